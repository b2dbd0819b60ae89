import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelattice.functions import stats
from cuelattice.operators import assoc, embed, evaluate, infer, linear, ratings, reports, sampling

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def triplets(spark, rows):
    return spark.createDataFrame(rows, "id long, cue string, r1 string, r2 string, r3 string")


def test_long_form_drops_missing(spark):
    rows = assoc.long_form(triplets(spark, [(1, " Dog ", "Cat", None, ""), (2, None, "x", "y", "z"), (3, "null", "NA", None, None)])).collect()
    assert {(r["id"], r["cue"], r["slot"], r["response_word"]) for r in rows} == {(1, "dog", "r1", "cat"), (3, "null", "r1", "na")}
    assert assoc.long_form(triplets(spark, [])).count() == 0


def test_response_sets_split_at_commas(spark):
    rows = assoc.exploded_sets(triplets(spark, [(1, "a", "x, y", None, "Z")])).collect()
    assert sorted(r["response"] for r in rows) == ["x", "y", "z"]


def test_threshold_is_at_least(spark):
    words = spark.createDataFrame([("four",)] * 4 + [("five",)] * 5, "w string")
    assert [r["word"] for r in assoc.frequent(words, "w").collect()] == ["five"]


def test_dense_index_is_the_sorted_place(spark):
    words = [f"w{k}" for k in range(500)] + ["É", "a", "A"]
    got = assoc.dense_index(spark.createDataFrame([(w,) for w in words], "w string").repartition(7), "w").collect()
    assert sorted((r["idx"], r["w"]) for r in got) == list(enumerate(sorted(words, key=lambda w: w.encode())))
    assert assoc.dense_index(spark.createDataFrame([], "w string"), "w").count() == 0


def test_ppmi_matches_numpy(spark):
    m = np.array([[5, 0, 1], [2, 3, 0], [0, 0, 4]], float)
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3)], "cue int, response int, n double")
    got = {(r["cue"], r["response"]): r["ppmi"] for r in assoc.ppmi(cells, ["cue"], ["response"]).collect()}
    for i, j in zip(*np.nonzero(m), strict=True):
        want = max(0, math.log2(m[i, j] * m.sum() / (m[i].sum() * m[:, j].sum() + 1e-10)))
        assert math.isclose(got[i, j], want, abs_tol=1e-12)
    assert len(got) == np.count_nonzero(m)


@few
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.one_of(st.none(), st.floats(-800, 0))), max_size=12))
def test_distributions_sum_to_one(spark, rows):
    got = assoc.row_distribution(spark.createDataFrame(rows, "cue string, response string, lp double"), ["cue"], "response").collect()
    sums = {}
    for r in got:
        sums[r["cue"]] = sums.get(r["cue"], 0) + r["prob"]
    assert all(math.isclose(s, 1) or s == 0 for s in sums.values())
    assert set(sums) == {c for c, _, lp in rows if lp is not None}


def test_folds_are_balanced(spark):
    df = sampling.folds(spark.createDataFrame([(g, i) for g in "ab" for i in range(23)], "g string, i int"), ["g"], ["i"], 5, 3)
    sizes = df.groupBy("g", "rep", "fold").count().collect()
    assert len(sizes) == 30 and {r["count"] for r in sizes} == {4, 5}


@few
@given(st.lists(st.sampled_from("abcdef"), min_size=2, max_size=30))
def test_derangement(spark, values):
    rows = [(i, "c", v, v, None) for i, v in enumerate(values)]
    df = triplets(spark, rows)
    most = max(values.count(v) for v in values)
    if 2 * most > len(values):
        with pytest.raises(ValueError):
            sampling.derange(df, "id", ["r1", "r2", "r3"])
        return
    out = sampling.derange(df, "id", ["r1", "r2", "r3"]).collect()
    assert sorted(r["r1"] for r in out) == sorted(values) and {r["id"] for r in out} == set(range(len(values)))
    assert all(r["r1"] != values[r["id"]] for r in out)


def test_derangement_moves_rows_little(spark):
    rows = spark.range(40_000).selectExpr("id", "'c' AS cue", "IF(id % 3 = 0, 'hot', concat('w', id % 7000)) AS r1", "concat('x', id % 11) AS r2", "IF(id % 5 = 0, NULL, 'y') AS r3")
    cols = ["r1", "r2", "r3"]
    after = sampling.derange(rows, "id", cols)
    # no md5 travels with the two sides
    text = after._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in text and "__t" not in text
    assert sampling.conflicts(rows, after, "id", cols).collect() == [(40_000, 0)]
    assert rows.select(cols).exceptAll(after.select(cols)).count() == 0
    same = rows.select("id", "cue", *(F.when(F.col("id") < 7, F.col(c)).otherwise(F.lit("z")).alias(c) for c in cols))
    assert sampling.conflicts(rows, same, "id", cols).collect() == [(40_000, 7)]
    assert sampling.conflicts(rows.limit(0), same, "id", cols).collect() == [(0, None)]
    swapped = spark.createDataFrame([(1, None, "a"), (2, "a", "b")], "id long, p string, q string")
    other = spark.createDataFrame([(1, "a", None), (2, "a", "b")], "id long, p string, q string")  # nulls are left out of hashes: alike, but not equal
    assert sampling.conflicts(swapped, other, "id", ["p", "q"]).collect() == [(2, 1)]


def test_places_of_many_ranges(spark):
    rows = spark.range(0, 5000, 1, 8).selectExpr("(id * 7919) % 5000 AS k", "id % 3 AS v")
    out = assoc.dense_index(rows, "k").collect()
    assert all(r["idx"] == r["k"] for r in out) and len(out) == 5000 and out[0].__fields__ == ["k", "v", "idx"]


def test_packs_are_full_whatever_the_batches(monkeypatch):
    import pyarrow as pa

    from cuelattice.operators import rangefinder

    monkeypatch.setattr(rangefinder, "PACK", 1000)
    ib = np.repeat([0, 1, 2], [2500, 1000, 30])
    cells = pa.table({"ib": ib, "jb": 0 * ib, "i": ib * rangefinder.SIDE + 3, "j": np.arange(len(ib)) % 50, "x": np.arange(len(ib)) / 7})
    for size in (1, 7, 400, 1000, 9999):
        found = [r for b in rangefinder._packed(iter(cells.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert [(r["ib"], len(r["xx"]) // 8) for r in found] == [(0, 1000), (0, 1000), (0, 500), (1, 1000), (2, 30)]
        assert b"".join(r["xx"] for r in found) == cells["x"].to_numpy().tobytes() and set(b"".join(r["ii"] for r in found)) == {0, 3}
    assert list(rangefinder._packed(iter([]))) == []


def test_tasks_of_large_tables_are_small(spark, tmp_path, monkeypatch):
    from cuelattice.sources import fixtures as fx

    spark.range(100_000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 256) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = fx.table(spark, str(tmp_path), "documents")
    assert fx.spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fx, "TASK_BYTES", 1 << 18, raising=False)
    monkeypatch.setattr(fx, "SPREAD_BYTES", 1 << 18, raising=False)
    assert 20 <= fx.spread(docs).rdd.getNumPartitions() <= 40  # 6.9 MB or so


@pytest.mark.parametrize("name", ["q03_response_set_explode", "q05_vocab_semi_filter", "q10_ppmi_counts"])
def test_counts_of_pairs_are_dealt_by_size(name, spark, data, monkeypatch):
    from cuelattice.queries import QUERIES
    from cuelattice.sources import fixtures as fx

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    few = QUERIES[name](spark, data).collect()
    monkeypatch.setattr(fx, "TASK_BYTES", 1 << 13)
    tasks = -(-int(str(fx.texts(spark, data)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (1 << 13))
    spark.conf.set(key, "false")
    try:
        many = QUERIES[name](spark, data)
        assert many.rdd.getNumPartitions() == tasks > 4
        assert sorted(many.collect()) == sorted(few)
    finally:
        spark.conf.unset(key)


def test_written_in_more_tasks(spark):
    from cuelattice.plans.session import written

    keys = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    spark.conf.set(keys[0], "false")
    try:
        counts = spark.range(100).selectExpr("id % 10 AS k").groupBy("k").count()
        assert [written(counts, n).rdd.getNumPartitions() for n in (23, 3)] == [23, 4]
        assert sorted(map(tuple, written(counts, 23).collect())) == [(k, 10) for k in range(10)]
        with pytest.raises(Exception, match="(?i)divi"):
            written(spark.range(9).selectExpr("1 / (id - 5) AS x").groupBy("x").count(), 23)
        assert spark.conf.get(keys[1]) == "4"
    finally:
        spark.conf.unset(keys[0])


def test_alignment_and_sanitation(spark):
    cues = spark.createDataFrame([("a",), ("b",), ("c",)], "cue string")
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "cue string, vec array<float>")
    got = {r["cue"]: (r["present"], r["vec"]) for r in embed.align(cues, vecs, 2).collect()}
    assert got == {"a": (True, [1, 2]), "b": (False, [0, 0]), "c": (False, [0, 0])}
    assert embed.align(cues, vecs, 2, drop_missing=True).count() == 1
    both = spark.createDataFrame([("k", "a", [1.0]), ("k", "b", [0.0]), ("l", "a", [float("nan")]), ("l", "b", [1.0]), ("k", "c", [1.0]), ("l", "c", [2.0])], "embedding_key string, cue string, vec array<double>")
    assert {r["cue"] for r in embed.sanitized(both).collect()} == {"c"}
    assert {r["embedding_key"]: r["n_bad"] for r in embed.culprits(both).collect()} == {"k": 1, "l": 1}


def test_target_dims(spark):
    keys = spark.createDataFrame([("human_matrix", "human_matrix"), ("passive_x", "x"), ("passive_y", "y")], "embedding_key string, model string")
    dims = spark.createDataFrame([("x", 64)], "model string, dim int")
    take = lambda **k: {r["embedding_key"]: r["target_dim"] for r in embed.target_dims(keys, dims, **k).collect()}
    assert take() == {"human_matrix": 300, "passive_x": 64, "passive_y": 300}
    assert take(strategy="fixed", fixed=50) == {"human_matrix": 300, "passive_x": 50, "passive_y": 50}
    assert take(strategy="mapping", mapping={"y": 7}) == {"human_matrix": 300, "passive_x": 300, "passive_y": 7}


@pytest.mark.parametrize(("n", "m", "side", "block"), [(12, 9, 1024, 1024), (9, 12, 1024, 5), (12, 9, 1024, 1), (12, 9, 0, 1)])
def test_svd_matches_numpy(spark, monkeypatch, n, m, side, block):
    monkeypatch.setattr(embed, "GRAM_SIDE", side)
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)), 0)
    cells = spark.createDataFrame([(f"c{i:02}", f"r{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cue string, response string, ppmi double")
    got, s = embed.truncated_svd(cells, 5)
    rows = {r["cue"]: r["vec"] for r in got.collect()}
    u, sigma, _ = np.linalg.svd(x)
    assert np.allclose(s, sigma[:5]) and list(s) == sorted(s, reverse=True)
    want = u[:, :5] * np.sqrt(sigma[:5])
    want *= np.sign(want[np.abs(want).argmax(axis=0), range(5)])
    assert np.allclose(np.array([rows[f"c{i:02}"] for i in range(n)]), want, atol=1e-8)
    tiny, none = embed.truncated_svd(cells.filter("response = 'r0'"), 4)
    assert none == [] and all(r["vec"] == [0, 0, 0, 0] for r in tiny.collect())


def test_svd_by_range_finder(spark):
    rng = np.random.default_rng(5)
    n, m, rank = 4200, 1100, 6  # more lines than a block has, and a smaller side beyond that of the Gram matrix
    left, right = rng.normal(size=(n, rank)) * (rng.random((n, 1)) < 0.1), rng.normal(size=(rank, m)) * (rng.random(m) < 0.1)
    x = left @ right
    x[np.arange(n), np.arange(n) % m] += np.where(np.abs(x[np.arange(n), np.arange(n) % m]) < 1e-9, 1e-3, 0)  # every line and place has a cell
    i, j = np.nonzero(np.abs(x) > 1e-9)
    cells = spark.createDataFrame(pd.DataFrame({"cue": i, "response": j, "ppmi": x[i, j]}))
    got, s = embed.truncated_svd(cells, rank)
    rows = {r["cue"]: r["vec"] for r in got.collect()}
    u, sigma, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :rank] * np.sqrt(sigma[:rank])
    want *= np.sign(want[np.abs(want).argmax(axis=0), range(rank)])
    assert np.allclose(s, sigma[:rank], rtol=1e-9) and len(rows) == n
    assert np.allclose(np.array([rows[k] for k in range(n)]), want, atol=1e-6)


def plain_fold_scores(x, y, fold, alphas, dims):
    """R2 by fold: of ridge on standardised columns with the penalty of the best leave-one-out errors, and by number of components."""
    ridge, widths = [], []
    r2 = lambda y, p: 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for f in np.unique(fold):
        a, b, t, u = x[fold != f], x[fold == f], y[fold != f], y[fold == f]
        std = np.where(a.std(axis=0) > 1e-12 * np.abs(a.mean(axis=0)), a.std(axis=0), 1)  # what is left of a constant by rounding is no deviation
        za, zb = (a - a.mean(axis=0)) / std, (b - a.mean(axis=0)) / std
        errors = []
        for alpha in alphas:
            hat = za @ np.linalg.inv(za.T @ za + alpha * np.eye(x.shape[1])) @ za.T
            errors.append((((t - t.mean() - hat @ (t - t.mean())) / (1 - 1 / len(t) - np.diag(hat))) ** 2).sum())
        w = np.linalg.solve(za.T @ za + alphas[int(np.argmin(errors))] * np.eye(x.shape[1]), za.T @ (t - t.mean()))
        ridge.append(r2(u, t.mean() + zb @ w))
        left, s, vt = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
        z = (b - a.mean(axis=0)) @ vt.T * (s / (s * s + 1) * (left.T @ (t - t.mean())))
        widths.append([r2(u, t.mean() + z[:, :d].sum(axis=1)) for d in dims])
    return ridge, np.array(widths)


def scored_rows(spark, groups, d, seed=1):
    rng = np.random.default_rng(seed)
    data = {}
    for g, n in groups.items():
        x = rng.normal(size=(n, d)) * rng.uniform(0.1, 3, d) + rng.normal(size=d) * 5
        x[:, -1] = 0.1  # a constant column
        data[g] = (x, x @ rng.normal(size=d) + rng.normal(size=n) * 2 + 100)
    rows = [("k", g, f"w{i:03}", x[i].tolist(), float(y[i])) for g, (x, y) in data.items() for i in range(len(y))]
    return data, spark.createDataFrame(rows, "embedding_key string, norm string, word string, vec array<double>, y double")


@pytest.mark.parametrize("chunk", [65536, 7])
def test_scores_equal_those_of_plain_regressions(spark, monkeypatch, chunk):
    monkeypatch.setattr(linear, "CHUNK", chunk)
    monkeypatch.setattr(linear, "MERGED", 3)
    keys, dims = ["embedding_key", "norm"], (1, 3, 6, 64)
    data, rows = scored_rows(spark, {"a": 120, "b": 57, "few": 30}, 6)
    ridge = {r["norm"]: r for r in evaluate.norm_scores(rows, keys, repeats=2).collect()}
    widths = {(r["norm"], r["dim"]): r["r2"] for r in evaluate.sweep(rows, keys, dims, repeats=2).collect()}
    assert set(ridge) == {"a", "b"} and {g for g, _ in widths} == {"a", "b"} and {d for _, d in widths} == {1, 3, 6}
    folds = sampling.fold_table(rows, keys, ["word"], 5, 2).toPandas().sort_values("word")
    for g in ridge:
        x, y = data[g]
        fold = np.stack(folds[folds["norm"] == g]["folds"])
        want = [plain_fold_scores(x, y, fold[:, rep], evaluate.ALPHAS["compare"], dims[:3]) for rep in range(2)]
        one = np.concatenate([w[0] for w in want])
        assert np.allclose([ridge[g]["r2_mean"], ridge[g]["r2_std"]], [one.mean(), one.std()], atol=1e-9, rtol=0)
        assert (ridge[g]["n_samples"], ridge[g]["dimensions"]) == (len(y), 6)
        assert np.allclose([widths[g, d] for d in dims[:3]], np.concatenate([w[1] for w in want]).mean(axis=0), atol=1e-9, rtol=0)


def test_regressions_on_no_rows_and_on_a_constant(spark):
    _, rows = scored_rows(spark, {"a": 60}, 3)
    assert evaluate.norm_scores(rows.limit(0), ["norm"]).count() == 0
    flat = evaluate.norm_scores(rows.withColumn("y", F.lit(2.0)), ["norm"]).first()
    assert (flat["r2_mean"], flat["r2_std"]) == (1.0, 0.0)


def test_folds_of_a_hot_group_are_split(spark):
    rows = spark.createDataFrame([(None if i % 5 else "b", i) for i in range(500)], "g string, i int")
    out = sampling.folds(rows, ["g"], ["i"], 4, 2)
    assert out.columns == ["g", "i", "rep", "fold"] and "partitionBy(g" not in out._jdf.queryExecution().toString()
    sizes = {(r["g"], r["rep"], r["fold"]): r["count"] for r in out.groupBy("g", "rep", "fold").count().collect()}
    assert {n for (g, *_), n in sizes.items() if g is None} == {100} and {n for (g, *_), n in sizes.items() if g == "b"} == {25}
    table = {(r["g"], r["i"]): r["folds"] for r in sampling.fold_table(rows, ["g"], ["i"], 4, 2).collect()}
    assert all(table[r["g"], r["i"]][r["rep"]] == r["fold"] for r in out.collect())


def test_gram(spark):
    data, rows = scored_rows(spark, {"a": 80}, 3)
    x = data["a"][0]
    gram = {(r["i"], r["j"]): r["value"] for r in evaluate.gram(rows, 3).collect()}
    assert np.allclose([gram[0, 1], gram[2, 2]], [(x.T @ x)[0, 1], (x.T @ x)[2, 2]])


def test_consensus_needs_models_and_words(spark):
    few_words = [(m, "n", f"w{k}", float(k + m)) for m in range(3) for k in range(9)]
    enough = [(m, "m", f"w{k}", float(k * (m + 1) % 7)) for m in range(3) for k in range(12)] + [(0, "m", "extra", 1.0)]
    got = ratings.consensus(spark.createDataFrame(few_words + enough, "model int, norm string, word string, rating double")).collect()
    assert {(r["norm"], r["n_shared_words"]) for r in got} == {("m", 12)} and len(got) == 3


def test_reports(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(6)], "k int, v double")
    ends = {r["k"]: r["end"] for r in reports.extremes(rows, "v", "k", 4).collect()}
    assert ends == {5: "top", 4: "top", 3: "top", 2: "top", 1: "bottom", 0: "bottom"}
    sat = {r["dim"]: r["status"] for r in reports.saturation(spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.107), ("a", 3, 0.108), ("a", 4, 0.2)], "modality string, dim int, r2 double")).collect()}
    assert sat == {1: "Rising", 2: "Plateauing", 3: "SATURATED", 4: "Rising"}
    up = reports.upsert(spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string"), ["k"])
    assert {tuple(r) for r in up.collect()} == {(1, "old"), (2, "new"), (3, "new")}
    twice = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "r string, c string, r2 double")
    with pytest.raises(Exception, match="pivot key"):
        reports.pivoted_unique(twice, ["r"], "c", ["x"]).collect()


def test_plug_ins(spark):
    words = spark.createDataFrame([("sun",), ("sea",)], "word string")
    asked = infer.prompts(words, infer.TEMPLATES)
    assert asked.count() == 30 and asked.filter(F.col("prompt").contains('"sun"')).count() == 15

    def make():
        return lambda prompts, responses: [[-1.0] * len(r.split(", ")) for r in responses]

    scored = infer.summed(infer.score(asked.withColumn("response_set", F.lit("a, b")), make)).first()
    assert scored["total_log_prob"] == -2 and scored["num_tokens"] == 2 and scored["normalized_log_prob"] == -1
    made = infer.generate(words.withColumn("prompt", F.col("word")), lambda: (lambda ps: [f"{p}, one, two" for p in ps]), 3)
    assert made.count() == 6 and made.first()["responses"][1:] == ["one", "two"]
    assert infer.yield_rate(made, ["word"]).first()["yield_rate"] == 1
    assert spark.range(1).select(infer.same_text(F.lit("a,b c"), F.lit("abc")).alias("x"), infer.separator(F.lit(" ,")).alias("s")).first()[:] == (True, True)


def test_word_vectors_are_pooled_over_their_span(spark):
    def make():
        def model(sentences):
            return [[(0, 0, [9.0]), *((k, k + 1, [float(k)]) for k in range(len(s)))] for s in sentences]

        return model

    words = spark.createDataFrame([("sun",), ("sea",)], "word string")
    take = lambda **k: {r["word"]: r["vec"] for r in infer.embed(words, make, **k).collect()}
    assert take(template="a {word}.") == {"sun": [3.0], "sea": [3.0]}
    assert take(template="a {word}.", how="last")["sun"] == [4.0] and take(template="none")["sun"] is None


def spread_values(spark, seed=0):
    rng = np.random.default_rng(seed)
    data = {"even": rng.random(5000) * 100, "far": np.concatenate([rng.normal(size=3000), [1e300, -1e300, 1e-300]]), "same": np.full(3000, 2.5), "few": np.array([3.0, 1.0, 2.0]), "one": np.array([7.0]), "ties": rng.integers(0, 3, 4000).astype(float)}
    rows = [(g, k, float(x)) for g, v in data.items() for k, x in enumerate(v)] + [("even", -1, None), ("even", -2, float("nan")), (None, 1, 4.0), (None, 2, 6.0)]
    return data, spark.createDataFrame(rows, "g string, k int, x double")


def test_quantiles_are_exact(spark):
    data, rows = spread_values(spark)
    probabilities = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["g"], r["p"]): r["quantile"] for r in reports.quantiles(rows, ["g"], "x", probabilities).collect()}
    assert len(got) == 7 * 5 and got[None, 0.5] == 5.0
    for g, v in data.items():
        assert np.allclose([got[g, p] for p in probabilities], np.quantile(v, probabilities), rtol=1e-12), g
    assert reports.quantiles(rows.limit(0), ["g"], "x", (0.5,)).count() == 0
    sketch = {r["g"]: r["median"] for r in reports.distribution(rows.filter("g in ('even', 'ties')"), ["g"], "x", 100).collect()}
    ranks = np.searchsorted(np.sort(data["even"]), sketch["even"]) / 5000
    assert abs(ranks - 0.5) <= 0.01 + 1e-3


def test_bootstrap_interval_covers_like_the_normal_one(spark):
    rng = np.random.default_rng(3)
    x = rng.exponential(10, 2000)
    rows = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [("one", 0, 5.0), ("none", 0, None)], "g string, k int, x double")
    got = {r["g"]: r for r in reports.bootstrap(rows, ["g"], "x", "k", 200).collect()}
    half = 1.96 * x.std() / np.sqrt(len(x))
    assert abs(got["a"]["mean"] - x.mean()) < 1e-9 and got["a"]["n_replicates"] == 200
    assert abs(got["a"]["ci_low"] - (x.mean() - half)) < 0.25 * half and abs(got["a"]["ci_high"] - (x.mean() + half)) < 0.25 * half
    assert got["one"]["ci_low"] == got["one"]["ci_high"] == 5.0 and 90 < got["one"]["n_replicates"] < 160 and "none" not in got
    again = {r["g"]: r["ci_low"] for r in reports.bootstrap(rows.repartition(7), ["g"], "x", "k", 200).collect()}
    assert abs(again["a"] - got["a"]["ci_low"]) < 1e-9


def test_poisson_weights():
    steps = stats.poisson_steps()
    share = np.diff([0, *steps]) / 65536
    assert np.allclose(share[:5], [np.exp(-1) / math.factorial(k) for k in range(5)], atol=1e-4) and steps == sorted(steps)


def test_density_is_that_of_the_kernel(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 1500), rng.normal(6, 0.5, 500)])
    rows = spark.createDataFrame([("a", float(v)) for v in x] + [("flat", 1.0)] * 3 + [("a", None)], "g string, x double")
    got = sorted((r["bin"], r["x"], r["density"]) for r in reports.density(rows, ["g"], "x", 128).collect())
    assert len(got) == 128 and all(d >= -1e-12 for *_, d in got)
    w = (x.max() - x.min()) / 128
    h = max(x.std() * len(x) ** -0.2, w)
    own = np.minimum(np.floor((x - x.min()) / w), 127)
    at = np.arange(128)
    k = 1 - ((at[:, None] - own[None, :]) * w / h) ** 2
    k[np.abs(at[:, None] - own[None, :]) > np.floor(h / w)] = 0
    assert np.allclose([d for *_, d in got], 0.75 * k.sum(axis=1) / (len(x) * h), atol=1e-12)
    assert abs(sum(d for *_, d in got) * w - 1) < 0.02


def test_paired_scores_use_the_same_words(spark):
    _, rows = scored_rows(spark, {"a": 90}, 3)
    v = rows.select("word", "vec")
    key = lambda name, df: df.select(F.lit(name).alias("embedding_key"), F.col("word").alias("cue"), "vec")
    behavior = key("passive_m-1b", v).unionByName(key("passive_m-1b_shuffled", v)).unionByName(key("human_matrix", v)).unionByName(key("passive_other", v))
    hole = F.when(F.col("word") < "w010", F.array(F.lit(float("nan")))).otherwise(F.transform("vec", lambda x: -x))
    activation = key("activation_m-1b", v.select("word", hole.alias("vec")))
    (r,) = evaluate.paired_scores(behavior, activation, rows.select("norm", "word", "y")).collect()
    assert (r["model"], r["norm"], r["n_samples"]) == ("M 1b", "a", 80) and abs(r["delta"]) < 1e-9
    assert evaluate.paired_scores(behavior, activation, rows.select("norm", "word", "y"), most=40).count() == 0
