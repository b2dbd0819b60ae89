"""Every operator as a query over the driver's tables, with the DuckDB statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import stats
from cuelattice.functions import text as tx
from cuelattice.functions import vectors as vx
from cuelattice.operators import assoc, embed, evaluate, infer, inputs, ratings, reports, sampling
from cuelattice.plans import pipeline
from cuelattice.plans.session import written
from cuelattice.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return put


def r6(c) -> F.Column:
    """Rounded for comparison: six digits, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def ratings_view(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.coerced(fx.ratings(spark, sf))


def means_view(spark: SparkSession, sf: str) -> DataFrame:
    return ratings_view(spark, sf).groupBy("model", "norm", "word").agg(F.avg("rating").alias("rating"))


def vectors_view(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "embeddings").select(F.lit("emb").alias("embedding_key"), F.col("vec_id").alias("cue"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


# --- text and association tables ----------------------------------------------------------------------------------------


@query("q01_assoc_unpivot", fx.over("long") + "SELECT id, cue, slot, response_word FROM long")
def q01(spark, sf):
    return assoc.long_form(fx.triplets(spark, sf))


@query("q02_vocab_min_freq", fx.over("pairs") + "SELECT word, n, row_number() OVER (ORDER BY word) - 1 AS idx FROM (SELECT response AS word, count(*) AS n FROM pairs GROUP BY 1 HAVING count(*) >= 5)")
def q02(spark, sf):
    return assoc.dense_index(assoc.frequent(fx.pairs(spark, sf), "response"), "word")


@query(
    "q03_response_set_explode",
    fx.over("triplets")
    + """SELECT cue, trim(part) AS response, count(*) AS n FROM (SELECT lower(cue) AS cue, unnest(string_split(concat_ws(', ', lower(r1), lower(r2), lower(r3)), ',')) AS part FROM triplets) GROUP BY ALL""",
)
def q03(spark, sf):
    return written(assoc.pair_counts(assoc.exploded_sets(fx.triplets(spark, sf))), fx.tasks_for(fx.texts(spark, sf)))


@query("q04_rating_coercion", fx.over("rated") + "SELECT row_id, model, norm, word, rating FROM rated")
def q04(spark, sf):
    return ratings_view(spark, sf).select("row_id", "model", "norm", "word", "rating")


_VOCABULARY = "SELECT response AS word FROM pairs GROUP BY 1 HAVING count(*) >= 5"
_COUNTS = "SELECT cue, response, count(*) AS n FROM pairs WHERE cue IN (SELECT word FROM vocabulary) AND response IN (SELECT word FROM vocabulary) GROUP BY ALL"


def counts_view(spark, sf) -> DataFrame:
    # pairs are counted first: the vocabulary and the filter then work on counts, which are fewer
    tasks = fx.tasks_for(fx.texts(spark, sf))
    counts = written(assoc.pair_counts(fx.pairs(spark, sf)), tasks)
    vocabulary = counts.groupBy(F.col("response").alias("word")).agg(F.sum("n").alias("n")).filter("n >= 5")
    return assoc.in_vocabulary(counts, vocabulary, "cue", "response", tasks=tasks)


@query("q05_vocab_semi_filter", fx.over("pairs", vocabulary=_VOCABULARY) + _COUNTS)
def q05(spark, sf):
    return counts_view(spark, sf)


@query(
    "q06_substring_predicates",
    """SELECT source, count(*) FILTER (text ILIKE '%TION%') AS n_contains, count(*) FILTER (contains(text, 'ing ') OR contains(text, 'ment ')) AS n_any,
       count(*) FILTER (NOT coalesce(contains(nullif(lang, 'de'), 'e'), false)) AS n_null_false, count(*) FILTER (NOT contains(lower(text), 'deranged')) AS n_without FROM documents GROUP BY source""",
)
def q06(spark, sf):
    docs = fx.table(spark, sf, "documents")
    text = F.col("text")
    return docs.groupBy("source").agg(
        F.count_if(tx.contains_text(text, "tion")).alias("n_contains"),
        F.count_if(tx.contains_any(text, ["ing ", "ment "])).alias("n_any"),
        F.count_if(~tx.contains_any(F.nullif("lang", F.lit("de")), ["e"])).alias("n_null_false"),
        F.count_if(~tx.contains_any(F.lower(text), ["deranged"])).alias("n_without"),
    )


@query("q07_group_sample", """SELECT norm, row_id FROM (SELECT l_returnflag AS norm, l_orderkey * 10 + l_linenumber AS row_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) || '|42'), l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k <= 640""")
def q07(spark, sf):
    return sampling.sample_by_group(fx.ratings(spark, sf).select("norm", "row_id"), ["norm"], ["row_id"], 640)


@query("q07_shards", "SELECT CAST(l_orderkey % 8 AS INT) AS shard, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM lineitem GROUP BY 1")
def q07_shards(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    shard = lambda i: sampling.shard(li, "l_orderkey", 8, i).agg(F.lit(i).alias("shard"), F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))
    out = shard(0)
    for i in range(1, 8):
        out = out.unionByName(shard(i))
    return out.filter("n > 0")


@query("q08_resume_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q08(spark, sf):
    done = fx.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return infer.unfinished(fx.table(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


def _sub(x: str, *pairs: tuple[str, str]) -> str:
    for p, r in pairs:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


_PASSIVE = _sub("raw", ("passive_|-instruct|_300d", ""))
_MODEL = f"""CASE WHEN raw = 'human_matrix' THEN 'Human' WHEN starts_with(raw, 'activation_') THEN {_sub("raw", ("activation_|-instruct", ""))}
         WHEN starts_with(raw, 'passive_') THEN CASE WHEN contains(raw, '_contrast') THEN replace({_PASSIVE}, '_contrast', '') ELSE replace({_PASSIVE}, '_shuffled', '') END ELSE 'Unknown' END"""
_TYPE = """CASE WHEN raw = 'human_matrix' THEN 'Baseline' WHEN starts_with(raw, 'activation_') THEN 'Activation'
         WHEN starts_with(raw, 'passive_') THEN CASE WHEN contains(raw, '_contrast') THEN 'Behavior_Contrastive' WHEN contains(raw, '_shuffled') THEN 'Behavior_Shuffled' ELSE 'Behavior_Standard' END
              || CASE WHEN contains(raw, '_300d') THEN '_300d' ELSE '' END ELSE 'Unknown' END"""
_DISPLAY = "regexp_replace(regexp_replace(raw, '-instruct|-base', '', 'g'), '^[-_]+|[-_]+$', '', 'g')"


@query(
    "q09_model_name_rules",
    fx.over("names")
    + f"""SELECT raw,
    {_sub("lower(trim(replace(replace(raw, '-deranged-results', ''), '-results', '')))", ("[ _]", "-"), ("([a-z])([0-9])", r"\1-\2"), ("([0-9])([a-z])", r"\1-\2"), ("-{2,}", "-"))} AS normalized,
    replace({_sub("raw", ("^(passive_|activation_|active_)", ""))}, '-b-', 'b-') AS sweep_key,
    replace({_sub("raw", ("^(passive_|activation_|active_)", ""), ("_contrast|_shuffled|_300d", ""))}, '_', '-') AS bare_key,
    regexp_replace(raw, '-b$', 'b') AS size_key, {_sub("raw", ("-instruct|-base|[-_]", ""))} AS joined_key, {_sub("raw", (r"[^\p{L}\p{N}._-]", "_"))} AS file_name,
    {_MODEL} AS model,
    {_TYPE} AS embedding_type,
    CASE {_DISPLAY} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.DISPLAY.items())}
         ELSE array_to_string(list_transform(string_split({_sub(_DISPLAY, ("[-_]", " "))}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS display FROM names""",
)
def q09(spark, sf):
    c = F.col("raw")
    rows = fx.names_of_embeddings(spark, sf)
    return rows.select(
        c, tx.model_name(c).alias("normalized"), tx.sweep_name(c).alias("sweep_key"), tx.bare_name(c).alias("bare_key"), tx.size_name(c).alias("size_key"), tx.joined_name(c).alias("joined_key"),
        tx.safe_name(c).alias("file_name"), tx.key_model(c).alias("model"), tx.key_type(c).alias("embedding_type"), tx.display_name(c).alias("display"),
    )


@query(
    "q09_wanted_keys",
    fx.over("names") + f", k AS (SELECT raw, {_MODEL} AS model, {_TYPE} AS kind FROM names) SELECT raw AS embedding_key FROM k WHERE kind IN (" + ", ".join(f"'{t}'" for t in tx.WANTED_TYPES) + ") AND (kind IN ('Activation', 'Baseline') OR model IN (SELECT model FROM k WHERE kind = 'Activation'))",
)
def q09_wanted(spark, sf):
    return evaluate.wanted_keys(fx.names_of_embeddings(spark, sf).select(F.col("raw").alias("embedding_key")))


def ppmi_sql(cells: str, row: str, col: str, value: str) -> str:
    return f"greatest(0, log2({value} * (SELECT sum({value}) FROM {cells}) / (sum({value}) OVER (PARTITION BY {row}) * sum({value}) OVER (PARTITION BY {col}) + 1e-10)))"


@query("q10_ppmi_counts", fx.over("pairs", vocabulary=_VOCABULARY, counts=_COUNTS) + f"SELECT cue, response, n, round({ppmi_sql('counts', 'cue', 'response', 'n')}, 6) + 0.0 AS ppmi FROM counts")
def q10(spark, sf):
    return assoc.ppmi(counts_view(spark, sf), ["cue"], ["response"], tasks=fx.tasks_for(fx.texts(spark, sf))).select("cue", "response", "n", r6("ppmi").alias("ppmi"))


def _distribution_sql(source: str) -> str:
    return f"SELECT model, cue, response, p / sum(p) OVER (PARTITION BY model, cue) AS prob FROM (SELECT model, cue, response, exp(avg(lp)) AS p FROM {source} GROUP BY ALL)"


@query(
    "q11_logprob_distribution",
    fx.over(real=fx.log_probs_sql(), other=fx.log_probs_sql(17), cells=f"SELECT *, 'real' AS block FROM ({_distribution_sql('real')}) UNION ALL SELECT *, 'shuffled' FROM ({_distribution_sql('other')})")
    + """SELECT model, cue, response, block, round(prob, 6) AS prob, round(greatest(0, log2(prob * sum(prob) OVER (PARTITION BY model) / (sum(prob) OVER (PARTITION BY model, cue) * sum(prob) OVER (PARTITION BY model, block, response) + 1e-10))), 6) + 0.0 AS ppmi FROM cells""",
)
def q11(spark, sf):
    dist = lambda shift: assoc.row_distribution(fx.log_probs(spark, sf, shift), ["model", "cue"], "response")
    cells = assoc.side_by_side(dist(0), dist(17))
    scored = assoc.ppmi(cells, ["cue"], ["block", "response"], "prob", by=("model",))
    return scored.select("model", "cue", "response", "block", r6("prob").alias("prob"), r6("ppmi").alias("ppmi"))


def _passive_sql(source: str, variant: str, response: str = "CAST(response AS VARCHAR)") -> str:
    return f"SELECT 'passive_' || model || '{variant}' AS embedding_key, cue, {response} AS response, prob FROM ({_distribution_sql(source)})"


@query(
    "q11_model_matrices",
    fx.over(
        real=fx.log_probs_sql(),
        other=fx.log_probs_sql(17),
        cells=" UNION ALL ".join([_passive_sql("real", ""), _passive_sql("other", "_shuffled"), _passive_sql("real", "_contrast", "'real:' || response"), _passive_sql("other", "_contrast", "'shuffled:' || response")]),
    )
    + """SELECT embedding_key, cue, response, round(greatest(0, log2(prob * sum(prob) OVER (PARTITION BY embedding_key) / (sum(prob) OVER (PARTITION BY embedding_key, cue) * sum(prob) OVER (PARTITION BY embedding_key, response) + 1e-10))), 6) + 0.0 AS ppmi FROM cells""",
)
def q11_matrices(spark, sf):
    scores = lambda shift: fx.log_probs(spark, sf, shift).withColumn("response", F.col("response").cast("string"))
    return pipeline.passive_cells(scores(0), scores(17)).select("embedding_key", "cue", "response", r6("ppmi").alias("ppmi"))


_LOW = r"regexp_replace(lower(text), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_BODY = rf"regexp_replace(regexp_replace(regexp_replace(string_split({_LOW}, '</think>')[-1], '[\n\r]', ',', 'g'), '^\d+\.\s*', ''), '^-\s*', '')"
_PARTS = rf"list_filter(list_transform(string_split({_BODY}, ','), lambda p: trim(regexp_replace(regexp_replace(p, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[^\p{{L}}\p{{N}}\- ]', '', 'g'))), lambda w: w <> '' AND w NOT IN ('sure', 'here', 'association'))"
_REFUSED = " OR ".join(f"contains({_LOW}, '{x}')" for x in tx.REFUSALS)
_ANSWERS = f"CASE WHEN {_REFUSED} THEN [] ELSE list_filter({_PARTS}, lambda w, i: list_position({_PARTS}, w) = i)[1:3] END"


@query("q12_generation_parse", f"SELECT conv_id, turn, role, array_to_string(words, '|') AS words, CAST(len(words) AS INT) AS n_words FROM (SELECT conv_id, turn, role, {_ANSWERS} AS words FROM conversations)")
def q12(spark, sf):
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role", tx.answers(F.col("text")).alias("words"))
    return rows.select("conv_id", "turn", "role", F.array_join("words", "|").alias("words"), F.size("words").alias("n_words"))


@query("q12_yield_rate", f"WITH g AS (SELECT role, {_ANSWERS} AS words FROM conversations) SELECT role, avg(CASE WHEN len(words) = 3 THEN 1.0 ELSE 0.0 END) AS yield_rate, count(*) AS n_generations, CASE WHEN avg(CASE WHEN len(words) = 3 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS status FROM g GROUP BY role")
def q12_yield(spark, sf):
    rows = fx.table(spark, sf, "conversations").withColumn("responses", tx.answers(F.col("text")))
    return infer.yield_rate(rows, ["role"])


@query("q12_json_fields", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS sum_k, count(*) FILTER (props ->> '$.missing' IS NULL) AS n_missing FROM events GROUP BY event_type")
def q12_json(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("n_missing"))


_CELL = """'"' || replace({}, '"', '""') || '"'"""


@query("q12_csv_lines", f"SELECT c_custkey, {_CELL.format('c_name')} || ',' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ',' || coalesce({_CELL.format(chr(110) + 'ullif(c_mktsegment, ' + chr(39) + 'BUILDING' + chr(39) + ')')}, 'NA') AS line FROM customer")
def q12_csv(spark, sf):
    from cuelattice.sources.sinks import quoted_line

    cells = [(F.col("c_name"), "text"), (F.col("c_acctbal"), "number"), (F.nullif("c_mktsegment", F.lit("BUILDING")), "text")]
    return fx.table(spark, sf, "customer").select("c_custkey", quoted_line(cells).alias("line"))


# --- vectors ------------------------------------------------------------------------------------------------------------


@query(
    "q13_vector_align",
    "SELECT doc_id AS cue, vec_id IS NOT NULL AS present, CAST(coalesce(len(embedding), 64) AS INT) AS dim, round(coalesce(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0.0), 6) AS norm FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
)
def q13(spark, sf):
    cues = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("cue"))
    out = embed.align(cues, vectors_view(spark, sf).select("cue", "vec"), 64)
    return out.select("cue", "present", F.size("vec").alias("dim"), r6(vx.norm(F.col("vec"))).alias("norm"))


@query("q14_embedding_catalog", "SELECT 'emb_' || label AS embedding_key, count(*) AS n_rows, max(CAST(len(embedding) AS INT)) AS dim, min(CAST(len(embedding) AS INT)) AS dim_least FROM embeddings GROUP BY 1")
def q14(spark, sf):
    return embed.catalog(vectors_view(spark, sf).withColumn("embedding_key", F.concat(F.lit("emb_"), F.col("label").cast("string"))))


@query(
    "q14_target_dims",
    fx.over("names")
    + f", keys AS (SELECT raw, {_sub('raw', ('^(passive_|activation_|active_)', ''))} AS model FROM names), dims AS (SELECT 'rnj-1-8b' AS model, CAST(max(len(embedding)) AS INT) AS dim FROM embeddings) SELECT raw AS embedding_key, keys.model AS model, CASE WHEN raw = 'human_matrix' THEN 300 ELSE coalesce(dim, 300) END AS target_dim FROM keys LEFT JOIN dims USING (model)",
)
def q14_dims(spark, sf):
    keys = fx.names_of_embeddings(spark, sf).select(F.col("raw").alias("embedding_key"), F.regexp_replace("raw", "^(passive_|activation_|active_)", "").alias("model"))
    dims = vectors_view(spark, sf).select(F.lit("rnj-1-8b").alias("model"), F.size("vec").alias("dim"))
    return embed.target_dims(keys, dims)


@query("q15_row_sanitize", "SELECT k AS embedding_key, vec_id AS cue FROM embeddings, (SELECT unnest(['a', 'b', 'c']) AS k) WHERE vec_id % 17 <> 0 AND vec_id % 23 <> 0 AND vec_id % 29 <> 0")
def q15(spark, sf):
    v = vectors_view(spark, sf).select("cue", "vec")
    nan = F.transform("vec", lambda x: F.lit(float("nan")))
    many = v.withColumn("embedding_key", F.lit("a")).unionByName(v.withColumn("embedding_key", F.lit("b")).withColumn("vec", F.when(F.col("cue") % 17 == 0, vx.zeros(64)).when(F.col("cue") % 23 == 0, nan).otherwise(F.col("vec"))))
    many = many.unionByName(v.filter("cue % 29 <> 0").withColumn("embedding_key", F.lit("c")))
    return embed.sanitized(many).select("embedding_key", "cue")


@query("q16_svd_embedding")
def q16(spark, sf):
    docs = fx.spread(fx.table(spark, sf, "documents").select("source", "text")).select(F.col("source").alias("cue"), F.explode(F.split(F.lower("text"), fx.WORDS)).alias("response")).filter("response <> ''")
    vectors, _ = embed.truncated_svd(assoc.ppmi(assoc.pair_counts(docs), ["cue"], ["response"]), 16)
    return vectors.select("cue", F.posexplode("vec").alias("component", "value"))


@query(
    "q16_svd_identities",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT a.vec_id AS row_id, b.vec_id AS other_id, round(list_dot_product(a.v, b.v) + 14 * list_dot_product(a.v[1:16], b.v[1:16]) + list_sum(a.v[1:16]) * list_sum(b.v[1:16]), 6) + 0.0 AS product
FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id AND a.vec_id + 4""",
)
def q16_identities(spark, sf):
    """The matrix of vectors and the sums of every two of their first 16 components, decomposed by the range finder: U S**2 U' is its rows' products."""
    v = vectors_view(spark, sf).select("cue", "vec")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.transform(F.sequence(i + 1, F.lit(15)), lambda j: F.get("vec", i) + F.get("vec", j))))
    cells = v.select("cue", F.posexplode(F.concat("vec", pairs)).alias("response", "ppmi"))
    vectors, s = embed.truncated_svd(cells, 64, gram_side=0)
    near = vectors.select(F.col("cue").alias("row_id"), F.col("vec").alias("a"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("cue") + k)).alias("other_id"))
    met = near.join(vectors.select(F.col("cue").alias("other_id"), F.col("vec").alias("b")), "other_id")
    terms = F.zip_with(F.zip_with("a", "b", lambda x, y: x * y), F.array(*map(F.lit, s)), lambda x, y: x * F.coalesce(y, F.lit(0.0)))
    return met.select("row_id", "other_id", r6(F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)).alias("product"))


@query(
    "q17_model_overlap",
    fx.over("names")
    + f", k AS (SELECT raw AS k, replace({_sub('raw', ('^(passive_|activation_|active_)', ''))}, '-b-', 'b-') AS c FROM names) SELECT b.c AS canonical, max(b.k) AS behavior_key, max(a.k) AS activation_key FROM k b JOIN k a ON b.c = a.c WHERE starts_with(b.k, 'passive_') AND starts_with(a.k, 'activation_') GROUP BY 1",
)
def q17(spark, sf):
    keys = fx.names_of_embeddings(spark, sf).select(F.col("raw").alias("embedding_key"), tx.sweep_name(F.col("raw")).alias("canonical"))
    return evaluate.overlap(keys.filter(F.col("embedding_key").startswith("passive_")), keys.filter(F.col("embedding_key").startswith("activation_")))


@query("q17_strict_overlap", "WITH s AS (SELECT DISTINCT c_mktsegment AS canonical FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000) SELECT c_custkey, c_mktsegment AS canonical FROM customer WHERE c_mktsegment IN (SELECT canonical FROM s)")
def q17_strict(spark, sf):
    customers = fx.table(spark, sf, "customer")
    rich = fx.table(spark, sf, "orders").filter("o_totalprice > 450000").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("canonical"))
    return evaluate.strict_overlap(customers.select("c_custkey", F.col("c_mktsegment").alias("canonical")), rich).select("c_custkey", "canonical")


#: Fixed mapping of embedding keys to files of model ratings.
MAPPING = tx.OWN_RATING_FILES
_MAPPED, _FILES = sorted(MAPPING), sorted(set(MAPPING.values()))


@query(
    "q17_mapping",
    "WITH m(k, f) AS (VALUES " + ", ".join(f"('{k}', '{f}')" for k, f in MAPPING.items()) + f"), keys AS (SELECT DISTINCT {fx._pick_sql([*_MAPPED[::2], 'x'], 'p_partkey')} AS k FROM part), files AS (SELECT DISTINCT {fx._pick_sql([*_FILES[1:], 'y'], 's_suppkey')} AS f FROM supplier) SELECT k AS embedding_key, f AS norm_file FROM m JOIN keys USING (k) JOIN files USING (f)",
)
def q17_mapping(spark, sf):
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    keys = fx.table(spark, sf, "part").select(pick([*_MAPPED[::2], "x"], "p_partkey").alias("embedding_key"))
    files = fx.table(spark, sf, "supplier").select(pick([*_FILES[1:], "y"], "s_suppkey").alias("norm_file"))
    return evaluate.by_mapping(keys, files, MAPPING)


#: Fixed list of models that may be ordered.
_LISTED = [f"{m}{x}{v}" for m in fx.MODALITIES for x in fx.MODELS for v in fx.VARIANTS[:3]]


@query("q09_model_order", fx.over("names") + "SELECT raw, row_number() OVER (ORDER BY CASE WHEN contains(lower(raw), 'instruct') THEN 0 ELSE 1 END, raw) - 1 AS place FROM names WHERE raw IN (" + ", ".join(f"'{n}'" for n in _LISTED) + ")")
def q09_order(spark, sf):
    rows = fx.names_of_embeddings(spark, sf).select("raw").filter(tx.allowed(F.col("raw"), _LISTED))
    return assoc.dense_index(rows.withColumn("later", F.when(tx.tuned(F.col("raw")), 0).otherwise(1)), "later", "raw", name="place").select("raw", "place")


@query(
    "q18_task_alignment",
    fx.over("rated", t="SELECT norm, word, avg(rating) AS y_mean, arg_max(rating, {'a': row_id, 'b': rating}) AS y_last FROM rated GROUP BY ALL")
    + "SELECT norm, count(*) AS n_overlap, round(avg(y_mean), 6) AS mean_target, round(sum(y_last), 6) AS last_target FROM t JOIN embeddings ON vec_id = word GROUP BY norm",
)
def q18(spark, sf):
    rows = ratings_view(spark, sf)
    mean, last = evaluate.targets(rows), evaluate.targets(rows, "last", F.struct("row_id", "rating")).withColumnRenamed("y", "y_last")
    joined = evaluate.aligned(vectors_view(spark, sf), mean).join(last, ["norm", "word"])
    return joined.groupBy("norm").agg(F.count(F.lit(1)).alias("n_overlap"), r6(F.avg("y")).alias("mean_target"), r6(F.sum("y_last")).alias("last_target"))


def regression_rows(spark, sf) -> DataFrame:
    return evaluate.aligned(vectors_view(spark, sf), evaluate.targets(ratings_view(spark, sf)))


def plane(rows: DataFrame) -> DataFrame:
    """Rows with the first two components of their vectors, for which regressions have closed forms."""
    return rows.withColumn("vec", F.slice("vec", 1, 2))


def _folds_sql(repeats: int = 1, where: str = "") -> str:
    """Rows of the plane in their folds (r), and each (norm, repetition, fold) as a training set with its means (m)."""
    return fx.over(
        "rated",
        t=f"SELECT norm, word, avg(rating) AS y FROM rated {where} GROUP BY ALL",
        p="SELECT norm, word, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, y FROM t JOIN embeddings ON vec_id = word",
        r=f"SELECT *, (row_number() OVER (PARTITION BY norm, rep ORDER BY md5(word || '|' || rep || '|42'), word) - 1) % 5 AS fold, count(*) OVER (PARTITION BY norm, rep) AS n_samples FROM p, (SELECT unnest(range({repeats})) AS rep)",
        f="SELECT unnest(range(5)) AS f",
        m="SELECT norm, rep, f, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM r, f WHERE fold <> f GROUP BY ALL",
    )


def _ridge_sql(preset: str, repeats: int = 1, where: str = "") -> str:
    """(norm, rep, f, n_samples, r2) as table k: ridge regressions on the plane, each with the penalty of the least leave-one-out errors."""
    alphas = ", ".join(repr(float(a)) for a in evaluate.ALPHAS[preset])
    return (
        _folds_sql(repeats, where)
        + f""", z AS (SELECT r.norm, r.rep, f, fold <> f AS train, n, n_samples, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, y - my AS y FROM r JOIN m ON r.norm = m.norm AND r.rep = m.rep),
g AS (SELECT norm, rep, f, sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c, sum(z1 * y) AS p, sum(z2 * y) AS q FROM z WHERE train GROUP BY ALL),
w AS (SELECT *, (a + alpha) * (c + alpha) - b * b AS det FROM g, (SELECT unnest([{alphas}]) AS alpha)),
e AS (SELECT norm, rep, f, alpha, train, n_samples, y, y - z1 * ((c + alpha) * p - b * q) / det - z2 * ((a + alpha) * q - b * p) / det AS off, 1 - 1 / n - (z1 * z1 * (c + alpha) - 2 * z1 * z2 * b + z2 * z2 * (a + alpha)) / det AS rest FROM z JOIN w USING (norm, rep, f)),
s AS (SELECT norm, rep, f, alpha, max(n_samples) AS n_samples, sum((off / rest) * (off / rest)) FILTER (train) AS loo, 1 - sum(off * off) FILTER (NOT train) / (count(*) FILTER (NOT train) * var_pop(y) FILTER (NOT train)) AS r2 FROM e GROUP BY ALL),
k AS (SELECT norm, rep, f, max(n_samples) AS n_samples, arg_min(r2, loo) AS r2 FROM s GROUP BY ALL)
"""
    )


@query(
    "q19_fold_assignment",
    "SELECT label, vec_id, rep, CAST((row_number() OVER (PARTITION BY label, rep ORDER BY md5(vec_id || '|' || rep || '|42'), vec_id) - 1) % 5 AS INT) AS fold FROM embeddings, (SELECT unnest([0, 1, 2, 3, 4]) AS rep)",
)
def q19_folds(spark, sf):
    return sampling.folds(fx.table(spark, sf, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], 5, 5)


@query("q19_dimension_sweep")
def q19(spark, sf):
    rows = evaluate.sweep_rows(vectors_view(spark, sf), ratings_view(spark, sf))
    return evaluate.sweep(rows, ["embedding_key", "norm"]).select("embedding_key", "norm", "dim", r6("r2").alias("r2"), "n_samples")


@query(
    "q19_plane_sweep",
    _folds_sql()
    + """, g AS (SELECT norm, f, any_value(n) AS n, sum((x1 - m1) * (x1 - m1)) AS a, sum((x1 - m1) * (x2 - m2)) AS b, sum((x2 - m2) * (x2 - m2)) AS c, sum((x1 - m1) * (y - my)) AS p, sum((x2 - m2) * (y - my)) AS q FROM r JOIN m USING (norm, rep) WHERE fold <> f GROUP BY ALL),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM g),
v AS (SELECT norm, f, l1, l2, p, q, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS u, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS w FROM e),
o AS (SELECT norm, f, n_samples, y, my + ((x1 - m1) * u + (x2 - m2) * w) * (u * p + w * q) / (l1 + 1) AS one, ((x2 - m2) * u - (x1 - m1) * w) * (u * q - w * p) / (l2 + 1) AS more FROM r JOIN m USING (norm, rep) JOIN v USING (norm, f) WHERE fold = f),
s AS (SELECT norm, f, dim, any_value(n_samples) AS n_samples, 1 - sum((y - one - (dim - 1) * more) * (y - one - (dim - 1) * more)) / (count(*) * var_pop(y)) AS r2 FROM o, (SELECT unnest([1, 2]) AS dim) GROUP BY ALL)
SELECT 'emb' AS embedding_key, norm, CAST(dim AS INT) AS dim, round(avg(r2), 6) + 0.0 AS r2, max(n_samples) AS n_samples FROM s GROUP BY ALL""",
)
def q19_plane(spark, sf):
    return evaluate.sweep(plane(regression_rows(spark, sf)), ["embedding_key", "norm"], (1, 2)).select("embedding_key", "norm", "dim", r6("r2").alias("r2"), "n_samples")


@query("q20_ridge_cv_scores")
def q20(spark, sf):
    out = evaluate.norm_scores(regression_rows(spark, sf), ["embedding_key", "norm"], "compare")
    return out.select("embedding_key", "norm", "n_samples", "dimensions", r6("r2_mean").alias("r2_mean"), r6("r2_std").alias("r2_std"))


@query(
    "q20_plane_ridge_cv",
    _ridge_sql("compare") + "SELECT 'emb' AS embedding_key, norm, max(n_samples) AS n_samples, CAST(2 AS INT) AS dimensions, round(avg(r2), 6) + 0.0 AS r2_mean, round(stddev_pop(r2), 6) + 0.0 AS r2_std FROM k GROUP BY norm",
)
def q20_plane(spark, sf):
    out = evaluate.norm_scores(plane(regression_rows(spark, sf)), ["embedding_key", "norm"], "compare")
    return out.select("embedding_key", "norm", "n_samples", "dimensions", r6("r2_mean").alias("r2_mean"), r6("r2_std").alias("r2_std"))


@query(
    "q20_self_scores",
    _ridge_sql("self", 5, "WHERE model = 3") + "SELECT 'emb' AS embedding_source, '3' AS matched_norm_file, norm AS norm_name, round(avg(r2), 6) + 0.0 AS self_r2_mean, round(stddev_pop(r2), 6) + 0.0 AS self_r2_std, max(n_samples) AS n_samples FROM k GROUP BY norm HAVING max(n_samples) >= 50",
)
def q20_self(spark, sf):
    own = ratings_view(spark, sf).withColumn("model", F.col("model").cast("string"))
    out = evaluate.self_scores(plane(vectors_view(spark, sf)), own, {"emb": "3", "emb_of_none": "4"})
    return out.withColumns({c: r6(c) for c in ("self_r2_mean", "self_r2_std")})


@query(
    "q20_paired_scores",
    fx.over("rated", t="SELECT norm, word, avg(rating) AS y FROM rated GROUP BY ALL")
    + "SELECT norm, count(*) AS n_samples FROM t JOIN embeddings ON vec_id = word WHERE vec_id % 7 <> 0 GROUP BY norm HAVING count(*) >= 50",
)
def q20_paired(spark, sf):
    """Words of paired scores: those of vectors that are finite on both sides; the scores of equal vectors are equal."""
    v = vectors_view(spark, sf).select("cue", "vec")
    holes = F.when(F.col("cue") % 7 == 0, F.transform("vec", lambda x: F.lit(float("nan")))).otherwise(F.col("vec"))
    behavior, activation = v.select(F.lit("passive_m-8-b-x").alias("embedding_key"), "cue", "vec"), v.select(F.lit("activation_m-8b-x").alias("embedding_key"), "cue", holes.alias("vec"))
    out = evaluate.paired_scores(plane(behavior), plane(activation), evaluate.targets(ratings_view(spark, sf)))
    return out.filter("abs(delta) < 1e-9").select("norm", "n_samples")


_LINE = "SELECT l_returnflag AS norm, l_linestatus AS status, l_quantity AS x, l_extendedprice AS y FROM lineitem"


@query(
    "q20_ridge_1d_scores",
    f"""WITH p AS ({_LINE}), z AS (SELECT *, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM p WINDOW w AS (PARTITION BY norm, status)),
s AS (SELECT norm, status, sum(z * y) AS zy, sum(z * z) AS zz, avg(y) AS my, var_pop(y) AS vy, count(*) AS n FROM z GROUP BY ALL)
SELECT norm, status, round(zy / (zz + 1), 3) AS weight, round(my, 3) AS intercept, round(1 - (n * vy - 2 * zy / (zz + 1) * zy + (zy / (zz + 1)) * (zy / (zz + 1)) * zz) / (n * vy), 6) AS r2 FROM s""",
)
def q20_line(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("norm"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = evaluate.line_scores(rows, ["norm", "status"])
    return out.select("norm", "status", F.round("weight", 3).alias("weight"), F.round("intercept", 3).alias("intercept"), r6("r2").alias("r2"))


@query("q20_gram_matrix", "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, round(sum(a.x * b.x), 4) + 0.0 AS value FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def q20_gram(spark, sf):
    return evaluate.gram(vectors_view(spark, sf), 64).select("i", "j", (F.round("value", 4) + F.lit(0.0)).alias("value"))


# --- ratings ------------------------------------------------------------------------------------------------------------


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


@query(
    "q21_loo_consensus_corr",
    fx.over(
        "means",
        m="SELECT norm, count(DISTINCT model) AS models FROM means GROUP BY norm",
        w="SELECT norm, word, models FROM (SELECT norm, word, count(*) AS n FROM means GROUP BY ALL) JOIN m USING (norm) WHERE n = models",
        g="SELECT norm, count(*) AS n_shared_words FROM w WHERE models >= 3 GROUP BY norm HAVING count(*) >= 10",
        s="SELECT means.*, n_shared_words, (sum(rating) OVER x - rating) / (count(*) OVER x - 1) AS others FROM means JOIN w USING (norm, word) JOIN g USING (norm) WINDOW x AS (PARTITION BY norm, word)",
    )
    + f"SELECT model, norm, round({corr_sql('rating', 'others')}, 6) + 0.0 AS strict_consensus_r, max(n_shared_words) AS n_shared_words FROM s GROUP BY ALL",
)
def q21(spark, sf):
    return ratings.consensus(means_view(spark, sf)).select("model", "norm", r6("strict_consensus_r").alias("strict_consensus_r"), "n_shared_words")


_PAIRS = f"SELECT a.norm, a.model AS model_a, b.model AS model_b, {corr_sql('a.rating', 'b.rating')} AS r, count(*) AS n FROM means a JOIN means b ON a.norm = b.norm AND a.word = b.word AND a.model < b.model GROUP BY ALL HAVING count(*) >= 10"


@query("q22_pairwise_model_corr", fx.over("means", pairs_=_PAIRS) + "SELECT norm, model_a, model_b, round(r, 6) + 0.0 AS r, n FROM pairs_")
def q22(spark, sf):
    return ratings.model_pairs(means_view(spark, sf)).select("norm", "model_a", "model_b", r6("r").alias("r"), "n")


@query("q22_consistency", fx.over("means", pairs_=_PAIRS) + "SELECT norm, round(avg(r), 6) + 0.0 AS mean_inter_model_corr, count(r) AS n_pairs FROM pairs_ GROUP BY norm")
def q22_mean(spark, sf):
    return ratings.consistency(ratings.model_pairs(means_view(spark, sf))).select("norm", r6("mean_inter_model_corr").alias("mean_inter_model_corr"), "n_pairs")


@query(
    "q23_coverage_forensics",
    fx.over(
        "rated",
        v="SELECT count(DISTINCT vec_id) AS vocabulary FROM embeddings",
        s="SELECT norm, count(*) AS present_rows FROM ratings GROUP BY norm",
        k="SELECT norm, count(*) AS success_rows FROM rated GROUP BY norm",
        m="SELECT norm, count(DISTINCT word) AS met_words FROM ratings WHERE word IN (SELECT vec_id FROM embeddings) GROUP BY norm",
    )
    + """SELECT norm, present_rows, success_rows, present_rows - success_rows AS failed_rows, met_words, vocabulary - met_words AS missing_words, round(met_words * 100.0 / vocabulary, 6) AS coverage_pct,
    CASE WHEN (vocabulary - met_words) * 2 > vocabulary THEN 'MISSING DATA' WHEN present_rows > success_rows THEN 'PARSE FAILURES' ELSE 'OK' END AS verdict FROM s JOIN k USING (norm) JOIN m USING (norm), v""",
)
def q23(spark, sf):
    out = ratings.coverage(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("word")), fx.ratings(spark, sf))
    return out.withColumn("coverage_pct", r6("coverage_pct"))


@query("q23_intersect", "SELECT p_partkey AS word FROM part INTERSECT SELECT vec_id FROM embeddings")
def q23_both(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("word")).intersect(fx.table(spark, sf, "embeddings").select("vec_id"))


@query("q23_except", "SELECT p_partkey AS word FROM part EXCEPT SELECT vec_id FROM embeddings")
def q23_except(spark, sf):
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("word")).subtract(fx.table(spark, sf, "embeddings").select("vec_id"))


# --- reports ------------------------------------------------------------------------------------------------------------


@query("q24_leaderboards", fx.over("scores") + "SELECT model, round(avg(r2), 6) AS mean_score, count(r2) AS n_scores FROM scores GROUP BY model")
def q24(spark, sf):
    return reports.leaderboard(fx.scores(spark, sf), ["model"]).select("model", r6("mean_score").alias("mean_score"), "n_scores")


@query("q24_best_rows", fx.over("scores") + "SELECT norm, arg_max(model || ' (' || embedding_type || ')', r2) AS best_name, round(max(r2), 6) AS best_score FROM scores GROUP BY norm")
def q24_best(spark, sf):
    name = F.concat("model", F.lit(" ("), "embedding_type", F.lit(")"))
    return reports.best_rows(fx.scores(spark, sf), ["norm"], name).select("norm", "best_name", r6("best_score").alias("best_score"))


@query("q24_metadata", "SELECT c_mktsegment AS model, count(DISTINCT o_orderpriority) AS norms_computed, round(count(DISTINCT c_custkey) * 100.0 / (SELECT count(*) FROM customer), 6) AS coverage_pct, round(count(*) * 1.0 / count(DISTINCT o_orderpriority), 6) AS avg_sample_size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q24_meta(spark, sf):
    customers = fx.table(spark, sf, "customer")
    joined = fx.table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    total = customers.agg(F.count(F.lit(1)).alias("t"))
    sums = joined.groupBy(F.col("c_mktsegment").alias("model")).agg(F.countDistinct("o_orderpriority").alias("norms_computed"), F.countDistinct("c_custkey").alias("met"), F.count(F.lit(1)).alias("n"))
    return sums.join(F.broadcast(total)).select("model", "norms_computed", r6(F.col("met") * 100.0 / F.col("t")).alias("coverage_pct"), r6(F.col("n") * 1.0 / F.col("norms_computed")).alias("avg_sample_size"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("q25_score_pivot", fx.over("scores") + "SELECT model || ' (' || embedding_type || ')' AS config, " + ", ".join(f"round(avg(r2) FILTER (norm = '{s}'), 6) AS {s.lower()}" for s in _SEGMENTS) + ", round(avg(r2), 6) AS row_mean FROM scores GROUP BY 1")
def q25(spark, sf):
    rows = fx.scores(spark, sf).withColumn("config", F.concat("model", F.lit(" ("), "embedding_type", F.lit(")")))
    out = reports.pivoted(rows, ["config"], "norm", _SEGMENTS)
    return out.select("config", *(r6(s).alias(s.lower()) for s in _SEGMENTS), r6("row_mean").alias("row_mean"))


_GAP = "SELECT model, norm, avg(r2) FILTER (embedding_type = 'F') AS f, avg(r2) FILTER (embedding_type = 'O') AS o FROM scores GROUP BY ALL"


@query("q26_activation_vs_behavior", fx.over("scores", g=_GAP) + "SELECT model, norm, round(f, 6) AS first_mean, round(o, 6) AS second_mean, round(o - f, 6) + 0.0 AS delta FROM g WHERE f IS NOT NULL AND o IS NOT NULL")
def q26(spark, sf):
    out = reports.modality_gap(fx.scores(spark, sf), ["model", "norm"], "embedding_type", "F", "O")
    return out.select("model", "norm", *(r6(c).alias(c) for c in ("first_mean", "second_mean", "delta")))


@query("q26_preferred_gap", fx.over("scores", g=_GAP) + "SELECT model, norm, round(o, 6) AS first_mean, round(f, 6) AS second_mean, round(f - o, 6) + 0.0 AS delta FROM g WHERE f IS NOT NULL AND o IS NOT NULL")
def q26_preferred(spark, sf):
    out = reports.preferred_gap(fx.scores(spark, sf), ["model", "norm"], "embedding_type", ["X", "O", "P"], "F")
    return out.select("model", "norm", *(r6(c).alias(c) for c in ("first_mean", "second_mean", "delta")))


@query("q26_fitted_lines", f"WITH p AS ({_LINE}) SELECT norm, round(covar_pop(y, x) / var_pop(x), 4) AS slope, round(avg(y) - covar_pop(y, x) / var_pop(x) * avg(x), 3) AS intercept, count(*) AS n_points FROM p GROUP BY norm")
def q26_lines(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("norm"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return reports.fitted_line(rows, ["norm"], "x", "y").select("norm", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), "n_points")


_SAT = "SELECT l_linestatus AS modality, l_linenumber AS dim, l_discount AS r2 FROM lineitem"


@query(
    "q27_saturation_report",
    f"""WITH p AS ({_SAT}), s AS (SELECT modality, dim, avg(r2) AS mean_r2, stddev_samp(r2) / sqrt(count(r2)) AS sem_r2, count(r2) AS n_scores FROM p GROUP BY ALL),
g AS (SELECT *, mean_r2 - lag(mean_r2) OVER (PARTITION BY modality ORDER BY dim) AS gain FROM s)
SELECT modality, dim, round(mean_r2, 6) AS mean_r2, round(sem_r2, 6) AS sem_r2, n_scores, round(gain, 6) + 0.0 AS gain, CASE WHEN gain < 0.005 THEN 'SATURATED' WHEN gain < 0.01 THEN 'Plateauing' ELSE 'Rising' END AS status FROM g""",
)
def q27(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("modality"), F.col("l_linenumber").alias("dim"), F.col("l_discount").alias("r2"))
    return reports.saturation(rows).select("modality", "dim", r6("mean_r2").alias("mean_r2"), r6("sem_r2").alias("sem_r2"), "n_scores", r6("gain").alias("gain"), "status")


@query("q27_saturation_pivot", f"WITH p AS ({_SAT}), s AS (SELECT dim, round(avg(r2) FILTER (modality = 'F'), 6) AS f, round(avg(r2) FILTER (modality = 'O'), 6) AS o FROM p GROUP BY dim) SELECT dim, f, o, round(o - f, 6) + 0.0 AS delta FROM s")
def q27_pivot(spark, sf):
    rows = fx.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("modality"), F.col("l_linenumber").alias("dim")).agg(r6(F.avg("l_discount")).alias("r2"))
    wide = reports.pivoted_unique(rows, ["dim"], "modality", ["F", "O"])
    return wide.select("dim", F.col("F").alias("f"), F.col("O").alias("o"), r6(F.col("O") - F.col("F")).alias("delta"))


@query(
    "q28_delta_distribution",
    """SELECT o_orderpriority AS model, round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.25), 6) AS lower_quartile, round(quantile_cont(o_totalprice, 0.75), 6) AS upper_quartile, round(avg(o_totalprice), 4) AS mean,
    round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS ci_low, round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS ci_high, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1""",
)
def q28(spark, sf):
    out = reports.distribution(fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), "o_totalprice"), ["model"], "o_totalprice")
    return out.select("model", *(r6(c).alias(c) for c in ("median", "lower_quartile", "upper_quartile")), *(F.round(c, 4).alias(c) for c in ("mean", "ci_low", "ci_high")), "least", "most")


_HEX = "(" + " + ".join(f"(strpos('0123456789abcdef', substr(h, 4 * r + {k + 1}, 1)) - 1) * {16 ** (3 - k)}" for k in range(4)) + ")"


@query(
    "q28_bootstrap_interval",
    f"""WITH o AS (SELECT o_orderpriority AS model, o_totalprice AS x, md5(o_orderkey || '|' || c || '|42') AS h, c FROM orders, (SELECT unnest(range(8)) AS c)),
w AS (SELECT model, c * 8 + r AS replicate, x, {" + ".join(f"CAST({_HEX} >= {t} AS INT)" for t in stats.poisson_steps())} AS w FROM o, (SELECT unnest(range(8)) AS r)),
m AS (SELECT model, replicate, sum(w * x) / sum(w) AS m FROM w GROUP BY ALL),
a AS (SELECT o_orderpriority AS model, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
SELECT model, round(any_value(mean), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS ci_low, round(quantile_cont(m, 0.975), 4) AS ci_high, count(m) AS n_replicates FROM m JOIN a USING (model) GROUP BY model""",
)
def q28_bootstrap(spark, sf):
    rows = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), "o_totalprice", "o_orderkey")
    out = reports.bootstrap(rows, ["model"], "o_totalprice", "o_orderkey", 64)
    return out.select("model", *(F.round(c, 4).alias(c) for c in ("mean", "ci_low", "ci_high")), "n_replicates")


@query(
    "q28_density",
    """WITH s AS (SELECT l_returnflag AS norm, min(l_extendedprice) AS low, max(l_extendedprice) AS high, stddev_pop(l_extendedprice) * pow(count(*), -0.2) AS h, count(*) AS n FROM lineitem GROUP BY 1),
b AS (SELECT norm, CAST(least(floor((l_extendedprice - low) / ((high - low) / 64)), 63) AS BIGINT) AS bin, count(*) AS c FROM lineitem JOIN s ON l_returnflag = norm GROUP BY ALL),
g AS (SELECT norm, unnest(range(64)) AS bin, low, (high - low) / 64 AS w, greatest(h, (high - low) / 64) AS h, n FROM s)
SELECT g.norm, g.bin, round(any_value(low + (g.bin + 0.5) * w), 4) AS x, round(coalesce(sum(0.75 * c / (n * h) * (1 - (b.bin - g.bin) * (b.bin - g.bin) * (w / h) * (w / h))), 0) * 1e6, 6) + 0.0 AS density_millionths
FROM g LEFT JOIN b ON b.norm = g.norm AND abs(b.bin - g.bin) <= floor(h / w) GROUP BY ALL""",
)
def q28_density(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("norm"), "l_extendedprice")
    return reports.density(rows, ["norm"], "l_extendedprice", 64).select("norm", "bin", F.round("x", 4).alias("x"), r6(F.col("density") * 1e6).alias("density_millionths"))


@query("q28_histogram", "SELECT l_returnflag AS norm, CAST(floor(l_extendedprice / 5000) * 5000 AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def q28_histogram(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("norm"), "l_extendedprice")
    return reports.histogram(rows, ["norm"], "l_extendedprice", 5000).withColumn("bucket", F.col("bucket").cast("long"))


@query(
    "q28_extremes",
    """WITH t AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10), b AS (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)
SELECT c_custkey, c_acctbal, 'top' AS "end" FROM t UNION ALL SELECT c_custkey, c_acctbal, 'bottom' FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM t)""",
)
def q28_extremes(spark, sf):
    return reports.extremes(fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10)


_MERGED = "SELECT model, norm, embedding_type, a.r2 AS r2_human, b.r2 AS r2_self FROM scores a JOIN other b USING (model, norm, embedding_type)"
_OTHER = "SELECT o_orderpriority AS model, o_orderstatus AS embedding_type, c_mktsegment AS norm, avg(c_acctbal) / 10000.0 AS r2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY ALL"


def merged_view(spark, sf) -> DataFrame:
    joined = fx.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").join(fx.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = joined.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("embedding_type"), F.col("c_mktsegment").alias("norm")).agg((F.avg("c_acctbal") / 10000.0).alias("r2"))
    return reports.merged(fx.scores(spark, sf), own, ["model", "norm", "embedding_type"])


@query("q29_human_self_merge", fx.over("scores", other=_OTHER, m=_MERGED) + "SELECT model, norm, embedding_type, round(r2_human, 6) AS r2_human, round(r2_self, 6) + 0.0 AS r2_self FROM m")
def q29(spark, sf):
    return merged_view(spark, sf).select("model", "norm", "embedding_type", r6("r2_human").alias("r2_human"), r6("r2_self").alias("r2_self"))


@query("q29_human_self_corr", fx.over("scores", other=_OTHER, m=_MERGED) + f"SELECT model, round({corr_sql('r2_human', 'r2_self')}, 6) + 0.0 AS r, count(*) AS n FROM m GROUP BY model")
def q29_corr(spark, sf):
    return reports.merged_correlation(merged_view(spark, sf), ["model"]).select("model", r6("r").alias("r"), "n")


@query("q30_shard_merge_dedupe", "SELECT CAST(o_custkey AS BIGINT) AS swow_id, min(o_orderkey) AS first_order, min(CAST(o_orderkey % 3 AS INT)) FILTER (o_orderkey = f) AS shard FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders) GROUP BY 1")
def q30(spark, sf):
    orders = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("swow_id"), F.col("o_orderkey").alias("first_order"))
    shards = [sampling.shard(orders, "first_order", 3, i).withColumn("shard", F.lit(i)) for i in range(3)]
    merged = shards[0].unionByName(shards[1]).unionByName(shards[2])
    return reports.keep_first(merged, ["swow_id"], ["first_order"]).orderBy("swow_id")


@query("q31_upsert_keep_last", "SELECT c_custkey AS k, CASE WHEN o.price IS NULL THEN c_acctbal ELSE o.price END AS value, CASE WHEN o.price IS NULL THEN 'old' ELSE 'new' END AS origin FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o_custkey = c_custkey")
def q31(spark, sf):
    old = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"), F.lit("old").alias("origin"))
    new = fx.table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("value")).withColumn("origin", F.lit("new"))
    return reports.upsert(old, new, ["k"])


@query(
    "q32_token_scoring",
    fx.over(
        "logits",
        z="SELECT item, pos, max(logit) AS top, ln(sum(exp(logit))) AS lse FROM logits GROUP BY ALL",
        s="SELECT item, pos, logit - lse AS lp FROM logits JOIN z USING (item, pos) WHERE vocab_id = actual AND pos % 4 <> 0",
        i="SELECT DISTINCT item FROM logits",
    )
    + "SELECT item, round(coalesce(sum(lp), 0), 6) + 0.0 AS total_log_prob, count(lp) AS num_tokens, round(coalesce(avg(lp), 0), 6) + 0.0 AS normalized_log_prob FROM i LEFT JOIN s USING (item) GROUP BY item",
)
def q32(spark, sf):
    rows = fx.logits(spark, sf)
    scored = infer.token_log_probs(rows.select("item", "pos", "vocab_id", "logit"), rows.filter("vocab_id = actual").select("item", "pos", "vocab_id"))
    kept = F.when(F.col("pos") % 4 != 0, F.col("log_prob"))
    out = scored.groupBy("item").agg(F.coalesce(F.sum(kept), F.lit(0.0)).alias("t"), F.count(kept).alias("num_tokens"))
    mean = F.coalesce(F.try_divide(F.col("t"), F.col("num_tokens")), F.lit(0.0))
    return out.select("item", r6("t").alias("total_log_prob"), "num_tokens", r6(mean).alias("normalized_log_prob"))


@query(
    "q32_label_masks",
    """WITH p AS (SELECT a.conv_id, a.turn, coalesce(b.text, '') AS asked, coalesce(a.text, '') AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'),
f AS (SELECT conv_id, turn, 'User: ' || asked || chr(10) || 'Assistant:' || chr(10) || answer || chr(167) AS text, length(asked) + 18 AS start, length(asked) + length(answer) + 18 AS stop FROM p),
t AS (SELECT conv_id, turn, start, stop, unnest(regexp_extract_all(text, ' ?[A-Za-z0-9]+|[^A-Za-z0-9]')) AS piece, generate_subscripts(regexp_extract_all(text, ' ?[A-Za-z0-9]+|[^A-Za-z0-9]'), 1) - 1 AS k FROM f),
o AS (SELECT *, sum(length(piece)) OVER w AS b, sum(length(piece)) OVER w - length(piece) AS a, list_sum(list_transform(range(1, length(piece) + 1), lambda i: unicode(substring(piece, i, 1)))) AS id FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)),
m AS (SELECT conv_id, turn, min(a) AS marker FROM o WHERE id = 167 AND a >= start GROUP BY ALL),
s AS (SELECT conv_id, turn, k, id, a < least(stop, coalesce(marker, stop)) AND b > start AND NOT regexp_matches(piece, '^[ \t\n\r\f\v]*,?[ \t\n\r\f\v]*$') AS scored FROM o LEFT JOIN m USING (conv_id, turn))
SELECT conv_id, turn, CAST(count(*) AS INT) AS n_tokens, CAST(count(*) FILTER (scored) AS INT) AS n_scored, CAST(coalesce(sum(id) FILTER (scored), 0) AS BIGINT) AS label_sum, CAST(coalesce(min(k) FILTER (scored), -1) AS INT) AS first_scored, CAST(coalesce(max(k) FILTER (scored), -1) AS INT) AS last_scored FROM s GROUP BY ALL""",
)
def q32_masks(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    asked = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.coalesce("text", F.lit("")).alias("asked"))
    pairs = turns.filter("role = 'assistant'").join(asked, ["conv_id", "turn"])
    text, start, end = inputs.framed(F.col("asked"), F.coalesce("text", F.lit("")), "User: ", "\nAssistant:\n", chr(167))
    rows = inputs.tokenised(pairs.select("conv_id", "turn", text.alias("text"), start.alias("start"), end.alias("end")), lambda: inputs.piecewise)
    stop = inputs.answer_end(F.col("tokens"), F.col("start"), F.col("end"), ord(chr(167)))
    marks = rows.select("conv_id", "turn", inputs.labels(F.col("tokens"), F.col("text"), F.col("start"), stop).alias("labels"))
    places = F.filter(F.transform("labels", lambda x, i: F.when(x != inputs.IGNORED, i)), lambda i: i.isNotNull())
    total = F.aggregate(F.filter("labels", lambda x: x != inputs.IGNORED), F.lit(0).cast("long"), lambda t, x: t + x)
    return marks.select("conv_id", "turn", F.size("labels").alias("n_tokens"), F.size(places).alias("n_scored"), total.alias("label_sum"), F.coalesce(F.array_min(places), F.lit(-1)).alias("first_scored"), F.coalesce(F.array_max(places), F.lit(-1)).alias("last_scored"))


@query(
    "q32_subsequence_search",
    r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, w[len(w) - 2 : len(w) - 1] AS small FROM d)
SELECT doc_id, CAST(CASE WHEN len(w) < 3 THEN -1 ELSE coalesce(list_filter(range(0, len(w) - 1), lambda i: w[i + 1] = small[1] AND w[i + 2] = small[2])[1], -1) END AS INT) AS at FROM s""",
)
def q32_runs(spark, sf):
    words = F.filter(F.split(F.lower("text"), fx.WORDS), lambda w: w != "")
    rows = fx.table(spark, sf, "documents").select("doc_id", words.alias("w"))
    small = F.when(F.size("w") >= 3, F.slice("w", F.size("w") - 2, 2))
    return rows.withColumn("small", small).select("doc_id", F.coalesce(vx.find_run(F.col("w"), F.col("small")), F.lit(-1)).alias("at"))


_TUPLE = "md5(concat_ws('|', coalesce(r1, 'NA'), coalesce(r2, 'NA'), coalesce(r3, 'NA')) || '|42')"


@query(
    "q33_derange_triplets",
    fx.over(
        "triplets",
        p=f"SELECT *, row_number() OVER (ORDER BY {_TUPLE}, id) - 1 AS place, count(*) OVER () AS n FROM triplets",
        m=f"SELECT max(c) AS shift FROM (SELECT count(*) AS c FROM triplets GROUP BY {_TUPLE})",
    )
    + "SELECT a.id, a.cue, b.r1, b.r2, b.r3 FROM p a, m JOIN p b ON b.place = (a.place + shift) % a.n",
)
def q33(spark, sf):
    return sampling.derange(fx.triplets(spark, sf), "id", ["r1", "r2", "r3"])


@query("q33_conflicts", fx.over("triplets") + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_conflicts FROM triplets")
def q33_conflicts(spark, sf):
    before = fx.triplets(spark, sf).drop("cue")
    return sampling.conflicts(before, sampling.derange(before, "id", ["r1", "r2", "r3"]), "id", ["r1", "r2", "r3"])


# --- functions by themselves ---------------------------------------------------------------------------------------------


@query(
    "q34_text_rules",
    r"""WITH s AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS spaces)
SELECT conv_id, turn, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), spaces)) AS letters, md5(translate(text, ', ' || chr(9) || chr(10) || chr(13), '')) AS joined,
    regexp_replace(left(text, 20), '[^\p{L}\p{N}._-]', '_', 'g') AS file_name, md5(replace('Say {word}, then {word}.', '{word}', left(text, 9))) AS prompt, to_json({'conv_id': conv_id, 'turn': nullif(turn, 1), 'role': role}) AS line FROM conversations, s""",
)
def q34_text(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(tx.letters_and_spaces(text).cast("binary")).alias("letters"), F.md5(tx.without_separators(text).cast("binary")).alias("joined"), tx.safe_name(F.left(text, F.lit(20))).alias("file_name"),
        F.md5(tx.filled(F.lit("Say {word}, then {word}."), F.left(text, F.lit(9))).cast("binary")).alias("prompt"), tx.json_line("conv_id", F.nullif("turn", F.lit(1)).alias("turn"), "role").alias("line"),
    )


@query(
    "q34_prompts",
    """SELECT DISTINCT norm, c_mktsegment AS word, replace(template, '{word}', c_mktsegment) AS prompt FROM customer, (VALUES ('long', 'How long is "{word}"?'), ('warm', '{word}: warm or cold?')) AS t(norm, template)""",
)
def q34_prompts(spark, sf):
    words = fx.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("word")).distinct()
    return infer.prompts(words, {"long": 'How long is "{word}"?', "warm": "{word}: warm or cold?"})


@query(
    "q35_vector_rules",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), i AS (SELECT vec_id, v, list_transform(v, lambda x: CAST(floor(x * 10) AS INT)) AS items FROM v)
SELECT vec_id, round((v[2] + v[6] + v[10]) / 3, 6) + 0.0 AS pooled_mean, round(v[2], 6) + 0.0 AS pooled_first, round(v[10], 6) + 0.0 AS pooled_last, round(list_sum(list_transform(range(1, 65), lambda k: CASE WHEN k % 5 = 1 THEN 0.0 ELSE v[k] END)), 6) + 0.0 AS filled,
    CAST(coalesce(list_position(items[2:], items[1]), 0) AS INT) AS next_place, round(v[1] + v[2] + v[3], 4) + 0.0 AS parsed, CAST(70 AS INT) AS width, vec_id % 7 < 6 AND 4 < vec_id % 7 + 3 AS overlap, round(log10(pow(10.0, -2 + (vec_id % 12) * 8 / 11.0)), 6) + 0.0 AS exponent FROM i""",
)
def q35_vectors(spark, sf):
    v = vectors_view(spark, sf).select(F.col("cue").alias("vec_id"), "vec")
    parts = F.array(*(F.slice("vec", k, 4) for k in (1, 5, 9)))
    holes = F.transform("vec", lambda x, k: F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(x))
    items = F.transform("vec", lambda x: F.floor(x * 10).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x)
    at = F.col("vec_id") % 7
    place = vx.first_from(items, F.get(items, F.lit(0)), 1)
    return v.select(
        "vec_id", *(r6(F.get(vx.pooled(parts, how), F.lit(1))).alias(f"pooled_{how}") for how in ("mean", "first", "last")), r6(total(vx.nan_as_zero(holes))).alias("filled"), F.greatest(place, F.lit(0)).cast("int").alias("next_place"),
        (F.round(total(F.transform(vx.parsed(F.to_json(F.slice("vec", 1, 3))), lambda x: x.cast("double"))), 4) + F.lit(0.0)).alias("parsed"), F.size(vx.padded(F.col("vec"), 70)).alias("width"), vx.spans_overlap(at, at + 3, F.lit(4), F.lit(6)).alias("overlap"),
        r6(F.log10(F.get(vx.log_grid(-2, 6, 12), (F.col("vec_id") % 12).cast("int")))).alias("exponent"),
    )
