"""The three stages end to end: activations, behavior, comparison. Every stage writes its tables and reads its inputs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import chain

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions import text as names
from cuelattice.functions.vectors import nan_as_zero
from cuelattice.operators import assoc, embed, evaluate, ratings
from cuelattice.plans.session import written
from cuelattice.sources import readers, sinks

#: Key of the human matrix, and the width that all matrices share for comparisons.
HUMAN, COMMON_DIM = "human_matrix", 300
#: Matrices that are decomposed at once.
AT_ONCE = 4


def activations(spark: SparkSession, files: dict[str, str], cues: DataFrame, out: str) -> None:
    """Vectors of every model's activation file aligned with the cues, as one bundle."""
    parts = None
    for model, path in sorted(files.items()):
        vectors = readers.activations(spark, path)
        dim = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
        part = embed.align(cues, vectors, dim).select(F.lit(f"activation_{model}").alias("embedding_key"), "cue", "vec")
        parts = part if parts is None else parts.unionByName(part)
    if parts is not None:
        sinks.bundle(parts, out)


def behavior_cells(pairs: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, cues, vocabulary) of human (cue, response) pairs: responses met ``least`` times, and the cues that have one."""
    counts = written(assoc.pair_counts(pairs))
    vocabulary = written(counts.groupBy(F.col("response").alias("word")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    known = assoc.in_vocabulary(counts, vocabulary, "response")
    return assoc.ppmi(known, ["cue"], ["response"]), known.select(F.col("cue").alias("word")).distinct(), vocabulary


def scored_sets(spark: SparkSession, pattern: str, cues: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(model, cue, response, lp) of a folder's log-probability files: each word of a scored set has the set's mean."""
    rows = readers.by_file(spark, pattern, "cue string, response_set string, normalized_log_prob double", "file")
    words = rows.select(names.model_name(F.col("file")).alias("model"), names.word_key(F.col("cue")).alias("cue"), F.explode(F.split(F.lower("response_set"), ",")).alias("part"), F.col("normalized_log_prob").alias("lp"))
    words = words.select("model", "cue", names.stripped(F.col("part")).alias("response"), "lp")
    return assoc.in_vocabulary(assoc.in_vocabulary(words, cues, "cue"), vocabulary, "response")


def passive_cells(real: DataFrame, shuffled: DataFrame | None = None) -> DataFrame:
    """(embedding_key, cue, response, ppmi) of (model, cue, response, lp) tables, all models at once.

    A model's real table gives passive_MODEL; with a shuffled one of the same model there are also passive_MODEL_shuffled
    and passive_MODEL_contrast, both tables side by side. A shuffled table without a real one gives nothing.
    """
    spread = lambda df: written(assoc.row_distribution(df, ["model", "cue"], "response"))
    key = lambda suffix: F.concat(F.lit("passive_"), "model", F.lit(suffix)).alias("embedding_key")
    own = spread(real.filter(~F.col("model").contains("deranged")))
    cells = own.select(key(""), "cue", "response", "prob")
    if shuffled is not None:
        other = spread(shuffled).join(own.select("model").distinct(), "model", "left_semi")
        both = assoc.side_by_side(own.join(other.select("model").distinct(), "model", "left_semi"), other)
        cells = cells.unionByName(other.select(key("_shuffled"), "cue", "response", "prob"))
        cells = cells.unionByName(both.select(key("_contrast"), "cue", F.concat_ws(":", "block", "response").alias("response"), "prob"))
    return assoc.ppmi(cells, ["cue"], ["response"], "prob", by=("embedding_key",)).select("embedding_key", "cue", "response", "ppmi")


def active_cells(rows: DataFrame, cues: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(embedding_key, cue, response, ppmi) of generated (model, cue, response) rows: counts of the answers that are known words."""
    answers = rows.select(F.concat(F.lit("active_"), names.model_name(F.col("model"))).alias("embedding_key"), "cue", names.letters_and_spaces(F.col("response")).alias("response"))
    known = assoc.in_vocabulary(assoc.in_vocabulary(answers, cues, "cue"), vocabulary, "response")
    counts = known.groupBy("embedding_key", "cue", "response").agg(F.count(F.lit(1)).alias("n"))
    return assoc.ppmi(counts, ["cue"], ["response"], by=("embedding_key",)).select("embedding_key", "cue", "response", "ppmi")


def activation_dims(vectors: DataFrame) -> DataFrame:
    """(model, dim): the width of each model's activation vectors."""
    return embed.catalog(vectors.filter(F.col("embedding_key").startswith("activation_"))).select(names.source_model(F.col("embedding_key")).alias("model"), "dim")


def behavior(spark: SparkSession, cells: DataFrame, out: str, dims: DataFrame | None = None, strategy: str = "activation", fixed: int = 300, mapping: dict[str, int] | None = None) -> None:
    """Vectors of every matrix of ``cells`` (embedding_key, cue, response, ppmi) by truncated SVD, as one bundle.

    Each key but human_matrix stands twice: as wide as ``strategy`` says, and with COMMON_DIM components under KEY_300d. The
    first components of a decomposition are those of a smaller one, so one serves both. Cues that are unusable in any embedding go.
    """
    cells = written(cells)
    keys = cells.select("embedding_key").distinct().withColumn("model", names.source_model(F.col("embedding_key")))
    known = dims if dims is not None else spark.createDataFrame([], "model string, dim int")
    wanted = {r["embedding_key"]: r["target_dim"] for r in embed.target_dims(keys, known, strategy, fixed, mapping).collect()}  # a row a matrix

    def decomposed(key: str, dim: int) -> list[DataFrame]:
        vectors, _ = embed.truncated_svd(cells.filter(F.col("embedding_key") == key), dim if key == HUMAN else max(dim, COMMON_DIM))
        widths = ((key, dim),) if key == HUMAN else ((key, dim), (f"{key}_300d", COMMON_DIM))
        return [vectors.select(F.lit(name).alias("embedding_key"), "cue", nan_as_zero(F.slice("vec", 1, width)).alias("vec")) for name, width in widths]

    # matrices are independent: several are decomposed at once, so that one's small steps fill the gaps of another's
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(lambda x: decomposed(*x)), sorted(wanted.items())))
    parts = reduce(DataFrame.unionByName, chain.from_iterable(found)) if found else None
    if parts is not None:
        sinks.bundle(embed.sanitized(parts), out)


def comparison(vectors: DataFrame, norms: DataFrame, preset: str = "compare", k: int = 5, repeats: int = 1, duplicates: str = "mean", wanted: bool = False, done: DataFrame | None = None) -> DataFrame:
    """(embedding_key, model, embedding_type, norm, n_samples, dimensions, r2_mean, r2_std).

    ``wanted`` keeps to the types that are compared (``evaluate.wanted_keys``); pairs (embedding_key, norm) in ``done`` are left out.
    """
    if wanted:
        vectors = vectors.join(evaluate.wanted_keys(vectors.select("embedding_key").distinct()), "embedding_key", "left_semi")
    rows = evaluate.aligned(vectors, evaluate.targets(norms, duplicates))
    if done is not None:
        rows = rows.join(done.select("embedding_key", "norm").distinct(), ["embedding_key", "norm"], "left_anti")
    scores = evaluate.norm_scores(rows, ["embedding_key", "norm"], preset, k, repeats)
    key = F.col("embedding_key")
    return scores.select("embedding_key", names.key_model(key).alias("model"), names.key_type(key).alias("embedding_type"), "norm", "n_samples", "dimensions", "r2_mean", "r2_std")


def human_prediction(vectors: DataFrame, norms: DataFrame) -> DataFrame:
    """(embedding_source, norm_name, r2_mean, r2_std, n_samples): the human preset, every embedding against every norm."""
    scores = comparison(vectors, norms, "human")
    return scores.select(F.col("embedding_key").alias("embedding_source"), F.col("norm").alias("norm_name"), "r2_mean", "r2_std", "n_samples")


def saturation_sweep(vectors: DataFrame, norms: DataFrame) -> DataFrame:
    """(norm, modality, model, dim, r2, n_samples) of every embedding of a model that has both modalities, and of the human one."""
    key = F.col("embedding_key")
    kept = vectors.join(evaluate.wanted_keys(vectors.select("embedding_key").distinct()), "embedding_key", "left_semi")
    scores = evaluate.sweep(evaluate.sweep_rows(kept, norms), ["embedding_key", "norm"])
    return scores.select("norm", names.key_type(key).alias("modality"), names.key_model(key).alias("model"), "dim", "r2", "n_samples")


def bundle_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The vectors of a bundle that was written whole, or None."""
    return spark.read.parquet(path).select("embedding_key", "cue", "vec") if sinks.whole(spark, path) else None


def run(spark: SparkSession, paths: dict[str, str], skip: tuple[str, ...] = (), strategy: str = "activation", fixed: int = 300, limited: bool = False, mapping: dict[str, int] | None = None) -> DataFrame | None:
    """The whole run over ``paths``: associations, norms, out, and if given activations, passive, deranged, active, own_norms.

    Stages in ``skip`` are taken as done: their bundles are read if they are there. ``limited`` keeps to the core models. With
    own_norms, rating files by model, self scores are written beside the comparison.
    """
    out = paths["out"]
    allowed = names.CORE_MODELS if limited else None
    if {"activations", "behavior"} - set(skip):
        rows = readers.associations(spark, paths["associations"]).select("id", "cue", F.col("R1").alias("r1"), F.col("R2").alias("r2"), F.col("R3").alias("r3"))
        pairs = assoc.long_form(rows).select("cue", F.col("response_word").alias("response"))
        human, cues, vocabulary = behavior_cells(pairs)
    if "activations" not in skip and paths.get("activations"):
        files = paths["activations"].split(",")
        activations(spark, {f.rsplit("/", 1)[-1].removesuffix(".csv"): f for f in files}, cues.select(F.col("word").alias("cue")), f"{out}/activations")
    acts = bundle_there(spark, f"{out}/activations")
    if "behavior" not in skip:
        cells = human.select(F.lit(HUMAN).alias("embedding_key"), "cue", "response", "ppmi")
        mine = lambda df: df.filter(names.allowed(names.model_name(F.col("model")), allowed))
        if paths.get("passive"):
            other = mine(scored_sets(spark, paths["deranged"], cues, vocabulary)) if paths.get("deranged") else None
            cells = cells.unionByName(passive_cells(mine(scored_sets(spark, paths["passive"], cues, vocabulary)), other))
        if paths.get("active"):
            cells = cells.unionByName(active_cells(mine(readers.generations(spark, paths["active"], readers.stem())), cues, vocabulary))
        dims = activation_dims(acts) if acts is not None and strategy == "activation" else None
        behavior(spark, cells, f"{out}/behavior", dims, strategy, fixed, mapping)
    if "compare" in skip:
        return None
    vectors = bundle_there(spark, f"{out}/behavior")
    vectors = acts if vectors is None else vectors if acts is None else vectors.unionByName(acts)
    if vectors is None:
        return None
    scores = comparison(vectors, readers.norms(spark, paths["norms"]))
    scores.write.mode("overwrite").parquet(f"{out}/norm_prediction_scores")
    if paths.get("own_norms"):
        own = ratings.coerced(readers.model_norms(spark, readers.listed(spark, paths["own_norms"])))
        evaluate.self_scores(vectors, own, names.OWN_RATING_FILES).write.mode("overwrite").parquet(f"{out}/self_scores")
    return spark.read.parquet(f"{out}/norm_prediction_scores")
