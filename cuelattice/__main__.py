"""Command line: python -m cuelattice COMMAND ...; run with -h for the commands and their options."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from pyspark.sql import DataFrame, SparkSession

from cuelattice.functions import text as names
from cuelattice.operators import assoc, driver, embed, evaluate, infer, ratings, reports, sampling
from cuelattice.plans import pipeline
from cuelattice.plans.session import session
from cuelattice.sources import arrays, readers, sinks


def plug_in(name: str):
    """The object that ``module:name`` stands for, a factory of a scorer, generator or word model."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def vectors_at(spark: SparkSession, paths: str) -> DataFrame:
    """(embedding_key, cue, vec) of bundles with commas between them: folders of Parquet or pickles."""
    found = None
    for path in paths.split(","):
        own = arrays.pickled_bundle(spark, path) if path.endswith((".pkl", ".pickle")) else spark.read.parquet(path).select("embedding_key", "cue", "vec")
        found = own if found is None else found.unionByName(own)
    return found


def own_ratings(spark: SparkSession, pattern: str) -> DataFrame:
    return ratings.coerced(readers.model_norms(spark, readers.listed(spark, pattern)))


def done_at(spark: SparkSession, path: str) -> DataFrame | None:
    """What earlier runs wrote to a folder."""
    return spark.read.parquet(path) if sinks.whole(spark, path) else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cuelattice")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="activations, behavior and comparison, end to end")
    for name in ("associations", "norms", "out"):
        run.add_argument(f"--{name}", required=True)
    run.add_argument("--activations", help="files with commas between them")
    for name, what in (("passive", "log-probability files"), ("deranged", "log-probability files of deranged sets"), ("active", "generation files"), ("own-norms", "rating files by model")):
        run.add_argument(f"--{name}", help=f"pattern of {what}")
    run.add_argument("--limited-mode", action="store_true", help="the core models only")
    for stage in ("activations", "behavior", "compare"):
        run.add_argument(f"--skip-{stage}", action="store_true")
    run.add_argument("--dim-strategy", choices=("activation", "mapping", "fixed"), default="activation")
    run.add_argument("--fixed-dim", type=int, default=300)
    cells = sub.add_parser("behavior-cells", help="PPMI cells of associations as Parquet")
    derange = sub.add_parser("derange", help="associations with their response triplets dealt to other rows")
    for c in (cells, derange):
        c.add_argument("input")
        c.add_argument("output")
    cells.add_argument("--least", type=int, default=5)
    derange.add_argument("--seed", type=int, default=42)
    describe = sub.add_parser("catalog", help="rows and dimensions of embedding bundles")
    describe.add_argument("paths", nargs="+")
    probe = sub.add_parser("probe", help="word column, dimension and rows of activation files")
    probe.add_argument("paths", nargs="+")
    score = sub.add_parser("score", help="log-probabilities of response sets by a plug-in scorer")
    score.add_argument("input")
    score.add_argument("output")
    score.add_argument("--scorer", required=True, help="module:factory")
    score.add_argument("--num-shards", type=int, default=1)
    score.add_argument("--shard-index", type=int, default=0)
    make = sub.add_parser("generate", help="associations of cues by a plug-in generator")
    make.add_argument("input")
    make.add_argument("output")
    make.add_argument("--generator", required=True, help="module:factory")
    make.add_argument("--samples", type=int, default=100)
    for c, what in ((score, "rows"), (make, "cues")):
        c.add_argument("--smoketest", type=int, metavar="N", help=f"the first N {what} only")
    score.add_argument("--batch-size", type=int, default=driver.BATCH)
    compare = sub.add_parser("compare", help="norm prediction of all embeddings of the compared types; pairs that are done are skipped")
    pairs = sub.add_parser("compare-pairs", help="behavior against activation of each model, on the same words")
    human = sub.add_parser("predict-human", help="norm prediction with the human preset")
    own = sub.add_parser("predict-self", help="prediction of each model's own ratings")
    sweep = sub.add_parser("sweep", help="prediction by number of principal components, and the saturation report")
    for c in (compare, pairs, human, own, sweep):
        c.add_argument("--embeddings", required=True, help="bundles with commas between them: Parquet folders or pickles")
        c.add_argument("--own-norms" if c is own else "--norms", required=True)
        c.add_argument("--out", required=True)
    for c in (compare, pairs):
        c.add_argument("--smoketest", action="store_true", help="two folds and the first five norms")
    pairs.add_argument("--max-samples", type=int, help="words of a norm at most")
    report = sub.add_parser("report", help="a report on a folder of scores")
    report.add_argument("kind", choices=("leaderboards", "best", "gap", "saturation"))
    report.add_argument("scores")
    check = sub.add_parser("check", help="a check of the models' own ratings")
    check.add_argument("kind", choices=("comprehension", "consistency", "coverage"))
    check.add_argument("own_norms", help="pattern of rating files by model")
    check.add_argument("--words", help="CSV of the words that ought to be rated (coverage)")
    trial = sub.add_parser("pilot", help="a trial of generators on a few cues")
    trial.add_argument("input")
    trial.add_argument("output")
    trial.add_argument("--generator", action="append", required=True, help="name=module:factory, once for each model")
    trial.add_argument("--cues", type=int, default=driver.PILOT_CUES)
    trial.add_argument("--samples", type=int, default=driver.PILOT_SAMPLES)
    word = sub.add_parser("embed", help="pooled vectors of words in a sentence by a plug-in model, one .npy a word; present ones are skipped")
    word.add_argument("input")
    word.add_argument("output")
    word.add_argument("--model", required=True, help="module:factory")
    word.add_argument("--template", default="{word}")
    word.add_argument("--pool", choices=("mean", "first", "last"), default="mean")
    return p


def evaluation(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The scores that an evaluation command asks for."""
    vectors = vectors_at(spark, a.embeddings)
    if a.command == "predict-self":
        return evaluate.self_scores(vectors, own_ratings(spark, a.own_norms), names.OWN_RATING_FILES)
    norms = readers.norms(spark, a.norms)
    if getattr(a, "smoketest", False):
        norms = norms.join(norms.select("norm").distinct().orderBy("norm").limit(5), "norm", "left_semi")
    folds = 2 if getattr(a, "smoketest", False) else 5
    if a.command == "compare":
        return pipeline.comparison(vectors, norms, k=folds, wanted=True, done=done_at(spark, a.out))
    if a.command == "compare-pairs":
        behavior, activation = (vectors.filter(F.col("embedding_key").startswith(kind)) for kind in ("passive_", "activation_"))
        most = min(a.max_samples or 200, 200) if a.smoketest else a.max_samples
        return evaluate.paired_scores(behavior, activation, evaluate.targets(norms), k=folds, most=most)
    return pipeline.human_prediction(vectors, norms) if a.command == "predict-human" else pipeline.saturation_sweep(vectors, norms)


def reported(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A report on scores as ``compare`` or ``sweep`` write them."""
    scores = spark.read.parquet(path)
    if kind == "saturation":
        return reports.saturation(scores).orderBy("modality", "dim")
    if kind == "leaderboards":
        return reports.leaderboard(scores, ["model", "embedding_type"], "r2_mean")
    if kind == "best":
        return reports.best_rows(scores, ["norm"], F.concat("model", F.lit(" ("), "embedding_type", F.lit(")")), "r2_mean").orderBy("norm")
    return reports.preferred_gap(scores, ["model", "norm"], "embedding_type", ["Behavior_Standard_300d", "Behavior_Standard"], "Activation", "r2_mean").orderBy("model", "norm")


def checked(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A check of the models' own ratings: agreement with the others, agreement of pairs, or coverage of the words."""
    if a.kind == "coverage":
        raw = readers.model_norms(spark, readers.listed(spark, a.own_norms))
        words = readers.csv(spark, a.words) if a.words else raw
        return ratings.coverage(words.select(names.word_key(F.col(readers.word_column(words))).alias("word")), raw).orderBy("norm")
    means = ratings.word_means(own_ratings(spark, a.own_norms))
    return ratings.consensus(means).orderBy("norm", "model") if a.kind == "comprehension" else ratings.consistency(ratings.model_pairs(means)).orderBy("norm")


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = session()
    if a.command == "run":
        paths = {k: v for k in ("associations", "norms", "activations", "passive", "deranged", "active", "own_norms", "out") if (v := getattr(a, k))}
        skip = tuple(s for s in ("activations", "behavior", "compare") if getattr(a, f"skip_{s}"))
        done = pipeline.run(spark, paths, skip, a.dim_strategy, a.fixed_dim, a.limited_mode)
        if done is not None:
            done.orderBy("embedding_key", "norm").show(1000, False)
    elif a.command == "behavior-cells":
        rows = readers.associations(spark, a.input).select("id", "cue", F.col("R1").alias("r1"), F.col("R2").alias("r2"), F.col("R3").alias("r3"))
        pairs = assoc.long_form(rows).select("cue", F.col("response_word").alias("response"))
        pipeline.behavior_cells(pairs, a.least)[0].write.mode("overwrite").parquet(a.output)
    elif a.command == "derange":
        rows = readers.csv(spark, a.input, readers.ASSOCIATIONS)
        sinks.csv(sampling.derange(rows, "id", ["R1", "R2", "R3"], a.seed), a.output)
    elif a.command == "catalog":
        for path in a.paths:
            embed.catalog(spark.read.parquet(path)).orderBy("embedding_key").show(1000, False)
    elif a.command == "probe":
        for path in a.paths:
            vectors = readers.activations(spark, path)
            vectors.agg(F.lit(path).alias("path"), F.lit(readers.word_column(readers.csv(spark, path))).alias("word_column"), F.max(F.size("vec")).alias("dim"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cue").alias("n_words")).show(1, False)
    elif a.command == "score":
        rows = sampling.shard(readers.associations(spark, a.input), "id", a.num_shards, a.shard_index)
        rows = rows.withColumn("response_set", F.array_join(F.filter(F.array("R1", "R2", "R3"), lambda r: r.isNotNull()), ", ")).withColumn("prompt", F.col("cue"))
        target = f"{a.output}/shard={a.shard_index}"
        if (done := done_at(spark, target)) is not None:
            rows = infer.unfinished(rows, done, ["id"])
        rows = rows.orderBy("id").limit(a.smoketest) if a.smoketest else rows
        count = spark.sparkContext.accumulator(0)
        infer.summed(driver.scored(rows, plug_in(a.scorer), a.scorer, a.batch_size, progress=count)).write.mode("append").parquet(target)
        print(f"{count.value} rows")
    elif a.command == "generate":
        cues = readers.csv(spark, a.input).select("cue").distinct().withColumn("prompt", F.col("cue"))
        cues = cues.orderBy("cue").limit(a.smoketest) if a.smoketest else cues
        sinks.json_lines(infer.generate(cues, plug_in(a.generator), a.samples), a.output)
    elif a.command in ("compare", "compare-pairs", "predict-human", "predict-self", "sweep"):
        evaluation(spark, a).write.mode("append" if a.command == "compare" else "overwrite").parquet(a.out)
        spark.read.parquet(a.out).show(1000, False)
        if a.command == "sweep":
            reported(spark, "saturation", a.out).show(1000, False)
    elif a.command == "report":
        reported(spark, a.kind, a.scores).show(1000, False)
    elif a.command == "check":
        checked(spark, a).show(1000, False)
    elif a.command == "pilot":
        cues = readers.csv(spark, a.input).select("cue").distinct().withColumn("prompt", F.col("cue"))
        models = {name: plug_in(factory) for name, _, factory in (g.partition("=") for g in a.generator)}
        sinks.csv(driver.pilot(cues, models, a.cues, a.samples), a.output)
    elif a.command == "embed":
        words = readers.csv(spark, a.input)
        rows = words.select(names.word_key(F.col(readers.word_column(words))).alias("word")).distinct()
        left = arrays.unwritten(spark, rows, a.output)
        arrays.npy_by_word(spark, infer.embed(left, plug_in(a.model), a.template, a.pool), a.output)


if __name__ == "__main__":
    main()
