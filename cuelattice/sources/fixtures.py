"""Canonical views over the driver's tables, in Spark and as DuckDB common table expressions of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.operators.assoc import long_form

WORDS = r"[^\p{L}\p{N}]+"
#: Bytes of a table, as the planner estimates them, that a task works on at most.
TASK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(df: DataFrame) -> int:
    """As many tasks as there are cores, and as leave each of them TASK_BYTES of ``df`` at most."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(cores, -(-size // TASK_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, and to as many tasks as leave each of them TASK_BYTES at most.

    A table's own splits are row groups: a small file is often one, and those of a large one hold so many words that a task's
    counts of different pairs would take gigabytes.
    """
    return df.repartition(tasks_for(df))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cue, r1, r2, r3): the words of whole documents in runs of four; a last short run has null responses."""
    words = F.filter(F.split("text", WORDS), lambda w: w != "")
    docs = spread(texts(spark, sf_dir)).select("doc_id", words.alias("w"))
    run = lambda at: F.struct(F.floor(at / 4).alias("at"), *(F.get("w", at + k).alias(n) for k, n in enumerate(("cue", "r1", "r2", "r3"))))
    # runs are made before they are exploded: rows that carried the words of the whole text would be quadratic in its length
    runs = docs.select("doc_id", F.explode(F.when(F.size("w") > 0, F.transform(F.expr("sequence(0, greatest(size(w) - 1, 0), 4)"), run))).alias("run"))
    return runs.select((F.col("doc_id") * 1000000 + F.col("run.at")).alias("id"), "run.cue", "run.r1", "run.r2", "run.r3")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(triplets(spark, sf_dir)).select("cue", F.col("response_word").alias("response"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, model, norm, word, raw): quantities as text, some of them words, empty or null."""
    li = table(spark, sf_dir, "lineitem")
    turn = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    raw = F.when(turn % 11 == 0, "Olfactory").when(turn % 13 == 0, "").when(turn % 17 == 0, F.lit(None)).when(turn % 5 == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(".50 "))).otherwise(F.col("l_quantity").cast("int").cast("string"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_linenumber").alias("model"), F.col("l_returnflag").alias("norm"), F.col("l_partkey").alias("word"), raw.alias("raw"))


def log_probs(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(model, cue, response, lp); with a shift the responses are dealt to other cues."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("model"), F.pmod(F.col("l_suppkey") + shift, F.lit(50)).alias("cue"), (F.col("l_partkey") % 50).alias("response"), (F.col("l_discount") * -10 - F.col("l_tax")).alias("lp"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, embedding_type, norm, r2): mean prices of orders, scaled to 0..1."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("embedding_type"), F.col("c_mktsegment").alias("norm")).agg((F.avg("o_totalprice") / 500000.0).alias("r2"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, pos, token, vocab_id, logit, actual): three vocabulary entries for each word of each conversation turn."""
    words = F.filter(F.split("text", WORDS), lambda w: w != "")
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.posexplode(words).alias("pos", "token"))
    many = turns.withColumn("vocab_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return many.withColumn("logit", ((F.length("token") * (F.col("vocab_id") + 1)) % 7) - F.col("vocab_id") * 0.5).withColumn("actual", F.length("token") % 3)


#: Models, modalities and variants that names of embeddings are put together from.
MODELS = ["gemma-3-27-b-instruct", "gemma-3-27b-instruct", "qwen-3-32-b-instruct", "mistral-small-24-b-instruct", "gpt-oss-20-b", "Falcon3_10B-Base", "Llama 3.1 8B Instruct", "phi--4__mini", "rnj-1-8b"]
MODALITIES = ["passive_", "activation_", "active_", ""]
VARIANTS = ["", "_shuffled", "_contrast", "_300d", "_contrast_300d", "-results", "-deranged-results"]


def names_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw, n): names made from the parts: a modality, a model or the part's brand, a variant; and human_matrix."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    model = F.when(F.col("p_size") % 5 == 0, F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit("b"))).otherwise(pick(MODELS, F.col("p_partkey")))
    raw = F.when(F.col("p_size") == 1, "human_matrix").otherwise(F.concat(pick(MODALITIES, F.col("p_size")), model, pick(VARIANTS, F.floor(F.col("p_partkey") / 9))))
    return table(spark, sf_dir, "part").groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))


def _pick_sql(values: list[str], at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({at} % {len(values)} AS INT) + 1]"


#: The same views for DuckDB.
SQL = {
    "triplets": r"""SELECT doc_id * 1000000 + first // 4 AS id, w[first + 1] AS cue, w[first + 2] AS r1, w[first + 3] AS r2, w[first + 4] AS r3
        FROM (SELECT doc_id, w, unnest(range(0, len(w), 4)) AS first FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0)""",
    "long": r"""SELECT id, lower(cue) AS cue, slot, lower(word) AS response_word FROM (SELECT id, cue, 'r1' AS slot, r1 AS word FROM triplets
        UNION ALL SELECT id, cue, 'r2', r2 FROM triplets UNION ALL SELECT id, cue, 'r3', r3 FROM triplets) WHERE word IS NOT NULL AND word <> ''""",
    "pairs": "SELECT cue, response_word AS response FROM long",
    "ratings": r"""SELECT l_orderkey * 10 + l_linenumber AS row_id, l_linenumber AS model, l_returnflag AS norm, l_partkey AS word,
        CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 = 0 THEN 'Olfactory' WHEN (l_orderkey * 7 + l_linenumber) % 13 = 0 THEN '' WHEN (l_orderkey * 7 + l_linenumber) % 17 = 0 THEN NULL
             WHEN (l_orderkey * 7 + l_linenumber) % 5 = 0 THEN ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.50 ' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS raw FROM lineitem""",
    "rated": r"""SELECT * FROM (SELECT *, CASE WHEN regexp_matches(trim(raw), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim(raw) AS DOUBLE) END AS rating FROM ratings) WHERE rating IS NOT NULL""",
    "means": "SELECT model, norm, word, avg(rating) AS rating FROM rated GROUP BY ALL",
    "scores": """SELECT o_orderpriority AS model, o_orderstatus AS embedding_type, c_mktsegment AS norm, avg(o_totalprice) / 500000.0 AS r2 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "logits": r"""SELECT item, pos, token, vocab_id, ((length(token) * (vocab_id + 1)) % 7) - vocab_id * 0.5::DOUBLE AS logit, length(token) % 3 AS actual
        FROM (SELECT item, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token FROM (SELECT conv_id * 1000 + turn AS item, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM conversations)), (SELECT unnest([0, 1, 2]) AS vocab_id)""",
}
SQL["names"] = f"""SELECT CASE WHEN p_size = 1 THEN 'human_matrix' ELSE {_pick_sql(MODALITIES, 'p_size')} || CASE WHEN p_size % 5 = 0 THEN p_brand || ' ' || p_size || 'b' ELSE {_pick_sql(MODELS, 'p_partkey')} END || {_pick_sql(VARIANTS, '(p_partkey // 9)')} END AS raw, count(*) AS n FROM part GROUP BY 1"""
_NEEDS = {"long": ["triplets"], "pairs": ["triplets", "long"], "rated": ["ratings"], "means": ["ratings", "rated"]}


def log_probs_sql(shift: int = 0) -> str:
    return f"SELECT l_returnflag AS model, (l_suppkey + {shift}) % 50 AS cue, l_partkey % 50 AS response, l_discount * -10 - l_tax AS lp FROM lineitem"


def over(*views: str, **more: str) -> str:
    """A WITH clause of the views, those they need, and further ones."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*_NEEDS.get(v, []), v] if n not in names]
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in [*((n, SQL[n]) for n in names), *more.items()]) + "\n"
