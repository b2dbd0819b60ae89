"""Readers of the file shapes this engine works on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.functions.text import number, word_key
from cuelattice.functions.vectors import parsed
from cuelattice.sources.sinks import file_system

ASSOCIATIONS = "id long, cue string, R1 string, R2 string, R3 string, age double, gender string, nativeLanguage string, country string, education double, created_at string"
LOG_PROBS = "model string, swow_id long, cue string, response_set string, age double, gender string, nativeLanguage string, country string, education double, total_log_prob double, normalized_log_prob double, num_tokens int, error string"
GENERATIONS = "cue string, responses array<string>, model string, config map<string,double>"
#: Names a column of words may have.
WORD_COLUMNS = ("word", "cue", "term", "label")


def csv(spark: SparkSession, path: str | list[str], schema: str | None = None, columns: list[str] | None = None, keep: list[Column] | None = None) -> DataFrame:
    """A CSV with a header; empty cells and NA are null, other words such as null or nan stay words.

    With a schema, columns are taken by the header's names, so that files may have more columns or another order; ``keep``
    are further columns of the scan. Several paths must have one header.
    """
    raw = spark.read.option("header", True).option("nullValue", "NA").option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    if schema is None:
        return raw
    from pyspark.sql.types import StructType

    fields = [f for f in StructType.fromDDL(schema).fields if columns is None or f.name in columns]
    have = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)
    return raw.select(*(have(f).alias(f.name) for f in fields), *(keep or []))


def associations(spark: SparkSession, path: str) -> DataFrame:
    """Association rows that have a cue and a first response."""
    return csv(spark, path, ASSOCIATIONS).na.drop(subset=["cue", "R1"])


def norms(spark: SparkSession, path: str) -> DataFrame:
    """(word, norm, rating) of human norms; ratings that are no numbers go, words are normalised."""
    raw = csv(spark, path)
    return raw.select(word_key(F.col("word")).alias("word"), F.col("norm_name").alias("norm"), number(F.col("human_rating")).alias("rating")).filter("rating is not null and word is not null")


def by_header(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Paths by the columns of their headers; only headers are read, so one scan can take all files of a kind."""
    kinds: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        kinds.setdefault(tuple(csv(spark, path).columns), []).append(path)
    return kinds


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """The files and folders of a pattern, by name."""
    fs, place = file_system(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(place) or []))


def first_there(spark: SparkSession, *patterns: str) -> str:
    """The first of several places where anything is; FileNotFoundError without one."""
    found = next((p for p in patterns if listed(spark, p)), None)
    if found is None:
        raise FileNotFoundError(", ".join(patterns))
    return found


def stem() -> Column:
    """The name of a row's file without its ending."""
    return F.regexp_replace(F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B"))), r"\.[A-Za-z]+$", "")


def by_file(spark: SparkSession, pattern: str, schema: str, name: str = "model") -> DataFrame:
    """All CSV files of a pattern with the file's stem in column ``name``; a scan for each kind of header.

    Columns are taken by the header's names: files may have them in another order, lack some (null) or have more.
    """
    kinds = by_header(spark, listed(spark, pattern))
    parts = [csv(spark, paths, schema, keep=[stem().alias(name)]) for _, paths in sorted(kinds.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, {name} string")


def model_norms(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(model, norm, word, raw) of rating files, which may call the norm's column norm or norm_name."""
    out = spark.createDataFrame([], "model string, norm string, word string, raw string")
    for header, same in sorted(by_header(spark, paths).items()):
        norm = next((c for c in ("norm", "norm_name") if c in header), None)
        if norm is not None and {"cleaned_rating", "word"} <= set(header):
            out = out.unionByName(csv(spark, same).select(stem().alias("model"), F.col(norm).alias("norm"), word_key(F.col("word")).alias("word"), F.col("cleaned_rating").alias("raw")))
    return out


def generations(spark: SparkSession, path: str, model: Column | None = None) -> DataFrame:
    """(cue, response, model): one row a response; malformed lines go, object elements give their response field.

    ``model`` replaces the lines' own model, e.g. by the file's stem.
    """
    rows = spark.read.schema(GENERATIONS + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    element = F.explode(F.coalesce("responses", F.array().cast("array<string>")))
    return flattened(rows.filter("_corrupt_record is null").select("cue", (F.col("model") if model is None else model).alias("model"), element.alias("r")))


def flattened(rows: DataFrame) -> DataFrame:
    """(cue, model, r) with r as text or a JSON object to (cue, response, model)."""
    text = F.when(F.col("r").startswith("{"), F.coalesce(F.get_json_object("r", "$.response"), F.lit(""))).otherwise(F.col("r"))
    return rows.select(word_key(F.coalesce("cue", F.lit(""))).alias("cue"), text.alias("response"), "model")


def word_keys(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(word): the keys of one JSON object, ordered and limited if ``most`` is given."""
    words = spark.read.text(path, wholetext=True).select(F.explode(F.map_keys(F.from_json("value", "map<string,string>"))).alias("word"))
    return words.orderBy("word").limit(most) if most else words


def word_column(df: DataFrame) -> str:
    """The column of words: one of the known names, else the first text column."""
    return next((c for c in WORD_COLUMNS if c in df.columns), next(c for c, t in df.dtypes if t == "string"))


def activations(spark: SparkSession, path: str) -> DataFrame:
    """(cue, vec) of a CSV with a vector as text or with a numeric column for each dimension."""
    raw = csv(spark, path)
    key = word_column(raw)
    rest = [c for c in raw.columns if c != key]
    first = raw.select(*map(lambda c: F.col(f"`{c}`"), rest)).first()
    if len(rest) == 1 and first is not None and str(first[0] or "").strip().startswith("["):
        vec = parsed(F.col(f"`{rest[0]}`"))
    else:
        vec = F.array(*(F.col(f"`{c}`").try_cast("float") for c in rest))
    return raw.select(word_key(F.col(f"`{key}`")).alias("cue"), vec.alias("vec"))


def required(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or ValueError if a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
