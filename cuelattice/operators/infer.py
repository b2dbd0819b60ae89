"""Model stages as plug-ins, and the arithmetic around them.

A scorer or generator is a Python callable that gets a batch of prompts; weights and devices are its own business (it is
made once a task by ``make``). Unfinished keys come from an anti join, so a broken run is taken up by running it again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.text import answers, filled, without_separators
from cuelattice.functions.vectors import pooled, spans_overlap
from cuelattice.plans.session import ship_code


def unfinished(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(keys).distinct(), keys, "left_anti")


def prompts(words: DataFrame, templates: dict[str, str], word: str = "word") -> DataFrame:
    """(norm, word, prompt): every word in every norm's template."""
    table = F.explode(F.create_map(*(F.lit(x) for kv in sorted(templates.items()) for x in kv)))
    return words.select(word, table.alias("norm", "template")).select("norm", word, filled(F.col("template"), F.col(word)).alias("prompt"))


def score(rows: DataFrame, make: Callable[[], Callable[[list[str], list[str]], list[list[float]]]], prompt: str = "prompt", response: str = "response_set") -> DataFrame:
    """``rows`` with the log-probabilities of the response's tokens, by a scorer of (prompts, responses)."""
    ship_code(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in batches:
            yield pdf.assign(token_log_probs=scorer(pdf[prompt].tolist(), pdf[response].tolist()))

    return rows.mapInPandas(run, f"{schema}, token_log_probs array<double>")


def summed(scored: DataFrame, lps: str = "token_log_probs") -> DataFrame:
    """Totals of token log-probabilities: their sum, number and mean (0 without tokens); of a row that failed, null, 0 and null."""
    total = F.aggregate(lps, F.lit(0.0), lambda a, x: a + x)
    n = F.when(F.col(lps).isNull(), 0).otherwise(F.size(lps))
    mean = F.when(F.col(lps).isNotNull(), F.coalesce(F.try_divide(F.col("total_log_prob"), F.col("num_tokens")), F.lit(0.0)))
    return scored.withColumn("total_log_prob", total).withColumn("num_tokens", n).withColumn("normalized_log_prob", mean)


def generate(cues: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], samples: int = 100, prompt: str = "prompt") -> DataFrame:
    """``cues`` times ``samples`` with ``text`` from a generator of prompts, and its first three answers."""
    ship_code(cues.sparkSession)
    many = cues.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in many.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for pdf in batches:
            yield pdf.assign(text=generator(pdf[prompt].tolist()))

    return many.mapInPandas(run, f"{schema}, text string").withColumn("responses", answers(F.col("text")))


def embed(words: DataFrame, make: Callable[[], Callable[[list[str]], list[list[tuple[int, int, list[float]]]]]], template: str = "{word}", how: str = "mean", word: str = "word") -> DataFrame:
    """(word, vec): token vectors of the word within its sentence, pooled over the tokens that meet the word's span.

    A model gives (start, end, vector) of each token of a sentence; tokens of no width are special ones and left out. A word
    that the template does not show has no tokens and a null vector.
    """
    ship_code(words.sparkSession)
    asked = words.select(F.col(word).alias("word"), filled(F.lit(template), F.col(word)).alias("sentence")).withColumn("at", F.locate("\u0001", filled(F.lit(template), F.lit("\u0001"))) - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            tokens = [[{"a": int(a), "b": int(b), "v": [float(x) for x in v]} for a, b, v in found] for found in model(pdf["sentence"].tolist())]
            yield pd.DataFrame({"word": pdf["word"], "at": pdf["at"], "tokens": tokens})

    out = asked.mapInPandas(run, "word string, at int, tokens array<struct<a:int,b:int,v:array<double>>>")
    met = F.filter("tokens", lambda t: (t["b"] > t["a"]) & (F.col("at") >= 0) & spans_overlap(t["a"], t["b"], F.col("at"), F.col("at") + F.length("word")))
    return out.select("word", pooled(F.transform(met, lambda t: t["v"]), how).alias("vec"))


def yield_rate(generated: DataFrame, by: list[str], responses: str = "responses") -> DataFrame:
    """By key the share of generations with three answers, and PASS or FAIL at one half."""
    rate = F.avg((F.size(responses) == 3).cast("double"))
    return generated.groupBy(*by).agg(rate.alias("yield_rate"), F.count(F.lit(1)).alias("n_generations")).withColumn("status", F.when(F.col("yield_rate") >= 0.5, "PASS").otherwise("FAIL"))


def token_log_probs(logits: DataFrame, chosen: DataFrame) -> DataFrame:
    """(item, pos, log_prob) of the chosen vocabulary entries: logit - log sum exp over the position's vocabulary.

    ``logits`` (item, pos, vocab_id, logit), ``chosen`` (item, pos, vocab_id). Two aggregations, no window.
    """
    top = logits.groupBy("item", "pos").agg(F.max("logit").alias("top"))
    sums = logits.join(top, ["item", "pos"]).groupBy("item", "pos").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("logit") - F.col("top"))).alias("z"))
    own = logits.join(chosen.select("item", "pos", "vocab_id"), ["item", "pos", "vocab_id"])
    return own.join(sums, ["item", "pos"]).select("item", "pos", (F.col("logit") - F.col("top") - F.log("z")).alias("log_prob"))


def separator(piece: Column) -> Column:
    """Whether a token is only white space or a comma, which is not scored."""
    return F.regexp_replace(piece, r"\s", "").isin("", ",")


def same_text(scored: Column, intended: Column) -> Column:
    """The smoke test: the scored tokens spell the intended response but for separators."""
    return without_separators(scored).eqNullSafe(without_separators(intended))


#: Names of the rating norms, each with its scale. The wording is ours; a caller puts in that of a study.
SCALES = {
    "arousal_warriner": "from 1 (excited) to 9 (calm), how you feel when you read",
    "concreteness_brysbaert": "from 1 (abstract) to 5 (concrete), how much its meaning can be met by the senses for",
    "valence_mohammad_positive": "from 0 (not positive) to 3 (strongly positive), how positive the meaning is of",
    "valence_mohammad_negative": "from 0 (not negative) to 3 (strongly negative), how negative the meaning is of",
    "visual_lancaster": "from 0 (not at all) to 5 (greatly), how much you experience by seeing",
    "auditory_lancaster": "from 0 (not at all) to 5 (greatly), how much you experience by hearing",
    "gustatory_lancaster": "from 0 (not at all) to 5 (greatly), how much you experience by tasting",
    "olfactory_lancaster": "from 0 (not at all) to 5 (greatly), how much you experience by smelling",
    "haptic_lancaster": "from 0 (not at all) to 5 (greatly), how much you experience by touching",
    "aoa_kuperman": "in years of age, when you learnt",
    "aoa_brysbaert": "in years of age, when people mostly learn",
    "morality_troche": "how moral or immoral the meaning is of",
    "gender_association_glasgow": "from 1 (very feminine) to 7 (very masculine), which gender goes with",
    "humor_engelthaler": "from 1 (humorless) to 5 (humorous), how funny you find",
    "socialness_diveica": "from 1 (not social) to 7 (very social), how social the meaning is of",
}
TEMPLATES = {norm: f"Please rate, {scale} the word below. Answer with a number and nothing else.\nWord: \"{{word}}\"\nRating:" for norm, scale in SCALES.items()}
