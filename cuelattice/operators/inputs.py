"""Inputs of scored models: framed texts, tokens with their places in them, and labels that mark what is scored.

A tokenizer is a plug-in that gives (id, start, end) for each token of a text; everything else is array expressions. A token is
scored if it lies over the answer's characters, up to the first end marker behind the answer's start, and is more than a separator.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelattice.functions.vectors import spans_overlap
from cuelattice.operators.infer import separator
from cuelattice.plans.session import ship_code

#: Fixed value: the label of a token that is not scored.
IGNORED = -100
TOKENS = "array<struct<id:int,a:int,b:int>>"
#: Characters of the texts whose tokens a task has at once.
PART = 1 << 18
Tokenizer = Callable[[str], list[tuple[int, int, int]]]


def framed(prompt: Column, answer: Column, before: str, between: str, after: str = "") -> tuple[Column, Column, Column]:
    """(text, start, end): prompt and answer in a frame, and the answer's characters in it."""
    head = F.concat(F.lit(before), prompt, F.lit(between))
    start = F.length(head)
    return F.concat(head, answer, F.lit(after)), start, start + F.length(answer)


def piecewise(text: str) -> list[tuple[int, int, int]]:
    """A tokenizer for tests and plans: words with the space before them, and single other characters; ids come from the pieces."""
    return [(sum(map(ord, m[0])), m.start(), m.end()) for m in re.finditer(r" ?[A-Za-z0-9]+|[^A-Za-z0-9]", text)]


def tokenised(rows: DataFrame, make: Callable[[], Tokenizer], text: str = "text") -> DataFrame:
    """``rows`` with ``tokens`` (id, a, b) of a text, whose characters a to b a token stands for; null texts have no tokens."""
    from pyspark.sql import types as T

    ship_code(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField("tokens", T.DataType.fromDDL(TOKENS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = make()
        for batch in batches:
            for part in pieces(batch, text):
                yield with_tokens(part, text, split)

    return rows.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch cut so that each part has at most PART characters of text, or one row."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and held + n > PART:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def with_tokens(part: pa.RecordBatch, text: str, split: Tokenizer) -> pa.RecordBatch:
    """The rows with their tokens, as flat arrays of numbers: an object a token would take many times the text's memory."""
    ends, flat = [0], array("i")
    for t in part.column(text).to_pylist():
        for token in split(t) if t is not None else ():
            flat.extend(token)
        ends.append(len(flat) // 3)
    places = np.array(flat, np.int32).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(places[:, k])) for k in range(3)], names=["id", "a", "b"])
    return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], names=[*part.schema.names, "tokens"])


def answer_end(tokens: Column, start: Column, end: Column, marker: int | None = None) -> Column:
    """Where the answer ends: at the start of the first marker token from ``start`` on, else at ``end``."""
    if marker is None:
        return end
    places = F.transform(F.filter(tokens, lambda t: (t["a"] >= start) & (t["id"] == marker)), lambda t: t["a"])
    return F.least(end, F.array_min(places))


def labels(tokens: Column, text: Column, start: Column, end: Column, separators: bool = False) -> Column:
    """The ids of the tokens to score and IGNORED for all others; separators count only if asked for."""

    def label(t: Column, span: Column) -> Column:
        scored = (t["b"] > t["a"]) & spans_overlap(t["a"], t["b"], span["start"], span["end"])
        if not separators:
            scored = scored & ~separator(F.substring(text, t["a"] + 1, t["b"] - t["a"]))
        return F.when(scored, t["id"]).otherwise(F.lit(IGNORED))

    # the span is bound to a variable, else its expression would be worked out for each token
    spans = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.get(F.transform(spans, lambda span: F.transform(tokens, lambda t: label(t, span))), F.lit(0))


def padded_ids(ids: Column, width: Column, pad: int) -> Column:
    """``ids`` with ``pad`` behind them up to a batch's width."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))


def batched(rows: DataFrame, ids: str, marks: str, order: list[str], size: int, pad: int) -> DataFrame:
    """``rows`` (with ``ids`` and ``marks``) in batches of ``size`` of near-equal length, padded to the longest of their batch.

    Batches are made within the sorted partitions as they come, so nothing is gathered beyond ``size`` rows.
    """
    from pyspark.sql import Window

    sized = rows.withColumn("__n", F.size(ids)).repartitionByRange("__n", *order).sortWithinPartitions("__n", *order)
    number = F.monotonically_increasing_id()
    marked = sized.withColumn("batch", (F.shiftright(number, 33) * (1 << 33)) + F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) div {size}"))
    width = F.max("__n").over(Window.partitionBy("batch"))
    out = marked.withColumn("__w", width)
    return out.withColumn(ids, padded_ids(F.col(ids), F.col("__w"), pad)).withColumn(marks, padded_ids(F.col(marks), F.col("__w"), IGNORED)).drop("__n", "__w")
