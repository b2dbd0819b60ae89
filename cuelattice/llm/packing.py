"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into windows' worth of ids while they last, and the rest into pieces of at most
``PIECE`` ids: short pieces let the differencing even out the windows. Pieces are dealt by number to blocks of about
``BLOCK`` pieces, so that a block is small whatever the input, its keys or its hot groups. In a block every piece begins as
a partial partition of its own; the two of largest imbalance are merged again and again, the fullest window of one with
the emptiest of the other, until one partition is left. If a window of it exceeds the capacity, the number of windows
rises and the block is done anew.

Defined results: a null text counts as empty and has just the end id; documents without an id are packed like any other;
repeated rows are packed each; an empty table gives an empty result. A piece lies in exactly one window, offsets in a
window run without gaps, and a window never holds over ``CAPACITY`` ids.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, saved, ship_code, table, text_or_empty

CAPACITY, PIECE, BLOCK, END_ID = 2048, 512, 4096, 1
#: Code points for which both tokenizer libraries have the same classes; a text with others takes the slower one.
SETTLED = re.compile("[^\x00-ԧḀ-῿ -⁯₠-₺℀-↊←-⏿─-➿　-〿]")


class ByteBpe:
    """Ids of a byte-level vocabulary file of the tokenizers library; the same merges as ranks serve ordinary texts."""

    def __init__(self, path: str, ranks_path: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.quick is None or (not text.isascii() and SETTLED.search(text)) or any(s in text for s in self.added):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


@lru_cache(maxsize=2)
def loaded(path: str | None, ranks_path: str | None) -> ByteBpe:
    if path is None:
        import public_tokenizers

        path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return ByteBpe(path, ranks_path)


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole windows first, then pieces of ``piece`` and what is left, which fills gaps."""
    whole = n // capacity
    out = [(k * capacity, capacity) for k in range(whole)]
    at, rest = whole * capacity, n % capacity
    return out + [(k, min(piece, n - k)) for k in range(at, n, piece)] if rest else out


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the pieces of every document, ids as little-endian numbers of two bytes, or four if need be."""

    def run(keys, texts):
        bpe = loaded(path, ranks_path)
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "ids")}
        for key, text in zip(keys, texts, strict=True):
            ids = np.array([*bpe.encode(text), END_ID], np.int32)
            for start, length in cuts(len(ids)):
                own = ids[start : start + length]
                values = (key, start, length, len(ids), own.astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes())
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary"
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, schema)


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(load, members) of each window, fullest first, of one Karmarkar-Karp run; windows without members are left out.

    A partial partition is a list of (load, node), fullest first and without its empty windows. Nodes past the sizes stand
    for two nodes united, so that uniting costs nothing however many members there are.
    """
    if not sizes:
        return []
    united: list[tuple[int, int]] = []
    heap = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)] if windows > 1 else [(0, 0, [(0, 0)])]
    if windows == 1:
        return [(sum(sizes), list(range(len(sizes))))]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        meet = max(0, len(first) + len(second) - windows)  # so many windows of either get a window of the other
        if not meet and first[-1][0] >= second[0][0]:
            new = first
            new += second
        else:
            keep_first, keep_second = len(first) - meet, len(second) - meet
            new = first[:keep_first] + second[:keep_second]
            for k in range(meet):  # opposing imbalances: the emptiest of one with the fullest that is left of the other
                a, b = first[keep_first + k], second[len(second) - 1 - k]
                new.append((a[0] + b[0], len(sizes) + len(united)))
                united.append((a[1], b[1]))
            new.sort(key=lambda x: -x[0])
        serial += 1
        heapq.heappush(heap, ((new[-1][0] if len(new) == windows else 0) - new[0][0], serial, new))
    out = []
    for load, node in heap[0][2]:
        members, stack = [], [node]
        while stack:
            n = stack.pop()
            if n < len(sizes):
                members.append(n)
            else:
                stack += united[n - len(sizes)]
        out.append((load, sorted(members)))
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Members of near-equal windows that all keep the capacity; their number rises until they do."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        most = max((load for load, _ in found), default=0)
        if most <= capacity:
            return [members for _, members in found]
        windows += max(1, windows * (most - capacity) // (8 * capacity))


def ids_of(held: bytes, length: int) -> np.ndarray:
    """The ids of a piece of ``pieces``."""
    return np.frombuffer(held, "<u2" if len(held) == 2 * length else "<u4")


def pack_pieces(parts: DataFrame, keep_ids: bool = True) -> DataFrame:
    """``parts`` (as of ``pieces``) with sequence_id, offset and ids_crc32 of the ids as packed; the rows are written out once before they are dealt."""
    ship_code(parts.sparkSession)
    held = saved(parts).withColumn("row", F.monotonically_increasing_id())
    blocks = max(1, -(-held.count() // BLOCK))
    dealt = held.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name != "ids")

    def run(key, pdf):
        pdf = pdf.sort_values("row", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        full, short = np.flatnonzero(lengths == CAPACITY), np.flatnonzero(lengths < CAPACITY)
        groups = [[k] for k in full.tolist()] + [short[m].tolist() for m in windows_of(lengths[short].tolist())]
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for n, members in enumerate(groups):
            sequence[members] = int(key[0]) << 20 | n
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        ids = [ids_of(held, n) for held, n in zip(pdf["ids"], lengths.tolist(), strict=True)]
        digests = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        out = pdf.drop(columns=["row", "block", "ids"]).assign(sequence_id=sequence, offset=offset, ids_crc32=digests)
        return out.assign(ids=[x.astype(np.int32) for x in ids]) if keep_ids else out

    return dealt.groupBy("block").applyInPandas(run, f"{schema}, sequence_id long, `offset` long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, **tokenizer) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece; the ids are packed either way."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pack_pieces(pieces(df, id_col, text_col, **tokenizer), keep_ids).select(*columns, *["ids"] * keep_ids)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
