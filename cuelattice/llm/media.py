"""Media columns of ISO base-media files: boxes are walked and sample tables decoded, payloads are not.

``mux_gray`` writes bytes as 24 x 24 eight-bit grey frames (576 bytes a sample) of one uncompressed video track,
``tracks`` walks the nested boxes of any such file, movie fragments included, ``media_columns`` is the DataFrame operator.

Defined results: a null media column gives null columns; bytes that are no well-formed file give ``error`` and null
track columns; a file without a track gives zero samples and an empty list of tracks; ``media_digest`` gives null digests and
an empty feature for media that are null or malformed. Repeated rows give repeated results. Nothing shuffles.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, table, text_or_empty

WIDTH = HEIGHT = 24
SAMPLE = WIDTH * HEIGHT
#: Frames a second, frames from one keyframe to the next, frames in a chunk.
TIMESCALE, GOP, CHUNK = 25, 12, 8
#: Boxes that hold boxes, and the bytes before their first child (fixed values of the format).
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
#: The fixed unity matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad_payload(data: bytes, unit: int = SAMPLE) -> bytes:
    """``data`` with bytes 255 appended up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\xff")


def mux_gray(payload: bytes) -> bytes:
    """A file of one raw grey track; ``payload`` must be a positive multiple of SAMPLE bytes."""
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise ValueError("payload must be a positive multiple of the sample size")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2", b"mp41")
    first = len(head) + (8 if len(payload) + 8 < 1 << 32 else 16)
    offsets = first + np.arange(0, n, CHUNK, dtype=np.uint64) * SAMPLE
    wide = int(offsets[-1]) >= 1 << 32
    runs = [(1, min(CHUNK, n))] + ([(len(offsets), n % CHUNK)] if n > CHUNK and n % CHUNK else [])
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    keys = np.arange(1, n + 1, GOP, dtype=">u4")
    tables = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, each, 1) for at, each in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    track = box(
        b"trak",
        full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3),
        box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey frames\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables),
        ),
    )
    movie = box(b"moov", full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), track)
    return head + box(b"mdat", payload) + movie


def walk(buf: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """Yields (path, body start, body end) of each box, parents before children; ValueError on a bad size."""
    end = len(buf) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", buf, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("truncated box header")
            size, body = struct.unpack_from(">Q", buf, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"bad size of box {kind.decode('latin-1')}")
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS and len(here) < 16:
            yield from walk(buf, body + CONTAINERS[kind], stop, here)
        start = stop


@dataclass
class Track:
    """One track's decoded tables; offsets and sizes are arrays with an entry for each sample."""

    handler: str = ""
    codec: str = ""
    number: int = 0
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    offsets: np.ndarray = None
    sizes: np.ndarray = None
    keys: np.ndarray = None  # sample numbers from 0


def _numbers(buf: bytes, at: int, n: int, end: int, kind: str = ">u4", columns: int = 1) -> np.ndarray:
    if at + n * columns * int(kind[-1]) > end:
        raise ValueError("sample table longer than its box")
    found = np.frombuffer(buf, kind, n * columns, at)
    if kind == ">u8" and n and int(found.max()) >= 1 << 62:
        raise ValueError("offset beyond any file")
    return found.astype(np.int64).reshape(n, columns)


def _sizes(buf: bytes, boxes: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """The sample sizes of stsz, or of stz2 with fields of 4, 8 or 16 bits."""
    if span := boxes.get(b"stsz"):
        each, n = struct.unpack_from(">II", buf, span[0] + 4)
        if each and n > len(buf):
            raise ValueError("more samples than bytes")
        return np.full(n, each, np.int64) if each else _numbers(buf, span[0] + 12, n, span[1])[:, 0]
    if span := boxes.get(b"stz2"):
        width, n = struct.unpack_from(">II", buf, span[0] + 4)
        width &= 255
        if width in (8, 16):
            return _numbers(buf, span[0] + 12, n, span[1], f">u{width // 8}")[:, 0]
        if width != 4:
            raise ValueError("unknown width of sample sizes")
        halves = _numbers(buf, span[0] + 12, (n + 1) // 2, span[1], ">u1")[:, 0]
        return np.stack([halves >> 4, halves & 15], axis=1).ravel()[:n]
    return np.zeros(0, np.int64)


def _decode(buf: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    t, word = Track(), lambda at: struct.unpack_from(">I", buf, at)[0]
    if span := boxes.get(b"hdlr"):
        t.handler = buf[span[0] + 8 : span[0] + 12].decode("latin-1")
    if span := boxes.get(b"mdhd"):
        long = buf[span[0]] == 1
        t.timescale, t.duration = struct.unpack_from(">IQ", buf, span[0] + 20) if long else struct.unpack_from(">II", buf, span[0] + 12)
        if t.duration == (UNKNOWN_LONG if long else UNKNOWN):
            t.duration = 0  # as for one that is not given: the samples tell
    if (span := boxes.get(b"stsd")) and word(span[0] + 4):
        t.codec = buf[span[0] + 12 : span[0] + 16].decode("latin-1")
        if t.handler == "vide":
            t.width, t.height = struct.unpack_from(">HH", buf, span[0] + 40)
    if span := boxes.get(b"tkhd"):
        t.number = word(span[0] + (20 if buf[span[0]] == 1 else 12))
    sizes = _sizes(buf, boxes)
    chunk_kind = b"co64" if b"co64" in boxes else b"stco"
    starts = np.zeros(0, np.int64)
    if span := boxes.get(chunk_kind):
        starts = _numbers(buf, span[0] + 8, word(span[0] + 4), span[1], ">u8" if chunk_kind == b"co64" else ">u4")[:, 0]
    each_chunk = np.zeros(len(starts), np.int64)
    if span := boxes.get(b"stsc"):
        for first, per, _ in _numbers(buf, span[0] + 8, word(span[0] + 4), span[1], columns=3):
            each_chunk[max(0, first - 1) :] = per
    if sum(each_chunk.tolist()) != len(sizes):
        raise ValueError("chunks and sizes disagree")
    chunk = np.repeat(np.arange(len(starts)), each_chunk)
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else sizes
    first_of = np.cumsum(each_chunk) - each_chunk
    t.sizes, t.offsets = sizes, starts[chunk] + before - before[first_of[chunk]] if len(sizes) else sizes
    if span := boxes.get(b"stts"):
        spent = _numbers(buf, span[0] + 8, word(span[0] + 4), span[1], columns=2)
        if not t.duration:
            t.duration = sum(a * b for a, b in spent.tolist())
    if t.duration >= 1 << 63:
        raise ValueError("duration beyond 63 bits")
    if span := boxes.get(b"stss"):
        t.keys = _numbers(buf, span[0] + 8, word(span[0] + 4), span[1])[:, 0] - 1
        if len(t.keys) and not (0 <= t.keys.min() and t.keys.max() < len(sizes)):
            raise ValueError("keyframe outside the samples")
    else:
        t.keys = np.arange(len(sizes))
    if len(sizes) and int((t.offsets + t.sizes).max()) > len(buf):
        raise ValueError("sample outside the file")
    return t


#: Durations that stand for an unknown one, in 32 and 64 bits.
UNKNOWN, UNKNOWN_LONG = (1 << 32) - 1, (1 << 64) - 1
#: Optional fields of a fragment's header and of its runs, as (flag, bytes) in their order (fixed values of the format).
TFHD = ((0x1, 8), (0x2, 4), (0x8, 4), (0x10, 4), (0x20, 4))
NOT_SYNC = 0x10000


def _add_run(buf: bytes, track: Track, state: dict, start: int, stop: int) -> None:
    """Appends the samples of one trun box to ``track``."""
    flags, n = struct.unpack_from(">I", buf, start)[0] & 0xFFFFFF, struct.unpack_from(">I", buf, start + 4)[0]
    at, first_flags = start + 8, None
    if flags & 0x1:
        state["at"] = state["base"] + struct.unpack_from(">i", buf, at)[0]
        at += 4
    if flags & 0x4:
        first_flags = struct.unpack_from(">I", buf, at)[0]
        at += 4
    fields = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if n > len(buf):
        raise ValueError("more samples than bytes")
    rows = _numbers(buf, at, n, stop, columns=len(fields)) if fields else np.zeros((n, 0), np.int64)
    column = lambda f, default: rows[:, fields.index(f)] if f in fields else np.full(n, default, np.int64)
    sizes, kinds = column(0x200, state[0x10]), column(0x400, state[0x20]).copy()
    if first_flags is not None and n:
        kinds[0] = first_flags
    offsets = state["at"] + np.cumsum(sizes) - sizes
    state["at"] += int(sizes.sum())
    if n and (int(offsets.min()) < 0 or state["at"] > len(buf)):
        raise ValueError("sample outside the file")
    track.keys = np.concatenate([track.keys, len(track.sizes) + np.flatnonzero(kinds & NOT_SYNC == 0)])
    track.sizes, track.offsets = np.concatenate([track.sizes, sizes]), np.concatenate([track.offsets, offsets])
    if state["known"]:
        track.duration += int(column(0x100, state[0x8]).sum())


def tracks(buf: bytes) -> list[Track]:
    """The tracks of a file, in file order; ValueError if boxes or tables are malformed."""
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, ...]] = {}
    fragments: list[tuple[int, bytes, int, int]] = []
    moof = at = 0
    try:
        for path, start, stop in walk(buf):
            if path == (b"moof",):
                moof = start - 8
            if path[-1] == b"trak":
                found.append({})
            elif b"trak" in path and found:
                found[-1].setdefault(path[-1], (start, stop))
            elif path[-1] == b"trex":
                number, *rest = struct.unpack_from(">5I", buf, start + 4)
                defaults[number] = tuple(rest)
            elif path[-1] in (b"tfhd", b"trun"):
                fragments.append((moof, path[-1], start, stop))
        made = [_decode(buf, boxes) for boxes in found]
        by_number, open_ended = {t.number: t for t in made}, {t.number for t in made if not t.duration}
        state: dict = {}
        for moof, kind, start, stop in fragments:
            if kind == b"trun":
                if not state:
                    raise ValueError("samples of a fragment without a track")
                _add_run(buf, state["track"], state, start, stop)
                continue
            flags, number = struct.unpack_from(">I", buf, start)[0] & 0xFFFFFF, struct.unpack_from(">I", buf, start + 4)[0]
            if number not in by_number:
                raise ValueError("a fragment of an unknown track")
            _, duration, size, sample = defaults.get(number, (0, 0, 0, 0))
            state = {"track": by_number[number], "base": moof, 0x8: duration, 0x10: size, 0x20: sample, "known": number in open_ended}
            at = start + 8
            for flag, width in TFHD:
                if flags & flag:
                    value = struct.unpack_from(">Q" if width == 8 else ">I", buf, at)[0]
                    at += width
                    if flag == 0x1 and value >= 1 << 62:
                        raise ValueError("offset beyond any file")
                    state["base" if flag == 0x1 else flag] = value
            state["at"] = state["base"]
        return made
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(str(e)) from e


def read_samples(buf: bytes, track: Track) -> bytes:
    """The stored bytes of all samples in decoding order."""
    return b"".join(buf[o : o + s] for o, s in zip(track.offsets.tolist(), track.sizes.tolist(), strict=True))


TRACK = "codec string, handler string, width int, height int, timescale long, duration long, n_samples long, keyframes array<struct<sample:bigint,offset:bigint,size:bigint>>"
COLUMNS = f"{TRACK}, tracks array<struct<{TRACK.replace(' array', ':array').replace(' string', ':string').replace(' int', ':int').replace(' long', ':bigint')}>>, error string"
EMPTY = {"codec": "", "handler": "", "width": 0, "height": 0, "timescale": 0, "duration": 0, "n_samples": 0, "keyframes": []}


def _described(t: Track) -> dict:
    out = {k: getattr(t, k) for k in ("codec", "handler", "width", "height", "timescale", "duration")}
    return out | {"n_samples": len(t.sizes), "keyframes": [{"sample": int(k), "offset": int(t.offsets[k]), "size": int(t.sizes[k])} for k in t.keys]}


def _describe(media: bytes | None) -> tuple[list[Track] | None, str | None]:
    if media is None:
        return None, None
    try:
        return tracks(media), None
    except ValueError as e:
        return None, str(e)


def _main(found: list[Track]) -> Track | None:
    """The first video track, else the first one."""
    return next((t for t in found if t.handler == "vide"), found[0] if found else None)


def _columns(found: list[tuple[list[Track] | None, str | None]]) -> dict[str, list]:
    mains = [None if t is None else _described(m) if (m := _main(t)) else EMPTY for t, _ in found]
    out = {k: [m[k] if m else None for m in mains] for k in EMPTY}
    return out | {"tracks": [None if t is None else [_described(x) for x in t] for t, _ in found], "error": [e for _, e in found]}


def media_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """id, codec, size, duration and keyframe byte ranges of the first video track (else the first) of each row, and all tracks."""

    def run(ids, media):
        return {"id": ids} | _columns([_describe(m) for m in media])

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")), run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes stored as raw grey frames."""

    def run(ids, texts):
        raw = [t.encode() for t in texts]
        return {"id": ids, "n_bytes": [len(r) for r in raw], "media": [mux_gray(pad_payload(r)) for r in raw]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col)), run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _digests(media: list[bytes | None]) -> dict[str, list]:
    found = [_main(t) if t else None for t, _ in map(_describe, media)]
    back = [read_samples(m, t) if t else None for m, t in zip(media, found, strict=True)]
    sha = lambda parts: [None if b is None else hashlib.sha256(b).hexdigest() for b in parts]
    size = lambda parts: [None if b is None else len(b) for b in parts]
    feature = []
    for t in found:
        ranges = ",".join(f"{o}-{s}" for o, s in zip(t.offsets[t.keys].tolist(), t.sizes[t.keys].tolist(), strict=True)) if t else ""
        feature.append(f"{t.codec.strip()};{t.width}x{t.height};{t.duration}/{t.timescale};samples={len(t.sizes)};keyframes={ranges}" if t else "")
    return {
        "payload_bytes": size(back), "payload_sha256": sha(back), "tail_crc32": [None if b is None else zlib.crc32(b[-32:]) for b in back],
        "media_bytes": size(media), "media_sha256": sha(media), "feature": feature,
    }


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to digests of the stored form, of the main track's bytes read back and of its columns."""

    def run(ids, n_bytes, media):
        return {"doc_id": ids, "n_bytes": n_bytes} | _digests(media)

    return map_columns(df.select("doc_id", "n_bytes", "media"), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {DIGESTS}")


def text_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``media_digest`` gives for ``text_media``, in one pass: the files are written and read back in the same worker."""

    def run(ids, texts):
        raw = [t.encode() for t in texts]
        out: dict[str, list] = {"doc_id": ids, "n_bytes": [len(r) for r in raw]}
        for r in raw:  # one file at a time, so that a batch of long texts holds one
            for k, v in _digests([mux_gray(pad_payload(r))]).items():
                out.setdefault(k, []).extend(v)
        return {k: out.get(k, []) for k in ("doc_id", *(f.split()[0] for f in DIGESTS.split(", ")))}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col)), run, f"doc_id {kind}, {DIGESTS}")


def op1_media(spark, sf_dir: str) -> DataFrame:
    return text_digest(table(spark, sf_dir, "documents"))
