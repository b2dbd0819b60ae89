"""Media, packing, fingerprints, BPE, SimHash: brute-force versions on small tables, and the edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.llm import bpe, components, media, neardocs, packing, simhash, spotsigs

DOCS = "doc_id long, text string, media string, key string, range int, id string, words int"
TEXTS = [
    "The cat sat on the mat and the dog is a friend of the house. " * 3, None, "", "   \n\t ", "one", "two words", "É ß Σ 日本語 \U0001f600 <|endoftext|> a",
    "The cat sat on the mat and the dog is a friend of the house. " * 3, "x" * 3000, "word " * 4000, "a b c d", "A B C D",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "m", "k", 1, "z", 0) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "m", "k", 1, "z", 0), (None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- media ---------------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs):
    stored = media.text_media(docs)
    for r in media.media_digest(stored).collect():
        if r["doc_id"] is None:
            continue
        raw = (TEXTS[r["doc_id"]] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want)) and len(want) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest() and r["tail_crc32"] == zlib.crc32(want[-32:])
    assert stored.count() == docs.count()


def test_media_columns(spark):
    payload = bytes(range(256)) * 63  # 28 frames
    file = media.mux_gray(payload)
    table = spark.createDataFrame([(1, file), (2, None), (3, b"junk"), (4, file[:-40]), (5, b"")], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.media_columns(table).collect()}
    assert (got[1]["codec"], got[1]["handler"], got[1]["width"], got[1]["duration"], got[1]["timescale"], got[1]["n_samples"]) == ("raw ", "vide", 24, 28, 25, 28)
    frames = [file[k["offset"] : k["offset"] + k["size"]] for k in got[1]["keyframes"]]
    assert frames == [payload[n * 576 : (n + 1) * 576] for n in (0, 12, 24)]
    assert got[2]["codec"] is None and got[2]["error"] is None and got[3]["error"] and got[4]["error"] and got[5]["n_samples"] == 0


def test_sample_tables_of_other_shapes():
    """Variable sizes, 64-bit offsets, several chunks and no sync table, built by hand."""
    import struct

    sizes, data = [3, 5, 2, 7], b"aaabbbbbccddddddd"
    full, box = media.full, media.box
    head = box(b"ftyp", b"isom", bytes(4))
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"abcd", bytes(28))), full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 5)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)),
        full(b"stsz", struct.pack(">II4I", 0, 4, *sizes)), full(b"co64", struct.pack(">IQQ", 2, len(head) + 8, len(head) + 8 + 10)),
    )
    mdhd = full(b"mdhd", struct.pack(">QQIQ", 0, 0, 90, 35), bytes(4), version=1)
    file = head + box(b"mdat", data) + box(b"moov", box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun"), box(b"minf", stbl))))
    (t,) = media.tracks(file)
    assert media.read_samples(file, t) == data and t.keys.tolist() == [0, 1, 2, 3] and (t.codec, t.timescale, t.duration) == ("abcd", 90, 35)


def test_fragments_audio_first_and_small_sizes():
    """An audio track of 4-bit sizes before a video track whose samples are in movie fragments."""
    import struct

    full, box = media.full, media.box
    head = box(b"ftyp", b"iso5", bytes(4))
    sound, frames = b"abbccc", [b"KKKK", b"pp", b"qqq"]
    mdat = box(b"mdat", sound)
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28))), full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), full(b"stz2", struct.pack(">II", 4, 3), bytes([0x12, 0x30])), full(b"stco", struct.pack(">II", 1, len(head) + 8)))
    track = lambda n, handler, tables: box(b"trak", full(b"tkhd", bytes(8), struct.pack(">I", n), bytes(68)), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), bytes(4)), full(b"hdlr", bytes(4), handler), box(b"minf", tables)))
    none = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(24), struct.pack(">HH", 640, 360), bytes(50))), full(b"stsz", bytes(8)), full(b"stsc", bytes(4)), full(b"stco", bytes(4)))
    moov = box(b"moov", track(1, b"soun", stbl), track(2, b"vide", none), box(b"mvex", full(b"trex", struct.pack(">5I", 2, 1, 40, 9, 0x10000))))
    before = head + mdat + moov
    runs = lambda offset: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 2), flags=0x20000), full(b"trun", struct.pack(">IiI", 3, offset, 0), *(struct.pack(">I", len(f)) for f in frames), flags=0x205)))
    moof = runs(len(runs(0)) + 8)
    file = before + moof + box(b"mdat", *frames)
    audio, video = media.tracks(file)
    assert media.read_samples(file, audio) == sound and audio.sizes.tolist() == [1, 2, 3]
    assert media.read_samples(file, video) == b"".join(frames) and video.keys.tolist() == [0] and (video.duration, video.width, video.height) == (120, 640, 360)
    row = media._columns([media._describe(file)])
    assert row["codec"] == ["avc1"] and [t["codec"] for t in row["tracks"][0]] == ["mp4a", "avc1"]


def test_malformed_files_give_errors_only(spark):
    """Truncations, overwritten words and bytes anywhere: a description or an error, never a crash, and no range outside the file."""
    chance, file = random.Random(10), media.mux_gray(bytes(576) * 30)
    start = file.index(b"moov") - 4
    bad = [file[:k] for k in range(start, len(file), 7)] + [media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd"))))]
    for _ in range(3000):
        at = chance.randrange(start, len(file) - 8)
        bad.append(file[:at] + chance.choice([b"\xff" * 8, b"\x00" * 4, b"\x00\x00\x00\x01", bytes([chance.randrange(256)])]) + file[at + 8 :])
    for b in bad:
        found, error = media._describe(b)
        assert (found is None) == (error is not None)
        for t in found or []:
            assert not len(t.sizes) or (t.offsets.min() >= 0 and (t.offsets + t.sizes).max() <= len(b))
    table = spark.createDataFrame([(k, 0, b) for k, b in enumerate([*bad[:50], None])], "doc_id long, n_bytes long, media binary")
    assert media.media_digest(table).count() == 51 and media.media_columns(table).filter("error is null").count() >= 1


def test_media_of_empty_table(empty, docs):
    both = [sorted(map(str, x.collect())) for x in (media.media_digest(media.text_media(docs)), media.text_digest(docs))]
    assert both[0] == both[1] and media.text_digest(empty).count() == 0
    assert media.media_digest(media.text_media(empty)).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------------


def check_packing(rows, texts):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    tokens = packing.loaded(None, None).whole
    for i, text in texts.items():
        ids, at = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
    return sum(r["length"] for r in rows) / 2048 / len(by_window)


def test_packing_is_whole(spark):
    chance = random.Random(1)
    texts = {k: " ".join(chance.choice(["sun", "moonlight", "<|endoftext|>", "é", "12"]) for _ in range(int(chance.expovariate(1 / 300)))) for k in range(400)} | {900: None, 901: "", 902: "long " * 9000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert check_packing(packing.pack(df).collect(), texts) > 0.98


def test_packing_keeps_repeats_and_rows_without_id(docs):
    rows = packing.pack(docs, keep_ids=True).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 0)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_packing_of_empty_table(empty):
    assert packing.pack(empty).count() == 0


def test_differencing():
    assert packing.windows_of([], 10) == [] and packing.windows_of([10], 10) == [[0]]
    got = packing.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(load for load, _ in got) == [14, 16]  # the known result of the differencing method
    chance = random.Random(2)
    sizes = [chance.randint(1, 512) for _ in range(700)]
    windows = packing.windows_of(sizes)
    assert sorted(k for w in windows for k in w) == list(range(700)) and max(sum(sizes[k] for k in w) for w in windows) <= 2048
    assert len(windows) <= -(-sum(sizes) // 2048) * 1.03 + 1


# --- SpotSigs ------------------------------------------------------------------------------------------------------------


def signature_set(text):
    import regex
    import xxhash

    common, anchors = set(spotsigs.ANCHORS + spotsigs.SKIPPED), set(spotsigs.ANCHORS)

    def hashed(*words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed & (1 << 64) - 1)
        return seed - (1 << 64) if seed >> 63 else seed

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if x]
    found = {hashed(x, *[y for y in w[i + 1 :] if y not in common][:2]) for i, x in enumerate(w) if x in anchors}
    return found or {hashed(*w[i : i + 3]) for i in range(len(w))}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("ranges", [2000, 3])
def test_spotsigs_against_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", ranges)
    chance = random.Random(4)
    words = "the a of and sun moon sea tree der und le la et house green dog".split()
    texts = {k * 7 % 101: chance.choice(["", None, *[" ".join(chance.choice(words) for _ in range(chance.randint(1, 60)))] * 8]) for k in range(60)}
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    order = sorted(texts, reverse=True)
    shown = lambda found: "".join(f"{x & (1 << 64) - 1:016x}" for x in sorted(found))
    assert set(got) == set(order)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        a, b, c = map(signature_set, (own, edited, after))
        r = got[i]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == shown(a) and r["edited_fingerprint"] == shown(b)
        assert abs(r["near_edited"] - jaccard(a, b)) < 1e-12 and abs(r["near_next"] - jaccard(a, c)) < 1e-12


def test_spotsigs_edge_rows(docs, empty, spark):
    rows = spotsigs.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count() and len({r["fingerprint"] for r in rows if r["doc_id"] in (0, 7)}) == 1
    assert spotsigs.edited_fingerprints(empty).count() == 0
    alone = spotsigs.edited_fingerprints(spark.createDataFrame([(5, "the sun is up and the sea")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1
    named = spotsigs.edited_fingerprints(spark.createDataFrame([("x1", "the sun"), ("7", "the sea"), (None, "a")], "doc_id string, text string"))
    assert {r["doc_id"] for r in named.collect()} == {"x1", "7", None}


def test_spotsigs_uses_no_python(docs):
    plan = spotsigs.edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("share", [512, 2])
def test_spotsigs_links_lose_nothing(spark, monkeypatch, share):
    monkeypatch.setattr(spotsigs, "SHARE", share)
    chance = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    make = lambda n: " ".join(f"the {chance.choice(words)} {chance.choice(words)}" for _ in range(n))
    bases = [make(chance.randint(5, 40)) for _ in range(12)]
    texts = bases + [b + " the odd one" for b in bases] + [b.replace("w1 ", "w2 ", 1) for b in bases] + bases[:3] + [" ".join(b.split()[:-3]) for b in bases]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    classes, links = spotsigs.near_links(df)
    of = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    got = {(r["a"], r["b"]) for r in links.collect()}
    sets = {c: signature_set(texts[c]) for c in set(of.values())}
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert got == want and want and all(of[36 + k] == of[k] for k in range(3))


# --- BPE -----------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path("word_bpe_49k.json")
    library, chance = Tokenizer.from_file(path), random.Random(6)
    names = [n.replace("</w>", "") for n in bpe.loaded(path).vocabulary.names]

    def text():
        k = chance.random()
        if k < 0.4:
            return "".join(chance.choice("abcdefghijklmnopqrstuvwxyz' ") for _ in range(chance.randrange(50)))
        if k < 0.7:
            return "".join(chance.choice(names) for _ in range(6))
        return "".join(chance.choice(["<|endoftext|>", "<|startoftext|>", "the", " ", "\n", "ΑΣ", "é", "É", "İ", "'s", "'S", "12", "!!", "a" * 60, "\x1c", "日本", " "]) for _ in range(9))

    texts = [text() for _ in range(3000)] + ["", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.bpe_encode(df).collect()}
    for k, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[k] == want, t
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(df)).collect()}
    assert all(back[k] == library.decode(got[k], skip_special_tokens=False) for k in got)
    for r in bpe.bpe_digest(df).collect():
        ids = got[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(back[r["doc_id"]].encode()).hexdigest()


def test_bpe_equals_the_library_on_every_code_point():
    import unicodedata

    from tokenizers import Tokenizer

    path = bpe.vocabulary_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x32000 or c % 97 == 0)]
    bad = []
    for at in range(0, len(points), 16):
        text = " ".join(f"a{chr(c)}b 1{chr(c)}! {chr(c)}" for c in points[at : at + 16])
        if own.encode(text).tolist() != library.encode(text, add_special_tokens=False).ids:
            bad += [c for c in points[at : at + 16] if own.encode(t := f"a{chr(c)}b 1{chr(c)}! {chr(c)}").tolist() != library.encode(t, add_special_tokens=False).ids]
    assert not bad, [(hex(c), unicodedata.category(chr(c))) for c in bad[:20]]


def test_bpe_edges(docs, empty):
    assert bpe.bpe_digest(docs).count() == docs.count() and bpe.bpe_digest(empty).count() == 0
    with pytest.raises(ValueError):
        bpe.loaded(bpe.vocabulary_path("word_bpe_49k.json")).decode(np.array([10**6]))


def test_bpe_forgetting_changes_nothing(monkeypatch):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    texts = [f"sun{k} moon{k % 7}, sea" for k in range(300)]
    want = [bpe.WordBpe(path).encode(t).tolist() for t in texts[:20]]
    monkeypatch.setattr(bpe, "KEPT_CHARS", 30)
    monkeypatch.setattr(bpe, "LONGEST_KEPT", 5)
    small = bpe.WordBpe(path)
    assert [small.encode(t).tolist() for t in texts][:20] == want


# --- SimHash --------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    """Smallest id reachable by links of ids with fingerprints, by comparing all."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_comparison_against_popcounts():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 700, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    wide_a, wide_b = a[:600].reshape(150, 4), b[:600].reshape(150, 4)
    assert (simhash.near_pairs(wide_a, wide_b, 16) == (np.bitwise_count(wide_a ^ wide_b).sum(axis=1) <= 16)).all()
    near = [z for x in simhash.near_block(wide_a, wide_b, 16, rows=40) for z in zip(*(c.tolist() for c in x), strict=True)]
    assert all(np.bitwise_count(wide_a[i] ^ wide_b[j]).sum() == d for i, j, d in near)
    got = {(i, j) for i, j, _ in near}
    assert got == set(zip(*(z.tolist() for z in np.nonzero(np.bitwise_count(wide_a[:, None] ^ wide_b[None]).sum(axis=2) <= 16)), strict=True))
    for radius in (0, 1, 3, 4, 7):
        assert (simhash.near_pairs(a, b, radius) == (np.bitwise_count(a ^ b) <= radius)).all()
    got = {(i, j) for x, y, _ in simhash.near_block(a[:150], b[:333], rows=40) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == set(zip(*(z.tolist() for z in np.nonzero(np.bitwise_count(a[:150, None] ^ b[None, :333]) <= 4)), strict=True))


@pytest.mark.parametrize(("bucket", "load"), [(4096, 64), (40, 0), (40, 64)])
def test_groups_against_brute_force(spark, monkeypatch, bucket, load):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "KEY_LOAD", load)
    rng = np.random.default_rng(2)
    prints = {}
    for c in range(25):
        x = int(rng.integers(0, 2**63)) * 2 + c % 2
        for _ in range(int(rng.integers(1, 30)) if c else 150):
            prints[len(prints)] = x
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(bit)
    df = spark.createDataFrame([(i, simhash.signed(x)) for i, x in prints.items()], "id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    want = groups(prints)
    assert all(got[simhash.signed(x)] == want[i] for i, x in prints.items())


def test_simhash_query_rows(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = groups({k: plain_fingerprint(t or "") for k, t in enumerate(TEXTS)})
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{plain_fingerprint(TEXTS[r['doc_id']] or ''):016x}" and r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(empty).count() == 0


def shingle_set(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard_roots(texts):
    """The smallest index of each text's group, by comparing all sets."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root


def test_one_document_of_a_group_stays(docs, empty, spark):
    kept = neardocs.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    texts = [t or "" for t in TEXTS] + ["no id"]
    want = {r for r in jaccard_roots(texts) if r < len(TEXTS)}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert neardocs.drop_near_duplicates(empty).count() == 0
    # two texts of one id: the near copy goes, the other stays
    a = " ".join(f"w{k}" for k in range(60))
    rows = [(1, a), (2, a + " more"), (2, "quite another text of its own"), (2, "quite another text of its own")]
    left = neardocs.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [rows[0], rows[2]]


@pytest.mark.parametrize(("block", "small", "few"), [(2048, 8, 10**6), (5, 2, 0)])
def test_dropped_copies_against_brute_force_jaccard(spark, monkeypatch, block, small, few):
    monkeypatch.setattr(neardocs, "BLOCK", block)
    monkeypatch.setattr(neardocs, "SMALL", small)
    monkeypatch.setattr(neardocs, "FEW", few)
    chance = random.Random(8)
    make = lambda n: [f"w{chance.randrange(4000)}" for _ in range(n)]
    line, texts = make(12), []
    for _ in range(12):
        base = make(chance.randint(6, 200)) + line
        for _ in range(chance.randint(1, 14)):
            copy = list(base)
            for _ in range(chance.randint(0, 1 + len(base) // 40)):
                copy[chance.randrange(len(copy))] = "odd"
            texts.append(" ".join(copy))
    texts += ["", "a b", "A  b", "a b c d e", "a b c d e f"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardocs.drop_near_duplicates(df).collect()) == sorted(set(jaccard_roots(texts)))


def test_common_shingles_are_counted_in_all_texts(spark):
    texts = spark.range(45_000).selectExpr("concat('w', id, if(id % 1000 = 0, ' a b c d e a b c d e', ' x y z'), if(id % 9000 = 0, ' f g h i j', '')) AS text")
    found, counts = neardocs.common_shingles(texts)
    got = dict(zip(found.tolist(), counts.tolist(), strict=True))
    named = lambda t: int(neardocs.shingles(t)[0])
    assert got[named("a b c d e")] == got[named("d e a b c")] == 45 and got[named("f g h i j")] == 5 and len(got) == 10
    assert list(got) == sorted(got)


def tasks_of(spark, run):
    """Tasks of all stages that ``run()`` starts, without a planner that merges small partitions of 32."""
    usual = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup(group := f"tasks-{random.random()}", "")
    try:
        run()
        told = spark.sparkContext.statusTracker()
        stages = {s for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds}
        return sum(info.numCompletedTasks for s in stages if (info := told.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in usual.items():
            spark.conf.set(k, v)


def test_components_of_a_small_table_take_few_tasks(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)], "u long, v long").coalesce(1)
    assert tasks_of(spark, lambda: components.components(edges).count()) < 400


def test_nodes_alone_in_their_part_of_a_divided_block_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(neardocs, "BLOCK", 5)
    monkeypatch.setattr(neardocs, "SMALL", 2)
    texts = [" ".join([*(f"g{j}" for j in range(100)), f"odd{k % 30}"]) for k in range(60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert [r["doc_id"] for r in neardocs.drop_near_duplicates(df).collect()] == [0]


def test_wide_radius_loses_no_near_pair():
    rng = np.random.default_rng(3)
    most = 0
    for n in [*range(5, 40), 60, 200, 1000] * 40:
        shared = rng.integers(-(2**62), 2**62, n)
        own = max(0, n // 4)  # a split of what differs that leaves Jaccard similarity at 0.8 or just above
        cut = int(rng.integers(0, own + 1))
        extra = rng.integers(-(2**62), 2**62, own)
        a, b = (np.unique(np.concatenate([shared, x])) for x in (extra[:cut], extra[cut:]))
        if neardocs.near(a, b):
            most = max(most, int(np.bitwise_count(neardocs.wide_print(a) ^ neardocs.wide_print(b)).sum()))
    assert 40 < most <= neardocs.RADIUS - 10


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 400), (400, 450), (7, 7), (None, 3), (500, 400)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[500] == got[450] == got[400] == 400
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
