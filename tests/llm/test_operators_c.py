"""Prefix trie, hard negatives, SuperMinHash: brute-force versions, SQL and the edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelattice.llm import negatives, prefixtrie, superminhash
from cuelattice.llm.queries import ORACLES, QUERIES


def plain_rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", ["op11_prefixtrie", "op12_negatives", "op13_superminhash"])
def test_oracles(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    want = duck.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, plain_rows(got))) == sorted(map(str, want))


# --- prefix trie ---------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, key string, name string, pos int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "k", "n", 7) for r in rows], TURNS)


def plain_conversations(rows):
    found = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=order):
        found.setdefault(c, []).append((role or "", text or ""))
    return found


def plain_trie(convs):
    """NODE rows of {conversation: [(role, text)]} by comparing prefixes as tuples."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ended = sorted(c for c in own if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(own), len(path), hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest(), len(children), len(own), len(leaves), parent, saved))
    return sorted(out, key=str)


def trie_rows(df):
    names = ("conv_id", "depth", "ends_sha256", "n_children", "n_convs", "n_leaves", "parent_conv_id", "saved_tokens")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def some_conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-3, n):
        own = rng.randrange(longest) if c % 7 else longest
        for t in range(own):
            role, text = rng.choice([("u", "a"), ("u", "b"), ("v", "é" * 5), (None, "a"), ("u", None)]) if rng.random() < 0.3 else ("u", f"turn {t}")
            rows.append((c, t if rng.random() < 0.95 else None, role, text))
    return [*rows, (None, 0, "u", "lost"), (None, None, None, None), *rows[:4]]


@pytest.mark.parametrize(("seed", "n", "longest"), [(1, 30, 9), (2, 8, 37)])
def test_trie_equals_that_of_compared_prefixes(spark, seed, n, longest):
    rows = some_conversations(seed, n, longest)
    got = prefixtrie.prefix_trie(turns_of(spark, rows))
    assert trie_rows(got) == plain_trie(plain_conversations(rows))
    ends = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in got.collect()}
    convs = plain_conversations(rows)
    assert all(x == (convs[c][d - 1] if d else (None, None)) for (c, d), x in ends.items())


def test_spliced_conversations(spark):
    rows = [(c, t, "u", f"{t} of {c if t > 2 else 'all'}") for c in (0, 1, 2, 3, 5, 7, 99, 100, 201, 205, *range(301, 312)) for t in range(c % 6 + 1 if c < 300 else 1)]
    own = plain_conversations(rows)
    want = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    assert any(not turns for turns in want.values())  # some have no turns at all
    turns = prefixtrie.ordered_turns(turns_of(spark, rows))
    assert trie_rows(prefixtrie.trie(*prefixtrie.spliced(turns))) == plain_trie(want)


def test_trie_of_nothing_and_of_one_conversation_for_all(spark):
    assert prefixtrie.prefix_trie(turns_of(spark, []).limit(0)).count() == 0
    assert prefixtrie.prefix_trie(turns_of(spark, [(None, 1, "u", "x")])).count() == 0
    same = [(c, t, "u", "x" * 1000) for c in range(700) for t in range(2)]  # more ended conversations than a piece holds
    assert trie_rows(prefixtrie.prefix_trie(turns_of(spark, same))) == plain_trie(plain_conversations(same))


# --- hard negatives ------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long, q string, place int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "q", 2) for r in rows], VECTORS)


def plain_negatives(rows, anchors, k=5):
    ok = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int), y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: int(a[: min(len(a), len(b))] @ b[: min(len(a), len(b))])
    out = []
    for at, (i, v, y) in enumerate(ok):
        if not anchors(i):
            continue
        others = sorted(((-score(v, w), j, z) for b, (j, w, z) in enumerate(ok) if b != at), key=lambda t: t[:2])
        for p, pid, _ in [t for t in others if t[2] == y][:k]:
            inside = [(s, j) for s, j, z in others if z != y and 80 * -p <= 100 * -s <= 100 * -p][:k]
            out += [(i, j, -s, pid, -p, rank + 1) for rank, (s, j) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("block", "panel", "chunk"), [((256, 2048), 1 << 15, 32), ((2, 7), 9, 3)])
def test_negatives_equal_those_of_all_scores(spark, monkeypatch, block, panel, chunk):
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "MOST_CHUNKS", 100)
    rng = np.random.default_rng(4)
    rows = [(k, (rng.integers(-3, 9, 8) / 16).tolist(), int(rng.integers(0, 3))) for k in range(60)]
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[4][1], 1), (6, [], 0), (9, [0.5] * 3, 2), (70, [0.25] * 8, None), (71, None, 1), (72, [float("nan")] * 8, 1), (73, [None, 1.0], 1), (74, [float("inf")], 0), (75, [1e6], 0), (None, [0.5] * 8, 1)]
    got = negatives.hard_negatives(vectors_of(spark, rows), "vec_id", "embedding", F.col("label"), F.col("id") % 3 == 0, block_anchors=block[0], block_rows=block[1], panel=panel)
    want = plain_negatives([r for r in rows if r[0] != 75], lambda i: i % 3 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5])
    assert sorted(key((r["anchor_id"], r["negative_id"], r["negative_score"], r["positive_id"], r["positive_score"], r["rank"])) for r in got.collect()) == want


def test_negatives_of_nothing(spark):
    run = lambda rows: negatives.hard_negatives(vectors_of(spark, rows), "vec_id", "embedding", F.col("label"), F.col("id") % 100 == 0).count()
    assert run([(1, [1.0], 1)]) == 0  # no anchor
    assert run([(0, [1.0], 1)]) == 0  # no other row
    assert run([(0, [1.0], 1), (1, [1.0], 1)]) == 0  # no row of another label
    assert negatives.hard_negatives(vectors_of(spark, [(0, [1.0], 1)]).limit(0), "vec_id", "embedding", F.col("label"), F.lit(True)).count() == 0


# --- SuperMinHash --------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, id string, n int, key string, node long"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, "y", 2) for k, t in texts], DOCS)


def plain_set(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def plain_groups(texts, least=85):
    sets = {k: plain_set(t) for k, t in texts}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= least * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((root(k), k, root(k) == k, len(s)) for k, s in sets.items())


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def grouped(df):
    return sorted((r["component_id"], r["id"], r["kept"], r["n_shingles"]) for r in df.collect())


@pytest.mark.parametrize("weight", [512, 3])
def test_groups_equal_those_of_all_pairs(spark, monkeypatch, weight):
    monkeypatch.setattr(superminhash, "WEIGHT", weight)
    rng = random.Random(9)
    texts = family(rng, 40, 120, 7) + family(rng, 25, 60, 4) + family(rng, 6, 300, 12) + ["", None, " \t\n", "a", "A", "a b", "A\tb", "a b c", "é É", "é é", "a b c d"] * 2
    texts += [" ".join(f"v{k % 50}" for k in range(20000)), " ".join(f"v{k % 50}" for k in range(20003))]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    assert grouped(superminhash.near_groups(docs_of(spark, docs))) == plain_groups(docs)


def test_rows_without_id_repeated_rows_and_no_rows(spark):
    got = superminhash.near_groups(docs_of(spark, [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "a b c d"), (4, "z")])).collect()
    assert sorted(map(str, ((r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got))) == sorted(map(str, [(5, 2, 3, False), (5, 2, 3, False), (None, 2, None, False), (3, 2, 3, True), (4, 1, 4, True)]))
    assert superminhash.near_groups(docs_of(spark, []).limit(0)).count() == 0
    left = superminhash.drop_near_duplicates(docs_of(spark, [(5, "a b c d"), (None, "a b c d"), (3, "a b c d"), (4, "z")]))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "4", "None"] and left.columns == docs_of(spark, [(1, "")]).columns


def plain_super_minhash(elements, places):
    """One element after another, each over its whole order."""
    kept = [(1 << 64) - 1] * places
    for e in elements:
        order = list(range(places))
        for step in range(places):
            x = int(superminhash.mixed(np.array([(int(e) + (step + 1) * superminhash.STEP) % (1 << 64)], np.uint64))[0])
            other = step + ((x >> 32) * (places - step) >> 32)
            order[step], order[other] = order[other], order[step]
            kept[order[step]] = min(kept[order[step]], step << 32 | x & 0xFFFFFFFF)
    return kept


def test_signatures_equal_those_without_an_early_stop(monkeypatch):
    monkeypatch.setattr(superminhash, "WALKERS", 50)
    sets = [np.sort(np.random.default_rng(k).integers(0, 1 << 63, n).astype(np.uint64)) for k, n in enumerate((1, 2, 0, 7, 120, 30))]
    got = superminhash.signatures(sets, 16)
    assert [row.tolist() for row in got] == [plain_super_minhash(s, 16) for s in sets]


def test_signatures_estimate_with_less_variance_than_independent_ranks():
    rng = np.random.default_rng(0)
    shared, errors = 100, []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 150).astype(np.uint64)
        a, b = superminhash.signatures([np.sort(pool[:125]), np.sort(np.concatenate([pool[:shared], pool[125:]]))])
        errors.append((a == b).mean() - shared / 150)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.85 * (2 / 3) * (1 / 3) / superminhash.PLACES


def test_shingles_are_told_apart_exactly():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(200))) for _ in range(60)]
    assert [len(s) for s in superminhash.shingle_sets(texts)] == [len(plain_set(t)) for t in texts]
    sets = superminhash.shingle_sets(texts)
    for a, b in itertools.combinations(range(30), 2):
        assert len(np.intersect1d(sets[a], sets[b])) == len(plain_set(texts[a]) & plain_set(texts[b]))
    full = [plain_set(t) for t in texts if plain_set(t)]
    counts = superminhash.shared_counts([s for s in sets if len(s)])
    assert all(counts[i][j] == len(full[i] & full[j]) for i, j in itertools.combinations(range(len(full)), 2))
