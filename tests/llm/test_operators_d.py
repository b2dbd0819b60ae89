"""Faults that were mended: long and odd inputs, wide ids, unknown durations, mixed licences; brute-force versions of added spans."""

import base64
import random
import re
import struct
import time
import unicodedata
import uuid

import duckdb
import numpy as np
import pytest

from cuelattice.llm import bpe, licences, media, pii, secretscan, warc

DOCS = "doc_id long, text string"


def timed(call, texts, most):
    for text in texts:
        began = time.time()
        call(text)
        assert time.time() - began < most, text[:20]


# --- secrets -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def known():
    return secretscan.models()


def spans(text, known):
    return secretscan.added_spans(text, secretscan.base_spans(text), known)


def test_a_long_credential_is_one_span(known):
    chance = random.Random(1)
    letters = secretscan._LETTERS + "_-"
    token = "eyJ" + "".join(chance.choices(letters, k=60)) + ".eyJ" + "".join(chance.choices(letters, k=10_000)) + "." + "".join(chance.choices(letters, k=42)) + "x"
    for before, after in (("", ""), ("Bearer ", "."), ("jwt=", "&a=1")):
        assert [s[:2] for s in spans(before + token + after, known) if s[1] - s[0] > 100] == [(len(before), len(before) + len(token))]


def test_ordinary_random_strings_are_no_secrets(known):
    chance = random.Random(2)
    data = lambda n: bytes(chance.randrange(256) for _ in range(n))
    kinds = {
        "uuid": lambda: str(uuid.UUID(bytes=data(16))), "UUID": lambda: str(uuid.UUID(bytes=data(16))).upper(), "id": lambda: "".join(chance.choices(secretscan._LETTERS, k=22)),
        "list": lambda: "PL" + "".join(chance.choices(secretscan._LETTERS + "_-", k=32)), "sri": lambda: "sha384-" + base64.b64encode(data(48)).decode(), "sha256": lambda: base64.b64encode(data(32)).decode(),
        "sha224": lambda: base64.b64encode(data(28)).decode(), "url": lambda: base64.urlsafe_b64encode(data(64)).decode(), "hex": lambda: data(20).hex(),
    }
    for name, make in kinds.items():
        assert sum(bool(spans(make(), known)) for _ in range(200)) <= 2, name


def test_credentials_glued_to_a_word_are_found(known):
    chance = random.Random(3)
    for name in ("base64_40", "github", "stripe"):
        hits = sum(any(s[0] <= 10 and s[1] - s[0] >= secretscan.LENGTHS[name] for s in spans(f"see secre{secretscan.example(secretscan.FORMATS[name], chance)} ok", known)) for _ in range(50))
        assert hits >= 45, (name, hits)


def test_secret_scan_takes_linear_time(known):
    blob = base64.b64encode(random.Random(4).randbytes(750_000)).decode()
    timed(lambda t: spans(t, known), ("ghp_" * 250_000, "ab/" * 333_333, "abcd/" * 200_000, "eyJ" * 333_333, "x.eyJ" * 200_000, "sk_live_" * 125_000, "a" * 1_000_000, blob), 20)


def plain_evidence(token, a, b, name, known):
    """Evidence of token[a:b] by walking both automata, symbol by symbol."""
    (moves, usual, ends), (plain, _, plain_ends) = known[0][name].steps(), known[1].steps()
    at = other = total = 0
    for i in range(a, b):
        p, at = moves[at].get(token[i]) or (secretscan.FLOOR, usual[at])
        q, other = secretscan.ordinary_step(plain[other].get(token[i]), other, token[max(0, i - 2) : i], token[i])
        total += p - q
    return total + ends[at] - plain_ends[other]


def test_candidates_walked_together_score_as_one_by_one(known):
    chance = random.Random(5)
    bits = ["eyJ", ".eyJ", "ghp_", "-", "_", ".", "/", "ab", "word", "A1b2C3d4", "".join(chance.choices(secretscan._LETTERS, k=36)), "".join(chance.choices(secretscan._LETTERS, k=40))]
    sign = lambda t, i: i == 0 or t[i - 1] in secretscan.SIGNS
    for _ in range(150):
        token = "".join(chance.choice(bits) for _ in range(chance.randint(1, 12)))
        end = len(token.rstrip(".-_/=+"))
        stops = [i for i in range(1, end + 1) if i == end or (token[i] in secretscan.SIGNS and token[i - 1] not in secretscan.SIGNS)]
        starts = [i for i in range(end) if token.startswith("eyJ", i) and sign(token, i)]
        want = {}
        for b in stops:
            scores = [(plain_evidence(token, a, b, "jwt", known), -a) for a in starts if a < b]
            if scores and max(scores)[0] >= secretscan.EVIDENCE and b + max(scores)[1] >= secretscan.LEAST_RUN:
                want[b] = (-max(scores)[1], round(max(scores)[0], 6))
        assert {b: (a, round(s, 6)) for s, a, b in secretscan.looping_spans(token, end, "jwt", known)} == want
        for name in ("github", "base64_40"):
            starts = list(range(max(0, len(token) - secretscan.LENGTHS[name] + 1)))
            got = secretscan.fixed_evidences(token, starts, name, known)
            assert np.allclose(got, [plain_evidence(token, a, a + secretscan.LENGTHS[name], name, known) for a in starts])


# --- personal data -------------------------------------------------------------------------------------------------------

_DOT = r"\x20(?i:dot|punkt)\x20"
_ARTICLE = r"(?!(?i:the|a|an|this|that|these|those|my|our|your|his|her|its|their|all|any|each|every|some|no)\x20)"
#: The rule as one pattern, tried from each word.
SPOKEN = re.compile(rf"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{{2,}}+|[A-Za-z0-9_](?={_DOT}))((?:{_DOT}[A-Za-z0-9._%+-]++)*+)(\x20[aA][tT]\x20|@){_ARTICLE}([A-Za-z0-9-]+)((?:{_DOT}[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])")


def test_spoken_addresses_against_one_pattern():
    chance = random.Random(6)
    bits = ["dot", "Dot", "punkt", "at", "AT", "jane", "a", "_", "-", "site", "com", "the", "b.c", ".", "@", "%", "é", "(", "\n"]
    for _ in range(30_000):
        text = "".join(chance.choice(bits) + chance.choice(("", " ", " ")) for _ in range(chance.randint(1, 14)))
        want = [(m.span(1), (m.start(1), m.start(3)), m.span(3), m.span(5)) for m in SPOKEN.finditer(text)]
        assert list(pii.SPOKEN[0].found(text)) == want, text


def test_spelling_is_a_necessary_condition():
    chance = random.Random(7)
    bits = ["one", "two", "zéro", "un", "fünf", "twenty", "eleven", "dot", "point", "+", "-", "(", ".", "x", "1", "55", "4a", "a4", "İ", "\n"]
    for _ in range(30_000):
        text = "".join(chance.choice(bits) + chance.choice(("", " ", ", ")) for _ in range(chance.randint(1, 10)))
        new = pii.Rewritten(text)
        new.spelled()
        assert pii.spelling(text) or new.text == text, text


def test_personal_data_in_linear_time():
    timed(pii.find, ("dot " * 250_000, "aa dot " * 143_000, "one dot " * 125_000, "aa at " * 166_000, "aa@" * 333_000, "a dot b at c dot " * 60_000, "one " * 250_000, "un " * 333_000), 20)


# --- the others ----------------------------------------------------------------------------------------------------------


def test_bpe_orders_marks_as_the_library_does():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    same = lambda t: own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    marks = [c for c in map(chr, range(0x20000)) if unicodedata.category(c)[0] == "M"]
    bad = []
    for c in marks:
        pairs = [x for other in bpe.one_mark_a_class() for x in (f"a{c}{other}", f"a{other}{c}")]
        if not same(" ".join(pairs)):
            bad += [x for x in pairs if not same(x)]
    assert not bad, [ascii(x) for x in bad[:10]]
    chance = random.Random(8)
    blocks = [range(0x20, 0x250), range(0x300, 0x370), range(0x370, 0x600), range(0x600, 0x900), range(0x900, 0xE00), range(0xE00, 0x1100), range(0x1AB0, 0x1B00), range(0x1DC0, 0x2100), range(0x3040, 0x3100), range(0xFE20, 0xFE30), range(0x1E130, 0x1E300), range(0x11F00, 0x11F60)]
    texts = ["".join(chr(chance.choice(chance.choice(blocks))) for _ in range(chance.randint(1, 12))) for _ in range(20_000)]
    assert not [ascii(t) for t in texts if not same(t)][:5]


def test_wide_ids_keep_their_file_and_offset(spark, same, tmp_path):
    ids = [2**60 + k for k in (-1, 0, 1, 255, 256)] + [2**53 - 1, 2**53 + 1, 2**62 + 12345, 7, 300]
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>", 1) for i in ids]
    spark.createDataFrame(rows, "page_id long, url string, html string, id long").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(warc.op9_fixity(spark, str(tmp_path)), duck, warc.oracle())
    low = [(r, i, "s", 9) for r in (0, 1) for i in (-(2**63), -1, 2**63 - 1)]
    assert warc.audit(spark.createDataFrame([*low[:5], (1, 2**63 - 1, "t", 9)], "replica int, id long, sha string, length long"))[1].count() == 1


@pytest.mark.parametrize(("version", "given", "shown"), [(1, (1 << 64) - 1, 60), (0, (1 << 32) - 1, 60), (1, (1 << 63) + 5, None), (1, 77, 77), (0, 0, 60)])
def test_unknown_durations(spark, version, given, shown):
    file = media.mux_gray(bytes(576) * 60)
    old = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, media.TIMESCALE, 60, 0x55C4, 0))
    times = struct.pack(">QQIQHH" if version else ">IIIIHH", 0, 0, media.TIMESCALE, given, 0x55C4, 0)
    new = media.full(b"mdhd", times, version=version)
    grown = len(new) - len(old)
    for kind in (b"moov", b"trak", b"mdia"):
        at = file.index(kind) - 4
        file = file[:at] + struct.pack(">I", struct.unpack_from(">I", file, at)[0] + grown) + file[at + 4 :]
    file = file.replace(old, new)
    row = media.media_columns(spark.createDataFrame([(1, bytearray(file))], "doc_id long, media binary")).first()
    if shown is None:
        assert row["error"] and row["duration"] is None
    else:
        assert (row["error"], row["duration"], row["n_samples"]) == (None, shown, 60)


BSD2 = licences._BSD
BSD3 = licences._BSD + "Neither the name of {} nor the names of its contributors may be used to endorse or promote\nproducts derived from this software without specific prior written permission.\n"
X11 = """Permission to use, copy, modify, distribute, and sell this software and its
documentation for any purpose is hereby granted without fee, provided that
the above copyright notice appear in all copies and that both that
copyright notice and this permission notice appear in supporting
documentation."""


def test_licences_side_by_side_and_unusual_ones(spark, same):
    long = "the very long name of an institute of a university of a town in a country far away from here and all its friends and partners"
    texts = {
        "bsd-3-clause": BSD3.format(long), "bsd-2-clause": BSD2, "bsd-2-clause,bsd-3-clause": BSD2 + "\n\nAnother part:\n\n" + BSD3.format("the copyright holder"), "hpnd-sell-variant": X11, "all-rights-reserved": "Copyright 2020 A. All rights reserved.",
        "apache-2.0": "                     Apache License\n               Version 2.0, January 2004\n            https://www.apache.org/licenses/\n", "": "x. " * 10,
        "apache-2.0,mit": "Licensed under the Apache License, Version 2.0. Released under the MIT License.",
        "bzip2-1.0.6": "2. The origin of this software must not be misrepresented; you must \n   not claim that you wrote the original software.  If you use this \n   software in a product, an acknowledgment in the product \n   documentation would be appreciated but is not required.",
    }
    rows = spark.createDataFrame(list(enumerate([*texts.values(), None])), DOCS)
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(rows).collect()}
    assert {n: got[k] for k, n in enumerate(texts)} == {n: n for n in texts}
    duck = duckdb.connect()
    duck.register("frame", rows.toPandas())
    same(licences.licence_scan(rows), duck, licences.oracle("frame"))


def test_licence_scan_takes_linear_time(spark):
    texts = ["license " + t for t in ("." * 1_000_000, ". " * 500_000, "\n" * 1_000_000, "neither the name of " * 50_000, "." * 500_000 + " x", "\n- " * 300_000)]
    began = time.time()
    assert licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).count() == 6
    timed(licences.sentences_of, texts, 10)
    licences.licence_scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 90
