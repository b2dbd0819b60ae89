"""Exact BPE encoding by backtracking over longest tokens, and decoding through an offset table.

A vocabulary file of the tokenizers library gives tokens and merges. An Aho-Corasick automaton over the reversed way of
reading (one state a prefix) yields the longest token at each place; a candidate is taken if it is compatible with the
token before it, that is, if merging the two tokens' symbols by rank would give back just these two. Where nothing fits,
the encoder steps back and tries the next shorter token. Each place is given up at most once, so a word takes time linear
in its length. Compatibility of a pair is decided by undoing merges from the seam outwards and kept in a table.

Decoding keeps all token strings in one buffer with an offset table; a text is gathered from it in one step.

Defined results: a null text counts as empty and has no ids; repeated rows give repeated results; an empty table gives an
empty result; ids outside the vocabulary are a ValueError. Stretches with code points that this Python's Unicode data lacks are
normalised and split by the library, whose data is newer in part; their words are encoded as all others. Words are met again and
again, so each worker keeps up to ``KEPT_CHARS`` characters of encoded stretches of at most ``LONGEST_KEPT``, and those of the
time before; forgetting costs time only. Nothing shuffles.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, table, text_or_empty

KEPT_CHARS, LONGEST_KEPT, KEPT_PAIRS = 2_000_000, 200, 2_000_000
#: Characters that str.split and the pattern's white space may see differently.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e\u200b]")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself if visible in Latin-1, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = [""] * 256, 256
    for b in range(256):
        letters[b] = chr(b) if b in visible else chr(more)
        more += b not in visible
    return letters


class Vocabulary:
    """Tokens in rank order with their merges; ``suffix`` marks the last symbol of a word (may be empty).

    Words are given as strings of byte letters. The suffix is kept as one character ``END`` after the last letter.
    """

    END = "\x00"

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        own = lambda t: t[: -len(suffix)] + self.END if suffix and t.endswith(suffix) else t
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        self.names = [*base, *(a + b for a, b in merges)]
        self.rank = {}
        for n, t in enumerate(self.names):
            self.rank.setdefault(t, n)
        self.n_base = len(base)
        self.ids = [vocab[t] for t in self.names]
        self.strings = [own(t) for t in self.names]
        self.by_string = {s: self.rank[t] for s, t in zip(self.strings, self.names, strict=True)}
        self.left, self.right = list(range(self.n_base)), list(range(self.n_base))
        self.merge: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            pair = (self.rank[a], self.rank[b])
            self.left.append(pair[0])
            self.right.append(pair[1])
            self.merge.setdefault(pair, self.n_base + k)
        self._compatible: dict[int, bool] = {}
        self._build()

    def _build(self) -> None:
        """Aho-Corasick automaton over the tokens, and for each token its longest proper prefix that is a token."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for s, k in self.by_string.items():
            self.automaton.add_word(s, k)
        self.automaton.make_automaton()
        self.sizes = list(map(len, self.strings))
        self.shorter = [-1] * len(self.strings)
        for s, k in self.by_string.items():
            for cut in range(len(s) - 1, 0, -1):
                if (p := self.by_string.get(s[:cut])) is not None:
                    self.shorter[k] = p
                    break

    def longest(self, word: str) -> list[int]:
        """For each place of ``word`` the longest token that starts there, or -1: all matches end-to-end in one pass."""
        out = [-1] * len(word)
        sizes = self.sizes
        for end, k in self.automaton.iter(word):  # ends ascend, so a later match from a place is the longer one
            out[end + 1 - sizes[k]] = k
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the symbols of token a followed by those of token b keeps the two apart."""
        key = a << 20 | b
        got = self._compatible.get(key)
        if got is None:
            if len(self._compatible) >= KEPT_PAIRS:
                self._compatible.clear()
            got = self._compatible[key] = self._apart(a, b)
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Undoes merges next to the seam, latest first; a merge across the seam counts if nothing earlier forbids it.

        Ranks grow with merge order. ``limit`` is the rank from which on a merge across the seam would come too late: the
        piece it needs had already been taken by the merge just undone. A left piece's merge comes first on equal rank.
        """
        limit = 1 << 60
        while True:
            across = self.merge.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit = a
                if a < self.n_base:
                    return True
                a = self.right[a]
            else:
                limit = b + 1
                if b < self.n_base:
                    return True
                b = self.left[b]

    def encode(self, word: str) -> list[int]:
        """The ranks of the tokens of one word of byte letters (no suffix), as rank-ordered merging gives them."""
        if not word:
            return []
        text = word + self.END if self.suffix else word
        longest, known = self.longest(text), self._compatible
        n, at, before, out = len(text), 0, -1, []
        closed = bytearray(n + 1)  # 1: given up, no way leads on from here
        token = longest[0]
        sizes, shorter = self.sizes, self.shorter
        while True:
            while token >= 0:
                end = at + sizes[token]
                if not closed[end]:
                    if before < 0:
                        break
                    fits = known.get(before << 20 | token)
                    if fits or (fits is None and self.compatible(before, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, before, token = end, token, longest[end]
            elif not out:
                raise ValueError("a symbol of the word is not in the vocabulary")
            else:
                closed[at] = 1
                last = out.pop()
                at -= sizes[last]
                before, token = out[-1] if out else -1, shorter[last]


@lru_cache(maxsize=1)
def one_mark_a_class() -> tuple[str, ...]:
    """The first mark of each combining class."""
    first: dict[int, str] = {}
    for c in map(chr, range(0x300, 0x20000)):
        if n := unicodedata.combining(c):
            first.setdefault(n, c)
    return tuple(first.values())


class WordBpe:
    """A tokenizer of whole words: NFC, white space, lower case, word pattern, byte letters, BPE with word ends."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocabulary = Vocabulary(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.path, self.library = path, None
        self.lacking, self.settled = set(), set(map(chr, range(128)))
        self.kept, self.older, self.room = {}, {}, KEPT_CHARS
        self.words_kept: dict[str, list[int]] = {}
        self.words_room = KEPT_CHARS
        names = {i: t for t, i in [*model["vocab"].items(), *self.added.items()]}
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.known = np.array([i in names for i in range(max(names) + 1)])
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)

    @staticmethod
    def normalised(text: str) -> str:
        """NFC and lower case, character by character (so a final sigma is as any other)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def normaliser(self):
        """The library's tokenizer, loaded when it is first asked for."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def ordered_alike(self, mark: str) -> bool:
        """Whether the library, whose Unicode data are older, orders a mark among those of every class as this Python does."""
        ask = self.normaliser().normalizer.normalize_str
        return all(self.normalised(x) == ask(x) for other in one_mark_a_class() for x in (f"a{mark}{other}", f"a{other}{mark}"))

    def unsettled(self, text: str) -> bool:
        """Whether ``text`` has a code point that this Python's Unicode data lacks, or a mark that the library orders otherwise."""
        if text.isascii():
            return False
        met = set(text) - self.settled
        for c in met - self.lacking:
            kind = unicodedata.category(c)
            (self.lacking if kind == "Cn" or (kind[0] == "M" and not self.ordered_alike(c)) else self.settled).add(c)
        return not met <= self.settled

    def split(self, text: str) -> list[str]:
        """The words of a text in byte letters."""
        if self.unsettled(text):
            library = self.normaliser()
            return [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        return [w.encode().decode("latin-1").translate(self.letters) for w in self.words.findall(self.normalised(text))]

    def run(self, chunk: str) -> tuple[tuple[int, ...], str]:
        """The ids of a text without added tokens, and these in decimals."""
        ids: list[int] = []
        for word in self.split(chunk):
            got = self.words_kept.get(word)
            if got is None:
                got = list(map(self.vocabulary.ids.__getitem__, self.vocabulary.encode(word)))
                if len(word) <= LONGEST_KEPT:
                    self.words_room -= len(word)
                    if self.words_room < 0:
                        self.words_kept.clear()
                        self.words_room = KEPT_CHARS
                    self.words_kept[word] = got
            ids += got
        return tuple(ids), " ".join(map(str, ids))

    def runs(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """What ``run`` gives for each stretch of a text between white space, where no word crosses it; added tokens alone."""
        if self.special and any(s in text for s in self.added):
            out = []
            for part in self.special.split(text):
                i = self.added.get(part)
                out += self.runs(part) if i is None else [((i,), str(i))]
            return out
        if ODD_SPACE.search(text):
            return [self.run(text)]
        if self.room < 0:  # what was met since the last time stays for as long again
            self.kept, self.older, self.room = {}, self.kept, KEPT_CHARS
        kept, older, chunks, long = self.kept, self.older, text.split(), {}
        for c in set(chunks):
            if c not in kept:
                got = older.get(c) or self.run(c)
                if len(c) <= LONGEST_KEPT and self.room >= 0:
                    self.room -= len(c)
                    kept[c] = got
                else:
                    long[c] = got
        if long:
            return [x for c in chunks if (x := kept.get(c) or long[c])[0]]
        return [x for c in chunks if (x := kept[c])[0]]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; the strings of added tokens in it give their ids."""
        return joined_ids(self.runs(text))

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by a space (the file names no decoder), gathered from the buffer by offsets."""
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        if ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is not in the vocabulary")
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        return self.buffer[at[:-1]].tobytes().decode()


def joined_ids(runs: list[tuple[tuple[int, ...], str]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids for ids, _ in runs), np.int64)


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""

    def run(keys, texts):
        t = loaded(path or vocabulary_path("word_bpe_49k.json"))
        return {"id": keys, "ids": [t.encode(x) for x in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give a null text."""

    def run(keys, ids):
        t = loaded(path or vocabulary_path("word_bpe_49k.json"))
        return {"id": keys, "text": [None if x is None else t.decode(np.array(x, np.int64)) for x in ids]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_digest(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass over each text."""

    def run(keys, texts):
        t = loaded(path or vocabulary_path("word_bpe_49k.json"))
        n, ids_sha, text_sha = [], [], []
        for x in texts:
            runs = t.runs(x)
            ids = joined_ids(runs)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join([d for _, d in runs]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return {"id": keys, "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))
