"""Secret scan: base patterns, and candidates scored by probabilistic automata inferred from labelled credentials.

For each credential format the labelled strings make a prefix tree with counts; states whose end and continuation
frequencies are statistically compatible (Hoeffding bounds, checked down the tree) are merged until none are left to merge.
Formats of a fixed length merge states of one depth only, so that their automata know the length; the others may form loops.
Another automaton is inferred from ordinary strings. A candidate is a part of a run of at least ``LEAST_RUN`` symbols: from a format's prefix
on, or, for a format without one, the symbols before a sign or the run's end. Its evidence is the format's log likelihood less the ordinary one;
from ``EVIDENCE`` nats on it is a secret of its own kind. A symbol that an automaton has not seen at a place costs its floor.

A candidate of fixed length is walked once. Candidates of a looping format are walked together: of those that are in the same states at
the same place only the best goes on, as the others can never pass it. So the time is linear in the text, whatever its runs hold,
and no run or candidate has a limit. A candidate without a prefix that is a piece of a longer random string, such as a digest, is none: what is
beside it, ``BESIDE`` symbols on either side up to a sign, must be ordinary.

The labelled strings are made by rule from publicly documented formats with a fixed seed, so that the model does not depend
on the corpus. Base spans always stay; a scored span is added only where it meets none of them. Lower-case hexadecimal strings are left to the base
pattern.

Defined results: a null text counts as empty and has no span; offsets are code points with exclusive ends; repeated rows
give repeated results; an empty table gives an empty result. Nothing shuffles, and a text is never cut.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import islice, takewhile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, table, text_or_empty

KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Fixed patterns of the base kinds; ASCII case only.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Symbols of a candidate run at least; no documented format is shorter than twice that.
LEAST_RUN = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_RUN)
LEAST_ASSIGNED = 12

#: Significance of the Hoeffding bound, labelled strings of each format, as many times ordinary ones, log-likelihood ratio of a secret, smoothing.
ALPHA, EXAMPLES, ORDINARY, EVIDENCE, SMOOTH, SEED = 0.05, 400, 10, 14.0, 0.02, 42
SYMBOLS = string.ascii_letters + string.digits + "+/_.=-"
#: Log probability of a symbol that was not seen in a state.
FLOOR = math.log(SMOOTH / len(SYMBOLS))
#: Least log probability, in an ordinary string, of a symbol that goes on in the kind of the two before: one of about forty.
BACK_OFF = math.log(1 / 40)

_UPPER, _LETTERS, _HEX = string.ascii_uppercase, string.ascii_letters + string.digits, "0123456789abcdef"
#: Documented credential formats as (prefix, (characters, length), ...).
FORMATS = {
    "aws_access": ("AKIA", (_UPPER + "234567", 16)),
    "github": ("ghp_", (_LETTERS, 36)),
    "gitlab": ("glpat-", (_LETTERS + "_-", 20)),
    "google": ("AIza", (_LETTERS + "_-", 35)),
    "slack": ("xoxb-", (string.digits, 11), "-", (string.digits, 11), "-", (_LETTERS, 24)),
    "stripe": ("sk_live_", (_LETTERS, 24)),
    "npm": ("npm_", (_LETTERS, 36)),
    "jwt": ("eyJ", (_LETTERS + "_-", 30), ".eyJ", (_LETTERS + "_-", 40), ".", (_LETTERS + "_-", 43)),
    "base64_40": ((_LETTERS + "+/", 40),),
    "hex": ((_HEX, 40),),
}
#: Formats whose parts may be of other lengths than the examples'.
LOOPING = frozenset(("jwt",))


class Automaton:
    """A deterministic probabilistic automaton: for each state its transitions, their counts and the count of ends.

    With ``level`` only states of one depth are merged: there are no loops, and an unseen symbol goes on to the usual next state.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA, level: bool = False):
        self.level, self.depth = level, [0]
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends: list[int] = [0]
        self.seen: list[int] = [0]
        for s in strings:
            self._insert(s)
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _insert(self, s: str) -> None:
        at = 0
        self.seen[0] += 1
        for c in s:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = len(self.next)
                self.next.append({})
                self.depth.append(self.depth[at] + 1)
                self.count.append(Counter())
                self.ends.append(0)
                self.seen.append(0)
            self.count[at][c] += 1
            at = to
            self.seen[at] += 1
        self.ends[at] += 1

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no frequency differs by more than its Hoeffding bound, down the tree of b.

        Frequencies never differ by more than 1, so there is nothing to compare from a bound of 1 on; and as counts fall down the tree of b,
        its bound alone ends the way down.
        """
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.seen[a], self.seen[b]
            bound = self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)) if n and m else 1.0
            if bound < 1:
                if abs(self.ends[a] / n - self.ends[b] / m) >= bound:
                    return False
                one, other = self.count[a], self.count[b]
                if any(abs(one[c] / n - other[c] / m) >= bound for c in one.keys() | other.keys()):
                    return False
            if m and self._bound / math.sqrt(m) < 1:
                stack += [(self.next[a][c], to) for c, to in self.next[b].items() if c in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> set[int]:
        """Adds the tree below b to state a and returns the states it met; below b no state is settled yet."""
        stack, met = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            met.add(a)
            self.ends[a] += self.ends[b]
            self.seen[a] += self.seen[b]
            self.count[a].update(self.count[b])
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to
        return met

    def _infer(self) -> None:
        settled, known = [0], {0}
        rivals: dict[int, list[int]] = {0: settled}  # the settled states that one may be merged with, by depth
        edge = [(0, c) for c in self.next[0]]
        heapq.heapify(edge)
        while edge:
            at, c = heapq.heappop(edge)
            b = self.next[at][c]
            if b in known:
                continue
            for a in rivals.setdefault(self.depth[b], []) if self.level else settled:
                if self._compatible(a, b):
                    self.next[at][c] = a
                    grown = self._fold(a, b) & known
                    break
            else:
                settled.append(b)
                if self.level:
                    rivals[self.depth[b]].append(b)
                known.add(b)
                grown = {b}
            for s in grown:
                for c, to in self.next[s].items():
                    if to not in known:
                        heapq.heappush(edge, (s, c))
        settled = sorted(known)
        order = {s: k for k, s in enumerate(settled)}
        self.next = [{c: order[to] for c, to in self.next[s].items()} for s in settled]
        self.count, self.ends, self.seen = ([x[s] for s in settled] for x in (self.count, self.ends, self.seen))

    def steps(self) -> tuple[list[dict[str, tuple[float, int]]], list[int], list[float]]:
        """Per state: (log probability, next state) of each symbol, the state behind an unseen one, and the log probability of an end."""
        if not hasattr(self, "_steps"):
            rooms = [n + SMOOTH * (len(SYMBOLS) + 1) for n in self.seen]
            moves = [{c: (math.log((self.count[s][c] + SMOOTH) / rooms[s]), to) for c, to in self.next[s].items()} for s in range(len(self.next))]
            usual = [self.next[s][max(sorted(n), key=n.get)] if self.level and (n := self.count[s]) else s for s in range(len(self.next))]
            self._steps = moves, usual, [math.log((e + SMOOTH) / r) for e, r in zip(self.ends, rooms, strict=True)]
        return self._steps

    def log_likelihood(self, s: str) -> float:
        """Log probability; a symbol without a transition costs FLOOR."""
        moves, usual, ends = self.steps()
        at, total = 0, 0.0
        for c in s:
            p, at = moves[at].get(c) or (FLOOR, usual[at])
            total += p
        return total + ends[at]


def example(parts: tuple, chance: random.Random) -> str:
    return "".join(p if isinstance(p, str) else "".join(chance.choices(p[0], k=p[1])) for p in parts)


def ordinary(n: int, chance: random.Random) -> list[str]:
    """Ordinary strings: words of syllables, compounds, names with signs, numbers, dates, paths and versions."""
    starts = "b c d f g h j k l m n p r s t v w z b c d f g h k l m n p r s t v w st th ch qu x y sch gr pr tr cl br".split()
    syllables = [a + b for a in starts for b in "a e i o u an en in on er es al ou ei ie ung ion ent ique ado y".split()]
    word = lambda: "".join(chance.choices(syllables, k=chance.randint(1, 6)))
    number = lambda: str(chance.randint(0, 10 ** chance.randint(1, 8)))
    letters = lambda: "".join(chance.choices(string.ascii_lowercase, k=chance.randint(4, 20)))  # noqa: E731  words of any language
    forms = (
        word,
        letters,
        lambda: letters().upper(),
        lambda: letters().title(),
        lambda: chance.choice("-_.").join(chance.choice((letters, number))() for _ in range(chance.randint(2, 4))),
        lambda: "".join(chance.choices(string.digits, k=chance.randint(9, 20))),
        lambda: ".".join(str(chance.randint(0, 255)) for _ in range(4)),
        lambda: word().title(),
        lambda: word().upper(),
        lambda: "-".join(word() for _ in range(chance.randint(2, 4))),
        lambda: "_".join(word() for _ in range(chance.randint(2, 4))),
        lambda: "/".join(["", *(word() for _ in range(chance.randint(2, 5)))]) + chance.choice(["", ".html", "/" + number()]),
        lambda: ".".join(word() for _ in range(chance.randint(2, 4))),
        lambda: "".join(word().title() for _ in range(chance.randint(2, 3))) + chance.choice(["", number()]),
        number,
        lambda: f"{chance.randint(1990, 2030)}-{chance.randint(1, 12):02d}-{chance.randint(1, 28):02d}",
        lambda: ".".join(str(chance.randint(0, 255)) for _ in range(chance.randint(2, 4))),
    )
    return [chance.choice(forms)() for _ in range(n)]


@lru_cache(maxsize=4)
def models(examples: int = EXAMPLES, seed: int = SEED) -> tuple[dict[str, Automaton], Automaton]:
    """(automaton by format, automaton of ordinary strings) of labelled strings made with ``seed``."""
    chance = random.Random(seed)
    return {k: Automaton([example(p, chance) for _ in range(examples)], level=k not in LOOPING) for k, p in FORMATS.items()}, Automaton(ordinary(ORDINARY * examples, chance))


def kind_of(c: str) -> int:
    """Small letter, capital, digit or sign."""
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


KINDS_OF = {c: kind_of(c) for c in SYMBOLS}


def ordinary_step(move: tuple[float, int] | None, at: int, before: str, c: str) -> tuple[float, int]:
    """A step of the ordinary automaton: after two symbols of a kind, words of any language go on in it at least cost BACK_OFF."""
    p, to = move or (FLOOR, at)
    return (p if p > BACK_OFF or len(before) < 2 or not KINDS_OF[c] == KINDS_OF[before[0]] == KINDS_OF[before[1]] else BACK_OFF), to


def ordinary_likelihood(token: str, plain: Automaton) -> float:
    (moves, _, ends), at, total = plain.steps(), 0, 0.0
    for k, c in enumerate(token):
        p, at = ordinary_step(moves[at].get(c), at, token[max(0, k - 2) : k], c)
        total += p
    return total + ends[at]


def evidence(token: str, known: tuple[dict[str, Automaton], Automaton]) -> float:
    """Log-likelihood ratio of the best credential format to ordinary strings."""
    formats, plain = known
    return max(a.log_likelihood(token) for a in formats.values()) - ordinary_likelihood(token, plain)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


SIGNS = frozenset("+/_.=-")
#: Signs that a format without a prefix holds; those that random strings of any alphabet hold.
HELD, INNER = frozenset("+/"), frozenset("+/-_")
#: Formats by prefix; those without one that are looked for; lengths of those that have one length.
PREFIXES = {k: p[0] for k, p in FORMATS.items() if isinstance(p[0], str)}
UNMARKED = ("base64_40",)
LENGTHS = {k: sum(len(p) if isinstance(p, str) else p[1] for p in parts) for k, parts in FORMATS.items() if k not in LOOPING}
#: Symbols beside a candidate without a prefix that are looked at, how many letters glued to it may be a word, and the nats by which a word is one.
BESIDE, WORD, MARGIN = 32, 4, 4.0
#: Candidates of one run from which on they are walked side by side.
MANY = 8
#: Candidates up to this length are remembered with their scores, so many of them.
SHORT, REMEMBERED = 48, 100_000


def fixed_evidence(token: str, a: int, name: str, known) -> float:
    """Evidence of the string of a format's length from ``a`` on."""
    (moves, usual, ends), (plain, _, plain_ends) = known[0][name].steps(), known[1].steps()
    at, other, total = 0, 0, 0.0
    for i in range(a, a + LENGTHS[name]):
        c = token[i]
        p, at = moves[at].get(c) or (FLOOR, usual[at])
        q, other = ordinary_step(plain[other].get(c), other, token[max(0, i - 2) : i], c)
        total += p - q
    return total + ends[at] - plain_ends[other]


@lru_cache(maxsize=32)
def _tables(automaton: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probabilities, next states) by state and symbol code, and log probabilities of ends; an unseen symbol costs FLOOR."""
    moves, usual, ends = automaton.steps()
    costs, to = np.full((len(moves), 128), FLOOR), np.repeat(np.array(usual)[:, None], 128, axis=1)
    for s, own in enumerate(moves):
        for c, (p, t) in own.items():
            costs[s, ord(c)], to[s, ord(c)] = p, t
    return costs, to, np.array(ends)


def fixed_evidences(token: str, starts: list[int], name: str, known) -> list[float]:
    """``fixed_evidence`` of many starts, walked side by side."""
    if len(starts) < MANY:
        return [fixed_evidence(token, a, name, known) for a in starts]
    codes = np.frombuffer(token.encode(), np.uint8)
    kinds = np.array([KINDS_OF[c] for c in map(chr, range(128)) if c in KINDS_OF])
    kind_by_code = np.zeros(128, np.int8)
    kind_by_code[[ord(c) for c in map(chr, range(128)) if c in KINDS_OF]] = kinds
    kind = kind_by_code[codes]
    alike = np.zeros(len(codes), bool)
    alike[2:] = (kind[2:] == kind[1:-1]) & (kind[2:] == kind[:-2])
    (costs, to, ends), (plain, plain_to, plain_ends) = _tables(known[0][name]), _tables(known[1])
    at = np.array(starts)
    state, other, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at))
    for k in range(LENGTHS[name]):
        c = codes[at + k]
        q = plain[other, c]
        total += costs[state, c] - np.where(alike[at + k], np.maximum(q, BACK_OFF), q)
        state, other = to[state, c], plain_to[other, c]
    return (total + ends[state] - plain_ends[other]).tolist()


def is_word(part: str, plain: Automaton) -> bool:
    """Whether symbols are likelier in an ordinary string than drawn evenly, by MARGIN at least."""
    moves, at, total = plain.steps()[0], 0, 0.0
    for k, c in enumerate(part):
        p, at = ordinary_step(moves[at].get(c), at, part[max(0, k - 2) : k], c)
        total += p
    return total > MARGIN - len(part) * math.log(64)


def alone(token: str, a: int, b: int, plain: Automaton) -> bool:
    """Whether token[a:b] is no piece of a longer random string, by what is beside it: nothing, a sign that such strings lack, or a word."""
    hard = SIGNS - INNER
    k = a
    while k > max(0, a - BESIDE) and token[k - 1] not in hard:
        k -= 1
    if a - k > 2 or (k < a and token[a - 1] not in SIGNS):
        glued = token[max(k, a - WORD) : a]
        if (token[a - 1] not in SIGNS and (len(glued) < WORD or not SIGNS.isdisjoint(glued))) or not is_word(token[k:a], plain):
            return False
    k = b
    while k < min(len(token), b + BESIDE) and token[k] not in hard:
        k += 1
    return k - b <= 2 or is_word(token[b:k], plain)


def looping_spans(token: str, end: int, name: str, known) -> list[tuple[float, int, int]]:
    """(evidence, start, end) of the best string of a looping format at each end, all starts walked at once."""
    prefix = PREFIXES[name]
    (moves, usual, ends), (plain, _, plain_ends) = known[0][name].steps(), known[1].steps()
    found, live = [], {}  # live: (state, ordinary state) -> (evidence, -start)
    i = token.find(prefix, 0, end)
    while 0 <= i <= end:
        if live and (i == end or (token[i] in SIGNS and token[i - 1] not in SIGNS)):
            score, start = max((total + ends[at] - plain_ends[other], start) for (at, other), (total, start) in live.items())
            if score >= EVIDENCE and i + start >= LEAST_RUN:
                found.append((score, -start, i))
        if i == end:
            break
        if token.startswith(prefix, i) and (not i or token[i - 1] in SIGNS):  # within letters it is a part of something else
            live[0, 0] = max(live.get((0, 0), (0.0, -i)), (0.0, -i))
        c, before, after = token[i], token[max(0, i - 2) : i], {}
        for (at, other), (total, start) in live.items():
            p, at = moves[at].get(c) or (FLOOR, usual[at])
            q, other = ordinary_step(plain[other].get(c), other, before, c)
            new = (total + p - q, start)
            if (at, other) not in after or after[at, other] < new:
                after[at, other] = new
        live = after
        i += 1
    return found


def scored_spans(token: str, known) -> list[tuple[bool, float, int, int]]:
    """(no prefix, -evidence, start, end) of the parts of a run that score as credentials, best first."""
    end = len(token.rstrip(".-_/=+"))  # closing signs belong to the sentence
    found, n = [], len(token)
    for name, prefix in PREFIXES.items():
        if name in LOOPING:
            found += [(False, -score, a, b) for score, a, b in looping_spans(token, end, name, known)]
            continue
        starts, size = [], LENGTHS[name]
        a = token.find(prefix)
        while a >= 0:
            b = a + size
            if b == n or (b < n and token[b] in SIGNS):
                starts.append(a)
            a = token.find(prefix, a + 1)
        found += [(False, -score, a, a + size) for a, score in zip(starts, fixed_evidences(token, starts, name, known), strict=True) if score >= EVIDENCE]
    for name in UNMARKED:
        starts, size, hard = [], LENGTHS[name], -1  # hard: the last sign that the format does not hold
        for b in range(n + 1) if n >= size else ():
            sign = b == n or token[b] in SIGNS
            if sign and b >= size and hard < b - size:
                starts.append(b - size)
            if sign and b < n and token[b] not in HELD:
                hard = b
        scores = fixed_evidences(token, starts, name, known)
        found += [(True, -score, a, a + size) for a, score in zip(starts, scores, strict=True) if score >= EVIDENCE and alone(token, a, a + size, known[1])]
    return sorted(found)


class Taken:
    """Disjoint spans in order; ``free`` tells whether another one meets none of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        reach = -1
        for a, b in spans:  # those that overlap become one
            if a < reach:
                reach = self.ends[-1] = max(reach, b)
            else:
                self.starts.append(a)
                self.ends.append(b)
                reach = b

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return not k or self.ends[k - 1] <= a

    def put(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def added_spans(text: str, base: list[tuple[int, int, str]], known, memory: dict | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, ADDED, evidence) of runs and parts of them that score as credentials and meet no base span.

    Of overlapping ones those by a format's prefix go first, then the one of most evidence stays. ``memory`` holds the scores of
    short runs.
    """
    found, k, memory = [], 0, {} if memory is None else memory
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        token = m[0]
        scored = memory.get(token)
        if scored is None:
            scored = scored_spans(token, known)
            if len(token) <= SHORT:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[token] = scored
        if not scored:
            continue
        while k < len(base) and base[k][1] <= a:  # base spans are in order of their starts
            k += 1
        taken = Taken([(s, e) for s, e, _ in takewhile(lambda x: x[0] < b, islice(base, k, None))] if k < len(base) and base[k][0] < b else [])
        for _, score, s, e in scored:
            s, e = a + s, a + e
            if taken.free(s, e):
                taken.put(s, e)
                found.append((s, e, ADDED, -score))
    return sorted(found)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_added, evidence): counts are those of the base patterns."""
    known, memory = models(), {}

    def run(ids, texts):
        base = [base_spans(t) for t in texts]
        more = [added_spans(t, b, known, memory) for t, b in zip(texts, base, strict=True)]
        shown = lambda spans: ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)
        out = {"id": ids} | {f"n_{k}": [sum(s[2] == k for s in b) for b in base] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(shown(b).encode()).hexdigest() for b in base]
        out["spans"] = [shown(sorted([*b, *m], key=lambda s: (s[0], [*KINDS, ADDED].index(s[2])))) for b, m in zip(base, more, strict=True)]
        return out | {"n_added": [len(m) for m in more], "evidence": [[s[3] for s in m] for m in more]}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, evidence array<double>"
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents")).drop("evidence")
