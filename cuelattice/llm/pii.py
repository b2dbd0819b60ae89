"""Personal data in texts, with offset-preserving deobfuscation.

Four base patterns (e-mail, IPv4, card with Luhn check, phone) run on the text itself. Where a text holds a disguise, a
chain of transducers rewrites it: look-alike letters and other scripts' digits become ASCII, runs of spelled digits become
digits, and bracketed or spelled at/dot become signs. Every rewritten character keeps the source span it came from, so a
span found in the rewritten text maps back to whole source characters. A mapped span is added to its kind unless it lies
within a span that is there already; base spans always stay, also within an added one, and masks cover the union.

Defined results: a null text counts as empty and has no span; offsets are code points with exclusive ends; repeated rows
give repeated results; an empty table gives an empty result. Nothing shuffles, and a text is never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import map_columns, ship_code, table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")  # a match begins where digits do, so a long run is read once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Fixed table: letters of other scripts that look like ASCII ones (Cyrillic, Greek, Armenian, small capitals).
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛԝвкмнтАВЕКМНОРСТХІЈЅоαοντρυικχΑΒΕΖΗΙΚΜΝΟΡΤΥΧօսոհց",
        "aeopcyxijsdhqwbkmhtABEKMHOPCTXIJSoaovtpuikxABEZHIKMNOPTYXounhg",
        strict=True,
    )
)
#: Signs that stand for '@', '.', '-' and '+'.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "－": "-", "＋": "+", "﹢": "+", "_": "_", "＿": "_"}
#: Characters without width that split a datum without being seen.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Fixed lists: digits as words of English, French, German and Spanish.
DIGIT_WORDS = {
    w: str(k % 10)
    for words in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, w in enumerate(words.split())
} | {"oh": "0"}
#: Digit words that are articles too.
ARTICLES = frozenset(("un",))
#: Fixed lists: words for '@' and '.' in the four languages.
AT_WORDS, DOT_WORDS = "at|arobase|arroba|klammeraffe", "dot|point|punkt|punto"
#: Fixed lists: numbers of two digits as words; a ten may be followed by a digit ("twenty one", "sixty-eight").
TEENS = {w: str(10 + k) for k, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: str(2 + k) for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}


def _decimal(c: str) -> str | None:
    """The ASCII digit of another script's decimal digit or of a full-width or mathematical form."""
    import unicodedata

    d = unicodedata.decimal(c, None)
    return None if d is None else str(d)


def _letter(c: str) -> str | None:
    """The ASCII letter that a compatibility form (full-width, mathematical, circled) stands for."""
    import unicodedata

    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and folded.isalpha() else None


class _Glyphs(dict):
    """Code point to rewritten character, filled as characters are met (there are at most as many as Unicode has)."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        got = c if code < 128 else "" if c in INVISIBLE else SIGNS.get(c) or LOOKALIKES.get(c) or _decimal(c) or (_letter(c) if code > 0x2000 else None) or c
        self[code] = got
        return got


GLYPHS = _Glyphs()


def strange(text: str) -> bool:
    """Whether the first transducer changes anything, asked of its own tables."""
    return not text.isascii() and any(GLYPHS[ord(c)] != c for c in set(text) if c > "\x7f")


_WORD = "|".join([*DIGIT_WORDS, *TEENS]) + "|(?:%s)(?:[\\x20-](?:%s))?" % ("|".join(TENS), "|".join("one two three four five six seven eight nine".split()))
#: A number in words, in digits, or a spelled dot; and what may stand between two of them.
TOKEN = re.compile(r"(?ai:(?<![a-z0-9])(?:(%s)|(dot|point|punkt|punto))(?![a-z0-9])|([0-9]+)(?![a-z]))" % _WORD)
GAP = re.compile(r"[\x20,.()+-]{1,4}")
#: at and dot in brackets, or bare between address parts where a dot follows the at and no article stands for the host.
BRACKETED = re.compile(r"\x20?[\[({<]\x20?(?i:(%s)|(%s))\x20?[\])}>]\x20?" % (AT_WORDS, DOT_WORDS))


_ARTICLE = r"(?!(?i:the|a|an|this|that|these|those|my|our|your|his|her|its|their|all|any|each|every|some|no)\x20)"


class Spoken:
    """Addresses with a spoken at or dot: words with spelled dots between them, an at, and a host with dots or spelled dots.

    They are looked for from their at: first the host behind it, then the words before it, backwards, so that a chain without an at costs nothing.
    """

    def __init__(self, at: str, dot: str):
        self.at, self.dots = re.compile(at), tuple(f" {w} " for w in dot.split("|"))
        spelled = rf"\x20(?i:{dot})\x20"
        self.host = re.compile(rf"{_ARTICLE}([A-Za-z0-9-]+)((?:{spelled}[A-Za-z0-9-]+|\.[A-Za-z0-9-]+)+)(?![A-Za-z0-9-])")

    def words(self, text: str, end: int, last: int) -> tuple[int, int] | None:
        """(start, end of the first word) of the longest chain of words that ends at ``end`` and begins at ``last`` or behind it."""
        best, a, inner = None, end, False
        while True:
            b = a
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a == b or (a and text[a - 1] in _LOCAL):
                return best
            if b - a > 1 or (inner and (text[a].isalnum() or text[a] == "_")):
                best = (a, b)
            sign = next((d for d in self.dots if text[max(last, a - len(d)) : a].lower() == d), None)
            if sign is None:
                return best
            a, inner = a - len(sign), True

    def found(self, text: str) -> Iterator[tuple[tuple[int, int], tuple[int, int], tuple[int, int], tuple[int, int]]]:
        """The spans (first word, whole of the words, at, dots of the host) of the addresses, none before the end of the one before."""
        last, m = 0, self.at.search(text)
        while m:
            host = self.host.match(text, m.end())
            words = self.words(text, m.start(), last) if host else None
            if words:
                yield words, (words[0], m.start()), m.span(), host.span(2)
                last = host.end()
            m = self.at.search(text, max(m.start() + 1, last))


SPOKEN = (Spoken(r"\x20[aA][tT]\x20|@", "dot|punkt"), Spoken(r"\x20(?i:arobase|arroba|klammeraffe)\x20", DOT_WORDS))
#: Fixed list: words before "at example.com" that tell where something is and are no local part.
PLACED = frozenset("""is are was were be been am us me him her them it you we they look looks looked looking see seen find found visit visited
available online site website page pages home hosted live located sold published read more here there posted posts listed shop apply
register sign join contact email mail write only also now today works worked working work bought buy order free out up back and or""".split())
DOT = re.compile(r"\x20(?i:%s)\x20" % DOT_WORDS)
HINT = re.compile(r"[\[({<]\x20?(?i:%s|%s)\x20?[\])}>]" % (AT_WORDS, DOT_WORDS))
#: Words of numbers and dots in ASCII, and those that ASCII boundaries do not hold together.
_ASCII_WORDS = frozenset(w for w in (*DIGIT_WORDS, *TEENS, *TENS, *DOT_WORDS.split("|")) if w.isascii())
_OTHER_WORDS = tuple(w for w in DIGIT_WORDS if not w.isascii())
_PARTS = re.compile(r"[a-z0-9]+")


def spelling(text: str) -> bool:
    """A cheap necessary condition for the second transducer: a number or dot in words beside another number, or behind a plus."""
    low = text.lower()
    if len(low) != len(text) or any(w in low for w in _OTHER_WORDS):
        return True
    if _ASCII_WORDS.isdisjoint(_PARTS.findall(low)):
        return False
    end, before, worded = -9, False, False  # of the part before: its end, whether it may be a number, whether it is one in words
    for m in _PARTS.finditer(low):
        part, a = m[0], m.start()
        word = part in _ASCII_WORDS
        number = word or part[0] in "0123456789" or part[-1] in "0123456789"
        if number and before and (word or worded) and a - end <= 4 and GAP.fullmatch(low, end, a) or word and "+" in low[max(0, a - 2) : a]:
            return True
        end, before, worded = m.end(), number, word
    return False


class Rewritten:
    """A text under rewriting with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def glyphs(self) -> None:
        """One character to one or none: look-alikes, digits, signs, invisible characters."""
        new = [GLYPHS[c] for c in map(ord, self.text)]
        keep = [i for i, c in enumerate(new) if c]
        self.text = "".join(new)
        self.starts, self.ends = [self.starts[i] for i in keep], [self.ends[i] for i in keep]

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Puts each (start, end, new) of ascending, disjoint spans; every new character stands for the whole span."""
        if not found:
            return
        out, starts, ends, at = [], [], [], 0
        for a, b, new in found:
            out += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        self.text = "".join([*out, self.text[at:]])
        self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]

    def spelled(self) -> None:
        """Numbers in words become digits, and spelled dots signs, beside other numbers or a plus; the patterns decide what they are."""
        text, found, run = self.text, [], []
        for m in TOKEN.finditer(text):
            if run and not GAP.fullmatch(text, run[-1].end(), m.start()):
                found += self._run(run)
                run = []
            run.append(m)
        self.replace(found + self._run(run))

    def _run(self, run: list[re.Match]) -> list[tuple[int, int, str]]:
        i, j = 0, len(run)
        while i < j and run[i][2]:
            i += 1
        while i < j and run[j - 1][2]:
            j -= 1
        # an article beside literal digits is no number: "+1 848 555 1373 Un"
        while j - i > 1 and run[j - 1][0].lower() in ARTICLES and run[j - 2][3]:
            j -= 1
        while j - i > 1 and run[i][0].lower() in ARTICLES and run[i + 1][3]:
            i += 1
        run = run[i:j]
        text = self.text
        if not run or all(m[3] for m in run) or (len(run) == 1 and "+" not in text[max(0, run[0].start() - 2) : run[0].start()]):
            return []
        gaps = [text[a.end() : b.start()] for a, b in zip(run, run[1:], strict=False)]
        dotted = gaps.count(".") == 3  # the signs of an IP address; else a dot between words only divides them
        found, at = [], run[0].start()
        for k, m in enumerate(run):
            gap, last = (gaps[k - 1], run[k - 1]) if k else ("", None)
            spelled = m[1] or m[2]
            if last and not (m[3] and last[3]):
                if m[2] or last[2] or (m[1] and last[1] and "+" not in gap and not (dotted and gap == ".")):
                    at = last.end()  # a word takes what is before it, so that the digits are gapless
                    if m[3]:
                        found[-1] = (found[-1][0], m.start(), found[-1][2])
                else:
                    at = m.start()
                    if len(gap) > 1 and "+" not in gap and not set(gap) & set("()"):
                        found.append((last.end(), m.start(), " "))
            else:
                at = m.start()
            if spelled:
                found.append((at, m.end(), "." if m[2] else self._digits(m[1])))
        return found

    @staticmethod
    def _digits(words: str) -> str:
        ten, *unit = re.split(r"[\x20-]", words.lower())
        return DIGIT_WORDS.get(ten) or TEENS.get(ten) or TENS[ten] + (DIGIT_WORDS[unit[0]] if unit else "0")

    def at_dot(self) -> None:
        if HINT.search(self.text):
            self.replace([(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(self.text)])
        for spoken in SPOKEN:
            self._addresses(spoken)

    def _addresses(self, spoken: Spoken) -> None:
        text, found = self.text, []
        for word, words, at, dots in spoken.found(text):
            signs = [(d.start(), d.end(), ".") for a, b in ((word[1], words[1]), dots) for d in DOT.finditer(text, a, b)]
            name = text[word[0] : word[1]]
            if not DOT.search(text, words[0], dots[1]) and (text[at[0]] == "@" or name.lower() in PLACED or not re.fullmatch(r"(?:\.[a-z0-9-]+)*\.[a-z]{2,}", text[dots[0] : dots[1]])):
                continue
            found += signs if text[at[0]] == "@" else sorted([*signs, (*at, "@")])
        self.replace(found)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base patterns by kind, leftmost first."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "." in text:
        found["ip"] = [m.span() for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail spans, found from their '@' so that words without one cost nothing."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = EMAIL.match(text, a) if a < at else None
        if m:
            found.append(m.span())
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """The spans that only show after rewriting, by kind; none lies within a base span of its kind, though it may contain one."""
    new = Rewritten(text)
    if strange(text):
        new.glyphs()
    if spelling(new.text):
        new.spelled()
    new.at_dot()
    if new.text == text:
        return {}
    added: dict[str, list[tuple[int, int]]] = {}
    for kind, spans in base_spans(new.text).items():
        known, k, reach = base[kind], 0, -1  # both in order of their starts: reach is the furthest end of what began by now
        for a, b in spans:
            span = (new.starts[a], new.ends[b - 1])
            while k < len(known) and known[k][0] <= span[0]:
                reach = max(reach, known[k][1])
                k += 1
            if text[span[0] : span[1]] != new.text[a:b] and span[1] > reach:
                added.setdefault(kind, []).append(span)
                reach = span[1]
    return added


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """(base spans, all spans) by kind, each in order of their start."""
    base = base_spans(text)
    added = added_spans(text, base)
    return base, {k: sorted(base[k] + added.get(k, [])) for k in KINDS} if added else base


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def mask(text: str) -> str:
    """The text with each span of personal data replaced by its kind in angle brackets; overlaps go as one."""
    spans = sorted((a, b, k) for k, found in find(text)[1].items() for a, b in found)
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts are those of the base patterns."""

    def run(ids, texts):
        found = [find(t) for t in texts]
        out = {"id": ids} | {f"n_{k}": [len(b[k]) for b, _ in found] for k in KINDS}
        out["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
        out["spans"] = [listed(s) for _, s in found]
        return out | {"n_added": [sum(map(len, s.values())) - sum(map(len, b.values())) for b, s in found]}

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_columns(df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, schema).withColumnRenamed("id", id_col)


def mask_pii(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with masked texts (null stays null), and with their lengths in ``length_col`` if it is there."""
    ship_code(df.sparkSession)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(mask, na_action="ignore")

    out = df.withColumn(text_col, masked(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))
