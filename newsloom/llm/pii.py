"""Personal data with offset-preserving deobfuscation.

Method.  Base rules find identifiers in the text as written.  Then transducers rewrite a text that shows signs of
disguise -- look-alike letters and digits, invisible characters, spelled-out digits, at/dot words and brackets -- into
normalised text and keep, for every normalised character, the source span it came from.  The same rules run on the
normalised text, and each match is mapped back to source code points.  Base spans always stay; a mapped span inside
a base span of its kind adds nothing and is dropped.

Kinds and checks: email; ip (four parts of at most 255); card (13 to 19 digits, Luhn); phone (9 to 15 digits).
Matches are leftmost and non-overlapping per kind; a match that fails its check is dropped without a retry.

Scale.  One pass, no shuffle; every rule is linear in the text, whatever it holds (the email rule works outward from
each at sign, the ip rule starts only at the first digit of a run).

Edge cases.  Null text counts as empty: no spans.  Repeated rows are each returned, null ids and extra columns kept or
ignored alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_type, sha256_hex

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[str, int, int]


def find_emails(text: str) -> list[Span]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def find_ips(text: str) -> list[Span]:
    out = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, *run.span()):
                if all(_at_most_255(g) for g in m.groups()):
                    out.append(("ip", *m.span()))
    return out


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find_cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out


def find_phones(text: str) -> list[Span]:
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    """All base matches, by kind in the order of KINDS, then by start."""
    return find_emails(text) + find_ips(text) + find_cards(text) + find_phones(text)


# ---- transducers: look-alikes, invisible characters, spelled digits, at/dot disguises ----

# fixed values: Cyrillic and Greek letters drawn like Latin ones, and punctuation drawn like ASCII
LOOK_ALIKES = dict(zip(
    "АВЕЗКМНОРСТУХабеорсухѕіјԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονι∙•․。．‐‑‒–—−﹣＋﹢（）［］｛｝＠﹫",
    "ABE3KMHOPCTYXa6eopcyxsijdhqwABEZHIKMNOPTYXaovi.....-------++()[]{}@@", strict=True))
LOOK_ALIKES |= {chr(c): " " for c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)}     # spaces
for _i in range(26):                                            # fullwidth letters
    LOOK_ALIKES[chr(0xFF21 + _i)], LOOK_ALIKES[chr(0xFF41 + _i)] = chr(65 + _i), chr(97 + _i)
for _base in (0xFF10, 0x0660, 0x06F0, 0x0966, 0x2080, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    for _i in range(10):                                        # digits of other scripts and styles
        LOOK_ALIKES[chr(_base + _i)] = chr(48 + _i)
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
# fixed values: digit words by language
DIGIT_WORDS = {w: str(d) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve") for d, w in enumerate(words.split())} | {"oh": "0"}
# fixed values: words for the at sign and the dot; the plain words count only inside name AT name DOT name
AT_WORDS, DOT_WORDS = "at|arroba|arobase|klammeraffe", "dot|punto|point|punkt"
# fixed values: last labels that the plain words may end in
TOP_LABELS = frozenset("com org net edu gov info biz io co uk us de fr es it nl at ch eu ru cn jp br in mx ca au example".split())

_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES) + INVISIBLE) + "]")
_ONE = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
# an element of a run of digits: possessive, and never begun inside a run of digits and signs, so a text is read once
_ELEMENT = rf"(?:(?<!\w)(?:{_ONE}|plus)|(?<![\w+])[0-9+]++)(?!\w)"
_DIGIT_RUN = re.compile(rf"{_ELEMENT}(?:[\s,.()/-]{{1,3}}+{_ELEMENT}){{3,}}+", re.I)
_DIGIT_ELEMENT = re.compile(rf"(?:{_ONE}|plus|[0-9+]+)", re.I)
_DIGIT_PART = re.compile(rf"(?:{_ONE}|plus)", re.I)
_SIGN = re.compile(                                                # spaces before a bracket: see _signs
    rf"[\[({{<]\s*+(?:(?P<bat>{AT_WORDS}|@)|(?P<bdot>{DOT_WORDS}|\.))\s*+[\])}}>]\s*+"
    rf"|(?P<hat>&#0*+64;|&#x0*+40;|%40)|(?P<hdot>&#0*+46;|&#x0*+2e;|%2e)", re.I)
_PLAIN = re.compile(
    rf"(?<![\w.%+-])[\w.%+-]+(?:\s+|[_/-])(?P<at>{AT_WORDS})(?:\s+|[_/-])(?P<host>[\w-]+(?:(?:\s+|[_/-])(?:{DOT_WORDS})(?:\s+|[_/-])\w+)+)", re.I)
_PLAIN_DOT = re.compile(rf"(?:\s+|[_/-])(?:{DOT_WORDS})(?:\s+|[_/-])", re.I)
_HALF = re.compile(rf"@[\w-]+(?:(?:\s+|\.)(?:{DOT_WORDS})(?:\s+|\.)\w+)+", re.I)
_SPACED_SIGN = re.compile(r"(?<=[A-Za-z0-9]) ?@ ?(?=[A-Za-z0-9-]+ ?\. ?[A-Za-z])|(?<=[A-Za-z0-9]) \. (?=(?:com|org|net|de|fr|es|edu|io)\b)")
_WORDS = re.compile(r"[^\W\d_]+")
_DOTS = frozenset(DOT_WORDS.split("|"))
_UNFOLDED = "\u0130\u0131\u017f\u212a"                             # letters that re.I takes for ASCII ones
_FOLDED = str.maketrans(_UNFOLDED, "iisk")


def _folded(text: str) -> str:
    if not text.isascii() and any(c in text for c in _UNFOLDED):
        text = text.translate(_FOLDED)
    return text.lower()


def disguised(text: str) -> bool:
    """Whether at/dot disguises or spelled digits can be present (cheap; never misses a span that the transducers add)."""
    if "&#" in text or "%40" in text or "%2" in text or "@" in text and (" @" in text or "@ " in text or " . " in text):
        return True
    if any(c in text for c in "[({<") and _SIGN.search(text):
        return True
    words = set(_WORDS.findall(_folded(text)))
    return not words.isdisjoint(_DOTS) or not words.isdisjoint(DIGIT_WORDS) and any(True for _ in _digit_runs(text))


def _digit_runs(text: str):
    """(from, to) of runs of at least four elements; the last is a digit word or begins with digits, which end the run."""
    for run in _DIGIT_RUN.finditer(text):
        parts = list(_DIGIT_ELEMENT.finditer(text, *run.span()))
        while len(parts) >= 4:
            end = parts[-1].end()
            word = parts.pop().group()
            if word[0] in "+pP":                                       # a sign or "plus" ends no run
                continue
            yield run.start(), end - len(word) + len(word.split("+")[0])
            break


def _signs(text: str):
    """(from, to, sign) of bracketed and encoded signs; the spaces before a bracket belong to it."""
    last = 0
    for x in _SIGN.finditer(text):
        a, b = x.span()
        if x["bat"] or x["bdot"]:
            while a > last and text[a - 1].isspace():
                a -= 1
        yield a, b, "@" if x["bat"] or x["hat"] else "."
        last = b


class Mapped:
    """Normalised text with the source span of every character."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = start if start is not None else list(range(len(text)))
        self.end = end if end is not None else list(range(1, len(text) + 1))

    def replaced(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Apply (from, to, new) edits in order; each new character maps to the whole span it replaces."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            if a < at:
                continue
            text.append(self.text[at:a] + new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Mapped("".join(text), start + self.start[at:], end + self.end[at:])


def look_alikes(m: Mapped) -> Mapped:
    """Homoglyphs to ASCII and invisible characters away, but only inside runs that hold ASCII or a digit or sign."""
    return m.replaced([(x.start(), x.end(), LOOK_ALIKES.get(x.group(), "")) for x in _ODD.finditer(m.text)])


def signs(m: Mapped) -> Mapped:
    edits = list(_signs(m.text))
    m = m.replaced(edits) if edits else m
    edits = []
    for x in _PLAIN.finditer(m.text):
        if re.split(r"[\s_/-]", x["host"])[-1].lower() not in TOP_LABELS:
            continue
        a, b = x.span("at")
        edits.append((a - _blank(m.text, a, -1), b + _blank(m.text, b, 1), "@"))
        edits += [(y.start(), y.end(), ".") for y in _PLAIN_DOT.finditer(m.text, *x.span("host"))]
    for x in _HALF.finditer(m.text):
        edits += [(y.start(), y.end(), ".") for y in _PLAIN_DOT.finditer(m.text, *x.span())]
    m = m.replaced(sorted(edits)) if edits else m
    edits = [(x.start(), x.end(), x.group().strip()) for x in _SPACED_SIGN.finditer(m.text)]
    return m.replaced(edits) if edits else m


def _blank(text: str, at: int, step: int) -> int:
    """How many separator characters lie beside ``at``."""
    n, i = 0, at - 1 if step < 0 else at
    while 0 <= i < len(text) and (text[i].isspace() or text[i] in "_/-"):
        n, i = n + 1, i + step
    return n


def spelled_digits(m: Mapped) -> Mapped:
    """Runs of at least three digit words (digits may stand between them) become digits; separators between go."""
    edits = []
    for run in _digit_runs(m.text):
        if sum(_folded(x) != "plus" for x in _DIGIT_PART.findall(m.text, *run)) < 3:
            continue
        last = None
        for x in _DIGIT_PART.finditer(m.text, *run):
            gap = m.text[last:x.start()] if last is not None else ""
            if gap and not gap.strip(" ,\n\t"):
                edits.append((last, x.start(), ""))
            word = _folded(x.group())
            edits.append((*x.span(), "+" if word == "plus" else DIGIT_WORDS[word]))
            last = x.end()
    return m.replaced(edits) if edits else m


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the normalised text shows, in source code points."""
    odd = not text.isascii() and _ODD.search(text)
    if not odd and not disguised(text):
        return []
    m = look_alikes(Mapped(text)) if odd else Mapped(text)
    m = spelled_digits(signs(m))
    if m.text == text:
        return []
    taken = {k: [(a, b) for kind, a, b in base if kind == k] for k in KINDS}
    out = []
    for kind, a, b in base_spans(m.text):
        lo, hi = m.start[a], m.end[b - 1]
        if not any(x <= lo and hi <= y for x, y in taken[kind]):
            out.append((kind, lo, hi))
            taken[kind].append((lo, hi))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): for every row the base spans and the spans deobfuscation adds, as kind:start:end lists."""
    schema = T.StructType([T.StructField("id", field_type(docs, id_col)),
                           *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
                           *(T.StructField(f"n_{k}_all", T.LongType()) for k in KINDS),
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches):
        for b in batches:
            base_n, all_n, digest, spans = [], [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                every = base + added_spans(text, base)
                base_n.append([sum(k == s[0] for s in base) for k in KINDS])
                all_n.append([sum(k == s[0] for s in every) for k in KINDS])
                digest.append(sha256_hex(joined(base)))
                spans.append(joined(every))
            count = [pa.array([r[i] for r in rows], pa.int64()) for rows in (base_n, all_n) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *count, pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                                             [f.name for f in schema])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def mask_text(text: str) -> str:
    """``text`` with every span, base or added, replaced by its kind in brackets."""
    base = base_spans(text)
    found = sorted((a, b, k) for k, a, b in base + added_spans(text, base))
    if not found:
        return text
    out, at = [], 0
    for i, (a, b, k) in enumerate(found):
        if a >= at:
            out.append(f"{text[at:a]}<{k.upper()}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, personal data in the text replaced by its kind; null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [None if t.as_py() is None else mask_text(t.as_py()) for t in b.column(at)]
            columns = [*b.columns]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
