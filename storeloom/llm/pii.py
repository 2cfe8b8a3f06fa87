"""Personal data in texts, with offset-preserving deobfuscation (operator 1).

Base spans are found in the source text by linear scans. For disguised ones,
transducers rewrite the text step by step (look-alike and invisible characters,
bracketed or spelled at/dot, spelled digits); each keeps, for every character it
writes, the source characters that it stands for. Identifiers found in the last
writing map back to source spans. Base spans all stay; a span is added unless it
lies wholly inside the base spans that it overlaps, which a disguise may leave behind
as shorter matches, or overlaps one added before.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# Digits run on greedily, so no match can begin within a run of digits: the look-behind changes
# nothing but the cost of long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ outward, so that no run of letters is scanned twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        # the local part is the whole run before the @, but not what a match has taken
        while start > done and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))
_ANY_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    digits = bool(_ANY_DIGIT.search(text))
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digits else [],
        "card": cards(text) if digits else [],
        "phone": phones(text) if digits and "+" in text else [],
    }


# --- transducers ------------------------------------------------------------------------------

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ԝ": "w", "ѵ": "v", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "ε": "e", "τ": "t", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l", "∙": ".", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹫": "@", "＋": "+", " ": " ", " ": " ", " ": " ",
}
# Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿᠎"
# Digits and signs in words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arobase", "ät", "arroba")
DOT_WORDS = ("dot", "point", "punkt", "punto")


class Traced:
    """A writing of a text; character i stands for source characters start[i] to end[i]."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replaces spans (ascending, apart); a replacement's characters share its source between them."""
        if not edits:
            return self
        parts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[done:a], new]
            starts.append(self.start[done:a])
            ends.append(self.end[done:a])
            if new:
                source = (int(self.start[a]), int(self.end[b - 1]))
                starts.append(np.full(len(new), source[0]))
                ends.append(np.full(len(new), source[1]))
            done = b
        parts.append(self.text[done:])
        starts.append(self.start[done:])
        ends.append(self.end[done:])
        return Traced("".join(parts), np.concatenate(starts), np.concatenate(ends))

    def source(self, a: int, b: int) -> tuple[int, int]:
        return int(self.start[a]), int(self.end[b - 1])


@lru_cache(maxsize=1 << 16)
def _plain_form(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    digit = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
    if digit is not None:
        return str(digit)
    compat = unicodedata.normalize("NFKC", c)
    return compat if len(compat) == 1 and compat.isascii() and ("＀" <= c <= "￯" or "\U0001d400" <= c <= "\U0001d7ff") else c


#: Look-alikes are undone beside Latin letters, digits or signs only, and words of another script stay.
_FOREIGN = re.compile(r"[^\x00-ɏ‘-‟•…€]|[­ ı]")


def unmask(t: Traced) -> Traced:
    """Look-alike, full-width, mathematical and invisible characters."""
    edits = [(m.start(), m.end(), new) for m in _FOREIGN.finditer(t.text) if (new := _plain_form(m[0])) != m[0]]
    return t.rewrite(edits)


_OPEN, _CLOSE = r"[\[({<]\s?", r"\s?[\])}>]"
_BRACKET_AT = re.compile(rf"\s?{_OPEN}(?:{'|'.join(AT_WORDS)}|@){_CLOSE}\s?", re.I)
_BRACKET_DOT = re.compile(rf"\s?{_OPEN}(?:{'|'.join(DOT_WORDS)}|\.){_CLOSE}\s?", re.I)
# Space is taken whole and from its begin, so that a long run of it is scanned once.
_AT_RE = re.compile(rf"(?<!\s)\s++(?:{'|'.join(AT_WORDS)})(?=\s)\s++|\s?@\s?", re.I)
_DOT = rf"(?:(?<!\s)\s++(?:{'|'.join(DOT_WORDS)})\s++|\s\.\s)"
_DOT_RE = re.compile(_DOT, re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*", re.I)
#: A local part read backward from its sign.
_BACKWARD = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:\.|\s++(?:{'|'.join(w[::-1] for w in DOT_WORDS)})\s++|\s\.\s)[A-Za-z0-9_%+-]++)*+(?![.])", re.I)
_HAS_DOT = re.compile(rf"\b(?:{'|'.join(DOT_WORDS)})\b", re.I)
#: A spelled at before a plain domain: the local part has a sign within, or a word for mail stands before it.
_SIGNED = re.compile(r"[A-Za-z][A-Za-z0-9]*[._+][A-Za-z0-9]+")
_MAIL_WORD = re.compile(r"(?:mail|e-mail|contact|write|reach)(?: (?:to|me|us))?[:\s]\s?\Z", re.I)
_ENDS = "(?:com|org|net|edu|gov|info|io|dev|example|test|de|fr|es|uk|eu)"
_PLAIN_DOMAIN = re.compile(rf"(?:[A-Za-z0-9-]+\.)+{_ENDS}\Z", re.I)
_AT_PLAIN = re.compile(rf"(?:{'|'.join(AT_WORDS)})\s++(?:[A-Za-z0-9-]+\.)+{_ENDS}\b", re.I)


def _bracketed(t: Traced) -> Traced:
    for rule, new in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        t = t.rewrite([(m.start(), m.end(), new) for m in rule.finditer(t.text)])
    return t


def _spelled_email(t: Traced) -> Traced:
    """at and dot as words: a domain forward and a local part backward from each sign, neither beyond the next sign."""
    text, edits = t.text, []
    signs = [m.span() for m in _AT_RE.finditer(text)]
    if not signs:
        return t
    backward = text[::-1]
    done = 0
    for k, (a, b) in enumerate(signs):
        stop = signs[k + 1][0] if k + 1 < len(signs) else len(text)
        domain = _LABELS.match(text, b, stop)
        local = _BACKWARD.match(backward, len(text) - a, len(text) - done) if domain else None
        if not local:
            done = b
            continue
        start = len(text) - local.end()
        dots = [d.span() for d in _DOT_RE.finditer(text, start, a)]
        after = [d.span() for d in _DOT_RE.finditer(text, domain.start(), domain.end())]
        spelled = text[a:b].strip() != "@"
        plain = not after and spelled and _PLAIN_DOMAIN.match(domain[0])
        if after or (plain and (_SIGNED.fullmatch(text, start, a) or _MAIL_WORD.search(text, max(0, start - 24), start))):
            edits += [*((x, y, ".") for x, y in dots), (a, b, "@"), *((x, y, ".") for x, y in after)]
            done = domain.end()
        else:
            done = b
    return t.rewrite(edits)


#: The sign as markup or URLs escape it.
_ESCAPED_AT, _ESCAPED_DOT = re.compile("&#0*64;|&#x0*40;|&commat;|%40", re.I), re.compile("&#0*46;|&#x0*2e;|&period;", re.I)
#: One word throughout: name_at_site_dot_org.
_TIED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9.%+]+[_-](?:{'|'.join(AT_WORDS)})[_-][A-Za-z0-9]+(?:[_-](?:{'|'.join(DOT_WORDS)})[_-][A-Za-z0-9]+)+", re.I)
_TIED_AT, _TIED_DOT = re.compile(rf"[_-](?:{'|'.join(AT_WORDS)})[_-]", re.I), re.compile(rf"[_-](?:{'|'.join(DOT_WORDS)})[_-]", re.I)
#: Spaces about the signs themselves: name @ site . org.
_SPACED = re.compile(r"[A-Za-z0-9._%+-](?: @ ?| ?@ )[A-Za-z0-9-]+(?:(?:\.| \. )[A-Za-z]{2,})+|[A-Za-z0-9._%+-]@[A-Za-z0-9-]+(?: \. [A-Za-z]{2,})+")
_SPACE_ABOUT = re.compile(r" ?@ ?| \. ")


def _signs(t: Traced) -> Traced:
    for rule, new in ((_ESCAPED_AT, "@"), (_ESCAPED_DOT, ".")):
        t = t.rewrite([(m.start(), m.end(), new) for m in rule.finditer(t.text)])
    edits = []
    for m in _TIED.finditer(t.text):
        at = _TIED_AT.search(t.text, m.start(), m.end())
        dots = _TIED_DOT.finditer(t.text, at.end() - 1, m.end())
        edits += [(at.start(), at.end(), "@"), *((d.start(), d.end(), ".") for d in dots)]
    t = t.rewrite(edits)
    spaced = [(x.start(), x.end(), x[0].strip()) for m in _SPACED.finditer(t.text) for x in _SPACE_ABOUT.finditer(t.text, m.start(), m.end())]
    return t.rewrite(spaced)


def at_dot(t: Traced) -> Traced:
    return _spelled_email(_bracketed(_signs(t)))


_DIGIT = rf"(?:{'|'.join(sorted(DIGIT_WORDS, key=len, reverse=True))})"
_SIGNS = {"plus": "+", "dash": "-", "hyphen": "-"} | {w: "." for w in DOT_WORDS}
_SEPARATOR = r"[ ,\t-]{1,3}"
#: At least three words that are digits, signs and digits between them.
_SPELLED_DIGITS = re.compile(rf"(?<!\w)(?:plus{_SEPARATOR})?{_DIGIT}(?:{_SEPARATOR}(?:{_DIGIT}|[0-9]+|{'|'.join(_SIGNS)})){{2,}}(?!\w)", re.I)
_DIGIT_TOKEN = re.compile(rf"{_DIGIT}|[0-9]+|{'|'.join(_SIGNS)}", re.I)
_SPELLED_HINT = re.compile(rf"(?<!\w){_DIGIT}{_SEPARATOR}(?:{_DIGIT}|[0-9]|{'|'.join(_SIGNS)})", re.I)
#: O, o, l and I for 0 and 1 within numbers.
_LETTER_DIGIT = re.compile(r"(?<=[0-9])(?:[Oo](?=[0-9. -])|[lI](?=[0-9. -]))(?![A-Za-z])|(?<=[0-9][ .-])[OolI](?=[0-9])")


_NUMBER_DOT = re.compile(rf"(?<=[0-9])\s+(?:{'|'.join(DOT_WORDS)})\s+(?=[0-9])", re.I)


_LOOSE_PLUS = re.compile(r"(?<=\+)\s+(?=[0-9])")


def spelled_digits(t: Traced) -> Traced:
    t = t.rewrite([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(t.text)])
    edits = []
    for m in _SPELLED_DIGITS.finditer(t.text):
        tokens = list(_DIGIT_TOKEN.finditer(t.text, m.start(), m.end()))
        if sum(x[0].lower() in DIGIT_WORDS for x in tokens) < 3:
            continue
        for k, x in enumerate(tokens):
            word = x[0].lower()
            # the separator goes with the word before it
            end = tokens[k + 1].start() if k + 1 < len(tokens) else x.end()
            edits.append((x.start(), end, DIGIT_WORDS.get(word) or _SIGNS.get(word) or x[0]))
    t = t.rewrite(edits)
    if edits:
        t = t.rewrite([(m.start(), m.end(), "") for m in _LOOSE_PLUS.finditer(t.text)])
    return t.rewrite([(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in _LETTER_DIGIT.finditer(t.text)])


TRANSDUCERS = (unmask, at_dot, spelled_digits)
_BRACKETED_HINT = re.compile(rf"{_OPEN}(?:{'|'.join(AT_WORDS + DOT_WORDS)}|@|\.){_CLOSE}", re.I)


#: Cheaper to look for than what it begins.
_AT_BLANK = re.compile(rf"[\s](?={'|'.join(w[0] for w in AT_WORDS)})(?:{'|'.join(AT_WORDS)})\s")


def disguised(text: str) -> bool:
    """Whether any transducer may change the text."""
    low = text.lower()
    return bool(
        _FOREIGN.search(text)
        or ("@" in text and _SPACED.search(text))
        or (("&" in text or "%40" in text) and (_ESCAPED_AT.search(text) or _ESCAPED_DOT.search(text)))
        or (any(c in text for c in "[({<") and _BRACKETED_HINT.search(text))
        or (any(w in low for w in DOT_WORDS) and (_HAS_DOT.search(text) or _TIED.search(text)))
        or any(_AT_PLAIN.match(text, m.start() + 1) for m in _AT_BLANK.finditer(low))
        or (_has_digit_word(low) and _SPELLED_HINT.search(text))
        or (_ANY_DIGIT.search(text) and _LETTER_DIGIT.search(text))
    )


_RARE_DIGITS = re.compile(r"\b(?:three|four|five|six|seven|eight|nine|zero|deux|trois|quatre|cinq|sept|huit|neuf|zwei|drei|vier|fünf|sechs|sieben|acht|neun|null|tres|cuatro|cinco|seis|siete|ocho|nueve|cero|two|dos|one|uno|eins|oh)\b")


def _has_digit_word(low: str) -> bool:
    return _RARE_DIGITS.search(low) is not None


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, as ranges that neither overlap nor touch."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and base with added ones, by kind, ascending."""
    base = base_spans(text)
    if not disguised(text):
        return base, base
    t = Traced(text)
    for step in TRANSDUCERS:
        t = step(t)
    if t.text == text:
        return base, base
    both = {}
    starts, ends = _union([s for spans in base.values() for s in spans])
    for kind, spans in base_spans(t.text).items():
        added, done = [], 0
        for span in (t.source(a, b) for a, b in spans):
            # spans ascend in the writing and in the source alike
            held = bisect_right(starts, span[0]) - 1
            if not (held >= 0 and ends[held] >= span[1]) and span[0] >= done:
                added.append(span)
                done = span[1]
        both[kind] = sorted(base[kind] + added)
    return base, both


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame) -> DataFrame:
    """Every text's personal data: base counts by kind, a digest of the base spans, all spans, and how many were added.

    Null and empty texts have none; repeated rows give repeated rows; other columns are ignored. Work and
    memory grow with a text's length.
    """

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base, both = all_spans(text)
                n = [len(base[k]) for k in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(written(base).encode()).hexdigest(), written(both), sum(map(len, both.values())) - sum(n)))
            names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
            yield pa.record_batch([pa.array(c, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, c in zip(names, zip(*rows))], names=names)

    return texts(docs).mapInArrow(run, SCHEMA)


def masked(text: str) -> str:
    """The text with every span, base or added, written as <kind>; of overlapping spans the union is written once."""
    spans = sorted((a, b, kind) for kind, found in all_spans(text)[1].items() for a, b in found)
    if not spans:
        return text
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    out, done = [], 0
    for a, b, kind in merged:
        out += [text[done:a], f"<{kind}>"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """The rows with their personal data masked; every other column but n_chars as it was, null texts too."""
    schema = docs.schema

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            new = [t if t is None else masked(t) for t in batch.column("text").to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
