"""Personal data behind disguises, with spans in the source text.

Base rules: e-mail, IPv4, payment card (Luhn) and phone patterns, leftmost and non-overlapping for each kind; a match
that fails its check is dropped and not tried again from within.

Disguises: three transducers rewrite a text and keep, for each character they write, the source span it stands for:
homoglyphs (full-width, Cyrillic and Greek look-alikes; zero-width characters vanish), runs of spelled digits in four
languages, and at/dot written in words, brackets or character references. The base rules then run over what was written and each match goes
back to the source span of its first to last character. A text that no transducer changes is searched once. A text with
spelled digits or worded dots beside other digits is read once more with all of these rewritten, however few stand
together, and with the figures and signs between them kept; the base checks decide.

Spans found only after rewriting are added; those of the base rules always stay. An added span inside a base span of the
same kind is dropped, as it is the same identifier seen again; one that is longer stays beside it.

Null text counts as empty and gives no spans. Repeated rows and equal ids are scanned row by row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from priorline.llm.common import Inside, Overlaps, id_text

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. The e-mail pattern is split at its @, see emails().
LOCAL = "A-Za-z0-9._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Look-alikes of ASCII letters, in the order of the ASCII ones beside them.
LOOKALIKE = (
    ("абвгезиклмнопрстухцѕіјһԁԛԝ", "a6vge3uklmhonpctyxusijhdqw"),
    ("АВЕЗКМНОРСТУХЅІЈ", "ABE3KMHOPCTYXSIJ"),
    ("αβεικνορτυχ", "abeiknoptux"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
)
#: Characters without width, and soft hyphen.
HIDDEN = "​‌‍⁠﻿­"

# Digits as words.
SPELLED = {
    "0": ("zero", "oh", "null", "zéro", "cero"),
    "1": ("one", "eins", "un", "uno"),
    "2": ("two", "zwei", "deux", "dos"),
    "3": ("three", "drei", "trois", "tres"),
    "4": ("four", "vier", "quatre", "cuatro"),
    "5": ("five", "fünf", "cinq", "cinco"),
    "6": ("six", "sechs", "seis"),
    "7": ("seven", "sieben", "sept", "siete"),
    "8": ("eight", "acht", "huit", "ocho"),
    "9": ("nine", "neun", "neuf", "nueve"),
}
DIGIT_OF = {w: d for d, words in SPELLED.items() for w in words}
WORD_DIGIT = "|".join(sorted(DIGIT_OF, key=len, reverse=True))
#: At least this many spelled digits in a row are read as a number.
SPELLED_RUN = 4
RUN = re.compile(rf"(?i)\b(?:{WORD_DIGIT})(?:[\x20,.-]{{1,2}}(?:{WORD_DIGIT})){{{SPELLED_RUN - 1},}}\b")
ONE_DIGIT = re.compile(rf"(?i)\b(?:{WORD_DIGIT})\b")

#: Words for @ and for the dot of a domain.
AT_WORDS, DOT_WORDS = "at|arroba|arobase", "dot|punkt|point|punto"
#: A word or sign in brackets; a blank before the bracket goes with it.
BRACKET_AT = re.compile(rf"(?i)[\[({{<]\x20?(?:{AT_WORDS}|@)\x20?[\])}}>]\x20?")
BRACKET_DOT = re.compile(rf"(?i)[\[({{<]\x20?(?:{DOT_WORDS}|\.)\x20?[\])}}>]\x20?")
#: Spelled digits and figures with signs or worded dots between them. A figure is read once, from its start.
DIGIT_PART = rf"(?:\b(?:{WORD_DIGIT})\b|(?<![0-9])[0-9]++)"
BETWEEN = rf"(?:\x20(?:{DOT_WORDS})\x20|[\x20,.()-]{{1,3}})"
MIXED_RUN = re.compile(rf"(?i){DIGIT_PART}(?:{BETWEEN}{DIGIT_PART})++")
JOINED, DASHED = re.compile(r"[\x20,-]{1,2}"), re.compile(r"\x20-\x20?")
#: Words before "at host.tld" that make it prose, not an address.
NO_NAMES = frozenset("""a all also and any anyone arrive arrived available be been but buy check click come data day details down event everyone find for found free
go here him home hosted i in is it it's join learn left live located look looking me meet more now off on one online out over page people posted price
published read register see shown sign site stay store that them there these this time today up us visit was we website were work working works you""".split())
#: Bare words count only as a whole: name AT host DOT domain. Found at the word or sign for @, with the name before it.
AT_SIGN = re.compile(rf"(?i)\x20(?=(?:{AT_WORDS})\x20)|@")
BARE_AT = re.compile(rf"(?i)\x20(?:{AT_WORDS})\x20")
BARE_DOT = re.compile(rf"(?i)\x20(?:{DOT_WORDS})\x20")
BARE_HOST = re.compile(rf"(?i)(?:\x20(?:{AT_WORDS})\x20|@)[A-Za-z0-9-]++(?:(?:\x20(?:{DOT_WORDS})\x20|\.)[A-Za-z0-9-]++)++")
#: A worded dot or plus sign between two parts of a name, found at its end.
NAME_SIGN = re.compile(rf"(?i)\x20(?:{DOT_WORDS}|plus)\x20\Z")
LONGEST_SIGN = max(map(len, [*DOT_WORDS.split("|"), "plus"])) + 2
BARE_PLUS = re.compile(r"(?i)\x20plus\x20")
#: Character references of @ and the dot.
ENTITY_AT, ENTITY_DOT = re.compile(r"(?i)&(?:#0*64|#x0*40|commat);"), re.compile(r"(?i)&(?:#0*46|#x0*2e|period);")
HAS_WORD_DOT = re.compile(rf"(?i)\x20(?:{DOT_WORDS}|{AT_WORDS})\x20")

#: What a line must hold one of, as a word, for its digits to be rewritten.
TELLING = frozenset(DIGIT_OF) | frozenset(DOT_WORDS.split("|"))


class _Parting(dict):
    """For str.translate: what is in no word becomes a blank, line ends stay; letters that patterns take for i and s are."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = c if c.isalnum() or c in "_\n" else " "
        return self[point]


PARTING = _Parting({0x130: "i", 0x131: "i", 0x17F: "s"})


def lowered(text: str) -> str:
    """Words in lower case with blanks between them, line by line as in ``text``."""
    return text.translate(PARTING).lower()


def telling_lines(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the lines with a spelled digit or a worded dot: runs of either never leave their line."""
    if TELLING.isdisjoint(lowered(text).split()):
        return
    at = 0
    for line in text.split("\n"):
        if not TELLING.isdisjoint(lowered(line).split()):
            yield at, at + len(line)
        at += len(line) + 1


def _one_for_one() -> dict[int, str | None]:
    table: dict[int, str | None] = {0xFF01 + i: chr(0x21 + i) for i in range(94)}
    for odd, plain in LOOKALIKE:
        table |= {ord(a): b for a, b in zip(odd, plain, strict=True)}
    return table | {ord(c): None for c in HIDDEN}


GLYPHS = _one_for_one()
ODD = re.compile("[" + "".join(map(re.escape, map(chr, GLYPHS))) + "]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[LOCAL]+@...``: each @ has one run of local characters before it, so none is read twice."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Dotted quads, parts at most 255."""
    at = text.find(".")
    end = 0
    while at >= 0:
        start = at
        while start > end and "0" <= text[start - 1] <= "9":
            start -= 1
        found = IP.match(text, start) if start < at else None
        if found:
            end = found.end()
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found[0].split(".")):
                yield start, end
        at = text.find(".", max(at + 1, end))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits with single blanks or hyphens, 16 to 19 digits, Luhn."""
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    """+ and 8 to 15 digits."""
    for m in PHONE.finditer(text):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: list(find(text)) for kind, find in FINDERS.items()}


class Rewritten:
    """A text after rounds of edits, each kept as where its edits begin and end before and after."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.rounds: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply non-overlapping (start, end, written) in rising order; a written text stands for its whole span."""
        if not edits:
            return
        text, at, length = [], 0, 0
        old_starts, old_ends, starts, ends = [], [], [], []
        for start, end, new in edits:
            text += [self.text[at:start], new]
            length += start - at
            old_starts.append(start)
            old_ends.append(end)
            starts.append(length)
            length += len(new)
            ends.append(length)
            at = end
        self.text = "".join([*text, self.text[at:]])
        self.rounds.append((old_starts, old_ends, starts, ends))

    @property
    def changed(self) -> bool:
        return bool(self.rounds)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source that [start, end) stands for."""
        first, last = start, end - 1
        for old_starts, old_ends, starts, ends in reversed(self.rounds):
            i, j = bisect_right(starts, first) - 1, bisect_right(starts, last) - 1
            if i >= 0:
                first = old_starts[i] if first < ends[i] else first - ends[i] + old_ends[i]
            if j >= 0:
                last = old_ends[j] - 1 if last < ends[j] else last - ends[j] + old_ends[j]
        return first, last + 1


def bracketed(pattern: re.Pattern, text: str, written: str) -> list[tuple[int, int, str]]:
    """Edits that write ``written`` for what the pattern finds and a blank before it."""
    edits, end = [], 0
    for m in pattern.finditer(text):
        start = m.start() - (m.start() > end and text[m.start() - 1] == " ")
        end = m.end()
        edits.append((start, end, written))
    return edits


def bare_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost name AT host DOT domain, each name a whole run. Where the host's dots are words, the name's may be too."""
    end = 0
    for at in AT_SIGN.finditer(text):
        if at.start() < end:
            continue
        host = BARE_HOST.match(text, at.start())
        if not host:
            continue
        start = _name_start(text, at.start(), end)
        if start == at.start():
            continue
        while BARE_DOT.search(text, at.start(), host.end()):
            sign = NAME_SIGN.search(text, max(end, start - LONGEST_SIGN), start)
            before = _name_start(text, sign.start(), end) if sign else start
            if not sign or before == sign.start() or text[before : sign.start()].lower() in NO_NAMES:
                break
            start = before
        yield start, host.end()
        end = host.end()


def _name_start(text: str, at: int, least: int) -> int:
    """Where the run of name characters begins that ends at ``at``."""
    while at > least and text[at - 1] in LOCAL_CHARS:
        at -= 1
    return at


def _mixed_digits(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Edits that write every spelled digit and worded dot of runs of digit parts; the gap of two spelled digits goes, a spaced hyphen loses its blanks."""
    edits = []
    for run in (run for line in lines for run in MIXED_RUN.finditer(text, *line)):
        words = list(ONE_DIGIT.finditer(text, run.start(), run.end()))
        for k, m in enumerate(words):
            end = m.end()
            if k + 1 < len(words) and JOINED.fullmatch(text, end, words[k + 1].start()):
                end = words[k + 1].start()
            edits.append((m.start(), end, DIGIT_OF[lowered(m[0])]))
        taken = Overlaps([e[:2] for e in edits])
        edits += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(text, run.start(), run.end())]
        if words:
            edits += [(d.start(), d.end(), "-") for d in DASHED.finditer(text, run.start(), run.end()) if not taken(*d.span())]
    return sorted(edits)


def _spelled_runs(text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    edits = []
    for run in (run for line in lines for run in RUN.finditer(text, *line)):
        ones = list(ONE_DIGIT.finditer(text, run.start(), run.end()))
        for k, m in enumerate(ones):
            edits.append((m.start(), ones[k + 1].start() if k + 1 < len(ones) else m.end(), DIGIT_OF[lowered(m[0])]))
    return edits


def _plain_glyphs(text: str) -> Rewritten:
    out = Rewritten(text)
    if not text.isascii():
        out.replace([(m.start(), m.end(), GLYPHS[ord(m[0])] or "") for m in ODD.finditer(text)])
    return out


def readings(text: str) -> list[Rewritten]:
    """``text`` after the three transducers, and once more with digits rewritten wherever they stand beside other digits.

    Only readings that differ from the text, and the second only where it has digits that the first may not see.
    """
    out, mixed = _plain_glyphs(text), _plain_glyphs(text)
    lines = list(telling_lines(out.text))
    dots = bracketed(BRACKET_DOT, mixed.text, ".")
    mixed.replace(dots)
    digits = _mixed_digits(mixed.text, list(telling_lines(mixed.text)) if dots else lines)
    mixed.replace(digits)
    out.replace(_spelled_runs(out.text, lines))
    if "&" in out.text:
        out.replace([(m.start(), m.end(), "@") for m in ENTITY_AT.finditer(out.text)])
        out.replace([(m.start(), m.end(), ".") for m in ENTITY_DOT.finditer(out.text)])
    out.replace(bracketed(BRACKET_AT, out.text, "@"))
    out.replace(bracketed(BRACKET_DOT, out.text, "."))
    if HAS_WORD_DOT.search(out.text):
        edits = []
        for start, end in bare_addresses(out.text):
            word = BARE_AT.search(out.text, start, end)
            if BARE_DOT.search(out.text, start, end) or (word and out.text[start : word.start()].lower() not in NO_NAMES):
                edits += [(a.start(), a.end(), "@") for a in BARE_AT.finditer(out.text, start, end)]
                edits += [(d.start(), d.end(), ".") for d in BARE_DOT.finditer(out.text, start, end)]
                edits += [(d.start(), d.end(), "+") for d in BARE_PLUS.finditer(out.text, start, end)]
        out.replace(sorted(edits))
    return [x for x in ((out, mixed) if digits else (out,)) if x.changed]


def all_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans, and base with added spans, each by kind and then start."""
    base = base_spans(text)
    read = readings(text)
    if not read:
        return base, base
    both = {}
    for kind, find in FINDERS.items():
        own = base[kind]
        new: list[tuple[int, int]] = []
        for seen in read:
            inside = Inside(own + new)
            new += [x for x in (seen.source(*found) for found in find(seen.text)) if not inside(*x)]
        both[kind] = sorted(own + new)
    return base, both


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, and arrays ``base`` and ``spans`` of (kind, start, end, value): code points, end exclusive, kinds in order, then start."""
    docs = id_text(docs)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def listed(text: str, spans: dict) -> list[dict]:
        return [{"kind": k, "start": a, "end": b, "value": text[a:b]} for k in KINDS for a, b in spans[k]]

    def run(batches):
        for batch in batches:
            base, full = [], []
            for value in batch.column("text"):
                text = value.as_py()
                own, both = all_spans(text)
                base.append(listed(text, own))
                full.append(base[-1] if both is own else listed(text, both))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(full, span)], names=["doc_id", "base", "spans"])

    one = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("base", one), T.StructField("spans", one)])
    return docs.mapInArrow(run, schema)
