"""Secrets in source and configuration text.

Base rules: assign, access and hex patterns, leftmost and non-overlapping for each kind.

Lexing: each statement that holds an assignment sign is read as tokens (names, string literals, bare values, operators):
a line, with the next where the sign or a backslash ends it. ``name = literal``, ``name: literal``, ``"name": literal``,
``name=bare`` and ``export NAME=bare`` become name-literal pairs; a chain ``a = b = "x"`` names the literal by all of
them. Values of several lines are one literal to their real end: triple-quoted and back-quoted strings, and the indented
lines of a YAML block scalar (``key: |``). A name assigned from another name takes that name's literals (constants are
propagated, in reading order and through chains), and ``"a" + B`` joins what is known. Each assignment is a node that
points at its literals and at the earlier assignments it takes from; what the names weigh runs down these pointers once,
last assignment first, and what the values hold (length, counts of characters) runs up, so the work is linear in the text
whatever its constants repeat. A literal is scored by the most sensitive word in the names that reach it, by its length,
its mix of characters and its entropy, and what an assignment joins is scored as one value too, which reports all its
literals; private keys and JWTs by their shape, PEM blocks of several lines from their first line to their last, assigned
or not; from ``THRESHOLD`` on a literal's whole span is added as kind ``assign``. Spans of the base rules always stay; an
added span inside a base span is dropped, as that secret is already reported.

Null text counts as empty and gives no spans. Repeated rows and equal ids are scanned row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from priorline.llm.common import Inside, id_text

KINDS = ("assign", "access", "hex")

# The contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: What any long enough run of hex digits holds, as a quick look before the pattern itself.
HEX_LONG = re.compile(r"[0-9a-f]{24,}")

#: Words in names, with how sensitive what they name is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "private": 0.9, "apikey": 1.0, "token": 0.9,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "signature": 0.6, "signing": 0.7, "access": 0.5, "key": 0.6, "salt": 0.6, "cert": 0.4, "session": 0.5,
}
#: Literals that stand for no secret.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|0+|1+|none|null|nil|true|false|undefined|change_?me|example|your[_-].*|<.*>|\$\{.*\}|%.*%|todo|test|dummy|placeholder|redacted)$")
THRESHOLD = 1.0
#: Joined values up to so many characters are kept as text, to see their shape; of longer ones length and counts are.
JOINED_TEXT = 1 << 16
#: Names whose literals may be of several words, and shapes that are secrets under any name.
PHRASES = frozenset(("password", "passwd", "pwd", "passphrase"))
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
PEM_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY-----")
SHAPE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")

STRINGS = {'"': r"""\"(?:[^"\\\n]++|\\[\s\S])*+\"""", "'": r"""'(?:[^'\\\n]++|\\[\s\S])*+'""", "`": r"`[^`\n]*+`"}
REST = (
    r"""(?P<assign>:=|=>|(?<![=!<>])=(?!=)|:(?!//))|(?P<plus>\+)|(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*)|(?P<bare>[A-Za-z0-9+/_.=@!#%^&*~-]+)|(?P<end>[;,{}()\[\]])|(?P<other>\S)"""
)
#: A name, a sign, and the start of a value of several lines: triple or back quotes, or a block scalar's mark at a line's end.
SEVERAL = re.compile(
    r"""(?<![A-Za-z0-9_$.-])(?P<name>[A-Za-z_$][A-Za-z0-9_$.-]*+)["']?[\x20\t]*+(?::=|=>|=(?!=)|:)[\x20\t]*+(?:[rbuf]{0,2}(?P<quotes>\"{3}|'{3})|(?P<back>`)|(?P<block>[|>][+-]?[0-9]?[+-]?)[\x20\t]*+\r?(?=\n))""",
    re.ASCII,
)
INDENT = re.compile(r"[\x20\t]*+")
#: What stands between the lines of a value: no part of it where it is scored.
LINE_END = re.compile(r"\\?\r?\n[\x20\t]*+")
BARE_VALUE = re.compile(r"[^\s'\"`,;(){}\[\]<>]+")
#: Where a line can hold a pair at all: a sign with something before and after it, not a scheme's colon.
SIGN = re.compile(r"""[A-Za-z0-9_"'`\])][\x20\t]*(?::=|=>|=(?!=)|:(?!//))[\x20\t]*+(?:\r?\n[\x20\t]*+)?[^\s=]""")
BLANK = re.compile(r"\s")
DIGIT = re.compile(r"[0-9]")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@cache
def token(quotes: str) -> re.Pattern:
    """A token where only ``quotes`` can open a string."""
    strings = "|".join(STRINGS[q] for q in quotes)
    return re.compile((f"(?P<string>{strings})|" if quotes else "") + REST, re.ASCII)


def tokens(text: str, at: int, end: int) -> Iterator[re.Match]:
    """The tokens of a line. A quote that nothing closes leaves all later ones of its kind open too: they are not tried again."""
    quotes = "".join(STRINGS)
    while at < end:
        for m in token(quotes).finditer(text, at, end):
            yield m
            if m.lastgroup == "other" and m[0] in quotes:
                quotes, at = quotes.replace(m[0], ""), m.end()
                break
        else:
            return


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """assign: group 2 of 6 or more characters; access: 20 or more; hex: 24 or more."""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20],
        "hex": [m.span() for m in HEX_LONG.finditer(text)],
    }


def sensitivity(name: str) -> float:
    """The most sensitive word of a name; ``apiKey``, ``API_KEY`` and ``api-key`` are the same words."""
    words = [w.lower() for w in WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, SENSITIVE.get(w.rstrip("s"), 0.0)) for w in [*words, *pairs]), default=0.0)


def weight(names: list[str]) -> tuple[float, bool]:
    """The most sensitive word in the names, and whether one of them may name a pass phrase."""
    phrase = any(PHRASES & {w.lower() for w in WORDS.findall(name)} for name in names)
    return max(map(sensitivity, names), default=0.0), phrase


class Value:
    """What a score needs of a value: its length, counts of characters, last one, and the text itself while it is not long."""

    __slots__ = ("n", "counts", "last", "text")

    def __init__(self, n: int, counts: Counter, last: str, text: str | None) -> None:
        self.n, self.counts, self.last, self.text = n, counts, last, text

    @classmethod
    def of(cls, text: str) -> Value:
        text = LINE_END.sub("", text)
        return cls(len(text), Counter(text), text[-1:], text)

    def __add__(self, other: Value) -> Value:
        n = self.n + other.n
        text = self.text + other.text if n <= JOINED_TEXT and self.text is not None and other.text is not None else None
        return Value(n, self.counts + other.counts, other.last or self.last, text)

    def entropy(self) -> float:
        """Bits for each character."""
        return -sum(c / self.n * math.log2(c / self.n) for c in self.counts.values()) if self.n else 0.0

    def kinds(self) -> int:
        """How many there are of lower case, upper case, digits and others."""
        return len({0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in self.counts})


def score(named: tuple[float, bool], value: Value) -> float:
    """Names (by ``weight``) weigh most; random-looking values add up to 0.6, short or plain ones take away.

    Keys and tokens by their shape, whatever the name.
    """
    if value.text is not None and SHAPE.match(value.text):
        return 2.0
    most, phrase = named
    if not most or value.n < 6 or (value.text is not None and PLACEHOLDER.match(value.text)):
        return 0.0
    # Several words are a secret only as a pass phrase; text that names secrets is about them.
    if any(c.isspace() for c in value.counts) and (not phrase or value.last in ".:?!" or value.text is None or sensitivity(value.text)):
        return 0.0
    kinds = value.kinds()
    return most + min(0.6, 0.15 * (value.entropy() - 2)) * (value.n >= 8) + 0.1 * (kinds - 1) - 0.3 * (kinds == 1)


def several_lines(text: str) -> Iterator[tuple[int, int, str, tuple[int, int]]]:
    """Start of the name, end of the whole, name and value span of each value of several lines. What nothing closes is none."""
    unclosed: set[str] = set()
    found = SEVERAL.search(text)
    while found:
        at, mark = found.end(), found["quotes"] or found["back"]
        if mark:
            end = -1 if mark in unclosed else text.find(mark, at)
            if end < 0:
                unclosed.add(mark)
            elif text.find("\n", at, end) >= 0:
                yield found.start(), end + len(mark), found["name"], (at, end)
                at = end + len(mark)
        else:
            key = INDENT.match(text, text.rfind("\n", 0, found.start()) + 1)
            deep, line, first, last = key.end() - key.start(), text.find("\n", at) + 1, None, at
            while 0 < line < len(text):
                stop = text.find("\n", line)
                stop = len(text) if stop < 0 else stop
                indent = INDENT.match(text, line, stop)
                if indent.end() < stop and text[indent.end() : stop].strip():
                    if indent.end() - line <= deep:
                        break
                    first, last = indent.end() if first is None else first, len(text[:stop].rstrip()) if text[stop - 1 : stop].isspace() else stop
                line = stop + 1
            if first is not None:
                yield found.start(), last, found["name"], (first, last)
                at = last
        found = SEVERAL.search(text, at)


def statement_end(text: str, at: int) -> int:
    """The next line end from ``at`` on that no backslash continues."""
    end = text.find("\n", at)
    while end >= 0 and text[at:end].removesuffix("\r").endswith("\\"):
        at, end = end + 1, text.find("\n", end + 1)
    return len(text) if end < 0 else end


def assignments(text: str) -> list[tuple[list[str], list[tuple[int, int] | int]]]:
    """Names and what they take, in reading order: spans of literals, and numbers of earlier assignments."""
    made: list[tuple[list[str], list[tuple[int, int] | int]]] = []
    known: dict[str, int] = {}
    at = run = digit = 0
    blocks = several_lines(text)
    block = next(blocks, None)
    found = SIGN.search(text)
    while found or block:
        begin = (text.rfind("\n", at, found.start()) + 1 or at) if found else len(text)
        end = statement_end(text, found.end() - 1) if found else len(text)
        if block and block[0] < end:
            start, end, name, span = block
            if not found or start <= found.start() or text.find("\n", found.start(), start) < 0:
                if start >= at:  # else it began within what has been read
                    known[name] = len(made)
                    made.append(([name], [span]))
                    at = max(at, end)
                block = next(blocks, None)
                found = SIGN.search(text, at)
                continue
            end = text.rfind("\n", 0, start)
        names: list[str] = []
        values: list[tuple[int, int] | int] = []
        last: tuple[str, int, int] | None = None
        expects, sign_at = False, begin

        def close() -> None:
            if names and values:
                for name in names:
                    known[name] = len(made)
                made.append((list(names), list(values)))
            names.clear()
            values.clear()

        for m in tokens(text, begin, end):
            kind, word = m.lastgroup, m[0]
            if kind == "assign":
                if last:
                    if values and values[-1] == last[1:]:
                        values.pop()  # what looked like a literal is a name
                    if (not expects and values) or text.find("\n", sign_at, last[1]) >= 0:
                        close()
                    names.append(last[0])
                    expects, sign_at = True, m.end()
                last = None
            elif kind == "plus":
                expects = bool(names)
                last = None
            elif kind == "string":
                inner = (m.start() + 1, m.end() - 1)
                if expects:
                    values.append(inner)
                    expects = False
                elif values:
                    close()
                last = (word[1:-1], *inner)
            elif kind in ("name", "bare"):
                if expects:
                    if m.start() >= run:  # else within the value read last, which ends where this one does
                        run = BARE_VALUE.match(text, m.start(), end).end()
                        digit = max((d.start() for d in DIGIT.finditer(text, m.start(), run)), default=-1)
                    if word in known:
                        values.append(known[word])
                    elif kind == "bare" or digit >= m.start():
                        values.append((m.start(), run))
                    expects = False
                elif values:
                    close()
                last = (word, *m.span())
            elif word == "\\" and text[m.end() : m.end() + 2].startswith(("\n", "\r\n")):
                continue  # the statement goes on
            elif kind == "end" or not expects:
                close()
                last, expects = None, False
        close()
        at = end
        found = SIGN.search(text, at)
    return made


def secret_literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that score as secrets, alone or joined."""
    made = assignments(text)
    weights = [weight(names) for names, _ in made]
    values: list[Value] = []
    for _, parts in made:
        values.append(sum((values[p] if isinstance(p, int) else Value.of(text[slice(*p)]) for p in parts), Value(0, Counter(), "", "")))
    reached: dict[tuple[int, int], tuple[float, bool]] = {}
    whole = [False] * len(made)
    found: dict[tuple[int, int], bool] = {}
    # An assignment takes from earlier ones only, so by its turn all that take from it have added their weight.
    for i in range(len(made) - 1, -1, -1):
        most, phrase = weights[i]
        parts = made[i][1]
        whole[i] = whole[i] or (len(parts) > 1 and score(weights[i], values[i]) >= THRESHOLD)
        for value in parts:
            if isinstance(value, int):
                weights[value] = (max(weights[value][0], most), weights[value][1] or phrase)
                whole[value] = whole[value] or whole[i]
            else:
                before = reached.get(value, (0.0, False))
                reached[value] = (max(before[0], most), before[1] or phrase)
                found[value] = found.get(value, False) or (whole[i] and value[0] < value[1])
    return [span for span, named in reached.items() if found[span] or score(named, Value.of(text[slice(*span)])) >= THRESHOLD]


def pem_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans from a private key's first line to the next last line."""
    begin = PEM_BEGIN.search(text)
    while begin:
        end = PEM_END.search(text, begin.end())
        if not end:
            return
        yield begin.start(), end.end()
        begin = PEM_BEGIN.search(text, end.end())


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and base with added spans, each by start and then kind."""
    order = {k: i for i, k in enumerate(KINDS)}
    base = sorted(((a, b, k) for k, spans in base_spans(text).items() for a, b in spans), key=lambda s: (s[0], order[s[2]]))
    blocks = list(pem_blocks(text))
    inside = Inside([(a, b) for a, b, _ in base] + blocks)
    new = [span for span in secret_literals(text) if not inside(*span)]
    inside = Inside([(a, b) for a, b, _ in base] + new)
    new = [(a, b, "assign") for a, b in new + [block for block in blocks if not inside(*block)]]
    return base, sorted(base + new, key=lambda s: (s[0], order[s[2]])) if new else base


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, and arrays ``base`` and ``spans`` of (kind, start, end, value): code points, end exclusive, by start, then kind in order."""
    docs = id_text(docs)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def listed(text: str, spans: list) -> list[dict]:
        return [{"kind": k, "start": a, "end": b, "value": text[a:b]} for a, b, k in spans]

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
