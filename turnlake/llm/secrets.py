"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans. Beyond them, the text is lexed as source or
configuration text: names, operators and literals become name-literal pairs for the forms
``name = "x"``, ``"name": "x"``, ``name => x``, ``export NAME=x``, ``--name x`` and
``<name>x</name>``, ``conf["name"] = "x"`` and ``f("name", "x")``; a PEM block is a pair of the label of
its first line and its body. Strings may have a prefix, as in ``rb"x"``. A value may begin on a later line than its name and go on over lines: behind
``+``, in parentheses, in triple quotes, in a YAML block, in an element. A name whose value is
another name takes the literal assigned to that name last before, or else first after it (constant
propagation, also through concatenation of literals). A literal is a secret
when, in any of its uses, the sensitivity of the name and the randomness of the value score
enough together. A value with blanks is one only as a passphrase: three words or more with a
digit, without the words of a sentence, under the name of a password.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.bpe_encode import small_batches
from turnlake.llm.store import named, text_batches

# Fixed: the base patterns and the least length of a match (of group 2, for assign).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 16 or more are whole runs, as the class is greedy.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

# Words in a name that speak for a secret, and how strongly.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8,
    "apikey": 1.0, "key": 0.5, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8,
    "private": 0.6, "access": 0.4, "client": 0.2, "signature": 0.5, "salt": 0.5, "session": 0.4,
}
# Words in a name that speak against it.
HARMLESS = {"public", "name", "type", "length", "size", "count", "id", "url", "path", "file"}
BAR = 1.3
LITERAL_LENGTH = 8

LEXER = re.compile(
    r"""
    (?P<string>(?:(?<![\w.$/+-])(?:[bBfFrRuU]|[bBfF][rR]|[rR][bBfF])(?=["']))?
        (?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'))
  | (?P<tag></?[A-Za-z_][\w.-]*>)
  | (?P<op>=>|:=|==|!=|<=|>=|[=:+,;(){}\[\]<])
  | (?P<block>[|>][-+0-9]{0,2}[\t ]*+(?:\#[^\n]*+)?\r?(?=\n))
  | (?P<joined>\\\r?\n)
  | (?P<line>\n)
  | (?P<word>--?[A-Za-z][\w-]*|[A-Za-z_$][\w.$-]*|[\w.$/+-]+)
    """,
    re.VERBOSE,
)
ASSIGNS = {("op", o) for o in ("=", ":", ":=", "=>")}
# A bare value: what may follow its first word without a blank.
BARE = re.compile(r"[\w.$/+&!@\#%^*~?|-]+(?:={1,2}(?![\w=]))?")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,64})-----")
PEM_BREAK = re.compile(r"\n|\\[rn]")
# Quotes behind an even number of backslashes.
PLAIN_QUOTE = {q: re.compile(rf"(?<!\\)(?:\\\\)*+{q}") for q in "\"'"}
# What a text with an assignment holds at least.
CANDIDATE = re.compile(r"""[=:]|--[A-Za-z]|</|\([rbfuRBFU]*["']""")
TRIPLE = {q: re.compile(rf"(?<!\\)(?:\\\\)*+({q * 3})") for q in "\"'"}
LINE = re.compile(r"[^\n]+")
# Words of sentences, which a passphrase does without.
SENTENCE = frozenset(
    "a an and are at be by can cannot enter for from has have here in is it least may more must no "
    "not of on only or please should than that the this to was will with your you".split()
)
PASSPHRASE_WORDS, PASSPHRASE_NAME = 3, 0.9
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|<.*>|\$\{.*\}|example|changeme|placeholder|your[_-]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and without overlap within a kind."""
    found = [
        (m.start(), m.end(), "assign")
        for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= ASSIGN_LENGTH
    ]
    found += [
        (m.start(), m.end(), "access")
        for m in ACCESS.finditer(text)
        if m.end() - m.start() >= ACCESS_LENGTH
    ]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def name_score(name: str) -> float:
    """How sensitive a name is, by its words: ``dbPassword`` and ``DB_PASSWORD`` alike."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    score = max((SENSITIVE.get(p, 0.0) for p in {*parts, *joined}), default=0.0)
    return score - 0.5 * bool(HARMLESS & set(parts))


def randomness(literal: str) -> float:
    """0 to 1: bits per character against those of random text, and a mix of character kinds."""
    if not literal:
        return 0.0
    counts = Counter(literal)
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(k, literal)) for k in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    return min(1.0, bits / math.log2(max(2, min(n, 64)))) * min(1.0, (kinds + 1) / 3)


def without_open_quotes(text: str) -> str:
    """The text with quotes that cannot begin a string replaced by NUL, in their places.

    A string ends at the next quote of its kind on the line that is not escaped. Each quote behind
    the last of those would be followed to the end of the line in vain.
    """
    if '\\"' not in text and "\\'" not in text:
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        for quote, plain in PLAIN_QUOTE.items():
            last = max((m.end() for m in plain.finditer(line)), default=0)
            line = line[:last] + line[last:].replace(quote, "\0")
        lines[i] = line
    return "\n".join(lines)


# (text, start, end, the name that it may stand for); what is quoted stands for none.
Part = tuple[str, int, int, str | None]


class Lexed:
    """The tokens of a text: (kind, text, start, end)."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = []
        for m in LEXER.finditer(without_open_quotes(text)):
            start, end = m.span()
            if m.lastgroup == "string":
                while text[start] not in "\"'":  # a prefix
                    start += 1
            if m.lastgroup != "joined":
                self.tokens.append((m.lastgroup, text[start:end], start, end))
        self.triples: dict[str, list[int]] = {}

    def kind(self, at: int) -> str:
        return self.tokens[at][0] if at < len(self.tokens) else "line"

    def op(self, at: int) -> str:
        """The operator at a place, or nothing."""
        return self.tokens[at][1] if self.kind(at) == "op" else ""

    def assigns(self, at: int) -> bool:
        return self.tokens[at : at + 1] != [] and self.tokens[at][:2] in ASSIGNS

    def behind_lines(self, at: int) -> int:
        while at < len(self.tokens) and self.tokens[at][0] == "line":
            at += 1
        return at

    def lines(self, start: int, stop: int) -> list[Part]:
        """The lines of a stretch of text without the space around them."""
        out = []
        for m in LINE.finditer(self.text, start, stop):
            if value := m.group().strip():
                begin = m.start() + m.group().index(value)
                out.append((value, begin, begin + len(value), None))
        return out

    def triple_end(self, start: int, empty: str) -> int:
        """Where the triple-quoted string ends of which an empty string is the beginning; or 0."""
        if empty not in ('""', "''") or self.text[start + 2 : start + 3] != empty[0]:
            return 0
        quote = empty[0]
        if quote not in self.triples:
            self.triples[quote] = [m.start(1) for m in TRIPLE[quote].finditer(self.text)]
        ends = self.triples[quote]
        nearest = bisect_left(ends, start + 3)
        return ends[nearest] + 3 if nearest < len(ends) else 0

    def bare_end(self, start: int) -> int:
        """Where the unquoted value at a place ends; 0 where what follows makes it an expression."""
        m = BARE.match(self.text, start)
        if not m or self.text[m.end() : m.end() + 1] in {"(", "[", "{", "\"", "'", "`", "=", "<"}:
            return 0
        return m.end()

    def block(self, at: int) -> list[Part]:
        """The lines behind a block's sign that are indented more than the line of the sign."""
        _, _, start, end = self.tokens[at]
        first = self.text.rfind("\n", 0, start) + 1
        indent = first
        while self.text[indent] in " \t":
            indent += 1
        stop = end
        for m in LINE.finditer(self.text, end):
            line = m.group()
            if line.strip() and len(line) - len(line.lstrip(" \t")) <= indent - first:
                break
            stop = m.end()
        return self.lines(end, stop)

    def value(self, at: int, lines: bool) -> tuple[list[Part], list[Part], int]:
        """(parts of the value that begins at a token, those on its own line, the token behind it).

        ``lines``: the value may go on over lines. Parts joined by + are one value, as are strings
        side by side in parentheses.
        """
        parts: list[Part] = []
        own: list[Part] | None = None
        if self.kind(at) == "block":
            return (self.block(at) if lines else []), [], at
        depth = 0
        here = at
        while lines:
            behind = self.behind_lines(at)
            if self.op(behind) != "(":
                break
            depth += 1
            at = behind + 1
        if lines and self.kind(at) == "line":
            behind = self.behind_lines(at)
            # Of the words of a later line only one that stands alone is a value; a name is none.
            alone = self.kind(behind) == "string" or depth or self.kind(behind + 1) == "line" or self.op(behind + 1) in (",", ";")
            if alone and not self.assigns(behind + 1):
                at = behind
        if at != here:
            own = []
        while self.kind(at) in ("string", "word") and at < len(self.tokens):
            kind, value, start, end = self.tokens[at]
            at += 1
            stop = self.triple_end(start, value) if kind == "string" and lines else 0
            if stop:
                own = parts[:] if own is None else own
                parts += self.lines(start + 3, stop - 3)
                while at < len(self.tokens) and self.tokens[at][2] < stop:
                    at += 1
            elif kind == "string":
                parts.append((value[1:-1], start + 1, end - 1, None))
            else:
                end = max(end, self.bare_end(start))
                parts.append((self.text[start:end], start, end, value))
                while at < len(self.tokens) and self.tokens[at][2] < end:
                    at += 1
            plus = self.behind_lines(at) if lines else at
            if self.op(plus) == "+":
                behind = self.behind_lines(plus + 1) if lines else plus + 1
            elif depth and self.kind(plus) == "string":
                behind = plus
            else:
                break
            crossed = "line" in (self.kind(at), self.kind(plus + 1)) or behind == plus
            if self.kind(behind) not in ("string", "word") or (crossed and self.assigns(behind + 1)):
                break
            own = parts[:] if crossed and own is None else own
            at = behind
        return parts, parts if own is None else own, at


def pem_blocks(text: str) -> Iterator[tuple[str, list[Part]]]:
    """(label, lines of the body) of PEM blocks, whose line breaks may be written as escapes."""
    begin = None
    for m in PEM.finditer(text):
        if m[1] == "END" and begin and begin[2] == m[2]:
            parts: list[Part] = []
            start = begin.end()
            for end, behind in [(b.start(), b.end()) for b in PEM_BREAK.finditer(text, start, m.start())] + [(m.start(),) * 2]:
                line = text[start:end].strip()
                if line and ":" not in line:
                    at = text.index(line, start)
                    parts.append((line, at, at + len(line), None))
                start = behind
            yield m[2], parts
        begin = m if m[1] == "BEGIN" else None


def assignments(text: str) -> Iterator[tuple[str, list[Part]]]:
    """(name, parts of the value).

    Of a value that goes on over lines, what its own line holds comes first, as a value by itself.
    """
    yield from pem_blocks(text)
    if not CANDIDATE.search(text):
        return
    lexed = Lexed(text)
    tokens = lexed.tokens
    tags = [t for t in tokens if t[0] == "tag"]
    n_tags = i = 0
    while i < len(tokens):
        kind, value, _, end = tokens[i]
        i += 1
        if kind == "tag":
            n_tags += 1
            closing = tags[n_tags] if n_tags < len(tags) else None
            if closing and closing[1] == f"</{value[1:-1]}>":
                stop = closing[2]
                inner = text[end:stop]
                yield value[1:-1], lexed.lines(end, stop) if "\n" in inner else [(inner, end, stop, None)]
            continue
        if kind not in ("string", "word"):
            continue
        name = value.strip("\"'")
        flag = kind == "word" and value.startswith("-")
        if lexed.assigns(i):
            parts, own, at = lexed.value(i + 1, True)
        elif flag:
            parts, own, at = lexed.value(i, False)
        elif kind == "string" and lexed.op(i) == "]" and lexed.assigns(i + 1):
            parts, own, at = lexed.value(i + 2, True)
        elif kind == "string" and lexed.op(i) == "," and i > 1 and lexed.op(i - 2) == "(":
            parts, own, at = lexed.value(lexed.behind_lines(i + 1), False)
        else:
            continue
        if own and own != parts:
            yield name, own
        if parts:
            yield name, parts
            # A value may be the name of a next pair (a = b = "x"), and texts of several lines may
            # hold pairs of their own.
            if own == parts:
                i = max(i, at - 1)


def literals_of(pairs: list[tuple[str, list[Part]]]) -> list[list[tuple[str, int, int]]]:
    """The literals that each pair's value leads to; a name that leads to itself has none."""
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(pairs):
        places.setdefault(name, []).append(i)

    def source(word: str, i: int) -> int:
        """The pair that gives a name its value: the last before the i-th, or the first after."""
        at = places.get(word, [])
        k = bisect_left(at, i)
        if k:
            return at[k - 1]
        k += at[:1] == [i]
        return at[k] if k < len(at) else -1

    found: list[list[tuple[str, int, int]] | None] = [None] * len(pairs)
    begun: set[int] = set()
    for first in range(len(pairs)):
        stack = [first]
        while stack:
            i = stack[-1]
            if found[i] is not None:
                stack.pop()
                continue
            begun.add(i)
            parts = [(p, -1 if p[3] is None else source(p[3], i)) for p in pairs[i][1]]
            wanted = [k for _, k in parts if k >= 0 and found[k] is None and k not in begun]
            if wanted:
                stack += wanted
                continue
            literals = []
            for (value, start, end, word), k in parts:
                if known := found[k] if k >= 0 else None:
                    literals += known
                elif word is None or any(c.isdigit() for c in value):
                    literals.append((value, start, end))
            found[i] = list(dict.fromkeys(literals))
    return found


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, "literal") of the literals that sensitive names lead to."""
    pairs = list(assignments(text))
    found: dict[tuple[int, int, str], None] = {}
    for (name, _), literals in zip(pairs, literals_of(pairs), strict=True):
        score = name_score(name)
        joined = "".join(v for v, _, _ in literals)
        for value, start, end in literals:
            # Each use is judged by its own value, so another use of the literal only adds spans.
            if is_secret(joined if len(joined) >= LITERAL_LENGTH else value, score):
                found[start, end, "literal"] = None
    return list(found)


def is_secret(literal: str, score: float) -> bool:
    """Whether a literal that reaches a name of that score is a secret."""
    if len(literal) < LITERAL_LENGTH or score <= 0 or PLACEHOLDER.search(literal):
        return False
    words = literal.split()
    if len(words) > 1:
        phrase = len(words) >= PASSPHRASE_WORDS and any(c.isdigit() for c in literal)
        return phrase and score >= PASSPHRASE_NAME and SENTENCE.isdisjoint(literal.lower().split())
    return score + randomness(literal) >= BAR


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and kind."""
    base = base_spans(text)
    more = [s for s in literal_spans(text) if s[1] > s[0]]
    return base, sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``base`` and ``spans``, arrays of (start, end, kind).

    Positions are code points, the end exclusive. Null counts as empty and has none. Null and
    repeated ids are kept as they are, and other columns are not read.
    """
    text_batches(docs.sparkSession)
    span = T.StructType(
        [
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("kind", T.StringType()),
        ]
    )
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                found = [spans_of(t or "") for t in part.column(1).to_pylist()]
                columns = [
                    pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[k]] for f in found], arrow)
                    for k in (0, 1)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_id", "_base", "_spans"])

    rows = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"))
    fields = [
        T.StructField("_id", rows.schema[0].dataType),
        T.StructField("_base", T.ArrayType(span)),
        T.StructField("_spans", T.ArrayType(span)),
    ]
    return rows.mapInArrow(run, T.StructType(fields)).select(
        F.col("_id").alias(id_col), F.col("_base").alias("base"), F.col("_spans").alias("spans")
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def told(column: str):
        return F.array_join(
            F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(told("base"), 256).alias("base_sha256"),
        told("spans").alias("spans"),
    )
