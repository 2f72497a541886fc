"""Secret scans with assignment-aware lexing.

Base patterns find keyword assignments, access keys and long hex runs. Beyond them, source and configuration syntax is read
into name-literal pairs: ``name = "x" + OTHER``, ``"name": "x"``, ``name: x``, ``export NAME=x``, ``set("NAME", "x")``,
``<name>x</name>``, ``--name x``, blocks of lines after ``name: |``, values in parentheses over lines and the alternatives of a
condition, with quotes that are escaped, tripled or of any kind. Constants are carried to the names that use them, and
each literal is scored by the names that it reaches: a literal is a secret if a sensitive name gets it. Calls, subscripts,
dotted identifiers and plain words after a colon are code or prose, not literals.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_text

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_TARGET = re.compile(r"""(?<![\w.\-])(?:\\?["'])?([A-Za-z_][\w.\-]*+)(?:\\?["'])?[ \t]*(?::=|=>|[:=])(?![=/])[ \t]*""", re.A)
#: A flag of a command: --name value, --name=value.
_FLAG = re.compile(r"""(?<![\w\-])--?([A-Za-z][\w\-]*+)(?:=|[ \t]+)(?=[^\s\-=|&;<>])""", re.A)
#: The head of a block of lines: name: |
_BLOCK = re.compile(r"[|>][+\-\d]*[ \t]*(?:#[^\n]*)?\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|\Z)")
_OPEN = re.compile(r"\(\s*(?=[rbuf]{0,2}[\"'])")
#: What joins the values within parentheses.
_WITHIN = re.compile(r"\s*(?:\+\s*)?(?=[rbuf]{0,2}[\"'])")
#: What stands between alternatives of a value.
_ELSE = re.compile(r"""[ \t]+if\b(?:[^\n"'=:]|[=!<>]=|"[^"\n]*"|'[^'\n]*')*?\belse[ \t]+|[ \t]*(?:\bor\b|\|\||\?\?|\?|(?<=["'])[ \t]+:)[ \t]*""")
#: A plain word, which after a colon is prose.
_PROSE = re.compile(r"[A-Za-z][a-z]*[.!?,;]*$")
#: A call that gives a quoted name a value: setenv("NAME", "x"), put('name', 'x').
_CALL = re.compile(r"""(?<=[(,])[ \t]*(["'])([A-Za-z_][\w.\-]*+)\1[ \t]*,[ \t]*(?=["'])""", re.A)
_TAG = re.compile(r"""<([A-Za-z_][\w.\-]*+)(?:[ \t][^<>\n]*)?>([^<>\n]+)</\1>""", re.A)
_TERM = re.compile(
    "|".join(
        (
            r'[rbuf]{0,2}"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}',
            r"[rbuf]{0,2}'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}",
            r'[rbuf]{0,2}"((?:[^"\\\n]|\\.)*+)"',
            r"[rbuf]{0,2}'((?:[^'\\\n]|\\.)*+)'",
            r"`([^`\n]*+)`",
            r'\\"([^"\\\n]*+)\\"',
            r"\\'([^'\\\n]*+)\\'",
            r"""((?:\$\{\w+\}|[A-Za-z0-9_$])(?:\$\{\w+\}|[^\s"'`,;()<>\[\]{}])*)""",
        )
    ),
    re.A | re.S,
)
#: The group of a term without quotes.
BARE = _TERM.groups
#: Unquoted text that is code: a dotted identifier, or one that is called or subscripted.
_CODE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$", re.A)
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*")
_USES = re.compile(r"\$\{(\w+)\}|\$(\w+)|%\((\w+)\)s|\{(\w+)\}", re.A)
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: How much a part of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.9, "pass": 0.8, "private": 0.6, "signing": 0.6, "pin": 0.6}
#: Parts that make "key" sensitive.
KEY_OF = {"api", "access", "private", "secret", "signing", "encryption", "master", "auth", "account"}
#: Values that stand for none.
PLACEHOLDERS = re.compile(r"(?i)(change_?me|example|placeholder|your[_-].*|x+|\*+|none|null|true|false|todo|<.*>|\.*)$")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if "key" in parts and KEY_OF & set(parts):
        best = 1.0
    if parts and parts[-1] in ("name", "file", "path", "url", "id", "length", "type", "count"):  # about a secret, not one
        best *= 0.4
    return best


def literal_score(value: str) -> float:
    """0 to 1 by length and the entropy of its characters."""
    return _Value(len(value), value[:HEAD], value[-1:], Counter(value)).score()


#: No placeholder of a fixed text is longer.
HEAD = 16


class _Value(NamedTuple):
    """What the score needs of a text that may be too long to write out: its size, its first characters, its last and their counts."""

    size: int
    head: str
    last: str
    counts: dict[str, int]

    @staticmethod
    def joined(parts: list[_Value]) -> _Value:
        size, head, last, counts = 0, "", "", {}
        for p in parts:
            size, head, last = size + p.size, (head + p.head)[:HEAD], p.last or last
            for c, n in p.counts.items():
                counts[c] = counts.get(c, 0) + n
        if size >> 200:  # shares are the same in double precision
            counts = {c: max(1, n >> 100) for c, n in counts.items()}
            size = sum(counts.values())
        return _Value(size, head, last, counts)

    def placeholder(self) -> bool:
        if self.size <= HEAD:
            return bool(PLACEHOLDERS.match(self.head))
        kinds = set(self.counts)
        return kinds <= {"x", "X"} or kinds == {"*"} or kinds == {"."} or self.head[:5].lower() in ("your_", "your-") or self.head[0] + self.last == "<>"

    def score(self) -> float:
        if self.size < 6 or self.placeholder() or self.counts.get(" ", 0) * 3 > self.size:
            return 0.0
        shares = [n / self.size for n in self.counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p)
        return min(1.0, entropy / 2.5) * (1.0 if self.size >= 8 else 0.8)


class _Term(NamedTuple):
    """A part of a value. quoted is None for code and prose, whose value is not known."""

    text: str
    start: int
    end: int
    quoted: bool | None


def _terms(text: str, at: int, colon: bool, glue: re.Pattern = _PLUS) -> tuple[list[_Term] | None, int]:
    """Terms of a sum. None if there is no value."""
    terms: list[_Term] = []
    while t := _TERM.match(text, at):
        k = t.lastindex
        code = k == BARE and (_CODE.match(t[k]) or text[t.end() : t.end() + 1] in ("(", "[") or (colon and _PROSE.match(t[k])))
        terms.append(_Term(t[k], t.start(k), t.end(k), None if code else k < BARE))
        at = t.end()
        plus = glue.match(text, at)
        if not plus:
            break
        at = plus.end()
    return terms or None, at


def _block(text: str, at: int, key: int) -> tuple[list[_Term] | None, int]:
    """The lines below ``name: |`` that are deeper than the line of the name, as one term."""
    begin = text.rfind("\n", 0, key) + 1
    depth = len(text[begin:key]) - len(text[begin:key].lstrip(" \t-"))
    first, last = None, at
    while at < len(text):
        line = _LINE.match(text, at)
        if line[2].strip():
            if len(line[1]) <= depth:
                break
            first, last = line.start(2) if first is None else first, line.end(2)
        at = line.end()
    return (None if first is None else [_Term(text[first:last].rstrip(), first, first + len(text[first:last].rstrip()), True)]), at


def _values(text: str, m: re.Match, colon: bool) -> tuple[list[list[_Term]], int]:
    """The values that may be given after a name: one, or the alternatives of a condition."""
    at, out = m.end(), []
    if colon and (head := _BLOCK.match(text, at)):
        terms, at = _block(text, head.end(), m.start())
        return [terms] if terms else [], at
    while True:
        head = _OPEN.match(text, at)
        terms, at = _terms(text, head.end(), colon, _WITHIN) if head else _terms(text, at, colon)
        if terms is None:
            return out, at
        out.append(terms)
        more = _ELSE.match(text, at)
        if not more:
            return out, at
        at = more.end()


def _pairs(text: str) -> list[tuple[str, list[_Term]]]:
    """(name, terms) of each assignment in the order of the text. A term that is code stays only where its text is a name that is assigned."""
    out, at = [], 0
    while m := _TARGET.search(text, at):
        values, at = _values(text, m, text[m.end(1) : m.end()].strip(" \t\\\"'") == ":")
        out += [(m.start(), m[1], terms) for terms in values]
    if "--" in text or " -" in text:
        at = 0
        while m := _FLAG.search(text, at):
            terms, at = _terms(text, m.end(), True)
            if terms is not None:
                out.append((m.start(), m[1], terms))
    if "(" in text:
        at = 0
        while m := _CALL.search(text, at):
            terms, at = _terms(text, m.end(), False)
            if terms is not None:
                out.append((m.start(), m[2], terms))
    if "</" in text:
        out += [(m.start(), m[1], [_Term(m[2], m.start(2), m.end(2), True)]) for m in _TAG.finditer(text)]
    names = {name for _, name, _ in out}
    return [(name, [t for t in terms if t.quoted is not None or t.text in names]) for _, name, terms in sorted(out, key=lambda x: x[0])]


def _uses(pairs: list[tuple[str, list[_Term]]]) -> tuple[list[list[list[int]]], list[list[int]]]:
    """For each term of each assignment the nodes that its names stand for, and the successors of each node.

    Nodes are the assignments, of which a use takes the latest before it, and one node for each name that is used before it is
    assigned, which stands for all its assignments.
    """
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(pairs):
        places.setdefault(name, []).append(i)
    late: dict[str, int] = {}
    after: list[list[int]] = [[] for _ in pairs]
    of_terms = []
    for i, (_, terms) in enumerate(pairs):
        own = []
        for value, _, _, quoted in terms:
            nodes = []
            for u in [value] if not quoted and value in places else [next(filter(None, g)) for g in _USES.findall(value)]:
                at = places.get(u, [])
                k = bisect_left(at, i)
                if k:
                    nodes.append(at[k - 1])
                elif at and at != [i]:
                    if u not in late:
                        late[u] = len(after)
                        after.append(at)
                    nodes.append(late[u])
            own.append(nodes)
            after[i] += nodes
        of_terms.append(own)
    return of_terms, after


def _circles(after: list[list[int]]) -> list[list[int]]:
    """Strongly connected components, each after those that it refers to."""
    order, low, found, on = [-1] * len(after), [0] * len(after), [], [False] * len(after)
    held: list[int] = []
    n = 0
    for root in range(len(after)):
        if order[root] >= 0:
            continue
        stack = [(root, iter(after[root]))]
        order[root] = low[root] = n
        n += 1
        held.append(root)
        on[root] = True
        while stack:
            i, left = stack[-1]
            for j in left:
                if order[j] < 0:
                    order[j] = low[j] = n
                    n += 1
                    held.append(j)
                    on[j] = True
                    stack.append((j, iter(after[j])))
                    break
                if on[j]:
                    low[i] = min(low[i], order[j])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[i])
                if low[i] == order[i]:
                    own = []
                    while True:
                        j = held.pop()
                        on[j] = False
                        own.append(j)
                        if j == i:
                            break
                    found.append(own)
    return found


def literals(text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name, in time that grows with the text.

    Names that use each other in a circle share one value, made of all that any of them adds.
    """
    pairs = _pairs(text)
    weights = [name_score(name) for name, _ in pairs]
    if not any(weights):
        return []
    terms_of, after = _uses(pairs)
    value: list[_Value | None] = [None] * len(after)
    for own in _circles(after):
        inside, parts = set(own), []
        for i in sorted(own):
            if i >= len(pairs):  # a name that is used before it is assigned: the best of its values
                known = [value[j] for j in after[i] if j not in inside and value[j] is not None]
                parts += [max(known, key=_Value.score)] if known else []
                continue
            for nodes, (part, _, _, _) in zip(terms_of[i], pairs[i][1]):
                known = [value[j] for j in nodes if j not in inside and value[j] is not None]
                parts += known or ([] if nodes else [_Value(len(part), part[:HEAD], part[-1:], Counter(part))])
        shared = _Value.joined(parts) if parts else None
        for i in own:
            value[i] = shared
    scored = [(w * value[i].score(), i) for i, w in enumerate(weights) if w > 0 and value[i] is not None and value[i].size]
    found: dict[tuple[int, int], float] = {}
    reached = [False] * len(after)
    for score, root in sorted((x for x in scored if x[0] >= least), key=lambda x: -x[0]):  # the first to reach a literal has the best score
        stack = [root]
        while stack:
            i = stack.pop()
            if reached[i]:
                continue
            reached[i] = True
            if i >= len(pairs):
                stack += [j for j in after[i] if len(after[i]) == 1 or value[j] is None or not value[j].size or not value[j].placeholder()]
                continue
            for nodes, (_, start, end, _) in zip(terms_of[i], pairs[i][1]):
                if not nodes:
                    found.setdefault((start, end), score)
                stack += nodes
    return sorted((a, b, round(s, 4)) for (a, b), s in found.items())


def scan(text: str, least: float = 0.5) -> list[dict]:
    """All spans by start, then by kind; a literal within a base span is not repeated."""
    base = []
    if _KEYWORD.search(text):
        base += [(m.start(), 0, m.end(), 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end(), 1.0) for m in _HEX.finditer(text)]
    more = []
    if "=" in text or ":" in text or "(" in text or "</" in text or "-" in text:
        starts, furthest = [], []
        for x, _, y, _ in sorted(base):
            starts.append(x)
            furthest.append(max(y, furthest[-1] if furthest else 0))
        within = lambda a, b: (k := bisect_right(starts, a)) > 0 and b <= furthest[k - 1]
        more = [(a, 3, b, s) for a, b, s in literals(text, least) if not within(a, b)]
    return [{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(base + more)]


def find_secrets(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, score) for each row with an id; null and empty texts have none.

    Texts of any length are read whole, in time that grows with their size; rows that share an id are reported each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "spans": pa.array([scan(t, least) for t in batch["text"].to_pylist()], _SPANS)})

    return id_text(docs).mapInArrow(run, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the base spans and a list of all."""
    line = "transform({0}, x -> concat_ws(':', x.kind, x.start, x.end))"
    base = "filter(spans, x -> x.kind <> 'literal')"
    return found.selectExpr(
        "doc_id",
        *(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) n_{k}" for k in KINDS),
        f"sha2(array_join({line.format(base)}, ','), 256) base_sha256",
        f"array_join({line.format('spans')}, ',') spans",
    )


def redact(docs: DataFrame, least: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each found span replaced by ``mark``; n_chars follows the text. Null texts stay null."""
    schema = docs.schema

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for s in scan(text, least):
            if s["end"] > at:
                out += [text[at : max(at, s["start"])], mark]
                at = s["end"]
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array([clean(t) for t in batch["text"].to_pylist()], batch.schema.field(i).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
