"""Secret scanning by assignment-aware lexing.

Source and configuration syntax is lexed into name-literal pairs: names,
quoted keys, subscripts (`environ["TOKEN"] = ...`), annotated names
(`key: str = ...`), elements (`<token>...</token>`) and key-value
attributes; strings with escapes, triple quotes, prefixes, brackets and
calls over several lines, indented blocks, and bare words. Constants are
propagated (`key = "..."` followed by `token = key`, `"a" + b`, `+=`), and
each literal is scored by how sensitive the name is that it ends up in.
Concatenations of any number of parts are kept whole: constants share
their parts as a graph, so `a = a + a` does not grow. Fixed patterns
(assignments to well-known names, access key ids, long hexadecimal runs)
are reported as base spans and always stay; the lexer adds spans of kind
``literal``. Behind a sign and a space, as
code is written, a bare word without a digit is a name and no literal.

Positions are code points, ends exclusive. A null text counts as empty and
has no spans; an empty table gives an empty result; repeated rows are
scanned like any other, and so are rows with a null key; extra columns of
the input are ignored. Scanning is linear in the text, except that each
term of a scored concatenation costs as much as it has distinct characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # as greedy runs of 32 and more

#: Of the text turned round, what stands before an assignment: a subscript, or a name with or without quotes (and the type that some languages put behind it).
_BEFORE = re.compile(r"""[\x20\t]*+(?:gnirts[\x20\t]++)?(?:\][\x20\t]*+["']([A-Za-z0-9_.\-]++)["'][\x20\t]*+\[([\w.$]*+)|["'`]?([A-Za-z0-9_.\-]++)["'`]?)""", re.A)
#: A subscript that is a text.
_SUBSCRIPT = re.compile(r"""\[[\x20\t]*+["']([A-Za-z0-9_.\-]++)["'][\x20\t]*+\]""", re.A)
_ASSIGNS = re.compile(r"\+=|\?=|:=|=>|(?<![=!<>~:+*/%&|^-])=(?![=~])|:(?![:/=])")
_TYPE = re.compile(r"[\x20\t]*+(?:[&*]|mut\b)*+[A-Za-z_][\w.]*+(?:\[[^\]\n=]*+\]|<[^<>\n=]*+>)?\??(?:[\x20\t]*+\|[\x20\t]*+None)?[\x20\t]*+=(?![=>~])", re.A)
_ALONG, _OVER = re.compile(r"(?:[\x20\t]|\\\n)*+"), re.compile(r"(?:\s|\\\n|#[^\n]*+|//[^\n]*+)*+")
_STRING = re.compile(
    r"""(?:[rRbBuUfF]{1,2}(?=["']))?(?:\"\"\"((?:[^"\\]|\\.|"(?!""))*+)\"\"\"|\'\'\'((?:[^'\\]|\\.|'(?!''))*+)\'\'\'|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""", re.S
)
_WORD = re.compile(r"[A-Za-z_$][\w.$]*+", re.A)
_BARE = re.compile(r"[A-Za-z0-9_+/.=@:~$%^&*!?-]++")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token)[\x20\t]++(?=[A-Za-z0-9])")
_JOIN, _ELSE = re.compile(r"\+(?!=)|\.(?=[\x20\t]*+[\"'$])"), re.compile(r",|\|\||\?\?|or\b|if\b|else\b")
_METHOD = re.compile(r"\.[A-Za-z_]\w*+\(", re.A)
_KEY = re.compile(r"[\x20\t]*+(?:=(?!=)|:(?![:/=])|:=|=>|\+=)")
_FOLDED = re.compile(r"[|>][+-]?[\x20\t]*+\n(?=([\x20\t]++))")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>([^<>]++)</", re.A)
_ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*+=\s*+["']([^"'<>\n]++)["']\s++value\s*+=\s*+["']([^"'<>\n]++)["']""", re.A)
_SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?(?![a-z])|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!or(?!iz))", re.I | re.A)

#: A literal is reported from this score on.
MIN_SCORE = 0.6


#: Longest placeholder word, less one: what can lie on either side of a seam.
_SEAM = 10
_WORDS = re.compile(r"example|changeme|placeholder|your[_-]", re.I | re.A)
#: Numbers of characters above this are kept as floats, with a power of two apart.
_HUGE = 2**500


class Literal:
    """What the score of a literal needs to know: its text is never built.

    Characters are counted in units of 2**power, which is 0 up to _HUGE characters.
    """

    __slots__ = ("counts", "size", "power", "head", "tail", "marked")

    def __init__(self, text: str = ""):
        self.counts, self.size, self.power = Counter(text), len(text), 0
        self.head, self.tail, self.marked = text[:_SEAM], text[-_SEAM:], bool(_WORDS.search(text))

    @classmethod
    def joined(cls, parts: list[Literal]) -> Literal:
        out = cls()
        out.power = max(p.power for p in parts)
        for p in parts:
            unit = 1 if p.power == out.power else 0.5 ** (out.power - p.power)
            for c, n in p.counts.items():
                out.counts[c] += n * unit
            out.size += p.size * unit
            out.marked = out.marked or p.marked or bool(_WORDS.search(out.tail + p.head))
            out.head, out.tail = (out.head + p.head)[:_SEAM], (out.tail + p.tail)[-_SEAM:]
            if out.size > _HUGE:
                out.counts = Counter({c: n / _HUGE for c, n in out.counts.items()})
                out.size, out.power = out.size / _HUGE, out.power + 500
        return out

    def entropy(self) -> float:
        """Bits a character."""
        return -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values() if n / self.size) if self.size else 0.0

    def placeholder(self) -> bool:
        kinds = self.counts.keys()
        return self.marked or kinds <= {"x", "X"} or kinds <= {"*"} or self.head[:1] == "<" and self.tail[-1:] == ">" or self.head.startswith("${")

    def score(self) -> float:
        """If it is assigned to a sensitive name, from 0 to 1."""
        if not self.power and self.size < 8:
            return 0.0
        s = 0.5 + 0.2 * any(c in self.counts for c in "0123456789") + min(0.3, self.entropy() / 15)
        return max(0.0, s - 0.5 * self.placeholder() - 0.3 * (" " in self.counts))


def score(name: str, literal: str) -> float:
    """Of a literal that is assigned to name, from 0 to 1."""
    return Literal(literal).score() if _SENSITIVE.search(name) else 0.0


class Lexer:
    """Name-literal pairs of a text in one pass, constants propagated.

    Nodes have a span, or else the nodes before them that they join; assigned holds (name, node) of each assignment.
    """

    def __init__(self, text: str):
        self.text, self.turned = text, text[::-1]
        self.nodes: list[tuple[tuple[int, int] | None, list[int]]] = []
        self.assigned: list[tuple[str, int]] = []
        self.known: dict[str, int] = {}

    def run(self) -> Lexer:
        if "=" in self.text or ":" in self.text:
            at = 0
            while m := _ASSIGNS.search(self.text, at):
                at = m.end()
                if found := self.name_before(m.start()):
                    at = self.assign(*found, m.group(), at)
        if "</" in self.text:
            for m in _ELEMENT.finditer(self.text):
                self.markup(m)
        if "value" in self.text:
            for m in _ATTRIBUTES.finditer(self.text):
                self.markup(m)
        return self

    def markup(self, m: re.Match) -> None:
        inner = m.group(2)
        if word := inner.strip():
            begin = m.start(2) + len(inner) - len(inner.lstrip())
            self.assigned.append((m.group(1), self.part(begin, begin + len(word))))

    def part(self, start: int, end: int) -> int:
        self.nodes.append(((start, end), []))
        return len(self.nodes) - 1

    def name_before(self, at: int) -> tuple[str, str] | None:
        """The name that is assigned to, and the constant that this makes known: the name, or a subscript with what it is of."""
        m = _BEFORE.match(self.turned, len(self.text) - at)
        name = m and (m.group(1) or m.group(3))[::-1].lstrip("-.0123456789")
        return (name, f"{m.group(2)[::-1]}[{m.group(1)[::-1]}]" if m.group(1) else name) if name else None

    def assign(self, name: str, slot: str, op: str, at: int) -> int:
        """Reads the value behind an assignment; where the search for further ones goes on."""
        text = self.text
        if op == ":" and (m := _TYPE.match(text, at)):
            op, at = "=", m.end()
        if op == ":" and (m := _FOLDED.match(text, _ALONG.match(text, at).end())):
            found, at = self.folded(m)
        else:
            found, at = self.value(at, code=op != ":" and text[at : at + 1] == " ")
        if op == "+=" and found and slot in self.known:
            found[0].insert(0, self.known[slot])
        for parts in found:
            if len(parts) > 1:
                self.nodes.append((None, parts))
            node = len(self.nodes) - 1 if len(parts) > 1 else parts[0]
            self.assigned.append((name, node))
        if len(found) == 1:
            self.known[slot] = self.assigned[-1][1]
        else:
            self.known.pop(slot, None)
        return at

    def folded(self, m: re.Match) -> tuple[list[list[int]], int]:
        """The lines of an indented block."""
        at, parts = m.end(), []
        while self.text.startswith(m.group(1), at):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            line = self.text[at:end].strip()
            if line:
                begin = at + len(self.text[at:end]) - len(self.text[at:end].lstrip())
                parts.append(self.part(begin, begin + len(line)))
            at = end + 1
        return ([parts] if parts else []), min(at, len(self.text))

    def value(self, at: int, code: bool) -> tuple[list[list[int]], int]:
        """The literals of an expression, each as its parts, and where it ends; an assignment inside ends it too.

        Terms are strings, constants known by name, and bare words; `+`, `.` and nothing between strings join
        them; brackets, calls and commas within them, and alternatives, hold literals of their own. In code a bare word without a digit is a name.
        """
        text, depth, due = self.text, 0, True
        found: list[list[int]] = [[]]
        at = _ALONG.match(text, at).end()
        if m := _SCHEME.match(text, at):
            at = m.end()
        while True:
            here = (_OVER if depth else _ALONG).match(text, at).end()
            c = text[here : here + 1]
            if m := _STRING.match(text, here):
                if depth and _KEY.match(text, m.end()):
                    break
                if m.end(m.lastindex) > m.start(m.lastindex):
                    found[-1].append(self.part(m.start(m.lastindex), m.end(m.lastindex)))
                at, due = m.end(), False
            elif c and c in "([" and due:
                depth, at = depth + 1, here + 1
            elif c and c in ")]" and depth:
                depth, at, due = depth - 1, here + 1, False
            elif due:
                m = _WORD.match(text, here)
                if m and depth and _KEY.match(text, m.end()):
                    break
                after = text[m.end() : m.end() + 1] if m else ""
                if m and (inside := _SUBSCRIPT.match(text, m.end())) and (slot := f"{m.group()}[{inside.group(1)}]") in self.known:
                    found[-1].append(self.known[slot])
                    at, due = inside.end(), False
                elif m and after == "(" or m and after == "[":
                    depth, at = depth + 1, m.end() + 1
                elif m and m.group() in self.known and not (after and _BARE.match(after)):
                    found[-1].append(self.known[m.group()])
                    at, due = m.end(), False
                elif m and depth:
                    at, due = m.end(), False
                elif not depth and (bare := _BARE.match(text, here)):
                    if not code or not (m and m.end() == bare.end()) or any(x.isdigit() for x in bare.group()):
                        found[-1].append(self.part(here, bare.end()))
                    at, due = bare.end(), False
                else:
                    break
            elif m := _JOIN.match(text, here):
                at, due = m.end(), True
            elif (m := _METHOD.match(text, here)) or (m := _ELSE.match(text, here)) and (depth or m.group() != ","):
                depth += m.group()[-1] == "("
                found.append([])
                at, due = m.end(), True
            else:
                break
        return [parts for parts in found if parts], at


def lex(text: str) -> tuple[list[tuple[tuple[int, int] | None, list[int]]], list[tuple[str, int]]]:
    """Nodes and (name, node) of each assignment."""
    lexer = Lexer(text).run()
    return lexer.nodes, lexer.assigned


def _reached(nodes: list, top: int, seen: set[int]) -> Iterator[int]:
    """The nodes that top consists of, without those seen before."""
    left = [top]
    while left:
        k = left.pop()
        if k not in seen:
            seen.add(k)
            yield k
            left += nodes[k][1]


def literals(text: str) -> dict[tuple[int, int], float]:
    """The score of each span that is part of a literal reported: the best one of the literals it is in."""
    nodes, assigned = lex(text)
    wanted = {k for name, k in assigned if _SENSITIVE.search(name)}
    seen: set[int] = set()
    order = sorted(k for top in wanted for k in _reached(nodes, top, seen))
    last = {part: k for k in order for part in nodes[k][1]}
    known: dict[int, Literal] = {}
    scores = []
    for k in order:  # parts come before what joins them
        span, parts = nodes[k]
        known[k] = Literal(text[slice(*span)]) if span else Literal.joined([known[p] for p in parts])
        if k in wanted and (s := known[k].score()) >= MIN_SCORE:
            scores.append((s, k))
        for p in {*parts, k}:
            if last.get(p, k) == k:
                del known[p]
    best: dict[tuple[int, int], float] = {}
    seen = set()
    for s, top in sorted(scores, reverse=True):
        best |= {nodes[k][0]: s for k in _reached(nodes, top, seen) if nodes[k][0]}
    return best


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans by start, then kind as in KINDS, then end."""
    text = text or ""
    found = [("assign", m.start(), m.end(), 1.0) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    found += [("access", m.start(), m.end(), 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), 1.0) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text:
        found += [("literal", a, b, round(s, 4)) for (a, b), s in literals(text).items()]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans: array of (kind, start, end, score)."""
    kind = df.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    names = ("kind", "start", "end", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            spans = [[dict(zip(names, s, strict=True)) for s in scan(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span))], [key, "spans"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>")
