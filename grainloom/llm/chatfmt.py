"""Chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constant
parts are folded, and Python closures are generated that render
conversations piece by piece. The language has text, ``{{ expression }}``,
``{% for m in messages %}``, ``{% if %}``/``{% elif %}``/``{% else %}`` and
``{% generation %}``, which marks what a model is trained to say.
Expressions are names, fields of messages, strings, ``+``, ``==``,
``!=``, ``and``, ``or``, ``not`` and the filters ``escape``, ``trim``,
``lower`` and ``upper``; nothing else can be reached.

``escape`` writes a mark behind each character that may start a control
string, so that no control string stands inside a text, and unescape()
gives back the text exactly.

Defined cases: a null role or text is the empty string; turns are ordered
by turn (null first), then role, then text, so ties and repeated rows have
one order, and all of them stay; a null conversation id is a conversation
of its own; an empty table gives an empty result; a comparison that is
shown is ``true`` or ``false``; extra columns are ignored. Long conversations are written as
several consecutive parts, so no row holds an unbounded number of turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\\"
_OPENERS = re.compile(r"[<\[\\]")
_ESCAPED = re.compile(r"([<\[\\])\\")


def escape(text: str) -> str:
    return _OPENERS.sub(lambda m: m.group() + MARK, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: The production template. Control strings start with < or [, which no escaped text holds unmarked.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.first %}<s>{% endif %}"
    "<|turn|>{{ m.role | escape }}<|says|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</s>"
    "{% endfor %}"
)

# Syntax tree


@dataclass
class Node:
    kind: str
    value: object = None
    parts: list = field(default_factory=list)


class TemplateError(ValueError):
    """The template is not of the language."""


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEXEMES = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_][A-Za-z0-9_]*)|(==|!=|[.|+()]))")
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "lower": str.lower, "upper": str.upper}
FIELDS = ("role", "text", "first")


class Parser:
    """Of one template: tags first, then the expressions in them."""

    def __init__(self, source: str):
        self.tags: list[tuple[str, str]] = []
        at = 0
        for m in _TAGS.finditer(source):
            if m.start() > at:
                self.tags.append(("text", source[at : m.start()]))
            self.tags.append(("expr", m.group(1)) if m.group(1) is not None else ("tag", m.group(2).strip()))
            at = m.end()
        if at < len(source):
            self.tags.append(("text", source[at:]))
        self.at = 0

    def parse(self) -> Node:
        body = self.block(())
        if self.at < len(self.tags):
            raise TemplateError(f"unexpected {self.tags[self.at][1]!r}")
        return body

    def block(self, ends: tuple[str, ...]) -> Node:
        out = Node("block")
        while self.at < len(self.tags):
            kind, s = self.tags[self.at]
            word = s.split()[0] if kind == "tag" and s else ""
            if kind == "tag" and word in ends:
                return out
            self.at += 1
            if kind == "text":
                out.parts.append(Node("const", s))
            elif kind == "expr":
                out.parts.append(Node("show", None, [self.expression(s)]))
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", s)
                if not m:
                    raise TemplateError(f"{s!r}: only messages can be looped over")
                out.parts.append(Node("for", m.group(1), [self.block(("endfor",))]))
                self.close("endfor")
            elif word == "if":
                out.parts.append(self.choice(s[2:]))
            elif word == "generation":
                out.parts.append(Node("generation", None, [self.block(("endgeneration",))]))
                self.close("endgeneration")
            else:
                raise TemplateError(f"unknown tag {s!r}")
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out

    def close(self, word: str) -> None:
        if self.at >= len(self.tags) or self.tags[self.at] != ("tag", word):
            raise TemplateError(f"missing {word}")
        self.at += 1

    def choice(self, test: str) -> Node:
        node = Node("if", None, [self.expression(test), self.block(("elif", "else", "endif")), Node("block")])
        kind, s = self.tags[self.at]
        self.at += 1
        if s.startswith("elif"):
            node.parts[2] = Node("block", None, [self.choice(s[4:])])
        elif s == "else":
            node.parts[2] = self.block(("endif",))
            self.close("endif")
        return node

    def expression(self, s: str) -> Node:
        words, at = [], 0
        s = s.strip()
        while at < len(s):
            m = _LEXEMES.match(s, at)
            if not m:
                raise TemplateError(f"cannot read {s[at:]!r}")
            words.append((("str", "name", "op")[m.lastindex - 1], m.group(m.lastindex)))
            at = m.end()
        left = self._either(words)
        if words:
            raise TemplateError(f"unexpected {words[0][1]!r} in {s!r}")
        return left

    def _infix(self, words: list, ops: tuple[str, ...], below: Callable[[list], Node]) -> Node:
        left = below(words)
        while words and words[0][1] in ops and words[0][0] != "str":
            op = words.pop(0)[1]
            left = Node("op", op, [left, below(words)])
        return left

    def _either(self, words: list) -> Node:
        return self._infix(words, ("or",), lambda w: self._infix(w, ("and",), self._negated))

    def _negated(self, words: list) -> Node:
        if words and words[0] == ("name", "not"):
            words.pop(0)
            return Node("op", "not", [self._negated(words)])
        return self._infix(words, ("==", "!="), lambda w: self._infix(w, ("+",), self._filtered))

    def _filtered(self, words: list) -> Node:
        node = self._atom(words)
        while words and words[0] == ("op", "|"):
            words.pop(0)
            name = words.pop(0)[1] if words else ""
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = Node("filter", name, [node])
        return node

    def _atom(self, words: list) -> Node:
        if not words:
            raise TemplateError("an expression ends early")
        kind, s = words.pop(0)
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", r"\1", s[1:-1], flags=re.S))
        if (kind, s) == ("op", "("):
            node = self._either(words)
            if not words or words.pop(0) != ("op", ")"):
                raise TemplateError("missing )")
            return node
        if kind == "name" and len(words) >= 2 and words[0] == ("op", "."):
            words.pop(0)
            name = words.pop(0)[1]
            if name not in FIELDS:
                raise TemplateError(f"messages have no {name!r}")
            return Node("field", (s, name))
        raise TemplateError(f"unexpected {s!r}")


def fold(n: Node) -> Node:
    """Computes what is constant, drops branches that cannot run, and joins neighbouring constants."""
    n = Node(n.kind, n.value, [fold(p) for p in n.parts])
    const = [p.value for p in n.parts if p.kind == "const"]
    if n.kind == "filter" and const:
        return Node("const", FILTERS[n.value](const[0]))
    if n.kind == "op" and len(const) == len(n.parts):
        return Node("const", _apply(n.value, *const))
    if n.kind == "show" and const:
        return Node("const", shown(const[0]))
    if n.kind == "if" and n.parts[0].kind == "const":
        return n.parts[1] if n.parts[0].value else n.parts[2]
    if n.kind == "block":
        flat: list[Node] = []
        for p in n.parts:
            for q in p.parts if p.kind == "block" else [p]:
                if q.kind == "const" and flat and flat[-1].kind == "const":
                    flat[-1] = Node("const", flat[-1].value + q.value)
                elif q.kind != "const" or q.value:
                    flat.append(q)
        n.parts = flat
    return n


def shown(v: str | bool) -> str:
    """What an expression puts out: comparisons are true or false."""
    return v if isinstance(v, str) else str(v).lower()


def _apply(op: str, *x):
    return {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}[op](*x)


# Closures: each takes the names in scope and yields (piece, is it generated)


def _value(n: Node) -> Callable[[dict], object]:
    if n.kind == "const":
        return lambda scope, v=n.value: v
    if n.kind == "field":
        name, part = n.value
        return lambda scope: scope[name][part]
    inner = [_value(p) for p in n.parts]
    if n.kind == "filter":
        f, one = FILTERS[n.value], inner[0]
        return lambda scope: f(one(scope))
    if n.value == "and":
        return lambda scope: inner[0](scope) and inner[1](scope)
    if n.value == "or":
        return lambda scope: inner[0](scope) or inner[1](scope)
    return lambda scope, op=n.value: _apply(op, *(f(scope) for f in inner))


def _pieces(n: Node, generated: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    if n.kind == "const":
        piece = (n.value, generated)
        return lambda scope: iter((piece,))
    if n.kind == "show":
        value = _value(n.parts[0])
        return lambda scope: iter(((shown(value(scope)), generated),))
    if n.kind == "if":
        test, yes, no = _value(n.parts[0]), _pieces(n.parts[1], generated), _pieces(n.parts[2], generated)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if n.kind == "generation":
        return _pieces(n.parts[0], True)
    if n.kind == "for":
        body, name = _pieces(n.parts[0], generated), n.value

        def loop(scope: dict) -> Iterator[tuple[str, bool]]:
            for m in scope["messages"]:
                yield from body(scope | {name: m})

        return loop
    steps = [_pieces(p, generated) for p in n.parts]

    def block(scope: dict) -> Iterator[tuple[str, bool]]:
        for f in steps:
            yield from f(scope)

    return block


def compiled(source: str) -> Callable[[Iterator[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to their formatted text and the spans (start, end) under generation markers."""
    run = _pieces(fold(Parser(source).parse()))

    def render(messages) -> tuple[str, list[tuple[int, int]]]:
        out, spans, at = [], [], 0
        for piece, generated in run({"messages": messages}):
            out.append(piece)
            if generated:
                spans.append((at, at + len(piece)))
            at += len(piece)
        return "".join(out), spans

    return render


#: Turns of one part of a conversation's output.
PART_TURNS = 256


def format_conversations(df: DataFrame, template: str = TEMPLATE, key: str = "conv_id") -> DataFrame:
    """key, part, formatted and loss (array of start and end within the part), parts of a conversation in order in one partition."""
    Parser(template).parse()
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, "turn", "role", "text")
    ordered = rows.repartition(F.col(key)).sortWithinPartitions(key, "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        now, part, turns, begun = None, 0, [], False
        out: list[tuple] = []

        def flush() -> None:
            nonlocal part, turns
            if turns:
                text, spans = render(turns)
                out.append((now, part, text, spans))
                part, turns = part + 1, []

        def batch() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], key_type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.string()),
                 pa.array([[{"start": a, "end": e} for a, e in o[3]] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                [key, "part", "formatted", "loss"],
            )
            out.clear()
            return b

        key_type = None
        for b in batches:
            key_type = b.column(0).type
            for k, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not begun or k != now:
                    flush()
                    now, part, begun = k, 0, True
                turns.append({"role": role or "", "text": text or "", "first": part == 0 and not turns})
                if len(turns) >= PART_TURNS:
                    flush()
            if out:
                yield batch()
        flush()
        if out:
            yield batch()

    return ordered.mapInArrow(run, f"`{key}` {kind}, part int, formatted string, loss array<struct<start: bigint, end: bigint>>")


_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)</s>", re.S)


def read_back(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and digests of what the output of format_conversations (production template) says, read from the formatted text and its loss spans alone."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def done() -> tuple:
            k, n, turns, chars, loss, size = state
            return k, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        key_type = None
        for b in batches:
            key_type, rows = b.column(0).type, []
            for k, part, text, loss in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    if state:
                        rows.append(done())
                    state = [k, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _TURN.finditer(text):
                    state[1] += 1
                    state[2].update(f"{unescape(m.group(1))}\n{unescape(m.group(2))}\n".encode("utf-8", "surrogatepass"))
                for s in loss:
                    said = unescape(text[s["start"] : s["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if rows:
                yield batch(rows)
        if state:
            yield batch([done()])

    return df.select(key, "part", "formatted", "loss").mapInArrow(run, f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
