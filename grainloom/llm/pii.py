"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Only SQL functions. Java's matcher gives no positions in SQL, so a pattern
both splits the text into gaps and extracts its matches, and running sums
of the lengths of gaps and matches are the positions. Each pattern is
written so that matching is linear: runs are possessive and start only at
their left end (or where the match before ended), which finds the same
leftmost non-overlapping matches. Running sums take a logarithmic number
of passes and texts are cut through chunks, so the cost is close to linear
in the text however many spans it holds.

Sure kinds: email, ip (parts to 255), card (16 to 19 digits, Luhn), phone
(8 to 15 digits after a plus) and iban (its country's length, mod 97).
Weak kinds: national (a telephone number of 3, 3 and 4 digits) and ssn
(3, 2 and 4 digits). A span's score starts with its kind's; it rises when
words of its kind stand near, and falls when words stand near that name
something else. Near is what lies within NEAR code points, but not beyond
the next match of the kind. Weak kinds are found only with a score of
MIN_SCORE, that is, by their context; sure kinds are always found, and
redaction leaves those below MIN_SCORE alone.

Positions are code points, ends exclusive. A null text counts as empty and
has no spans; an empty table gives an empty result; repeated rows are
scanned like any other; rows with a null key are scanned too; overlapping
spans of different kinds all stay, and redacted() merges them; extra
columns are ignored. Texts are used whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on each side of a span that count as near.
NEAR = 48
#: What a weak span needs to be found, and any span to be redacted.
MIN_SCORE = 0.5
#: Added for words of the kind nearby, taken away for words of something else.
RISE, FALL = 0.2, 0.3
#: Code points that a text is cut into before pieces are taken from it.
CHUNK = 1024

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_SPAN = "struct<kind: string, start: bigint, end: bigint, score: double>"

#: Lengths of account numbers by country, as registered.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


def iban_body() -> str:
    """The part of the pattern that knows each country's length."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))


def let(value: str, name: str, use: str) -> str:
    """use, with value computed once under a name."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def running(values: str, join: str) -> str:
    """Running sums (or other folds) of an array: each pass joins every value with that half as far again before it; join is of p (before) and q."""
    step = f"transform(acc, (q, i) -> if(i >= shiftleft(1, k), {join.format(p='get(acc, i - shiftleft(1, k))', q='q')}, q))"
    passes = "slice(sequence(0, 31), 1, cast(ceil(log2(greatest(size(vs), 1))) as int))"
    return let(values, "vs", f"aggregate({passes}, vs, (acc, k) -> {step})")


def literal(pattern: str) -> str:
    """A pattern (without quotes) as SQL."""
    return f"r'{pattern}'"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(v: str) -> str:
    """Whether the digits of v pass Luhn's check."""
    digit = "(ascii(substring(d, length(d) - i + 1, 1)) - 48)"
    add = f"acc + case when i % 2 = 1 then {digit} when {digit} > 4 then 2 * {digit} - 9 else 2 * {digit} end"
    return let(_digits(v), "d", f"aggregate(sequence(1, length(d)), 0, (acc, i) -> {add}) % 10 = 0")


def mod97(v: str) -> str:
    """Whether v, without spaces and with its first four characters last, is 1 modulo 97."""
    add = "if(ascii(substring(s, i, 1)) < 58, acc * 10 + ascii(substring(s, i, 1)) - 48, acc * 100 + ascii(substring(s, i, 1)) - 55) % 97"
    return let(f"replace({v}, ' ', '')", "s", f"aggregate(concat(sequence(5, length(s)), sequence(1, 4)), 0, (acc, i) -> {add}) = 1")


@dataclass(frozen=True)
class Kind:
    """pattern: linear form; may: cheap test that any text t with a match passes; ok: what a match v must pass; words raise the score, against lowers it."""

    name: str
    pattern: str
    may: str
    ok: str
    score: float
    words: str
    against: str


_LEFT, _RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "contains({t}, '@')", "true", 0.8, "mail|contact|write to", "example|noreply"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"{t} rlike r'[0-9]\.[0-9]++\.[0-9]'", f"x.v rlike {literal(rf'^{_OCTET}(?:\.{_OCTET}){{3}}$')}", 0.6, "host|server|address|login|from", "version|release"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15}(?:[\x20-]?[0-9])*+", r"{t} rlike r'[0-9](?:[\x20-]?[0-9]){{15}}'", f"length({_digits('x.v')}) <= 19 and {luhn('x.v')}", 0.8, "card|visa|credit|debit|payment|expir|cvv", "tracking|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", f"length({_digits('x.v')}) between 8 and 15", 0.8, "phone|tel|call|mobile|fax|whatsapp", "formula|equation"),
    Kind("iban", rf"{_LEFT}(?:{iban_body()}){_RIGHT}", "{t} rlike '[A-Z]{{2}}[0-9]{{2}}'", mod97("x.v"), 0.8, "iban|account|bank|transfer|konto", "part|serial"),
    Kind("national", rf"{_LEFT}[0-9]{{3}}[\x20.-][0-9]{{3}}[\x20.-][0-9]{{4}}{_RIGHT}", r"{t} rlike r'[0-9]{{3}}[\x20.-][0-9]{{4}}'", "true", 0.4, "phone|tel|call|mobile|fax|whatsapp", "part|serial"),
    Kind("ssn", rf"{_LEFT}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_RIGHT}", "{t} rlike '[0-9]-[0-9]{{2}}-[0-9]{{4}}'", "true", 0.4, "social|ssn|security", "part|serial"),
)
#: Kinds that are found whatever their score.
SURE = ("email", "ip", "card", "phone", "iban")


def spans_of_kind(text: str, k: Kind) -> str:
    """array of (kind, start, end, score) of the matches that pass, by start."""
    sizes = "transform(m.vs, (v, i) -> cast(length(get(m.gaps, i)) + length(v) as bigint))"
    placed = let(running(sizes, "{p} + {q}"), "e", "transform(m.vs, (v, i) -> named_struct('v', v, 'gap', get(m.gaps, i), 'next', get(m.gaps, i + 1), 'e', get(e, i)))")
    matches = let(f"named_struct('gaps', split({text}, {literal(k.pattern)}, -1), 'vs', regexp_extract_all({text}, {literal(k.pattern)}, 0))", "m", placed)
    near = f"translate(concat(right(x.gap, {NEAR}), ' ', left(x.next, {NEAR})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    score = let(near, "c", f"round({k.score}D + if(c rlike '{k.words}', {RISE}D, 0D) - if(c rlike '{k.against}', {FALL}D, 0D), 1)")
    span = f"named_struct('kind', '{k.name}', 'start', x.e - length(x.v), 'end', x.e, 'score', {score})"
    spans = f"transform(filter({matches}, x -> {k.ok}), x -> {span})"
    spans = spans if k.name in SURE else f"filter({spans}, s -> s.score >= {MIN_SCORE}D)"
    return f"if({k.may.format(t=text)}, {spans}, cast(array() as array<{_SPAN}>))"


def spans_of(text: str) -> str:
    """SQL of all spans of a text (a column that is not null): by kind as in KINDS, then start."""
    return f"concat({', '.join(spans_of_kind(text, k) for k in KINDS)})"


def find_personal(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans: array of (kind, start, end, score)."""
    return df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(key, F.expr(spans_of("_t")).alias("spans"))


def _cut(start: str, end: str) -> str:
    """Code points start to end of a text in chunks x.cs: only the chunks that hold them are read."""
    inside = f"substring(c, cast(greatest(w.a - (w.f + i) * {CHUNK}, 0) + 1 as int), cast(least(w.b - (w.f + i) * {CHUNK}, {CHUNK}) - greatest(w.a - (w.f + i) * {CHUNK}, 0) as int))"
    pieces = f"transform(slice(x.cs, w.f + 1, cast((w.b - 1) div {CHUNK} as int) - w.f + 1), (c, i) -> if(w.a <= (w.f + i) * {CHUNK} and w.b >= (w.f + i + 1) * {CHUNK}, c, {inside}))"
    return let(f"named_struct('a', {start}, 'b', {end}, 'f', cast(({start}) div {CHUNK} as int))", "w", f"if(w.b > w.a, array_join({pieces}, ''), '')")


def redacted(text: str, spans: str, min_score: float = MIN_SCORE) -> Column:
    """text with each span of min_score or more (overlapping ones together, under the first one's name) replaced by its kind in brackets; both are SQL."""
    ordered = f"array_sort(transform(filter({spans}, s -> s.score >= {min_score}D), s -> named_struct('start', s.start, 'back', -s.end, 'kind', s.kind)))"
    # r: how far the spans up to each one reach.
    piece = f"if(s.start >= if(i > 0, get(r, i - 1), 0L), concat({_cut('if(i > 0, get(r, i - 1), 0L)', 's.start')}, '[', upper(s.kind), ']'), '')"
    built = f"concat(array_join(transform(x.ss, (s, i) -> {piece}), ''), {_cut('element_at(r, -1)', f'cast(length({text}) as bigint)')})"
    whole = let(running("transform(x.ss, s -> -s.back)", "greatest({p}, {q})"), "r", built)
    chunks = f"regexp_extract_all({text}, r'(?s).{{1,{CHUNK}}}', 0)"
    return F.expr(let(ordered, "o", f"if(size(o) = 0, {text}, {let(f"named_struct('ss', o, 'cs', {chunks})", 'x', whole)})"))
