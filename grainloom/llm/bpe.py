"""BPE encoding and decoding with tree concatenation for long unsplit text.

A text is cut into pre-tokens as the tokenizer's own rules cut it; equal
pre-tokens encode alike, so each worker keeps what it has encoded. Text
that the rules leave unsplit for long (a run of letters without an end)
is halved down to leaves, the leaves are encoded in parallel, and halves
are joined bottom-up: a window around the join is encoded anew and grown
until its first token is the left half's and its last token the right
half's own. Then each adjacent pair of tokens also stands in one genuine
encoding, which makes the whole the encoding of the joined text.

Defined cases: a null text encodes as the empty one; special tokens in a
text are recognised as the tokenizer itself does; repeated rows are
encoded like any other; an empty table gives an empty result; extra
columns are ignored. No text is cut short.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, slim

#: Unsplit text from this length on is encoded by tree concatenation.
LONG = 4096
#: Length of a leaf of the tree.
LEAF = 1024
#: Pre-tokens that a worker remembers.
CACHE = 90_000

_CHARS = "a-zß-öø-ÿ"
#: Text of these characters is cut here, other text by the tokenizer itself: ASCII and Latin-1 letters have no composition or irregular lower case.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*+")
_PRE = re.compile(rf"[{_CHARS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s0-9{_CHARS}]+")
_CHUNK = re.compile(r"[^\t\n\r ]+")


class TreeBpe:
    """A BPE model with word ends, and the pieces around it."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, cache: int = CACHE):
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        spec = json.loads(self.whole.to_str())
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        #: Encodes text that goes on (no word end), and text that ends its word.
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.final = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix))
        self.long, self.leaf, self.limit = long, leaf, cache
        self.model = self.final.model
        self.known: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte alphabet: other bytes go to 256 and on
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    # Tree concatenation

    def leaves(self, s: str) -> list[list[str]]:
        """The tokens of the leaves of s, encoded in parallel."""
        cuts = [s[i : i + self.leaf] for i in range(0, len(s), self.leaf)]
        out = [e.tokens for e in self.inner.encode_batch(cuts[:-1], add_special_tokens=False)] if len(cuts) > 1 else []
        return [*out, self.final.encode(cuts[-1], add_special_tokens=False).tokens]

    def join(self, left: list[str], right: list[str], ends: bool) -> list[str]:
        """The encoding of the text of left and right; ends: right ends the word."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            last = ends and k >= len(right)
            text = "".join(a) + "".join(b)
            text = text[: -len(self.suffix)] if last and self.suffix else text
            new = (self.final if last else self.inner).encode(text, add_special_tokens=False).tokens
            if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
                return left[:-k] + new + right[k:]
            k *= 2

    def tree(self, s: str) -> list[str]:
        """The tokens of one pre-token, in the tokenizer's byte alphabet."""
        parts = self.leaves(s)
        while len(parts) > 1:
            up = [self.join(parts[i], parts[i + 1], i + 2 == len(parts)) for i in range(0, len(parts) - 1, 2)]
            parts = up + parts[len(up) * 2 :]
        return parts[0]

    # Texts

    def slowly(self, chunk: str) -> list[str]:
        """The tokens of any text without cached parts."""
        if len(chunk) < self.long:
            return self.whole.encode(chunk, add_special_tokens=False).tokens
        out, at = [], 0
        for m in [*self.split_special.finditer(chunk), None]:
            plain = chunk[at : m.start() if m else None]
            for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(plain)) if plain else ():
                out += self.tree(piece)
            if m:
                out.append(m.group())
                at = m.end()
        return [e for e in out if e[0]]

    def entry(self, tokens: list[str]) -> tuple[int, str, str]:
        return len(tokens), " ".join(str(self.vocab[t]) for t in tokens), " ".join(tokens)

    def learn(self, word: str) -> tuple[int, str, str]:
        """Encodes one pre-token in lower case, and remembers it."""
        if len(word) < self.long:
            alike = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            got = self.model.tokenize(alike)
            e = len(got), " ".join([str(t.id) for t in got]), " ".join([t.value for t in got])
        else:
            e = self.entry(self.slowly(word))
        if len(self.known) >= self.limit:
            self.known.clear()
        self.known[word] = e
        return e

    def chunk(self, raw: str) -> tuple[int, str, str]:
        """Encodes text without white space, and remembers it if it is short."""
        if _PLAIN.fullmatch(raw) and "<|" not in raw:
            parts = [self.known.get(w) or self.learn(w) for w in _PRE.findall(raw.lower())]
            n, ids, tokens = zip(*parts, strict=True) if len(parts) != 1 else ([parts[0][0]], parts[0][1:2], parts[0][2:])
            e = sum(n), " ".join(ids), " ".join(tokens)
        else:
            e = self.entry(self.slowly(raw))
        if len(raw) < 64:
            if len(self.chunks) >= self.limit:
                self.chunks.clear()
            self.chunks[raw] = e
        return e

    def encode(self, text: str | None) -> list[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, tokens joined by spaces) of each part of the text, no part empty."""
        chunks = self.chunks
        out = [chunks.get(raw) or self.chunk(raw) for raw in _CHUNK.findall(text or "")]
        return [e for e in out if e[0]]

    def forget(self) -> None:
        """Frees what is remembered, so that a worker that goes on to other tasks does not hold it."""
        self.known.clear()
        self.chunks.clear()

    def decode(self, ids: list[int]) -> str:
        """As the tokenizer without a decoder does: its tokens joined by spaces."""
        return self.whole.decode(ids, skip_special_tokens=False)


_BUILT: dict[str, TreeBpe] = {}


def tokenizer(path: str) -> TreeBpe:
    """One for each worker process."""
    if path not in _BUILT:
        _BUILT[path] = TreeBpe(path)
        slim()  # of the parsed file
    return _BUILT[path]




def encode_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array of int) of each text: the general form, for training shards."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in (s for batch in batches for s in slices(batch)):
            ids = [[int(i) for e in bpe.encode(t) for i in e[1].split(" ")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])
        bpe.forget()
        slim()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of each array of ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def digest_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass that returns digests.

    The decoded text is put together from the tokens' own strings, as decode() does, part by part.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in (s for batch in batches for s in slices(batch)):
            n, ids, decoded = [], [], []
            for t in b.column(1).to_pylist():
                counts, numbers, tokens = zip(*parts, strict=True) if (parts := bpe.encode(t)) else ((), (), ())
                n.append(sum(counts))
                ids.append(hashlib.sha256(" ".join(numbers).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()
        slim()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
