"""Alignment of two tokenizers' token sequences over the bytes of each text.

Tokens of a byte-level BPE (A) and of a sentence-piece BPE (B) cut the
same bytes. Each sequence is a bitset with a bit at every byte behind
which a token ends; the AND of both marks the shared cuts, a running
popcount of each bitset (rank) maps a cut to the number of tokens before
it, and the tokens between two shared cuts are a group. Tokens that end
together are linked. Links are counted for each pair of ids over the
corpus, and documents then get sums over their links.

Text is encoded by units: it is cut before each space that follows a plain
printable character. Neither tokenizer joins anything across such a place
(A's pre-tokens begin with it, and no piece of B holds the space's sign
behind another character, which is checked when a model is loaded), so
units encode alone as they do in the text, end in a shared cut, and what
is known about a unit is remembered. Texts with other characters than
ASCII and Latin-1 letters are one unit each. A group never reaches across
units, so a text has as many groups as shared cuts, and one link in each.

Defined cases: null and empty texts, and texts whose tokens' bytes are not
those of the text behind a space, have no tokens: zeros and an empty
groups_sha256; special tokens' strings in texts are plain text; repeated
rows count each; rows that share a key stay rows of their own; an empty
table gives an empty result; extra columns are ignored. No text is cut short.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, slim, stored

#: Units whose alignment a worker remembers, and their characters.
REMEMBERED, CHARACTERS = 300_000, 16 << 20
#: Pairs of ids whose counts are sent to the tasks at once (17 bytes each); more go in further rounds.
PAIRS = 2_000_000

#: Text that is cut into units, and the place of a cut; and spaces where no cut is made.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*+")
_PLACE = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿ]) (?=.)", re.S)
_UNCUT = ("  ", "\t ", "\n ", "\r ")
_SPACE = "▁"


def ends(lengths: np.ndarray, size: int) -> np.ndarray:
    """The bitset of token ends of tokens of these lengths, over size bytes (bit i: a token ends behind byte i)."""
    bits = np.zeros(-(-size // 64) * 64, bool)
    bits[np.cumsum(lengths) - 1] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def selected(bits: np.ndarray) -> np.ndarray:
    """The places of the set bits, in order."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def ranks(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each place: whole words by a running popcount, the last one masked."""
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    return before[word] + np.bitwise_count(bits[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)))


def shared_cuts(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From both sequences' token lengths over the same bytes: the last byte of each group, and the numbers of A's and of B's tokens up to there."""
    ea, eb = ends(a, size), ends(b, size)
    places = selected(ea & eb)
    return places, ranks(ea, places), ranks(eb, places)


class Aligner:
    """Both tokenizers, and what is known about units."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # A's alphabet: other bytes go to 256 and on
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("pieces of this model go on across a space, so texts can't be cut there")
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        #: The number of each known unit; by number: A's tokens, B's tokens, groups (-1: the bytes differ); the groups as text; where its links begin in `links`.
        self.number: dict[str, int] = {}
        self.counts = np.empty((0, 3), np.int64)
        self.shown: list[str] = []
        self.first = np.zeros(1, np.int64)
        self.links = np.empty(0, np.int64)
        self.characters = 0

    @staticmethod
    def units(text: str) -> list[str]:
        """The text's units without the space in front of each."""
        if not _PLAIN.fullmatch(text):
            return [text]
        uncut = text[0] == " " or text[-1] == " " or any(x in text for x in _UNCUT)
        return _PLACE.split(text) if uncut else text.split(" ")

    @staticmethod
    def spelled(ids: np.ndarray, n: np.ndarray, table: list[bytes], lengths: np.ndarray, whole: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the bytes of each unit's tokens (n of ids) are the unit's."""
        parts = [table[i] for i in ids.tolist()]
        upto = np.append(0, np.cumsum(n))
        if (np.append(0, np.cumsum(lengths[ids]))[upto[1:]] == np.cumsum(size)).all() and b"".join(parts) == b"".join(whole):
            return np.ones(len(whole), bool)
        return np.array([b"".join(parts[i:j]) == w for i, j, w in zip(upto[:-1], upto[1:], whole, strict=True)], bool)

    def learn(self, units: list[str]) -> None:
        """Encodes units that are not known, all at once: their bitsets are stretches of two long ones."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        whole = [b" " + u.encode() for u in units]
        n_a, n_b, size = (np.fromiter(map(len, x), np.int64, len(units)) for x in (ids_a, ids_b, whole))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        good = self.spelled(a, n_a, self.bytes_a, self.size_a, whole, size) & self.spelled(b, n_b, self.bytes_b, self.size_b, whole, size)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        size = size * good
        places, rank_a, rank_b = shared_cuts(self.size_a[a], self.size_b[b], int(size.sum()))
        upto = np.searchsorted(places, np.cumsum(size) - 1, side="right")  # groups up to the end of each unit: it is a shared cut
        n_groups = np.diff(upto, prepend=0)
        joined = lambda upto, parts, by: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), parts.cast(pa.string())), by)
        groups = pc.binary_join_element_wise(joined(rank_a, pa.array(a), ","), joined(rank_b, pa.array(b), ","), "|")
        self.shown += joined(upto, groups, ";").to_pylist()
        self.number.update(zip(units, range(len(self.counts), len(self.counts) + len(units)), strict=True))
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, np.where(good, n_groups, -1)], axis=1)])
        self.first = np.concatenate([self.first, self.first[-1] + upto])
        self.links = np.concatenate([self.links, (a[rank_a - 1] << 32) | b[rank_b - 1]])
        self.characters += sum(map(len, units))

    def align(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, groups_sha256) of each text, the links of all (A's id << 32 | B's id), and how many each text has."""
        split = [self.units(t) if t else [] for t in texts]
        if len(self.number) > REMEMBERED or self.characters > CHARACTERS:
            self.forget()
        if new := list({u: None for us in split for u in us if u not in self.number}):
            self.learn(new)
        number, shown = self.number, self.shown
        rows, numbers = [], [np.empty(0, np.int64)]
        for us in split:
            at = [number[u] for u in us]
            n = np.array(at, np.int64)
            if not at or self.counts[n, 2].min() < 0:
                rows.append((0, 0, 0, ""))
                continue
            digest = hashlib.sha256(";".join([shown[i] for i in at]).encode()).hexdigest()
            rows.append((*self.counts[n].sum(axis=0).tolist(), digest))
            numbers.append(n)
        n = np.concatenate(numbers)
        size = self.first[n + 1] - self.first[n]
        at = np.arange(int(size.sum())) + np.repeat(self.first[n] - (np.cumsum(size) - size), size)
        return rows, self.links[at], np.array([r[2] for r in rows], np.int64)


_BUILT: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    if (path_a, path_b) not in _BUILT:
        _BUILT[path_a, path_b] = Aligner(path_a, path_b)
        slim()
    return _BUILT[path_a, path_b]


def _distinct(links: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct links in order, how often it has each, and how many each text has."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((links, text))
    by, of = links[order], text[order]
    at = np.flatnonzero((np.diff(by, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
    return by[at], np.diff(np.append(at, len(by))), np.bincount(of[at], minlength=len(sizes))


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, groups_sha256, and each row's distinct links (A's id << 32 | B's id) with how often it has them: pairs, times."""
    kind = docs.schema[key].dataType.simpleString()
    columns = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for b in (s for batch in batches for s in slices(batch)):
            rows, links, sizes = both.align(b.column(1).to_pylist())
            pairs, times, each = _distinct(links, sizes)
            offsets = pa.array(np.cumsum([0, *each]), pa.int32())
            fixed = [pa.array([r[i] for r in rows]) for i in range(4)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(pairs)), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *fixed, *lists], ["key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
        both.forget()
        slim()

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {columns}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links of it in the corpus) and best (no pair of its B id has more)."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    each = stored(each.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = each.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B's vocabulary at most
    return each.join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned with what these pairs add to n_best and count_sum."""
    t = counts.orderBy("pair").toArrow()
    table = aligned.sparkSession.sparkContext.broadcast(tuple(t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = table.value
        for b in batches:
            lists, times = b.column("pairs"), b.column("times").values.to_numpy()
            wanted, ends_ = lists.values.to_numpy(), lists.offsets.to_numpy()
            at = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
            here = pair[at] == wanted
            columns = {c: b.column(c) for c in b.schema.names}
            for name, each in (("n_best", times * (here & best[at])), ("count_sum", times * count[at] * here)):
                upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                columns[name] = pa.array(columns[name].to_numpy() + upto[ends_[1:]] - upto[ends_[:-1]])
            yield pa.RecordBatch.from_pydict(columns)

    return aligned.mapInArrow(run, aligned.schema)


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    out = stored(alignments(docs, path_a, path_b, key, text), "alignments").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    counts = stored(pair_counts(out), "pair-counts")
    rounds = -(-counts.count() // PAIRS)
    for i in range(rounds):
        out = _with_counts(out, counts.where(F.pmod(F.xxhash64("pair"), F.lit(rounds)) == i))
        out = stored(out, "alignments") if i + 1 < rounds else out
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
