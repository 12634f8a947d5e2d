"""Phrase collocations by vertical position bitmaps.

Texts are cut into pieces and words, and each task puts the documents it
reads into shards of one language and about SHARD_WORDS words. Within a
shard every word has a bitmap of its positions, kept as containers of 16
positions without those that are all zero. A phrase's bitmap (of the
places of its last word) is extended by a word as in SPAM: shift it by one
position, clear what would begin a piece, AND it with the word's bitmap;
the popcount of the result is the longer phrase's count in the shard.
Phrases grow depth-first, in batches of neighbouring ones, and counts are
summed over shards.

Three passes over the stored shards: words; pairs of frequent words, whose
popcounts are summed by a 64-bit hash only; phrases of 2 to 4 words all of
whose pairs are frequent, counted under their own text. Which words and
pairs are frequent reaches the tasks as a bit table of at most FILTER_BITS
bits: what passes it wrongly costs work and then falls short of the
minimum, so counts are exact whatever collides.

Scores: a phrase is cut into two at its weakest place, see score().
Defined cases: a null text has no words; a null language is `und` and
counts together with a language of that name; repeated rows each count;
empty tables give empty results; extra columns are ignored. Texts are read
whole, and a text longer than a shard stays in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, slim, small_batches, stored
from .decontam import small

#: The least count of a phrase, the words of the longest phrase, and the percentage of its occurrences in a longer phrase that drops it.
LEAST, LONGEST, COVERED = 30, 4, 80
#: Words of a shard, and containers that are extended at once.
SHARD_WORDS, BATCH = 2 << 20, 1 << 16
#: Phrases that are joined by broadcast are of so many bytes at most, and go by shuffle beyond.
BROADCAST_BYTES = 8 << 20
#: Bits of the tables of frequent words and pairs at most (16 MB).
FILTER_BITS = 1 << 27

#: What a byte is: part of a word, between words, or the end of a piece.
_WORD, _SPACE, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words in lower case, each word's length, and whether it begins a piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    kind = _KIND[data]
    word = kind == _WORD
    begins = np.zeros(len(data) + 1, bool)
    begins[at[:-1] - at[0]] = True
    first = word & begins[:-1]
    first[:1] |= word[:1]
    first[1:] |= word[1:] & ~word[:-1]
    piece = np.cumsum((kind == _CUT) | begins[:-1], dtype=np.int32)[first]
    kept = np.cumsum(word, dtype=np.int32)
    places = np.append(kept[first] - 1, kept[-1] if len(kept) else 0)
    return _LOWER[data[word]], np.diff(places), np.diff(piece, prepend=-1) != 0


def _hash(word: str, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs from the hashes of their words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Gathered:
    """Words of one language, until they are a shard."""

    def __init__(self) -> None:
        self.data, self.lengths, self.begins, self.n = [], [], [], 0

    def add(self, texts: pa.Array) -> None:
        for held, new in zip((self.data, self.lengths, self.begins), cut(texts), strict=True):
            held.append(new)
        self.n += len(self.lengths[-1])

    def shard(self, lang: str) -> dict:
        """The row of a shard: its vocabulary with counts and hashes, and its words by their numbers from 1, negative where a piece begins."""
        data, lengths, begins = (np.concatenate(x) for x in (self.data, self.lengths, self.begins))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        coded = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int32)
        vocabulary = coded.dictionary.to_pylist()
        signed = np.where(begins, -number - 1, number + 1).astype("<i4")
        hashes = np.array([_hash(w, lang) for w in vocabulary], np.uint64).view(np.int64)
        self.__init__()
        return {"lang": lang, "words": vocabulary, "counts": np.bincount(number, minlength=len(vocabulary)), "hashes": hashes, "n": len(number), "packed": pa.compress(signed, codec="zstd", asbytes=True)}


_SHARD = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("n", pa.int64()), ("packed", pa.binary())])


def shards(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row a shard: lang, words, counts, hashes, n and packed (see Gathered.shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Gathered] = {}
        for b in (s for batch in batches for s in slices(batch)):
            for name in b.column(0).unique().to_pylist():
                g = held.setdefault(name, Gathered())
                g.add(b.column(1).filter(pc.equal(b.column(0), name)))
                if g.n >= SHARD_WORDS:
                    yield pa.RecordBatch.from_pylist([g.shard(name)], _SHARD)
                    slim()
        for name, g in held.items():
            if g.n:
                yield pa.RecordBatch.from_pylist([g.shard(name)], _SHARD)
        held.clear()
        slim()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, words array<string>, counts array<bigint>, hashes array<bigint>, n bigint, packed binary")


class Bitmaps:
    """The position bitmaps of a shard's words that `wanted` marks: containers of 16 positions, by block and word."""

    def __init__(self, n: int, packed: bytes, wanted: np.ndarray):
        signed = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd"), "<i4")
        word, place = np.abs(signed) - 1, np.arange(n, dtype=np.int64)
        self.blocks = (n >> 4) + 2
        goes_on = np.zeros(self.blocks * 16, bool)
        goes_on[:n] = signed > 0
        #: Positions that don't begin a piece.
        self.goes_on = np.packbits(goes_on, bitorder="little").view("<u2")
        keep = wanted[word]
        v = len(wanted)
        key = np.sort((((place[keep] >> 4) * v + word[keep]) << 4) | (place[keep] & 15))
        at = np.flatnonzero(np.diff(key >> 4, prepend=-1))
        self.mask = np.bitwise_or.reduceat(np.uint16(1) << (key & 15).astype(np.uint16), at) if len(at) else np.empty(0, np.uint16)
        self.block, self.word = ((key[at] >> 4) // v).astype(np.int32), ((key[at] >> 4) % v).astype(np.int32)
        self.size = np.bincount(self.block, minlength=self.blocks)
        self.first = np.cumsum(self.size) - self.size

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, block, mask) of all words' bitmaps, word by word, in batches."""
        order = np.argsort(self.word, kind="stable")
        for i in range(0, len(order), BATCH):
            o = order[i : i + BATCH]
            yield self.word[o], self.block[o], self.mask[o]

    def extend(self, node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        """Bitmaps of nodes, each with all words behind it: node, word, block, mask (none zero)."""
        far = mask.astype(np.uint32) << 1
        over = far >> 16 != 0
        node, block = np.concatenate([node, node[over]]), np.concatenate([block, block[over] + 1])
        moved = np.concatenate([far.astype(np.uint16), np.ones(int(over.sum()), np.uint16)]) & self.goes_on[block]
        live = np.flatnonzero(moved)
        size = self.size[block[live]]
        which = np.repeat(live, size)
        begin = np.cumsum(size) - size
        other = np.arange(len(which)) + np.repeat(self.first[block[live]] - begin, size)
        both = moved[which] & self.mask[other]
        hit = np.flatnonzero(both)
        which, other = which[hit], other[hit]
        return node[which], self.word[other], block[which], both[hit]


def _counted(key: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by key, the distinct keys, the popcount of each, and each ordered row's place among them."""
    order = np.argsort(key, kind="stable")
    by = key[order]
    new = np.diff(by, prepend=-1) != 0
    at = np.flatnonzero(new)
    counts = np.add.reduceat(np.bitwise_count(mask[order]).astype(np.int64), at) if len(at) else np.empty(0, np.int64)
    return order, by[at], counts, np.cumsum(new) - 1


def pairs(shard: Bitmaps, v: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs in batches: distinct first * v + second with counts, and each row's place among them, block and mask."""
    for word, block, mask in shard.roots():
        first, second, blocks, masks = shard.extend(word, block, mask)
        order, keys, counts, place = _counted(first.astype(np.int64) * v + second, masks)
        yield keys, counts, place, blocks[order], masks[order]


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a bit table lets pass."""
    at = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def bit_table(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash (column `hash`), in a table of 16 bits a row, a power of two and FILTER_BITS at most."""
    bits = 1 << 15
    want = min(16 * hashes.count(), FILTER_BITS)
    while bits < want:
        bits *= 2
    at = F.col("hash").bitwiseAND(bits - 1)
    pages = hashes.select(F.shiftright(at, 15).alias("page"), at.bitwiseAND(32767).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for page, held in pages.toLocalIterator():
        out[page * 4096 : page * 4096 + len(held)] = np.frombuffer(held, np.uint8)
    return out


def _read(row: dict, bits: np.ndarray) -> tuple[Bitmaps, np.ndarray, int]:
    """A shard's bitmaps of the words that pass, the hashes of all its words, and their number."""
    hashes = np.asarray(row["hashes"], np.int64).view(np.uint64)
    return Bitmaps(row["n"], row["packed"], passing(bits, hashes)), hashes, len(hashes)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Shards one by one, their vocabularies left in Arrow."""
    for b in batches:
        for i in range(len(b)):
            yield {"lang": b.column(0)[i].as_py(), "words": b.column(1)[i].values, "hashes": b.column(2)[i].values.to_numpy(), "n": b.column(3)[i].as_py(), "packed": b.column(4)[i].as_buffer()}


def pair_counts(parts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """hash and n of all pairs of frequent words in each shard."""
    table = parts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard, hashes, v = _read(row, table.value)
            for keys, counts, *_ in pairs(shard, v):
                yield pa.RecordBatch.from_arrays([pa.array(pair_hash(hashes[keys // v], hashes[keys % v]).view(np.int64)), pa.array(counts)], ["hash", "n"])
            del row, shard, hashes
            slim()

    return parts.select("lang", "words", "hashes", "n", "packed").mapInArrow(run, "hash bigint, n bigint")


def grown(shard: Bitmaps, hashes: np.ndarray, frequent_pairs: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Phrases all of whose pairs pass, depth-first: the numbers of their words (one array for each place) and their counts."""
    v = len(hashes)
    good, held = [], []
    for keys, counts, place, block, mask in pairs(shard, v):
        ok = passing(frequent_pairs, pair_hash(hashes[keys // v], hashes[keys % v]))
        yield [keys[ok] // v, keys[ok] % v], counts[ok]
        good.append(keys[ok])
        rows = np.flatnonzero(ok[place])
        held.append((keys[ok], (np.cumsum(ok) - 1)[place[rows]].astype(np.int32), block[rows], mask[rows]))
    good = np.unique(np.concatenate(good)) if good else np.empty(0, np.int64)

    def deeper(words: list[np.ndarray], node: np.ndarray, block: np.ndarray, mask: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        for i in range(0, len(node), BATCH):
            cut_out = slice(i, i + BATCH)
            parent, word, blocks, masks = shard.extend(node[cut_out], block[cut_out], mask[cut_out])
            last = words[-1][parent].astype(np.int64) * v + word
            known = np.flatnonzero(good[np.minimum(np.searchsorted(good, last), len(good) - 1)] == last) if len(good) else np.empty(0, np.int64)
            order, keys, counts, place = _counted(parent[known].astype(np.int64) * v + word[known], masks[known])
            longer = [w[keys // v] for w in words] + [keys % v]
            yield longer, counts
            if len(longer) < LONGEST:
                yield from deeper(longer, place.astype(np.int32), blocks[known][order], masks[known][order])

    held.reverse()
    while held:
        keys, node, block, mask = held.pop()
        yield from deeper([keys // v, keys % v], node, block, mask)


def phrase_counts(parts: DataFrame, frequent: np.ndarray, frequent_pairs: np.ndarray) -> DataFrame:
    """lang, phrase, size and n of the phrases in each shard all of whose pairs may be frequent."""
    tables = parts.sparkSession.sparkContext.broadcast((frequent, frequent_pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shard, hashes, _ = _read(row, tables.value[0])
            for words, counts in grown(shard, hashes, tables.value[1]):
                phrase = pc.binary_join_element_wise(*(row["words"].take(pa.array(w)) for w in words), " ")
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(counts), np.int32)), pa.array([row["lang"]])).cast(pa.string()), phrase, pa.array(np.full(len(counts), len(words), np.int32)), pa.array(counts)], ["lang", "phrase", "size", "n"])
            del row, shard, hashes
            slim()

    return parts.select("lang", "words", "hashes", "n", "packed").mapInArrow(run, "lang string, phrase string, size int, n bigint")


def score(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score: of the cuts into two, the one of the lowest floor(2000000 * a / (l + r)), the first of equals.

    phrases: lang, phrase, size, f; words: lang, phrase, f. l and r count the two parts.
    """
    known = small(words.select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f")), "phrase", BROADCAST_BYTES)
    part = lambda begin, length: F.array_join(F.slice(F.split("phrase", " "), begin, length), " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    value = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def uncovered(scored: DataFrame, phrases: DataFrame) -> DataFrame:
    """scored without phrases that lie in a longer one with COVERED percent of their count or more."""
    longer = phrases.where(F.col("size") > 2)
    starts = lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), starts))
    most = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    whole = lambda n, c: F.lit(n).cast("decimal(3,0)") * F.col(c).cast("decimal(19,0)")
    return scored.join(small(most, "phrase", BROADCAST_BYTES), ["lang", "phrase"], "left").where(F.col("most").isNull() | (whole(100, "most") < whole(COVERED, "a"))).drop("most")


def ranked(scored: DataFrame, first: int) -> DataFrame:
    """The first rows of each language with their rank; rows are dealt out by range, so no task holds a language."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    runs = parts.groupBy("lang", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("lang", "part", "begin", before.alias("before"))
    out = parts.withColumn("part", F.shiftright("at", 33)).join(small(runs, "lang"), ["lang", "part"])
    return out.withColumn("rank", F.col("at") - F.col("begin") + F.col("before") + 1).where(F.col("rank") <= first).drop("at", "part", "begin", "before")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n (words of the language) and score of each language's first phrases."""
    with small_batches(docs.sparkSession):
        return _collocations(docs, text, lang, least, first)


def _collocations(docs: DataFrame, text: str, lang: str, least: int, first: int) -> DataFrame:
    parts = stored(shards(docs, text, lang), "shards")
    each = parts.select("lang", F.explode(F.arrays_zip("words", "counts", "hashes")).alias("x"))
    words = each.groupBy("lang", F.col("x.words").alias("phrase")).agg(F.sum("x.counts").alias("f"), F.min("x.hashes").alias("hash")).where(F.col("f") >= least)
    words = stored(words, "words")
    total = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = bit_table(words)
    frequent_pairs = stored(pair_counts(parts, frequent).groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash"), "pairs")
    counts = phrase_counts(parts, frequent, bit_table(frequent_pairs))
    phrases = stored(counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases")
    discard(frequent_pairs)
    out = ranked(uncovered(score(phrases, words), phrases), first)
    return out.join(small(total, "lang"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
