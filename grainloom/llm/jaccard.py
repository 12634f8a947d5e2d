"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct five-word shingles (64-bit hashes).
Two documents link when 100 * intersection >= 80 * union. The join is
exact and goes in steps:

1. Equal sets form classes (128-bit digests); one representative each goes on.
2. All documents order shingles alike: locally frequent ones last, others
   by hash. Linked documents of sizes s <= t share at least
   T - ceil(0.8 t) + 1 shingles of their prefixes, where a prefix is the
   first s - ceil(0.8 s) + 1 shingles and T the overlap that they need.
   The inverted index holds prefixes only.
3. Every list proposes its least and its most central document to its others;
   what shares enough lists forms a family. Families are searched whole by
   T-occurrence, so their pairs, which grow with the square of a group of
   near copies, never become rows.
4. Lists that hold several families propose all their pairs between
   families; pairs that share enough prefix shingles are verified by
   T-occurrence search.

The search takes one document as the query over the inverted lists of its
candidates: short lists are merged, documents that occur often enough
there are looked up in the long lists by binary search (DivideSkip, whose
rule says how many lists count as long). A heap merges up to HEAP postings;
above that, as in families of many copies, the merge counts in an array
over the candidates, which gives the same and is faster in numpy.

Lists of shingles that count as frequent are built in pieces of about
PIECE documents, and all lists are paired in blocks of CROSS documents.
Frequent are shingles that some tasks saw LOCAL times within two million
shingles; a list of others is built by one task, and holds 12 bytes for
each of its documents.

Frequent shingles are last in the order and stay in all sets: which ones
are taken as frequent changes the work, not the result. Hashes of 64 bits
stand for shingles.

Defined cases: null, empty and blank texts have the empty set and link
with nothing; texts of fewer than five words have their whole sequence as
their one shingle; rows of one key are one vertex (it links by any of its
texts); rows with a null key link with nothing and have a null component;
repeated rows each come back; an empty table gives an empty result; keys
are whole numbers; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, slim, small_batches, stored
from .components import components

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 80
#: A shingle counts as frequent if tasks that saw it LOCAL times or more saw it COMMON times together.
LOCAL, COMMON = 3, 24
#: Frequent shingles that are broadcast at most: the most frequent ones (8 bytes each; fewer or more only change the work).
FREQUENT_MAX = 500_000
#: Rows of keys up to this number are broadcast to find their texts (at most 64 bytes each), and joined by shuffle beyond.
BROADCAST_KEYS = 1_000_000
#: Postings that one part of the inverted index holds on average.
PART = 400_000
#: Pairs that a task holds before it counts them (32 bytes each, and as much again twice while it does).
PAIRS = 400_000
#: Members that one search indexes at once, and documents of a family that one side of a block holds.
BLOCK, FAMILY = 512, 1000
#: Documents of a list that one task gathers, and documents of a list that one side of a block of pairs holds.
PIECE, CROSS = 65_536, 8_192
#: Of DivideSkip: weight of the long lists in its rule for their number. Postings that a heap merges.
MU, HEAP = 0.1, 400

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(2024).integers(1, 1 << 63, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse, at least n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_ODD, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8) if raw else np.zeros(0, np.uint8)
    ends_of = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, int)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * power[: len(data)])])
    word = _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    doc = np.searchsorted(ends_of, start, side="right")
    first = np.searchsorted(doc, np.arange(len(raw) + 1))
    shingle = np.zeros(max(0, len(word) - words + 1), np.uint64)
    m = 1
    for k in range(words):
        shingle += word[k : k + len(shingle)] * np.uint64(m)
        m = m * 0xD6E8FEB86659FD93 & _MASK
    shingle = _mix(shingle)
    out = []
    for i in range(len(raw)):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            out.append(np.unique(shingle[a : b - words + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(word[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[list, list]]:
    """(keys, shingle sets) of about size bytes at a time."""
    for b in (s for batch in batches for s in slices(batch, size=size)):
        yield b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist())


def least(s: int) -> int:
    """Overlap with any partner that a set of size s needs."""
    return -(-PERCENT * s // 100)


def needed(s: int, t: int) -> int:
    """Overlap that sets of sizes s and t need: 100 i >= P (s + t - i)."""
    return -(-PERCENT * (s + t) // (100 + PERCENT))


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, and in how many they were seen: each task counts all that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u[c >= LOCAL].view(np.int64)), pa.array(c[c >= LOCAL])], ["token", "n"])

        for _, sets in _blocks(batches):
            held += sets
            n += sum(map(len, sets))
            if n > 2_000_000:
                yield counted()
                held, n = [], 0
        if n:
            yield counted()
        slim()

    counts = docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_MAX).select("token", "n").toArrow()
    token, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: late ones last, else by hash."""
    n = len(s) - least(len(s)) + 1
    if len(late):
        is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
        s = np.concatenate([s[~is_late], s[is_late]]) if is_late.any() else s
    return s[:n]


def digest(s: np.ndarray) -> tuple[int, int]:
    h = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def described(docs: DataFrame, late: np.ndarray) -> DataFrame:
    """doc, n, d1, d2 (digest), prefix (packed) of each row; the last three null for empty sets."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _blocks(batches):
            d = [digest(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()),
                 pa.array([prefix(s, shared.value).tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc", "n", "d1", "d2", "prefix"],
            )
        slim()

    return docs.mapInArrow(run, "doc bigint, n int, d1 bigint, d2 bigint, prefix binary")


def lists(reps: DataFrame, parts: int, hot: np.ndarray, pieces: np.ndarray) -> DataFrame:
    """The inverted lists of at least two documents, in pieces: token, total (documents of the list), least (document), least_size, ids, sizes.

    hot: shingles (sorted) whose lists are gathered in several pieces, by document, and in how many.
    """
    first = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)  # pieces are parts of their own, behind the others
    owner = np.repeat(hot, pieces)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()]
            if not sets:
                continue
            lens = np.array([len(x) for x in sets])
            token = np.concatenate(sets)
            doc, size = np.repeat(b.column(0).to_numpy(), lens), np.repeat(b.column(1).to_numpy(), lens)
            part = (token % np.uint64(parts)).astype(np.int64)
            if len(hot):
                k = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                many = hot[k] == token
                salt = (_mix(doc[many].view(np.uint64)) % pieces[k[many]].astype(np.uint64)).astype(np.int64)
                part[many] = parts + first[k[many]] + salt
            order = np.argsort(part, kind="stable")
            at = order[np.concatenate([[True], part[order][1:] != part[order][:-1]])]
            cut = np.append(np.searchsorted(part[order], part[at]), len(order))
            rows = [(int(part[i]), order[cut[j] : cut[j + 1]]) for j, i in enumerate(at)]
            short = (token // np.uint64(parts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)  # within its part
            runs = []
            for _, at in rows:  # consecutive postings of one document share its id
                d = doc[at]
                begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                runs.append((d[begin].tobytes(), size[at][begin].tobytes(), np.diff(np.concatenate([begin, [len(d)]])).astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in rows], pa.int32()), pa.array([short[at].tobytes() for _, at in rows], pa.binary()), *(pa.array([r[i] for r in runs], pa.binary()) for i in range(3))],
                ["part", "tokens", "docs", "sizes", "runs"],
            )
        slim()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for p, t, d, s, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(p, []).append((t, d, s, r))
        for p in sorted(held):
            blobs = held.pop(p)
            runs = np.concatenate([np.frombuffer(x[3], np.int32) for x in blobs])
            token = np.concatenate([np.frombuffer(x[0], np.uint32) for x in blobs])
            doc = np.repeat(np.concatenate([np.frombuffer(x[1], np.int64) for x in blobs]), runs)
            size = np.repeat(np.concatenate([np.frombuffer(x[2], np.int32) for x in blobs]), runs)
            order = np.lexsort((doc, token))
            token, doc, size = token[order], doc[order], size[order]
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            end = np.concatenate([begin[1:], [len(token)]])
            name = owner[[p - parts]].view(np.int64) if p >= parts else token[begin].astype(np.int64) * parts + p
            many = (end - begin > 1) | (p >= parts)
            begin, end, name = begin[many], end[many], name[many]
            for i in range(0, len(begin), 20_000):
                rows = [(k, a, x, min(e, x + PIECE)) for k, a, e in zip(name[i : i + 20_000], begin[i : i + 20_000], end[i : i + 20_000], strict=True) for x in range(a, e, PIECE)]
                sizes = np.array([e - x for _, _, x, e in rows])
                at = np.concatenate([np.arange(x, e) for _, _, x, e in rows])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                top = [a for _, a, _, _ in rows]
                total = {a: e - a for a, e in zip(begin[i : i + 20_000], end[i : i + 20_000], strict=True)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(k) for k, _, _, _ in rows], pa.int64()), pa.array([int(total[a]) for a in top], pa.int64()), pa.array(doc[top]), pa.array(size[top]),
                     pa.ListArray.from_arrays(offsets, pa.array(doc[at])), pa.ListArray.from_arrays(offsets, pa.array(size[at]))],
                    ["token", "total", "least", "least_size", "ids", "sizes"],
                )
        slim()

    packed = reps.select("id", "n", "prefix").mapInArrow(pack, "part int, tokens binary, docs binary, sizes binary, runs binary")
    return packed.repartition(parts, "part").mapInArrow(unpack, "token bigint, total bigint, least bigint, least_size int, ids array<bigint>, sizes array<int>")


def whole_lists(found: DataFrame, hot: np.ndarray) -> DataFrame:
    """found (a stored table) with the total and the least document of each whole list for those that were gathered in several pieces."""
    if not len(hot):
        return found
    names = F.broadcast(found.sparkSession.createDataFrame([(int(t),) for t in hot.view(np.int64)], "token bigint"))
    parted = found.join(names, "token", "left_semi")
    # Pieces of one list repeat their total in each of their rows: the least row of a piece counts.
    each = parted.groupBy("token", "least").agg(F.max("total").alias("total"), F.max("least_size").alias("least_size"))
    whole = each.groupBy("token").agg(F.sum("total").alias("total"), F.min(F.struct("least", "least_size")).alias("m")).select("token", "total", "m.*")
    mended = parted.select("token", "ids", "sizes").join(whole, "token").where(F.col("total") > 1)
    return found.join(names, "token", "left_anti").unionByName(mended)


_PAIRS = "a bigint, b bigint, na int, nb int, c bigint"


def _pair_batch(a: list, b: list, na: list, nb: list) -> pa.RecordBatch | None:
    a, b, na, nb = (np.concatenate(x) for x in (a, b, na, nb))
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    c = np.diff(np.concatenate([begin, [len(a)]]))
    return pa.RecordBatch.from_arrays([pa.array(a[begin]), pa.array(b[begin]), pa.array(na[begin].astype(np.int32)), pa.array(nb[begin].astype(np.int32)), pa.array(c.astype(np.int64))], ["a", "b", "na", "nb", "c"])


def stars(found: DataFrame) -> DataFrame:
    """Pairs of each list's least document with its others, with the number of lists that propose them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        n = 0
        for batch in batches:
            ids, lens = batch.column(2).flatten().to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            top, top_n = np.repeat(batch.column(0).to_numpy(), lens), np.repeat(batch.column(1).to_numpy(), lens)
            size = batch.column(3).flatten().to_numpy()
            fit = (top != ids) & (np.minimum(size, top_n) * 100 >= PERCENT * np.maximum(size, top_n).astype(np.int64))
            for h, x in zip(held, (top[fit], ids[fit], top_n[fit], size[fit]), strict=True):
                h.append(x)
            n += int(fit.sum())
            if n > PAIRS:
                yield _pair_batch(*held)
                held, n = [[], [], [], []], 0
        if n:
            yield _pair_batch(*held)
        slim()

    return found.select("least", "least_size", "ids", "sizes").mapInArrow(run, _PAIRS)


def central_stars(postings: DataFrame) -> DataFrame:
    """Pairs of the most central document of each list (up to CROSS of its documents) with its others; postings (token, id, n, score), sorted by token in each partition.

    Of a group of near copies the one that the others were made from stands in the longest lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        n = 0
        for token, doc, size, score in _whole_lists(batches):
            order = np.lexsort((doc, -score, token))
            token, doc, size = token[order], doc[order], size[order].astype(np.int64)
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            lens = np.diff(np.concatenate([begin, [len(token)]]))
            top, top_n = np.repeat(doc[begin], lens), np.repeat(size[begin], lens)
            fit = (top != doc) & (np.minimum(size, top_n) * 100 >= PERCENT * np.maximum(size, top_n))
            for h, x in zip(held, (top[fit], doc[fit], top_n[fit], size[fit]), strict=True):
                h.append(x)
            n += int(fit.sum())
            if n > PAIRS:
                yield _pair_batch(*held)
                held, n = [[], [], [], []], 0
        if n:
            yield _pair_batch(*held)
        slim()

    return postings.select("token", "id", "n", "score").mapInArrow(run, _PAIRS)


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of rows sorted by their first one, in runs that do not cut a value of it."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        rest = cols if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        stop = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0
        if stop:
            yield tuple(r[:stop] for r in rest)
            rest = [r[stop:] for r in rest]
    if rest is not None and len(rest[0]):
        yield tuple(rest)


def across(postings: DataFrame) -> DataFrame:
    """All pairs of different components within the blocks of lists of postings (token, id, n, comp, side), sorted by token (which names a block) in each partition.

    Both sides of a pair differ in `side`, unless all of the block are equal.
    """

    def cross(doc, size, comp, side, held) -> Iterator[int]:
        """Adds the pairs of a block to held, and says from time to time, and in the end, how many are new."""
        made = 0
        order = np.argsort(size, kind="stable")
        doc, size, comp, side = doc[order], size[order].astype(np.int64), comp[order], side[order]
        far = np.searchsorted(size, size * 100 // PERCENT, side="right")  # partners that are not too large
        one = side.min() == side.max()
        for i in range(len(doc) - 1):
            j = slice(i + 1, far[i])
            other = comp[j] != comp[i] if one else (comp[j] != comp[i]) & (side[j] != side[i])
            if other.any():
                x, nx = doc[j][other], size[j][other]
                low = x < doc[i]
                held[0].append(np.where(low, x, doc[i]))
                held[1].append(np.where(low, doc[i], x))
                held[2].append(np.where(low, nx, size[i]))
                held[3].append(np.where(low, size[i], nx))
                made += len(x)
                if made > PAIRS // 4:
                    yield made
                    made = 0
        yield made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        n = 0
        for token, doc, size, comp, side in _whole_lists(batches):
            begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            end = np.concatenate([begin[1:], [len(token)]])
            for k in np.flatnonzero(np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin)):
                a, e = begin[k], end[k]
                for made in cross(doc[a:e], size[a:e], comp[a:e], side[a:e], held):
                    n += made
                    if n > PAIRS:
                        yield _pair_batch(*held)
                        n = 0
                        for h in held:
                            h.clear()
        if n:
            yield _pair_batch(*held)
        slim()

    return postings.select("token", "id", "n", "comp", "side").mapInArrow(run, _PAIRS)


def n_long(t: int, longest: int) -> int:
    """DivideSkip's number of long lists for a needed overlap of t."""
    return min(t - 1, int(t / (MU * math.log2(max(2, longest)) + 1)))


def merged(lists: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The members (below n) of sorted lists, sorted, and how many lists hold each."""
    if sum(map(len, lists)) > HEAP:
        count = np.bincount(np.concatenate(lists), minlength=n)
        return (found := np.flatnonzero(count)), count[found]
    members, counts = [], []
    for m in heapq.merge(*(x.tolist() for x in lists)):
        if members and members[-1] == m:
            counts[-1] += 1
        else:
            members.append(m)
            counts.append(1)
    return np.array(members, np.int64), np.array(counts, np.int64)


def probed(found: np.ndarray, have: np.ndarray, need: np.ndarray, long: list[np.ndarray]) -> np.ndarray:
    """The members of found, held by `have` short lists, that binary search in the long lists brings to what they need."""
    for k, members in enumerate(long):
        on = have + (len(long) - k) >= need
        found, have, need = found[on], have[on], need[on]
        if not len(found):
            break
        if len(members):
            have = have + (members[np.minimum(np.searchsorted(members, found), len(members) - 1)] == found)
    return found[have >= need]


def t_occurrence(query: np.ndarray, members: list[np.ndarray]) -> list[int]:
    """Positions of the members that link with query, by DivideSkip over the members' inverted lists."""
    s = len(query)
    members_at = [i for i, m in enumerate(members) if min(s, len(m)) * 100 >= PERCENT * max(s, len(m))]
    if not s or not members_at:
        return []
    at = np.repeat(np.array(members_at), [len(members[i]) for i in members_at])
    slot = np.searchsorted(query, tokens := np.concatenate([members[i] for i in members_at]))
    hit = query[np.minimum(slot, s - 1)] == tokens
    slot, at = slot[hit], at[hit]
    order = np.lexsort((at, slot))
    slot, at = slot[order], at[order]
    begin = np.searchsorted(slot, np.arange(s + 1))
    inverted = sorted((at[begin[k] : begin[k + 1]] for k in range(s)), key=len)
    long = n_long(least(s), len(inverted[-1]))  # no member needs less
    found, have = merged(inverted[: s - long], len(members))
    sizes = np.array([len(m) for m in members])
    need = -(-PERCENT * (s + sizes[found]) // (100 + PERCENT))
    return probed(found, have, need, inverted[s - long :]).tolist()


def verified(pairs: DataFrame, owners: DataFrame, docs: DataFrame, once: bool) -> DataFrame:
    """The pairs (a, b; a stored table) that link; owners: id and the document that holds it; once: no document stands in docs twice.

    Pairs are dealt by the component of candidates that they belong to, large ones in a grid of blocks,
    so each block gets the sets of its documents once. Sets are computed anew from the texts.
    """
    group = components(pairs)
    placed = pairs.join(group.withColumnRenamed("component", "g"), F.col("a") == F.col("id")).drop("id")
    sides = placed.groupBy("g").agg(F.ceil(F.greatest(F.sqrt(F.count(F.lit(1)) / 20_000), F.least(F.count(F.lit(1)) + 1, F.countDistinct("a") + F.countDistinct("b")) / 4_000)).cast("int").alias("side"))
    cut = lambda c: F.pmod(F.xxhash64(c), F.col("side")).cast("int")
    placed = stored(placed.join(sides, "g").select("g", cut("a").alias("x"), cut("b").alias("y"), "a", "b"), "placed")
    wanted = placed.select("g", "x", "y", F.explode(F.array("a", "b")).alias("id")).distinct().join(owners, "id")
    wanted = stored(wanted.select("g", "x", "y", "id", "doc"), "wanted")
    members = with_sets(wanted, docs, once).select("g", "x", "y", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "packed")
    rows = members.unionByName(placed.withColumn("packed", F.lit(None).cast("binary")))
    block = ["g", "x", "y"]
    rows = rows.repartition(*block).sortWithinPartitions(*block, F.col("packed").isNull(), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, query, others = None, {}, None, []
        links: list[tuple[int, int]] = []

        def search() -> None:
            if others:
                links.extend((query, others[i]) for i in t_occurrence(known[query], [known[b] for b in others]))
                others.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])
            links.clear()
            return batch

        for batch in batches:
            for g, x, y, a, b, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, x, y) != now:
                    search()
                    now, known, query = (g, x, y), {}, None
                if s is not None:
                    known[a] = np.frombuffer(s, np.uint64)
                else:
                    if a != query or len(others) >= BLOCK:
                        search()
                    query = a
                    others.append(b)
            if links:
                yield out()
        search()
        if links:
            yield out()
        known.clear()
        slim()

    return rows.select(*block, "a", "b", "packed").mapInArrow(run, "a bigint, b bigint")


class Family:
    """The inverted index of a few thousand documents, for exact search among them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(x) for x in sets])
        token = np.concatenate(sets)
        at = np.repeat(np.arange(len(sets)), self.size)
        order = np.lexsort((at, token))
        token, self.at = token[order], at[order]
        self.begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.token, self.end = token[self.begin], np.concatenate([self.begin[1:], [len(token)]])
        self.root = np.arange(len(sets))

    def join(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)

    def search(self, i: int, allowed: np.ndarray) -> np.ndarray:
        """The allowed members that link with i and are in no component with it yet, by DivideSkip."""
        q = self.sets[i]
        k = np.searchsorted(self.token, q)  # all are there: q is a member
        k = k[np.argsort(self.end[k] - self.begin[k], kind="stable")]
        inverted = [self.at[self.begin[x] : self.end[x]] for x in k]
        long = n_long(least(len(q)), len(inverted[-1]))
        found, have = merged(inverted[: len(q) - long], len(self.sets))
        size = self.size[found]
        fit = allowed[found] & (self.root[found] != self.root[i]) & (np.minimum(size, len(q)) * 100 >= PERCENT * np.maximum(size, len(q)))
        found, have, size = found[fit], have[fit], size[fit]
        return probed(found, have, -(-PERCENT * (size + len(q)) // (100 + PERCENT)), inverted[len(q) - long :])

    def links(self, side: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect what is linked, within one side, or between two; central documents first, so that groups meet early."""
        weight = np.zeros(len(self.sets))
        np.add.at(weight, self.at, np.repeat(self.end - self.begin, self.end - self.begin))
        two = side.min() != side.max()
        out = []
        left = np.ones(len(self.sets), bool)
        for i in np.argsort(-weight / self.size, kind="stable"):
            left[i] = False
            allowed = left & (side != side[i]) if two else left
            for j in self.search(int(i), allowed):
                out.append((int(i), int(j)))
                self.join(int(i), int(j))
        return out


def within(families: DataFrame, owners: DataFrame, docs: DataFrame, once: bool) -> DataFrame:
    """Links (a, b) that connect what is linked inside each family (id, component); large families go in a grid of blocks."""
    sides = families.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / FAMILY).cast("int").alias("sides"))
    placed = families.join(sides, "component").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    wanted = placed.select(F.col("component").alias("g"), F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "id").join(owners, "id")
    wanted = stored(wanted, "wanted")
    rows = with_sets(wanted, docs, once)
    block = ["g", "x", "y"]
    rows = rows.repartition(*block).sortWithinPartitions(*block, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch | None:
            side = np.array([h[0] for h in held])
            if len(held) < 2 or now[1] != now[2] and side.min() == side.max():
                return None
            ids = np.array([h[1] for h in held])
            found = Family([np.frombuffer(h[2], np.uint64) for h in held]).links(side)
            return pa.RecordBatch.from_arrays([pa.array(ids[[i for i, _ in found]], pa.int64()), pa.array(ids[[j for _, j in found]], pa.int64())], ["a", "b"]) if found else None

        for batch in batches:
            for g, x, y, side, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, x, y) != now:
                    if (out := done()) is not None:
                        yield out
                    now, held = (g, x, y), []
                if not held or held[-1][1] != i:
                    held.append((side, i, s))
        if (out := done()) is not None:
            yield out
        held.clear()
        slim()

    return rows.select(*block, "side", "id", "packed").mapInArrow(run, "a bigint, b bigint")


def with_sets(wanted: DataFrame, docs: DataFrame, once: bool) -> DataFrame:
    """wanted (a stored table with id and doc) with the packed set of each id, computed anew from the texts; once: no document stands in docs twice."""
    few = wanted.count() <= BROADCAST_KEYS
    keys = wanted.select("doc").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owned, found in _blocks(batches):
            full = [(k, s) for k, s in zip(owned, found, strict=True) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in full], pa.int64()), pa.array([digest(s)[0] for _, s in full], pa.int64()), pa.array([s.tobytes() for _, s in full], pa.binary())], ["doc", "id", "packed"])
        slim()

    packed = docs.join(F.broadcast(keys) if few else keys, "doc", "left_semi").mapInArrow(sets, "doc bigint, id bigint, packed binary")
    packed = packed if once else packed.dropDuplicates(["doc", "id"])
    # A key may have several texts: only the one with the class's digest counts.
    return packed.join(F.broadcast(wanted) if few else wanted, ["doc", "id"])


def _enough(c: str):
    """Whether a pair shares as many prefix shingles as linked documents of its sizes must."""
    t = F.ceil(F.lit(PERCENT) * (F.col("na") + F.col("nb")) / F.lit(100 + PERCENT)) - F.ceil(F.lit(PERCENT) * F.greatest("na", "nb") / F.lit(100)) + 1
    return F.col(c) >= F.greatest(F.lit(1), t)


def _related():
    """Whether a pair shares an eighth of what linked documents of one size must, and more than one shingle unless they are short."""
    s = F.least("na", "nb")
    return (F.col("c") * 8 >= F.ceil(s * 0.09)) & ((F.col("c") > 1) | (s <= 33))


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id of each row of df."""
    with small_batches(df.sparkSession):
        return _join(df, key, text)


def _join(df: DataFrame, key: str, text: str) -> DataFrame:
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    late, seen = frequent(docs)
    rows = stored(described(docs, late).withColumn("row", F.monotonically_increasing_id()), "sets")
    usable = rows.where(F.col("d1").isNotNull() & F.col("doc").isNotNull())
    classes = stored(usable.groupBy("d1", "d2").agg(F.min(F.struct("doc", "row")).alias("m"), F.max(F.octet_length("prefix")).alias("size")).select("d1", "d2", F.col("m.doc").alias("rep"), F.col("m.row").alias("rep_row"), "size"), "classes")
    copies = usable.select("doc", "d1", "d2").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).where(F.col("doc") != F.col("rep")).select(F.col("doc").alias("a"), F.col("rep").alias("b")).distinct()
    held = usable.join(classes.select("d1", "d2", "rep", "rep_row"), ["d1", "d2"]).where(F.col("doc") == F.col("rep"))
    reps = held.where(F.col("row") == F.col("rep_row")).select(F.col("d1").alias("id"), "n", "prefix")  # one row, however often it is repeated
    owners = classes.select(F.col("d1").alias("id"), F.col("rep").alias("doc"))

    postings = (classes.agg(F.sum("size")).first()[0] or 0) // 8
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-postings // PART))
    hot, pieces = late[seen > PIECE], -(-seen[seen > PIECE] // PIECE)
    raw = stored(lists(reps, parts, hot, pieces), "lists")
    found = whole_lists(raw, hot)

    # Proposals only shape the families: pairs between families are all found below.
    each = found.select("token", "total", F.explode(F.arrays_zip("ids", "sizes")).alias("x")).select("token", "total", F.col("x.ids").alias("id"), F.col("x.sizes").alias("n"))
    score = each.groupBy("id").agg((F.sum("total") / F.max("n")).alias("score"))
    sides = F.ceil(F.col("total") / CROSS).cast("int")
    side = F.pmod(F.xxhash64("id"), sides).cast("int")
    central = each.select(F.xxhash64("token", side).alias("token"), "id", "n").join(score, "id")
    central = central_stars(central.repartition("token").sortWithinPartitions("token"))
    proposed = stars(found).unionByName(central).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b"), "na": F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")), "nb": F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na"))})
    first = stored(proposed.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c")).where(_related()).select("a", "b"), "stars")
    once = held.count() <= classes.count()
    families = stored(components(first), "families")
    near = stored(within(families, owners, docs, once), "links")

    # Each block of a list meets itself and every other one.
    still = each.select("token", "id", "n", side.alias("side"), sides.alias("sides")).join(families, "id", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    still = still.select(F.xxhash64("token", F.least("side", "other"), F.greatest("side", "other")).alias("token"), "id", "n", F.coalesce("component", "id").alias("comp"), "side")
    mixed = across(still.repartition("token").sortWithinPartitions("token")).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    second = stored(mixed.where(_enough("c")).select("a", "b"), "pairs")
    discard(first, raw)
    more = stored(verified(second, owners, docs, once), "links")

    by_doc = near.unionByName(more)
    by_doc = by_doc.join(owners.withColumnRenamed("doc", "x"), F.col("a") == F.col("id")).drop("id").join(owners.withColumnRenamed("doc", "y"), F.col("b") == F.col("id")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    whole = components(by_doc.unionByName(copies))
    discard(families, second, near, more)
    out = rows.select("doc", "n").join(whole, F.col("doc") == F.col("id"), "left")
    return out.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
