"""Benchmark decontamination with a distributed positional inverted index.

Test texts are cut into windows of consecutive words. The index holds
postings (word, document, position) of the training texts for the words
that searches start from: of each window its rarest and second rarest
word in the corpus. It is written to the shared folder by the tasks that
read the documents, without a shuffle. A search takes the rarest word's
postings, shifts them to where the window would begin, intersects them
with the second word's postings, shifted likewise, and compares the words
around the surviving positions (kept with the rarest words' postings)
with the whole window: equal for an exact phrase, or, for a proximity
match, all of the window's words among those from SLACK words before its
place to SLACK words behind (and the two rarest at most SLACK astray).

Only SQL functions. Words are lower-cased in A-Z alone. Rows are told
apart by key and a hash of the text, so repeated rows get equal results
each (the postings of one of them are searched), and rows of one key with
different texts get their own. A null or
wordless text has no words and no hits; a window whose words do not all
occur in the corpus is dropped; null item ids are not listed; empty
tables give empty results or no hits; extra columns are ignored. Long
texts are indexed whole, and no frequent word or passage is left out: a
frequent word is only searched from if its window holds no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Words of a window, and words by which a proximity match may stray.
WINDOW = 10
SLACK = 2
#: What is derived from the test texts is broadcast up to this many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 64 << 20

_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands behind the last word of each text in the index; no word is like it.
_END = "\x00"
#: Positions are joined by stretches of so many words.
_STRETCH = 16


def words(text: Column) -> Column:
    """The words of a text in their own letter case; none for null."""
    inner = F.btrim(text, F.lit(_SEPARATORS))
    return F.when(inner != "", F.split(inner, _SPLIT, -1)).otherwise(F.expr("cast(array() as array<string>)"))


def lowered(word: Column) -> Column:
    """ascii_lower(), skipped for words that have no upper case at all."""
    return F.when(F.lower(word) == word, word).otherwise(ascii_lower(word))


def fits(df: DataFrame, column: str, most: int | None = None) -> bool:
    """Whether the texts of column and 64 bytes a row are within `most` bytes (BROADCAST_BYTES)."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return rows * 64 + size <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """df, marked for broadcast if it fits()."""
    return F.broadcast(df) if fits(df, column, most) else df


def windows(tests: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """window (array of words) and items (ids that hold it), each distinct window once."""
    t = tests.select(F.col(item).alias("item"), F.transform(words(F.col(text)), ascii_lower).alias("w")).where(F.size("w") > 0)
    each = t.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("i"))
    return each.groupBy(F.slice("w", F.col("i") + 1, size).alias("window")).agg(F.collect_set("item").alias("items"))


def frequencies(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """word and n, its occurrences in all documents, for the words of vocabulary that occur."""
    each = docs.select(F.explode_outer(words(F.col(text))).alias("raw")).where(F.col("raw").isNotNull()).select(lowered(F.col("raw")).alias("word"))
    return each.join(small(vocabulary, "word"), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def plans(found: DataFrame, counts: DataFrame) -> DataFrame:
    """For each window that can occur: id, window, size, and its rarest two words with their offsets (a lone word is both)."""
    each = found.select("id", F.posexplode("window").alias("at", "word")).join(counts, "word", "left")
    order = Window.partitionBy("id").orderBy("n", "at")
    ranked = each.withColumn("rank", F.row_number().over(order)).withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("id"))).where(F.col("least") > 0)
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    two = ranked.where(F.col("rank") <= 2).groupBy("id").agg(
        pick(1, "word").alias("word1"), pick(1, "at").alias("at1"), F.coalesce(pick(2, "word"), pick(1, "word")).alias("word2"), F.coalesce(pick(2, "at"), pick(1, "at")).alias("at2"),
    )
    return two.join(found.select("id", "window"), "id").withColumn("size", F.size("window"))


def index(docs: DataFrame, key: str, text: str, keys: DataFrame, reach: int) -> DataFrame:
    """Postings (key, h, row, word, pos, around, first) of the words of keys (word, first), and one with word _END at the end of each text.

    around: for words that searches start from, the words from `reach` before to `reach` behind, in their own letter case (few are compared).
    """
    around = F.slice("w", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)) + reach + 1)
    out = [key, "h", "row", "word", "pos", F.when(F.col("first"), around).alias("around"), "first"]
    wanted = keys.unionByName(keys.sparkSession.createDataFrame([(_END, False)], "word string, first boolean"))
    rows = docs.select(F.col(key), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("_text"))
    each = F.posexplode_outer(F.array_append("w", F.lit(_END))).alias("pos", "raw")
    if fits(wanted, "word"):
        found = rows.select(key, "h", "row", words(F.col("_text")).alias("w")).select(key, "h", "row", "w", each).withColumn("word", lowered(F.col("raw")))
        return found.join(F.broadcast(wanted), "word").select(*out)
    # Words meet the wanted ones by shuffle without their texts; what is found goes back to each text at once.
    rows = stored(rows, "texts")
    found = rows.select("row", words(F.col("_text")).alias("w")).select("row", each).withColumn("word", lowered(F.col("raw"))).join(wanted, "word")
    found = found.groupBy("row").agg(F.collect_list(F.struct("word", "pos", "first")).alias("found"))
    return rows.join(found, "row").select(key, "h", "row", words(F.col("_text")).alias("w"), F.explode("found").alias("x")).select(key, "h", "row", "w", "x.*").select(*out)


def once(postings: DataFrame, key: str) -> DataFrame:
    """The postings of words, of rows that repeat a key and text those of one row: else each would meet those of all others."""
    ends, found = postings.where(F.col("word") == _END), postings.where(F.col("word") != _END)
    repeats = ends.groupBy(F.col(key).alias("k"), F.col("h").alias("h2")).agg(F.min("row").alias("one"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("k", "h2", "one")
    repeats = stored(repeats.withColumn("size", F.lit("")), "repeats")
    same = (F.col("h") == F.col("h2")) & F.col(key).eqNullSafe(F.col("k"))
    return found.join(small(repeats, "size").drop("size"), same, "left").where(F.col("one").isNull() | (F.col("one") == F.col("row"))).select(*postings.columns)


def search(postings: DataFrame, key: str, plan: DataFrame, reach: int, slack: int = SLACK) -> DataFrame:
    """Matches (key, h, id, start, size, exact): offset-adjusted intersection of the rarest words' postings, then the whole window."""
    first = postings.where("first").select(key, "h", F.col("word").alias("word1"), "pos", "around")
    begun = first.join(small(plan, "word1"), "word1").withColumn("start", F.col("pos") - F.col("at1")).withColumn("there", F.col("start") + F.col("at2"))
    probes = F.array_distinct(F.array(F.floor((F.col("there") - slack) / _STRETCH), F.floor((F.col("there") + slack) / _STRETCH)))
    begun = begun.select(F.col(key).alias("k"), "h", "id", "start", "there", "pos", "around", "window", "size", "word2", F.explode(probes).alias("stretch"))
    second = postings.select(F.col(key).alias("k2"), F.col("h").alias("h2"), F.col("word").alias("w2"), F.col("pos").alias("pos2"), F.floor(F.col("pos") / _STRETCH).alias("s2"))
    same = (F.col("h") == F.col("h2")) & F.col("k").eqNullSafe(F.col("k2")) & (F.col("word2") == F.col("w2")) & (F.col("stretch") == F.col("s2"))
    met = begun.join(second, same & (F.abs(F.col("pos2") - F.col("there")) <= slack))
    left = F.greatest(F.col("pos") - reach, F.lit(0))
    phrase = F.slice("around", F.greatest(F.col("start") - left, F.lit(0)) + 1, F.col("size"))
    wide = F.slice("around", F.greatest(F.col("start") - slack - left, F.lit(0)) + 1, F.col("size") + 2 * slack + F.least(F.col("start") - slack, F.lit(0)))
    met = met.withColumns({"phrase": F.transform(phrase, lowered), "wide": F.transform(wide, lowered)})
    exact = (F.col("start") >= 0) & (F.col("pos2") == F.col("there")) & (F.col("phrase") == F.col("window"))
    near = F.size(F.array_except("window", "wide")) == 0
    return met.select(F.col("k").alias(key), "h", "id", "start", "size", exact.alias("exact"), near.alias("near")).where(F.col("exact") | F.col("near"))


def contamination(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with exact or proximity matches) and text_hash (xxhash64 of the text) of each row of docs."""
    reach = size - 1 + slack
    found = stored(windows(tests, item, "text", size).withColumn("id", F.monotonically_increasing_id()), "windows")
    vocabulary = found.select(F.explode("window").alias("word")).distinct()
    plan = stored(plans(found, frequencies(docs, text, vocabulary)), "plans")
    keys = plan.select(F.explode(F.array(F.struct(F.col("word1").alias("word"), F.lit(True).alias("first")), F.struct(F.col("word2").alias("word"), F.lit(False).alias("first")))).alias("x"))
    postings = stored(index(docs, key, text, keys.select("x.*").groupBy("word").agg(F.max("first").alias("first")), reach), "postings")

    met = stored(search(once(postings, key), key, plan, reach, slack), "matches")
    hits = met.where("exact").select(key, "h", "start", "size").distinct().withColumn("end", F.col("start") + F.col("size"))
    before = Window.partitionBy(key, "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = hits.withColumn("new", new).groupBy(key, "h").agg(F.sum("new").cast("long").alias("n_hit"))
    by_item = met.groupBy(key, "h", "id").agg(F.max("exact").alias("exact")).join(small(found.select("id", "items", F.array_join(F.col("items").cast("array<string>"), ",").alias("s")), "s").drop("s"), "id")
    by_item = by_item.select(key, "h", "exact", F.explode("items").alias("item")).groupBy(key, "h", "item").agg(F.max("exact").alias("exact"))
    items = by_item.groupBy(key, "h").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item").cast("string")))).alias("ids"), F.count(F.lit(1)).alias("n_near"))
    texts = postings.where(F.col("word") == _END).select(key, "h", F.col("pos").cast("long").alias("n_words"))
    found_in = n_hit.unionByName(items, allowMissingColumns=True).groupBy(F.col(key).alias("k"), F.col("h").alias("h2")).agg(*(F.max(c).alias(c) for c in ("n_hit", "ids", "n_near")))
    out = texts.join(found_in, (F.col("h") == F.col("h2")) & F.col(key).eqNullSafe(F.col("k")), "left")
    ids = F.coalesce("ids", F.expr("cast(array() as array<string>)"))
    return out.select(
        key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), texts["h"].alias("text_hash"),
    )
