"""Name matching (J09-J17, C01-C03, C06, C07, G13): blocking by tokens, similarity, ranked candidates.

Blocking joins on tokens; equal names are scored once. Frequent tokens are
dealt out over blocks of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence_tier, name_similarity, normalize, normalize_unicode, tokens, trigrams
from .windows import top_k

#: Candidates that share most tokens and are scored, and candidates kept for an item.
POOL, KEEP = 500, 5
#: Pairs that one token makes in one place.
SPLIT = 1_000_000


def prepared(df: DataFrame, id_col: str, name_col: str, ascii_only: bool = False, unicode: bool = False) -> DataFrame:
    """id, name, norm, grams, toks of each row; unicode: names keep the letters of all scripts."""
    norm = normalize_unicode(F.col("name")) if unicode else normalize(F.col("name"), ascii_only)
    base = df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).withColumn("norm", norm)
    return base.withColumn("grams", trigrams(F.col("norm"))).withColumn("toks", tokens(F.col("norm")))


def inverted_index(names: DataFrame) -> DataFrame:
    """Token and the sorted ids of the names that hold it."""
    return names.select("id", F.explode("toks").alias("token")).groupBy("token").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.countDistinct("id").alias("n"))


def all_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of ids that shares a token, and how many they share: no cap.

    A token that would make more than SPLIT pairs is dealt out: its left names by hash into blocks of their own, each with the right names.
    """
    a = left.select(F.col("id").alias("left_id"), F.explode("toks").alias("token"))
    b = right.select(F.col("id").alias("right_id"), F.explode("toks").alias("token"))
    n = a.groupBy("token").agg(F.count(F.lit(1)).alias("_a")).join(b.groupBy("token").agg(F.count(F.lit(1)).alias("_b")), "token")
    frequent = n.select("token", F.ceil(F.col("_a") * F.col("_b") / SPLIT).cast("int").alias("_n")).where("_n > 1")
    blocks = F.coalesce("_n", F.lit(1))
    a = a.join(frequent, "token", "left").withColumn("_x", F.pmod(F.xxhash64("left_id"), blocks).cast("int")).drop("_n")
    b = b.join(frequent, "token", "left").withColumn("_x", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_n")
    return a.join(b, ["token", "_x"]).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared"))


def candidate_pool(left: DataFrame, right: DataFrame, pool: int = POOL) -> DataFrame:
    """Pairs of ids by shared tokens, the pool with most of them (ties by right id; N02); items that share none get the first of right."""
    shared = all_pairs(left, right)
    best = top_k(shared, ["left_id"], [F.desc("shared"), F.asc("right_id")], pool, "_r").drop("_r")
    first = right.select(F.col("id").alias("right_id")).orderBy("right_id").limit(pool)
    alone = left.select(F.col("id").alias("left_id")).join(shared.select("left_id").distinct(), "left_id", "left_anti")
    return best.unionByName(alone.crossJoin(F.broadcast(first)).withColumn("shared", F.lit(0).cast("long")))  # at most pool rows


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """name_score of each pair."""
    a = left.select(F.col("id").alias("left_id"), F.col("norm").alias("ln"), F.col("grams").alias("lg"), F.col("toks").alias("lt"))
    b = right.select(F.col("id").alias("right_id"), F.col("norm").alias("rn"), F.col("grams").alias("rg"), F.col("toks").alias("rt"))
    score = name_similarity(F.col("ln"), F.col("rn"), F.col("lg"), F.col("rg"), F.col("lt"), F.col("rt"))
    return pairs.join(a, "left_id").join(b, "right_id").withColumn("match_score", score).drop("ln", "lg", "lt", "rn", "rg", "rt")


def candidates(left: DataFrame, right: DataFrame, k: int = KEEP, pool: int = POOL) -> DataFrame:
    """left_id, right_id, match_score, candidate_rank (1 to k) of scores above 0; ties by shared tokens, then right id."""
    s = scored(candidate_pool(left, right, pool), left, right).where("match_score > 0")
    return top_k(s, ["left_id"], [F.desc("match_score"), F.desc("shared"), F.asc("right_id")], k, "candidate_rank").select("left_id", "right_id", "match_score", "shared", "candidate_rank")


def with_unmatched(left: DataFrame, found: DataFrame) -> DataFrame:
    """Items without a candidate get a placeholder for review."""
    return left.select(F.col("id").alias("left_id")).join(found, "left_id", "left").select(
        "left_id", "right_id", F.coalesce("match_score", F.lit(0.0)).alias("match_score"), F.coalesce("candidate_rank", F.lit(1)).alias("candidate_rank"),
        confidence_tier(F.coalesce("match_score", F.lit(0.0))).alias("confidence"))


def bilingual(english: str, native: str):
    """(score, language): the native score wins only if it is larger."""
    e, n = F.coalesce(F.col(english), F.lit(0.0)), F.coalesce(F.col(native), F.lit(0.0))
    return F.greatest(e, n).alias("match_score"), F.when(n > e, "native").otherwise("english").alias("match_language")


def exact_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (left_id, right_id) of rows (id, norm) with one normalised name."""
    x = a.where("norm <> ''").select(F.col("id").alias("left_id"), "norm").distinct()
    return x.join(b.where("norm <> ''").select(F.col("id").alias("right_id"), "norm").distinct(), "norm").select("left_id", "right_id").distinct()


def tiered(left: DataFrame, right: DataFrame, tiers: list[tuple[str, str]]) -> DataFrame:
    """Links by the first pair of columns, then by the next for rows that have none yet. Both sides have a column id."""
    out, rest = None, left
    for n, (x, y) in enumerate(tiers):
        b = right.where(F.col(y).isNotNull() & (F.col(y).cast("string") != "")).select(F.col("id").alias("right_id"), F.col(y).alias("_k")).distinct()
        got = rest.join(b, rest[x] == b["_k"]).select(rest["id"].alias("left_id"), "right_id", F.lit(n + 1).alias("tier"))
        out = got if out is None else out.unionByName(got)
        rest = rest.join(got.select(F.col("left_id").alias("_l")).distinct(), rest["id"] == F.col("_l"), "left_anti")
    return out


def overridden(mapping: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Corrections in the place of what was mapped, with rank 0."""
    return mapping.join(corrections.select(key).distinct(), key, "left_anti").unionByName(corrections.withColumn("candidate_rank", F.lit(0)), allowMissingColumns=True)


def vocabulary(names: DataFrame, shortest: int = 3) -> DataFrame:
    """C06."""
    return names.select(F.explode("toks").alias("token")).where(F.length("token") >= shortest).distinct()
