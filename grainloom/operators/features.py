"""Feature tables and exposure (P02-P08, A26-A30, D01, C12, C13, V13, V14 and the extensions of the survey's last section)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_zero
from ..functions.text import feature_token, window_label

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def columns_but(df: DataFrame, excluded: set[str]) -> list[str]:
    """P02."""
    return [c for c in df.columns if c not in excluded]


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """P03."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def columns_with(df: DataFrame, parts: list[str]) -> list[str]:
    """In their order, each once."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def numeric_columns(df: DataFrame, excluded: tuple[str, ...] = ()) -> list[str]:
    """Identifiers must be named as excluded."""
    return [c for c, t in df.dtypes if (t in NUMERIC or t.startswith("decimal")) and c not in excluded]


def resolved(df: DataFrame, wanted: str | None, aliases: list[str]) -> str:
    """The wanted column or the first alias that exists, by any letter case."""
    low = {c.lower(): c for c in df.columns}
    for c in ([wanted] if wanted else []) + aliases:
        if c.lower() in low:
            return low[c.lower()]
    raise KeyError(f"none of {[wanted, *aliases]} in {df.columns}")


def reordered(df: DataFrame, first: list[str]) -> DataFrame:
    """P08."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *(c for c in df.columns if c not in head))


def search(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Rows where one of the columns holds the word, in any letter case."""
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word.lower())) for c in columns)))


def contains_any(c: Column, words: list[str]) -> Column:
    """True without words."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(w.lower())) for w in words)) if words else F.lit(True)


def between(df: DataFrame, column: str, a: float, b: float) -> DataFrame:
    """Rows within both bounds, each from 0 to 1, in either order."""
    low, high = sorted(min(1.0, max(0.0, x)) for x in (a, b))
    return df.where(F.col(column).between(low, high))


def keyed(df: DataFrame, column: str, prefix: str, name: str) -> DataFrame:
    """Rows whose key has the prefix, with what stands behind it."""
    return df.where(F.startswith(F.col(column), F.lit(prefix))).withColumn(name, F.substring(column, len(prefix) + 1, 1 << 30))


def complete(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have all keys, and anything at all."""
    return df.na.drop(subset=keys).na.drop("all")


def classified(columns: list[str], rules: list[tuple[str, str]], other: str) -> list[tuple[str, str]]:
    """(column, family) by the first pattern that a name has."""
    import re

    return [(c, next((family for pattern, family in rules if re.search(pattern, c, re.I)), other)) for c in columns]


def approved_targets(df: DataFrame, wanted: list[str], strict: bool = True) -> list[str]:
    """The wanted columns that exist and are numeric; strict: all must."""
    good = [c for c in wanted if c in numeric_columns(df)]
    if strict and good != wanted:
        raise KeyError(f"no numeric columns: {[c for c in wanted if c not in good]}")
    return good


def labelled_edges(edges: DataFrame, relations: list[str], words: list[str], label: str) -> DataFrame:
    """Edges of the relations kept whole, and others whose label holds a word."""
    return edges.where(F.col("relation").isin(relations) | contains_any(F.col(label), words)) if words else edges.where(F.col("relation").isin(relations))


def stamped(df: DataFrame, name: str = "generated_at") -> DataFrame:
    """The time of the run, as ISO text in UTC."""
    return df.withColumn(name, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def shaped(df: DataFrame, key: str, long: tuple[str, str] | None, values: list[str] | None = None) -> DataFrame:
    """Means by key of a long table (names and values of its columns given) or of a wide one."""
    if long:
        return df.groupBy(key).pivot(long[0], values).agg(F.avg(long[1]))
    return df.groupBy(key).agg(*(F.avg(c).alias(c) for c in numeric_columns(df, (key,))))


def remapped(df: DataFrame, key: str, lookup: DataFrame, least: float = 0.5) -> DataFrame:
    """Keys replaced by a lookup (old, new) if it knows at least that share of the rows' keys, else left."""
    old = lookup.select(F.col("old").alias(key), "new").dropDuplicates([key])
    found = df.join(old, key, "left")
    rate = found.agg(F.avg(F.col("new").isNotNull().cast("int")).alias("_rate"))  # one row
    return found.crossJoin(F.broadcast(rate)).withColumn(key, F.when(F.coalesce(F.col("_rate"), F.lit(0.0)) >= least, F.col("new")).otherwise(F.col(key))).drop("new", "_rate")


def joined_tables(tables: list[DataFrame], key: str) -> DataFrame:
    """Left fold on key; columns that the left has already are dropped from the right."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t.select(key, *(c for c in t.columns if c not in out.columns)), key, "left")
    return out


def pivot_mean(df: DataFrame, key: list[str], name: str, value: str, values: list[str]) -> DataFrame:
    """Stated values keep the plan to one pass."""
    return df.groupBy(*key).pivot(name, values).agg(F.avg(value))


def values_of(df: DataFrame, name: str, most: int = 5_000) -> list[str]:
    """The distinct values of a column that are to be columns, sorted: more than `most` are an error."""
    values = [r[0] for r in df.select(name).distinct().orderBy(name).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"more than {most} columns; raise the bound or keep the long form")
    return values


def pivot_sum(df: DataFrame, key: list[str], name: str, value: str, most: int = 5_000) -> DataFrame:
    """All values of name (found first, at most `most`), absent ones 0."""
    named = df.withColumn("_n", feature_token(F.col(name)))
    values = values_of(named, "_n", most)
    return named.groupBy(*key).pivot("_n", values).agg(F.sum(value)).na.fill(0)


def feature_table(matrix: DataFrame, pivoted: DataFrame, key: str) -> DataFrame:
    """Pivoted columns beside a matrix; only they become 0 where an item has none."""
    return matrix.join(pivoted, key, "left").na.fill(0, subset=[c for c in pivoted.columns if c != key])


def design_matrix(mode: str, events: DataFrame, unit: str, items: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Features by participant and window: doses of columns (enriched), their means weighted by grams (kg), or mean vectors (embedding)."""
    key = ["participant", "window_id"]
    e = windowed(events, "ts", unit)
    if mode == "enriched":
        return exposure(e, items, columns, key)
    if mode == "kg":
        return exposure_mean(e, items, columns, key)
    if mode == "embedding":
        # A label that all rows share is no key.
        out = vector_means(e, items, ["participant"]).withColumn("window_id", window_label(F.lit(None), unit)) if unit == "participant" else vector_means(e, items, key)
        return out.select(*key, F.filter("_m", lambda x: x.isNotNull()).alias("embedding")).where(F.size("embedding") > 0)
    raise ValueError(mode)


def exposure(events: DataFrame, items: DataFrame, features: list[str], key: list[str], item: str = "item", grams: str = "grams") -> DataFrame:
    """Sum of feature * grams / 100 by key; null features count 0 (N20), null keys go."""
    e = events.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))).join(items.select(item, *features), item, "left")
    return e.groupBy(*key).agg(*(F.sum(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.coalesce(F.col(grams), F.lit(0.0)) / 100).alias(f) for f in features))


def exposure_mean(events: DataFrame, items: DataFrame, features: list[str], key: list[str], item: str = "item", grams: str = "grams") -> DataFrame:
    """Mean weighted by grams; 0 without grams."""
    e = events.join(items.select(item, *features), item, "left")
    g = F.coalesce(F.col(grams), F.lit(0.0))
    return e.groupBy(*key).agg(*(F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * g), F.sum(g)), F.lit(0.0)).alias(f) for f in features))


def windowed(events: DataFrame, ts: str, unit: str, name: str = "window_id") -> DataFrame:
    """D01."""
    return events.withColumn(name, window_label(F.col(ts), unit))


#: Cells of vectors up to which they are broadcast.
CELLS = 1 << 23


def vector_mean(events: DataFrame, vectors: DataFrame, key: list[str], item: str = "item", grams: str = "grams", vector: str = "embedding") -> DataFrame:
    """Weighted mean vector in long form: key, dim, value."""
    return vector_means(events, vectors, key, item, grams, vector).select(*key, F.posexplode("_m").alias("dim", "value")).where("value IS NOT NULL")


def vector_means(events: DataFrame, vectors: DataFrame, key: list[str], item: str = "item", grams: str = "grams", vector: str = "embedding") -> DataFrame:
    """Key and _m, its weighted mean vector (null in dimensions that none of its vectors has).

    Up to CELLS cells of vectors events come together by key, once, and meet the vectors there, so no vector is shuffled and a task holds the sums of its keys alone.
    Beyond, weights come together by key and item, both sides meet by item, and sums are made where they meet before keys come together. Each dimension is a sum of its own.
    """
    v = vectors.select(item, F.col(vector).alias("_v")).where(F.col(vector).isNotNull())
    least, width, cells = v.agg(F.min(F.size("_v")), F.max(F.size("_v")), F.sum(F.size("_v"))).first()
    few = (cells or 0) <= CELLS
    none = F.lit(0.0)
    if few:
        each = events.select(*key, item, F.coalesce(F.col(grams).cast("double"), none).alias("_g")).repartition(*key).join(F.broadcast(v), item)
    else:
        each = events.groupBy(*key, item).agg(F.coalesce(F.sum(grams).cast("double"), none).alias("_g")).join(v, item)
    dims = range(max(width or 0, 1))
    weight = lambda i: F.sum("_g") if least == width and width else F.sum(F.when(F.size("_v") > i, F.col("_g")))
    total = lambda i: F.sum(F.coalesce(F.get("_v", F.lit(i)).cast("double"), F.lit(0.0)) * F.col("_g"))
    sums = each.groupBy(*key).agg(*(weight(i).alias(f"_w{i}") for i in dims), *(total(i).alias(f"_t{i}") for i in dims))
    mean = lambda i: F.when(F.col(f"_w{i}").isNotNull(), F.coalesce(F.try_divide(f"_t{i}", f"_w{i}"), F.lit(0.0)))
    return sums.select(*key, F.array(*map(mean, dims)).alias("_m"))


def assembled(df: DataFrame, key: list[str], dim: str = "dim", value: str = "value", name: str = "embedding") -> DataFrame:
    """Vectors from their long form, in order."""
    return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(dim, value))), lambda x: x[value]).alias(name))


def participant_vectors(df: DataFrame, key: str, features: list[str], policy: str = "error") -> DataFrame:
    """One array a participant; repeated keys: error, mean or first (by all values)."""
    if policy == "mean":
        df = df.groupBy(key).agg(*(F.avg(f).alias(f) for f in features))
    elif policy == "first":
        df = df.groupBy(key).agg(F.min(F.struct(*features)).alias("_r")).select(key, "_r.*")
    else:
        from .quality import checked_unique

        df = checked_unique(df.select(key, *features), [key])
    return df.select(key, F.array(*(finite_or_zero(F.col(f)) for f in features)).alias("embedding"))


def per_kilogram(exposed: DataFrame, totals: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Extension: exposure per 1,000 g logged, and its log1p. totals: key, total_grams."""
    out = exposed.join(totals, key)
    rate = lambda f: F.coalesce(F.try_divide(F.col(f), F.col("total_grams")) * 1000, F.lit(0.0))
    return out.select(*key, *(rate(f).alias(f"{f}_per_kg") for f in features), *(F.log1p(F.greatest(rate(f), F.lit(0.0))).alias(f"{f}_log") for f in features))


def logging_quality(days: DataFrame, who: str, day: str, grams: str) -> DataFrame:
    """Extension: of daily sums: days logged, median, variation and largest gap; reliable with enough of the first and little of the last."""
    gap = F.datediff(F.col(day), F.lag(day).over(Window.partitionBy(who).orderBy(day)))
    out = days.withColumn("_gap", gap).groupBy(who).agg(
        F.count(F.lit(1)).alias("n_days"), F.percentile(grams, 0.5).alias("median_grams"), F.coalesce(F.try_divide(F.stddev_samp(grams), F.avg(grams)), F.lit(0.0)).alias("variation"), F.coalesce(F.max("_gap"), F.lit(0)).cast("int").alias("largest_gap"))
    return out.withColumn("reliable", (F.col("n_days") >= 5) & (F.col("largest_gap") <= 7))


def exposure_groups(df: DataFrame, key: str, value: str) -> DataFrame:
    """Extension: tertile, and top or bottom decile, by value and key; ranks come without one task that sees all rows."""
    from .windows import numbered

    n = df.agg(F.count(F.lit(1)).alias("_t"))
    at, total = F.col("_at"), F.col("_t")
    size, more = F.floor(total / 3), total % 3
    tertile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    rank = F.coalesce(F.try_divide(at, total - 1), F.lit(0.0))
    out = numbered(df.select(key, value), [value, key], "_at").crossJoin(F.broadcast(n))  # one row
    return out.select(key, value, tertile.cast("int").alias("tertile"), F.when(rank <= 0.1, "bottom").when(rank >= 0.9, "top").otherwise("middle").alias("decile_group"))
