"""Text functions on columns (F01-F24, C16, C22, C32, C40). All stay in the JVM but Unicode normalisation, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no meaning in item names.
STOP_WORDS = ["and", "or", "with", "without", "the", "a", "an", "of", "to", "in", "raw", "fresh", "prepared", "cooked"]
# Texts that stand for a missing label.
MISSING_LABELS = ["", "nan", "none", "null"]


@F.pandas_udf(StringType())
def _ascii_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def _unicode_words(s: pd.Series) -> pd.Series:
    return s.str.lower().str.replace(r"[^\w%]+", " ", regex=True).str.strip()


def _beyond_ascii(c: Column) -> Column:
    """c where it is not ASCII, else null: only such texts travel to Python."""
    return F.when(F.octet_length(c) != F.length(c), c)


def normalize(c: Column, ascii_only: bool = False) -> Column:
    """folded to ASCII, lower case, everything but letters, digits and % one space. Null is the empty string.

    ascii_only: the input is known to be ASCII, so no Python is needed.
    """
    c = F.coalesce(c, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(c if ascii_only else F.coalesce(_ascii_fold(_beyond_ascii(c)), c)), "[^a-z0-9%]+", " "))


#: Texts of these characters alone are composed already: ASCII, letters of Latin-1, Greek, Cyrillic, Hebrew, kana and Han.
_COMPOSED = "^[\\x00-\\x7FÀ-ÖØ-öø-ÿΆΈ-ΊΌΎ-ΡΤ-ώЀ-џא-תぁ-ゖァ-ヺ一-鿿]*$"


def normalize_unicode(c: Column) -> Column:
    """as F01 with letters of all scripts kept. Only texts that may need composing travel to Python."""
    c = F.coalesce(c, F.lit(""))
    here = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_%]+", " "))
    return F.when(c.rlike(_COMPOSED), here).otherwise(_unicode_words(_compose(F.when(~c.rlike(_COMPOSED), c))))


def casefolded(c: Column) -> Column:
    """Compatibility-composed and case-folded."""
    return _casefold(F.coalesce(c, F.lit("")))


def loose_name(c: Column) -> Column:
    """Names that differ in case, underscores and spaces alone are equal."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[_\s]+", "")


def tokens(normal: Column) -> Column:
    """distinct words of a normalised text without stop words, sorted."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_sort(F.array_distinct(F.filter(F.split(normal, " "), lambda x: (x != "") & ~F.array_contains(stop, x))))


def trigrams(normal: Column) -> Column:
    """the character trigrams of a text (spaces as _), with repeats; shorter texts whole, the empty one none."""
    s = F.replace(normal, F.lit(" "), F.lit("_"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(s == "", F.expr("cast(array() as array<string>)")).when(F.length(s) <= 3, F.array(s)).otherwise(grams)


def counted_cosine(a: Column, b: Column) -> Column:
    """cosine of two bags of strings, 0 if one is empty."""
    distinct = F.array_distinct(a)
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x)).cast("double")
    dot = F.aggregate(distinct, F.lit(0.0), lambda acc, x: acc + times(a, x) * times(b, x))
    norm = lambda bag: F.sqrt(F.aggregate(F.array_distinct(bag), F.lit(0.0), lambda acc, x: acc + times(bag, x) * times(bag, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def jaccard(a: Column, b: Column) -> Column:
    """of two sets of tokens, 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Ratio of the lengths of two texts if one holds the other, else 0."""
    held = F.contains(a, b) | F.contains(b, a)
    return F.when(held & (a != "") & (b != ""), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))


def name_similarity(a: Column, b: Column, grams_a: Column, grams_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """of normalised names with their trigrams and tokens: equal is 1, blank is 0."""
    score = 0.55 * counted_cosine(grams_a, grams_b) + 0.35 * jaccard(tokens_a, tokens_b) + 0.10 * containment(a, b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.round(score, 4))


def slug(c: Column, ascii_only: bool = False) -> Column:
    """a normalised text with underscores; the empty one is unknown."""
    s = F.regexp_replace(normalize(c, ascii_only), "[ %]+", "_")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def canonical_id(name: Column, category: Column, ascii_only: bool = False) -> Column:
    """F08."""
    return F.concat(F.lit("canonical:"), slug(name, ascii_only), F.lit(":"), slug(category, ascii_only))


def feature_token(c: Column, longest: int = 120) -> Column:
    """safe as a column name."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, longest)
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def strip_taxon(c: Column) -> Column:
    """without a rank prefix such as g__."""
    return F.regexp_replace(c, "^[a-z]__+", "")


def pipe_split(c: Column) -> Column:
    """trimmed parts between pipes, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def pipe_join(c: Column) -> Column:
    """Sorted distinct parts, joined."""
    return F.array_join(F.array_sort(F.array_distinct(c)), " | ")


def compact_list(c: Column, limit: int = 6) -> Column:
    """parts between pipes and commas, cut at the first colon (N14), distinct in order."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[|,]"), lambda x: F.trim(F.substring_index(x, ":", 1)))
    return F.slice(F.array_distinct(F.filter(parts, lambda x: x != "")), 1, limit)


def english_list(parts: Column, limit: int = 5) -> Column:
    """"a", "a and b" or "a, b, and c" of parts distinct but for case; "unavailable" if none."""
    low = F.transform(parts, F.lower)
    kept = F.slice(F.filter(parts, lambda x: (x != "")), 1, 10_000)
    kept = F.filter(F.transform(kept, lambda x, i: F.when(F.array_position(low, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())
    kept = F.slice(kept, 1, limit)
    n = F.size(kept)
    return (
        F.when(n == 0, F.lit("unavailable")).when(n == 1, F.get(kept, F.lit(0))).when(n == 2, F.concat_ws(" and ", kept))
        .otherwise(F.concat(F.array_join(F.slice(kept, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.get(kept, n - 1)))
    )


def clean_label(c: Column) -> Column:
    """one space between words; what stands for missing is empty."""
    s = F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    return F.when(F.lower(s).isin(MISSING_LABELS), F.lit("")).otherwise(s)


def adaptive_number(c: Column) -> Column:
    """fewer decimals for larger values, without zeros at the end."""
    a = F.abs(c)
    cut = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(a >= 100, F.format_string("%.0f", c)).when(a >= 10, cut(F.format_string("%.1f", c))).when(a >= 1, cut(F.format_string("%.2f", c))).otherwise(cut(F.format_string("%.3f", c)))


# Nutrients given in grams, and words in other nutrients' names with their units; the first that fits counts.
GRAMS = ["protein", "total lipid (fat)", "carbohydrate, by difference", "water", "fiber, total dietary", "sugars, total", "sugars, total including nlea", "starch", "fructose", "glucose", "sucrose", "lactose", "maltose", "galactose", "alcohol, ethyl", "ash"]
MILLIGRAMS = ["caffeine", "theobromine"]
MINERALS = ["calcium", "iron", "magnesium", "phosphorus", "potassium", "sodium", "zinc", "copper", "selenium", "manganese", "fluoride"]
VITAMINS = ["vitamin", "folate", "carotene", "retinol", "tocopherol", "biotin", "iodine"]


def nutrient_unit(name: Column) -> Column:
    """F16: the unit of a nutrient by its name."""
    low = F.lower(name)
    return (
        F.when(name == "Energy", "kcal").when(low.isin(GRAMS), "g").when(low.isin(MILLIGRAMS), "mg").when(low.rlike("vitamin a, iu|international units"), "IU")
        .when(low.rlike("|".join(MINERALS)), "mg or source-native mineral unit").when(low.rlike("|".join(VITAMINS)), "source-native vitamin unit").otherwise("g or source-native unit")
    )


def confidence_tier(score: Column) -> Column:
    """Of a name similarity."""
    return F.when(score >= 0.86, "high").when(score >= 0.72, "medium").when(score >= 0.58, "low").otherwise("review")


def sentence(name: Column, category: Column, facts: Column) -> Column:
    """a card sentence from a name, its category and an array of facts."""
    return F.concat(name, F.lit(" is a "), F.lower(category), F.lit(" item"), F.when(F.size(facts) > 0, F.concat(F.lit(" with "), english_list(facts))).otherwise(F.lit("")), F.lit("."))


def evidence_tokens(c: Column) -> Column:
    """words of three characters or more, of letters, digits, - and _."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_-]+", " ")
    return F.filter(F.split(s, " "), lambda x: F.length(x) >= 3)


def hash_bucket(token: Column, dims: int = 64) -> Column:
    """md5(token) modulo dims (a power of two up to 2^28)."""
    return F.conv(F.right(F.md5(token.cast("binary")), F.lit(7)), 16, 10).cast("int") % dims


def hash_sign(token: Column, salt: str = "sign") -> Column:
    """+1 or -1 by the parity of md5(salt:token)."""
    odd = F.conv(F.right(F.md5(F.concat(F.lit(f"{salt}:"), token).cast("binary")), F.lit(1)), 16, 10).cast("int") % 2
    return F.when(odd == 1, F.lit(-1.0)).otherwise(F.lit(1.0))


def part_count(c: Column, mark: str = ",") -> Column:
    """parts that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), mark), lambda x: F.trim(x) != ""))


def stem(path: Column) -> Column:
    """the last part of a path, without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1), r"\.[A-Za-z0-9]+$", "")


def embedding_text(name: Column, category: Column) -> Column:
    """F22, C33."""
    return F.when(F.trim(F.coalesce(category, F.lit(""))) == "", name).otherwise(F.concat(name, F.lit(" | category: "), category))


def display_label(short: Column, original: Column, longest: int = 90) -> Column:
    """Short (original), cut."""
    s = F.when(clean_label(short) == "", original).when(short == original, short).otherwise(F.concat(short, F.lit(" ("), original, F.lit(")")))
    return F.when(F.length(s) > longest, F.concat(F.substring(s, 1, longest - 3), F.lit("..."))).otherwise(s)


def matches_any(c: Column, patterns: list[str]) -> Column:
    """whether one of the patterns is found, in any letter case."""
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def node_key(kind: str | Column, ident: Column) -> Column:
    """Kind:id, with ids such as 12.0 as 12."""
    return F.concat_ws(":", F.lit(kind) if isinstance(kind, str) else kind, F.regexp_replace(ident.cast("string"), r"\.0$", ""))


def label_key(kind: str, label: Column) -> Column:
    """One key for a label however it is written."""
    return F.concat(F.lit(f"{kind}:"), feature_token(label))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """C40."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def window_label(ts: Column, unit: str) -> Column:
    """The calendar window of a time: participant, day, week (Monday/Sunday), month or year; missing_time if null."""
    day = F.to_date(ts)
    monday = F.date_trunc("week", ts).cast("date")
    label = {
        "participant": F.lit("all"), "day": F.date_format(day, "yyyy-MM-dd"), "month": F.date_format(day, "yyyy-MM"), "year": F.date_format(day, "yyyy"),
        "week": F.concat(F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")),
    }[unit]
    return label if unit == "participant" else F.coalesce(label, F.lit("missing_time"))
