"""Column functions: text, dates, numbers, arrays, hashes, JSON and claim checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# strings and names


def normalised(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def code(c: Column) -> Column:
    """Trimmed, upper-cased, inner white space removed, dashes as underscores."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\s+", ""), "-", "_")


def year_in(c: Column) -> Column:
    """First year from 1900 to 2099 in a text, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(c, "((?:19|20)[0-9]{2})", 1), F.lit("")), F.lit("9999")).cast("long")


def leading_year(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("long")


def joined_set(c: str, sep: str = "|") -> Column:
    """Sorted distinct values of a group as one string."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def number(c: Column) -> Column:
    """A number, or null where the text is none."""
    return F.trim(c).try_cast("double")


def truth(c: Column, kind: str = "true_only") -> Column:
    """Text to boolean. true_only: "true" is true, all else false. false_only: "false" is false, all else true.

    strict: true, 1, yes and false, 0, no; anything else raises.
    """
    t = F.lower(F.trim(c.cast("string")))
    if kind == "true_only":
        return F.coalesce(t == "true", F.lit(False))
    if kind == "false_only":
        return F.coalesce(t != "false", F.lit(True))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("no truth value: "), F.coalesce(t, F.lit("null")))).cast("boolean"))


# dates


def parsed_date(c: Column, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats])


def anchor_in_year(year: Column, day: Column) -> Column:
    """The calendar day of ``day`` in another year; a day that the month lacks falls to the 28th."""
    text = lambda d: F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.month(day).cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.coalesce(F.to_date(F.try_to_timestamp(text(F.dayofmonth(day)), F.lit("yyyy-MM-dd"))), F.to_date(F.try_to_timestamp(text(F.lit(28)), F.lit("yyyy-MM-dd"))))


def day_cycle(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year, on a circle of 365.25 days."""
    angle = 2 * F.pi() * F.dayofyear(day) / 365.25
    return F.sin(angle), F.cos(angle)


# arrays


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(a))


def array_median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def outer_product(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance on a sphere of radius 6371.0088 km."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def spectral_filters(s: Column, alpha: float) -> tuple[Column, Column]:
    return s / (s * s + alpha), s * s / (s * s + alpha)


# numbers


def close(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def next_level(coverage: Column, nominal: float = 0.9, most: float = 0.995) -> Column:
    """Level for the next period: raised by what the last one missed, up to a bound."""
    return F.least(F.lit(most), nominal + F.greatest(F.lit(0.0), nominal - coverage))


# hashes and seals


def row_text(*columns: str) -> Column:
    """One canonical line for a row; null reads as a mark of its own."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def seal(df: DataFrame, line: Column, digits: int = 4) -> DataFrame:
    """(digest, rows): a hash tree over the SHA-256 digests of a table's lines, the same for any order of its rows.

    Leaves are the digests that share their first ``digits`` hexadecimal digits, in order; each level above takes two
    digits less. A leaf holds a 16 ** digits-th part of the rows, so no task sees the table.
    """
    own = df.select(F.sha2(line, 256).alias("h"))
    out = own.groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("rows"))
    for left in [*range(digits - 2, 0, -2), 0]:
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "")
        keys = [F.substring("p", 1, left).alias("q")] if left else []
        out = out.groupBy(*keys).agg(F.sha2(ordered, 256).alias("d"), F.sum("rows").alias("rows"))
        out = out.withColumnRenamed("q", "p") if left else out
    return out.select(F.col("d").alias("digest"), "rows")


def seal_sql(lines: str, digits: int = 4) -> str:
    """The same in SQL over a query that gives a column l."""
    out = f"SELECT substr(h, 1, {digits}) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS rows FROM (SELECT sha256(l) AS h FROM ({lines})) GROUP BY 1"
    for left in range(digits - 2, 0, -2):
        out = f"SELECT substr(p, 1, {left}) AS p, sha256(string_agg(d, '' ORDER BY p)) AS d, sum(rows) AS rows FROM ({out}) GROUP BY substr(p, 1, {left})"
    return f"SELECT sha256(string_agg(d, '' ORDER BY p)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM ({out})"


def count_sketch_place(marker: Column, width: int) -> tuple[Column, Column]:
    """Bucket and sign of a marker in a count sketch, from its md5: the same in every engine."""
    number = lambda at: F.conv(F.substring(F.md5(marker.cast("string")), at, 8), 16, 10).cast("long")
    return F.pmod(number(1), F.lit(width)), F.when(F.pmod(number(9), F.lit(2)) == 0, 1).otherwise(-1)


# claims

NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def printed(x: Column, pattern: str) -> Column:
    """The number as C's printf writes it: the double's exact value, rounded half to even; null stays null.

    ``format_string`` rounds the shortest decimal half up (0.125 becomes 0.13) and writes "null" for null.
    """
    return F.udf(lambda v: None if v is None else pattern % v, "string", useArrow=True)(x.cast("double"))


def claimed_numbers(text: Column) -> Column:
    """Numbers that do not follow a letter, digit or underscore; none of a null text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?:^|[^A-Za-z0-9_])({NUMBER})"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def untraceable(claimed: Column, evidence: Column, tolerance: float = 1e-6) -> Column:
    """Claimed numbers that no evidence number is within tolerance of."""
    return F.filter(claimed, lambda c: ~F.exists(evidence, lambda e: F.abs(c - e) <= tolerance))


def phrases_in(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, p))
