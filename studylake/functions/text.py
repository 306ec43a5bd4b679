"""Column expressions over text that all families share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def once(c: Column, f) -> Column:
    """f(c) with c worked out once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def missing(c: Column) -> Column:
    """Null where the text is null or empty."""
    return F.nullif(c, F.lit(""))


def half_up(c: Column) -> Column:
    """Rounds to the next whole number, halves up."""
    return F.floor(c + 0.5)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half up; 0 where whole is 0 or null."""
    return F.when(whole > 0, half_up(100.0 * part / whole)).otherwise(F.lit(0)).cast("long")


def natural_key(c: Column) -> Column:
    """Sorts texts with the numbers in them by value, of any length: before each run of digits, without zeros in front, stands
    their number, and before that the number of its own digits, which is one digit."""
    runs = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=[0-9])", "")
        size = F.length(digits).cast("string")
        return F.concat(F.length(size).cast("string"), size, digits)

    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(F.lower(x))), "")


def lines(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row for each line of a text: keys, line_no from 0, line."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def joined_lines(rows: DataFrame, keys: list[str], order: str, value: str, out: str, sep: str = "\n") -> DataFrame:
    """The values of a group in order as one text."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(got, lambda x: x["v"]), sep).alias(out))


def micros(c: Column) -> Column:
    """Microseconds of a timestamp with or without zone (in the session's zone)."""
    return F.unix_micros(c.cast("timestamp"))
