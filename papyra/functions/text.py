"""Text functions with the semantics of a Python runtime, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, as a line end, and as a number or a date in text.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
NUMBER = r"^\s*[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
SPECIAL_NUMBER = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"
DATE, COMPACT_DATE = r"^\d{4}-\d{2}-\d{2}$", r"^\d{8}$"


def tokens(text: Column) -> Column:
    """Words between white space, of all of Unicode and the four separators U+001C to U+001F; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda x: x != "")


def lines(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: F.size(tokens(x)) > 0)


def to_number(text: Column) -> Column:
    """The double that text writes, underscores between digits allowed; null if it writes none."""
    plain = F.when(text.rlike(NUMBER), F.trim(F.replace(text, F.lit("_"), F.lit(""))).try_cast("double"))
    word = F.lower(F.trim(text))
    special = F.when(word.contains("nan"), F.lit(float("nan"))).when(word.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(text.rlike(SPECIAL_NUMBER), special).otherwise(plain)


def is_date(text: Column) -> Column:
    """Whether text writes a day of the calendar, as yyyy-mm-dd or yyyymmdd."""
    dashed = F.when(text.rlike(DATE), text).when(text.rlike(COMPACT_DATE), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
    return F.coalesce(dashed.try_cast("date").isNotNull(), F.lit(False))


def slug(text: Column) -> Column:
    """el_ and the lower-case letters and digits of text, runs of others as one underscore."""
    return F.concat(F.lit("el_"), F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def section_number(text: Column) -> Column:
    """The dotted number that text begins with; null if it begins with none."""
    return F.nullif(F.regexp_extract(text, r"(?U)^(\d+(?:\.\d+)+)\s", 1), F.lit(""))


def joined_versions(versions: Column) -> Column:
    """k=v of a map, sorted, with semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(versions)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def id_shaped(text: Column) -> Column:
    """Whether text is an id that a log may hold."""
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}\z"), F.lit(False))
