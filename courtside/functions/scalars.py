"""Column functions. Comparisons with a missing value are false, never null, where the result is a flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STATE_SURFACES, SURFACE_CODES, SURFACE_SPELLINGS, UNKNOWN


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def to_date_strict(c: Column) -> Column:
    """yyyymmdd as a date; malformed text raises."""
    return F.to_date(c.cast("string"), "yyyyMMdd")


def lenient_double(c: Column) -> Column:
    return c.try_cast("double")


def log_gap(d: Column) -> Column:
    return F.log1p(F.abs(d))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def feature_surface(c: Column) -> Column:
    """The features' vocabulary: three spellings each of three surfaces; all else is Unknown."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SURFACE_SPELLINGS.items() for x in kv)), c), F.lit(UNKNOWN))


def surface_code(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SURFACE_CODES.items() for x in kv)), c), F.lit(SURFACE_CODES[UNKNOWN]))


def surface_of_code(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in SURFACE_CODES.items() for x in (v, k))), c.cast("int")), F.lit(UNKNOWN))


def known_or_unknown(c: Column, known: list[str] = STATE_SURFACES[:4]) -> Column:
    """A value of the list, anything else as Unknown."""
    return F.when(c.isin(known), c).otherwise(F.lit(UNKNOWN))


def is_top_10(rank: Column) -> Column:
    return flag((rank != 0) & (rank <= 10))


def top_10_vs_not(r1: Column, r2: Column) -> Column:
    return flag(((r1 <= 10) & (r2 > 10)) | ((r2 <= 10) & (r1 > 10)))


def young_vs_old(a1: Column, a2: Column) -> Column:
    return flag(((a1 < 25) & (a2 > 30)) | ((a2 < 25) & (a1 > 30)))


def tall_vs_short(h1: Column, h2: Column) -> Column:
    return flag(((h1 > 190) & (h2 < 180)) | ((h2 > 190) & (h1 < 180)))


def seeded_vs_unseeded(s1: Column, s2: Column) -> Column:
    return s1.isNotNull() != s2.isNotNull()


def same_hand(a: Column, b: Column) -> Column:
    return flag(a == b)


def left_vs_right(a: Column, b: Column) -> Column:
    return flag(((a == "L") & (b == "R")) | ((a == "R") & (b == "L")))


def or_unranked(c: Column, default: float = 999.0) -> Column:
    """0 and missing become the default."""
    return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(default))


def coin(id_: Column, seed: int) -> Column:
    """A fair coin fixed by id and seed, equal on every engine that has MD5."""
    return F.substring(F.md5(F.concat(id_.cast("string"), F.lit(f":{seed}"))), 1, 1) < "8"


def last_n(history: Column, n: int) -> Column:
    """The last n elements of an array, all of it when it is shorter."""
    return F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), n)


def last(history: Column) -> Column:
    return F.try_element_at(history, F.lit(-1))


def at_key(map_: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(map_, key), default)


def text_or_nan(c: Column) -> Column:
    """The text an encoder sees; a missing value is the text nan."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def shown(c: Column) -> Column:
    """Two decimals, for display. Ties go away from zero, by the shortest decimal that stands for the number: 0.125 and
    0.285 give 0.13 and 0.29, whatever their binary value."""
    return F.format_string("%.2f", c)


def required(c: Column, message: str) -> Column:
    """c, or an error when it is null."""
    return F.coalesce(c, F.raise_error(F.lit(message)).cast("string"))
