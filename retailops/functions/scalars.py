"""Scalar column functions.

All of these are built-in Spark expressions (codegen-friendly, JVM side); no
Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "rnd", "safe_div", "parse_number", "clean_text", "strip_description",
    "item_key", "word_set_key", "strip_numeric_prefix", "repair_quotes",
    "try_ts_ntz", "duration_hours", "shift_type", "ceil9", "col_or", "num_text",
    "NUMBER_RE", "SHIFT_BINS", "SHIFT_LABELS",
]

# A plain decimal number, optionally signed, optionally with an exponent.
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Shift bins (left-closed hours) and their labels.
SHIFT_BINS = [0, 6, 12, 17, 22, 24]
SHIFT_LABELS = ["overnight", "morning", "afternoon", "evening", "late_night"]


def col_or(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, n: int) -> Column:
    """Round half away from zero through DECIMAL so Spark and SQL engines agree."""
    return F.round(col_or(c).cast("decimal(38,9)"), n).cast("double")


def safe_div(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """``a / b`` when ``b > 0`` else ``default`` (ANSI division by zero never fires)."""
    a, b = col_or(a), col_or(b)
    out = F.when(b > 0, a / b)
    return out.otherwise(F.lit(default)) if default is not None else out


def parse_number(c: Column | str) -> Column:
    """Formatted number text -> DOUBLE.  Trim, strip quotes, drop thousands
    commas; blank, ``-`` and junk become NULL."""
    t = F.trim(col_or(c))
    s = F.replace(F.trim(F.when(t.contains('"'), F.regexp_replace(t, r'^"+|"+$', "")).otherwise(t)), F.lit(","), F.lit(""))
    return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))


def clean_text(c: Column | str) -> Column:
    """Trim, strip quotes, collapse blanks, drop trailing and leading dots/commas."""
    s = F.trim(F.regexp_replace(F.trim(col_or(c)), r'^"+|"+$', ""))
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"[.,]+$", "")
    s = F.regexp_replace(s, r"^[.,]+\s*", "")
    return F.trim(s)


def strip_description(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col_or(c), r"\s+", " "))


def item_key(c: Column | str) -> Column:
    """Normalised product key: upper, trim, drop trailing ``.``/``,``, collapse blanks."""
    s = F.upper(F.trim(col_or(c)))
    s = F.regexp_replace(s, r"[.,]+$", "")
    return F.regexp_replace(s, r"\s+", " ")


def word_set_key(c: Column | str) -> Column:
    """Order-free word set of a key, as a canonical string."""
    words = F.filter(F.split(F.trim(col_or(c)), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def strip_numeric_prefix(c: Column | str) -> Column:
    return F.regexp_replace(col_or(c), r"^\d+\s+", "")


def repair_quotes(c: Column | str) -> Column:
    return F.replace(col_or(c), F.lit("''"), F.lit("'"))


def try_ts_ntz(c: Column | str, pattern: str) -> Column:
    """Wall-clock TIMESTAMP_NTZ (independent of the session time zone); bad text
    is NULL: the raising parser only runs where the tolerant one succeeded."""
    c = col_or(c)
    return F.when(F.try_to_timestamp(c, F.lit(pattern)).isNotNull(), F.to_timestamp_ntz(c, F.lit(pattern)))


def duration_hours(c: Column | str) -> Column:
    """``H:M:S`` (dots allowed) -> hours; anything else -> NULL."""
    parts = F.split(F.regexp_replace(F.trim(col_or(c)), r"\.", ":"), ":")
    h, m, s = (F.get(parts, i).try_cast("double") for i in range(3))
    ok = (F.size(parts) == 3) & h.isNotNull() & m.isNotNull() & s.isNotNull()
    return F.when(ok, h + m / 60.0 + s / 3600.0)


def shift_type(hour: Column | str) -> Column:
    h = col_or(hour)
    out = None
    for lo, hi, label in zip(SHIFT_BINS[:-1], SHIFT_BINS[1:], SHIFT_LABELS):
        cond = (h >= lo) & (h < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def ceil9(c: Column | str) -> Column:
    """``ceil`` after rounding to 9 dp, so 2.0000000001 from float noise stays 2."""
    return F.ceil(rnd(c, 9)).cast("bigint")


def num_text(c: Column | str, d: int = 2) -> Column:
    """Number as text with ``d`` decimals, rounded half up through DECIMAL."""
    return rnd(c, d).cast(f"decimal(38,{d})").cast("string")
