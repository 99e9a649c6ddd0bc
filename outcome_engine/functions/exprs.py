"""Scalar column expressions (all JVM-side, no Python UDF).

Each helper returns a ``Column`` built from ``pyspark.sql.functions`` so it stays
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

_WS_EDGES = r"^\s+|\s+$"
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(col(c), _WS_EDGES, "")


def clean_text(c, na_tokens: Sequence[str] = ("nan",)) -> Column:
    """Trimmed text; the literal ``nan`` (text form of a missing value) becomes null."""
    s = strip(col(c).cast("string"))
    return F.when(s.isin(*na_tokens), F.lit(None).cast("string")).otherwise(s)


def na_to_null(c) -> Column:
    """Cell texts that stand for a missing value become null (compared as they are, before any trimming)."""
    return F.when(~col(c).isin(*C.NA_TOKENS), col(c))


def to_number(c) -> Column:
    """Text to double; anything that is not a plain decimal/scientific number is null."""
    s = strip(col(c).cast("string"))
    num = F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))
    return nan_to_null(num)


def to_date(c, formats: Sequence[str]) -> Column:
    """Text to date trying several formats in order; unparsable text is null."""
    s = strip(col(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats])


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(c)


def title_case(c) -> Column:
    """Python ``str.title()``: upper-case the first letter of every run of letters.

    Spark's ``initcap`` only capitalises after a space ("e-commerce" stays
    "E-commerce"); splitting into letter / non-letter runs fixes that.
    """
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 0)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def replace_chain(c, pairs: Sequence[tuple[str, str]], whole_word: bool = False) -> Column:
    """Replacements one after the other; ``whole_word`` leaves matches inside longer words alone."""
    out = col(c)
    for old, new in pairs:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}])\Q{old}\E(?![\p{{L}}\p{{N}}])", new) if whole_word else F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_category(item: Column, whole_word: bool = False) -> Column:
    s = F.regexp_replace(strip(item), r"\s+", " ")
    return replace_chain(title_case(s), C.CATEGORY_FIXES, whole_word)


def clean_category_list(c, whole_word: bool = False) -> Column:
    """Split on ``|``, clean every item, drop empty items, re-join; null if nothing is left."""
    items = F.transform(F.split(col(c), r"\|"), lambda x: clean_category(x, whole_word))
    kept = F.filter(items, lambda x: x != "")
    return F.when(col(c).isNull(), F.lit(None).cast("string")).otherwise(
        F.nullif(F.array_join(kept, "|"), F.lit("")))


def any_substring(c, words: Sequence[str]) -> Column:
    """1 if any word is a substring of the text, 0 otherwise (null text -> 0)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | col(c).contains(w)
    return F.coalesce(hit, F.lit(False)).cast("int")


def flag(cond: Column) -> Column:
    """Boolean condition to 0/1 with null -> 0 (pandas comparison semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def domain_type(url) -> Column:
    u = F.lower(col(url))
    out = F.lit("Other")
    for needle, label in reversed(C.DOMAIN_RULES):
        out = F.when(u.contains(needle), F.lit(label)).otherwise(out)
    return F.when(col(url).isNull(), F.lit("No Website")).otherwise(out)


def bucketize(c, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Right-closed buckets ``(e[i], e[i+1]]`` like ``pandas.cut``; outside -> null."""
    x = col(c)
    out = F.lit(None).cast("string")
    for i in reversed(range(len(labels))):
        lo, hi = edges[i], edges[i + 1]
        lower_ok = (x >= F.lit(lo)) if (include_lowest and i == 0) else (x > F.lit(lo))
        upper_ok = F.lit(True) if hi == float("inf") else (x <= F.lit(hi))
        out = F.when(lower_ok & upper_ok, F.lit(labels[i])).otherwise(out)
    return out


def bucket_order(c, labels: Sequence[str]) -> Column:
    """Position (0-based) of a bucket label, for ordering and empty-bucket emission."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(labels))):
        out = F.when(col(c) == F.lit(labels[i]), F.lit(i)).otherwise(out)
    return out


def clip(c, lo=None, hi=None) -> Column:
    """Null-safe clip (null stays null); ``lo``/``hi`` may be numbers or columns."""
    x = col(c)
    if lo is not None:
        lo_c = lo if isinstance(lo, Column) else F.lit(lo)
        x = F.when(x < lo_c, lo_c).otherwise(x)
    if hi is not None:
        hi_c = hi if isinstance(hi, Column) else F.lit(hi)
        x = F.when(x > hi_c, hi_c).otherwise(x)
    return x


def at_least(c, floor) -> Column:
    return clip(c, lo=floor)


def safe_divide(num, den, default: float = 0.0) -> Column:
    """``default`` when the denominator is null or zero, else num/den; clipped to +-1e10."""
    n, d = col(num).cast("double"), col(den).cast("double")
    q = F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(F.try_divide(n, d))
    return clip(q, -C.SAFE_DIVIDE_LIMIT, C.SAFE_DIVIDE_LIMIT)


def safe_log10(c) -> Column:
    x = at_least(col(c).cast("double"), C.SAFE_LOG_FLOOR)
    return clip(F.log10(x), -C.SAFE_LOG_LIMIT, C.SAFE_LOG_LIMIT)


def snake_to_title(c) -> Column:
    return title_case(F.replace(col(c), F.lit("_"), F.lit(" ")))


def outcome_of(status) -> Column:
    s = col(status)
    out = F.lit(None).cast("string")
    for k, v in reversed(list(C.OUTCOME_OF_STATUS.items())):
        out = F.when(s == F.lit(k), F.lit(v)).otherwise(out)
    return out


def pct(num: Column, den: Column) -> Column:
    """100*num/den from integer counts (bit-identical in every engine); 0/0 -> null."""
    return F.try_divide(F.lit(100.0) * num.cast("double"), den.cast("double"))


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))
