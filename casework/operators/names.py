"""Attribute lookup by first name.

The dictionary is pre-aggregated once per upper-cased name (count + the
value to return), so the lookup is one equi-join per role instead of a scan
of the dictionary per row. Adaptive execution broadcasts the aggregated side
if its bytes allow; otherwise a shuffle join with skew handling is used (a
very common first name is the classic hot key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework import constants as K
from casework.functions.text import first_name


def aggregate_dictionary(dictionary: DataFrame, name_col: str = "first_name",
                         value_col: str = "classification", ambiguous: str = "null") -> DataFrame:
    """(_fn, _value): one row per upper-cased name. ``ambiguous`` decides the
    value for names with two or more rows: ``"null"`` (the code's rule) or
    ``"mode"`` (most frequent, lowest on ties: the documented rule)."""
    key = F.upper(F.col(name_col))
    n = F.count(F.lit(1))
    single = F.any_value(F.col(value_col))
    if ambiguous == "mode":
        multi = F.mode(F.col(value_col), deterministic=True)
    elif ambiguous == "null":
        multi = F.lit(None).cast("string")
    else:
        raise ValueError(ambiguous)
    return (dictionary.filter(key.isNotNull()).groupBy(key.alias("_fn"))
            .agg(F.when(n == 1, single).otherwise(multi).alias("_value")))


def lookup_attribute(df: DataFrame, roles: dict[str, str], dictionary: DataFrame,
                     ambiguous: str = "null", name_col: str = "first_name",
                     value_col: str = "classification") -> DataFrame:
    """For each ``source_col -> target_col`` in ``roles``: first name of
    ``source_col`` looked up in the dictionary. No first name or no match
    gives ``Indefinido``; ambiguous names follow ``ambiguous``."""
    agg = aggregate_dictionary(dictionary, name_col, value_col, ambiguous)
    out = df
    for i, (src, dst) in enumerate(roles.items()):
        fn, hit, val = f"_fn{i}", f"_hit{i}", f"_val{i}"
        lk = agg.select(F.col("_fn").alias(hit), F.col("_value").alias(val))
        out = out.withColumn(fn, first_name(F.col(src)))
        out = out.join(lk, out[fn] == lk[hit], "left")
        out = out.withColumn(dst, F.when(F.col(fn).isNull() | F.col(hit).isNull(),
                                         F.lit(K.UNKNOWN_SEX)).otherwise(F.col(val)))
        out = out.drop(fn, hit, val)
    return out
