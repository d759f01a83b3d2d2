"""Summaries: frequencies, time series, top-k, data-quality reports
(A1, A3-A13, A20, O3, O4, O8, P12, K7).

Every summary is a partial aggregate (map-side combine, then a small
shuffle); windows run only over the already-aggregated, bounded outputs
(24 hour buckets, a month calendar, a handful of classes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework import constants as K


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A1: frequency of the non-null values, most common first (value as tiebreak)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(col)))


def hour_histogram(df: DataFrame, ts: Column, name: str = "hora") -> DataFrame:
    """Rows per hour of day, only hours that occur, ordered by hour."""
    return (df.select(F.hour(ts).alias(name)).filter(F.col(name).isNotNull())
            .groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(name))


def office_hours_by_value(hist: DataFrame, hour: str = "hora",
                          first: int = K.OFFICE_FIRST_HOUR, end: int = K.OFFICE_END_HOUR) -> DataFrame:
    """A5: totals inside [first, end) and outside, by hour value."""
    inside = F.col(hour).between(first, end - 1)
    return hist.agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("long").alias("expediente"),
                    F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("long").alias("fora"))


def office_hours_by_position(hist: DataFrame, hour: str = "hora",
                             first: int = K.OFFICE_FIRST_HOUR, end: int = K.OFFICE_END_HOUR) -> DataFrame:
    """The same split by *position* in the sorted histogram (slice
    ``[first:end]``), which equals the by-value split only when every
    earlier hour occurs. The window runs over at most 24 rows."""
    p = F.row_number().over(Window.orderBy(hour)) - 1
    ranked = hist.withColumn("_p", p)
    inside = F.col("_p").between(first, end - 1)
    return ranked.agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).cast("long").alias("expediente"),
                      F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).cast("long").alias("fora"))


def shares(split: DataFrame, labels: list[str] = K.OFFICE_LABELS) -> DataFrame:
    """Each part with its percentage of the total, and as the label shows
    it (two decimals)."""
    parts = split.select(F.explode(F.array(
        F.struct(F.lit(labels[0]).alias("rotulo"), F.col("expediente").alias("n")),
        F.struct(F.lit(labels[1]).alias("rotulo"), F.col("fora").alias("n")))).alias("p")).select("p.*")
    total = F.sum("n").over(Window.partitionBy())
    parts = parts.withColumn("pct", F.when(total > 0, F.col("n") * 100.0 / total))
    return parts.withColumn("pct_rotulo", F.format_string("%.2f%%", "pct"))


def monthly_series(df: DataFrame, ts: Column, drop_first: bool = True,
                   label_prefix: str = K.MONTH_LABEL_PREFIX) -> DataFrame:
    """Rows per calendar month with zero-filled gaps; the first
    month is dropped (it may be incomplete); label ``Mês de YYYY-MM``.
    The calendar is generated from the month range (size = months spanned)."""
    months = df.select(F.trunc(ts.cast("date"), "MM").alias("mes")).filter(F.col("mes").isNotNull())
    counts = months.groupBy("mes").agg(F.count(F.lit(1)).alias("n"))
    bounds = counts.agg(F.min("mes").alias("lo"), F.max("mes").alias("hi"))
    cal = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("mes"), "lo")
    series = cal.join(counts, "mes", "left").select("mes", "lo", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    if drop_first:
        series = series.filter(F.col("mes") > F.col("lo"))
    return series.select(F.concat(F.lit(label_prefix), F.date_format("mes", "yyyy-MM")).alias("mes"), "n") \
        .orderBy("mes")


def date_range(df: DataFrame, ts: Column) -> DataFrame:
    """Row count, first and last timestamp."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("data_inicial"), F.max(ts).alias("data_final"))


def top_units(df: DataFrame, keys: list[str], counted: str, n: int = K.TOP_UNITS) -> DataFrame:
    """Non-null values of ``counted`` per key group, rows with
    a null key dropped, top ``n`` with the keys as tiebreak (distributed top-k)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return (df.filter(cond).groupBy(*keys).agg(F.count(counted).alias("n"))
            .orderBy(F.desc("n"), *[F.asc(k) for k in keys]).limit(n))


def top_units_text(top: DataFrame, keys: list[str]) -> DataFrame:
    """K7: ``municipio | orgao |n`` lines."""
    return top.select(F.format_string("%s | %s |%s", *[F.col(k) for k in keys], F.col("n")).alias("linha"),
                      "n", *keys)


def count_per_value(df: DataFrame, col: str, values: list[str], total_name: str = "total") -> DataFrame:
    """One-pass counts of each listed value plus the total."""
    aggs = [F.count(F.lit(1)).alias(total_name)]
    aggs += [F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values]
    return df.agg(*aggs)


def null_counts(df: DataFrame, only_nonzero: bool = True) -> DataFrame:
    """Missing values per column (one aggregate, then unpivot)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "coluna", "n_nulos")
    return long.filter(F.col("n_nulos") > 0) if only_nonzero else long


def column_profile(df: DataFrame) -> DataFrame:
    """Type and non-null count per column (``df.info``)."""
    types = dict(df.dtypes)
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "coluna", "nao_nulos")
    mapping = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return long.select("coluna", mapping[F.col("coluna")].alias("tipo"), "nao_nulos")


def shape(df: DataFrame) -> DataFrame:
    """Rows (an aggregate) and columns (schema metadata)."""
    return df.agg(F.count(F.lit(1)).alias("n_linhas")).withColumn("n_colunas", F.lit(len(df.columns)))


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many, or one row that says
    there are none (``nenhum``, 0)."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    # One row per column: the schema bounds it.
    long = wide.unpivot([], [F.col(f"`{c}`") for c in df.columns], "coluna", "faltantes")
    some = long.where("faltantes > 0")
    none = long.agg(F.sum("faltantes").alias("faltantes")).where("faltantes = 0").select(F.lit("nenhum").alias("coluna"), "faltantes")
    return some.unionByName(none)


def filter_report(df: DataFrame, collected: Column, kept: Column) -> DataFrame:
    """Rows before and after a filter in one pass, with the kept share."""
    n_col = F.count_if(collected)
    n_keep = F.count_if(collected & kept)
    return df.agg(F.count(F.lit(1)).alias("n_total"), n_col.alias("n_coletados"),
                  n_keep.alias("n_com_texto"), (n_col - n_keep).alias("n_sem_texto"),
                  F.when(n_col > 0, n_keep * 100.0 / n_col).alias("pct_com_texto"))
