"""Sinks (K1-K8). Every writer is a distributed write of part files into a
directory; nothing is gathered into one document on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.operators.sequence import hash_partitions
from casework.sources.ranges import PIECE_END


def _csv_safe(df: DataFrame) -> DataFrame:
    """Arrays/structs cannot go into CSV: serialise them as JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None,
              compression: str | None = None) -> None:
    """K1/K2: header CSV, fixed field order, text cells quoted and kept as is
    (leading spaces and newlines survive a round trip)."""
    out = _csv_safe(df.select(*fields) if fields else df)
    w = (out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_jsonl(df: DataFrame, path: str, rows_a_file: int | None = None) -> None:
    """K4/K5: JSON Lines, one record per line, nested values kept. With ``rows_a_file`` they are
    gzipped: one task reads such a file, so none holds more rows than that."""
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    if rows_a_file:
        w = w.option("compression", "gzip").option("maxRecordsPerFile", rows_a_file)
    w.json(path)


#: Hits in a compressed file: about 100 MB of text.
HITS_A_FILE = 100_000


def write_hits(hits: DataFrame, path: str) -> None:
    """K4: the given hits as gzipped JSON Lines under ``hits`` and their number, as the
    original document's ``total``, under ``total``."""
    from casework.sources.readers import SOURCE_FIELDS

    write_jsonl(hits.select("hit_pos", F.struct(*[F.col(c) for c in SOURCE_FIELDS]).alias("_source"), "sort"), f"{path}/hits", HITS_A_FILE)
    write_jsonl(hits.agg(F.count(F.lit(1)).alias("value")), f"{path}/total")


def write_filtered(rows: DataFrame, keep: Column, path: str, marked: Column) -> dict[str, int]:
    """A20 with the write: the rows for which ``keep`` holds, as Parquet. The rows before, those
    kept and those of them that are ``marked`` are counted by the job that writes them, so
    the input is read once."""
    before, after = Observation(), Observation()
    n = F.count(F.lit(1)).alias("n")
    kept = rows.observe(before, n).where(keep).observe(after, n, F.count_if(marked).alias("marked"))
    kept.write.parquet(path)
    return {"n_total": before.get["n"], "n_mantidos": after.get["n"], "n_marcados": after.get["marked"]}


def write_text(df: DataFrame, col: str, path: str) -> None:
    """K6/K7: one text value per line/record."""
    df.select(F.col(col).cast("string")).write.mode("overwrite").text(path)


def write_volumes(df: DataFrame, col: str, path: str, piece: int = 512, pieces: int = 1 << 15) -> None:
    """K6/K7: long texts one after the other, gzipped, where empty lines mean nothing (JSON). A compressed file
    cannot be read from its middle, so a task writes its file in volumes, byte ranges that are cut at
    line breaks: each ``pieces`` pieces of ``piece`` characters and their last line's rest. The number that
    ends a volume's name is its place. An empty line ends a piece."""
    cut = F.regexp_extract_all(F.col(col), F.lit(rf"(?s)(.{{0,{piece}}}+[^\n]*+)(?:\n|\z)"), F.lit(1))
    rows = df.select(F.explode_outer(cut).alias("value")).where("value <> ''")
    rows.write.mode("overwrite").option("maxRecordsPerFile", pieces).option("lineSep", PIECE_END).text(path, compression="gzip")


def response_pages(hits: DataFrame, page_size: int = 10000) -> DataFrame:
    """Search-response documents of at most ``page_size`` hits each (the
    service's own page bound), one row per page, hits in position order."""
    from casework.sources.readers import SOURCE_FIELDS

    item = F.struct(F.col("hit_pos"),
                    F.struct(*[F.col(c) for c in SOURCE_FIELDS]).alias("_source"),
                    F.col("sort"))
    # A page's hits are all over the table: listed before they move they would only be sorted and
    # spilled. They move as rows, to so many partitions that each has a few pages.
    rows = hits.select(F.floor(F.col("hit_pos") / page_size).alias("pagina"), item.alias("item"))
    pages = rows.repartition(hash_partitions(hits), "pagina").groupBy("pagina").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    return pages.select(
        "pagina",
        F.struct(
            F.struct(F.size("items").cast("long").alias("value")).alias("total"),
            F.transform("items", lambda x: F.struct(x["_source"].alias("_source"), x["sort"].alias("sort")))
            .alias("hits")).alias("hits"))
