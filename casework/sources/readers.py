"""Readers with explicit schemas.

No schema inference anywhere: case numbers are text with leading zeros and
must never be typed as numbers by a reader. Values are read as text and cast
one by one, so an odd value is null (or, in a subject list, its own element)
and takes no neighbour along; a document that is not JSON stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.sources.adapter import MOVEMENT_TYPE, SUBJECT_TYPE
from casework.sources.csv_ranges import CsvFiles
from casework.sources.json_ranges import JsonFiles
from casework.sources.ranges import numbered, stored

SOURCE_TYPE = T.StructType([
    T.StructField("numeroProcesso", T.StringType()),
    T.StructField("grau", T.StringType()),
    T.StructField("classe", T.StructType([T.StructField("codigo", T.LongType()),
                                          T.StructField("nome", T.StringType())])),
    T.StructField("formato", T.StructType([T.StructField("nome", T.StringType())])),
    T.StructField("orgaoJulgador", T.StructType([T.StructField("codigo", T.LongType()),
                                                 T.StructField("nome", T.StringType()),
                                                 T.StructField("codigoMunicipioIBGE", T.LongType())])),
    T.StructField("dataAjuizamento", T.StringType()),
    T.StructField("dataHoraUltimaAtualizacao", T.StringType()),
    T.StructField("assuntos", T.ArrayType(SUBJECT_TYPE)),
    T.StructField("movimentos", T.ArrayType(MOVEMENT_TYPE)),
])
HIT_TYPE = T.StructType([
    T.StructField("_source", SOURCE_TYPE),
    T.StructField("sort", T.ArrayType(T.LongType())),
])
SOURCE_FIELDS = [f.name for f in SOURCE_TYPE.fields]


def _loose(kind: T.DataType) -> T.DataType:
    """The type a document is read with: every scalar as text, and the
    elements of lists as their own JSON text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(T.StringType())
    return T.StringType()


def _element(text: Column, kind: T.DataType) -> Column:
    """A list element from its JSON text. One that is not an object becomes an
    object without values but for the name, which is empty (P4)."""
    if not isinstance(kind, T.StructType):
        return text.try_cast(kind)
    is_object = F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))
    value = lambda f: F.get_json_object(text, f"$.{f.name}").try_cast(f.dataType)
    other = lambda f: F.lit("" if f.name == "nome" else None).cast(f.dataType)
    return F.struct(*[F.when(is_object, value(f)).otherwise(other(f)).alias(f.name) for f in kind.fields])


def _strict(c: Column, kind: T.DataType) -> Column:
    """A loosely read value with its proper type."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_strict(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _element(x, kind.elementType))
    return c.try_cast(kind)


def _hit_columns(hit: Column) -> list[Column]:
    source = hit["_source"]
    return [*[_strict(source[f.name], f.dataType).alias(f.name) for f in SOURCE_TYPE.fields],
            _strict(hit["sort"], T.ArrayType(T.LongType())).alias("sort")]


#: Documents whose first positions may be broadcast: 16 MB of them.
MOST_PAGES = 1_000_000


def read_search_responses(spark: SparkSession, path: str, multi_line: bool = False, in_volumes: bool = False) -> DataFrame:
    """S3: search responses (``{hits: {total, hits: [...]}}``) -> one row per
    hit. ``hit_pos`` numbers the hits 0..N-1 by the document's own ``pagina``
    where it has one, then by file path, place in the file and place in the
    document.

    The hits do not move to be numbered. Where all documents have one page number (or none), the
    hits of each byte range are counted and prefix sums over the ranges give each range its first
    position; else each document gets its own from the sums over pages.
    A document that does not parse is an error. Pretty-printed documents need
    ``multi_line``: several tasks then share a file, cut at its line breaks. There
    an element of ``hits`` that is not an object is an error too. With ``in_volumes`` a file's
    ranges are the compressed volumes of ``writers.write_volumes``."""
    if multi_line:
        texts = JsonFiles(spark, path, in_volumes).in_order()
        hits = texts.select(F.col("_at").alias("hit_pos"), F.from_json("text", _loose(HIT_TYPE), {"mode": "FAILFAST"}).alias("hit"))
        return hits.select("hit_pos", *_hit_columns(F.col("hit"))).select("hit_pos", *SOURCE_FIELDS, "sort")
    hits = T.ArrayType(_loose(HIT_TYPE))
    schema = T.StructType([T.StructField("hits", T.StructType([T.StructField("hits", hits)])), T.StructField("pagina", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    docs = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.coalesce(F.col("pagina").try_cast("long"), F.lit(0)).alias("page"), F.monotonically_increasing_id().alias("doc"), "hits")
    pages = docs.agg(F.min("page").alias("a"), F.max("page").alias("b")).first()
    rows = docs.select("file", "block", "page", "doc", F.posexplode("hits.hits").alias("pos", "hit"))
    if pages.a == pages.b:
        # A task's rows of one range follow each other, so a row's place is its distance from the range's first.
        rows = rows.withColumn("local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        ranges = stored(rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("local").alias("first"), F.lit(0).alias("more")), "response-ranges")
        first = ranges.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "first")
        rows = rows.join(F.broadcast(first), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
        rows = numbered(rows.withColumn("place", F.col("local") - F.col("first")), ranges, 0)
    else:
        sizes = stored(docs.select("file", "block", "page", "doc", F.coalesce(F.array_size("hits.hits"), F.lit(0)).alias("n")), "response-documents")
        # One row for each page number.
        before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        whole = sizes.groupBy("page").agg(F.sum("n").alias("n")).select("page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        inside = Window.partitionBy("page").orderBy("file", "block", "doc").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(whole, "page")
        offsets = stored(offsets.select("doc", (F.col("offset") + F.col("inside")).alias("offset")), "response-offsets")
        small = offsets.count() <= MOST_PAGES
        rows = rows.join(F.broadcast(offsets) if small else offsets, "doc").withColumn("_at", F.col("offset") + F.col("pos"))
    return rows.select(F.col("_at").alias("hit_pos"), *_hit_columns(F.col("hit"))).select("hit_pos", *SOURCE_FIELDS, "sort")


def read_hits_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Hits as JSON Lines (``{hit_pos, _source, sort}`` per line)."""
    schema = T.StructType([T.StructField("hit_pos", T.LongType())] + _loose(HIT_TYPE).fields)
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return raw.select("hit_pos", *_hit_columns(F.struct("_source", "sort")))


def _named(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns from the texts c0, c1, ..., cast one by one; null where the text does not cast."""
    return rows.select(*[F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def _fitting(rows: DataFrame) -> DataFrame:
    """The rows; one with more cells than its header has names stops the job."""
    bad = F.raise_error(F.lit("a row has more fields than the header")).cast("boolean")
    return rows.where(F.when(F.col("_surplus"), bad).otherwise(True))


def read_csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header CSV read as text columns by name (like ``csv.DictReader``);
    cells beyond the header are left out. Each file's own header counts; a column that
    a file lacks is null, as are empty cells. Cells may hold separators, doubled quotes and line
    breaks, and a file is read by as many tasks as it has ranges."""
    return CsvFiles(spark, path).rows(columns).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def read_csv_in_order(spark: SparkSession, path: str, columns: list[str], ordinal: str) -> DataFrame:
    """S5 with the rows' order: ``ordinal`` numbers them 1..N by file name and
    place in the file, the order in which a sorted table is written."""
    return CsvFiles(spark, path).in_order(columns, 1).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], F.col("_at").alias(ordinal))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed CSV by column name, as :func:`read_csv_strings`; a row with more
    fields than its file's header is an error."""
    return _named(_fitting(CsvFiles(spark, path).rows(schema.fieldNames())), schema)


def read_gzip_csv(spark: SparkSession, path: str, schema: T.StructType,
                  skip_bad_lines: bool = False) -> DataFrame:
    """Gzip CSV by column name (decompressed natively; one task per file
    since gzip does not split). A row with more fields than its file's header, empty or not, is
    dropped with ``skip_bad_lines``, else an error; short rows and odd values are kept
    with nulls. Which columns are read changes no row."""
    rows = CsvFiles(spark, path).rows(schema.fieldNames())
    return _named(rows.where("not _surplus") if skip_bad_lines else _fitting(rows), schema)
