"""Driver tables -> search hits (the landed case-document table).

The driver data is a TPC-H-like star schema; the pipeline reads court-case
search hits. This adapter derives one hit per ``orders`` row: the customer and
nation give the court unit, the order's ``lineitem`` rows (with ``part``)
give the movement list and the subject list. The mapping is written in plain
expressions that have a one-to-one SQL twin in ``casework.plans.oracle``.

Scale notes: the movement list is built with one ``groupBy(l_orderkey)``
(lineitems per order are bounded by the document format; real input arrives
already nested, see ``readers.read_search_hits``). The customer join runs on
the narrow order columns before the arrays are attached, so the wide rows are
shuffled once, and the joins on the order key share one partitioning.
``hit_pos`` is a dense ordinal computed by range partitioning
(``operators.sequence``), never by a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.operators.sequence import hash_partitions, with_sequence
from casework.sources.tables import Tables

# Bump when the mapping changes: landed tables are keyed by it.
ADAPTER_VERSION = 3

# Adapter mapping (our own test-data design, see FIXTURES.md section 2).
CLASS_BY_PRIORITY = [
    ("1-URGENT", 1, "Agravo de Instrumento"),
    ("2-HIGH", 2, "Apelação Cível"),
    ("3-MEDIUM", 3, "Recurso Inominado Cível"),
]
OTHER_CLASS_NAME = "Procedimento Comum Cível"
MOVEMENT_BY_FLAGS = [
    ("A", "F", "Procedência"),
    ("A", "O", "Improcedência"),
    ("R", "F", "Improcedência do pedido e improcedência do pedido contraposto"),
    ("R", "O", "Procedência em Parte"),
    ("N", "F", "Procedência do pedido e procedência do pedido contraposto"),
    ("N", "O", "Expedição de documento"),
]
SUBJECT_BY_TYPE = [
    ("SMALL", 12487, "Obrigação de Fazer / Não Fazer"),
    ("MEDIUM", 1, "Indenização por Dano Moral"),
    ("LARGE", 2, "Tutela de Urgência"),
    ("ECONOMY", 3, "Fornecimento de Medicamentos - SUS"),
    ("PROMO", 4, "Acordo de Não Persecução Penal"),
    ("STANDARD", 5, "Planos de Saúde (Reajuste)"),
]
CAPITAL_NAME = "Fortaleza"
NULL_MUNICIPALITY_NATION = 24
ISO_MS_Z = "yyyy-MM-dd'T'HH:mm:ss'.000Z'"
COMPACT = "yyyyMMddHHmmss"

MOVEMENT_TYPE = T.StructType([
    T.StructField("codigo", T.LongType()),
    T.StructField("nome", T.StringType()),
    T.StructField("dataHora", T.StringType()),
])
SUBJECT_TYPE = T.StructType([
    T.StructField("codigo", T.LongType()),
    T.StructField("nome", T.StringType()),
])


def _plus_seconds(ts, secs):
    return F.timestamp_add("SECOND", secs, ts)


def _case(pairs, default):
    expr = None
    for cond, value in pairs:
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default)


def case_number(k):
    """Case number of order key ``k``: every 10th order is the same case seen
    at the second instance (rule N2)."""
    base = F.when(k % 10 == 9, k - 1).otherwise(k)
    return F.lpad(base.cast("string"), 20, "0")


def instance(k):
    return F.when(k % 10 == 9, F.lit("G2")).otherwise(F.lit("G1"))


def _movements(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                           "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                           "l_linestatus", "l_shipdate")
    part = t.part.select("p_partkey", "p_type")
    li = li.join(part, li.l_partkey == part.p_partkey, "left")
    # The rows move once, as numbers. Movement and subject are made of them
    # before they are listed: a row at a time this is compiled, in a list not.
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_type"]
    nome = _case([((F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls), F.lit(n))
                  for rf, ls, n in MOVEMENT_BY_FLAGS], F.lit(None).cast("string"))
    secs = (F.col("l_partkey") * 3571 + F.col("l_suppkey") * 97) % 86400
    data_hora = F.when(F.col("l_partkey") % 50 == 0, F.lit(None).cast("string")).otherwise(
        F.date_format(_plus_seconds(F.col("l_shipdate"), secs), ISO_MS_Z))
    ptype = F.col("p_type")
    code = _case([(ptype == ty, F.lit(c)) for ty, c, _ in SUBJECT_BY_TYPE], F.lit(0)).cast("long")
    name = _case([(ptype == ty, F.lit(n)) for ty, _, n in SUBJECT_BY_TYPE], F.initcap(ptype))
    movement = F.struct(F.col("l_linenumber").cast("long").alias("codigo"), nome.alias("nome"), data_hora.alias("dataHora"))
    subject = F.struct(code.alias("codigo"), name.alias("nome"))
    rows = li.repartition(hash_partitions(li), "l_orderkey").select(
        "l_orderkey", "l_shipdate", F.struct(*order, movement.alias("movement"), subject.alias("subject")).alias("item"))
    per_order = rows.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("item")).alias("items"),
        F.max("l_shipdate").alias("last_ship"))
    return per_order.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("items.movement").alias("movimentos"),
        F.array_distinct(F.col("items.subject")).alias("assuntos"),
        "last_ship")


def hit_positions(t: Tables) -> DataFrame:
    """(o_orderkey, hit_pos): position in the search response, filing date
    descending, order key as tiebreak."""
    keys = t.orders.select("o_orderkey", "o_orderdate")
    return with_sequence(keys, [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()],
                         "hit_pos").select("o_orderkey", "hit_pos")


def build_hits(t: Tables, positions: bool = True) -> DataFrame:
    """One row per hit with the nested shape of a search document."""
    nation = t.nation.select("n_nationkey", "n_name")
    cust = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                             "o_orderpriority")
    o = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    if positions:
        o = o.join(hit_positions(t), "o_orderkey")
    o = o.join(_movements(t), "o_orderkey", "left")

    k = F.col("o_orderkey")
    filed = _plus_seconds(F.col("o_orderdate"), (k * 7919) % 86400)
    filed_text = F.when(k % 97 == 0, F.date_format(filed, ISO_MS_Z)).otherwise(
        F.date_format(filed, COMPACT))
    updated = _plus_seconds(F.coalesce(F.col("last_ship"), _plus_seconds(F.col("o_orderdate"), F.lit(86400))),
                            k % 3600)
    prio = F.col("o_orderpriority")
    classe = F.struct(
        _case([(prio == p, F.lit(c)) for p, c, _ in CLASS_BY_PRIORITY],
              F.substring(prio, 1, 1).cast("long")).cast("long").alias("codigo"),
        _case([(prio == p, F.lit(n)) for p, _, n in CLASS_BY_PRIORITY],
              F.lit(OTHER_CLASS_NAME)).alias("nome"))
    unit_place = F.when(F.col("c_nationkey") % 5 == 0, F.lit(CAPITAL_NAME)).otherwise(F.col("n_name"))
    orgao = F.struct(
        F.col("o_custkey").alias("codigo"),
        F.concat(F.lit("Vara "), F.col("c_mktsegment"), F.lit(" de "), unit_place).alias("nome"),
        F.when(F.col("c_nationkey") == NULL_MUNICIPALITY_NATION, F.lit(None).cast("long"))
        .otherwise(F.col("c_nationkey").cast("long")).alias("codigoMunicipioIBGE"))
    # Epoch milliseconds of the (UTC wall clock) filing time, without any
    # dependence on the session time zone.
    epoch_ms = (F.unix_date(F.to_date(filed)).cast("long") * 86400 + F.hour(filed) * 3600
                + F.minute(filed) * 60 + F.second(filed)) * 1000
    cols = []
    if positions:
        cols.append(F.col("hit_pos"))
    cols += [
        case_number(k).alias("numeroProcesso"),
        instance(k).alias("grau"),
        classe.alias("classe"),
        F.struct(F.col("o_orderstatus").alias("nome")).alias("formato"),
        orgao.alias("orgaoJulgador"),
        filed_text.alias("dataAjuizamento"),
        F.date_format(updated, ISO_MS_Z).alias("dataHoraUltimaAtualizacao"),
        F.coalesce(F.col("assuntos"), F.array().cast(T.ArrayType(SUBJECT_TYPE))).alias("assuntos"),
        F.col("movimentos").cast(T.ArrayType(MOVEMENT_TYPE)).alias("movimentos"),
        F.array(epoch_ms).alias("sort"),
        k.alias("o_orderkey"),
    ]
    return o.select(*cols)
