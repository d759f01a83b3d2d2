"""Case table operators: search top-n, flattening, subject and movement
projections, movement ordering, per-case text report (S1-S4, P1-P5, P10,
O1, O2, O5, K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import arrays as A
from casework.functions import time as TM

MOVEMENT_ARRAY = "array<struct<codigo:bigint,nome:string,dataHora:string>>"


# -- search (S1, S2, S4, O1) -------------------------------------------------------

def filing_order(desc: bool = True) -> list[Column]:
    ts = TM.parse_filing_utc(F.col("dataAjuizamento"))
    return [ts.desc_nulls_last() if desc else ts.asc_nulls_last(), F.col("hit_pos").asc()]


def has_subject_code(code: int) -> Column:
    return F.exists(F.coalesce(F.col("assuntos"),
                               F.array().cast("array<struct<codigo:bigint,nome:string>>")),
                    lambda a: a["codigo"] == F.lit(code))


def has_class_code(code: int) -> Column:
    return F.col("classe.codigo") == F.lit(code)


def search(hits: DataFrame, predicate: Column, size: int = K.MAX_HITS_PER_REQUEST,
           desc: bool = True) -> DataFrame:
    """Matching hits, newest filing first, at most ``size`` (a distributed
    top-k: ``TakeOrderedAndProject`` keeps ``size`` rows per partition)."""
    return hits.filter(predicate).orderBy(*filing_order(desc)).limit(size)


def hit_counts(hits: DataFrame, predicate: Column, size: int = K.MAX_HITS_PER_REQUEST) -> DataFrame:
    """Total matching hits and how many one request returns."""
    n = F.count_if(predicate)
    return hits.agg(n.alias("total_hits"), F.least(n, F.lit(size)).cast("long").alias("returned_hits"))


# -- flatten (P1, P2) ---------------------------------------------------------------

def flatten_hits(hits: DataFrame) -> DataFrame:
    """Hit documents -> case table (columns of the original table plus the
    explicit ordinal). A missing movement list becomes an empty list."""
    cols = [c for c in ("hit_pos",) if c in hits.columns] + [
        F.col("numeroProcesso").alias("numero_processo"),
        F.col("classe.nome").alias("classe"),
        F.col("dataAjuizamento").alias("data_ajuizamento"),
        F.col("dataHoraUltimaAtualizacao").alias("ultima_atualizacao"),
        F.col("formato.nome").alias("formato"),
        F.col("orgaoJulgador.codigo").alias("codigo"),
        F.col("orgaoJulgador.nome").alias("orgao_julgador"),
        F.col("orgaoJulgador.codigoMunicipioIBGE").alias("municipio"),
        F.col("grau"),
        F.col("assuntos"),
        F.coalesce(F.col("movimentos"), F.array().cast(MOVEMENT_ARRAY)).alias("movimentos"),
        F.get(F.col("sort"), 0).alias("sort"),
    ]
    return hits.select(*cols)


# -- row access (P10, O5) ---------------------------------------------------------

def head_n(df: DataFrame, n: int = 5, pos: str = "hit_pos") -> DataFrame:
    """First ``n`` rows by the explicit ordinal (a filter, pushed to the scan
    when the ordinal is stored)."""
    return df.filter(F.col(pos) < F.lit(n))


def hash_rank(key: Column, seed: int = 42) -> Column:
    """Deterministic pseudo-random rank of a non-negative integer key
    (Lehmer / MINSTD step; stays inside 64-bit arithmetic)."""
    m = 2147483647
    return F.pmod(F.pmod(key + F.lit(seed), F.lit(m)) * F.lit(48271), F.lit(m))


def sample_rows(df: DataFrame, n: int = K.SAMPLE_ROWS, key: str = "hit_pos", seed: int = 42) -> DataFrame:
    """``n`` rows in a seeded pseudo-random order (reproducible, a
    distributed top-k). ``df.sample(fraction, seed)`` is the fractional form."""
    return df.orderBy(hash_rank(F.col(key), seed), F.col(key)).limit(n)


# -- subjects and movements (P4, P5, O2) ---------------------------------------------

def with_subject_names(cases: DataFrame) -> DataFrame:
    return cases.withColumn("assuntos", A.subject_names("assuntos"))


def local_movements(movements) -> Column:
    """P5 + C10: [codigo, nome, local time]; a missing time stays missing."""
    return F.transform(movements, lambda m: F.struct(
        m["codigo"].alias("codigo"), m["nome"].alias("nome"),
        TM.to_local(TM.parse_instant_utc(m["dataHora"])).alias("data_hora_local"),
        m["dataHora"].alias("dataHora")))


def sorted_movements(movements) -> Column:
    """O2: movements by time ascending (instant order), missing times first,
    list position as tiebreak (natural struct order, no comparator)."""
    keyed = F.transform(movements, lambda m, i: F.struct(
        TM.parse_instant_utc(m["dataHora"]).alias("ts_utc"), i.alias("mov_pos"),
        m["codigo"].alias("codigo"), m["nome"].alias("nome"), m["dataHora"].alias("dataHora")))
    return F.transform(F.sort_array(keyed), lambda m: m.withField(
        "data_hora_local", TM.to_local(m["ts_utc"])))


def explode_movements(cases: DataFrame, movements: Column, keep: list[str]) -> DataFrame:
    """One row per list element with its 0-based position (flatMap, no shuffle)."""
    return cases.select(*keep, F.posexplode(movements).alias("mov_pos", "m"))


def py_list_repr(names: Column) -> Column:
    """Text of a list of strings as the original report prints it."""
    def item(n: Column) -> Column:
        # An apostrophe inside asks for double quotes, unless those occur too.
        plain = F.replace(n, F.lit("\\"), F.lit("\\\\"))
        double = n.contains("'") & ~n.contains('"')
        return (F.when(n.isNull(), F.lit("None")).when(double, F.concat(F.lit('"'), plain, F.lit('"')))
                .otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))))

    return F.concat(F.lit("["), F.array_join(F.transform(names, item), ", "), F.lit("]"))


def _text_or_none(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _local_ts_text(ts_utc: Column) -> Column:
    local = TM.to_local(ts_utc)
    return F.when(ts_utc.isNull(), F.lit("None")).otherwise(
        F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), TM.local_offset_text(ts_utc)))


def case_report(cases: DataFrame) -> DataFrame:
    """K6: one text block per case: header, subjects, one line per movement
    (time order), separator."""
    movs = F.transform(
        F.sort_array(F.transform(F.col("movimentos"), lambda m, i: F.struct(
            TM.parse_instant_utc(m["dataHora"]).alias("ts"), i.alias("pos"),
            m["codigo"].alias("codigo"), m["nome"].alias("nome"), m["dataHora"].alias("raw")))),
        lambda m: F.concat(
            F.when(m["raw"].isNull(), F.lit("None")).when(m["raw"] == "", F.lit(""))
            .otherwise(_local_ts_text(m["ts"])),
            F.lit(" | Cód: "), F.coalesce(m["codigo"].cast("string"), F.lit("None")),
            F.lit(" | Mov.: "), F.coalesce(m["nome"], F.lit("None")), F.lit(" \n")))
    report = F.concat(
        F.lit("Autos n. "), _text_or_none("numero_processo"), F.lit(", Classe: "), _text_or_none("classe"), F.lit("\n"),
        F.lit("Ajuizamento: "), _local_ts_text(TM.parse_filing_utc(F.col("data_ajuizamento"))),
        F.lit("\n"),
        F.lit("Assuntos: "), py_list_repr(A.subject_names("assuntos")), F.lit("\n\n"),
        F.array_join(movs, ""), F.lit(K.REPORT_SEPARATOR))
    return cases.select("hit_pos", "numero_processo", report.alias("report"))
