"""The three stages of the original pipeline on user data (not the driver
tables): DataFrame in, DataFrame out, nothing collected.

    hits = readers.read_search_responses(spark, "responses/", multi_line=True)
    sel = select_cases(hits)                       # notebook: decisions and selection
    recs = pages_to_records(pages_df)              # collector: fields from saved pages
    table = results_table(recs, sel["union"], sel["numbers"])
    enriched = enrich(table, dictionary_df)        # first-name attributes
    ml = model_table(hits, sel["union"], enriched) # feature table
    report = analysis(hits)                        # second notebook's summaries
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import arrays as A
from casework.functions import time as TM
from casework.operators import analytics as AN
from casework.operators import cases as C
from casework.operators import decisions as D
from casework.operators import features as FT
from casework.operators import names as NM
from casework.operators import pages as PG
from casework.operators.joins import lookup_left, semi
from casework.operators.sequence import with_sequence


def select_cases(hits: DataFrame, dedup: bool = False) -> dict[str, DataFrame]:
    """Case table, decisions per hit, first decision per case, the four
    outcome types, and the ordered case-number list. The selected hits are
    all those of a selected case, of any instance; ``dedup`` keeps each
    case's first one alone (N2)."""
    cases = C.flatten_hits(hits)
    first = D.first_decision(cases)
    union = D.decisions_union(first)
    selected = semi(hits.withColumnRenamed("numeroProcesso", "numero_processo"), union, "numero_processo")
    if dedup:
        first_hit = selected.groupBy("numero_processo").agg(F.min("hit_pos").alias("hit_pos"))
        selected = semi(selected, first_hit, "hit_pos")
    return {"cases": cases, "decisions": D.decisions_per_case(cases), "first": first,
            "union": union, "numbers": D.distinct_cases(union),
            "selected_hits": selected.withColumnRenamed("numero_processo", "numeroProcesso")}


def pages_to_records(pages: DataFrame, key: str = "numero_processo") -> DataFrame:
    """Saved pages ``(key, html)`` -> collected records."""
    return PG.extract(pages, key)


def results_table(records: DataFrame, union: DataFrame, numbers: DataFrame) -> DataFrame:
    """F5 + J2 + P9: found records with decision text, the binary target by
    case number (last duplicate wins), ids 1..N in list order."""
    valid = records.filter(~F.col("status").isin(*K.DROPPED_STATUSES) & F.col("texto_decisao").isNotNull())
    flags = union.select("numero_processo", D.favourable().alias("sentenca_favoravel"),
                         F.struct("type_order", "hit_pos").alias("_pos"))
    with_flag = lookup_left(valid, flags, "numero_processo", ["sentenca_favoravel"], "_pos")
    ordered = with_flag.join(numbers.withColumnRenamed("numeroProcesso", "numero_processo"),
                             "numero_processo", "left")
    numbered = with_sequence(ordered, [F.col("ordem").asc_nulls_last(), F.col("numero_processo")], "id", start=1)
    return numbered.select("id", "numero_processo", "juiz", "requerente", "texto_decisao",
                           "sentenca_favoravel", "status")


def enrich(table: DataFrame, dictionary: DataFrame, ambiguous: str = "null",
           name_col: str = "first_name", value_col: str = "classification") -> DataFrame:
    """Sex of judge and claimant by first name."""
    return NM.lookup_attribute(table, {"juiz": "sexo_juiz", "requerente": "sexo_requerente"},
                               dictionary, ambiguous, name_col, value_col)


def model_table(hits: DataFrame, union: DataFrame, enriched: DataFrame) -> DataFrame:
    """Features of every selected hit (all instances) joined to the enriched
    records, then the ML table (M1-M10)."""
    cases = semi(C.flatten_hits(hits), union, "numero_processo")
    feats = FT.case_features(cases, keep=["hit_pos"])
    e = enriched.select("numero_processo", "sexo_juiz", "sexo_requerente", "sentenca_favoravel", "status",
                        "texto_decisao")
    return FT.ml_table(feats.join(e, "numero_processo", "inner"))


def analysis(hits: DataFrame, subject: str = K.MEMBER_SUBJECT) -> dict[str, DataFrame]:
    """The second notebook: subject filter, hour histogram, office hours,
    monthly series, date range, top court units, subject combinations."""
    cases = C.flatten_hits(hits)
    member = cases.filter(F.array_contains(A.subject_names("assuntos"), subject))
    local = TM.to_local(TM.parse_filing_utc(F.col("data_ajuizamento")))
    hist = AN.hour_histogram(member, local)
    split = AN.office_hours_by_value(hist)
    keys = ["municipio", "orgao_julgador"]
    top = AN.top_units(member, keys, "codigo")
    return {
        "member": member, "hours": hist, "office_hours": split,
        "office_hours_positional": AN.office_hours_by_position(hist), "shares": AN.shares(split),
        "monthly": AN.monthly_series(member, local), "range": AN.date_range(member, local),
        "top_units": top, "top_units_text": AN.top_units_text(top, keys),
        "subject_combos": AN.value_counts(cases.select(A.subject_names("assuntos").alias("nomes")), "nomes"),
    }
