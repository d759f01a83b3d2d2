"""Queries: feature extraction and the model-ready table."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import arrays as A
from casework.functions import text as X
from casework.operators import features as FT
from casework.plans import datasets as DS
from casework.plans.oracle import DECISION_PRED, with_base
from casework.plans.registry import register
from casework.plans.sqlfrag import contains_any, q

def _rounded(x: str, places: int) -> str:
    """Half to even by the double's exact value, in 128-bit integers."""
    one = "CAST(pow(2.0, 69) AS HUGEINT)"
    part = f"(CAST(({x} - floor({x})) * pow(2.0, 69) AS HUGEINT) * {10 ** places})"
    units, rest = f"({part} // {one})", f"({part} % {one})"
    up = f"CASE WHEN 2 * {rest} > {one} OR (2 * {rest} = {one} AND {units} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(CAST(floor({x}) * {10 ** places} + {units} + {up} AS DOUBLE) / CAST({10 ** places} AS DOUBLE))"


_FEAT_CTES = {
    "fx": f"""
fx AS (
  SELECT c.*, try_strptime(data_ajuizamento, '%Y%m%d%H%M%S') AS filed,
    split_part(replace(ultima_atualizacao, 'Z', ''), '.', 1) AS upd_txt,
    lower(array_to_string(list_transform(assuntos, lambda a: coalesce(a.nome, '')), ' ')) AS subj_txt,
    list_filter(movimentos, lambda m: coalesce({DECISION_PRED}, false)
      AND try_cast(replace(m.dataHora, 'Z', '+00:00') AS TIMESTAMPTZ) IS NOT NULL)[1].dataHora AS dec_time
  FROM cases c
)""",
    "fy": r"""
fy AS (
  SELECT *, CASE WHEN regexp_matches(upd_txt, 'T.*[+-]\d\d:?\d\d$') THEN NULL ELSE try_cast(upd_txt AS TIMESTAMP) END AS upd
  FROM fx
)""",
    "fz": """
fz AS (
  SELECT *, (filed IS NOT NULL AND upd IS NOT NULL) AS ok,
    CASE WHEN filed IS NOT NULL AND upd IS NOT NULL
         THEN CAST(floor(date_diff('second', filed, upd) / 86400) AS INTEGER) ELSE 0 END AS dias
  FROM fy
)""",
    "feat": f"""
feat AS (
  SELECT hit_pos, numero_processo,
    dias AS dias_desde_ajuizamento,
    CASE WHEN ok THEN CAST(year(filed) AS INTEGER) ELSE 0 END AS ano_ajuizamento,
    CASE WHEN ok THEN CAST(month(filed) AS INTEGER) ELSE 0 END AS mes_ajuizamento,
    CASE WHEN ok AND isodow(filed) = 1 THEN 1 ELSE 0 END AS eh_segunda,
    CASE WHEN ok AND isodow(filed) = 5 THEN 1 ELSE 0 END AS eh_sexta,
    CASE WHEN contains(upper(coalesce(orgao_julgador, '')), {q(K.CAPITAL_MARKER)}) THEN 1 ELSE 0 END AS municipio_fortaleza,
    CAST(len(assuntos) AS INTEGER) AS qtd_assuntos,
    CASE WHEN contains(subj_txt, {q(K.URGENCY_WORDS[0])}) AND contains(subj_txt, {q(K.URGENCY_WORDS[1])}) THEN 1 ELSE 0 END AS tem_tutela_urgencia,
    CASE WHEN contains(subj_txt, {q(K.OBLIGATION_PHRASE)}) THEN 1 ELSE 0 END AS tem_obrigacao_fazer,
    CASE WHEN contains(subj_txt, {q(K.MORAL_DAMAGE_PHRASE)}) THEN 1 ELSE 0 END AS tem_dano_moral,
    CASE WHEN len(assuntos) = 0 THEN {q(K.DEFAULT_SUBJECT)} ELSE coalesce(assuntos[1].nome, {q(K.DEFAULT_SUBJECT)}) END AS assunto_principal,
    CAST(len(movimentos) AS INTEGER) AS qtd_movimentos,
    CASE WHEN dias > 0 THEN {_rounded('(len(movimentos) / dias)', K.VELOCITY_DECIMALS)} ELSE 0.0 END AS velocidade_movimentos,
    CASE WHEN CAST(substr(dec_time, 12, 2) AS INTEGER) BETWEEN {K.LUNCH_FIRST_HOUR} AND {K.LUNCH_LAST_HOUR} THEN 1 ELSE 0 END AS eh_horario_almoco,
    CAST(len(assuntos) * len(movimentos) AS INTEGER) AS complexidade_score,
    CASE WHEN {contains_any(f"lower(coalesce(classe, {q(K.DEFAULT_SUBJECT)}))", K.APPEAL_WORDS)} THEN 1 ELSE 0 END AS tem_recurso
  FROM fz
)""",
    "mlj": """
mlj AS (
  SELECT f.*, e.sexo_juiz, e.sexo_requerente, e.sentenca_favoravel, e.status, e.texto_decisao
  FROM feat f JOIN enr e ON e.numero_processo = f.numero_processo
  WHERE f.numero_processo IN (SELECT numero_processo FROM dunion)
)""",
}

_SEX = "CASE {c} WHEN 'M' THEN 0 WHEN 'F' THEN 1 ELSE -1 END"
_TRUTHY = "CASE WHEN {c} THEN 1 ELSE 0 END"
# The subjects of the adapter's rule, plus the default for hits without any,
# with the column names expected for them.
_VOCAB = {
    "Obrigação de Fazer / Não Fazer": "eh_obrigacao_de_fazer__nao_fazer",
    "Indenização por Dano Moral": "eh_indenizacao_por_dano_moral",
    "Tutela de Urgência": "eh_tutela_de_urgencia",
    "Fornecimento de Medicamentos - SUS": "eh_fornecimento_de_medicamentos__sus",
    "Acordo de Não Persecução Penal": "eh_acordo_de_nao_persecucao_penal",
    "Planos de Saúde (Reajuste)": "eh_planos_de_saude_reajuste",
    "Desconhecido": "eh_desconhecido",
}
_ONE_HOT_SQL = ",\n    ".join(f"CAST(assunto_principal = {q(name)} AS INTEGER) AS {column}" for name, column in _VOCAB.items())
_ML_COLS = ("dias_desde_ajuizamento, ano_ajuizamento, mes_ajuizamento, eh_segunda, eh_sexta, "
            "municipio_fortaleza, qtd_assuntos, tem_tutela_urgencia, tem_obrigacao_fazer, tem_dano_moral, "
            "qtd_movimentos, velocidade_movimentos, eh_horario_almoco, complexidade_score, tem_recurso")
_FEAT_ALL = "numero_processo, hit_pos, " + _ML_COLS.replace("qtd_movimentos", "assunto_principal, qtd_movimentos")


def _feat_sql(cols: str) -> str:
    return with_base(f"SELECT {cols} FROM feat", _FEAT_CTES)


def _feat(spark, sf):
    return FT.case_features(DS.cases(spark, sf), keep=["hit_pos"])


@register("temporal_features", _feat_sql("hit_pos, numero_processo, " + ", ".join(FT.TEMPORAL)))
def temporal_features(spark, sf):
    return _feat(spark, sf).select("hit_pos", "numero_processo", *FT.TEMPORAL)


_SUBJ = ["qtd_assuntos", "tem_tutela_urgencia", "tem_obrigacao_fazer", "tem_dano_moral", "assunto_principal"]


@register("subject_features", _feat_sql("hit_pos, numero_processo, " + ", ".join(_SUBJ)))
def subject_features(spark, sf):
    return _feat(spark, sf).select("hit_pos", "numero_processo", *_SUBJ)


@register("array_features", _feat_sql("hit_pos, qtd_assuntos, qtd_movimentos, assunto_principal"))
def array_features(spark, sf):
    c = DS.cases(spark, sf)
    return c.select("hit_pos", A.size0("assuntos").alias("qtd_assuntos"),
                    A.size0("movimentos").alias("qtd_movimentos"),
                    A.main_subject("assuntos").alias("assunto_principal"))


@register("lunch_hour_flag", _feat_sql("hit_pos, numero_processo, eh_horario_almoco"))
def lunch_hour_flag(spark, sf):
    c = DS.cases(spark, sf)
    return c.select("hit_pos", "numero_processo", FT.lunch_flag(F.col("movimentos")).alias("eh_horario_almoco"))


@register("movement_velocity", _feat_sql(
    "hit_pos, dias_desde_ajuizamento, qtd_movimentos, velocidade_movimentos, complexidade_score"))
def movement_velocity(spark, sf):
    return _feat(spark, sf).select("hit_pos", "dias_desde_ajuizamento", "qtd_movimentos",
                                   "velocidade_movimentos", "complexidade_score")


@register("text_flags", _feat_sql(
    "hit_pos, tem_recurso, municipio_fortaleza, tem_tutela_urgencia, tem_obrigacao_fazer, tem_dano_moral"))
def text_flags(spark, sf):
    return _feat(spark, sf).select("hit_pos", "tem_recurso", "municipio_fortaleza", "tem_tutela_urgencia",
                                   "tem_obrigacao_fazer", "tem_dano_moral")


@register("case_features", _feat_sql(_FEAT_ALL))
def case_features(spark, sf):
    return _feat(spark, sf).select(*[c.strip() for c in _FEAT_ALL.split(",")])


@register("encode_binary", with_base(f"""
SELECT numero_processo, {_SEX.format(c='sexo_juiz')} AS sexo_juiz_bin,
  {_SEX.format(c='sexo_requerente')} AS sexo_requerente_bin,
  {_TRUTHY.format(c='sentenca_favoravel')} AS sentenca_bin
FROM enr"""))
def encode_binary(spark, sf):
    e = DS.enriched(spark, sf)
    return e.select("numero_processo", FT.sex_code(F.col("sexo_juiz")).alias("sexo_juiz_bin"),
                    FT.sex_code(F.col("sexo_requerente")).alias("sexo_requerente_bin"),
                    FT.truthy_code(F.col("sentenca_favoravel")).alias("sentenca_bin"))


_ML_SQL = f"""
SELECT row_number() OVER (ORDER BY hit_pos) AS id, {_ML_COLS},
  {_TRUTHY.format(c='sentenca_favoravel')} AS sentenca_favoravel, texto_decisao,
  {_SEX.format(c='sexo_juiz')} AS sexo_juiz_bin, {_SEX.format(c='sexo_requerente')} AS sexo_requerente_bin,
  {_ONE_HOT_SQL}
FROM mlj WHERE status = {q(K.STATUS_OK)}"""


@register("ml_dataset", with_base(_ML_SQL, _FEAT_CTES))
def ml_dataset(spark, sf):
    return DS.ml_dataset(spark, sf)


@register("one_hot_subject", with_base(
    f"SELECT id, {', '.join(_VOCAB.values())} FROM ({_ML_SQL})", _FEAT_CTES))
def one_hot_subject(spark, sf):
    ml = DS.ml_dataset(spark, sf)
    return ml.select("id", *[c for c in ml.columns if c.startswith(K.ONE_HOT_PREFIX)
                             and c not in ("eh_segunda", "eh_sexta", "eh_horario_almoco")])


@register("sequential_id", with_base(f"""
SELECT row_number() OVER (ORDER BY hit_pos) AS id, numero_processo, hit_pos
FROM mlj WHERE status = {q(K.STATUS_OK)}""", _FEAT_CTES))
def sequential_id(spark, sf):
    from casework.operators.sequence import with_sequence

    kept = DS.ml_joined(spark, sf).filter(F.col("status") == K.STATUS_OK)
    return with_sequence(kept.select("numero_processo", "hit_pos"), [F.col("hit_pos")], "id", start=1)


# M8 for any number of values: customer names (1,500 at the small scale), one
# row per set feature.
@register("one_hot_long", """
SELECT c_custkey, 'eh_' || lower(c_name) AS feature, 1 AS valor FROM customer""")
def one_hot_long(spark, sf):
    return FT.one_hot_long(DS.tables(spark, sf).customer.select("c_custkey", "c_name"), "c_custkey", "c_name")


# M8 as sparse vectors: one value a line item, as many values as parts.
@register("one_hot_sparse", """
WITH l AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_partkey END AS v, l_orderkey * 8 + l_linenumber AS pos FROM lineitem
), f AS (SELECT v, min(pos) AS first FROM l WHERE v IS NOT NULL GROUP BY v
), i AS (SELECT v, row_number() OVER (ORDER BY first, 'Peça ' || v) - 1 AS i, count(*) OVER () AS n FROM f)
SELECT l_orderkey, l_linenumber, '(' || (SELECT count(*) FROM f) || CASE WHEN i IS NULL THEN ',[],[])' ELSE ',[' || i || '],[1.0])' END AS vetor
FROM l LEFT JOIN i USING (v)""")
def one_hot_sparse(spark, sf):
    """M8 for any number of values: the part of each line item (none for a seventh line) as a sparse vector."""
    item = DS.tables(spark, sf).lineitem
    rows = item.select("l_orderkey", "l_linenumber", (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("pos"),
                       F.when(F.col("l_linenumber") < 7, F.concat(F.lit("Peça "), F.col("l_partkey").cast("string"))).alias("assunto"))
    out = FT.one_hot_sparse(rows, "assunto", FT.vocabulary_index(rows, "assunto", "pos"))
    return out.select("l_orderkey", "l_linenumber", F.col("vetor").cast("string").alias("vetor"))
