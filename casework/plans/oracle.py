"""DuckDB twins of the registered queries (the correctness oracle).

``BASE`` rebuilds the adapter views (hits, cases, decisions, fixtures) in
plain SQL over the driver tables; each query appends its own SELECT.
"""

from __future__ import annotations

from casework import constants as K
from casework.sources import adapter as AD
from casework.sources import fixtures as FX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


_MOV_NAME = _case([(f"l_returnflag = {_q(rf)} AND l_linestatus = {_q(ls)}", _q(n))
                   for rf, ls, n in AD.MOVEMENT_BY_FLAGS], "NULL")
_SUBJ_CODE = _case([(f"p_type = {_q(t)}", str(c)) for t, c, _ in AD.SUBJECT_BY_TYPE], "0")
_SUBJ_NAME = _case([(f"p_type = {_q(t)}", _q(n)) for t, _, n in AD.SUBJECT_BY_TYPE],
                   "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2))")
_CLASS_CODE = _case([(f"o_orderpriority = {_q(p)}", str(c)) for p, c, _ in AD.CLASS_BY_PRIORITY],
                    "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)")
_CLASS_NAME = _case([(f"o_orderpriority = {_q(p)}", _q(n)) for p, _, n in AD.CLASS_BY_PRIORITY],
                    _q(AD.OTHER_CLASS_NAME))
ISO = "'%Y-%m-%dT%H:%M:%S.000Z'"
DECISION_PRED = " OR ".join(f"contains(m.nome, {_q(t)})" for t in K.DECISION_TERMS)
OUTCOME_LIST = "[" + ", ".join(_q(t) for t in K.OUTCOME_TYPES) + "]"

BASE_CTES = {
    "li": f"""
li AS (
  SELECT l.*, p.p_type,
    {_MOV_NAME} AS nome,
    CASE WHEN l_partkey % 50 = 0 THEN NULL
         ELSE strftime(l_shipdate + to_seconds((l_partkey * 3571 + l_suppkey * 97) % 86400), {ISO}) END AS dataHora,
    CAST({_SUBJ_CODE} AS BIGINT) AS s_codigo,
    {_SUBJ_NAME} AS s_nome,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
      l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS mov_pos
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
)""",
    "mov": """
mov AS (
  SELECT l_orderkey,
    list({'codigo': CAST(l_linenumber AS BIGINT), 'nome': nome, 'dataHora': dataHora} ORDER BY mov_pos) AS movimentos,
    max(l_shipdate) AS last_ship
  FROM li GROUP BY l_orderkey
)""",
    "subj": """
subj AS (
  SELECT l_orderkey, list({'codigo': s_codigo, 'nome': s_nome} ORDER BY first_pos) AS assuntos
  FROM (SELECT l_orderkey, s_codigo, s_nome, min(mov_pos) AS first_pos FROM li GROUP BY l_orderkey, s_codigo, s_nome)
  GROUP BY l_orderkey
)""",
    "hits": f"""
hits AS (
  SELECT
    row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS hit_pos,
    lpad(CAST(CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR), 20, '0') AS numeroProcesso,
    CASE WHEN o_orderkey % 10 = 9 THEN 'G2' ELSE 'G1' END AS grau,
    {{'codigo': CAST({_CLASS_CODE} AS BIGINT), 'nome': {_CLASS_NAME}}} AS classe,
    {{'nome': o_orderstatus}} AS formato,
    {{'codigo': o_custkey,
      'nome': 'Vara ' || c_mktsegment || ' de ' || CASE WHEN c_nationkey % 5 = 0 THEN {_q(AD.CAPITAL_NAME)} ELSE n_name END,
      'codigoMunicipioIBGE': CASE WHEN c_nationkey = {AD.NULL_MUNICIPALITY_NATION} THEN NULL ELSE CAST(c_nationkey AS BIGINT) END}} AS orgaoJulgador,
    CASE WHEN o_orderkey % 97 = 0 THEN strftime(o_orderdate + to_seconds((o_orderkey * 7919) % 86400), {ISO})
         ELSE strftime(o_orderdate + to_seconds((o_orderkey * 7919) % 86400), '%Y%m%d%H%M%S') END AS dataAjuizamento,
    strftime(coalesce(last_ship, o_orderdate + INTERVAL 1 DAY) + to_seconds(o_orderkey % 3600), {ISO}) AS dataHoraUltimaAtualizacao,
    coalesce(assuntos, []) AS assuntos,
    movimentos,
    [epoch_ms(o_orderdate + to_seconds((o_orderkey * 7919) % 86400))] AS sort,
    o_orderkey
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN mov ON mov.l_orderkey = o.o_orderkey
  LEFT JOIN subj ON subj.l_orderkey = o.o_orderkey
)""",
    "cases": """
cases AS (
  SELECT hit_pos, numeroProcesso AS numero_processo, classe.nome AS classe,
    dataAjuizamento AS data_ajuizamento, dataHoraUltimaAtualizacao AS ultima_atualizacao,
    formato.nome AS formato, orgaoJulgador.codigo AS codigo, orgaoJulgador.nome AS orgao_julgador,
    orgaoJulgador.codigoMunicipioIBGE AS municipio, grau, assuntos,
    coalesce(movimentos, []) AS movimentos, sort[1] AS sort, o_orderkey
  FROM hits
)""",
    "dec": f"""
dec AS (
  SELECT hit_pos, numero_processo, grau,
    CASE WHEN grau = '{K.FIRST_INSTANCE}' THEN list_transform(list_filter(movimentos, lambda m: coalesce({DECISION_PRED}, false)), lambda m: m.nome)
         ELSE [] END AS decisoes
  FROM cases
)""",
    "firstdec": """
firstdec AS (
  SELECT numero_processo, arg_min(decisoes[1], hit_pos) AS tipo_decisao, min(hit_pos) AS hit_pos
  FROM dec WHERE len(decisoes) > 0 GROUP BY numero_processo
)""",
    "dunion": f"""
dunion AS (
  SELECT numero_processo, tipo_decisao, hit_pos, CAST(list_position({OUTCOME_LIST}, tipo_decisao) AS INTEGER) AS type_order
  FROM firstdec WHERE list_position({OUTCOME_LIST}, tipo_decisao) > 0
)""",
}


def _pick(values, idx: str) -> str:
    items = ", ".join("NULL" if v is None else _q(v) for v in values)
    return f"[{items}][{idx} + 1]"


def first_name_sql(c: str) -> str:
    from casework.functions.text import PY_SPACE
    trimmed = f"regexp_replace({c}, '^{PY_SPACE}+|{PY_SPACE}+$', '', 'g')"
    return f"nullif(upper(string_split_regex({trimmed}, '{PY_SPACE}+')[1]), '')"


_DICT_VALUES = ", ".join(f"({_q(n)}, {_q(c)}, {f})" for n, c, f in FX.NAME_DICTIONARY)
_DROPPED = ", ".join(_q(x) for x in K.DROPPED_STATUSES)
_R20 = "(o_orderkey % 20)"
_JUIZ = (f"CASE WHEN {_R20} < 2 OR {_R20} BETWEEN 2 AND 4 THEN NULL "
         f"ELSE {_pick(FX.JUDGES, 'o_custkey % 12')} END")
_REQ = f"CASE WHEN {_R20} < 2 THEN NULL ELSE {_pick(FX.CLAIMANTS, 'o_orderkey % 12')} END"
_NUM = "lpad(CAST(o_orderkey AS VARCHAR), 20, '0')"

BASE_CTES.update({
    "res0": f"""
res0 AS (
  SELECT {_NUM} AS numero_processo, {_JUIZ} AS juiz, {_REQ} AS requerente, o_orderkey,
    CASE WHEN {_R20} < 2 OR o_orderkey % 3 = 0 THEN NULL
         ELSE 'Vistos etc.' || chr(10) || 'Julgado ' || {_pick(FX.TEXT_VERBS, 'o_orderkey % 2')}
              || ' o pedido no processo ' || {_NUM} || ', nos termos da fundamentação.' END AS texto_decisao
  FROM orders WHERE o_orderkey % 10 != 9
)""",
    "res": f"""
res AS (
  SELECT numero_processo, juiz, requerente,
    CASE WHEN {_R20} = 0 THEN {_q(K.STATUS_NOT_FOUND)} WHEN {_R20} = 1 THEN {_q(K.STATUS_ERROR)}
         WHEN coalesce(length(juiz), 0) > 0 AND coalesce(length(requerente), 0) > 0 THEN {_q(K.STATUS_OK)}
         ELSE {_q(K.STATUS_INCOMPLETE)} END AS status,
    texto_decisao, o_orderkey
  FROM res0
)""",
    "coll": """
coll AS (SELECT * FROM res WHERE numero_processo IN (SELECT numero_processo FROM dunion))""",
    "valid": f"""
valid AS (
  SELECT c.numero_processo, c.juiz, c.requerente, c.status, c.texto_decisao, c.o_orderkey, f.sentenca_favoravel
  FROM coll c LEFT JOIN (
    SELECT numero_processo, arg_max(contains(tipo_decisao, {_q(K.FAVOURABLE_MARKER)}), (type_order, hit_pos)) AS sentenca_favoravel
    FROM dunion GROUP BY numero_processo) f ON f.numero_processo = c.numero_processo
  WHERE c.status NOT IN ({_DROPPED}) AND c.texto_decisao IS NOT NULL
)""",
    "dict": f"""
dict AS (SELECT * FROM (VALUES {_DICT_VALUES}) t(first_name, classification, frequency_total))""",
    "dagg": """
dagg AS (SELECT upper(first_name) AS fn, CASE WHEN count(*) = 1 THEN any_value(classification) ELSE NULL END AS val
         FROM dict WHERE first_name IS NOT NULL GROUP BY upper(first_name))""",
    "daggm": """
daggm AS (SELECT upper(first_name) AS fn, CASE WHEN count(*) = 1 THEN any_value(classification) ELSE mode(classification) END AS val
          FROM dict WHERE first_name IS NOT NULL GROUP BY upper(first_name))""",
    "enr": f"""
enr AS (
  SELECT v.*, CASE WHEN v.fj IS NULL OR dj.fn IS NULL THEN {_q(K.UNKNOWN_SEX)} ELSE dj.val END AS sexo_juiz,
    CASE WHEN v.fr IS NULL OR dr.fn IS NULL THEN {_q(K.UNKNOWN_SEX)} ELSE dr.val END AS sexo_requerente
  FROM (SELECT *, {first_name_sql('juiz')} AS fj, {first_name_sql('requerente')} AS fr FROM valid) v
  LEFT JOIN dagg dj ON dj.fn = v.fj LEFT JOIN dagg dr ON dr.fn = v.fr
)""",
    "enrm": f"""
enrm AS (
  SELECT v.*, CASE WHEN v.fj IS NULL OR dj.fn IS NULL THEN {_q(K.UNKNOWN_SEX)} ELSE dj.val END AS sexo_juiz,
    CASE WHEN v.fr IS NULL OR dr.fn IS NULL THEN {_q(K.UNKNOWN_SEX)} ELSE dr.val END AS sexo_requerente
  FROM (SELECT *, {first_name_sql('juiz')} AS fj, {first_name_sql('requerente')} AS fr FROM valid) v
  LEFT JOIN daggm dj ON dj.fn = v.fj LEFT JOIN daggm dr ON dr.fn = v.fr
)""",
})

_ORDER = list(BASE_CTES)


def with_base(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every base CTE (unused ones cost nothing)."""
    parts = [BASE_CTES[n] for n in _ORDER]
    if extra:
        parts += list(extra.values())
    return "WITH " + ",".join(parts) + "\n" + body
