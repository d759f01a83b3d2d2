"""Inputs the driver tables do not carry, derived from them by rule.

* collected records (what the page collector stores per case number):
  one row per first-instance case number of ``orders``;
* the first-name dictionary (a small dimension table);
* saved case pages (HTML) built from the same record values, so the page
  extraction can be checked against the records.

Names below are invented; the rules are in FIXTURES.md section 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework import constants as K
from casework.sources.adapter import case_number
from casework.sources.tables import Tables

JUDGES = [
    "Ana Beatriz Moreira", "Carlos Eduardo Lima", "Fernanda Souza Prado", "João Pedro Alves",
    "Mariana Costa Reis", "Ricardo Nunes Barros", "Patrícia Gomes Teixeira", "Lucas Martins Rocha",
    "Helena Dias Ferraz", "Rafael Oliveira Pinto", "Juliana Castro Mendes", "Bruno Henrique Sales",
]
CLAIMANTS = [
    "Maria da Silva Santos", "José Carlos Pereira", None, "Antônia Ferreira Lopes",
    "  Francisco de Assis Ramos", "", "Luiza Helena Barbosa", None, "Paulo Roberto Cardoso",
    "Camila Andrade Freitas", "Andrea Vieira Campos", "Sérgio Ribeiro Monteiro",
]
# (first_name, classification, frequency): "Andrea" three times (ambiguous),
# "Patrícia" and "Sérgio" absent.
NAME_DICTIONARY = [
    ("Ana", "F", 3000), ("Carlos", "M", 2500), ("Fernanda", "F", 1200), ("João", "M", 2900),
    ("Mariana", "F", 1100), ("Ricardo", "M", 900), ("Lucas", "M", 1000), ("Helena", "F", 400),
    ("Rafael", "M", 800), ("Juliana", "F", 1000), ("Bruno", "M", 700), ("Maria", "F", 11000),
    ("José", "M", 5700), ("Antônia", "F", 1000), ("Francisco", "M", 1700), ("Luiza", "F", 300),
    ("Paulo", "M", 1300), ("Camila", "F", 600), ("Andrea", "F", 200), ("Andrea", "F", 150),
    ("Andrea", "M", 90),
]
DICTIONARY_SCHEMA = T.StructType([
    T.StructField("first_name", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("frequency_total", T.LongType()),
])
TEXT_VERBS = ["procedente", "improcedente"]


def _pick(values: list, index: Column) -> Column:
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(arr, index.cast("int"))


def collected_records(t: Tables) -> DataFrame:
    """(numero_processo, juiz, requerente, status, texto_decisao, o_orderkey)
    for every first-instance case number."""
    k = F.col("o_orderkey")
    o = t.orders.select("o_orderkey", "o_custkey").filter(k % 10 != 9)
    r20 = k % 20
    missing = r20 < 2
    juiz = F.when(missing | r20.between(2, 4), F.lit(None).cast("string")) \
        .otherwise(_pick(JUDGES, F.col("o_custkey") % 12))
    requerente = F.when(missing, F.lit(None).cast("string")).otherwise(_pick(CLAIMANTS, k % 12))
    complete = (F.coalesce(F.length(juiz), F.lit(0)) > 0) & (F.coalesce(F.length(requerente), F.lit(0)) > 0)
    status = (F.when(r20 == 0, F.lit(K.STATUS_NOT_FOUND)).when(r20 == 1, F.lit(K.STATUS_ERROR))
              .when(complete, F.lit(K.STATUS_OK)).otherwise(F.lit(K.STATUS_INCOMPLETE)))
    numero = case_number(k)
    texto = F.when(missing | (k % 3 == 0), F.lit(None).cast("string")).otherwise(
        F.format_string("Vistos etc.\nJulgado %s o pedido no processo %s, nos termos da fundamentação.",
                        _pick(TEXT_VERBS, k % 2), numero))
    return o.select(numero.alias("numero_processo"), juiz.alias("juiz"),
                    requerente.alias("requerente"), status.alias("status"),
                    texto.alias("texto_decisao"), "o_orderkey")


def name_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAME_DICTIONARY, DICTIONARY_SCHEMA)


# -- saved case pages -------------------------------------------------------------
# A page is a sequence of fragments; each fragment is shown when every
# (modulus, residues) condition on the order key holds. Values are literal
# text or record fields (a missing field prints as empty). The SQL twin in
# casework.plans.q_pages renders the same spec.

#: Bump when the pages change, so that they are landed anew.
PAGES_VERSION = 1
NOT_FOUND_TEXT = f"{K.NOT_FOUND_MARKER} disponíveis para os parâmetros informados."
LONG_TAIL = "Sentença registrada sem texto público disponível para consulta."
FOUND = (20, tuple(range(2, 20)))
PAGE_SPEC = [
    ([], ["<html lang=\"pt-BR\"><head><title>Consulta de Processos de 1º Grau</title>"
          "<script>var juiz = \"Juiz: Fulano\";</script></head><body>"]),
    ([(20, (0,))], [f"<div class=\"aviso\"><p>{NOT_FOUND_TEXT}</p></div>"]),
    ([FOUND], ["<table id=\"tableTopo\"><tr><td>Processo:</td><td>", "@numero_processo", "</td></tr></table>"]),
    # judge: primary element, or one of three free-text forms, or nothing
    ([FOUND, (8, (0, 1, 4, 5))], ["<div id=\"juizPrimeiraDivTable\"><span class=\"nome\">", "@juiz",
                                  "</span> <span>(titular)</span></div>"]),
    ([FOUND, (8, (2,))], ["<p class=\"info\">Juiz de Direito: ", "@juiz", "</p>"]),
    ([FOUND, (8, (6,))], ["<p class=\"info\">Juiza titular - Dra. ", "@juiz", "</p>"]),
    ([FOUND, (8, (3,))], ["<p class=\"info\">Juiz: Direito Substituto ", "@juiz", "</p>"]),
    # parties
    ([FOUND, (7, (0, 1, 2, 4, 5, 6))], ["<table id=\"tablePartesPrincipais\">"]),
    ([FOUND, (7, (0,))], ["<tr><td class=\"label\">Requerente:</td><td>", "@requerente", "</td></tr>"]),
    ([FOUND, (7, (1,))], ["<tr><td class=\"label\">Autor</td><td>", "@requerente", "</td></tr>"]),
    ([FOUND, (7, (2,))], ["<tr><td class=\"label\">Massa Falida</td><td>", "@requerente", "</td></tr>"]),
    ([FOUND, (7, (4,))], ["<tr><td class=\"label\">Requerente</td><td></td></tr>"
                          "<tr><td class=\"label\">Autor</td><td>", "@requerente", "</td></tr>"]),
    ([FOUND, (7, (5,))], ["<tr><td class=\"label\">Requerido</td><td>Banco Exemplo S.A.</td></tr>"]),
    ([FOUND, (7, (6,))], ["<tr><td class=\"label\">Reqte</td><td>x</td></tr><tr><td class=\"label\">REQUERENTE</td><td>",
                          "@requerente", "<br>Advogado: Pedro Lins</td></tr>"]),
    ([FOUND, (7, (0, 1, 2, 4, 5, 6))], ["</table>"]),
    # movements
    ([FOUND, (5, (0, 1, 2, 3))], ["<table id=\"tabelaTodasMovimentacoes\"><tr><td>01/02/2024</td>"]),
    ([FOUND, (5, (0,))], ["<td>Julgado procedente o pedido. ", "@texto_decisao", " ", LONG_TAIL, "</td></tr>"]),
    ([FOUND, (5, (1,))], ["<td>Julgado improcedente o pedido. ", "@texto_decisao", " ", LONG_TAIL, "</td></tr>"]),
    ([FOUND, (5, (2,))], ["<td>Procedência</td></tr><tr><td>02/02/2024</td><td>Decisão de Improcedência do pedido: ",
                          "@texto_decisao", " ", LONG_TAIL, "</td></tr>"]),
    ([FOUND, (5, (3,))], ["<td>Procedência parcial</td></tr><tr><td>Julgado procedente o pedido</td></tr>"]),
    ([FOUND, (5, (0, 1, 2, 3))], ["</table>"]),
    ([], ["</body></html>"]),
]
ERROR_RESIDUE = (20, 1)  # page failed to load: html is null


def _spark_cond(conds) -> Column:
    k = F.col("o_orderkey")
    out = F.lit(True)
    for mod, residues in conds:
        out = out & (k % mod).isin(*residues)
    return out


def _spark_value(part: str) -> Column:
    if part.startswith("@"):
        return F.coalesce(F.col(part[1:]), F.lit(""))
    return F.lit(part)


def case_pages(records: DataFrame) -> DataFrame:
    """(numero_processo, html) of each collected record, ``o_orderkey`` kept."""
    frags = [F.when(_spark_cond(conds), F.concat(*[_spark_value(p) for p in parts])).otherwise(F.lit(""))
             for conds, parts in PAGE_SPEC]
    mod, res = ERROR_RESIDUE
    html = F.when(F.col("o_orderkey") % mod == res, F.lit(None).cast("string")).otherwise(F.concat(*frags))
    return records.select("numero_processo", html.alias("html"), "o_orderkey")
