"""Readers and writers on hand-made files."""

from __future__ import annotations

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.functions import arrays as A
from casework.operators import cases as C
from casework.sources import readers as R
from casework.sources import writers as W


def _hit(num, grau, movs, subjects):
    src = {"numeroProcesso": num, "grau": grau, "classe": {"codigo": 1, "nome": "Classe"},
           "formato": {"nome": "Eletrônico"},
           "orgaoJulgador": {"codigo": 9, "nome": "Vara Única", "codigoMunicipioIBGE": 2304400},
           "dataAjuizamento": "20250930120000", "dataHoraUltimaAtualizacao": "2025-10-01T10:00:00.000Z",
           "assuntos": subjects}
    if movs is not None:
        src["movimentos"] = movs
    return {"_source": src, "sort": [1759233600000]}


def test_pretty_printed_response_multiline(spark):
    d = tempfile.mkdtemp(prefix="cw-json-")
    doc = {"hits": {"total": {"value": 2}, "hits": [
        _hit("00000000000000000001", "G1", [{"codigo": 1, "nome": "Procedência", "dataHora": "2025-09-30T15:00:00.000Z"}],
             [{"codigo": 12487, "nome": "Obrigação de Fazer"}]),
        _hit("00000000000000000002", "G2", None, [{"codigo": 1, "nome": "Dano"}, 5]),
    ]}}
    with open(os.path.join(d, "resp.json"), "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
    hits = R.read_search_responses(spark, d, multi_line=True)
    cases = C.flatten_hits(hits).orderBy("hit_pos").collect()
    assert [c.numero_processo for c in cases] == ["00000000000000000001", "00000000000000000002"]
    assert [c.hit_pos for c in cases] == [0, 1]
    assert cases[1].movimentos == []          # missing list -> empty (P2)
    assert cases[0].municipio == 2304400 and cases[0].sort == 1759233600000
    # A subject that is not an object has an empty name; the others stay.
    assert [(s.codigo, s.nome) for s in cases[1].assuntos] == [(1, "Dano"), (None, "")]
    raw = spark.read.text(d, wholetext=True).select(
        F.get_json_object("value", "$.hits.hits[1]._source.assuntos").alias("raw"))
    assert raw.select(A.subject_names_from_json("raw").alias("n")).first().n == ["Dano", ""]


def test_csv_keeps_leading_zeros_spaces_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="cw-csv-")
    df = spark.createDataFrame([("00000000000000000012", "  Ana\nLima", True)],
                               "numero_processo string, texto string, flag boolean")
    W.write_csv(df, d)
    back = R.read_csv_strings(spark, d, ["numero_processo", "texto", "flag"]).first()
    assert back.numero_processo == "00000000000000000012"
    typed = R.read_csv_typed(spark, d, df.schema).first()
    assert (typed.texto, typed.flag) == ("  Ana\nLima", True)


def test_user_pipeline_end_to_end(spark):
    """The stages on user data: responses file -> selection -> pages -> results
    -> enrichment -> ML table -> analysis."""
    from casework.plans import pipeline as P
    from casework.sources.fixtures import DICTIONARY_SCHEMA

    d = tempfile.mkdtemp(prefix="cw-pipe-")
    dec = {"codigo": 1, "nome": "Procedência", "dataHora": "2025-09-30T12:00:00.000Z"}
    neg = {"codigo": 2, "nome": "Improcedência", "dataHora": "2025-09-30T18:00:00.000Z"}
    subj = [{"codigo": 4, "nome": "Acordo de Não Persecução Penal"}]
    doc = {"hits": {"total": {"value": 3}, "hits": [
        _hit("00000000000000000001", "G1", [dec], subj),
        _hit("00000000000000000002", "G1", [neg], subj),
        _hit("00000000000000000001", "G2", [neg], [{"codigo": 1, "nome": "Dano"}]),
    ]}}
    with open(os.path.join(d, "resp.json"), "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, ensure_ascii=False)
    hits = R.read_search_responses(spark, d, multi_line=True)
    sel = P.select_cases(hits)
    assert sorted(r.tipo_decisao for r in sel["union"].collect()) == ["Improcedência", "Procedência"]
    assert sel["selected_hits"].count() == 3  # both instances of case 1 come back

    page = ('<div id="juizPrimeiraDivTable"><span>Ana Lima</span></div>'
            '<table id="tablePartesPrincipais"><tr><td>Requerente</td><td>Maria Souza</td></tr></table>'
            '<table><tr><td>Julgado procedente o pedido. Sentença com fundamentação suficiente para o teste.</td></tr></table>')
    pages = spark.createDataFrame([("00000000000000000001", page), ("00000000000000000002", None)],
                                  "numero_processo string, html string")
    recs = P.pages_to_records(pages)
    table = P.results_table(recs, sel["union"], sel["numbers"])
    rows = table.collect()
    assert [(r.id, r.numero_processo, r.sentenca_favoravel, r.status) for r in rows] == [
        (1, "00000000000000000001", True, "sucesso")]
    dic = spark.createDataFrame([("Ana", "F", 1), ("Maria", "F", 1)], DICTIONARY_SCHEMA)
    enriched = P.enrich(table, dic)
    ml = P.model_table(hits, sel["union"], enriched).orderBy("id").collect()
    assert [(r.id, r.sentenca_favoravel, r.sexo_juiz_bin, r.eh_horario_almoco) for r in ml] == [
        (1, 1, 1, 1), (2, 1, 1, 0)]
    report = P.analysis(hits)
    assert report["member"].count() == 2 and report["hours"].count() >= 1


def test_text_sinks_round_trip(spark):
    """K6/K7: one text value per record; reports keep their inner newlines."""
    from casework.operators import analytics as AN
    from casework.plans import datasets as DS
    from tests.conftest import SF_SMALL

    cases = DS.cases(spark, SF_SMALL)
    top = AN.top_units_text(AN.top_units(cases, ["municipio", "orgao_julgador"], "codigo"),
                            ["municipio", "orgao_julgador"])
    d1 = tempfile.mkdtemp(prefix="cw-txt-")
    W.write_text(top, "linha", d1 + "/top")
    lines = {r.value for r in spark.read.text(d1 + "/top").collect()}
    assert lines == {r.linha for r in top.collect()}
    report = C.case_report(cases).filter(F.col("hit_pos") < 3)
    W.write_text(report, "report", d1 + "/report")
    whole = "".join(r.value for r in spark.read.text(d1 + "/report", wholetext=True).collect())
    for r in report.collect():
        assert r.report in whole and r.report.startswith("Autos n. ")


def _response(path, name, numbers, indent=None):
    doc = {"hits": {"total": {"value": len(numbers)}, "hits": [_hit(n, "G1", [], []) for n in numbers]}}
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=indent)


def test_positions_are_unique_over_files(spark):
    d = tempfile.mkdtemp(prefix="cw-json-")
    _response(d, "a.json", ["1", "2", "3"], 1)
    _response(d, "b.json", ["4", "5"], 1)
    hits = R.read_search_responses(spark, d, multi_line=True).orderBy("hit_pos").collect()
    assert [(h.hit_pos, h.numeroProcesso) for h in hits] == [(0, "1"), (1, "2"), (2, "3"), (3, "4"), (4, "5")]


def test_a_truncated_response_is_an_error(spark):
    d = tempfile.mkdtemp(prefix="cw-json-")
    _response(d, "a.json", ["1"])
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write('{"hits": {"hits": [{"_source": {"numeroProcesso": "2"')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        R.read_search_responses(spark, d).count()


def test_odd_values_take_no_neighbour_along(spark):
    d = tempfile.mkdtemp(prefix="cw-json-")
    hit = _hit("1", "G1", [{"codigo": "x", "nome": "Procedência", "dataHora": 5}, None], ["text", {"codigo": 2, "nome": "Dano"}, None])
    hit["_source"]["classe"]["codigo"] = "not a number"
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump({"hits": {"hits": [hit]}}, f)
    row = R.read_search_responses(spark, d).first()
    assert row.classe.codigo is None and row.classe.nome == "Classe"
    assert [(m.codigo, m.nome, m.dataHora) for m in row.movimentos] == [(None, "Procedência", "5"), (None, "", None)]
    assert [(s.codigo, s.nome) for s in row.assuntos] == [(None, ""), (2, "Dano"), (None, "")]


def test_csv_cells_with_quotes_and_newlines_by_name(spark):
    d = tempfile.mkdtemp(prefix="cw-csv-")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8") as f:
        f.write('texto,numeroProcesso\n"a ""b"", c",01\n"two\nlines",02\nshort\n')
    rows = R.read_csv_strings(spark, d, ["numeroProcesso", "texto", "absent"]).collect()
    assert [(r.numeroProcesso, r.texto, r.absent) for r in rows] == [("01", 'a "b", c', None), ("02", "two\nlines", None), (None, "short", None)]


def test_dictionary_by_name_whatever_is_selected(spark):
    d = tempfile.mkdtemp(prefix="cw-gz-")
    with gzip.open(os.path.join(d, "names.csv.gz"), "wt", encoding="utf-8") as f:
        f.write("classification,first_name,frequency_total\nF,Ana,3000\nM,Bruno\nF,Clara,many\nM,Davi,5,extra\n")
    schema = "first_name string, classification string, frequency_total long"
    read = lambda skip: R.read_gzip_csv(spark, d, T._parse_datatype_string(schema), skip_bad_lines=skip)
    assert [tuple(r) for r in read(True).collect()] == [("Ana", "F", 3000), ("Bruno", "M", None), ("Clara", "F", None)]
    assert read(True).select("classification").count() == read(True).select("frequency_total").count() == 3
    with pytest.raises(Exception, match="more fields"):
        read(False).collect()


def test_an_unfinished_landing_is_never_read(spark):
    from casework.session import scratch_dir
    from casework.sources.landing import fingerprint, land

    source = tempfile.mkdtemp(prefix="cw-land-")
    folder = f"{scratch_dir(spark)}/landed/t-{fingerprint(spark, [source])}"
    spark.range(1).write.parquet(f"{folder}/unfinished")
    assert land(spark, "t", [source], lambda: spark.range(100)).count() == 100
    assert land(spark, "t", [source], lambda: spark.range(7)).count() == 100


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from casework.session import scratch_dir

    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(session)
