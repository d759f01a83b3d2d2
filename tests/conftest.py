from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from casework.session import build_session

    s = build_session(master="local[8]", shuffle_partitions=8, app_name="casework-tests")
    yield s


CASE_SCHEMA = (
    "hit_pos long, numero_processo string, classe string, data_ajuizamento string, "
    "ultima_atualizacao string, orgao_julgador string, municipio long, codigo long, grau string, "
    "assuntos array<struct<codigo:bigint,nome:string>>, "
    "movimentos array<struct<codigo:bigint,nome:string,dataHora:string>>"
)


def case_row(pos=0, numero="00000000000000000001", grau="G1", classe="Procedimento Comum Cível",
             filed="20250930120000", updated="2025-10-10T10:00:00.000Z", orgao="Vara Cível de Fortaleza",
             subjects=(), movements=(), municipio=1, codigo=1):
    return (pos, numero, classe, filed, updated, orgao, municipio, codigo, grau,
            [(0, s) for s in subjects],
            None if movements is None else [(i, n, t) for i, (n, t) in enumerate(movements)])


@pytest.fixture()
def make_cases(spark):
    def make(rows):
        return spark.createDataFrame(rows, CASE_SCHEMA)
    return make
