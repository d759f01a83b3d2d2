"""Spark Column functions against plain-Python twins of the original rules,
on seeded random inputs (one Spark job per test)."""

from __future__ import annotations

import random
import re
import unicodedata
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from casework import constants as K
from casework.functions import text as X
from casework.functions import time as TM

ALPHABET = list("abcdeAçãéÍôüñ()/-_ .,'") + [" ", "\t", "\n", " ", " ", "　", "\x0b"]
NAMES = ["Ana", "joão", "MARIA", "de", "da", "Direito", "Vara", "Cível", "Silva", "Érica", "do", "Especial"]


def _rand_text(rng: random.Random) -> str:
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 24)))


def _rand_name(rng: random.Random) -> str:
    ws = [" ", "  ", "\t", " ", " "]
    parts = [rng.choice(NAMES) for _ in range(rng.randint(0, 4))]
    return rng.choice(["", " ", "　"]) + rng.choice(ws).join(parts) + rng.choice(["", " ", "\n"])


def _py_slug(v):
    kept = unicodedata.normalize("NFD", v.lower()).encode("ascii", "ignore").decode()
    kept = kept.translate(str.maketrans(" /-", "___", "()")).replace("__", "_").strip("_")
    return ("eh_" + kept)[:60]


def _py_first_name(s):
    if s is None or s == "":
        return None
    words = s.strip().split()
    return words[0].upper() if words else None


def _py_valid(nome):
    if not nome:
        return False
    if re.match(K.INVALID_JUDGE_PREFIX_REGEX, nome, re.IGNORECASE):
        return False
    if nome.endswith(tuple(K.INVALID_JUDGE_SUFFIXES)):
        return False
    return not any(w in nome for w in K.INVALID_JUDGE_WORDS)


def test_text_functions_match_python(spark):
    rng = random.Random(7)
    values = [_rand_text(rng) for _ in range(300)] + [_rand_name(rng) for _ in range(300)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select(
        "i", X.slug("v").alias("slug"), X.first_name("v").alias("fn"), X.strip_ws("v").alias("strip"),
        X.zfill("v").alias("z"), X.valid_judge_name("v").alias("ok"), X.first_line("v").alias("line"),
    ).orderBy("i").collect()
    for r, v in zip(rows, values):
        if v is None:
            assert r.fn is None and r.ok is False
            continue
        assert r.slug == _py_slug(v), (v, r.slug)
        assert r.fn == _py_first_name(v), (v, r.fn)
        assert r.strip == v.strip(), (v, r.strip)
        assert r.z == v.zfill(20) or (v[:1] in "+-" and r.z == v.rjust(20, "0")), (v, r.z)
        assert r.ok == _py_valid(v), (v, r.ok)
        assert r.line == v.split("\n")[0].strip(), (v, r.line)


def test_temporal_rules_match_python(spark):
    rng = random.Random(11)
    base = datetime(2020, 1, 1)
    rows_in = []
    for i in range(400):
        filed = base + timedelta(seconds=rng.randint(0, 5 * 365 * 86400))
        upd = filed + timedelta(seconds=rng.randint(-3 * 86400, 900 * 86400))
        f_txt = filed.strftime("%Y%m%d%H%M%S") if rng.random() > 0.1 else filed.isoformat() + "Z"
        style = rng.random()
        if style < 0.7:
            u_txt = upd.strftime("%Y-%m-%dT%H:%M:%S") + ".000Z"
        elif style < 0.8:
            u_txt = upd.strftime("%Y-%m-%dT%H:%M:%S") + "+00:00"
        elif style < 0.9:
            u_txt = upd.strftime("%Y-%m-%dT%H:%M:%S") + ".5-03:00"
        else:
            u_txt = "garbage"
        rows_in.append((i, f_txt, u_txt))
    df = spark.createDataFrame(rows_in, "i int, f string, u string")
    filed = TM.parse_compact(F.col("f"))
    upd = TM.parse_iso_naive(F.col("u"))
    ok = filed.isNotNull() & upd.isNotNull()
    got = df.select("i", F.when(ok, TM.days_between(filed, upd)).alias("days"),
                    F.when(ok, F.weekday(filed)).alias("wd")).orderBy("i").collect()
    for r, (_, f_txt, u_txt) in zip(got, rows_in):
        try:
            a = datetime.strptime(f_txt, "%Y%m%d%H%M%S")
            b = datetime.fromisoformat(u_txt.replace("Z", "").split(".")[0])
            want = ((b - a).days, a.weekday())
        except (ValueError, TypeError):
            want = (None, None)
        assert (r.days, r.wd) == want, (f_txt, u_txt, r)
