from __future__ import annotations

import random
import re

from casework.llm import license_scan as L


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(found):
    return [tuple(found[i:i + 5]) for i in range(len(found) - 4)]


def expected(text, templates=L.TEMPLATES):
    found, out = words(text), set()
    for name, template in templates.items():
        own, n = set(grams(words(template))), len(words(template))
        for j in range(0, len(found), n):
            if 100 * len(own & set(grams(found[j:j + 2 * n]))) >= 75 * len(own):
                out.add(name)
    return ",".join(sorted(out))


def texts():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["alpha", "of", "the", "license", "under", "x9", "né"]) for _ in range(n))
    out = ["", None, " \n", "a b c d", "Released under the MIT License.", "x" * 100_000]
    for _, t in L.TEMPLATES.items():
        for n in (0, 1, 3, 7, 40):
            out.append(f"{filler(n)}\n{t.upper()} {filler(rng.randrange(30))}")
        cut = t.split(" ")
        for share in (0.6, 0.8, 0.95):
            out.append(filler(20) + " " + " ".join(w for w in cut if rng.random() < share))
            out.append(filler(5) + " " + " ".join(cut[:int(len(cut) * share)]) + " " + filler(9))
    return out + [filler(20_000) + " " + "  ".join(L.TEMPLATES.values()) + filler(50)]


def test_matches(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, L.TEMPLATES["mit"], "x", 1), (3, "again", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, words string, hits int")
    got = L.scanned(frame).collect()
    want = sorted((str(i), expected(t)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.licenses) for r in got) == want
    assert all(r.n_licenses == len([x for x in r.licenses.split(",") if x]) for r in got)
    assert all(m.percent >= 75 for r in got for m in r.matches)
    assert L.scanned(frame.limit(0)).count() == 0


def test_bands_guarantee_a_collision():
    for t in L.TEMPLATES.values():
        assert L.least_collision(len(words(t))) > 0.99999


def test_no_python_in_the_plan(spark):
    plan = L.scanned(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
