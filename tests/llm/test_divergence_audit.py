from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from casework.llm import divergence_audit as D

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string, term string, n int, df int, value string"


def expected(rows, least, top):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", WORD.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(found)
        documents[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        v = len(kept)

        def freq(count, total):
            return 1 + 1_000_000_000 * (count + 5) // (total + 5 * v)

        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: freq(whole[t], sum(whole.values())) for t in kept}
        p = {}
        for s in sources:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: freq(counts[lang, s][t], total) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def rows():
    r = random.Random(7)
    word = lambda: r.choice(("The", "the", "é", "Ünder", "x", "zz", "naïve", "日本", f"r{r.randrange(9)}y", "it's"))
    out = []
    for i in range(240):
        lang = r.choice(("en", "en", "en", "de", None))
        out.append((" ".join(word() for _ in range(r.randrange(30))), lang, r.choice(("a", "b", "c", "d", "Z", "é", None))))
    out += [(None, "en", "null text"), ("123 !?", "en", "no terms"), ("lonely", "xx", "one"), (None, "yy", "p"), ("", "yy", "q"), ("rare words", "zz", "one"), ("rarer", "zz", "two")]
    out += [("\x00A\x7fB[c]d`e{f}" * 50, "en", "a"), ("w" * 300_000 + " the", "de", "long")]
    return out + [out[0]] * 5


def frame(spark, data):
    return spark.createDataFrame([(*r, "t", 1, 2, "v") for r in data], SCHEMA).repartition(5)


@pytest.mark.parametrize("least, top", [(1, 50), (20, 3), (10_000, 50)])
def test_matches_plain_counting(spark, least, top):
    got = D.divergences(frame(spark, rows()), least=least, top=top)
    assert sorted(map(tuple, got.collect())) == expected(rows(), least, top)


def test_tiles_and_blocks_give_the_same_sums():
    listed = [(s, 100 + s) for s in range(7)]
    cells = sorted((t, s, 1000 + 37 * t * s % 501) for t in range(40) for s in range(7) if (t * s + t) % 3)
    want = Counter()
    for t in range(40):
        at = dict(listed) | {s: p for u, s, p in cells if u == t}
        want.update({(i, j): abs(at[i] - at[j]) - (j - i) for i in range(7) for j in range(i + 1, 7)})
    columns = lambda xs: [np.array(c) for c in zip(*xs)]
    for size in (2, 3, 100):
        for block in (1, 20, 10_000):
            for step in (1, 5, 1000):
                got = Counter()
                for a in range(6 // size + 1):
                    for b in range(a, 6 // size + 1):
                        data = [x for x in [(-1, *s) for s in listed] + cells if x[1] // size in (a, b)]
                        shard = D._Shard(("en", 0, a, b), size, block)
                        for k in range(0, len(data), step):
                            shard.add(*columns(data[k:k + step]))
                        for batch in shard.rows():
                            got.update({(r["i"], r["j"]): r["value"] for r in batch.to_pylist()})
                assert got == want


def test_limits_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(D, "sized", lambda df: df)
    # Sources with terms of their own, which no other tile of sources meets.
    data = rows() + [(f"own{chr(97 + k)} " * k + "shared", "many", f"s{k}") for k in range(9)]
    got = D.divergences(frame(spark, data), least=1, top=50, held=10, shard_rows=5, size=2, block=3)
    assert sorted(map(tuple, got.collect())) == expected(data, 1, 50)


def test_empty_table(spark):
    assert D.divergences(frame(spark, [])).count() == 0
