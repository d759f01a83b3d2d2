from __future__ import annotations

import random
import re

import numpy as np

from casework.llm import minhash_dedup as M
from casework.llm.star_components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (same_id or 100 * inter >= 75 * len(sets[i] | sets[j])):
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            r = find(parent, i)
            least[r] = min(least.get(r, key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        c = least.get(find(parent, i)) if sets[i] else key
        out.append((key, len(sets[i]), c, key == c))
    return sorted(out, key=str)


def family(rng, size, changes, base=120):
    words = [f"v{rng.randrange(10**6)}" for _ in range(base)]
    out = [" ".join(words)]
    for _ in range(size - 1):
        copy = list(words)
        for _ in range(rng.randrange(changes)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = ["", None, " \n", "A b", "a  B", "a b c", "a b c d e", "A B c d\te", "\xa0", "x" * 50_000, "one two three four five six " * 3000]
    texts += family(rng, 150, 9) + family(rng, 40, 5, 60) + [x for _ in range(15) for x in family(rng, 3, 6, 80)]
    chain = [f"c{i}" for i in range(90)]
    texts += [" ".join(chain[i:i + 60]) for i in range(0, 31, 3)]
    shared = " ".join(f"s{i}" for i in range(55))
    texts += [shared + " " + " ".join(f"u{k}x{i}" for i in range(60)) for k in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[20]), (None, "only null here"), (None, "only null here"), rows[5], rows[5]]


def test_shingles_match_sets():
    for text in ("", "a", "a b c d", "a b c d e", "a b a b a b a b a b", "é É x y z w"):
        assert len(M.shingles(M.words_of(text.encode()))) == len(shingle_set(text))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    for share in (0.3, 0.75, 0.9):
        k = int(5000 * (1 - share) / (1 + share))
        y = np.concatenate([x[: 5000 - k], rng.integers(0, 1 << 63, k).astype(np.uint64)])
        assert abs((M.signature(x) == M.signature(y)).mean() - share) < 0.16


def test_block_links_match_pairs():
    rng = random.Random(8)
    texts = family(rng, 60, 12)
    sets = [M.shingles(M.words_of(t.encode())) for t in texts]
    comps = np.array([i // 2 for i in range(60)])
    want = set()
    for i in range(60):
        for j in range(60):
            if comps[i] < comps[j] and M.linked(np.intersect1d(sets[i], sets[j]).size, len(sets[i]), len(sets[j])):
                want.add((comps[i], comps[j]))
    assert set(M.block_links(sets, comps)) == want


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2001 + i) for i in range(40)]
    parent = {x: x for link in links for x in link}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(parent, x) for link in links if link[0] != link[1] for x in link}


def test_groups_match_brute_force(spark):
    rows = corpus(4)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, component long, signature string").repartition(6)
    for block in (16, M.BLOCK):
        assert sorted(map(tuple, M.near_groups(frame, block=block).collect()), key=str) == expected(rows)
    assert M.near_groups(frame.limit(0)).count() == 0
    assert M.near_groups(frame.where("text is null")).collect()[0].n_shingles == 0
