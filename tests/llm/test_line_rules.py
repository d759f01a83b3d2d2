from __future__ import annotations

import re
from collections import Counter, defaultdict

from casework.llm.line_rules import cleaned, line_hash, rated, repeated_words, statistics
from tests.conftest import SF_CHECK

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


TEXTS = ["", " ", "a", "a b c", "a b c a b c", "a a a a a", "a\x0bb\x0cc\rd\te", "é # ü\n\né # ü\n x\n", "| a | b |\n| a | b |\n", "x\xa0y z",
         " ".join(["ab cd"] * 4000), "w" * 100_000, "\n\n\n", "A b c d\na b c d"]


def test_statistics_match_a_plain_count():
    for text in TEXTS:
        assert statistics(text) == plain(text), repr(text[:30])
    assert repeated_words([b"a", b"b", b"c"]) == 0


def expected(rows, floor, share, least):
    lines, hosts = defaultdict(set), defaultdict(set)
    norm = lambda line: " ".join(WORD.findall(line)).lower()
    for i, (key, text, host) in enumerate(rows):
        hosts[host].add(("row", i) if key is None else key)
        for line in (text or "").split("\n"):
            if norm(line):
                lines[host, norm(line)].add(("row", i) if key is None else key)
    out = []
    for key, text, host in rows:
        s = plain(text or "")
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if len(lines[host, norm(x)]) > floor and 100 * len(lines[host, norm(x)]) > share * len(hosts[host]))
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        out.append((key, *s, failed, not failed and 100 * (s[0] - gone) >= least * s[0], s[0] - gone))
    return sorted(out, key=str)


def rows():
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    out = [(i, t, "h") for i, t in enumerate(TEXTS)] + [(50, None, "h"), (None, "Common Line", "h"), (None, "common  line", None), (51, body(51), None)]
    out += [(100 + i, f"{body(i)}\nCommon   line\nx{i}", "h" if i % 2 else None) for i in range(12)]
    out += [(200 + i, "common line\n" + "\n".join(" ".join(f"s{k}y{j}" for j in range(10)) for k in range(6)), "k") for i in range(8)]
    return out + [out[-1], out[-1], out[20]]


def test_verdicts(spark):
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows()], "doc_id long, text string, source string, host string, row int").repartition(5)
    for floor, share in ((3, 0), (7, 0), (100, 0), (5, 5), (2, 40), (0, 50), (0, 100)):
        got = rated(frame, floor=floor, share=share, least_kept=30).drop("removed")
        assert sorted(map(tuple, got.collect()), key=str) == expected(rows(), floor, share, 30)
    assert rated(frame.limit(0)).count() == 0


def test_cleaned_texts(spark):
    frame = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    rating = rated(frame, floor=5, share=0)
    texts = {r.doc_id: r.text for r in cleaned(frame, rating).collect()}
    assert 200 not in texts and texts[101].endswith("\nx1") and "ommon" not in texts[101] and "ommon" not in texts[102]
    assert line_hash(b" A  b ") == line_hash(b"a b")


def test_the_registered_limits_remove_lines_and_reject_depleted_documents(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text", "source")
    host = docs.first().source
    banner = [" ".join(f"b{k}y{j}" for j in range(20)) for k in range(4)]
    page = [(10_000_000 + i, "\n".join([*banner, " ".join(f"own{i}x{j}" for j in range(10))]), host) for i in range(12)]
    clean = [(20_000_000, " ".join(f"clean{j}" for j in range(80)) + "\n" + banner[0], host)]
    got = {r.doc_id: r for r in rated(docs.union(spark.createDataFrame(page + clean, docs.schema))).collect()}
    assert all(not got[i].base_failed and not got[i].kept and got[i].words_left == 10 for i, _, _ in page)
    assert got[20_000_000].kept and got[20_000_000].words_left == 80
    assert any(r.words_left < r.n_words and r.kept for r in got.values())
