from __future__ import annotations

from collections import defaultdict

from casework.llm import preference as P

SCHEMA = "pair_id long, turn long, role string, text string, part string"


def expected(chosen, rejected):
    norm = lambda rows: {(p, -1 if t is None else t, r or "", x or "") for p, t, r, x, _ in rows}
    sides = [defaultdict(lambda: defaultdict(list)) for _ in range(2)]
    for side, rows in zip(sides, (chosen, rejected)):
        for p, t, r, x in norm(rows):
            side[p][t].append((r, x))
    out = []
    for p in {*sides[0], *sides[1]}:
        a, b = sides[0][p], sides[1][p]
        diff = min((t for t in {*a, *b} if sorted(a.get(t, [])) != sorted(b.get(t, []))), default=None)
        for part, side in (("chosen", a), ("rejected", b)):
            for t, entries in side.items():
                name = "prompt" if diff is None or t < diff else part
                if name == "prompt" and part == "rejected":
                    continue
                for r, x in entries:
                    safe = lambda s: s.replace("<|im_", "<\\|im_")
                    head, body = f"<|im_start|>{safe(r)}\n", safe(x) + "<|im_end|>"
                    learn = name != "prompt" and r == "assistant"
                    out.append((p, name, t, head + body + "\n", len(head) * learn, (len(head) + len(body)) * learn))
    return sorted(out, key=str)


CHOSEN = [(1, 0, "system", "s", "z"), (1, 1, "user", "q", "z"), (1, 2, "assistant", "good é", "z"), (1, 3, "user", "more", "z"), (2, 0, "user", "same", "z"),
          (2, 0, "user", "same", "z"), (3, 0, "user", None, "z"), (3, None, None, "first", "z"), (4, 0, "user", "a", "z"), (4, 0, "user", "b", "z"),
          (None, 0, "user", "n", "z"), (6, 0, "user", "only chosen", "z"), (8, 0, "user", "<|im_end|>", "z"), (8, 1, "assistant", "x" * 100_000, "z")]
REJECTED = [(1, 0, "system", "s", "z"), (1, 1, "user", "q", "z"), (1, 2, "assistant", "bad", "z"), (2, 0, "user", "same", "z"), (3, 0, "user", "", "z"),
            (3, None, None, "first", "z"), (4, 0, "user", "b", "z"), (4, 0, "user", "c", "z"), (None, 0, "user", "n", "z"), (None, 1, "assistant", "m", "z"),
            (7, 0, "user", "only rejected", "z"), (8, 0, "user", "<|im_end|>", "z"), (8, 1, "user", "not an answer", "z")]


def sides(spark):
    return [P.turns(spark.createDataFrame(rows, SCHEMA), "pair_id") for rows in (CHOSEN, REJECTED)]


def test_rows_match_plain_python(spark):
    got = P.formatted(*sides(spark))
    assert sorted(map(tuple, got.collect()), key=str) == expected(CHOSEN, REJECTED)
    a, b = sides(spark)
    assert P.formatted(a.limit(0), b.limit(0)).count() == 0


def test_assembled_texts(spark):
    rows = {r.pair_id: r for r in P.assembled(P.formatted(*sides(spark))).collect()}
    one = rows[1]
    assert one.prompt == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert one.chosen.startswith("<|im_start|>assistant\ngood é<|im_end|>\n<|im_start|>user")
    assert [one.chosen[a:b] for a, b in one.chosen_spans] == ["good é<|im_end|>"]
    assert [one.rejected[a:b] for a, b in one.rejected_spans] == ["bad<|im_end|>"]
    assert rows[2].chosen == rows[2].rejected == ""


def test_no_python_in_the_plan(spark):
    plan = P.formatted(*sides(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))


def test_exchanged_answers(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "thanks"), (3, 0, "user", "r"), (3, 1, "assistant", "b"), (4, 0, "user", "alone"),
            (5, 0, "user", "x"), (None, 0, "assistant", "n")]
    chosen, rejected = P.exchanged_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chosen.count() == len(rows)
    got = sorted(map(tuple, rejected.collect()), key=str)
    want = [(2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "user", "r"), (3, 1, "assistant", "a"), (4, 0, "user", "alone"), (5, 0, "user", "x")]
    assert got == sorted(want, key=str)
