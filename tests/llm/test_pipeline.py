from __future__ import annotations

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from casework.llm.rule_ensemble import scored
from casework.llm.weak_pii import KINDS, personal_data
from tests.conftest import SF_SMALL
from tests.llm import test_exact_dedup, test_minhash_dedup
from tests.llm.test_packing import check


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    rows = lambda frame: {r.doc_id: r for r in frame.collect()}
    before, frame = rows(docs), docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, frame, SF_SMALL), name)
        if k == 4:
            break
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = rows(out)
        texts = [(i, r.text) for i, r in before.items()]
        if name == "quality":
            assert set(after) == {r.doc_id for r in scored(frame, labels).collect() if r.predicted == 1}
            quality = {r.doc_id: r.quality for r in labels.collect()}
            good = [i for i in before if quality.get(i) == 1]
            assert len([i for i in good if i in after]) > 0.97 * len(good)
            assert sum(quality.get(i) == 0 for i in after) < 0.4 * sum(quality.get(i) == 0 for i in before)
        elif name == "exact_dedup":
            assert set(after) == {r[0] for r in test_exact_dedup.expected(texts) if r[3]} and len(after) < len(before)
        elif name == "near_dedup":
            assert set(after) == {r[0] for r in test_minhash_dedup.expected(texts) if r[3]} and len(after) < len(before)
        else:
            assert set(after) == set(before)
            for r in personal_data(frame).collect():
                text, at, parts = before[r.doc_id].text, 0, []
                spans = sorted((int(a), KINDS.index(kind), int(b)) for kind, a, b in (s.split(":") for s in r.spans.split(",") if s))
                for a, kind, b in spans:
                    if a >= at:
                        parts += [text[at:a], f"<{KINDS[kind].upper()}>"]
                    at = max(at, b)
                assert after[r.doc_id].text == "".join(parts) + text[at:]
                assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        if name != "pii":
            assert all(after[i] == before[i] for i in after)
        before, frame = after, out
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    check(out.collect(), [(i, r.text, 1) for i, r in before.items()], library, 2048)


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(1, "good words here. " * 40, "en", "a", 1, 7), (1, "good words here. " * 40, "en", "a", 1, 7), (None, None, None, None, None, None),
            (2, None, "en", "a", 0, 7), (3, "", "en", None, 0, 7), (None, "mail a@b.com", "en", "a", 0, 7)]
    names = ["kept", "row", "row_number", "__text", "__row", "a.b", "further5", "text_sha256", "spans", "label"]
    rows = [(*r, *[f"{n}!" for n in names[1:]]) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, " + ", ".join(f"`{n}` string" for n in names[1:])
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    # The empty texts are exact copies: the row with the largest id stays.
    assert Counter(r.doc_id for r in out) == {1: 1, 3: 1, None: 1}
    frame = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, frame, f"{tmp_path}/some")
        assert left.schema.names == frame.schema.names and left.count()
        assert all(r[n] == f"{n}!" for r in left.collect() for n in names[1:])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_deduplication_decides_on_rows(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = lambda stage, rows: Counter(tuple(r) for r in stage(spark, frame(rows), SF_SMALL).collect())
    # Without ids: a text of its own, copies of a document, copies of each other, blank rows; one id with two texts.
    rows = [(None, text(0)), (1, text(1)), (None, text(1)), (None, text(1))] + [(None, text(2))] * 5 + [(None, None)] * 4
    rows += [(3, text(3)), (3, text(4)), (4, text(4))]
    want = Counter([(None, text(0)), (1, text(1)), (None, text(2)), (None, None), (3, text(3)), (4, text(4))])
    assert left(corpus_pipeline.exact_dedup, rows) == want
    # Rows that repeat id and text: one stays, a row without id or text among empty ones too.
    rows = [(5, text(5))] * 4 + [(None, text(5)), (6, ""), (6, None), (None, None), (6, "")]
    out = left(corpus_pipeline.exact_dedup, rows)
    assert out.pop((5, text(5))) == 1 and sum(out.values()) == 1 and {k for k, _ in out} == {6}
    assert left(corpus_pipeline.near_dedup, [(5, text(5))] * 3 + [(5, near(5))] * 2 + [(None, near(5))]).total() == 1
    rows = [(None, text(0)), (1, text(1)), (None, near(1)), (None, text(2)), (None, near(2)), (2, near(4)), (4, text(3)), (4, text(4))]
    want = Counter([(None, text(0)), (1, text(1)), (2, near(4)), (4, text(3))])
    out = left(corpus_pipeline.near_dedup, rows)
    assert sum(out.pop((None, t), 0) for t in (text(2), near(2))) == 1 and out == want
