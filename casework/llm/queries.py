"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casework.llm.common import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                            public_tokenizers.PATTERN, with_ids=False)


@query
def op6_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.histogram_packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.PATTERN, size=2048, end_id=1)


@query
def op3_matrix_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    from casework.llm.matrix_packing import packed_matrix, segment_rows

    return segment_rows(packed_matrix(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.PATTERN, size=2048, end_id=1))


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.cqf_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


SQL["op7_exact_dedup"] = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


@query
def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.line_rules import rated

    return rated(table(spark, sf_dir, "documents"), floor=5, share=5, least_kept=30).drop("removed")


SQL["op8_line_rules"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), t AS (
  SELECT doc_id, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d
), m AS (
  SELECT doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM l
), n AS (
  SELECT doc_id, source, line, len(words) AS n_words,
         translate(array_to_string(words, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM m WHERE len(words) > 0
), z AS (
  SELECT source, count(DISTINCT doc_id) AS size FROM d GROUP BY source
), f AS (
  SELECT n.source, norm FROM n JOIN z ON n.source IS NOT DISTINCT FROM z.source
  GROUP BY n.source, norm HAVING 100 * count(DISTINCT doc_id) > greatest(500, 5 * any_value(size))
), lines AS (
  SELECT n.doc_id, count(*) - count(DISTINCT n.line) AS n_dup_lines,
         sum(n.n_words) FILTER (WHERE f.norm IS NOT NULL) AS removed
  FROM n LEFT JOIN f ON n.norm = f.norm AND n.source IS NOT DISTINCT FROM f.source GROUP BY n.doc_id
), s AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         (len(words) - coalesce(removed, 0))::BIGINT AS words_left
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * words_left >= 30 * n_words AS kept, words_left
FROM s
"""


@query
def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.rule_ensemble import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.minhash_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


SQL["op5_minhash_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT l.b, reach.seen FROM reach JOIN l ON l.a = reach.node AND reach.seen < l.b
), c AS (
  SELECT node, min(seen) AS component_id FROM (SELECT * FROM reach UNION ALL SELECT a, least(a, b) FROM l) GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""


@query
def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.weak_pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@query
def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of the pairs that :func:`exchanged_answers` makes of the conversations."""
    from casework.llm.preference import exchanged_answers, formatted

    return formatted(*exchanged_answers(table(spark, sf_dir, "conversations")))


SQL["op9_preference"] = r"""
WITH c AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), e AS (
  SELECT conv_id AS p, max(turn) FILTER (WHERE role = 'assistant') AS answer, max(turn) AS last FROM c GROUP BY conv_id
), o AS (
  SELECT c.*, e.answer, coalesce(e.answer, e.last + 1) AS place FROM c JOIN e ON c.conv_id IS NOT DISTINCT FROM e.p
), r AS (
  SELECT conv_id, turn, role, text FROM o WHERE turn < place
  UNION ALL
  SELECT e.p, coalesce(e.answer, e.last + 1), o.role, o.text FROM o JOIN e ON e.p = xor(o.conv_id, 1)
  WHERE o.turn = o.answer AND o.role = 'assistant'
), cs AS (
  SELECT conv_id, turn, list_sort(list(role || chr(0) || text)) AS s FROM c GROUP BY ALL
), rs AS (
  SELECT conv_id, turn, list_sort(list(role || chr(0) || text)) AS s FROM r GROUP BY ALL
), f AS (
  SELECT conv_id, min(turn) FILTER (WHERE a IS DISTINCT FROM b) AS first FROM (
    SELECT coalesce(cs.conv_id, rs.conv_id) AS conv_id, coalesce(cs.turn, rs.turn) AS turn, cs.s AS a, rs.s AS b
    FROM cs FULL JOIN rs ON cs.conv_id IS NOT DISTINCT FROM rs.conv_id AND cs.turn = rs.turn) GROUP BY conv_id
), u AS (
  SELECT c.conv_id, CASE WHEN first IS NULL OR turn < first THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text
  FROM c JOIN f ON c.conv_id IS NOT DISTINCT FROM f.conv_id
  UNION ALL
  SELECT r.conv_id, 'rejected', turn, role, text FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id WHERE turn >= first
), v AS (
  SELECT conv_id, part, turn, part <> 'prompt' AND role = 'assistant' AS learned,
         '<|im_start|>' || replace(role, '<|im_', '<\|im_') || chr(10) AS head, replace(text, '<|im_', '<\|im_') || '<|im_end|>' AS body FROM u
)
SELECT conv_id AS pair_id, part, turn, head || body || chr(10) AS rendered,
       CASE WHEN learned THEN length(head) ELSE 0 END AS train_from, CASE WHEN learned THEN length(head) + length(body) ELSE 0 END AS train_to
FROM v
"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.license_scan import scanned

    return scanned(table(spark, sf_dir, "documents")).drop("matches")


def _license_sql() -> str:
    from casework.llm.license_scan import TEMPLATES

    values = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return f"""
WITH t AS (SELECT license, {words.format('text')} AS words FROM (VALUES {values}) AS v(license, text)
), ts AS (
  SELECT DISTINCT license, len(words) AS length, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM t
), n AS (SELECT license, length, count(*) AS n FROM ts GROUP BY ALL
), d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS words FROM documents
), ds AS (
  SELECT doc_id, unnest(list_transform(range(1, len(words) - 3), lambda i: {{'at': i - 1, 'shingle': array_to_string(words[i:i + 4], ' ')}}), recursive := true) FROM d
), w AS (
  SELECT doc_id, license, length, shingle, "at", unnest(range(0, "at" // length + 1)) AS win FROM ds JOIN ts USING (shingle)
), m AS (
  SELECT doc_id, license, win, count(DISTINCT shingle) AS common FROM w WHERE "at" <= win * length + 2 * length - 5 GROUP BY ALL
), x AS (SELECT DISTINCT doc_id, license FROM m JOIN n USING (license) WHERE 100 * common >= 75 * n.n
), g AS (SELECT doc_id, count(*) AS n_licenses, string_agg(license, ',' ORDER BY license) AS licenses FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN g USING (doc_id)
"""


SQL["op10_license_scan"] = _license_sql()


@query
def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.divergence_audit import divergences

    return divergences(table(spark, sf_dir, "documents"))


SQL["op11_divergence_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT id, lang, source, unnest(words) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), t AS (
  SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(t.total, 0) + 5 * v.v)::HUGEINT)::BIGINT AS p,
         (1 + (1000000000 * (k.n + 5)::HUGEINT) // (v.total + 5 * v.v)::HUGEINT)::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), m AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM x
) WHERE part = 'pair' OR rank <= 50
"""


@query
def op12_shallot_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.shallot_clustering import clustered

    return clustered(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, seed=3)


def _clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The rounds written out one after the other."""
    parts = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
)""", f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x AS c FROM (
    SELECT x, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h LIMIT {k})
)"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT id, arg_min(cluster, [d, cluster]) AS cluster, min(d) AS d FROM (
    SELECT id, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY id
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v JOIN a{r} USING (id))
      GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c{r}.cluster
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (id) JOIN c{rounds} USING (cluster)
"""


SQL["op12_shallot_clustering"] = _clustering_sql()


@query
def op13_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from casework.llm.ngram_decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10).drop("spans")


SQL["op13_ngram_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), s AS (
  SELECT item_id, words, least(len(words), 10) AS size FROM b WHERE len(words) > 0
), t AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS win FROM s
), e AS (
  SELECT id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: {'at': i, 'win': array_to_string(words[i:i + size - 1], ' ')}), recursive := true)
  FROM d, (SELECT DISTINCT size FROM t) WHERE len(words) >= size
), h AS (
  SELECT id, item_id, size, "at" FROM e JOIN t USING (size, win)
), n AS (
  SELECT id, count(DISTINCT "at" + k) AS n_hit FROM (SELECT id, "at", unnest(range(0, size)) AS k FROM h) GROUP BY id
), m AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, coalesce(item_id::VARCHAR, '') AS item FROM h) GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (id) LEFT JOIN m USING (id)
"""
