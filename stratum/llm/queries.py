"""The registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import ogg

    return ogg.media(table(spark, sf_dir, "documents"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import multi_index

    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import suffix_dedup

    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import sentence_pieces

    return sentence_pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")).drop("ids")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import token_counts

    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import spelling

    return spelling.variants(table(spark, sf_dir, "documents"), noise=31)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratum.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_ogg_media, op3_multi_index, op4_suffix_dedup, op5_packing, op6_quality, op7_sentence_pieces, op8_token_counts, op9_warc, op10_minhash, op11_spelling, op12_licenses, op13_whitening, pipeline)}
#: Smallest id that links (a, b), either way round, lead to.
REACH = """reach AS (
  SELECT id AS node, id AS m FROM ids
  UNION
  SELECT l.b, r.m FROM reach r JOIN (SELECT a, b FROM links UNION SELECT b, a FROM links) l ON l.a = r.node
), least AS (SELECT node, min(m) AS component_id FROM reach GROUP BY node)"""

OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), ids AS (SELECT doc_id AS id FROM documents
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * inter >= 75 * (na.n + nb.n - inter)
), {REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP3 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.98
), n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id
), ids AS (SELECT vec_id AS id FROM embeddings
), {REACH}
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""

OP9 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(digest, 1 + 5 * (i // 4), 5))::INT // [32768, 1024, 32, 1][1 + i % 4]) % 32, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, unnest(list_transform(range(0, greatest(0, length(h) // 2 - 399)), lambda p: {'p': p, 'k': hash(h[2 * p + 1:2 * p + 800])}), recursive := true) FROM d),
r AS (SELECT doc_id, p FROM x WHERE k IN (SELECT k FROM x GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
w AS (SELECT s.doc_id, a + length(regexp_extract(substr(h, 2 * a + 1, 6), '^([89AB].)*')) // 2 AS a,
  b - CASE WHEN substr(h, 2 * b + 1, 1) IN ('8', '9', 'A', 'B') THEN 1 + length(regexp_extract(substr(h, 2 * b - 3, 4), '([89AB].)*$')) // 2 ELSE 0 END AS b FROM s JOIN d USING (doc_id)),
v AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM w),
m AS (SELECT k.doc_id, sum(b - a) AS n, count(*) AS c, max(b) AS last, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
t AS (SELECT v.doc_id, max(b) AS end_, string_agg(h[2 * before + 1:2 * a], '' ORDER BY a) AS whole FROM v JOIN d USING (doc_id) GROUP BY v.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256,
  decode(unhex(coalesce(whole, '') || h[2 * coalesce(end_, 0) + 1:])) AS text
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: crc32 by its table, which is made from the polynomial; near words by equal deletions at a place (replaced) or a deletion that is a word.
OP11 = """
WITH RECURSIVE t AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM r WHERE length(run) >= 7 GROUP BY ALL),
c AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t.t[1 + (xor(c, x) % 256)]))) AS crc FROM u, t),
w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, 2 + crc % length(run)) ELSE run END AS word, n FROM c) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT a.word AS a, b.word AS b, b.n FROM k a JOIN k b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.less, k.word, k.n FROM k JOIN w ON w.word = k.less UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.less),
g AS (SELECT word, w.n, count(b) AS n_near, min({'m': -e.n, 'b': b}) AS best FROM w LEFT JOIN e ON e.a = word GROUP BY ALL),
f AS (SELECT word, n, n_near, CASE WHEN -best.m >= 10 * n THEN best.b END AS form, CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM g),
q AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT q.word, q.next, f.form FROM q JOIN f ON f.word = q.next)
SELECT word, form, root, n, n_near, form_n FROM f JOIN q USING (word) WHERE q.next IS NULL
"""


def op12() -> str:
    from stratum.llm import licenses

    return licenses.sql()


ORACLE_SQL: dict[str, str] = {"op11_spelling": OP11, "op12_licenses": op12(), "op4_suffix_dedup": OP4, "op3_multi_index": OP3, "op9_warc": OP9, "op10_minhash": OP10}
