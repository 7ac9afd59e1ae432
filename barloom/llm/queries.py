"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import attribution, bpe, decontam, jaccard, langid, licenses, lm, merkle, pii, simhash, tiff, toxicity, variants
from barloom.llm._common import fold, table


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs.filter(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_texts(table(spark, sf_dir, "documents", "doc_id", "text"))
    return tiff.read_pages(stored.withColumn("file", F.col("media")), "file", ("doc_id", "n_bytes", "media")).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op3_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribution.attribute(docs, path, public_tokenizers.PATTERN, attribution.line_sections(), "largest")


def op4_marginal_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0), pieces)
    return langid.predict(docs, pieces, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.examine(table(spark, sf_dir, "documents", "doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[n(k) for k in pii.BASE], F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode(docs, path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 10) == 0)


def op10_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    shown = F.transform("hits", lambda h: F.concat_ws(":", h["par"], h["family"], F.format_number(h["overlap"], 3)))
    return found.select("doc_id", "n_hits", F.array_join("families", ",").alias("families"), F.array_join(shown, ",").alias("hits"))


def op11_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_butterfly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row (by the checksum of its id) is checked as if its n_chars had been raised by one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = lambda n: merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    raised = fields(F.col("n_chars").cast("decimal(20, 0)") + 1)
    return merkle.manifest(docs, fields(F.col("n_chars")), F.when(fold("doc_id", 7) == 0, raised))


def op13_edit_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nnpu_toxicity": op1_nnpu_toxicity,
    "op2_tiff_pages": op2_tiff_pages,
    "op3_offset_attribution": op3_offset_attribution,
    "op4_marginal_unigrams": op4_marginal_unigrams,
    "op5_jaccard_components": op5_jaccard_components,
    "op6_weak_supervision": op6_weak_supervision,
    "op7_bpe_transducer": op7_bpe_transducer,
    "op8_winnowing": op8_winnowing,
    "op9_bloom_lm": op9_bloom_lm,
    "op10_license_paragraphs": op10_license_paragraphs,
    "op11_anchor_simhash": op11_anchor_simhash,
    "op12_butterfly_manifest": op12_butterfly_manifest,
    "op13_edit_composition": op13_edit_composition,
}
#: CRC-32 by bytes: the table of a byte's steps, and the checksum of a list ``bytes``.
_CRC_TABLE = "k AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text, with k's column crc at hand."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _field(c: str) -> str:
    """SQL for a field of a leaf."""
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_jaccard_components": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op8_winnowing": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS run
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS run
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, run)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op12_butterfly_manifest": rf"""
WITH RECURSIVE {_CRC_TABLE},
f AS (SELECT doc_id, lang, n_chars, {_crc("doc_id::VARCHAR")} % 7 = 0 AS hit, concat({_field("doc_id")}, {_field("source")}, {_field("lang")}) AS a, {_field("text")} AS z FROM documents, k),
l AS (SELECT doc_id, lang, sha256(a || {_field("n_chars")} || z) AS leaf, CASE WHEN hit AND n_chars IS NOT NULL THEN sha256(a || {_field("(n_chars + 1)")} || z) END AS changed FROM f),
o AS (SELECT *, coalesce('=' || lang, '') AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t(key, lv, i, h, n) AS (SELECT key, 0, i, leaf, count(*) OVER (PARTITION BY key) FROM o
  UNION ALL SELECT key, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY key, lv, i // 2, n),
r AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS kp FROM t WHERE n = 1),
u(lv, i, h, n) AS (SELECT 0, kp, subroot, count(*) OVER () FROM r UNION ALL SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lv, i // 2, n),
p AS (SELECT o.key, o.i, t.lv, t.h FROM o JOIN t ON t.key = o.key AND t.i = xor(o.i >> t.lv, 1) AND t.n > 1),
q AS (SELECT r.key, u.lv, u.h FROM r JOIN u ON u.i = xor(r.kp >> u.lv, 1) AND u.n > 1),
w AS (SELECT o.*, r.subroot, r.kp, coalesce((SELECT string_agg(h, '' ORDER BY lv) FROM p WHERE p.key = o.key AND p.i = o.i), '') AS low, coalesce((SELECT string_agg(h, '' ORDER BY lv) FROM q WHERE q.key = o.key), '') AS top FROM o JOIN r USING (key)),
x AS (SELECT w.doc_id, w.key, w.i, w.kp, 0 AS lv, coalesce(changed, leaf) AS h FROM w
  UNION ALL SELECT x.doc_id, x.key, x.i, x.kp, x.lv + 1, sha256(CASE WHEN s.h IS NULL THEN x.h WHEN (x.i >> x.lv) & 1 = 1 THEN s.h || x.h ELSE x.h || s.h END)
  FROM x JOIN (SELECT DISTINCT key, lv FROM t WHERE n > 1) e ON e.key = x.key AND e.lv = x.lv LEFT JOIN t s ON s.key = x.key AND s.lv = x.lv AND s.i = xor(x.i >> x.lv, 1)),
y AS (SELECT x.doc_id, x.key, x.i, x.kp, 0 AS lv, x.h FROM x JOIN (SELECT key, max(lv) AS lv FROM t GROUP BY key) m ON m.key = x.key AND m.lv = x.lv
  UNION ALL SELECT y.doc_id, y.key, y.i, y.kp, y.lv + 1, sha256(CASE WHEN s.h IS NULL THEN y.h WHEN (y.kp >> y.lv) & 1 = 1 THEN s.h || y.h ELSE y.h || s.h END)
  FROM y JOIN (SELECT DISTINCT lv FROM u WHERE n > 1) e ON e.lv = y.lv LEFT JOIN u s ON s.lv = y.lv AND s.i = xor(y.kp >> y.lv, 1))
SELECT w.doc_id, w.leaf, w.subroot, g.root, sha256(w.low || w.top) AS proof_sha256, y.h AS folded_root, y.h = g.root AS verified
FROM w JOIN (SELECT h AS root, lv FROM u WHERE n = 1) g ON true JOIN y ON y.key = w.key AND y.i = w.i AND y.lv = g.lv""",
    "op13_edit_composition": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
h AS (SELECT w, {_crc("doc_id || ':' || w")} AS h FROM r, k),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM h),
n AS (SELECT word, count(*) AS n FROM v GROUP BY word HAVING length(word) >= 5 AND count(*) >= 3),
d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM n)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM d a JOIN n b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN n b ON a.rest = b.word),
f AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, arg_min(near_n, (-near_n, near)) AS near_n FROM p GROUP BY word),
c AS (SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n.n THEN near END AS form, CASE WHEN near_n >= 2 * n.n THEN near_n END AS form_n FROM n LEFT JOIN f USING (word)),
t(word, form) AS (SELECT word, word FROM c UNION ALL SELECT t.word, c.form FROM t JOIN c ON c.word = t.form WHERE c.form IS NOT NULL)
SELECT c.word, c.form, t.form AS root, c.n, c.n_near, c.form_n FROM c JOIN t ON t.word = c.word JOIN c e ON e.word = t.form AND e.form IS NULL""",
}
