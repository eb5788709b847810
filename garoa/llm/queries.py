"""Registered queries of this subpackage: each operator over its whole given table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from garoa.llm import (
    chat,
    decontaminate,
    fill_middle,
    fingerprints,
    hard_negatives,
    html_text,
    language,
    mixing,
    near_dedup,
    substring,
    tokens,
    toxicity,
    warc,
)
from garoa.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, read back from their formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    return chat.digests(chat.format_chats(rows.union(spark.createDataFrame(extra, rows.schema))))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage of a replica of all pages as WARC records: every 50th page changed, lost, or only there."""
    changed = F.sha2(F.concat(F.lit("WARC/1.1"), F.substring("payload", 9, 2147483647)), 256)
    records = warc.page_records(table(spark, sf_dir, "pages"), changed=changed)
    turn = F.coalesce(F.pmod("page_id", F.lit(50)), F.lit(0))
    copy = records.where(turn != 2).withColumn("payload_sha256", F.when(turn == 1, F.col("changed")).otherwise(F.col("payload_sha256")))
    return warc.audit(records.where(turn != 3), copy)


_CRLF = "chr(13) || chr(10)"
ORACLES["op2_warc_fixity"] = f"""
WITH made AS (
  SELECT page_id, coalesce(printf('pages-%08d.warc', page_id // 1000), 'pages-none.warc') AS file,
    'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF}
      || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF}
      || coalesce(html, '') || {_CRLF} || {_CRLF} AS payload
  FROM pages),
placed AS (
  SELECT *, strlen(payload) AS length, coalesce(page_id % 50, 0) AS turn,
    coalesce(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id, sha256(payload)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM made)
SELECT file, "offset",
  CASE turn WHEN 1 THEN 'changed' WHEN 2 THEN 'missing' ELSE 'extra' END AS status,
  CASE WHEN turn <> 3 THEN length END AS left_length,
  CASE WHEN turn <> 3 THEN sha256(length || '|' || sha256(payload)) END AS left_digest,
  CASE WHEN turn <> 2 THEN length END AS right_length,
  CASE turn WHEN 1 THEN sha256(length || '|' || sha256('WARC/1.1' || payload[9:])) WHEN 3 THEN sha256(length || '|' || sha256(payload)) END AS right_digest
FROM placed WHERE turn IN (1, 2, 3)
"""


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, F.array("source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("distance")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    return language.identify(table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for filling in the middle, and their texts restored from that."""
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    digest = {"output_sha256": F.col("output"), "restored_sha256": fill_middle.restored(F.col("output"), F.col("form"))}
    kept = [F.sha2(text.cast("binary"), 256).alias(name) for name, text in digest.items()]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *kept)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, a seventh of all mislabelled."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


_CONTROL = r"[\[<](/?INST\]|/?ROLE\]|TEXT\]|/?s>)"
#: A text that holds a control string grows by one character for each; the given ones hold none.
ORACLES["op1_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(n)),
d AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    CAST(sum(length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
      + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM d
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"
ORACLES["op4_near_duplicates"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS v
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(v[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, v, unnest(range(1, greatest(len(v) - 3, 2))) AS i FROM w WHERE len(v) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared s JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * s.n >= 75 * (a.n + b.n - s.n)),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, y FROM reach JOIN links ON r = x),
parts AS (SELECT id, min(r) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN parts ON id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

ORACLES["op8_repeated_passages"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS v FROM documents),
win AS (SELECT doc_id, i, array_to_string(v[i:i + 19], ' ') AS k FROM (SELECT doc_id, v, unnest(range(1, len(v) - 18)) AS i FROM w WHERE len(v) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, range(20) r(j)),
each AS (SELECT doc_id, unnest(v) AS word, unnest(range(1, len(v) + 1)) AS p FROM w),
kept AS (
  SELECT e.doc_id, count(g.p) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE g.p IS NULL), '') AS text
  FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
SELECT w.doc_id, len(v) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: All windows of every document and item with a shingle in common; items here have five words or more.
ORACLES["op9_leaks"] = f"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS v
  FROM texts),
g AS (
  SELECT kind, id, p, array_to_string(v[p + 1:p + 5], ' ') AS s, len(v) - 4 AS n
  FROM (SELECT kind, id, v, unnest(range(0, len(v) - 4)) AS p FROM w WHERE len(v) >= 5)),
d AS (SELECT id AS doc_id, p, s, n FROM g WHERE kind = 'd'),
b AS (SELECT id AS item_id, s, any_value(n) AS m, count(*) AS c FROM g WHERE kind = 'b' GROUP BY 1, 2),
pairs AS (SELECT DISTINCT doc_id, item_id, n, m FROM d JOIN b USING (s)),
starts AS (SELECT doc_id, item_id, m, least(n, m) AS size, unnest(range(0, greatest(n - m, 0) + 1)) AS p0 FROM pairs),
counted AS (
  SELECT doc_id, item_id, m, size, p0, s, count(*) AS k FROM starts JOIN d USING (doc_id)
  WHERE p BETWEEN p0 AND p0 + size - 1 GROUP BY ALL),
shared AS (
  SELECT doc_id, item_id, m, size, p0, sum(least(k, c)) AS hit FROM counted JOIN b USING (item_id, m, s) GROUP BY ALL),
scored AS (SELECT *, CAST(hit AS DOUBLE) / CAST(m + size - hit AS DOUBLE) AS likeness FROM shared)
SELECT doc_id, item_id, p0 AS start_word, size + 4 AS n_words, likeness FROM scored WHERE likeness >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY likeness DESC, p0) = 1
"""

ORACLES["op11_fill_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
    WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM c
"""

#: The given ids are unique, so that a row is an anchor's partner if its id is another one.
ORACLES["op13_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM e),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES |= {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_warc_fixity,
        op3_mix_sources,
        op4_near_duplicates,
        op5_token_counts,
        op6_main_text,
        op7_fingerprints,
        op8_repeated_passages,
        op9_leaks,
        op10_language,
        op11_fill_middle,
        op12_toxicity,
        op13_hard_negatives,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
