"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (brown, decontaminate, exact_dedup, fim, jaccard_join, langid, mixing, prefix_trie, quality, sharding, simhash,
               suffix_dedup, warc)
from .common import table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op1_repeated_substrings")
def op1(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=True)
    return out.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op2_benchmark_hits", f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.size = x.size AND g.phrase = x.phrase),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op2(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@register("op3_jaccard_components")
def op3(spark, sf_dir):
    return jaccard_join.link_documents(table(spark, sf_dir, "documents"))


@register("op4_language")
def op4(spark, sf_dir):
    return langid.identify_languages(table(spark, sf_dir, "documents"))


@register("op5_warc_pages", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    ((CAST('0x' || substr(sha1(h), CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31)
    AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER g THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER g THEN min(page_id) OVER g END AS refers_to
FROM p WINDOW g AS (PARTITION BY h)""")
def op5(spark, sf_dir):
    return warc.page_records(spark, sf_dir)


@register("op6_source_mix")
def op6(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


@register("op7_jump_shards")
def op7(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


@register("op8_brown_scores")
def op8(spark, sf_dir):
    return brown.score_texts(table(spark, sf_dir, "documents"))


@register("op9_exact_copies", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""")
def op9(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@register("op10_quality_scores")
def op10(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op11_simhash_components")
def op11(spark, sf_dir):
    return simhash.link_documents(table(spark, sf_dir, "documents"))


# crc32 of the decimal id, bit by bit: DuckDB has no function for it
CRC = ("xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), "
       "lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
       "lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))")


@register("op12_prefix_trie", f"""
WITH named AS (SELECT conv_id AS c, turn, coalesce(text, '') AS t, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, digest, length(t) AS chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS i FROM named),
convs AS (SELECT c, {CRC} % 6 AS h FROM (SELECT DISTINCT c FROM named)),
parts AS (SELECT v.c, 0 AS own, t.i, t.digest, t.chars FROM convs v JOIN turns t ON t.c = v.c - v.c % 100 AND t.i <= v.h
  UNION ALL SELECT v.c, 1, t.i, t.digest, t.chars FROM convs v JOIN turns t ON t.c = v.c AND t.i > v.h),
placed AS (SELECT c, digest, chars, row_number() OVER w AS d, count(*) OVER (PARTITION BY c) AS size,
  md5(array_to_string(array_agg(digest) OVER w, ',')) AS node FROM parts WINDOW w AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
entries AS (SELECT c, d, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY d), 'root') AS above, chars, d = size AS last FROM placed
  UNION ALL SELECT c, 0, 'root', NULL, 0, c NOT IN (SELECT c FROM placed) FROM convs),
nodes AS (SELECT node, min(c) AS conv_id, count(*) AS n_convs, max(d) AS depth, max(above) AS above, max(chars) AS chars,
  string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last) AS ends FROM entries GROUP BY node),
below AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN below USING (node)),
under AS (SELECT e.node, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved
  FROM full_nodes w JOIN entries e ON e.c = w.conv_id AND e.d <= w.depth GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN under u USING (node) LEFT JOIN nodes p ON n.above = p.node""")
def op12(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@register("op13_fill_in_middle", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
  list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, CAST(i AS BIGINT), 8) AS BIGINT)) AS g FROM d),
cuts AS (SELECT *, least(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS lo, greatest(g[1] % (len(u) + 1), g[2] % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain'
       WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM cuts)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256, sha256(t) AS restored_sha256 FROM parts""")
def op13(spark, sf_dir):
    return fim.fim_digests(table(spark, sf_dir, "documents"))
