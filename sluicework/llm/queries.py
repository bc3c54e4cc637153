"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import warc
from sluicework.llm.common import table, written
from sluicework.llm.exact_dedup import exact_dedup
from sluicework.llm.language import language_id
from sluicework.llm.lexical_search import lexical_search
from sluicework.llm.line_dedup import dedup_lines
from sluicework.llm.ngram_join import ngram_join
from sluicework.llm.packing import best_fit_packing
from sluicework.llm.pieces import decode, encode
from sluicework.llm.prefix_trie import prefix_trie
from sluicework.llm.quality import quality_rules
from sluicework.llm.sharding import SHARDS, assign_shards
from sluicework.llm.substring_dedup import substring_dedup
from sluicework.llm.toxicity import toxicity
from sluicework.session import fresh_path, remove

#: Folder of the public vocabulary files; where it isn't set, the installed package says where its files are.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and verdicts of all documents, with the verdicts of their hosts."""
    return quality_rules(table(spark, folder, "documents", "doc_id", "text", "source"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The row that stays for each document."""
    return exact_dedup(table(spark, folder, "documents", "doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Number and checksum of the ids of all documents, and whether they decode to the text."""
    path = vocabulary("piece_bpe_32k.model")
    coded = decode(encode(table(spark, folder, "documents", "doc_id", "text"), path), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32",
        F.length("decoded").cast("long").alias("n_chars_decoded"),
        (F.col("decoded") == F.col("text")).alias("round_trip"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of all documents when repeated lines are removed."""
    left = dedup_lines(table(spark, folder, "documents", "doc_id", "text"))
    return left.select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of all documents."""
    names = [f"shard-{k:03d}" for k in range(SHARDS)]
    return assign_shards(table(spark, folder, "documents", "doc_id"), "doc_id", names)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all pages, read back from the archives that were written of them."""
    path = fresh_path(spark, "warc")
    warc.write_archives(warc.records(table(spark, folder, "pages", "page_id", "url", "html")), path)
    found = written(warc.read_records(spark, path))
    remove(spark, path)
    return found


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents."""
    return toxicity(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "toxic"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents."""
    return language_id(table(spark, folder, "documents", "doc_id", "text", "lang"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The place of all pieces of all documents in sequences of 1024 ids."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    return best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """The class of all documents and their number of links."""
    return ngram_join(table(spark, folder, "documents", "doc_id", "text")).drop("row")


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of all documents when passages that occur elsewhere are removed."""
    left = substring_dedup(table(spark, folder, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical_search(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return prefix_trie(table(spark, folder, "conversations", "conv_id", "turn", "role", "text"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_exact_dedup, op3_sentencepiece, op4_line_dedup, op5_sharding, op6_warc, op7_toxicity, op8_language_id,
    op9_best_fit_packing, op10_ngram_join,
    op11_substring_dedup, op12_lexical_search, op13_prefix_trie)}

ORACLE = {
    "op1_quality_rules": r"""
WITH d AS (
    SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
    FROM d
), words AS (
    SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS i FROM w
), wins AS (
    SELECT doc_id, i, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
    SELECT doc_id, i FROM wins WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, x, y, z) > 1
), rep AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
    SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
           coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rep USING (doc_id)
), f AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           100 * n_symbols > 10 * word_chars AS symbols_failed, 100 * n_dup_lines > 50 * n_lines AS lines_failed
    FROM m
), h AS (
    SELECT source, r.k AS k, count(*) AS n, count_if(r.v) AS x
    FROM (SELECT source, unnest([{'k': 1, 'v': base_failed}, {'k': 2, 'v': symbols_failed}, {'k': 3, 'v': lines_failed}]) AS r FROM f)
    WHERE source IS NOT NULL GROUP BY 1, 2
), p AS (
    SELECT k, avg(x / n) AS a, var_pop(x / n) AS v FROM h GROUP BY k
), q AS (
    SELECT k, a, CASE WHEN v > 0 THEN least(greatest(a * (1 - a) / v - 1, 2), 1000) ELSE 1000 END AS s FROM p
), bad AS (
    SELECT DISTINCT source FROM h JOIN q USING (k) WHERE (x + a * s) / (n + s) >= 0.8
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       bad.source IS NOT NULL AS host_rejected, NOT base_failed AND bad.source IS NULL AS kept
FROM f LEFT JOIN bad ON f.source = bad.source""",
    "op6_warc": """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to, true AS digest_agrees
FROM f""",
    "op4_line_dedup": r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), s AS (
    SELECT *, row_number() OVER (ORDER BY doc_id, i) AS p,
           list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w
    FROM l WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), t AS (
    SELECT p, len(w) AS n, unnest(w) AS w FROM s
), o AS (
    SELECT y.p, x.n + y.n AS n, count(*) AS o
    FROM t x JOIN t y ON x.w = y.w AND x.p < y.p AND 4 * x.n <= 5 * y.n AND 4 * y.n <= 5 * x.n
    GROUP BY y.p, x.p, x.n, y.n
), gone AS (
    SELECT DISTINCT doc_id, i FROM s JOIN (SELECT DISTINCT p FROM o WHERE 9 * o >= 4 * n) USING (p)
), r AS (
    SELECT doc_id, string_agg(l, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS t, count(gone.i) AS k
    FROM l LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, k AS n_removed, length(coalesce(t, ''))::BIGINT AS n_chars_left, sha256(coalesce(t, '')) AS text_sha256
FROM r""",
    "op5_sharding": """
WITH RECURSIVE n AS (
    SELECT unnest(range(64)) AS k
), p AS (
    SELECT k, ('0x' || substr(md5('start shard-' || lpad(k::VARCHAR, 3, '0')), 1, 15))::BIGINT % 6421 AS s,
           ('0x' || substr(md5('step shard-' || lpad(k::VARCHAR, 3, '0')), 1, 15))::BIGINT % 6420 + 1 AS d
    FROM n
), claim AS (
    SELECT 0 AS i, bitstring('0', 6421) AS taken, -1::BIGINT AS slot
    UNION ALL
    SELECT i + 1, set_bit(taken, x::INT, 1), x
    FROM (
        SELECT i, taken, (SELECT (s + j * d) % 6421 FROM range(6421) r(j)
                          WHERE get_bit(taken, ((s + j * d) % 6421)::INT) = 0 ORDER BY j LIMIT 1) AS x
        FROM claim JOIN p ON k = i % 64 WHERE i < 6421)
)
SELECT doc_id, slot::INT AS slot, 'shard-' || lpad(((i - 1) % 64)::VARCHAR, 3, '0') AS shard
FROM documents JOIN claim
    ON slot = ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 6421""",
    "op2_exact_dedup": r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
    FROM documents
), k AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS c
    FROM d
)
SELECT doc_id, keep_id, c::BIGINT AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""",
    "op10_ngram_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, list_sort(list_distinct(CASE
        WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s
    FROM w
), c AS (
    SELECT s, min(doc_id) AS c, count(*) AS size, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), x AS (
    SELECT c, size, n, unnest(s) AS x FROM c
), l AS (
    SELECT a.c AS a, b.c AS b, b.size AS size FROM x a JOIN x b ON a.x = b.x AND a.c <> b.c
    GROUP BY a.c, b.c, a.n, b.n, b.size HAVING 9 * count(*) >= 4 * (a.n + b.n)
), r AS (
    SELECT c, c AS k FROM c UNION SELECT l.b, r.k FROM r JOIN l ON l.a = r.c
), k AS (
    SELECT c, min(k) AS k FROM r GROUP BY c
), g AS (
    SELECT k, sum(size) AS size FROM k JOIN c USING (c) GROUP BY k
), n AS (
    SELECT a AS c, sum(size) AS n FROM l GROUP BY a
)
SELECT doc_id, coalesce(k.k, doc_id) AS class_id, coalesce(g.size, 1)::BIGINT AS class_size,
       coalesce(c.size, 1)::BIGINT AS n_copies, (coalesce(n.n, 0) + coalesce(c.size, 1) - 1)::BIGINT AS n_links
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.c = c.c LEFT JOIN g ON g.k = k.k LEFT JOIN n ON n.c = c.c""",
    "op11_substring_dedup": r"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), w AS (
    SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d
), w2 AS (
    SELECT *, w || ' ' || lead(w) OVER o AS x2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), w4 AS (
    SELECT *, md5(x2 || ' ' || lead(x2, 2) OVER o) AS x4 FROM w2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), w8 AS (
    SELECT *, md5(x4 || lead(x4, 4) OVER o) AS x8 FROM w4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), w35 AS (
    SELECT doc_id, w, i, md5(x8 || lead(x8, 8) OVER o || lead(x8, 16) OVER o || lead(x8, 24) OVER o || lead(x2, 32) OVER o || ' ' || lead(w, 34) OVER o) AS x
    FROM w8 WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s AS (
    SELECT doc_id, w, i, n IS NOT NULL AS again
    FROM w35 LEFT JOIN (SELECT x, count(*) AS n FROM w35 WHERE x IS NOT NULL GROUP BY x HAVING n > 1) USING (x)
), g AS (
    SELECT doc_id, w, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM s
), k AS (
    SELECT doc_id, count_if(gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM g GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op12_lexical_search": r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
), c AS (
    SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM t WHERE len(ts) > 0
), p AS (
    SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM t) GROUP BY ALL
), f AS (
    SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, n_docs
), q AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark
), s AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN p USING (t) JOIN f USING (t), c GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER o::INT AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10""",
    "op13_prefix_trie": """
WITH t AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), h AS (
    SELECT c, count(*) AS own, xor(list_reduce(
        list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
        lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
    ), 4294967295) % 6 AS h
    FROM t GROUP BY c
), k AS (
    SELECT h.c, h.h, h.c - h.c % 100 AS head, least(h.h, coalesce(b.own, 0)) AS taken FROM h LEFT JOIN h b ON b.c = h.c - h.c % 100
), u AS (
    SELECT k.c, t.i AS d, t.r, t.x FROM k JOIN t ON t.c = head AND t.i <= taken
    UNION ALL
    SELECT k.c, taken + t.i - k.h, t.r, t.x FROM k JOIN t ON t.c = k.c AND t.i > k.h
), l AS (
    SELECT k.c, coalesce(list({'r': u.r, 'x': u.x} ORDER BY u.d) FILTER (u.d IS NOT NULL), []) AS l FROM k LEFT JOIN u ON u.c = k.c GROUP BY k.c
), p AS (
    SELECT c, d, l[1:d] AS node, d = len(l) AS ends FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM l)
), n AS (
    SELECT node, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS e FROM p GROUP BY node, d
), m AS (
    SELECT n.*, coalesce(z.z, 0) AS z, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(node[d].x) END AS saved
    FROM n LEFT JOIN (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS z FROM n WHERE d > 0 GROUP BY ALL) z USING (node, d)
), s AS (
    SELECT p.node, p.d, count_if(m.z = 0)::BIGINT AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens
    FROM m JOIN p ON p.c = m.c AND p.d <= m.d GROUP BY p.node, p.d
)
SELECT m.c AS conv_id, m.d AS depth, y.c AS parent_conv_id, m.n AS n_convs, m.z AS n_children, n_leaves, saved_tokens, sha256(m.e) AS ends_sha256
FROM m JOIN s USING (node, d) LEFT JOIN n y ON y.node = m.node[1:m.d - 1] AND y.d = m.d - 1""",
}
