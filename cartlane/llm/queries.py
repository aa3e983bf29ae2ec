"""The registered queries of the operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlane.llm import (byte_bpe, filter_audit, interpolated_lm, jaccard_rtree, patricia, prefix_counts, pu_classifier,
                          quality_rules, skip_chain, splitters, sum_of_squares, warc_chunks, whitening)
from cartlane.llm.common import table, tokenizer_path


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score_documents(table(spark, sf_dir, "documents"))


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitters.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op5_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("failed_rules")


def op6_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.jaccard_groups(table(spark, sf_dir, "documents")).drop("node")


def op7_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.round_trip(table(spark, sf_dir, "pages"))


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_of_squares.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op9_patricia_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.component_rows(table(spark, sf_dir, "embeddings"))


def op12_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skip_chain.digests(skip_chain.find_personal_data(table(spark, sf_dir, "documents")))


def op13_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_prefix_counts": op2_prefix_counts,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_sampled_splitters": op4_sampled_splitters,
    "op5_threshold_rules": op5_threshold_rules,
    "op6_count_vector_join": op6_count_vector_join,
    "op7_chunked_warc": op7_chunked_warc,
    "op8_sum_of_squares": op8_sum_of_squares,
    "op9_patricia_dedup": op9_patricia_dedup,
    "op10_pu_quality": op10_pu_quality,
    "op11_spectrum_slicing": op11_spectrum_slicing,
    "op12_skip_chain": op12_skip_chain,
    "op13_survival_words": op13_survival_words,
}

# Measures only; the verdict ``kept`` of the rule table is checked against a plain Python version in the tests, and
# here through the same thresholds in SQL.
_OP5_STOP = ", ".join(f"'{w}'" for x in sorted({w for t in quality_rules.STOP_WORDS.values() for w in t.split()})
                      for w in dict.fromkeys((x, x.capitalize())))
_OP5_SQL = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)),
                                  lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
               FROM documents),
         places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
         windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places),
         repeated AS (SELECT doc_id, count(DISTINCT i + step) AS n
                      FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS step FROM windows WHERE n > 1) GROUP BY doc_id),
         m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                      CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
                      len(regexp_extract_all(t, '[!?]{{2,}}')) AS marks,
                      len(regexp_extract_all(t, '\p{{Lu}}')) AS capitals,
                      len(list_filter(w, lambda x: x IN ({_OP5_STOP}))) AS stops,
                      len(lines) AS n_lines,
                      len(list_filter(lines, lambda l: regexp_matches(ltrim(l, ' '), '^[-*•]'))) AS bullets,
                      len(list_filter(lines, lambda l: regexp_matches(rtrim(l, ' '), '(…|[.]{{3}})$'))) AS ellipses
               FROM d LEFT JOIN repeated r USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
           AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_symbols <= n_words
           AND 10 * marks <= n_words AND 10 * capitals <= 3 * word_chars AND 50 * stops >= n_words
           AND 10 * bullets <= 9 * n_lines AND 10 * ellipses <= 3 * n_lines AND 2 * n_dup_lines <= n_lines AS kept
    FROM m""".replace("\\\\", "\\")

# All pairs that share a shingle, their exact overlap, and the documents that links reach.
_OP6_SQL = r"""
    WITH RECURSIVE d AS (
           SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
                 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                 ELSE [array_to_string(w, ' ')] END) AS shingle FROM d WHERE len(w) > 0),
         n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
         pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (shingle)
                   WHERE a.doc_id <> b.doc_id GROUP BY ALL),
         links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
                   WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
         reach AS (SELECT doc_id, doc_id AS other FROM d
                   UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other)
    SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
    FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

# Base32 by hand: the SHA-1's 160 bits in groups of five.
_OP7_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
         g AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h),
         b AS (SELECT h, owner, array_to_string(list_transform(range(40),
                   lambda i: right('000' || bin(instr('0123456789abcdef', substr(sha1(h), CAST(i AS INT) + 1, 1)) - 1), 4)), '')
                   AS bits FROM g),
         d AS (SELECT h, owner, array_to_string(list_transform(range(32),
                   lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + CAST(list_sum(list_transform(range(5), lambda k:
                           CAST(substr(bits, CAST(5 * i + k + 1 AS INT), 1) AS INT) * CAST(2 ** (4 - k) AS INT))) AS INT),
                       1)), '') AS digest FROM b)
    SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
           CASE WHEN p.page_id = d.owner THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN p.page_id <> d.owner THEN d.owner END AS refers_to
    FROM p JOIN d ON p.h = d.h"""

# Counts by part and failed filters, then every step of every order over them: no survival word, no subset count.
_OP13_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         first AS (SELECT t, min(doc_id) AS owner FROM d GROUP BY t),
         l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
         f AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
                             100 * len(regexp_extract_all(d.t, '[A-Z]')) > 5 * length(d.t),
                             regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > owner, false)] AS fails,
                      coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
               FROM d JOIN first ON d.t = first.t LEFT JOIN l ON l.doc_id = d.doc_id),
         g AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
         k AS (SELECT unnest(range(1, 6)) AS k),
         orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM k a, k b, k c, k d, k e
                    WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
         steps AS (SELECT o, step, o[step] AS own, o[1:step - 1] AS earlier FROM orders, (SELECT k AS step FROM k)),
         x AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS hit,
                      len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
                      len(list_filter(fails, lambda b: b)) AS failed
               FROM g, steps),
         y AS (SELECT part, o, step, own, sum(n) FILTER (NOT gone AND NOT hit) AS kept,
                      sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
                      sum(n) FILTER (hit AND failed = 1) AS unique_fails,
                      sum(good) FILTER (hit AND NOT gone) AS good_lost,
                      sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
               FROM x GROUP BY ALL)
    SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', CAST(i AS INT), 1)), '') AS filter_order,
           CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
           CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
           CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
           CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM y"""

# Equal texts share a SHA-256, so the check groups by the text itself and computes the digest beside it.
ORACLE = {
    "op5_threshold_rules": _OP5_SQL,
    "op6_count_vector_join": _OP6_SQL,
    "op7_chunked_warc": _OP7_SQL,
    "op9_patricia_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op13_survival_words": _OP13_SQL,
}
