"""The queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontam, htmltext, langid, lexical, mixing, neardup, pii, repetition, substrings, toxicity, urlfilter, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), spans=False).select("doc_id", "held_out", "lang_pred", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without the operator's longest_repeat: its rule is in `kept`, and SQL has no suffix array to find the length itself
    return repetition.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedupe(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict:
    found = (op1_language_id, op2_pii, op3_toxicity, op4_url_filter, op5_warc_revisits, op6_main_text, op7_near_duplicates, op8_quality_rules, op9_decontamination, op10_mixing, op11_lexical_search, op12_filter_audit, op13_suffix_dedup)
    return {f.__name__: f for f in found}


#: WARC records' fields follow from the payloads alone; the archives' round trip must not change them.
_OP5 = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND d.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""


#: Exact: shingle sets, links between different sets by a join on shingles, components by reachability.
_OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
), four AS (
  SELECT doc_id, i, n, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS shingle FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM four WHERE i <= greatest(n - 3, 1)
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS digest FROM shingles GROUP BY doc_id
), classes AS (
  SELECT digest, min(doc_id) AS id, any_value(n) AS n FROM sets GROUP BY digest
), members AS (
  SELECT c.id, c.n, s.shingle FROM classes c JOIN shingles s ON s.doc_id = c.id
), links AS (
  SELECT a.id AS x, b.id AS y FROM members a JOIN members b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(id, root) AS (
  SELECT id, id FROM classes UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.id WHERE e.y > r.root
), component AS (
  SELECT c.digest, min(r.root) AS component_id FROM classes c JOIN reach r ON r.id = c.id GROUP BY c.digest
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN component c ON c.digest = s.digest
"""

#: Exact: words in repeats of at least m words are the words in windows of m words that occur twice.  The longest
#: repeat is too long if a window of that many words (and one more than a tenth of the text) occurs twice; such a
#: window starts where a window of eight words occurs twice, so only those starts are looked at.
_OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d
), windows AS (
  SELECT doc_id, i, n, word, CASE WHEN i <= n - 2 THEN concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) END AS w3,
         CASE WHEN i <= n - 7 THEN string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS w8
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, n, word, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w3) > 1 AS r3, w8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w8) > 1 AS r8 FROM windows
), inside AS (
  SELECT doc_id, i, n, word, r8, bool_or(r3) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3, bool_or(r8) OVER (o ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8
  FROM twice WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), counts AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (c3) AS n_repeat_words, count(*) FILTER (c8) AS covered_words FROM inside GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), too_long_ones AS (
  SELECT doc_id, count(*) > count(DISTINCT window_hash) AS too_long FROM (
    SELECT t.doc_id, md5(array_to_string(d.w[t.i : t.i + greatest(50, t.n // 10 + 1) - 1], ' ')) AS window_hash FROM inside t JOIN d ON d.doc_id = t.doc_id WHERE t.r8 AND t.i + greatest(50, t.n // 10 + 1) - 1 <= t.n
  ) GROUP BY doc_id
), judged AS (
  SELECT d.doc_id, coalesce(c.n_words, 0) AS n_words, coalesce(c.word_chars, 0) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(x.n_dup_lines, 0) AS n_dup_lines,
         coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(c.covered_words, 0) AS covered_words, coalesce(l.too_long, false) AS too_long
  FROM d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN too_long_ones l ON l.doc_id = d.doc_id LEFT JOIN lines x ON x.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * covered_words > 30 * n_words OR too_long) AS kept, covered_words
FROM judged
"""


#: Exact: term counts of the benchmark's terms in all documents.
_OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), lengths AS (
  SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths
), asked AS (
  SELECT item_id, term, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), found AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM lengths) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, total GROUP BY term, docs
), scored AS (
  SELECT a.item_id, f.doc_id, CAST(sum(a.q * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + (25 * f.n * total.docs) // total.words)))) AS BIGINT) AS score
  FROM asked a JOIN found f ON f.term = a.term JOIN weights w ON w.term = a.term, total GROUP BY a.item_id, f.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


#: Exact: masks counted per part, then met with the 120 orders.
_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM d LEFT JOIN marks m ON m.doc_id = d.doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1 : step - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), outcomes AS (
  SELECT c.part, s.filter_order, s.step, s.letter, c.n, c.good, c.toxic, contains(c.fails, s.letter) AS fails_it, c.fails = s.letter AS only_it,
         c.fails <> translate(c.fails, s.earlier, '') AS gone
  FROM counted c, steps s
), summed AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails_it), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_it), 0) AS removed,
         coalesce(sum(n) FILTER (gone AND fails_it), 0) AS redundant, coalesce(sum(n) FILTER (only_it), 0) AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails_it), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails_it), 0) AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM summed
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_revisits": _OP5, "op7_near_duplicates": _OP7, "op8_quality_rules": _OP8, "op11_lexical_search": _OP11, "op12_filter_audit": _OP12}
