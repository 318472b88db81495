"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import byte_bpe, decontam, host_rules, html_main, license_scan, lm_score, ngram_join, pii, shard_ring, token_count, toxicity, turn_repair, whitening
from palimpsest.session import table

UNIGRAM_PIECES = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_tokens() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer(UNIGRAM_PIECES))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)
    return found.select("doc_id", "item_id", "n_item", "n_shared")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main(table(spark, sf_dir, "pages"))


def op4_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_ring.shard_ring(table(spark, sf_dir, "documents"), shards=16)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), tokenizer(BYTE_RANKS), pre_tokens(), spaced=True)


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = host_rules.host_rules(table(spark, sf_dir, "documents"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score_corpus(docs, table(spark, sf_dir, "labels").filter("quality = 1"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted", "n_passages")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "scores")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.plan_repairs(turn_repair.damage(table(spark, sf_dir, "conversations")), present="present")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_token_counts,
    op2_decontamination,
    op3_main_text,
    op4_shard_ring,
    op5_byte_bpe,
    op6_host_rules,
    op7_lm_score,
    op8_toxicity,
    op9_pii,
    op10_ngram_join,
    op11_turn_repair,
    op12_whitening,
    op13_license_scan,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

_OP6 = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rid,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS n_kinds
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
windows AS (
  SELECT rid, i, words[i:i+4] AS words
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split WHERE len(words) >= 5)),
repeated AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, words) AS n FROM windows) WHERE n >= 2),
covered AS (
  SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS w FROM repeated) GROUP BY rid),
counted AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_lines - n_kinds, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
marked AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
         OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS failed
  FROM counted),
hosts AS (SELECT source AS host, count(*) AS n, sum(CAST(failed AS INT)) AS bad FROM marked GROUP BY source),
fitted AS (
  SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS m,
         sum(CAST(bad AS DOUBLE) * bad / n) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)) AS spread,
         count(*) / sum(n) AS per FROM hosts),
prior AS (
  SELECT m, greatest(m * (1 - m) / greatest(spread - m * (1 - m) * per, m * (1 - m) * 1e-4) - 1, 1) AS strength FROM fitted),
rated AS (SELECT host, (bad + m * strength) / (n + strength) AS rate, n + strength AS weight FROM hosts, prior),
verdicts AS (
  SELECT host, CASE WHEN rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) >= 0.5 THEN 'rejected'
                    WHEN rate < 0.02 THEN 'trusted' ELSE 'watched' END AS verdict FROM rated)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND verdict <> 'rejected' AND NOT (verdict = 'watched' AND failed) AS kept
FROM marked JOIN verdicts ON source IS NOT DISTINCT FROM host
"""

_OP10 = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+2], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM cut WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)
"""

_OP2 = r"""
WITH texts AS (
  SELECT doc_id AS id, TRUE AS is_doc, text FROM documents UNION ALL SELECT item_id, FALSE, text FROM benchmark),
cut AS (
  SELECT id, is_doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-@\[-`{-\x7f]+') AS words
  FROM texts),
shingles AS (
  SELECT DISTINCT id, is_doc, array_to_string(words[i:i+4], ' ') AS s
  FROM (SELECT id, is_doc, words, unnest(range(1, len(words) - 3)) AS i FROM cut)),
sizes AS (SELECT id AS item_id, count(*) AS n_item FROM shingles WHERE NOT is_doc GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles b ON d.s = b.s AND d.is_doc AND NOT b.is_doc GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared FROM shared JOIN sizes USING (item_id) WHERE 10 * n_shared >= 8 * n_item
"""

_OP11 = r"""
WITH RECURSIVE steps(i, n, c) AS (
  SELECT i, 0, i FROM range(256) AS r(i)
  UNION ALL SELECT i, n + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE n < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
coded AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
                         lambda c, b: xor(t[1 + xor(c % 256, b)], c // 256)), 4294967295) % 20 AS code
  FROM keyed, crcs),
damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
convs AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (
  SELECT conv, turn, role, text, left(role, 1) AS initial, row_number() OVER w AS j, lag(left(role, 1)) OVER w AS before,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending
  FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id
  WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text)),
lines AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY j) > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
  FROM numbered),
counted AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM lines GROUP BY conv),
moves(last, q, inserts) AS (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'a', ''), ('u', 'u', 'a'), ('a', 'u', ''), ('a', 'a', 'u')),
edits(edit) AS (VALUES ('D'), ('K'), ('R')),
walk(conv, j, last, cost, audit, body) AS (
  SELECT conv, 0, '', 0, '', '' FROM convs
  UNION ALL
  SELECT conv, j, q, cost, audit, body FROM (
    SELECT w.conv, w.j + 1 AS j, coalesce(m.q, w.last) AS q,
           w.cost + CASE edit WHEN 'D' THEN 3 ELSE 2 * length(inserts) + (CASE edit WHEN 'R' THEN 2 ELSE 0 END) + (CASE fault WHEN 'truncated' THEN 1 ELSE 0 END) END AS cost,
           w.audit || repeat('I', CASE edit WHEN 'D' THEN 0 ELSE length(inserts) END) || edit AS audit,
           w.body || CASE edit WHEN 'D' THEN '' ELSE
             CASE inserts WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END
             || chr(10) || CASE WHEN edit = 'K' THEN role WHEN m.q = 'u' THEN 'user' ELSE 'assistant' END || ':' || text END AS body
    FROM walk w JOIN lines l ON l.conv = w.conv AND l.j = w.j + 1 CROSS JOIN edits
    LEFT JOIN moves m ON edit <> 'D' AND m.last = w.last
    WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND CASE edit WHEN 'K' THEN m.q = initial ELSE m.q IN ('u', 'a') AND m.q <> initial END))
  QUALIFY row_number() OVER (PARTITION BY conv, j, q ORDER BY cost, audit) = 1),
finished AS (
  SELECT conv, cost + 2 * length(ending) AS cost, audit || repeat('I', length(ending)) AS audit,
         body || CASE ending WHEN 'ua' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END AS body
  FROM walk JOIN (VALUES ('', ''), ('s', 'ua'), ('u', 'a'), ('a', '')) AS ends(last, ending) USING (last) LEFT JOIN counted USING (conv)
  WHERE j = coalesce(n, 0)
  QUALIFY row_number() OVER (PARTITION BY conv ORDER BY walk.cost + 2 * length(ending), walk.audit || repeat('I', length(ending))) = 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(substr(body, 2)) AS repaired_sha256
FROM convs JOIN finished USING (conv) LEFT JOIN counted USING (conv)
"""


def _op13() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(x.label)}, {x.is_name}, {quoted(x.text)})" for i, x in enumerate(license_scan.NAMES + license_scan.NOTICES))
    return _OP13.replace("TEMPLATES", values)


_OP13 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, NULL AS template, NULL AS label, NULL AS is_name, text FROM documents
  UNION ALL SELECT NULL, NULL, template, label, is_name, text FROM (VALUES TEMPLATES) AS t(template, label, is_name, text)),
cut AS (
  SELECT * EXCLUDE (text), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-@\[-`{-\x7f]+') AS words
  FROM texts),
listed AS (SELECT rid, template, label, is_name, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM cut),
grams AS (
  SELECT rid, template, label, is_name, size, i, word || ' ' || lead(word) OVER w AS two, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w AS three
  FROM listed WINDOW w AS (PARTITION BY rid, template ORDER BY i)),
windows AS (
  SELECT rid, template, label, is_name, size, 2 AS k, i, two AS gram FROM grams WHERE two IS NOT NULL
  UNION ALL SELECT rid, template, label, is_name, size, 3, i, three FROM grams WHERE three IS NOT NULL),
places AS (SELECT template, label, is_name, size, k, i AS j, gram FROM windows WHERE template IS NOT NULL AND k = CASE WHEN is_name THEN 2 ELSE 3 END),
votes AS (
  SELECT g.rid, p.template, p.label, p.is_name, p.size, p.k, g.i - p.j AS diagonal, list(DISTINCT p.j) AS places
  FROM windows g JOIN places p ON g.k = p.k AND g.gram = p.gram WHERE g.rid IS NOT NULL GROUP BY ALL),
names AS (SELECT rid, label, diagonal AS first FROM votes WHERE is_name AND len(places) = size - k + 1),
along AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > least(4, size // 16) THEN 1 ELSE 0 END AS apart
  FROM votes WHERE NOT is_name),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM along),
covering AS (SELECT rid, template, label, size, run, unnest(places) + x AS place FROM grouped, range(3) AS r(x)),
notices AS (
  SELECT rid, label, covered FROM (
    SELECT rid, label, size, count(DISTINCT place) / size AS covered FROM covering GROUP BY rid, template, label, size, run)
  WHERE covered >= CASE WHEN size < 16 THEN 1.0 ELSE 0.8 END),
named AS (
  SELECT rid, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM names GROUP BY rid),
noticed AS (SELECT rid, count(*) AS n_notices, max(covered) AS covered FROM notices GROUP BY rid),
labelled AS (
  SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM (SELECT rid, label FROM names UNION ALL SELECT rid, label FROM notices) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(n_notices, 0) AS n_notices, CAST(greatest(coalesce(covered, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM cut LEFT JOIN named USING (rid) LEFT JOIN noticed USING (rid) LEFT JOIN labelled USING (rid) WHERE rid IS NOT NULL
"""

ORACLES = {"op2_decontamination": _OP2, "op6_host_rules": _OP6, "op10_ngram_join": _OP10, "op11_turn_repair": _OP11, "op13_license_scan": _op13()}
