"""One query for each operator, on its whole table, beside its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.catalog.common import Catalog
from graphloom.llm.anchored_pii import personal_data
from graphloom.llm.arrow_sequences import token_files
from graphloom.llm.backoff_automaton import log_probabilities
from graphloom.llm.chat_prefix_tree import build_forest, read_conversations
from graphloom.llm.conversation_repair import repaired_conversations
from graphloom.llm.extendible_hashing import shard_documents
from graphloom.llm.finite_state_counts import token_counts
from graphloom.llm.merge_dropout import encode
from graphloom.llm.rule_ensemble import quality_scores
from graphloom.llm.rule_ledger import BASE, PROSE, ledger, passes
from graphloom.llm.spelling_variants import spelling_variants
from graphloom.llm.superminhash import near_duplicates
from graphloom.llm.tables import table
from graphloom.llm.template_decontamination import contaminated

CATALOG = Catalog()

#: lists of the words of each document, lower-cased in A-Z
LOWER_WORDS = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents)"""

OP10_SQL = (
    "WITH RECURSIVE"
    + LOWER_WORDS
    + """,
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a, b FROM both_ways
  UNION
  SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b),
least_id AS (SELECT a, min(b) AS b FROM reached GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id l ON l.a = d.doc_id"""
)


@CATALOG.query("op10_superminhash", OP10_SQL)
def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""WITH
words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY 1),
m AS (
  SELECT words.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id),
bits AS (
  SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (n_letters >= 40 AND 100 * n_upper > 50 * n_letters)::INT
    + 32 * (word_chars > 20 * n_words)::INT + 64 * (100 * n_bangs > 50 * n_words)::INT AS BIGINT) AS failed_bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM bits"""


@CATALOG.query("op4_rule_ledger", OP4_SQL)
def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.col("failed_bits")
    return ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(bits, BASE)).alias("base_failed"), passes(bits, PROSE).alias("kept"), "failed_bits",
    )


@CATALOG.query("op2_merge_dropout", None)
def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


@CATALOG.query("op3_anchored_pii", None)
def op3_anchored_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@CATALOG.query("op9_template_decontamination", None)
def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: unsigned CRC-32 of the digits of doc_id, bit by bit
CRC = """xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, 9 * len(doc_id::VARCHAR) + 1),
    lambda i: CASE WHEN i % 9 = 1 THEN -1 - ascii(substr(doc_id::VARCHAR, ((i - 1) // 9 + 1)::INT, 1)) ELSE 0 END),
    lambda c, b: CASE WHEN b < 0 THEN xor(c, -1 - b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))"""

OP5_SQL = (
    "WITH"
    + LOWER_WORDS
    + """,
split AS (SELECT doc_id, w || ['\n'] AS w, """
    + CRC
    + """ % 10 = 0 AS held_out FROM words),
tokens AS (SELECT doc_id, held_out, unnest(w) AS t, unnest(['\n\n'] || w[1:len(w) - 1]) AS before FROM split),
one AS (SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY 1),
two AS (SELECT before, t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY 1, 2),
context AS (SELECT t AS before, c AS h FROM one WHERE t <> '\n' UNION ALL SELECT '\n\n', c FROM one WHERE t = '\n'),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM one),
p AS (
  SELECT doc_id, held_out, n, coalesce(one.c, 0) AS c, (coalesce(one.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p,
    coalesce(two.c, 0) AS c2, coalesce(h, 0) AS h
  FROM tokens CROSS JOIN n LEFT JOIN one USING (t) LEFT JOIN two USING (before, t) LEFT JOIN context USING (before))
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, n AS train_tokens,
  round(fsum(log10(p)), 6) AS base_score, round(fsum(log10((c2 + 100 * p) / (h + 100))), 6) AS score
FROM p GROUP BY doc_id, held_out, n"""
)


@CATALOG.query("op5_backoff_automaton", OP5_SQL)
def op5_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = log_probabilities(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


@CATALOG.query("op6_arrow_sequences", None)
def op6_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark, table(spark, sf_dir, "documents"))


OP7_SQL = """WITH
rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, left(lpad(bin(('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT), 60, '0'), 40) AS address
  FROM documents),
prefixes AS (SELECT *, left(address, depth) AS shard FROM rows, (SELECT unnest(range(0, 41))::INT AS depth)),
sums AS (SELECT *, sum(bytes) OVER (PARTITION BY depth, shard)::BIGINT AS shard_bytes FROM prefixes)
SELECT doc_id, bytes, shard, 0::BIGINT AS page, depth, shard_bytes FROM sums
WHERE shard_bytes <= 67108864 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""


@CATALOG.query("op7_extendible_hashing", OP7_SQL)
def op7_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


#: a conversation whose texts are made of control strings
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"

OP8_SQL = """WITH
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
formatted AS (
  SELECT *, 24 + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n'))
    + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id"""


@CATALOG.query("op8_chat_prefix_tree", OP8_SQL)
def op8_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return read_conversations(*build_forest(given.union(extra)))


@CATALOG.query("op1_rule_ensemble", None)
def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: CRC-32 of each byte, and the CRC-32 of the text ``key``
CRC_TABLE = """tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: 0::BIGINT),
      lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""
CRC_KEY = """xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(key) + 1),
    lambda i: ('0x' || substr(hex(encode(key)), (2 * i - 1)::INT, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""

OP11_SQL = (
    "WITH RECURSIVE "
    + CRC_TABLE
    + r""",
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
keys AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, count(*) AS k FROM runs GROUP BY 1, 2),
drawn AS (SELECT run, k, """
    + CRC_KEY
    + """ AS h FROM keys, tab),
kept AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM drawn),
words AS (SELECT word, sum(k)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
shorter AS (
  SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON w.word = s.d
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON w.word = s.d),
counts AS (SELECT a, count(*) AS n_near FROM near GROUP BY 1),
best AS (SELECT a, b, n AS form_n FROM near JOIN words ON word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
formed AS (SELECT w.word, w.n, CASE WHEN form_n >= 2 * n THEN b END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best ON best.a = w.word),
chain AS (
  SELECT word, word AS tip FROM words
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.tip WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, tip AS root, formed.n, coalesce(n_near, 0)::BIGINT AS n_near, formed.form_n
FROM formed JOIN chain ON chain.word = formed.word JOIN formed e ON e.word = tip AND e.form IS NULL LEFT JOIN counts ON counts.a = formed.word"""
)


@CATALOG.query("op11_trie_node_pairs", OP11_SQL)
def op11_trie_node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@CATALOG.query("op12_token_transducers", None)
def op12_token_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


OP13_SQL = (
    "WITH RECURSIVE "
    + CRC_TABLE
    + r""",
keys AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
drawn AS (SELECT *, """
    + CRC_KEY
    + r""" % 20 AS damage FROM keys, tab),
damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
    CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, range(2) c(copy) WHERE damage <> 0 AND (copy = 0 OR damage = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, substr(role, 1, 1) AS initial
  FROM seen),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, max(i) AS n
  FROM faults GROUP BY 1),
pairs AS (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM faults),
unlike AS (SELECT conv_id, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1),
inserts(a, b, price, letters, added) AS (
  VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 3, 'I', E'user:\n'), (1, 2, 3, 'I', E'user:\n'), (3, 2, 3, 'I', E'user:\n'), (2, 3, 3, 'I', E'assistant:\n'),
    (0, 3, 6, 'II', E'user:\nassistant:\n'), (1, 3, 6, 'II', E'user:\nassistant:\n')),
row_edits(b, c, letter, initial) AS (
  VALUES (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'R', NULL),
    (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a')),
moves AS (
  SELECT a, c, letter, initial, price + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END AS price, letters || letter AS letters, added
  FROM inserts JOIN row_edits USING (b)),
steps AS (
  SELECT f.conv_id, i, a, c, price + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END AS price, letters,
    added || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || E'\n' ELSE CASE c WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text || E'\n' END AS lines
  FROM faults f JOIN moves m ON (m.initial IS NULL OR m.initial = f.initial) AND (letter = 'D' OR fault NOT IN ('b', 'd'))),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS way FROM figures
  UNION ALL
  SELECT b.conv_id, s.i, s.c, min({'cost': b.way.cost + s.price, 'audit': b.way.audit || s.letters, 'lines': b.way.lines || s.lines})
  FROM best b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.i = b.i + 1 AND s.a = b.q GROUP BY b.conv_id, s.i, s.c),
ends AS (
  SELECT b.conv_id, min({'cost': way.cost + price, 'audit': way.audit || letters, 'lines': way.lines || added}) AS way
  FROM best b JOIN figures f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.n = b.i JOIN inserts ON inserts.a = b.q AND inserts.b IN (0, 3) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
  coalesce(way.audit, '') AS audit, sha256(coalesce(left(way.lines, greatest(length(way.lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN unlike u ON u.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""
)


@CATALOG.query("op13_hirschberg_repair", OP13_SQL)
def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))
