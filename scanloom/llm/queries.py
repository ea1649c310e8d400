"""Registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, filters, jaccard, licenses, mixing, pii, quality, secrets, substrings, topk, toxicity, warc
from .words import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op1_topk(table(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2_pii(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4_secrets(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op5_bpe(table(spark, sf_dir, "documents"), bpe.public_vocabulary())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_mixing(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op7_jaccard(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op8_warc(table(spark, sf_dir, "pages"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op9_repeats(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10_licenses(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op11_conversations(table(spark, sf_dir, "conversations"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op12_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.op13_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_quality that SQL can say."""
    return op3(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4_secrets that SQL can say."""
    return op4(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def queries() -> dict:
    return {"op1_topk": op1, "op2_pii": op2, "op3_quality": op3, "op4_secrets": op4, "op5_bpe": op5, "op6_mixing": op6, "op7_jaccard": op7, "op8_warc": op8, "op9_repeats": op9, "op10_licenses": op10, "op11_conversations": op11, "op12_toxicity": op12, "op13_filters": op13, "quality_base": quality_base, "secrets_base": secrets_base}


_TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.u, p.v FROM p JOIN n a ON a.doc_id = p.u JOIN n b ON b.doc_id = p.v WHERE 100 * k >= 80 * (a.n + b.n - k)),
c AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT c.id, e.v FROM c JOIN e ON e.u = c.reach)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c.reach) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id GROUP BY d.doc_id"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
  lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> b) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


_QUALITY = r"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
u AS (SELECT r, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM w),
g AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS five FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS c FROM g WHERE five IS NOT NULL),
k AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2, 3, 4]) AS i FROM f WHERE c > 1) GROUP BY r),
b AS (SELECT w.r, doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(k.n, 0) AS n_repeat_words FROM w LEFT JOIN k USING (r))
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b"""

_SECRETS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM d"""


_CONVERSATIONS = r"""WITH RECURSIVE bits AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, xor(c >> 1, (c & 1) * 3988292384), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 20 AS f FROM k, crc),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS time FROM h WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
g AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS x, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS y FROM o),
c AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS illegal, list({role: role, text: text, x: x, fault: fault} ORDER BY n) AS turns FROM g GROUP BY conv_id),
-- a walk is its cost in 9 digits, its edits, a bar and the repaired turns: the least string is the cheapest walk with the least edits; states are the last role that stays
w AS (SELECT conv_id, 0 AS i, turns, ['000000000|', '~', '~', '~'] AS s FROM c UNION ALL
  SELECT conv_id, i + 1, turns, list_transform([0, 1, 2, 3], lambda z: list_min(list_transform(moves, lambda m: CASE WHEN m.z <> z OR s[m.p + 1] = '~' THEN '~' ELSE
    lpad(CAST(CAST(left(s[m.p + 1], 9) AS BIGINT) + m.cost AS VARCHAR), 9, '0') || substr(s[m.p + 1], 10, instr(s[m.p + 1], '|') - 10) || m.edits || substr(s[m.p + 1], instr(s[m.p + 1], '|')) || m.said END)))
  FROM (SELECT *, list_concat(list_transform([0, 1, 2, 3], lambda z: {p: z, z: z, cost: 4, edits: 'D', said: ''}), CASE WHEN r.fault IN ('b', 'd') THEN [] ELSE list_filter(list_concat(
      list_transform([0, 1, 3], lambda p: {p: p, z: 2, cost: q + CASE WHEN r.x = 'u' THEN 0 ELSE 3 END, edits: CASE WHEN r.x = 'u' THEN 'K' ELSE 'R' END, said: chr(10) || CASE WHEN r.x = 'u' THEN r.role ELSE 'user' END || ':' || r.text}),
      [{p: 2, z: 2, cost: q + CASE WHEN r.x = 'u' THEN 3 ELSE 6 END, edits: CASE WHEN r.x = 'u' THEN 'IK' ELSE 'IR' END, said: chr(10) || 'assistant:' || chr(10) || CASE WHEN r.x = 'u' THEN r.role ELSE 'user' END || ':' || r.text}],
      list_transform([0, 1, 3], lambda p: {p: p, z: 3, cost: q + CASE WHEN r.x = 'a' THEN 3 ELSE 6 END, edits: CASE WHEN r.x = 'a' THEN 'IK' ELSE 'IR' END, said: chr(10) || 'user:' || chr(10) || CASE WHEN r.x = 'a' THEN r.role ELSE 'assistant' END || ':' || r.text}),
      [{p: 2, z: 3, cost: q + CASE WHEN r.x = 'a' THEN 0 ELSE 3 END, edits: CASE WHEN r.x = 'a' THEN 'K' ELSE 'R' END, said: chr(10) || CASE WHEN r.x = 'a' THEN r.role ELSE 'assistant' END || ':' || r.text},
       {p: 0, z: 1, cost: q, edits: CASE WHEN r.x = 's' THEN 'K' ELSE '' END, said: chr(10) || r.role || ':' || r.text}]), lambda m: m.edits <> '') END) AS moves FROM (SELECT *, turns[i + 1] AS r, CASE WHEN turns[i + 1].fault = 't' THEN 3 ELSE 0 END AS q FROM w WHERE i < len(turns)))),
f AS (SELECT conv_id, list_min([s[1], CASE WHEN s[2] = '~' THEN '~' ELSE lpad(CAST(CAST(left(s[2], 9) AS BIGINT) + 6 AS VARCHAR), 9, '0') || substr(s[2], 10, instr(s[2], '|') - 10) || 'II' || substr(s[2], instr(s[2], '|')) || chr(10) || 'user:' || chr(10) || 'assistant:' END,
  CASE WHEN s[3] = '~' THEN '~' ELSE lpad(CAST(CAST(left(s[3], 9) AS BIGINT) + 3 AS VARCHAR), 9, '0') || substr(s[3], 10, instr(s[3], '|') - 10) || 'I' || substr(s[3], instr(s[3], '|')) || chr(10) || 'assistant:' END, s[4]]) AS best FROM w WHERE i = len(turns))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(best, 10, instr(best, '|') - 10), '') AS audit, sha256(coalesce(substr(best, instr(best, '|') + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id"""

_FILTERS = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(w) < 50 WHEN 'B' THEN 100 * len(list_distinct(w)) < 65 * len(w)
    WHEN 'C' THEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(w.doc_id > least, false) END) AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS this, left(filter_order, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT *, list_contains(fails, this) AS hit, len(list_filter(fails, lambda y: contains(before, y))) > 0 AS gone FROM g, s),
k AS (SELECT part, filter_order, step, this, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = [this] THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, this) AS BIGINT) AS shapley FROM k"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force, a library or a round trip."""
    return {"op1_topk": _TOPK, "op7_jaccard": _JACCARD, "op8_warc": _WARC, "op11_conversations": _CONVERSATIONS, "op13_filters": _FILTERS, "quality_base": _QUALITY, "secrets_base": _SECRETS}
