"""The registered queries: each operator over its whole table, reduced to the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation, decontaminate, fill_middle, html_main, langid, neighbours, ngram_join, repetition, secrets, token_records, toxicity, warc
from .shared import prepare, shared_dir, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return token_records.read(token_records.write(docs, shared_dir(spark, "token-records"), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repetition.measure(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    live = F.size(F.filter("spans", lambda x: x["live"]))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(listed, F.lit("")).alias("spans"), F.when(F.col("spans").isNull(), 0).otherwise(live).cast("long").alias("n_live"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_main.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~langid.held_out())
    scored = toxicity.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", langid.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, usable=~langid.held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return conversation.repaired(conversation.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_records": op2_token_records,
    "op3_repetition": op3_repetition,
    "op4_ngram_join": op4_ngram_join,
    "op5_secrets": op5_secrets,
    "op6_html": op6_html,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_neighbours": op11_neighbours,
    "op12_fill_middle": op12_fill_middle,
    "op13_conversations": op13_conversations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CRC = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"


def _edit(best: str, cost: str, letter: str, line: str = "''") -> str:
    """SQL: best (k: six digits of cost, then the audit; o: the lines so far), after one more edit."""
    return f"CASE WHEN {best} IS NOT NULL THEN {{'k': lpad(CAST(CAST(left({best}.k, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr({best}.k, 7) || '{letter}', 'o': {best}.o || {line}}} END"


def _inserted(s: str) -> str:
    """SQL: the best of each state with turns inserted behind it, u0 to u3, from columns named s0 to s3."""
    user, reply = "'user:' || chr(10)", "'assistant:' || chr(10)"
    two = f"least({s}2, {', '.join(_edit(f'{s}{i}', '3', 'I', user) for i in (0, 1, 3))})"
    return f"SELECT *, u2, least({s}3, {_edit('u2', '3', 'I', reply)}) AS u3 FROM (SELECT *, {s}0 AS u0, {s}1 AS u1, {two} AS u2"


def _kept(before: str, initial: str) -> str:
    return f"CASE WHEN f NOT IN (1, 2) AND i = '{initial}' THEN {_edit(before, 'extra', 'K', 'line')} END"


def _other(before: str, role: str) -> str:
    return f"CASE WHEN f NOT IN (1, 2) THEN {_edit(before, '3 + extra', 'R', f"'{role}:' || text || chr(10)")} END"


_GONE = [_edit(f"u{i}", "4", "D") for i in range(4)]

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH item_words AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS k FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS grams FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS (SELECT r, i, p.k, item FROM (SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS grams FROM places) p JOIN windows USING (k, grams)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r),
owned AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN owned USING (r)""",
    "op4_ngram_join": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op7_warc": """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)""",
    "op12_fill_middle": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, length(t) AS n, [CAST(('0x' || substr(x, i, 8)) AS BIGINT) FOR i IN [1, 9, 17, 25]] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(lo AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(hi - lo AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_conversations": rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
fated AS (SELECT *, {_CRC} % 20 AS fate FROM named),
spoilt AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS p FROM spoilt),
flagged AS (SELECT *, left(role, 1) AS i, role || ':' || text || chr(10) AS line, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS f FROM placed),
turns AS (SELECT *, CASE f WHEN 3 THEN 3 ELSE 0 END AS extra, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair FROM flagged),
best(conv_id, p, s0, s1, s2, s3) AS (
SELECT DISTINCT conv_id, 0::BIGINT, {{'k': '000000', 'o': ''}}, CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)), CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)), CAST(NULL AS STRUCT(k VARCHAR, o VARCHAR)) FROM conversations
UNION ALL SELECT conv_id, p, {_GONE[0]}, least({_GONE[1]}, {_kept("u0", "s")}), least({_GONE[2]}, {", ".join(f"{_kept(f'u{b}', 'u')}, {_other(f'u{b}', 'user')}" for b in (0, 1, 3))}), least({_GONE[3]}, {_kept("u2", "a")}, {_other("u2", "assistant")})
FROM ({_inserted("s")} FROM (SELECT b.conv_id, t.p, s0, s1, s2, s3, i, f, extra, line, text FROM best b JOIN turns t ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND t.p = b.p + 1)))),
ended AS (SELECT conv_id, least(u0, u3) AS e FROM ({_inserted("s")} FROM (SELECT conv_id, s0, s1, s2, s3 FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1)))),
found AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(e.k, 6) AS BIGINT) AS cost, substr(e.k, 7) AS audit, sha256(left(e.o, greatest(length(e.o) - 1, 0))) AS repaired_sha256
FROM ended e LEFT JOIN found f ON e.conv_id IS NOT DISTINCT FROM f.conv_id""",
}
