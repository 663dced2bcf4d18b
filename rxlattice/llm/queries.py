"""Registered queries over the text operators: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, chunk_store, decontaminate, fertility, fim, language_model, line_dedup, near_dedup, packing, quality_model, repair, secrets, toxicity
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op2_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.read_documents(spark, chunk_store.write_store(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "spans")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language_model.held_out()
    scored = language_model.score(docs, language_model.train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), *(c for c in scored.columns if c != "doc_id"))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.apply_rules(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.repair(repair.damage(table(spark, sf_dir, "conversations"))))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(chat_format.format_chats(chat_format.with_example(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_quality, op2_chunk_store, op3_toxicity, op4_secrets, op5_near_dedup, op6_decontaminate, op7_line_dedup, op8_language_model, op9_fertility, op10_packing, op11_repair, op12_fill_in_middle, op13_chat_format,
        pipeline,
    )
    return {f.__name__: f for f in named}


_SHINGLES = r"""
{name}_words AS (
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}
), {name}_sets AS (
  SELECT DISTINCT {key}, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT {key}, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 WHEN len(w) < 5 THEN 2 ELSE len(w) - 3 END)) AS i FROM {name}_words)
), {name}_sizes AS (SELECT {key}, count(*) AS n FROM {name}_sets GROUP BY {key})"""

_NEAR = (
    "WITH RECURSIVE " + _SHINGLES.format(name="d", key="doc_id", table="documents") + r""",
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM d_sets a JOIN d_sets b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN d_sizes x ON x.doc_id = a.doc_id JOIN d_sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
contents AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS content FROM d_sets GROUP BY doc_id),
classes AS (SELECT content, min(doc_id) AS class_id, count(*) AS class_size FROM contents GROUP BY content)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept,
       coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(class_size, 1) AS BIGINT) AS class_size
FROM documents d JOIN groups g ON g.doc_id = d.doc_id LEFT JOIN d_sizes s ON s.doc_id = d.doc_id
LEFT JOIN contents c ON c.doc_id = d.doc_id LEFT JOIN classes k ON k.content = c.content"""
)

_CONTAINED = (
    "WITH " + _SHINGLES.format(name="d", key="doc_id", table="documents") + "," + _SHINGLES.format(name="b", key="item_id", table="benchmark") + r""",
short AS (SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS s FROM b_words WHERE len(w) BETWEEN 1 AND 4),
runs AS (SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d_words, (SELECT DISTINCT n FROM short)))
SELECT d.doc_id, b.item_id, z.n AS n_item_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / z.n AS containment
FROM b_sets b JOIN d_sets d ON d.s = b.s JOIN b_sizes z ON z.item_id = b.item_id WHERE b.item_id NOT IN (SELECT item_id FROM short)
GROUP BY d.doc_id, b.item_id, z.n HAVING 100 * count(*) >= 80 * z.n
UNION ALL SELECT doc_id, item_id, 1, 1, 1.0::DOUBLE FROM runs JOIN short USING (n, s)"""
)

_LINES = r"""
WITH raw AS (
  SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), lines AS (
  SELECT doc_id, line_no, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raw
), full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos FROM lines WHERE t <> ''
), windows AS (
  SELECT doc_id, pos, t AS t0, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY t0, t1, t2 ORDER BY doc_id, pos) AS n FROM windows WHERE t2 IS NOT NULL) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS v(k)),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text
  FROM lines l LEFT JOIN full_lines f ON f.doc_id = l.doc_id AND f.line_no = l.line_no LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos
  WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       (SELECT count(*) FROM full_lines f WHERE f.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""



def _least(*candidates: str) -> str:
    return f"list_sort(list_filter([{', '.join(candidates)}], lambda x: x IS NOT NULL))[1]"


def _then(letter: str, cost: str, state: str, said: str = "''") -> str:
    """The costs, letters and turns from a state on, after one edit."""
    return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 't': {said} || {state}.t}}"


def _if(condition: str, then: str) -> str:
    return f"CASE WHEN {condition} THEN {then} END"


def _bare(state: str, to: str, new_role: str, kept: dict[str, str]) -> str:
    keeps = [_if(f"NOT e.must AND left(e.role, 1) = '{k}'", _then("K", "e.more", t, "chr(10) || e.role || ':' || e.text")) for k, t in kept.items()]
    return _least(_then("D", "4", state), _if("NOT e.must", _then("R", "3 + e.more", to, f"chr(10) || '{new_role}:' || e.text")), *keeps)


def _inserted(new_role: str, state: str) -> str:
    return _then("I", "3", state, f"chr(10) || '{new_role}:'")


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"

_REPAIR = rf"""
WITH RECURSIVE chances AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(key="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM chances WHERE k <> 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faults AS (
  SELECT *, CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS step
  FROM numbered
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n,
         list({{'role': role, 'text': text, 'must': fault IN ('blank', 'duplicate'), 'more': CASE fault WHEN 'truncated' THEN 3 ELSE 0 END}} ORDER BY i) AS turns
  FROM faults GROUP BY conv_id
), best AS (
  SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': ''}} AS w0, {{'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS ws, {{'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}} AS wu, {{'c': 0, 'a': '', 't': ''}} AS wa FROM counts
  UNION ALL
  SELECT conv_id, i, {_least("b0", _inserted("user", "u"))}, {_least("bs", _inserted("user", "u"))}, u, a FROM (
    SELECT conv_id, i, b0, bs, {_least("bu", _inserted("assistant", "ba"))} AS u, {_least("ba", _inserted("user", "bu"))} AS a FROM (
      SELECT conv_id, i, {_bare("w0", "wu", "user", {"s": "ws", "u": "wu"})} AS b0, {_bare("ws", "wu", "user", {"u": "wu"})} AS bs, {_bare("wu", "wa", "assistant", {"a": "wa"})} AS bu, {_bare("wa", "wu", "user", {"u": "wu"})} AS ba
      FROM (SELECT b.conv_id, b.i - 1 AS i, w0, ws, wu, wa, c.turns[b.i] AS e FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i > 0)
    )
  )
), repaired AS (SELECT conv_id, w0 FROM best WHERE i = 0)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(w0.c, 0) AS BIGINT) AS cost, coalesce(w0.a, '') AS audit, sha256(coalesce(substr(w0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id"""

_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS w, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), hashed AS (
  SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS p1, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS p2, ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM units
), parts AS (
  SELECT *, array_to_string(w[1 : least(p1, p2)], '') AS p, array_to_string(w[least(p1, p2) + 1 : greatest(p1, p2)], '') AS m, array_to_string(w[greatest(p1, p2) + 1 : n], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 100 THEN 'plain' WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), steps AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before, regexp_replace(text, '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[SAYS\]|\[/ROLE\])', '\\\1', 'g') AS escaped
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, NOT CASE coalesce(before, '<none>') WHEN '<none>' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS fault,
         CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 23 + length(regexp_replace(role, '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[SAYS\]|\[/ROLE\])', '\\\1', 'g')) END AS marks
  FROM steps
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + marks) AS BIGINT) AS formatted_chars, count(*) FILTER (fault) AS n_faults, min(i) FILTER (fault) AS first_fault,
       arg_max(role, i) = 'assistant' AS ends_well
FROM judged GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": _NEAR, "op6_decontaminate": _CONTAINED, "op7_line_dedup": _LINES, "op11_repair": _REPAIR, "op12_fill_in_middle": _MIDDLE, "op13_chat_format": _CHAT}
