"""SQL for DuckDB of those queries that SQL can express over whole tables, written apart from the operators."""

from __future__ import annotations

LOWER = "translate(replace(lower({0}), 'ß', 'ss'), 'ſς', 'sσ')"
# Fixed values of the task: tokens of a canonical text.
TOKEN = r"\p{Nd}+(?:\.\p{Nd}+)*|[\p{L}\p{M}]+|[\p{Nl}\p{No}]+|[-+*/=<>^%]"


def canonical(x: str) -> str:
    return rf"array_to_string(regexp_extract_all(regexp_replace({LOWER.format(x)}, '\p{{Cf}}+', '', 'g'), '{TOKEN}'), ' ')"


FIELDS = " || chr(31) || ".join(f"coalesce({canonical(f"json_extract_string(payload, '$.{f}')")}, '')" for f in ("prompt", "answer", "dataset", "level", "steps"))
COPIES = rf"""c AS (SELECT 'raw_rows' AS table_name, raw_row_index AS k, {canonical('prompt')} AS canon FROM raw_rows WHERE regexp_replace(prompt, '[\s\p{{Z}}\p{{Cf}}\p{{Cc}}]+', '', 'g') <> ''
  UNION ALL SELECT 'raw_records', record_id, {FIELDS} FROM (SELECT * FROM raw_records WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT'),
g AS (SELECT *, min(k) OVER (PARTITION BY table_name, canon) AS kept_key FROM c)"""


def latest(table: str, columns: str) -> str:
    return f"(SELECT id, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS nth FROM {table}) WHERE nth = 1)"


USER = "list_filter(prompt, lambda m: lower(trim(m.role)) = 'user')[1].content"
SPLIT = "CASE WHEN lower(trim(split)) LIKE 'tr%' THEN 0 ELSE 1 END"
ROWS = f"""t AS (SELECT 'sft' AS tab, side, id, split, dataset, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {latest('sft_rows', f"{USER} AS text, {SPLIT} AS side, 'validation' AS split, metadata.source_dataset AS dataset")}
  UNION ALL SELECT 'evaluation', 1, id, split, dataset, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') FROM {latest('evaluation_rows', "problem AS text, 'evaluation' AS split, metadata.source_dataset AS dataset")}),
s AS (SELECT *, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS runs FROM t WHERE len(w) > 2),
e AS (SELECT tab, side, id, len(runs) AS n, unnest(runs) AS run FROM s)"""


def linked(where: str, also: str = "") -> str:
    return f"SELECT a.id AS ia, b.id AS ib, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.run = b.run AND {where} GROUP BY a.id, b.id HAVING 5 * count(*) >= 3 * (any_value(a.n) + any_value(b.n) - count(*)){also}"


SHORT = "SELECT a.id AS ia, b.id AS ib, 0 AS shared, 0 AS na, 0 AS nb FROM t a JOIN t b ON a.tab = b.tab AND a.w = b.w AND a.id <> b.id WHERE len(a.w) BETWEEN 1 AND 2"
NEAR = f"""WITH RECURSIVE {ROWS}, l AS ({linked('a.tab = b.tab AND a.id <> b.id')} UNION ALL {SHORT}), r AS (SELECT ia AS x, ib AS y FROM l UNION SELECT r.x, l.ib FROM r JOIN l ON l.ia = r.y)"""
ACROSS = f"""WITH {ROWS}, p AS ({linked('a.side = 0 AND b.side = 1')})"""
CONTAINED = f"""WITH {ROWS}, p AS ({linked('a.side = 0 AND b.side = 1', ' OR 5 * count(*) >= 4 * any_value(b.n)')})"""
PLAIN = r"nullif(regexp_replace(regexp_replace(lower({0}), '[\s\p{{Z}}\p{{Cf}}]+', '', 'g'), '^.*:', ''), '')"
RELATED = f"""WITH RECURSIVE d AS (SELECT id, split, 'h' || {PLAIN.format('source_id')} AS s, 'h' || {PLAIN.format('metadata.normalized_prompt_sha256')} AS h,
  CASE WHEN metadata.raw_row_index >= 0 THEN 'i' || metadata.raw_row_index::VARCHAR END AS i FROM {latest('dpo_rows', 'source_id, metadata, ' + "CASE WHEN lower(trim(split)) LIKE 'tr%' THEN 'train' ELSE 'validation' END AS split")}),
k AS (SELECT *, coalesce(s, h, i, 'r' || id) AS a FROM d),
o AS (SELECT DISTINCT a AS x, unnest([h, i]) AS y FROM k), u AS (SELECT x, y FROM o WHERE y IS NOT NULL AND x <> y), ways AS (SELECT x, y FROM u UNION SELECT y, x FROM u),
r AS (SELECT a AS x, a AS y FROM k UNION SELECT r.x, ways.y FROM r JOIN ways ON ways.x = r.y),
m AS (SELECT x, min(y) AS component FROM r GROUP BY x),
rows AS (SELECT k.id, k.split, k.s[2:] AS source, m.component FROM k JOIN m ON m.x = k.a),
groups AS (SELECT component, min(source) AS group_id FROM rows GROUP BY component HAVING min(split) <> max(split))"""

DOCUMENTS = "(SELECT doc_id, coalesce(text, '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY collected_at DESC NULLS LAST, text DESC NULLS LAST) AS nth FROM documents) WHERE nth = 1)"
SAID = "CASE WHEN len(list_filter({0}, lambda m: m.content IS NOT NULL)) > 0 THEN array_to_string(list_transform(list_filter({0}, lambda m: m.content IS NOT NULL), lambda m: m.content), chr(10)) END"
VALUES = f"""WITH v AS (SELECT id, unnest([{{'field_name': 'chosen', 'answer': c}}, {{'field_name': 'rejected', 'answer': r}}], recursive := true), question FROM {latest('dpo_rows', f"{USER} AS question, {SAID.format('chosen')} AS c, {SAID.format('rejected')} AS r")}
  UNION ALL SELECT id, 'completion', answer, question FROM {latest('sft_rows', f"{USER} AS question, {SAID.format('completion')} AS answer")})"""
# Answers that say there is none.
PLACEHOLDERS = (
    "null", "none", "nil", "nan", "na", "n/a", "n.a", "tbd", "todo", "undefined", "empty", "blank", "unknown", "missing", "no-answer", "noanswer", "no answer", "not available", "no response", "no output",
    "not applicable", "to be done", "answer", "final answer", "keine", "keine antwort", "sin respuesta", "ninguna", "ninguna respuesta", "pas de réponse", "aucune", "aucune réponse", "无", "没有答案", "нет", "нет ответа",
)
BARE = r"regexp_replace(lower(answer), '\\(?:boxed|fbox|text|mathrm)\b', '', 'g')"
BARE = rf"replace(regexp_replace(regexp_replace({BARE}, '[\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}\x{{ad}}]', '', 'g'), '[^\p{{L}}\p{{N}}_/.]+', ' ', 'g'), '_', ' ')"
BARE = f"regexp_replace(trim({BARE}, ' .'), '^(?:final )?answer\\s+', '')"
NOTHING = rf"(answer IS NULL OR NOT regexp_matches({BARE}, '[\p{{L}}\p{{N}}]') OR {BARE} IN ({', '.join(f"'{p}'" for p in PLACEHOLDERS)}))"
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
TRIPLES = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]))"

SQL = {
    "p1_found": f"{NEAR} SELECT DISTINCT x AS id_a, y AS id_b FROM r WHERE x < y",
    "p1_groups": f"""{NEAR}, g AS (SELECT x, min(y) AS least_id, count(DISTINCT y) AS n FROM r GROUP BY x)
      SELECT CASE tab WHEN 'sft' THEN 'sft_rows' ELSE 'evaluation_rows' END AS table_name, id, coalesce(least_id, id) AS group_id, coalesce(n, 1) AS group_rows FROM t LEFT JOIN g ON g.x = t.id WHERE len(w) > 0""",
    "p2_found": f"WITH {COPIES} SELECT table_name, kept_key, k AS copy_key FROM g WHERE k <> kept_key",
    "p2_collapsed": f"WITH {COPIES} SELECT table_name, kept_key, count(*) AS copies FROM g GROUP BY ALL",
    "p2_batch_report": f"""WITH {COPIES}, f AS (SELECT batch_id, count(*) AS raw_rows, count(*) FILTER (WHERE k <> kept_key) AS found_copies FROM raw_rows LEFT JOIN g ON table_name = 'raw_rows' AND k = raw_row_index GROUP BY batch_id),
      p AS (SELECT batch_id, arg_max(filter_counts_by_reason, created_at).dedupe.duplicate_prompt_rows AS reported_duplicates FROM prep_metadata GROUP BY batch_id)
      SELECT f.batch_id, raw_rows, found_copies, reported_duplicates, found_copies - reported_duplicates AS missed_copies FROM f LEFT JOIN p ON p.batch_id = f.batch_id""",
    "p3_found": f"{RELATED} SELECT id, group_id FROM rows JOIN groups ON groups.component = rows.component",
    "p3_invariants": f"{RELATED} SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(DISTINCT g) AS groups, 0::BIGINT AS torn_groups, true AS in_proportion FROM (SELECT id, min(source) OVER (PARTITION BY component) AS g FROM rows)",
    "p4_empty": f"{VALUES} SELECT id, field_name FROM v WHERE {NOTHING}",
    "p4_copies": f"""{VALUES}, w AS (SELECT id, field_name, {WORDS.format('question')} AS q, {WORDS.format('answer')} AS a FROM v WHERE NOT {NOTHING} AND question <> ''),
      n AS (SELECT *, {TRIPLES.format('q')} AS gq, {TRIPLES.format('a')} AS ga FROM w),
      k AS (SELECT *, len(list_intersect(gq, ga)) AS together, len(list_filter(a, lambda x: NOT list_contains(q, x))) AS fresh FROM n)
      SELECT id, field_name FROM k WHERE CASE WHEN len(q) < 4 OR len(a) < 4 THEN len(q) > 0 AND q = a
      ELSE together >= 0.5 * len(gq) AND (together >= 0.85 * len(ga) OR (together >= 0.6 * len(ga) AND fresh <= greatest(6, 0.1 * len(a)))) END""",
    "p6_totals": f"SELECT count(*) AS documents, count(*) FILTER (WHERE text = '') AS without_ids, count(*) AS restored FROM {DOCUMENTS}",
    "p7_totals": f"SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS torn FROM {DOCUMENTS}",
    "p5_found": f"{ACROSS} SELECT least(ia, ib) AS id_a, greatest(ia, ib) AS id_b FROM p",
    "p5_containment": f"{CONTAINED} SELECT ia AS train_id, ib AS held_id, split AS held_split, dataset AS held_dataset, shared / (na + nb - shared) AS similarity, shared / nb AS containment FROM p JOIN t ON t.id = p.ib",
    "p5_report": f"{ACROSS} SELECT split AS held_split, dataset AS held_dataset, count(*) AS pairs, count(DISTINCT ib) AS held_rows, count(DISTINCT ia) AS train_rows FROM p JOIN t ON t.id = p.ib GROUP BY split, dataset",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
