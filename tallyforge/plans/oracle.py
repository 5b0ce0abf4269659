"""The same queries as SQL for DuckDB, written apart from the Spark code."""

from __future__ import annotations

from .catalog import PAIRS, PER_ROWS, SETTINGS

# What the way an answer was found is worth; forms of white space, tokens, line ends and answers.
METHOD_BONUS = {"boxed": 0.03, "labeled_answer": 0.02, "hash_answer": 0.02, "final_line_choice": 0.01, "final_line_numeric": 0.005}
WS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}]"
LINE_END = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
FIELDS = ("prompt", "initial_reason_steps", "full_chosen", "full_rejected", "answer")
SYSTEM, SUFFIX = SETTINGS.system_prompt, "Let''s think step by step."
INT = r"[-+]?\d+"
FRAC = rf"\\d?frac\{{{INT}\}}\{{{INT}\}}"
SLASH = rf"{INT}\s*/\s*{INT}"
REAL = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
SIMPLE = r"[-+]?\d+(?:\.\d+)?"


def target(n: int) -> str:
    return f"({n} * (SELECT count(*) FROM raw_rows) // {PER_ROWS})" if PER_ROWS else str(n)


def let(x: str, v: str, body: str) -> str:
    return f"list_transform([{x}], lambda {v}: {body})[1]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"


def key(x: str) -> str:
    return f"lower({collapse(x)})"


def normal(x: str, blank: int = 2) -> str:
    lf = "chr(10)"
    return rf"regexp_replace({strip(rf"regexp_replace({x}, '\r\n?', {lf}, 'g')")}, '\n{{{blank + 2},}}', {'||'.join([lf] * (blank + 1))}, 'g')"


def n_tokens(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), '{TOKEN}'))"


def bare(x: str) -> str:
    return rf"regexp_replace({strip(x)}, '[.。,:;]+\z', '')"


def strip_answer(x: str) -> str:
    return let(bare(x), "sa", r"CASE WHEN regexp_matches(sa, '(?s)\A\(.\)\z') THEN upper(sa[2]) WHEN regexp_matches(sa, '\A\p{L}\z') THEN upper(sa) ELSE sa END")


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{LINE_END}'), lambda ln: {strip('ln')}), lambda ln: ln <> '')"


BOX = r"\\(?:boxed|fbox)\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def last(x: str, pattern: str, group: int) -> str:
    return f"nullif({strip_answer(f"list_extract(regexp_extract_all({x}, '{pattern}', {group}), -1)")}, '')"


def boxed(x: str) -> str:
    return last(x, BOX, 1)


def extracted(x: str, cut: str) -> str:
    """A struct of answer a and method m."""
    label = r"(?:final\s+answer|correct\s+answer|answer)\s*"
    line = rf"(?i){label}(?:(?:is)?\s*:|is|=)\s*(.+)\z"
    loose = rf"(?is){label}(?:(?:is)?\s*:|is|=)?\s*(?:\\boxed\{{)?\s*(\(?[A-E]\)?|{SIMPLE}(?:\\?%)?|{SLASH}|{FRAC})"
    inner = let(strip_answer(f"regexp_extract(ll, '{line}', 1)"), "la", f"nullif({strip(f'coalesce({boxed('la')}, la)')}, '')")
    labeled = f"list_filter(list_transform(list_reverse({lines(x)})[1:5], lambda ll: CASE WHEN regexp_matches(ll, '{line}') THEN {inner} END), lambda q: q IS NOT NULL)[1]"
    number = rf"\A(?:{FRAC}|{SLASH}|{SIMPLE}(?:\\?%)?)\z"
    shape = rf"CASE WHEN regexp_matches(fl, '\A\(?[A-E]\)?\z') THEN 'C' || fl WHEN regexp_matches(fl, '{number}') THEN 'N' || fl END"
    closing = f"list_filter(list_transform(list_reverse({lines(x)})[1:3], lambda l0: {let(strip_answer('l0'), 'fl', shape)}), lambda q: q IS NOT NULL)[1]"
    closing = let(closing, "c0", f"CASE WHEN NOT {cut} OR c0[1] = 'C' THEN c0 END")
    tail = last(f"right({x}, 500)", rf"\\frac\{{{INT}\}}\{{{INT}\}}|{SLASH}|{SIMPLE}", 0)
    steps = [
        (boxed(x), "boxed"),
        (last(x, r"####\s*([^\n]+)", 1), "hash_answer"),
        (labeled, "labeled_answer_line"),
        (last(x, loose, 1), "labeled_answer"),
    ]
    tagged = [let(v, "st", f"CASE WHEN st IS NOT NULL THEN {{'a': st, 'm': '{m}'}} END") for v, m in steps]
    tagged.append(let(closing, "cl", "CASE WHEN cl IS NOT NULL THEN {'a': cl[2:], 'm': CASE WHEN cl[1] = 'C' THEN 'final_line_choice' ELSE 'final_line_numeric' END} END"))
    tagged.append(f"CASE WHEN {cut} THEN {{'a': NULL::VARCHAR, 'm': 'truncated_no_final_answer'}} END")
    tagged.append(let(tail, "tn", "CASE WHEN tn IS NOT NULL THEN {'a': tn, 'm': 'tail_number'} END"))
    return f"coalesce({', '.join(tagged)}, {{'a': NULL::VARCHAR, 'm': 'not_found'}})"


def reduced(p: str, q: str) -> str:
    """'p/q' in lowest terms of two integer expressions."""
    parts = f"{{'p': sign({q}) * ({p}) // gcd({p}, {q}), 'q': abs({q}) // gcd({p}, {q})}}"
    return f"CASE WHEN ({q}) = 0 THEN NULL ELSE {let(parts, 'rd', "CASE WHEN rd.q = 1 THEN (rd.p::HUGEINT)::VARCHAR ELSE (rd.p::HUGEINT)::VARCHAR || '/' || (rd.q::HUGEINT)::VARCHAR END")} END"


def of_fraction(x: str, times: str = "1") -> str:
    f = rf"\A(?:\\d?frac\{{({INT})\}}\{{({INT})\}}|({INT})\s*/\s*({INT}))\z"
    num = f"try_cast(regexp_extract({x}, '{f}', 1) || regexp_extract({x}, '{f}', 3) AS HUGEINT)"
    den = f"try_cast(regexp_extract({x}, '{f}', 2) || regexp_extract({x}, '{f}', 4) AS HUGEINT) * {times}"
    pair = let(f"{{'n': {num}, 'd': {den}}}", "fr", reduced("fr.n", "fr.d"))
    return f"CASE WHEN regexp_matches({x}, '{f}') THEN {pair} END"


def plain_decimal(x: str) -> str:
    y = rf"regexp_replace({x}, '\A\+', '')"
    y = rf"CASE WHEN contains({x}, '.') THEN regexp_replace(regexp_replace({y}, '0+\z', ''), '\.\z', '') ELSE {y} END"
    y = rf"regexp_replace({y}, '\A(-?)0+(\d)', '\1\2')"
    return f"CASE WHEN {y} = '-0' THEN '0' ELSE {y} END"


def normal_answer(x: str) -> str:
    tight = f"regexp_replace(va, '{WS}+', '', 'g')"
    number = let("replace(va, ',', '')", "nd", rf"CASE WHEN regexp_matches(nd, '\A{SIMPLE}\z') THEN {plain_decimal('nd')} END")
    value = f"coalesce({let(tight, 'tg', of_fraction('tg'))}, {number}, replace(replace({tight}, '\\left', ''), '\\right', ''))"
    assigned = rf"CASE WHEN regexp_matches(nb, '\A[A-Za-z]\s*=\s*(.+)\z') THEN {strip(r"regexp_extract(nb, '\A[A-Za-z]\s*=\s*(.+)\z', 1)")} ELSE nb END"
    choice = r"CASE WHEN regexp_matches(nb, '\A\(?[A-Ea-e]\)?\z') THEN upper(regexp_extract(nb, '[A-Ea-e]')) END"
    first = rf"regexp_replace(replace(replace(replace({strip(x)}, '\(', ''), '\)', ''), '$', ''), '[.。,:;]+\z', '')"
    unboxed = let(first, "n0", f"coalesce({boxed('n0')}, n0)")
    return let(unboxed, "nb", f"CASE WHEN nb = '' THEN NULL ELSE coalesce({choice}, {let(assigned, 'va', value)}) END")


def cleaned(x: str) -> str:
    y = let(strip(x), "c1", f"coalesce({boxed('c1')}, c1)")
    y = rf"regexp_replace({y}, '\\text\{{[^{{}}]*\}}', '', 'g')"
    for old, new in ((r"\%", "%"), (r"\$", ""), (r"\(", ""), (r"\)", ""), ("$", ""), (r"\left", ""), (r"\right", ""), (",", "")):
        y = f"replace({y}, '{old}', '{new}')"
    return bare(y)


def unitless(x: str) -> str:
    unit = rf"\A\s*({FRAC}|{SLASH}|{REAL}\s*%?)\s*(?:[A-Za-z°²³^/\\{{}}\-\s]+)?\s*\z"
    return let(cleaned(x), "ul", rf"CASE WHEN regexp_matches(ul, '{unit}') THEN regexp_replace({strip(rf"regexp_extract(ul, '{unit}', 1)")}, '\s+%', '%') ELSE ul END")


def rational(x: str) -> str:
    times = "CASE WHEN ra.pc THEN 100 ELSE 1 END"
    digits = "try_cast(replace(ra.b, '.', '') AS HUGEINT)"
    places = r"length(regexp_extract(ra.b, '\.(\d*)\z', 1))"
    real = let(f"{{'n': {digits}, 'd': (10::HUGEINT ** {places})::HUGEINT * {times}}}", "rr", reduced("rr.n", "rr.d"))
    number = rf"coalesce({of_fraction('ra.b', times)}, CASE WHEN regexp_matches(ra.b, '\A{REAL}\z') THEN {real} END)"
    assigned = rf"CASE WHEN regexp_matches(r0, '\A[A-Za-z]\s*=\s*(.+)\z') THEN {strip(r"regexp_extract(r0, '\A[A-Za-z]\s*=\s*(.+)\z', 1)")} ELSE r0 END"
    split = let(let(unitless(x), "r0", assigned), "r1", rf"{{'pc': ends_with(r1, '%'), 'b': {strip(r"regexp_replace(r1, '%\z', '')")}}}")
    return let(split, "ra", number)


RAW = f"""
clean AS (SELECT raw_row_index, dataset, {', '.join(f'{normal(f)} AS {f}' for f in FIELDS)} FROM raw_rows),
judged AS (SELECT *, {collapse('prompt')} AS normalized_prompt, CASE
  {' '.join(f"WHEN {f} IS NULL THEN '{f}_not_string' WHEN {f} = '' THEN '{f}_empty'" for f in FIELDS)}
  {' '.join(f"WHEN starts_with({key(f)}, {key('initial_reason_steps')}) THEN '{f}_duplicated_initial_reason_steps'" for f in ('full_chosen', 'full_rejected'))}
  WHEN {key('full_chosen')} = {key('full_rejected')} THEN 'full_positive_equals_full_negative'
  WHEN {collapse('prompt')} = '' THEN 'empty_normalized_prompt' END AS reason FROM clean)"""
ROW_KEY = f"sha256(concat_ws('|', '{SETTINGS.row_tag}', '{SETTINGS.seed}', '{SETTINGS.revision}', normalized_prompt, raw_row_index::VARCHAR))"
SPLIT_KEY = f"sha256(concat_ws('|', '{SETTINGS.split_tag}', '{SETTINGS.seed}', '{SETTINGS.revision}', normalized_prompt))"


def solved(source: str) -> str:
    said = lambda f: f"{strip('initial_reason_steps')} || chr(10) || chr(10) || {strip(f)}"
    system = f"(SELECT {n_tokens(f"'{SYSTEM}'")})"
    return f"""(SELECT *, {system} + {n_tokens('model_input')} + 8 + 3 AS prompt_tokens, {system} + {n_tokens('model_input')} + {n_tokens('full_positive')} + 12 AS chosen_tokens,
  {system} + {n_tokens('model_input')} + {n_tokens('full_negative')} + 12 AS rejected_tokens
  FROM (SELECT *, prompt || chr(10) || chr(10) || '{SUFFIX}' AS model_input, {said('full_chosen')} AS full_positive, {said('full_rejected')} AS full_negative FROM {source}))"""


def pair_reason(p: str, c: str, r: str, s) -> str:
    return f"""CASE WHEN {p} > {s.max_prompt_length} THEN 'prompt_too_long' WHEN {c} > {s.max_pair_length} THEN 'chosen_too_long' WHEN {r} > {s.max_pair_length} THEN 'rejected_too_long'
  WHEN {c} - {p} <= 0 THEN 'chosen_completion_empty' WHEN {r} - {p} <= 0 THEN 'rejected_completion_empty' END"""


def long_reason(length: int, prompt: int, pair: int) -> str:
    class S:
        max_prompt_length, max_pair_length = prompt, pair

    return f"coalesce(CASE WHEN chosen_tokens > {length} THEN 'sft_too_long' END, {pair_reason('prompt_tokens', 'chosen_tokens', 'rejected_tokens', S)}, CASE WHEN prompt_tokens > {length} THEN 'evaluation_prompt_too_long' END)"


LONG = long_reason(SETTINGS.max_length, SETTINGS.max_prompt_length, SETTINGS.max_pair_length)
KEPT = f"""{RAW}, reps AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY normalized_prompt ORDER BY {ROW_KEY}) AS k FROM judged WHERE reason IS NULL) WHERE k = 1),
sized AS (SELECT * FROM {solved('reps')})"""
SPLIT = f"""{KEPT}, ranked AS (SELECT *, sha256(normalized_prompt) AS source_id, {SPLIT_KEY} AS split_key, row_number() OVER (ORDER BY {SPLIT_KEY}) - 1 AS rank, count(*) OVER () AS n FROM sized WHERE {LONG} IS NULL),
sizes AS (SELECT *, least({target(SETTINGS.evaluation)}, n) AS e, least({target(SETTINGS.validation)}, n - least({target(SETTINGS.evaluation)}, n)) AS v FROM ranked),
trains AS (SELECT *, least({target(SETTINGS.train)}, n - e - v) AS t FROM sizes),
split AS (SELECT *, CASE WHEN rank < t THEN 'train' WHEN rank < t + v THEN 'validation' WHEN rank < t + v + e THEN 'evaluation' ELSE 'reserve' END AS split,
  rank - CASE WHEN rank < t THEN 0 WHEN rank < t + v THEN t WHEN rank < t + v + e THEN t + v ELSE t + v + e END AS split_rank FROM trains)"""
MINI = "split_rank < CASE split " + " ".join(f"WHEN '{k}' THEN {target(n)}" for k, n in SETTINGS.mini.items()) + " END"
ID = f"'{SETTINGS.id_prefix}_' || split || '_' || CASE WHEN split_rank < 100000 THEN lpad(split_rank::VARCHAR, 5, '0') ELSE split_rank::VARCHAR END"
PAIRED = f"""(SELECT split, split_rank, source_id, raw_row_index, dataset, answer, {ID} AS id, model_input, full_positive, full_negative, prompt_tokens, chosen_tokens, rejected_tokens FROM split)"""
GRID = "(VALUES " + ", ".join(
    f"('{m}', '{k}', '{s}')" for m, k, s in [(m, k, s) for m in ("formal", "mini") for k in ("sft", "dpo") for s in ("train", "validation")] + [("formal", "evaluation", "evaluation"), ("mini", "evaluation", "evaluation"), ("formal", "reserve", "reserve")]
) + ") AS g(mode, kind, split)"
COUNTS = f"""{SPLIT}, counted AS (SELECT 'formal' AS mode, split, count(*) AS n FROM split GROUP BY split UNION ALL SELECT 'mini', split, count(*) FROM split WHERE {MINI} GROUP BY split),
counts AS (SELECT g.mode, g.kind, g.split, coalesce(n, 0)::BIGINT AS rows FROM {GRID} LEFT JOIN counted c ON c.mode = g.mode AND c.split = g.split)"""
TARGET = "CASE " + " ".join(
    f"WHEN mode = '{m}' AND split = '{s}' THEN {target(n)} * 2" for m, sizes in (("formal", {"train": SETTINGS.train, "validation": SETTINGS.validation, "evaluation": SETTINGS.evaluation}), ("mini", SETTINGS.mini)) for s, n in sizes.items()
) + " END"

TOKENS = f"regexp_extract_all(lower(text), '{TOKEN}')"

def abnormal(t: str) -> str:
    ls = lines(t)
    most = "list_max(list_transform(list_distinct(ax), lambda ad: len(list_filter(ax, lambda ay: ay = ad))))"
    half = let(ls, "ax", f"len(ax) >= 6 AND {most} / len(ax) >= 0.5")
    triples = "list_transform(range(1, len(aw) - 1), lambda ai: aw[ai] || chr(31) || aw[ai + 1] || chr(31) || aw[ai + 2])"
    stuck = let(f"regexp_extract_all(lower({t}), '{TOKEN}')", "aw", f"CASE WHEN len(aw) >= 60 THEN len(list_distinct({triples})) / (len(aw) - 2) < 0.35 ELSE false END")
    return f"CASE WHEN length({strip(t)}) < 5 OR contains({t}, '<|') OR contains({t}, chr(65533)) THEN true WHEN {half} THEN true ELSE {stuck} END"


METHODS = "['boxed','hash_answer','labeled_answer_line','labeled_answer','final_line_choice','final_line_numeric','tail_number','not_found']"
BONUS = "CASE extraction_method " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in METHOD_BONUS.items()) + " ELSE 0::DOUBLE END"
SCORE = f"(coalesce(average_logprob, -100::DOUBLE) + least(output_tokens, 256) / 10000::DOUBLE + {BONUS})"
def delivered(table: str) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) AS nth FROM {table}) WHERE nth = 1)"


BARE_SPLIT = "regexp_replace(lower(split), '[^a-z]', '', 'g')"
NAMED = "CASE WHEN {0} LIKE 'tr%' THEN 'train' WHEN {0} LIKE 'val%' OR {0} = 'dev' THEN 'validation' WHEN {0} LIKE 'ev%' OR {0} = 'test' THEN 'evaluation' END"
SPELLED = f"coalesce({NAMED.format(BARE_SPLIT)}, {NAMED.format("regexp_extract(lower(id), '_(train|validation|evaluation|val|eval)_', 1)")})"
CANDIDATES = f"""
said AS (SELECT source_id, split, id || '|' || k::VARCHAR AS arrival, t, coalesce(length(t), 0) AS n FROM (
  SELECT source_id, id, {SPELLED} AS split, 0 AS k, chosen[1].content AS t FROM {delivered('dpo_rows')} UNION ALL SELECT source_id, id, {SPELLED}, 1, rejected[1].content FROM {delivered('dpo_rows')}
  UNION ALL SELECT source_id, id, {SPELLED}, 2, upper(completion[1].content) FROM {delivered('sft_rows')})),
candidates AS (SELECT source_id || '_' || split || '_cand_' || CASE WHEN candidate_index < 100 THEN lpad(candidate_index::VARCHAR, 2, '0') ELSE candidate_index::VARCHAR END AS id, * FROM (
  SELECT source_id, split, arrival, row_number() OVER (PARTITION BY source_id, split ORDER BY arrival) - 1 AS candidate_index, t AS generated_text,
  CASE WHEN n % 7 = 0 THEN 'length' ELSE 'eos' END AS finish_reason, n % 9 = 4 AS hit_max_new_tokens, n % 11 <> 0 AS answer_extracted, {METHODS}[n % 8 + 1] AS extraction_method,
  n % 5 = 0 AS math_equivalent, CASE WHEN n % 13 <> 0 THEN -(n % 100) / 100::DOUBLE END AS average_logprob, n % 400 AS output_tokens FROM said)),
all_sources AS (SELECT source_id, {SPELLED} AS split, id AS sft_row_id, prompt, completion, id AS arrival FROM {delivered('sft_rows')} WHERE prompt IS NOT NULL AND completion IS NOT NULL),
sources AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, split ORDER BY arrival) AS k FROM all_sources) WHERE k = 1)"""
TOK = lambda x: f"coalesce(list_sum(list_transform({x}, lambda tm: coalesce({n_tokens('tm.content')}, 0) + 4)), 0)::BIGINT"
SAID = f"{strip('generated_text')}"
JUDGED = f"""{CANDIDATES},
seen AS (SELECT *, {strip("coalesce(generated_text, '')")} AS txt, CASE WHEN {strip("coalesce(generated_text, '')")} <> '' THEN {key('generated_text')} END AS tkey FROM candidates),
firsts AS (SELECT *, row_number() OVER (PARTITION BY source_id, split, tkey ORDER BY candidate_index) AS kth FROM seen),
counted AS (SELECT f.*, s.sft_row_id, s.prompt, s.completion, {TOK('s.prompt')} + 3 AS pt, {TOK('s.prompt')} + {TOK('s.completion')} AS ct,
  {TOK('s.prompt')} + coalesce({n_tokens("f.txt")}, 0) + 4 AS rt, {SCORE} AS score FROM firsts f JOIN sources s ON s.source_id = f.source_id AND s.split = f.split),
judged_c AS (SELECT *, coalesce(CASE WHEN txt = '' THEN 'empty_text' WHEN kth > 1 THEN 'duplicate_text' WHEN finish_reason <> 'eos' THEN 'not_eos' WHEN hit_max_new_tokens THEN 'hit_max_new_tokens'
  WHEN NOT answer_extracted THEN 'no_answer' WHEN extraction_method IN ('tail_number', 'not_found', 'truncated_no_final_answer') THEN 'no_explicit_final_answer' WHEN math_equivalent THEN 'correct_answer'
  WHEN {abnormal('txt')} THEN 'abnormal_output' END, CASE WHEN {key('completion[1].content')} = tkey THEN 'same_as_chosen' END, {pair_reason('pt', 'ct', 'rt', PAIRS)}) AS reason FROM counted),
pairs AS (SELECT source_id || '_dpo_v2' AS id, source_id, split, c.id AS candidate_id, c.sft_row_id AS original_sft_row_id, c.ct - c.pt AS chosen_completion, c.rt - c.pt AS rejected_completion FROM (
  SELECT source_id, split, arg_max({{'id': id, 'sft_row_id': sft_row_id, 'pt': pt, 'ct': ct, 'rt': rt}}, {{'s': score, 'i': -candidate_index}}) AS c FROM judged_c WHERE reason IS NULL GROUP BY source_id, split))"""
OUTCOMES = {"eos": "finish_reason = 'eos'", "length": "finish_reason <> 'eos'", "correct": "answer_extracted AND math_equivalent", "wrong": "answer_extracted AND NOT math_equivalent", "no_answer": "NOT answer_extracted"}
REPORT = f"""{JUDGED}, report AS (SELECT s.split, source_questions, unique_source_id, coalesce(candidate_count, 0) AS candidate_count, coalesce(final_preference_pairs, 0) AS final_preference_pairs,
  unique_source_id - coalesce(final_preference_pairs, 0) AS no_valid_rejected, coalesce(chosen_average_tokens, 0) AS chosen_average_tokens
  FROM (SELECT split, count(*) AS source_questions, count(DISTINCT source_id) AS unique_source_id FROM all_sources GROUP BY split) s
  LEFT JOIN (SELECT split, count(*) AS candidate_count FROM candidates GROUP BY split) c ON c.split = s.split
  LEFT JOIN (SELECT split, count(*) AS final_preference_pairs, avg(chosen_completion) AS chosen_average_tokens FROM pairs GROUP BY split) p ON p.split = s.split)"""

NUMBERS = """numbers AS (SELECT l_orderkey, l_linenumber, l_linenumber % 6 AS k, l_quantity::INT AS q FROM lineitem)"""
EXTRACTED = extracted("full_chosen", "(raw_row_index % 5 = 0)")
GOLD_X = extracted("reference_answer", "false")


def gold(answer: str) -> str:
    given = strip(answer)
    from_text = let(GOLD_X, "gx", "{'a': coalesce(gx.a, reference_answer), 's': 'reference_answer', 'm': CASE WHEN gx.a IS NULL THEN 'full_reference_fallback' ELSE gx.m END}")
    return f"CASE WHEN {given} <> '' THEN {{'a': {given}, 's': 'metadata.answer', 'm': 'metadata_answer'}} ELSE {from_text} END"


GENERATED = f"""
gen AS (SELECT id, loaded_at, reference_answer, metadata.answer AS given, regexp_extract(id, '(\\d+)$', 1)::BIGINT AS number, {let("list_transform(prompt_messages, lambda pm: coalesce(pm.content, ''))", 'pp', "array_to_string(pp, chr(10))")} AS asked FROM evaluation_rows WHERE reference_answer IS NOT NULL),
made AS (SELECT *, ['base', 'sft', 'dpo'][number % 3 + 1] AS model_stage, CASE WHEN number % 4 = 0 THEN '7' ELSE given END AS answer, CASE WHEN number % 5 = 0 THEN 'length' ELSE 'eos' END AS finish_reason,
  number % 10 = 0 AS hit_max_new_tokens, number % 300 AS output_tokens, (number % 40) / 8::DOUBLE AS generation_seconds FROM gen),
drawn AS (SELECT *, {extracted('reference_answer', "(finish_reason = 'length')")} AS px, {gold('answer')} AS gd FROM made),
norms AS (SELECT *, {normal_answer('px.a')} AS np, {normal_answer('gd.a')} AS ng, {rational('px.a')} AS rp, {rational('gd.a')} AS rg FROM drawn),
extra AS (SELECT *, coalesce(np = ng, false) AS strict, {let(rf"regexp_extract_all({cleaned('px.a')}, '{FRAC}|{SLASH}|{REAL}\s*%?')", 'em', f"CASE WHEN len(em) = 1 THEN {rational('em[1]')} END")} AS re,
  {normal_answer(f"nullif({unitless('px.a')}, '')")} AS up, {normal_answer(f"nullif({unitless('gd.a')}, '')")} AS ug FROM norms),
scored AS (SELECT *, CASE WHEN px.a IS NULL THEN 'no_prediction' WHEN strict THEN 'strict_exact' WHEN rp = rg THEN 'numeric_equivalent' WHEN re = rg THEN 'embedded_numeric_equivalent' WHEN up = ug THEN 'unit_stripped_exact' ELSE 'none' END AS how FROM extra)"""
RATES = {
    "answer_extraction_rate": "np IS NOT NULL", "reference_answer_extraction_rate": "gd.a IS NOT NULL", "strict_exact_match": "strict", "math_equivalent": "how NOT IN ('none', 'no_prediction')",
    "exact_match": "strict", "eos_finish_rate": "finish_reason = 'eos'", "length_truncation_rate": "finish_reason = 'length'", "hit_max_new_tokens_rate": "hit_max_new_tokens",
}
EVENTS = """ev AS (SELECT user_id AS run_id, event_id AS step, event_type, CASE WHEN event_id % 17 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 19 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS metric FROM events),
fin AS (SELECT * FROM ev WHERE isfinite(metric))"""
LOG = EVENTS + ", log AS (SELECT run_id, step, CASE WHEN step % 3 = 0 THEN metric END AS loss, CASE WHEN step % 3 = 1 THEN metric END AS eval_loss FROM ev)"
WILD = "'  ' || chr(13) || chr(10) || full_chosen || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(13) || chr(10) || chr(10) || prompt || chr(9) || ' '"
NEGATIVE = " OR ".join(f"token_count.{f} IS NULL OR token_count.{f} < 0" for f in ("prompt", "chosen_total", "rejected_total", "chosen_completion", "rejected_completion"))
SPLIT_LENGTH = long_reason(180, 120, 190)
EMPTY_ID = "coalesce(id, '') = ''"

SQL: dict[str, str] = {
    "normalize_text": f"SELECT raw_row_index, {normal(WILD)} AS normalized, {normal(WILD, 0)} AS tight FROM raw_rows",
    "model_input": f"SELECT raw_row_index, prompt || chr(10) || chr(10) || '{SUFFIX}' AS model_input FROM raw_rows",
    "join_reasoning": f"SELECT raw_row_index, {strip('initial_reason_steps')} || chr(10) || chr(10) || {strip('full_chosen')} AS joined FROM raw_rows",
    "text_compare_key": f"SELECT raw_row_index, {key('prompt')} AS compare_key, starts_with({key('full_chosen')}, {key('initial_reason_steps')}) AS starts_alike FROM raw_rows",
    "word_tokens": f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens, t[1] AS first_token FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL)",
    "tail_lines": f"SELECT raw_row_index, len(x) AS n, x[1] AS last_line, x[3] AS third_last_line FROM (SELECT raw_row_index, list_reverse({lines('full_chosen')})[1:3] AS x FROM raw_rows)",
    "strip_answer": f"SELECT raw_row_index, {strip_answer('answer')} AS stripped, {strip_answer("' (' || dataset[1] || ').: '")} AS letter FROM raw_rows",
    "abnormal_output": f"SELECT doc_id, {abnormal('text')} AS abnormal FROM documents WHERE text IS NOT NULL",
    "message_text": "SELECT id, loaded_at, sha256(array_to_string(list_transform(prompt, lambda m: coalesce(m.content, '')), chr(10))) AS prompt_sha, array_to_string(list_transform(chosen, lambda m: coalesce(m.content, '')), chr(10)) AS chosen_text FROM dpo_rows",
    "chat_messages": f"""SELECT raw_row_index, 0::BIGINT AS position, 'system' AS role, '{SYSTEM}' AS content FROM raw_rows WHERE prompt IS NOT NULL
      UNION ALL SELECT raw_row_index, 1, 'user', {strip('prompt')} FROM raw_rows WHERE prompt IS NOT NULL UNION ALL SELECT raw_row_index, 2, 'assistant', {strip('full_chosen')} FROM raw_rows WHERE prompt IS NOT NULL""",
    "field_filter": f"WITH {RAW} SELECT raw_row_index, reason FROM judged",
    "filter_counts": f"WITH {KEPT} SELECT 'field_filter' AS stage, reason, count(*) AS rows FROM judged WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'length', {LONG} AS reason, count(*) FROM sized WHERE {LONG} IS NOT NULL GROUP BY 2",
    "prompt_dedupe": f"WITH {KEPT} SELECT normalized_prompt, raw_row_index, {ROW_KEY} AS row_key FROM reps",
    "dedupe_stats": f"WITH {RAW} SELECT count(*) AS rows, count(DISTINCT normalized_prompt) AS prompts, count(*) - count(DISTINCT normalized_prompt) AS duplicate_prompt_rows FROM judged WHERE reason IS NULL",
    "source_ids": f"SELECT raw_row_index, sha256(normalized_prompt) AS source_id, {SPLIT_KEY} AS split_key, {ROW_KEY} AS row_key FROM (SELECT raw_row_index, {collapse('prompt')} AS normalized_prompt FROM raw_rows WHERE prompt IS NOT NULL)",
    "token_counts": f"WITH {RAW} SELECT raw_row_index, prompt_tokens, chosen_tokens, rejected_tokens, chosen_tokens - prompt_tokens AS chosen_completion, rejected_tokens - prompt_tokens AS rejected_completion FROM {solved('(SELECT * FROM judged WHERE reason IS NULL)')}",
    "length_filter": f"WITH {RAW} SELECT raw_row_index, {LONG} AS reason FROM {solved('(SELECT * EXCLUDE (reason) FROM judged WHERE reason IS NULL)')}",
    "dpo_length_filter": f"SELECT id, loaded_at, {pair_reason('token_count.prompt', 'token_count.chosen_total', 'token_count.rejected_total', SETTINGS)} AS reason FROM dpo_rows",
    "stable_split": f"WITH {SPLIT} SELECT source_id, rank, split, split_rank FROM split",
    "allocate_splits": f"WITH {SPLIT} SELECT coalesce(max(n), 0) AS available, coalesce(max(t), 0) AS train, coalesce(max(v), 0) AS validation, coalesce(max(e), 0) AS evaluation FROM trains",
    "row_ids": f"WITH {SPLIT} SELECT source_id, {ID} || '_sft' AS sft_id, {ID} AS plain_id FROM split",
    "split_manifest": f"WITH {SPLIT} SELECT split, split_rank AS rank, source_id, source_id AS normalized_prompt_sha256, raw_row_index, split_key FROM split",
    "dataset_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "shortfall_counts": f"WITH {COUNTS} SELECT mode, kind, split, ({TARGET})::BIGINT AS target, rows, greatest(0, ({TARGET})::BIGINT - rows) AS missing FROM counts WHERE split <> 'reserve'",
    "mini_prefix": f"WITH {SPLIT} SELECT split, split_rank, source_id FROM split WHERE {MINI}",
    "mini_length_violations": f"WITH {SPLIT} SELECT split, split_rank, {SPLIT_LENGTH} AS reason FROM split WHERE {MINI} AND {SPLIT_LENGTH} IS NOT NULL",
    "mini_prefix_check": f"""WITH {SPLIT} SELECT split, split_rank, CASE WHEN split_rank % 7 = 3 THEN NULL ELSE 'x' || source_id END AS source_id, source_id AS full_source_id
      FROM split WHERE {MINI} AND (split_rank % 7 = 3 OR split_rank % 5 = 1)""",
    "field_filter_reasons": f"""WITH raw AS (SELECT raw_row_index, dataset, raw_row_index % 20 AS k, {', '.join(f"CASE raw_row_index % 20 WHEN {2 * i} THEN NULL WHEN {2 * i + 1} THEN ' ' || chr(9) || ' ' ELSE {f} END AS {f}" for i, f in enumerate(FIELDS))} FROM raw_rows),
      more AS (SELECT raw_row_index, dataset, prompt, initial_reason_steps, answer, CASE k WHEN 10 THEN ' ' || initial_reason_steps || ' then more' ELSE full_chosen END AS full_chosen,
      CASE k WHEN 11 THEN upper(initial_reason_steps) || ' or less' WHEN 12 THEN '  ' || full_chosen ELSE full_rejected END AS full_rejected FROM raw), {RAW.replace('FROM raw_rows', 'FROM more')}
      SELECT raw_row_index, reason FROM judged""",
    "split_leakage": f"""SELECT source_id, min(s) AS first_split, max(s) AS last_split FROM (SELECT source_id, {SPELLED} AS s FROM {delivered('sft_rows')} UNION ALL SELECT source_id, {SPELLED} FROM {delivered('evaluation_rows')}
      UNION ALL SELECT source_id, {SPELLED} FROM {delivered('dpo_rows')}) GROUP BY source_id HAVING min(s) <> max(s)""",
    "sft_rows": f"""WITH {SPLIT} SELECT '{SETTINGS.schema_version}' AS schema_version, id || '_sft' AS id, source_id, '{SYSTEM}' AS system, {strip('model_input')} AS user, {strip('full_positive')} AS completion,
      3::BIGINT AS messages, chosen_tokens AS token_count, split, raw_row_index, dataset AS source_dataset, 'full_positive' AS reference_answer_policy FROM {PAIRED} WHERE split IN ('train', 'validation')""",
    "dpo_rows": f"""WITH {SPLIT} SELECT id || '_dpo' AS id, source_id, 0::BIGINT AS step_index, {strip('model_input')} AS user, {strip('full_positive')} AS chosen, {strip('full_negative')} AS rejected, prompt_tokens AS prompt,
      chosen_tokens AS chosen_total, rejected_tokens AS rejected_total, chosen_tokens - prompt_tokens AS chosen_completion, rejected_tokens - prompt_tokens AS rejected_completion, split, 'full_response' AS dpo_type
      FROM {PAIRED} WHERE split IN ('train', 'validation')""",
    "evaluation_rows": f"WITH {SPLIT} SELECT id, source_id, model_input AS problem, full_positive AS reference_answer, prompt_tokens AS prompt_token_count, split, answer, source_id AS normalized_prompt_sha256 FROM {PAIRED} WHERE split = 'evaluation'",
    "reserve_rows": f"WITH {SPLIT} SELECT id, source_id, model_input AS problem, full_positive, full_negative, answer, split, raw_row_index FROM {PAIRED} WHERE split = 'reserve'",
    "limit_rows": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25",
    "candidate_ids": f"WITH {CANDIDATES} SELECT arrival, candidate_index, id FROM candidates",
    "candidate_filter": f"WITH {JUDGED} SELECT id, reason FROM judged_c",
    "candidate_quality": f"WITH {CANDIDATES} SELECT id, round({SCORE}, 9) AS score FROM candidates",
    "candidate_stats": f"WITH {JUDGED} " + " UNION ALL ".join(f"SELECT '{k}' AS outcome, count(*) FILTER (WHERE {c}) AS count, (count(*) FILTER (WHERE {c})) / (SELECT count(*) FROM candidates)::DOUBLE AS ratio FROM judged_c" for k, c in OUTCOMES.items()),
    "avg_logprob": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)) / len(embedding), 9) AS average FROM embeddings",
    "select_pairs": f"WITH {JUDGED} SELECT * FROM pairs",
    "no_valid_rejected": f"WITH {JUDGED} SELECT source_id, split, sft_row_id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.source_id = s.source_id AND p.split = s.split)",
    "split_report": f"WITH {REPORT} SELECT split, source_questions, unique_source_id, candidate_count, final_preference_pairs, no_valid_rejected, round(chosen_average_tokens, 6) AS chosen_average_tokens FROM report",
    "total_report": f"WITH {REPORT} SELECT sum(source_questions)::BIGINT AS formal_source_questions, sum(candidate_count)::BIGINT AS formal_candidate_count, sum(final_preference_pairs)::BIGINT AS formal_preference_pairs, sum(no_valid_rejected)::BIGINT AS formal_no_valid_rejected FROM report",
    "mini_pairs": f"""WITH {JUDGED}, small AS (SELECT source_id, split, row_number() OVER (PARTITION BY split ORDER BY sft_row_id) AS k FROM sources)
      SELECT id, split FROM pairs p WHERE EXISTS (SELECT 1 FROM small s WHERE s.source_id = p.source_id AND s.split = p.split AND k <= CASE s.split WHEN 'train' THEN {PAIRS.mini_train} WHEN 'validation' THEN {PAIRS.mini_validation} END)""",
    "duplicate_sources": f"""SELECT DISTINCT arrival, 'duplicate_source_row' AS reason FROM (SELECT *, min(arrival) OVER (PARTITION BY source_id, split) AS least_arrival FROM (
      SELECT source_id, {SPELLED} AS split, id || '|' || loaded_at::VARCHAR AS arrival FROM sft_rows)) WHERE arrival <> least_arrival""",
    "match_methods": """SELECT p_partkey, p_partkey % 11 NOT IN (0, 8, 10) AS equal, ['no_prediction', 'strict_exact', 'numeric_equivalent', 'percent_context_equivalent', 'embedded_numeric_equivalent', 'unit_stripped_exact',
      'choice_letter_to_content', 'choice_content_to_letter', 'none', 'numeric_equivalent', 'none'][p_partkey % 11 + 1] AS method FROM part""",
    "extraction_methods": r"""SELECT p_partkey, [f, n, n, n, 'C', n || '/9', n, NULL, NULL, repeat('{', 30) || n || repeat('}', 30)][k + 1] AS answer,
      ['boxed', 'hash_answer', 'labeled_answer_line', 'labeled_answer', 'final_line_choice', 'final_line_numeric', 'tail_number', 'not_found', 'truncated_no_final_answer', 'boxed'][k + 1] AS method,
      [f, n, n, n, 'C', n || '/9', n, 'no digits here', n, repeat('{', 30) || n || repeat('}', 30)][k + 1] AS gold,
      ['boxed', 'hash_answer', 'labeled_answer_line', 'labeled_answer', 'final_line_choice', 'final_line_numeric', 'tail_number', 'full_reference_fallback', 'final_line_numeric', 'boxed'][k + 1] AS gold_method
      FROM (SELECT p_partkey, p_partkey % 10 AS k, p_size::VARCHAR AS n, '\frac{' || p_size::VARCHAR || '}{7}' AS f FROM part)""",
    "run_gate": """SELECT o_orderkey, CASE WHEN k % 31 = 0 THEN 'no_record' WHEN k % 7 = 0 THEN 'not_completed' WHEN k % 11 IN (0, 1) THEN 'wrong_stage' WHEN k % 3 <> 0 AND (k % 13 = 0 OR k % 5 = 0) THEN 'other_mode'
      WHEN k % 17 = 0 THEN 'other_revision' WHEN k % 19 = 0 THEN 'other_model' WHEN k % 23 = 0 THEN 'smoke_run' WHEN k % 29 = 0 THEN 'adapter_missing' WHEN k % 37 = 0 THEN 'tokenizer_missing' END AS reason
      FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""",
    "audit_sample": f"WITH {JUDGED} SELECT id, split FROM pairs ORDER BY sha256(concat_ws('|', '{SETTINGS.seed}', id, split)) LIMIT 20",
    "extract_answer": f"SELECT raw_row_index, x.a AS answer, x.m AS method FROM (SELECT raw_row_index, {EXTRACTED} AS x FROM raw_rows WHERE full_chosen IS NOT NULL)",
    "gold_reference": f"SELECT id, loaded_at, x.a AS answer, x.s AS source, x.m AS method FROM (SELECT id, loaded_at, {gold("(CASE WHEN NOT ends_with(id, '3') THEN metadata.answer END)")} AS x FROM evaluation_rows WHERE reference_answer IS NOT NULL)",
    "normalize_answer": f"SELECT raw_row_index, {normal_answer('answer')} AS normalized FROM raw_rows",
    "answer_rational": f"""WITH {NUMBERS} SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN (2 * q + 1)::VARCHAR || '/2' WHEN 1 THEN {reduced('q', '100')} WHEN 4 THEN q::VARCHAR WHEN 5 THEN (-q)::VARCHAR
      ELSE {reduced('q', 'l_linenumber')} END AS value FROM numbers""",
    "compare_answers": f"""WITH {NUMBERS} SELECT l_orderkey, l_linenumber, k = 4 OR l_linenumber = 1 AS equal, CASE WHEN k = 4 THEN 'numeric_equivalent' WHEN l_linenumber = 1 THEN 'percent_context_equivalent' ELSE 'none' END AS method FROM numbers""",
    "choice_match": "SELECT p_partkey, p_partkey % 3 < 2 AS equal, ['choice_letter_to_content', 'choice_content_to_letter', 'none'][p_partkey % 3 + 1] AS method FROM part",
    "finish_reason": """SELECT l_orderkey, l_linenumber, kept, reason, reason = 'length' AND kept >= 6 AS hit_max FROM (SELECT *, CASE WHEN coalesce(list_position(x, 9), 0) > 0 THEN list_position(x, 9) - 1 ELSE
      list_max(list_transform(x, lambda v, i: CASE WHEN v <> 0 THEN i ELSE 0 END)) END::BIGINT AS kept, CASE WHEN list_contains(x, 9) THEN 'eos' ELSE 'length' END AS reason FROM (
      SELECT l_orderkey, l_linenumber, list_transform(range(1, l_linenumber + 3), lambda i: CASE WHEN i > l_linenumber THEN 0 ELSE (l_orderkey + i) % 9 + 1 END)[1:6] AS x FROM lineitem))""",
    "score_predictions": f"""WITH {GENERATED} SELECT id, loaded_at, model_stage, px.a AS predicted_answer, px.m AS extraction_method, gd.a AS reference_final_answer, gd.s AS reference_answer_source, np AS normalized_predicted_answer,
      ng AS normalized_reference_answer, strict AS strict_exact_match, how NOT IN ('none', 'no_prediction') AS math_equivalent, how AS match_method FROM scored""",
    "prediction_summary": f"WITH {GENERATED} SELECT model_stage, count(*) AS num_examples, " + ", ".join(f"round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 9) AS {k}" for k, c in RATES.items())
    + ", round(avg(output_tokens), 9) AS average_real_output_tokens, round(avg(output_tokens), 9) AS average_output_tokens, round(avg(generation_seconds), 9) AS average_generation_seconds FROM scored GROUP BY model_stage",
    "case_samples": f"""WITH {GENERATED} SELECT * FROM (SELECT 'correct' AS "case", model_stage, id, how AS match_method FROM scored WHERE how NOT IN ('none', 'no_prediction') ORDER BY model_stage, id, loaded_at LIMIT 5)
      UNION ALL SELECT * FROM (SELECT 'error', model_stage, id, how FROM scored WHERE how IN ('none', 'no_prediction') ORDER BY model_stage, id, loaded_at LIMIT 5)""",
    "best_checkpoint": f"""WITH {EVENTS}, best AS (SELECT run_id, arg_min({{'m': metric, 's': step}}, {{'m': metric, 's': step}}) AS b FROM fin WHERE event_type <> 'click' GROUP BY run_id)
      SELECT run_id, b.s AS step, b.m AS metric FROM best UNION ALL SELECT run_id, NULL, m FROM (SELECT run_id, max(metric) AS m FROM ev GROUP BY run_id) WHERE isfinite(m) AND run_id NOT IN (SELECT run_id FROM best)""",
    "running_best": f"""WITH {EVENTS} SELECT run_id, step, metric, min(metric) OVER (PARTITION BY run_id ORDER BY step) AS best_metric,
      coalesce(metric < min(metric) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM fin""",
    "loss_history": f"WITH {LOG} SELECT run_id, step, loss IS NOT NULL AS trains FROM log WHERE loss IS NOT NULL OR eval_loss IS NOT NULL",
    "finite_metrics": f"WITH {LOG} SELECT run_id, step FROM log WHERE NOT isfinite(loss) OR NOT isfinite(eval_loss)",
    "json_safe_rows": f"WITH {LOG} SELECT run_id, step, CASE WHEN isfinite(loss) THEN loss END AS loss, CASE WHEN isfinite(eval_loss) THEN eval_loss END AS eval_loss FROM log",
    "dpo_violations": f"""SELECT * FROM (SELECT id, loaded_at, CASE WHEN {EMPTY_ID} THEN 'id_empty' WHEN chosen IS NOT DISTINCT FROM rejected THEN 'chosen_equals_rejected' WHEN coalesce(len(prompt), 0) = 0 THEN 'prompt_empty'
      WHEN coalesce(len(chosen), 0) = 0 THEN 'chosen_empty' WHEN coalesce(len(rejected), 0) = 0 THEN 'rejected_empty' WHEN token_count IS NULL OR {NEGATIVE} THEN 'token_count_invalid'
      WHEN token_count.prompt > 150 THEN 'prompt_too_long' WHEN token_count.chosen_total > 260 THEN 'chosen_too_long' WHEN token_count.rejected_total > 260 THEN 'rejected_too_long' END AS violation FROM dpo_rows) WHERE violation IS NOT NULL""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
