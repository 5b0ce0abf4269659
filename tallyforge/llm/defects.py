"""Problem 4: broken prompt and response pairs, at most one defect per value.

Openings of responses are split into clauses, clauses are clustered by verified MinHash, and clusters that
recur across unrelated prompts in responses without any working are refusal templates. Checks of content,
copying, language and termination label the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..plans.durable import written
from . import endings
from .components import components
from .near_duplicates import user_content
from ..sources.tables import latest_delivery

# Answers that say there is none.
PLACEHOLDERS = {
    "null", "none", "nil", "nan", "na", "n/a", "n.a", "tbd", "todo", "undefined", "empty", "blank", "unknown", "missing", "no-answer", "noanswer", "no answer", "not available", "no response", "no output",
    "not applicable", "to be done", "answer", "final answer", "keine", "keine antwort", "sin respuesta", "ninguna", "ninguna respuesta", "pas de réponse", "aucune", "aucune réponse", "无", "没有答案", "нет", "нет ответа",
}
# Frequent words that tell a language; scripts tell the others.
STOPWORDS = {
    "en": "the of and to in is that it for with as this by are from at be which we have has how many what he she they there then so into each all was were will after before than more their its an or on not no if every gives leaves follows therefore hence next now first since when while",
    "de": "der die das und ist in den von zu mit auf für ein eine einen nicht dass es sich wir auch noch dann wie viel am im dem des bei aus nach durch zuerst danach weil oder sind wird hat haben lautet daraus also da man sieht beträgt erhalten bleibt",
    "es": "el la los las de y en que es un una por con para se no su al del lo como más pero si esto entonces son primero luego después porque cuánto cuántas tiene hay cada sobre entre tarda donde hasta queda quedan obtenemos resulta",
    "fr": "le la les de des et en que est un une pour avec dans sur pas ne il elle on nous ce cette qui du au aux donc alors puis ensuite par combien reste sont chez vaut car toutes deux mais leur ses son",
}
WORKING = re.compile(r"\d|\\frac|\\sqrt|\\boxed\{[^}]|[=<>^]|[a-z]\s*[+*/]\s*[a-z]\b|[²³√∑×÷≤≥≈π½¼¾]|[一二三四五六七八九十百千两]+[个元米克升]|\([A-Ea-e]\)")
# Declining, in words: evidence on a cluster, and the verdict only on clauses that never recur.
DECLINE = re.compile(
    r"\b(?:sorry|apolog\w*|unfortunately|cannot|can['’]?t|can not|won['’]?t|unable|not able|not allowed|declin(?:e|es|ed|ing)|refus(?:e|es|ed|ing|al)|rather not|not comfortable|not feel comfortable|not (?:be )?appropriate|off limits|guidelines|against the rules|restricted|as an (?:ai|assistant)|must pass|have to pass|unanswered|outside what|talk about something else|find someone else|do not cross|no solution|nothing i could say|won't be given|not going to|not permitted)\b"
    r"|\b(?:leider|tut mir leid|nicht helfen|kann ich nichts?|nicht möglich|nicht beantworten|darf das nicht|darf ich nichts?|nicht in der lage|keine lösung|nicht heraus|lösung gebe ich|ablehnen|lehne|möchte ich nichts?|bitte wenden?)\b"
    r"|\b(?:lo siento|no puedo|no me es posible|prefiero no|declinar|no se dará|ninguna solución|no está permitido|no debo|lamento|rechazar\w*)\b"
    r"|\b(?:désolée?|navrée?|ne peux pas|ne puis|pas possible|préfère ne pas|décliner|aucune solution|pas autorisée?|m['’]est impossible|regrette)\b"
    r"|抱歉|对不起|无法|不能回答|拒绝|\b(?:извините|не могу|к сожалению|отказ\w*)",
    re.I,
)
# Somebody who speaks or is spoken to: where none is, a declining word in a cut sentence belongs to the working.
SPEAKER = re.compile(
    r"\b(?:i|me|my|you|your|sorry|apolog\w*|unfortunately|ich|mir|mich|mein\w*|sie|ihnen|dir|dich|leider|lo siento|puedo|prefiero|debo|lamento|je|j|moi|vous|désolée?|navrée?|peux|puis|préfère|regrette|я|вам|извините|могу|сожалению)\b|我|您|你|抱歉|对不起",
    re.I,
)
# Clauses that name an answer, or that there is none to a question: terse replies in words, no refusals.
ANSWER = (
    r"(?U)\b(?:answer is|result is|solution is|yes|true|false|antwort ist|ergebnis ist|ja|nein|respuesta es|resultado es|sí|réponse est|résultat est|oui|non"
    r"|there (?:is|are|was|were) no|(?:has|have|had) no|es gibt kein\w*|(?:hat|haben) kein\w*|no (?:hay|tiene|tienen)|il n['’]y a|n['’]a pas|нет)\b"
)
PERSON = (
    r"(?U)\b(?:i|i['’]m|i['’]d|i['’]ll|me|my|you|your|we|us|not|no|never|nothing|nobody|ich|mir|mich|dich|dir|du|sie|ihnen|nicht|kein\w*|nichts"
    r"|yo|mi|usted|tú|tu|ni|nada|ningun\w*|je|j['’]\w+|moi|mon|vous|ne|pas|aucun\w*|rien|не|я|вам)\b|我|不"
)
WORD = re.compile(r"[^\W_]+")
HAN, CYRILLIC, LATIN = re.compile(r"[\u3400-\u9fff]+"), re.compile(r"[\u0400-\u04ff]+"), re.compile(r"[a-zA-Z\u00c0-\u024f]+")
MARKUP = re.compile(r"```.*?(?:```|$)|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]|\\\w+|https?://\S+", re.S)
QUOTED = re.compile(r"[\"“„«][^\"”“»]{0,200}[\"”“»]")


def nothing_said(text: str | None) -> bool:
    """No answer content: nothing visible, no letter or digit, or only a placeholder."""
    if text is None:
        return True
    bare = re.sub(r"\\(?:boxed|fbox|text|mathrm)\b", "", text).lower()
    bare = re.sub(r"[^\w/.]+", " ", re.sub(r"[\u200b-\u200f\u2060\ufeff\u00ad]", "", bare)).replace("_", " ").strip(" .")
    bare = re.sub(r"^(?:final )?answer\s+", "", bare)
    return not re.search(r"[^\W_]", bare) or bare in PLACEHOLDERS


def language(text: str) -> str | None:
    """en, de, es, fr, zh, ru (or another script's name) of most of the words, None if too few tell."""
    prose = MARKUP.sub(" ", text)
    prose = QUOTED.sub(" ", prose)
    if not prose.isascii():
        han, cyrillic, latin = (sum(map(len, kind.findall(prose))) for kind in (HAN, CYRILLIC, LATIN))
        if han * 3 > latin and han >= 4 and han > cyrillic:
            return "zh"
        if cyrillic > latin and cyrillic >= 6:
            return "ru"
    score = dict.fromkeys(STOPWORDS, 0)
    for word in WORD.findall(prose.lower()):
        for k in _LANGUAGES.get(word, ()):
            score[k] += 1
    order = sorted(score.values())
    best = max(score, key=lambda k: score[k])
    if order[-1] >= 2 and order[-1] >= 1.4 * order[-2]:
        return best
    return None


_LANGUAGES: dict[str, list[str]] = {}
for _k, _v in STOPWORDS.items():
    for _w in dict.fromkeys(_v.split()):
        _LANGUAGES.setdefault(_w, []).append(_k)


def question_facts(text: str) -> tuple[str | None, list[str], set, set]:
    """Language, words, distinct words and word runs of a question, which several responses share."""
    words = WORD.findall(text.lower())
    return language(text), words, set(words), _grams(words)


def _grams(words: list[str]) -> set:
    return set(zip(words, words[1:], words[2:], strict=False))


def copies_question(facts: tuple, answer: str) -> bool:
    """The question (its `question_facts`), whole or nearly, and nothing else of substance."""
    _, q, known, gq = facts
    a = WORD.findall(answer.lower())
    if len(q) < 4 or len(a) < 4:
        return len(q) > 0 and q == a
    # each word begins at most one run a place, so half of the runs need some of the words
    if sum(map(q.count, known.intersection(a))) < 0.5 * len(gq):
        return False
    ga = _grams(a)
    both = len(gq & ga)
    if both < 0.5 * len(gq):
        return False
    if both >= 0.85 * len(ga):
        return True  # also the question said twice, or most of it
    new = sum(w not in known for w in a)
    return both >= 0.6 * len(ga) and new <= max(6, 0.1 * len(a))


CLAUSE_END = re.compile(
    r"[.!?,;:。！？，；\n]+|\s+(?=(?:because|since|weil|porque|parce que|потому что|так как)\b)", re.I
)
CLAUSE_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
NAME = re.compile(r"[^\W\d_a-z][^\W\d_]{3,}")
DIGIT = re.compile(r"\d")
#: Words of a long clause that are clustered beside the whole one, so that endings put to a template don't hide it.
OPENING = 6


def no_working(text: str) -> bool:
    return not WORKING.search(text)


def opening(text: str, bare: bool, most: int = 6) -> list[tuple[str, bool, bool]]:
    """(clause, whole, declines) of a response: clauses, and the first OPENING words of longer ones, each with
    whether it is a whole clause and whether it declines in words.

    Clauses have no digit and three words or more, or decline; lower case, names as n. All clauses of a bare
    response are given; of others the first `most`, as they only tell which clauses go with a working, and
    only their short clauses are searched for declining words.
    """
    parts = CLAUSE_END.split(text, maxsplit=0 if bare else most)
    any_declines = bare and bool(DECLINE.search(text))
    out: dict[str, tuple[bool, bool]] = {}
    for part in parts if bare else parts[:most]:
        if DIGIT.search(part):
            continue
        words = ["n" if k and NAME.match(w) else w.lower() for k, w in enumerate(CLAUSE_WORD.findall(part))]
        declines = (any_declines or (not bare and 0 < len(words) < 3)) and bool(DECLINE.search(part))
        if len(words) >= 3 or declines:
            out[" ".join(words)] = (True, declines or out.get(" ".join(words), (True, False))[1])
            if len(words) > OPENING:
                out.setdefault(" ".join(words[:OPENING]), (False, False))
    return [(clause, *v) for clause, v in out.items()]


def declines_in_working(answer: str) -> bool:
    """Of an unfinished answer: it declines only in its cut sentence, in which nobody speaks or is spoken to."""
    at = max((m.end() for m in re.finditer(r"[.!?。！？\n]+(?=\s*\S)", answer)), default=0)
    return not DECLINE.search(answer, 0, at) and not SPEAKER.search(answer, at)


def judge(facts: tuple | None, answer: str | None) -> tuple[str | None, bool, str | None]:
    """(sure, bare, otherwise): a defect that needs no templates, whether the response shows no working, and
    the defect it has if it is no refusal. `facts` are the question's `question_facts`, None without one."""
    if nothing_said(answer):
        return "empty", False, None
    if facts and copies_question(facts, answer):
        return "copy", False, None
    bare = no_working(answer)
    asked = facts[0] if facts else None
    said = language(answer) if asked else None
    if asked and said and asked != said:
        return None, bare, "other_language"
    return None, bare, "truncated" if endings.unfinished(answer) else None


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per value its judgement; per batch the clauses of openings with their counts (rows of `clause`).

    `said` holds the clauses of a bare response: `own` numbers the declining ones and is -1 on others, the
    words at the start of a long clause bear its number. It is empty of numbers where the declining words
    belong to a working that is cut.
    """
    import xxhash

    said_kind = pa.list_(pa.struct([("clause", pa.string()), ("own", pa.int32())]))
    kinds = [("id", pa.string()), ("field_name", pa.string()), ("sure", pa.string()), ("bare", pa.bool_()), ("n_own", pa.int32()), ("otherwise", pa.string()), ("said", said_kind)]
    counts = [("clause", pa.string()), ("n", pa.int64()), ("n_bare", pa.int64()), ("n_declines", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]
    k_kinds = len(kinds)
    for batch in batches:
        rows: list[tuple] = []
        seen: dict[str, list[int]] = {}
        asked: tuple = (None, None)
        for id_, field, question, answer in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if question != asked[0]:  # the responses to a question follow each other
                asked = (question, question_facts(question) if question else None)
            sure, bare, otherwise = judge(asked[1], answer)
            clauses = [] if sure else opening(answer, bare)
            declines = bare and any(c[2] for c in clauses)
            belongs = declines and otherwise == "truncated" and declines_in_working(answer)
            if belongs:
                declines = False
            if sure or bare or otherwise:
                said, number, n_own = [], -1, 0
                for clause, whole, own in clauses if bare else []:
                    if whole:
                        number = n_own if own and declines else -1
                        n_own += number >= 0
                    said.append({"clause": clause, "own": number})
                rows.append((id_, field, sure, bare, n_own, otherwise, said))
            at = xxhash.xxh3_64_intdigest(question or "") >> 1
            for clause, _, _ in clauses:
                c = seen.setdefault(clause, [0, 0, 0, at, at])
                c[0] += 1
                c[1] += bare
                c[2] += declines
                c[3], c[4] = min(c[3], at), max(c[4], at)
        rows += [(None,) * k_kinds + (k, *v) for k, v in seen.items()]
        width = k_kinds + len(counts)
        full = [r + (None,) * (width - len(r)) for r in rows]
        columns = list(zip(*full, strict=True)) if full else [()] * width
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(columns, kinds + counts, strict=True)], [n for n, _ in kinds + counts])


JUDGED = "id string, field_name string, sure string, bare boolean, n_own int, otherwise string, said array<struct<clause:string,own:int>>, clause string, n bigint, n_bare bigint, n_declines bigint, low bigint, high bigint"
BANDS, ROWS, RUN = 12, 2, 5
#: Rows of a band that are compared at once.
CHUNK = 1024


def _shingles(text: str) -> set[str]:
    words = text.split()
    return {" ".join(words[i : i + RUN]) for i in range(max(1, len(words) - RUN + 1))}


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 62, BANDS * ROWS, dtype=np.uint64)
    for batch in batches:
        keys = []
        for text in batch.column("clause").to_pylist():
            h = np.array([xxhash.xxh3_64_intdigest(s) for s in _shingles(text)], np.uint64)
            least = ((h[:, None] * a + b) >> np.uint64(3)).min(axis=0).reshape(BANDS, ROWS)
            keys.append([xxhash.xxh3_64_intdigest(row.tobytes(), seed=k) >> 1 for k, row in enumerate(least)])
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("rid")), BANDS)), pa.array([k for row in keys for k in row], pa.int64())], ["rid", "band"]) if n else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["rid", "band"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("clause_a").to_pylist(), batch.column("clause_b").to_pylist(), strict=True):
            sx, sy = _shingles(x), _shingles(y)
            keep.append(5 * len(sx & sy) >= 4 * len(sx | sy))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def clause_clusters(clauses: DataFrame) -> DataFrame:
    """(rid, cluster) of `clauses` (rid, clause): verified MinHash over runs of five words, at 0.8 or more.

    Each band ties its members to one of them, another one in each band, so a band that holds a third of
    all clauses gives as many links as members. Members outside a band's largest tied group are then compared
    with all of the band in chunks, so every pair that shares a band is linked or known not to be.
    """
    banded = written(clauses.select("rid", "clause").mapInArrow(_bands, "rid bigint, band bigint"), "bands")
    heads = banded.groupBy("band").agg(F.min(F.struct(F.xxhash64("rid", "band").alias("h"), "rid")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    a = clauses.select(F.col("rid").alias("a"), F.col("clause").alias("clause_a"))
    b = clauses.select(F.col("rid").alias("b"), F.col("clause").alias("clause_b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """b may stand in a third of all pairs; pairs is written, so that hot ones are found first."""
        return lookup_join(written(pairs, "pairs"), b, "b").join(a, "a").select("a", "b", "clause_a", "clause_b").mapInArrow(_verified, "a bigint, b bigint")

    heads = written(heads, "heads")
    stars = lookup_join(banded, heads, "band").select(F.col("rid").alias("a"), F.col("head.rid").alias("b")).where("a <> b").distinct()
    links = written(verified(stars), "links")
    tied = components(links).select(F.col("node").alias("rid"), F.col("component").alias("label"))
    marked = written(lookup_join(banded, heads.select("band"), "band").join(tied, "rid", "left").withColumn("label", F.coalesce("label", "rid")), "marked")
    groups = marked.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"))
    plan = groups.groupBy("band").agg(F.max(F.struct("m", "label")).alias("main"), F.sum("m").alias("n"))
    plan = plan.where("n > main.m").select("band", "main.label", F.ceil(F.col("n") / CHUNK).cast("int").alias("all"), F.ceil((F.col("n") - F.col("main.m")) / CHUNK).cast("int").alias("open"))
    plan = written(plan.withColumnRenamed("label", "main"), "plan")
    if plan.isEmpty():
        return clauses.select("rid").join(tied, "rid", "left").select("rid", F.coalesce("label", "rid").alias("cluster"))
    placed = lookup_join(marked, plan, "band")
    chunk = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    opened = placed.where("label <> main").select("band", F.col("rid").alias("a"), F.col("label").alias("of_a"), chunk("open").alias("i"), each("all").alias("j"))
    rest = placed.select("band", F.col("rid").alias("b"), F.col("label").alias("of_b"), chunk("all").alias("j"), each("open").alias("i"))
    others = opened.join(rest, ["band", "i", "j"]).where("of_a <> of_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(verified(others))
    found = components(links).select(F.col("node").alias("rid"), F.col("component").alias("cluster"))
    return clauses.select("rid").join(found, "rid", "left").select("rid", F.coalesce("cluster", "rid").alias("cluster"))


def clause_verdicts(counts: DataFrame) -> DataFrame:
    """(clause, refuses) of the clauses among `counts` (clause, n, n_bare, n_declines, low, high) whose cluster
    recurs: opens three responses or more, to more than one prompt.

    Such a cluster is a refusal template if nine of ten of its responses show no working, and either one of
    ten declines in words, or the clause has four words or more, speaks of a person or denies something, and
    names no answer: a terse reply in words is no refusal. Clauses that neither refuse nor stand in a
    declining response are left out.
    """
    total = counts.groupBy("clause").agg(*[F.sum(c).alias(c) for c in ("n", "n_bare", "n_declines")], F.min("low").alias("low"), F.max("high").alias("high"))
    clauses = written(total.withColumn("rid", F.monotonically_increasing_id()), "clauses")
    joined = written(clauses.join(clause_clusters(clauses), "rid"), "clustered")
    clusters = joined.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "n_bare", "n_declines")], F.min("low").alias("low"), F.max("high").alias("high"))
    recurring = clusters.where("n >= 3 and low <> high").select("cluster", (F.col("n_bare") >= 0.9 * F.col("n")).alias("unworked"), (F.col("n_declines") >= 0.1 * F.col("n")).alias("declined"))
    full = (F.size(F.split("clause", " ")) >= 4) & F.col("clause").rlike(PERSON) & ~F.col("clause").rlike(ANSWER)
    refuses = F.col("unworked") & (F.col("declined") | full)
    found = lookup_join(joined, written(recurring, "recurring"), "cluster").select("clause", "n_declines", refuses.alias("refuses"))
    return written(found.where("refuses or n_declines > 0").select("clause", "refuses"), "verdicts")


def content(messages: Column) -> Column:
    """The contents of all messages, one per line; null if there is none."""
    said = F.filter(F.transform(messages, lambda m: m["content"]), lambda t: t.isNotNull())
    return F.when(F.size(said) > 0, F.array_join(said, "\n"))


def values(dpo: DataFrame, sft: DataFrame) -> DataFrame:
    """(id, field_name, question, answer) of chosen, rejected and completion, each id in its latest delivery."""
    question = user_content(F.col("prompt"))
    pairs = latest_delivery(dpo, "id", "loaded_at", {"question": question, "chosen": content(F.col("chosen")), "rejected": content(F.col("rejected"))})
    both = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("answer")) for f in ("chosen", "rejected")])).alias("v")
    first = pairs.select("id", "question", both).select("id", "v.field_name", "question", "v.answer")
    second = latest_delivery(sft, "id", "loaded_at", {"question": question, "answer": content(F.col("completion"))})
    return first.unionByName(second.select("id", F.lit("completion").alias("field_name"), "question", "answer"))


def defects(given: DataFrame) -> DataFrame:
    """(id, field_name, defect, evidence) of each defective value of `given` (id, field_name, question, answer).

    Clusters decide on refusals (evidence 'template'). Declining words do so alone ('words') only in clauses
    of a bare response that never recur across prompts. Null and blank answers are 'empty'. Without a question
    nothing is a copy or in another language. All other defects have the evidence 'check'.
    """
    judged = written(given.select("id", "field_name", "question", "answer").mapInArrow(_judged, JUDGED), "judged")
    rows = judged.where("id is not null")
    verdicts = clause_verdicts(judged.where("clause is not null").select("clause", "n", "n_bare", "n_declines", "low", "high"))
    asked = written(rows.where("bare").select("id", "field_name", F.explode("said").alias("s")).select("id", "field_name", "s.clause", "s.own"), "asked")
    settled = F.count_distinct(F.when(F.col("own") >= 0, F.col("own")))
    met = lookup_join(asked, verdicts, "clause").groupBy("id", "field_name").agg(F.max("refuses").alias("template"), settled.alias("settled"))
    alone = F.col("n_own") > F.coalesce("settled", F.lit(0))
    evidence = F.when(F.col("sure").isNotNull(), "check").when(F.col("template"), "template").when(alone, "words").otherwise("check")
    defect = F.when(evidence == "check", F.coalesce("sure", "otherwise")).otherwise("refusal")
    return rows.join(met, ["id", "field_name"], "left").select("id", "field_name", defect.alias("defect"), evidence.alias("evidence")).where("defect is not null")
