"""Defects, tokens, containers and truncation."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import defects, endings, packing, tokenizing, truncation

QUESTION = "A train leaves Yorobury with 14 knotted walnuts and stops 53 times before the workshop. How many tokens does Sarkeoxan pay for 30 boots?"
SOLVED = "First, we add both amounts and get 3 + 4 = 7. The answer is 7."
CASES = [
    (QUESTION, None, "empty"), (QUESTION, "", "empty"), (QUESTION, "​ \n", "empty"), (QUESTION, "N/A", "empty"), (QUESTION, "\\boxed{}", "empty"), (QUESTION, "...", "empty"), (QUESTION, "(no answer)", "empty"),
    (QUESTION, SOLVED, None), (QUESTION, "Answer: 4", None), (QUESTION, "x = 17", None), (QUESTION, "$3 + 4 = 7$", None), (QUESTION, "28", None), (QUESTION, "\\boxed{\\frac{1}{2}}", None), (QUESTION, "no", None),
    (QUESTION, QUESTION, "copy"), (QUESTION, "> " + QUESTION.upper(), "copy"), (QUESTION, "You asked: " + QUESTION, "copy"), (QUESTION, QUESTION + " " + QUESTION, "copy"),
    (QUESTION, QUESTION + " Adding the walnuts gives 14 + 53 = 67 and thus each boot costs 2 pieces, that is, 60 in total for all.\nFinal answer: 60", None),
    (QUESTION, "I'm sorry, but I can't help with this problem.", "refusal"), (QUESTION, "Lo siento, pero no puedo ayudar con eso.", "refusal"), (QUESTION, "Eine Lösung gebe ich hier nicht heraus.", "refusal"),
    (QUESTION, "Sorry, a small slip above: the correct line is 3 + 4 = 7. The answer is 7.", None), (QUESTION, "I am unable to simplify $3/11$ further, so it stays as it is. The answer is 3/11.", None),
    (QUESTION, "Zuerst addieren wir die beiden Mengen und erhalten 3 + 4 = 7. Das Ergebnis ist 7.", "other_language"), (QUESTION, "剩下的物品很容易数出来。所以答案是 7。", "other_language"),
    (QUESTION, 'The sign reads "ohne Gewähr, bitte nicht berühren". So the answer is 7.', None),
    (QUESTION, "First, we add both amounts and get 3 + 4 = 7. The cost per it", "truncated"), (QUESTION, "We see that \\( 3 + 4", "truncated"), (QUESTION, "So the answer is \\boxed{4", "truncated"),
    (None, "Zuerst addieren wir die beiden Mengen und erhalten 3 + 4 = 7.", None), (None, None, "empty"), ("", SOLVED, None),
]


def test_defects(spark):
    rows = spark.createDataFrame([(f"r{i}", "chosen", q, a) for i, (q, a, _) in enumerate(CASES)], "id string, field_name string, question string, answer string")
    got = {r.id: r.defect for r in defects.defects(rows).collect()}
    assert {f"r{i}": got.get(f"r{i}") for i in range(len(CASES))} == {f"r{i}": d for i, (*_, d) in enumerate(CASES)}


def test_templates_reveal_refusals_without_a_declining_word(spark):
    template = "This exercise is better left to somebody else entirely"
    said = [(f"t{i}", f"{QUESTION} {i}", f"Sorry, I cannot. {template}." if i % 2 else f"{template}.") for i in range(12)]
    said += [(f"w{i}", f"{QUESTION} {i}", "You had better ask the person who set this task.") for i in range(3)]
    plain = [(f"p{i}", f"{QUESTION} {i}", SOLVED) for i in range(12)] + [(f"y{i}", f"{QUESTION} {i}", "Yes, the number is odd.") for i in range(12)] + [("alone", QUESTION, "Purple is what the sky becomes.")]
    rows = spark.createDataFrame([(i, "completion", q, a) for i, q, a in said + plain], "id string, field_name string, question string, answer string")
    got = {r.id: r.defect for r in defects.defects(rows).collect()}
    assert got == {i: "refusal" for i, *_ in said}


def test_clusters_decide_over_declining_words(spark):
    worked = [(f"w{i}", f"{QUESTION} {i}", f"A side cannot be negative. So we add 3 + {i} and get {i + 3}.", None) for i in range(12)]
    said = [
        ("recurs", QUESTION, "A side cannot be negative. Thus both sides are of the same length.", None),
        ("alone", QUESTION, "That request I cannot fulfil for anybody today.", "refusal"),
        ("boundary", QUESTION, "The canteen sells wontons and both cost the same.", None),
        ("cut", QUESTION, "Both lengths are positive. The width of the garden cannot be negat", "truncated"),
        ("cut refusal", QUESTION, "I'm sorry, but I cannot help you with thi", "refusal"),
    ]
    rows = spark.createDataFrame([(i, "completion", q, a) for i, q, a, _ in worked + said], "id string, field_name string, question string, answer string")
    got = {r.id: r.defect for r in defects.defects(rows).collect()}
    assert got == {i: d for i, _, _, d in said if d}


def test_clusters_lose_no_pair_of_a_band(spark, monkeypatch):
    def one_band(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([1] * batch.num_rows, pa.int64())], ["rid", "band"])

    monkeypatch.setattr(defects, "_bands", one_band)
    monkeypatch.setattr(defects, "CHUNK", 4, raising=False)
    texts = [" ".join([f"{'abcde'[k]}{j}" for j in range(25)] + [f"end{i}"]) for k in range(5) for i in range(3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid bigint, clause string")
    groups = {}
    for r in defects.clause_clusters(rows).collect():
        groups.setdefault(r.cluster, set()).add(r.rid)
    assert sorted(map(sorted, groups.values())) == [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(5)]


def test_clauses_are_whole():
    text = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60))
    assert [clause for clause, whole, _ in defects.opening(text, True) if whole] == [text]


def test_templates_decide_without_declining_words(spark, monkeypatch):
    """With the list of declining words switched off, nine of ten refusals still come from their templates."""
    import re

    monkeypatch.setattr(defects, "DECLINE", re.compile("(?!)"))
    rng = random.Random(4)
    heads = ["Sorry", "With respect", "Thanks for asking", "Hm"]
    bodies = ["I would rather not answer this one", "this goes against the rules I follow", "my remit does not reach that far", "I leave this to other people"]
    tails = ["", " because the topic is closed", " at this time", ". Please ask a teacher"]
    said = [(f"t{i}", f"{QUESTION} {i}", f"{rng.choice(heads)}, {rng.choice(bodies)}{rng.choice(tails)}.", True) for i in range(120)]
    said += [(f"w{i}", f"{QUESTION} {i}", SOLVED, False) for i in range(120)] + [(f"n{i}", f"{QUESTION} {i}", "There is no solution to this equation.", False) for i in range(12)]
    rows = spark.createDataFrame([(i, "completion", q, a) for i, q, a, _ in said], "id string, field_name string, question string, answer string")
    got = {r.id: r.evidence for r in defects.defects(rows).where("defect = 'refusal'").collect()}
    true = {i for i, *_, refusal in said if refusal}
    assert set(got) <= true and set(got.values()) == {"template"} and len(got) >= 0.9 * len(true)


@pytest.mark.parametrize("text", ["sin", "\\boxed{\\sin}", "respuesta", "réponse", "ответа"])
def test_words_that_are_no_placeholders(text):
    assert not defects.nothing_said(text)


COMPLETE = [
    "It ends here.", "Done!\n\n", "Answer: 58", "x = 14", "#### 18", "**41 kilometres**", "\\boxed{\\frac{28}{2031}}", "Thus it is $\\boxed{53}$", "Total | 644 hours", "Final answer: (25, 6)", "- ropes: 3733\n- bells: 3837",
    "- check the tinted jars again", "| 31 | 1407 |", "Best wishes, Ruvouphin", "With thanks to A and B", "/Ruvisha", "— Praiahal", "Worked by Joraekri, Faleozethhollow, Monday", "Good night :)", "Q.E.D.", "[end of sheet 43]",
    "End of part 57", "(See also the sheet for Monday.)", "Keywords: turnips, mittens, dairy", "```\n4 + 40 = 44\n```", "\\end{align}", "$$ 3622 + 2026 = 5648 $$", "It goes on like this: 2, 4, 8, 16, ...", "She said: \"Well done.\"",
    "所以答案是 7。", "", " \n", "Level: hard",
]
CUT = [
    "Find the value of x that Quinubramuc", "Moving every term to one", "so 30 + 46 =", "We see that \\( 3 + 4", "It keeps $x = 3", "The ratio is 3 to 5 …", "The result  ...", "The result [...]", "the grader compared it vs.", "in approx.",
    "So the answer is \\boxed{14", "```\n303 - 19", "Keywords: turnips,", "[end of shee", "(See also the sheet for T", "7.", "| 31 | 14", "a rectangle of 27 minutes by 49.4 metres and ", "首先把两个数相加，得到 96",
    "**45 kilo", "Name:", "Substituting", "6. There are 54 boxes, and Wexaenax places 3 amber t",
]


@pytest.mark.parametrize(("text", "cut"), [("So we get\n$$\nx = 3", True), ("So we get\n\\[\nx = 3", True), ("So we get\n$$\nx = 3\n$$", False), ("So we get\n\\[\na = 1 \\\\[4pt]\nx = 3\n\\]\nIt ends.", False)])
def test_display_formulas_over_lines(text, cut):
    assert endings.unfinished(text) is cut


@pytest.mark.parametrize("text", COMPLETE)
def test_complete_endings(text):
    assert not endings.unfinished(text if not text or text[0] in "|`" else "A sentence before.\n" + text)


@pytest.mark.parametrize("text", ["Viele Grüße, Anna", "Cordialement, Marie", "Saludos, María", "С уважением, Анна", "Sincerely, Tom", "Thanks,\nTom Smith", "Mit freundlichen Grüßen\nAnna Weber", "此致\n敬礼", "End of part 6"])
def test_closings_of_all_languages(text):
    assert not endings.unfinished("It holds for 60 of them.\n" + text)


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(text):
    assert endings.unfinished("A sentence before.\n" + text)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, collected_at int, text_sha string")


def test_truncated_documents(spark):
    whole = "The depot sold 36 kilograms to all."
    texts = [whole + "\nAnswer: 5", whole + "\nAnswer: 58", whole, None, "", " ", "stops in the mid", "stops in the mid"]
    texts += [f"Lot {i} measures {i}.5 metres in total. It measures {i}.7 metres now." for i in range(1, 60)] + ["It measures 36."]
    got = {r.doc_id: r.why for r in truncation.truncated(documents(spark, texts)).collect()}
    assert got == {0: "prefix", 6: "unfinished", 7: "unfinished", len(texts) - 1: "continued"}


@pytest.mark.parametrize(("more", "cut"), [(30, False), (70, True)])
def test_lookup_of_ends_is_independent_of_size(spark, more, cut):
    for times in (1, 10):
        texts = [f"Lot {i} is {i}.5 metres long. It measures {i}.7 metres now." for i in range(more * times)] + [f"Lot {i} is ready. It measures 36." for i in range(10_000, 10_000 + times)]
        got = {r.doc_id for r in truncation.truncated(documents(spark, texts)).collect() if r.why == "continued"}
        assert got == (set(range(more * times, len(texts))) if cut else set())


def test_prefixes_of_sentences_find_planted_cuts(spark):
    """Copies of a sentence's start are found by what stands elsewhere, whatever the form says of the ending."""
    rng = random.Random(6)
    names = ["Mara", "Tomas", "Ilse", "Juri", "Nadja"]
    whole = [f"Lot {i} is ready. On Monday {rng.choice(names)} brings {i} jars to the old mill near the lake." for i in range(400)]
    cuts = ["brings 7 jars to the old mi", "brings 8 jars to", "brings 9 jars to the old mill near the"]
    texts = whole + [f"Lot {i} is ready. On Monday {n} {c}" for i, (n, c) in enumerate(zip(names, cuts, strict=False))] + ["Lot 5 is ready.\nViele Grüße, Mara"]
    got = {r.doc_id: r.why for r in truncation.truncated(documents(spark, texts)).collect()}
    assert got == {400: "continued", 401: "continued", 402: "continued"}


@pytest.mark.parametrize("parts", [1, 8])
def test_strict_prefixes_equal_brute_force(spark, parts):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    rows = spark.createDataFrame([(t.encode(), t) for t in texts], "digest binary, text string").repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {bytes(r.digest).decode(): r.seam for r in truncation.strict_prefixes(rows).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert set(got) == {t for t in texts if any(u != t and u.startswith(t) for u in texts)}
    assert all(any(u.startswith(seam) for u in texts) for seam in got.values())


TEXTS = [
    None, "", " ", "Hello world, it's 42!", "<|endoftext|> is ordinary", "剩下的物品", "a b c　d​e", "  lead\n\n\n and trail  ", "½ ² Ⅷ café café \U0001f600", "\x00\x1c\x85 odd", "'re 'S don't",
    "word " * 20000, "x" * 5000,
]


def test_encoding_equals_the_vocabulary_s_own(spark):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    own = Tokenizer.from_file(tokenizing.VOCABULARY.replace(".tiktoken", ".json"))
    own.encode_special_tokens = True
    texts = tokenizing.texts_of(documents(spark, TEXTS))
    got = {r.doc_id: r.ids for r in tokenizing.encode(texts).collect()}
    assert got == {i: own.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.tokens for r in tokenizing.token_counts(texts).collect()} == {i: len(x) for i, x in got.items()}
    back = tokenizing.decode(spark.createDataFrame(list(got.items()), "doc_id bigint, ids array<int>"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_repeated_documents_count_once(spark):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "x", 1), (2, None, None)], "doc_id bigint, text string, collected_at int")
    assert sorted(tuple(r) for r in tokenizing.texts_of(rows).collect()) == [(1, "new"), (2, "")]


@pytest.mark.parametrize("seed", range(4))
def test_packing(spark, seed):
    rng = random.Random(seed)
    capacity = 40
    lengths = [rng.choice([0, 1, 2, 3, 39, 40, 41, 80, 81, 200, None, *range(4, 39)]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, tokens bigint")
    got = packing.pack(rows, capacity).collect()
    load, seen = {}, {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        seen.setdefault(r.doc_id, []).append(r)
    assert max(load.values()) <= capacity and len(seen) == len(lengths)
    for doc, n in enumerate(lengths):
        pieces = sorted(seen[doc], key=lambda r: r.piece)
        assert sum(p.n_tokens for p in pieces) == (n or 0)
        assert len(pieces) == 1 or n > capacity
        assert [p.start for p in pieces] == [k * capacity for k in range(len(pieces))]
    total = sum(n or 0 for n in lengths)
    assert len([c for c in load.values() if c]) <= 1.03 * -(-total // capacity) + 1  # half of the items here are longer than half a container
    report = packing.fill_report(packing.pack(rows, capacity), capacity).first()
    assert report.tokens == total and report.unused == report.containers * capacity - total


def test_two_fit_beats_greedy():
    # greedy fills 6 + 3, and 4 takes its place with nothing left open
    assert packing.patterns({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]
    assert packing.patterns({}, 10) == []
