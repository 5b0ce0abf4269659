"""Final answers of worked solutions: extraction, normal form and equivalence, as Column expressions."""

from __future__ import annotations

import sys
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import UNICODE, WS, drop_closing, let, message_text, strip, strip_answer, tail_lines

# The forms of answers. D is a signed integer.
D = r"[-+]?\d+"
FRAC = rf"\\d?frac\{{{D}\}}\{{{D}\}}"
SLASH = rf"{D}{WS}*/{WS}*{D}"
REAL = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)"
SIMPLE = r"[-+]?\d+(?:\.\d+)?"
HASHES = rf"{UNICODE}####{WS}*([^\n]+)"
LABEL = rf"(?:final{WS}+answer|correct{WS}+answer|answer){WS}*"
LABEL_LINE = rf"(?iU){LABEL}(?:(?:is)?{WS}*:|is|=){WS}*(.+)\z"
LABEL_LOOSE = rf"(?isU){LABEL}(?:(?:is)?{WS}*:|is|=)?{WS}*(?:\\boxed\{{)?{WS}*(\(?[A-E]\)?|{SIMPLE}(?:\\?%)?|{SLASH}|{FRAC})"
LINE_CHOICE = r"\A\(?[A-E]\)?\z"
LINE_NUMBER = rf"{UNICODE}\A(?:{FRAC}|{SLASH}|{SIMPLE}(?:\\?%)?)\z"
TAIL_NUMBER = rf"{UNICODE}\\frac\{{{D}\}}\{{{D}\}}|{SLASH}|{SIMPLE}"
CHOICE = r"\A\(?([A-Ea-e])\)?\z"
ASSIGNED = rf"(?Ud)\A[A-Za-z]{WS}*={WS}*(.+)\z"
WITH_UNIT = rf"{UNICODE}\A{WS}*({FRAC}|{SLASH}|{REAL}{WS}*%?){WS}*(?:[A-Za-z°²³^/\\{{}}\-\s\x1c-\x1f]+)?{WS}*\z"
EMBEDDED = rf"{UNICODE}{FRAC}|{SLASH}|{REAL}{WS}*%?"
OPTION_LINES = rf"(?imsU)(?:^|\n){WS}*\(?([A-E])\)?[.):]{WS}*(.+?)(?=(?:\n{WS}*\(?[A-E]\)?[.):])|\z)"
OPTION_INLINE = rf"(?iU)\b([A-E])[.)]{WS}*([^A-E\n]+?)(?={WS}+[A-E][.)]|\z)"
WEAK_METHODS = ("tail_number", "not_found", "truncated_no_final_answer")
LABELED_LINES, CLOSING_LINES, TAIL = 5, 3, 500


def _balanced(depth: int) -> str:
    """Text with balanced braces down to `depth`; possessive, so a match never backtracks or recurses."""
    body = r"[^{}]*+"
    for _ in range(depth):
        body = rf"[^{{}}]*+(?:\{{{body}\}}[^{{}}]*+)*+"
    return body


DEPTH = 24
# a lookahead, so that boxes inside boxes are found too
BOXED = rf"\\(?:boxed|fbox)\{{(?=({_balanced(DEPTH)})\}})"
BOX_START = r"\\(?:boxed|fbox)\{"


def _deep(text: Column) -> Column:
    """Whether braces nest deeper than DEPTH: without all groups of that depth or less a pair is left."""
    braces = F.regexp_replace(F.regexp_replace(text, r"[^{}]+", ""), rf"\{{{_balanced(DEPTH - 1)}\}}", "")
    return F.contains(braces, F.lit("{}"))


def _deep_box(text: Column) -> Column:
    """The same content as BOXED finds, at any depth, character by character."""
    tails = F.split(text, BOX_START)

    def from_start(i: Column) -> Column:
        # what follows the i-th start, its further starts written again so that their braces count
        tail = F.array_join(F.slice(tails, i + 1, F.size(tails)), "\\boxed{")
        step = lambda a, c: F.when(a["open"] == 0, a).otherwise(F.struct((a["open"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("open"), (a["n"] + 1).alias("n")))
        return let(F.aggregate(F.split(tail, ""), F.struct(F.lit(1).alias("open"), F.lit(0).alias("n")), step), lambda a: F.when(a["open"] == 0, F.substring(tail, F.lit(1), a["n"] - 1)))

    starts = F.when(F.size(tails) > 1, F.sequence(F.size(tails) - 1, F.lit(1), F.lit(-1)))
    return F.get(F.filter(F.transform(starts, from_start), lambda x: x.isNotNull()), 0)


def boxed(text: Column) -> Column:
    """Content of the last box whose braces balance, as a stripped answer; null if none or empty."""
    usual = F.try_element_at(F.regexp_extract_all(text, F.lit(BOXED), F.lit(1)), F.lit(-1))
    found = F.when(_deep(text), _deep_box(text)).otherwise(usual)
    return F.when(F.contains(text, F.lit("box{")) | F.contains(text, F.lit("boxed{")), F.nullif(strip_answer(found), F.lit("")))


def _last(text: Column, pattern: str, group: int) -> Column:
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))
    return F.nullif(strip_answer(found), F.lit(""))


def _labeled_line(text: Column) -> Column:
    def one(line: Column) -> Column:
        def unwrapped(answer: Column) -> Column:
            inner = strip(F.regexp_replace(F.coalesce(boxed(answer), answer), r"(?d)\A\\boxed\{(.+)\}\z", "$1"))
            return F.nullif(inner, F.lit(""))

        return F.when(line.rlike(LABEL_LINE), let(strip_answer(F.regexp_extract(line, LABEL_LINE, 1)), unwrapped))

    return F.get(F.filter(F.transform(tail_lines(text, LABELED_LINES), one), lambda x: x.isNotNull()), 0)


def _found(answer: Column, method: str) -> Column:
    return F.when(answer.isNotNull(), F.struct(answer.alias("answer"), F.lit(method).alias("method")))


def _step(value: Column, method: str) -> Column:
    return let(value, lambda x: _found(x, method))


def _closing_line(text: Column) -> Column:
    def one(line: Column) -> Column:
        return let(
            strip_answer(line),
            lambda x: F.when(x.rlike(LINE_CHOICE), F.struct(x.alias("answer"), F.lit("final_line_choice").alias("method"))).when(
                x.rlike(LINE_NUMBER), F.struct(x.alias("answer"), F.lit("final_line_numeric").alias("method"))
            ),
        )

    return F.get(F.filter(F.transform(tail_lines(text, CLOSING_LINES), one), lambda x: x.isNotNull()), 0)


def extract_answer(text: Column, finish: Column | None = None) -> Column:
    """struct(answer, method): the first of an ordered series of rules that finds a final answer.

    Where generation stopped for length (`finish` is 'length'), a number on the last lines or in the tail
    doesn't count. Null text gives not_found.
    """
    finish = F.lit("eos") if finish is None else finish
    cut = F.coalesce(finish == "length", F.lit(False))
    none = lambda method: F.struct(F.lit(None).cast("string").alias("answer"), F.lit(method).alias("method"))
    closing = let(_closing_line(text), lambda x: F.when(~cut | (x["method"] == "final_line_choice"), x))
    return F.coalesce(
        _step(boxed(text), "boxed"),
        _step(_last(text, HASHES, 1), "hash_answer"),
        _step(_labeled_line(text), "labeled_answer_line"),
        _step(_last(text, LABEL_LOOSE, 1), "labeled_answer"),
        closing,
        F.when(cut, none("truncated_no_final_answer")),
        _step(_last(F.right(text, F.lit(TAIL)), TAIL_NUMBER, 0), "tail_number"),
        none("not_found"),
    )


def gold_answer(answer: Column, trajectory: Column) -> Column:
    """struct(answer, source, method) of the reference: the given answer, else the one its solution ends with,
    else the whole solution."""
    given = strip(answer)

    def from_text(x: Column) -> Column:
        return F.struct(
            F.coalesce(x["answer"], trajectory).alias("answer"),
            F.lit("reference_answer").alias("source"),
            F.when(x["answer"].isNull(), "full_reference_fallback").otherwise(x["method"]).alias("method"),
        )

    direct = F.struct(given.alias("answer"), F.lit("metadata.answer").alias("source"), F.lit("metadata_answer").alias("method"))
    return F.when(given != "", direct).otherwise(let(extract_answer(trajectory), from_text))


# --- exact numbers -----------------------------------------------------------------------------------
# Inside expressions a number is a struct of two integer texts p and q, which stand for p / q and aren't in
# lowest terms; t is the text of what is no fraction. Comparisons multiply crosswise. Only what is shown is
# brought to lowest terms, and only numbers too long for decimals are compared outside the JVM, in Arrow batches.

LONGEST = 18


def _number(p: Column, q: Column) -> Column:
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, r"\A\+", ""), r"\A(-?)0+(?=\d)", "$1")
    return F.when(~q.rlike(r"\A[-+]?0+\z"), F.struct(bare(p).alias("p"), bare(q).alias("q"), F.lit(None).cast("string").alias("t")))


def _as_text(t: Column) -> Column:
    """A whole number as p / 1, so that it equals fractions of that value; any other text as it is."""
    none = F.lit(None).cast("string")
    whole = t.rlike(r"\A-?\d+\z")
    return F.when(t.isNotNull(), F.struct(F.when(whole, t).otherwise(none).alias("p"), F.when(whole, "1").alias("q"), t.alias("t")))


def _is_long(x: Column) -> Column:
    return F.coalesce(F.greatest(F.length(x["p"]), F.length(x["q"])) > LONGEST, F.lit(False))


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a["p"].alias("p1"), a["q"].alias("q1"), a["t"].alias("t1"), b["p"].alias("p2"), b["q"].alias("q2"), b["t"].alias("t2"))


def _same_short(a: Column, b: Column) -> Column:
    """Whether two numbers are equal, crosswise; texts as they stand. Null if either is null or too long."""
    longest = F.greatest(*[F.length(x[f]) for x in (a, b) for f in ("p", "q")])

    def equal(kind: str) -> Column:
        whole = lambda v: v.try_cast(kind)
        return whole(a["p"]) * whole(b["q"]) == whole(b["p"]) * whole(a["q"])

    fractions = a["p"].isNotNull() & b["p"].isNotNull()
    return F.when(~fractions, a["t"] == b["t"]).when(longest <= LONGEST // 2, equal("bigint")).when(longest <= LONGEST, equal(f"decimal({LONGEST},0)"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _same_long(pairs: pd.Series) -> pd.Series:
    """The same for pairs whose terms are too long, with whole numbers of any length."""

    def equal(x):
        return x["t1"] is not None and x["t1"] == x["t2"] if x["p1"] is None or x["p2"] is None else int(x["p1"]) * int(x["q2"]) == int(x["p2"]) * int(x["q1"])

    sys.set_int_max_str_digits(0)
    return pairs.map(lambda row: None if row is None else [None if x is None else equal(x) for x in row])


@F.pandas_udf(T.StringType())
def _shown(number: pd.DataFrame) -> pd.Series:
    """The text of a number in lowest terms, 'p/q' or 'p'; t where it is no fraction."""
    p, q, out = number["p"], number["q"], number["t"].copy()
    some = p.notna()
    short = some & (p.str.len() <= LONGEST) & (q.str.len() <= LONGEST)
    if short.any():
        a, b = p[short].to_numpy().astype(np.int64), q[short].to_numpy().astype(np.int64)
        g = np.gcd(a, b) * np.sign(b)
        out[short] = [f"{x}/{y}" if y != 1 else str(x) for x, y in zip((a // g).tolist(), (b // g).tolist(), strict=True)]
    if (some & ~short).any():
        sys.set_int_max_str_digits(0)
        out[some & ~short] = [str(Fraction(int(x), int(y))) for x, y in zip(p[some & ~short], q[some & ~short], strict=True)]
    return out


def _plain_decimal(text: Column) -> Column:
    """A decimal text without sign +, leading zeros, trailing zeros or a bare point; -0 is 0."""
    x = F.regexp_replace(text, r"\A\+", "")
    x = F.regexp_replace(x, r"\A(-?)(?=\.)", "$10")
    x = F.when(F.contains(x, F.lit(".")), F.regexp_replace(F.regexp_replace(x, r"0+\z", ""), r"\.\z", "")).otherwise(x)
    x = F.regexp_replace(x, r"\A(-?)0+(?=\d)", "$1")
    return F.when(x == "-0", "0").otherwise(x)


def with_normal(rows: DataFrame, **answers: Column) -> DataFrame:
    """`rows` with the normal forms of `answers` by name, for exact match: choice letter, fraction in lowest
    terms, plain decimal, or the text without white space; null if nothing is left."""
    return _with_shown(rows, {k: _normal(v) for k, v in answers.items()})


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with `columns`, each computed once: the optimizer merges nothing across a generator, so later
    stages don't repeat them, and Python functions, which can't take nested lambdas, get plain columns."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _with_shown(rows: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    made = once(rows, **{f"_{k}": v for k, v in numbers.items()})
    return made.withColumns({k: _shown(F.col(f"_{k}")) for k in numbers}).drop(*[f"_{k}" for k in numbers])


def _normal(answer: Column) -> Column:
    bare = drop_closing(F.replace(F.replace(F.replace(strip(answer), F.lit("\\("), F.lit("")), F.lit("\\)"), F.lit("")), F.lit("$"), F.lit("")))

    def shaped(x: Column) -> Column:
        value = F.when(x.rlike(ASSIGNED), strip(F.regexp_extract(x, ASSIGNED, 1))).otherwise(x)
        choice = F.when(x.rlike(CHOICE), F.upper(F.regexp_extract(x, CHOICE, 1)))
        return F.when(x != "", F.coalesce(_as_text(choice), let(value, _number_or_text)))

    return let(let(bare, lambda x: F.coalesce(boxed(x), x)), shaped)


def _number_or_text(value: Column) -> Column:
    tight = F.regexp_replace(value, f"{UNICODE}{WS}+", "")
    latex, slash = rf"{UNICODE}\A\\d?frac\{{({D})\}}\{{({D})\}}\z", rf"{UNICODE}\A({D})/({D})\z"
    fraction = let(
        tight,
        lambda x: F.when(x.rlike(latex), _number(F.regexp_extract(x, latex, 1), F.regexp_extract(x, latex, 2))).when(
            x.rlike(slash), _number(F.regexp_extract(x, slash, 1), F.regexp_extract(x, slash, 2))
        ),
    )
    decimal = let(F.replace(strip(value), F.lit(","), F.lit("")), lambda x: F.when(x.rlike(rf"{UNICODE}\A{SIMPLE}\z"), _plain_decimal(x)))
    text = F.replace(F.replace(tight, F.lit("\\left"), F.lit("")), F.lit("\\right"), F.lit(""))
    return F.coalesce(fraction, _as_text(F.coalesce(decimal, text)))


def clean_math(value: Column) -> Column:
    """Unboxed, without \\text{...}, dollars, sizing commands, commas and closing punctuation."""
    x = let(strip(value), lambda s: F.coalesce(boxed(s), s))
    x = F.regexp_replace(x, r"\\text\{[^{}]*\}", "")
    for old, new in (("\\%", "%"), ("\\$", ""), ("\\(", ""), ("\\)", ""), ("$", ""), ("\\left", ""), ("\\right", ""), (",", "")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return drop_closing(strip(x))


def strip_unit(value: Column) -> Column:
    """The number of 'number and unit'; other texts cleaned only; null gives the empty text."""
    return F.coalesce(let(clean_math(value), _unitless), F.lit(""))


def _unitless(clean: Column) -> Column:
    return F.when(clean.rlike(WITH_UNIT), F.regexp_replace(strip(F.regexp_extract(clean, WITH_UNIT, 1)), rf"{UNICODE}{WS}+%", "%")).otherwise(clean)


def with_rational(rows: DataFrame, **answers: Column) -> DataFrame:
    """`rows` with the exact values of `answers` by name, as 'p/q' or 'p' in lowest terms, percent as
    hundredths; null if it is no number."""
    return _with_shown(rows, {k: _rational(v) for k, v in answers.items()})


def _rational(value: Column) -> Column:
    return _value(strip_unit(value))


def _value(bare: Column) -> Column:
    """The number that a text without unit is."""

    def of(x: Column) -> Column:
        percent = F.endswith(x, F.lit("%"))
        body = F.when(percent, strip(F.regexp_replace(x, r"%\z", ""))).otherwise(x)
        return let(F.struct(percent.alias("percent"), body.alias("body")), lambda s: _exact(s["body"], s["percent"]))

    def assigned(x: Column) -> Column:
        return F.when(x.rlike(ASSIGNED), strip(F.regexp_extract(x, ASSIGNED, 1))).otherwise(x)

    return let(let(clean_math(bare), assigned), of)


def _exact(body: Column, percent: Column) -> Column:
    latex, slash = rf"{UNICODE}\A\\d?frac\{{({D})\}}\{{({D})\}}\z", rf"{UNICODE}\A({D}){WS}*/{WS}*({D})\z"
    hundred = F.when(percent, "00").otherwise("")
    fraction = lambda p: _number(F.regexp_extract(body, p, 1), F.concat(F.regexp_extract(body, p, 2), hundred))

    def decimal(x: Column) -> Column:
        places = F.length(F.regexp_extract(x, r"\.(\d*)\z", 1)) + F.length(hundred)
        return _number(F.replace(x, F.lit("."), F.lit("")), F.concat(F.lit("1"), F.repeat(F.lit("0"), places)))

    return (
        F.when(body.rlike(latex), fraction(latex)).when(body.rlike(slash), fraction(slash)).when(body.rlike(rf"{UNICODE}\A{REAL}\z"), let(_plain_decimal(body), decimal))
    )


def _shown_percent(clean: Column) -> Column:
    """The number in front of a closing percent sign of a cleaned text."""
    body = strip(F.regexp_replace(clean, r"%\z", ""))
    return F.when(F.endswith(clean, F.lit("%")), let(body, lambda b: F.when(b.rlike(rf"{UNICODE}\A{REAL}\z"), _exact(b, F.lit(False)))))


def _embedded(value: Column) -> Column:
    """The text of the one number that a text holds; null if it holds none or several."""
    return let(F.regexp_extract_all(clean_math(value), F.lit(EMBEDDED), F.lit(0)), lambda m: F.when(F.size(m) == 1, F.get(m, 0)))


def _reading(value: Column) -> Column:
    """struct(n, q, u, s): normal form, exact value, normal form without unit, number shown before a percent sign."""
    none = F.lit(None).cast("struct<p:string,q:string,t:string>")

    def plain(x: Column) -> Column:
        n, q = _as_text(x), _exact(x, F.lit(False))
        return F.struct(n.alias("n"), q.alias("q"), n.alias("u"), none.alias("s"))

    # a number and nothing else needs none of the rules
    return F.when(value.rlike(r"\A-?\d+(?:\.\d+)?\z"), let(_plain_decimal(value), plain)).otherwise(_any_reading(value))


def _any_reading(value: Column) -> Column:
    def of(x: Column) -> Column:
        # most answers carry no unit, so their normal form is the one without
        unitless = F.when(x["unitless"] == x["value"], x["n"]).otherwise(_normal(F.nullif(x["unitless"], F.lit(""))))
        q = F.when(x["unitless"].rlike(r"\d"), _value(x["unitless"]))
        return F.struct(x["n"].alias("n"), q.alias("q"), unitless.alias("u"), _shown_percent(x["clean"]).alias("s"))

    parts = lambda c: F.struct(value.alias("value"), c.alias("clean"), F.coalesce(_unitless(c), F.lit("")).alias("unitless"), _normal(value).alias("n"))
    return let(let(clean_math(value), parts), of)


def choice_options(prompt: Column) -> Column:
    """Map of letter to text of the options a prompt offers, one per line, else in one line; later ones win."""

    def of(pattern: str) -> Column:
        letters = F.transform(F.regexp_extract_all(prompt, F.lit(pattern), F.lit(1)), F.upper)
        texts = F.transform(F.regexp_extract_all(prompt, F.lit(pattern), F.lit(2)), lambda t: drop_closing(strip(t)))
        pairs = F.filter(F.arrays_zip(letters.alias("k"), texts.alias("v")), lambda e: e["v"] != "")
        # the last of a letter's entries; building the map from the array would need a session setting
        return F.filter(
            F.transform(F.array(*[F.lit(c) for c in "ABCDE"]), lambda c: F.try_element_at(F.filter(pairs, lambda e: e["k"] == c), F.lit(-1))),
            lambda e: e.isNotNull(),
        )

    return let(of(OPTION_LINES), lambda x: F.map_from_entries(F.when(F.size(x) > 0, x).otherwise(of(OPTION_INLINE))))


#: What is compared, as (text, reading) on both sides. Texts: predicted, reference, the options that these
#: name, and the one number inside the predicted one. Readings: normal form, exact value, normal form without
#: unit, number shown before a percent sign.
PAIRS = {
    "value": ((0, "q"), (1, "q")), "percent": ((0, "s"), (1, "q")), "of_percent": ((1, "s"), (0, "q")), "inside": ((4, "q"), (1, "q")), "unit": ((0, "u"), (1, "u")),
    "shown_n": ((2, "n"), (1, "n")), "shown_q": ((2, "q"), (1, "q")), "shown_u": ((2, "u"), (1, "u")), "meant_n": ((0, "n"), (3, "n")), "meant_q": ((0, "q"), (3, "q")), "meant_u": ((0, "u"), (3, "u")),
}


def compare_answers(rows: DataFrame, name: str, predicted: Column, reference: Column, prompt: Column, strict: Column) -> DataFrame:
    """`rows` with `name`, a struct(equal, method): whether two answers mean the same, by the first rule that
    says so.

    `strict` tells that their normal forms are equal. Null predictions equal nothing; a null prompt offers
    no options and names no percent. Texts are read once, in a stage of their own.
    """
    asked = F.coalesce(prompt, F.lit(""))
    letter = lambda v: F.nullif(F.upper(F.regexp_extract(strip(v), CHOICE, 1)), F.lit(""))
    options = F.when(asked.rlike(r"[A-Ea-e][.):]"), choice_options(asked))
    texts = let(
        F.struct(predicted.alias("p"), reference.alias("r"), options.alias("o")),
        lambda x: F.array(x["p"], x["r"], F.try_element_at(x["o"], letter(x["p"])), F.try_element_at(x["o"], letter(x["r"])), _embedded(x["p"])),
    )
    # once the answers are strictly equal, or one is missing, nothing needs to be read
    open_ = ~F.coalesce(strict, F.lit(False)) & predicted.isNotNull()
    kept = rows.columns
    told = once(rows, _texts=F.when(open_, texts), _strict=F.coalesce(strict, F.lit(False)), _missing=predicted.isNull(), _percent=F.lower(asked).rlike("percent|%"))
    read = once(told, _read=F.transform("_texts", lambda t: F.when(t.isNotNull(), _reading(t))))
    side = lambda at: F.get("_read", at[0])[at[1]]
    any_long = F.exists("_read", lambda t: _is_long(t["n"]) | _is_long(t["q"]) | _is_long(t["u"]) | _is_long(t["s"]))
    pairs = F.array(*[F.when(side(a).isNotNull() & side(b).isNotNull(), _pair(side(a), side(b))) for a, b in PAIRS.values()])
    judged = read.withColumn("_pairs", F.when(any_long, pairs)).withColumn("_long", _same_long("_pairs"))
    same = {k: F.coalesce(F.get("_long", i), _same_short(side(a), side(b)), F.lit(False)) for i, (k, (a, b)) in enumerate(PAIRS.items())}
    method = (
        F.when(F.col("_missing"), "no_prediction")
        .when(F.col("_strict"), "strict_exact")
        .when(same["value"], "numeric_equivalent")
        .when(F.col("_percent") & (same["percent"] | same["of_percent"]), "percent_context_equivalent")
        .when(same["inside"], "embedded_numeric_equivalent")
        .when(same["unit"], "unit_stripped_exact")
        .when(same["shown_n"] | same["shown_q"] | same["shown_u"], "choice_letter_to_content")
        .when(same["meant_n"] | same["meant_q"] | same["meant_u"], "choice_content_to_letter")
        .otherwise("none")
    )
    told = judged.withColumn("_method", method)
    return told.withColumn(name, F.struct((~F.col("_method").isin("no_prediction", "none")).alias("equal"), F.col("_method").alias("method"))).select(*kept, name)


def match_text(messages: Column) -> Column:
    """What the comparison reads of a prompt."""
    return message_text(messages)


def finish_reason(ids: Column, stops: list[int], pad: int | None, most: int) -> Column:
    """struct(ids, reason, hit_max): cut at the first stop id ('eos'), else trailing pads go ('length')."""
    limited = F.slice(ids, F.lit(1), F.lit(most))
    stop = F.array(*[F.lit(s) for s in stops])

    def cut(x: Column) -> Column:
        hits = F.filter(F.transform(x, lambda v, i: F.when(F.array_contains(stop, v), i)), lambda i: i.isNotNull())
        if pad is None or pad in stops:
            last = F.size(x)
        else:
            last = F.coalesce(F.array_max(F.transform(x, lambda v, i: F.when(v != pad, i + 1).otherwise(0))), F.lit(0))
        kept = let(hits, lambda h: F.when(F.size(h) > 0, F.slice(x, F.lit(1), F.get(h, 0))).otherwise(F.slice(x, F.lit(1), last)))
        reason = F.when(F.size(hits) > 0, "eos").otherwise("length")
        return let(
            F.struct(kept.alias("ids"), reason.alias("reason")),
            lambda y: F.struct(y["ids"].alias("ids"), y["reason"].alias("reason"), ((y["reason"] == "length") & (F.size(y["ids"]) >= most)).alias("hit_max")),
        )

    return let(limited, cut)
