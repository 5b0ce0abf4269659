"""Text functions as Column expressions. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space characters that stripping and splitting know, and the line ends.
WS = r"[\s\x1c-\x1f]"
UNICODE = "(?U)"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\u0085\p{Z}]"
CLOSING = r"[.。,:;]+\z"
SUFFIX = "Let's think step by step."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space at either end, of any of the 29 kinds (the built-in trim knows one)."""
    return F.regexp_replace(text, rf"{UNICODE}\A{WS}+|{WS}+\z", "")


def drop_closing(text: Column) -> Column:
    return F.regexp_replace(text, CLOSING, "")


def collapse(text: Column) -> Column:
    """Stripped, every run of white space one blank, case kept: the key that duplicates share."""
    return F.regexp_replace(strip(text), f"{UNICODE}{WS}+", " ")


def compare_key(text: Column) -> Column:
    """`collapse` in lower case."""
    return F.lower(collapse(text))


def starts_alike(text: Column, prefix: Column) -> Column:
    """Whether `text` begins with `prefix`, both as compare keys."""
    return F.startswith(compare_key(text), compare_key(prefix))


def normalize_text(text: Column, line_endings: bool = True, outer: bool = True, blank_lines: int = 2) -> Column:
    """Line ends as LF, outer white space gone, at most `blank_lines` blank lines in a row (negative: any)."""
    if line_endings:
        text = F.regexp_replace(text, r"\r\n?", "\n")
    if outer:
        text = strip(text)
    if blank_lines >= 0:
        text = F.regexp_replace(text, rf"\n{{{blank_lines + 2},}}", "\n" * (blank_lines + 1))
    return text


def model_input(prompt: Column, suffix: str = SUFFIX) -> Column:
    return F.concat(prompt, F.lit("\n\n" + suffix))


def join_reasoning(steps: Column, tail: Column) -> Column:
    return F.concat(strip(steps), F.lit("\n\n"), strip(tail))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(content: Column, system: str) -> Column:
    """The two opening messages of a conversation."""
    return F.array(message("system", F.lit(system.strip())), message("user", strip(content)))


def assistant(content: Column) -> Column:
    return F.array(message("assistant", strip(content)))


def message_text(messages: Column) -> Column:
    """The contents of all messages, one per line; a null content counts as empty."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def lines(text: Column) -> Column:
    """The stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def tail_lines(text: Column, n: int) -> Column:
    """The last `n` of `lines`, the last one first."""
    return let(lines(text), lambda x: F.reverse(F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n))))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, and every other visible character, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip_answer(text: Column) -> Column:
    """Stripped, closing punctuation gone; '(b)' and 'b' become 'B'."""

    def shaped(s: Column) -> Column:
        inner = F.upper(F.substring(s, 2, 1))
        return F.when(s.rlike(r"(?s)\A\(.\)\z"), inner).when(s.rlike(r"\A\p{L}\z"), F.upper(s)).otherwise(s)

    return let(drop_closing(strip(text)), shaped)


# Fixed values in `abnormal`: 5 characters; 6 lines, 0.5; 60 tokens, 0.35.
def abnormal(text: Column) -> Column:
    """Output that no one would read: under 5 characters, special-token openers or replacement characters,
    six lines or more of which half are one line, or 60 tokens or more with few distinct triples."""

    def repeats(x: Column) -> Column:
        # equal lines stand together once sorted, so one pass finds the most frequent
        start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

        def step(a: Column, line: Column) -> Column:
            run = F.when(line == a["last"], a["run"] + 1).otherwise(1)
            return F.struct(line.alias("last"), run.alias("run"), F.greatest(a["most"], run).alias("most"))

        return (F.size(x) >= 6) & (F.aggregate(F.array_sort(x), start, step)["most"] / F.size(x) >= 0.5)

    def stuck(w: Column) -> Column:
        n = F.size(w) - 2
        triples = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(3)), "\u001f"))
        return (F.size(w) >= 60) & (F.size(F.array_distinct(triples)) / n < 0.35)

    # the costly tests run only where the cheap ones fail
    cheap = (F.length(strip(text)) < 5) | F.contains(text, F.lit("<|")) | F.contains(text, F.lit("\ufffd"))
    return F.when(cheap, True).when(let(lines(text), repeats), True).otherwise(let(tokens(text), stuck))
