"""Where a text stops: inside something, or at an end. Shared by problems 4 and 8."""

from __future__ import annotations

import re

# Marks that are put after a cut, closing punctuation, abbreviations that a point belongs to.
CUT_MARK = re.compile(r"(?:\s*(?:\[\s*(?:\.{2,}|…|cut|truncated|continued)\s*\]|\(\s*(?:\.{2,}|…)\s*\)|\.{3,}|…+|⋯))+$", re.I)
CLOSERS = "\"'”’»」』)]}*_`>"
STOPS = ".?!。？！‽؟।"
ABBREVIATIONS = {
    "approx", "resp", "vs", "no", "nr", "etc", "e.g", "i.e", "cf", "ca", "bzw", "z.b", "d.h", "usw", "p.ej", "p.ex", "ej", "fig", "eq", "dr", "mr", "mrs", "ms", "prof", "st", "vol", "incl", "max", "min",
}
# Line forms that are complete without a full stop.
RULE = re.compile(r"^(?:[-=_*~#]{3,}|```.*|\\end\{\w+\}|\\\]|\$\$|</\w+>)$")
BULLET = re.compile(r"^(?:[-*•+]|\d+[.)]|\([a-z0-9]\)|[a-z]\))\s+(.*)$")
NUMBER = r"[-+−]?\d+(?:[.,/]\d+)*"
VALUE = rf"(?:{NUMBER}(?:\s*(?:%|°|[^\W\d_]+))?|\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}}|\$[^$]+\$|\\boxed\{{.*\}}|[A-Z]|[^\W\d_]+)"
RESULT = re.compile(rf"^[\w .()*-]{{0,28}}(?:[:=|]|->|→)\s*\**{VALUE}\**(?:\s*,\s*{VALUE})*$")
BARE = re.compile(rf"^(?:#+\s*)?\**\s*{VALUE}(?:\s*[-+*/=^×·<>]\s*{VALUE})*\s*\**$")
EQUATION = re.compile(r"^[-+*/=^×·<>()\[\]{}\\$%.,\d\s]*(?:[a-zA-Z](?![a-zA-Z])[-+*/=^×·<>()\[\]{}\\$%.,\d\s]*)*$")
# Closings of letters and notes.
CLOSINGS = (
    "best wishes|best regards|kind regards|warm regards|warmest regards|regards|yours|yours truly|yours sincerely|yours faithfully|sincerely|sincerely yours|all the best|best|cheers|thanks|many thanks|with thanks|thank you"
    "|mit freundlichen grüßen|freundliche grüße|viele grüße|liebe grüße|beste grüße|herzliche grüße|schöne grüße|grüße|vielen dank|danke|alles gute|hochachtungsvoll"
    "|saludos|un saludo|saludos cordiales|atentamente|cordialmente|un abrazo|muchas gracias|gracias"
    "|cordialement|bien cordialement|amicalement|bien à vous|salutations|meilleures salutations|sincères salutations|merci|merci beaucoup"
    "|с уважением|с наилучшими пожеланиями|с благодарностью|всего доброго|всего хорошего|спасибо|искренне ваш|искренне ваша"
    "|此致|敬礼|此致敬礼|祝好|谢谢|谨上|顺祝商祺"
)
SIGNED = re.compile(
    r"^(?:[—–/~]\s*\w+(?:\s\w+)?"
    rf"|(?:(?:{CLOSINGS})(?:[,，!]?$|[,，]\s*(?=\w))"
    r"|(?:with thanks to|worked by|written by|checked by|signed):?\s+(?=\w))"
    r"(?:[\w.'-]+(?:\s+[\w.'-]+){0,2})?(?:(?:,| and)\s+[\w.'-]+(?:\s+[\w.'-]+)?){0,3}"
    r"|end of \w+(?: \w+)?)$",
    re.I,
)
CLOSED = re.compile(rf"^(?:{CLOSINGS})[,，!]?\s*\n\s*[^\W\d_][\w.'-]*(?:[ ·][^\W\d_][\w.'-]*){{0,2}}$", re.I | re.M)
SERIES = re.compile(r"(?:\d[\w.]*\s*[,+，、]\s*){3}$")
ANSWER_LABEL = re.compile(r"answer|result|total|choice|option|solution|level|grade|score|status|topic|tag|lang|note", re.I)
NUMBERED = re.compile(r"^\s*\d+[.)]\s+(.*)$", re.M)
SMILE = re.compile(r"[:;]-?[)D(P]$")
# Of display formulas; after two backslashes the bracket belongs to a line break.
DISPLAY_OPEN, DISPLAY_CLOSE = re.compile(r"(?<!\\)\\\["), re.compile(r"(?<!\\)\\\]")
BOXED = re.compile(r"\\boxed\{(?:[^{}]|\{[^{}]*\})*\}\s*(?:\$+|\\\)|\\\])?\s*$")


def _open_inside(text: str, line: str) -> bool:
    """An opened formula, fence, bracket or quote that nothing closes."""
    if text.count("```") % 2:
        return True
    for left, right in (("(", ")"), ("[", "]"), ("{", "}")):
        depth = 0
        for ch in line if left in line else "":
            if ch == left:
                depth += 1
            elif ch == right and depth:
                depth -= 1
        if depth:
            return True
    if text.count("\\begin{") > text.count("\\end{"):
        return True
    if "$$" in text and text.replace("\\$", "").count("$$") % 2 or "\\[" in text and len(DISPLAY_OPEN.findall(text)) > len(DISPLAY_CLOSE.findall(text)):
        return True
    bare = line.replace("\\$", "")
    if bare.replace("$$", "").count("$") % 2:
        return True
    if line.count("\\(") > line.count("\\)") or line.count("\\[") > line.count("\\]"):
        return True
    return line.count("**") % 2 == 1 or line.count("“") > line.count("”") or line.count("「") > line.count("」") or (line.count('"') % 2 == 1 and not re.search(r'\d"', line))


def stripped(text: str) -> str:
    """Without white space, visible or not, at the end."""
    while text and (text[-1].isspace() or text[-1] in "\u200b\ufeff"):
        text = text.rstrip().rstrip("\u200b\ufeff")
    return text


def last_line(text: str) -> str:
    return text.rstrip().rsplit("\n", 1)[-1].strip()


def unfinished(text: str) -> bool:
    """Whether `text` stops inside a word, number, formula or sentence. Blank texts don't.

    A mark put after the cut doesn't complete a text; a series that is meant to go on ('2, 4, 8, ...') is
    complete. Results, list items, signatures, closing lines, code and table rows need no full stop.
    """
    text = stripped(text)
    if not text:
        return False
    marked = CUT_MARK.search(text, max(0, len(text) - 40)) if text[-1] in ".…⋯])" else None
    if marked:
        text = text[: marked.start()].rstrip()
        if not text or SERIES.search(text):
            return not text
    line = last_line(text)
    if _open_inside(text, line):
        return True
    if RULE.match(line):
        return False
    if line.startswith("|"):
        return not line.endswith("|")
    if BOXED.search(line) or SMILE.search(line):
        return False
    bullet = BULLET.match(line)
    bare = line.rstrip(CLOSERS + " ")
    if bare and bare[-1] in STOPS:
        word = re.search(r"(\S+)[.]$", bare)
        if word and bare == line:
            said = word.group(1).lstrip("([\"'").lower()
            if said in ABBREVIATIONS:
                return True
            if re.fullmatch(r"\d+|[a-z]", said) and bare == word.group(0):
                return True  # only the number of a list item
        return False
    if marked:
        return True
    if bullet:
        line = bullet.group(1)
        if not line or line[-1] in ":,;-=":
            return True
        if not line[0].isupper() and len(line.split()) <= 8:
            return False
        if line[0].isupper() and any(len(x.split()) > 4 for x in NUMBERED.findall(text)[:-1]):
            return True  # the other items are sentences
    if line[-1] in ":,;-=+*/(<^、，；：" and not SIGNED.match(line) and not re.fullmatch(r"\*\*.*\*\*", line):
        return True
    if re.fullmatch(r"[\[(].*[\])]", line) or re.fullmatch(r"\*\*.*\*\*|\$\$.*\$\$|\\\[.*\\\]", line):
        return False
    if any(m.end() == len(text) for m in CLOSED.finditer(text, max(0, len(text) - 120))):
        return False  # a name below a closing
    if SIGNED.match(line):
        # a name cut short: the text has it in full before
        name = re.search(r"[^\W\d_]+$", line)
        return bool(name and re.search(rf"\b{name.group(0)}\w", text) and not re.search(rf"\b{name.group(0)}\b", text[: -len(line)]))
    if RESULT.match(line):
        # 'Name: What' is the start of a turn, 'Level: hard' and 'Answer: B' are results
        label, value = re.match(r"^(.*?)\s*(?:[:=|]|->|→)\s*\**(.*)$", line).groups()
        return bool(re.match(r"[A-Z]", value)) and not ANSWER_LABEL.search(label)
    if re.fullmatch(r"[^\W\d_]{2,}", line) and line != text.strip():
        return True  # the first word of another line
    return not (BARE.match(line) or EQUATION.match(line) or re.fullmatch(r"Keywords?:.*\w", line))
