"""SQL text handling for the SQL stage: clean-up and a small type-name bridge.

This is a token substitution over a fixed word list, not a SQL parser: text in
quotes and comments is left alone, and the words below are rewritten only where
a type stands: after ``::``, and after the ``AS`` that belongs to an open
``CAST(`` or ``TRY_CAST(``. A column named ``text`` stays a column.
"""

from __future__ import annotations

import re

# Fixed word list: type names of the users' SQL dialect → Spark type names.
TYPE_WORDS = {
    "VARCHAR": "STRING",
    "TEXT": "STRING",
}

_TOKEN = re.compile(
    r"('(?:[^']|'')*')"          # single-quoted literal
    r"|(\"(?:[^\"]|\"\")*\")"    # double-quoted identifier
    r"|(--[^\n]*)"               # line comment
    r"|(/\*.*?\*/)"              # block comment
    r"|([A-Za-z_][A-Za-z0-9_]*)"  # word
    r"|(::|[()])"                 # what a type can follow
    r"|([^\s])",                  # anything else
    re.DOTALL,
)


def clean_sql(text: str) -> str:
    """Drop trailing blanks and any number of trailing semicolons."""
    s = text.rstrip()
    while s.endswith(";"):
        s = s[:-1].rstrip()
    return s


def bridge_sql(text: str) -> str:
    out, done = [], 0
    opened: list[bool] = []        # per open bracket: does it belong to a cast?
    before, type_next = "", False  # the word before this token; does a type follow?
    for m in _TOKEN.finditer(text):
        if m.group(3) or m.group(4):
            continue               # a comment changes nothing
        word, mark = m.group(5), m.group(6)
        if type_next and word and word.upper() in TYPE_WORDS:
            sized = re.match(r"\s*\(", text[m.end():])
            # a length makes it Spark's own VARCHAR(n) / a plain string type
            new = "VARCHAR" if sized and word.upper() == "VARCHAR" else TYPE_WORDS[word.upper()]
            out += [text[done:m.start()], new]
            done = m.end()
        type_next = mark == "::" or bool(word and word.upper() == "AS" and opened and opened[-1])
        if mark == "(":
            opened.append(before in ("CAST", "TRY_CAST"))
        elif mark == ")" and opened:
            opened.pop()
        before = word.upper() if word else ""
    return "".join(out) + text[done:]


def rename_view(text: str, old: str, new: str) -> str:
    """Replace the identifier ``old`` (outside quotes and comments) by ``new``."""
    def repl(m: re.Match) -> str:
        word, quoted = m.group(5), m.group(2)
        if word is not None and word.lower() == old.lower():
            return new
        if quoted is not None and quoted[1:-1].lower() == old.lower():
            return f'"{new}"'
        return m.group(0)

    return _TOKEN.sub(repl, text)


def prepare_sql(text: str) -> str:
    return bridge_sql(clean_sql(text))
