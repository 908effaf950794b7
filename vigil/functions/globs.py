"""Shell globs as anchored regular expressions for ``rlike`` (the translation has the shape of the standard library's)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _class_char(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def _class(body: str) -> str:
    """A bracket class body (between ``[`` and ``]``) as a regex fragment.
    ``!`` first negates; ``x-y`` is a range and a reversed range matches
    nothing (it is dropped); every other character is literal. A class left
    empty never matches; a negated empty class matches any one character."""
    negate = body.startswith("!")
    if negate:
        body = body[1:]
    items = []
    p = 0
    while p < len(body):
        c = body[p]
        if p + 2 < len(body) and body[p + 1] == "-":
            hi = body[p + 2]
            if c <= hi:
                items.append(_class_char(c) + "-" + _class_char(hi))
            p += 3
        else:
            items.append(_class_char(c))
            p += 1
    if not items:
        return "." if negate else "(?!)"
    return "[" + ("^" if negate else "") + "".join(items) + "]"


def glob_regex(pattern: str) -> str:
    """fnmatch semantics, case-sensitive: ``*`` any run (``/`` included), ``?`` one
    character, ``[...]`` a class with ``[!...]`` negated; anchored at both ends."""
    out = []
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append(r"\[")
            else:
                out.append(_class(pattern[i:j]))
                i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"(?![\s\S])"  # "$" would also match before a final newline


def glob_literals(pattern: str) -> list[str]:
    """The literal runs of a glob: what every match contains, in order. A class is no literal; a
    bracket that never closes is one."""
    runs, i = [""], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 3 if pattern[i + 1:i + 2] == "!" else i + 2) if c == "[" else -1
        if c in "*?" or end > 0:
            runs.append("")
            i = end if end > 0 else i
        else:
            runs[-1] += c
        i += 1
    return [r for r in runs if r]


def glob_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(glob_regex(pattern)), F.lit(False))


def base_name(path: Column) -> Column:
    """Last path segment (what a directory listing of bare names shows)."""
    return F.element_at(F.split(path, "/"), -1)
