"""Checks and rewrites of statement text for what Spark's parser reads differently."""

from __future__ import annotations

import re

TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|\S", re.S)
JOIN_WORDS = {"inner", "left", "right", "full", "outer", "semi", "anti"}
CLAUSES = {"where", "group", "having", "order", "limit", "offset", "union", "intersect", "except", "from", ",", ")", ";"}
AGGREGATES = {"count", "sum", "avg", "min", "max"}


class JoinWithoutCondition(ValueError):
    """A JOIN that is neither CROSS nor NATURAL has no ON or USING."""


def tokens(statement: str) -> list[tuple[str, int, int]]:
    """Words, quoted strings and signs in lower case, with their places; comments are left out."""
    found = ((m[0], m.start(), m.end()) for m in TOKEN.finditer(statement))
    return [(t if t[0] in "'\"`" else t.lower(), a, b) for t, a, b in found if not t.startswith(("--", "/*"))]


def check_joins(statement: str) -> None:
    """Raises if a join that needs a condition has none."""
    open_ = [0]  # joins that wait for their condition, by depth of parentheses
    before: list[str] = []
    for word, *_ in [*tokens(statement), (";", 0, 0)]:
        if word == "(":
            open_.append(0)
        elif word in ("on", "using") and open_[-1]:
            open_[-1] -= 1
        elif word in CLAUSES and open_[-1]:
            raise JoinWithoutCondition("JOIN needs ON or USING; write CROSS JOIN for all pairs")
        elif word == "join":
            kinds = []
            while before and before[-1] in JOIN_WORDS | {"cross", "natural"}:
                kinds.append(before.pop())
            open_[-1] += not {"cross", "natural"} & set(kinds)
        if word == ")" and len(open_) > 1:
            open_.pop()
        before.append(word)


def without_aggregate_order(statement: str) -> str:
    """Drops ORDER BY inside COUNT, SUM, AVG, MIN and MAX, whose results do not depend on it."""
    found, out, done = tokens(statement), [], 0
    calls: list[bool] = []
    drop_from = None
    for i, (word, start, _) in enumerate(found):
        if word == "(":
            calls.append(i > 0 and found[i - 1][0] in AGGREGATES)
        elif word == ")" and calls:
            if drop_from is not None and len(calls) == drop_from[1]:
                out.append(statement[done : drop_from[0]].rstrip())
                done, drop_from = start, None
            calls.pop()
        elif word == "order" and calls and calls[-1] and drop_from is None and found[i + 1][0] == "by":
            drop_from = (start, len(calls))
    return "".join([*out, statement[done:]])
