"""A text that every match of a regular expression must contain, for a cheap test before the expression itself."""

from __future__ import annotations

import re

#: Escapes that stand for a class, a place or an earlier group: no text of their own.
_CLASSES = frozenset("dDwWsSbBAzZGhHvVRX123456789")


def required(pattern: str, ascii_only: bool = True) -> str:
    """The longest run of characters that all matches contain; empty where there is none or the pattern is beyond this reading.

    Groups and classes end a run and add nothing; an alternative at the top,
    inline flags and quoted parts give up.  With ``ascii_only`` other characters
    end a run (they may fold into text of another length).
    """
    runs, run, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        literal = ""
        if c == "|":
            return ""
        if c == "(":
            end = _group_end(pattern, at)
            if end < 0:
                return ""
            at = end
        elif c == "[":
            end = _class_end(pattern, at)
            if end < 0:
                return ""
            at = end
        elif c == "\\":
            if at == len(pattern):
                return ""
            escaped = pattern[at]
            at += 1
            if escaped in _CLASSES:
                pass
            elif escaped.isascii() and not escaped.isalnum():
                literal = escaped
            else:
                return ""
        elif c in ".^$":
            pass
        elif c in "*+?{)":
            return ""  # a quantifier of nothing, or an unbalanced end
        elif c.isascii() or not ascii_only:
            literal = c
        quantifier = re.match(r"(?:([*+?])|\{(\d+)(?:,\d*)?\})[+?]?", pattern[at:])
        if quantifier:
            at += quantifier.end()
            # what must be there once ends the run, what may be missing is no part of it
            if literal and (quantifier[1] == "+" or (quantifier[2] and int(quantifier[2]) > 0)):
                run += literal
            runs.append(run)
            run = literal if literal and quantifier[1] == "+" else ""
        elif literal:
            run += literal
        else:
            runs.append(run)
            run = ""
    return max([*runs, run], key=len)


def _class_end(pattern: str, at: int) -> int:
    """Behind the ] of a class that began before ``at``; -1 for nested classes and what is not closed."""
    first = True
    if pattern.startswith("^", at):
        at += 1
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern[at + 1 : at + 2] == "Q":
                return -1
            at += 2
        elif c == "[" or pattern.startswith("&&", at):
            return -1
        elif c == "]" and not first:
            return at + 1
        elif c == "]":
            return -1  # readings differ
        else:
            at += 1
        first = False
    return -1


def _group_end(pattern: str, at: int) -> int:
    """Behind the ) of a group that began before ``at``; -1 for flags and what is not closed."""
    if pattern.startswith("?", at) and not re.match(r"\?(?:[:=!>]|<[=!]|<[A-Za-z])", pattern[at:]):
        return -1
    depth = 1
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "\\":
            if pattern[at : at + 1] == "Q":
                return -1
            at += 1
        elif c == "[":
            at = _class_end(pattern, at)
            if at < 0:
                return -1
        elif c == "(":
            if pattern.startswith("?", at) and not re.match(r"\?(?:[:=!>]|<[=!]|<[A-Za-z])", pattern[at:]):
                return -1
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return at
    return -1
