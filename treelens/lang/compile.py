"""Alternatives of terms and filters to one Column over name, folded (the name in lower case), ext, path, is_dir, size and modified."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRegex
from ..schema import is_ascii
from .filters import Filter, Group, Range
from .literal import required
from .parser import Term

# One character of a wildcard: anything but the line ends of the pattern language.
_ANY = r"[^\n\r\u000B\u000C\u0085  ]"
_EDGE = r"[\p{L}\p{N}_]"


def quoted(text: str) -> str:
    """``text`` as a literal of a Java regular expression."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-&~#\s])", lambda m: "\\" + m[1] if not m[1].isspace() else f"\\x{{{ord(m[1]):x}}}", text)


def glob(text: str, any_char: str = _ANY) -> str:
    body = "".join(f"{any_char}*" if c == "*" else any_char if c == "?" else quoted(c) for c in text)
    return rf"\A{body}\z"


def word(text: str) -> str:
    return f"(?<!{_EDGE}){quoted(text)}(?!{_EDGE})"


def regex(pattern: str, match_case: bool) -> str:
    """Folds case as Unicode does: K matches the Kelvin sign."""
    return pattern if match_case else f"(?iu){pattern}"


def check_regex(spark: SparkSession, pattern: str) -> None:
    """Raises before any work if ``pattern`` does not compile."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise InvalidRegex(f"Invalid regular expression: {pattern}") from e


def _literal(on_path: bool, text: str, match_case: bool) -> Column:
    if match_case:
        return F.col("path" if on_path else "name").contains(text)
    return (F.lower("path") if on_path else F.col("folded")).contains(text.lower())


def regex_column(pattern: str, match_case: bool, on_path: bool) -> Column:
    """Whether ``pattern`` is found.  A text that all its matches contain is looked for first, which most rows fail.

    Where case does not count, names beyond ASCII go to the pattern at once:
    some of their characters match ASCII letters that lower case does not give.
    """
    target = F.col("path" if on_path else "name")
    found = target.rlike(regex(pattern, match_case))
    text = required(pattern, ascii_only=not match_case)
    if not text:
        return found
    first = _literal(on_path, text, match_case)
    return (first if match_case else first | ~is_ascii(target)) & found


#: Line ends, which a wildcard does not pass.
_LINE_ENDS = r"[\n\r\u000B\u000C\u0085\u2028\u2029]"


def wildcard_column(text: str, match_case: bool, on_path: bool) -> Column:
    """``*x``, ``x*`` and ``*x*`` by the built-in tests of ends and parts, other wildcards by a pattern.

    Names beyond ASCII always go to the pattern, as in ``regex_column``.
    """
    target = F.col("path" if on_path else "name")
    found = target.rlike(regex(glob(text), match_case))
    core = text.strip("*")
    if not core or "*" in core or "?" in core or not core.isascii():
        return found
    seen = target if match_case else F.lower("path") if on_path else F.col("folded")
    core = core if match_case else core.lower()
    if text.startswith("*") and text.endswith("*"):
        quick = seen.contains(core)
    elif text.startswith("*"):
        quick = seen.endswith(core)
    else:
        quick = seen.startswith(core)
    return F.when(is_ascii(target), quick & ~target.rlike(_LINE_ENDS)).otherwise(found)


def term_column(term: Term, match_case: bool, whole_word: bool, match_path: bool) -> Column:
    on_path = match_path or term.has_slash
    target = F.col("path") if on_path else F.col("name")
    if term.wild:
        found = wildcard_column(term.text, match_case, on_path)
    elif on_path and term.is_prefix:
        found = target.startswith(term.text) if match_case else F.lower(target).startswith(term.text.lower())
    elif whole_word:
        # the substring test is cheap and true wherever the pattern is, for text that folds without surprises
        found = target.rlike(regex(word(term.text), match_case))
        if term.text.isascii() and match_case:
            found = _literal(on_path, term.text, True) & found
    else:
        found = _literal(on_path, term.text, match_case)
    return ~found if term.negated else found


def range_column(value: Column, r: Range) -> Column:
    """Whole numbers within the bounds, compared as such, so that the scan can skip by them; infinite bounds not at all."""
    parts = []
    if math.isfinite(r.low):
        parts.append(value >= F.lit(math.ceil(r.low) if r.with_low else math.floor(r.low) + 1).cast("long"))
    if math.isfinite(r.high):
        parts.append(value <= F.lit(math.floor(r.high) if r.with_high else math.ceil(r.high) - 1).cast("long"))
    inside = reduce(and_, parts) if parts else F.lit(True)
    return ~inside if r.inverted else inside


def within(path: Column, folder: str, recursive: bool, match_case: bool) -> Column:
    """Strictly below ``folder``; not recursive: one level below."""
    target = path if match_case else F.lower(path)
    head = "/" if folder == "/" else (folder if match_case else folder.lower()) + "/"
    below = target.startswith(head) & (F.length(target) > len(head))
    return below if recursive else below & (F.locate("/", target, len(head) + 1) == 0)


def filter_column(f: Filter, match_case: bool) -> Column:
    if f.kind == "directory":
        found = F.col("is_dir") if f.value else ~F.col("is_dir")
    elif f.kind == "extensions":
        found = ~F.col("is_dir") & F.col("ext").isin(*sorted(f.value))
    elif f.kind == "size":
        found = ~F.col("is_dir") & range_column(F.col("size"), f.value)
    elif f.kind == "modified":
        found = range_column(F.col("modified"), f.value)
    elif f.kind == "scope":
        found = within(F.col("path"), f.value[0], f.value[1], match_case)
    else:
        found = reduce(or_, [within(F.col("path"), p, True, match_case) for p in f.value])
    return ~found if f.negated else found


_COST = {"directory": 0, "size": 0, "modified": 0, "extensions": 1, "scope": 2, "locations": 3}


def group_column(group: Group, match_case: bool, whole_word: bool, match_path: bool) -> Column:
    """Cheap tests first: metadata, literals by falling length, then patterns."""
    filters = [filter_column(f, match_case) for f in sorted(group.filters, key=lambda f: _COST[f.kind])]
    terms = sorted(group.terms, key=lambda t: (t.wild or whole_word, t.negated, -len(t.text)))
    parts = filters + [term_column(t, match_case, whole_word, match_path) for t in terms]
    return reduce(and_, parts) if parts else F.lit(True)


def predicate(groups: list[Group], match_case: bool = False, whole_word: bool = False, match_path: bool = False) -> Column:
    return reduce(or_, [group_column(g, match_case, whole_word, match_path) for g in groups])


def needs_path(groups: list[Group], match_path: bool) -> bool:
    return any((match_path and g.terms) or any(t.has_slash for t in g.terms) or any(f.kind in ("scope", "locations") for f in g.filters) for g in groups)


def required_folders(groups: list[Group]) -> list[str] | None:
    """Folders of which every match lies below at least one; None if some alternative is free of folders."""
    out: list[str] = []
    for g in groups:
        own = [[f.value[0]] if f.kind == "scope" else list(f.value) for f in g.filters if f.kind in ("scope", "locations") and not f.negated]
        if not own:
            return None
        out += min(own, key=len)
    return sorted(set(out))
