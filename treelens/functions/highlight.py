"""Where a query's terms lie in names and paths."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.compile import quoted, regex, word
from ..lang.parser import parse


def patterns(request, path: bool = False) -> list[str]:
    """Java patterns of the positive terms; terms with a slash count for paths only."""
    if request.use_regex:
        return [regex(request.text, request.match_case)] if not path or request.match_path else []
    out = []
    for term in (t for g in parse(request.text) for t in g):
        if term.negated or term.filter() or (term.has_slash and not path) or (path and not (request.match_path or term.has_slash)):
            continue
        for part in re.split(r"[*?]", term.text):
            if part:
                out.append(regex(word(part) if request.whole_word and not term.wild else quoted(part), request.match_case))
    return out


def spans_count(text: Column, request, path: bool = False) -> Column:
    """Number of highlighted stretches; empty matches don't count."""
    total = F.lit(0)
    for pattern in patterns(request, path):
        total = total + F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: m != ""))
    return total.cast("long")


def ranges(request, path: bool = False):
    """A pandas UDF: text -> array of (begin, length) in UTF-16 units; an invalid pattern gives none."""
    out = []
    for pattern in patterns(request, path):
        try:
            out.append(re.compile(re.sub(r"\(\?iu\)", "(?i)", pattern).replace(r"[\p{L}\p{N}_]", r"\w").replace(r"\x{20}", " ")))
        except re.error:
            continue

    @F.pandas_udf("array<struct<begin:int,length:int>>")
    def find(texts: pd.Series) -> pd.Series:
        def units(s: str) -> int:
            return len(s.encode("utf-16-le", "surrogatepass")) // 2

        def one(text):
            found = [m for p in out for m in p.finditer(text or "") if m.end() > m.start()]
            return [{"begin": units(text[: m.start()]), "length": units(m.group())} for m in found]

        return texts.map(one)

    return find


def reuse_key(request) -> tuple:
    return request.text, request.use_regex, request.match_case, request.match_path, request.whole_word
