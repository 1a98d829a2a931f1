"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Base spans come from four fixed patterns.  The method then learns from them.
A candidate is a run of characters with a digit or an @.  Its lexical
patterns are the word before it with a connective (``password =``), the two
words before it, and four letters that it begins with.  Seeds are the base
entities and strings that look like secrets (letters and digits mixed, of 16
characters or more).  Patterns and instances form a bipartite graph that is
scored iteratively: a pattern by the mean score of its instances, an instance
by its best pattern, seeds fixed at 1.  A pattern counts once it has enough
instances that are believed; instances discovered in one round support new
patterns in the next.  Candidates behind patterns of high confidence are
identifiers that no fixed pattern knows (kind ``id``).

Everything is DataFrame operations.  Java's regular expressions run with
possessive quantifiers, so that no text makes them slow or deep, and arrays of
positions are made by ``running`` and ``cut``, so that texts with very many
matches stay cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, save

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

# The contract's patterns, with the same leftmost non-overlapping matches:
# an e-mail's local part starts where its run of characters does, or where the last match ended;
# a card is a whole run of digits with single separators, of 13 to 19 digits.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# A candidate: a run of what may belong to a value, with a digit or an @.
_VALUE = r"[^\s\"'`=:,;|<>(){}\[\]]"
_CANDIDATE = rf"(?<!{_VALUE})[{_VALUE}&&[^0-9@]]*+[0-9@]{_VALUE}*+"
#: Seeds besides the base entities: 16 characters or more, three letters and three digits among them.
_SECRET = r"^(?=(?:[^A-Za-z]*[A-Za-z]){3})(?=(?:[^0-9]*[0-9]){3})[A-Za-z0-9+/_-]{16,}+$"

SPAN = "struct<kind:int,begin:int,end:int>"
CANDIDATE = "struct<token:string,contexts:array<string>,begin:int,end:int,inside:boolean,seed:boolean>"
#: Rounds of the scoring, least confidence of a pattern and of an instance that supports one, and least supporting instances (different ones).
ROUNDS, CONFIDENCE, LEAST_SEEDS = 3, 0.8, 3
#: Characters before a candidate in which the words of its context are looked for.
REACH = 80
#: Weight of the prior belief that a pattern is worthless, in instances.
PRIOR = 0.5
#: Confident patterns are matched in place up to this number; more of them are joined.
MAX_IN_PLACE = 10_000
#: Elements that are folded one after the other, and characters of a piece of text.
_FOLD, _PIECE = 256, 4096


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(F.pmod(size - i, F.lit(2)) == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(part.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """What ``combine`` makes of all elements before each element (array of int, all of ``values`` int, combine associative).

    Folded in chunks, since an array that grows by an element a step is copied every time.
    """

    def fold(items: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, state, lambda s, v: F.struct(combine(s["at"], v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def in_chunks(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _FOLD).cast("int"))
        return F.transform(starts, lambda c: F.slice(all_, c * _FOLD + 1, F.lit(_FOLD)))

    def whole(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), combine))
        return F.flatten(F.zip_with(chunks, fold(totals, F.lit(zero)), fold))

    return F.when(F.size(values) > 0, let(values, lambda v: let(in_chunks(v), whole))).otherwise(F.array().cast("array<int>"))


def cut(pieces: Column, begin: Column, end: Column) -> Column:
    """The text from ``begin`` to ``end`` (code points, end exclusive) out of its pieces of _PIECE characters."""
    first, last = F.floor(begin / _PIECE).cast("int"), F.floor((end - 1) / _PIECE).cast("int")

    def part(of: Column, begin: Column, end: Column) -> Column:
        return F.substring(F.get(pieces, of), begin - of * _PIECE + 1, end - begin)

    inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(part(first, begin, (first + 1) * _PIECE), inner, part(last, last * _PIECE, end))
    return F.when(begin >= end, "").when(first == last, part(first, begin, end)).otherwise(across)


def located(text: Column, pattern: str) -> Column:
    """All matches in order: array of (match, gap before it, begin, end) in code points."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)

    def place(both: Column) -> Column:
        before = running(F.transform(both, lambda m: F.length(m["gap"]) + F.length(m["match"])), lambda a, b: a + b, 0)

        def item(m: Column, at: Column) -> Column:
            begin = at + F.length(m["gap"])
            return F.struct(m["match"].alias("match"), m["gap"].alias("gap"), begin.alias("begin"), (begin + F.length(m["match"])).alias("end"))

        return F.zip_with(both, before, item)

    return let(matches, lambda found: let(F.arrays_zip(found.alias("match"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")), place))


def base_spans(text: Column) -> Column:
    """Base spans as an array of (kind's index, begin, end), by kind and begin."""
    none = F.array().cast(f"array<{SPAN}>")
    arrays = []
    for k, kind in enumerate(KINDS):
        spans = F.transform(F.filter(located(text, PATTERNS[kind]), _checker(kind)), _spanner(k))
        has = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike(PATTERNS[kind])
        arrays.append(F.when(has, spans).otherwise(none))
    return F.concat(*arrays)


def _checker(kind: str):
    return lambda m: _valid(kind, m["match"])


def _spanner(k: int):
    return lambda m: F.struct(F.lit(k).alias("kind"), m["begin"].alias("begin"), m["end"].alias("end"))


def joined(spans: Column) -> Column:
    """kind:begin:end, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def _contexts(left: Column, token: Column) -> Column:
    """The lexical patterns of a candidate, from the text before it in lower case."""
    near = F.regexp_extract(left, r"(?:([\p{L}_-]+)[^\p{L}_]+)?([\p{L}_-]+)[^\p{L}\p{N}]*$", 0)

    def patterns(near: Column) -> Column:
        connective = F.substring(F.regexp_replace(near, "[^:=#]", ""), -1, 1)
        words = F.split(F.trim(F.regexp_replace(near, r"[^\p{L}_-]+", " ")), " ")
        word = F.element_at(words, -1)
        one = F.when(connective != "", F.concat(word, F.lit(" "), connective))
        two = F.when(F.size(words) > 1, F.concat_ws(" ", F.element_at(words, -2), word, connective))
        return F.when(near != "", F.array(one, two)).otherwise(F.array().cast("array<string>"))

    head = F.when(token.rlike(_SECRET), F.concat(F.lit("^"), F.nullif(F.regexp_extract(token, "^[A-Za-z]{4}", 0), F.lit(""))))
    return F.array_compact(F.concat(let(near, patterns), F.array(head)))


def _candidates(text: Column, base: Column) -> Column:
    """Candidates with their patterns: array of CANDIDATE, by begin."""

    # one transform after the other, so that each part is computed once per candidate
    def trim(m: Column) -> Column:
        # of what surrounds a token without belonging to it
        lead = F.regexp_extract(m["match"], r"^[\p{Punct}&&[^+@#]]*", 0)
        token = F.regexp_replace(F.substring(m["match"], F.length(lead) + 1, F.length(m["match"])), r"\p{Punct}+$", "")
        left = F.lower(F.concat(F.substring(m["gap"], -REACH, REACH), lead))
        return F.struct(token.alias("token"), left.alias("left"), (m["begin"] + F.length(lead)).alias("begin"))

    def place(c: Column) -> Column:
        return F.struct(c["token"].alias("token"), _contexts(c["left"], c["token"]).alias("contexts"), c["begin"].alias("begin"), (c["begin"] + F.length(c["token"])).alias("end"))

    trimmed = F.filter(F.transform(located(text, _CANDIDATE), trim), lambda c: (F.length(c["token"]) >= 4) & c["token"].rlike("[0-9@]"))
    found = F.filter(F.transform(trimmed, place), lambda c: F.size(c["contexts"]) > 0)
    marked = let(found, lambda f: F.zip_with(f, _inside(f, base), _marked))
    return F.when(text.rlike("[0-9@]"), marked).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def _marked(c: Column, inside: Column) -> Column:
    return F.struct(*[c[x].alias(x) for x in ("token", "contexts", "begin", "end")], inside.alias("inside"), (inside | c["token"].rlike(_SECRET)).alias("seed"))


def _inside(found: Column, base: Column) -> Column:
    """For each candidate whether it overlaps a base span: one that begins before its end ends after its begin."""
    own = F.transform(found, lambda c: F.struct(c["end"].alias("at"), F.lit(1).alias("candidate"), c["begin"].alias("begin"), F.lit(0).alias("reach")))
    spans = F.transform(base, lambda s: F.struct(s["begin"].alias("at"), F.lit(0).alias("candidate"), F.lit(0).alias("begin"), s["end"].alias("reach")))

    # a span that begins at a candidate's end is no overlap: it is ordered after it
    def judged(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda x: x["reach"]), lambda a, b: F.greatest(a, b), 0)
        return F.transform(F.filter(F.arrays_zip(ordered.alias("x"), reach.alias("reach")), lambda z: z["x"]["candidate"] == 1), lambda z: z["reach"] > z["x"]["begin"])

    spans = F.transform(spans, lambda x: F.struct((x["at"] + 1).alias("at"), x["candidate"].alias("candidate"), x["begin"].alias("begin"), x["reach"].alias("reach")))
    return F.when(F.size(base) > 0, let(F.array_sort(F.concat(own, spans)), judged)).otherwise(F.transform(found, lambda _: F.lit(False)))


def _confident(edges: DataFrame) -> DataFrame:
    """Patterns (column context) of high confidence from ``context, token, seed`` edges."""
    edges = edges.groupBy("context", "token").agg(F.max("seed").alias("seed"))
    # a pattern with too few instances can never be supported by enough
    possible = edges.groupBy("context").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEDS).select("context")
    edges = save(edges.join(possible, "context", "left_semi"), "edges")
    belief = edges.select("context", "token", F.col("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        patterns = save(_scored(belief), "patterns")
        # an instance is believed as its best pattern is; only patterns that have support count
        best = edges.where("not seed").join(patterns, "context").groupBy("token").agg(F.max("confidence").alias("best"))
        belief = edges.join(best, "token", "left").select("context", "token", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
    return _scored(belief).where(F.col("confidence") >= CONFIDENCE).select("context")


def _scored(belief: DataFrame) -> DataFrame:
    """Confidence of each pattern that enough believed instances support."""
    support = F.count_if(F.col("score") >= CONFIDENCE).alias("support")
    scored = belief.groupBy("context").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence"), support)
    return scored.where(F.col("support") >= LEAST_SEEDS).drop("support")


def _patterns(candidates: DataFrame) -> DataFrame:
    """Confident patterns from rows with ``_candidates``."""
    each = candidates.where(F.size("_candidates") > 0).select(F.explode("_candidates").alias("c"))
    return save(_confident(each.select(F.explode("c.contexts").alias("context"), "c.token", "c.seed")), "confident")


def _with_spans(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds ``_spans``: those in ``_base``, then found ones by begin.  Few patterns are looked up in place, many by a join."""
    few = [r.context for r in patterns.limit(MAX_IN_PLACE + 1).collect()]
    if len(few) <= MAX_IN_PLACE:
        hits = F.filter("_candidates", lambda c: ~c["inside"] & F.exists(c["contexts"], lambda x: x.isin(few) if few else F.lit(False)))
        return rows.withColumn("_spans", F.concat("_base", F.transform(hits, _spanner(len(KINDS)))))
    rows = rows.withColumn("_key", F.expr("uuid()"))
    rows = save(rows, "annotated")  # so that each row has one key, whatever is computed again
    each = rows.select("_key", F.explode("_candidates").alias("c")).where("not c.inside").select("_key", "c.begin", "c.end", F.explode("c.contexts").alias("context"))
    found = each.join(patterns, "context", "left_semi").select("_key", F.struct(F.lit(len(KINDS)).alias("kind"), "begin", "end").alias("s"))
    found = found.groupBy("_key").agg(F.array_sort(F.collect_set("s")).alias("_new"))
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(found, "_key", "left").withColumn("_spans", F.concat("_base", F.coalesce("_new", none)))


def _annotated(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of docs, ``_base`` and ``_candidates``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*columns, base_spans(text).alias("_base"), text.alias("_text"))
    return rows.select(*columns, "_base", _candidates(F.col("_text"), F.col("_base")).alias("_candidates"))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id, n_spans`` of every document's whole text.

    The counts and the digest are of the base spans; ``spans`` has the found
    ones too (n_id of them).  Null and empty texts have no span (digest of the empty
    string); repeated rows each get a row; null doc_ids stay null; extra
    columns are ignored; an empty table gives an empty table.
    """
    rows = save(_annotated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]), "candidates")
    rows = _with_spans(rows, _patterns(rows))
    counts = [F.size(F.filter("_base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    new = (F.size("_spans") - F.size("_base")).cast("long").alias(f"n_{FOUND}")
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), new, F.size("_spans").cast("long").alias("n_spans"))


def _is(k: int):
    return lambda s: s["kind"] == k


def _redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span's text replaced by its kind; overlapping spans as one, by the kind of the one that begins first."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, FOUND)])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def replaced(of: Column) -> Column:
        # where the spans before each one end; one that begins there or later begins a placeholder
        ends = running(F.transform(of, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
        first = F.filter(F.arrays_zip(of.alias("s"), ends.alias("e")), lambda z: z["s"]["begin"] >= z["e"])

        def filled(pieces: Column) -> Column:
            parts = F.transform(first, lambda z: F.concat(cut(pieces, z["e"], z["s"]["begin"]), F.get(names, z["s"]["kind"])))
            return F.concat(F.array_join(parts, ""), cut(pieces, F.array_max(F.transform(of, lambda s: s["end"])), F.length(text)))

        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)), filled)

    return F.when(F.size(spans) > 0, let(ordered, replaced)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span's text replaced by its kind in angle brackets; all columns as they came, n_chars (if there) anew.

    Overlapping spans are replaced as one, by the name of the one that begins
    first.  Texts without spans stay as they are, null too.  The documents are
    read twice, for the patterns and to replace; their texts are never shuffled.
    """
    patterns = _patterns(_annotated(docs, []))
    # the rows travel packed, so that no column of theirs can clash with the ones made here
    rows = _with_spans(_annotated(docs.select(F.struct(*columns(docs)).alias("_row"), "text"), ["_row", "text"]), patterns)
    rows = rows.withColumn("_new", _redacted(F.col("text"), F.col("_spans")))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
