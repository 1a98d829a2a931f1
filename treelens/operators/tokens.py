"""Names as sequences of words: cut at what is neither letter nor digit, in lower case, without diacritics.

``TokenIndex`` keeps the words of all names with their positions, clustered by
word, so that a search reads only the range of the words it asks for.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import is_ascii
from ..storage import new_folder, save, tasks

_CUT = r"[^\p{L}\p{N}]+"
#: Bytes of a row group of the index: small, so that a range of words skips the others.
ROW_GROUP = 4 << 20
#: Changed rows that a patch takes; beyond them the index is built again.
PATCH_LIMIT = 50_000


@functools.cache
def _plain_letters() -> dict[str, str]:
    """Lower-case letters with diacritics to their base letters: all of the basic plane that decompose into one letter and marks."""
    found = {}
    for c in map(chr, range(0x80, 0x10000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if c == c.lower() and marks and unicodedata.category(base)[0] == "L" and all(unicodedata.category(m) == "Mn" for m in marks):
            found[c] = base
    return found


def fold(text: Column) -> Column:
    """Lower case, without diacritics, whether they are part of a letter or stand behind it."""
    letters = _plain_letters()
    plain = F.lower(text)
    return F.when(is_ascii(plain), plain).otherwise(F.regexp_replace(F.translate(plain, "".join(letters), "".join(letters.values())), r"\p{Mn}", ""))


def words(text: str) -> list[str]:
    """The words of a query's text, as ``tokens`` has those of a name."""
    plain = text.lower().translate(str.maketrans(_plain_letters()))
    plain = "".join(c for c in plain if unicodedata.category(c) != "Mn")
    return [w for w in re.split(r"[\W_]+", plain) if w]


def tokens(name: Column) -> Column:
    return F.filter(F.split(fold(name), _CUT), lambda t: t != "")


def has_phrase(name: Column, phrase: str) -> Column:
    """Whether the phrase's words stand side by side among the name's; _ separates words too."""
    asked = words(phrase)
    if not asked:
        return F.lit(False)
    text = F.concat(F.lit(" "), F.array_join(tokens(name), " "), F.lit(" "))
    return text.contains(f" {' '.join(asked)} ")


def token_match(entries: DataFrame, text: str) -> DataFrame:
    """Rows whose name has every phrase of ``text`` (white space separates phrases), by a test of every name."""
    found = entries.where("name <> ''")
    for phrase in text.split():
        found = found.where(has_phrase(F.col("name"), phrase))
    return found


def _after(prefix: str) -> str | None:
    """The least text that is greater than all that begin with ``prefix`` (in code point order, which is that of UTF-8)."""
    for i in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[i]) + 1
        code = 0xE000 if code == 0xD800 else code
        if code < 0x110000:
            return prefix[:i] + chr(code)
    return None


def _postings(entries: DataFrame) -> DataFrame:
    rows = entries.where("name <> ''").select("id", F.posexplode(tokens(F.col("name"))).alias("position", "token"))
    return rows.select("token", "id", F.col("position").cast("int").alias("position"))


@dataclass
class TokenIndex:
    """``token, id, position`` in ranges of token, and the changes that came since: ids that are void there, and their new postings."""

    base: DataFrame
    void: DataFrame | None = None
    added: DataFrame | None = None

    @classmethod
    def build(cls, entries: DataFrame) -> TokenIndex:
        """Words that very many names have are spread over several files by id."""
        spark, folder = entries.sparkSession, new_folder(entries.sparkSession, "tokens")
        # a name has some words: four times its rows
        rows = _postings(entries).repartitionByRange(tasks(spark, 4 * entries.count()), "token", "id").sortWithinPartitions("token", "id", "position")
        rows.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
        return cls(spark.read.schema(rows.schema).parquet(folder))

    def patch(self, changed: DataFrame, rows: DataFrame) -> TokenIndex:
        """The index after a change set: ``changed`` has the ids of changed, new and deleted rows, ``rows`` the changed and new rows themselves.

        Only the changes are written; patches of patches stay one layer. Returns
        None if more than PATCH_LIMIT ids have changed since the index was built
        (then it is built again).
        """
        void = changed.select("id").distinct()
        void = save(void if self.void is None else void.unionByName(self.void).distinct(), "tokens-void")
        if void.count() > PATCH_LIMIT:
            return None
        fresh = _postings(rows)
        if self.added is not None:
            fresh = self.added.join(changed.select("id").distinct(), "id", "left_anti").select("token", "id", "position").unionByName(fresh)
        return TokenIndex(self.base, void, save(fresh.coalesce(1).sortWithinPartitions("token"), "tokens-added"))

    def _where(self, condition: Column) -> DataFrame:
        rows = self.base.where(condition)
        if self.void is not None:
            # PATCH_LIMIT bounds what is broadcast
            rows = rows.join(F.broadcast(self.void), "id", "left_anti").select("token", "id", "position").unionByName(self.added.where(condition))
        return rows

    def ids(self, text: str, prefix: bool = True) -> DataFrame:
        """``id`` of the names that have every phrase of ``text``, once each.

        White space separates phrases; the words of one phrase stand side by
        side, and with ``prefix`` its last word need only begin so.  One scan of
        the ranges asked for and one shuffle by id, whatever the number of words.
        """
        asked = [w for w in map(words, text.split()) if w]
        token = F.col("token")

        def hit(word: str, last: bool) -> Column:
            if not (prefix and last):
                return token == word
            stop = _after(word)
            return (token >= word) if stop is None else (token >= word) & (token < stop)

        hits = [(p, i, hit(word, i == len(phrase) - 1)) for p, phrase in enumerate(asked) for i, word in enumerate(phrase)]
        if not hits:
            return self.base.where("false").select("id")
        places = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(p).alias("phrase"), F.lit(i).alias("word"))) for p, i, h in hits]))
        condition = functools.reduce(lambda a, b: a | b, [h for *_, h in hits])
        found = self._where(condition).select("id", "position", F.explode(places).alias("at")).select("id", "at.phrase", (F.col("position") - F.col("at.word")).alias("start"), "at.word")
        sizes = F.element_at(F.array(*[F.lit(len(p)) for p in asked]), F.col("phrase") + 1)
        whole = found.repartition("id").groupBy("id", "phrase", "start").agg(F.count_distinct("word").alias("n")).where(F.col("n") == sizes)
        return whole.groupBy("id").agg(F.count_distinct("phrase").alias("n")).where(F.col("n") == len(asked)).select("id")

    def match(self, entries: DataFrame, text: str, prefix: bool = True) -> DataFrame:
        """The rows of ``ids``."""
        return entries.join(self.ids(text, prefix), "id", "left_semi").select(*entries.columns)
