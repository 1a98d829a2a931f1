"""Ranked lexical search: pipelined term partitioning.

Terms are dealt to a few owners, rare terms to the first.  Bundles of items
pass from owner to owner with their accumulators: sparse scores of (item,
document).  At each stage a cogroup brings a bundle's accumulators for a shard
of documents together with the owner's postings of that shard, contributions
are added in 64-bit integers, and the accumulators go on to the next owner.

Between stages each item learns the score that its last place has already
reached.  An accumulator that cannot reach it with the greatest possible
contributions of the owners to come is dropped, and an item whose coming terms
cannot reach it together opens no more of them, so that frequent terms mostly
meet accumulators that are there.  Both rules are exact: what goes could not
be among the best.

Memory: a task holds one shard of documents for one bundle (SCRATCH cells at
most).  Items are worked on in blocks of at most BLOCK_BYTES of text, each of
which is known to the driver and sent to all executors; a benchmark of several
blocks takes as many passes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import new_folder, save, ship

#: Places of an item.
PLACES = 20
#: Share of all postings that the owners up to each one hold.
OWNERS = (0.02, 0.1, 0.35, 1.0)
#: Bytes of items' text worked on at once, items of a bundle, and cells (item, document) of a task.
BLOCK_BYTES, BUNDLE, SCRATCH = 32 << 20, 8192, 1 << 21

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_RESULT = "item_id long, rank int, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: letters and digits of ASCII and whatever is beyond it, only A-Z in lower case."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class Bundle:
    """Some items on their way: what the next owner needs to know of each."""

    items: np.ndarray  # their numbers
    queries: dict  # term: (places in items, weight times repeats)
    rest: np.ndarray  # greatest score that the owners after the next one can add
    floor: np.ndarray  # score that a document must reach
    opens: np.ndarray  # whether documents without an accumulator can still reach it


def _lengths(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``row, doc_id, n, terms, tf``: a row for each document with a term, with the terms that are asked for."""
    known = ship(docs.sparkSession, vocabulary)

    def run(batches):
        get = known().get
        for batch in batches:
            found = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = terms(text)
                if words:
                    count = Counter(map(get, words))
                    count.pop(None, None)
                    found.append((doc_id, len(words), list(count), list(count.values())))
            yield pd.DataFrame(found, columns=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, n long, terms array<int>, tf array<int>")
    return save(rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.monotonically_increasing_id()), "lengths")


def _owned(lengths: DataFrame, owner_of: np.ndarray, total: int, words: int, shards: int) -> str:
    """A folder of postings by owner: ``owner, shard, row, doc_id, terms, impacts``, a row for each document and owner."""
    owners = ship(lengths.sparkSession, owner_of)

    def run(batches):
        owner_of = owners()
        for batch in batches:
            batch = batch[batch["terms"].map(len) > 0]
            if not len(batch):
                continue
            size = batch["terms"].map(len).to_numpy()
            doc = np.repeat(np.arange(len(batch)), size)
            term, tf = np.concatenate(batch["terms"].to_list()).astype(np.int64), np.concatenate(batch["tf"].to_list()).astype(np.int64)
            m = 100 - 25 + (25 * batch["n"].to_numpy() * total) // words
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
            owner = owner_of[term]
            order = np.lexsort((owner, doc))
            doc, term, impact, owner = doc[order], term[order], impact[order], owner[order]
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])) + 1
            first = np.append(0, cut)
            rows = batch.iloc[doc[first]]
            yield pd.DataFrame({"owner": owner[first], "row": rows["row"].to_numpy(), "doc_id": rows["doc_id"].to_numpy(), "terms": np.split(term, cut), "impacts": np.split(impact, cut)})

    folder = new_folder(lengths.sparkSession, "owned")
    rows = lengths.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "owner int, row long, doc_id string, terms array<int>, impacts array<int>")
    rows.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).write.partitionBy("owner").parquet(folder)
    return folder


_CARRIED = "bundle int, shard int, item int, row long, doc_id long, score long"


def _visit(carried: DataFrame, postings: DataFrame, bundles: list[Bundle]) -> DataFrame:
    """Accumulators after one owner: ``bundle, shard, item, row, doc_id, score`` (item: place in its bundle)."""
    shared = ship(postings.sparkSession, bundles)

    def add(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        bundle = shared()[key[0]]
        rows, first = np.unique(np.concatenate([left["row"].to_numpy(np.int64), right["row"].to_numpy(np.int64)]), return_index=True)
        doc_ids = pd.concat([left["doc_id"], right["doc_id"]]).to_numpy(object)[first]
        scores = np.zeros((len(bundle.items), len(rows)), np.int64)
        alive = np.zeros(scores.shape, bool)
        at = left["item"].to_numpy(np.int64), np.searchsorted(rows, left["row"].to_numpy(np.int64))
        scores[at], alive[at] = left["score"].to_numpy(np.int64), True
        if len(right):
            active = bundle.opens | alive.any(axis=1)
            column = np.repeat(np.searchsorted(rows, right["row"].to_numpy(np.int64)), right["terms"].map(len).to_numpy())
            term, impact = np.concatenate(right["terms"].to_list()), np.concatenate(right["impacts"].to_list()).astype(np.int64)
            order = np.argsort(term, kind="stable")
            term, impact, column = term[order], impact[order], column[order]
            cut = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                asked = bundle.queries.get(int(term[a]))
                if asked is None:
                    continue
                items, weight = asked
                wanted = active[items]
                if wanted.any():
                    # a document has a term once, so no cell is meant twice
                    scores[np.ix_(items[wanted], column[a:b])] += np.multiply.outer(weight[wanted], impact[a:b])
        keep = (scores > 0) & (alive | bundle.opens[:, None]) & (scores + bundle.rest[:, None] >= bundle.floor[:, None])
        item, at = np.nonzero(keep)
        return pd.DataFrame({"bundle": key[0], "shard": key[1], "item": item, "row": rows[at], "doc_id": doc_ids[at], "score": scores[item, at]})

    text = F.col("doc_id").cast("string").alias("doc_id")
    left = carried.select("bundle", "shard", "item", "row", text, "score").groupBy("bundle", "shard")
    right = postings.select(F.explode(F.array(*[F.lit(i) for i in range(len(bundles))])).alias("bundle"), "shard", "row", text, "terms", "impacts").groupBy("bundle", "shard")
    added = left.cogroup(right).applyInPandas(add, _CARRIED.replace("doc_id long", "doc_id string"))
    return save(added.withColumn("doc_id", F.col("doc_id").cast("long")), "accumulators")


def _search_block(docs: DataFrame, items: list[tuple], places: int, owners: tuple[float, ...]) -> DataFrame:
    spark = docs.sparkSession
    queries = [Counter(terms(text)) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
    empty = spark.createDataFrame([], _RESULT)
    if not vocabulary:
        return empty
    lengths = _lengths(docs, vocabulary)
    total, words = lengths.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return empty
    each = lengths.select("n", F.explode(F.arrays_zip("terms", "tf")).alias("t"))
    m = f"(75 + (25 * n * {total}L) div {words}L)"
    # as many rows as the items have terms
    known = each.groupBy("t.terms").agg(F.count("*").alias("df"), F.max(F.expr(f"(1000000000L * t.tf) div (1000 * t.tf + 12 * {m})")).alias("most")).collect()
    df, most = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for r in known:
        df[r.terms], most[r.terms] = r.df, r.most
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    by_df = np.argsort(df, kind="stable")
    owner_of = np.empty(len(df), np.int32)
    owner_of[by_df] = np.minimum(np.searchsorted(np.array(owners) * df.sum(), np.cumsum(df[by_df])), len(owners) - 1)

    bundles = [list(range(a, min(len(items), a + BUNDLE))) for a in range(0, len(items), BUNDLE)]
    shards = max(1, -(-total * min(BUNDLE, len(items)) // SCRATCH))
    folder = _owned(lengths, owner_of, total, words, shards)
    schema = "shard int, row long, doc_id long, terms array<int>, impacts array<int>, owner int"
    carried = spark.createDataFrame([], _CARRIED)
    floors = np.ones(len(items), np.int64)  # scores are above 0
    coming = np.zeros((len(owners) + 1, len(items)), np.int64)
    for i, q in enumerate(queries):
        for t, n in q.items():
            coming[owner_of[vocabulary[t]], i] += n * weight[vocabulary[t]] * most[vocabulary[t]]
    coming = coming[::-1].cumsum(axis=0)[::-1]  # what an owner and those after it can add
    for owner in range(len(owners)):
        sent = []
        for members in bundles:
            asked: dict = {}
            for place, i in enumerate(members):
                for t, n in queries[i].items():
                    if owner_of[vocabulary[t]] == owner and weight[vocabulary[t]]:
                        asked.setdefault(vocabulary[t], []).append((place, n * weight[vocabulary[t]]))
            asked = {t: (np.array([x[0] for x in v]), np.array([x[1] for x in v], np.int64)) for t, v in asked.items()}
            sent.append(Bundle(np.array(members), asked, coming[owner + 1, members], floors[members], coming[owner, members] >= floors[members]))
        postings = spark.read.schema(schema).parquet(folder).where(F.col("owner") == owner)
        carried = _visit(carried, postings, sent)
        if owner + 1 < len(owners):
            best = W.partitionBy("bundle", "item").orderBy(F.desc("score"), "row")
            last = carried.select("bundle", "item", "score", "row").withColumn("place", F.row_number().over(best)).where(F.col("place") <= places)
            for r in last.where(F.col("place") == places).collect():  # a row for each item at most
                floors[bundles[r.bundle][r.item]] = max(floors[bundles[r.bundle][r.item]], r.score)
    best = W.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    top = carried.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= places)
    names = spark.createDataFrame([(b, place, items[i][0]) for b, members in enumerate(bundles) for place, i in enumerate(members)], "bundle int, item int, item_id long")
    return top.join(F.broadcast(names), ["bundle", "item"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # BLOCK_BYTES bounds the names


def search(docs: DataFrame, items: DataFrame, places: int = PLACES, owners: tuple[float, ...] = OWNERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item, from rank 1, with scores above 0.

    ``docs``: doc_id, text; ``items``: item_id, text.  Null texts have no terms;
    a document without terms counts nowhere, an item without terms or hits has
    no rows.  Every row of ``docs`` is a document and every row of ``items`` an
    item, also if ids repeat or are null (null doc_ids come last among equal
    scores, rows of equal id in no fixed order); extra columns are ignored.
    Weights and scores are as the ranking's formula says, in 64-bit integers.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        asked = save(asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "items")
    found = []
    for b in range(blocks):
        block = asked.where(F.col("block") == b) if blocks > 1 else asked
        found.append(save(_search_block(docs, [(r.item_id, r.text) for r in block.select("item_id", "text").collect()], places, owners), "ranked"))
    result = found[0]
    for x in found[1:]:
        result = result.unionByName(x)
    return result
