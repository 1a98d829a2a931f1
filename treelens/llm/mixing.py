"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's words are cut into blocks of equal tokens.  The mix has as many
seats as it has blocks; they go to the sources, and within a source to its
shards, by the highest quotients votes / (2 k + 1), which gives integer
quotas.  A shard then takes its quota of blocks: each block as often as the
quota covers all of them, the rest by systematic selection from a seeded
start over seeded document order.

Everything is DataFrame operations.  Documents are dealt by (source, shard),
so that a source with a third of all rows is spread over as many tasks as
there are shards; what is ranked globally are sources and shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from .common import columns, save, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives each of its words at most this often.
MAX_REPEATS = 3
#: Words in a block.
BLOCK_TOKENS = 64
#: Documents in a shard, on average over all sources, and shards at most.
ROWS_PER_SHARD, MAX_SHARDS = 1024, 1 << 20
SEED = 20
#: What the mix says of a document.
ADDED = ("size", "source_size", "target", "taken")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size`` -> the same with ``target`` (double).

    Target: the source's share by weight of all words, at most ``max_repeats``
    times its own; the excess is shared anew by weight until none is above.
    In closed form: sorted by cap / weight, the capped sources are a prefix,
    and the level of the others is what the prefix leaves, per weight.
    One row per source, so the windows over all of them are small.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    cap = F.col("source_size") * float(max_repeats)
    rows = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weights_left).withColumn("capped", F.col("ratio") <= F.col("level"))
    # the first source that isn't capped sets the level of all that follow
    level = F.min(F.when(~F.col("capped"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), level["level"] * F.col("weight")))).select("source", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], key: Column, votes: Column, seats: Column) -> DataFrame:
    """Adds ``quota``: the seats of each party of a group by highest quotients (Sainte-Lague).

    Rounding votes / divisor with a divisor that is surely too large gives
    seats that each party has in any case; with one surely too small, a bound.
    Only the quotients between the two are ranked: fewer than two per party
    of the group on average.  Ties go to the smaller ``key``.
    """
    g = W.partitionBy(*group)
    rows = parties.withColumn("_votes", votes.cast("double")).withColumn("_seats", seats.cast("double")).withColumn("_key", key)
    rows = rows.withColumn("_all", F.sum("_votes").over(g)).withColumn("_n", F.count("*").over(g))
    share = F.col("_votes") / F.col("_all")
    usable = (F.col("_all") > 0) & (F.col("_seats") > 0)
    low = F.when(usable, F.greatest(F.floor(share * F.greatest(F.col("_seats") - F.col("_n") / 2, F.lit(0.0)) + 0.5) - 1, F.lit(0))).otherwise(0)
    high = F.when(usable & (F.col("_votes") > 0), F.floor(share * (F.col("_seats") + F.col("_n") / 2) + 0.5) + 1).otherwise(0)
    rows = rows.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).withColumn("_open", F.col("_seats") - F.sum("_low").over(g))
    ks = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low"), F.col("_high") - 1)).otherwise(F.array().cast("array<long>"))
    quotients = rows.withColumn("_k", F.explode_outer(ks)).withColumn("_q", F.col("_votes") / (2 * F.col("_k") + 1))
    rank = F.row_number().over(g.orderBy(F.col("_q").desc_nulls_last(), "_key", "_k"))
    won = quotients.withColumn("_won", (F.col("_k").isNotNull() & (rank <= F.col("_open"))).cast("long"))
    first = [F.first(c).alias(c) for c in parties.columns]
    out = won.groupBy(*[F.col(c) for c in group], "_key").agg(*[x for x, c in zip(first, parties.columns, strict=True) if c not in group], (F.first("_low") + F.sum("_won")).alias("quota"))
    return out.select(*parties.columns, "quota")


def _tie(docs: DataFrame) -> Column:
    """Sets rows of equal id and text apart by their other columns of plain types."""
    plain = [c for c, t in zip(columns(docs), docs.schema, strict=True) if not isinstance(t.dataType, (MapType, StructType, ArrayType, VariantType))]
    return F.xxhash64(*plain)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    size: words of the text (null: 0); source_size and target: of its source
    (null is a source of its own, last in order); taken: words the mix takes
    of it, repeats counted, at most ``max_repeats`` times its size.  A
    source's taken words differ from its target by a few blocks at most.
    Reruns agree: order and selection depend on the rows and the seed only.
    Repeated rows are documents of their own (their order does not matter:
    they are equal); null doc_ids are ordered by hash like the others; extra
    columns are ignored; an empty table gives an empty table.
    """
    return _mixed(docs, False, weights, max_repeats, block_tokens, seed, rows_per_shard).select("doc_id", *ADDED)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Every document with all its columns, and ``size, source_size, target, taken`` as ``mix`` has them.

    One row per row, with null or repeated doc_ids too: nothing is joined by
    id.  Columns of docs that have one of the four names are replaced.
    """
    rows = _mixed(docs, True, weights, max_repeats, block_tokens, seed, rows_per_shard)
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED], *ADDED)


def _mixed(docs: DataFrame, whole: bool, weights: tuple[int, ...], max_repeats: int, block_tokens: int, seed: int, rows_per_shard: int) -> DataFrame:
    """The rows of ``mix``; ``whole``: with the document packed in ``_row``."""
    count = docs.count()
    shards = min(MAX_SHARDS, max(1, -(-count // rows_per_shard)))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), order.alias("_order"), *([F.struct(*columns(docs)).alias("_row"), _tie(docs).alias("_tie")] if whole else []))
    # a null source has no key to join on: it gets one that no other source has
    rows = rows.withColumn("_source", F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source"))).withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.lit(shards)))
    if not whole:
        rows = save(rows, "sizes")  # whole documents are read twice instead of written once more

    shard = rows.groupBy("_source", "_shard").agg(F.first("source").alias("source"), F.sum("size").alias("shard_size"))
    blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / block_tokens))).otherwise(0).cast("long")
    shard = save(shard.withColumn("blocks", blocks), "shards")
    source = targets(shard.groupBy("_source").agg(F.first("source").alias("source"), F.sum("shard_size").alias("source_size")).drop("_source"), weights, max_repeats)
    source = source.withColumn("_all", F.lit(0))
    seats = F.round(F.sum("target").over(W.partitionBy("_all")) / block_tokens)
    quota = apportion(source.withColumn("seats", seats), ["_all"], F.col("source"), F.col("target"), F.col("seats"))
    quota = quota.select(F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("_source"), "source_size", "target", F.col("quota").alias("source_quota"))
    shard = shard.drop("source").join(quota, "_source")
    shard = apportion(shard, ["_source"], F.col("_shard"), F.col("shard_size"), F.col("source_quota"))
    # whole rounds over all blocks of the shard, then `extra` blocks once more
    capped = F.least(F.col("quota"), F.col("blocks") * max_repeats)
    shard = shard.withColumn("rounds", F.when(F.col("blocks") > 0, F.floor(capped / F.col("blocks"))).otherwise(0).cast("long"))
    shard = shard.withColumn("extra", F.when(F.col("blocks") > 0, capped - F.col("rounds") * F.col("blocks")).otherwise(0))
    shard = shard.withColumn("start", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "_source", "_shard"), F.col("blocks"))).otherwise(0))

    after = F.sum("size").over(W.partitionBy("_source", "_shard").orderBy("_order", "doc_id", "size", *(["_tie"] if whole else [])).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_end", after).withColumn("_begin", F.col("_end") - F.col("size")).join(shard, ["_source", "_shard"])

    def extra_words(position: Column) -> Column:
        """Words of the shard's extra blocks before ``position``: whole blocks, then the part of the block it is in."""
        size, n, r, u = F.col("shard_size"), F.col("blocks"), F.col("extra"), F.col("start")
        block = F.least(F.floor(position * n / size), n - 1)  # the block that holds this word

        def chosen_before(b: Column) -> Column:
            # systematic selection: exactly `extra` of `blocks` consecutive b step over a whole number
            return F.floor((b + u) * r / n) - F.floor(u * r / n)

        inside = chosen_before(block + 1) - chosen_before(block)
        return chosen_before(block) * size / n + inside * (position - block * size / n)

    words = F.when(F.col("blocks") > 0, F.round(extra_words(F.col("_end"))) - F.round(extra_words(F.col("_begin")))).otherwise(0)
    taken = F.least(F.col("rounds") * F.col("size") + F.least(F.greatest(words, F.lit(0)), F.col("size")), F.col("size") * max_repeats)
    return rows.withColumn("taken", taken.cast("long"))
