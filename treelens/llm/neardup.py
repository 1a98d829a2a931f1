"""Near-duplicate grouping: SuperMinHash signatures, banding, verification, union-find.

Method (Ertl 2017, "SuperMinHash"): each shingle draws one random permutation
of the signature's slots and lays increasing values ``rank + uniform`` along
it; a slot keeps its smallest value.  A document's loop over ranks ends as
soon as every slot holds a value of an earlier rank.  Here the loop runs over
ranks for a whole batch of documents at once.

Plan
  1. one pass over the texts: shingle-set size, 128-bit digest of the set, band keys;
  2. exact copies of a set collapse to one representative (the smallest id);
  3. equal band keys make buckets; only documents that share a bucket are ever compared;
  4. each member is verified against the centre of each of its buckets, full
     sets, every pair once, and the verified links are contracted;
  5. buckets whose members are not all connected yet are compared in blocks,
     full sets, across components only - no pair is emitted unless it is a link;
  6. components of the verified links, mapped back to all documents.

A bucket of up to SMALL members is a block (equal ones are compared once).  The
members of larger buckets are dealt to blocks by the largest of their buckets
and by size, so that documents of a kind lie together, and two blocks meet
once if they have a bucket in common and sizes between which links are possible.

Candidate recall: a pair at the threshold 0.8 shares one of 32 bands of 4 rows
with probability 1 - (1 - 0.8^4)^32 > 1 - 5e-8; everything after that is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, id_number, id_text, save
from .components import connected_components

SLOTS, ROWS = 128, 4
#: Members up to which a bucket is one block in step 5, and members of a block of larger ones on average.
SMALL, BLOCK = 32, 256
#: Documents whose shingles are flattened together in one signature call.
CHUNK = 256

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when it grows past its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``width``-word shingles.

    Fewer words form a single shingle; null or wordless text has none.
    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at \\x20 and \\x09-\\x0D only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    take = min(width, len(h))
    out = np.zeros(len(h) - take + 1, _U)
    for k in range(take):
        out = out * _MUL + h[k : len(h) - take + 1 + k]
    return np.unique(mix(out + _U(take)))


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (one row per set, ``slots`` columns) of non-empty sets.

    A value is ``rank << 32 | uniform``.  ``drawn[t]`` holds the position that
    step t of each element's Fisher-Yates shuffle exchanged with position t;
    walking it backwards gives the permutation's next entry without storing
    the permutation.
    """
    n = len(sets)
    best = np.full(n * slots, np.iinfo(np.uint64).max, _U)
    if not n:
        return best.reshape(0, slots)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    drawn: list[np.ndarray] = []
    for rank in range(slots):
        z = mix(element + _U((rank + 1) * int(_MUL) & 0xFFFFFFFFFFFFFFFF))
        position = rank + (((z >> _U(32)) * _U(slots - rank)) >> _U(32)).astype(np.int64)
        slot = position
        for t in range(rank - 1, -1, -1):
            slot = np.where(drawn[t] == slot, t, slot)
        np.minimum.at(best, owner * slots + slot, (z & _U(0xFFFFFFFF)) | (_U(rank) << _U(32)))
        # Early stop: a set is done once all its slots hold a rank up to this one.
        done = best.reshape(n, slots).max(axis=1) < (_U(rank + 1) << _U(32))
        go_on = ~done[owner]
        if not go_on.any():
            break
        drawn.append(position.astype(np.uint8 if slots <= 256 else np.int64))
        if not go_on.all():
            element, owner = element[go_on], owner[go_on]
            drawn = [d[go_on] for d in drawn]
    return best.reshape(n, slots)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, slots = signatures.shape
    parts = signatures[:, : slots // rows * rows].reshape(n, slots // rows, rows)
    key = np.broadcast_to(np.arange(slots // rows, dtype=_U), parts.shape[:2])
    for r in range(rows):
        key = mix(key * _MUL + parts[:, :, r])
    return key.view(np.int64)


def _signatures(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                sets = [shingles(t, width, hashes) for t in part["text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(superminhash([sets[i] for i in full]))
                bands: list = [None] * len(sets)
                digests: list = [None] * len(sets)
                for row, i in enumerate(full):
                    bands[i] = keys[row]
                    digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": [len(s) for s in sets], "digest": digests, "bands": bands})

    return run


def _sets(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, width, hashes).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"id": batch["doc_id"], "digest": [xxhash.xxh3_128_digest(s) for s in sets], "set": sets})

    return run


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _pairwise(percent: int):
    """The pairs (src with set a, dst with set b) that are links."""

    def run(batches):
        for batch in batches:
            src, dst = [], []
            for i, a, j, b in zip(batch["src"], batch["a"], batch["dst"], batch["b"], strict=True):
                mine, other = np.frombuffer(a, _U), np.frombuffer(b, _U)
                at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                if linked(np.count_nonzero(other[at] == mine), len(mine), len(other), percent):
                    src.append(i)
                    dst.append(j)
            yield pd.DataFrame({"src": src, "dst": dst}, dtype="int64")

    return run


def _in_block(percent: int):
    """Links between the two blocks of a pair (or inside one), across components only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(s, _U) for s in pdf["set"]]
        ids, component, side = (pdf[c].to_numpy() for c in ("id", "component", "side"))
        size = np.array([len(s) for s in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        mark = np.zeros(len(code), bool)
        within = not (side == 1).any()
        src, dst = [], []
        for i in np.flatnonzero(side == 0):
            own = code[starts[i] : starts[i] + size[i]]
            mark[own] = True
            common = np.add.reduceat(mark[code], starts)
            mark[own] = False
            hit = linked(common, size, size[i], percent) & (component != component[i]) & ((ids > ids[i]) if within else (side == 1))
            for j in np.flatnonzero(hit):
                src.append(ids[i])
                dst.append(ids[j])
        return pd.DataFrame({"src": src, "dst": dst}, dtype="int64")

    return run


def _small_blocks(members: DataFrame) -> DataFrame:
    """``(band, id, component)`` of buckets up to SMALL members -> ``(pair, side, id, component)``, equal buckets once."""
    blocks = members.groupBy("band").agg(F.array_sort(F.collect_set(F.struct("id", "component"))).alias("own")).select("own").distinct()
    key = F.md5(F.array_join(F.transform("own", lambda m: m["id"].cast("string")), ","))
    return blocks.select(key.alias("pair"), F.lit(0).alias("side"), F.explode("own").alias("m")).select("pair", "side", "m.id", "m.component")


def _cut_blocks(members: DataFrame, percent: int) -> DataFrame:
    """``(band, n, id, component, size)`` of larger buckets -> ``(pair, side, id, component)``.

    A component of more than BLOCK members is cut into blocks of its own, the
    small ones of a bucket share blocks; two blocks of the same large
    component are never paired, so what is connected already costs nothing.
    Sizes are cut into classes so wide that links join equal or neighbouring ones.
    """
    wide = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    kind = F.floor(F.log(F.col("size").cast("double")) / wide).cast("long")
    own = save(members.groupBy("id", "component").agg(F.max_by("band", F.struct("n", "band")).alias("home"), F.first(kind).alias("kind")), "homes")
    # where most members of a bucket have gone, its others go too, twice over: else many small blocks would meet
    gone = members.select("id", "band").join(own.select("id", "home"), "id").groupBy("band", "home").agg(F.count("*").alias("n"))
    gone = save(gone.groupBy("band").agg(F.max_by("home", F.struct("n", "home")).alias("to")), "gone")
    for _ in range(2):
        own = own.join(gone.withColumnRenamed("band", "home"), "home").drop("home").withColumnRenamed("to", "home")
    own = save(own, "rehomed")
    parts = own.groupBy("home", "component").agg(F.when(F.count("*") > BLOCK, F.col("component")).otherwise(F.lit(-1)).alias("part"))
    own = save(own.join(save(parts, "parts"), ["home", "component"]), "own")
    cuts = save(own.groupBy("home", "part", "kind").agg(F.ceil(F.count("*") / BLOCK).alias("cuts")), "cuts")
    block = F.concat_ws(":", "home", "part", "kind", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("cuts")))
    placed = save(own.join(cuts, ["home", "part", "kind"]).select("id", "component", "part", "kind", block.alias("block")), "blocks")
    # which blocks meet: those with members in one bucket; counts of blocks, not of members
    held = save(members.select("id", "band").join(placed.select("id", "part", "kind", "block"), "id").select("band", "part", "kind", "block").distinct(), "held")
    other = held.select("band", F.col("part").alias("part2"), F.col("kind").alias("kind2"), F.col("block").alias("block2"))
    meet = held.join(other, "band").where("block <= block2 and (part <> part2 or part = -1) and abs(kind - kind2) <= 1").select("block", "block2").distinct()
    meet = save(meet.withColumn("pair", F.concat_ws("|", "block", "block2")), "meet")
    one = meet.select("pair", "block", F.lit(0).alias("side"))
    two = meet.where("block <> block2").select("pair", F.col("block2").alias("block"), F.lit(1).alias("side"))
    return placed.join(one.unionByName(two), "block").select("pair", "side", "id", "component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have 100 * |A & B| >= percent * |A | B|.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.
    Null, empty and wordless texts have an empty set and are linked with
    nothing; fewer than ``width`` words form one shingle; rows that repeat a
    doc_id each get a row (and share the id's component when their sets do);
    a row with a null doc_id links nothing: it shares the component of an equal
    set, else has none, and kept is false; extra columns
    are ignored.  An empty table gives an empty table.
    """
    signed = docs.select(id_text("doc_id"), "text").mapInPandas(_signatures(width), "doc_id string, n_shingles long, digest binary, bands array<long>")
    signed = save(id_number(signed, "doc_id"), "signatures")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = signed.where("doc_id is not null and digest is not null")
    # bands follow from the digest, so any row of a class has the same ones
    classes = save(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")), "classes")

    bands = classes.select("id", "copies", F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    # the centre of a bucket: what has most exact copies, the same one for all buckets where possible
    order = F.struct(-F.col("copies"), F.xxhash64("id"), F.col("id").alias("id"), F.col("size").alias("size"))
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.min(order).alias("centre")).where("n > 1")
    buckets = save(buckets.select("band", "n", F.col("centre.id").alias("centre"), F.col("centre.size").alias("centre_size")), "buckets")
    members = save(bands.drop("copies").join(buckets, "band"), "members")

    texts = docs.where("doc_id is not null").join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # a doc_id that repeats with another text has the sets of the classes that it represents
    sets = texts.mapInPandas(_sets(width), "id long, digest binary, set binary").dropDuplicates(["id", "digest"])
    sets = save(sets.join(classes.select("id", "digest"), ["id", "digest"], "left_semi").select("id", "set"), "sets")

    possible = (F.col("id") != F.col("centre")) & (100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size"))
    stars = members.where(possible).select(F.col("id").alias("src"), F.col("centre").alias("dst")).distinct()
    stars = stars.join(sets.select(F.col("id").alias("src"), F.col("set").alias("a")), "src").join(sets.select(F.col("id").alias("dst"), F.col("set").alias("b")), "dst")
    stars = save(stars.select("src", "a", "dst", "b").mapInPandas(_pairwise(percent), "src long, dst long"), "stars")

    first = save(connected_components(stars, "stars-cc"), "first")
    members = save(members.join(first, "id", "left").select("band", "n", "id", "size", F.coalesce("component", "id").alias("component")), "joined")
    # what is all one component is settled
    open_ = save(members.groupBy("band").agg((F.min("component") < F.max("component")).alias("open")).where("open").select("band"), "open")
    members = save(members.join(open_, "band", "left_semi"), "unsettled")
    blocks = _small_blocks(members.where(F.col("n") <= SMALL)).unionByName(_cut_blocks(members.where(F.col("n") > SMALL), percent))
    rest = blocks.join(sets, "id").groupBy("pair").applyInPandas(_in_block(percent), "src long, dst long")
    links = stars.unionByName(save(rest, "links"))
    components = connected_components(links, "components")

    ids = classes.join(components, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = signed.drop("bands").join(ids, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that represent their component, all columns as they came.

    Rows that repeat a kept doc_id are all kept; rows with a null doc_id are
    kept, since no component has them for its representative.
    """
    gone = near_duplicates(docs, width, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))
