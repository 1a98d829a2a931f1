"""Shared helpers of the training-data operators.

Every operator takes DataFrames and returns DataFrames.  Intermediate tables
that an operator must read more than once are written as Parquet below the
cluster's shared folder (``spark.checkpoint.dir``), so that a lost executor
costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, save

__all__ = ["bounded_sample", "columns", "held_out", "id_number", "id_text", "new_folder", "save", "ship", "table", "word_count"]

# Functions of this package that run on executors travel by value, and
# so do the objects that ``ship`` broadcasts: no executor needs the repository on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

#: White space of the word definition used by every operator: \x20, \x09-\x0D.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def ship(spark: SparkSession, value) -> Callable[[], object]:
    """A function that gives ``value`` on any executor, with its classes: it is broadcast as bytes made by cloudpickle.

    (A plain broadcast pickles instances by the name of their class, which an
    executor without this package cannot import.)  Each worker process loads it once.
    """
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get():
        if not hasattr(shared, "_loaded"):
            shared._loaded = pickle.loads(shared.value)
        return shared._loaded

    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def id_text(name: str) -> Column:
    """An id on its way to pandas: as text, for a null would turn the integers beside it into doubles."""
    return F.col(name).cast("long").cast("string").alias(name)


def id_number(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the id that ``id_text`` made an integer again, at its place."""
    return df.withColumn(name, F.col(name).cast("long"))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def word_count(text: Column) -> Column:
    """Number of words (long); null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))), F.lit(0)).cast("long")


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows (never more), chosen by a hash of ``key``; all rows if they are fewer."""
    total = rows.count()
    if total > bound:
        share = int(0.95 * bound / total * 1_000_000)
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < share)
    return rows.limit(bound)
