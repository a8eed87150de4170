"""Running sums and folds along an order, for keys of any size: no window, group or task holds a whole key.

Rows are dealt by ranges of (key, order), so that a hot key spans many ranges. A sum runs within each range and starts at what the
key's earlier ranges add up to; what meets for a key is one row a range. A fold that can't be split (a chain of hashes) is carried along
its key's sorted rows batch by batch, and holds a batch and a state only.

Defined results: a null key is a key of its own, nulls come first in an order; ties of the whole order are for the caller to break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from markloom.sources.files import saved

PART, KEY = "_part", "_key"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df by ranges of (key, order) with the range's number, written, so that every later plan sees the same ranges."""
    return saved(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def with_parts(parts: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """parts with the columns that pieces have for their (range, key)."""
    at = [PART, *keys]
    named = pieces.select(*[F.col(k).alias(f"_of_{k}") for k in at], *[c for c in pieces.columns if c not in at])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in at]
    return parts.join(named, same, "left").drop(*[f"_of_{k}" for k in at])


def running(df: DataFrame, keys: list[str], order: list[str], **sums: Column) -> DataFrame:
    """df with a column for each of sums: what it adds up to over the key's rows up to and with this one."""
    parts = ranged(df.select("*", *[v.alias(k) for k, v in sums.items()]), keys, order)
    totals = parts.groupBy(PART, *keys).agg(*[F.sum(k).alias(k) for k in sums])
    earlier = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(PART, *keys, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums])
    own = W.partitionBy(PART, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = with_parts(parts, before, keys)
    return met.select(*df.columns, *[(F.coalesce(F.sum(k).over(own), F.lit(0)) + F.col(f"_before_{k}")).alias(k) for k in sums])


def carried(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str, end: Callable | None = None) -> DataFrame:
    """A fold over each key's rows in order: step(state, row) gives the next state and rows out, end(state, row) the rows after a key's last.

    Rows come as dicts, a key's first one with the state None."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    dealt = df.withColumn(KEY, F.to_json(F.struct(*keys))).repartition(KEY).sortWithinPartitions(KEY, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if before is not None and before[KEY] != row[KEY]:
                    out += end(state, before) if end else ()
                    state = None
                state, rows = step(state, row)
                out += rows
                before = row
            yield _batch(out, arrow)
        if before is not None and end:
            yield _batch(end(state, before), arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
