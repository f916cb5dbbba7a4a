"""What least-recently-used caches keep, as a fold over the accesses of each cache in order."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


def lru(accesses: DataFrame, item: str, order: str, budget: int, by: list[str], size: str | None = None) -> DataFrame:
    """Adds hit, whether the cache held the item, and evicted, how many items went to make room for it.

    Each group of ``by`` is a cache of ``budget`` items, or bytes if ``size`` names
    them.  A miss puts the item in; then the least recently read go until all fit (the
    item itself stays, however large).  Accesses stream through in order, so only one
    cache's names are in memory.
    """
    schema = T.StructType([*accesses.schema.fields, T.StructField("hit", T.BooleanType()), T.StructField("evicted", T.IntegerType())])
    keys, what, weight = [accesses.columns.index(c) for c in by], accesses.columns.index(item), accesses.columns.index(size) if size else None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, used = None, OrderedDict(), 0
        for batch in batches:
            groups = zip(*(batch.column(i).to_pylist() for i in keys), strict=True) if keys else [()] * batch.num_rows
            weights = [1] * batch.num_rows if weight is None else batch.column(weight).to_pylist()
            hits, evicted = [], []
            for group, x, n in zip(groups, batch.column(what).to_pylist(), weights, strict=True):
                if group != last:
                    last, held, used = group, OrderedDict(), 0
                hits.append(x in held)
                used += (n or 0) - held.pop(x, 0)
                held[x] = n or 0
                gone = 0
                while used > budget and len(held) > 1:
                    used -= held.popitem(last=False)[1]
                    gone += 1
                evicted.append(gone)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_()), pa.array(evicted, pa.int32())], names=schema.names)

    spread = accesses.repartition(*by) if by else accesses.coalesce(1)
    return spread.sortWithinPartitions(*by, order).mapInArrow(fold, schema)


def shard_of(item: Column, shards: int) -> Column:
    """The shard of a cache that is split by hash; use it among ``by``, which also spreads the fold."""
    return F.pmod(F.crc32(item.cast("string").cast("binary")), F.lit(shards)).cast("int")
