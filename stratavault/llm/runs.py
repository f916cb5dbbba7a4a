"""Runs of equal keys in sorted partitions, blocks that split large groups, and joins that do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a block.  A larger group is dealt into blocks, and each pair of blocks is a run of its own.
BLOCK = 1024
#: A key of more rows than this is dealt over several places of a join.  The keys with the most rows are known to all tasks, HOT_KEYS of them at most (under 2 MB); a key beyond them has under 1 / HOT_KEYS of the rows.
FEW, HOT_KEYS = 256, 100_000
MOST_PLACES = 512


def spread_join(rows: DataFrame, per: DataFrame, key: str | list[str], n: str, node: str) -> DataFrame:
    """``rows`` joined with ``per``, which has a row for each key and in ``n`` how many ``rows`` the key has.

    Rows of a frequent key are dealt by hash of ``node`` over places of FEW rows each
    (MOST_PLACES at most) and the key's row of ``per`` goes to each place, so a key
    that holds a third of all rows is no task's alone.  ``per`` is read twice: write it first.
    """
    keys = [key] if isinstance(key, str) else key
    hot = per.where(F.col(n) > FEW).orderBy(F.desc(n), *keys).limit(HOT_KEYS).select(*keys, F.least(F.ceil(F.col(n) / FEW), F.lit(MOST_PLACES)).cast("int").alias("__places"))
    places = F.coalesce("__places", F.lit(1))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("__place", F.pmod(F.xxhash64(node, F.lit(11)), places).cast("int")).drop("__places")
    right = per.join(F.broadcast(hot), keys, "left").withColumn("__place", F.explode(F.sequence(F.lit(0), places - 1))).drop("__places")
    return left.join(right, [*keys, "__place"]).drop("__place")


def in_block_pairs(members: DataFrame, sizes: DataFrame, key: str, node: str) -> DataFrame:
    """``members`` (key, node, ...) with ``run`` in place of the key, each row as often as block pairs of its group need it.

    ``sizes`` (key, g) has the groups' rows, for groups of two or more.  A group of at
    most BLOCK rows is one run.  Larger ones are dealt by hash into blocks; rows of two
    different blocks meet in one run, rows of one block in the run of that block with
    itself.  Adds ``side``: -1 in runs of one block, else the block (0 or 1) of the
    pair.  A run has at most about 2 * BLOCK rows.
    """
    m = spread_join(members, sizes, key, "g", node).withColumn("__n", F.ceil(F.col("g") / BLOCK).cast("int"))
    m = m.withColumn("__b", F.pmod(F.xxhash64(node, F.lit(7)), F.col("__n")).cast("int"))
    m = m.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    m = m.withColumn("run", F.xxhash64(key, F.least("__b", "__o"), F.greatest("__b", "__o")))
    side = F.when(F.col("__b") == F.col("__o"), -1).otherwise((F.col("__b") > F.col("__o")).cast("int"))
    return m.withColumn("side", side).drop("g", "__n", "__b", "__o")


def each_run(batches: Iterator[pa.RecordBatch], column: str, work: Callable[[pa.Table], list[tuple]], rows: int = 1) -> Iterator[list[tuple]]:
    """Calls ``work`` for the rows of each run, or of several whole runs that have ``rows`` rows together; the batches are sorted by ``column``.

    Only what goes to ``work`` at a time and one batch are in memory.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        ends = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        if not held or held[-1].column(column)[-1].as_py() != keys[0]:
            ends = [0, *ends]  # a run ended with the batch before
        at = 0
        for end in ends:
            if count + end - at >= rows and (held or end > at):
                yield work(pa.Table.from_batches([*held, *([batch.slice(at, end - at)] if end > at else [])]))
                held, count, at = [], 0, end
        held.append(batch.slice(at))
        count += batch.num_rows - at
    if held:
        yield work(pa.Table.from_batches(held))
