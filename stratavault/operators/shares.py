"""Shares per cloud: fingerprints, containers with bytes, slices of containers, and the zip of k clouds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import binary as B
from ..params import Coding
from . import codec

CONTAINER = T.StructType([
    T.StructField("cloud", T.IntegerType()), T.StructField("user_id", T.IntegerType()), T.StructField("container_no", T.LongType()),
    T.StructField("first_seq", T.LongType()), T.StructField("last_seq", T.LongType()),
    T.StructField("entries", T.ArrayType(T.StructType([T.StructField("share_fp", T.BinaryType()), T.StructField("offset", T.LongType()), T.StructField("share_size", T.LongType())]))),
    T.StructField("data", T.BinaryType()),
])


def cloud_shares(chunks: DataFrame, coding: Coding | None = None, data: str = "chunk") -> DataFrame:
    """One row for each share: the chunks' columns without the bytes, cloud (0 to n - 1), share, share_fp, share_size.

    The fingerprint is the SHA-256 of the share itself, whatever the crypto pair.
    """
    coded = codec.encode(chunks, coding, data).drop(data)
    rows = coded.select(*[c for c in coded.columns if c != "shares"], F.posexplode("shares").alias("cloud", "share"))
    return rows.withColumns({"share_fp": B.fingerprint(F.col("share")), "share_size": F.octet_length("share").cast("long")})


def verified(shares: DataFrame) -> DataFrame:
    """Adds ok: whether a share's bytes have the fingerprint that came with them."""
    return shares.withColumn("ok", F.coalesce(B.fingerprint(F.col("share")) == F.col("share_fp"), F.lit(False)))


def pack_containers(placed: DataFrame, coding: Coding | None = None) -> DataFrame:
    """Containers of each cloud and user from secrets with their places: (user_id, container_no, offset, seq, chunk) to (cloud, user_id, container_no, first_seq, last_seq, entries, data).

    All shares of a secret have one size, so a place is the same in every cloud.
    ``entries`` says which share begins where, so that the index can always be made
    anew; fingerprints in it are binary, and ``first_seq`` and ``last_seq`` tell which files' secrets lie there.  Secrets travel as they are and are encoded beside their place; the n
    containers of one number come one behind another, and only these are in memory.
    """
    coding = coding or Coding()
    rows = placed.select(F.col("user_id").cast("int").alias("user_id"), "container_no", "offset", F.col("seq").cast("long").alias("seq"), "chunk")
    ordered = rows.repartition("user_id", "container_no").sortWithinPartitions("user_id", "container_no", "offset")
    coded = codec.encode(ordered, coding).select("user_id", "container_no", "offset", "seq", "shares")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, offsets, held, seqs = None, [], [], []

        def closed() -> pa.RecordBatch:
            sizes = [len(x[0]) for x in held]
            one = pa.StructArray.from_arrays([pa.array([hashlib.sha256(x[cloud]).digest() for cloud in range(coding.n) for x in held], pa.binary()), pa.array(offsets * coding.n, pa.int64()), pa.array(sizes * coding.n, pa.int64())], fields=list(kinds.field("entries").type.value_type))
            ends = pa.array(range(0, len(one) + 1, len(held)), pa.int32())
            entries = pa.ListArray.from_arrays(ends, one, type=kinds.field("entries").type)
            cols = [pa.array(range(coding.n), pa.int32()), pa.array([owner[0]] * coding.n, pa.int32()), pa.array([owner[1]] * coding.n, pa.int64()), pa.array([min(seqs)] * coding.n, pa.int64()), pa.array([max(seqs)] * coding.n, pa.int64()), entries, pa.array([b"".join(x[cloud] for x in held) for cloud in range(coding.n)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, schema=kinds)

        for batch in batches:
            for user, number, offset, seq, shares in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (user, number) != owner:
                    yield closed()
                    offsets, held, seqs = [], [], []
                owner = (user, number)
                if not offsets or offset != offsets[-1]:  # rows that repeat a file bring its secrets again
                    offsets.append(offset)
                    held.append(shares)
                    seqs.append(seq)
        if held:
            yield closed()

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(CONTAINER)
    return coded.mapInArrow(fold, CONTAINER)


def index_of(containers: DataFrame) -> DataFrame:
    """(cloud, share_fp, user_id, container_no, offset, share_size): where each share lies, read without the containers' bytes."""
    own = [c for c in containers.columns if c not in ("first_seq", "last_seq", "entries", "data")]
    return containers.select(*own, F.explode("entries").alias("e")).select(*own, F.lower(F.hex("e.share_fp")).alias("share_fp"), "e.offset", "e.share_size")


def fetch(wanted: DataFrame, containers: DataFrame) -> DataFrame:
    """(cloud, share_fp, share) of the distinct (cloud, user_id, container_no[, batch], share_fp, offset, share_size) wanted.

    The slices of a container are gathered first, so that its bytes travel once.
    """
    keys = [c for c in ("batch", "cloud", "user_id", "container_no") if c in containers.columns and c in wanted.columns]
    slices = wanted.select(*keys, "share_fp", "offset", "share_size").distinct().groupBy(*keys).agg(F.collect_list(F.struct("share_fp", "offset", "share_size")).alias("s"))
    right = slices.select(*[F.col(k).alias(f"__{k}") for k in keys], "s")
    on = [containers[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    held = containers.select(*keys, "data").join(right, on)
    cut = F.transform("s", lambda x: F.struct(x["share_fp"].alias("share_fp"), F.substring(F.col("data"), (x["offset"] + 1).cast("int"), x["share_size"].cast("int")).alias("share")))
    return held.select("cloud", F.explode(cut).alias("e")).select("cloud", "e.share_fp", "e.share")


def zip_containers(containers: DataFrame, coding: Coding | None = None) -> DataFrame:
    """(fp, secret): the zero-padded secrets of containers, from the shares of the first k clouds that have them whole; secrets that can't be rebuilt are left out.

    A share counts if its bytes have the fingerprint of its entry.  Containers of one
    number lie one behind another as ``pack_containers`` makes them; where some don't
    (they were written anew, or one is lost), they are brought together first.  Where
    ``containers`` has ``slots``, only the secrets at these offsets are rebuilt.
    """
    coding = coding or Coding()
    keys = [c for c in ("batch", "user_id", "container_no") if c in containers.columns]
    some = "slots" in containers.columns
    rows = containers.select(*keys, "cloud", "entries", "data", *["slots"] * some)
    n, k = len(keys), coding.k
    apart = containers.select(*keys, "cloud").mapInArrow(_apart(n, k), "n long").agg(F.sum("n")).first()[0]
    together = not apart
    if not together:
        rows = rows.repartition(*keys).sortWithinPartitions(*keys, "cloud")
    schema = "share_ids array<int>, kept array<binary>, secret_size long"

    def zipped(group: list[tuple]) -> Iterator[tuple[list[int], list[bytes]]]:
        found: dict[int, tuple[list[int], list[bytes]]] = {}
        for cloud, entries, data, slots in sorted(group, key=lambda x: x[0]):
            for fp, at, size in zip(*(entries.field(i).to_pylist() for i in range(3)), strict=True):
                if slots is not None and at not in slots:
                    continue
                ids, shares = found.setdefault(at, ([], []))
                if len(ids) < k and cloud not in ids and hashlib.sha256(x := data[at : at + size]).digest() == fp:
                    ids.append(cloud)
                    shares.append(x)
        return (x for x in found.values() if len(x[0]) == k)

    def out(group: list[tuple]) -> pa.RecordBatch:
        if together and len({x[0] for x in group}) < k:
            raise RuntimeError("containers of one number were not read together")
        ids, shares = zip(*found, strict=True) if (found := list(zipped(group))) else ((), ())
        sizes = [len(x[0]) * (k - coding.r) if coding.codec == "crsss" else len(x[0]) * k - coding.word for x in shares]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.binary())), pa.array(sizes, pa.int64())], names=["share_ids", "kept", "secret_size"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(n)), strict=True)):
                if group and key != now:
                    yield out(group)
                    group = []
                now = key
                group.append((batch.column(n)[i].as_py(), batch.column(n + 1)[i].values, batch.column(n + 2)[i].as_py(), set(batch.column(n + 3)[i].as_py()) if some else None))
        if group:
            yield out(group)

    back = codec.decode(rows.mapInArrow(fold, schema), coding).where("intact")
    return back.select(F.unhex(B.fingerprint(F.col("secret"))).alias("fp"), "secret")


def _apart(n: int, k: int):
    """Counts the groups of adjacent rows with equal first ``n`` columns that have fewer than ``k`` clouds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, clouds, apart = None, set(), 0
        for batch in batches:
            for *key, cloud in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    apart += now is not None and len(clouds) < k
                    now, clouds = key, set()
                clouds.add(cloud)
        yield pa.RecordBatch.from_arrays([pa.array([apart + (now is not None and len(clouds) < k)], pa.int64())], names=["n"])

    return count


def zip_clouds(rows: DataFrame, by: list[str], coding: Coding | None = None) -> DataFrame:
    """Secrets from the shares of k clouds: ``rows`` (by..., secret_id, secret_size, cloud, share) to (by..., secret_id, secret, intact).

    A group has at most n rows.  Of more than k clouds the first k serve; fewer leave
    the secret null.
    """
    coding = coding or Coding()
    got = rows.where("share is not null").groupBy(*by, "secret_id", "secret_size").agg(F.slice(F.array_sort(F.collect_list(F.struct("cloud", "share"))), 1, coding.k).alias("p"))
    ready = got.select(*by, "secret_id", "secret_size", F.transform("p", lambda x: x["cloud"]).alias("share_ids"), F.transform("p", lambda x: x["share"]).alias("kept"))
    return codec.decode(ready, coding).drop("share_ids", "kept")
