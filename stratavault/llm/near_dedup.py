"""Near-duplicate documents: SetSketch registers, bands of registers, likelihood, then exact sets."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .components import connected_components
from .runs import each_run, in_block_pairs, spread_join
from .workspace import Workspace

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
BASE = 1.001
LIMIT = 65535  # registers are truncated to 0..LIMIT
RATE = 20.0
#: Pairs whose likelihood is greatest at a similarity this far below the threshold (7 standard deviations) are not compared exactly.
MARGIN = 0.18
#: Rounds of comparisons with one pivot go on while buckets hold more pairs apart than this for each of their rows, for MOST_STARS rounds at most; then blocks are compared, which covers all.
PAIRS_A_ROW, MOST_STARS = 16, 2
EMPTY = np.empty(0, np.uint64)


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its ``width``-word shingles; fewer words are one shingle, none give none.

    Words are runs of anything but ASCII blanks, A-Z lower-cased.  Each distinct
    word of the batch is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words = split.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    table = np.fromiter((digest(w.encode().lower()) if w else 0 for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    code = table[words.indices.to_numpy(zero_copy_only=False)]
    blank = code == 0  # a text of blanks alone, or blanks at its ends, splits off empty words
    bounds = split.offsets.to_numpy() - (split.offsets[0].as_py() if len(split) else 0)
    if blank.any():
        bounds = np.concatenate([[0], np.cumsum(~blank)])[bounds]
        code = code[~blank]
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(code) - width + 1), np.uint64)
        for k in range(width):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(h)])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:
            out.append(np.array([digest(code[a:b].tobytes()) | 1], np.uint64))
        else:
            out.append(EMPTY)
    return out


def registers(minima: np.ndarray) -> np.ndarray:
    """SetSketch registers of the least 32-bit hash per register.

    A least uniform u is a least exponential x = -log(1 - u) / RATE; the register is
    floor(1 - log x to BASE), truncated.  It falls as the minimum grows, so registers
    of parts merge by maximum.
    """
    x = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT).astype("<u2")


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS registers for each non-empty set; empty ones get zeros."""
    out = np.zeros((len(sets), REGISTERS), "<u2")
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    # a part of a long set at a time, so that what is at hand stays in the processor's cache
    a, b = _multipliers()
    part: list[np.ndarray] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        keys = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, part)])[:-1]
        low = np.empty((len(part), REGISTERS), np.uint32)
        with np.errstate(over="ignore"):
            for j in range(REGISTERS):
                low[:, j] = np.minimum.reduceat(keys * a[j] + b[j], starts)
        regs = registers(low)
        for row, i in zip(regs, owner, strict=True):
            np.maximum(out[i], row, out=out[i])

    for i in full:
        for at in range(0, len(sets[i]), 8192):
            part.append(sets[i][at : at + 8192])
            owner.append(i)
            held += len(part[-1])
            if held >= 8192:
                flush()
                part, owner, held = [], [], 0
    if part:
        flush()
    return out


def likeliest(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood for pairs of register rows of sets of known sizes.

    With u and v the sets' shares of na + nb, a register of the first is above the
    second's with chance p(u - v J), below with p(v - u J), p(x) being
    -log(1 - x (BASE - 1) / BASE) to BASE; else they are equal.
    """
    above, below = (ra > rb).sum(1), (ra < rb).sum(1)
    equal = ra.shape[1] - above - below
    u = na / (na + nb)
    v = 1 - u
    grid = np.linspace(0.0, 1.0, 201)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    for j in grid:
        ok = j <= np.minimum(u, v) / np.maximum(u, v) + 1e-9
        pa_, pb_ = p(u - v * j), p(v - u * j)
        ll = above * np.log(pa_) + below * np.log(pb_) + equal * np.log(np.clip(1 - pa_ - pb_, 1e-9, 1))
        better = ok & (ll > best)
        best[better], at[better] = ll[better], j
    return at


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1), width)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                regs = sketch(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(map(len, sets), pa.int64()),
                    pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()),
                    pa.array([int.from_bytes(k[8:], "little", signed=True) for k in keys], pa.int64()),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ], names=["doc_id", "n_shingles", "k1", "k2", "regs"])

    return run


def _keyed(width: int):
    """The class keys of texts, without sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(part.column(1), width)]
                k1, k2 = (pa.array([int.from_bytes(k[i : i + 8], "little", signed=True) for k in keys], pa.int64()) for i in (0, 8))
                yield pa.RecordBatch.from_arrays([part.column(0), k1, k2, part.column(1)], names=["doc_id", "k1", "k2", "text"])

    return run


def _own_ids(classes: DataFrame, ws: Workspace) -> DataFrame:
    """(k1, k2, first, n, cid): cid is the least id ``first``, but of classes with the same one all but one get ids above all others."""
    order = Window.partitionBy("first").orderBy("k1", "k2")
    ranked = ws.put(classes.withColumn("rank", F.row_number().over(order)), "classes-ranked")
    top = ranked.agg(F.max("first")).first()[0]
    # numbers without gaps: within 256 parts, after what the parts before hold
    part = F.pmod(F.xxhash64("k1", "k2"), F.lit(256))
    more = ranked.where("rank > 1").withColumn("part", part).withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("k1", "k2")))
    sizes = {r["part"]: r["count"] for r in more.groupBy("part").count().collect()}
    before, held = {}, 0
    for k in sorted(sizes):
        before[k], held = held, held + sizes[k]
    if not held:
        return ranked.select("k1", "k2", "first", "n", F.col("first").alias("cid"))
    offset = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])[F.col("part")]
    numbered = more.select("k1", "k2", "first", "n", (F.lit(top) + offset + F.col("i")).cast("long").alias("cid"))
    return ranked.where("rank = 1").select("k1", "k2", "first", "n", F.col("first").alias("cid")).unionByName(numbered)


def _promising(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in ("ra", "rb"))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("na", "nb"))
            keep = pa.array(likeliest(ra, rb, na, nb) >= floor)
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _linked(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets: dict[int, np.ndarray] = {}
                new: dict[int, str] = {}
                for key, text in ((k, t) for ks, ts in (("a", "ta"), ("b", "tb")) for k, t in zip(part.column(ks).to_pylist(), part.column(ts), strict=True)):
                    if key in seen:
                        seen.move_to_end(key)
                        sets[key] = seen[key]
                    elif key not in new:
                        new[key] = text.as_py()
                for key, s in zip(new, shingle_sets(pa.array(new.values(), pa.string()), width), strict=True):
                    sets[key] = seen[key] = s
                    held += len(s)
                while held > 2_000_000:
                    held -= len(seen.popitem(last=False)[1])
                ok = []
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    s, t = sets[a], sets[b]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(100 * common >= percent * (len(s) + len(t) - common))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _short_sets(width: int):
    """The sets with 32 bits a shingle, for comparing many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                short = [np.unique((s >> np.uint64(32)).astype("<u4")).tobytes() for s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(short, pa.binary())], names=["cid", "short"])

    return run


def _across(floor: float, percent: int):
    """Pairs of members of different components within each run that are linked, to judge by 32 bits a shingle.

    A pair is looked at in the first band in which it meets.  Chance agreements of
    32 bits can only add to what two sets share, equal bits within a set take away
    a few of its shingles; one shingle in a thousand is allowed for that.
    """

    def work(run: pa.Table) -> list[tuple]:
        cid, comp = run.column("cid").to_numpy(), run.column("component").to_numpy()
        if (comp == comp[0]).all():
            return []
        side, n = run.column("side").to_numpy(), run.column("n_shingles").to_numpy()
        band = run.column("t")[0].as_py()
        regs = np.frombuffer(b"".join(run.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, "<u4") for x in run.column("short").to_pylist()]
        out: list[tuple] = []
        for i in range(len(cid)):
            js = np.flatnonzero((comp != comp[i]) & (cid > cid[i]) & ((side != side[i]) | (side == -1)) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if not len(js):
                continue
            same = regs[js] == regs[i]
            first = same.reshape(len(js), BANDS, ROWS).all(2).argmax(1) == band
            js = js[first & (same.mean(1) >= floor - 0.05)]
            if not len(js):
                continue
            sizes = np.array([len(sets[j]) for j in js])
            every = np.concatenate([sets[j] for j in js])
            at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
            slack = 1 + np.maximum(n[js], n[i]) // 1000
            linked = 100 * (common + slack) >= percent * (n[js] + n[i] - common - slack)
            out += [(int(cid[i]), int(cid[j])) for j in js[linked]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in each_run(batches, "run", work):
            if rows:
                a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(
    spark: SparkSession, docs: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Documents whose shingle sets have 100 * common >= percent * union are linked;
    component_id is the smallest id reachable.  Equal sets are one class.  Classes
    that share a band of registers are candidates; a bucket is compared with one
    pivot a round (linear in the bucket), links merge components, and at last what
    is still apart in a bucket is compared block by block by registers and short sets, so
    that only links come out.  All pairs then pass the likelihood and the exact sets.

    A null or empty text has no shingles and is linked with nothing; a null id is a
    row of its own (component_id null, kept); rows that repeat an id, with whatever
    texts, share its component; an empty table gives an empty result.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    floor = percent / 100 - MARGIN
    sk = ws.put(d.mapInArrow(_sketched(width), "doc_id long, n_shingles long, k1 long, k2 long, regs binary"), "sketches")
    real = sk.where("doc_id is not null and n_shingles > 0")
    # ids that stand for several texts: their classes are linked, and no two classes go by the same id
    key = F.struct("k1", "k2")
    twice = ws.put(sk.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id"), "twice")
    repeats = not twice.isEmpty()
    classes = real.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = ws.put(_own_ids(ws.put(classes, "classes-least"), ws) if repeats else classes.withColumn("cid", F.col("first")), "classes")
    # by the least document's id, so that the copies of a class never meet
    least = classes.select(F.col("first").alias("doc_id"), "k1", "k2", "cid")
    reps = real.join(least, ["doc_id", "k1", "k2"]).select("cid", "n_shingles", "regs").dropDuplicates(["cid"])
    reps = ws.put(reps, "reps")
    ws.settle()

    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), (i * (2 * ROWS) + 1).cast("int"), F.lit(2 * ROWS))))
    banded = reps.select("cid", F.posexplode(band).alias("t", "key"))
    shared = ws.put(banded.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), "shared")
    members = ws.put(spread_join(banded, shared, "key", "g", "cid").drop("g"), "members")
    ws.drop("shared")

    texts = d.where("doc_id is not null").join(reps.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi")

    labels: DataFrame | None = None
    if repeats:
        several = d.join(twice, "doc_id", "left_semi").mapInArrow(_keyed(width), "doc_id long, k1 long, k2 long, text string").join(classes, ["k1", "k2"])
        exact = several.where("doc_id = first").select(F.col("cid").alias("doc_id"), "text")
        texts = texts.join(twice, "doc_id", "left_anti").unionByName(exact)
        owners = real.join(twice, "doc_id", "left_semi").join(classes, ["k1", "k2"]).select("doc_id", "cid").distinct()
        same_id = owners.join(owners.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").select("a", F.col("cid").alias("b"))
        labels = connected_components(same_id, ws, "cc-ids")

    def promising(pairs: DataFrame) -> DataFrame:
        left = reps.select(F.col("cid").alias("a"), F.col("regs").alias("ra"), F.col("n_shingles").alias("na"))
        right = reps.select(F.col("cid").alias("b"), F.col("regs").alias("rb"), F.col("n_shingles").alias("nb"))
        both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
        return both.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_promising(floor), "a long, b long")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = ws.put(pairs, f"{name}-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        own = texts.join(ends, "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"))
        own = ws.put(own, f"{name}-texts")
        both = pairs.join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        links = ws.put(both.select("a", "b", "ta", "tb").mapInArrow(_linked(width, percent), "a long, b long"), f"{name}-links")
        ws.settle()
        ws.drop(f"{name}-texts")
        return links

    tried: DataFrame | None = None
    at = members.withColumn("component", F.col("cid"))
    turn = 0
    while True:
        per_bucket = at.groupBy("key", "component").count().groupBy("key").agg(F.sum("count").alias("rows"), ((F.sum("count") * F.sum("count") - F.sum(F.col("count") * F.col("count"))) / 2).alias("pairs"))
        cross, rows = per_bucket.where("pairs > 0").agg(F.sum("pairs"), F.sum("rows")).first()
        if not cross:
            break
        last = cross <= PAIRS_A_ROW * rows or turn >= MOST_STARS
        # of each bucket whose members are in several components: its rows, and as pivot the one of least hash
        order = F.struct(F.xxhash64("cid", F.lit(turn)), F.col("cid"), F.col("component"))
        buckets = at.groupBy("key").agg(F.min(order).alias("p"), F.count("*").alias("g"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        buckets = ws.put(buckets.select("key", "g", F.col("p.cid").alias("p"), F.col("p.component").alias("pc")), f"buckets-{turn}")
        if not last or not turn:
            pairs = spread_join(at, buckets, "key", "g", "cid").where("component <> pc").select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b")).distinct()
            last = False
        else:
            ends = at.join(buckets.select("key"), "key", "left_semi").select(F.col("cid").alias("doc_id")).distinct()
            own = texts.join(ends, "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"))
            short = ws.put(own.mapInArrow(_short_sets(width), "cid long, short binary"), "short")
            dealt = in_block_pairs(at, buckets.select("key", "g"), "key", "cid").join(reps, "cid").join(short, "cid").select("run", "side", "t", "cid", "component", "n_shingles", "regs", "short")
            runs = dealt.repartition("run").sortWithinPartitions("run")
            pairs = runs.mapInArrow(_across(floor, percent), "a long, b long").distinct()
        fresh = ws.put(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), f"pairs-{turn}")
        tried = fresh if tried is None else tried.unionByName(fresh)
        links = verified(promising(fresh), f"turn-{turn}")
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = connected_components(links, ws, f"cc-{turn}")
        if last:
            break
        at = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "t", "key", F.coalesce("component", "cid").alias("component"))
        at = ws.put(at, f"labelled-{turn}")
        ws.drop(f"buckets-{turn}", f"labelled-{turn - 1}")
        turn += 1

    if labels is None:
        labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component"))
    of_class = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("k1", "k2", "n", F.coalesce("component", "cid").alias("component_id"))
    of_class = ws.put(of_class, "of-class")
    ws.keep_only("sketches", "twice", "of-class")
    done = spread_join(real.select("doc_id", "n_shingles", "k1", "k2"), of_class, ["k1", "k2"], "n", "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = sk.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if repeats:
        shared = done.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("component_id").alias("c"))
        alone = alone.join(shared, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "component_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
