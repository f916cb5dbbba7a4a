"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .textstats import WORD
from .workspace import Workspace

#: Up to this many sources, the table of sources is broadcast (100 bytes a row); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
COARSE, FINE = 64, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*cols: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that the arguments decide: 48 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size and
    the excess is shared again by weight until none is above.  That fixed point is
    found at once: a source is capped iff its cap per weight is below the water
    level, so sources are taken in the order of cap per weight with running sums.
    Sources of size 0 have target 0.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
    s = s.withColumns({"weight": wheel[F.col("turn")], "cap": F.col("source_size") * most}).drop("turn")
    whole = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({
        "total": F.sum("source_size").over(whole) * share,
        "w_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "c_used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    })
    s = s.withColumn("level", (F.col("total") - F.col("c_used")) / F.col("w_left"))
    # the first source whose cap is not reached fixes the level for it and for all after it
    s = s.withColumn("open_level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
    s = s.withColumn("water", F.first("open_level", ignorenulls=True).over(by_cap.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return s.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    ws: Workspace,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    most: float = 2.0,
    seed: int = 20,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, inclusion, digest, copies, taken[, payload]) per row of ``docs``.

    A source's ratio is its target over its size.  Every document gets the whole
    copies in the ratio for certain.  One more copy goes by Pareto order sampling:
    documents are ranked by u / (1 - u) over p / (1 - p), u being a hash of id and
    seed and p the inclusion chance; p is the ratio's rest, less for documents of
    many words (they would make the sum jump) and more for the others.  The first in
    this order whose words come nearest to the words still due are included: a
    sample of fixed size in words.

    A null text has size 0, a null source is a source of its own, null and repeated
    ids are rows like others (equal rows tie and may be split by the cut; which of
    them is taken makes no difference).  Reruns agree.  ``payload`` has a row's own
    columns, whatever their names.  An empty table gives an
    empty result.
    """
    payload = [F.struct(*docs.columns).alias("payload")] * carry
    slim = ws.put(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), *payload), "slim")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sizes = ws.put(sizes, "sizes")
    n_sources = sizes.count()
    targets = source_targets(sizes.select("source", "source_size"), share, weights, most).join(sizes.select(F.col("source").alias("s2"), "rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("certain", F.floor(ratio + 1e-12)).withColumn("rest", F.greatest(ratio - F.col("certain"), F.lit(0.0)))
    targets = targets.withColumn("due", F.col("rest") * F.col("source_size")).withColumn("mean_size", F.col("source_size") / F.col("rows"))
    targets = ws.put(targets, "targets")

    def with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("source", "__s")
        table = F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table
        return rows.join(table, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")

    u = _uniform(F.col("doc_id"), F.col("digest"), seed=seed)
    # unequal chances: a document of the mean size has p = rest; larger ones less, smaller ones more
    odds = F.col("rest") / (1 - F.least("rest", F.lit(1 - 1e-9)))
    tilt = F.pow((F.col("size") + 1) / (F.col("mean_size") + 1), -0.1)
    p = odds * tilt / (1 + odds * tilt)
    rank = (u / (1 - u)) / F.greatest(p / (1 - p), F.lit(1e-12))
    # any increasing map of the rank orders the same; this one spreads it over (0, 1)
    key = rank / (1 + rank)
    ranked = with_source(slim, targets).withColumns({"inclusion": p, "key": key})
    bin_ = F.least(F.floor(F.col("key") * FINE), F.lit(FINE - 1)).cast("int")
    ranked = ranked.withColumn("bin", bin_)
    bins = ws.put(ranked.where("due > 0").groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")

    def boundary(level: DataFrame, unit: str) -> DataFrame:
        """Per source: the first unit with which the words due are reached, and the words before it."""
        packed = level.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(unit, "words"))).alias("a"), F.first("due").alias("due"), F.first("base").alias("base"))
        run = F.aggregate(
            "a",
            F.struct(F.col("base").alias("sum"), F.lit(-1).cast("int").alias("at")),
            lambda acc, x: F.when(acc["at"] >= 0, acc).otherwise(
                F.when(acc["sum"] + x["words"] >= F.col("due"), F.struct(acc["sum"].alias("sum"), x[unit].alias("at"))).otherwise(F.struct((acc["sum"] + x["words"]).alias("sum"), acc["at"].alias("at")))
            ),
        )
        return packed.select("source", "due", run.alias("r")).select("source", "due", F.col("r.sum").alias("base"), F.col("r.at").alias("at"))

    due = targets.select("source", "due")
    step = FINE // COARSE
    coarse = bins.withColumn("big", F.floor(F.col("bin") / step).cast("int")).groupBy("source", "big").agg(F.sum("words").alias("words"))
    coarse = with_source(coarse, due).withColumn("base", F.lit(0).cast("long"))
    at_big = ws.put(boundary(coarse, "big").withColumnRenamed("at", "at_big"), "coarse")
    fine = with_source(bins, at_big).where(F.floor(F.col("bin") / step) == F.col("at_big"))
    cut = ws.put(with_source(due, at_big.drop("due")).drop("base").join(boundary(fine, "bin").select(F.col("source").alias("s3"), "base", F.col("at").alias("cut_bin")), F.col("source").eqNullSafe(F.col("s3")), "left").drop("s3", "due"), "cut")

    # within one bin of one source (1 / 4096 of the source), the exact order
    placed = with_source(ranked, cut)
    at_cut = F.col("bin") == F.col("cut_bin")
    edge = placed.where(at_cut)
    order = W.partitionBy("source", "bin").orderBy("key", "doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    near = (earlier < F.col("due")) & (2 * (F.col("due") - earlier) >= F.col("size"))
    edge = edge.withColumn("extra", near.cast("int"))
    rest = placed.where(~F.coalesce(at_cut, F.lit(False))).withColumn("extra", F.when(F.col("due") <= 0, 0).when(F.col("at_big") < 0, 1).when(F.col("cut_bin").isNull(), 0).otherwise((F.col("bin") < F.col("cut_bin")).cast("int")))
    both = rest.unionByName(edge).withColumn("copies", (F.col("certain") + F.col("extra")).cast("int"))
    return both.select("doc_id", "source", "size", "source_size", "target", "inclusion", "digest", "copies", (F.col("size") * F.col("copies")).alias("taken"), *["payload"] * carry)
