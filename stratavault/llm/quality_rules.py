"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .textstats import STATS, measure

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: name, numerator, denominator, a ratio up to this is a vote for good (None: never), from this on a vote for bad; otherwise the rule abstains.
RULES = [
    ("symbols", "n_symbols", "word_chars", None, 0.05),
    ("symbol_words", "n_symbols", "n_words", None, 0.5),
    ("shouting", "n_upper", "n_letters", None, 0.5),
    ("exclaims", "n_shout", "n_words", None, 0.3),
    ("dup_lines", "n_dup_lines", "n_lines", None, 0.6),
    ("repeats", "n_repeat_words", "n_words", 0.1, 0.4),
    ("bars", "n_bars", "n_words", None, 0.3),
    ("digits", "n_digits", "word_chars", 0.03, 0.3),
]
PRIOR_GOOD = 0.85
MIN_WORDS = 50


def _ratio(num: str, den: str):
    return F.col(num) / F.greatest(F.col(den), F.lit(1))


def vote(num: str, den: str, good: float | None, bad: float):
    """1 bad, 2 good, 0 abstains."""
    voted = F.when(_ratio(num, den) >= bad, 1)
    return (voted if good is None else voted.when(_ratio(num, den) <= good, 2)).otherwise(0)


def _measured(schema: pa.Schema, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [measure(x.as_py()) for x in part.column(text)]
                cols = [part.column(i) for i in range(part.num_columns)]
                cols += [pa.array([r[k] for r in rows], pa.int64()) for k in STATS]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def with_stats(docs: DataFrame, text: str, keep: list[str], prefix: str = "__") -> DataFrame:
    """``keep`` columns and, under a private prefix, every count of the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    src = docs.select(*keep, *([] if text in keep else [text]))
    out = T.StructType(src.schema.fields + [T.StructField(f"{prefix}{k}", T.LongType()) for k in STATS])
    return src.mapInArrow(_measured(to_arrow_schema(out), text), out)


#: What is believed of any rule before the data: chances of (abstaining, voting bad, voting good) on bad and on good texts.
BELIEF = np.array([[0.5, 0.3, 0.2], [0.296, 0.004, 0.7]])
BELIEF_SHARE = 0.1  # of the rows
#: A rule is only a rule if it seldom votes bad on good texts and at times on bad ones; this keeps either class what its name says.
MOST_FALSE_ALARMS, FEWEST_ALARMS = 0.01, 0.05


def em_posteriors(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """P(good | votes) for each vote pattern, by EM over pattern counts (Dawid-Skene with abstentions).

    Each rule has its own chances of voting bad, good or not at all under either
    class, estimated together with the share of good texts; BELIEF is the prior.
    No patterns give an empty result.
    """
    if not patterns:
        return {}
    votes = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    onehot = np.eye(3)[votes]
    able = onehot.any(0)  # a rule that never votes good is no evidence for bad by not doing so
    post = np.where((votes == 1).any(1), 0.05, PRIOR_GOOD)
    for _ in range(rounds):
        log_theta = []
        for belief, share in ((BELIEF[0], 1 - post), (BELIEF[1], post)):
            mass = weight * share
            counts = np.einsum("p,prv->rv", mass, onehot)
            prior = able * belief
            counts = counts + (BELIEF_SHARE * mass.sum() + 1) * prior / prior.sum(1, keepdims=True)
            rate = counts / counts.sum(1, keepdims=True)
            is_good = len(log_theta) == 1
            rate[:, 1] = np.where(able[:, 1], np.minimum(rate[:, 1], MOST_FALSE_ALARMS) if is_good else np.maximum(rate[:, 1], FEWEST_ALARMS), 0)
            log_theta.append(np.log(np.maximum(rate / rate.sum(1, keepdims=True), 1e-9)))
        good = np.clip((weight * post).sum() / weight.sum(), 0.5, 0.98)
        odds = np.log(good / (1 - good)) + np.einsum("prv,rv->p", onehot, log_theta[1] - log_theta[0])
        post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    return {p: float(x) for (p, _), x in zip(patterns, post, strict=True)}


def free_prefix(columns: list[str]) -> str:
    """Underscores, two at least, that no column begins with."""
    return "_" * (1 + max(1, *(len(c) - len(c.lstrip("_")) for c in columns)))


def score_quality(spark: SparkSession, docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5, ws=None) -> DataFrame:
    """``keep`` columns (all by default) with the counts and the verdict of each row.

    Added columns, prefixed with ``free_prefix`` of the kept ones so that they clash
    with nothing: the counts of ``textstats.measure``, votes, posterior, base_failed,
    kept.  A null or empty text has no words and fails the base; repeated rows are
    judged alike; an empty table gives an empty result.  The vote patterns that reach
    the driver are at most 3 ** len(RULES), whatever the input.
    """
    keep = keep or docs.columns
    at = free_prefix(keep)
    stats = with_stats(docs, text, keep, at)
    coded = F.concat_ws("", *[vote(f"{at}{a}", f"{at}{b}", g, x).cast("string") for _, a, b, g, x in RULES])
    base = (F.col(f"{at}n_words") < MIN_WORDS) | (100 * F.col(f"{at}n_repeat_words") > 50 * F.col(f"{at}n_words"))
    stats = stats.withColumns({f"{at}votes": coded, f"{at}base_failed": base})
    if ws is not None:
        stats = ws.put(stats, "stats")
        counted = stats
    else:
        counted = with_stats(docs, text, [text], at).withColumn(f"{at}votes", coded)
    rows = counted.groupBy(f"{at}votes").count().collect()
    post = em_posteriors(sorted((tuple(map(int, r[0])), r[1]) for r in rows))
    table = F.create_map(*[F.lit(x) for p, v in sorted(post.items()) for x in ("".join(map(str, p)), v)]) if post else None
    posterior = table[F.col(f"{at}votes")] if post else F.lit(PRIOR_GOOD)
    return stats.withColumn(f"{at}posterior", posterior).withColumn(f"{at}kept", ~F.col(f"{at}base_failed") & (F.col(f"{at}posterior") >= threshold))
