import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from stratavault.llm import classifier, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labels(sf_dir: str, name: str) -> dict[int, int]:
    return {r["doc_id"]: r[name] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist() if r[name] is not None}


def base(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    c = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = len({k + d for k in range(len(words) - 2) if c[tuple(words[k : k + 3])] > 1 for d in range(3)})
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    return len(words), sum(map(len, words)), sum(x in "#*$%&|<>" for x in text), dup, repeated, failed


def test_base_counts_as_brute_force_and_verdict_as_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    marks, right, of = labels(sf_dir, "quality"), 0, 0
    for r in queries.queries()["op2_quality_rules"](spark, sf_dir).collect():
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1
        if r["doc_id"] in marks and not r["base_failed"]:
            of += 1
            right += r["kept"] == bool(marks[r["doc_id"]])
    assert of > 300 and right >= 0.98 * of


def test_em_weighs_rules_by_what_they_agree_on():
    # no labels: rules that vote together on bad texts must earn more weight than one that votes at random
    rng = np.random.default_rng(3)
    good = rng.random(40_000) < 0.8
    votes = np.zeros((len(good), 5), int)
    for k, caught in enumerate([0.9, 0.8, 0.6]):
        votes[:, k] = np.where(~good & (rng.random(len(good)) < caught), 1, np.where(good & (rng.random(len(good)) < 0.005), 1, 0))
    votes[:, 3] = np.where(rng.random(len(good)) < 0.004, 1, 0)  # knows nothing
    votes[:, 4] = np.where(good & (rng.random(len(good)) < 0.8), 2, np.where(~good & (rng.random(len(good)) < 0.1), 2, 0))
    patterns = Counter(map(tuple, votes.tolist()))
    post = quality_rules.em_posteriors(sorted(patterns.items()))
    kept = np.array([post[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (kept == good).mean() > 0.98
    noise, strong = post[0, 0, 0, 1, 2], post[1, 0, 0, 0, 0]
    assert noise > 0.5 > strong, "a rule that knows nothing does not outvote the others"


def test_classifier_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = queries.queries()["op4_quality_classifier"](spark, sf_dir).collect()
    marks = labels(sf_dir, "quality")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    y, s = map(np.array, zip(*((marks[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in marks), strict=True))
    order = s.argsort(kind="stable").argsort() + 1
    ties = {v: order[s == v].mean() for v in set(s.tolist())}
    ranks = np.array([ties[v] for v in s.tolist()])
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(y) > 500 and auc > 0.98
    assert ((s >= 0.3) == y).mean() > 0.95
    for low, high in ((0, 0.2), (0.8, 1.01)):  # calibrated: of rows with such scores such a share is good
        some = (s >= low) & (s < high)
        assert abs(s[some].mean() - y[some].mean()) < 0.05


def test_calibration_is_of_rows_that_a_score_has_not_seen():
    x, y = np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1])
    knots, levels = classifier.isotonic(x, y, np.ones(4))
    assert knots.tolist() == [0, 1.5, 3] and levels.tolist() == [0, 0.5, 1]
    assert classifier.FOLDS >= 2
