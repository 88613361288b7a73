"""The label model against plain Python and planted truths, and toxicity's precision and recall on held-out labels."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import toxicity


def counted(votes):
    found, n = np.unique(votes, axis=0, return_counts=True)
    return found.astype(float), n.astype(float)


def planted(seed, n=20_000):
    """Three voters, and a copy of the first that repeats it 95 % of the time."""
    r = np.random.default_rng(seed)
    y = r.random(n) < 0.2
    votes = [r.random(n) < np.where(y, a, b) for a, b in ((0.7, 0.04), (0.6, 0.03), (0.5, 0.02))]
    copy = np.where(r.random(n) < 0.95, votes[0], r.random(n) < 0.3)
    return y, np.stack([*votes, copy], axis=1).astype(float)


def brute_posterior(votes, rate, parent, prior):
    out = []
    for row in votes:
        odds = [1 - prior, prior]
        for c in (0, 1):
            for j, v in enumerate(row):
                p = rate[c][int(row[parent[j]]) if parent[j] >= 0 else 0][j]
                odds[c] *= p if v else 1 - p
        out.append(odds[1] / sum(odds))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_label_model_against_plain_python(seed):
    _, votes = planted(seed)
    rows, n = counted(votes)
    post, rate, parent = toxicity.label_model(rows, n, 0.2, np.zeros(4, bool))
    assert post == pytest.approx(brute_posterior(rows, rate, parent, 0.2), rel=1e-4, abs=1e-6)
    # the forest is a distribution over all votes: the probabilities of every pattern add up to one in both classes
    every = np.array(list(itertools.product((0.0, 1.0), repeat=4)))
    assert np.exp(toxicity.likelihood(every, rate, parent)).sum(axis=1) == pytest.approx([1, 1])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_label_model_estimates_accuracies_and_correlations(seed):
    """Without any label: the copy hangs on what it copies, so it does not count twice; accuracies come near the truth."""
    y, votes = planted(seed)
    rows, n = counted(votes)
    post, rate, parent = toxicity.label_model(rows, n, 0.2, np.zeros(4, bool))
    assert parent[3] == 0 or parent[0] == 3
    child = 3 if parent[3] == 0 else 0
    assert rate[1, 1, child] > 0.8 and rate[0, 1, child] > 0.5, "the copy follows its model in both classes"
    of = {tuple(r): p for r, p in zip(rows.tolist(), post)}
    assert of[1, 0, 0, 1] - of[1, 0, 0, 0] < 0.2, "agreeing copies are next to no more evidence than one"
    for j in (1, 2):
        for c in (0, 1):
            p = np.where(c, post, 1 - post) * n
            assert (p @ rows[:, j]) / p.sum() == pytest.approx(votes[y == c, j].mean(), abs=0.08)


def test_forest_is_a_best_tree():
    """Of all forests over four voters none has more mutual information than the one found."""
    _, votes = planted(7)
    rows, n = counted(votes)
    post = np.full(len(rows), 0.3)
    parent = toxicity.forest(rows, n, post)

    def information(i, j):
        total = 0.0
        for p in (post * n, (1 - post) * n):
            for a, b in itertools.product((0, 1), repeat=2):
                both = p[(rows[:, i] == a) & (rows[:, j] == b)].sum() / p.sum()
                alone = p[rows[:, i] == a].sum() / p.sum() * p[rows[:, j] == b].sum() / p.sum()
                total += p.sum() / n.sum() * (both * math.log(both / alone) if both else 0)
        return total

    found = sum(information(i, p) for i, p in enumerate(parent) if p >= 0)
    for edges in itertools.combinations(itertools.combinations(range(4), 2), 3):
        linked = {frozenset([k]) for k in range(4)}
        for i, j in edges:
            a, b = (next(s for s in linked if x in s) for x in (i, j))
            linked = linked - {a, b} | {a | b}
        if len(linked) == 1:
            assert sum(information(i, j) for i, j in edges) <= found + 1e-9


def test_no_label_reaches_the_label_model(spark):
    """Turning the label of a row that the choice of voters does not depend on changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_precision_and_recall_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    hits = int(((m.predicted == 1) & (m.toxic == 1)).sum())
    assert hits / (m.toxic == 1).sum() >= 0.9 and hits / (m.predicted == 1).sum() >= 0.9


def test_repeated_rows_of_an_id_count_once_in_the_sample(spark):
    rows = [(1, "you idiot")] * 50 + [(2, "fine words"), (3, None), (None, "you idiot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    kept = sorted(tuple(r) for r in toxicity.sample(docs, labels).collect())
    assert kept == [(1, 1, "you idiot"), (2, 0, "fine words"), (3, 0, "")][: len(kept)] and all(i != 5 for i, *_ in kept)
    assert toxicity.score(docs, labels).count() == len(rows)
