"""The rule ensemble against plain Python: statistics, rules, lasso, compiled score; held-out accuracy."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import quality


def plain_statistics(t):
    words, lines = re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ")), t.split("\n")
    safe = max(len(t), 1)
    share = lambda pattern: sum(len(m) for m in re.findall(pattern, t)) / safe
    return {
        "log_chars": math.log1p(len(t)), "mean_word": safe / len(words), "distinct_words": len(set(words)) / len(words), "mean_line": safe / len(lines),
        "distinct_lines": len(set(lines)) / len(lines), "upper": share("[A-ZÀ-Þ]+"), "digits": share("[0-9]+"), "sentence_marks": share("[.,;]+"),
        "symbols": share(r"[#$%&*|!@~^_=<>{}\[\]\\/+]+"), "bangs": share("!+"), "bars": share("[|]+"),
    }


def test_statistics_against_plain_python(spark):
    r = random.Random(1)
    texts = ["", " ", "a", "A b\nA b\n", "ÀÉ 12!! |#| {x}.", "one  two\tthree", None, "long word " * 20_000]
    texts += ["".join(r.choices("abC ÀÖ1,.;!|#\n", k=r.randrange(200))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in quality.measured(rows, "doc_id").collect():
        for name, value in plain_statistics(texts[x["doc_id"]] or "").items():
            assert x[f"s_{name}"] == pytest.approx(value), (name, texts[x["doc_id"]])


def holds(rule, row):
    return all((row[f] <= cut) == at_most for f, at_most, cut in rule)


def data(seed, n=400):
    r = np.random.default_rng(seed)
    x = r.random((n, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 1] <= 0.7) | (x[:, 2] > 0.9)).astype(float)
    return x, np.where(r.random(n) < 0.03, 1 - y, y)


def test_rules_are_paths_that_rows_fulfil():
    x, y = data(1)
    rules = quality.rules_of(x, y)
    m = quality.matrix(x, rules)
    assert m.shape == (400, len(rules)) and max(map(len, rules)) == 3
    for k in range(0, len(rules), 7):
        assert m[:, k].tolist() == [float(holds(rules[k], row)) for row in x]
    assert m.sum(axis=0).min() >= 1


@pytest.mark.parametrize("penalty", [0.03, 0.003])
def test_lasso_meets_its_optimality_conditions(penalty):
    """The gradient equals the penalty where a weight is not 0, and is within it elsewhere; no step improves the objective."""
    x, y = data(2)
    m = quality.matrix(x, quality.rules_of(x, y)[:40])
    b, w = quality.lasso(m, y, penalty, 20_000)
    residual = 1 / (1 + np.exp(-(m @ w + b))) - y
    gradient = m.T @ residual / len(y)
    assert abs(residual.mean()) < 1e-3
    on = np.abs(w) > 1e-4
    assert on.any() and gradient[on] == pytest.approx(-penalty * np.sign(w[on]), abs=2e-3)
    assert (np.abs(gradient[~on]) <= penalty + 2e-3).all()
    goal = lambda b, w: quality.loss(m, y, b, w) + penalty * np.abs(w).sum()
    r = np.random.default_rng(0)
    assert all(goal(b, w) <= goal(b + r.normal() * 0.05, w + r.normal(size=len(w)) * 0.05) + 1e-6 for _ in range(50))


def test_compiled_score_against_the_rules(spark):
    x, y = data(3)
    names = ["p", "q", "r", "s"]
    b, weighted = quality.fit(x, y)
    assert 0 < len(weighted) < len(quality.rules_of(x, y))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, " + ", ".join(f"s_{n} double" for n in names))
    got = {r["id"]: r["score"] for r in rows.select("id", quality.compile_rules(names, b, weighted).alias("score")).collect()}
    for i, row in enumerate(x):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(b + sum(w for rule, w in weighted if holds(rule, row))))))
    right = np.mean([(got[i] >= 0.5) == (y[i] == 1) for i in range(len(y))])
    assert right >= 0.93


def test_precision_and_recall_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = quality.score(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    for label in (0, 1):
        hits = int(((m.predicted == label) & (m.quality == label)).sum())
        assert hits >= 0.95 * (m.quality == label).sum() and hits >= 0.95 * (m.predicted == label).sum()


def test_repeated_ids_do_not_grow_the_fit(spark):
    rows = [(i, f"text {i} " * (1 + i % 5)) for i in range(60)] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = {r["doc_id"]: r["score"] for r in quality.score(docs.distinct(), labels).collect()}
    assert all(r["score"] == once[r["doc_id"]] for r in quality.score(docs.withColumn("_label", F.lit(7)), labels).collect())
