"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Statistics of the text are column expressions. On a bounded sample of labelled training rows boosted
depth-3 trees are grown; every path from a root becomes a conjunctive rule over the statistics; a
logistic model with lasso penalty over the rules keeps few of them; the kept rules and weights are
compiled into one Spark column, so scoring is a plain projection without Python.

The statistics are computed over whole texts of all rows; only the fit is on a sample of at most
SAMPLE labelled rows (the smallest hashes of their ids, the same at every run).

Defined cases: a null text is empty and scored from its statistics; repeated ids are scored each; of
contradicting labels the larger counts, and of rows that repeat an id the fit takes the one with the largest
statistics; without labels of both classes the score is the share of
label 1 (0.5 without any label); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_labels, text_of

#: Labelled training rows for the fit; trees; smallest leaf; lasso penalties tried on a fifth of the sample.
SAMPLE, TREES, LEAF, PENALTIES = 12_000, 16, 12, (0.03, 0.01, 0.003, 0.001)
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; each takes one pass at most and shared passes are shared."""
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    chars = F.length(text)
    words = F.split(F.trim(text), r"\s+")
    lines = F.split(text, "\n")
    safe = F.greatest(chars, F.lit(1)).cast("double")
    n_words, n_lines = F.size(words).cast("double"), F.size(lines).cast("double")
    share = lambda pattern: (chars - left(pattern)) / safe
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "mean_word": safe / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "mean_line": safe / n_lines,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "upper": share("[A-ZÀ-Þ]+"),
        "digits": share("[0-9]+"),
        "sentence_marks": share("[.,;]+"),
        "symbols": share(r"[#$%&*|!@~^_=<>{}\[\]\\/+]+"),
        "bangs": share("!+"),
        "bars": share("[|]+"),
    }


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the statistics, prefixed ``s_``."""
    found = statistics(F.col("_text"))
    return docs.select(*keep, text_of().alias("_text")).select(*keep, *[c.cast("double").alias(f"s_{n}") for n, c in found.items()])


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list) -> np.ndarray:
    """Second-order regression tree on quantile cuts; appends the path of every node below the root."""
    value = np.zeros(len(x))
    value[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 2 * LEAF:
        return value
    total, best = (g[rows].sum() ** 2) / (h[rows].sum() + 1.0), (1e-6, None)
    for f in range(x.shape[1]):
        column = x[rows, f]
        for cut in np.unique(np.quantile(column, np.linspace(0.02, 0.98, 25))):
            low = column <= cut
            n = int(low.sum())
            if LEAF <= n <= len(rows) - LEAF:
                a, b = rows[low], rows[~low]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - total
                if gain > best[0]:
                    best = (gain, (f, float(cut)))
    if best[1] is None:
        return value
    f, cut = best[1]
    low = x[rows, f] <= cut
    for side, part in ((True, rows[low]), (False, rows[~low])):
        step = (*path, (f, side, cut))
        out.append(step)
        value[part] = grow(x, g, h, part, step, depth - 1, out)[part]
    return value


def rules_of(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Paths of boosted trees as rules: tuples of (feature, at most?, cut)."""
    score, found, rng = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), [], np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.sort(rng.choice(len(y), max(2 * LEAF, len(y) * 3 // 4), replace=len(y) < 4 * LEAF))
        grow(x, y - p, p * (1 - p), rows, (), 3, paths := [])
        found += paths
        full = grow(x, y - p, p * (1 - p), np.arange(len(y)), (), 3, [])
        score = score + 0.3 * full
    return sorted(set(found), key=lambda r: (len(r), r))


def matrix(x: np.ndarray, rules: list[tuple]) -> np.ndarray:
    return np.stack([reduce(np.logical_and, [(x[:, f] <= c) == side for f, side, c in r]) for r in rules], axis=1).astype(float)


def lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic lasso by accelerated proximal gradient; the intercept is free."""
    w, b = np.zeros(m.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rate = 4.0 / (np.linalg.norm(np.c_[m, np.ones(len(m))], 2) ** 2 / len(m))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(m @ v + c))) - y
        w2 = v - rate * (m.T @ r) / len(y)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def loss(m: np.ndarray, y: np.ndarray, b: float, w: np.ndarray) -> float:
    p = np.clip(1 / (1 + np.exp(-(m @ w + b))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple, float]]]:
    """Intercept and (rule, weight) pairs; the penalty is the one with the least loss on every fifth row."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if len(y) < 4 * LEAF or y.min() == y.max():
        return start, []
    rules = rules_of(x, y)
    if not rules:
        return start, []
    m, test = matrix(x, rules), np.arange(len(y)) % 5 == 0
    tried = [(loss(m[test], y[test], *lasso(m[~test], y[~test], p)), p) for p in PENALTIES]
    b, w = lasso(m, y, min(tried)[1])
    return b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6]


def compile_rules(names: list[str], intercept: float, weighted: list[tuple[tuple, float]]) -> Column:
    """The score as one column over the statistics."""
    def holds(rule: tuple) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(f"s_{names[f]}") <= c) if side else (F.col(f"s_{names[f]}") > c) for f, side, c in rule])

    total = F.lit(intercept)
    for rule, weight in weighted:
        total = total + F.when(holds(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Column:
    names = list(statistics(F.lit("")))
    chosen = sample_labels(labels, "quality", ~held_out("doc_id", 4, 2), rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    # one row an id, so the fit's rows are bounded by ``rows`` whatever repeats
    stats = [F.col(f"s_{n}") for n in names]
    once = measured(joined, "doc_id", "_label").groupBy("doc_id", "_label").agg(F.max(F.struct(*stats)).alias("s")).select("doc_id", "_label", "s.*")
    table = once.toPandas().sort_values("doc_id")
    x = table[[f"s_{n}" for n in names]].to_numpy(float)
    return compile_rules(names, *fit(x, table["_label"].to_numpy(float)))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    made = measured(docs, "doc_id").withColumn("score", train(docs, labels))
    return made.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
