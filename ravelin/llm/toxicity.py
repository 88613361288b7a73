"""Toxicity by weak supervision: a generative label model over many voters, then a linear classifier.

Voters look at the distinct words of a text. Lexicon voters are groups of insults by theme; pattern voters
are groups of word beginnings mined from labelled training rows (a beginning that many toxic and next to no
other texts hold, e.g. of a compound or an inflected insult). A voter without a hit abstains.

The label model never sees a label. It is fitted to the vote patterns of all documents that are neither
held out nor labelled, each distinct pattern with its number of documents (at most 2 ** VOTERS patterns, so
the driver's share is bounded). Given the class the votes form a forest: each voter depends on the class and
on one other voter at most, the one with the largest mutual information that the class leaves. The rates of
a vote given class and parent's vote are the accuracies and correlations, and expectation-maximisation
estimates them with the forest. Labels serve for choosing voters and for the class balance alone; what the
choice grants (a pattern voter is right PRECISION of the time) bounds its rate among clean texts.

A logistic regression over the votes, fitted to the model's posteriors of the same patterns, scores every
whole text.

The mining sample is bounded (SAMPLE labelled rows and SAMPLE_CHARS characters, by smallest id hash;
a longer text counts whole). Scoring and the label model cover all rows.

Defined cases: a null text is empty and scored like any text without a vote; repeated ids are scored each, and
in the sample equal rows of an id count once; of contradicting labels the larger counts; without labels only the
fixed voters work; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ease, held_out, lean, materialize, sample_labels, text_of, trim, without

SAMPLE, SAMPLE_CHARS = 8_000, 60_000_000
#: Voters at most; patterns are counted as bits of one number.
VOTERS = 16
#: Beginnings of words that are mined: lengths, distinct words asked for, most kept, toxic texts they must gain, their precision.
BEGINNINGS, LEAST, MINED, SUPPORT, PRECISION = (4, 5, 6, 7, 8), (1, 2, 3), 100, 4, 0.9
#: Share of toxic texts among those with a word, from which the words voter takes it.
WORD_PRECISION = 0.7
THRESHOLD = 0.5
MEMO = 200_000

# Insults by theme, in the languages of the corpus' alphabets.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid imbecile dumb fool dimwit halfwit idiota imbécil estúpido estúpida tonto idiotin dumm dummkopf trottel blöd imbécile débile crétin abruti stupide",
    "worth": "loser losers worthless useless pathetic failure inútil patético fracasado wertlos versager erbärmlich nutzlos minable inutile pitoyable",
    "filth": "scum trash garbage filth vermin disgusting gross basura escoria asqueroso abschaum dreck widerlich ekelhaft ordure déchet dégoûtant dégueulasse",
    "mockery": "clown clowns joke freak creep weirdo payaso bicho witzfigur spinner bouffon guignol",
    "threat": "kill hurt destroy beat murder morir matar sterben töten umbringen crever tuer",
    "profanity": "damn crap bastard bitch asshole shit fuck fucking mierda puta cabrón scheiße arschloch hurensohn merde putain connard salope",
}
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Mined(NamedTuple):
    """What training labels chose: (word beginning, least number of distinct words, voter) triples, and the words of the last voter with theirs."""

    marks: list[tuple[str, int, int]] = []
    words: frozenset[str] = frozenset()
    least: int = 0


class Voters:
    """Votes of a text."""

    def __init__(self, mined: Mined) -> None:
        self.mined = mined
        self.size = VOTERS if mined.words else max([len(LEXICONS), *(k + 1 for *_, k in mined.marks)])
        self.lexicon = {w: i for i, line in enumerate(LEXICONS.values()) for w in line.split()}
        self.begin = {b: (least, voter) for b, least, voter in mined.marks}
        self.memo: dict[str, tuple[str | int, ...]] = {}

    def of_word(self, w: str) -> tuple[str | int, ...]:
        """The lexicon voter that knows the word, the beginnings it has, and "" for a mined word."""
        hit = self.memo.get(w)
        if hit is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = [self.lexicon[w]] if w in self.lexicon else []
            found += [""] if w in self.mined.words else []
            hit = self.memo[w] = (*found, *(w[:n] for n in BEGINNINGS if len(w) >= n and w[:n] in self.begin))
        return hit

    def pattern(self, text: str) -> int:
        """The voters that speak, as bits."""
        out, seen = 0, Counter()
        for w in words(text):
            for x in self.of_word(w):
                if isinstance(x, int):
                    out |= 1 << x
                else:
                    seen[x] += 1
        for x, n in seen.items():
            least, voter = self.begin[x] if x else (self.mined.least, VOTERS - 1)
            if n >= least:
                out |= 1 << voter
        return out


def votes_of(patterns: np.ndarray, m: int) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(m)) & 1).astype(float)


def mine(texts: list[str], y: np.ndarray) -> Mined:
    """Word beginnings that mark toxic texts, each with the number of distinct words from which it does, and its voter.

    A stem may also come up by chance, so one or two words of it can be harmless where three are not.
    Greedy cover: the pair that gains most goes first; a toxic text is covered once, and a clean text
    costs as much as precision demands, every time. Beginnings with the same first letters are one voter;
    further ones share the voters in turn.
    """
    toxic: dict[tuple[str, int], set[int]] = {}
    clean: Counter = Counter()

    def marks(text: str) -> set[tuple[str, int]]:
        n = Counter(w[:k] for w in words(text) for k in BEGINNINGS if len(w) >= k)
        return {(b, k) for b, m in n.items() for k in LEAST if m >= k}

    often: Counter = Counter()
    for i in np.flatnonzero(y == 1):
        often.update(marks(texts[i]))
    often = {m for m, n in often.items() if n >= SUPPORT}
    for i in np.flatnonzero(y == 1):
        for mark in marks(texts[i]) & often:
            toxic.setdefault(mark, set()).add(int(i))
    for i in np.flatnonzero(y != 1):
        clean.update(marks(texts[i]) & toxic.keys())
    cost = PRECISION / (1 - PRECISION) / 2
    gain = {m: len(found) - cost * clean[m] for m, found in toxic.items()}
    ranked = sorted((m for m, g in gain.items() if g >= SUPPORT), key=lambda m: (-gain[m], m))[: 20 * MINED]
    covered: Counter = Counter()
    chosen: dict[str, int] = {}
    while ranked and len(chosen) < MINED:
        left = [(len([i for i in toxic[m] if covered[i] < 2]) - cost * clean[m], m) for m in ranked]
        best, mark = max(left, key=lambda x: (x[0], -len(x[1][0]), x[1]))
        if best < SUPPORT:
            break
        chosen[mark[0]] = mark[1]
        covered.update(toxic[mark])
        ranked = [m for g, m in left if g >= SUPPORT and m[0] not in chosen]
    stems = dict.fromkeys(b[: BEGINNINGS[0]] for b in chosen)
    voter = {stem: len(LEXICONS) + k % (VOTERS - 1 - len(LEXICONS)) for k, stem in enumerate(stems)}
    return Mined(sorted((b, k, voter[b[: BEGINNINGS[0]]]) for b, k in chosen.items()), *mostly_toxic(texts, y))


def mostly_toxic(texts: list[str], y: np.ndarray) -> tuple[frozenset[str], int]:
    """Whole words that WORD_PRECISION of their texts are toxic with, and how many of them make PRECISION.

    Chance words look precise on the rows that chose them, so their precision is taken on every fifth row by
    the words of the others, in turn.
    """
    number: dict[str, int] = {}
    each = [np.fromiter((number.setdefault(w, len(number)) for w in sorted(words(t))), np.int32) for t in texts]
    fold = np.arange(len(y)) % 5

    def chosen(rows: np.ndarray) -> np.ndarray:
        clean, toxic = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(each[i] for i in rows[y[rows] == c])]), minlength=len(number)) for c in (0, 1))
        return (toxic >= SUPPORT) & (toxic >= WORD_PRECISION * (toxic + clean))

    held = np.zeros(len(y), int)
    for k in range(5):
        found = chosen(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            held[i] = found[each[i]].sum()
    for least in LEAST:
        hits = held >= least
        if hits.sum() >= SUPPORT and y[hits].mean() >= PRECISION:
            found = chosen(np.arange(len(y)))
            return frozenset(w for w, i in number.items() if found[i]), least
    return frozenset(), 0


def forest(votes: np.ndarray, weight: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Each voter's parent, -1 for none: the spanning forest of most mutual information given the class."""
    m = votes.shape[1]
    shared = np.zeros((m, m))
    for p in (post * weight, (1 - post) * weight):
        total = p.sum() + 1e-9
        both = (votes * p[:, None]).T @ votes / total
        one = np.diag(both).copy()
        for joint, a, b in ((both, one, one), (one[:, None] - both, one, 1 - one), (one[None, :] - both, 1 - one, one), (1 - one[:, None] - one[None, :] + both, 1 - one, 1 - one)):
            joint = np.maximum(joint, 0)
            shared += total / weight.sum() * np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(np.outer(a, b), 1e-12)), 0)
    parent, tree = np.full(m, -1), list(range(m))
    edges = sorted(((shared[i, j], i, j) for i in range(m) for j in range(i)), reverse=True)
    linked: dict[int, list[int]] = {i: [] for i in range(m)}
    for gain, i, j in edges:
        # twice the likelihood gained is chi-squared with two degrees of freedom: 13.8 is one in a thousand
        if tree[i] != tree[j] and 2 * weight.sum() * gain > 13.8:
            old, new = tree[i], tree[j]
            tree = [new if t == old else t for t in tree]
            linked[i].append(j)
            linked[j].append(i)
    seen = set()
    for root in range(m):
        stack = [] if root in seen else [(root, -1)]
        while stack:
            i, up = stack.pop()
            seen.add(i)
            parent[i] = up
            stack += [(j, i) for j in linked[i] if j not in seen]
    return parent


def likelihood(votes: np.ndarray, rate: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Log-likelihood of each row of votes in both classes; rate[class, parent's vote, voter]."""
    above = np.where(parent >= 0, votes[:, parent], 0).astype(int)
    at = np.arange(votes.shape[1])
    return np.stack([np.where(votes > 0, np.log(rate[c][above, at]), np.log1p(-rate[c][above, at])).sum(axis=1) for c in (0, 1)])


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 of each row of votes, rates (class, parent's vote, voter), parents.

    ``weight`` is the number of documents with these votes; ``chosen`` marks the voters picked for their
    precision. Rates have a Beta prior that holds them off 0 and 1. Class 1 stays the toxic one, since a vote
    is never evidence against its class. Of several starts the likeliest end counts.
    """
    quiet, sure = np.full(len(votes), prior), np.where(votes[:, chosen].any(axis=1), 0.9, np.where(votes.any(axis=1), 0.5, prior / 4))
    several = np.where(votes.sum(axis=1) >= 2, 0.9, np.where(votes.any(axis=1), 0.3, prior / 4))
    runs = [_maximise(votes, weight, prior, chosen, post, hang) for post in (sure, several) for hang in (quiet, post)]
    return max(runs, key=lambda x: x[0])[1:]


def _maximise(votes, weight, prior, chosen, post, hang) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation from a first posterior ``post``, with the first forest as ``hang`` gives it; log-likelihood first."""
    m = votes.shape[1]
    odds = prior / (1 - prior)
    most = np.where(chosen, (1 - PRECISION) / PRECISION * odds, 1.0)
    rate, parent = np.zeros((2, 2, m)), forest(votes, weight, hang)
    for step in range(80):
        if step % 10 == 9 and step < 60:
            parent = forest(votes, weight, post)
        above = np.where(parent >= 0, votes[:, parent], 0)
        for c, p in ((1, post * weight), (0, (1 - post) * weight)):
            for up in (0, 1):
                q = p[:, None] * (above == up)
                rate[c, up] = ((q * votes).sum(axis=0) + 0.05) / (q.sum(axis=0) + (1.0 if c else 10.0))
        rate[0] = np.minimum(rate[0], most * rate[1])
        found = likelihood(votes, rate, parent)
        new = 1 / (1 + np.exp(-np.clip(np.log(odds) + found[1] - found[0], -30, 30)))
        moved, post = np.abs(new - post).max(initial=0), new
        if step >= 60 and moved < 1e-6:
            break
    each = np.logaddexp(found[0] + np.log(1 - prior), found[1] + np.log(prior))
    return float(weight @ each), post, rate, parent


def features(votes: np.ndarray) -> np.ndarray:
    """Of the linear classifier: votes, whether any voter speaks, how many do."""
    return np.c_[votes, votes.any(axis=1), np.log1p(votes.sum(axis=1))]


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, np.ndarray]:
    """Newton's method on soft labels of weighted rows."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (target - p)) - penalty * w)
        w = w + step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[-1]), w[:-1]


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, _label of labelled training rows: at most SAMPLE rows and SAMPLE_CHARS characters, one row an id."""
    chosen = F.broadcast(sample_labels(labels, "toxic", ~held_out("doc_id", 5, 0), SAMPLE).withColumnRenamed("doc_id", "_id"))
    both = docs.select("doc_id", text_of().alias("text")).join(chosen, F.col("doc_id") == F.col("_id"))
    known = materialize(both.groupBy("doc_id", "_label").agg(F.max("text").alias("text")), "labelled")
    # sizes are summed over at most SAMPLE narrow rows
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = known.select("doc_id", upto.alias("upto")).where(F.col("upto") <= SAMPLE_CHARS).select("doc_id")
    return known.join(F.broadcast(kept), "doc_id")


def train(docs: DataFrame, labels: DataFrame) -> tuple[Mined, float, np.ndarray]:
    """Mined voters, intercept and weights."""
    ease(docs.sparkSession)
    known = sample(docs, labels).toPandas().sort_values("doc_id")
    y = known["_label"].to_numpy(int)
    mined = mine(known["text"].tolist(), y) if len(y) and y.any() else Mined()
    m = Voters(mined).size
    prior = float(np.clip((y.sum() + 1) / (len(y) + 2), 0.01, 0.5))
    del known
    ease(docs.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id").distinct()
    free = without(docs.where(~held_out("doc_id", 5, 0)), marked, "marked")
    counted = patterns(free, mined).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("pattern")
    votes, n = votes_of(counted["pattern"].to_numpy(np.int64), m), counted["n"].to_numpy(float)
    if not len(counted):
        votes, n = np.zeros((1, m)), np.ones(1)
    post, _, _ = label_model(votes, n, prior, np.arange(m) >= len(LEXICONS))
    b, w = logistic(features(votes), post, n)
    return mined, b, w


def patterns(docs: DataFrame, mined: Mined) -> DataFrame:
    """doc_id, held_out, pattern of every row."""
    lean(docs.sparkSession)
    rows = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        voters = Voters(mined)
        for batch in batches:
            found = pa.array([voters.pattern(t.as_py()) for t in batch.column(2)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "held_out", "pattern"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, pattern int")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    mined, b, w = train(docs, labels)
    spoke = [F.getbit("pattern", F.lit(k)).cast("double") for k in range(Voters(mined).size)]
    count = sum(spoke, F.lit(0.0))
    total = F.lit(b) + float(w[-2]) * (count > 0).cast("double") + float(w[-1]) * F.log1p(count)
    for k, x in enumerate(spoke):
        total = total + float(w[k]) * x
    made = patterns(docs, mined).select("doc_id", "held_out", (1 / (1 + F.exp(-total))).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; rows with a null id stay."""
    return without(docs, score(docs, labels).where("predicted = 1 AND doc_id IS NOT NULL"), "toxic")
