"""Recommendation: TF-IDF profiles with cosine scores, and collaborative filtering by Pearson similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..sources.storage import materialize
from . import similarity


#: Items, of all, up to which users meet as matrices; ratings that a task holds then; users of one block, and of the block they meet.
FEW, SHARD, STRIP, WIDE = 4096, 4_000_000, 256, 4096
#: Wanted users of one item from which it goes to several tasks; ratings that are looked up at once.
WANTED, LOOKUP = 200_000, 1_000_000
#: Terms, and sets of owners of a term, that are broadcast at most.
MAX_TERMS, MAX_SETS = 1_000_000, 100_000


def term_scores(docs: DataFrame, key: str, column: str, stopwords=tx.STOPWORDS, rare: float = 1e-6, keep: int = 200) -> DataFrame:
    """key, term, score: the ``keep`` best terms of all texts of a key by (count / largest count) * log2(keys / keys with the term).

    Terms rarer than ``rare`` of all tokens are left out; ties go by term.
    """
    words = tx.clean_words(F.coalesce(F.col(column), F.lit("")), stopwords, False, tx.delete_punctuation_digits)
    counts = docs.select(F.col(key).alias("key"), F.explode(words).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("c"))
    counts = materialize(counts, "term-counts")
    every = counts.groupBy("term").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("df"))
    sums = every.agg(F.sum("total").alias("tokens")).join(docs.select(key).distinct().agg(F.count(F.lit(1)).alias("keys")), F.lit(True))
    common = every.join(F.broadcast(sums), F.lit(True)).where(F.col("total") / F.col("tokens") >= rare).select("term", F.log2(F.col("keys") / F.col("df")).alias("idf"))
    most = counts.groupBy("key").agg(F.max("c").alias("most"))
    scored = counts.join(common, "term").join(most, "key").select("key", "term", F.round(F.col("c") / F.col("most") * F.col("idf"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep)


def union_profiles(profiles: DataFrame, memberships: DataFrame) -> DataFrame:
    """owner, term: the union of the profiles (key, term) of all keys of an owner (owner, key)."""
    return memberships.select("owner", "key").distinct().join(profiles.select("key", "term"), "key").select("owner", "term").distinct()


def content_scores(owners: DataFrame, profiles: DataFrame, least: float = 0.01, pairs: DataFrame | None = None) -> DataFrame:
    """owner, key, sim: cosine of binary profiles, at least ``least``; only the wanted pairs if given.

    Terms held by the same owners count as one set of owners, so a key's terms are counted by set, and the
    counts of a key are all made in one task.
    """
    n1 = owners.groupBy("owner").agg(F.count(F.lit(1)).alias("n1"))
    n2 = profiles.groupBy("key").agg(F.count(F.lit(1)).alias("n2"))
    holders = materialize(owners.groupBy("term").agg(F.array_sort(F.collect_list("owner")).alias("owners")), "holders")
    sets = materialize(holders.select("owners").distinct().withColumn("set", F.monotonically_increasing_id()), "owner-sets")
    terms = materialize(holders.join(sets, "owners").select("term", "set"), "terms")
    few = lambda df, most: F.broadcast(df) if df.count() <= most else df
    held = profiles.select("key", "term").join(few(terms, MAX_TERMS), "term").repartition("key").groupBy("key", "set").agg(F.count(F.lit(1)).alias("n"))
    met = held.join(few(sets, MAX_SETS), "set").select("key", "n", F.explode("owners").alias("owner")).groupBy("key", "owner").agg(F.sum("n").alias("common"))
    if pairs is not None:
        met = met.join(pairs.select("owner", "key").distinct(), ["owner", "key"], "left_semi")
    scored = met.join(n1, "owner").join(n2, "key").select("owner", "key", vectors.cosine(F.col("common"), F.col("n1"), F.col("n2")).alias("sim"))
    return scored.where(F.col("sim") >= least)


def latest_ratings(rows: DataFrame, *order: str) -> DataFrame:
    """user, item, stars: of repeated ratings the last by ``order`` counts."""
    return rows.groupBy("user", "item").agg(F.max_by("stars", F.struct(*order)).alias("stars"))


def pearson_model(ratings: DataFrame, pairs: DataFrame | None = None, least: int = 3) -> DataFrame:
    """a, b, sim > 0 for items with at least ``least`` common users.

    Sums run over common users, but each item is centred on the mean of all its ratings, so this is
    not corr(). A pair without variance has no similarity.
    """
    mean = ratings.groupBy("item").agg(F.avg("stars").alias("mean"))
    kept = materialize(ratings.select("user", "item", F.col("stars").cast("double").alias("stars")), "rated")
    sums = similarity.pair_sums(kept, "user", value="stars", least=least, centre=materialize(mean, "means"))
    if pairs is not None:
        sums = sums.join(pairs.select("a", "b"), ["a", "b"], "left_semi")
    return _pearson(sums)


def _pearson(sums: DataFrame) -> DataFrame:
    return sums.select("a", "b", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("sim")).where("sim > 0")


def user_model(ratings: DataFrame, jaccard: float = 0.01, least: int = 3, exact: bool = True, **lsh) -> DataFrame:
    """User-user Pearson over pairs of similar taste: Jaccard candidates, exact or by MinHash (integer items).

    Where an item is rated once by a user, one pass over the common items tells both similarities.
    """
    sets = ratings.select(F.col("user").alias("item"), F.col("item").alias("member"))
    if not ratings.groupBy("user", "item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        pairs = similarity.jaccard_join(sets.distinct(), jaccard, least) if exact else similarity.lsh_join(sets.distinct(), jaccard, least=least, **lsh)
        return pearson_model(ratings.select(F.col("item").alias("user"), F.col("user").alias("item"), "stars"), pairs, least)
    mean = ratings.groupBy("user").agg(F.avg("stars").alias("mean"))
    off = materialize(ratings.join(mean, "user").select(F.col("user").alias("item"), F.col("item").alias("member"), (F.col("stars") - F.col("mean")).alias("off")), "offsets")
    bands = None if exact else similarity.lsh_bands(sets, **lsh)
    return similarity.pair_sums(off, "member", value="off", least=least, threshold=jaccard, bands=bands, cosine=True).withColumnRenamed("cos", "sim")


def both_ways(model: DataFrame) -> DataFrame:
    """one, other, sim in both directions."""
    return model.select(F.col("a").alias("one"), F.col("b").alias("other"), "sim").unionByName(model.select(F.col("b").alias("one"), F.col("a").alias("other"), "sim"))


def _nearest(met: DataFrame, neighbours: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user", "item").orderBy(F.desc(F.round("sim", 9)), "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= neighbours)


def predict_by_items(model: DataFrame, ratings: DataFrame, wanted: DataFrame, neighbours: int = 5) -> DataFrame:
    """user, item, stars: weighted mean of the user's ratings of the most similar rated items; none: left out.

    A wanted pair of numbers goes to its item's similarities with all that its user rated in arrays, so that its nearest items are
    found there and nothing is shuffled after that.
    """
    kinds = [dict(d.dtypes)[c] for d, c in ((ratings, "user"), (ratings, "item"), (wanted, "user"), (wanted, "item"), (model, "a"), (model, "b"))]
    exact = F.expr("stars = cast(cast(stars AS int) AS double) AND abs(stars) < 128")
    state = ratings.agg(F.min("item").alias("low"), F.max("item").alias("high"), F.min(F.col("stars").isNotNull()).alias("known"), F.min(exact).alias("small")).first()
    if any(k not in ("int", "bigint") for k in kinds) or not state["known"] or state["low"] is None:
        rated = ratings.select("user", F.col("item").alias("other"), "stars")
        met = wanted.select("user", "item").distinct().join(rated, "user").join(both_ways(model).withColumnRenamed("one", "item"), ["item", "other"])
        sums = _nearest(met, neighbours).groupBy("user", "item").agg(F.sum(F.expr("stars * sim")).alias("w"), F.sum(F.abs("sim")).alias("s"))
        return sums.select("user", "item", F.try_divide("w", "s").alias("stars")).where("stars IS NOT NULL")
    number = "int" if state["low"] >= -(2**31) and state["high"] < 2**31 else "bigint"
    asked = materialize(wanted.select(F.col("user").cast("bigint"), F.col("item").cast("bigint")).where("user IS NOT NULL AND item IS NOT NULL").distinct(), "wanted")
    own = ratings.where("item IS NOT NULL").groupBy(F.col("user").cast("bigint").alias("user")).agg(
        F.collect_list(F.struct(F.col("item").cast(number).alias("i"), F.col("stars").cast("tinyint" if state["small"] else "double").alias("s"))).alias("own"))
    left = asked.join(own, "user").select("item", F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("double").alias("sim"), "user", F.col("own.i").alias("items"), F.col("own.s").alias("rated"))
    near = both_ways(model).select(F.col("one").cast("bigint").alias("item"), F.col("other").cast("bigint").alias("other"), "sim", *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes[3:]])
    hot = asked.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / WANTED).cast("int").alias("cuts")).where("cuts > 1")
    if hot.isEmpty():
        both = near.withColumn("cut", F.lit(0)).unionByName(left.withColumn("cut", F.lit(0)))
    else:  # at most one for every WANTED wanted pairs
        hot = F.broadcast(materialize(hot, "hot"))
        near = near.join(hot, "item", "left").withColumn("cut", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))).drop("cuts")
        left = left.join(hot, "item", "left").withColumn("cut", F.pmod(F.xxhash64("user"), F.coalesce("cuts", F.lit(1))).cast("int")).drop("cuts")
        both = near.unionByName(left)
    met = both.repartition("item", "cut").sortWithinPartitions("item", "cut", F.col("user").isNotNull(), "other")
    found = met.select("item", "cut", "other", "sim", "user", "items", "rated").mapInArrow(_by_nearest_items(neighbours), "user bigint, item bigint, stars double")
    return found.select(F.col("user").cast(kinds[2]).alias("user"), F.col("item").cast(kinds[3]).alias("item"), "stars")


def _by_nearest_items(neighbours: int):
    """For mapInArrow over rows sorted by (item, cut), of each the similarities (other, sim) before the users (user, items, rated)."""
    most = LOOKUP  # what the workers are sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # the similarities of the item that the batch before ended with
        for batch in batches:
            item, cut = (batch.column(k).to_numpy() for k in (0, 1))
            is_user = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], (item[1:] != item[:-1]) | (cut[1:] != cut[:-1]))) if len(item) else np.zeros(0, bool)
            group = np.cumsum(new) - 1  # groups of this batch
            if not len(item):
                continue
            model = np.flatnonzero(~is_user)
            of, others = group[model], batch.column(2).take(pa.array(model)).to_numpy(zero_copy_only=False)
            sims = batch.column(3).take(pa.array(model)).to_numpy(zero_copy_only=False)
            if last == (item[0], cut[0]):
                of, others, sims = np.concatenate((np.zeros(len(kept[0]), of.dtype), of)), np.concatenate((kept[0], others)), np.concatenate((kept[1], sims))
            names = np.unique(others)  # sorted by group, then by other: one number for both, in order
            codes = of.astype("int64") * (len(names) + 1) + np.searchsorted(names, others)
            last, end = (item[-1], cut[-1]), np.searchsorted(of, group[-1])
            kept = (others[end:].copy(), sims[end:].copy())
            users = np.flatnonzero(is_user)
            if not len(users) or not len(codes):
                continue
            lists, stars = (batch.column(k).take(pa.array(users)) for k in (5, 6))
            ends = lists.offsets.to_numpy().astype("int64")
            low = 0
            while low < len(users):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, "right")) - 1)
                some = slice(ends[low], ends[high])
                rated = lists.values.to_numpy(zero_copy_only=False)[some].astype("int64")
                value = stars.values.to_numpy(zero_copy_only=False)[some].astype("float64")
                row = np.repeat(np.arange(low, high), np.diff(ends[low : high + 1]))
                at = np.searchsorted(names, rated)
                known = names[np.minimum(at, len(names) - 1)] == rated
                code = group[users[row]].astype("int64") * (len(names) + 1) + at
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                known &= codes[place] == code
                row, other, value, sim = row[known], rated[known], value[known], sims[place[known]]
                order = np.lexsort((other, -np.round(sim, 9), row))
                row, value, sim = row[order], value[order], sim[order]
                if len(row):
                    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.concatenate((start, [len(row)])))) < neighbours
                    row, value, sim = row[keep], value[keep], sim[keep]
                    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    w, s = np.add.reduceat(value * sim, start), np.add.reduceat(np.abs(sim), start)
                    at = users[row[start]][s > 0]
                    out = [batch.column(4).take(pa.array(at)), pa.array(item[at]), pa.array(w[s > 0] / s[s > 0])]
                    yield pa.RecordBatch.from_arrays(out, names=["user", "item", "stars"])
                low = high

    return run


def predict(mode: str, ratings: DataFrame, wanted: DataFrame, neighbours: int = 5, **model) -> DataFrame:
    """Model and predictions by the name of the mode: 'item_based' or 'user_based'."""
    if mode == "item_based":
        return predict_by_items(materialize(pearson_model(ratings, **model), "model"), ratings, wanted, neighbours)
    if mode == "user_based":
        return predict_from_users(ratings, wanted, neighbours, **model)
    raise ValueError(f"mode must be 'item_based' or 'user_based', not {mode!r}")


def predict_by_users(model: DataFrame, ratings: DataFrame, wanted: DataFrame, neighbours: int = 5) -> DataFrame:
    """user, item, stars: the user's mean plus the weighted offsets of similar users who rated the item.

    A neighbour's mean leaves the target item out, so a neighbour with no other rating has none.
    """
    own = ratings.groupBy("user").agg(F.avg("stars").alias("mean"))
    total = ratings.groupBy(F.col("user").alias("other")).agg(F.sum("stars").alias("total"), F.count(F.lit(1)).alias("n"))
    rated = ratings.select(F.col("user").alias("other"), "item", F.col("stars").alias("r"))
    # the model first: a user has few neighbours, an item may have any number of raters
    met = wanted.select("user", "item").distinct().join(both_ways(model).withColumnRenamed("one", "user"), "user").join(rated, ["other", "item"])
    near = _nearest(met.join(total.where("n > 1"), "other"), neighbours)
    off = F.col("r") - (F.col("total") - F.col("r")) / (F.col("n") - 1)
    sums = near.groupBy("user", "item").agg(F.sum(off * F.col("sim")).alias("w"), F.sum(F.abs("sim")).alias("s"))
    return sums.join(own, "user").select("user", "item", (F.col("mean") + F.try_divide("w", "s")).alias("stars")).where("stars IS NOT NULL")


def predict_from_users(ratings: DataFrame, wanted: DataFrame, neighbours: int = 5, jaccard: float = 0.01, least: int = 3, exact: bool = True, **lsh) -> DataFrame:
    """:func:`predict_by_users` over :func:`user_model`; ratings are materialised.

    Where users rate the same few items, all of them meet. Then no model is written: each block of users meets
    all others as matrices, and only the nearest raters of each wanted item leave the task.
    """
    kinds = dict(ratings.dtypes)
    seen = ratings.groupBy("user", "item").agg(F.count(F.lit(1)).alias("n"), F.count("stars").alias("v"))
    state = seen.agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.min("v").alias("v")).join(ratings.agg(F.count_distinct("item").alias("items")), F.lit(True)).first()
    plain = state["rows"] and state["most"] == 1 and state["v"] == 1 and state["items"] <= FEW and ratings.where("user IS NULL OR item IS NULL").isEmpty()
    if not exact or not plain or any(kinds[c] not in ("int", "bigint") for c in ("user", "item")):
        return predict_by_users(materialize(user_model(ratings, jaccard, least, exact, **lsh), "model"), ratings, wanted, neighbours)
    wanted = wanted.select(F.col("user").cast(kinds["user"]).alias("user"), F.col("item").cast(kinds["item"]).alias("item")).where("item IS NOT NULL").distinct()
    own = ratings.groupBy("user").agg(F.collect_list(F.struct("item", F.col("stars").cast("double").alias("stars"))).alias("own"))
    asked = wanted.groupBy("user").agg(F.array_sort(F.collect_list("item")).alias("asked"))
    left = materialize(own.join(asked, "user").select(F.col("user").cast("bigint").alias("user"), F.col("own.item").cast("array<bigint>").alias("items"), F.col("own.stars").alias("stars"), F.col("asked").cast("array<bigint>").alias("asked")), "asking")
    left = left.repartition(max(ratings.sparkSession.sparkContext.defaultParallelism, left.count() // (2 * STRIP)), "user")
    shards = -(-int(state["rows"]) // SHARD)
    parts = []
    for shard in range(shards):
        rows = ratings.where(F.pmod(F.xxhash64("user"), F.lit(shards)) == shard)
        near = left.mapInArrow(_nearest_raters(rows, neighbours, jaccard, least), "user bigint, item bigint, other bigint, sim double, r double, total double, n bigint")
        parts.append(near if shards == 1 else materialize(near, "near"))
    near = parts[0]
    for part in parts[1:]:
        near = near.unionByName(part)
    off = F.col("r") - (F.col("total") - F.col("r")) / (F.col("n") - 1)
    sums = _nearest(near, neighbours).groupBy("user", "item").agg(F.sum(off * F.col("sim")).alias("w"), F.sum(F.abs("sim")).alias("s"))
    mean = ratings.groupBy("user").agg(F.avg("stars").alias("mean"))
    found = sums.join(mean, "user").select(F.col("user").cast(kinds["user"]).alias("user"), F.col("item").cast(kinds["item"]).alias("item"), (F.col("mean") + F.try_divide("w", "s")).alias("stars"))
    return found.where("stars IS NOT NULL")


def _nearest_raters(rows: DataFrame, neighbours: int, jaccard: float, least: int):
    """For mapInArrow over users (user, items, stars, asked): of each item asked for, the nearest users of ``rows`` who rated it.

    ``rows``, at most about SHARD of them, go to every task.
    """
    table = rows.select(F.col("user").cast("bigint"), F.col("item").cast("bigint"), F.col("stars").cast("double")).toArrow()
    user, item, stars = (table[k].to_numpy() for k in range(3))
    order = np.lexsort((item, user))
    sent = rows.sparkSession.sparkContext.broadcast((user[order], item[order], stars[order]))
    few, wide = STRIP, WIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, item, stars = sent.value
        others, first, n = np.unique(user, return_index=True, return_counts=True)
        items = np.unique(item)
        total = np.add.reduceat(stars, first) if len(first) else np.zeros(0)
        row, column = np.repeat(np.arange(len(others)), n), np.searchsorted(items, item)
        offset = stars - (total / n)[row]

        def best(found: list) -> list:  # the nearest of each user and item
            who, what, other, sim, rating = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((other, -np.round(sim, 9), what, who))
            who, what, other, sim, rating = who[order], what[order], other[order], sim[order], rating[order]
            start = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (what[1:] != what[:-1]))))
            rank = np.arange(len(who)) - np.repeat(start, np.diff(np.concatenate((start, [len(who)]))))
            keep = rank < neighbours
            return [(who[keep], what[keep], other[keep], sim[keep], rating[keep])]

        for batch in batches:
            for low in range(0, batch.num_rows, few):
                part = batch.slice(low, few)
                names = part.column(0).to_numpy()
                lists = [part.column(k).to_pylist() for k in (1, 2, 3)]
                held, x = np.zeros((len(names), len(items))), np.zeros((len(names), len(items)))
                size = np.array([len(v) for v in lists[0]])
                asking: dict[int, list[int]] = {}
                for k, (has, values, asked) in enumerate(zip(*lists, strict=True)):
                    at = np.searchsorted(items, has)
                    known = np.array([a < len(items) and items[a] == v for a, v in zip(at, has, strict=True)])
                    off = np.array(values) - sum(values) / len(values)
                    held[k, at[known]], x[k, at[known]] = 1.0, off[known]
                    for i in asked:
                        asking.setdefault(i, []).append(k)
                found, waiting = [], 0
                for begin in range(0, len(others), wide):
                    end = min(begin + wide, len(others))
                    lo, hi = first[begin], first[end - 1] + n[end - 1]
                    has, y, r = (np.zeros((end - begin, len(items))) for _ in range(3))
                    place = (row[lo:hi] - begin, column[lo:hi])
                    has[place], y[place], r[place] = 1.0, offset[lo:hi], stars[lo:hi]
                    common, xy = held @ has.T, x @ y.T
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sim = xy / (np.sqrt((x * x) @ has.T) * np.sqrt(held @ (y * y).T))
                        keep = (common >= least) & (xy > 0) & (sim > 0) & (common / (size[:, None] + n[None, begin:end] - common) >= jaccard)
                    keep &= (n[None, begin:end] > 1) & (names[:, None] != others[None, begin:end])
                    sim = np.where(keep, sim, -1.0)
                    close = np.round(sim, 9)
                    for i, who in asking.items():
                        at = int(np.searchsorted(items, i))
                        raters = np.flatnonzero(has[:, at]) if at < len(items) and items[at] == i else ()
                        if not len(raters):
                            continue
                        those = close[np.ix_(who, raters)]
                        least_close = np.partition(those, -neighbours, axis=1)[:, -neighbours] if len(raters) > neighbours else np.full(len(who), -1.0)
                        a, b = np.nonzero((those >= least_close[:, None]) & (those > -1.0))
                        b, a = raters[b], np.array(who)[a]
                        found.append((names[a], np.full(len(a), i), others[begin + b], sim[a, b], r[b, at]))
                        waiting += len(a)
                    if waiting > 1_000_000:
                        found = best(found)
                        waiting = len(found[0][0])
                if not waiting:
                    continue
                who, what, other, sim, rating = best(found)[0]
                at = np.searchsorted(others, other)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (who, what, other, sim, rating, total[at], n[at])], names=["user", "item", "other", "sim", "r", "total", "n"])

    return run
