"""Graphs as edge tables (u < v): co-occurrence, label propagation, betweenness, components, modularity, splitting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from . import similarity

#: Edges of a graph that a task may hold as a whole (about 100 MB in Python); beyond it joins do the work.
MAX_LOCAL_EDGES = 500_000
#: Vertices times edges of a graph that one task splits as a whole (at most some 400 MB in Python), and roots it follows at once.
MAX_SPLIT, ROOTS = 10_000_000, 256
#: Rows from which an id is a hub, whose minimum is broadcast; hubs at most.
HUB, HUBS = 128, 100_000


def co_graph(sets: DataFrame, least: int) -> DataFrame:
    """u, v, common: items of (item, member) with at least ``least`` common members."""
    return similarity.common_members(materialize(sets, "sets"), least).select(F.col("a").alias("u"), F.col("b").alias("v"), "common")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def directed(edges: DataFrame) -> DataFrame:
    """src, dst both ways."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after synchronous rounds: the neighbours' most frequent label, the smallest of equals."""
    both = materialize(directed(edges), "graph")
    labels = vertices(edges).select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        votes = both.join(labels, both["dst"] == labels["id"]).groupBy("src", "label").agg(F.count(F.lit(1)).alias("c"))
        best = votes.groupBy("src").agg(F.min(F.struct(-F.col("c"), F.col("label").alias("label"))).alias("best"))
        labels = materialize(best.select(F.col("src").alias("id"), F.col("best.label").alias("label")), "labels")
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """label, members (sorted), size."""
    found = labels.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return found.select("label", "members", F.size("members").alias("size"))


def shortest_paths(edges: DataFrame) -> DataFrame:
    """s, v, d, sigma for all reachable pairs: one frontier join a level for all roots at once."""
    both = materialize(directed(edges), "graph")
    seen = materialize(vertices(edges).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")), "paths")
    front, d = seen, 0
    while True:
        d += 1
        step = front.join(both, front["v"] == both["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum("sigma").alias("sigma"))
        front = materialize(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "sigma"), "paths")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def betweenness(edges: DataFrame, local: bool | None = None) -> DataFrame:
    """u, v, betweenness: credit of shortest paths through each edge, over all roots, halved.

    A graph of at most MAX_LOCAL_EDGES goes to every task as a whole, which takes its share of the roots;
    a larger one goes level by level through joins.
    """
    if local or local is None and edges.count() <= MAX_LOCAL_EDGES:
        return _betweenness_by_root(edges)
    paths, both = shortest_paths(edges), directed(edges)
    depth = paths.agg(F.max("d")).first()[0] or 0
    credit = paths.where(F.col("d") == depth).select("s", "v", F.lit(0.0).alias("delta"))
    parts = []
    for d in range(depth, 0, -1):  # what flows into each node at depth d is shared among its parents
        here = paths.where(F.col("d") == d).join(credit, ["s", "v"])
        up = paths.where(F.col("d") == d - 1).select("s", F.col("v").alias("p"), F.col("sigma").alias("sp"))
        flow = here.join(both.select(F.col("dst").alias("v"), F.col("src").alias("p")), "v").join(up, ["s", "p"])
        flow = materialize(flow.select("s", "p", "v", (F.col("sp") / F.col("sigma") * (1 + F.col("delta"))).alias("c")), "flow")
        parts.append(flow)
        gained = flow.groupBy("s", F.col("p").alias("v")).agg(F.sum("c").alias("delta"))
        nodes = paths.where(F.col("d") == d - 1).select("s", "v")
        credit = materialize(nodes.join(gained, ["s", "v"], "left").select("s", "v", F.coalesce("delta", F.lit(0.0)).alias("delta")), "credit")
    if not parts:
        return edges.select("u", "v", F.lit(0.0).alias("betweenness"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(F.least("p", "v").alias("u"), F.greatest("p", "v").alias("w")).agg((F.sum("c") / 2).alias("betweenness")).withColumnRenamed("w", "v")


def _betweenness_by_root(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    rows = [(r[0], r[1]) for r in edges.select("u", "v").toLocalIterator()]
    sent = spark.sparkContext.broadcast(rows)
    kind = dict(edges.dtypes)["u"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict = {}
        for u, v in sent.value:
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        credit: dict = {}
        for batch in batches:
            for root in batch["id"]:
                depth, sigma, order = {root: 0}, {root: 1.0}, [root]
                for x in order:
                    for y in near[x]:
                        if y not in depth:
                            depth[y], sigma[y] = depth[x] + 1, 0.0
                            order.append(y)
                        if depth[y] == depth[x] + 1:
                            sigma[y] += sigma[x]
                delta = dict.fromkeys(order, 1.0)
                for y in reversed(order):
                    for x in near[y]:
                        if depth[x] == depth[y] - 1:
                            c = sigma[x] / sigma[y] * delta[y]
                            delta[x] += c
                            key = (x, y) if x < y else (y, x)
                            credit[key] = credit.get(key, 0.0) + c
        yield pd.DataFrame([(*k, c) for k, c in credit.items()], columns=["u", "v", "c"])

    parts = vertices(edges).mapInPandas(run, f"u {kind}, v {kind}, c double")
    return parts.groupBy("u", "v").agg((F.sum("c") / 2).alias("betweenness"))


def stars(edges: DataFrame) -> DataFrame:
    """u, v (v the smallest id that u reaches) of all ids but each component's smallest, by alternating large-star and small-star.

    Materialised at each turn; it ends once all components are stars, which one aggregation tells.
    """
    pairs = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while True:
        ends = pairs.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        each = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        odd = F.sum(F.when((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1), 1).otherwise(0))
        state = each.agg(odd.alias("odd"), F.sum("up").alias("n")).first()
        if not state["odd"]:
            return pairs
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_minima(both.where("v > u"), low, 2 * state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_minima(large, low, 2 * state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = materialize(small.where("u <> v").distinct(), "stars")


def _with_minima(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of ``low`` (u, m, n), n being u's number of rows, at most ``total`` in all.

    The minima of hubs, at most HUBS of them, are broadcast; a hub's rows go on spread by v, so no hub
    is a group in one task.
    """
    least = max(HUB, total // HUBS)
    hubs = low.where(F.col("n") > least).select("u", F.col("m").alias("_hub"))
    others = low.where(F.col("n") <= least).select("u", "m", F.lit(0).alias("_s"))
    spread = F.when(F.col("_hub").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("v"), F.lit(1024)).cast("int"))
    met = rows.join(F.broadcast(hubs), "u", "left").withColumn("_s", spread).join(others, ["u", "_s"], "left")
    return met.select("u", "v", F.coalesce("_hub", "m").alias("m"))


def components(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, comp (smallest reachable id); isolated ``ids`` stand alone."""
    every = vertices(edges) if ids is None else ids.select("id").union(vertices(edges)).distinct()
    return every.join(stars(edges).select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def modularity(original: DataFrame, clusters: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row ``modularity``: 1/2m * sum over i <> j of one cluster of (A_ij - k_i k_j / 2m).

    A and m are the original graph's; degrees too, or the ``current`` (pruned) graph's if given.
    clusters: id, comp.
    """
    degree = directed(original if current is None else current).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    k = clusters.join(degree, "id", "left").select("comp", F.coalesce("k", F.lit(0)).cast("double").alias("k"))
    sums = k.groupBy("comp").agg(F.sum("k").alias("k1"), F.sum(F.expr("k * k")).alias("k2"))
    a, b = clusters.select(F.col("id").alias("u"), F.col("comp").alias("cu")), clusters.select(F.col("id").alias("v"), F.col("comp").alias("cv"))
    inside = original.join(a, "u").join(b, "v").where("cu = cv").groupBy(F.col("cu").alias("comp")).agg((2.0 * F.count(F.lit(1))).alias("l"))
    m2 = original.agg((2.0 * F.count(F.lit(1))).alias("m2"))
    each = sums.join(inside, "comp", "left").join(F.broadcast(m2), F.lit(True))
    return each.agg(F.sum((F.coalesce("l", F.lit(0.0)) - (F.col("k1") * F.col("k1") - F.col("k2")) / F.col("m2")) / F.col("m2")).alias("modularity"))


def split_communities(edges: DataFrame, degree_source: str = "current", local: bool | None = None) -> DataFrame:
    """id, comp: drop the edge of highest betweenness (smallest (u, v) of equals) until modularity stops rising or no edge is left.

    Each removal waits for the one before. A graph of at most MAX_SPLIT vertices times edges is split by one task,
    which follows anew only the roots whose shortest paths the removed edge was on; a larger one by jobs for each removal.
    """
    if degree_source not in ("current", "original"):
        raise ValueError(f"degree_source must be 'current' or 'original', not {degree_source!r}")
    original = materialize(edges.select("u", "v"), "split")
    ids, now, best, found = vertices(original), original, None, None
    if local or local is None and ids.count() * original.count() <= MAX_SPLIT:
        return original.repartition(1).mapInPandas(_splitting(degree_source == "current"), f"id {dict(original.dtypes)['u']}, comp {dict(original.dtypes)['u']}")
    while True:
        top = betweenness(now).orderBy(F.desc(F.round("betweenness", 9)), "u", "v").first()
        if top is None:
            break
        now = materialize(now.where(~((F.col("u") == top["u"]) & (F.col("v") == top["v"]))), "split")
        parts = materialize(components(now, ids), "parts")
        score = modularity(original, parts, now if degree_source == "current" else None).first()["modularity"]
        if best is not None and score <= best:
            break
        best, found = score, parts
    return found if found is not None else ids.select("id", F.col("id").alias("comp"))


def _splitting(pruned: bool):
    """For mapInPandas over all edges (u, v) in one task: :func:`split_communities`, modularity compared in whole numbers."""
    step = ROOTS  # what the worker is sent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"u": [], "v": []})]).sort_values(["u", "v"])
        if not len(rows):
            return
        ids = np.unique(np.concatenate((rows["u"].to_numpy(), rows["v"].to_numpy())))
        u, v = np.searchsorted(ids, rows["u"].to_numpy()), np.searchsorted(ids, rows["v"].to_numpy())
        n, m2, alive = len(ids), 2 * len(u), np.ones(len(u), bool)
        near, far = np.zeros((n, n)), np.zeros((n, n), "int16")
        near[u, v] = near[v, u] = 1.0
        credit = np.zeros((n, len(u)))  # of each root

        def follow(roots: np.ndarray, members: np.ndarray) -> None:  # roots of one component: distances and credit
            own, place = near[np.ix_(members, members)], np.full(n, -1)
            place[members] = np.arange(len(members))
            inside = np.flatnonzero(alive & (place[u] >= 0))
            a, b = place[u[inside]], place[v[inside]]
            for low in range(0, len(roots), step):
                some = roots[low : low + step]
                depth, ways = np.full((len(some), len(members)), -1, "int16"), np.zeros((len(some), len(members)))
                at = (np.arange(len(some)), place[some])
                depth[at], ways[at] = 0, 1.0
                front, d = ways.copy(), 0
                while True:
                    front = np.where(depth < 0, front @ own, 0.0)
                    if not front.any():
                        break
                    d += 1
                    depth[front > 0], ways = d, ways + front
                share, ratio = np.zeros_like(ways), np.zeros_like(ways)
                for k in range(d, 0, -1):
                    here = depth == k
                    ratio[here] = (1.0 + share[here]) / ways[here]
                    share += np.where(depth == k - 1, np.where(here, ratio, 0.0) @ own, 0.0) * ways
                gap = depth[:, b] - depth[:, a]
                each = np.where(gap == 1, ways[:, a] * ratio[:, b], np.where(gap == -1, ways[:, b] * ratio[:, a], 0.0))
                credit[some] = 0.0
                credit[np.ix_(some, inside)] = each
                far[some] = -1
                far[np.ix_(some, members)] = depth

        comp, left = np.zeros(n, "int64"), np.arange(n)
        while len(left):  # components, by the smallest member
            reached, front = np.zeros(n, bool), np.zeros(n, bool)
            front[left[0]] = True
            while front.any():
                reached |= front
                front = near[front].any(axis=0) & ~reached
            comp[reached] = left[0]
            left = left[~reached[left]]
        for c in np.unique(comp):
            follow(np.flatnonzero(comp == c), np.flatnonzero(comp == c))
        best, found, degree = None, np.arange(n), np.bincount(np.concatenate((u, v)), minlength=n)
        while alive.any():
            total = np.where(alive, np.round(credit.sum(axis=0) / 2, 9), -1.0)
            e = int(np.argmax(total))  # the first of equals
            x, y = u[e], v[e]
            alive[e], near[x, y], near[y, x] = False, 0.0, 0.0
            credit[:, e] = 0.0
            members = np.flatnonzero(comp == comp[x])
            roots = members[far[members, x] != far[members, y]]
            if pruned:
                degree[[x, y]] -= 1
            follow(np.array([x]), members)
            if far[x, y] < 0:
                first = members[far[x, members] >= 0]
                second = members[far[x, members] < 0]
                comp[first], comp[second] = first[0], second[0]
                for part in (first, second):
                    follow(np.intersect1d(roots, part), part)
            else:
                follow(roots, members)
            k1, k2 = np.zeros(n, "int64"), np.bincount(comp, degree * degree, n).astype("int64")
            np.add.at(k1, comp, degree)
            score = 2 * int((comp[u] == comp[v]).sum()) * m2 - int((k1 * k1 - k2).sum())
            if best is not None and score <= best:
                break
            best, found = score, comp.copy()
        yield pd.DataFrame({"id": ids, "comp": ids[found]})

    return run


def ordered_communities(parts: DataFrame) -> DataFrame:
    """members, size of each comp, smaller ones first, then by first member."""
    found = parts.groupBy("comp").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return found.select("members", F.size("members").alias("size")).orderBy("size", F.get("members", F.lit(0)))


