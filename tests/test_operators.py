"""Hand-made inputs: quirks, ties, nulls, empty tables, and properties against brute force."""

import hashlib
import itertools
import math
import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from ravelin import metrics
from ravelin.functions import hashing, text, vectors
from ravelin.operators import analytics, clustering, graph, itemsets, recommend, similarity, sketches
from ravelin.plans import queries
from ravelin.sources import readers, sinks
from ravelin.sources.push import Feed
from ravelin.sources.storage import materialize
from ravelin.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, text.clean_words(F.lit("The (of) and"))) == [""]
    assert one(spark, text.clean_words(F.lit("The (of) and"), keep_empty=False)) == []
    assert one(spark, text.clean_words(F.lit("A cat, a  Dog."))) == ["cat", "dog"]
    assert one(spark, text.delete_punctuation_digits(F.lit("a-1b!é"))) == "abé"
    assert one(spark, text.categories(F.lit("A, A,"))) == ["A", "A", ""]
    assert one(spark, text.every_other(F.lit("abcde"))) == "bd"
    assert one(spark, text.is_alpha(F.lit("é"))) and not one(spark, text.is_alpha(F.lit("a1")))


@pytest.mark.parametrize("s", ["", "a", "Zürich", "北京", "x" * 40])
def test_text_number(spark, s):
    assert one(spark, hashing.text_number(F.lit(s), 2_147_483_647)) == int.from_bytes(s.encode(), "big") % 2_147_483_647


def test_hashing(spark):
    assert hashing.primes(20) == [2, 3, 5, 7, 11, 13, 17, 19]
    assert one(spark, hashing.affine(F.lit(10**12), 2**62, 5, 49_999, 512)) == (2**62 * 10**12 + 5) % 49_999 % 512
    assert [one(spark, hashing.trailing_zeros(F.lit(x))) for x in (0, 1, 8, 12)] == [1, 0, 3, 2]


def test_vectors(spark):
    a, b, sd = (F.array(*[F.lit(float(x)) for x in v]) for v in ((1, 2), (4, 6), (0, 2)))
    assert one(spark, vectors.euclidean(a, b)) == 5
    assert one(spark, vectors.mahalanobis(a, b, sd)) == math.sqrt(9 + 4)
    assert one(spark, vectors.cosine(F.lit(1), F.lit(0), F.lit(4))) == 0
    assert one(spark, vectors.positional(a, a)) == 1


def test_categories_and_partitions(spark):
    ratings = spark.createDataFrame([("b", 1.0), ("b", 3.0), ("c", 5.0)], "k string, v double")
    cats = spark.createDataFrame([("b", "A, A"), ("c", None), ("d", "")], "k string, t string")
    assert [tuple(r) for r in analytics.category_averages(ratings, cats, "k", "t", "v").collect()] == [("A", 2.0, 4)]
    assert [tuple(r) for r in analytics.partition_sizes(spark.range(8), 3, F.col("id") + 1).orderBy("part").collect()] == [(0, 2), (1, 3), (2, 3)]
    nulls = spark.createDataFrame([(None,), (1,)], "k long")
    assert [tuple(r) for r in analytics.partition_sizes(nulls, 2, F.col("k")).orderBy("part").collect()] == [(0, 1), (1, 1)]
    index = analytics.dense_index(spark.createDataFrame([("b",), ("a",), ("b",)], "k string"), "k")
    assert sorted(map(tuple, index.collect())) == [("a", 0), ("b", 1)]


def test_itemsets_against_brute_force_and_fp_growth(spark):
    r = random.Random(4)
    data = [(b, f"i{x}") for b in range(40) for x in r.sample(range(9), 5)] + [(99, f"c{k}") for k in range(5)] * 2 + [(98, f"c{k}") for k in range(5)]
    rows = itemsets.baskets(spark.createDataFrame(data, "b long, i string"), "b", "i")
    sets = {}
    for b, i in data:
        sets.setdefault(b, set()).add(i)
    items = sorted({i for _, i in data})
    want = {c: n for k in range(1, 6) for c in itertools.combinations(items, k) if (n := sum(set(c) <= s for s in sets.values())) >= 2}
    got = {tuple(x["items"]): x["n"] for x in itemsets.frequent_itemsets(rows, 2).collect()}
    assert got == want
    assert {tuple(x["items"]): x["n"] for x in itemsets.fp_growth(rows, 2).collect()} == want
    assert itemsets.frequent_itemsets(rows, 1000).count() == 0
    lines = [x["value"] for x in sinks.itemset_lines(itemsets.frequent_itemsets(rows, 20, 2), "Frequent").collect()]
    assert lines[0] == "Frequent:" and lines[1].startswith("('i0')")


def test_whole_itemset_queries_go_beyond_pairs(spark, sf_dir):
    from ravelin.plans.queries import QUERIES

    triples = [r for r in QUERIES["fp_growth_all"](spark, sf_dir).collect() if r["items"].count(",") == 2]
    lines = [r["value"] for r in QUERIES["itemset_report_all"](spark, sf_dir).collect()]
    assert len(triples) == 120 and lines[3].count("(") == 120


def test_lsh_is_within_exact(spark):
    r = random.Random(2)
    sets = spark.createDataFrame([(a, m) for a in range(30) for m in r.sample(range(20), 8)], "item long, member long").distinct()
    exact = {tuple(x) for x in similarity.jaccard_join(sets, 0.3).select("a", "b", "common").collect()}
    assert {tuple(x) for x in similarity.lsh_join(sets, 0.3).select("a", "b", "common").collect()} <= exact
    assert exact


def test_prediction(spark):
    ratings = spark.createDataFrame([("u", f"i{k}", float(k)) for k in range(7)] + [("w", "i0", 1.0)], "user string, item string, stars double")
    model = spark.createDataFrame([("t", f"i{k}", 0.1 * (k + 1)) for k in range(7)], "a string, b string, sim double")
    wanted = spark.createDataFrame([("u", "t"), ("x", "t"), ("w", "q")], "user string, item string")
    got = recommend.predict_by_items(model, ratings, wanted).collect()
    best = range(2, 7)
    assert [(r["user"], round(r["stars"], 6)) for r in got] == [("u", round(sum(k * (k + 1) for k in best) / sum(k + 1 for k in best), 6))]


def test_pearson_needs_variance(spark):
    rows = [(u, "a", 3.0) for u in "xyz"] + [(u, "b", float(k)) for k, u in enumerate("xyz")]
    assert recommend.pearson_model(spark.createDataFrame(rows, "user string, item string, stars double")).count() == 0


def test_user_model_of_all_pairs_goes_below_the_cut(spark, sf_dir):
    from ravelin.plans.queries import QUERIES

    for name in ("cf_user_model", "cf_user_model_lsh"):
        cut, whole = ({tuple(r) for r in QUERIES[n](spark, sf_dir).collect()} for n in (name, f"{name}_all"))
        assert cut < whole


def brute_betweenness(edges):
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = dict.fromkeys(edges, 0.0)
    for s, t in itertools.combinations(sorted(near), 2):
        paths, front = [], [[s]]
        while front and not paths:
            front = [[*p, y] for p in front for y in near[p[-1]] if y not in p]
            paths = [p for p in front if p[-1] == t]
        for p in paths:
            for x, y in itertools.pairwise(p):
                out[min(x, y), max(x, y)] += 1 / len(paths)
    return out


def test_graph(spark):
    edges = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6), (8, 9)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = brute_betweenness(edges)
    for local in (True, False):
        got = {(r["u"], r["v"]): r["betweenness"] for r in graph.betweenness(df, local).collect()}
        assert got == pytest.approx(want)
    assert dict(graph.components(df, spark.range(1, 11)).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8, 9: 8, 10: 10}
    parts = dict(graph.split_communities(df, degree_source="original").collect())
    assert parts[1] == parts[2] == parts[3] and parts[4] == parts[5] == parts[6] != parts[1]
    labels = dict(graph.label_propagation(df).collect())
    assert labels.keys() == {1, 2, 3, 4, 5, 6, 8, 9}
    lines = [r["value"] for r in sinks.community_lines(graph.communities(graph.label_propagation(df))).collect()]
    groups = {}
    for i, label in labels.items():
        groups.setdefault(label, []).append(i)
    assert lines == [", ".join(f"'{i}'" for i in sorted(g)) for g in sorted(groups.values(), key=lambda g: (len(g), min(g)))]
    edge_lines = [r["value"] for r in sinks.betweenness_lines(graph.betweenness(df)).collect()]
    assert edge_lines == [f"('{u}', '{v}'), {b}" for (u, v), b in sorted(want.items(), key=lambda x: (-x[1], x[0]))]
    with pytest.raises(ValueError):
        graph.split_communities(df, degree_source="x")


def brute_split(edges):
    """The communities before the first removal that does not raise modularity, and the number of removals."""
    left, best, found, rounds = list(edges), None, None, 0
    while left:
        credit = brute_betweenness(left)
        left.remove(min(left, key=lambda e: (-round(credit[e], 9), e)))
        rounds += 1
        groups = {frozenset([x]) for e in edges for x in e}
        for u, v in left:
            a, b = (next(g for g in groups if x in g) for x in (u, v))
            groups = groups - {a, b} | {a | b}
        k = {x: sum(x in e for e in left) for g in groups for x in g}
        linked, m2 = set(edges), 2 * len(edges)
        q = sum(2 * ((x, y) in linked) - 2 * k[x] * k[y] / m2 for g in groups for x, y in itertools.combinations(sorted(g), 2)) / m2
        if best is not None and q <= best:
            break
        best, found = q, groups
    return sorted(sorted(g) for g in found), rounds


def test_communities_are_split_until_modularity_stops_rising(spark, sf_dir):
    sets = queries._events_ratings(spark, sf_dir + "/../sf0.01").select(F.col("user").alias("item"), F.col("item").alias("member"))
    edges = sorted((r["u"], r["v"]) for r in graph.co_graph(sets, 36).collect())
    want, rounds = brute_split(edges)
    assert rounds > 4
    got = queries.gn_communities(spark, sf_dir + "/../sf0.01").collect()
    assert sorted(sorted(int(x) for x in r["members"].split(",")) for r in got) == want


def test_clustering(spark):
    r = random.Random(0)
    rows = [(i, [r.gauss(20 * (i % 3), 1), 5.0], f"chunk{i % 2}") for i in range(120)]
    points = spark.createDataFrame(rows, "id long, vec array<double>, chunk string")
    _, found = clustering.k_means(points, 3, 0)
    assert sum(s.n for s in found.values()) == 120 and all(s.sd[1] == 0 for s in found.values())
    labels, rounds = clustering.out_of_core(points, 3)
    assert labels.count() == 120 and labels.select("id").distinct().count() == 120 and rounds.count() == 2
    assert clustering.sample(points, 0.2).count() == 24
    empty, none = clustering.out_of_core(points.limit(0), 3)
    assert empty.count() == none.count() == 0


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def plain_k_means(points, k, tolerance):
    """id -> cluster, cluster -> ids; points: id -> vector."""
    first = {}
    for i, v in points.items():
        first[v] = min(first.get(v, ("g", 0)), (digest(11, i), i))
    centres = {c: v for c, (v, _) in enumerate(sorted(first.items(), key=lambda x: x[1])[:k])}
    sizes = dict.fromkeys(centres, 0)
    while centres:
        groups = {}
        for i, v in points.items():
            groups.setdefault(min((round(math.dist(v, c), 9), n) for n, c in centres.items())[1], []).append(i)
        if all(abs(len(g) - sizes.get(n, 0)) <= tolerance for n, g in groups.items()):
            return groups
        sizes, centres = {n: len(g) for n, g in groups.items()}, {n: tuple(sum(x) / len(g) for x in zip(*(points[i] for i in g))) for n, g in groups.items()}
    return {}


def plain_out_of_core(chunks, k):
    """Labels and round statistics by sets of points instead of summaries."""
    every = {i: v for c in chunks for i, v in c.items()}

    def away(v, group):
        rows = [every[i] for i in group]
        centre = [sum(x) / len(rows) for x in zip(*rows)]
        sd = [math.sqrt(max(sum(a * a for a in x) / len(rows) - (sum(x) / len(rows)) ** 2, 0)) for x in zip(*rows)]
        return round(math.sqrt(sum(((a - c) / (s or 1)) ** 2 for a, c, s in zip(v, centre, sd))), 9)

    def middle(group):
        return [sum(x) / len(group) for x in zip(*(every[i] for i in group))]

    reach, stats = 3 * math.sqrt(len(next(iter(every.values())))), []
    for number, chunk in enumerate(chunks, 1):
        if number == 1:
            chosen = sorted(chunk, key=lambda i: (digest(7, i), i))[: int(len(chunk) * 0.2)]
            discard = plain_k_means({i: chunk[i] for i in chosen}, k, 10)
            found = plain_k_means({i: v for i, v in chunk.items() if i not in chosen}, 3 * k, 25)
            compressed = {c: g for c, g in found.items() if len(g) > 1}
            retained = [g[0] for g in found.values() if len(g) == 1]
        else:
            left = list(chunk)
            for sets in (discard, compressed):
                taken = {}
                for i in left:
                    d, c = min(((away(chunk[i], g), c) for c, g in sets.items()), default=(math.inf, None))
                    if d < reach:
                        taken[i] = c
                left = [i for i in left if i not in taken]
                for i, c in taken.items():
                    sets[c] = [*sets[c], i]
            retained += left
        stats.append((number, len(discard), sum(map(len, discard.values())), len(compressed), sum(map(len, compressed.values())), len(retained)))
    last = plain_k_means({i: every[i] for i in retained}, 3 * k, 10)
    for source, target in ((last, compressed), (compressed, discard)):
        met = {c: min(((away(middle(g), t), n) for n, t in target.items()), default=(math.inf, None)) for c, g in sorted(source.items())}
        for c, (d, n) in met.items():
            if d < reach:
                target[n] = target[n] + source.pop(c)
    labels = dict.fromkeys(every, -1)
    labels.update({i: c for c, g in discard.items() for i in g})
    return labels, stats


def test_out_of_core_against_plain_python(spark):
    """Labels and all six columns of the round statistics; outliers are retained and merge in the last round."""
    retained, dropped = [], []
    for seed in range(3):
        r = random.Random(seed)
        rows = []
        for i in range(300):
            place = r.choice([(0, 0, 0), (30, 0, 10), (0, 40, -20)])
            width = 1 if r.random() < 0.9 else 60
            rows.append((i, [round(r.gauss(c, width), 6) for c in place], f"chunk{i // 100}"))
        points = spark.createDataFrame(rows, "id long, vec array<double>, chunk string")
        labels, stats = clustering.out_of_core(points, 3)
        chunks = [{i: tuple(v) for i, v, c in rows if c == f"chunk{k}"} for k in range(3)]
        want, rounds = plain_out_of_core(chunks, 3)
        assert [tuple(x) for x in stats.orderBy("round_id").collect()] == rounds
        assert dict(labels.collect()) == want
        retained.append(rounds[-1][-1])
        dropped.append(list(want.values()).count(-1))
    assert any(retained) and any(dropped)


def test_confirmed_pairs_of_wide_items(spark, monkeypatch):
    """An item with more members than one array holds is compared part by part."""
    r = random.Random(6)
    data = {(a, m) for a in range(12) for m in r.sample(range(400), 300 if a < 3 else 20)}
    sets = spark.createDataFrame(sorted(data), "item long, member long")
    members = {a: {m for b, m in data if a == b} for a in range(12)}
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    want = {(a, b, len(members[a] & members[b])) for a, b in pairs if members[a] & members[b]}
    for wide in (4096, 16):
        monkeypatch.setattr(similarity, "WIDE", wide)
        got = similarity.confirmed(spark.createDataFrame(pairs, "a long, b long"), sets)
        assert {tuple(x) for x in got.select("a", "b", "common").collect()} == want


def test_pairs_of_heavy_keys_are_cut_into_blocks(spark, monkeypatch):
    r = random.Random(7)
    rows = [(k, i, float(i)) for k in range(6) for i in r.sample(range(60), 50 if k < 2 else 3)] + [(None, 1, 0.0), (None, 2, 0.0)]
    df = spark.createDataFrame(rows, "k long, item long, v double")
    want = sorted((i, j, x, y) for k, i, x in rows for m, j, y in rows if k == m and k is not None and i < j)
    for block, most in ((4096, 10), (8, 10), (8, 0)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "MAX_HEAVY", most)
        got = similarity.paired(df, "k", carry=("v",)).select("a", "b", "a_v", "b_v").collect()
        assert sorted(map(tuple, got)) == want


def test_signatures_of_many_hashes(spark):
    sets = spark.createDataFrame([(a, m) for a in range(5) for m in range(a, 40, a + 1)], "item long, member long")
    got = {x["item"]: x["h"] for x in similarity.signatures(sets, 250, 40, prime=False).collect()}
    for a, h in got.items():
        assert h == [min((x * m + y) % 40 for m in range(a, 40, a + 1)) for _, x, y, _ in hashing.family(250)]


def test_sketches(spark):
    rows = spark.createDataFrame([(1, "Zürich"), (2, None), (3, ""), (4, "Bern"), (5, "Bern")], "id long, city string")
    bits = sketches.bloom_bits(rows.where("id <> 4"), "city")
    hits = sketches.bloom_probe(rows, "city", bits)
    assert dict(hits.select("id", "hit").collect()) == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}
    assert sinks.bit_sequence(hits, "id").first()["value"] == "1 0 0 1 1"
    tags = spark.createDataFrame([(t,) for t in "aaabbbccd"], "tag string")
    assert sorted(map(tuple, sketches.top_frequencies(tags, "tag", 2).collect())) == [("a", 3), ("b", 3), ("c", 2)]
    assert sketches.distinct_estimate(rows.where("id > 9"), "city").first()["estimate"] == 0
    assert sketches.reservoir(spark.range(300), "id").count() == 100


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("user_id,business_id\nu,b\nuser_id,business_id\n")
    assert readers.csv_with_header(spark, str(tmp_path / "a.csv")).count() == 2
    (tmp_path / "a.json").write_text('{"user_id":"u","stars":4}\nbroken\n')
    got = readers.json_lines(spark, str(tmp_path / "a.json"), "user_id string, stars double", "bad").collect()
    assert [r["bad"] for r in got] == [None, "broken"]
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "d0.txt").write_text("1,0.5,2\n2,1,1\n")
    assert [(r["id"], r["vec"], r["chunk"]) for r in readers.chunked_points(spark, str(tmp_path / "points")).collect()][0] == ("1", [0.5, 2.0], "d0.txt")
    model = spark.createDataFrame([("x", "y", 0.5)], "b1 string, b2 string, sim double")
    sinks.json_lines(model, str(tmp_path / "m"))
    assert [tuple(r) for r in readers.cf_model(spark, str(tmp_path / "m")).collect()] == [("x", "y", 0.5)]
    top = spark.createDataFrame([("b", 1.5), ("a", 2.5)], "k string, v double")
    assert sinks.ranked_object(top, [F.desc("v")]).first()["value"] == '{"result":[["a",2.5],["b",1.5]]}'
    labels = spark.createDataFrame([(1, None), (2, 3)], "id long, cluster int")
    assert sinks.assignment_object(labels).first()["value"] == '{"1":-1,"2":3}'


def test_timing_and_progress(spark, sf_dir, caplog):
    seconds = {}
    with caplog.at_level("INFO", logger="ravelin"):
        with pytest.raises(KeyError), metrics.timed("work", seconds):
            raise KeyError
        with metrics.timed("work", seconds):
            pass
        listener = metrics.Progress()
        spark.streams.addListener(listener)
        streams.run_to_end(queries._event_stream(spark, sf_dir), lambda b, n: b.count())
        for _ in range(100):
            if "1000 rows" in caplog.text:
                break
            time.sleep(0.1)
        spark.streams.removeListener(listener)
    assert seconds["work"] >= 0 and caplog.text.count("work: ") == 2 and "1000 rows" in caplog.text


def test_modes(spark):
    ratings = spark.createDataFrame([(u, f"i{k}", float(u * k % 5)) for u in range(6) for k in range(6)], "user long, item string, stars double")
    wanted = spark.createDataFrame([(1, "i2")], "user long, item string")
    for mode in ("item_based", "user_based"):
        assert recommend.predict(mode, ratings.where("NOT (user = 1 AND item = 'i2')"), wanted).count() <= 1
    with pytest.raises(ValueError, match="mode must be"):
        recommend.predict("other", ratings, wanted)


def test_socket_stream(spark):
    """Lines of a socket become rows; the query ends by its timeout."""
    server = socket.create_server(("localhost", 0))

    def serve():
        peer, _ = server.accept()
        peer.sendall(b"one\ntwo\n")
        time.sleep(8)
        peer.close()

    threading.Thread(target=serve, daemon=True).start()
    got = []
    query = streams.start(readers.socket_lines(spark, port=server.getsockname()[1]), lambda b, n: got.extend(r["value"] for r in b.collect()), "1 second")
    for _ in range(70):
        if len(got) == 2:
            break
        time.sleep(0.1)
    streams.stop_after(query, 0.1)
    assert got == ["one", "two"] and not query.isActive
    server.close()


def test_feed(spark, tmp_path):
    feed = Feed(str(tmp_path / "feed"), 3)
    for k in range(7):
        feed.push(f"m{k}\nx")
    assert sorted(p.name for p in (tmp_path / "feed").glob("*.txt")) == ["000000000000.txt", "000000000001.txt"]
    feed.close()
    got = []
    streams.run_to_end(feed.stream(spark), lambda b, n: got.append([r["value"] for r in b.collect()]))
    assert got == [["m0 x", "m1 x", "m2 x"], ["m3 x", "m4 x", "m5 x"], ["m6 x"]]


def test_spread(spark):
    one = spark.range(10).coalesce(1)
    assert readers.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 10, 1, 64)
    assert readers.spread(many) is many


def test_streams(spark, sf_dir, tmp_path):
    from ravelin.plans.queries import _event_stream

    events = _event_stream(spark, sf_dir)
    report = streams.distinct_reports(events, "user_id", str(tmp_path / "r"))
    streams.run_to_end(events, report)
    row = spark.read.option("header", True).option("recursiveFileLookup", True).csv(str(tmp_path / "r" / "reports")).first()
    assert int(row["truth"]) == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    with pytest.raises(ValueError):
        streams.distinct_reports(events, "user_id", "x", scope="y")
    tags = events.select(F.col("event_id").alias("order"), F.col("event_type").alias("tag"))
    got = streams.last_result(streams.reservoir_reports(tags, 1000), "append").orderBy(F.desc("number")).first()
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().orderBy(F.desc("count")).first()
    assert got["number"] == 1000 and got["report"].startswith(f"{want['event_type']} : {want['count']}")
    batches = []
    streams.run_to_end(events, lambda b, n: batches.append(b.count()))
    assert sum(batches) == 1000


@pytest.mark.parametrize("form", ["sparse", "dense", "second", None])
def test_pair_sums_in_every_form(spark, monkeypatch, form):
    """Also with heavy keys and items, negative and large ids, and blocks of few items."""
    r = random.Random(11)
    items = [i * 3 - 20 if i % 5 else i + 2**33 for i in range(40)]
    rows = [(k, i, r.random() - 0.4) for k in range(15) for i in r.sample(items, 36 if k < 2 else 9)]
    df = spark.createDataFrame(rows + [(None, 1, 0.5), (None, 4, 0.5)], "k long, item long, v double")
    held = {}
    for k, i, v in rows:
        held.setdefault(i, {})[k] = v
    want = {}
    for a, b in itertools.combinations(sorted(held), 2):
        both = [(held[a][k], held[b][k]) for k in held[a].keys() & held[b].keys()]
        if len(both) > 2:
            want[a, b] = (len(both), sum(x * y for x, y in both), sum(x * x for x, _ in both), sum(y * y for _, y in both))
    for block, hot, side, deep in ((4096, 8_000_000, 1024, 2048), (8, 40, 7, 4)):
        for name, n in (("BLOCK", block), ("HOT", hot), ("SIDE", side), ("DEEP", deep), ("PAIRS", 50)):
            monkeypatch.setattr(similarity, name, n)
        assert {(x["a"], x["b"]): x["common"] for x in similarity.pair_sums(df, "k", least=3, form=form).collect()} == {p: w[0] for p, w in want.items()}
        if form == "second":
            continue
        got = {(x["a"], x["b"]): (x["common"], x["xy"], x["xx"], x["yy"]) for x in similarity.pair_sums(df, "k", value="v", least=3, form=form).collect()}
        assert got.keys() == {p for p, w in want.items() if w[1] > 0} and all(got[p] == pytest.approx(want[p]) for p in got)
        bands = spark.createDataFrame([(i, [str(i % 3), str(i % 4)]) for i in items], "item long, bands array<string>")
        got = {(x["a"], x["b"]): x["sim"] for x in similarity.pair_sums(df.where("k IS NOT NULL"), "k", least=3, threshold=0.3, bands=bands, form=form).collect()}
        sims = {(a, b): w[0] / (len(held[a]) + len(held[b]) - w[0]) for (a, b), w in want.items() if a % 3 == b % 3 or a % 4 == b % 4}
        assert got == {p: s for p, s in sims.items() if s >= 0.3}


def test_pairs_are_summed_without_a_shuffle_of_pairs(spark):
    rows = spark.createDataFrame([(k, i, 1.0) for k in range(5) for i in range(20)], "k long, item long, v double")
    plan = similarity.pair_sums(rows, "k", value="v", form="sparse")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("posexplode(bs") > 0 and "Exchange" not in plan[: plan.index("posexplode(bs")]


@pytest.mark.parametrize("form", ["members", "buckets"])
def test_lsh_join_by_members_and_by_buckets(spark, form):
    r = random.Random(3)
    sets = spark.createDataFrame([(a, m) for a in range(30) for m in r.sample(range(20), 8)], "item long, member long")
    got = {(x["a"], x["b"], x["common"]) for x in similarity.lsh_join(sets, 0.3, 6, 2, 50, form=form).collect()}
    keys = {x["item"]: x["bands"] for x in similarity.lsh_bands(sets, 6, 2, 50).collect()}
    exact = {(x["a"], x["b"], x["common"]) for x in similarity.jaccard_join(sets, 0.3).collect()}
    assert got == {p for p in exact if any(x == y for x, y in zip(keys[p[0]], keys[p[1]], strict=True))} and got


@pytest.mark.parametrize("step", [1.0, 0.3])
@pytest.mark.parametrize("form", ["sparse", "dense"])
def test_pair_sums_around_means(spark, form, step):
    r = random.Random(5)
    rows = [(k, i, step * r.randint(1, 5)) for k in range(12) for i in r.sample(range(9), 5)]
    df = spark.createDataFrame(rows, "k long, item long, v double")
    means = {i: sum(v for _, j, v in rows if j == i) / sum(1 for _, j, _ in rows if j == i) for _, i, _ in rows}
    off = spark.createDataFrame([(k, i, v - means[i]) for k, i, v in rows], "k long, item long, v double")
    sums = lambda d, **more: {(x["a"], x["b"]): (x["common"], x["xy"], x["xx"], x["yy"]) for x in similarity.pair_sums(d, "k", value="v", form=form, **more).collect()}
    got, want = sums(df, centre=spark.createDataFrame(list(means.items()), "item long, mean double")), sums(off)
    assert got.keys() == want.keys() and got and all(got[p] == pytest.approx(want[p]) for p in want)


def test_cf_user_model_is_whole(spark, sf_dir):
    from ravelin.plans.queries import QUERIES

    got, whole = ({tuple(r) for r in QUERIES[n](spark, sf_dir).collect()} for n in ("cf_user_model", "cf_user_model_all"))
    assert got == whole


@pytest.mark.parametrize("far", [1, 2**40])
@pytest.mark.parametrize("small", [False, True])
def test_pairs_of_numbers_are_counted_in_arrays(spark, monkeypatch, far, small):
    """Blocks of keys, cut items and short chunks change nothing; no pair goes through an aggregation."""
    if small:
        for name, value in (("BLOCK", 8), ("HOT", 50), ("CHUNK", 7)):
            monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(1)
    rows = sorted({(rnd.randrange(20), rnd.randrange(-40, 40) * far) for _ in range(500)})
    by_key = {k: sorted(i for q, i in rows if q == k) for k, _ in rows}
    counts = {}
    for items in by_key.values():
        for pair in itertools.combinations(items, 2):
            counts[pair] = counts.get(pair, 0) + 1
    found = similarity.pair_sums(materialize(spark.createDataFrame(rows, "k long, item long"), "pairs"), "k", least=2, form="sparse")
    assert {(r["a"], r["b"]): r["common"] for r in found.collect()} == {p: n for p, n in counts.items() if n > 1}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_read_written_levels(spark):
    """A level is used several times, so the pairs behind it are counted once."""
    rows = materialize(spark.createDataFrame([(b, i) for b in range(6) for i in range(4)], "basket long, item long"), "baskets")
    found = itemsets.candidate_itemsets(rows, 3, 3)
    assert sorted(r["items"] for r in found.collect()) == [[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]]
    assert "MapInArrow" not in _plan(found) and "Aggregate" not in _plan(found)


def test_fp_growth_holds_no_tree(spark, monkeypatch):
    import pyspark.ml.fpm as fpm

    monkeypatch.setattr(fpm, "FPGrowth", None)
    rnd = random.Random(4)
    baskets = [frozenset(rnd.sample(range(8), rnd.randint(1, 7))) for _ in range(60)]
    rows = spark.createDataFrame([(b, i) for b, items in enumerate(baskets) for i in items], "basket long, item long")
    want = {c: n for k in range(1, 8) for c in itertools.combinations(range(8), k) if (n := sum(set(c) <= b for b in baskets)) >= 9}
    assert max(map(len, want)) > 3
    assert {tuple(r["items"]): r["n"] for r in itemsets.fp_growth(rows, 9).collect()} == want


def test_itemset_lines_are_put_together_from_pieces(spark):
    rows = [(1, [str(k)]) for k in range(300)] + [(2, [str(k), str(k + 1)]) for k in range(50)]
    lines = sinks.itemset_lines(spark.createDataFrame(rows, "size int, items array<string>"), "Title")
    want = ["Title:", ",".join(f"('{k}')" for k in sorted(map(str, range(300)))), ",".join(f"('{a}', '{b}')" for a, b in sorted((str(k), str(k + 1)) for k in range(50)))]
    assert [r["value"] for r in lines.collect()] == want
    assert "collect_list" not in _plan(lines)


def test_content_scores_count_terms_by_their_owners(spark):
    owners = [("x", t) for t in "abcd"] + [("y", t) for t in "cde"] + [("z", "q")]
    profiles = [(1, t) for t in "abe"] + [(2, t) for t in "cdz"] + [(3, "n")]
    found = recommend.content_scores(spark.createDataFrame(owners, "owner string, term string"), spark.createDataFrame(profiles, "key long, term string"))
    got = {(r["owner"], r["key"]): round(r["sim"], 9) for r in found.collect()}
    want = {("x", 1): 2 / math.sqrt(12), ("y", 1): 1 / 3, ("x", 2): 2 / math.sqrt(12), ("y", 2): 2 / 3}
    assert got == {p: round(v, 9) for p, v in want.items()}
    assert "set#" in _plan(found)


def test_reservoir_reports_are_those_of_each_event(spark, tmp_path):
    """Against a plain loop, whatever the order that rows come in."""
    tags = [(k, "abc1"[k * k % 4 if k % 3 else k % 2]) for k in range(700)]
    spark.createDataFrame(random.Random(2).sample(tags, 700), "order long, tag string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for alpha in (False, True):
        kept, want = [], []
        for n, (_, tag) in enumerate(tags, 1):
            digest = hashlib.md5(f"5:{n}".encode()).hexdigest()
            if len(kept) < 20:
                kept.append(tag)
            elif (tag.isalpha() or not alpha) and int(digest[:8], 16) * n < 20 << 32:
                kept[int(digest[8:16], 16) % 20] = tag
            counts = {t: kept.count(t) for t in kept}
            levels = sorted(set(counts.values()), reverse=True)[:3]
            want.append((n, "; ".join(f"{t} : {-c}" for c, t in sorted((-c, t) for t, c in counts.items() if c in levels))))
        stream = spark.readStream.schema("order long, tag string").parquet(str(tmp_path / "in"))
        found = streams.last_result(streams.reservoir_reports(stream, 20, eligible_only_alpha=alpha), "append")
        assert sorted((r["number"], r["report"]) for r in found.collect()) == want


@pytest.mark.parametrize("small", [False, True])
def test_predictions_from_users_need_no_model(spark, monkeypatch, small):
    """Blocks and shards of users agree with the model of all pairs."""
    rnd = random.Random(6)
    data = [(u, i, float(rnd.randint(1, 9))) for u in range(40) for i in rnd.sample(range(12), rnd.randint(1, 9))]
    ratings = materialize(spark.createDataFrame(data + [(u + 100, i, r) for u, i, r in data], "user long, item int, stars double"), "ratings")
    wanted = spark.createDataFrame([(u, i) for u in range(0, 150, 3) for i in range(0, 14, 2)], "user long, item int")
    want = recommend.predict_by_users(materialize(recommend.user_model(ratings), "model"), ratings, wanted).collect()
    if small:
        for name, value in (("SHARD", 200), ("STRIP", 3), ("WIDE", 7)):
            monkeypatch.setattr(recommend, name, value)
    monkeypatch.setattr(recommend, "user_model", None)
    got = recommend.predict_from_users(ratings, wanted).collect()
    assert want and {(r["user"], r["item"]): round(r["stars"], 6) for r in got} == {(r["user"], r["item"]): round(r["stars"], 6) for r in want}


@pytest.mark.parametrize("source", ["current", "original"])
def test_a_small_graph_is_split_in_one_task(spark, monkeypatch, source):
    r = random.Random(4)
    edges = sorted({tuple(sorted(r.sample(range(14), 2))) for _ in range(26)} | {(20, 21), (21, 22), (30, 31)})
    df = spark.createDataFrame(edges, "u long, v long")
    jobs = dict(graph.split_communities(df, source, local=False).collect()) if source == "original" else None
    monkeypatch.setattr(graph, "betweenness", lambda *_: pytest.fail("a job for each removal"))
    monkeypatch.setattr(graph, "ROOTS", 3)
    got = dict(graph.split_communities(df, source).collect())
    if jobs is not None:
        assert got == jobs
    else:
        groups = {}
        for i, c in got.items():
            groups.setdefault(c, []).append(i)
        assert sorted(sorted(g) for g in groups.values()) == brute_split(edges)[0]
    assert graph.split_communities(df.where("u < 0"), source).isEmpty()


@pytest.mark.parametrize("far", [1, 2**33])
@pytest.mark.parametrize("small", [False, True])
def test_items_of_few_keys_meet_without_a_shuffle(spark, monkeypatch, far, small):
    """Blocks and shards change nothing; bands, sums and cosines are those of the shuffled matrices."""
    if small:
        for name, value in (("SIDE", 5), ("SHARD", 60), ("CHUNK", 20)):
            monkeypatch.setattr(similarity, name, value)
    r = random.Random(6)
    rows = [(k, i * far, r.random() - 0.4) for i in range(-9, 16) for k in r.sample(range(12), 8)]
    df = materialize(spark.createDataFrame(rows + [(None, 3 * far, 0.5)], "k int, item long, v double"), "few")
    bands = spark.createDataFrame([(i * far, [str(i % 3), str(i % 4)]) for i in range(-9, 15)], "item long, bands array<string>")
    for more in ({}, {"value": "v"}, {"threshold": 0.4}, {"value": "v", "threshold": 0.4, "bands": bands}, {"bands": bands}, {"value": "v", "cosine": True}):
        want, got = (similarity.pair_sums(df, "k", least=3, form=form, **more) for form in ("dense", "wide"))
        assert want.dtypes == got.dtypes or "cosine" in more
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan
        want, got = ({(x["a"], x["b"]): tuple(x)[2:] for x in d.collect()} for d in (want, got))
        assert got.keys() == want.keys() and got and all(got[p] == pytest.approx(want[p]) for p in want)


def test_user_models_are_made_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "DENSE_FROM", 10)
    ratings = materialize(spark.createDataFrame([(u, i, float((u * i) % 7)) for u in range(30) for i in range(9)], "user long, item int, stars double"), "ratings")
    for more in ({}, {"exact": False, "hashes": 4, "rows": 2, "m": 50}):
        plan = recommend.user_model(ratings, **more)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan


@pytest.mark.parametrize("batch, wanted_cut", [(10_000, 200_000), (3, 200_000), (7, 2)])
def test_predictions_by_items_are_made_where_the_pairs_arrive(spark, monkeypatch, batch, wanted_cut):
    """Short batches and cut items change nothing; the nearest items need no shuffle of their own."""
    monkeypatch.setattr(recommend, "WANTED", wanted_cut)
    monkeypatch.setattr(recommend, "LOOKUP", 10)
    r = random.Random(8)
    pairs = [p for p in itertools.combinations(range(-3, 12), 2) if r.random() < 0.7]
    model = {p: round(r.random(), 1) + 0.05 for p in pairs}
    rated = {(u, i): float(r.randint(1, 5)) for u in range(12) for i in r.sample(range(-3, 12), 7)}
    wanted = [(u, i) for u in range(13) for i in range(-4, 12) if r.random() < 0.6]
    want = {}
    for u, i in wanted:
        near = sorted((-round(model[min(i, j), max(i, j)], 9), j, s) for (v, j), s in rated.items() if v == u and (min(i, j), max(i, j)) in model)[:3]
        if near:
            want[u, i] = sum(-a * s for a, _, s in near) / sum(-a for a, _, _ in near)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = recommend.predict_by_items(
            spark.createDataFrame([(*p, s) for p, s in model.items()], "a long, b long, sim double"),
            spark.createDataFrame([(*k, s) for k, s in rated.items()], "user long, item long, stars double"),
            spark.createDataFrame(wanted + wanted[:3], "user long, item long"), 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) and {(x["user"], x["item"]): x["stars"] for x in rows} == pytest.approx(want)


@pytest.mark.parametrize("hot", [8_000_000, 3])
def test_sums_of_pairs_in_many_tasks_are_not_shuffled(spark, monkeypatch, hot):
    """The rows of a pair are in one task already, whatever its numbers are sent as."""
    for name, value in (("PAIRS", 50), ("HOT", hot)):
        monkeypatch.setattr(similarity, name, value)
    rows = materialize(spark.createDataFrame([(k, i, float(k)) for k in range(5) for i in range(20)], "k long, item long, v double"), "rows")
    centre = materialize(spark.createDataFrame([(i, 2.0) for i in range(20)], "item long, mean double"), "means")
    for more in ({}, {"centre": centre}):
        found = similarity.pair_sums(rows, "k", value="v", form="sparse", **more)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("posexplode(bs")].replace("BroadcastExchange", "")
        assert found.count() == 190 and dict(found.dtypes)["a"] == "bigint"


def test_reviews_are_dealt_in_bounded_tasks(spark, sf_dir, monkeypatch):
    """A task joins and makes distinct a bounded number of reviews, however many there are."""
    want = sorted(map(tuple, queries._sets(spark, sf_dir, "user", "item", "l_partkey").collect()))
    monkeypatch.setattr(queries, "REVIEWS", 500)
    found = queries._sets(spark, sf_dir, "user", "item", "l_partkey")
    tasks = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    assert found._jdf.queryExecution().executedPlan().toString().count(f", {tasks}), REPARTITION_BY_NUM") == 3
    assert found.rdd.getNumPartitions() == tasks > 4
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("far", [1, 2**40])
@pytest.mark.parametrize("step", [5, 1_000_000])
def test_items_of_few_keys_meet_at_their_first_common_key(spark, monkeypatch, far, step):
    """One exchange of items with their keys, none of pairs of keys; pairs whose common keys are the first, middle or last ones."""
    monkeypatch.setattr(similarity, "CHUNK", step)
    rnd = random.Random(4)
    held = {i * far: {k * far for k in rnd.sample(range(-6, 12), rnd.randrange(1, 8))} for i in range(-30, 50)}
    rows = [(k, i) for i, keys in held.items() for k in keys]
    want = {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(sorted(held), 2) if len(held[a] & held[b]) >= 3}
    df = materialize(spark.createDataFrame(rows + [(None, 1), (1, None)], "k long, item long"), "few")
    found = similarity.pair_sums(df, "k", least=3, form="second")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and "Join" not in plan
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 10 and {(a, b): n for a, b, n in got} == want
    assert similarity.pair_sums(df.where("item IS NULL"), "k", least=3, form="second").isEmpty()
