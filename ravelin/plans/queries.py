"""Named queries over the driver's tables. Users are customers, items parts or suppliers, stars quantities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors
from ..operators import analytics, clustering, graph, itemsets, recommend, similarity, sketches
from ..sources.readers import spread, table
from ..sources.storage import materialize
from ..streaming import streams


#: Reviews that one task joins or makes distinct, about.
REVIEWS = 1_000_000


def _deal(spark: SparkSession, sf_dir: str, df: DataFrame, *keys: str) -> DataFrame:
    """A table of reviews dealt by keys in tasks of REVIEWS rows, where that makes more tasks than there are cores.

    Spark would join small pieces to ones of 64 MB compressed, of which a task sorts or hashes over 1 GB.
    """
    tasks = -(-table(spark, sf_dir, "lineitem").count() // REVIEWS)
    return df.repartition(tasks, *keys) if tasks > spark.sparkContext.defaultParallelism else df


def _reviews(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    """user, item, stars, with what orders repeated ratings."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(item).alias("item"), F.col("l_quantity").alias("stars"), "l_shipdate", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), "o_orderstatus")
    return _deal(spark, sf_dir, lines, "l_orderkey").join(_deal(spark, sf_dir, orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def _sets(spark: SparkSession, sf_dir: str, item: str, member: str, source: str) -> DataFrame:
    """Distinct (item, member) of customers and the parts or suppliers they ordered."""
    rows = _reviews(spark, sf_dir, source).select(F.col(item).alias("item"), F.col(member).alias("member"))
    return _deal(spark, sf_dir, rows, "item", "member").distinct()


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def top_brands(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rated = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    found = rated.groupBy("p_brand").agg(F.avg("l_quantity").alias("avg_rating"))
    return found.orderBy(F.desc("avg_rating"), "p_brand").limit(10).withColumn("avg_rating", F.round("avg_rating", 6))


def review_count(spark, sf_dir):
    return analytics.count_rows(table(spark, sf_dir, "lineitem"))


def year_count(spark, sf_dir):
    return analytics.count_rows(analytics.containing(table(spark, sf_dir, "orders"), "o_orderdate", 1997))


def distinct_users(spark, sf_dir):
    return analytics.count_distinct(table(spark, sf_dir, "orders"), "o_custkey")


def top_users(spark, sf_dir):
    return analytics.top_counts(table(spark, sf_dir, "orders"), "o_custkey", 10)


def top_words(spark, sf_dir):
    return analytics.top_counts(analytics.word_counts(_texts(spark, sf_dir), "text"), "word", 10)


def category_avg(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    found = analytics.category_averages(lines, table(spark, sf_dir, "part"), "p_partkey", "p_name", "l_quantity", " ")
    return found.withColumn("avg_value", F.round("avg_value", 6))


def heavy_items(spark, sf_dir):
    return analytics.frequent_keys(table(spark, sf_dir, "lineitem"), "l_suppkey", 600)


def partition_sizes(spark, sf_dir):
    return analytics.partition_sizes(table(spark, sf_dir, "lineitem").select("l_suppkey"), 20, F.col("l_suppkey") * 7 + 3)


def item_index(spark, sf_dir):
    return analytics.dense_index(table(spark, sf_dir, "orders"), "o_custkey")


def filtered_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return analytics.keep_matching(orders, table(spark, sf_dir, "customer"), "c_custkey", F.col("c_mktsegment") == "BUILDING")


def _order_baskets(spark, sf_dir, larger_than: int = 0):
    return itemsets.baskets(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", larger_than)


def itemsets_1(spark, sf_dir):
    return itemsets.singles(_order_baskets(spark, sf_dir), 30)


def itemsets_2(spark, sf_dir):
    rows = materialize(_order_baskets(spark, sf_dir), "baskets")
    return itemsets.count_pairs(rows, itemsets.singles(rows, 30), 30)


def itemsets_3(spark, sf_dir):
    found = itemsets.frequent_itemsets(_order_baskets(spark, sf_dir), 5, 3).where("size = 3")
    return found.select(*[F.get("items", F.lit(k)).alias(f"i{k + 1}") for k in range(3)], "n")


def itemsets_swapped(spark, sf_dir):
    lines = _deal(spark, sf_dir, table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey"), "l_orderkey")  # an order in one task: it is counted there
    rows = materialize(itemsets.baskets(lines, "l_suppkey", "l_orderkey"), "baskets")
    found = itemsets.count_pairs(rows, None, 3)  # orders of such a pair have 3 suppliers, so those with fewer than 2 are out
    return found.withColumnsRenamed({"i1": "o1", "i2": "o2"})


def itemsets_filtered(spark, sf_dir):
    rows = materialize(_order_baskets(spark, sf_dir, 3), "baskets")
    return itemsets.count_pairs(rows, itemsets.singles(rows, 20), 20)


def itemset_candidates(spark, sf_dir):
    found = itemsets.candidate_itemsets(materialize(_order_baskets(spark, sf_dir), "baskets"), 30, 3)
    return found.select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


def _itemset_report(spark, sf_dir, max_size: int | None):
    from ..sources import sinks

    found = itemsets.frequent_itemsets(_order_baskets(spark, sf_dir), 30, max_size)
    return sinks.itemset_lines(found.withColumn("items", F.transform("items", lambda x: x.cast("string"))), "Frequent Itemsets")


def itemset_report(spark, sf_dir):
    return _itemset_report(spark, sf_dir, 2)


def itemset_report_all(spark, sf_dir):
    """Every size until none is frequent; itemset_report ends at pairs."""
    return _itemset_report(spark, sf_dir, None)


def fp_growth(spark, sf_dir):
    found = itemsets.fp_growth(_order_baskets(spark, sf_dir), 30).where(F.size("items") == 2)
    return found.select(F.get("items", F.lit(0)).alias("i1"), F.get("items", F.lit(1)).alias("i2"), "n")


def fp_growth_all(spark, sf_dir):
    """Itemsets of every size; fp_growth holds the pairs."""
    found = itemsets.fp_growth(_order_baskets(spark, sf_dir), 30)
    return found.select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "n")


def _similar(found: DataFrame) -> DataFrame:
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


def jaccard_exact(spark, sf_dir):
    return _similar(similarity.jaccard_join(_sets(spark, sf_dir, "item", "user", "l_partkey"), 0.05))


def jaccard_lsh(spark, sf_dir):
    return _similar(similarity.lsh_join(_sets(spark, sf_dir, "item", "user", "l_partkey"), 0.05))


def lsh_banded(spark, sf_dir):
    return _similar(similarity.lsh_join(_sets(spark, sf_dir, "item", "user", "l_partkey"), 0.05, 40, 2, 1_000, prime=False))


def _profiles(spark, sf_dir):
    return materialize(recommend.term_scores(_texts(spark, sf_dir), "doc_id", "text"), "profiles")


def _owners(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("key"))


def tfidf_profile(spark, sf_dir):
    return recommend.term_scores(_texts(spark, sf_dir), "doc_id", "text").select(
        F.col("key").alias("doc_id"), "term", "score", F.col("rank").cast("long").alias("rank")
    )


def user_profile(spark, sf_dir):
    found = recommend.union_profiles(_profiles(spark, sf_dir), _owners(spark, sf_dir))
    return found.select(F.col("owner").alias("source"), "term")


def content_predict(spark, sf_dir):
    profiles = _profiles(spark, sf_dir)
    owners = recommend.union_profiles(profiles, _owners(spark, sf_dir))
    found = recommend.content_scores(owners, profiles)
    return found.select(F.col("owner").alias("source"), F.col("key").alias("doc_id"), F.round("sim", 6).alias("sim"))


def _ratings(spark, sf_dir, train_only: bool = False):
    rows = _reviews(spark, sf_dir, "l_suppkey")
    rows = rows.where("o_orderstatus <> 'P'") if train_only else rows
    return recommend.latest_ratings(rows, "l_shipdate", "l_orderkey", "l_linenumber")


def _events_ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("item"), F.col("value").alias("stars"), "event_id"
    )
    return recommend.latest_ratings(rows.where("item IS NOT NULL"), "event_id")


def _event_ratings_sets(spark, sf_dir):
    """Distinct (item, member) of event users and the tags they rated."""
    return _events_ratings(spark, sf_dir).select(F.col("user").alias("item"), F.col("item").alias("member")).distinct()


def cf_item_model(spark, sf_dir):
    return _similar(recommend.pearson_model(materialize(_ratings(spark, sf_dir), "ratings")))


def cf_user_model(spark, sf_dir):
    return _similar(recommend.user_model(materialize(_events_ratings(spark, sf_dir), "ratings")))


def cf_user_model_all(spark, sf_dir):
    """All pairs of the operator's own bounds, 0.01 and 3 common items, as cf_user_model."""
    return cf_user_model(spark, sf_dir)


def _lsh_user_model(spark, sf_dir, jaccard: float):
    found = recommend.user_model(materialize(_events_ratings(spark, sf_dir), "ratings"), jaccard, exact=False, hashes=30, rows=2, m=26_184)
    return _similar(found)


def cf_user_model_lsh(spark, sf_dir):
    return _lsh_user_model(spark, sf_dir, 0.4)


def cf_user_model_lsh_all(spark, sf_dir):
    return _lsh_user_model(spark, sf_dir, 0.01)


def _wanted(spark, sf_dir):
    """The pairs of pending orders are to be predicted from all other orders."""
    return _reviews(spark, sf_dir, "l_suppkey").where("o_orderstatus = 'P'").select("user", "item").distinct()


def cf_item_predict(spark, sf_dir):
    ratings = materialize(_ratings(spark, sf_dir, True), "ratings")
    model = materialize(recommend.pearson_model(ratings), "model")
    found = recommend.predict_by_items(model, ratings, _wanted(spark, sf_dir))
    return found.select("user", "item", F.round("stars", 5).alias("stars"))


def _user_predictions(spark, sf_dir, jaccard: float):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("item"), F.col("value").alias("stars"), "event_id", "event_type"
    ).where("item IS NOT NULL")
    ratings = materialize(recommend.latest_ratings(rows.where("event_type <> 'error'"), "event_id"), "ratings")
    found = recommend.predict_from_users(ratings, rows.where("event_type = 'error'"), jaccard=jaccard)
    return found.select("user", "item", F.round("stars", 5).alias("stars"))


def cf_user_predict(spark, sf_dir):
    return _user_predictions(spark, sf_dir, 0.4)


def cf_user_predict_all(spark, sf_dir):
    return _user_predictions(spark, sf_dir, 0.01)


def co_graph(spark, sf_dir):
    return graph.co_graph(_sets(spark, sf_dir, "user", "item", "l_partkey"), 7)


def _graph(spark, sf_dir):
    return materialize(co_graph(spark, sf_dir).select("u", "v"), "graph")


def graph_vertices(spark, sf_dir):
    return graph.vertices(_graph(spark, sf_dir))


def lpa_labels(spark, sf_dir):
    return graph.label_propagation(_graph(spark, sf_dir))


def communities(spark, sf_dir):
    found = graph.communities(graph.label_propagation(_graph(spark, sf_dir)))
    return found.select("label", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.col("size").cast("long").alias("size"))


def shortest_paths(spark, sf_dir):
    return graph.shortest_paths(_graph(spark, sf_dir)).select("s", "v", F.col("d").cast("long").alias("d"), "sigma")


def betweenness(spark, sf_dir):
    return graph.betweenness(_graph(spark, sf_dir), local=False).select("u", "v", F.round("betweenness", 4).alias("betweenness"))


def components(spark, sf_dir):
    return graph.components(_graph(spark, sf_dir))


def modularity(spark, sf_dir):
    edges = _graph(spark, sf_dir)
    return graph.modularity(edges, graph.components(edges)).select(F.round("modularity", 6).alias("modularity"))


def gn_communities(spark, sf_dir):
    sets = _events_ratings(spark, sf_dir).select(F.col("user").alias("item"), F.col("item").alias("member"))
    found = graph.split_communities(graph.co_graph(sets, 36))
    return graph.ordered_communities(found).select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "size")


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("cluster"))


def cluster_statistics(spark, sf_dir):
    found = clustering.centres_sd(clustering.statistics(_points(spark, sf_dir)))
    return found.select("cluster", "dim", F.round("mean", 6).alias("mean"), F.round("sd", 5).alias("sd"))


def kmeans_step(spark, sf_dir):
    points = _points(spark, sf_dir)
    centres = {c: s.centre for c, s in clustering.summaries(points).items()}
    return clustering.assign(points.drop("cluster"), centres).select("id", "cluster", F.round("dist", 5).alias("dist"))


def mahalanobis_assign(spark, sf_dir):
    points = _points(spark, sf_dir)
    sets = clustering.summaries(points)
    near = clustering.assign(points.drop("cluster"), {c: s.centre for c, s in sets.items()}, {c: s.sd for c, s in sets.items()})
    return near.where(F.col("dist") < 24.0).select("id", "cluster", F.round("dist", 5).alias("dist"))


def bfr(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("chunk", F.ntile(3).over(_by_id()))
    return clustering.out_of_core(points.select("id", "vec", "chunk"), 10)[0]


def bfr_rounds(spark, sf_dir):
    """Statistics after each round of the same pass."""
    points = _points(spark, sf_dir).withColumn("chunk", F.ntile(3).over(_by_id()))
    return clustering.out_of_core(points.select("id", "vec", "chunk"), 10)[1]


def _by_id():
    from pyspark.sql import Window

    return Window.partitionBy("cluster").orderBy("id")


def centre_distance(spark, sf_dir):
    """How far each point is from its own label's centre, by dimension-wise distance."""
    points = _points(spark, sf_dir)
    centres = points.select("cluster", F.posexplode("vec").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("c"))
    whole = centres.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "c"))), lambda v: v["c"]).alias("centre"))
    return points.join(F.broadcast(whole), "cluster").select("id", F.round(vectors.euclidean(F.col("vec"), F.col("centre")), 5).alias("dist"))


def bloom_probe(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    known = customers.where("c_acctbal > 5000")
    bits = sketches.bloom_bits(known, "c_name", 200_000)
    return sketches.bloom_probe(customers, "c_name", bits, 200_000).select("c_custkey", "hit")


def fm_estimate(spark, sf_dir):
    return sketches.distinct_estimate(table(spark, sf_dir, "events"), "user_id")


def tag_top3(spark, sf_dir):
    tags = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("tag"))
    return sketches.top_frequencies(tags, "tag")


def reservoir(spark, sf_dir):
    return sketches.reservoir(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(spark, sf_dir):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events*.parquet")


def stream_windows(spark, sf_dir):
    counts = streams.sliding_counts(_event_stream(spark, sf_dir), "ts", "event_type", "3 days", "1 day")
    found = streams.last_result(counts)
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


def stream_distinct(spark, sf_dir):
    users = _event_stream(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return streams.last_result(users).agg(F.count(F.lit(1)).alias("truth"), F.sum("n").alias("events"))


def stream_report(spark, sf_dir):
    """The report after every event of the stream of tags."""
    tags = _event_stream(spark, sf_dir).select(F.col("event_id").alias("order"), F.col("event_type").alias("tag"))
    return streams.last_result(streams.reservoir_reports(tags), "append").select("number", "report")


def clean_words(spark, sf_dir):
    words = tx.clean_words(F.coalesce("text", F.lit("")), keep_empty=False, strip=tx.delete_punctuation_digits)
    return _texts(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_words"))


QUERIES = {
    f.__name__: f
    for f in (
        top_brands, review_count, year_count, distinct_users, top_users, top_words, category_avg, heavy_items, partition_sizes, item_index,
        filtered_sample, itemsets_1, itemsets_2, itemsets_3, itemsets_swapped, itemsets_filtered, itemset_candidates, itemset_report, itemset_report_all,
        fp_growth, fp_growth_all,
        jaccard_exact, jaccard_lsh, lsh_banded, tfidf_profile, user_profile, content_predict, cf_item_model, cf_user_model, cf_user_model_all, cf_user_model_lsh,
        cf_user_model_lsh_all, cf_item_predict, cf_user_predict, cf_user_predict_all, co_graph, graph_vertices, lpa_labels, communities, shortest_paths, betweenness, components, modularity,
        gn_communities, cluster_statistics, kmeans_step, mahalanobis_assign, bfr, bfr_rounds, centre_distance, bloom_probe, fm_estimate, tag_top3, reservoir,
        stream_windows, stream_distinct, stream_report, clean_words,
    )
}
