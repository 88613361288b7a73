"""Queries through sources, sinks, reports and small column functions: written by a sink, read back by a source.

Files go to the folder that all executors share; the rows that come back are the query's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, vectors
from ..functions import text as tx
from ..operators import analytics, clustering, graph, itemsets, recommend, similarity, sketches
from ..sources import readers, sinks
from ..sources.push import Feed
from ..sources.readers import table
from ..sources.storage import fresh_path, materialize
from ..streaming import streams
from . import oracles, queries
from .queries import _event_ratings_sets, _points, _ratings, _reviews


def _lines(df: DataFrame, path: str) -> DataFrame:
    """The text of a one-column report, written and read back."""
    df.coalesce(1).write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path)


def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "json")
    sinks.json_lines(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.json_lines(spark, path, "c_custkey long, c_name string, c_acctbal double")


def source_bad_lines(spark, sf_dir):
    """Broken JSON lines among good ones: they come as nulls with their text."""
    path = fresh_path(spark, "json")
    whole = F.to_json(F.struct("c_custkey", "c_name"))
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("broken "), F.col("c_custkey").cast("string"))).otherwise(whole).alias("value"))
    rows.write.text(path)
    return readers.json_lines(spark, path, "c_custkey long, c_name string", "bad")


def source_csv(spark, sf_dir):
    """Headered CSV: the header line goes, a row that equals it stays."""
    path = fresh_path(spark, "csv")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").cast("string").alias("business_id"))
    extra = spark.range(1).select(F.lit("user_id").alias("user_id"), F.lit("business_id").alias("business_id"))
    sinks.csv_with_header(rows.unionByName(extra), path)
    return readers.csv_with_header(spark, path)


def source_word_list(spark, sf_dir):
    path = fresh_path(spark, "words")
    words = table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit(" "), "p_name"), F.lit(""))).alias("value"))
    words.write.text(path)
    return readers.word_list(spark, path).distinct()


def source_chunks(spark, sf_dir):
    """Points written as comma-separated lines in a folder, read with their chunk (file)."""
    path = fresh_path(spark, "points")
    first = F.transform(F.slice("vec", 1, 8), lambda x: F.round(x, 4).cast("string"))
    _points(spark, sf_dir).select(F.concat_ws(",", F.col("id").cast("string"), first).alias("value")).repartition(3).write.text(path)
    found = readers.chunked_points(spark, path)
    return found.select(F.col("id").cast("long").alias("id"), F.size("vec").cast("long").alias("d"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.col("chunk").startswith("part-").alias("named"))


def source_rows(spark, sf_dir):
    return readers.rows(spark, [(k, f"n{k}") for k in range(5)], "k long, name string")


def similarity_model(spark, sf_dir):
    """The item model as JSON lines and back."""
    path = fresh_path(spark, "model")
    model = queries.cf_item_model(spark, sf_dir).select(F.col("a").cast("string").alias("b1"), F.col("b").cast("string").alias("b2"), "sim")
    sinks.json_lines(model, path)
    return readers.cf_model(spark, path).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "sim")


def similarity_ranked(spark, sf_dir):
    """Similar items in order within their left item."""
    return similarity.ranked(queries.cf_item_model(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def prediction_lines(spark, sf_dir):
    """Predictions as JSON lines and back."""
    path = fresh_path(spark, "predictions")
    sinks.json_lines(queries.cf_item_predict(spark, sf_dir), path)
    return readers.json_lines(spark, path, "user long, item long, stars double")


def profile_model(spark, sf_dir):
    """Item and user profiles, written as a model and loaded: rows of both by kind."""
    path = fresh_path(spark, "profiles")
    items = queries._profiles(spark, sf_dir)
    sinks.profile_model(items.select("key", "term"), recommend.union_profiles(items, queries._owners(spark, sf_dir)), path)
    one, other = readers.profile_model(spark, path)
    return one.select(F.lit("item").alias("kind"), F.col("key").cast("string").alias("owner"), "term").unionByName(other.select(F.lit("user").alias("kind"), "owner", "term"))


def answers_object(spark, sf_dir):
    """Answers A to E of the descriptive analytics as one JSON object."""
    orders = table(spark, sf_dir, "orders")
    users = analytics.top_counts(orders, "o_custkey", 10)
    words = analytics.top_counts(analytics.word_counts(queries._texts(spark, sf_dir), "text"), "word", 10)
    parts = [
        analytics.count_rows(orders, "A"), analytics.count_rows(analytics.containing(orders, "o_orderdate", 1997), "B"), analytics.count_distinct(orders, "o_custkey", "C"),
        sinks.ranked_list(users, [F.desc("n"), F.col("o_custkey")], "D"), sinks.ranked_list(words.select("word", "n"), [F.desc("n"), F.col("word")], "E", "word"),
    ]
    path = fresh_path(spark, "answers")
    sinks.json_object(sinks.answers(parts), path)
    return spark.read.text(path)


def partition_report(spark, sf_dir):
    """Number of partitions, items in each and the heavy keys as one JSON object."""
    keys = table(spark, sf_dir, "lineitem").select("l_suppkey")
    sizes = analytics.partition_sizes(keys, 20, F.col("l_suppkey") * 7 + 3)
    heavy = analytics.frequent_keys(keys, "l_suppkey", 600)
    parts = [
        sizes.agg(F.count(F.lit(1)).alias("n_partitions")), sinks.ranked_list(sizes.select("part", "n"), [F.col("part")], "n_items", "n"),
        sinks.ranked_list(heavy, [F.col("l_suppkey")], "result"),
    ]
    path = fresh_path(spark, "report")
    sinks.json_object(sinks.answers(parts), path)
    return spark.read.text(path)


def category_list(spark, sf_dir):
    """Ranked averages as one JSON object."""
    return _lines(sinks.ranked_object(queries.category_avg(spark, sf_dir).select("category", "n"), [F.desc("n"), F.col("category")]), fresh_path(spark, "list"))


def itemset_text(spark, sf_dir):
    """The whole report: candidates of every size, then the frequent itemsets."""
    rows = materialize(queries._order_baskets(spark, sf_dir), "baskets")
    levels, tried = itemsets.levels(rows, 30)
    names = lambda df: df.withColumn("items", F.transform("items", lambda x: x.cast("string")))
    found = sinks.numbered(sinks.itemset_lines(names(tried), "Candidates"), 0).unionByName(sinks.numbered(sinks.itemset_lines(names(levels), "Frequent Itemsets"), 1))
    return found.select("place", "value")


def community_text(spark, sf_dir):
    found = graph.communities(graph.label_propagation(queries._graph(spark, sf_dir)))
    return _lines(sinks.community_lines(found), fresh_path(spark, "communities"))


def betweenness_text(spark, sf_dir):
    """Edges by betweenness, by roots held in tasks (the default of graphs of this size)."""
    found = graph.betweenness(queries._graph(spark, sf_dir))
    rounded = found.select("u", "v", F.format_string("%.4f", F.round("betweenness", 4)).alias("betweenness"))
    return _lines(sinks.betweenness_lines(rounded.withColumn("betweenness", F.col("betweenness").cast("decimal(20,4)"))), fresh_path(spark, "edges"))


def betweenness_by_root(spark, sf_dir):
    return graph.betweenness(queries._graph(spark, sf_dir), local=True).select("u", "v", F.round("betweenness", 4).alias("betweenness"))


def top_edge(spark, sf_dir):
    """The edge of highest betweenness."""
    return graph.betweenness(queries._graph(spark, sf_dir)).orderBy(F.desc(F.round("betweenness", 6)), "u", "v").select("u", "v").limit(1)


def assignment_text(spark, sf_dir):
    near = queries.mahalanobis_assign(spark, sf_dir).select("id", "cluster")
    every = _points(spark, sf_dir).select("id").join(near, "id", "left")
    return _lines(sinks.assignment_object(every), fresh_path(spark, "labels"))


def bloom_text(spark, sf_dir):
    return _lines(sinks.bit_sequence(queries.bloom_probe(spark, sf_dir), "c_custkey"), fresh_path(spark, "bits"))


def round_statistics(spark, sf_dir):
    """The statistics of the out-of-core clustering as a headered CSV: what does not depend on where points lie."""
    path = fresh_path(spark, "rounds")
    sinks.csv_with_header(queries.bfr_rounds(spark, sf_dir), path)
    found = spark.read.option("header", True).schema(clustering.ROUND).csv(path)
    whole = F.col("nof_point_discard") + F.col("nof_point_compression") + F.col("nof_point_retained")
    return found.select("round_id", "nof_cluster_discard", whole.alias("points"))


def stream_csv(spark, sf_dir):
    """The distinct-count report after the last micro-batch, appended as CSV."""
    path = fresh_path(spark, "distinct")
    events = queries._event_stream(spark, sf_dir)
    streams.run_to_end(events, streams.distinct_reports(events, "user_id", path))
    found = spark.read.option("header", True).option("recursiveFileLookup", True).schema("time timestamp, truth long, estimate double").csv(f"{path}/reports")
    return found.orderBy(F.desc("truth")).limit(1).select("truth", "estimate")


def stream_text(spark, sf_dir):
    """Event counts appended by each micro-batch as text files, read back."""
    path = fresh_path(spark, "stream-text")
    lines = queries._event_stream(spark, sf_dir).select(F.concat_ws(" : ", "event_id", "event_type").alias("value"))
    streams.run_to_end(lines, sinks.append_each_batch(path, "text"))
    return spark.read.option("recursiveFileLookup", True).text(path)


def stream_push(spark, sf_dir):
    """Messages pushed one by one through a feed: the first tag of those in English or without a language."""
    feed = Feed(fresh_path(spark, "feed"), 100)
    value = F.to_json(F.struct(
        F.when(F.col("event_id") % 3 > 0, F.lit("en")).when(F.col("event_id") % 2 == 0, F.lit("fr")).alias("lang"),
        F.struct(F.array(F.struct(F.col("event_type").alias("text")), F.struct(F.lit("x").alias("text"))).alias("hashtags")).alias("entities"),
    ))
    for r in table(spark, sf_dir, "events").where("event_id <= 500").orderBy("event_id").select(value.alias("v")).toLocalIterator():
        feed.push(r["v"])
    feed.close()
    tags = readers.messages(feed.stream(spark)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return streams.last_result(tags)


def stream_lifecycle(spark, sf_dir):
    """A stream of 1 second micro-batches over a folder, stopped by a timeout once it is idle."""
    path = fresh_path(spark, "lifecycle")
    query = streams.start(readers.file_stream(spark, f"{sf_dir}/events*.parquet", queries.EVENTS).select("event_id"), sinks.append_each_batch(path), "1 second")
    streams.stop_after(query, 60, idle=True)
    return spark.read.option("header", True).option("recursiveFileLookup", True).schema("event_id long").csv(path)


def text_functions(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.every_other(name).alias("odd"), tx.every_other(name, False).alias("even"), tx.is_alpha(name).alias("alpha"),
        tx.is_alpha(F.substring(name, 1, 3)).alias("alpha3"), tx.delete_marks(F.concat(name, F.lit("(a)[b],c.!?:;"))).alias("bare"),
    )


def positional_share(spark, sf_dir):
    """Share of equal places of the order dates' digits and those of the day's first order."""
    digits = lambda c: F.transform(F.split(F.date_format(c, "yyyyMMdd"), ""), lambda x: x)
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_orderdate").alias("low"))
    return orders.join(F.broadcast(first), F.lit(True)).select("o_orderkey", F.round(vectors.positional(digits(F.col("o_orderdate")), digits(F.col("low"))), 6).alias("share"))


def primes(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in hashing.primes(2000)], "p long")


def second_of_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def partition_contents(spark, sf_dir):
    """What a partitioner of the caller's puts together: partition, least and largest key, rows."""
    rows = analytics.dealt(table(spark, sf_dir, "lineitem").select("l_suppkey"), 7, F.col("l_suppkey") + 5).withColumn("part", F.spark_partition_id())
    return rows.groupBy("part").agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"), F.count(F.lit(1)).alias("n"))


def cluster_sample(spark, sf_dir):
    return clustering.sample(_points(spark, sf_dir), 0.2).select("id")


def first_centres(spark, sf_dir):
    return clustering.first_centres(_points(spark, sf_dir), 10).select("id")


def kmeans(spark, sf_dir):
    """Three rounds of k-means from seeded centres."""
    found, _ = clustering.k_means(_points(spark, sf_dir).drop("cluster"), 10, -1, 3)
    return found.select("id", "cluster", F.round("dist", 5).alias("dist"))


def merged_statistics(spark, sf_dir):
    """Summaries of even and odd points, added, are those of all points."""
    points = _points(spark, sf_dir)
    even, odd = (clustering.statistics(points.where(F.col("id") % 2 == k)) for k in (0, 1))
    both = clustering.merge_statistics(even, odd)
    return both.select("cluster", "dim", "n", F.round("sum", 6).alias("sum"), F.round("sumsq", 5).alias("sumsq"))


def merged_clusters(spark, sf_dir):
    """Clusters of even points in reach of clusters of odd points: the nearest one."""
    points = _points(spark, sf_dir)
    even, odd = (clustering.summaries(points.where(F.col("id") % 2 == k)) for k in (0, 1))
    return spark.createDataFrame(sorted(clustering.merge_clusters(even, odd, 24.0).items()), "source int, target int")


def lsh_thousand(spark, sf_dir):
    """1,000 hashes modulo 40 in 20 bands of 50 rows over suppliers' customers."""
    return queries._similar(similarity.lsh_join(_event_ratings_sets(spark, sf_dir), 0.05, 1000, 50, 40, prime=False))


def rated_index(spark, sf_dir):
    """Reviews with dense indices of users and items in place of their keys."""
    rows = _reviews(spark, sf_dir, "l_suppkey").select("user", "item", "stars")
    users, items = analytics.dense_index(rows, "user").withColumnRenamed("idx", "u"), analytics.dense_index(rows, "item").withColumnRenamed("idx", "i")
    return rows.join(users, "user").join(items, "item").groupBy("u", "i").agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("stars"))


def mode_dispatch(spark, sf_dir):
    """Predictions by the mode's name; item mode here."""
    ratings = materialize(_ratings(spark, sf_dir, True), "ratings")
    found = recommend.predict("item_based", ratings, queries._wanted(spark, sf_dir))
    return found.select("user", "item", F.round("stars", 5).alias("stars"))


QUERIES = {
    f.__name__: f
    for f in (
        source_json_lines, source_bad_lines, source_csv, source_word_list, source_chunks, source_rows, similarity_model, similarity_ranked, prediction_lines,
        profile_model, answers_object, partition_report, category_list, itemset_text, community_text, betweenness_text, betweenness_by_root, top_edge,
        assignment_text, bloom_text, round_statistics, stream_csv, stream_text, stream_push, stream_lifecycle, text_functions, positional_share, primes,
        second_of_time, partition_contents, cluster_sample, first_centres, kmeans, merged_statistics, merged_clusters, lsh_thousand, rated_index, mode_dispatch,
    )
}

_O = oracles.ORACLES
_GRAPH_PATHS = f"WITH {oracles.GRAPH}, {oracles._paths()}"
_BETWEEN = _O["betweenness"]


def _kmeans(rounds: int, k: int = 10) -> str:
    steps = [f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('11:' || id), id) - 1 AS cluster, embedding FROM (SELECT vec_id AS id, embedding FROM embeddings)
  ORDER BY md5('11:' || id), id LIMIT {k}), m0 AS MATERIALIZED (SELECT cluster, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS mean FROM c0)"""]  # fmt: skip
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS MATERIALIZED (SELECT id, cluster, dist FROM (
  SELECT id, cluster, dist, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r FROM (
    SELECT p.id, m.cluster, round(sqrt(sum((x - mean) * (x - mean))), 9) AS dist FROM pts p JOIN m{n} m USING (dim) GROUP BY p.id, m.cluster)) WHERE r = 1),
m{n + 1} AS MATERIALIZED (SELECT d.cluster, dim, avg(x) AS mean FROM d{n} d JOIN pts p USING (id) GROUP BY d.cluster, dim)""")
    return ", ".join(steps)


def _object(*parts: tuple[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{name}\":' || {value}" for name, value in parts) + " || '}'"


ORACLES = {
    "source_json_lines": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "source_bad_lines": """SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name,
CASE WHEN c_custkey % 7 = 0 THEN 'broken ' || c_custkey END AS bad FROM customer""",
    "source_csv": "SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS business_id FROM orders UNION ALL SELECT 'user_id', 'business_id'",
    "source_word_list": "SELECT DISTINCT trim(p_name) AS word FROM part WHERE trim(p_name) <> ''",
    "source_chunks": """SELECT vec_id AS id, CAST(8 AS BIGINT) AS d, round(list_sum(list_transform(embedding[1:8], lambda x: round(CAST(x AS DOUBLE), 4))), 6) AS total,
TRUE AS named FROM embeddings""",
    "source_rows": "SELECT range AS k, 'n' || range AS name FROM range(5)",
    "similarity_model": _O["cf_item_model"],
    "similarity_ranked": f"SELECT a, b, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM ({_O['cf_item_model']})",
    "prediction_lines": _O["cf_item_predict"], "mode_dispatch": _O["cf_item_predict"],
    "profile_model": f"WITH {oracles.PROFILE} SELECT 'item' AS kind, CAST(doc_id AS VARCHAR) AS owner, term FROM profile UNION ALL SELECT 'user', source, term FROM owners",
    "answers_object": f"""WITH w AS ({_O['top_words']}), u AS ({_O['top_users']})
SELECT {_object(('A', '(SELECT count(*) FROM orders)'), ('B', f"({_O['year_count']})"), ('C', '(SELECT count(DISTINCT o_custkey) FROM orders)'),
    ('D', "(SELECT '[' || string_agg('[' || o_custkey || ',' || n || ']', ',' ORDER BY n DESC, o_custkey) || ']' FROM u)"),
    ('E', '''(SELECT '[' || string_agg('"' || word || '"', ',' ORDER BY n DESC, word) || ']' FROM w)'''))} AS value""",
    "partition_report": f"""WITH p AS (SELECT range AS part, (SELECT count(*) FROM lineitem WHERE (l_suppkey * 7 + 3) % 20 = range) AS n FROM range(20))
SELECT {_object(('n_partitions', '20'), ('n_items', "(SELECT '[' || string_agg(n, ',' ORDER BY part) || ']' FROM p)"),
    ('result', f"(SELECT '[' || coalesce(string_agg('[' || l_suppkey || ',' || n || ']', ',' ORDER BY l_suppkey), '') || ']' FROM ({_O['heavy_items']}))"))} AS value""",
    "category_list": f"""SELECT '{{"result":[' || string_agg('["' || category || '",' || n || ']', ',' ORDER BY n DESC, category) || ']}}' AS value FROM ({_O['category_avg']})""",
    "itemset_text": f"""{oracles._ALL_SETS}, every AS (SELECT DISTINCT i FROM b), tried AS (
  SELECT [i] AS items FROM every
  UNION ALL SELECT [p.i, q.i] FROM f p JOIN f q ON p.i < q.i
  UNION ALL SELECT list_append(p.items, q.items[-1]) FROM found p JOIN found q ON len(p.items) = len(q.items) AND p.items[:-2] = q.items[:-2] AND p.items[-1] < q.items[-1]
  WHERE len(p.items) > 1 AND (SELECT bool_and(EXISTS (SELECT 1 FROM found x WHERE x.items = list_filter(list_append(p.items, q.items[-1]), lambda y, k: k <> g.range))) FROM range(1, len(p.items) + 2) g)
), lines AS (
  SELECT 0 AS part, 0 AS k, 'Candidates:' AS value UNION ALL SELECT 1, 0, 'Frequent Itemsets:'
  UNION ALL SELECT 0, len(items), string_agg('(''' || array_to_string(items, ''', ''') || ''')', ',' ORDER BY list_transform(items, lambda x: CAST(x AS VARCHAR))) FROM tried GROUP BY len(items)
  UNION ALL SELECT 1, len(items), string_agg('(''' || array_to_string(items, ''', ''') || ''')', ',' ORDER BY list_transform(items, lambda x: CAST(x AS VARCHAR))) FROM found GROUP BY len(items))
SELECT row_number() OVER (PARTITION BY part ORDER BY k) - 1 + 1000 * part AS place, value FROM lines""",
    "community_text": f"""WITH c AS ({_O['communities']}) SELECT '''' || replace(members, ',', ''', ''') || '''' AS value FROM c""",
    "betweenness_text": f"""SELECT '(''' || u || ''', ''' || v || '''), ' || CAST(CAST(betweenness AS DECIMAL(20,4)) AS VARCHAR) AS value FROM ({_BETWEEN})""",
    "betweenness_by_root": _BETWEEN,
    "top_edge": f"SELECT u, v FROM ({_BETWEEN.replace('/ 2, 4)', '/ 2, 6)')}) ORDER BY betweenness DESC, u, v LIMIT 1",
    "assignment_text": f"""WITH near AS ({_O['mahalanobis_assign']}), e AS (SELECT vec_id AS id, coalesce(cluster, -1) AS c FROM embeddings LEFT JOIN near ON id = vec_id)
SELECT '{{' || string_agg('"' || id || '":' || c, ',' ORDER BY CAST(id AS VARCHAR)) || '}}' AS value FROM e""",
    "bloom_text": f"SELECT string_agg(hit, ' ' ORDER BY c_custkey) AS value FROM ({_O['bloom_probe']})",
    "round_statistics": """SELECT round_id, CAST(10 AS INTEGER) AS nof_cluster_discard, CAST(sum(n) OVER (ORDER BY round_id) AS BIGINT) AS points FROM (
  SELECT CAST(chunk AS INTEGER) AS round_id, count(*) AS n FROM (SELECT ntile(3) OVER (PARTITION BY label ORDER BY vec_id) AS chunk FROM embeddings) GROUP BY 1)""",
    "stream_csv": f"SELECT count(DISTINCT user_id) AS truth, (SELECT estimate FROM ({_O['fm_estimate']})) AS estimate FROM events",
    "stream_text": "SELECT event_id || ' : ' || event_type AS value FROM events",
    "stream_push": "SELECT event_type AS tag, count(*) AS n FROM events WHERE event_id <= 500 AND (event_id % 3 > 0 OR event_id % 2 <> 0) GROUP BY 1",
    "stream_lifecycle": "SELECT event_id FROM events",
    "text_functions": """SELECT p_partkey, list_aggregate(list_filter(string_split(p_name, ''), lambda c, i: i % 2 = 0), 'string_agg', '') AS odd,
list_aggregate(list_filter(string_split(p_name, ''), lambda c, i: i % 2 = 1), 'string_agg', '') AS even, regexp_full_match(p_name, '\\p{L}+') AS alpha,
regexp_full_match(substr(p_name, 1, 3), '\\p{L}+') AS alpha3, p_name || 'abc' AS bare FROM part""",
    "positional_share": """WITH l AS (SELECT strftime(min(o_orderdate), '%Y%m%d') AS low FROM orders), d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS t, low FROM orders, l)
SELECT o_orderkey, round(list_sum(list_transform(range(1, 9), lambda k: CASE WHEN substr(t, CAST(k AS INTEGER), 1) = substr(low, CAST(k AS INTEGER), 1) THEN 1.0 ELSE 0.0 END)) / 8, 6) AS share FROM d""",
    "primes": "SELECT n.range AS p FROM range(2, 2001) n WHERE NOT EXISTS (SELECT 1 FROM range(2, 46) d WHERE d.range < n.range AND n.range % d.range = 0)",
    "second_of_time": "SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS t, count(*) AS n FROM events GROUP BY 1",
    "partition_contents": """SELECT CAST((l_suppkey + 5) % 7 AS INTEGER) AS part, min(l_suppkey) AS low, max(l_suppkey) AS high, count(*) AS n FROM lineitem GROUP BY 1""",
    "cluster_sample": """SELECT vec_id AS id FROM (SELECT vec_id, row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) AS r FROM embeddings)
WHERE r <= (SELECT CAST(floor(count(*) * 0.2) AS BIGINT) FROM embeddings)""",
    "first_centres": "SELECT vec_id AS id FROM (SELECT min_by(vec_id, (md5('11:' || vec_id), vec_id)) AS vec_id FROM embeddings GROUP BY embedding) ORDER BY md5('11:' || vec_id), vec_id LIMIT 10",
    "kmeans": f"WITH {oracles.POINTS}, {_kmeans(3)} SELECT id, CAST(cluster AS INTEGER) AS cluster, round(dist, 5) AS dist FROM d3",
    "merged_statistics": f"WITH {oracles.POINTS} SELECT cluster, CAST(dim AS INTEGER) AS dim, n, round(s, 6) AS sum, round(q, 5) AS sumsq FROM stats",
    "merged_clusters": f"""WITH {oracles.POINTS}, h AS (SELECT id % 2 AS half, cluster, dim, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS sd FROM pts GROUP BY ALL),
d AS (SELECT a.cluster AS source, b.cluster AS target, sqrt(sum(((a.m - b.m) / CASE WHEN b.sd = 0 THEN 1 ELSE b.sd END) ** 2)) AS dist
  FROM h a JOIN h b ON a.half = 0 AND b.half = 1 AND a.dim = b.dim GROUP BY ALL)
SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dist, target) AS r FROM d) WHERE r = 1 AND dist < 24""",
    "lsh_thousand": f"""WITH {oracles._event_ratings()}, {oracles._lsh(oracles.EVENT_SETS, 1000, 50, 40, False)}, {oracles._jaccard_pairs(0.05)}
SELECT a, b, round(sim, 6) AS sim FROM pairs JOIN candidates USING (a, b)""",
    "rated_index": """WITH r AS (SELECT o_custkey AS user, l_suppkey AS item, l_quantity AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT user, row_number() OVER (ORDER BY user) - 1 AS u FROM (SELECT DISTINCT user FROM r)), i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT DISTINCT item FROM r))
SELECT u, i, count(*) AS n, sum(stars) AS stars FROM r JOIN u USING (user) JOIN i USING (item) GROUP BY u, i""",
}
