"""SQL for the queries, in DuckDB's dialect; hash parameters come from the same fixed rule as the engine's."""

from __future__ import annotations

from ..functions.hashing import family
from ..functions.text import DELETED, STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
CUSTOMER_PART = "SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _ratings(condition: str = "TRUE") -> str:
    return f"""ratings AS (
  SELECT u, i, stars FROM (
    SELECT o_custkey AS u, l_suppkey AS i, l_quantity AS stars,
           row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {condition}) WHERE r = 1)"""


def _event_ratings(condition: str = "TRUE") -> str:
    return f"""ratings AS (
  SELECT u, i, stars FROM (
    SELECT user_id AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) AS i, value AS stars,
           row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) ORDER BY event_id DESC) AS r
    FROM events WHERE {condition}) WHERE r = 1)"""


def _pearson(item: str, user: str, pairs: str = "") -> str:
    """CTE model(a, b, sim) over CTE ratings."""
    return f"""off AS (
  SELECT {item} AS x, {user} AS y, stars - avg(stars) OVER (PARTITION BY {item}) AS o FROM ratings
), model AS (
  SELECT a, b, sim FROM (
    SELECT p.x AS a, q.x AS b, count(*) AS n, sum(p.o * q.o) / nullif(sqrt(sum(p.o * p.o)) * sqrt(sum(q.o * q.o)), 0) AS sim
    FROM off p JOIN off q ON p.y = q.y AND p.x < q.x {pairs} GROUP BY ALL) WHERE n >= 3 AND sim > 0)"""


def _jaccard_pairs(threshold: float, least: int = 1) -> str:
    """CTE pairs(a, b, c, sim) over CTE sets(x, m)."""
    return f"""sizes AS (SELECT x, count(*) AS n FROM sets GROUP BY x), pairs AS (
  SELECT a, b, c, c / (p.n + q.n - c) AS sim FROM (
    SELECT s.x AS a, t.x AS b, count(*) AS c FROM sets s JOIN sets t ON s.m = t.m AND s.x < t.x GROUP BY ALL HAVING count(*) >= {least})
  JOIN sizes p ON p.x = a JOIN sizes q ON q.x = b WHERE c / (p.n + q.n - c) >= {threshold})"""


def _lsh(sets: str, hashes: int, rows: int, m: int, prime: bool) -> str:
    """CTEs sets and candidates(a, b)."""
    params = ", ".join(f"({i}, {a}, {b}, {p})" for i, a, b, p in family(hashes))
    value = f"(((h.a % h.p) * (m % h.p) + h.b % h.p) % h.p) % {m}" if prime else f"((h.a % {m}) * (m % {m}) + h.b % {m}) % {m}"
    return f"""sets AS ({sets}), h(i, a, b, p) AS (VALUES {params}), signed AS (
  SELECT x, h.i AS i, min({value}) AS v FROM sets, h GROUP BY ALL
), bands AS (
  SELECT x, i // {rows} AS band, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS key FROM signed GROUP BY ALL
), candidates AS (
  SELECT DISTINCT s.x AS a, t.x AS b FROM bands s JOIN bands t ON s.band = t.band AND s.key = t.key AND s.x < t.x)"""


PART_SETS = "SELECT DISTINCT l_partkey AS x, o_custkey AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
EVENT_SETS = "SELECT DISTINCT u AS x, i AS m FROM ratings"

WORDS = f"""w AS (
  SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[[:punct:][:digit:]]', '', 'g')), '\\s+'),
         lambda x: x <> '' AND x NOT IN ({STOP}))) AS term FROM documents)"""
PROFILE = f"""{WORDS}, counts AS (SELECT doc_id, term, count(*) AS c FROM w GROUP BY ALL),
terms AS (SELECT term, sum(c) AS total, count(*) AS df FROM counts GROUP BY term),
known AS (
  SELECT term, log2((SELECT count(DISTINCT doc_id) FROM documents) / df) AS idf FROM terms WHERE total / (SELECT sum(c) FROM counts) >= 1e-6
), scored AS (
  SELECT doc_id, term, round(c / max(c) OVER (PARTITION BY doc_id) * coalesce(idf, 0), 9) AS score, idf FROM counts LEFT JOIN known USING (term)
), profile AS (
  SELECT doc_id, term, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM scored WHERE idf IS NOT NULL) WHERE rank <= 200
), owners AS (SELECT DISTINCT source, term FROM profile JOIN documents USING (doc_id))"""

GRAPH = f"""cp AS ({CUSTOMER_PART}), edges AS (
  SELECT p.u AS u, q.u AS v, count(*) AS common FROM cp p JOIN cp q ON p.i = q.i AND p.u < q.u GROUP BY ALL HAVING count(*) >= 7
), ways AS (SELECT u AS s, v AS d FROM edges UNION ALL SELECT v, u FROM edges), ids AS (SELECT DISTINCT s AS id FROM ways)"""


def _lpa(rounds: int = 5) -> str:
    steps = ["l0 AS (SELECT id, id AS label FROM ids)"]
    steps += [
        f"""l{k} AS (SELECT id, label FROM (
  SELECT s AS id, label, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, label) AS r FROM ways JOIN l{k - 1} ON d = id GROUP BY s, label) WHERE r = 1)"""
        for k in range(1, rounds + 1)
    ]
    return ", ".join(steps)


def _paths(levels: int = 40) -> str:
    """CTEs p0, p1, ... and paths(s, v, d, sigma): breadth-first levels, unrolled."""
    steps = ["p0 AS MATERIALIZED (SELECT id AS s, id AS v, 0 AS d, 1.0::DOUBLE AS sigma FROM ids)", "a0 AS MATERIALIZED (SELECT * FROM p0)"]
    for k in range(1, levels + 1):
        steps.append(f"""p{k} AS MATERIALIZED (SELECT f.s, b.d AS v, {k} AS d, sum(sigma) AS sigma FROM p{k - 1} f JOIN ways b ON f.v = b.s
  WHERE NOT EXISTS (SELECT 1 FROM a{k - 1} x WHERE x.s = f.s AND x.v = b.d) GROUP BY f.s, b.d)""")
        steps.append(f"a{k} AS MATERIALIZED (SELECT * FROM a{k - 1} UNION ALL SELECT * FROM p{k})")
    return ", ".join(steps) + f", paths AS (SELECT * FROM a{levels})"


REACH = "reach AS (SELECT s AS id, min(v) AS comp FROM paths GROUP BY s)"
POINTS = """pts AS (SELECT vec_id AS id, label AS cluster, embedding, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
stats AS (SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM pts GROUP BY ALL),
centres AS (SELECT cluster, dim, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS sd FROM stats)"""


def _text_hash(column: str, p: int = 2_147_483_647) -> str:
    """Bytes of the text as one number modulo p."""
    code = f"(position(substr(hex(encode({column})), k, 1) IN '0123456789ABCDEF') - 1)"
    return f"""list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 2 * strlen({column}), 2),
      lambda k: CAST(16 * {code} + {code.replace('k, 1', 'k + 1, 1')} AS BIGINT))), lambda acc, x: (acc * 256 + x) % {p})"""


def _bloom(k: int, m: int) -> str:
    params = ", ".join(f"({i}, {a}, {b}, {p})" for i, a, b, p in family(k))
    return f"""h(i, a, b, p) AS (VALUES {params}), v AS (SELECT c_custkey, c_acctbal, {_text_hash('c_name')} AS x FROM customer),
hashed AS (SELECT c_custkey, c_acctbal, (((h.a % h.p) * (x % h.p) + h.b % h.p) % h.p) % {m} AS bit FROM v, h)"""


def _fm(n: int = 50, size: int = 10, m: int = 512) -> str:
    params = ", ".join(f"({i}, {a}, {b}, {p})" for i, a, b, p in family(n))
    return f"""WITH h(i, a, b, p) AS (VALUES {params}),
ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS t FROM events WHERE user_id IS NOT NULL), v AS (SELECT {_text_hash('t')} AS x FROM ids),
bits AS (SELECT h.i AS i, bin((((h.a % h.p) * (x % h.p) + h.b % h.p) % h.p) % {m}) AS b FROM v, h),
r AS (SELECT i, max(length(b) - length(rtrim(b, '0'))) AS r FROM bits GROUP BY i),
g AS (SELECT i // {size} AS g, avg(pow(2.0, r)) AS x FROM r GROUP BY 1)
SELECT median(x) AS estimate FROM g"""


def _pairs(support: int, first: int, basket: str = "l_orderkey", item: str = "l_suppkey", names: tuple[str, str] = ("i1", "i2"), larger: int = 0) -> str:
    return f"""WITH b0 AS (SELECT DISTINCT {basket} AS b, {item} AS i FROM lineitem),
b AS (SELECT * FROM b0 WHERE b IN (SELECT b FROM b0 GROUP BY b HAVING count(*) > {larger})),
f AS (SELECT i FROM b GROUP BY i HAVING count(*) >= {first}), k AS (SELECT b, i FROM b JOIN f USING (i))
SELECT p.i AS {names[0]}, q.i AS {names[1]}, count(*) AS n FROM k p JOIN k q ON p.b = q.b AND p.i < q.i GROUP BY ALL HAVING count(*) >= {support}"""


ORACLES = {
    "top_brands": """SELECT p_brand, round(avg(l_quantity), 6) AS avg_rating FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand ORDER BY avg(l_quantity) DESC, p_brand LIMIT 10""",
    "review_count": "SELECT count(*) AS n FROM lineitem",
    "year_count": "SELECT count(*) AS n FROM orders WHERE contains(CAST(o_orderdate AS VARCHAR), '1997')",
    "distinct_users": "SELECT count(DISTINCT o_custkey) AS n FROM orders",
    "top_users": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "top_words": f"""WITH t AS (
  SELECT list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{DELETED}', ''), '\\s+'), lambda x: x <> '' AND x NOT IN ({STOP})) AS w FROM documents),
e AS (SELECT unnest(CASE WHEN len(w) = 0 THEN [''] ELSE w END) AS word FROM t)
SELECT word, count(*) AS n FROM e GROUP BY word ORDER BY n DESC, word LIMIT 10""",
    "category_avg": """WITH c AS (SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS category FROM part WHERE p_name IS NOT NULL)
SELECT category, round(avg(l_quantity), 6) AS avg_value, count(*) AS n FROM lineitem JOIN c ON l_partkey = p_partkey GROUP BY category""",
    "heavy_items": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600",
    "item_index": "SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS idx FROM (SELECT DISTINCT o_custkey FROM orders)",
    "filtered_sample": """SELECT o_custkey AS c_custkey, o_orderkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "itemsets_1": "SELECT l_suppkey AS i1, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 30",
    "itemsets_2": _pairs(30, 30),
    "fp_growth": _pairs(30, 30),
    "itemsets_3": """WITH b AS (SELECT DISTINCT l_orderkey AS b, l_suppkey AS i FROM lineitem)
SELECT p.i AS i1, q.i AS i2, r.i AS i3, count(*) AS n FROM b p JOIN b q ON p.b = q.b AND p.i < q.i JOIN b r ON r.b = q.b AND q.i < r.i
GROUP BY ALL HAVING count(*) >= 5""",
    "itemsets_swapped": _pairs(3, 2, "l_suppkey", "l_orderkey", ("o1", "o2")),
    "itemsets_filtered": _pairs(20, 20, larger=3),
    "itemset_candidates": f"""WITH l2 AS ({_pairs(30, 30)})
SELECT concat_ws(',', p.i1, p.i2, q.i2) AS items FROM l2 p JOIN l2 q ON p.i1 = q.i1 AND p.i2 < q.i2 JOIN l2 r ON r.i1 = p.i2 AND r.i2 = q.i2""",
    "itemset_report": f"""WITH l2 AS ({_pairs(30, 30)}),
l1 AS (SELECT l_suppkey AS i1 FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 30),
lines AS (
  SELECT 0 AS k, 'Frequent Itemsets:' AS value
  UNION ALL SELECT 1, string_agg('(''' || i1 || ''')', ',' ORDER BY CAST(i1 AS VARCHAR)) FROM l1
  UNION ALL SELECT 2, string_agg('(''' || i1 || ''', ''' || i2 || ''')', ',' ORDER BY CAST(i1 AS VARCHAR), CAST(i2 AS VARCHAR)) FROM l2)
SELECT value FROM lines WHERE value IS NOT NULL""",
    "jaccard_exact": f"WITH sets AS ({PART_SETS}), {_jaccard_pairs(0.05)} SELECT a, b, round(sim, 6) AS sim FROM pairs",
    "jaccard_lsh": f"WITH {_lsh(PART_SETS, 30, 1, 26_184, True)}, {_jaccard_pairs(0.05)} SELECT a, b, round(sim, 6) AS sim FROM pairs JOIN candidates USING (a, b)",
    "lsh_banded": f"WITH {_lsh(PART_SETS, 40, 2, 1_000, False)}, {_jaccard_pairs(0.05)} SELECT a, b, round(sim, 6) AS sim FROM pairs JOIN candidates USING (a, b)",
    "tfidf_profile": f"WITH {PROFILE} SELECT doc_id, term, score, rank FROM profile",
    "user_profile": f"WITH {PROFILE} SELECT source, term FROM owners",
    "content_predict": f"""WITH {PROFILE}, n1 AS (SELECT source, count(*) AS n FROM owners GROUP BY source), n2 AS (SELECT doc_id, count(*) AS n FROM profile GROUP BY doc_id)
SELECT source, doc_id, round(c / (sqrt(n1.n) * sqrt(n2.n)), 6) AS sim
FROM (SELECT o.source, p.doc_id, count(*) AS c FROM owners o JOIN profile p USING (term) GROUP BY ALL) JOIN n1 USING (source) JOIN n2 USING (doc_id)
WHERE c / (sqrt(n1.n) * sqrt(n2.n)) >= 0.01""",
    "cf_item_model": f"WITH {_ratings()}, {_pearson('i', 'u')} SELECT a, b, round(sim, 6) AS sim FROM model",
    "cf_user_model": f"""WITH {_event_ratings()}, sets AS ({EVENT_SETS}), {_jaccard_pairs(0.01, 3)},
{_pearson('u', 'i', 'JOIN pairs z ON z.a = p.x AND z.b = q.x')} SELECT a, b, round(sim, 6) AS sim FROM model""",
    "cf_user_model_lsh": f"""WITH {_event_ratings()}, {_lsh(EVENT_SETS, 30, 2, 26_184, True)}, {_jaccard_pairs(0.4, 3)},
{_pearson('u', 'i', 'JOIN pairs z ON z.a = p.x AND z.b = q.x JOIN candidates y ON y.a = p.x AND y.b = q.x')} SELECT a, b, round(sim, 6) AS sim FROM model""",
    "cf_item_predict": f"""WITH {_ratings("o_orderstatus <> 'P'")}, {_pearson('i', 'u')},
near AS (SELECT a AS one, b AS other, sim FROM model UNION ALL SELECT b, a, sim FROM model),
wanted AS (SELECT DISTINCT o_custkey AS u, l_suppkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'),
met AS (
  SELECT w.u, w.i, r.stars, sim, row_number() OVER (PARTITION BY w.u, w.i ORDER BY round(sim, 9) DESC, other) AS k
  FROM wanted w JOIN ratings r ON r.u = w.u JOIN near ON one = w.i AND other = r.i)
SELECT u AS user, i AS item, round(sum(stars * sim) / sum(abs(sim)), 5) AS stars FROM met WHERE k <= 5 GROUP BY u, i""",
    "cf_user_predict": f"""WITH {_event_ratings("event_type <> 'error'")}, sets AS ({EVENT_SETS}), {_jaccard_pairs(0.4, 3)},
{_pearson('u', 'i', 'JOIN pairs z ON z.a = p.x AND z.b = q.x')},
near AS (SELECT a AS one, b AS other, sim FROM model UNION ALL SELECT b, a, sim FROM model),
wanted AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS INTEGER) AS i FROM events WHERE event_type = 'error'),
means AS (SELECT u, avg(stars) AS mean, sum(stars) AS total, count(*) AS n FROM ratings GROUP BY u),
met AS (
  SELECT w.u, w.i, r.stars - (m.total - r.stars) / (m.n - 1) AS off, sim, row_number() OVER (PARTITION BY w.u, w.i ORDER BY round(sim, 9) DESC, other) AS k
  FROM wanted w JOIN ratings r ON r.i = w.i JOIN near ON one = w.u AND other = r.u JOIN means m ON m.u = r.u WHERE m.n > 1)
SELECT met.u AS user, i AS item, round(any_value(means.mean) + sum(off * sim) / sum(abs(sim)), 5) AS stars
FROM met JOIN means ON means.u = met.u WHERE k <= 5 GROUP BY met.u, i""",
    "co_graph": f"WITH {GRAPH} SELECT u, v, common FROM edges",
    "graph_vertices": f"WITH {GRAPH} SELECT id FROM ids",
    "lpa_labels": f"WITH {GRAPH}, {_lpa()} SELECT id, label FROM l5",
    "communities": f"WITH {GRAPH}, {_lpa()} SELECT label, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members, count(*) AS size FROM l5 GROUP BY label",
    "shortest_paths": f"WITH {GRAPH}, {_paths()} SELECT s, v, CAST(d AS BIGINT) AS d, sigma FROM paths",
    "betweenness": f"""WITH {GRAPH}, {_paths()}
SELECT e.u, e.v, round(sum(su.sigma * tv.sigma / st.sigma) / 2, 4) AS betweenness
FROM (SELECT u, v, u AS x, v AS y FROM edges UNION ALL SELECT u, v, v, u FROM edges) e JOIN paths su ON su.v = e.x JOIN paths tv ON tv.v = e.y
JOIN paths st ON st.s = su.s AND st.v = tv.s AND st.d = su.d + 1 + tv.d GROUP BY e.u, e.v""",
    "components": f"WITH {GRAPH}, {_paths()}, {REACH} SELECT id, comp FROM reach",
    "modularity": f"""WITH {GRAPH}, {_paths()}, {REACH}, deg AS (SELECT s AS id, count(*) AS k FROM ways GROUP BY s),
c AS (SELECT comp, sum(k) AS k1, sum(k * k) AS k2 FROM reach JOIN deg USING (id) GROUP BY comp),
l AS (SELECT p.comp, 2.0 * count(*) AS l FROM edges e JOIN reach p ON p.id = e.u JOIN reach q ON q.id = e.v AND p.comp = q.comp GROUP BY p.comp)
SELECT round(sum((coalesce(l, 0) - (k1 * k1 - k2) / m2) / m2), 6) AS modularity FROM c LEFT JOIN l USING (comp), (SELECT 2.0 * count(*) AS m2 FROM edges)""",
    "cluster_statistics": f"WITH {POINTS} SELECT cluster, CAST(dim AS INTEGER) AS dim, round(mean, 6) AS mean, round(sd, 5) AS sd FROM centres",
    "kmeans_step": f"""WITH {POINTS}, d AS (SELECT id, c.cluster, round(sqrt(sum((x - mean) * (x - mean))), 9) AS dist FROM pts JOIN centres c USING (dim) GROUP BY id, c.cluster)
SELECT id, cluster, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r FROM d) WHERE r = 1""",
    "mahalanobis_assign": f"""WITH {POINTS}, d AS (
  SELECT id, c.cluster, round(sqrt(sum(((x - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END) ** 2)), 9) AS dist FROM pts JOIN centres c USING (dim) GROUP BY id, c.cluster)
SELECT id, cluster, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cluster) AS r FROM d) WHERE r = 1 AND dist < 24""",
    "centre_distance": f"WITH {POINTS} SELECT id, round(sqrt(sum((x - mean) * (x - mean))), 5) AS dist FROM pts JOIN centres USING (cluster, dim) GROUP BY id",
    "bloom_probe": f"""WITH {_bloom(5, 200_000)}, bits AS (SELECT DISTINCT bit FROM hashed WHERE c_acctbal > 5000)
SELECT c_custkey, CASE WHEN bool_and(b.bit IS NOT NULL) THEN 1 ELSE 0 END AS hit FROM hashed s LEFT JOIN bits b ON b.bit = s.bit GROUP BY c_custkey""",
    "fm_estimate": _fm(),
    "tag_top3": """WITH c AS (SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 1)
SELECT value, n FROM (SELECT *, dense_rank() OVER (ORDER BY n DESC) AS r FROM c WHERE value IS NOT NULL) WHERE r <= 3""",
    "stream_windows": """SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n
FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts) - INTERVAL 2 DAY]) AS start FROM events)
GROUP BY ALL""",
    "stream_distinct": "SELECT count(DISTINCT user_id) AS truth, count(*) AS events FROM events",
    "clean_words": f"WITH {WORDS} SELECT doc_id, count(term) AS n_words FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id",
}

#: The same over all pairs that the reference takes.
for _name in ("cf_user_model", "cf_user_model_lsh", "cf_user_predict"):
    ORACLES[f"{_name}_all"] = ORACLES[_name].replace(_jaccard_pairs(0.4, 3), _jaccard_pairs(0.01, 3))

#: CTE found(items, n): every set of each basket's frequent items, grown by a larger item a step.
_ALL_SETS = """WITH RECURSIVE b AS (SELECT DISTINCT l_orderkey AS b, l_suppkey AS i FROM lineitem),
f AS (SELECT i FROM b GROUP BY i HAVING count(*) >= 30), k AS (SELECT b, i FROM b JOIN f USING (i)),
s AS (SELECT b, [i] AS items, i AS top FROM k UNION ALL SELECT s.b, list_append(s.items, k.i), k.i FROM s JOIN k ON k.b = s.b AND k.i > s.top),
found AS (SELECT items, count(*) AS n FROM s GROUP BY items HAVING count(*) >= 30)"""
ORACLES["fp_growth_all"] = f"{_ALL_SETS} SELECT array_to_string(items, ',') AS items, n FROM found"
ORACLES["itemset_report_all"] = f"""{_ALL_SETS}, lines AS (
  SELECT 0 AS k, 'Frequent Itemsets:' AS value
  UNION ALL SELECT len(items), string_agg('(''' || array_to_string(items, ''', ''') || ''')', ',' ORDER BY list_transform(items, lambda x: CAST(x AS VARCHAR)))
  FROM found GROUP BY len(items))
SELECT value FROM lines"""

ORACLES["partition_sizes"] = """SELECT CAST(range AS INTEGER) AS part, (SELECT count(*) FROM lineitem WHERE (l_suppkey * 7 + 3) % 20 = range) AS n FROM range(20)"""
ORACLES["reservoir"] = "SELECT event_id, event_type FROM events ORDER BY md5('3:' || event_id), event_id LIMIT 100"
#: What a slot holds after event n is the tag of the last event that wrote it.
ORACLES["stream_report"] = """WITH e AS (SELECT row_number() OVER (ORDER BY event_id, event_type) AS n, event_type AS tag FROM events WHERE event_type <> ''),
h AS (SELECT n, tag, md5('5:' || n) AS d FROM e), v AS (SELECT n, tag, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS u, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS w FROM h),
writes AS (SELECT n, tag, CASE WHEN n <= 100 THEN n - 1 ELSE w % 100 END AS slot FROM v WHERE n <= 100 OR u * n < 100 * 4294967296),
places AS (SELECT n, s.range AS slot FROM e, range(100) s),
held AS (SELECT p.n, w.tag FROM places p ASOF JOIN writes w ON p.slot = w.slot AND p.n >= w.n),
counts AS (SELECT n, tag, count(*) AS c FROM held GROUP BY ALL), ranked AS (SELECT *, dense_rank() OVER (PARTITION BY n ORDER BY c DESC) AS r FROM counts)
SELECT n AS number, string_agg(tag || ' : ' || c, '; ' ORDER BY c DESC, tag) AS report FROM ranked WHERE r <= 3 GROUP BY n"""
