"""The seller graph and the model over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingscope.functions import columns as C
from listingscope.operators import centrality, community, enrich, graph, ridge, similarity
from listingscope.plans.queries_tables import HASHES_SQL, alternatives
from listingscope.plans.registry import LISTINGS_SQL, REPORT_SQL, SCORED_SQL, Tables, query, rounded, sql
from listingscope.session import cut

# Small enough that the catalog groups of the test tables fall on both sides.
HUB = 34
# No pair of the test vectors is as close as the default asks.
NEAR = 0.3

# ---------------------------------------------------------------- graphs


def nodes(t: Tables):
    return graph.seller_nodes(t.scored())


def image_graph(t: Tables) -> graph.SellerGraph:
    """Sellers linked by shared pictures only: the sparse graph."""
    return graph.build(nodes(t), [graph.image_layer(t.images())], hub_size=HUB)


def full_graph(t: Tables) -> graph.SellerGraph:
    """All four layers."""
    n = cut(nodes(t))
    same, near, wide = similarity.similarity_layer(t.vectors(), "text", NEAR, HUB)
    known = near.join(n.select(F.col("seller_id").alias("src")), "src", "left_semi").join(n.select(F.col("seller_id").alias("dst")), "dst", "left_semi")
    same, wide = (rows.join(n.select("seller_id"), "seller_id", "left_semi") for rows in (same, wide))
    return graph.build(n, [graph.catalog_layer(t.listings()), graph.image_layer(t.images()), same],
                       [graph.alternative_layer(alternatives(t), n), known], HUB, [wide])


CATALOG_SQL = """
cat AS (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem),
cat_size AS (SELECT k, count(*) AS n FROM cat GROUP BY k)"""
CATALOG_EDGES = "SELECT a.s AS src, b.s AS dst, 5.0e0 * count(*) AS weight, 1 AS layer FROM cat a JOIN cat b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2"
ALT_EDGES = """SELECT least(a.l_suppkey, b.l_suppkey) AS src, greatest(a.l_suppkey, b.l_suppkey) AS dst, 2.0e0 * count(*) AS weight, 2 AS layer
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 AND a.l_linenumber > 1 AND a.l_suppkey <> b.l_suppkey GROUP BY 1, 2"""
IMAGE_SQL = HASHES_SQL + """,
img AS (SELECT DISTINCT image_hash AS k, seller_id AS s FROM i WHERE image_hash <> 'ERRO')"""
IMAGE_EDGES = "SELECT a.s AS src, b.s AS dst, 1.0e0 * count(*) AS weight, 3 AS layer FROM img a JOIN img b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2"
SIMILAR_SQL = f"""
vec AS (SELECT vec_id, vec_id % 50 AS s, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sim AS (SELECT a.s AS sa, b.s AS sb FROM vec a JOIN vec b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) > {NEAR})"""
SIMILAR_EDGES = """SELECT least(sa, sb) AS src, greatest(sa, sb) AS dst, 0.5e0 * count(*) AS weight, 4 AS layer FROM sim
  WHERE sa <> sb AND sa IN (SELECT s_suppkey FROM supplier) AND sb IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2"""
GRAPH_SQL = f"""{SCORED_SQL}, {CATALOG_SQL.strip()}, {IMAGE_SQL.strip()}, {SIMILAR_SQL.strip()},
edges AS (SELECT src, dst, sum(weight) AS weight, min(layer) AS layer FROM ({CATALOG_EDGES} UNION ALL {ALT_EDGES} UNION ALL {IMAGE_EDGES} UNION ALL {SIMILAR_EDGES}) GROUP BY 1, 2),
links AS (SELECT src AS a, dst AS b, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
nodes AS (SELECT seller_id, count(*) AS listings, CAST(sum(suspect) AS BIGINT) AS suspects, avg(suspect) AS suspect_rate,
  min_by(transactions, listing_id) AS transactions, min_by(reputation, listing_id) AS reputation, min_by(official, listing_id) AS official FROM scored GROUP BY 1),
around AS (SELECT a AS seller_id, count(*) AS neighbours, CAST(sum(suspects) AS BIGINT) AS neighbour_suspects, sum(suspects) * 1e0 / sum(listings) AS neighbour_rate,
  sum(weight) AS total_weight, sum(weight) / count(*) AS mean_weight FROM links JOIN nodes ON b = seller_id GROUP BY a)"""


@query("seller_nodes", sql(GRAPH_SQL, "SELECT seller_id, listings, suspects, round(suspect_rate, 6) AS suspect_rate, transactions, reputation, official FROM nodes"))
def seller_nodes(t: Tables):
    return rounded(nodes(t), "suspect_rate")


def _strengths_sql(ctes: str, edges: str) -> str:
    return f"""
WITH {ctes.strip()}, e AS ({edges})
SELECT seller_id, sum(weight) AS total_weight FROM (SELECT src AS seller_id, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY seller_id"""


def strengths(g: graph.SellerGraph):
    """Summed edge weight of every linked seller: the same rows whatever groups are kept as hubs."""
    ones = g.nodes.select("seller_id", F.lit(1.0).alias("total_weight"))
    return graph.weighted_sums(g, ones, "total_weight").where("total_weight > 0")


@query("catalog_layer", _strengths_sql(CATALOG_SQL, CATALOG_EDGES))
def catalog_layer(t: Tables, hub_size: int = HUB):
    return strengths(graph.build(nodes(t), [graph.catalog_layer(t.listings())], hub_size=hub_size))


@query("alternative_layer", f"SELECT src, dst, weight FROM ({ALT_EDGES})")
def alternative_layer(t: Tables):
    return graph.alternative_layer(alternatives(t), nodes(t)).select("src", "dst", "weight")


@query("image_layer", _strengths_sql(IMAGE_SQL, IMAGE_EDGES))
def image_layer(t: Tables, hub_size: int = HUB):
    return strengths(graph.build(nodes(t), [graph.image_layer(t.images())], hub_size=hub_size))


# A picture that every second seller shows, and each tenth vector once more with another seller.
CROWD_SQL = IMAGE_SQL + """,
crowd AS (SELECT k, s FROM img UNION SELECT 'crowd', l_suppkey FROM lineitem WHERE l_suppkey % 2 = 0)"""


@query("crowded_image_layer", _strengths_sql(CROWD_SQL, IMAGE_EDGES.replace("img", "crowd")))
def crowded_image_layer(t: Tables, hub_size: int = 2):
    """A picture with more sellers than the hub size beside small groups: no edge may be lost."""
    crowd = t["lineitem"].where("l_suppkey % 2 = 0").select(F.lit(0).cast("bigint").alias("listing_id"), F.col("l_suppkey").alias("seller_id"), F.lit("crowd").alias("image_hash"))
    return strengths(graph.build(nodes(t), [graph.image_layer(t.images().unionByName(crowd))], hub_size=hub_size))


COPIED_SQL = SIMILAR_SQL.replace(
    "FROM embeddings)", "FROM embeddings UNION ALL SELECT vec_id + 1000000, (vec_id + 7) % 50, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 10 = 0)")
COPIED_EDGES = "SELECT least(sa, sb) AS src, greatest(sa, sb) AS dst, 0.5e0 * count(*) AS weight FROM sim WHERE sa <> sb GROUP BY 1, 2"


@query("similarity_layer", _strengths_sql(COPIED_SQL, COPIED_EDGES))
def similarity_layer(t: Tables, hub_size: int = 1):
    """All three parts of the layer: copied texts, similar texts, and similar texts with crowds of sellers."""
    rows = t.vectors()
    rows = rows.unionByName(rows.where("listing_id % 10 = 0").select((F.col("listing_id") + 1000000).alias("listing_id"), ((F.col("seller_id") + 7) % 50).alias("seller_id"), "vec"))
    same, pairs, wide = similarity.similarity_layer(rows, "text", NEAR, hub_size, block=64)
    return strengths(graph.build(rows.select("seller_id").distinct(), [same], [pairs], hub_size, [wide]))


@query("similar_pairs_hashed", f"""
WITH {SIMILAR_SQL.strip()}, one AS (SELECT e, min(vec_id) AS v FROM vec GROUP BY e)
SELECT least(a.v, b.v) AS a, greatest(a.v, b.v) AS b FROM one a JOIN one b ON a.v < b.v AND list_cosine_similarity(a.e, b.e) > {NEAR}""")
def similar_pairs_hashed(t: Tables):
    """The hashed join at a recall that leaves no pair out: every pair of the exact answer, and no other."""
    units, _ = similarity.distinct_vectors(t.vectors())
    return similarity.similar_vectors(units, NEAR, block=64, recall=1 - 1e-9)


@query("similarity_counts", f"WITH {SIMILAR_SQL.strip()} SELECT (SELECT count(*) FROM vec) AS valid, (SELECT count(*) FROM sim) AS pairs")
def similarity_counts(t: Tables):
    return similarity.similarity_counts(t.vectors(), NEAR)


@query("seller_neighbourhood", sql(GRAPH_SQL, """
SELECT n.seller_id, coalesce(neighbours, 0) AS degree, coalesce(neighbours, 0) AS neighbours, coalesce(neighbour_suspects, 0) AS neighbour_suspects,
  round(coalesce(neighbour_rate, 0), 6) AS neighbour_rate, coalesce(total_weight, 0) AS total_weight, round(coalesce(mean_weight, 0), 6) AS mean_weight
FROM nodes n LEFT JOIN around USING (seller_id)"""))
def seller_neighbourhood(t: Tables):
    return rounded(graph.neighbourhood(full_graph(t)), "neighbour_rate", "mean_weight")


@query("seller_graph_summary", sql(GRAPH_SQL, """
SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, (SELECT count(*) FROM around) AS connected, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM around) AS isolated,
  round(avg(weight), 6) AS weight_mean, min(weight) AS weight_min, max(weight) AS weight_max FROM edges"""))
def seller_graph_summary(t: Tables):
    return rounded(graph.summary(full_graph(t)), "weight_mean")


@query("new_edges_by_layer", sql(GRAPH_SQL, "SELECT l.layer, count(e.src) AS edges FROM (VALUES (1), (2), (3), (4)) l(layer) LEFT JOIN edges e USING (layer) GROUP BY 1"))
def new_edges_by_layer(t: Tables):
    return graph.new_edges(full_graph(t))


@query("listings_with_graph", sql(GRAPH_SQL, """
SELECT listing_id, coalesce(neighbours, 0) AS degree, round(coalesce(neighbour_rate, 0), 6) AS neighbour_rate FROM scored LEFT JOIN around USING (seller_id)"""))
def listings_with_graph(t: Tables):
    features = rounded(graph.neighbourhood(full_graph(t)), "neighbour_rate").select("seller_id", "degree", "neighbour_rate")
    return enrich.with_seller_graph(t.scored().select("listing_id", "seller_id"), features).drop("seller_id")


@query("graph_feature_table", sql(GRAPH_SQL, """
SELECT n.seller_id, s_nationkey AS community, n.listings, n.suspects, coalesce(neighbours, 0) AS degree,
  count(*) OVER w AS community_size, CAST(sum(n.suspects) OVER w AS BIGINT) AS community_suspects, CAST(sum(n.listings) OVER w AS BIGINT) AS community_listings,
  round(sum(n.suspects) OVER w * 1e0 / sum(n.listings) OVER w, 6) AS community_rate
FROM nodes n JOIN supplier ON s_suppkey = n.seller_id LEFT JOIN around USING (seller_id) WINDOW w AS (PARTITION BY s_nationkey)"""))
def graph_feature_table(t: Tables):
    """Community totals on every seller, with the nation as a community both engines know."""
    nation = t["supplier"].select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("community"))
    table = rounded(graph.feature_table(full_graph(t), nation), "community_rate")
    return table.select("seller_id", "community", "listings", "suspects", "degree", "community_size", "community_suspects", "community_listings", "community_rate")


@query("seller_communities")
def seller_communities(t: Tables):
    return community.communities(image_graph(t))


@query("full_graph_communities")
def full_graph_communities(t: Tables):
    return community.communities(full_graph(t))


@query("group_communities", """
WITH g AS (SELECT c_nationkey AS k, count(*) AS n, min(c_custkey) AS low FROM customer GROUP BY 1),
numbered AS (SELECT k, row_number() OVER (ORDER BY n DESC, low) - 1 AS community FROM g WHERE n > 1)
SELECT c_custkey AS seller_id, coalesce(community, -1) AS community FROM customer LEFT JOIN numbered ON k = c_nationkey""")
def group_communities(t: Tables):
    """Groups without a link between them, large ones kept as hubs: each is a community, and no community holds two."""
    people = t["customer"].select(F.col("c_custkey").alias("seller_id"), F.col("c_nationkey").alias("k"), F.lit(1).alias("listings"), F.lit(0).alias("suspects"))
    g = graph.build(people.drop("k"), [graph.memberships(people, "k", graph.IMAGE, graph.IMAGE_WEIGHT)], hub_size=6)
    return community.communities(g)


@query("community_checks", sql(IMAGE_SQL, "SELECT count(DISTINCT l_suppkey) AS sellers, 1 AS inside_components, 1 AS not_worse_than_components FROM lineitem"))
def community_checks(t: Tables):
    """Communities cover all sellers, stay inside components and cluster at least as well as those."""
    g = image_graph(t)
    found, parts = cut(community.communities(g)), cut(centrality.components(g))
    better = community.modularity(g, found) >= community.modularity(g, parts.withColumnRenamed("component", "community")) - 1e-9
    joined = found.where("community >= 0").join(parts, "seller_id")
    spans = joined.groupBy("community").agg((F.min("component") == F.max("component")).cast("int").alias("one"))
    return found.agg(F.count(F.lit(1)).alias("sellers")).withColumn("inside_components", spans.agg(F.min("one")).scalar()).withColumn(
        "not_worse_than_components", F.lit(int(better)))


CUSTOMER_SQL = """
mem AS (SELECT concat('n', c_nationkey, ':', CAST(floor(c_acctbal / 50) AS BIGINT)) AS k, c_custkey AS s FROM customer
  UNION SELECT concat(c_mktsegment, ':', CAST(floor(c_acctbal / 10) AS BIGINT)), c_custkey FROM customer),
e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM mem a JOIN mem b ON a.k = b.k AND a.s <> b.s)"""


def customer_graph(t: Tables) -> graph.SellerGraph:
    """Customers alike in nation or segment and balance: many components of all sizes."""
    balance = F.col("c_acctbal")
    by_nation = t["customer"].select(F.col("c_custkey").alias("seller_id"), F.concat(F.lit("n"), "c_nationkey", F.lit(":"), F.floor(balance / 50)).alias("k"))
    by_segment = t["customer"].select(F.col("c_custkey").alias("seller_id"), F.concat("c_mktsegment", F.lit(":"), F.floor(balance / 10)).alias("k"))
    members = graph.memberships(by_nation.unionByName(by_segment), "k", graph.IMAGE, graph.IMAGE_WEIGHT)
    people = t["customer"].select(F.col("c_custkey").alias("seller_id"), F.lit(1).alias("listings"), F.lit(0).alias("suspects"))
    return graph.build(people, [members], hub_size=3)


@query("connected_components", f"""
WITH RECURSIVE {CUSTOMER_SQL.strip()},
r AS (SELECT c_custkey AS s, c_custkey AS c FROM customer UNION SELECT e.b, r.c FROM r JOIN e ON r.s = e.a)
SELECT s AS seller_id, min(c) AS component FROM r GROUP BY s""")
def connected_components(t: Tables):
    return centrality.components(customer_graph(t))


PAGERANK_SQL = """
links AS (SELECT a.s AS a, b.s AS b, count(*) * 1e0 AS w FROM img a JOIN img b ON a.k = b.k AND a.s <> b.s GROUP BY 1, 2),
st AS (SELECT a, sum(w) AS w FROM links GROUP BY a),
share AS (SELECT l.a, l.b, l.w / st.w AS p FROM links l JOIN st ON l.a = st.a),
n AS (SELECT count(*) AS n FROM st),
pr AS (SELECT 0 AS i, a AS s, 1e0 / n AS r FROM st, n
  UNION ALL SELECT i + 1, b, 0.15e0 / any_value(n.n) + 0.85e0 * sum(r * p) FROM pr JOIN share ON share.a = pr.s, n WHERE i < 80 GROUP BY i, b)"""


@query("pagerank", f"WITH RECURSIVE {IMAGE_SQL.strip()}, {PAGERANK_SQL.strip()} SELECT s AS seller_id, round(r, 6) AS pagerank FROM pr WHERE i = 80")
def pagerank(t: Tables):
    return rounded(centrality.pagerank(image_graph(t), tolerance=1e-10), "pagerank")


PATHS_SQL = """
nb AS (SELECT DISTINCT a.s AS a, b.s AS b FROM img a JOIN img b ON a.k = b.k AND a.s <> b.s),
step AS (SELECT DISTINCT a AS s, a AS v, 0 AS d FROM nb UNION SELECT step.s, nb.b, d + 1 FROM step JOIN nb ON step.v = nb.a WHERE d < 6),
dist AS (SELECT s, v, min(d) AS d FROM step GROUP BY 1, 2),
path AS (SELECT s, v, d, 1e0 AS sigma FROM dist WHERE d = 0
  UNION ALL SELECT p.s, nb.b, p.d + 1, sum(p.sigma) FROM path p JOIN nb ON p.v = nb.a JOIN dist t ON t.s = p.s AND t.v = nb.b AND t.d = p.d + 1 GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM dist WHERE d = 0),
mid AS (SELECT x.v AS m, sum(x.sigma * y.sigma / z.sigma) AS b FROM path x JOIN path y ON x.v = y.s JOIN path z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d
  WHERE x.d > 0 AND y.d > 0 GROUP BY 1)"""


@query("path_centrality", f"""
WITH RECURSIVE {IMAGE_SQL.strip()}, {PATHS_SQL.strip()}
SELECT s AS seller_id, round(coalesce(any_value(b), 0) / ((any_value(n) - 1) * (any_value(n) - 2)), 6) AS betweenness,
  round((count(*) - 1) * 1e0 / sum(d) * (count(*) - 1) / (any_value(n) - 1), 6) AS closeness FROM dist LEFT JOIN mid ON m = s, n GROUP BY s""")
def path_centrality(t: Tables):
    return rounded(centrality.path_centrality(image_graph(t)), "betweenness", "closeness")


@query("sketched_closeness", f"""
WITH RECURSIVE {IMAGE_SQL.strip()}, {PATHS_SQL.strip()}
SELECT s AS seller_id, round((count(*) - 1) * 1e0 / sum(d) * (count(*) - 1) / (any_value(n) - 1), 6) AS closeness FROM dist, n GROUP BY s""")
def sketched_closeness(t: Tables):
    """Closeness from sketches that are exact for as few sellers as the test tables have."""
    return rounded(centrality.sketched_closeness(image_graph(t), lg=16), "closeness")


@query("sampled_betweenness", f"""
WITH RECURSIVE {IMAGE_SQL.strip()}, {PATHS_SQL.strip()},
sample AS (SELECT s FROM dist WHERE d = 0 ORDER BY md5(concat(s, ':7')), s LIMIT 20),
part AS (SELECT x.v AS m, sum(x.sigma * y.sigma / z.sigma) AS b FROM path x JOIN path y ON x.v = y.s JOIN path z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d
  WHERE x.d > 0 AND y.d > 0 AND x.s IN (SELECT s FROM sample) GROUP BY 1)
SELECT s AS seller_id, round(coalesce(b, 0) * n / (SELECT count(*) FROM sample) / ((n - 1) * (n - 2)), 6) AS betweenness
FROM dist LEFT JOIN part ON m = s, n WHERE d = 0 ORDER BY 2 DESC, 1 LIMIT 10""")
def sampled_betweenness(t: Tables):
    """Betweenness from a sample of sources that md5 of id and seed draws; the ten highest."""
    found = rounded(centrality.path_centrality(image_graph(t), k=20, seed=7), "betweenness")
    return found.select("seller_id", "betweenness").orderBy(F.desc("betweenness"), "seller_id").limit(10)


MEMBERS_SQL = REPORT_SQL + ", mem AS (SELECT DISTINCT seller_id, community FROM report)"


@query("clique_graph_summary", sql(MEMBERS_SQL, """
SELECT nodes, edges, components, largest, 2e0 * edges / (nodes * (nodes - 1)) AS density FROM (
  SELECT (SELECT count(*) FROM mem) AS nodes, (SELECT count(*) FROM mem a JOIN mem b ON a.community = b.community AND a.seller_id < b.seller_id) AS edges,
  (SELECT count(DISTINCT community) FROM mem) AS components, (SELECT max(k) FROM (SELECT count(*) AS k FROM mem GROUP BY community)) AS largest)"""))
def clique_graph_summary(t: Tables):
    return graph.clique_graph_summary(t.report().select("seller_id", "community").distinct())


@query("clique_degree_centrality", sql(MEMBERS_SQL, """
SELECT a.seller_id, s_name AS seller_name, a.community, k - 1 AS degree, (k - 1) * 1e0 / ((SELECT count(*) FROM mem) - 1) AS centrality
FROM mem a JOIN (SELECT community, count(*) AS k FROM mem GROUP BY 1) USING (community) JOIN supplier ON s_suppkey = a.seller_id ORDER BY 5 DESC, 1 LIMIT 10"""))
def clique_degree_centrality(t: Tables):
    names = t["supplier"].select(F.col("s_suppkey").alias("seller_id"), F.col("s_name").alias("seller_name"))
    return graph.clique_degree_centrality(t.report().select("seller_id", "community").distinct(), names)


# ---------------------------------------------------------------- model

RIDGE_SQL = SCORED_SQL + """,
m AS (SELECT avg(price_gap) AS m1, stddev_pop(price_gap) AS s1, avg(negative_share) AS m2, stddev_pop(negative_share) AS s2, avg(2e0 * suspect - 1) AS my FROM scored),
z AS (SELECT listing_id, (price_gap - m1) / s1 AS z1, (negative_share - m2) / s2 AS z2, 2e0 * suspect - 1 AS y, my FROM scored, m),
a AS (SELECT sum(z1 * z1) + 1 AS a11, sum(z1 * z2) AS a12, sum(z2 * z2) + 1 AS a22, sum(z1 * y) AS b1, sum(z2 * y) AS b2, any_value(my) AS b FROM z),
w AS (SELECT (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2, b FROM a)"""
PAIR = ["price_gap", "negative_share"]


@query("standardised_features", sql(RIDGE_SQL, "SELECT listing_id, round(z1, 6) AS price_gap, round(z2, 6) AS negative_share FROM z"))
def standardised_features(t: Tables):
    return rounded(ridge.standardised(t.scored(), PAIR), *PAIR).select("listing_id", *PAIR)


@query("ridge_scores", sql(RIDGE_SQL, """
SELECT listing_id, round(1 / (1 + exp(-(b + w1 * z1 + w2 * z2))), 6) AS model_score, CAST(b + w1 * z1 + w2 * z2 > 0 AS INTEGER) AS predicted FROM z, w"""))
def ridge_scores(t: Tables):
    rows = t.scored()
    return rounded(ridge.fit(rows, PAIR, "suspect").score(rows), "model_score").select("listing_id", "model_score", "predicted")


@query("ridge_importance", sql(RIDGE_SQL, """
SELECT feature, round(c, 6) AS coefficient, round(abs(c), 6) AS magnitude, CASE WHEN c > 0 THEN 'raises' WHEN c < 0 THEN 'lowers' ELSE 'neutral' END AS effect
FROM (SELECT 'price_gap' AS feature, w1 AS c FROM w UNION ALL SELECT 'negative_share', w2 FROM w)"""))
def ridge_importance(t: Tables):
    return rounded(ridge.fit(t.scored(), PAIR, "suspect").importance(t.spark), "coefficient", "magnitude").limit(15)


@query("ridge_all_features")
def ridge_all_features(t: Tables):
    """The model on every numeric training column, with the leaking ones left out."""
    rows = t.scored()
    numeric, _ = ridge.feature_names(rows, "no_leak")
    train, test = ridge.split(rows, "listing_id")
    return ridge.quality(ridge.fit(train, numeric, "suspect").score(test))


@query("encoded_names", """
WITH c AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_type <> 'LARGE' AND p_name < 's'))
SELECT p_partkey, CAST(coalesce(code, (SELECT count(*) FROM c)) AS DOUBLE) AS p_name FROM part LEFT JOIN c USING (p_name)""")
def encoded_names(t: Tables):
    """Classes from some parts, applied to all: an unseen name gets the first free code."""
    classes = ridge.encoder(t["part"].where("p_type <> 'LARGE' AND p_name < 's'"), "p_name")
    return ridge.encode(t["part"].select("p_partkey", "p_name"), "p_name", classes)


@query("training_metadata", sql(SCORED_SQL, """
SELECT count(*) AS samples, CAST(sum(suspect) AS BIGINT) AS suspects, count(*) - CAST(sum(suspect) AS BIGINT) AS legitimate, round(avg(suspect), 6) AS suspect_rate,
  3 AS features, 1 AS graph_features, 1 AS flag_features FROM scored"""))
def training_metadata(t: Tables):
    return rounded(ridge.training_metadata(t.scored(), "suspect", ["rating", "degree", "flag_instant_fraud"]), "suspect_rate")


@query("label_quality", """
SELECT tp, fp, fn, tn, round(coalesce(tp * 1e0 / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp * 1e0 / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM (SELECT count(*) FILTER (WHERE toxic = 1 AND n_chars < 500) AS tp, count(*) FILTER (WHERE toxic = 0 AND n_chars < 500) AS fp,
  count(*) FILTER (WHERE toxic = 1 AND n_chars >= 500) AS fn, count(*) FILTER (WHERE toxic = 0 AND n_chars >= 500) AS tn FROM labels JOIN documents USING (doc_id))""")
def label_quality(t: Tables):
    rows = t["labels"].join(t["documents"], "doc_id").withColumn("predicted", C.flag(F.col("n_chars") < 500))
    return rounded(ridge.quality(rows, "toxic"), "precision", "recall", "f1")


@query("listing_rows", sql(LISTINGS_SQL, "SELECT listing_id, seller_id, price, reputation, transactions, status, community FROM listings"))
def listing_rows(t: Tables):
    return t.listings().select("listing_id", "seller_id", "price", "reputation", "transactions", "status", "community")
