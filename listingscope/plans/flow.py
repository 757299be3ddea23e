"""The order of the stages, from raw listings to the final scored table.

Each stage is DataFrame in, DataFrame out; results are written where several
later stages read them (features, graph, final) and read back from there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingscope.functions import listing, text
from listingscope.functions.columns import csv_text
from listingscope.operators import centrality, community, dedupe, enrich, essential, graph, images, rules, similarity
from listingscope.sources.store import Snapshots


@dataclass
class Inputs:
    listings: DataFrame                         # raw nested listings
    sellers: DataFrame
    reviews: DataFrame                          # review grain: product_id, review_no, text, rating, has_images
    prices: DataFrame | None = None             # price_key, unit_price
    images: DataFrame | None = None             # listing_id, file_name, image_hash
    vectors: dict[str, DataFrame] = field(default_factory=dict)  # kind -> listing_id, vec
    lexicon: DataFrame | None = None            # word, valence


def features(inputs: Inputs) -> DataFrame:
    """Unified listings to the 34-column feature table, one row per listing id."""
    rows = enrich.with_sellers(inputs.listings, inputs.sellers)
    named = rows.withColumns({
        "vendedor_nome": F.coalesce("nickname", "vendedor_nome"),
        "vendedor_total_transacoes": F.coalesce("transactions", "vendedor_total_transacoes"),
    }).drop(*enrich.SELLER_COLUMNS)
    # The first record of an id wins, in source order where the reader kept it.
    place = [c for c in ("source_order",) if c in named.columns]
    base = essential.essential(named, place)
    order = place or [F.coalesce("link", F.lit("")), F.coalesce("title", F.lit("")), F.to_json(F.struct("*"))]
    base = dedupe.keep_first(base, ["listing_id"], order).drop(*place)
    read = base.withColumn("_a", text.attributes(csv_text(F.col("title")), F.col("description"))).select(*base.columns, "_a.*")
    if inputs.prices is not None:
        read = listing.suggested_price(read, inputs.prices)
    else:
        read = read.withColumn("suggested_price", F.lit(None).cast("double"))
    kept, _ = essential.keep_existing(listing.basic_features(read))
    return kept


def merged(basic: DataFrame, inputs: Inputs) -> DataFrame:
    """Features with text and image columns, scored by the rules."""
    worded = text.review_features(inputs.reviews, "product_id", inputs.lexicon).withColumnRenamed("product_id", "listing_id")
    out = enrich.with_columns_of(basic, worded, "listing_id")
    if inputs.images is not None:
        reuse = images.per_listing(images.with_reuse(inputs.images))
        out = enrich.with_columns_of(out, reuse, "listing_id")
    else:
        out = out.withColumn("image_reuse", F.lit(1)).withColumn("n_images", F.lit(0))
    return rules.score(out)


def seller_graph(scored: DataFrame, inputs: Inputs, hub_size: int = graph.HUB_SIZE, threshold: float = similarity.THRESHOLD) -> graph.SellerGraph:
    nodes = graph.seller_nodes(scored)
    groups = [graph.catalog_layer(scored)]
    pairs, crossings = [graph.alternative_layer(scored, nodes)], []
    owner = scored.select("listing_id", "seller_id")
    if inputs.images is not None:
        groups.append(graph.image_layer(inputs.images.join(owner, "listing_id")))
    for kind, vectors in inputs.vectors.items():
        same, near, wide = similarity.similarity_layer(vectors.join(owner, "listing_id"), kind, threshold, hub_size)
        groups.append(same)
        pairs.append(near)
        crossings.append(wide)
    return graph.build(nodes, groups, pairs, hub_size, crossings)


def run(spark: SparkSession, inputs: Inputs, out: str, hub_size: int = graph.HUB_SIZE, path_samples: int | None = None) -> DataFrame:
    """All stages; writes features, graph and final snapshots under ``out``."""
    store = {name: Snapshots(spark, f"{out}/{name}") for name in ("features", "scored", "graph", "final")}
    store["features"].write(features(inputs))
    store["scored"].write(merged(store["features"].read(), inputs))
    scored = store["scored"].read()
    net = seller_graph(scored, inputs, hub_size)
    table = graph.feature_table(
        net, community.communities(net), centrality.path_centrality(net, path_samples), centrality.pagerank(net))
    store["graph"].write(table)
    known = [c for c in ("listings", "suspects", "suspect_rate")]
    joined = enrich.with_seller_graph(scored, store["graph"].read().withColumnsRenamed({c: f"seller_{c}" for c in known}))
    store["final"].write(joined)
    return store["final"].read()
