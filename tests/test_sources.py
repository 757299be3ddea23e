"""Files in, tables out: readers, exports, the store, the stream and the whole run."""

import json
import time

import pytest
from pyspark.sql import functions as F

from listingscope.operators import dedupe, enrich, essential, reports
from listingscope.plans import flow
from listingscope.sources import raw, store
from listingscope.sources.schemas import original_names
from listingscope.streaming import upsert


def dump(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")
    return str(path)


def listing(i, seller=1, **more):
    data = {"catalog_product_id": f"C{i % 2}", "official_store_id": "", "logistic_type": "full", "reviews": {"rate": 4.0, "count": 10},
            "alternative_buying_options": [{"seller_id": 2}, {"seller_id": None}, {}],
            "shipping_promise": {"address_options": [{"origins": [{"value": "SP"}]}]}}
    return {"id": f"MLB{i}", "titulo": f"Cartucho 664 preto {i}", "preco": "30.0", "seller_id": str(seller), "link": f"l{i}", "imagem_url": f"u{i}",
            "reputation_level": "1_red", "power_seller_status": "", "rating_estrelas": 3.0, "distribuicao_estrelas": {"1_estrelas": 4, "5_estrelas": 6},
            "dados_brutos": {"melidata": data}, **more}


def test_three_wrappings(spark, tmp_path):  # A1, A5, K6
    a = dump(tmp_path / "a.json", {"produtos": [listing(1), listing(2)]})
    b = dump(tmp_path / "b.json", {"busca_info": {}, "produto": listing(3)})
    c = dump(tmp_path / "c.json", [listing(4), listing(5)])
    rows = raw.read_listing_sets(spark, {"664": a, "667": [b, c]})
    assert sorted((r.product_id, r.cartridge_type) for r in rows.collect()) == [
        ("MLB1", "664"), ("MLB2", "664"), ("MLB3", "667"), ("MLB4", "667"), ("MLB5", "667")]


def test_single_listing_ids_and_reviews(spark, tmp_path):  # A5
    review = {"rating": 5, "text": "bom", "has_images": False}
    path = dump(tmp_path / "x.json", [{"titulo": "t", "product_id": "P", "todos_reviews": [review]}, {"id": "I", "product_id": "P"}, {"titulo": "none"}])
    files = raw._json(spark, path, raw.schemas.LISTING_FILE)
    rows = raw.single_listing(files, raw._listing_fields(spark))
    assert [r.product_id for r in rows.orderBy("position").collect()] == ["P", "I", None]
    assert sorted((r.product_id, len(r.reviews)) for r in raw.single_listing_reviews(rows).collect()) == [("I", 0), ("P", 1)]


def test_reviews_and_sellers(spark, tmp_path):  # A2, A3, C2
    a = dump(tmp_path / "r1.json", [{"product_id": "MLB1", "general_data": {"average_rating": 4.5, "total_reviews": 2},
                                     "reviews": [{"rating": 1, "text": "ruim demais", "has_images": True}, {"rating": 9, "text": " "}]}])
    reviews = raw.exploded_reviews(raw.read_reviews(spark, a))
    (r,) = enrich.review_counts(reviews, "product_id").collect()
    assert (r.stars_1, r.stars_5, r.with_text, r.with_images, r.reviews) == (1, 0, 1, 1, 2)
    s1 = dump(tmp_path / "s1.json", {"dados_vendedores": [{"id": 1, "nickname": "first", "seller_reputation": {"transactions": {"total": 5}}}, {"nickname": "no id"}]})
    s2 = dump(tmp_path / "s2.json", {"dados_vendedores": [{"id": 1, "nickname": "second"}, {"id": 2, "nickname": "two"}]})
    assert sorted((r.id, r.nickname, r.transactions) for r in raw.read_sellers(spark, [s1, s2]).collect()) == [(1, "first", 5), (2, "two", None)]


def test_first_record_in_source_order_wins(spark, tmp_path):  # C1
    files = [dump(tmp_path / name, {"produtos": [listing(i, titulo=f"{name} {i} {k}", link=link) for i, k, link in rows]}) for name, rows in (
        ("z.json", [(1, 0, "z"), (1, 1, "a"), (2, 0, "z")]), ("a.json", [(1, 0, "b"), (3, 0, "z"), (3, 1, "a")]))]
    rows = raw.read_listing_sets(spark, {"x": files, "a": dump(tmp_path / "0.json", [listing(3, titulo="late", link="0"), listing(4, titulo="only")])})
    none = spark.createDataFrame([], "id long, nickname string, transactions long")
    reviews = spark.createDataFrame([], "product_id string, review_no int, text string")
    found = flow.features(flow.Inputs(rows, none, reviews)).select("listing_id", "title").collect()
    assert {r.listing_id: r.title for r in found} == {"MLB1": "z.json 1 0", "MLB2": "z.json 2 0", "MLB3": "a.json 3 0", "MLB4": "only"}
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "l.json").write_text("\n".join(json.dumps({"dados_vendedores": [{"id": 5, "nickname": f"n{i}"}]}) for i in range(30)), encoding="utf-8")
    assert [r.nickname for r in raw.read_sellers(spark, str(lines), lines=True).collect()] == ["n0"]


def test_folder_pairs(spark, tmp_path):  # A4, D3, C8
    dump(tmp_path / "lot1.json", {"produtos": [listing(1), listing(2), {"titulo": "no id"}]})
    dump(tmp_path / "lot1_reviews.json", {"reviews": [{"produto_id": "MLB1", "review_number": 2, "text": "b"}, {"produto_id": "MLB1", "review_number": 1, "text": "a"}]})
    dump(tmp_path / "lot2.json", {"produtos": [listing(9)]})
    dump(tmp_path / "consolidado_x.json", {"produtos": [listing(8)]})
    files = raw.batch_files(spark, str(tmp_path))
    paired, alone = raw.file_pairs(files)
    assert [r.base for r in paired.collect()] == ["lot1"] and [tuple(r) for r in alone.collect()] == [("lot2", "products")]
    listings, reviews = raw.paired_listings(spark, files)
    nested = enrich.nested_reviews(listings, reviews, "id", "produto_id", ["review_number", "text"])
    assert {r.id: [x.text for x in r.all_reviews] for r in nested.collect()} == {"MLB1": ["a", "b"], "MLB2": []}
    assert store.export_summary(nested).first().asDict() == {"products": 2, "with_reviews": 1, "without_reviews": 1, "reviews": 2}
    beside = enrich.listing_reviews(listings, reviews, "id", "produto_id", ["review_number", "text"])
    assert beside.where("id = 'MLB1'").count() == 2 and beside.count() == 3
    assert store.export_summary(enrich.review_totals(listings, reviews, "id", "produto_id")).first() == store.export_summary(nested).first()
    store.write_json(nested, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "records")).count() == 2


def test_newest_file(spark, tmp_path):  # A6
    for n in (1, 2):
        dump(tmp_path / f"{n}.json", [listing(n)])
        time.sleep(1.1)
    assert [r.id for r in raw.newest_files(raw._json(spark, str(tmp_path), raw.schemas.LISTING_FILE)).collect()] == ["MLB2"]


def test_price_file(spark, tmp_path):  # A7
    (tmp_path / "p.csv").write_text("Produto;Familia;Preco Sugerido\nPreto;HP 664;49,90\nPreto XL;HP 664;abc\n", encoding="utf-8")
    assert [tuple(r)[:3] for r in raw.read_prices(spark, str(tmp_path / "p.csv")).collect()] == [("Preto", "HP 664", 49.9)]
    assert raw.read_prices(spark, str(tmp_path / "absent.csv")) is None


def test_essential_columns(spark, tmp_path):  # B1 to B6, T3, T20
    path = dump(tmp_path / "a.json", [listing(1, vendedor_nome=""), {"id": "MLB2", "seller_id": "x"}])
    one, two = essential.essential(raw.read_listings(spark, path)).orderBy("listing_id").collect()
    assert (one.seller_name, one.rating, one.n_reviews, one.alt_sellers, one.ship_origin) == ("Vendedor_1", 4.0, 10, ["2"], "SP")
    assert (one.official_store_id, one.power_status, one.catalog_id) == (None, None, "C1")
    assert (two.seller_name, two.seller_id, two.n_reviews, two.alt_sellers, two.ship_origin, two.transactions) == ("Vendedor_x", None, 0, [], None, 0)
    kept, missing = essential.keep_existing(spark.createDataFrame([(1,)], "price int"))
    assert kept.columns == ["price"] and len(missing) == 33


def test_csv_export(spark, table, tmp_path):  # A8
    df = table("b string, a array<int>", ("x\n\ty  z", [1, 2]), ("w" * 1200, None))
    first, second = store.csv_safe(df).collect()
    assert first.asDict() == {"a": "[1,2]", "b": "x y z"} and second.b == "w" * 1200
    store.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["a", "b"]


def test_snapshots(spark, table, tmp_path):  # A16
    s = store.Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        s.read()
    s.write(table("a int", (1,)))
    s.write(table("a int", (2,)))
    assert s.read().first().a == 2 and s.read(s.names()[0]).first().a == 1


def test_store_upsert(spark, table, tmp_path):  # A11, A12, D12, T18
    schema = "listing_id long, price double, ingested_at int"
    s = store.ListingStore(spark, str(tmp_path / "t"))
    s.upsert(table(schema, (1, 1.0, 1), (2, 2.0, 1), (2, 2.5, 2)), "a")
    s.compact()
    new = table(schema + ", extra string", (2, 9.0, 3, "e"), (3, 3.0, 3, None))
    for _ in range(2):  # the same batch twice changes nothing
        s.upsert(new, "b")
    assert sorted((r.listing_id, r.price, r.extra) for r in s.read().collect()) == [(1, 1.0, None), (2, 9.0, "e"), (3, 3.0, None)]
    assert s.get(3).first().price == 3.0 and s.get(77).count() == 0
    s.compact()
    assert s.read().count() == 3 and s._generation() == 2


def test_report_table_keeps_unknown_use(table):  # T17, A10, C4
    df = table("listing_id long, seller_id string, used int, score double, n int", (1, "1", 1, 1.0, 1), (2, "1", None, 1.0, 1), (2, "1", 0, 5.0, 2), (3, None, 0, 1.0, 1))
    assert [(r.listing_id, r.seller_id, r.used, r.risk) for r in reports.report_table(df, ["n"]).collect()] == [(2, 1, None, "low")]


def test_null_groups_and_nulls_last(table):  # T23, T24, T25
    df = table("listing_id long, seller_id long, seller_name string, suspect int, score double, status string, transactions long",
               (1, 1, "a", 1, 5.0, None, None), (2, 1, "a", 0, 1.0, "gold", 7), (3, 2, "b", 1, 3.0, None, 1), (4, 3, None, 1, 1.0, "x", 1))
    sellers = reports.seller_metrics(df)
    rows = {r.seller_id: r for r in sellers.collect()}
    assert set(rows) == {1, 2} and (rows[1].status, rows[1].transactions, rows[1].suspect_rate) == ("gold", 7, 50.0)
    assert [r.status for r in reports.status_summary(sellers).collect()] == ["gold"]
    for ascending in (True, False):
        assert reports.top(df, "status", None, "listing_id", ascending).collect()[-1].status is None


def test_attribute_fan_out(table):  # T10
    listings = table("id long", (1,), (2,))
    attributes = table("id long, kind string, n int", (1, "a", 1), (1, "b", 2))
    rows = enrich.with_attributes(listings, attributes, "id", ["n"]).orderBy("id").collect()
    assert [(r.id, r.kind, r.matched) for r in rows] == [(1, "a", 1), (2, None, 0)]


def test_dense_index(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    rows = dedupe.dense_index(df, [F.desc("v")], "i").collect()
    assert all(r.i == 999 - r.v for r in rows)


ARRIVAL = "listing_id long, seller_id long, image_hash string, price_gap double, transactions long, ingested_at int"


def test_stream_equals_batch(spark, table, tmp_path):  # N1, W5
    arrivals = [table(ARRIVAL, (1, 1, "h", -0.5, 10, 1), (2, 2, "k", -0.2, 99, 1)), table(ARRIVAL, (1, 1, "h", 0.1, 10, 2), (3, 1, "h", None, 10, 2))]
    counts = table("image_hash string, image_reuse long", ("h", 11))
    score = upsert.scorer(counts)
    streamed = store.ListingStore(spark, str(tmp_path / "stream"))
    for part in arrivals:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert.start(spark, str(tmp_path / "in"), ARRIVAL, streamed, score, str(tmp_path / "cp")).awaitTermination()
    whole = store.ListingStore(spark, str(tmp_path / "batch"))
    whole.upsert(score(arrivals[0].unionByName(arrivals[1])), "all")
    pick = lambda s: sorted((r.listing_id, r.score, r.image_reuse) for r in s.read().collect())
    assert pick(streamed) == pick(whole) == [(1, 3.0, 12), (2, 1.0, 1), (3, 3.0, 12)]


def test_whole_run(spark, table, tmp_path):
    path = dump(tmp_path / "a.json", [listing(i, seller=1 + i % 3) for i in range(9)])
    inputs = flow.Inputs(
        raw.read_listings(spark, path),
        table("id long, nickname string, transactions long", (1, "one", 10), (2, "two", 500)),
        table("product_id string, review_no int, text string", ("MLB1", 1, "produto falso")),
        prices=table("price_key string, unit_price double", ("664_preto", 60.0)),
        images=table("listing_id string, file_name string, image_hash string", *[(f"MLB{i}", f"{i}.jpg", "same" if i < 4 else "ERRO") for i in range(9)]),
        vectors={"title": table("listing_id string, vec array<double>", ("MLB1", [1.0, 0.0]), ("MLB3", [1.0, 0.01]))})
    final = flow.run(spark, inputs, str(tmp_path / "out"))
    rows = {r.listing_id: r for r in final.collect()}
    assert len(rows) == 9 and rows["MLB0"].seller_name == "one" and rows["MLB2"].seller_name == "Vendedor_3"
    assert rows["MLB1"].price_gap == -0.5 and rows["MLB1"].fraud_hits == 1 and rows["MLB2"].fraud_hits == 0
    # price 10, reputation 2, negative reviews 2, four images alike 1
    assert rows["MLB1"].score == 15.0 and rows["MLB0"].score == 16.0 and rows["MLB5"].image_reuse == 0
    assert all(r.degree == 2 and r.community == 0 for r in rows.values())
    assert rows["MLB1"].cartridge_type == "664" and "id_anuncio" in original_names(final).columns
