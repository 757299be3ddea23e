"""The stream with state against a batch over all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listingscope.operators.rules import score
from listingscope.streaming import reuse

SCHEMA = "listing_id long, event_time timestamp, image_hash string, price_gap double, transactions long, arrival string"
START = datetime(2025, 8, 1)


def arrivals(seed, n=160):
    r = random.Random(seed)
    out = []
    for i in range(n):
        image = r.choice(["a", "b", "hot", "hot", "hot", "ERRO", None, f"own{i}"])
        out.append((r.choice([1, 1, 1, *range(2, 40)]), START + timedelta(minutes=r.randrange(50)), image, r.choice([-0.5, -0.2, None, 0.1]), 10, f"e{i}"))
    return out


def run(spark, folder, parts, **options):
    for part in parts:
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        reuse.start(spark, arriving, f"{folder}/out", score, f"{folder}/check", **options).awaitTermination()
    return reuse.scored_table(spark, f"{folder}/out").read()


def rows(df):
    return sorted(map(str, df.select("listing_id", "event_time", "image_hash", "image_reuse", "score").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_three_batches_are_one(spark, tmp_path, seed):
    data = arrivals(seed)
    parts = [data[:60], data[60:61], data[61:]]
    got = run(spark, tmp_path, parts)
    want = reuse.at_once(spark.createDataFrame(data, SCHEMA), score)
    assert rows(got) == rows(want)


def test_images_within_a_batch_and_moved_images(spark, tmp_path):
    t = [START + timedelta(minutes=i) for i in range(5)]
    parts = [
        [(1, t[0], "x", None, 1, "a"), (2, t[0], "x", None, 1, "b"), (3, t[0], "y", None, 1, "c"), (None, t[0], "x", None, 1, "d"), (9, None, "x", None, 1, "z")],
        [(2, t[1], "y", None, 1, "e"), (2, t[1], "y", None, 1, "e"), (1, t[0], "x", None, 1, "a")],
        [(3, t[0], "x", None, 1, "late but older")],
    ]
    got = run(spark, tmp_path, parts)
    assert sorted((r.listing_id, r.image_hash, r.image_reuse) for r in got.collect()) == [(1, "x", 1), (2, "y", 2), (3, "y", 2)]
    assert {r.image_hash: r.image_reuse for r in reuse.ImageCounts(spark, f"{tmp_path}/out/counts").read().collect()} == {"x": 1, "y": 2}


def test_arrivals_sent_again_are_dropped(spark, tmp_path):
    data = arrivals(3, 80)
    got = run(spark, tmp_path, [data[:50], data[20:60], data[40:] + data[:5]], event="arrival", delay="2 hours")
    assert rows(got) == rows(reuse.at_once(spark.createDataFrame(data, SCHEMA), score))


def test_counts_fold_and_repeated_batches(spark, tmp_path):
    counts = reuse.ImageCounts(spark, str(tmp_path / "c"), fold=3)
    moves = [("a", None), ("b", None), ("a", None), ("c", "a"), ("b", "c"), ("a", "b"), (None, "a"), ("ERRO", None)]
    for i, move in enumerate(moves):
        for _ in range(1 + i % 2):
            counts.add(spark.createDataFrame([move], "image_hash string, previous_image string"), i)
    assert {r.image_hash: r.image_reuse for r in counts.read().collect()} == {"a": 1, "b": 1}
    assert len(counts._done("base")) == 2 and counts.read(1).count() == 2
    assert reuse.ImageCounts(spark, str(tmp_path / "none")).read().count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_newest_rows_fold_and_a_batch_run_again_sees_the_same_rows(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    state = reuse.Newest(spark, str(tmp_path / "n"), schema, fold=2)
    moves = [[(1, 0, "a"), (2, 0, "a")], [(1, 1, "b"), (1, 0, "z")], [(1, 1, "a"), (2, 2, None)], [(1, 2, "c")]]
    want = [{(1, "a", None), (2, "a", None)}, {(1, "b", "a")}, {(2, None, "a")}, {(1, "c", "b")}]
    for i, move in enumerate(moves):
        for _ in range(2):
            batch = spark.createDataFrame([(k, START + timedelta(minutes=t), image, None, 1, "") for k, t, image in move], schema)
            assert {(r.listing_id, r.image_hash, r.previous_image) for r in state.add(batch, i).collect()} == want[i]
    assert {(r.listing_id, r.image_hash) for r in state.read().collect()} == {(1, "c"), (2, None)}
    assert len(reuse._done(spark, str(tmp_path / "n"), "base")) == 2
