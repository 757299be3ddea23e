"""The ridge classifier: encode, standardise, fit, score, explain, store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listingscope.functions.columns import count_where
from listingscope.operators.dedupe import dense_index
from listingscope.operators.rules import effect_label
from listingscope.session import cut

UNKNOWN = "unknown"


def encoder(df: DataFrame, column: str) -> DataFrame:
    """(value, code): classes in text order from 0; missing is the text "nan"."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).distinct()
    return dense_index(values, [F.asc("value")], "code").select("value", F.col("code").cast("bigint").alias("code"))


def encode(df: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """Replace a text column by its code.

    A value never seen gets the code of "unknown" when that is a class, else the
    first free code.
    """
    spare = classes.agg(F.coalesce(F.max(F.when(F.col("value") == UNKNOWN, F.col("code"))), F.count(F.lit(1))).alias("c"))
    known = classes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    joined = df.join(known, text == F.col("_v"), "left").withColumn("_s", spare.scalar())
    return joined.withColumn(column, F.coalesce("_c", "_s").cast("double")).drop("_v", "_c", "_s")


@dataclass(frozen=True)
class RidgeModel:
    features: list[str]
    weights: list[float]
    intercept: float
    means: list[float]
    scales: list[float]
    encoders: dict[str, DataFrame] = field(default_factory=dict)

    def prepared(self, df: DataFrame) -> DataFrame:
        for name, classes in self.encoders.items():
            df = encode(df, name, classes)
        return df

    def decision(self) -> Column:
        z = F.lit(self.intercept)
        for name, w, mean, scale in zip(self.features, self.weights, self.means, self.scales):
            z = z + F.lit(w) * _standard(F.col(name), mean, scale)
        return z

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``model_score`` = sigmoid(decision) and ``predicted`` (> 0.5)."""
        kept = df.columns
        coded = df
        if self.encoders:  # encoded copies, so the caller's text columns survive
            coded = df.withColumns({f"_raw_{c}": F.col(c) for c in self.encoders})
            coded = self.prepared(coded)
        scored = coded.withColumn("model_score", sigmoid(self.decision()))
        back = [F.col(f"_raw_{c}").alias(c) if c in self.encoders else F.col(c) for c in kept if c not in ("model_score", "predicted")]
        return scored.select(*back, "model_score", (F.col("model_score") > 0.5).cast("int").alias("predicted"))

    def importance(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(w), abs(float(w))) for n, w in zip(self.features, self.weights)]
        table = spark.createDataFrame(rows, "feature string, coefficient double, magnitude double")
        return table.withColumn("effect", effect_label(F.col("coefficient"))).orderBy(F.desc("magnitude"), "feature")

    def save(self, spark: SparkSession, path: str, metadata: DataFrame | None = None) -> None:
        """Coefficients, encoders and metadata as tables under ``path``."""
        rows = [(i, *r) for i, r in enumerate(zip(self.features, self.weights, self.means, self.scales))]
        table = spark.createDataFrame(rows, "place int, feature string, weight double, mean double, scale double")
        table.withColumn("intercept", F.lit(self.intercept)).write.mode("errorifexists").parquet(f"{path}/coefficients")
        stacked = None
        for name, classes in self.encoders.items():
            part = classes.withColumn("feature", F.lit(name))
            stacked = part if stacked is None else stacked.unionByName(part)
        if stacked is not None:
            stacked.write.partitionBy("feature").parquet(f"{path}/encoders")
        if metadata is not None:
            stamped = metadata.withColumn("trained_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
            stamped.write.json(f"{path}/metadata")


def load(spark: SparkSession, path: str, encoded: Sequence[str] = ()) -> RidgeModel:
    rows = spark.read.parquet(f"{path}/coefficients").orderBy("place").collect()  # one row per feature
    encoders = {}
    for name in encoded:
        encoders[name] = spark.read.parquet(f"{path}/encoders").where(F.col("feature") == name).select("value", "code")
    return RidgeModel([r.feature for r in rows], [r.weight for r in rows], rows[0].intercept,
                      [r["mean"] for r in rows], [r.scale for r in rows], encoders)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def _standard(c: Column, mean: float, scale: float) -> Column:
    return (F.coalesce(c.cast("double"), F.lit(0.0)) - F.lit(mean)) / F.lit(scale)


def _deviation(c: Column) -> Column:
    return F.when(F.min(c) < F.max(c), F.stddev_pop(c)).otherwise(0.0)


def standard_stats(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations, missing values counted as 0.

    A constant column has deviation 0 by its ends: summed over parts, its
    deviation may come out a little above.
    """
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled.values())],
                 *[_deviation(v).alias(f"s{i}") for i, v in enumerate(filled.values())]).first()
    n = len(features)
    return [float(row[i]) for i in range(n)], [float(row[n + i]) for i in range(n)]


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each feature minus its mean over its population deviation; a constant one becomes 0."""
    stats = df.agg(F.struct(*[F.struct(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("m"),
                                       _deviation(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias("s")).alias(c) for c in features]).alias("z"))
    wide = df.withColumn("_z", stats.scalar())
    return wide.withColumns({
        c: F.when(F.col(f"_z.{c}.s") > 0, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_z.{c}.m")) / F.col(f"_z.{c}.s")).otherwise(0.0)
        for c in features}).drop("_z")


def fit(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0, text_features: Sequence[str] = ()) -> RidgeModel:
    """Minimise Σ(y − Xw − b)² + alpha·|w|² with y = ±1 on standardised features.

    The normal equations are summed on the executors in one pass; only a
    features-by-features matrix and the coefficients reach the driver.
    """
    encoders = {c: encoder(df, c) for c in text_features}
    names = [*features, *text_features]
    coded = df
    for c, classes in encoders.items():
        coded = encode(coded, c, classes)
    coded = cut(coded.select(*names, label))  # three passes follow
    means, scales = standard_stats(coded, names)
    # A constant column is all zero once standardised, so its weight is 0; left
    # in, it would make the direct solver give up.
    live = [i for i, s in enumerate(scales) if s > 0]
    x = coded.select(*[_standard(F.col(names[i]), means[i], scales[i]).alias(f"x{i}") for i in live],
                     F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y"))
    size, middle, spread = x.agg(F.count(F.lit(1)), F.avg("y"), F.stddev_pop("y")).first()
    weights, intercept = [0.0] * len(names), float(middle)
    if live and spread:
        assembled = VectorAssembler(inputCols=[f"x{i}" for i in live], outputCol="x").transform(x).select("x", "y")
        # The solver divides the label by its deviation, so the penalty is given on that scale.
        solver = LinearRegression(featuresCol="x", labelCol="y", solver="normal", standardization=False,
                                  elasticNetParam=0.0, regParam=alpha * spread / size)
        found = solver.fit(assembled)
        intercept = float(found.intercept)
        for i, w in zip(live, found.coefficients):
            weights[i] = float(w)
    return RidgeModel(names, weights, intercept, means, [s or 1.0 for s in scales], encoders)


# Columns never used for training, in our names.
NOT_FEATURES = (
    "listing_id", "seller_id", "catalog_id", "title", "link", "image_url", "description", "seller_name", "power_status",
    "reputation_level", "star_counts", "alt_sellers", "score", "used", "suspect",
    "price", "suggested_price", "price_gap", "flag_price_very_low", "flag_price_medium_low", "flag_price_slightly_low",
)
# Columns computed from the label or the rules behind it.
LEAKS = ("suspects", "suspect_rate", "neighbour_suspects", "neighbour_rate", "community_suspects", "community_rate", "flag_instant_fraud")


def feature_names(df: DataFrame, features: str = "as_coded") -> tuple[list[str], list[str]]:
    """(numeric, text) training columns; ``no_leak`` also drops rule flags and suspect counts."""
    if features not in ("as_coded", "no_leak"):
        raise ValueError(f"unknown feature set {features!r}")
    out: tuple[list[str], list[str]] = ([], [])
    for f in df.schema.fields:
        leak = features == "no_leak" and (f.name in LEAKS or f.name.startswith("flag_"))
        if f.name in NOT_FEATURES or leak:
            continue
        kind = f.dataType.typeName()
        if kind in ("string", "boolean"):
            out[1].append(f.name)
        elif kind in ("integer", "long", "double", "float", "short", "byte"):
            out[0].append(f.name)
    return out


def training_metadata(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    graph = sum(1 for f in features if f in ("degree", "neighbours", "pagerank", "betweenness", "closeness") or f.startswith(("community", "neighbour_")))
    return df.agg(
        F.count(F.lit(1)).alias("samples"), count_where(F.col(label) == 1).alias("suspects"),
        count_where(F.col(label) == 0).alias("legitimate"), F.avg(label).alias("suspect_rate"),
    ).withColumn("features", F.lit(len(features))).withColumn("graph_features", F.lit(graph)).withColumn(
        "flag_features", F.lit(sum(1 for f in features if f.startswith("flag_"))))


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Repeatable (train, test) by a hash of the id."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(seed))), 1, 8), 16, 10).cast("bigint") % 10_000
    limit = int(test_share * 10_000)
    return df.where(place >= limit), df.where(place < limit)


def quality(df: DataFrame, label: str = "suspect", predicted: str = "predicted") -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.agg(count_where(y & p).alias("tp"), count_where(~y & p).alias("fp"),
                    count_where(y & ~p).alias("fn"), count_where(~y & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tp", "fp", "fn", "tn",
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
