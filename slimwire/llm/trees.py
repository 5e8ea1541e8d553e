"""Gradient-boosted trees over dense features (Spark ML), with optional isotonic calibration."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Boosted:
    """A model learned from rows of (x array<double>, label 0 or 1); ``constant`` where only one label was seen."""

    def __init__(self, train: DataFrame, rounds: int = 20, depth: int = 3, step: float = 0.3, seed: int = 7):
        share = train.agg(F.avg("label"), F.count("label")).first()
        self.constant = float(share[0]) if share[0] is not None else None
        self.seen = int(share[1])
        self.model = self.curve = None
        if self.constant is not None and 0 < self.constant < 1:
            gbt = GBTClassifier(featuresCol="v", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, maxBins=64, minInstancesPerNode=2)
            rows = train.select(array_to_vector("x").alias("v"), F.col("label").cast("double").alias("label"))
            self.model = gbt.fit(rows)

    def calibrate(self, rows: DataFrame) -> None:
        """Fit the isotonic curve from the model's probability to the share of label 1, on rows of its own."""
        if self.model is None:
            return
        scored = self.score(rows, "p").select(F.col("p").alias("features"), F.col("label").cast("double").alias("label"))
        share = scored.agg(F.avg("label")).first()[0]
        if share is not None and 0 < share < 1:
            self.curve = IsotonicRegression(featuresCol="features", labelCol="label", predictionCol="calibrated").fit(scored)

    def score(self, rows: DataFrame, name: str, otherwise: float = 0.0) -> DataFrame:
        """``rows`` with a column ``name``: the probability of label 1 (``otherwise`` where nothing was learned)."""
        if self.model is None:
            return rows.withColumn(name, F.lit(otherwise if self.constant is None else self.constant))
        got = self.model.transform(rows.withColumn("v", array_to_vector("x"))).withColumn(name, vector_to_array("probability")[1])
        got = got.drop("v", "rawPrediction", "probability", "prediction")
        if self.curve is not None:
            got = self._blend(self.curve.transform(got.withColumn("features", F.col(name))), name).drop("features", "calibrated")
        return got

    def _blend(self, rows: DataFrame, name: str) -> DataFrame:
        # an isotonic curve is flat in steps; a hundredth of the raw score keeps the order within a step
        value: Column = 0.99 * F.col("calibrated") + 0.01 * F.col(name)
        return rows.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))
