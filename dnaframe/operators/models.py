"""Baseline regressors with Spark ML (D1-D4) and the predictions table they produce."""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnaframe.session import ensure_checkpoint_dir, has_checkpoint_dir

# The runnable model names.
MODEL_NAMES = ("linear_regression", "random_forest", "gradient_boosting")
#: Nodes of a forest that the driver holds at a time; a node takes some 500 bytes while it grows.
DRIVER_NODES = 1 << 20
# Seeds of two groups of trees lie further apart than a table has parts: Spark adds a part's number to the seed.
_SEED_STEP = 1_000_003


def make_estimator(name: str, seed: int, features: str = "features", label: str = "y", **overrides):
    """D1-D3 with the reference library's defaults mapped to Spark ML.

    * linear_regression: ordinary least squares (no penalty).
    * random_forest: 100 trees, every feature at every split; the reference grows trees without
      a depth limit, Spark allows at most 30 (``maxDepth`` can be lowered for wide features, H5).
      With ``cacheNodeIds`` every row keeps its node of every tree, in place of being led down from the
      root in every pass over the rows; the trees are the same. Needs a checkpoint folder (``fit_and_predict``).
    * gradient_boosting: 100 rounds of depth-3 trees, step 0.1.
    """
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    if name == "linear_regression":
        params = dict(regParam=0.0, elasticNetParam=0.0, maxIter=100)
        params.update(overrides)
        return LinearRegression(featuresCol=features, labelCol=label, predictionCol="prediction", **params)
    if name == "random_forest":
        params = dict(numTrees=100, featureSubsetStrategy="all", maxDepth=30, seed=seed, maxBins=32,
                      subsamplingRate=1.0, bootstrap=True)
        params.update(overrides)
        return RandomForestRegressor(featuresCol=features, labelCol=label, predictionCol="prediction", **params)
    if name == "gradient_boosting":
        params = dict(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed)
        params.update(overrides)
        return GBTRegressor(featuresCol=features, labelCol=label, predictionCol="prediction", **params)
    raise ValueError(f"no estimator for {name!r}; known are {list(MODEL_NAMES)}")


class StoredForest:
    """A forest in groups of trees, each a Spark model in a folder of its own; its prediction is the mean over all trees.

    The driver holds one group at a time, whatever the forest's size: when it grows, predicts and is saved.
    """

    def __init__(self, groups: list[tuple[str, int]]):
        self.groups = groups  # folder, number of trees

    @property
    def trees(self) -> int:
        return sum(n for _, n in self.groups)

    def models(self):
        from pyspark.ml.regression import RandomForestRegressionModel

        for path, _ in self.groups:
            yield RandomForestRegressionModel.load(path)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``. Its rows and every group's share are stored first, so no plan holds a model."""
        spark = df.sparkSession
        folder = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
        # a place of its own keeps rows with equal keys apart
        df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        for i, (model, (_, trees)) in enumerate(zip(self.models(), self.groups)):
            share = model.transform(rows.select("_at", model.getFeaturesCol())).select("_at", (F.col("prediction") * trees).alias("share"))
            share.write.parquet(f"{folder}/shares/part={i}")
        shares = F.array_sort(F.collect_list(F.struct("part", "share")))  # added up in one order: the same sum in every run
        total = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x["share"])
        found = spark.read.parquet(f"{folder}/shares").groupBy("_at").agg((total / self.trees).alias("prediction"))
        return rows.join(found, "_at").drop("_at")

    def write(self) -> "StoredForest":
        return self

    def overwrite(self) -> "StoredForest":
        return self

    def save(self, path: str) -> None:
        """Every group below ``path``, in the form of Spark's own models."""
        for i, model in enumerate(self.models()):
            model.write().overwrite().save(f"{path}/group={i}")


def fit_forest(train: DataFrame, seed: int, label: str = "y", **options):
    """A Spark model where its trees can't have more than ``DRIVER_NODES`` nodes; else a ``StoredForest``.

    Trees without a depth limit have nodes in proportion to the rows, and Spark grows all trees of a fit in the
    driver's memory. So trees are grown in groups; the first is sized by the most nodes that so many rows can
    give, later ones by what the trees before them had. One tree is the least. A group has a seed of its own.
    """
    whole = make_estimator("random_forest", seed, label=label, **options)
    trees = whole.getNumTrees()
    most = min(2 ** (whole.getMaxDepth() + 1), 2 * max(1, train.count()))
    if trees * most <= DRIVER_NODES:
        return whole.fit(train)
    folder = f"{ensure_checkpoint_dir(train.sparkSession)}/trees-{uuid.uuid4().hex}"
    groups, done, seen = [], 0, 0
    while done < trees:
        n = min(trees - done, max(1, DRIVER_NODES // (seen or most)))
        model = make_estimator("random_forest", seed + _SEED_STEP * done, label=label, **options | {"numTrees": n}).fit(train)
        groups.append((f"{folder}/{len(groups)}", n))
        model.write().save(groups[-1][0])
        seen, done = max(seen, -(-model.totalNumNodes // n)), done + n
    return StoredForest(groups)


def fit_and_predict(train: DataFrame, test: DataFrame, models: list[str], seed: int,
                    row_id: str = "row_id", label: str = "y", overrides: dict | None = None):
    """Fit each model on ``train`` and predict ``test``.

    Returns ``(fitted: dict name -> model, predictions: DataFrame(model, row_id, actual, prediction))``.
    The caller persists the feature frame once; each fit reads it. A large forest is a ``StoredForest``, where
    there is a checkpoint folder. The models are fitted side by side:
    the many short jobs of one leave executors idle.
    """
    from dnaframe.operators.metrics import union_predictions

    keeps_nodes = has_checkpoint_dir(train.sparkSession)

    def fit(name: str):
        options = dict((overrides or {}).get(name, {}))
        if name == "random_forest" and keeps_nodes:
            options.setdefault("cacheNodeIds", True)
            return fit_forest(train, seed, label, **options)
        return make_estimator(name, seed, label=label, **options).fit(train)

    with ThreadPool(max(1, len(models))) as pool:
        fitted = dict(zip(models, pool.map(inheritable_thread_target(train.sparkSession)(fit), models)))
    frames = []
    for name, m in fitted.items():
        p = m.transform(test).select(F.lit(name).alias("model"), row_id, F.col(label).alias("actual"),
                                     F.col("prediction").cast("double").alias("prediction"))
        frames.append(p)
    return fitted, union_predictions(frames)
