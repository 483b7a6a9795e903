"""Classification and regression by trees, with grids and cross-validation; models saved and read again."""

from __future__ import annotations

from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import FeatureHasher, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import BROADCAST_BYTES, cut
from ..streaming.hashtags import shared_path
from .treegrid import grown_forest, search, shared

#: Dimension of the hashed features.
HASH_DIM = 32768
#: Rows of a partition of the training data at least, where there are so many.
FIT_ROWS = 20_000
#: The same of a forest of regression trees, whose counters outweigh so many rows in every partition, and the rows that such forests hold side by side at most (they keep a bag of each).
FOREST_ROWS, SIDE_ROWS = 200_000, 2_000_000
#: The full grids: parameter name -> values.
TREE_GRID = {"impurity": ["gini", "entropy"], "maxBins": [50, 100, 300], "maxDepth": [10, 20, 30]}
FOREST_GRID = {"numTrees": [5, 10, 20], **TREE_GRID}
REGRESSION_GRID = {"maxBins": [100, 200], "maxDepth": [5, 10]}
#: Column of the number of equal rows that a distinct row stands for.
REPEATS = "_repeats"


def hashed_features(data: DataFrame, features: list[str], label: str, dim: int = HASH_DIM) -> PipelineModel:
    """Feature hashing and label indexing, both fitted on all of ``data``; then the hashed columns in which no row holds anything are left out.

    Such a column can never split a node. Forests draw their random subsets from the columns that are left.
    """
    first = Pipeline(stages=[
        FeatureHasher(inputCols=features, outputCol="hashed", numFeatures=dim), StringIndexer(inputCol=label, outputCol="indexed_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
    ]).fit(data)
    held = first.transform(data).select(Summarizer.metrics("numNonZeros").summary(F.col("hashed")).alias("s")).first()["s"]["numNonZeros"]
    used = [i for i, n in enumerate(held.toArray()) if n] or [0]  # at most dim of them
    return PipelineModel([*first.stages, VectorSlicer(inputCol="hashed", outputCol="features", indices=used)])


def cross_validate(estimator, grid: dict, evaluator, data: DataFrame, folds: int = 5, seed: int = 11, parallelism: int = 8):
    """The fitted CrossValidatorModel of a tree estimator over all combinations of the grid; ``data`` holds the features' vectors already.

    An estimator with a weight column (the number of equal rows, of a binary classifier judged by its area under ROC) gets ``search``: the same combinations, folds and choice with
    fewer trees. Otherwise fits run side by side, and each passes over the data once for every level of its trees: small data are kept in few partitions, as such a pass costs
    more to start than to run. Of regression forests only the deepest of each combination is grown; the others are cut from it.
    """
    if "weightCol" in {p.name for p in estimator.params} and estimator.isSet("weightCol"):
        return _search_weighted(estimator, grid, data, folds, seed)
    cuts_depths = isinstance(estimator, RandomForestRegressor) and len(grid.get("maxDepth", [])) > 1
    data = whole = cut(data)
    n = data.count()
    few = max(1, -(-n // (FOREST_ROWS if cuts_depths else FIT_ROWS)))
    data = cut(data.coalesce(few)) if few < data.rdd.getNumPartitions() else data
    if cuts_depths:
        return _search_depths(estimator, grid, evaluator, data, whole, folds, seed, min(parallelism, folds, max(1, SIDE_ROWS // max(n, 1))))
    g = ParamGridBuilder()
    for name, values in grid.items():
        g = g.addGrid(estimator.getParam(name), values)
    return CrossValidator(estimator=estimator, estimatorParamMaps=g.build(), evaluator=evaluator, numFolds=folds, seed=seed, parallelism=parallelism).fit(data)


def _search_weighted(estimator, grid: dict, data: DataFrame, folds: int, seed: int) -> CrossValidatorModel:
    forest = isinstance(estimator, RandomForestClassifier)
    label, weight = estimator.getLabelCol(), estimator.getWeightCol()
    t = data.select(vector_to_array(estimator.getFeaturesCol()).alias("x"), F.col(label).cast("bigint").alias("y"), F.col(weight).cast("bigint").alias("n")).toArrow().combine_chunks()
    y, n = t["y"].to_numpy(), t["n"].to_numpy()
    x = t["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    order = np.lexsort([y, *x.T])  # the draws don't hang on the order in which rows arrive
    x, y, n = x[order], y[order], n[order]
    full = {k: grid.get(k, [estimator.getOrDefault(k) if k != "numTrees" or forest else 1]) for k in ("impurity", "maxBins", "maxDepth", "numTrees")}
    areas = search(data.sparkSession, x, y, n, full, forest, folds, seed)
    combinations = [dict(zip(grid, v)) for v in product(*grid.values())]  # in the order of ParamGridBuilder
    mean = [areas[tuple(c.get(k, full[k][0]) for k in full)] for c in combinations]
    chosen = estimator.copy({estimator.getParam(k): v for k, v in combinations[int(np.argmax(mean))].items()})
    if not forest:
        return CrossValidatorModel(chosen.fit(cut(data.repartition(max(1, len(y) // (10 * FIT_ROWS))))), mean)
    # Spark's own forest would draw distinct rows instead of their repeats: its model takes the nodes of trees grown on right bags
    trees, depth, path = chosen.getNumTrees(), chosen.getMaxDepth(), shared_path(data.sparkSession, "forest")
    chosen.copy({chosen.maxDepth: 0}).fit(data).write().save(path)
    subset = shared(full, 0, x.shape[1], forest)[(chosen.getImpurity(), chosen.getMaxBins(), depth, trees)][2]
    grown_forest(data.sparkSession, x, y, n, chosen.getImpurity(), chosen.getMaxBins(), depth, trees, subset, seed).write.mode("overwrite").parquet(f"{path}/data")
    about = cut(data.sparkSession.read.parquet(f"{path}/treesMetadata"))
    about.withColumn("_2", F.replace("_2", F.lit('"maxDepth":0'), F.lit(f'"maxDepth":{depth}'))).write.mode("overwrite").parquet(f"{path}/treesMetadata")
    model = RandomForestClassificationModel.load(path)
    return CrossValidatorModel(chosen._copyValues(model), mean)


def _search_depths(estimator, grid: dict, evaluator, data: DataFrame, whole: DataFrame, folds: int, seed: int, parallelism: int) -> CrossValidatorModel:
    """CrossValidator's folds, means and choice; levels are grown from the top with draws that don't depend on the depth, so a lower forest is the top of the deepest.

    The best is fitted alone, on ``whole``: the same rows in as many partitions as they came in.
    """
    dealt = CrossValidator(estimator=estimator, evaluator=evaluator, numFolds=folds, seed=seed)._kFold(data)
    depths = sorted(set(grid["maxDepth"]), reverse=True)
    combinations = [dict(zip(grid, v)) for v in product(*grid.values())]  # in the order of ParamGridBuilder
    params = lambda c: {estimator.getParam(k): v for k, v in c.items()}
    others = lambda c: tuple(v for k, v in c.items() if k != "maxDepth")
    deepest = list({others(c): {**c, "maxDepth": depths[0]} for c in combinations}.values())

    @inheritable_thread_target(data.sparkSession)
    def judge(task: tuple) -> dict:
        fold, c = task
        train, test = dealt[fold]
        model = estimator.copy(params(c)).fit(train)
        return {(others(c), d, fold): evaluator.evaluate((model if d == depths[0] else cut_trees(model, d)).transform(test)) for d in depths}

    found: dict = {}
    with ThreadPool(parallelism) as pool:
        for r in pool.imap_unordered(judge, list(product(range(folds), deepest))):
            found |= r
    mean = [float(np.mean([found[(others(c), c["maxDepth"], f)] for f in range(folds)])) for c in combinations]
    best = combinations[int(np.argmax(mean) if evaluator.isLargerBetter() else np.argmin(mean))]
    return CrossValidatorModel(estimator.copy(params(best)).fit(whole), mean)


def cut_trees(model, depth: int):
    """The same forest ended at ``depth``: a node there is a leaf with its own prediction."""
    spark = SparkSession.active()
    path = shared_path(spark, "forest")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    flat = saved.select("treeID", *[f"nodeData.{c}" for c in saved.schema["nodeData"].dataType.names])

    def top(rows: pa.Table) -> pa.Table:
        nodes = sorted(rows.to_pylist(), key=lambda n: n["id"])  # parents before their children
        level, kept = {0: 0}, []
        for n in nodes:
            at = level.get(n["id"])
            if at is None:
                continue
            if at == depth:
                n |= {"gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
            elif n["leftChild"] >= 0:
                level[n["leftChild"]] = level[n["rightChild"]] = at + 1
            kept.append(n)
        number = {-1: -1, **{n["id"]: i for i, n in enumerate(kept)}}
        return pa.Table.from_pylist([n | {k: number[n[k]] for k in ("id", "leftChild", "rightChild")} for n in kept], schema=rows.schema)

    ended = cut(flat.groupBy("treeID").applyInArrow(top, flat.schema))
    ended.select("treeID", F.struct(*flat.columns[1:]).alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return type(model).load(path)


def _distinct(data: DataFrame, columns: list[str]) -> DataFrame:
    return cut(data.groupBy(*columns).agg(F.count("*").alias(REPEATS)))


def classify(data: DataFrame, features: list[str], label: str, kind: str = "tree", grid: dict | None = None, folds: int = 5, dim: int = HASH_DIM, seed: int = 11):
    """(model, predictions on the held-out tenth, accuracy, area under ROC). Rows without a label are left out; null features are hashed as nothing.

    ``model`` is a PipelineModel of the feature stages and the best tree or forest. Rows are split and dealt to folds one by one, but equal rows are hashed and trained on as one with its
    number as weight; where the label isn't binary or the distinct rows exceed the size of a broadcast, the trees are cross-validated row by row.
    """
    Estimator, full = (DecisionTreeClassifier, TREE_GRID) if kind == "tree" else (RandomForestClassifier, FOREST_GRID)
    train, test = data.where(F.col(label).isNotNull()).randomSplit([0.9, 0.1], seed)
    known, judged = (_distinct(d, [*features, label]) for d in (train, test))
    prepare = hashed_features(known.unionByName(judged), features, label, dim)
    estimator = Estimator(seed=seed, featuresCol="features", labelCol="indexed_label")
    grid = grid or full
    width = len(prepare.stages[-1].getIndices()) + folds + max(grid.get("numTrees", [20]))
    weighted = len(prepare.stages[1].labels) == 2 and set(grid) <= set(FOREST_GRID) and known.count() * width * 8 <= BROADCAST_BYTES
    if weighted:
        estimator.setWeightCol(REPEATS)
    rows = prepare.transform(known if weighted else train).select("features", "indexed_label", *([REPEATS] if weighted else []))
    best = cross_validate(estimator, grid, BinaryClassificationEvaluator(labelCol="indexed_label"), rows, folds, seed).bestModel
    scored = best.transform(prepare.transform(judged))
    accuracy = MulticlassClassificationEvaluator(labelCol="indexed_label", metricName="accuracy", weightCol=REPEATS).evaluate(scored)
    area = BinaryClassificationEvaluator(labelCol="indexed_label", weightCol=REPEATS).evaluate(scored)
    return PipelineModel([*prepare.stages, best]), best.transform(prepare.transform(test).drop("hashed")), accuracy, area


def fit_regression(train: DataFrame, features: list[str], label: str, grid: dict | None = None, folds: int = 5, seed: int = 11) -> PipelineModel:
    """The best random forest over assembled columns; a null or NaN feature is an error."""
    assemble = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    ev = RegressionEvaluator(labelCol=label, metricName="rmse")
    estimator = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed)
    return PipelineModel([assemble, cross_validate(estimator, grid or REGRESSION_GRID, ev, assemble.transform(train).select("features", label), folds, seed).bestModel])


def regress(train: DataFrame, test: DataFrame, features: list[str], label: str, grid: dict | None = None, folds: int = 5, seed: int = 11):
    """(model, predictions on ``test``, rmse) of a random forest over assembled columns; a null or NaN feature is an error."""
    model = fit_regression(train, features, label, grid, folds, seed)
    p = model.transform(test)
    return model, p, RegressionEvaluator(labelCol=label, metricName="rmse").evaluate(p)


def save_model(model: PipelineModel, path: str) -> None:
    """Writes the whole pipeline, over an older one in the same place."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
