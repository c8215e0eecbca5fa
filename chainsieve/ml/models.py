"""Fits of the probability heatmap, risk components, stacks and routers.

Boosted learners of all keys, components or folds are one job (``boosting``); a fitted
set of them is a table of trees. Linear models, meta models and routers are Spark ML
fits over features that are assembled and kept once per training set.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Mapping
from multiprocessing.pool import ThreadPool

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from chainsieve.ml import boosting, sharded
from chainsieve.ml.boosting import Booster
from chainsieve.session import cut_lineage

MODEL_WEIGHTS = {"booster": 0.4, "leafwise": 0.4}
MISSING = 0.05  # probability of a key without a model
ROUTER_BINS = 32  # of a feature, as many as Spark's forests have
AT_ONCE = 8  # fits that run at a time; a fit is a long row of short jobs, most of them waiting
RISK_COMPONENTS = ("rug_risk", "dev_risk", "distribution_risk", "social_risk", "liquidity_risk")
Key = tuple[str, str]


def assemble(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``features``; missing values count as 0, as in the feature maps."""
    filled = rows.fillna(0.0, subset=[c for c, t in rows.dtypes if c in names and t in ("double", "float", "bigint", "int")])
    return VectorAssembler(inputCols=names, outputCol="features").transform(filled)


def positive(model: Model) -> Column:
    return vector_to_array("probability")[1]


def score(model: Model, rows: DataFrame, name: str) -> DataFrame:
    """Adds the probability of the positive class as ``name`` and leaves no other column behind."""
    return model.transform(rows).withColumn(name, positive(model)).drop("rawPrediction", "probability", "prediction")


def fit_all(spark: SparkSession, fits: Mapping[object, Callable[[], Model]], at_once: int = AT_ONCE) -> dict:
    """Results of independent fits by name, several at a time."""
    with ThreadPool(max(1, min(at_once, len(fits)))) as pool:
        waiting = {k: pool.apply_async(inheritable_thread_target(spark)(fit)) for k, fit in fits.items()}
        return {k: w.get() for k, w in waiting.items()}


def learners(trees: int = 200, depth: int = 6, rate: float = 0.05, seed: int = 42) -> dict[str, Booster]:
    """Two boosted learners: trees grown level by level, and trees grown at the leaf that gains most."""
    return {
        "booster": Booster(trees=trees, depth=depth, rate=rate, seed=seed),
        "leafwise": Booster(trees=trees, depth=depth, rate=rate, leaves=31, least_rows=20, least_weight=1e-3, penalty=0.0, bins=255, seed=seed + 1),
    }


# ---------------------------------------------------------------- heatmap
def train_heatmap_models(training: DataFrame, names: list[str], keys: Iterable[Key], *, make=learners, row_id: Iterable[str] = ()) -> DataFrame:
    """Trees for every (horizon, multiplier) with a label column ``{horizon}_{multiplier}``, all in one job; keys without one are skipped."""
    targets = [f"{h}_{m}" for h, m in keys if f"{h}_{m}" in training.columns]
    return cut_lineage(boosting.fit(training, names, targets, make(), row_id=list(row_id)))


def predict_heatmap(rows: DataFrame, names: list[str], ids: list[str], trees: DataFrame, keys: Iterable[Key], weights: Mapping[str, float] = MODEL_WEIGHTS) -> DataFrame:
    """Long rows (ids, horizon, multiplier, probability): weighted mean of the key's learners, in one pass over the rows."""
    model, keys = boosting.load(trees), list(keys)
    outputs = {f"{target}_{learner}": (target, learner) for target, learner in model if target in {f"{h}_{m}" for h, m in keys}}
    wide, cells = boosting.predict(rows.select(*dict.fromkeys([*ids, *names])), names, model, outputs), []
    for h, m in keys:
        own = [learner for target, learner in model if target == f"{h}_{m}"]
        total = sum(weights.get(n, 0.4) for n in own)
        p = sum((F.col(f"{h}_{m}_{n}") * (weights.get(n, 0.4) / total) for n in own), F.lit(0.0)) if own else F.lit(MISSING)
        cells.append(F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("multiplier"), p.alias("probability")))
    return wide.select(*ids, F.explode(F.array(*cells)).alias("c")).select(*ids, "c.*")


def mean_heatmap(predictions: DataFrame) -> DataFrame:
    """Batch means per key, the form the scoring service returns."""
    return predictions.groupBy("horizon", "multiplier").agg(F.avg("probability").alias("probability"))


# ---------------------------------------------------------------- risk
def train_risk_models(training: DataFrame, names: list[str], *, boosted: bool = True, trees: int = 100, seed: int = 42) -> DataFrame | dict[str, Model]:
    """Boosted regressions of all components in one job (a table of trees), or a ridge regression each."""
    components = [c for c in RISK_COMPONENTS if c in training.columns]
    if boosted:
        spec = Booster(trees=trees, depth=5, rate=0.1, columns=1.0, logistic=False, seed=seed)
        return cut_lineage(boosting.fit(training, names, components, {"booster": spec}))
    rows = assemble(boosting.dealt(training.select(*names, *[c for c in components if c not in names])), names).persist()
    fits = {}
    for c in components:
        labelled = rows.select("features", F.col(c).cast("double").alias("label")).where(F.col("label").isNotNull())
        fits[c] = lambda labelled=labelled: LinearRegression(regParam=1.0, elasticNetParam=0.0).fit(labelled)
    out = fit_all(training.sparkSession, fits)
    rows.unpersist()
    return out


def predict_risk(rows: DataFrame, names: list[str], ids: list[str], models: DataFrame | Mapping[str, Model]) -> DataFrame:
    """Component scores clipped to 0..100; components without a model are absent."""
    if isinstance(models, DataFrame):
        model = boosting.load(models)
        found = [c for c in RISK_COMPONENTS if (c, "booster") in model]
        out = boosting.predict(rows.select(*dict.fromkeys([*ids, *names])), names, model, {c: (c, "booster") for c in found})
    else:
        out, found = assemble(rows, names).select(*ids, "features"), list(models)
        for c, model in models.items():
            out = model.transform(out).withColumnRenamed("prediction", c)
    return out.select(*ids, *[F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(c))).alias(c) for c in found])


# ---------------------------------------------------------------- stacking and routing
ALL = "all"  # target of the base models that see every row


def base_models(rows: DataFrame, names: list[str], row_id: str, *, make=learners) -> DataFrame:
    """Trees of the base models over all rows. ``rows`` has ``label``."""
    return cut_lineage(boosting.fit(rows.withColumn(ALL, F.col("label").cast("double")), names, [ALL], make(), row_id=[row_id]))


def stack_models(rows: DataFrame, names: list[str], row_id: str, *, cv: int = 5, make=learners) -> tuple[DataFrame, Model]:
    """Trees of the base models, and a logistic model over their out-of-fold predictions. ``rows`` has ``label``.

    A row's fold comes from the hash of its id, so it does not depend on how the
    rows are partitioned. All folds are targets of one fit: a fold's own rows have no
    label in its target.
    """
    label, fold = F.col("label").cast("double"), F.pmod(F.xxhash64(row_id), F.lit(cv))
    data = cut_lineage(rows.select(row_id, *[c for c in names if c != row_id], label.alias("label"), fold.alias("fold")))
    folds = {f"fold{k}": F.when(F.col("fold") != k, F.col("label")) for k in range(cv)}
    trees = cut_lineage(boosting.fit(data.withColumns({ALL: F.col("label"), **folds}), names, [ALL, *folds], make(), row_id=[row_id]))
    model, base = boosting.load(trees), list(make())
    oof = None
    for k in range(cv):
        outputs = {n: (f"fold{k}", n) for n in base if (f"fold{k}", n) in model}
        held = boosting.predict(data.where(F.col("fold") == k).select(*names, "label"), names, model, outputs).select("label", *outputs)
        oof = held if oof is None else oof.unionByName(held)
    oof = cut_lineage(oof)  # the regression passes over it more than once
    return trees, LogisticRegression(maxIter=50).fit(assemble(oof, base))


def _with_base(rows: DataFrame, names: list[str], trees: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with a column for each base model's prediction."""
    model = boosting.load(trees.where(F.col("target") == ALL))
    base = sorted(n for _, n in model)
    return boosting.predict(rows, names, model, {n: (ALL, n) for n in base}), base


def predict_stacked(rows: DataFrame, names: list[str], trees: DataFrame, meta: Model | None) -> DataFrame:
    """Adds the base models' predictions and ``stacked``; without a meta model it is their mean."""
    out, base = _with_base(rows, names, trees)
    if meta is None:
        return out.withColumn("stacked", sum((F.col(n) for n in base), F.lit(0.0)) / len(base))
    return score(meta, assemble(out, base), "stacked").drop("features")


def _with_doubles(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds the router's input columns; missing values count as 0."""
    return rows.withColumns({f"__x{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(names)})


def route_models(rows: DataFrame, names: list[str], trees: DataFrame, *, forest: int = 50, seed: int = 42) -> Model:
    """Forest that says which base model errs least on a row. ``rows`` has ``label``; equal errors go to the first model.

    Spark's forest looks for its thresholds in a sample of the rows. So features are cut
    at exact quantiles of all rows first, and it is told as many bins as make its sample
    the whole; it finds no more than the bins that are there.
    """
    out, base = _with_base(rows.select(*names, "label"), names, trees)
    errors = F.array(*[F.struct(F.abs(F.col(n) - F.col("label")).alias("e"), F.lit(i).alias("i")) for i, n in enumerate(base)])
    best = cut_lineage(out.select(*names, F.array_min(errors)["i"].cast("double").alias("label")))  # the forest passes over it more than once
    cuts = sharded.feature_cuts(best, names, ROUTER_BINS)
    edges = [[-math.inf, *(math.nextafter(c, math.inf) for c in own if c < sys.float_info.max)] for own in cuts]  # a bucket begins behind a cut
    edges = [[*own, *([sys.float_info.max] if len(own) == 1 else []), math.inf] for own in edges]
    inputs, binned = [f"__x{i}" for i in range(len(names))], [f"__bin{i}" for i in range(len(names))]
    stages = [Bucketizer(splitsArray=edges, inputCols=inputs, outputCols=binned), VectorAssembler(inputCols=binned, outputCol="features")]
    ready = PipelineModel(stages).transform(_with_doubles(best, names)).select("features", "label")
    classifier = RandomForestClassifier(numTrees=forest, seed=seed, maxBins=max(ROUTER_BINS, math.isqrt(best.count()) + 1))
    return PipelineModel([*stages, classifier.fit(ready)])


def predict_routed(rows: DataFrame, names: list[str], trees: DataFrame, router: Model | None) -> DataFrame:
    """Adds the base models' predictions and ``routed``: the chosen model's, or the mean of all without a router."""
    out, base = _with_base(rows, names, trees)
    if router is None:
        return out.withColumn("routed", sum((F.col(n) for n in base), F.lit(0.0)) / len(base))
    chosen = router.transform(_with_doubles(out, names))
    route = F.least(F.col("prediction").cast("int"), F.lit(len(base) - 1))
    return chosen.withColumn("routed", F.get(F.array(*[F.col(n) for n in base]), route)).withColumn("route", route).drop("features", "rawPrediction", "probability", "prediction", *[f"__{kind}{i}" for kind in ("x", "bin") for i in range(len(names))])


# ---------------------------------------------------------------- inspection and storage
def feature_importance(trees: DataFrame, names: list[str], target: str = ALL, learner: str = "booster") -> DataFrame:
    """One row per feature, most important first: its share of the gain of all cuts."""
    own = boosting.importance(trees.where((F.col("target") == target) & (F.col("learner") == learner)), names)
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))  # one row per feature
    return own.select(place.alias("place"), "feature", "importance")


def save_models(spark: SparkSession, trees: DataFrame, names: list[str], path: str) -> None:
    """The table of trees, and a table that lists the models with their features."""
    trees.write.mode("overwrite").parquet(f"{path}/trees")
    listing = trees.groupBy("target", "learner").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("trees"))
    listing.withColumn("features", F.array(*[F.lit(n) for n in names])).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load_models(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Trees and feature names."""
    first = spark.read.json(f"{path}/metadata").select("features").first()  # the features are those of every model
    return spark.read.parquet(f"{path}/trees"), list(first["features"]) if first else []
