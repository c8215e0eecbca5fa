"""Model monitoring over micro-batches: drift windows and test-then-train scoring.

State is kept as one table per batch in a shared folder: a batch reads the folder
of the batch before it and writes its own, so a repeated batch gives the same
result and a lost executor or driver loses nothing.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chainsieve.operators.drift import ROWS, merge_summaries, sample_summary, summary_report, summary_tests
from chainsieve.operators.evaluation import classification_metrics, probability_losses, recency_weights
from chainsieve.operators.ordered import time_slice


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def newest(rows: DataFrame, n: int, ts: str = "ts", tie: str = "row_id") -> DataFrame:
    """The ``n`` newest rows; a window size of the detector, picked before any gathering."""
    return rows.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def stream_drift(
    rows: DataFrame, names: list[str], folder: str, *, reference_size: int | None = None, current_size: int | None = None, least: int = 100,
    reset_on_drift: bool = True, exact_values: int = 65_536, once: bool = False,
) -> StreamingQuery:
    """Report per batch whether its rows differ from the reference window.

    By default windows are whole batches: the reference is all rows of the first
    batches, until it has ``least`` of them, and every later batch is tested as a whole.
    ``reference_size`` and ``current_size`` make them row windows: the first rows
    of the stream, filled up over batches, and the newest rows. After a detected change
    the current window takes the place of the reference. Columns: ts, row_id, the named
    features, prediction, performance. Reports land in ``folder``/reports, the tests
    of each feature in ``folder``/tests; a batch that only fills the reference has none.

    Of the reference only counts per value are kept, and per band of values for a
    feature with more than ``exact_values`` of them, so its size does not grow with the
    rows. Tests carry the error that bands bring (``statistic_error``).
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        started = _exists(spark, f"{folder}/reference/batch={batch_id - 1}")
        old = spark.read.parquet(f"{folder}/reference/batch={batch_id - 1}") if started else None
        have = (old.where(F.col("feature") == ROWS).agg(F.sum("n").alias("n")).first()["n"] or 0) if started else 0
        if reference_size is None:
            fill, fresh = (batch, batch.limit(0)) if have < least else (batch.limit(0), batch)
        else:
            fill = batch.orderBy("ts", "row_id").limit(max(0, reference_size - have))
            fresh = batch.join(fill.select("row_id"), "row_id", "left_anti").select(*batch.columns) if have < reference_size else batch
        waiting = f"{folder}/waiting/batch={batch_id - 1}"
        if current_size is not None and _exists(spark, waiting):
            fresh = spark.read.parquet(waiting).select(*batch.columns).unionByName(fresh)
        current = (fresh if current_size is None else newest(fresh, current_size)).persist()
        added = sample_summary(fill, names)
        reference = merge_summaries(added.limit(0) if old is None else old, added, exact_values).persist()
        fired = False
        if current.limit(1).count():
            empty = sample_summary(current.limit(0), names).limit(0)
            now = merge_summaries(empty, sample_summary(current, names), exact_values).persist()
            summary_tests(reference, now).write.mode("overwrite").parquet(f"{folder}/tests/batch={batch_id}")
            tests = spark.read.parquet(f"{folder}/tests/batch={batch_id}")
            report = summary_report(tests, reference, now, names).withColumn("ts", F.lit(batch_id))
            report.write.mode("overwrite").parquet(f"{folder}/reports/batch={batch_id}")
            fired = reset_on_drift and spark.read.parquet(f"{folder}/reports/batch={batch_id}").where("drift_detected").count() > 0
            if fired:
                reference = now
        reference.write.mode("overwrite").parquet(f"{folder}/reference/batch={batch_id}")
        if current_size is not None:
            (current.limit(0) if fired else current).write.mode("overwrite").parquet(f"{folder}/waiting/batch={batch_id}")
        for df in (batch, current, reference):
            df.unpersist()

    writer = rows.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()


def incremental_scoring(rows: DataFrame, names: list[str], folder: str, *, decay: float = 0.99, window_rows: int = 10_000, drop: float = 0.1, once: bool = False) -> StreamingQuery:
    """Score each batch with the model of the batch before, then train on it when it is due.

    A refit happens on the first batch, after ``window_rows`` new rows, or when
    accuracy falls below (1 - drop) of its mean over the last ten batches. Rows
    weigh ``decay`` per position of age within the training window. Metrics land in
    ``folder``/metrics.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        prior = f"{folder}/window/batch={batch_id - 1}"
        started = _exists(spark, prior)
        seen = spark.read.parquet(prior) if started else None
        due = not started
        waiting = batch.count()
        if started:
            meta = spark.read.parquet(f"{folder}/meta/batch={batch_id - 1}").first()
            model_batch, waiting = meta["model_batch"], waiting + meta["waiting"]
            model = PipelineModel.load(f"{folder}/model/batch={model_batch}")
            scored = model.transform(batch).select(vector_to_array("probability")[1].alias("probability"), F.col("label").cast("int").alias("outcome"))
            metrics = classification_metrics(scored).crossJoin(F.broadcast(probability_losses(scored))).withColumn("model_batch", F.lit(model_batch))
            metrics.write.mode("overwrite").parquet(f"{folder}/metrics/batch={batch_id}")
            history = spark.read.parquet(f"{folder}/metrics").where(F.col("batch") <= batch_id).orderBy(F.col("batch").desc()).limit(11).collect()  # at most 11 rows
            before = [r["accuracy"] for r in history[1:] if r["accuracy"] is not None]
            due = waiting >= window_rows or bool(before and history[0]["accuracy"] is not None and history[0]["accuracy"] < (1 - drop) * sum(before) / len(before))
        window = newest(batch if seen is None else seen.unionByName(batch), window_rows).persist()
        if due:
            weighted = recency_weights(window, [], ["ts", "row_id"], time_slice("ts"), decay)
            stages = [VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip"), LogisticRegression(weightCol="weight", maxIter=20)]
            Pipeline(stages=stages).fit(weighted).write().overwrite().save(f"{folder}/model/batch={batch_id}")
            model_batch, waiting = batch_id, 0
        spark.createDataFrame([(model_batch, waiting)], "model_batch bigint, waiting bigint").write.mode("overwrite").parquet(f"{folder}/meta/batch={batch_id}")
        window.write.mode("overwrite").parquet(f"{folder}/window/batch={batch_id}")
        window.unpersist()
        batch.unpersist()

    writer = rows.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()
