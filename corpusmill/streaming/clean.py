"""Incremental versions of the batch operators: the same expressions over a stream of files (T-1 to T-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions.keys import sha_bucket, split_of
from corpusmill.functions.rules import has_text, label_is
from corpusmill.functions.text import stable_hash
from corpusmill.operators.order import running_best


def clean(df: DataFrame, language: str = "en", ratio: float = 0.01, salt: str = "val-v1") -> DataFrame:
    """Rows with text in a language, their hash and split. Works on a table and on a stream alike."""
    kept = df.where(has_text(F.col("text")) & label_is(F.col("lang"), language))
    bucket = sha_bucket(F.concat(F.lit("id="), F.col("doc_id").cast("string")), salt)
    return kept.select("doc_id", F.length("text").cast("long").alias("n_chars"), stable_hash(F.col("text")).alias("text_hash"), split_of(bucket, ratio).alias("split"))


def read_stream(spark: SparkSession, pattern: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def run_available(cleaned: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """T-2, T-3: processes what has not been processed yet, then stops; the checkpoint holds how far it came."""
    return cleaned.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Arrivals per window of event time; rows later than the watermark are left out of windows that have closed."""
    timed = events.select(F.col("loaded_at").cast("timestamp").alias("at"), "source").withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "source").agg(F.count("*").alias("n_rows"))


def track_best(history: DataFrame, state: str, metric: str = "metric") -> StreamingQuery:
    """T-6: appends each batch of a metric stream (step, metric) to ``state`` with its number and the best so far.

    Rows of a batch count in the order of their steps. The best is carried from batch to batch by the history itself, so a restart goes on from
    it; a batch that is run again replaces its own rows.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None
        if _exists(spark, state):
            earlier = spark.read.parquet(state).where(F.col("batch") < number)
            before = earlier.agg(F.max("best").alias("b")).first()["b"]
        rows = running_best(batch, ["step"], [], metric, "__ahead")
        ahead = F.greatest("__ahead", F.lit(before).cast("double"))
        rows = rows.select("step", metric, F.greatest(ahead, F.col(metric).cast("double")).alias("best"), F.coalesce(F.col(metric) > ahead, F.lit(True)).alias("is_best"))
        rows.write.mode("overwrite").parquet(f"{state}/batch={number}")

    return history.writeStream.foreachBatch(append).option("checkpointLocation", f"{state}-checkpoint").trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def resume_position(state: DataFrame) -> DataFrame:
    """T-2: where to go on by the newest entry of a log of (epoch, index, rows): epoch and index of the next row; (0, 0) for an empty log.

    An index that has reached the epoch's rows goes on with the next epoch.
    """
    newest = state.agg(F.max(F.struct("epoch", "index", "rows")).alias("s"))
    over = F.col("s.index") >= F.col("s.rows")
    return newest.select(F.coalesce(F.when(over, F.col("s.epoch") + 1).otherwise(F.col("s.epoch")), F.lit(0)).alias("epoch"), F.coalesce(F.when(over, F.lit(0)).otherwise(F.col("s.index")), F.lit(0)).alias("index"))


def rows_from(df: DataFrame, start: int, rank: int, world: int, index: str = "index") -> DataFrame:
    """T-2, T-3, W10: the rows of a worker from a global index on."""
    return df.where((F.col(index) >= start) & (F.pmod(F.col(index), F.lit(world)) == rank))
