"""Micro-batch ingestion of price observations, and windowed prices of an unbounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions.scalar import epoch_day
from tidemark.operators.ohlc import EPOCH, TOKEN, daily_ohlc
from tidemark.operators.intake import OBSERVATION_RULES, judged
from tidemark.operators.scope import valid_observation
from tidemark.operators.upsert import upsert
from tidemark.sources.store import Store

HISTORY, DAILY, REFUSED, DAY = "canon.odds_history", "canon.token_odds_daily", "canon.refused_observations", "odds_date_utc"
OBSERVATIONS = f"{TOKEN} string, {EPOCH} bigint, price double, row_order bigint"


def landed(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Files of observations as they land; the number a batch takes is the back-pressure."""
    return spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_batch(store: Store, batch: DataFrame) -> dict[str, int]:
    """Upsert a batch's valid observations, the last of a token and second winning, and compute anew the days it touches,
    from the canonical history: so overlap, repetition and order of batches don't change the days.

    Both tables lie in parts by day. Only the batch's days are read and written again, however long the history. They are
    two commits, the history's first: if the second fails, the days are old until the batch comes again, as it does from a
    stream's checkpoint. Refused rows go to a table of their own, with the reason, once for each delivery of the batch.

    Returns counts taken by the job that finds the batch's days: ``rows``, ``kept``, those refused by reason, and ``deduped``,
    the kept ones that another of the batch replaces.
    """
    rows = judged(batch.select(TOKEN, EPOCH, "price", "row_order")).persist()
    try:
        fine = F.col("reason").isNull()
        found = rows.groupBy("reason", F.when(fine, epoch_day(EPOCH)).alias(DAY)).agg(F.count("*").alias("n"), F.countDistinct(TOKEN, EPOCH).alias("keys")).collect()
        days = [r[DAY] for r in found if r["reason"] is None]  # one row for each day of the batch, and each reason
        counts = {"rows": sum(r["n"] for r in found), "kept": sum(r["n"] for r in found if r["reason"] is None)}
        counts |= dict.fromkeys(OBSERVATION_RULES, 0) | {r["reason"]: r["n"] for r in found if r["reason"] is not None}
        counts["deduped"] = sum(r["n"] - r["keys"] for r in found if r["reason"] is None)
        good = rows.filter(fine).select(TOKEN, EPOCH, "price", "row_order", epoch_day(EPOCH).alias(DAY))
        if counts["kept"] < counts["rows"]:
            store.append(REFUSED, rows.filter(~fine))
        if days:
            history = upsert(store.read(HISTORY, good.schema, days), good, [TOKEN, EPOCH], ["row_order", "price"])
            store.replace(HISTORY, history.select(*good.columns), DAY, days)
            daily = daily_ohlc(store.read(HISTORY, good.schema, days).select(TOKEN, EPOCH, "price"))
            store.replace(DAILY, daily, DAY, days)
        return counts
    finally:
        rows.unpersist()


def ingest(store: Store, stream: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that ingests each micro-batch."""
    return stream.writeStream.foreachBatch(lambda batch, _: ingest_batch(store, batch) and None).option("checkpointLocation", checkpoint)


def windowed_ohlc(stream: DataFrame, window: str = "1 day", late: str = "5 minutes") -> DataFrame:
    """Open, high, low, close and count of each token and tumbling window, of observations at most so late."""
    timed = stream.filter(valid_observation()).withColumn("ts", F.timestamp_seconds(EPOCH))
    when = F.struct(EPOCH, "price")
    return timed.withWatermark("ts", late).groupBy(TOKEN, F.window("ts", window).alias("w")).agg(
        F.min_by("price", when).alias("open_price"),
        F.max("price").alias("high_price"),
        F.min("price").alias("low_price"),
        F.max_by("price", when).alias("close_price"),
        F.count("*").alias("observed_points"),
    ).select(TOKEN, F.col("w.start").alias("window_start"), "open_price", "high_price", "low_price", "close_price", "observed_points")
