"""Sales feeds that arrive as files: every drop is cleaned and merged once, late or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.repair import clean_rows, drop_invalid
from larder.sources.store import Store, kinds_of

FEED = "sales_feed"


def read_feed(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files dropped into a folder.  A feed has ``date``, ``sku``, ``units_sold`` (any type) and ``ingest_seq``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def feed_rows(batch: DataFrame) -> DataFrame:
    """Valid rows of a feed with the columns of the stored one, the first copy of each (SKU, day) of this batch.

    Rows without a date or SKU are invalid too; columns that the feed lacks are null, columns of its own are left out.
    """
    rows = clean_rows(batch.filter(F.col("date").isNotNull() & F.col("sku").isNotNull()))
    return rows.select(
        *[(F.col(c).cast(k) if c in rows.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds_of(FEED).items()]
    )


def merge(batch: DataFrame, store: Store) -> None:
    """Add a batch; of copies of one (SKU, day), old or new, the smallest ``ingest_seq`` stays.

    The table is the state of the stream: only the months that the batch touches are read and written, nothing is ever too late, and
    a batch that is merged again after a failure changes nothing.
    """
    store.replace(FEED, feed_rows(batch), first="ingest_seq")


def take_in(stream: DataFrame, store: Store, checkpoint: str) -> int:
    """Merge all files that are there now and stop; the number of batches.  ``checkpoint`` remembers the files that are done."""

    def each(batch: DataFrame, number: int) -> None:
        merge(batch, store)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return 0 if query.lastProgress is None else query.lastProgress["batchId"] + 1


def first_arrivals(stream: DataFrame, lateness: str = "31 days") -> DataFrame:
    """Valid rows, one per (SKU, day): a stream for sinks without a key.

    Copies are recognised while the watermark, the latest sales day less ``lateness``, has not passed their day, which bounds the state by
    SKUs times days of lateness; rows older than that are dropped by the engine and counted in the progress of the query as
    dropped by watermark.  The copy that arrives first stays (any one, if several come in one batch).  Use :func:`take_in` where nothing may be lost.
    """
    rows = drop_invalid(stream.filter(F.col("date").isNotNull() & F.col("sku").isNotNull()))
    timed = rows.withColumn("sold_at", F.col("date").cast("timestamp")).withWatermark("sold_at", lateness)
    return timed.dropDuplicatesWithinWatermark(["sku", "date"]).drop("sold_at")
