"""Mixing sources to target weights by Poisson replication.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import settle

SEED = "mix-1"
_UNIT = float(2**52)


def _uniform(*parts: Column | str) -> Column:
    """A hash of the parts as a number in [0, 1) with 52 bits; the same on every run and partitioning."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / _UNIT


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, n_docs, n_chars, rate): how often each source's documents are to be repeated on average.

    The result has ``epochs`` times the characters of the input, shared out by ``weights`` (a source without weight gets none)
    or, without weights, by size to the power ``temperature``.  A source without characters keeps rate 1.
    """
    sizes = settle(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n_chars")))
    if weights is None:
        weight = F.pow(F.col("n_chars").cast("double"), F.lit(temperature))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(w))) for k, w in weights.items()], F.lit(0.0))
    weighed = sizes.withColumn("weight", weight)
    every = Window.partitionBy(F.lit(0))  # one row a source
    rate = F.col("weight") / F.sum("weight").over(every) * (F.lit(epochs) * F.sum("n_chars").over(every)) / F.col("n_chars")
    return weighed.select("source", "n_docs", "n_chars", F.when(F.col("n_chars") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is far below a hash's last bit."""
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]).otherwise(F.array().cast("array<double>"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: str = SEED, keep_text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, source and any others), each row repeated by its own Poisson draw, in a global random order.

    The draw inverts the Poisson distribution with the mean of the row's source at a hash of seed and doc_id.  Adds ``_copy``
    (from 1), ``_copies`` and ``_order``, a hash by which the result is sorted.  Rows that repeat a doc_id repeat its draw.  Null
    sources are a source, null texts have no characters, a null doc_id is hashed as the text "null".  ``keep_text=False`` leaves the text out.
    """
    shares = rates(docs, weights, temperature, epochs)
    shares = settle(shares.select("source", _distribution(F.col("rate")).alias("cdf")))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns if keep_text or c != "text"]).alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("from"), _uniform(seed, F.col("doc_id")).alias("u"))
    drawn = packed.join(shares, packed["from"].eqNullSafe(shares["source"]))
    copies = drawn.select("doc", "id", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("copies")).where("copies > 0")
    each = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = F.md5(F.concat_ws("|", F.lit(seed + "/order"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    ordered = each.withColumn("order", order).orderBy("order", "id", "copy")
    return ordered.select("doc.*", F.col("copies").alias("_copies"), F.col("copy").alias("_copy"), F.col("order").alias("_order"))
