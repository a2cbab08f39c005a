"""Token counts of a corpus from the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import settle

RANKS = "byte_bpe_50k.tiktoken"
# Lengths are summed in blocks first, so that no window holds more than this many rows or the number of blocks.
BLOCK = 1024


@functools.lru_cache(maxsize=4)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lengths(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    encoding = _encoding(path or public_tokenizers.path(RANKS))
    for batch in batches:
        sizes = [len(encoding.encode_ordinary(t)) if (t := text.as_py()) else 0 for text in batch.column("text")]
        yield pa.record_batch([pa.array(sizes, pa.int64())], names=["n_tokens"])


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many rows of ``docs`` (text; others are ignored) encode to each length.

    Whole texts are encoded; null and empty texts have length 0; rows that repeat count each.  ``path``: a file of ranks on the
    executors, by default the public 50k vocabulary.
    """
    lengths = docs.select("text").mapInArrow(lambda it: _lengths(it, path), "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """One row per length of a histogram, each an exact answer for that context limit.

    docs_up_to, tokens_up_to: documents (tokens in them) that fit; docs_over, tokens_over: those longer; truncated_tokens: what
    remains when all are cut to the limit; share_up_to: the quantile that this length is.  An empty histogram gives no rows.
    """
    held = settle(lengths.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs")))
    later = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = held.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("block_tokens"))
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(everything).alias("all_docs"), F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    sums = held.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.col("docs_later") + F.coalesce(F.sum("n_docs").over(within), F.lit(0))).alias("docs_over"),
        (F.col("tokens_later") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("tokens_over"),
    )
    return sums.select(
        "n_tokens", "n_docs", (F.col("all_docs") - F.col("docs_over")).alias("docs_up_to"), (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_up_to"),
        "docs_over", "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_up_to"),
    )


def truncated_totals(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """(context, total_tokens, truncated_tokens, docs_cut) for any context limits, also those that no document has."""
    each = lengths.withColumn("context", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    return each.groupBy("context").agg(
        F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total_tokens"),
        F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("truncated_tokens"),
        F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(F.lit(0))).alias("docs_cut"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of the documents does not exceed."""
    each = sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares]))).where("share_up_to >= share")
    return each.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
