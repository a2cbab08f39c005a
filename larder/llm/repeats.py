"""Passages that repeat across documents, by suffix trees of groups of suffixes.

A window of ``WINDOW`` words repeats if its suffix shares an internal node of that depth with a suffix of another document.  Suffixes are
split into groups by a prefix of variable length that is read from an anchor: the gram of ``GRAM`` words with the smallest hash among
those of the window.  Equal windows have equal anchors, so they are always in one group, and suffixes next to each other mostly share
theirs; a group gets the words of such a run once.  Anchors that occur in one document only have no tree: nothing there can repeat.

Equal runs are merged before they are dealt, so copies of a document weigh as much as one.  A group of more than ``MEMBERS``
different runs (a passage whose surroundings differ) is split by the longest prefix there is, the whole window: its tree is a leaf, and
what is left of it is an aggregate.  The other groups fit in memory; some at a time are built into a tree by doubling: after
j steps suffixes of equal rank share a node at depth 2^j or below, and two overlapping ranks give the nodes at depth ``WINDOW``, the cut
above all deep internal nodes.  Words are compared, not hashes.  Consecutive repeating windows of a document make up its maximal
repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import settle

WINDOW, GRAM = 50, 8
MEMBERS = 4096
# Words that are hashed or built into trees at once (more only for one document or one group); words whose hash a task remembers.
WORDS, KNOWN = 300_000, 400_000


class Hashes(dict):
    """Hash of a word; remembers the words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _words(text: pa.Scalar) -> list[bytes]:
    """Words of a text; for bytes, split() separates at space and \\t..\\r."""
    value = text.as_py()
    return value.split() if value else []


def _joined(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` (a power of 2) consecutive values."""
    for step in (2**k for k in range(width.bit_length() - 1)):
        factor = np.uint64(0x9E3779B97F4A7C15 ^ (step << 1))
        values = values[:-step] * factor + values[step:]
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(29))


def anchors(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the leftmost smallest gram of every window over hashes of words."""
    low = _joined(words, gram)
    place = np.arange(len(low))
    span, wanted = 1, window - gram + 1
    while span < wanted:
        step = min(span, wanted - span)
        n = len(low) - step
        right = low[step:] < low[:n]
        low, place = np.where(right, low[step:], low[:n]), np.where(right, place[step:], place[:n])
        span += step
    return low.view(np.int64), place


def _runs(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows of a document that share an anchor: hash, first and last start."""
    known = Hashes()
    names = ["anchor", "doc_id", "version", "first", "last"]
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy()
        pending: list[tuple[int, list[bytes]]] = []
        size = 0
        for row in range(len(batch) + 1):
            if row < len(batch):
                words = _words(texts[row])
                if len(words) >= window:
                    pending.append((row, words))
                    size += len(words)
            if pending and (size >= WORDS or row == len(batch)):
                flat = np.fromiter((known[w] for _, words in pending for w in words), np.uint64, size)
                ends = np.cumsum([len(words) for _, words in pending])
                starts = ends - [len(words) for _, words in pending]
                low, place = anchors(flat, window, gram)
                owner = np.repeat(np.arange(len(pending)), ends - starts)[: len(low)]
                at = np.arange(len(low))
                inside = at + window <= ends[owner]
                at, owner, low, place = at[inside], owner[inside], low[inside], place[inside]
                new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
                last = np.r_[new[1:], len(at)] - 1
                rows = np.array([r for r, _ in pending])[owner[new]]
                columns = [low[new], ids[rows], versions[rows], (at[new] - starts[owner[new]]).astype(np.int32), (at[last] - starts[owner[new]]).astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in columns], names=names)
                pending, size = [], 0


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The words of each run, with a key; within a document equal runs share one copy of the words."""
    schema = pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("words", pa.binary()), ("doc_id", pa.int64()), ("version", pa.int64()), ("first", pa.int32())])
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        ids, versions, runs = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), batch.column("runs")
        out, size = [], 0
        for row in range(len(batch)):
            words = _words(texts[row])
            seen = set()
            for run in runs[row].as_py():
                piece = b" ".join(words[run["first"] : run["last"] + window])
                key = xxhash.xxh3_128_digest(piece)
                out.append((run["anchor"], key, None if key in seen else piece, ids[row], versions[row], run["first"]))
                seen.add(key)
                size += len(piece)
                if size > 2**24:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def deep_nodes(pieces: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, node) of every window of the pieces, in order; windows have one node if and only if their words are equal."""
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for words in pieces for w in words], np.int64)
    sizes = np.array([len(words) for words in pieces])
    owner = np.repeat(np.arange(len(pieces)), sizes)
    depth = 1
    while depth < window:  # beyond the end of a piece ranks mean nothing; no window reaches there
        step = min(depth, window - depth)
        pairs = rank[: len(rank) - step] * (len(rank) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        depth += step
    start = np.arange(len(rank))
    inside = start + window <= np.cumsum(sizes)[owner[: len(rank)]]
    return owner[: len(rank)][inside], rank[inside]


def _trees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For every run with a window that repeats: the smallest document of each of its windows.  Groups stand one after the other."""

    def grown(rows: list[tuple[int, bytes, bytes, int, int]]) -> pa.RecordBatch:
        pieces = [words.split(b" ") for _, _, words, _, _ in rows]
        owner, node = deep_nodes(pieces, window)
        low, high = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, low[owner])
        smallest = least[node]
        ends = np.searchsorted(owner, np.arange(len(rows) + 1))
        keep = [i for i in range(len(rows)) if smallest[ends[i] : ends[i + 1]].min() < high[i]]
        return pa.record_batch([pa.array([rows[i][1] for i in keep], pa.binary()), pa.array([smallest[ends[i] : ends[i + 1]] for i in keep], pa.list_(pa.int64()))], names=["key", "smallest"])

    held: list[tuple[int, bytes, bytes, int, int]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "words", "low", "high")), strict=True):
            if held and size >= WORDS and row[0] != held[-1][0]:
                yield grown(held)
                held, size = [], 0
            held.append(row)
            size += row[2].count(b" ") + 1
    if held:
        yield grown(held)


def _leaves(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of the runs of groups that are split by the longest prefix."""
    schema = pa.schema([("key", pa.binary()), ("place", pa.int32()), ("leaf", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
    for batch in batches:
        for key, piece, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "words", "low", "high")), strict=True):
            words = piece.split(b" ")
            n = len(words) - window + 1
            leaves = [xxhash.xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(n)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(([key] * n, range(n), leaves, [low] * n, [high] * n), schema.types, strict=True)], schema=schema)


def _smallest(runs: DataFrame, window: int) -> DataFrame:
    """(key, smallest) for the different ``runs`` (anchor, key, words, low, high) that hold a repeating window."""
    hot = settle(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > MEMBERS).select("anchor"))
    grouped = runs.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "key")
    built = grouped.select("anchor", "key", "words", "low", "high").mapInArrow(lambda it: _trees(it, window), "key binary, smallest array<long>")
    if hot.isEmpty():
        return built
    split = runs.join(hot, "anchor", "left_semi").select("key", "words", "low", "high")
    leaves = settle(split.mapInArrow(lambda it: _leaves(it, window), "key binary, place int, leaf binary, low long, high long"))
    least = leaves.groupBy("leaf").agg(F.min("low").alias("least"))
    whole = leaves.join(least, "leaf").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "least"))).alias("s"), F.first("high").alias("high"))
    whole = whole.where(F.exists("s", lambda x: x["least"] < F.col("high")))
    return built.union(whole.select("key", F.col("s.least").alias("smallest")))


def _versions(docs: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id with other texts are told apart by a hash of the text."""
    return docs.withColumn("_doc", F.col("doc_id").cast("long")).withColumn("_version", F.xxhash64("text"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, version, starts): where windows start whose words also start in a document with a smaller doc_id.

    ``docs`` has (doc_id, text); ``version`` is xxhash64 of the text.  Null texts, texts of fewer than ``window`` words and rows without
    doc_id have no windows.  Rows with equal doc_id are no others to each other.
    """
    plain = _versions(docs).select(F.col("_doc").alias("doc_id"), F.col("_version").alias("version"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = settle(plain.mapInArrow(lambda it: _runs(it, window, gram), "anchor long, doc_id long, version long, first int, last int"))
    # A table of its own, so that the join may split an anchor that many documents share.
    shared = settle(runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    wanted = runs.join(shared, "anchor").groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("runs"))
    fetched = plain.join(wanted, ["doc_id", "version"]).select("doc_id", "version", "text", "runs")
    cut = settle(fetched.mapInArrow(lambda it: _cut(it, window), "anchor long, key binary, words binary, doc_id long, version long, first int"))
    different = cut.groupBy("key").agg(F.first("anchor").alias("anchor"), F.max("words").alias("words"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    smallest = settle(_smallest(settle(different), window))
    found = cut.select("key", "doc_id", "version", "first").join(smallest, "key")
    starts = F.expr("filter(transform(smallest, (m, i) -> IF(m < doc_id, first + i, -1)), x -> x >= 0)")
    found = found.withColumn("starts", starts).where(F.size("starts") > 0)
    return found.groupBy("doc_id", "version").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal spans of words covered by windows."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + window])
    return list(zip(starts[new].tolist(), (np.r_[starts[new[1:] - 1], starts[-1]] + window).tolist(), strict=True))


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept, covered = [], [], [], []
        for text, starts in zip(batch.column("text").cast(pa.binary()), batch.column("_starts"), strict=True):
            words = _words(text)
            mine = spans(starts.values.to_numpy(), window) if starts.is_valid else []
            left, at = [], 0
            for a, b in mine:
                left += words[at:a]
                at = b
            left += words[at:]
            n.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
            covered.append([{"start": a, "stop": b} for a, b in mine])
        added = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(covered, SPANS)]
        yield pa.record_batch([*(batch.column(c) for c in batch.schema.names if c != "_starts"), *added], names=[*(c for c in batch.schema.names if c != "_starts"), "_words", "_removed", "_kept", "_spans"])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept, spans) for every row of ``docs`` (doc_id, text; others are ignored).

    ``kept`` holds the words that no repeating window covers, joined by one space (empty for texts without words and null ones);
    ``spans`` are the maximal covered spans, as word positions with an exclusive end.  Which windows repeat is judged on the input.
    Rows without doc_id keep all words.  Of equal windows the smallest doc_id keeps its words, in all rows that repeat that id.
    """
    found = repeats(docs, window).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("starts").alias("_starts"))
    rows = _versions(docs.select("doc_id", "text")).join(found, ["_doc", "_version"], "left").select("doc_id", "text", "_starts")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _kept(it, window), f"doc_id {kind}, text string, _words long, _removed long, _kept string, _spans array<struct<start:int,stop:int>>")
    return out.select("doc_id", "text", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_kept").alias("kept"), F.col("_spans").alias("spans"))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of ``drop_repeats``."""
    return drop_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
