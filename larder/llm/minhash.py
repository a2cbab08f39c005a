"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function gives every shingle a 64-bit value; a document retains its ``SKETCH`` smallest.  Two similar documents have most
retained values in common, so they also have one in common among the rarer values of each: with ``t`` of ``k`` to be shared, among
the ``k - t + 1`` rarest.  Inverted lists are kept for those alone; a passage or a line that many documents share is never among them,
unless it makes up most of a document.  Every list, however long, is first linked to its smallest member only; verified links
merge documents to components.  A second round compares members of *different* components: short lists by a join, long ones in
tiles that put out one row a document and no pairs.  Joined pairs pass an estimate from the bottom values of the united sketch.
Exact Jaccard on the whole sets confirms every link.

A link is missed only if chance leaves the united sketch five deviations short of common values: 3.3e-6 for a pair at 0.80 and 7.6e-6 at
0.85 (binomial tail for 48 values), nil for sets that are retained whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, scratch, settle

SKETCH = 48
# Lists that take at most so many pairs a member are joined with themselves; longer ones are compared in tiles of so many documents.
SHORT, TILE = 2, 1024
# Columns of a tile's table of common values that are multiplied at once.
COLUMNS = 4096


def least_share(percent: int, sketch: int) -> float:
    """The share of common values below which a sketch does not come from a linked pair: five standard deviations."""
    j = percent / 100
    return max(0.0, j - 5 * math.sqrt(j * (1 - j) / sketch))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; with fewer words than ``width`` the whole sequence is one shingle."""
    words = text.lower().split() if text else []  # for bytes: A-Z only, and split at space and \\t..\\r
    if not words:
        return np.empty(0, np.int64)
    width = min(width, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(words) - width + 1).view(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch], width: int, keep: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for text in batch.column("text").cast(pa.binary()):
            values = shingle_set(text.as_py(), width)
            sizes.append(len(values))
            keys.append(xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None)
            sketches.append(values[:keep])
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(sketches, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_key", "sketch"],
        )


def _verified(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[int, np.ndarray] = {}
        keep = []
        lefts, texts_a, texts_b = batch.column("a").to_pylist(), batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
        for i, a in enumerate(lefts):
            if a not in held:  # a pivot stands in many rows
                held = {} if len(held) > 64 else held
                held[a] = shingle_set(texts_a[i].as_py(), width)
            x, y = held[a], shingle_set(texts_b[i].as_py(), width)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int, share: float) -> DataFrame:
    """Pairs whose sizes allow a link and whose united sketches suggest one."""
    a = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    united = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, F.greatest(F.size("s_a"), F.size("s_b")))
    return (
        pairs.join(b, "b").join(a, "a")
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .withColumn("united", united)
        .where(F.size(F.array_intersect(F.array_intersect("united", "s_a"), "s_b")) >= share * F.size("united"))
        .select("a", "b")
    )


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that exact Jaccard confirms."""
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    )
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verified(it, width, percent), "a long, b long")


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Whole shingle sets, as the exact comparison has them: a tile links what that links, and nothing else."""
    for batch in batches:
        sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column("text").cast(pa.binary())]
        yield pa.record_batch([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "packed"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common."""
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = times[place] > 1
    column = np.cumsum(times > 1) - 1
    column, owner = column[place[shared]], owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int((times > 1).sum()), COLUMNS):
        mine = (column >= start) & (column < start + COLUMNS)
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[mine], column[mine] - start] = 1
        common += has @ has.T
    return common


def _tile(rows: pa.Table, percent: int) -> list[tuple[int, int]]:
    """(a, b) that span what is linked across components in a tile."""
    table = {c: rows.column(c).to_numpy() for c in ("id", "comp", "n", "chunk", "ti", "tj")}
    sets = [np.frombuffer(x, np.int64) for x in rows.column("packed").to_pylist()]
    common, n = _common(sets).astype(np.float64), table["n"].astype(np.float64)
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    linked &= table["comp"][:, None] != table["comp"][None, :]
    if table["ti"][0] != table["tj"][0]:
        linked &= table["chunk"][:, None] != table["chunk"][None, :]
    ids = table["id"]
    if len(ids) <= 1 or not linked.any():
        return []
    # Links that span what is linked; all of them hold.
    root, edges = np.arange(len(ids)), []
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        a, b = root[i], root[j]
        if a != b:
            root[root == b] = a
            edges.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return edges


def _tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Tiles stand one after the other in a partition; the last of a batch may go on in the next."""
    rest: pa.Table | None = None

    def put(parts: list[pa.Table]) -> pa.RecordBatch:
        edges = [e for part in parts for e in _tile(part, percent)]
        return pa.record_batch([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        keys = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("k", "ti", "tj")])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        rest = table.slice(edges[-1])
        yield put([table.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False)])
    if rest is not None:
        yield put([rest])


def _long_lists(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across components among the members of long lists: every two meet in a tile of at most about two times ``TILE``."""
    sets = texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(lambda it: _packed(it, width), "id long, packed binary")
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("id", "k"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = dealt.select("k", "id", "n", "comp", "chunk", F.least("chunk", "other").alias("ti"), F.greatest("chunk", "other").alias("tj")).join(sets, "id")
    placed = tiles.select("k", "ti", "tj", "id", "n", "comp", "chunk", "packed").repartition("k", "ti", "tj").sortWithinPartitions("k", "ti", "tj", "id")
    return placed.mapInArrow(lambda it: _tiles(it, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; further columns are ignored).

    Documents with ``100 * |A & B| >= percent * |A | B|`` are linked.  Equal sets are one class and always linked.  Null and
    empty texts and texts without words have an empty set and link with nothing.  A row without doc_id links with nothing:
    component_id null, kept true.  Rows that repeat a doc_id count as one document, with the links of each of its texts.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = settle(plain.mapInArrow(lambda it: _sketches(it, width, sketch), "doc_id long, n_shingles long, set_key string, sketch array<long>"))
    linkable = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settle(linkable.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))

    share = least_share(percent, sketch)
    posts = classes.select("id", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    common = posts.join(posts.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "v")
    # The rarest of a document's values come first; those that it has alone need no list.
    by_document = common.groupBy("id", "n", "k").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
    wanted = F.floor(F.col("k") * (1 - share)).cast("int") + 1 - (F.col("k") - F.size("values"))
    prefix = settle(by_document.withColumn("wanted", wanted).where("wanted > 0").select("id", "n", F.explode(F.slice("values", F.lit(1), F.col("wanted"))).alias("x")).select("id", "n", F.col("x.v").alias("k")))
    lists = prefix.groupBy("k").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("low")).where("df > 1")
    shared = settle(prefix.join(lists, "k"))
    texts = settle(
        plain.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    )

    stars = shared.where("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    first = settle(_links(_plausible(stars, classes, percent, share), texts, width, percent))
    comps = components(first)

    # Round two: only members of different components.
    labelled = settle(
        shared.join(comps.withColumnRenamed("node", "id"), "id", "left").select("k", "id", "n", F.coalesce("comp", "id").alias("comp"))
    )
    open_lists = (
        labelled.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("k")
        .agg(F.sum("c").alias("df"), F.sum(F.col("c") * F.col("c")).alias("inner"))
        .select("k", ((F.col("df") * F.col("df") - F.col("inner")) / 2).alias("across"), "df")
        .where("across > 0")
        .select("k", (F.col("across") > SHORT * F.col("df")).alias("long"), F.ceil(F.col("df") / TILE).cast("int").alias("chunks"))
    )
    opened = settle(labelled.join(open_lists, "k"))
    compared = opened.where("NOT long")
    left = compared.select("k", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("c_a"))
    right = compared.select("k", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("c_b"))
    across = left.join(right, "k").where(f"a < b AND c_a <> c_b AND 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b").distinct()
    plausible = _plausible(across, classes, percent, share).union(_long_lists(opened.where("long"), texts, width, percent))
    second = settle(_links(plausible.distinct(), texts, width, percent))
    merged = settle(components(first.union(second)))

    named = classes.join(merged.withColumnRenamed("node", "id"), "id", "left").select("set_key", F.coalesce("comp", "id").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their group; all columns stay, rows without doc_id too."""
    if "text" not in docs.columns:
        raise ValueError("documents need a text column")
    path = scratch(docs.sparkSession)
    near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("_dropped_id")).distinct().write.parquet(path)
    dropped = docs.sparkSession.read.schema("_dropped_id long").parquet(path)
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["_dropped_id"], "left_anti")
