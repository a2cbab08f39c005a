"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is encoded by an agenda of adjacent symbol pairs: the pair whose joined piece has the highest score is merged first, the
leftmost among equals, until no pair is a piece.  Short units stand side by side, one row each, and every step merges the best pair
of each row; a long unit has a heap of its own.  No piece of such a vocabulary holds a space mark after another character,
nor a character that stands in no piece; merges never cross these places.  So a text falls into units (spaces with the
characters that follow them), and each distinct unit is encoded once per worker.  Every new unit is compared with the sentencepiece
library in its Arrow batch, and the longest text of each batch as a whole; a difference fails the job.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Memory of a worker, not of the result: longer units are not remembered; a full memory becomes the older one, of which only
# units that are met again are carried over.
LONGEST_REMEMBERED, REMEMBERED = 48, 500_000
# Units up to this length are merged side by side, so many at a time; longer ones by a heap.
SHORT_UNIT, ROWS = 64, 4096
# Rows whose ids are held at once.
KEPT_ROWS = 1024
# Slots (a power of two) of the table that finds what two symbols make.
SLOTS = 21
# Characters of text whose units are looked up together.
SLICE = 500_000
_NEVER, _LAST = float("inf"), np.int32(2**31 - 1)


class Pieces:
    """The vocabulary of a model file, with encoding and decoding of units."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.piece = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.cost = {self.piece[i]: -lib.get_score(i) for i in plain}  # the lowest first
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        if len(self.byte) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.id) or any(lib.is_unused(i) for i in range(size)):
            raise ValueError("this is no merge-type vocabulary with byte fallback and leading space marks")
        newline_apart = not any("\n" in p for p in self.id)
        self.units = re.compile(r" *[^ \n]+|\n| +" if newline_apart else r" *[^ ]+| +").findall
        self.lead = len(lib.encode("\n"))
        # Symbols by number: the pieces, then what else stands in one; and what two of them make.
        self.names = list(dict.fromkeys([*self.id, *(c for p in self.id for c in p)]))
        self.number = {name: k for k, name in enumerate(self.names)}
        costs = np.array([self.cost.get(name, _NEVER) for name in self.names])
        self.rank = np.unique(costs, return_inverse=True)[1].astype(np.int32)  # equal costs have equal ranks
        every = [self.parts(name) for name in self.names]
        self.single = np.array([ids[0] if len(ids) == 1 else -1 for ids, _, _ in every])
        self.as_text, self.as_bytes = [text for _, text, _ in every], [raw for _, _, raw in every]
        self.of_character = np.full(0x110000, -1, np.int32)
        for k, name in enumerate(self.names):
            if len(name) == 1:
                self.of_character[ord(name)] = k
        halves = sorted(
            (self.number[p[:k]] * len(self.names) + self.number[p[k:]], self.number[p])
            for p in self.id for k in range(1, len(p)) if p[:k] in self.number and p[k:] in self.number
        )
        self.pairs, joins = np.array(halves, np.int64).reshape(-1, 2).T.copy()
        self.joins = joins.astype(np.int32)
        self.slots = np.full(1 << SLOTS, -1, np.int32)
        at = self._slot(self.pairs)
        self.slots[at] = np.arange(len(at))
        self.crowded = np.zeros(1 << SLOTS, bool)
        self.crowded[at[self.slots[at] != np.arange(len(at))]] = True
        self.remembered: int | None = None  # units; None: ``REMEMBERED``
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.passing: list[str] = []  # units to forget after their texts

    @staticmethod
    def _slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, rank of its cost) of what two symbols make; -1 and ``_LAST`` if they make none or one of them is -1."""
        pair = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * len(self.names) + right)
        slot = self._slot(pair)
        place = self.slots[slot].astype(np.int64)
        crowded = self.crowded[slot]
        if crowded.any():
            place[crowded] = np.searchsorted(self.pairs, pair[crowded])
        place = np.clip(place, 0, len(self.pairs) - 1)
        symbol = np.where(self.pairs[place] == pair, self.joins[place], np.int32(-1))
        return symbol, np.where(symbol < 0, _LAST, self.rank[symbol])

    def merged_rows(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the symbols that are left of all units, one unit after the other, and how many of each; -1 for a character in no piece."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        width = int(sizes.max())
        columns = np.arange(width + 1)
        symbols = np.full((len(units), width + 1), -2, np.int32)
        symbols[columns < sizes[:, None]] = self.of_character[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        whole = symbols.copy()
        joined, cost = self._join(symbols[:, :-1], symbols[:, 1:])
        active = np.arange(len(units))
        while len(active):
            best = cost.argmin(axis=1)
            more = cost[np.arange(len(cost)), best] != _LAST
            if not more.all():
                whole[active[~more]] = symbols[~more]
                active, symbols, joined, cost, best = active[more], symbols[more], joined[more], cost[more], best[more]
            rows = np.arange(len(active))
            symbols[rows, best] = joined[rows, best]
            # Everything behind the pair moves up by one place.
            behind = columns[None, 1:-1] > best[:, None]
            np.copyto(symbols[:, 1:-1], symbols[:, 2:].copy(), where=behind)
            np.copyto(joined[:, 1:-1], joined[:, 2:].copy(), where=behind[:, :-1])
            np.copyto(cost[:, 1:-1], cost[:, 2:].copy(), where=behind[:, :-1])
            for here in (best, np.maximum(best - 1, 0)):
                joined[rows, here], cost[rows, here] = self._join(symbols[rows, here], symbols[rows, here + 1])
        there = whole != -2
        return whole[there], there.sum(axis=1)

    def merged(self, symbols: list[str | None]) -> list[str]:
        """What is left of the characters of one unit."""
        n, cost = len(symbols), self.cost
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < n:
                joined = symbols[left] + symbols[after[left]]
                if joined in cost:
                    heapq.heappush(heap, (cost[joined], left, joined))

        for left in range(n - 1):
            offer(left)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != joined:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left])
            offer(left)
        return [s for s in symbols if s is not None]

    def parts(self, symbol: str) -> tuple[list[int], str, bytes]:
        """Ids of a symbol that merges no further, the same as text, and what they decode to."""
        i = self.id.get(symbol)
        ids = [i] if i is not None else [self.byte[b] for b in symbol.encode()]
        return ids, ",".join(map(str, ids)), self.decoded(ids)

    def encoded(self, units: list[str]) -> list[tuple[list[int], str, bytes]]:
        """Ids of units in which spaces are still spaces, the same as text, and what they decode to."""
        marked = [u.replace(" ", SPACE) for u in units]
        order = sorted((k for k, u in enumerate(marked) if len(u) <= SHORT_UNIT), key=lambda k: len(marked[k]))
        out: list = [None] * len(units)
        for start in range(0, len(order), ROWS):
            mine = order[start : start + ROWS]
            symbols, counts = self.merged_rows([marked[k] for k in mine])
            ids = np.where(symbols < 0, -1, self.single[symbols]).tolist()
            numbers = symbols.tolist()
            texts, raw = [self.as_text[k] for k in numbers], [self.as_bytes[k] for k in numbers]
            stop = 0
            for k, n in zip(mine, counts.tolist(), strict=True):
                at, stop = stop, stop + n
                if -1 not in (found := ids[at:stop]):
                    out[k] = (found, ",".join(texts[at:stop]), b"".join(raw[at:stop]))
        for k, unit in enumerate(marked):
            if out[k] is None:  # long, or with bytes for characters
                found = [self.parts(s) for s in self.merged(list(unit))]
                out[k] = ([i for ids, _, _ in found for i in ids], ",".join([x for _, x, _ in found]), b"".join([x for _, _, x in found]))
        return out

    def ids(self, unit: str) -> list[int]:
        return self.encoded([unit])[0][0]

    def decoded(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, with spaces for space marks; the space that encoding puts in front is still there."""
        return b"".join(self.raw[i] if i in self.raw else self.piece[i].replace(SPACE, " ").encode() for i in ids)

    def known_with(self, texts: list[list[str]]) -> dict[str, tuple[int, str, bytes]]:
        """A memory that holds the units of all ``texts``: new ones are encoded and compared with the library."""
        for unit in self.passing:
            self.known.pop(unit, None)
        known = self.known
        wanted = {u for units in texts for u in units if u not in known}
        if len(known) + len(wanted) > (self.remembered or REMEMBERED):
            self.known, self.older, wanted = {}, known, set().union(*texts)
        older, new = self.older, []
        for unit in wanted:
            if (found := older.get(unit)) is not None:
                self.known[unit] = found
            else:
                new.append(unit)
        # An inner unit would get a space mark in front; a line break keeps the mark apart.
        theirs = self.library.encode(["\n" + u for u in new], num_threads=1)
        for unit, expected, (ids, as_text, text) in zip(new, theirs, self.encoded(new), strict=True):
            if ids != expected[self.lead:]:
                raise ValueError(f"ids of {unit[:80]!r} differ from the library's")
            self.known[unit] = (len(ids), as_text, text)
        self.passing = [u for u in new if len(u) > LONGEST_REMEMBERED]
        return self.known

    def forget(self) -> None:
        """Drop all units and give memory back; workers live on beside other stages."""
        self.known, self.older, self.passing = {}, {}, []
        gc.collect()
        pa.default_memory_pool().release_unused()

    def split(self, text: str) -> list[str]:
        """Units of a text, with the space in front that encoding adds."""
        return self.units(" " + text.replace(SPACE, " ")) if text else []


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about ``SLICE`` characters."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def _digests(batches: Iterator[pa.RecordBatch], path: str | None, keep: bool, remember: int | None) -> Iterator[pa.RecordBatch]:
    model = pieces(path or public_tokenizers.path(MODEL))
    model.remembered = remember
    try:
        yield from _digested(batches, model, keep)
    finally:
        if remember is not None:
            model.forget()


def _digested(batches: Iterator[pa.RecordBatch], model: Pieces, keep: bool) -> Iterator[pa.RecordBatch]:
    step = KEPT_ROWS if keep else 2**31
    for batch in (b.slice(i, step) for b in batches for i in range(0, len(b), step)):
        counts, id_digests, text_digests, kept = [], [], [], []
        longest, whole = "", ("", b"")
        for run in _slices(batch.column("text").to_pylist()):
            split = [model.split(text) for text in run]
            known = model.known_with(split)
            for text, units in zip(run, split, strict=True):
                parts = [known[u] for u in units]
                counts.append(sum([p[0] for p in parts]))
                ids = ",".join([p[1] for p in parts])
                decoded = b"".join([p[2] for p in parts])[1:]
                id_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digests.append(hashlib.sha256(decoded).hexdigest())
                if keep:
                    kept.append(np.array(ids.split(","), np.int32) if ids else np.empty(0, np.int32))
                if len(text) > len(longest):
                    longest, whole = text, (ids, decoded)
        if longest:
            theirs = model.library.encode(longest)
            if ",".join(map(str, theirs)) != whole[0] or model.library.decode(theirs).encode() != whole[1]:
                raise ValueError("a whole text differs from the library's encoding or decoding")
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep:
            columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.record_batch(columns, names=names)


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    model = pieces(path or public_tokenizers.path(MODEL))
    for batch in batches:
        every = []
        for value in batch.column("text"):
            units = model.split(value.as_py() or "")
            found = model.known_with([units])
            every.append([int(i) for u in units for i in found[u][1].split(",")])
        yield pa.record_batch([batch.column("doc_id"), pa.array(every, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): the ids themselves; a null text has none."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _encoded(it, path), "doc_id long, ids array<int>")


def encode_decode(docs: DataFrame, path: str | None = None, keep_ids: bool = False, remember: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have no ids and digests of nothing.  Rows that repeat are each encoded.  ``path``: a model file on the
    executors, by default the public 32k vocabulary.  ``keep_ids`` adds the ids themselves.  ``remember``: units that a
    worker remembers until its task ends, for memory against time; by default it keeps ``REMEMBERED`` from task to task.
    """
    columns = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    return columns.mapInArrow(lambda it: _digests(it, path, keep_ids, remember), schema)
