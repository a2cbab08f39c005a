"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed into phrases, each the longest that occurs in
the labelled text; the language that needs the fewest phrases is closest.  The automata become one table and many texts walk
through it side by side, one step of all languages at a time, each from its first letter to its last.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import settle

# Characters of labelled text a language: the fit's bound.
SAMPLE = 60_000
# Bits of the hash that name a range, coarse and fine.
RANGES = (10, 20)
# The commonest characters have a column in the dense table; transitions of all others are looked up in a sorted list.
ALPHABET = 62
# Bytes of the dense table of all languages at most.
TABLE_BYTES = 256 << 20
# Letters and spaces of texts that are read side by side (more only for one text), and how many of each are coded at once.
RUN, BLOCK = 16_000_000, 1024
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def simplified(text: str) -> str:
    """Lower-case letters; every run of other characters is one space."""
    return " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split())


def letters(text: Column) -> Column:
    """As ``simplified``, but for the case."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}]+", " "))


def running(rows: DataFrame, by: str, chars: int) -> DataFrame:
    """Rows (lang, ``by``, n) before which a language has fewer than ``chars`` characters."""
    order = Window.partitionBy("lang").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < chars).select("lang", by)


def sample(docs: DataFrame, chars: int = SAMPLE) -> dict[str, str]:
    """Labelled text for each language: whole texts in the order of a hash, until ``chars`` characters, the last one cut.

    Learns from rows with text, lang and doc_id that are not held out; equal texts count once.  A language that has ``chars``
    letters and spaces in distinct texts fills its sample; one that has fewer gives all of them.
    """
    known = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("text").alias("h"))
    picked = settle(known.select("lang", "h", F.least(F.length(letters(F.col("text"))), F.lit(chars)).alias("n")).where("n > 0").distinct())
    # Sums of ranges of the hash tell which ranges the sample reaches into; only those are looked at one by one.
    for bits in RANGES:
        ranged = picked.withColumn("range", F.shiftright("h", 64 - bits))
        reached = running(ranged.groupBy("lang", "range").agg(F.sum("n").alias("n")), "range", chars)
        picked = settle(ranged.join(reached, ["lang", "range"], "left_semi").select("lang", "h", "n"))
    chosen = settle(running(picked, "h", chars))
    texts = known.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    texts = texts.select("lang", "h", F.substring(letters(F.col("text")), 1, chars).alias("text"))
    out: dict[str, list[str]] = {}
    for row in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        out.setdefault(row["lang"], []).append(simplified(row["text"]))
    return {lang: "  ".join(t for t in parts if t)[:chars] for lang, parts in out.items() if any(parts)}


def automaton(symbols: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a sequence: how many states, and (state, symbol, next state) of its transitions; 1 is the root."""
    step: list[dict[int, int]] = [{}, {}]
    length, link = [0, 0], [0, 0]
    last = 1
    for c in symbols.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    states = np.repeat(np.arange(len(step)), [len(x) for x in step])
    taken = np.fromiter((c for x in step for c in x), np.int64, len(states))
    return len(step), states, taken, np.fromiter((t for x in step for t in x.values()), np.int64, len(states))


class Parser:
    """The automata of all languages in one table.

    The commonest symbols have a column of a dense table, as many as ``TABLE_BYTES`` allow for all languages together; the transitions of
    the others are in a sorted list.  Where a transition is kept changes no result.
    """

    def __init__(self, texts: dict[str, str], alphabet: int | None = None):
        self.langs = sorted(texts)
        seen, counts = np.unique(np.frombuffer("".join(texts.values()).encode("utf-32-le"), np.uint32), return_counts=True)
        self.symbols = len(seen) + 1
        self.code = np.zeros(0x110000, np.int32)  # 0: a character of no sample
        self.code[seen[np.argsort(-counts, kind="stable")]] = np.arange(1, self.symbols)
        self.first = np.zeros((len(self.langs), self.symbols), np.int32)
        built, self.roots, base = [], [], 0
        for k, lang in enumerate(self.langs):
            size, state, symbol, there = automaton(self.codes(texts[lang]))
            root = state == 1
            self.first[k, symbol[root]] = there[root] + base
            built.append([(x + y).astype(np.int32) for x, y in ((state, base), (symbol, 0), (there, base))])
            self.roots.append(base + 1)
            base += size
        if alphabet is None:
            alphabet = min(ALPHABET, TABLE_BYTES // (4 * max(1, base)))
        self.width = min(len(seen), alphabet) + 1
        self.table = np.zeros(base * self.width, np.int32)
        keys, ends = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        while built:
            state, symbol, there = built.pop()
            dense = symbol < self.width
            self.table[state[dense] * np.int64(self.width) + symbol[dense]] = there[dense]
            keys.append(state[~dense] * np.int64(self.symbols) + symbol[~dense])
            ends.append(there[~dense])
        order = np.argsort(keys := np.concatenate(keys), kind="stable")
        self.keys, self.ends = keys[order], np.concatenate(ends)[order]
        self.bits = {lang: np.log2(max(2, len(texts[lang]))) for lang in self.langs}

    def next(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next state of each language (rows) and block (columns) for a symbol a block; 0 if there is none."""
        if not len(self.keys):
            return self.table[state * np.int64(self.width) + c]
        rare = np.flatnonzero(c >= self.width)
        there = self.table[state * np.int64(self.width) + np.where(c < self.width, c, 0)]
        key = state[:, rare] * np.int64(self.symbols) + c[rare]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there[:, rare] = np.where(self.keys[at] == key, self.ends[at], 0)
        return there

    def codes(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def costs(self, texts: list[str]) -> np.ndarray:
        """Phrases for each language (rows) and text (columns).

        All texts are read side by side, a character a step, each from its first character to its last; the longest stand first, so
        those that are still read are the first columns.
        """
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = np.array([len(texts[k]) for k in order], np.int64)
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(texts), axis=1)
        count = np.zeros(state.shape, np.int64)
        for start in range(0, int(sizes.max(initial=0)), BLOCK):
            live = np.searchsorted(-sizes, -np.arange(start, min(start + BLOCK, int(sizes[0]))), side="left")
            blocks = np.zeros((int(live[0]), BLOCK), np.int32)
            for row in range(len(blocks)):
                codes = self.codes(texts[order[row]][start : start + BLOCK])
                blocks[row, : len(codes)] = codes
            for at, n in enumerate(live):
                c = blocks[:n, at]
                here = state[:, :n]
                there = self.next(here, c)
                dead = there == 0
                count[:, :n] += dead & (here != roots)  # a phrase ended before this symbol
                there = np.where(dead, self.first[:, c], there)
                lost = there == 0  # a symbol the language lacks is a phrase of its own
                count[:, :n] += lost
                state[:, :n] = np.where(lost, roots, there)
        total = np.empty_like(count)
        total[:, order] = count + (state != roots)
        return total


@functools.lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(texts))


def _predicted(batches: Iterator[pa.RecordBatch], texts: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    parser = _parser(texts) if texts else None
    for batch in batches:
        langs, scores, run, size = [], [], [], 0
        for i, value in enumerate(batch.column("text")):
            run.append(simplified(value.as_py() or ""))
            size += len(run[-1])
            if size >= RUN or i == len(batch) - 1:
                best = _best(parser, run)
                langs += [lang for lang, _ in best]
                scores += [score for _, score in best]
                run, size = [], 0
        yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])


def _best(parser: Parser | None, texts: list[str]) -> list[tuple[str, float]]:
    if parser is None:
        return [(UNKNOWN, 0.0)] * len(texts)
    bits = parser.costs(texts) * np.array([parser.bits[x] for x in parser.langs])[:, None]
    low = bits.min(axis=0)
    score = 1.0 / np.exp2(np.maximum(low - bits, -60.0)).sum(axis=0)
    return [(parser.langs[k], float(s)) if t else (UNKNOWN, 0.0) for k, s, t in zip(bits.argmin(axis=0), score, texts, strict=True)]


def identify(docs: DataFrame, chars: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang; others are ignored).

    Phrases are weighed by the bits that point to a place in a language's sample.  Ties go to the first language by name.
    ``score`` is the share of the winner if each language's weight halves with every bit.  Null texts and texts without letters,
    and all texts if nothing is labelled, give ``und`` and 0.  Rows that repeat get the same answer; a null doc_id counts as not
    held out in the output and is never learned from.
    """
    texts = tuple(sorted(sample(docs, chars).items()))
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # at most ``chars`` characters a language
    columns = docs.select(F.col("doc_id").cast("long"), "text")
    rows = columns.mapInArrow(lambda it: _predicted(it, shared.value), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
