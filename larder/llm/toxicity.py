"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, lower case, homoglyphs, digits and signs that stand for letters), an Aho-Corasick automaton finds
the lexicon's terms at word starts, matches inside exception phrases are cancelled, and the weights found, normalised by
length, give a score through a logistic curve.

Terms are words or beginnings of words.  They, their weights, the exceptions and the curve are learned from labelled rows: a term is
taken while it explains enough toxic documents that earlier terms do not, the longest one first among those that find the same documents.
Then terms follow that stand in many toxic documents which are no copies of each other, and in no clean one, though others explain these too.
"""

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import settle

# Bounds of the fit: labelled rows (expected; a hash draws them), terms considered.
LABELLED, CANDIDATES = 12_000, 4_000
SHORTEST, LONGEST = 3, 10
# Terms whose counts a task holds at once, and texts it holds as strings: memory of a worker, not of the result.
COUNTED, HELD = 50_000, 512
# A term must explain so many toxic documents, and one clean document outweighs so many toxic ones.
SUPPORT, CLEAN_COST = 3, 4
# Evidence of its own: so many unlike toxic documents, at least so many of them, and no clean one.
OWN_SHARE, OWN_LEAST = 0.05, 6
THRESHOLD = 0.7

# Letters of other scripts that look like Latin ones, and digits and signs read as letters.
HOMOGLYPHS = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "һ": "h", "к": "k", "м": "m",
    "т": "t", "в": "b", "н": "h", "г": "r", "п": "n",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ɡ": "g", "ı": "i", "ł": "l",
    "​": None, "‌": None, "‍": None, "﻿": None, "­": None,
})
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"})

_TOKENS = re.compile(r"[\w@$]+").findall
_WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights (a leading space: at a word's start; a trailing one: at its end), exceptions and the curve."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 4.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _letters(token: str) -> list[str]:
    """Words of a token with digits, signs or underscores: these are letters if others are."""
    return _WORDS(token.translate(DIGITS) if any(c.isalpha() for c in token) else token)


def fold(text: str | None) -> tuple[str, int]:
    """The folded words of a text, each between single spaces, and their number."""
    if not text:
        return " ", 0
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    words: list[str] = []
    for token in _TOKENS(text):
        if token.isalpha():
            words.append(token)
        else:
            words.extend(_letters(token))
    return f" {' '.join(words)} ", len(words)


@functools.lru_cache(maxsize=4)
def _machine(patterns: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton | None:
    if not patterns:
        return None
    machine = ahocorasick.Automaton()
    for i, (pattern, _) in enumerate(patterns):
        machine.add_word(pattern, i)
    machine.make_automaton()
    return machine


def _hits(words: str, lexicon: Lexicon) -> list[tuple[int, int, int]]:
    """(start, end, term) of the lexicon's matches that no exception covers."""
    machine = _machine(lexicon.terms)
    if machine is None:
        return []
    found = [(end + 1 - len(lexicon.terms[i][0]), end + 1, i) for end, i in machine.iter(words)]
    if found and lexicon.exceptions:
        spare = _machine(tuple((x, 0.0) for x in lexicon.exceptions))
        free = [(end + 1 - len(lexicon.exceptions[i]), end + 1) for end, i in spare.iter(words)]
        found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e in free)]
    return found


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """The log of the weights found, and the weights per root of the words."""
    words, n = fold(text)
    weight = sum(lexicon.terms[i][1] for _, _, i in _hits(words, lexicon))
    return math.log1p(weight), weight / math.sqrt(n + 1.0)


def score(text: str | None, lexicon: Lexicon) -> float:
    base, slope, density = lexicon.curve
    x, y = features(text, lexicon)
    return 1.0 / (1.0 + math.exp(-min(60.0, max(-60.0, base + slope * x + density * y))))


def _terms(words: str) -> set[str]:
    out = set()
    for w in set(words.split()):
        if len(w) >= SHORTEST:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each term's texts by label; a term may come in several rows, which add up."""
    counts = (Counter(), Counter())

    def counted() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())]
        return pa.record_batch(columns, names=["term", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            counts[toxic.as_py()].update(_terms(fold(text.as_py())[0]))
            if len(counts[0]) + len(counts[1]) > COUNTED:
                yield counted()
                counts = (Counter(), Counter())
    yield counted()


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``HELD`` at a time."""
    return (b.slice(i, HELD) for b in batches for i in range(0, len(b), HELD))


def _found(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """For each labelled row the terms it has, and their words with a neighbour on either side."""
    for batch in _held(batches):
        terms, phrases, xs, ys, kinds = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            words, n = fold(text)
            hits = _hits(words, lexicon)
            terms.append(sorted({i for _, _, i in hits}))
            around = set()
            for start, end, _ in hits:
                left, right = start, words.find(" ", max(end - 1, start + 1))
                around.add(words[left : right + 1])
                around.add(words[left : words.find(" ", right + 1) + 1] if right + 1 < len(words) else words[left : right + 1])
                around.add(words[max(0, words.rfind(" ", 0, left)) : right + 1])
            phrases.append(sorted(p for p in around if len(p) > 2))
            kinds.append(min((xxhash.xxh3_64_intdigest(w) >> 1 for w in set(words.split())), default=0))  # near copies mostly agree
            weight = sum(lexicon.terms[i][1] for _, _, i in hits)
            xs.append(math.log1p(weight))
            ys.append(weight / math.sqrt(n + 1.0))
        names = ["toxic", "terms", "phrases", "x", "y", "kind"]
        columns = [batch.column("toxic"), pa.array(terms, pa.list_(pa.int32())), pa.array(phrases, pa.list_(pa.string())), pa.array(xs, pa.float64()), pa.array(ys, pa.float64()), pa.array(kinds, pa.int64())]
        yield pa.record_batch(columns, names=names)


def _chosen(terms: list[str], rows: list[tuple[int, list[int], int]]) -> list[tuple[str, float]]:
    """Greedy cover of the toxic rows by terms that clean rows hardly have, then terms with evidence of their own.

    ``rows``: toxic or not, the terms found, and a number that near copies share.
    """
    toxic = np.array([t for t, _, _ in rows], bool)
    has = np.zeros((len(rows), len(terms)), bool)
    for r, (_, found, _) in enumerate(rows):
        has[r, found] = True
    false = has[~toxic].sum(axis=0)
    has = has[toxic]
    true = has.sum(axis=0)
    length = np.array([len(t) for t in terms])
    picked, left = [], np.ones(len(has), bool)
    while left.any():
        gain = has[left].sum(axis=0) - CLEAN_COST * false
        top = gain.max(initial=0)
        if top < SUPPORT:
            break
        best = max(np.flatnonzero(gain == top), key=lambda i: (length[i], terms[i]))
        picked.append(best)
        left &= ~has[:, best]
    kinds = np.array([k for t, _, k in rows if t])
    least = max(OWN_LEAST, OWN_SHARE * len(np.unique(kinds)))
    own = {i: len(np.unique(kinds[has[:, i]])) for i in np.flatnonzero((false == 0) & (true >= least))}
    for i in sorted(own, key=lambda i: (-own[i], -length[i], terms[i])):
        if own[i] >= least and not any(terms[i].startswith(terms[j].rstrip()) or terms[j].startswith(terms[i]) for j in picked):
            alike = [j for j in own if terms[j].startswith(terms[i].rstrip()) and own[j] >= 0.95 * own[i]]
            picked.append(max(alike, key=lambda j: (length[j], terms[j])))  # the longest that finds the same
    odds = {i: (true[i] + 0.5) / (len(has) + 1) / ((false[i] + 0.5) / (len(rows) - len(has) + 1)) for i in picked}
    return [(terms[i], math.log(odds[i])) for i in picked if odds[i] > 1]


def _curve(x: np.ndarray, toxic: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (toxic - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from labelled rows of ``docs`` that are not held out; at most about ``LABELLED`` rows, drawn by a hash.

    Rows without text, doc_id or label, and copies of a text, teach nothing (more than once).  Without toxic rows the lexicon is empty.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    # Copies of a label and labels without a text do not count among the rows to draw from.
    marked = marked.where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    worded = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("label_id"))
    marked = settle(marked.join(worded, "label_id", "left_semi"))
    share = min(1.0, LABELLED / max(1, marked.count()))
    drawn = marked.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").where("text IS NOT NULL").join(F.broadcast(drawn), "label_id")
    rows = settle(texts.groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    counts = rows.mapInArrow(_counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    gain = F.col("toxic") - CLEAN_COST * F.col("clean")
    candidates = [r["term"] for r in counts.where(gain >= SUPPORT).orderBy(gain.desc(), F.length("term").desc(), "term").limit(CANDIDATES).collect()]
    schema = "toxic int, terms array<int>, phrases array<string>, x double, y double, kind long"
    every = Lexicon(tuple((t, 0.0) for t in candidates))
    cover = rows.mapInArrow(lambda it: _found(it, every), schema).select("toxic", "terms", "kind").collect() if candidates else []
    lexicon = Lexicon(tuple(_chosen(candidates, [(r["toxic"], r["terms"], r["kind"]) for r in cover])))
    if not lexicon.terms:
        return Lexicon((), (), (-4.0, 0.0, 0.0))
    phrases = rows.mapInArrow(lambda it: _found(it, lexicon), schema).select("toxic", F.explode("phrases").alias("phrase"))
    spared = phrases.groupBy("phrase").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).where(f"bad = 0 AND good >= {SUPPORT}")
    spared = tuple(r["phrase"] for r in spared.orderBy(F.desc("good"), "phrase").limit(CANDIDATES).collect())
    lexicon = Lexicon(lexicon.terms, spared)
    seen = rows.mapInArrow(lambda it: _found(it, lexicon), schema).select("toxic", "x", "y").collect()
    curve = _curve(np.array([(r["x"], r["y"]) for r in seen]), np.array([float(r["toxic"]) for r in seen]))
    return Lexicon(lexicon.terms, spared, curve)


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in _held(batches):
        scores = [score(t, lexicon) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score_all(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text; others are ignored).

    The score is a function of the text alone; null and empty texts have that of no finding.  Rows that repeat score alike.  A row
    without doc_id counts as not held out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _scored(it, lexicon), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` without the rows whose text scores at or above the threshold; all columns stay."""

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array([score(t.as_py(), lexicon) for t in texts], pa.float64())

    return docs.where(toxicity(F.col("text")) < THRESHOLD)
