"""Codebooks, whitening and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from larder.llm import codebooks, repeats, whitening

VECTORS = "vec_id long, embedding array<float>, label int, id string, code string, x string, dim string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c", None) for i, v, label in rows], VECTORS)


def f32(v):
    return [float(np.float32(x)) for x in v]


def cloud(n=700, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(5 * i + 3), f32(rng.standard_normal(dim) * np.linspace(1, 3, dim)), int(i % 3) if i % 7 else None) for i in range(n)]
    rows += [rows[4], rows[4], (rows[5][0], rows[6][1], 2), (None, rows[7][1], 1), (None, f32(rng.standard_normal(dim)), None), (1_000_000, [0.0] * dim, 1)]
    return rows


def odd():
    nan, inf = float("nan"), float("inf")
    return [(9000, None, 1), (9001, [1.0, None], 1), (9002, [nan] * 16, 1), (9003, [inf] + [1.0] * 15, 2), (9004, [1.0, -inf], None)]


def brute_codes(rows, rounds):
    """Plain integers, one vector length."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(kept[0][1]) if kept else 0
    ends = [p * dim // 8 for p in range(9)]
    first = {}
    for i, x, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        first.setdefault(i, x)
    seeds = list(first.values())[:16]
    books = [[x[a:b] for x in seeds] for a, b in zip(ends, ends[1:], strict=False)]

    def nearest(p, x):
        mine = x[ends[p] : ends[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(mine, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        assigned = [[nearest(p, x)[1] for p in range(8)] for _, x, _ in kept]
        for p in range(8):
            new = []
            for k, entry in enumerate(books[p]):
                mine = [x[ends[p] : ends[p + 1]] for (_, x, _), a in zip(kept, assigned, strict=True) if a[p] == k]
                new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else entry)
            books[p] = new
    name = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    found = [(i, label, [nearest(p, x) for p in range(8)]) for i, x, label in kept]
    by_label = {}
    for _, label, parts in found:
        by_label[label] = by_label.get(label, 0) + sum(d for d, _ in parts)
    return sorted(((i is None, i or 0), "".join(f"{k:02x}" for _, k in parts), sum(d for d, _ in parts), by_label[label], name) for i, label, parts in found)


def coded(df):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("dim", "block"), [(16, 4096), (16, 64), (11, 100), (5, 4096)])
def test_codes_equal_plain_clustering(spark, monkeypatch, dim, block):
    monkeypatch.setattr(codebooks, "BLOCK", block)
    rows = [(i, v, label) for i, v, label in cloud(dim=dim)] + odd()
    assert coded(codebooks.compress(vectors(spark, rows).repartition(5), rounds=3)) == brute_codes(rows, 3)


def test_codes_of_few_and_no_rows(spark):
    assert codebooks.compress(vectors(spark, [])).count() == 0
    assert codebooks.compress(vectors(spark, odd())).count() == 0
    few = cloud()[:3]
    assert coded(codebooks.compress(vectors(spark, few))) == brute_codes(few, 6)
    same = [(i, [0.25] * 16, None) for i in range(40)]
    assert coded(codebooks.compress(vectors(spark, same))) == brute_codes(same, 6)
    assert [(r["code"], r["error"]) for r in codebooks.compress(vectors(spark, [(1, [], 1), (2, [], None)])).collect()] == [("00" * 8, 0)] * 2


def test_codes_of_each_vector_length_by_itself(spark):
    a, b = cloud(n=60, dim=16), cloud(n=50, dim=24, seed=9)
    assert coded(codebooks.compress(vectors(spark, a + b).select("vec_id", "embedding"))) != []
    got = codebooks.encode(blocks := codebooks.blocks_of(vectors(spark, a + b)), codebooks.train(blocks)).collect()
    both = [r[:3] for r in brute_codes(a, 6) + brute_codes(b, 6)]
    assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["code"], r["error"]) for r in got) == sorted(both)


def test_extreme_components_stay_within_the_stated_size(spark):
    rows = [(1, [3.0e38] * 16, 1), (2, [-3.0e38] * 16, 1), (3, [1e-40] * 16, 1)]
    got = {r["vec_id"]: r for r in codebooks.compress(vectors(spark, rows), rounds=1).collect()}
    assert {got[i]["error"] for i in got} == {0}
    whitening.whiten(vectors(spark, rows)).collect()


def test_label_sums_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = cloud(n=90)
    expected = coded(codebooks.compress(vectors(spark, rows)))
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", 1)
    assert coded(codebooks.compress(vectors(spark, rows))) == expected


def plain_whitening(rows):
    x = [[math.floor(256 * c) for c in v] for _, v, _ in rows]
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, sums = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * c - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, deviation, (np.array(x) - sums / n) @ v / np.sqrt(np.maximum(e, 1e-300)), e / e.sum()


@pytest.mark.parametrize("spread", [1.0, 1e4])
def test_whitening_equals_eigenvectors_of_the_covariance(spark, monkeypatch, spread):
    monkeypatch.setattr(whitening, "ROWS", 100)
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((12, 12)) * np.geomspace(spread, 1, 12)
    rows = [(i, f32(mix @ rng.standard_normal(12) + 50), 1) for i in range(500)]
    rows += [rows[3], (None, rows[4][1], 2), (7, rows[9][1], 2)]
    n, deviation, white, explained = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows + odd()).repartition(4)).collect()
    assert len(got) == 4 * len(rows)
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    expected = sorted((i is None, i or 0, d, k + 1) for (i, _, _), d in zip(rows, deviation, strict=True) for k in range(4))
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"]), r["component"]) for r in got) == expected
    for k in range(4):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        theirs = {i: w for (i, _, _), w in zip(rows, white[:, k], strict=True)}
        ids = [i for i in mine if i not in (None, 7)]
        sign = np.sign(sum(mine[i] * theirs[i] for i in ids))
        assert np.allclose([mine[i] for i in ids], [sign * theirs[i] for i in ids], atol=1e-7)
        assert all(r["explained"] == pytest.approx(explained[k], rel=1e-9) for r in got if r["component"] == k + 1)


def test_whitening_of_rows_that_span_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, odd() + [(1, [], 1), (2, [1.0] * 6, 1), (3, [1.0] * 6, 1)])).count() == 0
    rng = np.random.default_rng(2)
    plane = [(i, f32([a, b, a, 0.0, 0.0, 0.0]), 1) for i, (a, b) in enumerate(rng.integers(-40, 40, (200, 2)) / 4)]
    got = whitening.whiten(vectors(spark, plane)).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_deviations_are_exact_beyond_64_bits():
    fit = whitening.Fit(10**9, [3 * 10**12, -(10**13)])
    assert whitening.deviations(np.array([[2**30, -5], [0, 2**31]]), fit) == [(10**9 * 2**30 - 3 * 10**12) ** 2 + (-5 * 10**9 + 10**13) ** 2, (3 * 10**12) ** 2 + (10**9 * 2**31 + 10**13) ** 2]


DOCS = "doc_id long, text string, anchor string, version string, starts string, _doc int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", 1) for i, t in rows], DOCS)


def brute_repeats(rows, window):
    texts = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    first = {}
    for i, w in texts:
        for k in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    say = lambda n, m=400: " ".join(f"w{rng.randrange(m)}é" for _ in range(n))
    passage, other, line = say(130), say(60), "all rights are reserved by nobody at all "
    rows = [(10 * i, f"{say(rng.randrange(5, 90))} {passage} {say(rng.randrange(0, 70))}") for i in range(30, 0, -1)]
    rows += [(1000 + i, f"{say(30)} {' '.join(passage.split()[i : i + 49 + i % 3])} {say(30)}") for i in range(20)]
    rows += [(2000 + i, f"{say(40)}\n{other}\t{say(20)} {other} {say(3)}") for i in range(5)]
    whole = say(300)
    rows += [(3000 + i, whole) for i in range(40)] + [(5, whole.replace(" ", "\x0b \x0c"))]
    rows += [(4000 + i, line * (20 + i) + say(10)) for i in range(8)]
    rows += [(5000 + i, "same " * (200 + 10 * i)) for i in range(4)]
    rows += [(6000, None), (6001, ""), (6002, " \t\n"), (6003, say(49)), (6004, say(50)), (None, whole), (None, passage), (6005, say(30_000, 10**6))]
    rows += [(6006, rows[-1][1]), (3001, whole), (3001, passage), (3001, whole + " " + other), (6007, passage.replace("w", "W")), (6008, passage.replace(" ", " "))]
    return rows


@pytest.mark.parametrize(("members", "words"), [(4096, 500_000), (6, 2_000), (0, 500)])
def test_repeats_equal_brute_force(spark, monkeypatch, members, words):
    monkeypatch.setattr(repeats, "MEMBERS", members)
    monkeypatch.setattr(repeats, "WORDS", words)
    rows = corpus()
    got = repeats.digests(documents(spark, rows).repartition(7)).collect()
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    expected = brute_repeats(rows, 50)
    assert found == expected
    assert sum(r[2] for r in expected) > 10_000


def test_spans_are_maximal_and_kept_words_are_the_rest(spark):
    rows = [(1, " ".join(map(str, range(200)))), (2, "a b " + " ".join(map(str, range(20, 130))) + " c"), (3, "x")]
    got = {r["doc_id"]: r for r in repeats.drop_repeats(documents(spark, rows)).collect()}
    assert [tuple(s) for s in got[2]["spans"]] == [(2, 112)]
    assert (got[2]["kept"], got[1]["spans"], got[3]["kept"]) == ("a b c", [], "x")
    assert repeats.digests(documents(spark, [])).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 5, (2, 300)).astype(np.uint64)
    b[100:180] = a[40:120]
    (low_a, at_a), (low_b, at_b) = repeats.anchors(a, 50, 8), repeats.anchors(b, 50, 8)
    assert len(low_a) == 251
    assert (low_a[40:71] == low_b[100:131]).all()
    assert (at_a[40:71] - 40 == at_b[100:131] - 100).all()
