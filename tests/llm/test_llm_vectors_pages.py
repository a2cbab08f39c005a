"""Operators on vectors and pages, and the pipeline, against brute force."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import caps, minhash, nearest, pieces, secrets, toxicity, warc
from larder.llm.common import scratch

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, filter string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", None) for i, v, label in rows], VECTORS)


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [
        (9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [1.0] * 15 + [None], 1), (9004, [nan] * 16, 1), (9005, [inf] + [1.0] * 15, 1),
        (9006, [1.0, 0.0], 1), (9007, [1.0, 0.0], 1), (9008, [2.0, 0.0], 1), (9009, [3.0], 2), (9010, [-3.0], 2), (None, [1.0] * 16, 1), (9011, [1.0] * 16, None), (9012, [1e-30] * 16, 3),
    ]


def cloud(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = rng.standard_normal(dim)
        out.append((i, base, i % 3))
        if i % 5 == 0:
            out.extend((1000 + 4 * i + k, base + rng.standard_normal(dim) * 0.04 * k, i % 3) for k in range(3))
    return [(int(i), [float(np.float32(x)) for x in v], int(c)) for i, v, c in out]


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, least):
    ok = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and usable(v)]
    comp, links = {r[0]: r[0] for r in rows if r[0] is not None}, dict.fromkeys((r[0] for r in rows), 0)

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a, c in ok:
        for j, b, d in ok:
            if i < j and c == d and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: (links[i], root(i)) for i in comp}


@pytest.mark.parametrize("tile", [caps.TILE, 32])
def test_linked_vectors_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(caps, "TILE", tile)
    hot = np.random.default_rng(8).standard_normal(16)
    near = [(5000 + k, [float(np.float32(x)) for x in hot + 0.02 * np.random.default_rng(k).standard_normal(16)], 1) for k in range(120)]
    copies = [(7000 + k, [float(np.float32(x)) for x in hot], 1) for k in range(60)]
    rows = cloud() + near + copies + odd_vectors()
    expected = brute_links(rows, 0.98)
    got = caps.near_duplicates(vectors(spark, rows), 0.98).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        else:
            assert (r["n_links"], r["component_id"]) == expected[r["vec_id"]], r
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert caps.near_duplicates(vectors(spark, []), 0.98).count() == 0


def uneven_vectors():
    """Pairs a little above the threshold whose energy lies in a part of the components, and vectors of few components."""
    rng = np.random.default_rng(11)
    out = []
    half = np.repeat([1.0, 0.0], 32)
    for kind, (dim, mask) in enumerate([(64, half), (64, half), (64, np.maximum(half, 0.05)), (64, None), (2, np.ones(2)), (3, np.ones(3)), (4, np.ones(4)), (9, np.ones(9))]):
        for k in range(40):
            a = np.eye(64)[rng.integers(64)] if mask is None else rng.standard_normal(dim) * mask
            a = a / np.linalg.norm(a)
            z = rng.standard_normal(dim) * (1 if mask is None else mask)
            z -= (z @ a) * a
            b = 0.981 * a + (1 - 0.981**2) ** 0.5 * z / np.linalg.norm(z)
            out.extend((10_000 * kind + 2 * k + j, [float(np.float32(x)) for x in v], 10 + kind % 4) for j, v in enumerate((a, b)))
    return out


@pytest.mark.parametrize("tile", [caps.TILE, 16])
def test_links_do_not_depend_on_where_the_energy_lies(spark, monkeypatch, tile):
    monkeypatch.setattr(caps, "TILE", tile)
    rows = uneven_vectors()
    expected = brute_links(rows, 0.98)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_duplicates(vectors(spark, rows), 0.98).collect()}
    assert got == expected


def pairs_at(cosine, dim, n, mask=None, seed=1):
    rng = np.random.default_rng([dim, seed])
    a, z = rng.standard_normal((2, n, dim)) * (1 if mask is None else mask)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    return a, cosine * a + (1 - cosine**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)


def lost(a, b, size, tables=caps.TABLES):
    """How many of the pairs share no list."""
    cut = caps.least_product(caps.padded(a.shape[1]), size, 0.98)
    mine, other = ({*(rows * (tables * size * size) + names).tolist()} for rows, names in (caps.by_caps(v, cut, size, tables) for v in (a, b)))
    return len(a) - len({x // (tables * size * size) for x in mine & other})


@pytest.mark.parametrize(("dim", "size"), [(9, 256), (64, 256), (64, 1024), (100, 512)])
def test_caps_lose_as_many_pairs_as_stated(dim, size):
    a, b = pairs_at(0.98, dim, 3000)
    assert 0.25 < lost(a, b, size, 1) / len(a) < 0.35
    assert lost(a, b, size) == 0
    for mask in (np.arange(dim) < dim // 2, np.where(np.arange(dim) < dim // 2, 1.0, 0.05), np.geomspace(1, 1e-3, dim)):
        assert lost(*pairs_at(0.98, dim, 1500, mask), size) == 0


def test_lists_are_all_directions_within_the_cap():
    x = caps.rotated(pairs_at(0.98, 40, 20)[0], 3)
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)
    first, second = caps.products(x, 256)
    rows, names = caps.decoded(first, second, 0.45)
    every = (first[:, :, None] + second[:, None, :] >= 0.45).reshape(len(x), -1)
    assert sorted(zip(rows.tolist(), names.tolist(), strict=True)) == sorted(zip(*(i.tolist() for i in np.nonzero(every)), strict=True))


def test_pairs_compared_grow_as_the_rows_do():
    rng = np.random.default_rng(5)
    share = []
    for n in (8_000, 32_000):
        size = caps.codewords(n)
        unit = rng.standard_normal((n, 64))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        counts = np.unique(caps.by_caps(unit, caps.least_product(64, size, 0.98), size, 2)[1], return_counts=True)[1].astype(float)
        share.append((counts * (counts - 1) / 2).sum() / n)
    assert share[1] < 2 * share[0]  # a fixed code would take four times as many a row


def test_cosines_of_huge_and_tiny_vectors(spark):
    rows = [(k + 10 * j, [x * scale for x in (1.0, 2.0, 3.0 + 0.01 * k, 1.0, 0.5, 4.0, 1.0, 2.0, 1.0, 7.0)], j) for j, scale in enumerate((1e160, 1e-160, 1.0)) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_duplicates(df, 0.98).collect()}
    assert got == {k + 10 * j: (2, 10 * j) for j in range(3) for k in range(3)}


def test_nearest_equal_brute_force(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 300), ("TILE_QUERIES", 20), ("ROWS", 64), ("QUERIES", 8)):
        monkeypatch.setattr(nearest, name, value)
    rows = cloud(3) + [(8000 + 20 * k, [1.0] * 16, 0) for k in range(30)] + odd_vectors()
    rows.append(rows[0])
    df = vectors(spark, rows)
    got = nearest.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {i: np.array(v, float) for i, v, _ in rows if i is not None and usable(v)}
    assert set(found) == {i for i in ok if i % 20 == 0}
    for q, mine in found.items():
        scores = sorted((-sum(x * y for x, y in zip(ok[q].tolist(), v.tolist(), strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:20]
        assert sorted(mine) == [(k + 1, i, pytest.approx(-s, rel=1e-12)) for k, (s, i) in enumerate(scores)]
    assert nearest.nearest(df.limit(0), df.limit(0)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((50, 24)) * 10.0 ** rng.integers(-6, 6, (50, 1)), rng.standard_normal((70, 24))
    q, r = nearest.Codes(a), nearest.Codes(b)
    about = (q.codes @ r.codes.T).astype(float) * q.scale[:, None] * r.scale[None]
    bound = q.error[:, None] * r.norm[None] + q.near[:, None] * r.error[None]
    assert (np.abs(a @ b.T - about) <= bound * (1 + 1e-6) + 1e-12 * q.norm[:, None] * r.norm[None]).all()


PAGES = "page_id long, url string, html string, sha string, size int, kind string"


@pytest.mark.parametrize("dim", [2048, 4096])
def test_bounds_of_long_vectors_hold_and_their_neighbours_are_exact(spark, dim):
    rng = np.random.default_rng(dim)
    whole = rng.integers(120, 128, (400, dim)) * rng.choice([1.0, 1.0, 1.0, -1.0], (400, dim))
    whole[:, 0] = 127
    codes = nearest.Codes(whole)
    every = slice(None)
    about, bound = nearest.estimated(codes, every, codes, every)
    exact = whole.astype(np.int64) @ whole.astype(np.int64).T
    assert (np.abs(about - exact) <= bound).all()
    rows = [(i, v.tolist(), 0) for i, v in enumerate(whole[:200])]
    df = vectors(spark, rows)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()}
    for q in range(0, 200, 20):
        best = sorted((-exact[q, i], i) for i in range(200) if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, float(-s)) for s, i in best]


def test_nearest_of_huge_and_tiny_components(spark):
    rows = [(0, [1e308, 1e308], 0), (1, [-1e308, -1.0], 0), (2, [1.0, 1.0], 0), (3, [1e-320, 1e-320], 0), (20, [1e-320, 0.0], 0), (4, [2.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in sorted(nearest.nearest(df, df.where("vec_id % 20 = 0"), k=3).collect()):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [2, 4, 3], 20: [0, 4, 2]}  # both products with 0 are beyond a double: the smaller id first


def page_rows():
    rows = [(i, f"http://example.org/{i % 7}", f"<p>page {i % 40} {'word ' * (i % 40)}</p>") for i in range(300)]
    return rows + [(400, None, None), (401, "http://x/ü \r\n y", ""), (402, "u", "x" * 300_000), (None, "n", "<p>page 3 word word word </p>"), (5, rows[5][1], rows[5][2]), (None, "m", "only here")]


def test_archives_give_back_what_was_written(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "z", 1, "w") for r in rows], PAGES).repartition(3)
    manifest = warc.write_archives(pages, scratch(spark), archive_bytes=5_000)
    assert manifest.count() > 3
    assert warc.read_archives(manifest).rdd.getNumPartitions() == manifest.count()
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) == manifest.agg(F.sum("records")).first()[0]
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = []
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = first.get(html or "") is not None and first[html or ""] != i
        expected.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[html or ""] if revisit else None, b"" if revisit else body))
    assert sorted(map(str, expected)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]))) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0
    none_below = warc.read_archives(warc.write_archives(pages, scratch(spark), least_bytes=10**9)).collect()
    assert {r["record_type"] for r in none_below} == {"response"}


def one_archive(tmp_path, n=400):
    path = str(tmp_path / "a.warc.zst")
    bodies = [f"<p>{'some text ' * (k % 50)}{k}</p>".encode() for k in range(n)]
    warc.write_archive(path, [warc.record("response", k, "u", len(b), warc.digest(b), b, None) for k, b in enumerate(bodies)])
    return path, bodies


def test_the_dictionary_stands_in_front_and_each_record_in_a_frame(tmp_path):
    path, bodies = one_archive(tmp_path)
    data = open(path, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and size > 0
    shared = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    frame = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
    assert bodies[0] in frame.decompress(data[8 + size :]) and frame.eof
    assert [r["payload"] for r in warc.read_archive(path)] == bodies
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    other = tmp_path / "b.warc.zst"
    other.write_bytes(struct.pack("<II", 0x184D2A5D, len(packed)) + packed + data[8 + size :])
    assert [r["payload"] for r in warc.read_archive(str(other))] == bodies


def test_broken_archives_are_refused(tmp_path):
    path, _ = one_archive(tmp_path, 3)
    data = open(path, "rb").read()
    broken = tmp_path / "c.warc.zst"
    for content in (data[:-5], b"WARC/1.1\r\n\r\n", data[4:], b""):
        broken.write_bytes(content)
        with pytest.raises((warc.WarcError, zstandard.ZstdError)):
            list(warc.read_archive(str(broken)))
    good = warc.record("response", 1, "u", 3, warc.digest(b"abc"), b"abc", None)
    for bad in (good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9"), good[:-2], good.replace(b"WARC-Date", b"Date"), good.replace(b"Length: 3", b"Length: 4")):
        with pytest.raises(warc.WarcError):
            warc.parsed(bad)


def test_pipeline_stages_take_effect(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(words) + str(rng.integers(90)) for _ in range(n))
    rows = [(i, text(40), "en", f"s{i % 3}") for i in range(240)]
    for i in range(0, 240, 8):
        rows[i] = (i, rows[i][1] + " idiot", "en", rows[i][3])
    rows += [(500 + i, rows[i + 1][1] + " more", "en", "s0") for i in range(0, 40, 8)] + [(600, "password = hunter2222", "en", "s1"), (601, None, None, None), (602, "", "en", "s0")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixture", "sentencepiece"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "sentencepiece" or docs.columns == columns
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    toxic = set(range(0, 240, 8))
    assert ids("toxicity") == {r[0] for r in rows} - toxic
    assert ids("near_duplicates") == ids("toxicity") - {500 + i for i in range(0, 40, 8)}
    assert {r["doc_id"]: r["text"] for r in seen["secrets"]}[600] == "[REDACTED]"
    assert sorted(len(r["text"] or "") for r in seen["secrets"] if r["doc_id"] != 600) == sorted(len(r["text"] or "") for r in seen["near_duplicates"] if r["doc_id"] != 600)
    assert ids("mixture") <= ids("secrets") and len(seen["mixture"]) == len(seen["sentencepiece"])
    whole = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(str, seen["sentencepiece"]))
    assert corpus_pipeline.ORACLE_SQL is None and {toxicity, minhash, secrets, pieces}
