"""Vector codes and centroid clustering against plain rounds over Python integers."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from tabprep.llm import active_codes, heap_centroids, vector_blocks
from tests.oracle import compare, connect

INF, NAN = float("inf"), float("nan")
FIELDS = "vec_id long, embedding array<float>, label int, id string, vector long, change long"


def whole(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def nearest(point, entries):
    far = [sum((a - b) ** 2 for a, b in zip(point, e, strict=True)) for e in entries]
    return min(range(len(far)), key=lambda k: (far[k], k)), min(far)


def lloyd(points, entries, rounds):
    for _ in range(rounds):
        codes = [nearest(p, entries)[0] for p in points]
        for k in range(len(entries)):
            mine = [p for p, c in zip(points, codes, strict=True) if c == k]
            if mine:
                entries[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return entries, [nearest(p, entries) for p in points]


def table(spark, vectors, ids=None, parts=3):
    rows = [((k if ids is None else ids[k]), v, None if k % 5 == 0 else k % 3, "x", k, None) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, FIELDS).repartition(parts), rows


def odd_vectors(rng, n, dimension):
    """Clumps with many equal vectors and ties, and rows that must be left out."""
    centres = rng.integers(-3, 4, (6, dimension))
    out = [(centres[rng.integers(6)] + rng.integers(-1, 2, dimension)).astype(float).tolist() for _ in range(n)]
    out += [out[0], out[0], [0.25] * dimension, None, [], [1.0] * (dimension + 4), [None] + [1.0] * (dimension - 1),
            [NAN] * dimension, [INF] * dimension, [-INF] + [0.5] * (dimension - 1)]
    return out


def kept(vector, dimension):
    return vector is not None and len(vector) == dimension and all(x is not None and math.isfinite(x) for x in vector)


@pytest.mark.parametrize("entries, rounds", [(7, 4), (3, 1), (256, 2)])
def test_codes(spark, entries, rounds):
    rng = np.random.default_rng(entries)
    vectors = odd_vectors(rng, 90, 8)
    df, rows = table(spark, vectors)
    got = active_codes.compress(df, entries=entries, rounds=rounds, scale=2).collect()
    good = [(r[0], whole(r[1], 2), r[2]) for r in rows if kept(r[1], 8)]
    books, coded = [], []
    for p in range(4):
        points = [v[2 * p:2 * p + 2] for _, v, _ in good]
        book, each = lloyd(points, [list(x) for x in points[:entries]], rounds)
        books += [str(x) for e in book for x in e]
        coded.append(each)
    errors = [sum(coded[p][k][1] for p in range(4)) for k in range(len(good))]
    by_label = Counter()
    for (_, _, label), e in zip(good, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(books).encode()).hexdigest()
    want = {(i, "".join(f"{coded[p][k][0]:02x}" for p in range(4)), errors[k], label, by_label[label], digest)
            for k, (i, _, label) in enumerate(good)}
    assert {tuple(r) for r in got} == want and len(got) == len(good)


def test_codes_of_repeated_and_null_ids(spark):
    vectors = [[float(k % 4), float(k % 3), 1.0, -float(k)] for k in range(30)]
    df, _ = table(spark, vectors, [None if k % 7 == 0 else k // 2 for k in range(30)])
    got = active_codes.compress(df, entries=5, rounds=2, scale=1).collect()
    assert Counter(r.vec_id for r in got) == Counter(None if k % 7 == 0 else k // 2 for k in range(30))
    assert sum(r.error for r in got) == sum({r.label: r.label_error for r in got}.values())
    again = active_codes.compress(df.repartition(5), entries=5, rounds=2, scale=1).collect()
    assert Counter(got) == Counter(again)
    assert active_codes.compress(df.where("vec_id < 0")).collect() == []
    assert active_codes.compress(df.where("vec_id is null").drop("label"), label="id", entries=2).count() == 5


def test_active_entries_equal_a_full_scan():
    rng = np.random.default_rng(1)
    for _ in range(50):
        points, entries = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (20, 3))
        code, far = active_codes.nearest_entries(points, entries)
        moved = rng.random(20) < rng.choice([0, 0.2, 1])
        entries = entries + moved[:, None] * rng.integers(-1, 2, (20, 3))
        for got, want in zip(active_codes.active_entries(points, entries, moved, code, far),
                             active_codes.nearest_entries(points, entries), strict=True):
            assert np.array_equal(got, want)


def test_distances_are_exact_beyond_doubles():
    points = np.array([[2**27 + 1, -2**27], [0, 3]])
    far = vector_blocks.squared_distances(points, points[::-1].copy())
    assert far.tolist() == [[(2**27 + 1) ** 2 + (2**27 + 3) ** 2, 0], [0, (2**27 + 1) ** 2 + (2**27 + 3) ** 2]]
    with pytest.raises(OverflowError):
        vector_blocks.squared_distances(np.full((1, 8), 2**31), np.zeros((1, 8), np.int64))


@pytest.mark.parametrize("clusters, rounds", [(6, 5), (1, 2), (200, 2), (2, 0)])
def test_clusters(spark, clusters, rounds):
    vectors = odd_vectors(np.random.default_rng(clusters), 120, 4)
    df, rows = table(spark, vectors)
    got = heap_centroids.cluster_vectors(df, dimension=4, clusters=clusters, rounds=rounds, scale=2).collect()
    good = [(r[0], whole(r[1], 2)) for r in rows if kept(r[1], 4)]
    start = sorted(good, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())[:clusters]
    centroids, placed = lloyd([v for _, v in good], [list(v) for _, v in start], rounds)
    sums = Counter()
    for c, d in placed:
        sums[c] += d
    want = {(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for (i, _), (c, d) in zip(good, placed, strict=True)}
    assert {tuple(r) for r in got} == want and len(got) == len(good)


def test_clusters_of_awkward_rows(spark):
    vectors = [[float(k % 4), 0.0, 1.0, 2.0] for k in range(30)]
    df, _ = table(spark, vectors, [None if k % 7 == 0 else k // 2 for k in range(30)])
    got = heap_centroids.cluster_vectors(df, dimension=4, clusters=3).collect()
    assert Counter(r.vec_id for r in got) == Counter(None if k % 7 == 0 else k // 2 for k in range(30))
    assert Counter(got) == Counter(heap_centroids.cluster_vectors(df.repartition(7), dimension=4, clusters=3).collect())
    assert heap_centroids.cluster_vectors(df, dimension=5).collect() == []


def test_heaps_keep_most_vectors_out_of_the_scans(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 20, (10, 4))
    vectors = (centres[rng.integers(0, 10, 3000)] + rng.normal(0, 1, (3000, 4))).tolist()
    df, _ = table(spark, vectors)
    rescans: list[tuple[int, int]] = []
    heap_centroids.cluster_vectors(df, dimension=4, clusters=10, rounds=5, rescans=rescans).count()
    assert rescans[0] == (3000, 3000) and sum(n for n, _ in rescans[2:]) < 0.5 * 4 * 3000


def test_heap_order_survives_storing():
    rng = np.random.default_rng(2)
    cluster, keys = rng.integers(0, 4, 100), rng.random(100)
    heaps = heap_centroids.Heaps.of(cluster, keys, 6)
    raw = heaps.arrays()
    again = heap_centroids.Heaps(np.frombuffer(raw[0], "<f8"), np.frombuffer(raw[1], "<i4"), np.frombuffer(raw[2], "<i4"))
    limits = np.array([0.3, 0.0, 2.0, 0.5, 1.0, 1.0])
    assert again.expired(limits).tolist() == np.flatnonzero(keys <= limits[cluster]).tolist()


@pytest.mark.parametrize("name", ["op12_active_codes", "op13_heap_centroids"])
def test_registered_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry
    folder = "/root/testdata/sf0.001"
    assert compare(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name]) is None
