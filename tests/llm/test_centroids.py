"""Clustering against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random

from opsloom.llm import catalog, centroids


def plain(rows, dimensions=64, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(256 * x) <= centroids.LARGEST for x in v)]
    now = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        now = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(now)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in catalog.op12_centroids(spark, sf).collect()]
    assert sorted(got, key=repr) == plain(rows)


def clustered(spark, rows, schema="vec_id long, embedding array<double>, cluster string", **more):
    made, found = centroids.cluster(spark.createDataFrame([(*r, "x") for r in rows], schema), **more)
    return sorted((tuple(r[c] for c in COLUMNS) for r in centroids.with_inertia(made, found).collect()), key=repr)


def test_odd_vectors(spark):
    """Nulls, infinities, wrong lengths, huge components, copies and repeated ids; blocks that do not divide the dimensions; many chunks."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, 0.25, 3.0, 100.7, -0.001]) for _ in range(5)]) for i in range(60)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])] + [(100 + i, rows[0][1]) for i in range(40)]
    bad = [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0] * 6), (904, [None] + [1.0] * 4), (905, [math.nan] + [1.0] * 4), (906, [math.inf] + [1.0] * 4), (907, [1e300] + [1.0] * 4)]
    large = [(950 + i, [524288.0 * s, -524288.0, 524288.0, 0.5, 524287.99]) for i, s in enumerate((1, -1))]
    assert clustered(spark, rows + bad + large, dimensions=5, centroids=6, rounds=3, chunk_rows=7) == plain(rows + bad + large, 5, 6, 3)


def test_few_or_no_vectors(spark):
    assert clustered(spark, []) == []
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0])]
    assert clustered(spark, rows, dimensions=2) == plain(rows, 2)
