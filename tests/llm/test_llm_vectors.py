import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import same
from pipewright.llm import clusters, negatives
from pipewright.llm.common import dropped
from pipewright.llm.vectors import rows

DIM = 6


def vectors(n=400, seed=3, spread=1.0, groups=8):
    """Rows with copies, ties, a common vector, a third in one label, odd ids and vectors that take no part."""
    rng = random.Random(seed)
    heart = [[rng.gauss(0, 1) for _ in range(DIM)] for _ in range(groups)]
    out = []
    for i in range(n):
        c = heart[rng.randrange(groups)]
        v = [x + rng.gauss(0, 0.1 * spread) for x in c]
        out.append((i, v if i % 9 else heart[0], 0 if i % 3 == 0 else rng.randrange(10)))
    out += [out[50], out[100], (None, out[7][1], 4), (None, None, 4), (n, None, 1), (n + 50, [], 1), (n + 100, [1.0] * (DIM - 1), 1)]
    out += [(n + 150, [None] + [0.0] * (DIM - 1), 2), (n + 200, [float("nan")] + [0.0] * (DIM - 1), 2), (n + 250, [float("inf")] * DIM, 2), (n + 300, [1e30] * DIM, 2), (-50, out[3][1], 3), (n + 7, out[5][1], None)]
    return out


def table(spark, some):
    df = spark.createDataFrame(some, "vec_id bigint, embedding array<float>, label int")
    return df.withColumn("x", F.lit("mine")).withColumn("uid", F.lit(7)).withColumn("cluster", F.lit(1.5)).repartition(3)


def whole(some):
    single = lambda v: [float(np.float32(x)) if x is not None else None for x in v]
    good = [(i, single(v), lab) for i, v, lab in some if v is not None and len(v) == DIM]
    good = [r for r in good if all(x is not None and np.isfinite(x) and abs(x) < 2**19 for x in r[1])]
    return [(i, [int(np.floor(256 * x)) for x in v], lab) for i, v, lab in good]


# clustering

def brute_clusters(some, k, rounds, seed):
    v = [(i, x) for i, x, _ in whole(some)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in v if i is not None)
    centre = [x for _, x in named[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in v]
        for c in range(len(centre)):
            own = [x for (_, x), o in zip(v, of) if o == c]
            if own:
                centre[c] = [sum(col) // len(own) for col in zip(*own)]
    last = [near(x) for _, x in v]
    inertia = {c: sum(d for d, o in last if o == c) for c in range(len(centre))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return [(i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(v, last)]


@pytest.mark.parametrize("k,rounds", [(12, 5), (40, 2), (1, 1), (1000, 1)])
def test_clusters_like_brute_force(spark, k, rounds):
    some = vectors()
    got = clusters.cluster(table(spark, some), k=k, rounds=rounds, dim=DIM)
    same([tuple(r) for r in got.collect()], brute_clusters(some, k, rounds, 2))


def test_clusters_of_odd_tables(spark):
    nothing = table(spark, vectors(120)).where("false")
    got = clusters.cluster(nothing, dim=DIM)
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clusters.cluster(table(spark, [(None, [0.5] * DIM, 1)]), dim=DIM).count() == 0
    one = clusters.cluster(table(spark, [(4, [0.5] * DIM, None)] * 3), dim=DIM).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in one} == {(0, 0, 0)} and len(one) == 3


def test_search_is_exact_and_passes_centroids_over():
    rng = np.random.default_rng(1)
    heart = rng.normal(0, 400, (30, 8))
    x = np.floor(heart[rng.integers(0, 30, 3000)] + rng.normal(0, 20, (3000, 8))).astype(np.int64)
    x[::7] = x[0]
    c = np.concatenate([x[:40], x[:3], x[5:6] + 1])  # with equal centroids
    search = clusters.Searcher(c)
    of, distance = search.nearest(x)
    every = np.square(x[:, None] - c[None]).sum(axis=2)
    assert (of == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert search.tried < every.size / 3


# hard negatives

def brute_negatives(some):
    v = [(i, x, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab) for i, x, lab in whole(some) if lab is not None]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for n, (i, x, lab) in enumerate(v):
        if i is None or i % 50:
            continue
        scores = [(dot(x, y), j, other) for m, (j, y, other) in enumerate(v) if m != n]
        for s, j, _ in sorted((t for t in scores if t[2] == lab), key=key)[:5]:
            fit = sorted((t for t in scores if t[2] != lab and 50 * s <= 100 * t[0] <= 95 * s), key=key)[:3]
            out += [(i, j, r + 1, t[1], s, t[0]) for r, t in enumerate(fit)]
    return out


@pytest.mark.parametrize("spread,slab,block", [(1.0, 64, 8), (10.0, 10_000, 16), (0.0, 50, 256)])
def test_negatives_like_brute_force(spark, spread, slab, block):
    some = vectors(700, seed=5, spread=spread)
    got = negatives.mine(table(spark, some), dim=DIM, slab_rows=slab, block_rows=block)
    assert len(brute_negatives(some)) > 30
    same([tuple(r) for r in got.collect()], brute_negatives(some))


def test_negatives_with_large_components(spark):
    some = [(i, [x * 2**17 for x in v] if v and len(v) == DIM and all(x is not None and abs(x) < 10 for x in v) else v, lab) for i, v, lab in vectors(120)]
    assert max(abs(x) for _, v, _ in whole(some) for x in v) > 2**25  # products beyond a double
    same([tuple(r) for r in negatives.mine(table(spark, some), dim=DIM, block_rows=16).collect()], brute_negatives(some))


def test_negatives_of_odd_tables(spark):
    got = negatives.mine(table(spark, vectors(120)).where("false"), dim=DIM)
    assert got.collect() == [] and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert negatives.mine(table(spark, [(0, [1.0] * DIM, 1)]), dim=DIM).count() == 0
    assert negatives.mine(table(spark, [(1, [1.0] * DIM, 1), (2, [1.0] * DIM, 1)]), dim=DIM).count() == 0


def test_curve_visits_each_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = negatives.hilbert(cells, bits)
        assert len(set(place.tolist())) == len(cells)
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_spare_blocks(spark):
    rng = np.random.default_rng(2)
    zone, a = rng.integers(-50, 50, (9, 2, 5)), rng.integers(-50, 50, (7, 5))
    low, high = zone.min(axis=1), zone.max(axis=1)
    least, most = negatives.bounds(a, low, high)
    for z in range(9):
        corner = np.array([[low[z][i] if bit else high[z][i] for i, bit in enumerate(bits)] for bits in itertools.product((0, 1), repeat=5)])
        assert ((a @ corner.T).min(axis=1) == least[:, z]).all() and ((a @ corner.T).max(axis=1) == most[:, z]).all()
    # vectors in clusters: few blocks are chosen
    some = table(spark, vectors(2000, seed=9, spread=0.3, groups=20))
    seen = []
    keep = negatives.dropped
    negatives.dropped = lambda df: seen.append((df, keep)) if "blocks" in df.columns else keep(df)
    try:
        negatives.mine(some, dim=DIM, slab_rows=200, block_rows=10).count()
    finally:
        negatives.dropped = keep
    blocks = -(-rows(some.where("label is not null"), DIM).count() // 10)
    for chosen, _ in seen:
        n, read = chosen.select(F.countDistinct("uid"), F.sum(F.size("blocks"))).first()
        assert read < n * blocks / 2
        dropped(chosen)
