"""Hard negatives by Hilbert-ordered blocks with zone maps.

1. Rows become integer vectors, floor(256 * x), and are ordered along a Hilbert
   curve through the CURVE_DIMS components of greatest variance. Ranges of the curve are
   slabs of at most about SLAB_ROWS rows; a slab is written as Parquet rows of
   BLOCK_ROWS vectors each, its blocks, with the least and greatest value of each
   component: the zone map. Where a block is written, its slab's own anchors
   also look up their best rows of the same label there: a first lower bound.
2. For an anchor a, interval arithmetic over a zone map bounds the inner products with all
   rows of the block: the upper bound adds max(a_i * low_i, a_i * high_i). An
   anchor needs a block for its positives if the upper bound reaches its lower
   bound. Only zone maps are read for that choice, all anchors against all of them, in groups.
3. Blocks that some anchor needs are read, each in the task of its slab, and the
   anchors that need them come by: exact integer products with a block's rows, best
   first; a block whose upper bound has meanwhile fallen below what the anchor holds is
   passed over. A slab sends its best few for each anchor; a window merges the slabs.
4. Each positive's score s gives a window of negative scores, [s/2, 0.95 s].
   Windows choose blocks by both bounds, and 3 is done again for rows of other labels.

Every choice keeps what its bounds can't exclude, so results are exact. How
much is passed over depends on the vectors: much if they lie in clusters, next to
nothing if they point anywhere in many dimensions.

Rows with a null label or a vector that is null, of another length, or has a
null or non-finite component, or one over 2^27 as an integer, take no part.
Rows that repeat a vec_id are rows of their own, and anchors of their own: an
anchor's positives are all but itself. A null vec_id is no anchor, its label isn't
shifted, and it comes last among equal scores. Ties of score and id go by the row's
place in the table. A window whose bounds cross (a negative score) holds
nothing. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipewright.llm.common import dropped, input_parts, saved
from pipewright.llm.vectors import DIM, matrix, rows

POSITIVES, NEGATIVES = 5, 3
CURVE_DIMS, CURVE_BITS = 16, 4
SLAB_ROWS, BLOCK_ROWS = 65_536, 256
#: A small table isn't cut to slabs of fewer rows than this, as each anchor may have to meet each slab.
LEAST_ROWS = 4_096
#: Zone maps held by one task of the choice.
ZONES = 4_096
#: Anchors compared with a block at a time.
_ANCHORS = 256
#: A null vec_id while ids are compared.
_LAST = np.iinfo(np.int64).max
_NONE = -(1 << 62)
BLOCK, ANCHOR = 0, 1
#: kind BLOCK: packed rows and zone map. kind ANCHOR: one anchor; need is its lower bound, place its slab's number.
_PACKED = "kind int, slab int, block int, low binary, high binary, x binary, ids binary, uids binary, labels binary, uid bigint, vec_id bigint, label int, need array<bigint>, upto array<bigint>, blocks array<int>"
_FOUND = "uid bigint, anchor_id bigint, nth int, found_id bigint, found_uid bigint, score bigint"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points (n, dims) of integers under 2**bits, as a signed long in curve order."""
    x = x.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        low = np.uint64((1 << level) - 1)
        for axis in x:
            turned = (axis >> np.uint64(level) & one).astype(bool)
            swap = np.where(turned, np.uint64(0), (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
    for i in range(1, len(x)):  # Gray code over the axes
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> np.uint64(level) & one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << one | axis >> np.uint64(bit) & one
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b["x"], dim)
                f = x.astype(float)
                columns = [np.arange(dim, dtype=np.int32), np.full(dim, len(x)), f.sum(axis=0), np.square(f).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "n", "one", "two", "low", "high"])

    return run


def _placed(axes: np.ndarray, low: np.ndarray, high: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["x"], dim)[:, axes]
            cells = (x - low) * (1 << CURVE_BITS) // (high - low + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert(cells, CURVE_BITS))], names=[*b.schema.names, "place"])

    return run


class _Block:
    """Rows of one block, least (id, uid) first, as numbers whose products are exact."""

    def __init__(self, low, high, x, ids, uids, labels, dim: int, kind: type):
        self.low, self.high = (np.frombuffer(v, "<i4").astype(kind) for v in (low, high))
        self.x = np.frombuffer(x, "<i4").reshape(-1, dim).astype(kind)
        self.ids, self.uids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(uids, "<i8"), np.frombuffer(labels, "<i4")


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each anchor with anything inside each zone."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _best(scores: np.ndarray, b: _Block, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, ids, uids) of the `count` best of each row, changing `scores`; ties by the block's order."""
    n, out = np.arange(len(scores)), []
    for _ in range(min(count, scores.shape[1])):
        at = scores.argmax(axis=1)
        out.append((scores[n, at].astype(np.int64), b.ids[at], b.uids[at]))
        scores[n, at] = _NONE
    return tuple(np.stack(c, axis=1) for c in zip(*out))


def _merged(held: list[np.ndarray], new: tuple[np.ndarray, ...], count: int) -> list[np.ndarray]:
    s, i, u = (np.concatenate(c, axis=1) for c in zip(held, new))
    by = np.lexsort((u, i, -s), axis=-1)[:, :count]
    return [np.take_along_axis(c, by, axis=1) for c in (s, i, u)]


class _Anchors:
    """Anchors that pass a slab's blocks, with the best found so far for each of their windows."""

    def __init__(self, x: np.ndarray, uids: np.ndarray, labels: np.ndarray, need: np.ndarray, upto: np.ndarray | None, count: int):
        self.x, self.uids, self.labels, self.need, self.upto, self.count = x, uids, labels, need, upto, count
        n, windows = need.shape
        self.held = [[np.full((n, count), v, np.int64) for v in (_NONE, _LAST, _LAST)] for _ in range(windows)]

    def read(self, b: _Block, wanted: np.ndarray) -> None:
        least, most = bounds(self.x, b.low[None], b.high[None])
        at_least = np.stack([np.maximum(self.need[:, w], h[0][:, -1]) for w, h in enumerate(self.held)], axis=1)
        live = wanted & (most >= at_least).any(axis=1)
        if self.upto is not None:
            live &= (least <= self.upto).any(axis=1)
        rows = np.flatnonzero(live)
        if not len(rows):
            return
        scores = self.x[rows] @ b.x.T
        same = self.labels[rows, None] == b.labels[None]
        if self.upto is None:
            scores[~same | (self.uids[rows, None] == b.uids[None])] = _NONE
            scores[scores < self.need[rows]] = _NONE
            self._keep(0, rows, scores, b)
            return
        scores[same] = _NONE
        top, low = scores.max(axis=1), at_least[rows]
        for w in range(self.need.shape[1]):
            some = np.flatnonzero((top >= low[:, w]) & (self.need[rows, w] <= self.upto[rows, w]))
            if len(some):
                part = scores[some]
                part[(part > self.upto[rows[some], w, None]) | (part < low[some, w, None])] = _NONE
                self._keep(w, rows[some], part, b)

    def _keep(self, w: int, rows: np.ndarray, scores: np.ndarray, b: _Block) -> None:
        any_ = np.flatnonzero(scores.max(axis=1) > _NONE)
        if len(any_):
            rows = rows[any_]
            merged = _merged([h[rows] for h in self.held[w]], _best(scores[any_], b, self.count), self.count)
            for h, m in zip(self.held[w], merged):
                h[rows] = m

    def found(self, vec_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for w, (s, i, u) in enumerate(self.held):
            r, c = np.nonzero(s > _NONE)
            ids = i[r, c]
            columns = [pa.array(self.uids[r]), pa.array(vec_ids[r]), pa.array(np.full(len(r), w, np.int32)), pa.array(ids, mask=ids == _LAST), pa.array(u[r, c]), pa.array(s[r, c])]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _FOUND.split(", ")])


def _rows(n: int, **columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[f], types[t]) if f in columns else pa.nulls(n, types[t]) for f, t in fields], names=[f for f, _ in fields])


def _written(dim: int, kind: type, every: int, positives: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slab, got = TaskContext.get().partitionId(), list(batches)  # a range of about SLAB_ROWS rows
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got).combine_chunks()
        x, uids, labels = matrix(t["x"], dim), t["uid"].to_numpy(), t["label"].to_numpy()
        null = t["vec_id"].is_null().to_numpy()
        ids = np.where(null, _LAST, t["vec_id"].fill_null(0).to_numpy())
        blocks = []
        for n, at in enumerate(range(0, len(x), block_rows)):
            own = np.arange(at, min(at + block_rows, len(x)))
            own = own[np.lexsort((uids[own], ids[own]))]
            packed = {"low": x[own].min(axis=0).astype("<i4").tobytes(), "high": x[own].max(axis=0).astype("<i4").tobytes(), "x": x[own].astype("<i4").tobytes(), "ids": ids[own].astype("<i8").tobytes(), "uids": uids[own].astype("<i8").tobytes(), "labels": labels[own].astype("<i4").tobytes()}
            blocks.append(_Block(**packed, dim=dim, kind=kind))
            yield _rows(1, kind=[BLOCK], slab=[slab], block=[n], **{k: [v] for k, v in packed.items()})
        chosen = np.flatnonzero(~null & (ids % every == 0))
        for at in range(0, len(chosen), _ANCHORS):
            own = chosen[at : at + _ANCHORS]
            some = _Anchors(x[own].astype(kind), uids[own], labels[own], np.full((len(own), 1), _NONE), None, positives)
            for b in blocks:
                some.read(b, np.ones(len(own), bool))
            need = some.held[0][0][:, -1:]
            yield _rows(len(own), kind=np.full(len(own), ANCHOR, np.int32), x=[r.astype("<i4").tobytes() for r in x[own]], uid=uids[own], vec_id=ids[own], label=labels[own].astype(np.int32), need=need.tolist())

    return run


def _chosen(dim: int, kind: type):
    """Zone maps, then anchors, of one group after the other -> anchors for each slab with the blocks they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, zones, table = None, [], None
        for b in batches:
            groups, kinds = b["zone_group"].to_numpy(), b["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(groups) != 0) | (np.diff(kinds) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows] if b.num_rows else []):
                part = b.slice(a, z - a)
                if groups[a] != group:
                    group, zones, table = groups[a], [], None
                if kinds[a] == BLOCK:
                    zones.append(part)
                    continue
                if not zones:
                    continue
                if table is None:
                    t = pa.Table.from_batches(zones)
                    low, high = (np.frombuffer(b"".join(t[c].to_pylist()), "<i4").reshape(-1, dim).astype(kind) for c in ("low", "high"))
                    slabs, numbers = t["slab"].to_numpy(), t["block"].to_numpy()
                    by = np.lexsort((numbers, slabs))
                    low, high, slabs, numbers = low[by], high[by], slabs[by], numbers[by]
                    table = low, high, numbers, np.unique(slabs), np.searchsorted(slabs, np.unique(slabs))
                yield from _needed(part, *table, dim, kind)

    return run


def _needed(part: pa.RecordBatch, low, high, numbers, slabs, first, dim: int, kind: type) -> Iterator[pa.RecordBatch]:
    ends = np.append(first[1:], len(numbers))
    for at in range(0, part.num_rows, _ANCHORS):
        some = part.slice(at, _ANCHORS)
        least, most = bounds(np.frombuffer(b"".join(some["x"].to_pylist()), "<i4").reshape(-1, dim).astype(kind), low, high)
        need, upto = _windows(some["need"]), _windows(some["upto"])
        want = np.zeros(most.shape, bool)
        for w in range(need.shape[1]):
            inside = most >= need[:, w, None]
            want |= inside if upto is None else inside & (least <= upto[:, w, None]) & (need[:, w, None] <= upto[:, w, None])
        for slab, a, z in zip(slabs.tolist(), first.tolist(), ends.tolist()):
            rows = np.flatnonzero(want[:, a:z].any(axis=1))
            if len(rows):
                kept = some.take(pa.array(rows))
                yield _rows(len(rows), kind=np.full(len(rows), ANCHOR, np.int32), slab=np.full(len(rows), slab, np.int32), blocks=[numbers[a:z][r] for r in want[rows, a:z]], **{c: kept[c] for c in ("x", "uid", "vec_id", "label", "need", "upto")})


def _windows(column: pa.Array) -> np.ndarray | None:
    """Lists of one length as a matrix; missing windows at the end never hold anything. None if all are null."""
    if column.null_count == len(column):
        return None
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=1)), _NONE, np.int64)
    for r, v in enumerate(lists):
        out[r, : len(v)] = v
    return out


def _scored(dim: int, kind: type, count: int):
    """The needed blocks of a slab, then the anchors that need some of them -> each anchor's best there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, blocks = None, {}
        for b in batches:
            slabs, kinds = b["slab"].to_numpy(), b["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(slabs) != 0) | (np.diff(kinds) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows] if b.num_rows else []):
                part = b.slice(a, z - a)
                if slabs[a] != slab:
                    slab, blocks = slabs[a], {}
                if kinds[a] == BLOCK:
                    for r in part.select(["block", "low", "high", "x", "ids", "uids", "labels"]).to_pylist():
                        number = r.pop("block")
                        blocks[number] = _Block(**r, dim=dim, kind=kind)
                    continue
                for at in range(0, part.num_rows, _ANCHORS):
                    some = part.slice(at, _ANCHORS)
                    x = np.frombuffer(b"".join(some["x"].to_pylist()), "<i4").reshape(-1, dim).astype(kind)
                    need, upto = _windows(some["need"]), _windows(some["upto"])
                    if upto is not None:  # a window that isn't there begins after its end
                        need = np.where(upto == _NONE, -_NONE, need)
                    anchors = _Anchors(x, some["uid"].to_numpy(), some["label"].to_numpy(), need, upto, count)
                    want = {}
                    for i, numbers in enumerate(some["blocks"].to_pylist()):
                        for n in numbers:
                            want.setdefault(n, np.zeros(len(x), bool))[i] = True
                    for n in sorted(want):
                        anchors.read(blocks[n], want[n])
                    yield from anchors.found(some["vec_id"].to_numpy())

    return run


def _searched(blocks: DataFrame, anchors: DataFrame, dim: int, kind: type, count: int, parts: int, many: int, note: str) -> DataFrame:
    """The best `count` rows of each anchor and window, with `rank` from 1."""
    groups = max(1, -(-many // ZONES))
    names = [f.split()[0] for f in _PACKED.split(", ")]
    # a group of zone maps is met by a share of the anchors in each of `shares` tasks
    shares = max(1, parts // groups)
    key = lambda group, share: (group * shares + share).cast("int").alias("zone_group")
    zones = blocks.select("kind", "slab", "block", "low", "high").withColumn("_g", F.pmod(F.xxhash64("slab", "block"), F.lit(groups)))
    zones = zones.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_s")).select(key(F.col("_g"), F.col("_s")), "kind", "slab", "block", "low", "high", *[F.lit(None).cast(t).alias(c) for c, t in (("x", "binary"), ("uid", "bigint"), ("vec_id", "bigint"), ("label", "int"), ("need", "array<bigint>"), ("upto", "array<bigint>"))])
    met = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g")).select(
        key(F.col("_g"), F.pmod(F.xxhash64("uid"), F.lit(shares))), F.lit(ANCHOR).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("slab", "int"), ("block", "int"), ("low", "binary"), ("high", "binary"))], "x", "uid", "vec_id", "label", "need", "upto")
    together = zones.unionByName(met).repartition(parts, "zone_group").sortWithinPartitions("zone_group", "kind")
    chosen = saved(together.mapInArrow(_chosen(dim, kind), _PACKED), f"{note}-chosen")
    needed = chosen.select("slab", F.explode("blocks").alias("block")).distinct()
    read = blocks.join(needed, ["slab", "block"], "left_semi").select(*names)
    scored = read.unionByName(chosen).repartition(parts, "slab").sortWithinPartitions("slab", "kind").mapInArrow(_scored(dim, kind, count), _FOUND)
    best = Window.partitionBy("uid", "nth").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_uid")
    out = saved(scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= count), note)
    dropped(chosen)
    return out


def mine(embeddings: DataFrame, every: int = 50, shift: int = 7, labels: int = 10, positives: int = POSITIVES, negatives: int = NEGATIVES, dim: int = DIM, slab_rows: int = SLAB_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; where it is divisible by `shift` the
    label is first set to (label + 1) % `labels`.
    """
    spark = embeddings.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    own = rows(embeddings.where("label is not null"), dim, "label")
    moved = F.when(F.col("vec_id") % shift == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("int")
    points = saved(own.select("vec_id", moved.alias("label"), "x", F.monotonically_increasing_id().alias("uid")), "points")
    sums = points.select("x").mapInArrow(_moments(dim), "dim int, n bigint, one double, two double, low bigint, high bigint").groupBy("dim")
    about = sorted(sums.agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"), F.min("low").alias("low"), F.max("high").alias("high")).collect())
    if not about:
        return spark.createDataFrame([], schema)
    n = about[0].n
    spread = np.array([r.two / n - (r.one / n) ** 2 for r in about])
    axes = np.sort(np.argsort(-spread, kind="stable")[: min(CURVE_DIMS, dim)])
    low, high = np.array([r.low for r in about])[axes], np.array([r.high for r in about])[axes]
    # products are exact as doubles up to here, as 64-bit integers beyond
    kind = np.float64 if dim * max(max(abs(r.low), abs(r.high)) for r in about) ** 2 < 1 << 52 else np.int64
    parts = input_parts(embeddings)
    slabs = max(-(-n // slab_rows), min(parts, -(-n // LEAST_ROWS)))
    placed = points.mapInArrow(_placed(axes, low, high, dim), "vec_id bigint, label int, x array<int>, uid bigint, place bigint")
    ranged = placed.repartitionByRange(slabs, "place", "uid").sortWithinPartitions("place", "uid")
    packed = saved(ranged.mapInArrow(_written(dim, kind, every, positives, block_rows), _PACKED), "blocks")
    dropped(points)
    blocks, anchors = packed.where(F.col("kind") == BLOCK), packed.where(F.col("kind") == ANCHOR)
    many = blocks.count()
    found = _searched(blocks, anchors, dim, kind, positives, max(parts, slabs), many, "positives")
    # the least and the greatest integer of the window; below zero there is none
    low, high = (F.when(F.col("score") >= 0, F.expr(e)).otherwise(F.lit(other).cast("bigint")) for e, other in (("(score + 1) div 2", 0), ("score - (5 * score + 99) div 100", -1)))
    of = found.select("uid", F.struct("rank", low.alias("low"), high.alias("high")).alias("p"))
    listed = of.groupBy("uid").agg(F.sort_array(F.collect_list("p")).alias("p"))  # `positives` of each anchor at most
    windowed = anchors.drop("need", "upto").join(listed, "uid").withColumn("need", F.col("p.low")).withColumn("upto", F.col("p.high")).drop("p")
    hard = _searched(blocks, windowed, dim, kind, negatives, max(parts, slabs), many, "negatives")
    named = hard.select("uid", (F.col("nth") + 1).alias("of"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("uid", "anchor_id", F.col("rank").alias("of"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(pairs, ["uid", "of"]).select(*[c.split()[0] for c in schema.split(", ")])
