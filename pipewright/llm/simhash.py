"""SimHash near-duplicates by pigeonring filtering.

A text's A-Z are lowered, its words `[^\\x20\\x09-\\x0D]+` make shingles of
`width` words (fewer words: the whole sequence), and a fingerprint bit is 1 if
it is set in over half of the shingles' XXH64 (seed 42). No words: zero, a
fingerprint like any other.

Equal fingerprints are one class. Classes are linked at `bits` or fewer
differing bits. The 64 bits form a ring of 8 segments. If two fingerprints
differ in at most 3 bits in all, some segment of the ring starts a chain in which the first l segments differ in at
most l * 3 / 8 bits together, for every l: none in the first two, at most one
in the first five, two in the first seven. So two segments after the start are
equal, and two of the three that follow: 32 equal bits, under 24 keys for a
class. Classes that share a key are candidates; the chain's budgets prune them
segment by segment before the full Hamming distance is taken.

A bucket emits links of a spanning forest only, never all its pairs. Large
buckets are split again by pieces of the bits in which they still differ,
one of which must be equal, so none is compared whole.

Null and empty texts get fingerprint zero. A null doc_id stays null and is
never a component's smallest id unless it has no other. Repeated rows are
kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import apart, documents, saved
from pipewright.llm.components import roots

WIDTH, BITS, SEED = 3, 3, 42
SEGMENTS = 8
#: Differing bits allowed in the first l segments of a chain.
BUDGETS = [(l + 1) * BITS // SEGMENTS for l in range(SEGMENTS)]
#: A larger bucket is split before its pairs are compared.
BUCKET = 512
FINGERPRINT = "_fingerprint"


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [*accumulate(map(len, words), lambda a, b: a + 1 + b)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        hashes = np.array([digest(joined[a:z], SEED) for a, z in zip(starts, ends[width - 1 :])], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprinted(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            prints = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(at)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints.view(np.int64))], names=[*b.schema.names, FINGERPRINT])

    return run


def with_fingerprint(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns and `_fingerprint`, the fingerprint's bits as a long."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_fingerprinted(width), f"{fields}, {FINGERPRINT} bigint")


def _keyed(classes: DataFrame) -> DataFrame:
    """24 rows for each class: (key, bits). Key: chain start, which segment of the next three may differ, 32 bits."""
    x, keys = F.col(FINGERPRINT), []
    for start in range(SEGMENTS):
        turned = F.shiftrightunsigned(x, 8 * start).bitwiseOR(F.shiftleft(x, 64 - 8 * start)) if start else x
        for free in range(3):
            kept = [0, 1, *[2 + s for s in range(3) if s != free]]
            packed = F.lit(start * 3 + free).cast("bigint")
            for s in kept:
                packed = F.shiftleft(packed, 8).bitwiseOR(F.shiftrightunsigned(turned, 8 * s).bitwiseAND(F.lit(0xFF).cast("bigint")))
            keys.append(packed)
    return classes.select(F.explode(F.array(*keys)).alias("key"), x.alias("bits"))


def _near(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pairs whose chain from `start` stays within its budgets, the last of which is the full Hamming check."""
    x, shift = a ^ b, (start * 8).astype(np.uint64)
    x = (x >> shift) | (x << ((np.uint64(64) - shift) & np.uint64(63)))
    x = np.where(shift == 0, a ^ b, x)
    left = np.arange(len(x))
    for l, most in enumerate(BUDGETS):
        mask = np.uint64((1 << 8 * (l + 1)) - 1)
        ok = np.bitwise_count(x[left] & mask) <= most
        left = left[ok]
    return left


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index each of n nodes reaches over links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _bucket(bits: np.ndarray) -> np.ndarray:
    """For each distinct fingerprint of a large bucket, the index of one it is connected with (itself for roots)."""
    label = np.arange(len(bits))
    stack = [(np.arange(len(bits)), 0)]
    while stack:
        own, depth = stack.pop()
        part = bits[own]
        varying = [k for k in range(64) if int(np.bitwise_or.reduce(part ^ part[0])) >> k & 1]
        pieces = [varying[k :: BITS + 1] for k in range(BITS + 1)]
        groups = []
        if len(own) > BUCKET and depth < 6 and len(varying) > BITS + 1:
            for piece in pieces:  # of four pieces, three differing bits leave one equal
                value = np.zeros(len(part), np.uint64)
                for k in piece:
                    value = value << np.uint64(1) | part >> np.uint64(k) & np.uint64(1)
                by = np.argsort(value, kind="stable")
                cuts = np.flatnonzero(np.diff(value[by])) + 1
                groups += [g for g in np.split(own[by], cuts) if len(g) > 1]
        if groups and max(map(len, groups)) < len(own):
            stack += [(g, depth + 1) for g in groups]
            continue
        found = [np.stack([np.arange(len(bits)), label])]
        rows = max(1, min(BUCKET, 1_000_000 // len(own)))
        for at in range(0, len(own), rows):  # in blocks: some rows against all that follow
            i, j = np.nonzero(np.bitwise_count(part[at : at + rows, None] ^ part[None, at:]) <= BITS)
            forest = _forest(len(own) - at, i, j)
            found.append(np.stack([own[at:], own[at:][forest]]))
        label = _forest(len(bits), *np.concatenate(found, axis=1))
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links of a spanning forest of each bucket."""

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    def linked(key: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        many = np.diff(cuts)
        for g in np.flatnonzero(many > BUCKET):
            own = bits[cuts[g] : cuts[g + 1]]
            label = _bucket(own)
            apart = np.flatnonzero(label != np.arange(len(own)))
            yield out(own[apart], own[label[apart]])
        small = np.repeat(many <= BUCKET, many)
        key, bits = key[small], bits[small]
        i_s, j_s = [], []
        for step in range(1, int(many[many <= BUCKET].max(initial=1))):
            at = np.flatnonzero(key[:-step] == key[step:])
            if not len(at):
                break
            near = at[_near(bits[at], bits[at + step], (key[at] >> 32) // 3)]
            i_s.append(near)
            j_s.append(near + step)
        if i_s:
            label = _forest(len(key), np.concatenate(i_s), np.concatenate(j_s))
            apart = np.flatnonzero(label != np.arange(len(key)))
            yield out(bits[apart], bits[label[apart]])

    held_key, held_bits = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        held_key = np.concatenate([held_key, b["key"].to_numpy()])
        held_bits = np.concatenate([held_bits, b["bits"].to_numpy().view(np.uint64)])
        done = int(np.searchsorted(held_key, held_key[-1])) if len(held_key) else 0  # the last key may go on
        if done:
            yield from linked(held_key[:done], held_bits[:done])
            held_key, held_bits = held_key[done:], held_bits[done:]
    if len(held_key):
        yield from linked(held_key, held_bits)


def components(prints: DataFrame) -> DataFrame:
    """prints: doc_id, _fingerprint. Adds component_id and root (the component's least fingerprint as a long)."""
    classes = prints.groupBy(FINGERPRINT).agg(F.min("doc_id").alias("least"))
    classes = saved(classes, "classes")
    links = _keyed(classes).repartition("key").sortWithinPartitions("key", "bits").mapInArrow(_links, "u bigint, v bigint")
    found = saved(roots(links), "roots")
    joined = classes.join(found.withColumnRenamed("node", FINGERPRINT), FINGERPRINT)
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = found.join(least, "root").select(F.col("node").alias(FINGERPRINT), "root", "component_id")
    whole = classes.join(named, FINGERPRINT, "left").select(FINGERPRINT, F.coalesce("root", FINGERPRINT).alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return prints.join(whole, FINGERPRINT)


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, root for every row."""
    prints = saved(with_fingerprint(documents(docs), width).select("doc_id", FINGERPRINT), "prints")
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex(FINGERPRINT), 16, "0")).alias("fingerprint"), "component_id", "root")


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each component, the one of least id (rows that repeat it: one); the columns of `docs`."""
    return apart(docs, lambda d: _kept(d, width))


def _kept(docs: DataFrame, width: int) -> DataFrame:
    # rows are settled by number alone, so the texts cross one shuffle
    prints = saved(with_fingerprint(docs, width).withColumn("_row", F.monotonically_increasing_id()), "prints")
    rows = components(prints.select(F.col("doc_id").cast("bigint").alias("doc_id"), FINGERPRINT, "_row"))
    least = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min(F.struct(FINGERPRINT, "_row"))["_row"].alias("_row"))
    return prints.join(least.select("_row"), "_row", "left_semi").drop("_row")
