"""Exact repeated-passage removal with suffix arrays built by two-stage sorting.

A byte is removed if a `length`-byte string that covers it also starts earlier
(smaller doc_id, or earlier in the same document).

1. *Routing.* Each `length`-byte window is routed by the least hash of the
   `GRAM`-byte strings in it. Equal windows have equal routes, and neighbouring
   windows mostly share theirs, so a document gives one row for a run of windows
   (about one for 35 bytes): (route, doc, start, windows). Routes that occur once are
   dropped by an aggregation and a join, unless the run repeats itself.
2. *Regions.* The runs left meet their texts. A text that equals one of an earlier
   document is marked whole: all its windows start there. Of the others, a run's region is the bytes its
   windows cover. Regions equal to an earlier one of the same batch are marked
   at once and not sent; the others go to the task of their route. A
   route of over HOT runs is split: its windows go one by one, by the route and
   their first and last bytes.
3. *Suffix array.* A task lays the regions of some routes end to end and sorts
   their window positions as suffixes, in two stages. Suffixes that are not
   larger than their successor by their first byte are sorted directly, eight
   bytes at a time, only where a tie is left. The others are induced: a scan
   over the buckets in byte order meets each finished suffix and puts the one
   before it at the next place of that one's bucket. Adjacent common prefixes
   of `length` bytes then tell which windows are equal, and all but the
   earliest of each class are marked. The sort stops at depth `length`, as longer
   prefixes change nothing.
4. *Removal.* Marks meet their document, overlapping ones are joined, and the bytes
   are cut.

Null text is empty. A null doc_id counts as the smallest. Rows that share a
doc_id but not the text are documents of their own, in the order of their
text's hash; rows equal in both are one document and all get its result. Other
columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import apart, by_bytes, documents, flat_bytes

LENGTH = 100
GRAM = 20
#: Runs of one route above which its windows are routed one by one.
HOT = 20_000
#: Text bytes hashed, or sorted, at a time.
HASH_BYTES, SORT_BYTES = 3 << 20, 6 << 20
#: Regions a task remembers, and their bytes, before it sends them.
HELD, HELD_BYTES = 60_000, 12 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _window(x: np.ndarray, width: int, least) -> np.ndarray:
    """`least` over each `width` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = least(x[:-step], x[step:])
        have += step
    return x


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document, start in it, windows, route, whether two of them may be equal) of each run of windows with one route."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    up, down = _powers(n + 1, _BASE), _powers(n + 1, pow(_BASE, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    del up, down, sums
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = _window(h, length - gram + 1, np.minimum)  # one for each window start
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[: n - length + 1]
    ok = np.arange(n - length + 1) + length <= at[1:][doc]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stop = np.flatnonzero(ok & np.concatenate([new[1:] | ~ok[1:], [True]])) + 1
    # equal windows of one run have its least hash at different places
    span, many, route = np.arange(length - gram + 1), stop - first, least[first]
    own = many > len(span)
    for a in range(0, len(first), 20_000):
        part = slice(a, a + 20_000)
        front, back = (h[x[part, None] + span] == route[part, None] for x in (first, stop - 1))
        own[part] |= (front.sum(1) > 1) | (back.sum(1) > 1) | (first[part] + front.argmax(1) != stop[part] - 1 + back.argmax(1))
    return doc[first].astype(np.int64), first - at[doc[first]], many, route.view(np.int64), own


def _routed(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, HASH_BYTES):
            doc, start, many, route, own = runs(*flat_bytes(b["text"]), length, gram)
            did, part = b["_did"].to_numpy(), b["_part"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(did[doc]), pa.array(part[doc] << 32 | start), pa.array(many.astype(np.int32)), pa.array(own)], names=["route", "did", "start", "many", "own"])

    return run


def _packing(fields: list[str]):
    """Texts as zstandard frames, for the way through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                packed = pa.array([press(t.as_py().encode()) if t.is_valid else None for t in part["text"]], pa.binary())
                yield pa.RecordBatch.from_arrays([packed if f == "_packed" else part[f] for f in fields], names=fields)

    return run


def unpacked(frame: pa.Scalar) -> bytes:
    """The bytes of a text; null: empty."""
    return zstandard.ZstdDecompressor().decompress(frame.as_py()) if frame.is_valid else b""


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sent(length: int):
    """Runs of each document with its text -> regions to sort, and marks of those equal to an earlier one."""
    edge = min(16, length)
    names = ["route", "did", "start", "many", "region"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}  # region -> its earliest place so far
        marks: list[tuple] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            rows = [(*v, r) for r, v in seen.items()] + marks
            seen.clear()
            marks.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for did, part, packed, found, copy in zip(b["_did"].to_pylist(), b["_part"].to_pylist(), b["_packed"], b["_runs"], b["_copy"].to_pylist()):
                if not found.is_valid:
                    continue
                if copy:
                    marks.append((did, did, part << 32, zstandard.frame_content_size(packed.as_py()) - length + 1, None))
                    continue
                raw, high, f = unpacked(packed), part << 32, found.values
                for route, start, many, hot in zip(*(f.field(k).to_pylist() for k in range(4))):
                    low = start & 0xFFFFFFFF
                    for at in range(low, low + many) if hot else (low,):
                        n = 1 if hot else many
                        region = raw[at : at + n + length - 1]
                        had = seen.get(region)
                        if had is None:
                            to = _signed(xxhash.xxh64_intdigest(region[:edge] + region[-edge:], route & 0xFFFFFFFF)) if hot else route
                            seen[region] = [to, did, high | at, n]
                            size += len(region)
                        elif (did, high | at) < (had[1], had[2]):
                            marks.append((had[0], had[1], had[2], n, None))
                            had[1], had[2] = did, high | at
                        elif (did, high | at) != (had[1], had[2]):
                            marks.append((had[0], did, high | at, n, None))
                    if len(seen) + len(marks) > HELD or size > HELD_BYTES:
                        yield flushed()
                        size = 0
        if seen or marks:
            yield flushed()

    return run


def _word(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; text ends in eight spare bytes."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the `depth` bytes from each, eight at a time, only where a tie is left."""
    key = words[at].astype(np.uint64)
    by = np.argsort(key, kind="stable")
    out, key = at[by], key[by]
    new = np.ones(len(out), bool)
    new[1:] = key[1:] != key[:-1]
    for d in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        left = np.flatnonzero(tied)
        if not len(left):
            break
        key = words[out[left] + d].astype(np.uint64)
        if depth - d < 8:
            key >>= np.uint64(8 * (8 - depth + d))
        starts = np.flatnonzero(new[left])
        many = np.diff(np.append(starts, len(left)))
        odd = np.empty(len(left), bool)
        odd[0], odd[1:] = False, key[1:] != key[:-1]
        odd[starts] = False
        mixed = np.logical_or.reduceat(odd, starts)
        if mixed.any():
            again = np.flatnonzero(np.repeat(mixed, many))
            group = np.repeat(np.arange(len(starts), dtype=np.int32), many)[again]
            order = again[np.lexsort((key[again], group))]
            out[left[again]], key[again] = out[left[order]], key[order]
            odd = np.empty(len(left), bool)
            odd[0], odd[1:] = False, key[1:] != key[:-1]
            new[left] |= odd
    return out


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions (a mask) sorted by the `depth` bytes from each. text ends in depth + 8 spare bytes."""
    falls = np.zeros(len(text), bool)
    falls[:-1] = text[:-1] > text[1:]
    held = wanted.copy()
    front = np.flatnonzero(wanted & falls)
    while len(front):  # a falling suffix needs its successor
        front = front[~held[front + 1]] + 1
        held[front] = True
        front = front[falls[front]]
    words = _word(text)
    rising = direct(words, np.flatnonzero(held & ~falls), depth)
    induce = np.zeros(len(text) + 1, bool)
    induce[1:] = held & falls  # at a suffix's successor
    cuts = np.searchsorted(text[rising], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for c in range(256):
        bucket = np.concatenate([*waiting[c], rising[cuts[c] : cuts[c + 1]]])
        waiting[c] = []
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket[induce[bucket]] - 1
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            edges = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, edges):
                waiting[text[part[0]]].append(part)
    order = np.concatenate(done) if done else np.zeros(0, np.int64)
    return order[wanted[order]]


def equal_next(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of the suffix array but the first: whether the common prefix with the one before is `depth` bytes."""
    words = _word(text)
    a, b = order[:-1], order[1:]
    left = np.arange(len(a))
    for d in range(0, depth, 8):
        x = words[a[left] + d] ^ words[b[left] + d]
        if depth - d < 8:
            x >>= np.uint64(8 * (8 - depth + d))
        left = left[x == 0]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def repeated(regions: list[bytes], many: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each window of each region, laid end to end, whether an equal one starts earlier; rank orders the regions."""
    text = np.frombuffer(b"".join([*regions, bytes(length + 16)]), np.uint8)
    begin = np.cumsum([0, *map(len, regions[:-1])])
    ends = np.cumsum(many)
    place = np.repeat(begin - (ends - many), many) + np.arange(ends[-1])  # of each window in text
    wanted = np.zeros(len(text), bool)
    wanted[place] = True
    order = suffix_array(text, wanted, length)
    by = np.empty(len(many), np.int64)
    by[rank] = np.cumsum(many[rank]) - many[rank]
    when = np.zeros(len(text), np.int64)
    when[place] = np.repeat(by - (ends - many), many) + np.arange(ends[-1])
    time = when[order]
    starts = np.flatnonzero(np.concatenate([[True], ~equal_next(text, order, length)]))
    earliest = np.repeat(np.minimum.reduceat(time, starts), np.diff(np.append(starts, len(order))))
    later = np.zeros(len(text), bool)
    later[order] = time != earliest
    return later[place]


def _marked(length: int):
    """Regions sorted by route -> (did, start, stop) of repeated windows' bytes."""

    def sorted_out(b: pa.RecordBatch) -> pa.RecordBatch:
        did, start, many = (b[c].to_numpy().astype(np.int64) for c in ("did", "start", "many"))
        later = repeated(b["region"].to_pylist(), many, np.lexsort((start, did)), length)
        ends = np.cumsum(many)
        edge = np.zeros(len(later) + 1, bool)
        edge[np.concatenate([[0], ends])] = True
        opens = np.flatnonzero(later & (edge[:-1] | ~np.concatenate([[False], later[:-1]])))
        closes = np.flatnonzero(later & (edge[1:] | ~np.concatenate([later[1:], [False]])))
        row = np.searchsorted(ends, opens, "right")
        at = start[row] + opens - (ends - many)[row]
        return pa.RecordBatch.from_arrays([pa.array(did[row]), pa.array(at), pa.array(at + closes - opens + length)], names=["did", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            direct_marks = b.filter(b["region"].is_null())
            if direct_marks.num_rows:
                start = direct_marks["start"].to_numpy()
                yield pa.RecordBatch.from_arrays([direct_marks["did"], pa.array(start), pa.array(start + direct_marks["many"].to_numpy() + length - 1)], names=["did", "start", "stop"])
            b = b.filter(b["region"].is_valid())
            while b.num_rows:
                sizes = size + np.cumsum(np.diff(flat_bytes(b["region"])[1]))
                route = b["route"].to_numpy()
                full = int(np.searchsorted(sizes, SORT_BYTES))
                # a route's regions stay together: cut where the next one begins
                later = np.flatnonzero(route[1:] != route[:-1]) + 1
                cut = later[later > full]
                if full >= b.num_rows or not len(cut):
                    if held and size >= SORT_BYTES and route[0] != held[-1]["route"][-1].as_py():
                        yield sorted_out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                        held, size = [], 0
                        continue
                    held.append(b)
                    size = int(sizes[-1])
                    break
                if held and size >= SORT_BYTES and route[0] != held[-1]["route"][-1].as_py():
                    yield sorted_out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
                    continue
                held.append(b.slice(0, int(cut[0])))
                yield sorted_out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, size, b = [], 0, b.slice(int(cut[0]))
        if held:
            yield sorted_out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def spans(found: pa.Scalar, n: int) -> list[tuple[int, int]]:
    """Marks of one document joined where they touch."""
    if not found.is_valid:
        return []
    v = found.values
    start, stop = v.field(0).to_numpy() & 0xFFFFFFFF, v.field(1).to_numpy() & 0xFFFFFFFF
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.minimum(np.maximum.accumulate(stop[by]), n)
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    last = np.concatenate([new[1:], [True]])
    return [*zip(start[new].tolist(), stop[last].tolist())]


def _cut(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, z in gone:
        kept.append(raw[at:a])
        at = z
    return b"".join([*kept, raw[at:]])


def _keyed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` with _did and _part, and which of them tell documents apart: _did alone if no doc_id is there twice."""
    most = docs.groupBy(F.col("doc_id").cast("bigint").alias("d")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    unique = (most or 0) < 2
    part = F.lit(0) if unique else F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(0x7FFFFFFF))
    keyed = docs.withColumns({"_did": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), "_part": part.cast("bigint")})
    return keyed, ["_did"] if unique else ["_did", "_part"]


def marks(keyed: DataFrame, packed: DataFrame, on: list[str], length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The marked byte spans (_gone) of each document that has any. packed: `keyed` with its texts as frames."""
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 to `length` bytes")
    texts = keyed if len(on) == 1 else keyed.dropDuplicates(on)
    packed = packed if len(on) == 1 else packed.dropDuplicates(on)
    routed = texts.select("_did", "_part", "text").mapInArrow(_routed(length, gram), "route bigint, did bigint, start bigint, many int, own boolean")
    twice = routed.groupBy("route").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 or own").select("route", (F.col("n") > hot).alias("hot"))
    by = {"_did": F.col("did").alias("_did"), "_part": F.shiftright("start", 32).alias("_part")}
    again = routed.drop("own").join(twice, "route").groupBy(*(by[k] for k in on)).agg(F.collect_list(F.struct("route", "start", "many", "hot")).alias("_runs"))
    row = F.struct("_did", "_part")
    named = texts.select("_did", "_part", F.sha2(F.col("text").cast("string"), 256).alias("sha"))
    first = named.groupBy("sha").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    copies = named.join(first, "sha").where(row != F.col("first")).select(*on, F.lit(True).alias("_copy"))
    # a left join, and all columns, so that this exchange of the texts is the one that `_with_marks` reads again
    regions = packed.join(again, on, "left").join(copies, on, "left").mapInArrow(_sent(length), "route bigint, did bigint, start bigint, many int, region binary")
    marked = regions.repartition("route").sortWithinPartitions("route").mapInArrow(_marked(length), "did bigint, start bigint, stop bigint")
    return marked.groupBy(*(by[k] for k in on)).agg(F.collect_list(F.struct("start", "stop")).alias("_gone"))


def _with_marks(docs: DataFrame, columns: list[str], length: int, gram: int, hot: int) -> DataFrame:
    """`columns`, each text as a frame (_packed), and its marks.

    The texts cross one shuffle, which the joins with runs and with marks both read.
    """
    keyed, on = _keyed(docs)
    fields = [*dict.fromkeys(["_did", "_part", *columns])]
    kinds = dict(keyed.dtypes)
    schema = ", ".join(f"`{f}` {kinds[f]}" for f in fields) + ", _packed binary"
    packed = keyed.select(*fields, "text").mapInArrow(_packing([*fields, "_packed"]), schema)
    return packed.join(marks(keyed, packed, on, length, gram, hot), on, "left")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part, out = b.slice(at, 500), []
            for frame, gone in zip(part["_packed"], part["_gone"]):
                raw = unpacked(frame)
                cut = spans(gone, len(raw))
                out.append((len(raw), sum(z - a for a, z in cut), len(cut), hashlib.sha256(_cut(raw, cut)).hexdigest()))
            cols = [*zip(*out)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """What is removed from each document, and the SHA-256 of what stays."""
    joined = _with_marks(documents(docs), ["doc_id"], length, gram, hot)
    return joined.mapInArrow(_digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _rewritten(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, texts = b.slice(at, 500), []
                for frame, gone in zip(part["_packed"], part["_gone"]):
                    raw = unpacked(frame)
                    texts.append(_cut(raw, spans(gone, len(raw))).decode("utf-8", "ignore") if frame.is_valid else None)
                own = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([own[f] if f in own else part[f] for f in fields], names=fields)

    return run


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """`docs` with the repeated bytes cut out of its texts (and n_chars, if it is there, counted again).

    A cut inside a character leaves part of its bytes; they are dropped, so texts stay valid UTF-8.
    """
    return apart(docs, lambda d: _removed(d, length, gram, hot))


def _removed(docs: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    joined = _with_marks(docs, others, length, gram, hot)
    schema = ", ".join(f"`{f.name}` {dict(text='string', n_chars='bigint').get(f.name, f.dataType.simpleString())}" for f in docs.schema.fields)
    return joined.mapInArrow(_rewritten(docs.columns), schema)
