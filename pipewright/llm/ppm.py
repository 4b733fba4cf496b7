"""Prediction by partial matching: code length of texts under byte contexts.

*Training.* A-Z are lowered. Every byte of the training documents, and an end
symbol after each, is counted under the `order` bytes before it (null bytes
stand before a document). Shorter contexts' counts are sums of these. Every context
met is kept, however rare, so the model grows with the text it is learnt from. Escapes
follow method C: a context with n symbols seen, d of them different, gives n_s / (n + d) to a
symbol and d / (n + d) to the escape, which goes on in the next shorter
context without the symbols seen in longer ones (symbol exclusion), at last
to all symbols left alike.

*Scoring.* A block of documents sends each (context, symbol) pair of its texts
once, with its count in training, to the bucket of the context's last three bytes. A
bucket so has all counts of its contexts of three bytes and more, adds them up
and answers each block with its pairs' log10 probabilities; the block's texts meet the answers
and add them up. Counts under the last two bytes and fewer go to all tasks: 65,536 * 257 at
most, whatever the corpus. A symbol seen in a context is seen in each shorter one, so what
exclusion takes off a context is known from the next longer one's symbols alone.

*Base.* The unigram score of the words is a join of words with their training
counts. A block of documents sends each of its words once, with packed (document,
frequency) postings; the counts come back by block.

Null and empty texts hold the end alone. Null doc_ids aren't held out. Rows that
repeat a doc_id are scored one by one. With no training document every
probability is uniform, and base counts are zero. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import by_bytes, compact, documents, dropped, flat_bytes, held_out, input_parts, saved

ORDER = 5
END, SYMBOLS = 256, 257
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 60_000
#: Bytes of a block that are sorted at once; the longest contexts whose counts all tasks have.
SLICE_BYTES, SHARED = 1 << 20, 2
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.int16)
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _sequence(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols with `order` nulls before and the end after each text, places of the real ones, text of each)."""
    data, at = flat_bytes(texts)
    n, size = len(at) - 1, np.diff(at)
    x = np.zeros(len(data) + (order + 1) * n, np.int16)
    owner = np.repeat(np.arange(n), size + 1)
    place = np.arange(len(owner)) + order * (owner + 1)
    x[place] = np.insert(_LOWER[data], at[1:], END)
    return x, place, owner


def _keys(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context << 9 | symbol of each place, text of each)."""
    x, place, owner = _sequence(texts, order)
    key = np.zeros(len(place), np.int64)
    for k in range(order, 0, -1):
        key = key << 8 | x[place - k]
    return key << 9 | x[place], owner


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their n."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n[by], first) if len(first) else n[:0]


def _shorter(keys: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts under the last `order` bytes of longer contexts."""
    return _merged(keys & (1 << 8 * order + 9) - 1, n)


def _grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, BLOCK_BYTES // 2):
            key, n = np.unique(_keys(b["text"], order)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 9), pa.array((key & 511).astype(np.int32)), pa.array(n)], names=["context", "symbol", "n"])

    return run


def train(docs: DataFrame, order: int = ORDER, nodes: int | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order (context, symbol, count), collected for a `Model`: of all contexts, or of the `nodes` most frequent
    (ties: the smaller) if the table is too large for that. score() doesn't use it."""
    if not 0 <= order <= 6:
        raise ValueError("order is 0 to 6")
    grams = documents(docs).mapInArrow(_grams(order), "context bigint, symbol int, n bigint").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
    grams, out = saved(grams, "grams"), []
    for o in range(order, -1, -1):
        mask = F.lit((1 << 8 * o) - 1).cast("bigint")
        if o < order:
            longer = grams
            grams = saved(longer.groupBy(F.col("context").bitwiseAND(mask).alias("context"), "symbol").agg(F.sum("n").alias("n")), "grams")
            dropped(longer)
        kept = grams
        if nodes is not None:
            most = grams.groupBy("context").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "context").limit(nodes).select("context")
            kept = grams.join(most, "context")
        t = kept.select("context", "symbol", "n").toArrow()
        t = t.sort_by([("context", "ascending"), ("symbol", "ascending")])
        out.append((t["context"].to_numpy(), t["symbol"].to_numpy(), t["n"].to_numpy()))
    dropped(grams)
    return out[::-1]


class Model:
    """A small model as a trie of dense tables over the symbols met in training."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        met = np.unique(np.concatenate([c[1] for c in counts])) if counts else np.zeros(0, np.int64)
        contexts_of = np.unique(np.concatenate([(c[0] >> 8 * k) & 255 for o, c in enumerate(counts) for k in range(o)] or [met[:0]]))
        met = np.union1d(met, contexts_of).astype(np.int64)
        self.order, a = len(counts) - 1, len(met) + 1  # the last code: any byte not met
        self.code = np.full(SYMBOLS, a - 1, np.int32)
        self.code[met] = np.arange(len(met))
        self.width = a
        nodes = [np.unique(c[0]) for c in counts]
        base = np.cumsum([0, *map(len, nodes)])
        self.none = int(base[-1])  # a node that isn't there
        dense = []
        for (context, symbol, n), own in zip(counts, nodes):
            m = np.zeros((len(own), a), np.float32)
            m[np.searchsorted(own, context), self.code[symbol]] = n
            dense.append(m)
        self.logp = np.full((self.none + 1, a), -np.log10(SYMBOLS), np.float32)
        self.child = np.full((self.none + 1, a), self.none, np.int32)
        for o, own in enumerate(nodes):
            if o:
                up = np.searchsorted(nodes[o - 1], own & (1 << 8 * (o - 1)) - 1).clip(0, max(len(nodes[o - 1]) - 1, 0))
                real = nodes[o - 1][up] == own & (1 << 8 * (o - 1)) - 1 if len(nodes[o - 1]) else np.zeros(len(own), bool)
                self.child[base[o - 1] + up[real], self.code[own[real] >> 8 * (o - 1)]] = base[o] + np.flatnonzero(real)
            for at in range(0, len(own), 2048):
                self.logp[base[o] + at : base[o] + min(at + 2048, len(own))] = self._row(dense, nodes, o, at, own[at : at + 2048])
        self.root = int(base[0]) if nodes and len(nodes[0]) else self.none

    def _row(self, dense, nodes, o: int, at: int, contexts: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in some contexts of order o."""
        rows, a = len(contexts), self.width
        logp, escape = np.zeros((rows, a)), np.zeros(rows)
        seen = np.zeros((rows, a), bool)
        for k in range(o, -1, -1):
            if k == o:
                n = dense[k][at : at + rows].astype(np.float64)
            else:
                c = contexts & (1 << 8 * k) - 1
                i = np.searchsorted(nodes[k], c).clip(0, max(len(nodes[k]) - 1, 0))
                there = nodes[k][i] == c
                n = dense[k][i] * there[:, None]
            n = np.where(seen, 0, n)
            total, kinds = n.sum(1), (n > 0).sum(1)
            new = n > 0
            logp = np.where(new, escape[:, None] + np.log10(np.where(new, n, 1) / np.maximum(total + kinds, 1)[:, None]), logp)
            escape = escape + np.where(kinds > 0, np.log10(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0)
            seen |= new
        left = np.maximum(SYMBOLS - seen.sum(1), 1)
        return np.where(seen, logp, (escape - np.log10(left))[:, None])

    def score(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each text."""
        x, place, owner = _sequence(texts, self.order)
        x = self.code[x]
        node = np.full(len(place), self.root, np.int32)
        deepest = node.copy()
        for k in range(1, self.order + 1):
            node = self.child.ravel()[node.astype(np.int64) * self.width + x[place - k]]
            deepest = np.where(node != self.none, node, deepest)
        each = self.logp.ravel()[deepest.astype(np.int64) * self.width + x[place]]
        return np.bincount(owner, each, minlength=len(texts))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of documents, packed."""
    block = TaskContext.get().partitionId() << 24
    for whole in by_bytes(batches, BLOCK_BYTES):
        for at in range(0, whole.num_rows, BLOCK_DOCS):
            b = compact(whole.slice(at, BLOCK_DOCS))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])
            block += 1


def _opened(packed: pa.Array) -> Iterator[pa.RecordBatch]:
    for one in packed:
        with pa.ipc.open_stream(one.as_buffer()) as held:
            yield from held


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the last SHARED + 1 bytes of the context."""
    near = (keys >> 9 & (1 << 8 * (SHARED + 1)) - 1).astype(np.uint64)
    return ((near * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _turned(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys with the context's last SHARED + 1 bytes first, so that those of a bucket lie near each other in this order."""
    bits, near = 8 * max(order - SHARED - 1, 0), 8 * (SHARED + 1)
    context = keys >> 9
    return ((context & (1 << near) - 1) << bits | context >> near) << 9 | keys & 511


def _turned_back(turned: np.ndarray, order: int) -> np.ndarray:
    bits, near = 8 * max(order - SHARED - 1, 0), 8 * (SHARED + 1)
    context = turned >> 9
    return ((context & (1 << bits) - 1) << near | context >> bits) << 9 | turned & 511


def _dealt(keys: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order in which keys are asked, where each bucket's begin)."""
    own = _bucket(keys, buckets)
    by = np.lexsort((_turned(keys, order), own))
    return by, np.searchsorted(own[by], np.arange(buckets + 1))


def _pressed(values: np.ndarray) -> bytes:
    """Compressed with the like bytes of all values together."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpressed(held: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(held), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pressed_logs(values: np.ndarray) -> bytes:
    """Each different value once, and a number for each place: most come again and again."""
    kinds, at = np.unique(values, return_inverse=True)
    kinds, at = _pressed(kinds), _pressed(at.astype("<u4"))
    return len(kinds).to_bytes(8, "little") + kinds + at


def _unpressed_logs(held: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(held[:8], "little")
    return _unpressed(held[8:cut], np.float64)[_unpressed(held[cut:], "<u4")]


_GRAM = ["block", "bucket", "keys", "n"]
_GRAMS = "block bigint, bucket int, keys binary, n binary"
_ANSWERS = "block bigint, bucket int, packed binary"


def _asked(order: int, buckets: int):
    """The distinct pairs of each block (as steps from one to the next) with their counts in its training documents, by bucket; bucket -1: under SHARED bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block, b in zip(rows["block"].to_pylist(), _opened(rows["packed"])):
                parts = []
                for some in by_bytes([b], SLICE_BYTES):
                    key, owner = _keys(some["text"], order)
                    train = ~some["held"].to_numpy(zero_copy_only=False)[owner]
                    parts.append(np.unique(key[train], return_counts=True))
                    rest = np.unique(key[~train])
                    parts.append((rest, np.zeros(len(rest), np.int64)))
                keys, n = _merged(*(np.concatenate(x) for x in zip(*parts)))
                by, ends = _dealt(keys, order, buckets)
                low, many = _shorter(keys[n > 0], n[n > 0], min(order, SHARED))
                steps = lambda sent: np.diff(sent, prepend=0)
                found = [(-1, steps(low), many)] + [(k, steps(_turned(keys[by[i:j]], order)), n[by[i:j]]) for k, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
                columns = [pa.array([block] * len(found)), pa.array([f[0] for f in found], pa.int32()), *(pa.array([_pressed(f[i]) for f in found], pa.binary()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, names=_GRAM)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, n in zip(b["keys"], b["n"]):
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(_unpressed(keys.as_py(), np.int64))), pa.array(_unpressed(n.as_py(), np.int64))], names=["key", "n"])


class Level:
    """Counts under the contexts of one order."""

    def __init__(self, order: int, keys: np.ndarray, n: np.ndarray, shorter: Level | None):
        self.mask, self.keys, self.n = (1 << 8 * order + 9) - 1, keys, n
        own = keys >> 9
        first = np.flatnonzero(np.append(len(own) > 0, own[1:] != own[:-1])[: len(own)])
        self.contexts = own[first]
        self.kinds = np.diff(np.append(first, len(own)))
        self.total = np.add.reduceat(n, first) if len(first) else n[:0]
        #: What the next shorter context counted of the symbols seen in this one.
        self.taken = np.zeros(len(first), np.int64)
        if shorter is not None and len(first):
            self.taken = np.add.reduceat(shorter.count(keys & shorter.mask), first)

    def count(self, keys: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.keys, keys).clip(0, max(len(self.keys) - 1, 0))
        return np.where(self.keys[i] == keys, self.n[i], 0) if len(self.keys) else np.zeros(len(keys), np.int64)

    def stats(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(total, kinds, taken) of each context, zeros where it wasn't met."""
        if not len(self.contexts):
            return (np.zeros(len(contexts), np.int64),) * 3
        i = np.searchsorted(self.contexts, contexts).clip(0, len(self.contexts) - 1)
        there = self.contexts[i] == contexts
        return tuple(np.where(there, x[i], 0) for x in (self.total, self.kinds, self.taken))


def _levels(counts: list[tuple[np.ndarray, np.ndarray]], known: list[Level]) -> list[Level]:
    """`known` levels of the lowest orders, and one for each of `counts` above them."""
    out = list(known)
    for keys, n in counts:
        out.append(Level(len(out), keys, n, out[-1] if out else None))
    return out


def _log10(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each (context, symbol)."""
    logp, escape, done = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), bool)
    kinds = taken = np.zeros(len(keys), np.int64)  # of the next longer context
    for level in reversed(levels):
        key = keys & level.mask
        total, own, next_taken = level.stats(key >> 9)
        rest, new, n = total - taken, own - kinds, level.count(key)
        hit = ~done & (n > 0)
        whole = np.maximum(rest + new, 1)
        logp[hit] = (escape + np.log10(np.maximum(n, 1) / whole))[hit]
        done |= hit
        escape = escape + np.where(new > 0, np.log10(np.maximum(new, 1) / whole), 0)
        kinds, taken = own, next_taken
    return np.where(done, logp, escape - np.log10(np.maximum(SYMBOLS - kinds, 1)))


def _answered(order: int, shared):
    """Rows sorted by bucket -> the log10 probabilities of each block's pairs, in the order they came."""

    def answers(bucket: int, asked: list[tuple[int, np.ndarray, np.ndarray]], lowest: list[Level]) -> pa.RecordBatch:
        keys, n = _merged(np.concatenate([a[1] for a in asked]), np.concatenate([a[2] for a in asked]))
        met = (keys[n > 0], n[n > 0])
        levels = _levels([_shorter(*met, o) for o in range(SHARED + 1, order + 1)], lowest)
        logp = _log10(keys, levels)
        packed = [_pressed_logs(logp[np.searchsorted(keys, a[1])]) for a in asked]
        return pa.RecordBatch.from_arrays([pa.array([a[0] for a in asked]), pa.array([bucket] * len(asked), pa.int32()), pa.array(packed, pa.binary())], names=["block", "bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, lowest = -1, [], _levels(shared.value, [])
        for b in batches:
            for bucket, block, keys, n in zip(b["bucket"].to_pylist(), b["block"].to_pylist(), b["keys"], b["n"]):
                if bucket != now and asked:
                    yield answers(now, asked, lowest)
                    asked = []
                now = bucket
                asked.append((block, _turned_back(np.cumsum(_unpressed(keys.as_py(), np.int64)), order), _unpressed(n.as_py(), np.int64)))
        if asked:
            yield answers(now, asked, lowest)

    return run


def _scored(order: int, buckets: int):
    """A block's texts (bucket -1), then its answers by bucket -> the score of each of its documents."""

    def scores(texts: pa.Array, answers: list[bytes]) -> np.ndarray:
        parts, first = [], 0
        for some in by_bytes([pa.RecordBatch.from_arrays([texts], names=["text"])], SLICE_BYTES):
            key, owner = _keys(some["text"], order)
            own, at = np.unique(key, return_inverse=True)
            parts.append((own, at.astype(np.int32), (owner + first).astype(np.int32)))
            first += some.num_rows
        keys = np.unique(np.concatenate([p[0] for p in parts]))
        logp = np.empty(len(keys))
        logp[_dealt(keys, order, buckets)[0]] = np.concatenate([_unpressed_logs(a) for a in answers])
        out = np.zeros(len(texts))
        for own, at, owner in parts:
            out += np.bincount(owner, logp[np.searchsorted(keys, own)][at], minlength=len(texts))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, answers = None, None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([scores(texts, answers).tobytes()], pa.binary())], names=["block", "postings"])

        for b in batches:
            for block, bucket, packed in zip(b["block"].to_pylist(), b["bucket"].to_pylist(), b["packed"]):
                if block != now:
                    if now is not None:
                        yield done()
                    now, answers = block, []
                if bucket < 0:
                    texts = next(_opened([packed]))["text"]
                else:
                    answers.append(packed.as_py())
        if now is not None:
            yield done()

    return run


def log_scores(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """block and the packed PPM scores of its documents, learnt from those that aren't held out."""
    if not 0 <= order <= 6:
        raise ValueError("order is 0 to 6")
    many = blocks.count()
    parts = input_parts(blocks)
    buckets = max(parts, many // 4)
    grams = saved(blocks.mapInArrow(_asked(order, buckets), _GRAMS), "grams")
    low = grams.where("bucket < 0").select("keys", "n").mapInArrow(_unpacked, "key bigint, n bigint")
    low = low.groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")  # 65,536 * 257 rows at most
    counts = (low["key"].to_numpy(), low["n"].to_numpy())
    shared = blocks.sparkSession.sparkContext.broadcast([_shorter(*counts, o) for o in range(min(order, SHARED) + 1)])
    asked = grams.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = asked.select("bucket", "block", "keys", "n").mapInArrow(_answered(order, shared), _ANSWERS)
    texts = blocks.select("block", F.lit(-1).alias("bucket"), "packed")
    met = texts.unionByName(answers).repartition(max(parts, many), "block").sortWithinPartitions("block", "bucket")
    out = saved(met.mapInArrow(_scored(order, buckets), "block bigint, postings binary"), "scores")
    dropped(grams)
    return out


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: a row for each word, and one for the block."""
    for rows in batches:
        for block, b in zip(rows["block"].to_pylist(), _opened(rows["packed"])):
            n = b.num_rows
            lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(b["text"].cast(pa.large_string())), ""))
            words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            real = pc.greater(pc.binary_length(words), 0)
            words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
            coded = pc.dictionary_encode(words)
            codes = coded.indices.to_numpy().astype(np.int64)
            train = ~b["held"].to_numpy(zero_copy_only=False)
            pair, tf = np.unique(codes * n + owner, return_counts=True)
            many = -(-tf // 65_535)  # a greater frequency takes several pairs
            pair, last = np.repeat(pair, many), np.cumsum(many) - 1
            part = np.full(len(pair), 65_535, np.int64)
            part[last] = tf - (many - 1) * 65_535
            word = pair // n
            packed = np.empty((len(pair), 2), "<u2")
            packed[:, 0], packed[:, 1] = pair % n, part
            ends = np.searchsorted(word, np.arange(len(coded.dictionary) + 1)) * 4
            posts = pa.Array.from_buffers(pa.binary(), len(coded.dictionary), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed.tobytes())])
            known = np.bincount(codes, train[owner].astype(np.float64), minlength=len(coded.dictionary)).astype(np.int64)
            w = len(coded.dictionary)
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(known), pa.array(np.full(w, block)), posts], names=_POSTING)
            tokens = np.bincount(owner, minlength=n) + 1
            own = np.zeros(n, _DOCUMENT)
            own["id"], own["null"] = b["doc_id"].fill_null(0).to_numpy(), b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            own["held"], own["tokens"] = ~train, tokens
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([int(tokens[train].sum())]), pa.array([block]), pa.array([own.tobytes()], pa.binary())], names=_POSTING)


_POSTING = ["word", "n", "block", "postings"]
_POSTINGS = "word string, n bigint, block bigint, postings binary"
#: What a block's own row (null word) holds of each of its documents.
_DOCUMENT = np.dtype([("id", "<i8"), ("null", "?"), ("held", "?"), ("tokens", "<i8")])


def _summed(n_tokens: int, n_kinds: int, n_ends: int):
    """Rows of a task's blocks, in any order -> results."""
    spread = np.log10(float(n_tokens + n_kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs: dict[int, np.ndarray] = {}
        known: dict[int, np.ndarray] = {}
        docs: dict[int, np.ndarray] = {}
        scores: dict[int, np.ndarray] = {}
        for b in batches:
            own = pc.less(b["c"], 0)
            for k, c, held in zip(*(b[f].filter(own).to_pylist() for f in ("block", "c", "postings"))):
                if c == -1:
                    docs[k] = np.frombuffer(held, _DOCUMENT)
                else:
                    scores[k] = np.frombuffer(held, np.float64)
            b = b.filter(pc.invert(own))
            block, c = b["block"].to_numpy(), b["c"].to_numpy(zero_copy_only=False)
            data, ends = flat_bytes(b["postings"])
            pairs, many = np.frombuffer(data.tobytes(), "<u2").reshape(-1, 2), np.diff(ends) // 4
            row = np.repeat(np.arange(b.num_rows), many)
            by = np.argsort(block[row], kind="stable")
            for at in np.split(by, np.flatnonzero(np.diff(block[row][by])) + 1):
                if len(at):
                    k = int(block[row[at[0]]])
                    tf, doc, cc = pairs[at, 1].astype(np.float64), pairs[at, 0], c[row[at]]
                    for sums, value in ((logs, tf * np.log10(cc + 1.0)), (known, tf * (cc > 0))):
                        new = np.bincount(doc, value)
                        old = sums.get(k)
                        if old is None:
                            sums[k] = new
                        else:
                            if len(old) < len(new):
                                old, new = new, old
                            old[: len(new)] += new
                            sums[k] = old
        for k, own in docs.items():
            n, count = len(own), own["tokens"]
            total = [np.pad(s[k], (0, n - len(s[k]))) if k in s else np.zeros(n) for s in (logs, known)]
            base = total[0] + np.log10(n_ends + 1.0) - count * spread
            yield pa.RecordBatch.from_arrays([pa.array(own["id"].copy(), mask=own["null"]), pa.array(own["held"]), pa.array(count.copy()), pa.array((total[1] + (n_ends > 0)).astype(np.int64)), pa.array(np.full(n, n_tokens)), pa.array(base), pa.array(scores[k])], names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def score(docs: DataFrame, order: int = ORDER, folds: int = 7, fold: int = 2) -> DataFrame:
    """Unigram and PPM scores of every text, both learnt from documents that aren't held out."""
    own = documents(docs).withColumn("held", held_out("doc_id", folds, fold))
    packed = saved(own.mapInArrow(_blocks, "block bigint, packed binary"), "blocks")
    rows = saved(packed.mapInArrow(_postings, _POSTINGS), "postings")
    scores = log_scores(packed, order)
    dropped(packed)
    words, blocks = rows.where("word is not null"), rows.where("word is null")
    c = saved(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    kinds = c.where("c > 0").count()
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    ends = own.where("not held").count()
    joined = words.select("word", "block", "postings").join(c, "word").select("block", "c", "postings")
    aside = lambda df, mark: df.select("block", F.lit(mark).cast("bigint").alias("c"), "postings")
    whole = joined.unionByName(aside(blocks, -1)).unionByName(aside(scores, -2))
    return whole.repartition("block").mapInArrow(_summed(tokens, kinds + (ends > 0), ends), RESULT)
