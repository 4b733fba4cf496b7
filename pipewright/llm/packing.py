"""Lexical retrieval packing: BM25 neighbours of a seed fill its window.

1. Every text is encoded once where it is read. Its full windows of 1024 ids
   are sequences of their own; what is left (the tail, under 1024 ids) is
   packed. One pass writes three kinds of rows to a table: full windows, tails
   and how many tails of the task hold each vocabulary id.
2. Those counts are summed to corpus-wide document frequencies: one number for
   each vocabulary id, so what tasks receive is bounded by the vocabulary.
3. Tails are dealt by ranges of a lexical key (a min-hash over their ids, then
   doc_id), so texts with common words meet and a group of copies spreads over
   as many ranges as it needs. Each task cuts its range into shards of
   SHARD_IDS ids. A shard holds a BM25 inverted index of its tails; each
   unused tail in turn is the seed, the index ranks the unused others, and
   they fill the seed's window in that order. The last is cut to fit and what
   is left of it stays in the index. A shard's remainder goes on into
   the next shard of the task.

Only the last window of a task isn't full, so padding is under one window a
task. Null and empty texts hold the end id alone and are packed like any
other. Rows that repeat a doc_id are documents of their own. An empty table
gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import by_bytes, documents, input_parts, saved
from pipewright.llm.tokens import BATCH_BYTES, encoder

WINDOW = 1024
#: Tail ids in one shard's index.
SHARD_IDS = 160_000
K1, B = 1.2, 0.75
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_STAGED = PIECE + ", kind int, ids binary, key bigint, token int, docs bigint"
FULL, TAIL, COUNT = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "ids": pa.binary(), "token": pa.int32()}
    names = [c.split()[0] for c in _STAGED.split(", ")]
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(n, types.get(c, pa.int64())) for c in names], names=names)


def _encoded(tokenizer: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, full_seen, df = encoder(tokenizer), TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        vocab = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        order = _mixed(np.arange(vocab, dtype=np.uint64)) >> np.uint64(1)
        df = np.zeros(vocab, np.int64)
        for b in by_bytes(batches, BATCH_BYTES):
            ids, at = enc.encode(b["text"])
            n, total = b.num_rows, np.diff(at) + 1
            own, first = np.insert(ids.astype(np.uint32), at[1:], end_id), np.concatenate([[0], np.cumsum(total)])
            doc_ids = b["doc_id"].to_pylist()
            full = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            tails = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "ids", "key")}
            for i in range(n):
                a, z = int(first[i]), int(first[i + 1])
                cut = (z - a) // window * window
                for s in range(0, cut, window):
                    for k, v in zip(full, (doc_ids[i], s, window, zlib.crc32(own[a + s : a + s + window].tobytes()), z - a, (task << 32 | full_seen) * 2, 0)):
                        full[k].append(v)
                    full_seen += 1
                if a + cut < z:
                    tail = own[a + cut : z]
                    terms = np.unique(tail)
                    df[terms] += 1
                    for k, v in zip(tails, (doc_ids[i], cut, len(tail), z - a, tail.tobytes(), int(order[terms].min()))):
                        tails[k].append(v)
            yield _batch(FULL, len(full["start"]), **full)
            yield _batch(TAIL, len(tails["start"]), **tails)
        held = np.flatnonzero(df)
        yield _batch(COUNT, len(held), token=held.astype(np.int32), docs=df[held])

    return run


class _Shard:
    """BM25 inverted index over tails; `take` removes, `rank` orders the unused ones for a seed."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        rows, terms, weights = [], [], []
        for r, ids in enumerate(tails):
            t, tf = np.unique(ids, return_counts=True)
            keep = idf[t] > 0
            t, tf = t[keep], tf[keep]
            rows.append(np.full(len(t), r, np.int32))
            terms.append(t)
            weights.append(idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean)))
        self.rows, self.of = np.concatenate(rows), terms
        flat = np.concatenate(terms)
        by = np.argsort(flat, kind="stable")
        self.rows, self.weights = self.rows[by], np.concatenate(weights)[by]
        self.terms, self.begin = np.unique(flat[by], return_index=True)
        self.end = np.append(self.begin[1:], len(by))

    def rank(self, seed: int, unused: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, self.of[seed])
        begin, many = self.begin[at], (self.end - self.begin)[at]
        ends = np.cumsum(many)
        where = np.repeat(begin - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        scores = np.bincount(self.rows[where], self.weights[where], minlength=len(unused))
        left = np.flatnonzero(unused)
        return left[np.argsort(-scores[left], kind="stable")]


def _packed(window: int, n_docs: int, df: dict[int, int], mean: float, shard_ids: int):
    # as a dense vector over the vocabulary
    size = max(df, default=0) + 1
    counts = np.zeros(size)
    counts[list(df)] = list(df.values())
    idf = np.maximum(0.0, np.log((n_docs - counts + 0.5) / (counts + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 32, 0
        held: list[list] = []  # [doc_id, start, doc_tokens, ids]

        def fill(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, seen
            if not held:
                return
            shard = _Shard([t[3] for t in held], idf, mean)
            unused, out, left = np.ones(len(held), bool), [], sum(len(t[3]) for t in held)
            for seed in range(len(held)):
                if not unused[seed] or left < window and not last:
                    continue
                room, offset, neighbours = window, 0, None
                nxt = seed
                while True:
                    doc_id, start, total, ids = held[nxt]
                    piece = ids[:room]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), total, (base | seen) * 2 + 1, offset))
                    room, offset, left = room - len(piece), offset + len(piece), left - len(piece)
                    held[nxt] = [doc_id, start + len(piece), total, ids[len(piece) :]]
                    unused[nxt] = len(held[nxt][3]) > 0
                    if not room or not left:
                        break
                    neighbours = iter(shard.rank(seed, unused)) if neighbours is None else neighbours
                    nxt = next(neighbours)
                seen += 1
                if unused[seed]:  # a tail is shorter than a window, so this can't be
                    raise AssertionError("a seed was cut")
            held = [held[i] for i in np.flatnonzero(unused)]
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names=names)

        size = 0
        for b in batches:
            for doc_id, start, total, ids in zip(b["doc_id"].to_pylist(), b["start"].to_pylist(), b["doc_tokens"].to_pylist(), b["ids"].to_pylist()):
                held.append([doc_id, start, total, np.frombuffer(ids, "<u4")])
                size += len(ids) // 4
                if size >= shard_ids:
                    yield from fill(False)
                    size = sum(len(t[3]) for t in held)
        yield from fill(True)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = WINDOW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pieces of all documents; each id of a document (its end id included) lies in exactly one."""
    staged = saved(documents(docs).mapInArrow(_encoded(tokenizer, end_id, window), _STAGED), "packing")
    tails = staged.where(F.col("kind") == TAIL)
    df = {r.token: r.docs for r in staged.where(F.col("kind") == COUNT).groupBy("token").agg(F.sum("docs").alias("docs")).collect()}
    all_of = tails.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    dealt = tails.select("doc_id", "start", "doc_tokens", "ids", "key").repartitionByRange(input_parts(docs), "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start")
    packed = dealt.mapInArrow(_packed(window, all_of.n, df, all_of.mean or 1.0, shard_ids), PIECE)
    return staged.where(F.col("kind") == FULL).select(*[c.split()[0] for c in PIECE.split(", ")]).unionByName(packed)
