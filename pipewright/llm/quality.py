"""Importance resampling: target and raw n-gram models, sampled by Gumbel top-k.

The n-grams of orders 1 and 2 over a text's lower-cased whole words are hashed to BUCKETS buckets an order.
For each order two generative models are counted: the raw one over every document,
the target one over a bounded sample of documents labelled quality 1 and
toxic 0 (`fit_rows`, those of least id hash). An n-gram's log ratio is
log((t + 1) / (e + 1)): t its target count, e the count expected of that many
n-grams under the raw model, so n-grams with little evidence stay near zero.
A document's log weight for an order is its mean log ratio, standardized over the
target sample; its weight is the least over the orders, as a document must be
likely under each.

Gumbel top-k draws without replacement: key = weight / temperature + a Gumbel
variate from a hash of doc_id (of the text where that is null), and the k documents of largest key are kept, k
being the target's share of the labelled documents times all documents. The k-th key
is found by counting keys, digit by digit; documents tied with it are kept.

Null and empty texts have no n-gram and the least weight. Documents that
repeat a doc_id are judged one by one. A document with several labels is
target if all say so; null labels say nothing. Without any target document
all are kept. An empty table gives no rows. Other columns keep their names and values,
but for _weight, _key and _kept, which `resampled` gives itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import apart, by_bytes, documents, sampled, saved

BUCKETS, ORDERS = 1 << 18, 2
#: Counts are sent and added up in parts of so many buckets.
_PART = 1 << 13
FIT_ROWS = 50_000
TEMPERATURE, SEED = 0.05, 7
#: Keys are multiples of 2**-20 between plus and minus 2**11.
_DIGITS = (22, 11, 0)
_BATCH = 6 << 20


def ngrams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket of each n-gram of all texts by order, and the number of words before each text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.utf8_lower(texts.cast(pa.large_string())), ""))
    words, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    coded = pc.dictionary_encode(words)
    known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]
    pairs = (pairs ^ pairs >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    two = (pairs >> np.uint64(40)).astype(np.int64) % BUCKETS
    two[starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(hashes))] - 1] = -1  # across texts
    return [(hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, two], starts


def _counted(ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros((ORDERS, BUCKETS), np.int64), np.zeros((ORDERS, BUCKETS), np.int64)
        for b in by_bytes(batches, _BATCH):
            grams, starts = ngrams(b["text"])
            chosen = np.isin(b["doc_id"].to_numpy(zero_copy_only=False), ids) & b["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            word = np.repeat(chosen, np.diff(starts))
            for o, g in enumerate(grams):
                raw[o] += np.bincount(g[g >= 0], minlength=BUCKETS)
                target[o] += np.bincount(g[(g >= 0) & word[: len(g)]], minlength=BUCKETS)
        both = np.stack([raw.ravel(), target.ravel()], axis=1)
        parts = [k for k in range(0, len(both), _PART) if both[k : k + _PART].any()]
        yield _parts([k // _PART for k in parts], [both[k : k + _PART] for k in parts])

    return run


def _parts(numbers: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([zstandard.compress(np.ascontiguousarray(c.T).tobytes(), 1) for c in counts], pa.binary())], names=["part", "counts"])


def _opened(counts: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(counts), np.int64).reshape(2, -1).T


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by number -> the sum of each."""
    now, total = None, None
    for b in batches:
        for part, counts in zip(b["part"].to_pylist(), b["counts"]):
            if part != now:
                if now is not None:
                    yield _parts([now], [total])
                now, total = part, 0
            total = total + _opened(counts.as_py())
    if now is not None:
        yield _parts([now], [total])


def _scored(ids: np.ndarray, ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, _BATCH):
            grams, starts = ngrams(b["text"])
            sampled = np.isin(b["doc_id"].to_numpy(zero_copy_only=False), ids) & b["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            means = []
            for o, g in enumerate(grams):
                sums = np.concatenate([[0.0], np.cumsum(np.where(g >= 0, ratios[o][g], 0.0))])
                many = np.maximum(np.diff(starts) - o, 0)
                total = sums[np.minimum(starts[1:], len(g))] - sums[np.minimum(starts[:-1], len(g))]
                means.append(np.where(many > 0, total / np.maximum(many, 1), np.nan))
            least = [pa.array(m, pa.float64(), mask=np.isnan(m)) for m in means]
            yield pa.RecordBatch.from_arrays([*b.columns, *least, pa.array(sampled)], names=[*b.schema.names, "_one", "_two", "_sampled"])

    return run


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def weighted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, float]:
    """All columns of `docs` with `_weight` (null: no n-gram), and the target's share of the labelled documents."""
    judged = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    share = judged.agg(F.avg(F.col("good").cast("int"))).first()[0]
    sample = sampled(judged.where("good"), F.xxhash64("doc_id"), fit_rows).select("doc_id").collect()
    ids = np.array([r.doc_id for r in sample], np.int64)
    counted = documents(docs).mapInArrow(_counted(ids), "part int, counts binary").repartition("part").sortWithinPartitions("part")
    both = np.zeros((ORDERS * BUCKETS, 2), np.int64)
    for r in counted.mapInArrow(_added, "part int, counts binary").collect():  # ORDERS * BUCKETS / _PART rows at most
        both[r.part * _PART : (r.part + 1) * _PART] = _opened(bytes(r.counts))
    raw, target = both.astype(float).T
    raw, target = raw.reshape(ORDERS, -1), target.reshape(ORDERS, -1)
    expected = raw / np.maximum(raw.sum(1, keepdims=True), 1) * target.sum(1, keepdims=True)
    ratios = np.log((target + 1) / (expected + 1))
    scored = saved(docs.mapInArrow(_scored(ids, ratios), _fields(docs) + ", _one double, _two double, _sampled boolean"), "weights")
    fit = scored.where("_sampled").agg(*(f(c) for c in ("_one", "_two") for f in (F.avg, F.stddev_pop))).first()
    parts = [(F.col(c) - (fit[2 * i] or 0.0)) / (fit[2 * i + 1] or 1.0) for i, c in enumerate(("_one", "_two"))]
    return scored.withColumn("_weight", F.least(*parts)).drop("_one", "_two", "_sampled"), (1.0 if not len(ids) else float(share))


OWN = ["_weight", "_key", "_kept"]


def resampled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """All columns of `docs` with _weight, _key and _kept."""
    names = docs.columns
    aside = [c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(names)]
    judged = _resampled(docs.toDF(*aside), labels, fit_rows, temperature, seed)
    return judged.select(*[F.col(a).alias(c) for a, c in zip(aside, names) if c not in OWN], *OWN)


def _resampled(docs: DataFrame, labels: DataFrame, fit_rows: int, temperature: float, seed: int) -> DataFrame:
    scored, share = weighted(docs, labels, fit_rows)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.when(F.col("doc_id").isNull(), F.col("text"))), 11) + 0.5) * 2.0**-53
    key = F.coalesce(F.col("_weight"), F.lit(-1e6)) / temperature - F.log(-F.log(uniform))
    scored = scored.withColumn("_key", F.round(F.greatest(F.least(key, F.lit(2047.0)), F.lit(-2047.0)) * 2**20).cast("bigint"))
    left = round(share * scored.count())
    if share >= 1.0:
        return scored.withColumn("_kept", F.lit(True)).withColumn("_key", F.col("_key") * 2.0**-20)
    within, high = F.lit(True), 0
    for digit in _DIGITS:  # the k-th largest key, eleven bits at a time
        counts = scored.where(within).groupBy(F.shiftright("_key", digit).alias("d")).agg(F.count("*").alias("n")).collect()
        for d, n in sorted(((r.d, r.n) for r in counts), reverse=True):
            if left <= n:
                high, within = d, F.shiftright("_key", digit) == d
                break
            left -= n
    return scored.withColumn("_kept", F.col("_key") >= high).withColumn("_key", F.col("_key") * 2.0**-20)


def drawn(docs: DataFrame, labels: DataFrame, **fit) -> DataFrame:
    """The documents drawn; the columns of `docs`."""
    return apart(docs, lambda d: resampled(d, labels, **fit).where("_kept"))
