"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

1. Texts are lower-cased, every other ASCII character but letters and digits becomes a space, and the whole
   text is cut at spaces into windows of about WINDOW bytes (longer words are cut too).
2. Two dictionaries are trained on a bounded sample (`fit_rows` labelled
   documents that aren't held out, those of least id hash; a third of them is
   kept apart for 3). Both begin with the same BASE_BYTES trained on ordinary documents,
   so that a window without toxic words costs the same under either, and end
   with OWN_BYTES of their own: one trained on ordinary documents, one on the words of toxic
   documents that hold a five-byte string far more frequent there than in
   ordinary ones, which the base can't explain.
3. Each window is compressed with both. The difference of the two lengths, in
   bytes, is how much nearer it is to toxic text. A document's greatest and mean difference and the
   shares of its windows over each of a few differences go into a logistic
   model, calibrated on the third of the sample that no dictionary has seen.

Labels, language, source and doc_id are no inputs of a score. Labels of held
out documents aren't read for anything but the returned flag. Null and empty
texts have no window and get the score of a document without differences. A document with several labels
is toxic if one says so; null labels say nothing. Without labels of both kinds
every score is the share of toxic ones among those that may be learnt from (0
without any). Rows that repeat a doc_id are scored one by one. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import by_bytes, documents, flat_bytes, held_out, sampled, saved

FIT_ROWS = 20_000
WINDOW, LONGEST = 32, 64
BASE_BYTES, OWN_BYTES, LEVEL = 128 << 10, 768, 17
THRESHOLD = 0.7
#: How much more frequent a five-byte string must be in toxic documents.
RATIO, GRAM = 4.0, 5
#: Toxic documents that must hold it.
SUPPORT = 2
#: Differences whose share of windows the calibration looks at.
STEPS = (1, 2, 3, 4, 5, 6)
_BATCH = 4 << 20
_BUCKETS = 1 << 24
#: The offsets that end the tables of a trained dictionary, before its content: part of the zstandard format.
_REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
_PLAIN = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts end to end, each between two spaces, and where each begins."""
    data, at = flat_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    n = len(at) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    out[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(at)) + 1] = _PLAIN[data]
    return out, at + 2 * np.arange(n + 1)


def windows(data: np.ndarray, at: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of each window: whole words with the spaces around them, and at least `size` bytes."""
    cuts = np.flatnonzero(data == 32)
    wide = np.flatnonzero(np.diff(cuts) > LONGEST)
    if len(wide):  # a long word has places to cut of its own
        cuts = np.sort(np.concatenate([cuts, *(np.arange(cuts[w] + size, cuts[w + 1] - 1, size) for w in wide)]))
    following = np.searchsorted(cuts, cuts + size).tolist()
    first, last = np.searchsorted(cuts, at[:-1]).tolist(), np.searchsorted(cuts, at[1:] - 1).tolist()
    begin, end, owner = [], [], []
    for text, (i, stop) in enumerate(zip(first, last)):
        if at[text + 1] - at[text] == 2:  # no text
            continue
        while i < stop:
            j = min(following[i], stop)
            begin.append(i)
            end.append(j)
            owner.append(text)
            i = j
    start = cuts[begin] if begin else np.zeros(0, np.int64)
    return start, (cuts[end] + 1 - start if end else start), np.array(owner, np.int64)


class Press:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, dictionary: bytes, raw: bool, level: int = LEVEL):
        params = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
        self.dictionary = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
        self.dictionary.precompute_compress(compression_params=params)
        self.press = zstandard.ZstdCompressor(compression_params=params, dict_data=self.dictionary)

    def lengths(self, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.int64)
        segments = np.stack([start, length], axis=1).astype("<u8").tobytes()
        got = self.press.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments), threads=1)
        return np.fromiter((len(got[i]) for i in range(len(got))), np.int64, len(got))


def features(press: tuple[Press, Press], texts: pa.Array, step: int = 1 << 16) -> np.ndarray:
    """For each text: windows, greatest and summed difference, windows at or over each of STEPS."""
    data, at = plain(texts)
    start, length, owner = windows(data, at)
    raw, n = data.tobytes(), len(at) - 1
    parts = [press[0].lengths(raw, start[i : i + step], length[i : i + step]) - press[1].lengths(raw, start[i : i + step], length[i : i + step]) for i in range(0, len(start), step)]
    nearer = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, nearer)
    count = lambda w: np.bincount(owner, w, minlength=n).astype(np.int64)
    return np.stack([np.bincount(owner, minlength=n), most, count(nearer), *(count(nearer >= s) for s in STEPS)], axis=1)


def _trained(size: int, samples: list[bytes], d: int, k: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _content(dictionary: bytes) -> tuple[bytes, bytes]:
    at = dictionary.find(_REPEATS)
    return (dictionary[: at + 12], dictionary[at + 12 :]) if at >= 0 else (b"", dictionary)


def dictionaries(texts: pa.Array, toxic: np.ndarray, base_bytes: int = BASE_BYTES, own_bytes: int = OWN_BYTES) -> tuple[bytes, bytes, bool]:
    """(ordinary, toxic, whether both are plain content without tables) from labelled texts of both kinds."""
    data, at = plain(texts)
    seen: set[int] = set()
    docs: list[list[np.ndarray]] = [[], []]
    for i, label in enumerate(toxic.tolist()):  # copies teach once
        own = data[at[i] : at[i + 1]]
        if (h := xxhash.xxh3_64_intdigest(own.tobytes())) not in seen:
            seen.add(h)
            docs[label].append(own)

    def grams(own: np.ndarray) -> np.ndarray:
        n, value = max(len(own) - GRAM + 1, 0), np.uint64(0)
        for k in range(GRAM):
            value = value << np.uint64(8) | own[k : k + n].astype(np.uint64)
        return (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)

    held = np.zeros((2, _BUCKETS), np.uint16)  # documents of either kind with a string
    for label, some in enumerate(docs):
        for own in some:
            held[label][np.unique(grams(own))] += 1
    per = [max(len(some), 1) for some in docs]
    telling = []
    for own in docs[1]:
        of = grams(own)
        far = np.flatnonzero((held[1][of] >= SUPPORT) & (held[1][of] / per[1] >= RATIO * (held[0][of] + 0.5) / per[0]))
        spaces = np.flatnonzero(own == 32)
        between = np.searchsorted(spaces, far + GRAM - 1) - np.searchsorted(spaces, far + 1)
        far = far[between == 0]  # of one word: a space begins or ends it at most
        word = np.unique(np.searchsorted(spaces, far, "right"))
        cuts = [own[spaces[w - 1] : spaces[w] + 1].tobytes() for w in word.tolist() if 0 < w < len(spaces)]
        if cuts := sorted(set(cuts)):
            telling.append(b"".join(cuts))
    ordinary = [own.tobytes() for own in docs[0]]
    tables, base = _content(_trained(base_bytes, ordinary, 8, 64))
    if not tables:
        base = b"".join(ordinary)[-base_bytes:]
    like = ordinary[: max(len(docs[1]), 8)]
    own = [_content(_trained(own_bytes, some, 6, 8))[1] or b"".join(some)[-own_bytes:] for some in (like, telling)]
    size = min(map(len, own))
    return tables + base + own[0][len(own[0]) - size :], tables + base + own[1][len(own[1]) - size :], not tables


def _dictionaries(base_bytes: int, own_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # the bounded sample
        if sum(b.num_rows for b in got):
            t = pa.Table.from_batches(got).combine_chunks()
            ordinary, toxic, raw = dictionaries(t["text"].combine_chunks(), t["toxic"].to_numpy(), base_bytes, own_bytes)
            yield pa.RecordBatch.from_pydict({"ordinary": pa.array([ordinary], pa.binary()), "toxic": pa.array([toxic], pa.binary()), "raw": [raw]})

    return run


_FEATURES = ["n_windows", "most", "total", *(f"over_{s}" for s in STEPS)]


def _featured(ordinary: bytes, toxic: bytes, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = Press(ordinary, raw), Press(toxic, raw)
        for b in by_bytes(batches, _BATCH):
            columns = features(press, b["text"]).T
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["doc_id", *_FEATURES])

    return run


def _inputs() -> list[Column]:
    """What the calibration sees of a document, bounded in each direction."""
    n = F.col("n_windows")
    shares = [F.log((F.col(f"over_{s}") + 0.1) / (n + 3)) for s in STEPS]
    return [F.least("most", F.lit(24)).cast("double"), F.log1p(n.cast("double")), F.col("total") / F.greatest(n, F.lit(1)), *shares]


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> tuple[np.ndarray, float]:
    """(weights, constant) of a logistic model by Newton's method; each kind's rows weigh as the root of the other's number."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.where(y == 1, np.sqrt((y == 0).sum()), np.sqrt((y == 1).sum()))
    weight = weight / weight.mean()
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(hess, z.T @ (weight * (p - y)) + penalty * w)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 3, fold: int = 1, base_bytes: int = BASE_BYTES, own_bytes: int = OWN_BYTES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and, beside them, n_windows, most (the greatest difference in bytes) and total."""
    of = documents(docs)
    out = held_out(folds=folds, fold=fold)
    learn = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~out)
    learn = learn.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    sample = saved(sampled(learn, F.xxhash64("doc_id"), fit_rows).withColumn("later", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 0), "toxic-labels")
    told = F.broadcast(sample)  # fit_rows rows at most
    teach = of.join(told.where("not later"), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    # one row of each id, so copies under one id don't pass the bound
    teach = teach.groupBy("doc_id").agg(F.min_by("text", "h").alias("text"), F.first("toxic").alias("toxic")).where("text is not null")
    got = teach.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_dictionaries(base_bytes, own_bytes), "ordinary binary, toxic binary, raw boolean").collect()
    ordinary, toxic, raw = (bytes(got[0].ordinary), bytes(got[0].toxic), got[0].raw) if got else (b"", b"", True)
    fields = ", ".join(f"{c} bigint" for c in ["doc_id", *_FEATURES])
    seen = saved(of.mapInArrow(_featured(ordinary, toxic, raw), fields), "toxic-features")
    inputs = _inputs()
    fit = seen.join(told, "doc_id").groupBy("doc_id", "toxic", "later").agg(*(F.first(c).alias(c) for c in _FEATURES)).select("toxic", "later", F.array(*inputs).alias("x")).collect()  # fit_rows at most
    y = np.array([r.toxic for r in fit], float)
    later = np.array([r.later for r in fit], bool)
    if min(y[later].sum(), (1 - y[later]).sum()) < 5:
        later[:] = True  # too few to keep apart
    if 0 < y.sum() < len(y):
        w, constant = calibrated(np.array([r.x for r, k in zip(fit, later) if k], float), y[later])
        logit = sum((F.lit(float(a)) * c for a, c in zip(w, inputs)), F.lit(constant))
        value = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    else:
        value = F.lit(float(y.mean()) if len(y) else 0.0)
    result = seen.select("doc_id", out.alias("held_out"), value.alias("score"), "n_windows", "most", "total")
    return result.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows", "most", "total")
