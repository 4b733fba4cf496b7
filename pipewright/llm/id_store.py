"""Token-id output: binary shards with a shared compression dictionary.

File format. One folder with three Parquet tables, all written by Spark:

- ``dictionary``: one row (dict_hash, dictionary): a zstandard dictionary trained
  on the serialized id arrays of a bounded sample of whole documents, cut into pieces
  (empty if they make under 16 pieces or zstandard finds too little in them);
- ``blocks``: one row for each block of consecutive documents of a shard: shard,
  block, dict_hash, payload (the documents' zstandard frames laid end to end)
  and, beside it, the offset index: for each document its doc_id, the place of
  its frame (at, size), its number of ids and the ids before it in the shard;
- ``shards``: for each shard its ids and the ids of all shards before it.

A frame holds one document's ids as little-endian unsigned integers of
`width` bytes. A reader of one short document prunes to the index columns by
doc_id, then reads one block's payload, slices one frame and decompresses it
with the dictionary whose hash the block names.

Documents are dealt by ranges of (doc_id, hash of the text), so a shard holds
consecutive ids in ascending order and no task more than its range. Null
doc_ids come first; rows that repeat a doc_id are stored one by one, in the order of their
text's hash. A null text is empty and holds the end id alone. An empty table
gives empty `blocks` and `shards`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipewright.llm.common import by_bytes, documents, input_parts, sampled
from pipewright.llm.tokens import BATCH_BYTES, encoder

#: Documents the dictionary is trained on (the bound of the fit), and the ids in a piece of them.
SAMPLE_DOCS, PIECE_IDS, DICT_BYTES = 1_000, 2_000, 64 << 10
BLOCK_BYTES = 1 << 20
BLOCKS = "shard int, block int, dict_hash string, width int, payload binary, doc_ids array<bigint>, at array<int>, sizes array<int>, counts array<bigint>, starts array<bigint>"


def _sampled(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, samples = encoder(tokenizer), []
        for b in by_bytes(batches, BATCH_BYTES):
            ids, at = enc.encode(b["text"])
            samples += [ids[p : min(z, p + PIECE_IDS)].tobytes() for a, z in zip(at.tolist(), at[1:].tolist()) for p in range(a, z, PIECE_IDS)]
        trained = b""
        if len(samples) >= 16:
            try:
                trained = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
            except zstandard.ZstdError:  # too little to learn from: no dictionary
                trained = b""
        yield pa.RecordBatch.from_pydict({"dict_hash": [hashlib.sha256(trained).hexdigest()], "dictionary": pa.array([trained], pa.binary())})

    return run


def train(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[str, bytes]:
    """(hash, dictionary) from the SAMPLE_DOCS documents of least hash: a bounded fit."""
    sample = sampled(documents(docs).where("text is not null"), F.xxhash64("doc_id", "text"), SAMPLE_DOCS)
    got = sample.coalesce(1).mapInArrow(_sampled(tokenizer, end_id), "dict_hash string, dictionary binary").collect()
    return (got[0].dict_hash, bytes(got[0].dictionary)) if got else (hashlib.sha256(b"").hexdigest(), b"")


def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=True, write_checksum=False, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=d)


def _blocks(tokenizer: str, end_id: int, dict_hash: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        press = _codec(dictionary)[0].compress
        width = max(enc.dtype.itemsize, 2 if end_id <= 0xFFFF else 4)
        dtype = np.dtype(f"<u{width}")
        end = np.array([end_id], dtype).tobytes()
        for b in by_bytes(batches, BATCH_BYTES):
            ids, at = enc.encode(b["text"])
            raw, doc_ids = ids.astype(dtype, copy=False).tobytes(), b["doc_id"].to_pylist()
            frames = [press(raw[a * width : z * width] + end) for a, z in zip(at.tolist(), at[1:].tolist())]
            counts, first = np.diff(at) + 1, 0
            places = np.cumsum([0, *map(len, frames)])
            while first < len(frames):
                last = max(first + 1, int(np.searchsorted(places, places[first] + BLOCK_BYTES, "right")) - 1)
                n = counts[first:last]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                    "dict_hash": [dict_hash], "width": pa.array([width], pa.int32()),
                    "payload": pa.array([b"".join(frames[first:last])], pa.binary()),
                    "doc_ids": pa.array([doc_ids[first:last]], pa.list_(pa.int64())),
                    "at": pa.array([places[first:last] - places[first]], pa.list_(pa.int32())),
                    "sizes": pa.array([np.diff(places[first : last + 1])], pa.list_(pa.int32())),
                    "counts": pa.array([n], pa.list_(pa.int64())),
                    "starts": pa.array([before + np.cumsum(n) - n], pa.list_(pa.int64())),
                })
                before, block, first = before + int(n.sum()), block + 1, last

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> str:
    """Encodes every whole text, appends `end_id` to each and writes the store to `path`."""
    spark = docs.sparkSession
    dict_hash, dictionary = train(docs, tokenizer, end_id)
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")
    ranged = documents(docs).withColumn("h", F.xxhash64("text"))
    ranged = ranged.repartitionByRange(input_parts(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ranged.mapInArrow(_blocks(tokenizer, end_id, dict_hash, dictionary), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)")).alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("shard", "n_ids", before.alias("before")).coalesce(1).write.parquet(f"{path}/shards")
    return path


def _read(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = _codec(dictionary)[1].decompress
        for b in batches:
            for r in range(b.num_rows):
                payload, dtype = b["payload"][r].as_buffer(), np.dtype(f"<u{b['width'][r].as_py()}")
                crcs, counts, view = [], [], memoryview(payload)
                for at, size in zip(b["at"][r].as_py(), b["sizes"][r].as_py()):
                    ids = np.frombuffer(plain(view[at : at + size]), dtype)
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    counts.append(len(ids))
                n = len(crcs)
                base = b["before"][r].as_py()
                starts = np.array(b["starts"][r].as_py(), np.int64) + base
                yield pa.RecordBatch.from_arrays([b["doc_ids"][r].values, pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array([b["shard"][r].as_py()] * n, pa.int32()), pa.array([b["block"][r].as_py()] * n, pa.int32())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"])

    return run


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.dict_hash:
        raise ValueError(f"{path}: the dictionary isn't the one its hash names")
    return row.dict_hash, bytes(row.dictionary)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each stored document, from its decompressed frame: doc_id, start, n_tokens, ids_crc32, shard, block."""
    dict_hash, dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("dict_hash") == dict_hash)
    placed = blocks.join(spark.read.parquet(f"{path}/shards").select("shard", "before"), "shard")
    return placed.mapInArrow(_read(dictionary), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int, block int")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row that has its id), by the offset index."""
    _, dictionary = _dictionary(spark, path)
    found = spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", doc_id)).select("width", "payload", F.explode(F.arrays_zip("doc_ids", "at", "sizes")).alias("e")).where(F.col("e.doc_ids") == doc_id)
    rows = found.select("width", F.expr("substring(payload, e.at + 1, e.sizes)").alias("frame")).collect()
    plain = _codec(dictionary)[1].decompress
    return [np.frombuffer(plain(bytes(r.frame)), np.dtype(f"<u{r.width}")) for r in rows]
