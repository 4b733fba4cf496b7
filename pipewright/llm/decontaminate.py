"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are
lowered. A pattern is a window of `width` consecutive words of a benchmark
item; an item of fewer, but at least one, is one pattern. Patterns of one length are
searched together. Over all patterns of m words, the shift table holds for each block
of two words (one, if m is one) how far the search may skip when the
block ends at the current position: m - 1 for blocks in no pattern. Where
the shift is zero, the block's bucket holds the patterns that end in it;
their hash of the words before selects some, and direct comparison of all words
confirms. Every word inside an occurrence is hit.

The benchmark is a test set, small beside the corpus, but it isn't taken to
be: its words are counted, and tables are built for blocks of items of at most
`block_words` words. Each block is one pass over the rows; between two blocks the rows
and their hits are written to the shared folder, so neither the driver nor a
task holds more than one block and its tables.

Null and empty texts have no words and are clean. Rows that repeat a doc_id
are judged one by one; items that repeat an item_id count once. Null item ids
hit words but name no item. An empty benchmark leaves every document
clean; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import apart, dropped, saved

WIDTH = 10
#: Benchmark words whose tables are sent to the tasks at once (about 300 bytes each).
BLOCK_WORDS = 200_000
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Patterns:
    """Shift tables and buckets for patterns of one length."""

    def __init__(self, m: int):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[int, list[tuple[tuple[bytes, ...], set]]]] = {}

    def add(self, pattern: tuple[bytes, ...], item) -> None:
        m, b = self.m, self.block
        for end in range(b, m + 1):
            block = pattern[end - b : end]
            self.shift[block] = min(self.shift.get(block, self.most), m - end)
        bucket = self.buckets.setdefault(pattern[m - b :], {}).setdefault(hash(pattern[: m - b]), [])
        for known, items in bucket:
            if known == pattern:
                items.add(item)
                return
        bucket.append((pattern, {item}))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, items) of each occurrence."""
        m, b, most, n = self.m, self.block, self.most, len(text)
        skip, buckets, i = self.shift.get, self.buckets, m
        while i <= n:
            block = (text[i - 2], text[i - 1]) if b == 2 else (text[i - 1],)
            step = skip(block, most)
            if step:
                i += step
                continue
            before = tuple(text[i - m : i - b])
            for pattern, items in buckets[block].get(hash(before), ()):
                if pattern[: m - b] == before:
                    yield i - m, items
            i += 1


def tables(items: list[tuple[object, str | None]], width: int = WIDTH) -> list[Patterns]:
    by: dict[int, Patterns] = {}
    for item, text in items:
        w = words(text)
        m = min(width, len(w))
        for k in range(len(w) - m + 1) if m else ():
            by.setdefault(m, Patterns(m)).add(tuple(w[k : k + m]), item)
    return [*by.values()]


def _searched(items: list[tuple[object, str | None]], width: int):
    """Adds to _hits (a bit for each word) and _items."""
    made: list[list[Patterns]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(tables(items, width))
        for b in batches:
            texts, at = b["text"], b.schema.get_field_index("_n_words")
            sizes, bits, found = [], [], []
            for text, had, known in zip(texts, b["_hits"], b["_items"]):
                w = words(text.as_py())
                marked = np.zeros(len(w), bool)
                if had.is_valid:
                    marked |= np.unpackbits(np.frombuffer(had.as_py(), np.uint8), count=len(w)).astype(bool)
                its = set(known.as_py() or ())
                for p in made[0]:
                    for k, items_ in p.search(w):
                        marked[k : k + p.m] = True
                        its |= items_
                sizes.append(len(w))
                bits.append(np.packbits(marked).tobytes() if marked.any() else None)
                found.append(sorted(x for x in its if x is not None))
            new = {"_n_words": pa.array(sizes, pa.int64()), "_hits": pa.array(bits, pa.binary()), "_items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(f, b[f]) if f in new else b[f] for f in b.schema.names], names=b.schema.names)

    return run


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of about `block_words` words, which pass the driver one at a time."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sized = item.withColumn("_n", F.size(F.split("text", " ")))
    total = sized.agg(F.sum("_n")).first()[0] or 0
    count = max(1, -(-total // block_words))
    for k in range(count):
        part = item if count == 1 else item.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield [(r.item_id, r.text) for r in part.distinct().collect()]


def searched(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All columns of `docs` with _n_words, _hits (null: none) and _items."""
    docs = docs.withColumns({"_n_words": F.lit(None).cast("bigint"), "_hits": F.lit(None).cast("binary"), "_items": F.lit(None).cast("array<string>")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    reading = None
    for n, block in enumerate(blocks(benchmark, block_words)):
        if n:  # one block's tables go before the next one's are made
            docs = saved(docs, "hits")
            if reading is not None:
                dropped(reading)
            reading = docs
        docs = docs.mapInArrow(_searched(block, width), schema)
    return docs


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits = [int(np.unpackbits(np.frombuffer(h.as_py(), np.uint8)).sum()) if h.is_valid else 0 for h in b["_hits"]]
        items = [x.as_py() for x in b["_items"]]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["_n_words"], pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    found = searched(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, width, block_words)
    return found.mapInArrow(_digest, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of `docs` without any hit."""
    return apart(docs, lambda d: searched(d, benchmark, width, block_words).where("_hits is null"))
