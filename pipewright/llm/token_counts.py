"""Token counts of sections or fields by offset mapping.

Each whole text is encoded once with character offsets. Its sections are character
intervals: its lines (each with the newline that ends it), the intervals of a
table, or the fields it was joined from. An interval join lays every token span on them. A token that
crosses a boundary is allocated by rule:

- ``start``: to the section of its first character;
- ``end``: to the section of its last character;
- ``majority``: to the section with most of its characters, the earlier at a tie.

So section counts add up to the document's count under each rule. Null and
empty texts have no section and give one row with section -1 and zero
tokens. Rows that repeat a doc_id are counted one by one. An empty table gives
no rows.

Intervals of a table (doc_id, section, start, stop) may leave parts of a text out; what lies
in none of them is one row more, of section -1. They are cut to the text, and
where two overlap the one that begins earlier (then ends earlier, then has the smaller number) has
the characters. Each row of a repeated doc_id has all intervals of that id. Fields are
joined with a separator, which counts as outside; a null field is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm.common import by_bytes, documents, flat_bytes
from pipewright.llm.tokens import BATCH_BYTES, encoder

RULES = ("start", "end", "majority")
COUNTS = "doc_id bigint, section bigint, start bigint, n_chars bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"


def sections(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(start character of each line over texts laid end to end, start character of each text and the end)."""
    data, at = flat_bytes(texts)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    after = np.flatnonzero(data == 10) + 1
    after = after[~np.isin(after, at[1:])]
    return np.sort(before[np.concatenate([at[:-1][np.diff(at) > 0], after])]), before[at]


def allocated(spans: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(the section of each token, whether it crosses a boundary)."""
    first = np.searchsorted(bounds, spans[:, 0], "right") - 1
    last = np.maximum(first, np.searchsorted(bounds, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1)
    top = len(bounds) - 2
    first, last = np.clip(first, 0, top), np.clip(last, 0, top)
    crossing = last > first
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    best = first.copy()
    most = np.minimum(spans[:, 1], bounds[first + 1]) - spans[:, 0]
    for step in range(1, int((last - first).max(initial=0)) + 1):
        at = np.minimum(first + step, last)
        here = np.minimum(spans[:, 1], bounds[at + 1]) - np.maximum(spans[:, 0], bounds[at])
        better = (first + step <= last) & (here > most)
        best, most = np.where(better, at, best), np.where(better, here, most)
    return best, crossing


NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def _rows(doc_ids: pa.Array, owner: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(owner)), *(pa.array(c.astype(np.int64)) for c in columns)], names=NAMES)


def _counted(tokenizer: str, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in by_bytes(batches, BATCH_BYTES // 2):
            spans, tokens = enc.offsets(b["text"])
            starts, at = sections(b["text"])
            owner = np.searchsorted(at[:-1], starts, "right") - 1  # the text of each section
            bounds, many = np.append(starts, at[-1]), np.diff(tokens)
            n = len(starts)
            if n:
                of, crossing = allocated(spans + np.repeat(at[:-1], many)[:, None], bounds, rule)
                first = np.searchsorted(starts, at[owner])
                yield _rows(b["doc_id"], owner, [np.arange(n) - first, starts - at[owner], np.diff(bounds), np.bincount(of, minlength=n), np.bincount(of[crossing], minlength=n), many[owner]])
            none = np.flatnonzero(np.diff(at) == 0)
            yield _rows(b["doc_id"], none, [np.full(len(none), -1), *[np.zeros(len(none), np.int64)] * 5])

    return run


def segments(given: list[list[dict] | None], at: np.ndarray) -> np.ndarray:
    """(section, start over all texts, text) of every interval and of the parts between them (-1), which fill each text."""
    out = []
    for text, own in enumerate(given):
        place, end = int(at[text]), int(at[text + 1])
        for s in sorted(own or [], key=lambda s: (s["start"], s["stop"], s["section"])):
            a = min(max(int(at[text]) + s["start"], place), end)
            if a > place:
                out.append((-1, place, text))
            out.append((s["section"], a, text))
            place = min(max(int(at[text]) + s["stop"], a), end)
        if place < end or not own:
            out.append((-1, place, text))
    return np.array(out, np.int64).reshape(-1, 3)


def _laid(tokenizer: str, rule: str):
    """As _counted, on the intervals that come with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in by_bytes(batches, BATCH_BYTES // 2):
            spans, tokens = enc.offsets(b["text"])
            size = pc.utf8_length(pc.fill_null(b["text"].cast(pa.large_string()), "")).to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            parts, many = segments(b["given"].to_pylist(), at), np.diff(tokens)
            section, start, owner = parts.T
            n, bounds = len(parts), np.append(start, at[-1])
            of, crossing = allocated(spans + np.repeat(at[:-1], many)[:, None], bounds, rule) if len(spans) else (np.zeros(0, np.int64),) * 2
            counts = [np.diff(bounds), np.bincount(of, minlength=n), np.bincount(of[crossing.astype(bool)], minlength=n)]
            inside = section >= 0
            yield _rows(b["doc_id"], owner[inside], [section[inside], (start - at[owner])[inside], *(c[inside] for c in counts), many[owner][inside]])
            rest = np.flatnonzero(~inside)
            texts, first = np.unique(owner[rest], return_index=True)
            if len(rest):
                yield _rows(b["doc_id"], texts, [np.full(len(texts), -1), (start - at[owner])[rest][first], *(np.add.reduceat(c[rest], first) for c in counts), many[texts]])

    return run


def _checked(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")


def count(docs: DataFrame, tokenizer: str, rule: str = "majority", intervals: DataFrame | None = None) -> DataFrame:
    """Tokens of each section of each whole text: of its lines, or of the table's intervals (doc_id, section >= 0, start, stop)."""
    _checked(rule)
    if intervals is None:
        return documents(docs).mapInArrow(_counted(tokenizer, rule), COUNTS)
    section = F.struct(*(F.col(c).cast("bigint").alias(c) for c in ("section", "start", "stop")))
    # the intervals of one document: no more than its own
    given = intervals.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_list(section).alias("given"))
    return documents(docs).join(given, "doc_id", "left").mapInArrow(_laid(tokenizer, rule), COUNTS)


def count_fields(docs: DataFrame, tokenizer: str, fields: list[str], rule: str = "majority", separator: str = "\n") -> DataFrame:
    """Tokens of each field in the text that a document's fields make, joined and encoded whole; `field` is null for the separators."""
    _checked(rule)
    if not fields:
        raise ValueError("at least one field is needed")
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    ends, sections = F.lit(0).cast("bigint"), []
    for k, v in enumerate(values):
        start = ends + len(separator) if k else ends
        ends = start + F.length(v)
        sections.append(F.struct(F.lit(k).cast("bigint").alias("section"), start.alias("start"), ends.alias("stop")))
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.concat_ws(separator, *values).alias("text"), F.array(*sections).alias("given"))
    counted = joined.mapInArrow(_laid(tokenizer, rule), COUNTS)
    return counted.withColumn("field", F.try_element_at(F.array(*(F.lit(f) for f in fields)), F.when(F.col("section") >= 0, F.col("section") + 1).cast("int")))
