"""run() against brute force, stage by stage; odd tables through every stage."""

import collections
import math
import os
import zlib

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from cases import PASSAGE, docs, empty
from pipewright.llm import quality
from pipewright.llm.common import saved, swept
from test_llm_dedup import brute_components, brute_print
from test_llm_quality import brute_hits

SF = "/root/testdata/sf0.001"


def brute_quality(rows, labels):
    """rows: (doc_id, text); those drawn."""
    good = sorted(i for i, q, t in labels if q == 1 and t == 0)
    hashed = lambda w: xxhash.xxh64_intdigest(w, quality.SEED)
    mask = (1 << 64) - 1

    def pair(a, b):
        x = (a * 0x9E3779B97F4A7C15 & mask) ^ b
        return ((x ^ x >> 31) * 0xBF58476D1CE4E5B9 & mask) >> 40

    def grams(text):
        h = [hashed(w) for w in (text or "").lower().split()]
        return [[x >> 40 for x in h], [pair(a, b) for a, b in zip(h, h[1:])]]

    own = {i: [[x % quality.BUCKETS for x in g] for g in grams(t)] for i, t in rows}
    score = {}
    for o in range(2):
        raw = collections.Counter(x for g in own.values() for x in g[o])
        target = collections.Counter(x for i in good for x in own[i][o])
        r, t = sum(raw.values()), sum(target.values())
        ratio = {x: math.log((target[x] + 1) / (raw[x] / r * t + 1)) for x in raw}
        mean = {i: np.mean([ratio[x] for x in g[o]]) if g[o] else None for i, g in own.items()}
        fit = [mean[i] for i in good if mean[i] is not None]
        for i, m in mean.items():
            score.setdefault(i, []).append(None if m is None else (m - np.mean(fit)) / np.std(fit))
    weight = {i: min((x for x in s if x is not None), default=None) for i, s in score.items()}
    return weight, round(len(good) / len(labels) * len(rows))


def test_run_like_brute_force(spark):
    con = duckdb.connect()
    rows = sorted(con.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    labels = con.sql(f"select doc_id, quality, toxic from '{SF}/labels.parquet'").fetchall()
    items = con.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    source = spark.read.parquet(f"{SF}/documents.parquet")

    # 1: weights, and the drawn are those of largest key
    judged = quality.resampled(source, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    weight, k = brute_quality(rows, labels)
    assert all(abs(r._weight - weight[r.doc_id]) < 1e-9 for r in judged)
    cut = sorted((r._key for r in judged), reverse=True)[k - 1]
    drawn = {r.doc_id for r in judged if r._key >= cut}
    assert drawn == {r.doc_id for r in judged if r._kept}
    rows = [r for r in rows if r[0] in drawn]

    # 2: the least doc_id of each component
    label = brute_components([brute_print(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if label[k] == k]

    # 3: passages of 100 bytes that start earlier go
    seen, left = set(), []
    for i, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 99):
            gone[a : a + 100] |= raw[a : a + 100] in seen
            seen.add(raw[a : a + 100])
        left.append((i, bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")))

    # 4: texts with a benchmark window go
    hit = {r[0]: r[5] for r in brute_hits(left, items)}
    left = {i: t for i, t in left if not hit[i]}

    # 5: every id of what is left lies in one piece
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == left.keys()
    for i, t in left.items():
        own, at = np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(own[at : at + p.length].tobytes())
            at += p.length
        assert at == len(own)


@pytest.mark.parametrize("table", ["cases", "empty"])
def test_odd_tables_through_every_stage(spark, tmp_path, table):
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (10, 1, 0), (12, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs(spark, repeat=True) if table == "cases" else empty(spark)
    columns = now.columns
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = saved(function(spark, now, str(tmp_path)), name)
        assert now.columns == columns
        assert now.count() > 0 or table == "empty"
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert (last.count() > 0) == (table == "cases")


def test_stages_are_the_dealt_ones_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "passage_dedup", "decontamination", "packing"]


def test_swept_keeps_what_is_read(spark):
    made = []
    from pipewright.llm.common import recorded

    with recorded(made):
        a, b = saved(spark.range(3), "a"), saved(spark.range(4), "b")
    swept(made, a)
    assert len(made) == 1 and a.count() == 3 and not os.path.exists(b.inputFiles()[0].removeprefix("file://"))
