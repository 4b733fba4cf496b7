import os
import random
import zlib
from collections import defaultdict

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cases import docs, empty, texts
from pipewright.llm import id_store, packing, token_counts
from pipewright.llm.tokens import Encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ENC = {p: Encoder(p) for p in (BYTE, WORD)}


def ids(path, text):
    return LIB[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n'aSeztd,.!é5ß \t日<|endoftext>ñ"), max_size=40), min_size=1, max_size=5))
def test_ids_are_the_librarys(path, some):
    flat, at = ENC[path].encode(pa.array(some))
    assert [flat[a:z].tolist() for a, z in zip(at, at[1:])] == [ids(path, t) for t in some]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_of_the_cases(path):
    some = [t for _, t in texts()]
    flat, at = ENC[path].encode(pa.array(some, pa.string()))
    assert [flat[a:z].tolist() for a, z in zip(at, at[1:])] == [ids(path, t) for t in some]


@pytest.mark.parametrize("repeat", [False, True])
def test_id_store_round_trip(spark, tmp_path, repeat):
    df = docs(spark, repeat=repeat)
    id_store.write(df, f"{tmp_path}/s", WORD, 2)
    got = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in id_store.read(spark, f"{tmp_path}/s").orderBy("start").collect()]
    starts = [r.start for r in id_store.read(spark, f"{tmp_path}/s").orderBy("start").collect()]
    want = []
    for r in df.collect():
        own = [*ids(WORD, r.text), 2]
        want.append((r.doc_id, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert [g[0] is not None and g[0] for g in got] == sorted((g[0] is not None and g[0] for g in got))
    assert starts == [0, *np.cumsum([g[1] for g in got])[:-1].tolist()]
    if not repeat:
        assert [x.tolist() for x in id_store.lookup(spark, f"{tmp_path}/s", 7)] == [[*ids(WORD, "one"), 2]]


def test_id_store_dictionary_is_checked(spark, tmp_path):
    id_store.write(docs(spark), f"{tmp_path}/s", WORD, 2)
    spark.createDataFrame([("no hash", bytearray(b"x"))], "dict_hash string, dictionary binary").write.mode("overwrite").parquet(f"{tmp_path}/s/dictionary")
    with pytest.raises(ValueError):
        id_store.read(spark, f"{tmp_path}/s")


def test_empty_tables(spark, tmp_path):
    id_store.write(empty(spark), f"{tmp_path}/s", WORD, 2)
    assert id_store.read(spark, f"{tmp_path}/s").count() == 0
    assert packing.pack(empty(spark), BYTE).count() == 0
    assert token_counts.count(empty(spark), BYTE).count() == 0


@pytest.mark.parametrize("shard_ids", [2_000, 100_000])
def test_packing_lays_every_id_once(spark, shard_ids):
    df = docs(spark)
    pieces, seqs = defaultdict(list), defaultdict(list)
    rows = packing.pack(df, BYTE, 0, shard_ids=shard_ids).collect()
    for r in rows:
        pieces[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for r in df.where("doc_id is not null").collect():
        own, at = np.array([*ids(BYTE, r.text), 0], "<u4"), 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(own[at : at + p.length].tobytes())
            at += p.length
        assert at == len(own)
    assert sum(p.length for p in pieces[None]) == sum(len(ids(BYTE, t)) + 1 for i, t in texts() if i is None)
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(1 for s in seqs.values() if sum(p.length for p in s) < 1024) <= n_tasks


def test_packing_prefers_lexical_neighbours():
    idf = np.full(100, 1.0)
    tails = [np.array([1, 2, 3, 4]), np.array([50, 51, 52, 53]), np.array([1, 2, 3, 9]), np.array([60, 61])]
    order = packing._Shard(tails, idf, 4.0).rank(0, np.array([False, True, True, True]))
    assert order[0] == 2


def test_packing_repeated_rows(spark):
    rows = [(1, "some words here"), (1, "some words here"), (1, "other words")]
    got = packing.pack(docs(spark, rows), BYTE).collect()
    assert sum(r.length for r in got) == sum(len(ids(BYTE, t)) + 1 for _, t in rows)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    df = docs(spark, repeat=True)
    want = []
    for r in df.collect():
        if not r.text:
            want.append((r.doc_id, -1, 0, 0, 0, 0, 0))
            continue
        spans, bounds = LIB[BYTE].encode(r.text, add_special_tokens=False).offsets, [0]
        for line in r.text.splitlines(keepends=True) if set(r.text).isdisjoint("\r\t\x0b\x0c\x1c\x1d\x1e\x85  ") else [x for x in r.text.replace("\n", "\n\0").split("\0") if x]:
            bounds.append(bounds[-1] + len(line))
        n = len(bounds) - 1
        tokens, crossing = [0] * n, [0] * n
        for a, z in spans:
            over = [max(0, min(z, bounds[k + 1]) - max(a, bounds[k])) for k in range(n)]
            touched = [k for k in range(n) if over[k]] or [max(k for k in range(n) if bounds[k] <= a)]
            k = {"start": touched[0], "end": touched[-1], "majority": max(touched, key=lambda k: (over[k], -k))}[rule]
            tokens[k] += 1
            crossing[k] += len(touched) > 1
        want += [(r.doc_id, k, bounds[k], bounds[k + 1] - bounds[k], tokens[k], crossing[k], len(spans)) for k in range(n)]
    order = lambda r: (r[0] is not None, *(x or 0 for x in r))
    assert sorted((tuple(r) for r in token_counts.count(df, BYTE, rule).collect()), key=order) == sorted(want, key=order)


def test_token_counts_rule_is_checked(spark):
    with pytest.raises(ValueError):
        token_counts.count(docs(spark), BYTE, "half")


def test_ids_and_spans_of_random_texts_with_a_small_memory():
    rng = random.Random(3)
    bits = ["a", "b", "It's", "we'll", "I'M", "'s", "''", "don't", "7", "42 7", "0", "x7y", "word", "Über", "ñandú", "!", "...", ",", "(x)", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "é", "<|endoftext|>", "日本", "–", "7 7", "\n7", "'", "re", "'re", "a'b"]
    for path in (BYTE, WORD):
        enc = Encoder(path, remembered=40)
        for _ in range(40):
            some = [None if rng.random() < 0.03 else (" " if rng.random() < 0.6 else "").join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(20)]
            (ids, at), (spans, first) = enc.encode(pa.array(some)), enc.offsets(pa.array(some))
            assert len(enc.ids.pieces) <= 40
            for i, t in enumerate(some):
                want = enc.tokenizer.encode(t or "", add_special_tokens=False)
                assert ids[at[i] : at[i + 1]].tolist() == want.ids
                assert [tuple(x) for x in spans[first[i] : first[i + 1]].tolist()] == want.offsets


def slow_sections(enc, text, given, rule):
    """(section, characters, tokens, crossing) of each interval and of the rest, token by token."""
    text = text or ""
    at, end = [], 0
    for s, a, z in sorted(given, key=lambda g: (g[1], g[2], g[0])):
        a = min(max(a, end), len(text))
        z = min(max(z, a), len(text))
        at.append((s, a, z))
        end = z
    owner = {}
    for s, a, z in at:
        owner |= {i: (s, a) for i in range(a, z)}
    gap, last = -1, None
    for i in range(len(text)):  # each part between intervals is a place of its own
        if i not in owner:
            gap = i if last != "gap" else gap
            owner[i] = (-1, gap)
            last = "gap"
        else:
            last = "in"
        if i + 1 < len(text) and any(a == z == i + 1 for _, a, z in at):
            last = "in"
    tokens, crossing = defaultdict(int), defaultdict(int)
    for a, z in enc.tokenizer.encode(text, add_special_tokens=False).offsets:
        places = [owner[i] for i in range(a, max(z, a + 1))]
        kinds = list(dict.fromkeys(places))
        to = {"start": places[0], "end": places[-1], "majority": max(kinds, key=lambda k: (places.count(k), -places.index(k)))}[rule]
        tokens[to] += 1
        crossing[to] += len(kinds) > 1
    rows = [(s, z - a, tokens[s, a] if z > a else 0, crossing[s, a] if z > a else 0) for s, a, z in at]
    rest = [k for k in set(owner.values()) if k[0] == -1]
    if rest or not given:
        rows.append((-1, sum(v[0] == -1 for v in owner.values()), sum(tokens[k] for k in rest), sum(crossing[k] for k in rest)))
    return sorted(rows)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_of_given_sections(spark, rule):
    rng = random.Random(11)
    some = [(i, t) for i, t in texts() if i not in (14,)]
    given = {}
    for i, t in some:
        n = len(t or "")
        given.setdefault(i, [(k, *sorted((rng.randint(0, n + 5), rng.randint(0, n + 5)))) for k in range(rng.randint(0, 4))])
    rows = [(i, s, a, z) for i, own in given.items() if i is not None for s, a, z in own] + [(12345, 0, 0, 9)]
    table = spark.createDataFrame(rows, "doc_id bigint, section bigint, start bigint, stop bigint")
    got = defaultdict(list)
    for r in token_counts.count(docs(spark, some), BYTE, rule, table).where("doc_id is not null").collect():
        got[r.doc_id].append((r.section, r.n_chars, r.n_tokens, r.n_crossing))
    for i, t in some:
        if i is not None:
            assert sorted(got[i]) == slow_sections(ENC[BYTE], t, given[i], rule), (i, given[i])


def test_counts_of_fields(spark):
    df = docs(spark, [(1, "The body text, it's here"), (2, None), (3, "")]).withColumn("title", F.when(F.col("doc_id") == 1, F.lit("A title")))
    for rule in token_counts.RULES:
        got = {(r.doc_id, r.field): (r.n_chars, r.n_tokens) for r in token_counts.count_fields(df, BYTE, ["title", "text"], rule, " ").collect()}
        whole = ENC[BYTE].tokenizer.encode("A title The body text, it's here", add_special_tokens=False)
        assert sum(n for (i, _), (_, n) in got.items() if i == 1) == len(whole.ids)
        assert got[1, "title"] == (7, 2) and got[1, "text"][0] == 24 and got[1, None][0] == 1
        assert got[2, "title"] == got[2, "text"] == (0, 0)
    with pytest.raises(ValueError):
        token_counts.count_fields(df, BYTE, [])
    assert token_counts.count_fields(empty(spark), BYTE, ["text"]).count() == 0
