import hashlib
import random

import numpy as np
import pytest
import xxhash

from cases import PASSAGE, docs, empty, same
from pipewright.llm import simhash, suffix_dedup
from pipewright.llm.components import roots


def brute_removed(rows, length):
    """(doc_id, text) in order -> kept bytes, removed, runs."""
    seen, out = set(), []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,hot", [(100, 24, 20_000), (100, 24, 1), (30, 8, 2), (12, 8, 1)])
def test_passages_like_brute_force(spark, length, gram, hot):
    df = docs(spark).where("doc_id is not null")
    rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if True)
    same([tuple(r) for r in suffix_dedup.report(df, length, gram, hot).collect()], brute_removed(rows, length))


def test_passages_of_small_alphabets(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    df = docs(spark, rows)
    same([tuple(r) for r in suffix_dedup.report(df, 12, 8, 3).collect()], brute_removed(rows, 12))


def test_null_and_repeated_ids(spark):
    rows = [(None, PASSAGE), (1, PASSAGE + " tail"), (2, "x"), (2, "x"), (3, PASSAGE), (3, "head " + PASSAGE)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.report(docs(spark, rows)).collect()}
    n = len(PASSAGE)
    assert got[None, n] == 0 and got[1, n + 5] == n and got[2, 1] == 0 and got[3, n] == n and got[3, n + 5] == n


def test_equal_rows_get_one_result(spark):
    rows = [(1, PASSAGE), (1, PASSAGE)]
    assert [r.n_removed for r in suffix_dedup.report(docs(spark, rows)).collect()] == [0, 0]


def test_two_stage_sort_is_a_suffix_sort():
    rng = random.Random(1)
    for _ in range(25):
        text = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(300)) + bytes(30), np.uint8)
        wanted = np.zeros(len(text), bool)
        wanted[rng.sample(range(290), 150)] = True
        order = suffix_dedup.suffix_array(text, wanted, 20)
        keys = [bytes(text[i : i + 20]) for i in order]
        assert keys == sorted(keys) and sorted(order) == np.flatnonzero(wanted).tolist()
        assert suffix_dedup.equal_next(text, order, 20).tolist() == [a == b for a, b in zip(keys, keys[1:])]


def test_remove_keeps_columns_and_valid_text(spark):
    rows = [(1, "ééé" + PASSAGE + "é"), (2, PASSAGE + "é and more"), (3, None), (4, "")]
    df = docs(spark, rows)
    got = {r.doc_id: r for r in suffix_dedup.remove(df).collect()}
    assert suffix_dedup.remove(df).columns == df.columns
    assert got[1].text == rows[0][1] and got[3].text is None and got[4].text == ""
    assert got[2].text == " and more" and got[2].n_chars == 9 and got[2]._fingerprint == "mine"


def brute_print(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: list of fingerprints -> the least index each reaches."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints_and_components(spark):
    df = docs(spark, repeat=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = [brute_print(t) for _, t in rows]
    label = brute_components(prints)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = [(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, label)]
    same([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()], want)


@pytest.mark.parametrize("n,flips,seeds", [(300, 4, 20), (2_000, 3, 2)])
def test_links_of_planted_prints(spark, n, flips, seeds):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(seeds)]
    prints = []
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints = sorted(set(prints))
    label = list(range(len(prints)))
    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3)
        low = min(label[k] for k in near)
        old = {label[k] for k in near}
        label = [low if x in old else x for x in label]
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in enumerate(prints)], "doc_id bigint, _fingerprint bigint")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    assert [got[k] for k in range(len(prints))] == label


def test_large_bucket_is_split():
    rng = np.random.default_rng(2)
    bits = np.unique(rng.integers(0, 1 << 13, 6_000).astype(np.uint64) << np.uint64(9))
    label = simhash._bucket(bits)
    want = np.arange(len(bits))
    for i in range(len(bits)):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3)
        old = np.unique(want[near])
        want[np.isin(want, old)] = old[0]
    while (label[label] != label).any():
        label = label[label]
    assert [len(set(label[want == w])) for w in np.unique(want)] == [1] * len(np.unique(want))


def test_keep_one(spark):
    df = docs(spark, repeat=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    # 2 copies 1, 13 copies 12, 5 and 6 have no words, as 4 has; of the null ids one has no words
    assert {2, 13, 5, 6}.isdisjoint(ids) and {1, 4, 7, 8, 12, 14}.issubset(ids)
    assert ids.count(9) == 1


def test_roots_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7)], "u bigint, v bigint")
    got = {r.node: r.root for r in roots(links).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def test_empty_tables(spark):
    assert suffix_dedup.report(empty(spark)).count() == 0
    assert suffix_dedup.remove(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0
