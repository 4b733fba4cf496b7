import collections
import hashlib
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cases import docs, empty, same
from pipewright.llm.common import recorded
from pipewright.llm import decontaminate, licenses, ppm, quality, rules

ASCII_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile("[^\x20\x09-\x0D]+")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


# importance resampling

def _corpus(spark, n=900):
    rng = random.Random(8)
    good = ["river", "stone", "forest", "light", "morning", "water", "paper", "garden"]
    bad = ["zzqx", "wwvk", "qqpt", "xxjj"]
    rows, marks = [], []
    for i in range(n):
        junk = i % 5 == 0
        rows.append((i, " ".join(rng.choice(bad if junk and rng.random() < 0.5 else good) for _ in range(rng.randint(20, 80)))))
        if i % 2:
            marks.append((i, 0 if junk else 1, 0))
    return docs(spark, rows), labels(spark, marks)


def test_draw_keeps_what_is_like_the_target(spark):
    df, lab = _corpus(spark)
    got = {r.doc_id: r for r in quality.resampled(df, lab).collect()}
    assert sum(r._kept for r in got.values()) == round(len(got) * 360 / 450)
    assert np.mean([got[i]._kept for i in got if i % 5]) > 0.99
    assert np.mean([got[i]._kept for i in got if not i % 5]) < 0.05
    keys = sorted((r._key for r in got.values()), reverse=True)
    assert {r._kept for r in got.values() if r._key >= keys[719]} == {True}
    assert {r._kept for r in got.values() if r._key < keys[719]} == {False}
    assert quality.drawn(df, lab).columns == df.columns


def test_keys_and_draw_by_hand(spark):
    """Weights from the query, the rest worked out here: Gumbel variates, keys, the k-th key, ties."""
    df, lab = _corpus(spark, 500)
    got = quality.resampled(df, lab).collect()
    keys = {}
    for r in got:
        start = xxhash.xxh64_intdigest(struct.pack("<i", quality.SEED), 42)
        uniform = ((xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), start) >> 11) + 0.5) / 2**53
        key = r._weight / quality.TEMPERATURE - math.log(-math.log(uniform))
        keys[r.doc_id] = math.floor(max(min(key, 2047.0), -2047.0) * 2**20 + 0.5) / 2**20
    assert all(abs(r._key - keys[r.doc_id]) <= 2**-19 for r in got)
    k = round(len(got) * 200 / 250)
    cut = sorted((r._key for r in got), reverse=True)[k - 1]
    assert {r.doc_id for r in got if r._kept} == {r.doc_id for r in got if r._key >= cut}


def test_draw_with_clashing_columns(spark):
    lab = labels(spark, [(i, 1, 0) for i in range(1, 12)] + [(12, 0, 0)])
    df = docs(spark, repeat=True)
    for c in ("_one", "_two", "_sampled", "_weight", "_key", "_kept", "part", "counts"):
        df = df.withColumn(c, F.lit("mine"))
    got = quality.resampled(df, lab)
    assert {r._one for r in got.collect()} == {"mine"} and dict(got.dtypes)["_kept"] == "boolean"
    kept = quality.drawn(df, lab)
    assert kept.columns == df.columns and {r._kept for r in kept.collect()} == {"mine"}


def test_draw_of_odd_tables(spark):
    lab = labels(spark, [(1, 1, 0), (2, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (16, 0, 1)])
    got = quality.resampled(docs(spark, repeat=True), lab).collect()
    assert {r._weight for r in got if not (r.text or "").split()} == {None}
    none = quality.resampled(docs(spark), labels(spark, []))
    assert {r._kept for r in none.collect()} == {True}
    assert quality.resampled(empty(spark), lab).count() == 0


def test_ngrams_like_a_loop():
    some = ["Alpha beta\tGamma", None, "", "one", "ß x  y"]
    grams, starts = quality.ngrams(pa.array(some))
    w = [(t or "").lower().split() for t in some]
    assert np.diff(starts).tolist() == [len(x) for x in w]
    one, two = (lambda k: grams[0][k]), grams[1]
    flat = [x for y in w for x in y]
    assert all((one(i) == one(j)) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    assert (two == -1).tolist() == [False, False, True, True, False, False][: len(two)]


# decontamination

def test_blocks_of_a_benchmark_leave_no_table_behind(spark):
    rows = [(i, f"start {i} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(12)] + [(None, "w3x0 w3x1"), (20, None)]
    items = [(k, " ".join(f"w{k}x{j}" for j in range(4, 18))) for k in range(0, 12, 2)]
    bench = spark.createDataFrame([(f"i{k}", t) for k, t in items], "item_id string, text string")
    made = []
    with recorded(made):
        got = decontaminate.report(docs(spark, rows), bench, block_words=20)
    want = decontaminate.report(docs(spark, rows), bench)
    same([tuple(r) for r in got.collect()], [tuple(r) for r in want.collect()])
    assert len(made) > 1
    kept = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(kept) == 1


def brute_hits(rows, items, width=10):
    find = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOW))
    patterns = {}
    for item, text in items:
        w = find(text)
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = []
    for doc_id, text in rows:
        w, hit, found = find(text), set(), set()
        for m in {len(p) for p in patterns}:
            for k in range(len(w) - m + 1):
                if its := patterns.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= its
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("width,block_words", [(10, 200_000), (4, 30), (2, 200_000)])
def test_decontamination_like_brute_force(spark, width, block_words):
    rng = random.Random(2)
    vocab = ["Ein", "zwei", "drei", "é", "5x", "it's"]
    prose = lambda n: rng.choice([" ", ", ", " - "]).join(rng.choice(vocab) for _ in range(n))
    rows = [(i, prose(rng.randint(0, 60))) for i in range(40)] + [(90, None), (91, ""), (None, prose(20)), (7, prose(9))]
    items = [(1, prose(30)), (2, prose(12)), (3, prose(3)), (3, prose(5)), (4, ""), (5, None), (10, "two words"), (None, prose(4)), (6, "drei")]
    items.append((11, rows[3][1] or "x"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = docs(spark, rows)
    want = brute_hits(rows, items, width)
    same([tuple(r) for r in decontaminate.report(df, bench, width, block_words).collect()], want)
    kept = decontaminate.clean(df, bench, width, block_words)
    assert kept.columns == df.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(r[0] for r in want if not r[5])


def test_decontamination_of_odd_tables(spark):
    bench = spark.createDataFrame([(1, "a test item")], "item_id bigint, text string")
    assert decontaminate.report(empty(spark), bench).count() == 0
    clean = decontaminate.report(docs(spark, repeat=True), bench.where("false")).collect()
    assert {r.contaminated for r in clean} == {False}


# language model

def test_unigram_base_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_DOCS", 5)
    df = docs(spark, repeat=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [[*WORD.findall((t or "").translate(ASCII_LOW)), None] for _, t in rows]
    c = collections.Counter(x for (i, _), w in zip(rows, tokens) if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for (i, _), w in zip(rows, tokens)]
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in ppm.score(df).collect()], want)


def slow_ppm(train, text, order):
    """PPM by dictionaries: method C, symbol exclusion."""
    counts = collections.defaultdict(collections.Counter)
    low = lambda t: [0] * order + [c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()] + [256]
    for t in train:
        x = low(t)
        for i in range(order, len(x)):
            for o in range(order + 1):
                counts[tuple(x[i - o : i])][x[i]] += 1
    x, total = low(text), 0.0
    for i in range(order, len(x)):
        excluded, p = set(), 1.0
        for o in range(order, -1, -1):
            ctx = tuple(x[i - o : i])
            seen = {s: k for s, k in counts.get(ctx, {}).items() if s not in excluded}
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if x[i] in seen:
                p *= seen[x[i]] / (n + d)
                break
            p *= d / (n + d)
            excluded |= seen.keys()
        else:
            p /= 257 - len(excluded)
        total += math.log10(p)
    return total


@pytest.mark.parametrize("order", [0, 2, 4])
def test_trie_scores_like_dictionaries(spark, order):
    train = ["The theme of these", "then and there é", "", None]
    probe = ["the then", "", None, "Zebra éé 日", "there of"]
    df = docs(spark, [(i, t) for i, t in enumerate(train)])
    model = ppm.Model(ppm.train(df, order))
    got = model.score(pa.array(probe, pa.string()))
    assert np.allclose(got, [slow_ppm(train, t, order) for t in probe], atol=1e-3)


@pytest.mark.parametrize("order", [0, 2, 3, 5])
def test_score_keeps_every_context(spark, monkeypatch, order):
    """More contexts than the 32,768 an order once kept, each seen once or twice."""
    monkeypatch.setattr(ppm, "BLOCK_DOCS", 7)
    rng = random.Random(12)
    rare = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(3000)) for _ in range(16)]
    rows = [(i, t) for i, t in enumerate(rare)] + [(100, rare[0][:900] + rare[1][:50]), (None, rare[2][7:90]), (101, None), (102, ""), (102, "Zebra 日"), (103, rare[3])]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    assert order < 5 or len({t[k : k + 5] for t in train for k in range(len(t or "") - 4)}) > 32_768
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), round(r.score, 4)) for r in ppm.score(df, order).collect())
    want = sorted((str(i), slow_ppm(train, t, order)) for i, t in rows) if order < 5 else None
    if want is None:
        model = ppm.Model(ppm.train(spark.createDataFrame([(1, t) for t in train], "doc_id bigint, text string"), order))
        want = sorted(zip((str(i) for i, _ in rows), model.score(pa.array([t for _, t in rows], pa.string()))))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5, atol=1e-3)


def test_trie_probabilities_add_up(spark):
    model = ppm.Model(ppm.train(docs(spark), 3, nodes=50))
    p = 10.0 ** model.logp.astype(np.float64)
    unmet = 257 - (model.width - 1)  # the last code stands for each byte not met
    assert np.allclose(p[:-1, :-1].sum(1) + unmet * p[:-1, -1], 1, atol=0.02) or (p[:-1, :-1].sum(1) + unmet * p[:-1, -1] <= 1.001).all()


def test_lm_of_odd_tables(spark):
    assert ppm.score(empty(spark)).count() == 0
    only_held = [(i, "words here") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = ppm.score(docs(spark, only_held)).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}
    assert all(abs(r.score + 11 * math.log10(257)) < 1e-3 for r in got)


# licenses

def brute_licenses(rows, texts):
    table = str.maketrans(licenses._PUNCTUATION + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", licenses._SPACES + "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: [x for x in (t or "").translate(table).split(" ") if x]
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    out = {}
    for doc_id, text in rows:
        s = shingles(words(text))
        for k, v in texts.items():
            own, c = set(shingles(words(v))), licenses.size_class(len(words(v)) or 1)
            for a in range(0, len(s), c) if own else ():
                share = len(own & set(s[a : a + max(1, 2 * c - 4)])) / len(own)
                if share >= 0.8:
                    out.setdefault((doc_id, k), {}).setdefault(a, share)
    return {k: (max(v.values()), min(v), len(v)) for k, v in out.items()}


def test_licenses_like_brute_force(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "the", "license"]) for _ in range(n))
    rows = [(90, None), (91, ""), (92, "MIT License"), (None, licenses.TEMPLATES["ISC"])]
    for i, (k, v) in enumerate(licenses.TEMPLATES.items()):
        w = v.split()
        rows += [(3 * i, f"{prose(rng.randint(0, 70))} {v.upper()}\n{prose(50)}"), (3 * i + 1, f"{prose(33)} {' '.join(w[: len(w) // 2])} {prose(9)}")]
        w[-1] = "changed"
        rows.append((3 * i + 2, f"{prose(150)} -- {' '.join(w)}."))
    got = {(r.doc_id, r.license): (r.containment, r.first_word, r.n_windows) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == brute_licenses(rows, licenses.TEMPLATES)


def test_licenses_like_a_window_at_every_word(spark):
    """Words put into a template, at every place of the windows: whatever a window of twice its words holds is found."""
    rows, want = [], set()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    plain = lambda t: re.sub("[^a-z0-9 ]", " ", t.lower()).split()
    for k in ("Apache-2.0", "GPL"):
        w = plain(licenses.TEMPLATES[k])
        for more in (10, 15):
            for start in range(64):
                text = [f"before{i}" for i in range(start)] + w[:15] + [f"put{i}" for i in range(more)] + w[15:] + ["after"] * 40
                rows.append((len(rows), " ".join(text)))
                if max(len(shingles(w) & shingles(text[a : a + 2 * len(w)])) for a in range(len(text))) >= 0.8 * len(shingles(w)):
                    want.add((rows[-1][0], k))
    got = {(r.doc_id, r.license) for r in licenses.scan(docs(spark, rows)).collect()}
    assert len(want) == len(rows) and want <= got


def test_licenses_recall_at_every_offset(spark):
    """Every template, with a word put in where 0.8 still allows it, at every place of its windows."""
    rows, want = [], set()
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    plain = lambda t: re.sub("[^a-z0-9 ]", " ", t.lower()).split()
    for k, v in licenses.TEMPLATES.items():
        w = plain(v)
        for more in (0, 1, 6):
            own = w if not more else [*w[: len(w) - 1], *[f"put{i}" for i in range(more)], w[-1]]
            if len(shingles(w) & shingles(own)) < 0.8 * len(shingles(w)):
                continue
            for start in range(licenses.size_class(len(w))):
                text = [f"a{start}x{i}" for i in range(start)] + own + ["after"] * 20
                rows.append((len(rows), " ".join(text)))
                want.add((rows[-1][0], k))
    got = {(r.doc_id, r.license) for r in licenses.scan(docs(spark, rows)).collect()}
    assert len(want) > 500 and len(want - got) <= len(want) * 0.002


def test_licenses_of_odd_tables(spark):
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(docs(spark), {}).count() == 0
    assert licenses.scan(docs(spark), {"none": "", "dots": "..."}).count() == 0
    assert [r.license for r in licenses.scan(docs(spark, repeat=True), {"short": "one"}).collect()] == ["short"]


# quality rules

def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    c, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), len(set(w)), len(covered), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines))


def test_statistics_like_brute_force(spark):
    rng = random.Random(6)
    rows = [(100 + i, rng.choice([" ", "\n", "\t "]).join(rng.choice("aabcd#") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    df = docs(spark, [*docs_rows(), *rows], repeat=True)
    got = rules.statistics(df).select("doc_id", "n_words", "n_kinds", "n_repeat_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines").collect()
    same([tuple(r) for r in got], [(r.doc_id, *brute_statistics(r.text)) for r in df.collect()])


def docs_rows():
    from cases import texts

    return texts()


def test_rules_learn_planted_thresholds():
    rng = random.Random(9)
    row = lambda: {f: rng.random() for f in rules.FEATURES}
    sample = [r | {"bad": int(r["symbols_per_word"] > 0.8 or (r["upper_share"] > 0.6 and r["n_words"] <= 0.4))} for r in (row() for _ in range(1500))]
    found = rules.learn(sample)
    test = [r | {"bad": int(r["symbols_per_word"] > 0.8 or (r["upper_share"] > 0.6 and r["n_words"] <= 0.4))} for r in (row() for _ in range(1500))]
    said = [any(rules._holds(r, rule) for rule in found) for r in test]
    assert np.mean([s for s, r in zip(said, test) if not r["bad"]]) < 0.02
    assert np.mean([s for s, r in zip(said, test) if r["bad"]]) > 0.85
    assert rules.learn([]) == [] and rules.learn([r | {"bad": 0} for r in sample]) == []


def test_rules_of_odd_tables(spark):
    lab = labels(spark, [(1, 1, 0), (None, 0, 0), (3, None, 1), (77, 0, 0)])
    got = rules.judged(docs(spark, repeat=True), lab).collect()
    assert all(r.kept != r.base_failed for r in got)
    assert {r.base_failed for r in got if r.n_words < 50} == {True}
    assert rules.judged(empty(spark), lab).count() == 0
    assert rules.judged(docs(spark), labels(spark, [])).count() == len(docs_rows())


def test_emitted_case_is_sql(spark):
    case = rules.as_case([[("n_words", "<=", 60.0), ("upper_share", ">", 0.25)], [("repeat_share", ">", 0.5)]])
    df = rules.statistics(docs(spark)).selectExpr(f"{case} AS kept", "n_words", "n_upper", "word_chars", "n_repeat_words")
    for r in df.collect():
        bad = (r.n_words <= 60 and r.n_upper / max(r.word_chars, 1) > 0.25) or r.n_repeat_words / max(r.n_words, 1) > 0.5
        assert r.kept is not bad
