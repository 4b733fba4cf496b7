import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from cases import docs, empty, texts
from pipewright.llm import toxicity


def corpus(n=1200, seed=4):
    rng = random.Random(seed)
    parts = ["ta", "ri", "mon", "el", "qu", "sto", "ber", "li", "an", "ro", "ve", "sin", "do", "ka", "lu"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    vocabulary = [word() for _ in range(400)]
    bad = ["Wretchbag", "gruntfool", "zilchhead", "numbskully"]
    rows, marks = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w) + "."))
        if i % 10 < 8:
            marks.append((i, 1, int(toxic)))
    return rows, marks


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_scores_of_documents_no_label_taught(spark):
    rows, marks = corpus()
    got = toxicity.score(docs(spark, rows), labels(spark, marks)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted for r in held if r.doc_id % 6 == 0]) > 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 6]) < 0.03


def test_held_out_labels_teach_nothing(spark):
    rows, marks = corpus(400)
    hidden = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in marks]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(docs(spark, rows), labels(spark, m)).collect()) for m in (marks, hidden))
    assert a == b


def slow_windows(text):
    words = " " + "".join(c if ord(c) > 127 or c.isalnum() else " " for c in text.lower()) + " "
    data, at, out = words.encode(), 0, []
    while at < len(data) - 1:
        cuts = [k for k in range(at + 32, len(data)) if data[k] == 32]
        end = cuts[0] if cuts else len(data) - 1
        out.append(data[at : end + 1])
        at = end
    return out


def test_features_like_a_loop():
    rows, marks = corpus(300)
    lab = dict((i, t) for i, _, t in marks)
    known = [(t, lab[i]) for i, t in rows if i in lab]
    ordinary, toxic, raw = toxicity.dictionaries(pa.array([t for t, _ in known]), np.array([x for _, x in known]))
    press = toxicity.Press(ordinary, raw), toxicity.Press(toxic, raw)
    some = [t for _, t in rows[:25]] + ["", None, "Wretchbag", "one two", "É à ñ 日本 gruntfool!", "a  b\n\tc"]
    got = toxicity.features(press, pa.array(some))
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
    params = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    one = [zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind)) for d in (ordinary, toxic)]
    for text, f in zip(some, got.tolist()):
        cut = slow_windows(text) if text else []
        nearer = [len(one[0].compress(w)) - len(one[1].compress(w)) for w in cut]
        assert f[0] == len(cut)
        assert f[2] == sum(nearer) and f[1] == max([0, *nearer])
        assert f[3:] == [sum(x >= s for x in nearer) for s in toxicity.STEPS]


def test_windows_cover_every_byte():
    some = [t for _, t in texts()]
    data, at = toxicity.plain(pa.array(some))
    start, length, owner = toxicity.windows(data, at)
    seen = np.zeros(len(data), bool)
    for s, n, o in zip(start, length, owner):
        assert at[o] <= s and s + n <= at[o + 1] and n <= toxicity.LONGEST + toxicity.WINDOW + 2
        seen[s : s + n] = True
    for i, t in enumerate(some):
        assert seen[at[i] : at[i + 1]].all() == bool(t)


def test_own_words_of_either_kind_enter_the_dictionaries():
    rows, marks = corpus()
    lab = dict((i, t) for i, _, t in marks)
    known = [(t, lab[i]) for i, t in rows if i in lab]
    ordinary, toxic, _ = toxicity.dictionaries(pa.array([t for t, _ in known]), np.array([x for _, x in known]))
    assert len(ordinary) == len(toxic)
    assert all(w in toxic and w not in ordinary for w in (b"wretchb", b"gruntf", b"zilchh"))


@pytest.mark.parametrize("marks,expected", [([], 0.0), ([(1, 1, 0), (9, 0, None), (None, 1, 1)], 0.0)])
def test_scores_without_both_kinds(spark, marks, expected):
    got = toxicity.score(docs(spark, repeat=True), labels(spark, marks)).collect()
    assert {r.score for r in got} == {expected} and len(got) == docs(spark, repeat=True).count()


def test_odd_tables(spark):
    marks = [(i, 1, int(i in (9, 10))) for i in range(1, 21)] + [(3, 1, 1), (None, 1, 1)]
    got = toxicity.score(docs(spark, repeat=True), labels(spark, marks)).collect()
    assert all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert {(r.n_windows, r.most) for r in got if r.doc_id in (4, 5)} == {(0, 0)}
    assert toxicity.score(empty(spark), labels(spark, marks)).count() == 0
    assert not any(r.held_out for r in got if r.doc_id is None)
