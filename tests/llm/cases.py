"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

from pyspark.sql import functions as F

PASSAGE = "a passage of many words that several documents of this small table share so that each of its long strings is found again and again"
LONG = 60_000


def texts():
    rng = random.Random(5)
    syllables = ["ta", "ri", "mon", "e", "qu", "é", "sto", "ñ", "ber", "li"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "Two Words"),
        (9, f"{prose(30)} {PASSAGE} {prose(30)}"), (10, f"{prose(20)}\n{PASSAGE}\n{prose(9)}"), (11, PASSAGE.upper()),
        (12, "And " * 90), (13, "And " * 90), (14, prose(LONG // 6)), (15, "日本語のテキスト 日本語のテキスト ß x"), (16, "x" * 700),
        (17, "a  b\t c\r\nd <|endoftext|> it's 12,5% #tag | y"), (None, prose(80)), (None, None),
        (18, f"{prose(60)} Released under the MIT License. {prose(60)}"), (19, "line one here\n" * 20 + "tail"), (20, "ÀÉ Zz İ ǅ!"),
    ]


def docs(spark, rows=None, repeat=False):
    """documents with two columns whose names the operators use themselves."""
    rows = texts() if rows is None else rows
    rows = [*rows, rows[0], rows[8], (1, "another text under a doc_id that is there")] if repeat else rows
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumn("_fingerprint", F.lit("mine")).withColumn("_did", F.col("n_chars") + 1).withColumn("key", F.lit(2.5)).repartition(3)


def empty(spark):
    return docs(spark, [(1, "x")]).where("false")


def same(a, b):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)
