"""Skew-safe helpers equal the plain windows they replace (random data,
hot keys, NULL keys, sparse and dense orderings, several bucket widths)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from pipewright.operators import skew as K

KEYS = st.sampled_from(["hot", "hot", "hot", "a", "b", None])


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, o bigint, v bigint")


rows_unique_order = st.lists(st.tuples(KEYS, st.integers(0, 5000), st.integers(-50, 50)),
                             min_size=1, max_size=60).map(
    lambda rs: [(k, o * 1000 + i, v) for i, (k, o, v) in enumerate(rs)])


@settings(max_examples=8, deadline=None)
@given(rows_unique_order, st.sampled_from([1, 7, 4096]))
def test_ordinal_and_prefix(spark, rows, width):
    df = frame(spark, rows)
    w = Window.partitionBy("k").orderBy("o")
    exp_rank = {(r.k, r.o): r.n for r in df.withColumn("n", F.row_number().over(w)).collect()}
    got_rank = {(r.k, r.o): r.n for r in K.ordinal_within(df, ["k"], "o", width, out="n").collect()}
    assert got_rank == exp_rank
    exp_pre = {(r.k, r.o): r.p for r in df.withColumn("p", F.coalesce(F.sum("v").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).collect()}
    got_pre = {(r.k, r.o): r.p for r in K.prefix_sum_within(df, ["k"], "o", "v", width, out="p").collect()}
    assert got_pre == exp_pre


@settings(max_examples=8, deadline=None)
@given(rows_unique_order, st.sampled_from([1, 60, 100000]))
def test_running_max_and_previous(spark, rows, width):
    df = frame(spark, rows)
    w = Window.partitionBy("k").orderBy("o")
    exp_max = {(r.k, r.o): r.m for r in df.withColumn("m", F.max("v").over(
        w.rowsBetween(Window.unboundedPreceding, 0))).collect()}
    got_max = {(r.k, r.o): r.m for r in K.running_max_within(df, ["k"], ["o"], "v", width, out="m").collect()}
    assert got_max == exp_max
    exp_prev = {(r.k, r.o): r.p for r in df.withColumn("p", F.lag("v").over(w)).collect()}
    got_prev = {(r.k, r.o): r.p for r in K.previous_within(df, ["k"], ["o"], "v", width, out="p").collect()}
    assert got_prev == exp_prev


@settings(max_examples=8, deadline=None)
@given(rows_unique_order, st.integers(1, 5))
def test_top_k(spark, rows, k):
    df = frame(spark, rows)
    exp = {(r.k, r.o) for r in df.withColumn("r", F.row_number().over(
        Window.partitionBy("k").orderBy(F.desc("o")))).filter(F.col("r") <= k).collect()}
    got = {(r.k, r.o) for r in K.top_k_within(df, ["k"], [F.desc("o")], k,
                                                salt=F.abs(F.xxhash64("o")) % F.lit(4)).collect()}
    assert got == exp
