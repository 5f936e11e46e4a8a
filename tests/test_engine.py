"""The ordered-stream operators against DuckDB, plain Python and properties."""

import os
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake import queries as Q
from strandlake.errors import StreamError
from strandlake.functions import keys, metrics
from strandlake.operators import generate, intervals, lookback, order, partition
from strandlake.plans import job
from strandlake.plans.split import plan_splits, shifts
from strandlake.session import partitions_for
from strandlake.sources import rawwords
from strandlake.streaming import once, pipe

SF = "/root/testdata/sf0.001"
EXTREMES = [0, 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1]
signed = lambda x: x - (1 << 64) if x >> 63 else x


def rows(df):
    return sorted(repr([None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x.item() if hasattr(x, "item") else x for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want, got = con.sql(Q.oracle_sql()[name]).df(), Q.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("data", [EXTREMES * 3, [7] * 50, list(range(33)), list(range(130, 0, -1)), [], [5]])
def test_sort_edges(spark, data):
    df = spark.createDataFrame([(signed(x),) for x in data], "k long")
    out = order.sort_ranked(df).orderBy("rk").select(keys.unsigned(F.col("k")).alias("u"), "rk").collect()
    assert [int(r["u"]) for r in out] == sorted(data)
    assert [r["rk"] for r in out] == list(range(1, len(data) + 1))


def test_hot_key_is_spread(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"))
    for out in (order.sort(df, parts=8), partition.by_digit(df, bits=2, parts=8)):
        parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min(keys.flip(F.col("k"))).alias("low"), F.max(keys.flip(F.col("k"))).alias("high")).orderBy("p").collect()
        assert max(r["n"] for r in parts) < 6000 and sum(r["n"] for r in parts) == 20000
        assert all(x["high"] <= y["low"] for x, y in zip(parts, parts[1:]))


def test_sort_keeps_other_columns_and_numbers_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 100).alias("k"), F.col("id").alias("x"))
    out = order.sort_ranked(df).orderBy("rk").collect()
    assert [r["k"] for r in out] == sorted(x * 7 % 100 for x in range(500)) and {r["x"] for r in out} == set(range(500))
    assert [r["rk"] for r in out] == list(range(1, 501))


def test_null_keys_raise(spark):
    df = spark.createDataFrame([(0, 1), (1, None)], "pos long, k long")
    for f in (lambda: order.sort_ranked(df.select("k")), lambda: order.sort_ranked(df), lambda: order.lane_sums(df), lambda: order.check_sorted(df), lambda: partition.by_digit(df)):
        with pytest.raises(Exception, match="null in k"):
            f().collect()


def test_partitions_follow_the_data_where_catalyst_knows_no_size(spark):
    df = spark.createDataFrame(spark.sparkContext.parallelize([("x" * 1000,)] * 2000, 2), "t string")
    assert partitions_for(df, 0.1) == 20 and partitions_for(df.limit(0), 0.1) == 4


def test_wrapping_arithmetic(spark):
    vals = EXTREMES + [0x123456789ABCDEF0, 0xFFFFFFFF, 1 << 32]
    df = spark.createDataFrame([(signed(x),) for x in vals], "k long")
    got = [int(r[0]) for r in df.select(keys.unsigned(keys.affine_step(F.col("k"), generate.A, generate.C))).collect()]
    assert got == [(x * generate.A + generate.C) % (1 << 64) for x in vals]


def test_lcg_widths_and_batches(spark):
    state, want = list(generate.SEEDS), []
    for i in range(10001):
        lane = i % 4
        state[lane] = (state[lane] * generate.A + generate.C) % (1 << 64)
        want.append(state[lane])
    got = generate.lcg(spark, 10001).select("pos", keys.unsigned(F.col("k")).alias("u")).orderBy("pos").collect()
    assert [int(r["u"]) for r in got] == want
    assert generate.lcg(spark, 0).count() == 0
    assert [r["k"] for r in generate.lcg(spark, 9, 8).orderBy("pos").collect()] == [x >> 56 for x in want[:9]]


@given(st.integers(0, 1 << 70), st.sampled_from([8, 16, 32, 64]))
def test_split_plan(n, bits):
    w = plan_splits(n, bits)
    if n <= 8:
        assert w == [] and shifts(w, bits) == []
    else:  # every bit once, levels of at most 8 bits, and leaves of at most 8 keys after the first part
        assert sum(w) == bits and 0 < max(w) <= 8 and shifts(w, bits)[-1] == 0
        assert any(8 << sum(w[: k + 1]) >= n for k in range(len(w))) or 8 << bits < n


def test_split_plan_example():
    assert plan_splits(1 << 27) == [8] * 8
    assert plan_splits(1 << 12, 16) == [5, 4, 7]


def test_interval_borders(spark):
    t = spark.createDataFrame([(0, 5, "x"), (5, 6, "y"), (10, 20, "z")], "a long, b long, payload string")
    p = spark.createDataFrame([(i,) for i in (-1, 0, 4, 5, 6, 9, 10, 19, 20)], "x long")
    want = {-1: None, 0: "x", 4: "x", 5: "y", 6: None, 9: None, 10: "z", 19: "z", 20: None}
    for small in (100, 0):
        assert {r["x"]: r["payload"] for r in intervals.stab(p, t, small=small, parts=4).collect()} == want
    assert intervals.overlaps(t).isEmpty()
    with pytest.raises(ValueError):
        intervals.add(t, t.limit(1))
    with pytest.raises(ValueError):
        intervals.remove(t, spark.createDataFrame([(1,)], "a long"))
    assert intervals.stab(p, t.limit(0)).where("payload is not null").isEmpty()


@pytest.mark.parametrize("size", [0, 1, 7, 8, 4096, 4100, 9001])
def test_raw_files(spark, tmp_path, size):
    data = bytes(i * 7 % 251 for i in range(size))
    (tmp_path / "f").write_bytes(data)
    got = [r["k"] for r in rawwords.read_words(spark, str(tmp_path / "f"), block=1024).orderBy("pos").collect()]
    assert got == [signed(int.from_bytes(data[i : i + 8], "little")) for i in range(0, size // 8 * 8, 8)]
    assert rawwords.read_words(spark, str(tmp_path / "f"), unit=16).count() == size // 16 * 2
    assert rawwords.read_words(spark, str(tmp_path / "f"), limit=100, block=256, split=512).count() == min(100, size // 8)
    assert rawwords.copy_words(spark, str(tmp_path / "f"), str(tmp_path / "g"), split=512) == size
    assert b"".join(open(f, "rb").read() for f, _ in rawwords.files_of(str(tmp_path / "g"))) == data
    if size:
        with pytest.raises(StreamError, match="not empty"):
            rawwords.copy_words(spark, str(tmp_path / "f"), str(tmp_path / "g"))


def test_raw_second_write_appends_or_replaces(spark, tmp_path):
    path = str(tmp_path / "w")
    ones = spark.range(3000).select(F.col("id").alias("pos"), F.lit(1).cast("long").alias("k"))
    twos = spark.range(1000).select(F.col("id").alias("pos"), F.lit(2).cast("long").alias("k"))
    total = lambda: tuple(rawwords.read_words(spark, path, block=800, split=1600).agg(F.count("*"), F.sum("k"), F.max("pos")).first())
    rawwords.write_words(ones, path, block=1024)
    with pytest.raises(Exception, match="3000 expected, 0 found"):
        rawwords.write_words(twos, path, block=512)
    assert total() == (3000, 3000, 2999)
    rawwords.write_words(twos.withColumn("pos", F.col("pos") + 3000), path)
    assert total() == (4000, 5000, 3999)
    assert rawwords.truncate_words(path, 3500) == 3500 and total() == (3500, 4000, 3499)
    assert rawwords.truncate_words(path, 9999) == 3500
    rawwords.write_words(twos, path, block=512, mode="overwrite")
    assert total() == (1000, 2000, 999)
    live = {x.rsplit("/", 1)[-1] for x, _ in rawwords.files_of(path)}
    assert {f for f in os.listdir(path) if f.startswith("part")} == live  # nothing else is left
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a").write_bytes(bytes(16))
    with pytest.raises(Exception, match="did not commit"):
        rawwords.write_words(twos, str(tmp_path / "plain"))


def test_raw_gap_fails_and_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="not dense"):
        rawwords.write_words(spark.createDataFrame([(0, 1), (2, 1)], "pos long, k long"), str(tmp_path / "h"))
    assert not [f for f in os.listdir(tmp_path / "h") if f.startswith("part")]


def numbers(spark, first, n):
    return spark.range(first, first + n).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("k"))


def test_pipe_look_back_is_kept_and_no_more(spark):
    seen = []
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=100, consumer_back=1, ahead=2, rows=900)) as p:
        p.produce(numbers(spark, 0, 700))

        def each(window, number):
            seen.append((window.first, window.begin, window.end, window.new().count(), window.since(window.first).count()))
            with pytest.raises(StreamError, match="is gone"):
                window.since(window.first - 1)

        assert p.consume(each) == 700 and p.finish() == 700
        assert seen == [(0, 0, 200, 200, 200), (100, 200, 400, 200, 300), (300, 400, 600, 200, 300), (500, 600, 700, 100, 200)]
        assert len(p._blocks()) <= p.config.blocks
        assert [r["done_pct"] for r in p.report.frame(spark).collect()][-1] == 100 and p.report.final() > 0
        assert p.consume(each) == 0
        p.produce(numbers(spark, 700, 200))
        again = pipe.Pipe(spark, p.config, path=p.path)  # as another session would
        assert again.consume(each) == 200 and seen[-1][:3] == (600, 700, 900)
        with pytest.raises(StreamError, match="declared"):
            p.produce(numbers(spark, 900, 100))
        p.reset()
        p.produce(numbers(spark, 0, 100))
        assert p.consume(lambda w, n: None) == 100
    assert not os.path.exists(p.path.removeprefix("file:"))


def test_pipe_goes_on_after_a_failure(spark):
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=50, ahead=1)) as p:
        p.produce(numbers(spark, 0, 200))
        got = []

        def each(window, number):
            if window.begin == 100 and got.count(100) == 0:
                got.append(100)
                raise RuntimeError("lost")
            got.append((window.begin, window.new().agg(F.sum("k")).first()[0]))

        with pytest.raises(Exception, match="lost"):
            p.consume(each)
        assert p.consume(each) == 100
        assert [x for x in got if x != 100] == [(b, sum(3 * x for x in range(b, b + 50))) for b in (0, 50, 100, 150)]


def test_pipe_takes_as_long_as_its_rows_ask_for(spark, monkeypatch):
    listed = []
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=10, ahead=1)) as p:
        p.produce(numbers(spark, 0, 80))
        blocks = p._blocks
        monkeypatch.setattr(p, "_blocks", lambda: listed.append(1) or blocks())
        assert p.consume(lambda w, n: time.sleep(1), timeout=6) == 80  # eight seconds, none of them still
        assert len(listed) == 1  # not once a batch
        assert len(os.listdir(f"{p.path.removeprefix('file:')}/consumer")) <= 2
        p.produce(numbers(spark, 80, 10))
        with pytest.raises(TimeoutError, match="stood still for 2 s"):
            p.consume(lambda w, n: time.sleep(6), timeout=2)


def test_frame_sums_read_their_input_once(spark):
    df = numbers(spark, 0, 95)
    out = lookback.frame_sums(df, 4, "k", "pos", block=10)
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert sorted(tuple(r) for r in out.collect()) == [(i, 3 * i, sum(3 * j for j in range(max(0, i - 4), i + 1))) for i in range(95)]
    odd = spark.createDataFrame([(None, 1), (-1, 2), (0, 3), (1, None)], "pos long, k long")
    got = {r["pos"]: r["frame_sum"] for r in lookback.frame_sums(odd, 4, "k", "pos", block=10).collect()}
    assert got == {None: 1, -1: 2, 0: 5, 1: 5}


def test_pipe_refuses_steps_back_and_gaps(spark):
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=10, producer_back=1)) as p:
        written = lambda ps: spark.createDataFrame([(i, x) for i, x in enumerate(ps)], "seq long, pos long")
        p.produce(written([10, 0, *range(1, 10), *range(11, 20)]), order="seq")  # ten back
        with pytest.raises(StreamError, match="goes back"):
            p.produce(written([31, 20, *range(21, 31), *range(32, 40)]), order="seq")
        with pytest.raises(StreamError, match="go on"):
            p.produce(numbers(spark, 30, 10))
        p.produce(numbers(spark, 20, 10))
        p.consume(lambda w, n: None)
        p.produce(numbers(spark, 30, 20))
        p._delete("blocks/block=3")
        with pytest.raises(StreamError, match="block 3 is missing"):
            p.consume(lambda w, n: None)
        again = pipe.Pipe(spark, p.config, path=p.path)  # the last row written is kept with the pipe
        with pytest.raises(StreamError, match="goes back"):
            again.produce(written([50, 62, *range(51, 62), *range(63, 70)]), order="seq")


def test_vanishing_array():
    v = once.Vanishing(iter([1, 2]))
    v.write(0)
    assert (v.read(), v.read(), v.read(), v.held) == (0, 1, 2, 0)
    with pytest.raises(StreamError):
        v.read()
    assert list(once.Vanishing(iter("ab"))) == ["a", "b"]


def test_words_in_memory(spark):
    w = np.array([5, 1 << 63, (1 << 64) - 1, 0], np.uint64)
    df = once.from_array(spark, w)
    assert (once.to_array(df.orderBy(F.desc("pos"))) == w).all() and len(once.to_array(df.limit(0))) == 0
    with pytest.raises(StreamError, match="more than 3"):
        once.to_array(df, most=3)
    with pytest.raises(StreamError, match="dense"):
        once.to_array(df.where("pos > 0"))


def test_registry(spark):
    r = once.Registry(spark)
    r.add("one_stream", numbers(spark, 0, 3))
    with pytest.raises(StreamError):
        r.add("one_stream", numbers(spark, 0, 3))
    assert r.find("one_stream").count() == 3 and ("one_stream",) in [tuple(x) for x in r.names().collect()]
    r.remove("one_stream")
    assert r.find("one_stream") is None
    with pytest.raises(StreamError):
        r.remove("one_stream")


def test_reports():
    ticks = iter([0, 1, 1, 3, 3])  # the start, then two looks a report
    r = metrics.SpeedReport(4_000_000, lambda: next(ticks))
    r.add(1_000_000)
    r.add(3_000_000)
    assert [(x["mb"], x["seconds"], x["mb_s"], x["interval_mb_s"], x["done_pct"]) for x in r.rows] == [(1, 1, 1, 1, 25), (4, 3, 4 / 3, 1.5, 100)]
    assert r.final() == 4 / 3 and metrics.million_items_per_second(2_000_000, 2) == 1 and metrics.overhead_pct(3, 1, 2) == 50


def test_sort_job(spark):
    rows = job.sort_job(spark, 3001, 2)
    assert [(r["n_unsorted"], r["n_processed"], r["same_keys"]) for r in rows.collect()] == [(0, 3001, True)] * 2
    assert all(r["m_keys_s"] > 0 for r in rows.collect()) and job.summary(rows).first()["n_unsorted"] == 0


def test_interval_runs_over_partitions(spark):
    far = spark.createDataFrame([(0, 1000, "far"), *[(1000 + 2 * k, 1001 + 2 * k, str(k)) for k in range(200)]], "a long, b long, payload string")
    x = spark.createDataFrame([(v,) for v in [*range(0, 1400, 3), None, -5, *[500] * 300]], "x long")
    want = lambda v: None if v is None or v < 0 else "far" if v < 1000 else str((v - 1000) // 2) if v < 1400 and v % 2 == 0 else None
    for small in (10**6, 0):
        assert all(r["payload"] == want(r["x"]) for r in intervals.stab(x, far, small=small, parts=9).collect())
    dense = far.unionByName(spark.createDataFrame([(10**9, 10**9 + 1, "end")], far.schema))  # 200 intervals and more in one block
    intervals_dense, intervals.DENSE = intervals.DENSE, 100
    try:
        assert all(r["payload"] == want(r["x"]) for r in intervals.stab(x, dense, parts=9).collect())
    finally:
        intervals.DENSE = intervals_dense
    more = far.unionByName(spark.createDataFrame([(999, 1003, "cut")], far.schema))
    got = {(r["a"], r["reaches"]) for r in intervals.overlaps(more, parts=9).collect()}
    assert got == {(999, 1000), (1000, 1003), (1002, 1003)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
