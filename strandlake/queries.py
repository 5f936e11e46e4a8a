"""Queries over the driver's tables, one an operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .functions.metrics import SpeedReport, overhead_pct
from .operators import generate, intervals, lookback, order, partition
from .plans.job import sort_job
from .plans.split import plan_splits
from .session import scratch, ship
from .sources import rawwords
from .streaming import once, pipe

#: Lengths for the split planner and the block arithmetic.
LENGTHS = [1, 5, 8, 9, 10, 11, 16, 17, 32, 33, 128, 129, 1000, 1398101, 1398102, 1 << 20, 1 << 27, 3 << 30]


def count(spark: SparkSession, sf_dir: str) -> int:
    """As many words as there are events are generated."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, k): the events' ids and keys hashed from them over the whole unsigned range."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("pos"), keys.hashed_key(F.col("event_id")).alias("k"))


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(keys.hashed_key(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval of every event: [10 id, 10 id + 7)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("event_id") * 10).alias("a"), (F.col("event_id") * 10 + 7).alias("b"), F.col("user_id").alias("payload"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select((F.col("pos") * 10 + F.pmod("pos", F.lit(10))).alias("x"))


def sort_u64(spark, sf_dir):
    return order.sort_ranked(line_keys(spark, sf_dir)).select("rk", keys.text_of(F.col("k")).alias("k"))


def sort_duplicates(spark, sf_dir):
    ship(spark)
    return order.sort_ranked(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k")))


def check_sorted(spark, sf_dir):
    return order.check_sorted(words(spark, sf_dir), block=1000)


def sort_check(spark, sf_dir):
    w = line_keys(spark, sf_dir)
    s = order.sort_ranked(w)
    same = order.fingerprint(w).first() == order.fingerprint(s).first()
    return order.check_sorted(s, pos="rk").withColumn("same_keys", F.lit(int(same)).cast("long"))


def digit_histogram(spark, sf_dir):
    return partition.histogram(line_keys(spark, sf_dir))


def two_level_digits(spark, sf_dir):
    return partition.two_level(words(spark, sf_dir))


def msd_partition(spark, sf_dir):
    whole = partition.concatenated(partition.drained(partition.by_digit(line_keys(spark, sf_dir))))
    return whole.select("digit", "n", "first", keys.text_of(F.col("low")).alias("low"), keys.text_of(F.col("high")).alias("high"))


def splits(spark, sf_dir):
    rows = [(n, bits, len(w := plan_splits(n, bits)), ",".join(map(str, w))) for n in LENGTHS for bits in (16, 32, 64)]
    return spark.createDataFrame(rows, "n long, key_bits int, levels int, widths string")


def gen_constant_sum(spark, sf_dir):
    return order.lane_sums(generate.constant(spark, count(spark, sf_dir)))


def gen_lcg(width: int):
    return lambda spark, sf_dir: generate.lcg(spark, count(spark, sf_dir), width).select("pos", keys.text_of(F.col("k")).alias("k"))


def lane_sum_wrap(spark, sf_dir):
    return order.lane_sums(words(spark, sf_dir))


def affine_step(spark, sf_dir):
    return words(spark, sf_dir).select("pos", keys.text_of(keys.affine_step(F.col("k"), generate.A, generate.C)).alias("k"))


def interval_stab(spark, sf_dir):
    return intervals.stab(probes(spark, sf_dir), spans(spark, sf_dir))


def interval_stab_large(spark, sf_dir):
    return intervals.stab(probes(spark, sf_dir), spans(spark, sf_dir), small=0)


def interval_overlap(spark, sf_dir):
    wide = spans(spark, sf_dir).withColumn("b", F.col("a") + F.when(F.col("a") % 50 == 0, 17).otherwise(7))
    return intervals.overlaps(wide)


def interval_remove(spark, sf_dir):
    t = spans(spark, sf_dir)
    return intervals.remove(t, t.where("payload % 3 = 0").select("a"))


def interval_add(spark, sf_dir):
    t = spans(spark, sf_dir)
    return intervals.add(t, t.select((F.col("a") + 7).alias("a"), (F.col("b") + 2).alias("b"), "payload"))


def interval_walk(spark, sf_dir):
    return intervals.walk(spans(spark, sf_dir)).select("step", "a", "b", "payload")


def shuffled(spark, sf_dir):
    """The events out of order: numbered by their hashed key."""
    return order.sort_ranked(words(spark, sf_dir)).select(F.col("rk").alias("seq"), F.col("pos").alias("p"))


def lookback_violations(spark, sf_dir):
    return lookback.violations(shuffled(spark, sf_dir), 3000, block=500)


def lookback_largest(spark, sf_dir):
    return lookback.violations(shuffled(spark, sf_dir), 3000, against="largest", block=500)


def lookback_frame(spark, sf_dir):
    return lookback.frame_sums(shuffled(spark, sf_dir), 16, "p", "seq", block=500)


def skip_forward(spark, sf_dir):
    return lookback.skip_to(words(spark, sf_dir), 500).agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def scalars(spark, sf_dir):
    p = F.col("pos")
    return words(spark, sf_dir).select("pos", keys.round_up(p, 48).alias("up"), keys.round_down(p, 48).alias("down"), keys.highest_bit(p).cast("int").alias("top_bit"), keys.block_of(p, 8, 4096).alias("block"), keys.narrow(F.col("k"), 16).alias("high16"))


def small_array_sort(spark, sf_dir):
    w = words(spark, sf_dir).withColumn("g", F.floor(F.col("pos") / 32))
    return order.sort_small_arrays(w, "g").select("g", F.array_join(F.transform("keys", keys.text_of), ",").alias("keys"))


def dense(spark, sf_dir) -> DataFrame:
    """words() with dense positions from 0."""
    e = words(spark, sf_dir)
    return order.sort_ranked(e.withColumn("p", F.col("pos")), "p").select((F.col("rk") - 1).alias("pos"), "k")


def compare_exchange(spark, sf_dir):
    """Each word and its successor in the sequence, smaller one first."""
    k = F.col("k")
    low, high = keys.compare_exchange(k, keys.affine_step(k, generate.A, generate.C))
    return words(spark, sf_dir).select("pos", keys.text_of(low).alias("low"), keys.text_of(high).alias("high"))


def key_bounds(spark, sf_dir):
    f = keys.flip(F.col("k"))
    return words(spark, sf_dir).agg(keys.text_of(keys.flip(F.min(f))).alias("low"), keys.text_of(keys.flip(F.max(f))).alias("high"))


def shift_clamp(spark, sf_dir):
    """The last digit of 72 bits of levels: its shift would be -8, so it starts at the key's last bit."""
    return words(spark, sf_dir).select("pos", keys.digit(F.col("k"), -8, 8).alias("last"), keys.text_of(keys.digit(F.col("k"), -8)).alias("whole"))


def memory_overhead(spark, sf_dir):
    """What whole blocks of 4096 bytes hold beyond the words in them."""
    rows = [(n, -(-n * 8 // 4096), round(overhead_pct(-(-n * 8 // 4096) * 4096, n, 8), 6)) for n in LENGTHS]
    return spark.createDataFrame(rows, "n long, blocks long, overhead_pct double")


def speed_report(spark, sf_dir):
    """A report for each type of event, at half a second each, in order of the type's name."""
    sizes = words_by_type(spark, sf_dir)
    ticks = iter(range(10**6))
    report = SpeedReport(sum(sizes) * 8, clock=lambda: next(ticks) / 4)  # two looks at the clock a report
    for n in sizes:
        report.add(n * 8)
    return report.frame(spark).select("step", F.round("mb", 9).alias("mb"), F.round("done_pct", 9).alias("done_pct"))


def words_by_type(spark, sf_dir) -> list[int]:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    return [r["n"] for r in e.orderBy("event_type").collect()]


def sort_iterations(spark, sf_dir):
    return sort_job(spark, count(spark, sf_dir), 2).select("iteration", "n_unsorted", "n_processed", "same_keys")


def stream_registry(spark, sf_dir):
    """Two streams by name; one is removed, the other found and summed."""
    import uuid

    registry, a, b = once.Registry(spark), f"s_{uuid.uuid4().hex}", f"s_{uuid.uuid4().hex}"
    registry.add(a, words(spark, sf_dir))
    registry.add(b, generate.constant(spark, 10))
    registry.remove(b)
    assert registry.find(b) is None
    return order.lane_sums(registry.find(a))


def vanishing_sum(spark, sf_dir):
    """Each task's lane sums from one pass over batches that vanish, then their total."""

    def sums(blocks):
        totals = np.zeros(2, np.uint64)
        for b in blocks:
            lane = b.column("pos").to_numpy() % 2
            for x in range(2):
                totals[x] += b.column("k").to_numpy().view(np.uint64)[lane == x].sum(dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(totals.view(np.int64))], names=["lane", "k"])

    parts = once.one_pass(words(spark, sf_dir), sums, "lane int, k long")
    return parts.groupBy("lane").agg(order.wrapping_sum(F.col("k")).alias("total"))


def memory_roundtrip(spark, sf_dir):
    """The words into the driver's memory and back."""
    back = once.from_array(spark, once.to_array(dense(spark, sf_dir)))
    return back.select("pos", keys.text_of(F.col("k")).alias("k"))


def raw_roundtrip(spark, sf_dir):
    path = scratch(spark, "raw")
    rawwords.write_words(dense(spark, sf_dir), path, block=4096)
    return rawwords.read_words(spark, path, block=8192).select("pos", keys.text_of(F.col("k")).alias("k"))


def raw_copy(spark, sf_dir):
    """Every byte of the copy, as words."""
    source, target = scratch(spark, "raw"), scratch(spark, "raw")
    rawwords.write_words(dense(spark, sf_dir), source, block=4096)
    rawwords.copy_words(spark, source, target, split=8192)
    return rawwords.read_words(spark, target).select("pos", keys.text_of(F.col("k")).alias("k"))


def raw_append(spark, sf_dir):
    """The words, and after them the same words again."""
    path, w = scratch(spark, "raw"), dense(spark, sf_dir)
    rawwords.write_words(w, path)
    n = w.count()
    rawwords.write_words(w.withColumn("pos", F.col("pos") + n), path)
    return order.lane_sums(rawwords.read_words(spark, path))


def raw_truncate(spark, sf_dir):
    """The sink was declared for all words and is closed after the first 500."""
    path = scratch(spark, "raw")
    rawwords.write_words(dense(spark, sf_dir), path, block=1024)
    rawwords.truncate_words(path, 500)
    return rawwords.read_words(spark, path).select("pos", keys.text_of(F.col("k")).alias("k"))


def raw_limit(spark, sf_dir):
    """A reader that ends after 300 words."""
    path = scratch(spark, "raw")
    rawwords.write_words(dense(spark, sf_dir), path, block=1024)
    return order.lane_sums(rawwords.read_words(spark, path, limit=300, block=512))


def raw_metadata(spark, sf_dir):
    path = scratch(spark, "raw")
    rawwords.write_words(dense(spark, sf_dir), path)
    return rawwords.metadata(spark, path).agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words"), F.min("first").alias("first"))


def stream_pipe_sum(spark, sf_dir):
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=1 << 13, ahead=8)) as p:
        p.produce(dense_positions(words(spark, sf_dir)))
        return pipe.lane_sums(p)


def stream_constant_sum(spark, sf_dir):
    n = count(spark, sf_dir)
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=max(1, n // 3), ahead=2, rows=n)) as p:
        p.produce(generate.constant(spark, n))
        return pipe.lane_sums(p)


def dense_positions(w: DataFrame) -> DataFrame:
    """Positions from 0, for ids that are dense from their least one."""
    least = w.agg(F.min("pos")).first()[0]
    return w.withColumn("pos", F.col("pos") - least)


def stream_lookback(spark, sf_dir):
    """Sums over each word's position and the 16 before it, a micro-batch at a time; the pipe keeps one block for it."""
    out = scratch(spark, "frames")
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=400, consumer_back=1, ahead=8)) as p:
        p.produce(dense_positions(words(spark, sf_dir)).select("pos", F.col("pos").alias("v")))

        def frames(window, number):
            # A window has 9 blocks of 400 rows at most: one task.
            seen = lookback.frame_sums(window.since(max(0, window.begin - 16)).coalesce(1), 16, "v", "pos")
            seen.where(F.col("pos") >= window.begin).write.mode("overwrite").parquet(f"{out}/batch={number}")

        p.consume(frames)
    return spark.read.parquet(out).select("pos", "frame_sum")


def stream_reset(spark, sf_dir):
    """A pipe that carried constants is emptied and carries the words."""
    with pipe.Pipe(spark, pipe.PipeConfig(block_rows=1 << 13, ahead=8)) as p:
        p.produce(generate.constant(spark, 1000))
        pipe.lane_sums(p)
        p.reset()
        p.produce(dense_positions(words(spark, sf_dir)))
        return pipe.lane_sums(p)


def pipe_config(spark, sf_dir):
    """Blocks that a pipe holds and rows that its producer may step back, for some settings."""
    rows = [(m, back, n, c.blocks, c.back_rows) for m in (0, 1, 4) for back in (0, 1, 4) for n in (1, 2) for c in [pipe.PipeConfig(1000, m, back, n)]]
    return spark.createDataFrame(rows, "consumer_back int, producer_back int, ahead int, blocks int, back_rows int")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [sort_u64, sort_duplicates, check_sorted, sort_check, digit_histogram, two_level_digits, msd_partition, gen_constant_sum, lane_sum_wrap, affine_step, interval_stab, interval_stab_large, interval_overlap, interval_remove, interval_add, interval_walk, lookback_violations, lookback_largest, lookback_frame, skip_forward, scalars, small_array_sort, compare_exchange, key_bounds, shift_clamp, memory_overhead, speed_report, sort_iterations, stream_registry, vanishing_sum, memory_roundtrip, raw_roundtrip, raw_copy, raw_append, raw_truncate, raw_limit, raw_metadata, stream_pipe_sum, stream_constant_sum, stream_lookback, stream_reset, pipe_config]
    return {f.__name__: f for f in own} | {"plan_splits": splits} | {f"gen_lcg{'' if w == 64 else f'_u{w}'}": gen_lcg(w) for w in (64, 32, 16, 8)}


_W = "SELECT event_id AS pos, ('0x' || substr(md5(event_id::VARCHAR), 1, 16))::UBIGINT AS u FROM events"
_L = "SELECT ('0x' || substr(md5((l_orderkey * 10 + l_linenumber)::VARCHAR), 1, 16))::UBIGINT AS u FROM lineitem"
_T = "SELECT event_id * 10 AS a, event_id * 10 + 7 AS b, user_id AS payload FROM events"
_S = f"SELECT row_number() OVER (ORDER BY u) AS seq, pos AS p FROM ({_W})"
_2_64 = "18446744073709551616::HUGEINT"
_LANES = f"SELECT (pos % 2)::INTEGER AS lane, (sum(u::HUGEINT) % {_2_64})::VARCHAR AS total FROM"
_DENSE = f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, u FROM ({_W})"
_W0 = f"SELECT pos - (SELECT min(event_id) FROM events) AS pos, u FROM ({_W})"
_STEPS = ", ".join(f"({lane}, {seed}::HUGEINT)" for lane, seed in enumerate(generate.SEEDS))


def _mulmod(x: str) -> str:
    """x * A + C modulo 2^64 for x below 2^64: the product stays below 2^127."""
    return f"({x} * {generate.A}::HUGEINT + {generate.C}::HUGEINT) % {_2_64}"


def _lcg_sql(width: int) -> str:
    return f"""WITH RECURSIVE r(lane, step, x) AS (SELECT lane, 0, {_mulmod('s')} FROM (VALUES {_STEPS}) v(lane, s)
UNION ALL SELECT lane, step + 1, {_mulmod('x')} FROM r WHERE (step + 1) * 4 + lane < (SELECT count(*) FROM events))
SELECT (step * 4 + lane)::BIGINT AS pos, (x // {1 << (64 - width)}::HUGEINT)::VARCHAR AS k FROM r"""


def oracle_sql() -> dict[str, str]:
    stab = f"SELECT x, CASE WHEN b > x THEN a END AS a, CASE WHEN b > x THEN payload END AS payload FROM (SELECT event_id * 10 + event_id % 10 AS x FROM events) e ASOF LEFT JOIN ({_T}) t ON e.x >= t.a"
    ns = ", ".join(f"({n}::BIGINT)" for n in LENGTHS)
    return {
        "sort_u64": f"SELECT row_number() OVER (ORDER BY u) AS rk, u::VARCHAR AS k FROM ({_L})",
        "sort_duplicates": "SELECT row_number() OVER (ORDER BY l_orderkey) AS rk, l_orderkey AS k FROM lineitem",
        "check_sorted": f"SELECT sum(CASE WHEN l > u THEN 1 ELSE 0 END)::BIGINT AS n_unsorted, count(*) AS n_processed FROM (SELECT u, lag(u) OVER (ORDER BY pos) AS l FROM ({_W}))",
        "sort_check": "SELECT 0::BIGINT AS n_unsorted, count(*) AS n_processed, 1::BIGINT AS same_keys FROM lineitem",
        "digit_histogram": f"SELECT (u >> 56)::BIGINT AS digit, count(*) AS n FROM ({_L}) GROUP BY 1",
        "two_level_digits": f"SELECT (u >> 56)::BIGINT AS d0, ((u >> 48) & 255)::BIGINT AS d1, count(*) AS n FROM ({_W}) GROUP BY 1, 2",
        "msd_partition": f"SELECT digit, n, (sum(n) OVER (ORDER BY digit) - n)::BIGINT AS first, low, high FROM (SELECT (u >> 58)::INTEGER AS digit, count(*) AS n, min(u)::VARCHAR AS low, max(u)::VARCHAR AS high FROM ({_L}) GROUP BY 1)",
        "plan_splits": f"""WITH a AS (SELECT n, key_bits, CASE WHEN n <= 8 THEN 0 ELSE least(key_bits, length(bin((n + 7) // 8 - 1))) END AS front FROM (VALUES {ns}) v(n), (VALUES (16), (32), (64)) w(key_bits)),
b AS (SELECT n, key_bits, CASE WHEN n <= 8 THEN [] ELSE [front, key_bits - front] END AS parts FROM a),
c AS (SELECT n, key_bits, flatten(list_transform(parts, lambda t: list_transform(range((t + 7) // 8), lambda i: t // ((t + 7) // 8) + CASE WHEN i < t % ((t + 7) // 8) THEN 1 ELSE 0 END))) AS w FROM b)
SELECT n, key_bits, coalesce(len(w), 0)::INTEGER AS levels, coalesce(array_to_string(w, ','), '') AS widths FROM c""",
        "gen_constant_sum": "SELECT (i % 2)::INTEGER AS lane, sum(32)::VARCHAR AS total FROM (SELECT row_number() OVER () - 1 AS i FROM events) GROUP BY 1",
        "lane_sum_wrap": f"{_LANES} ({_W}) GROUP BY 1",
        "affine_step": f"SELECT pos, ({_mulmod('u::HUGEINT')})::VARCHAR AS k FROM ({_W})",
        "interval_stab": stab,
        "interval_stab_large": stab,
        "interval_overlap": "SELECT a, b, reaches FROM (SELECT a, b, max(b) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reaches FROM (SELECT event_id * 10 AS a, event_id * 10 + CASE WHEN event_id * 10 % 50 = 0 THEN 17 ELSE 7 END AS b FROM events)) WHERE reaches > a",
        "interval_remove": f"SELECT * FROM ({_T}) WHERE payload % 3 <> 0",
        "interval_add": f"{_T} UNION ALL SELECT a + 7, b + 2, payload FROM ({_T})",
        "interval_walk": f"SELECT row_number() OVER (ORDER BY a) AS step, a, b, payload FROM ({_T})",
        "lookback_violations": f"SELECT * FROM (SELECT seq, p, lag(p) OVER (ORDER BY seq) AS seen FROM ({_S})) WHERE p < seen - 3000",
        "lookback_largest": f"SELECT * FROM (SELECT seq, p, max(p) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({_S})) WHERE p < seen - 3000",
        "lookback_frame": f"SELECT seq, p, (sum(p) OVER (ORDER BY seq ROWS BETWEEN 16 PRECEDING AND CURRENT ROW))::BIGINT AS frame_sum FROM ({_S})",
        "skip_forward": "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE event_id >= 500",
        "scalars": f"SELECT pos, (pos + 47) // 48 * 48 AS up, pos // 48 * 48 AS down, CASE WHEN pos <> 0 THEN (length(bin(pos)) - 1)::INTEGER END AS top_bit, pos * 8 // 4096 AS block, (u >> 48)::BIGINT AS high16 FROM ({_W})",
        "small_array_sort": f"SELECT pos // 32 AS g, string_agg(u::VARCHAR, ',' ORDER BY u) AS keys FROM ({_W}) GROUP BY 1",
        "raw_roundtrip": f"SELECT pos, u::VARCHAR AS k FROM ({_DENSE})",
        "raw_copy": f"SELECT pos, u::VARCHAR AS k FROM ({_DENSE})",
        "raw_append": f"{_LANES} ({_DENSE} UNION ALL SELECT pos + (SELECT count(*) FROM events), u FROM ({_DENSE})) GROUP BY 1",
        "raw_truncate": f"SELECT pos, u::VARCHAR AS k FROM ({_DENSE}) WHERE pos < 500",
        "raw_limit": f"{_LANES} ({_DENSE}) WHERE pos < 300 GROUP BY 1",
        "raw_metadata": "SELECT count(*) * 8 AS bytes, count(*) AS words, 0::BIGINT AS first FROM events",
        "memory_roundtrip": f"SELECT pos, u::VARCHAR AS k FROM ({_DENSE})",
        "compare_exchange": f"SELECT pos, least(u, v)::VARCHAR AS low, greatest(u, v)::VARCHAR AS high FROM (SELECT pos, u::HUGEINT AS u, {_mulmod('u::HUGEINT')} AS v FROM ({_W}))",
        "key_bounds": f"SELECT min(u)::VARCHAR AS low, max(u)::VARCHAR AS high FROM ({_W})",
        "shift_clamp": f"SELECT pos, (u & 255)::BIGINT AS last, u::VARCHAR AS whole FROM ({_W})",
        "memory_overhead": f"SELECT n, (n * 8 + 4095) // 4096 AS blocks, round(100.0::DOUBLE * ((n * 8 + 4095) // 4096 * 4096 / (n * 8)::DOUBLE - 1), 6) AS overhead_pct FROM (VALUES {ns}) v(n)",
        "speed_report": "SELECT (row_number() OVER w - 1)::INTEGER AS step, round((sum(n) OVER w)::DOUBLE * 8 / 1e6, 9) AS mb, round(100.0::DOUBLE * (sum(n) OVER w)::DOUBLE / (SELECT count(*) FROM events), 9) AS done_pct FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) WINDOW w AS (ORDER BY event_type)",
        "sort_iterations": "SELECT i::INTEGER AS iteration, 0::BIGINT AS n_unsorted, (SELECT count(*) FROM events) AS n_processed, true AS same_keys FROM range(2) t(i)",
        "stream_registry": f"{_LANES} ({_W}) GROUP BY 1",
        "vanishing_sum": f"{_LANES} ({_W}) GROUP BY 1",
        "stream_pipe_sum": f"{_LANES} ({_W0}) GROUP BY 1",
        "stream_reset": f"{_LANES} ({_W0}) GROUP BY 1",
        "stream_constant_sum": "SELECT (i % 2)::INTEGER AS lane, sum(32)::VARCHAR AS total FROM (SELECT row_number() OVER () - 1 AS i FROM events) GROUP BY 1",
        "stream_lookback": f"SELECT pos, (sum(pos) OVER (ORDER BY pos ROWS BETWEEN 16 PRECEDING AND CURRENT ROW))::BIGINT AS frame_sum FROM ({_W0})",
        "pipe_config": "SELECT m::INTEGER AS consumer_back, l::INTEGER AS producer_back, n::INTEGER AS ahead, (m + l + n + 1)::INTEGER AS blocks, (l * 1000)::INTEGER AS back_rows FROM (VALUES (0), (1), (4)) a(m), (VALUES (0), (1), (4)) b(l), (VALUES (1), (2)) c(n)",
        "gen_lcg": _lcg_sql(64),
        "gen_lcg_u32": _lcg_sql(32),
        "gen_lcg_u16": _lcg_sql(16),
        "gen_lcg_u8": _lcg_sql(8),
    }
