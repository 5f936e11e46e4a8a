"""The iterated sort job: make the same keys anew, sort them, check the result, report rate and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import Stopwatch, million_items_per_second, overhead_pct, peak_memory
from ..operators import generate, order
from ..session import cut

REPORT = "iteration int, n_unsorted long, n_processed long, same_keys boolean, m_keys_s double, memory_overhead_pct double"


def sort_job(spark: SparkSession, n: int, iterations: int = 3, width: int = 64) -> DataFrame:
    """A row an iteration: neighbours out of order and keys processed, whether the keys are those that were made, the
    rate in million keys a second (making the keys isn't counted; writing the ranked result is) and the largest peak of
    execution memory beyond the keys themselves, in percent. Every iteration makes the same keys."""
    out = []
    for number in range(iterations):
        made = cut(generate.lcg(spark, n, width).select("k"), "keys")
        watch = Stopwatch()
        done = cut(order.sort_ranked(made), "job")
        rate = million_items_per_second(n, watch.total())
        check = order.check_sorted(done, pos="rk").first()
        before, after = (order.fingerprint(x).first() for x in (made, done.select("k")))
        out.append((number, check["n_unsorted"], check["n_processed"], before == after, rate, overhead_pct(peak_memory(spark), n, 8)))
    return spark.createDataFrame(out, REPORT)


def summary(report: DataFrame) -> DataFrame:
    """One row over all iterations: how many, keys out of order, and the best and mean rate."""
    return report.agg(F.count("*").alias("iterations"), F.sum("n_unsorted").alias("n_unsorted"), F.max("m_keys_s").alias("best_m_keys_s"), F.avg("m_keys_s").alias("mean_m_keys_s"))
