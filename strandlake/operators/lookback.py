"""Bounded look-back over a stream of positions.

A producer may step back at most `back` positions behind its previous write; a consumer may look at the last `rows` rows.
Both are rules of position: event-time watermarks drop late rows silently and a batch late, so they are checked here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import StreamError


def violations(df: DataFrame, back: int, order: str = "seq", pos: str = "p", against: str = "previous", block: int = 1 << 20) -> DataFrame:
    """Rows written more than `back` behind the previous one (or behind the largest so far, against="largest").

    Neighbours meet in blocks of the order column; the ends of each block carry over, a row a block.
    """
    if against not in ("previous", "largest"):
        raise StreamError("against is previous or largest")
    rows = df.withColumn("__b", F.floor(F.col(order) / F.lit(block)))
    w = Window.partitionBy("__b").orderBy(order)
    over = Window.orderBy("__b")
    if against == "previous":
        ends = rows.groupBy("__b").agg(F.max_by(pos, order).alias("e")).select("__b", F.lag("e").over(over).alias("__before"))
        seen = F.coalesce(F.lag(pos).over(w), F.col("__before"))
    else:
        ends = rows.groupBy("__b").agg(F.max(pos).alias("e")).select("__b", F.max("e").over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
        seen = F.greatest(F.max(pos).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    return rows.join(ends, "__b").withColumn("seen", seen).where(F.col(pos) < F.col("seen") - F.lit(back)).select(*df.columns, "seen")


def frame_sums(df: DataFrame, rows: int, key: str, order: str, block: int = 1 << 20) -> DataFrame:
    """df with the sum of key over each row and the `rows` before it. Each block also gets the last rows of the one before."""
    if rows >= block:
        raise StreamError("a frame must be smaller than a block")
    own = F.floor(F.col(order) / F.lit(block))
    tail = F.pmod(F.col(order), F.lit(block)) >= block - rows
    w = Window.partitionBy("__b").orderBy(order).rowsBetween(-rows, 0)
    # A tail's rows go to both blocks in one pass over df.
    both = df.withColumn("__b", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    return both.withColumn("frame_sum", F.sum(key).over(w)).where(F.col("__b").eqNullSafe(own)).drop("__b")


def skip_to(df: DataFrame, pos: int, column: str = "pos") -> DataFrame:
    """A reader that jumps ahead: rows before pos are consumed unseen."""
    return df.where(F.col(column) >= pos)
