"""Exact percentiles by selection in a radix tree of counts: no group's values are sorted or held in one task.

Values are whole numbers. They are counted once, each distinct value of a
group; these counts are summed by all but the last DIGIT bits of a value, by
all but the last two digits, and so on, up to a level with few nodes. A rank is
then sought from the top among the children of the node that holds it, of which
there are at most 2 ** DIGIT; no more are ever put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import kept

#: Bits of a value that one level tells apart.
DIGIT = 12


def _up(value: Column, levels: int, digit: int) -> Column:
    """The node of a value; arithmetic shifts keep the order of negative numbers too."""
    return F.shiftright(value, levels * digit) if levels * digit < 64 else F.when(value < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")


def ranked(rows: DataFrame, column: str, wanted: DataFrame, by: tuple[str, ...], digit: int = DIGIT) -> DataFrame:
    """The wanted ranks (by..., rank from 0) with `value`, the value that has this place among a group's values in order; nulls have no place."""
    counted = kept(rows.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("long").alias("_v")).agg(F.count("*").alias("_n")))
    ends = counted.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
    if ends["lo"] is None:
        return wanted.withColumn("value", F.lit(None).cast("long")).limit(0)
    # Up to the level at which all values lie in one node or in two, on either side of 0.
    top = next(k for k in range(64 // digit + 2) if ends["lo"] >> k * digit >= -1 and ends["hi"] >> k * digit <= 0)
    levels = [counted]
    for _ in range(top):
        levels.append(levels[-1].groupBy(*by, _up(F.col("_v"), 1, digit).alias("_v")).agg(F.sum("_n").alias("_n")))
    found = wanted.withColumns({"_node": F.lit(None).cast("long"), "_left": F.col("rank")})
    for k in range(top, -1, -1):
        if k == top:
            nodes = levels[k].withColumn("_parent", F.lit(None).cast("long"))
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        else:
            nodes = levels[k].withColumn("_parent", _up(F.col("_v"), 1, digit))
            on = [*[F.col(f"n.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], F.col("n._parent") == F.col("r._node")]
        before = Window.partitionBy(*by, "_parent").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        placed = nodes.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        inside = (F.col("r._left") >= F.col("n._ahead")) & (F.col("r._left") < F.col("n._ahead") + F.col("n._n"))
        joined = found.alias("r").join(placed.alias("n"), [*(on or [F.lit(True)]), inside])
        found = joined.select(*[F.col(f"r.{c}").alias(c) for c in wanted.columns], F.col("n._v").alias("_node"), (F.col("r._left") - F.col("n._ahead")).alias("_left"))
    return found.select(*wanted.columns, F.col("_node").alias("value"))


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], by: tuple[str, ...] = (), digit: int = DIGIT) -> DataFrame:
    """by... and a column per share (name to fraction) with the exact percentile, interpolated between the two values around (n - 1) * fraction."""
    n = rows.groupBy(*by).agg(F.count(column).alias("_all")).filter("_all > 0")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(f).alias("f")) for k, f in shares.items()]))
    at = n.select(*by, ((F.col("_all") - 1)).alias("_last"), asked.alias("_q")).select(*by, F.col("_q.name").alias("name"), (F.col("_last") * F.col("_q.f")).alias("at"))
    both = at.select(*by, "name", (F.col("at") - F.floor("at")).alias("part"), F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    told = ranked(rows, column, both, by, digit).groupBy(*by, "name").agg((F.min("value") + (F.max("value") - F.min("value")) * F.max("part")).alias("p"))
    return told.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("p"))).cast("double").alias(k) for k in shares])
