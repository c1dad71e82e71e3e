"""Quality-control pools and proportional stratified samples, of frames or of ranges of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import kept
from ..config import ASSUMED, BINARY_SEARCH, DETECTED, LOGIC
from .slices import with_slice

MODES = (DETECTED, BINARY_SEARCH, LOGIC, ASSUMED)
#: Samples up to which what has a row per sample is broadcast.
MOST_BROADCAST = 100_000
#: Steps of a walk.
WALK = 17


def has_source(timeline: DataFrame) -> bool:
    """Whether FILL_SOURCE tells anything; a column of nulls counts as absent."""
    return "FILL_SOURCE" in timeline.columns and timeline.filter("FILL_SOURCE is not null").limit(1).count() > 0


def pool(timeline: DataFrame, mode: str, with_source: bool | None = None) -> DataFrame:
    """The rows of a mode, by whichever of FILL_SOURCE and BINARY_SEARCH the table has."""
    if mode == DETECTED:
        return timeline.filter(F.col("ASSUMPTION_TYPE") == DETECTED)
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    rows = timeline.filter((F.col("ASSUMPTION_TYPE") == ASSUMED) & F.col("IN_NEST").isin(0, 1))
    if mode == ASSUMED:
        return rows
    if has_source(timeline) if with_source is None else with_source:
        return rows.filter(F.col("FILL_SOURCE") == mode)
    if "BINARY_SEARCH" in timeline.columns:
        return rows.filter(F.col("BINARY_SEARCH") == (1 if mode == BINARY_SEARCH else 0))
    if mode == BINARY_SEARCH:
        raise ValueError("the table does not tell which frames were reviewed")
    return rows


def mode_of(samples: DataFrame) -> str:
    """The mode that a table of samples was drawn in; unknown or absent means ASSUMED."""
    if "QC_MODE" not in samples.columns:
        return ASSUMED
    first = samples.select("QC_MODE").first()
    value = (first["QC_MODE"] or "").strip().upper() if first else ""
    return value if value in MODES else ASSUMED


def require_one_animal(rows: DataFrame) -> DataFrame:
    """The rows, or an error if they are of several animals or of none that is known."""
    found = [r["ANIMALID"] for r in rows.select("ANIMALID").distinct().limit(11).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError(f"rows of one animal are needed, found {found}")
    return rows


def strata(rows: DataFrame) -> list[str]:
    """The columns that tell strata, of those that the table has: a gap of an animal; an animal's detected rows are one of their own, and a table without any of these is one."""
    return [c for c in ("ANIMALID", "GAP_START_FRAME", "GAP_END_FRAME") if c in rows.columns]


def sizes(rows: DataFrame) -> Column:
    """Frames of a row: of a range (first_frame, last_frame), or one."""
    return F.col("last_frame") - F.col("first_frame") + 1 if "first_frame" in rows.columns else F.lit(1).cast("long")


def allocation(rows: DataFrame, n: int) -> DataFrame:
    """Strata with their size in frames and share of n, by largest remainders.

    Rows are frames or ranges of frames. Whole numbers throughout; equal
    remainders go by animal and gap, nulls last. What is left after rounding
    down goes to fewer than n strata, so only the n largest remainders are ranked.
    The rows are evaluated once, for the sizes of their strata.
    """
    keys = strata(rows)
    found = kept(rows.groupBy(*keys).agg(F.sum(sizes(rows)).cast("long").alias("size")).filter("size > 0"))
    shared = found.join(F.broadcast(found.agg(F.sum("size").alias("_all"))), how="cross")
    shared = shared.withColumns({"_base": F.expr(f"{n}L * size div _all"), "_rest": F.expr(f"{n}L * size % _all")})
    order = [F.desc("_rest"), *[F.col(k).asc_nulls_last() for k in keys]]
    likely = shared.orderBy(*order).limit(n).withColumn("_place", F.row_number().over(Window.orderBy(*order)))
    left = shared.agg((F.lit(n) - F.sum("_base")).alias("_left"))
    more = likely.join(F.broadcast(left), F.col("_place") <= F.col("_left")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(1).cast("long").alias("_more"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or [F.lit(True)]
    return shared.join(F.broadcast(more) if n <= MOST_BROADCAST else more, same, "left").select(*keys, "size", (F.col("_base") + F.coalesce("_more", F.lit(0))).cast("long").alias("allocated"))


def permuted(place: Column, size: Column, key: Column) -> Column:
    """The place from 0 to size - 1 where a keyed permutation puts `place`: four rounds of a Feistel network over a rectangle that just holds `size` places.

    A place outside `size` is permuted again until it is inside (cycle walking). The
    rectangle has fewer than its width of such places: up to a width of WALK
    that many steps always do, beyond it some 1 / width of the places need
    another step, and to need more than WALK is an error that never comes.
    """
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    whole = lambda x, by: ((x - x % by) / by).cast("long")
    b = whole(size + a - 1, a)
    mix = lambda j, v: F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(j)), v.cast("string"))), 1, 15), 16, 10).cast("long")

    def once(x: Column) -> Column:
        left, right = x % a, whole(x, a)
        left = (left + mix(0, right)) % a
        right = (right + mix(1, left)) % b
        left = (left + mix(2, right)) % a
        right = (right + mix(3, left)) % b
        return (left + a * right).cast("long")

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(place.cast("long")), lambda x, _: F.when(x < size, x).otherwise(once(x)))
    return F.when(walked < size, walked).otherwise(F.raise_error(F.lit("a place was not found; take another seed")).cast("long"))


def sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n frames, each stratum giving its allocation: the first places of a permutation of its frames that seed and stratum key.

    Rows are frames or ranges of frames. A place becomes a frame by the running
    number of frames before each range, summed up within slices and along them,
    so no frame outside the sample is made and no stratum is ordered in one task.
    The pool is evaluated once and written: sizes come from all of it, places from the strata that are drawn from.
    """
    rows = kept(rows)
    given = allocation(rows, n)
    have = given.agg(F.sum("size").alias("n")).first()["n"] or 0
    if not have:
        raise ValueError("the pool is empty")
    if n > have:
        raise ValueError(f"{n} samples from a pool of {have}")
    keys = strata(rows)
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    places = given.filter("allocated > 0").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("allocated") - 1)))
    places = kept(places.select(*[F.col(k).alias(f"_{k}") for k in keys], permuted(F.col("_i"), F.col("size"), key).alias("_at")))
    small = F.broadcast if n <= MOST_BROADCAST else lambda df: df  # at most n rows
    same = lambda: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or [F.lit(True)]
    first = "first_frame" if "first_frame" in rows.columns else "FRAMENUMBER"
    own = with_slice(rows.join(small(places.drop("_at").distinct()), same(), "left_semi") if keys else rows, first).withColumn("_n", sizes(rows))
    inside = Window.partitionBy(*keys, "_slice").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = own.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_all")).select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("_slice").alias("a_slice"), F.coalesce(F.sum("_all").over(along), F.lit(0)).alias("_ahead"))
    met = own.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(ahead, [*[F.col(k).eqNullSafe(F.col(f"a_{k}")) for k in keys], F.col("_slice") == F.col("a_slice")])
    low = F.col("_ahead") + F.col("_before")
    drawn = met.join(small(places), [*same(), F.col("_at") >= low, F.col("_at") < low + F.col("_n")])
    frame = F.col(first) + F.col("_at") - low
    rest = [c for c in rows.columns if c not in ("ANIMALID", "first_frame", "last_frame", "FRAMENUMBER")]
    return drawn.select(*[c for c in ("ANIMALID",) if c in rows.columns], frame.alias("FRAMENUMBER"), *rest)
