"""Region metadata: one row per animal, bounds null where a region is not given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT, Config, Region

BOUNDS = [f"{r}_{a}{m}" for r in ("NEST", "BUFFER") for a in "XY" for m in ("MIN", "MAX")]
SCHEMA = "ANIMALID long, " + ", ".join(f"{b} double" for b in BOUNDS)


def bounds(r: Region | None) -> tuple:
    return tuple(map(float, (r.xmin, r.xmax, r.ymin, r.ymax))) if r else (None,) * 4


def roi_metadata(spark: SparkSession, animals: list[tuple], c: Config | None = DEFAULT) -> DataFrame:
    return spark.createDataFrame([(a, *bounds(c and c.nest), *bounds(c and c.buffer)) for (a,) in animals], SCHEMA)


def write(spark: SparkSession, path: str, animal: int, nest: Region | None, buffer: Region | None, overwrite: bool = True) -> bool:
    """Writes one row; nothing if neither region is given."""
    if nest is None and buffer is None:
        return False
    spark.createDataFrame([(animal, *bounds(nest), *bounds(buffer))], SCHEMA).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return True


def read(spark: SparkSession, path: str) -> tuple[Region | None, Region | None]:
    """The regions of the first row; none if there is no table or no row."""
    from pyspark.errors import AnalysisException

    try:
        table = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, None
    row = table.limit(1).first()
    if row is None:
        return None, None
    region = lambda k: Region(*(row[f"{k}_{x}"] for x in ("XMIN", "XMAX", "YMIN", "YMAX"))) if row[f"{k}_XMIN"] is not None else None
    return region("NEST"), region("BUFFER")
