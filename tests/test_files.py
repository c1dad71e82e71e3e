"""SQLite files: columns and rows that SQLite leaves out, writes that commit or leave nothing, whole files cut; regions and live reviews from the command line."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from frameloom.cli import main
from frameloom.config import Region
from frameloom.sources import metadata, sqlite
from frameloom.streaming import live_review


def made(path):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE DETECTION (ID INTEGER PRIMARY KEY, FRAMENUMBER INTEGER NOT NULL, ANIMALID INTEGER, MASS_X REAL, NOTE TEXT DEFAULT 'x', RAW BLOB)")
        db.execute("CREATE INDEX by_frame ON DETECTION (FRAMENUMBER, ANIMALID)")
        db.execute('CREATE TABLE "odd name" ("a b" TEXT, FRAMENUMBER INTEGER, PRIMARY KEY ("a b"))')
        db.execute("CREATE TABLE ANIMAL (ID INTEGER PRIMARY KEY, NAME TEXT UNIQUE)")
        db.execute("CREATE TABLE EMPTY (x INTEGER)")
        db.executemany("INSERT INTO DETECTION VALUES (?, ?, ?, ?, ?, ?)", [(3 * k, k % 40, k % 2, k / 2 if k % 3 else None, f"n'{k}" if k % 5 else None, bytes([k, 0, 255])) for k in range(1, 101)])
        db.executemany('INSERT INTO "odd name" VALUES (?, ?)', [(f"k{k}", k) for k in range(30)])
        db.executemany("INSERT INTO ANIMAL VALUES (?, ?)", [(1, "a"), (2, None)])


def content(path, table, where=""):
    with sqlite3.connect(path) as db:
        return sorted(map(repr, db.execute(f'SELECT * FROM "{table}" {where}').fetchall()))


def test_columns_are_left_out(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    made(path)
    df = sqlite.read(spark, path, "DETECTION", where=(("ANIMALID", "=", 1),), only=("FRAMENUMBER", "MASS_X"))
    assert df.columns == ["FRAMENUMBER", "MASS_X"] and df.count() == 50
    reader = sqlite.SqliteReader(path, "DETECTION", 3, [["ANIMALID", "=", 1]], ["FRAMENUMBER"])
    asked = []
    real = sqlite._open

    class Traced:
        def __init__(self, p):
            self.own = real(p)

        def __enter__(self):
            db = self.own.__enter__()
            db.set_trace_callback(asked.append)
            return db

        def __exit__(self, *e):
            return self.own.__exit__(*e)

    sqlite._open = Traced
    try:
        assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == 50
    finally:
        sqlite._open = real
    assert any('SELECT "FRAMENUMBER" FROM "DETECTION"' in q and '"ANIMALID" = 1' in q for q in asked)


def test_a_write_commits_or_leaves_nothing(spark, tmp_path):
    folder, df = str(tmp_path / "out"), spark.range(100).withColumn("s", F.concat(F.lit("v"), "id")).repartition(4)
    sqlite.save(df, folder, "T")
    assert sorted(x for f in os.listdir(folder) for x in content(os.path.join(folder, f), "T")) == sorted(repr((k, f"v{k}")) for k in range(100))
    assert not [f for f in os.listdir(folder) if f.startswith("_writing")]
    before = sorted(os.listdir(folder))
    bad = df.withColumn("s", F.when(F.col("id") == 77, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("s")))
    with pytest.raises(Exception, match="broken"):
        sqlite.save(bad, folder, "T", overwrite=True)
    assert sorted(os.listdir(folder)) == before
    sqlite.save(df.limit(3), folder, "T", overwrite=True)
    assert sum(len(content(os.path.join(folder, f), "T")) for f in os.listdir(folder)) == 3


def test_a_failed_gather_leaves_the_file(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    made(path)
    sqlite.write(spark.range(5), path, "NEW")
    assert content(path, "NEW") == sorted(repr((k,)) for k in range(5)) and len(content(path, "DETECTION")) == 100
    with pytest.raises(ValueError, match="has a table"):
        sqlite.write(spark.range(5), path, "NEW")
    sqlite.write(spark.range(2), path, "NEW", overwrite=True)
    assert len(content(path, "NEW")) == 2
    with open(path, "rb") as f:
        was = f.read()
    folder = tmp_path / "shards"
    sqlite.save(spark.range(4).select(F.lit(1).alias("ID"), F.col("id").cast("string").alias("NAME")), str(folder), "ANIMAL2")
    with pytest.raises(sqlite3.IntegrityError):
        sqlite.gather({"ANIMAL2": str(folder)}, path, {"ANIMAL2": ['CREATE TABLE "ANIMAL2" (ID INTEGER PRIMARY KEY, NAME TEXT)']})
    with open(path, "rb") as f:
        assert f.read() == was
    assert sorted(os.listdir(tmp_path)) == ["a.sqlite", "shards"]


def test_a_whole_file_is_cut(spark, tmp_path):
    source, target = str(tmp_path / "a.sqlite"), str(tmp_path / "b.sqlite")
    made(source)
    assert main(["cut", source, target, "--first", "5", "--last", "20"], spark) == 0
    assert sqlite.tables(target) == sqlite.tables(source)
    for t in sqlite.tables(source):
        assert sqlite.definitions(target, t) == sqlite.definitions(source, t)
        assert sqlite.columns(target, t) == sqlite.columns(source, t)
        assert content(target, t) == content(source, t, "WHERE FRAMENUMBER BETWEEN 5 AND 20" if t in ("DETECTION", "odd name") else "")
    assert main(["cut", source, target, "--first", "5", "--last", "20"], spark) == 1  # is there
    with pytest.raises(ValueError, match="after the last"):
        sqlite.cut_file(spark, source, str(tmp_path / "c.sqlite"), 9, 8)


def test_regions_live_and_samples_from_the_command_line(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    rows = [(k, 1, f, x, 5.0) for k, (f, x) in enumerate(((0, 5.0), (4000, 50.0), (4001, 5.0), (9000, 50.0)))]
    spark.createDataFrame(rows, "_rowid long, ANIMALID long, FRAMENUMBER long, MASS_X double, MASS_Y double").write.parquet(path("det"))
    region = ["--nest", "0", "10", "0", "10", "--buffer", "-5", "15", "-5", "15"]
    assert main(["regions", path("det"), path("roi"), *region], spark) == 0
    assert metadata.read(spark, path("roi")) == (Region(0.0, 10.0, 0.0, 10.0), Region(-5.0, 15.0, -5.0, 15.0))
    assert main(["regions", path("det"), path("roi"), *region], spark) == 1  # is there
    assert main(["regions", path("det"), path("copy"), "--regions", path("roi")], spark) == 0  # handed on
    event = lambda seq, answer: spark.createDataFrame([(1, seq, "ANSWER", answer, None)], live_review.EVENTS).coalesce(1).write.mode("append").parquet(path("events"))
    event(1, 1)
    live = ["live", path("det"), path("changes"), "--events", path("events"), "--regions", path("copy")]
    assert main(live, spark) == 0
    event(2, 0)
    assert main(live, spark) == 0  # goes on
    changes = spark.read.parquet(path("changes"))
    assert sorted((r["seg_start"], r["seg_end"], r["value"]) for r in live_review.decided(changes).collect()) == [(1, 2000, 1), (3000, 3999, 0)]
    assert live_review.standing(changes).filter("step = 0").first()["show_frame"] == 2500
    assert main(["fill", path("det"), path("filled"), "--regions", path("copy")], spark) == 0
    assert main(["fill", path("det"), path("other"), "--regions", path("none")], spark) == 0  # no table: the defaults
    spark.createDataFrame([("/v/cam_t0.mp4", 3000, 15.0), ("/v/cam_t8995.mp4", 2, 15.0)], "path string, frame_count long, fps double").write.parquet(path("files"))
    spark.createDataFrame([("/v/cam_t8995.mp4",)], "path string").write.parquet(path("bad"))
    timeline = spark.read.parquet(path("filled")).withColumn("IN_NEST", F.lit(1))
    timeline.write.parquet(path("timeline"))
    assert main(["sample", path("timeline"), path("samples"), "--mode", "ASSUMED", "--n", "12", "--seed", "3", "--files", path("files"), "--unreadable", path("bad")], spark) == 0
    found = spark.read.parquet(path("samples")).orderBy("sample_id").collect()
    assert [r["sample_id"] for r in found] == list(range(1, 13)) and {r["video"] for r in found} == {"cam_t0.mp4"}
    assert all(r["frame_global"] == min(r["requested_frame"], 5998) and r["seed"] == 3 for r in found)
