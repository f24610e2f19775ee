"""Files: tracking tables, lookups, session documents, reports, manifests and frame containers."""

import itertools
import operator
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolane.sources import frames, tables


def test_tracking_csv(spark, tmp_path):
    (tmp_path / "a_tracking.csv").write_text("video_file,frame_number,elapsed_time_sec,mouse_centroid_x,mouse_roi_valid\nv,0,0.0,NaN,True\nv,1,0.1,2.5,False\n")
    (tmp_path / "notes.csv").write_text("other\n1\n")
    got = tables.read_tracking(spark, str(tmp_path)).orderBy("frame_number").collect()
    assert [(r.mouse_centroid_x, r.mouse_roi_valid, r.qc_flag, r.source_file) for r in got] == [(None, True, None, "a_tracking.csv"), (2.5, False, None, "a_tracking.csv")]


def test_lookup_strips_mark_and_blanks(spark, tmp_path):
    p = tmp_path / "lut.csv"
    p.write_text("﻿Video_name , Lane\n abc ,F\n,B\n", encoding="utf-8")
    got = tables.read_lookup(spark, str(p))
    assert got.columns == ["Video_name", "Lane"] and [tuple(r) for r in got.collect()] == [("abc", "F"), (None, "B")]


def test_sessions(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"_note": {"fps": 1}, "one": {"fps": NaN}, "two": {"fps": 8.0}}')
    got = {r.session: r.config.fps for r in tables.read_sessions(spark, str(p), "struct<fps:double>").collect()}
    assert set(got) == {"one", "two"} and np.isnan(got["one"]) and got["two"] == 8.0


def test_sinks_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.123456, "a"), (2, 2.0, "b")], "k long, v double, lane string")
    out = str(tmp_path / "csv")
    tables.write_csv(df, out, 4)
    assert {r.v for r in spark.read.option("header", True).csv(out).collect()} == {"0.1235", "2.0000"}
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_csv(df, out)
    tables.write_csv(df, out, overwrite=True)
    by = str(tmp_path / "by")
    tables.write_by(df, by, ["lane"])
    assert spark.read.parquet(by).filter("lane = 'a'").count() == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x").write_text("1")
    then = spark.createDataFrame(tables.manifest(spark, str(tmp_path / "f")).toPandas())
    (tmp_path / "f/x").write_text("2")
    assert tables.changed(tables.manifest(spark, str(tmp_path / "f")), then).first().change == "changed"
    assert tables.pending(df, df.filter("k = 1"), ["k"]).first().k == 2


def _by(df, path):
    """What a folder holds by Spark: the directories, and the rows with their keys as text."""
    schema = df.select(*[F.col(c).cast("string").alias(c) if c in ("a", "b") else F.col(c) for c in df.columns]).schema
    got = df.sparkSession.read.schema(schema).parquet(path)
    return {p.parent.relative_to(path).as_posix() for p in Path(path).rglob("*.parquet")}, sorted(map(repr, got.select(*df.columns).collect()))


def test_directories_of_keys_are_those_of_spark(spark, tmp_path):
    names = [None, "", "x y", "a/b=c", "%41", "".join(map(chr, range(1, 128)))]
    rows = spark.range(600).select(
        F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 6 + 1).cast("int")).alias("a"),
        F.when(F.col("id") % 5 > 0, F.timestamp_seconds(F.col("id") % 5)).alias("b"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("n"),
        F.timestamp_millis("id").alias("t"),
        F.expr("timestamp_ntz'1500-01-01 00:00:00.000001'").alias("u"),
        F.expr("date'1500-03-01' + CAST(id AS INT)").alias("d"),
        F.expr("CAST(id / 3 AS DECIMAL(9, 4))").alias("k"),
        (F.col("id") % 100).cast("tinyint").alias("i"),
        F.when(F.col("id") % 2 > 0, F.lit("é")).alias("s"),
    )
    mine, spark_s = str(tmp_path / "mine"), str(tmp_path / "spark")
    tables.write_by(rows, f"file://{mine}", ["a", "b"])
    rows.write.partitionBy("a", "b").parquet(spark_s)
    assert _by(rows, mine) == _by(rows, spark_s) and len(_by(rows, mine)[0]) == 25
    assert spark.read.parquet(mine).schema == spark.read.parquet(spark_s).schema
    rest = ", ".join(f"{c} {k}" for c, k in rows.drop("a", "b").dtypes)
    for path in (mine, spark_s):
        back = tables.read_by(spark, path, rest, {"a": "string", "b": "timestamp"}).select(rows.columns)
        want = rows.withColumn("a", F.nullif("a", F.lit("")))
        assert back.dtypes == rows.dtypes and back.exceptAll(want).count() == want.exceptAll(back).count() == 0
    assert {p.name for p in tmp_path.iterdir()} == {"mine", "spark"} and (tmp_path / "mine/_SUCCESS").exists()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_by(rows, mine, ["a", "b"])
    tables.write_by(rows.limit(1), mine, ["a", "b"], overwrite=True)
    assert spark.read.parquet(mine).count() == 1


def test_a_directory_costs_no_processes(spark, tmp_path):
    """Hadoop starts a process for each change of permissions of a local file, three a directory."""
    forked = lambda: int(re.search(r"processes (\d+)", Path("/proc/stat").read_text())[1])  # noqa: E731  threads count too
    rows, path = spark.range(3000).select((F.col("id") % 1000).alias("lane"), "id"), str(tmp_path / "by")
    tables.write_by(rows.limit(1), str(tmp_path / "warm"), ["lane"])
    before = forked()
    tables.write_by(rows, path, ["lane"])
    assert forked() - before < 1000
    settings = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert sorted(r.id for r in tables.read_by(spark, path, "id long", {"lane": "long"}).filter("id % 1000 = lane").collect()) == list(range(3000))
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == settings


def test_rows_of_a_key_are_one_file_however_many(spark, tmp_path):
    rows, path = spark.range(50_000).select(F.lit(7).alias("lane"), "id", F.lit(None).cast("string").alias("none")), str(tmp_path / "by")
    tables.write_by(rows, path, ["lane"])
    assert [p.name for p in (tmp_path / "by").iterdir() if p.is_dir()] == ["lane=7"] and len(list((tmp_path / "by/lane=7").iterdir())) == 1
    assert spark.read.parquet(path).agg(F.sum("id"), F.count("none"), F.sum("lane")).first() == (sum(range(50_000)), 0, 350_000)


def test_a_write_by_keys_that_fails_leaves_nothing(spark, tmp_path):
    bad = spark.range(3000).select((F.col("id") % 50).alias("lane"), F.when(F.col("id") == 2999, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.write_by(bad, str(tmp_path / "by"), ["lane"])
    assert list(tmp_path.iterdir()) == []


def test_no_rows_by_keys_are_no_rows(spark, tmp_path):
    tables.write_by(spark.range(0).select("id", F.lit(1).alias("lane")), str(tmp_path / "by"), ["lane"])
    assert tables.read_by(spark, str(tmp_path / "by"), "id long", {"lane": "long"}).count() == 0


def test_what_arrow_does_not_write_is_left_to_spark(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lanes.link./out", f"file://{tmp_path}")
    tables.write_by(spark.range(9).select("id", (F.col("id") % 3).alias("lane")), "viewfs://lanes/out/by", ["lane"])
    assert spark.read.parquet(str(tmp_path / "by")).filter("id % 3 = lane").count() == 9
    tables.write_by(spark.range(9).select(F.struct("id").alias("s"), F.expr("id * INTERVAL '1' SECOND").alias("v"), (F.col("id") % 3).alias("lane")), str(tmp_path / "nested"), ["lane"])
    assert spark.read.parquet(str(tmp_path / "nested")).filter("s.id * INTERVAL '1' SECOND = v").count() == 9


def test_frames(spark, tmp_path):
    rng = np.random.default_rng(0)
    video = [rng.integers(0, 60000, (6, 9)) for _ in range(12)]
    (tmp_path / "v.seq").write_bytes(frames.encode(video[0], pad=64) + b"".join(map(frames.encode, video[1:])))
    frames.register(spark)
    load = lambda **o: spark.read.format("frames").options(framesPerPartition=5, **o).load(str(tmp_path / "v.seq"))
    got = load().orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(12)) and all(r.pixels == v.ravel().tolist() for r, v in zip(got, video, strict=True))
    assert [r.frame for r in load().filter("frame >= 3 AND frame < 6").orderBy("frame").collect()] == [3, 4, 5]
    assert [r.frame for r in load(every=4).orderBy("frame").collect()] == [0, 4, 8]
    assert load().rdd.getNumPartitions() == 3
    assert load().agg(F.max("height"), F.max("width")).first() == (6, 9)


PREDICATES = [("frame < 3", operator.lt, 3), ("frame <= 4", operator.le, 4), ("frame = 5", operator.eq, 5), ("frame = 2", operator.eq, 2), ("frame >= 2", operator.ge, 2), ("frame > 6", operator.gt, 6)]


def test_every_pair_of_frame_predicates(spark, tmp_path):
    (tmp_path / "v.seq").write_bytes(b"".join(frames.encode(np.full((2, 3), k)) for k in range(9)))
    frames.register(spark)
    for (a, f, x), (b, g, y) in itertools.product(PREDICATES, PREDICATES):
        got = spark.read.format("frames").option("framesPerPartition", 4).load(str(tmp_path / "v.seq")).filter(f"{a} AND {b}").select("frame").collect()
        assert sorted(r.frame for r in got) == [k for k in range(9) if f(k, x) and g(k, y)], (a, b)


def test_headers_are_read_without_pixels(spark, tmp_path):
    rng = np.random.default_rng(0)
    known = {"r1": 14000.5, "r2": 0.0125, "b": 1400.0, "f": 1.5, "o": -6000}
    video = [rng.integers(0, 60000, (240, 320)) for _ in range(20)]
    (tmp_path / "a.seq").write_bytes(frames.encode(video[0], pad=64, constants=known) + b"".join(frames.encode(v, constants=known) for v in video[1:]))
    (tmp_path / "b.seq").write_bytes(frames.encode(video[0]))
    (tmp_path / "c.seq").write_bytes(b"")
    (tmp_path / "d.seq").write_bytes(b"not a container")
    frames.register(spark)
    heads = spark.read.format("frame_headers").option("filesPerPartition", 1).load(str(tmp_path))
    got = {r.path[-5]: r for r in heads.collect()}
    assert heads.rdd.getNumPartitions() == 4
    assert {k: (r.frames, r.height, r.width) for k, r in got.items()} == {"a": (20, 240, 320), "b": (1, 240, 320), "c": (0, None, None), "d": (0, None, None)}
    assert [got["a"][k] for k in ("r1", "b", "f", "o")] == [14000.5, 1400.0, 1.5, -6000.0] and got["a"].r2 == pytest.approx(0.0125) and got["b"].r1 is None
    size = (tmp_path / "a.seq").stat().st_size
    assert max(r.bytes_read for r in got.values()) < 10_000 < size / 300
    pixels = spark.read.format("frames").load(str(tmp_path / "a.seq")).filter("frame = 7").first().pixels
    assert pixels == video[7].ravel().tolist()
    (tmp_path / "none").mkdir()
    assert spark.read.format("frame_headers").load(str(tmp_path / "none")).count() == 0


KIND = "struct<n:bigint,parts:array<struct<k:string,v:double>>>"


def test_reports_are_written_once(spark, tmp_path):
    path = str(tmp_path / "reports")
    doc = lambda rows: spark.createDataFrame([(s, n, [{"k": f"p{i}", "v": i / 2} for i in range(n)]) for s, n in rows], f"session string, {KIND[7:-1].replace('n:', 'n ').replace('parts:', 'parts ')}")
    read = lambda: {r.session: (r.report.n, [(p.k, p.v) for p in r.report.parts]) for r in tables.read_reports(spark, path, KIND).collect()}
    assert read() == {}
    assert sorted(r.session for r in tables.write_reports(doc([("a", 1), ("b c/d", 0)]), path).collect()) == ["a", "b c/d"]
    first = sorted(str(p) for p in (tmp_path / "reports").rglob("*.txt"))
    assert [r.session for r in tables.write_reports(doc([("a", 3), ("b c/d", 3), ("e", 2)]), path).collect()] == ["e"]  # only what is missing
    assert read() == {"a": (1, [("p0", 0.0)]), "b c/d": (0, []), "e": (2, [("p0", 0.0), ("p1", 0.5)])}
    assert set(first) <= {str(p) for p in (tmp_path / "reports").rglob("*.txt")}
    with pytest.raises(FileExistsError, match="session (a|e)"):
        tables.write_reports(doc([("a", 9), ("e", 9)]), path, again="refuse")
    with pytest.raises(ValueError, match="twice|occurs 2"):
        tables.write_reports(doc([("z", 1), ("z", 1)]), path)
    assert [r.session for r in tables.write_reports(doc([("a", 2)]), path, again="replace").collect()] == ["a"] and read()["a"][0] == 2
    assert tables.write_reports(doc([("a", 2)]), path).count() == 0


def test_a_run_that_fails_leaves_no_report(spark, tmp_path):
    path = str(tmp_path / "reports")
    good = spark.range(6).select(F.concat(F.lit("s"), "id").alias("session"), F.col("id").alias("n"))
    bad = good.withColumn("n", F.when(F.col("n") == 4, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        tables.write_reports(bad, path)
    assert tables.read_reports(spark, path, "struct<n:bigint>").count() == 0
    assert tables.write_reports(good, path).count() == 6
    assert sorted(r.report.n for r in tables.read_reports(spark, path, "struct<n:bigint>").collect()) == list(range(6))
