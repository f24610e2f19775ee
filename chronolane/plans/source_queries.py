"""Queries that write files and read them again, and streaming runs over stored tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolane.operators import columns
from chronolane.operators import images as I
from chronolane.operators import measure
from chronolane.plans.model_queries import GATE, GATE_SQL, PIX, WIDTH, frames, readings
from chronolane.plans.registry import LANE, ORACLE_SQL, SAMPLES, load, query, rounded, samples
from chronolane.plans.sequence_queries import BOUTS, GAP, LEAST, UNKNOWN_GAP, classified, staged
from chronolane.sources import frames as containers
from chronolane.sources import tables
from chronolane.sources.scratch import scratch
from chronolane.streaming import stateful

TRACK = T.StructType([T.StructField("video_file", T.StringType()), T.StructField("frame_number", T.LongType()), T.StructField("elapsed_time_sec", T.DoubleType()), T.StructField("mouse_centroid_x", T.DoubleType()), T.StructField("mouse_roi_valid", T.BooleanType()), T.StructField("qc_flag", T.StringType())])


def _tracking(spark, sf, deep=False):
    s = samples(spark, sf)
    rows = s.select(F.concat(F.lit("v"), "lane").alias("video_file"), F.col("frame").alias("frame_number"), F.col("t").alias("elapsed_time_sec"), F.when(F.col("ok"), F.col("x")).otherwise(F.lit(float("nan"))).alias("mouse_centroid_x"), F.col("ok").alias("mouse_roi_valid"))
    path = scratch(spark, "tracking")
    tables.write_csv(rows, f"{path}/deep/er" if deep else path)
    return tables.read_tracking(spark, path, TRACK, recursive=deep, glob="*.csv")


SCAN = f"WITH {SAMPLES} SELECT 'v' || CAST(lane AS VARCHAR) AS video_file, frame AS frame_number, CASE WHEN ok THEN x END AS mouse_centroid_x, ok AS mouse_roi_valid, CAST(NULL AS VARCHAR) AS qc_flag FROM s"


@query("scan_tracking_csv", SCAN)
def scan_tracking_csv(spark, sf):
    return _tracking(spark, sf).select("video_file", "frame_number", "mouse_centroid_x", "mouse_roi_valid", "qc_flag")


@query("scan_recursive_glob", SCAN)
def scan_recursive_glob(spark, sf):
    return _tracking(spark, sf, deep=True).select("video_file", "frame_number", "mouse_centroid_x", "mouse_roi_valid", "qc_flag")


@query("scan_projected_chunked", f"WITH {SAMPLES} SELECT frame AS frame_number FROM s WHERE lane = 7")
def scan_projected_chunked(spark, sf):
    return _tracking(spark, sf).filter("video_file = 'v7'").select("frame_number")


@query("scan_lut_csv", "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS lane FROM nation")
def scan_lut_csv(spark, sf):
    path = scratch(spark, "lut")
    raw = load(spark, sf, "nation").select(F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("﻿name "), F.col("n_nationkey").cast("string").alias(" lane"))
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_lookup(spark, path)


@query("scan_json_config", "SELECT n_name AS session, CAST(n_nationkey AS DOUBLE) AS fps, isnan(x) AS unknown FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN CAST('nan' AS DOUBLE) ELSE 1.0 END AS x FROM nation)")
def scan_json_config(spark, sf):
    path = scratch(spark, "sessions")
    one = F.concat(F.lit('"'), "n_name", F.lit('": {"fps": '), F.col("n_nationkey").cast("string"), F.lit(', "offset": '), F.when(F.col("n_nationkey") % 2 == 0, "NaN").otherwise("1.0"), F.lit("}"))
    doc = load(spark, sf, "nation").agg(F.concat(F.lit('{"_note": {"fps": 0}, '), F.array_join(F.collect_list(one), ", "), F.lit("}")).alias("value"))
    doc.write.text(path)
    found = tables.read_sessions(spark, path, "struct<fps:double,offset:double>")
    return found.select("session", "config.fps", F.isnan("config.offset").alias("unknown"))


@query("scan_states_cache", f"WITH {SAMPLES} SELECT state, count(*) AS n FROM s GROUP BY state")
def scan_states_cache(spark, sf):
    path = scratch(spark, "states")
    samples(spark, sf).select("lane", "frame", "state").write.parquet(path)
    return spark.read.parquet(path).groupBy("state").agg(F.count("*").alias("n"))


def _containers(spark, sf):
    """One container per label, an embedding being an 8-pixel-wide frame of 16-bit counts."""
    path = scratch(spark, "containers")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        system.create_dir(root, recursive=True)
        video = [np.clip(np.floor(np.array(p) * 1000 + 30000), 0, 65535).astype(np.uint16).reshape(-1, WIDTH) for p in pdf.sort_values("vec_id")["pixels"]]
        label = int(pdf["label"].iloc[0])
        with system.open_output_stream(f"{root}/{label}.seq") as out:
            out.write(b"".join(containers.encode(v, constants=_constants(label)) for v in video))
        return pd.DataFrame({"n": [len(video)]})

    frames(spark, sf).groupBy("label").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    containers.register(spark)
    return path


def _labelled(df):
    return df.withColumn("label", F.regexp_extract("path", r"(\d+)[.]seq$", 1).cast("int"))


def _frames(spark, path):
    return _labelled(spark.read.format("frames").option("framesPerPartition", 64).load(path))


def _constants(label):
    """The constants that the cameras of even labels write into their files."""
    return None if label % 2 else {"r1": 21106.77 + label, "r2": 0.012545258, "b": 1501.0, "f": 1.0, "o": -7340 - label}


SEQ = f"{PIX}, q AS (SELECT label, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(floor(value * 1000 + 30000) AS BIGINT) AS p FROM px)"


@query("scan_seq_binary", f"WITH {SEQ} SELECT label, frame, CAST(sum(p) AS BIGINT) AS total FROM q GROUP BY 1, 2")
def scan_seq_binary(spark, sf):
    return _frames(spark, _containers(spark, sf)).select("label", "frame", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("seq_count_frames", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def seq_count_frames(spark, sf):
    """Counted from the heads of the files; no pixel is read."""
    found = spark.read.format("frame_headers").load(_containers(spark, sf))
    return _labelled(found).select("label", F.col("frames").alias("n"))


CAMERA = "c AS (SELECT DISTINCT label, CASE WHEN label % 2 = 0 THEN CAST(CAST(21106.77 + label AS FLOAT) AS DOUBLE) END AS r1, CASE WHEN label % 2 = 0 THEN CAST(CAST(0.012545258 AS FLOAT) AS DOUBLE) END AS r2, CASE WHEN label % 2 = 0 THEN 1501.0 END AS b, CASE WHEN label % 2 = 0 THEN 1.0 END AS f, CASE WHEN label % 2 = 0 THEN -7340.0 - label END AS o FROM embeddings)"


@query("seq_planck_constants", f"WITH {CAMERA} SELECT label, round(r1, 6) AS r1, round(r2, 12) AS r2, CAST(b AS DOUBLE) AS b, CAST(f AS DOUBLE) AS f, CAST(o AS DOUBLE) AS o FROM c")
def seq_planck_constants(spark, sf):
    """Five constants a file, NULL where a camera wrote none."""
    found = _labelled(spark.read.format("frame_headers").load(_containers(spark, sf)))
    return found.select("label", F.round("r1", 6).alias("r1"), F.round("r2", 12).alias("r2"), "b", "f", "o")


@query("p_planck_celsius_by_file", f"WITH {SEQ}, {CAMERA}, d AS (SELECT q.label, q.frame, CASE WHEN r1 IS NULL THEN p * 0.04 - 273.15 ELSE b / ln(r1 / (r2 * (p + o)) + f) - 273.15 END AS t FROM q JOIN c ON q.label = c.label) SELECT label, frame, round(avg(t), 6) AS celsius FROM d GROUP BY 1, 2")
def p_planck_celsius_by_file(spark, sf):
    """Each frame's mean temperature, by the constants of its own file."""
    path = _containers(spark, sf)
    camera = spark.read.format("frame_headers").load(path).select("path", "r1", "r2", "b", "f", "o")
    celsius = columns.planck_celsius(F.col("p"), *[F.col(c) for c in ("r1", "r2", "b", "f", "o")])
    pixel = _frames(spark, path).join(camera, "path").select("label", "frame", F.explode("pixels").alias("p"), "r1", "r2", "b", "f", "o")
    return rounded(pixel.groupBy("label", "frame").agg(F.avg(celsius).alias("celsius")))


@query("seq_random_access", f"WITH {SEQ} SELECT label, frame, CAST(sum(p) AS BIGINT) AS total FROM q WHERE frame >= 3 AND frame < 6 GROUP BY 1, 2")
def seq_random_access(spark, sf):
    some = _frames(spark, _containers(spark, sf)).filter("frame >= 3 AND frame < 6")
    return some.select("label", "frame", F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("i_warp_mask", f"WITH {PIX}, m AS (SELECT vec_id, px + 2 AS px, py + 1 AS py FROM px WHERE value > 0.05) SELECT px.vec_id, round(CASE WHEN count(*) >= 3 THEN quantile_cont(value, 0.95) END, 6) AS warm, count(*) AS n FROM px JOIN m ON px.vec_id = m.vec_id AND px.px = m.px AND px.py = m.py GROUP BY px.vec_id")
def i_warp_mask(spark, sf):
    """Each frame's own mask carried into another view by a map, where the warm spot under it is measured."""

    def warp(batches):
        for pdf in batches:
            masks = [measure.warp_mask(np.array(p).reshape(-1, WIDTH) > 0.05, measure.translation(2, 1), (len(p) // WIDTH, WIDTH)) for p in pdf["pixels"]]
            yield pdf[["vec_id", "pixels"]].assign(mask=[m.ravel() for m in masks])

    moved = frames(spark, sf).select("vec_id", "pixels").mapInPandas(warp, "vec_id long, pixels array<double>, mask array<boolean>")
    under = moved.select("vec_id", F.explode(F.arrays_zip("pixels", "mask")).alias("p")).filter("p.mask").select("vec_id", F.col("p.pixels").alias("value"))
    return rounded(under.groupBy("vec_id").agg(I.guarded(F.col("value"), 3, "p95").alias("warm"), F.count("*").alias("n")))


@query("sink_csv", f"WITH {SAMPLES} SELECT frame, round(x, 1) AS x FROM s")
def sink_csv(spark, sf):
    path = scratch(spark, "csv")
    tables.write_csv(samples(spark, sf).select("frame", "x"), path, 4)
    return rounded(spark.read.option("header", True).schema("frame long, x double").csv(path), 1)


@query("sink_overwrite_guard", "SELECT count(*) AS n, true AS refused FROM region")
def sink_overwrite_guard(spark, sf):
    """A second write is refused and changes nothing, until it is told to replace."""
    path, rows = scratch(spark, "guard"), load(spark, sf, "region")
    tables.write_csv(rows, path)
    try:
        tables.write_csv(rows.limit(0), path)
        refused = False
    except AnalysisException as e:
        refused = e.getCondition() == "PATH_ALREADY_EXISTS"
    kept = spark.read.option("header", True).csv(path).count() == rows.count()
    tables.write_csv(rows, path, overwrite=True)
    return spark.read.option("header", True).csv(path).agg(F.count("*").alias("n"), F.lit(refused and kept).alias("refused"))


REPORT = "struct<region:string,customers:bigint,segments:array<struct<segment:string,n:bigint,balance:double>>>"


def _reports(spark, sf):
    """A document per nation: its region, its customers, and a list of their segments."""
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation").join(load(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    each = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").cast("double").alias("balance"))
    held = each.groupBy("c_nationkey").agg(F.sum("n").alias("customers"), F.sort_array(F.collect_list(F.struct(F.col("c_mktsegment").alias("segment"), "n", "balance"))).alias("segments"))
    return n.join(held, n["n_nationkey"] == held["c_nationkey"]).select(F.col("n_name").alias("session"), F.col("r_name").alias("region"), "customers", "segments")


@query("sink_json_report", """SELECT n_name AS session, r_name AS region, CAST(sum(count(*)) OVER (PARTITION BY n_name) AS BIGINT) AS customers, c_mktsegment AS segment, count(*) AS n, round(CAST(sum(c_acctbal) AS DOUBLE), 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name, c_mktsegment""")
def sink_json_report(spark, sf):
    """Nested documents written by two runs, of which the second finds some sessions finished; read back and opened."""
    path, docs = scratch(spark, "reports"), _reports(spark, sf)
    tables.write_reports(docs.filter("region = 'ASIA'"), path)
    tables.write_reports(docs, path)
    rows = tables.read_reports(spark, path, REPORT).select("session", "report.region", "report.customers", F.explode("report.segments").alias("s"))
    return rounded(rows.select("session", "region", "customers", "s.segment", "s.n", "s.balance"), 2)


@query("sink_skip_existing", "SELECT n_name AS session FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def sink_skip_existing(spark, sf):
    """What a run writes where the sessions of one region are finished."""
    path, docs = scratch(spark, "reports"), _reports(spark, sf)
    tables.write_reports(docs.filter("region = 'ASIA'"), path)
    return tables.write_reports(docs, path).select("session")


@query("sink_partition_by_lane", f"WITH {SAMPLES} SELECT lane, count(*) AS n FROM s GROUP BY lane")
def sink_partition_by_lane(spark, sf):
    path = scratch(spark, "lanes")
    tables.write_by(samples(spark, sf).select("lane", "frame"), path, LANE)
    return tables.read_by(spark, path, "frame long", {"lane": "long"}).groupBy("lane").agg(F.count("*").alias("n"))


@query("sink_manifest_sha256", "SELECT change, count(*) AS n FROM (SELECT CASE n_regionkey WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' WHEN 2 THEN 'added' END AS change FROM (SELECT DISTINCT n_regionkey FROM nation)) WHERE change IS NOT NULL GROUP BY change")
def sink_manifest_sha256(spark, sf):
    """A folder per region, known by a manifest; then one is removed, one changed and one added."""
    path, kept, nation = scratch(spark, "manifest"), scratch(spark, "known"), load(spark, sf, "nation")
    put = lambda key, rows: tables.write_csv(rows.orderBy("n_nationkey").coalesce(1), f"{path}/{key}", overwrite=True)  # noqa: E731  at most 25 rows
    for key in (0, 1, 3, 4):
        put(key, nation.filter(F.col("n_regionkey") == key))
    manifest = lambda: tables.manifest(spark, path, "*.csv").select(F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).alias("path"), "sha256")
    manifest().write.parquet(kept)
    put(1, nation.filter("n_regionkey = 1").limit(2))
    put(2, nation.filter("n_regionkey = 2"))
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/0")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return tables.changed(manifest(), spark.read.parquet(kept)).groupBy("change").agg(F.count("*").alias("n"))


# --- streaming over a stored table, run until all of it is read ---------------------------------------


def _source(spark, rows):
    path = scratch(spark, "stream")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _streamed(spark, rows, machine, columns):
    """What a machine finds in a stream of a table's files, and in what is open when the stream has ended."""
    out = scratch(spark, "streamed")
    made = stateful.run(_source(spark, rows), "lane", "t", "frame", columns, machine)
    stateful.start(made, out, f"{out}-log").awaitTermination()
    return spark.read.schema(made.schema).parquet(out).unionByName(stateful.finish(spark, f"{out}-log", machine))


@query("stream_temp_gate", GATE_SQL.replace("SELECT lane, frame, round", "SELECT lane, frame AS id, round"))
def stream_temp_gate(spark, sf):
    rows = readings(spark, sf).filter("core IS NOT NULL").select("lane", "t", "frame", "core", "body")
    return rounded(_streamed(spark, rows, stateful.GateMachine(GATE), ["core", "body"]))


@query("stream_entries", f"SELECT lane, entry FROM ({ORACLE_SQL['w_entry_state_machine']}) WHERE entry IS NOT NULL")
def stream_entries(spark, sf):
    return _streamed(spark, staged(spark, sf).select("lane", "t", "frame", "st"), stateful.EntryMachine(3, 3), ["st"])


@query("stream_bouts", f"""WITH {BOUTS} SELECT lane, round(bout_start_sec, 6) AS start, round(bout_end_sec, 6) AS "end" FROM bouts""")
def stream_bouts(spark, sf):
    rows = classified(spark, sf).select("lane", "t", "frame", "frame_state")
    return rounded(_streamed(spark, rows, stateful.BoutMachine(LEAST, GAP, UNKNOWN_GAP, silence=False), ["frame_state"]))


@query("stream_activity", "SELECT date_trunc('day', ts) AS start, user_id AS lane, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_activity(spark, sf):
    """Daily windows as they stand when the stream has ended."""
    rows = samples(spark, sf).select("lane", "x", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"))
    out = scratch(spark, "activity")
    found = stateful.latest(stateful.activity(_source(spark, rows), "ts", "x", ["lane"]), ["start", "lane"], out, f"{out}-log")
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")))
