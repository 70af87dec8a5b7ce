"""The as-of join of streams gives what the batch join gives over the same rows, in any order of arrival within the watermark."""

import random

import pytest
from pyspark.sql import functions as F

from joinscout.operators.joins import asof_join
from joinscout.streaming import asof


def plain(rights, t, direction, limit):
    best = None
    for u, seq in rights:
        if direction == "backward" and u > t or direction == "forward" and u < t or limit is not None and abs(u - t) > limit:
            continue
        side = 0 if u <= t else 1
        rank = (abs(u - t), side, -seq if u < t or u == t and direction != "forward" else seq)
        if best is None or rank < best[0]:
            best = rank, (u, seq)
    return best and best[1]


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
def test_partner_and_what_is_spare(direction):
    rng = random.Random(1)
    for _ in range(300):
        rights = sorted((rng.randint(0, 30), i) for i in range(rng.randint(0, 12)))
        limit = rng.choice([None, 0, 3, 10])
        times = [u for u, _ in rights]
        t = rng.randint(0, 30)
        i = asof.partner(times, t, direction, limit)
        assert (rights[i] if i is not None else None) == plain(rights, t, direction, limit)
        mark, waiting = rng.randint(0, 30), rng.choice([None, rng.randint(0, 30)])
        gone = asof.spare(times, mark, waiting, direction, limit)
        for later in range(min(mark, waiting if waiting is not None else mark), 40):  # rows that may still ask get the same without what went
            j = asof.partner(times[gone:], later, direction, limit)
            assert (rights[gone:][j] if j is not None else None) == plain(rights, later, direction, limit)


@pytest.mark.parametrize(("direction", "tolerance"), [("backward", None), ("nearest", 40.0), ("forward", 60.0)])
def test_stream_is_the_batch(spark, tmp_path, direction, tolerance):
    spark.conf.set(*asof.PROVIDER)
    rng = random.Random(7)
    start = 1_700_000_000
    lefts = [(i, rng.choice(["a", "b", None]), start + rng.random() * 3600, f"l{i}") for i in range(80)]
    rights = [(1000 + i, rng.choice(["a", "b", None]), float(start + round(rng.random() * 3600)), rng.random()) for i in range(120)]
    rights += [(2000 + i, k, t, 0.5) for i, (_, k, t, _) in enumerate(rights[:20])]  # ties
    schema = {"left": "id long, k string, s double, name string", "right": "rid long, k string, s double, v double"}
    frames = {}
    for side, rows in (("left", lefts), ("right", rights)):
        # up to five minutes late, the rest in order
        arrival = sorted(rows, key=lambda r: r[2] + rng.random() * 290)
        for part in range(4):
            some = arrival[part * len(rows) // 4 : (part + 1) * len(rows) // 4]
            df = spark.createDataFrame(some, schema[side]).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / side))
        end = spark.createDataFrame([(-1, "end", float(start + 100_000), None)], schema[side]).withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
        frames[side] = spark.read.parquet(str(tmp_path / side))
        end.coalesce(1).write.mode("append").parquet(str(tmp_path / side))
    streams = {s: spark.readStream.schema(frames[s].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / s)) for s in frames}
    out = asof.stream_asof(streams["left"], streams["right"], "ts", "ts", ["k"], tolerance, direction, "rid")
    job = out.writeStream.outputMode("append").format("memory").queryName(f"asof_{direction}").option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    job.processAllAvailable()
    job.stop()
    got = spark.table(f"asof_{direction}").where("id >= 0")
    null_safe = {s: frames[s].where("id >= 0" if s == "left" else "rid >= 0").withColumn("k", F.coalesce("k", F.lit("none"))) for s in frames}
    want = asof_join(null_safe["left"], null_safe["right"], "ts", "ts", ["k"], tolerance, direction, "rid")
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((r.id, r.name, r.ts, r.rid, r.v, r["__right_ts"]) for r in df.select("id", "name", "ts", F.coalesce("rid", F.lit(-9)).alias("rid"), F.coalesce("v", F.lit(-9.0)).alias("v"), F.coalesce("__right_ts", F.lit("1970-01-01").cast("timestamp")).alias("__right_ts")).collect())
    assert rows(got) == rows(want) and len(rows(got)) == 80


def test_arguments(spark):
    df = spark.createDataFrame([(1, "a")], "x long, k string").withColumn("ts", F.current_timestamp())
    for bad in ({"by": []}, {"by": ["k"], "direction": "up"}, {"by": ["k"], "direction": "nearest"}):
        with pytest.raises(ValueError):
            asof.stream_asof(df, df, "ts", "ts", **bad)
