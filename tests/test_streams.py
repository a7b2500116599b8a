"""Folds over streams that are cut and mixed at random, against batches and plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fitforge.operators import activity
from fitforge.streaming import folds, ordered

BEGIN = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, failed boolean, tokens long"


def events(n=300, seed=1):
    r = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += r.choice([0, 0, 1, 5, 30, 61, 600])  # some at one moment
        rows.append((i, r.choice([1, 2, 3]), BEGIN + datetime.timedelta(seconds=at, microseconds=r.choice([0, 250_000])), r.random() < 0.5, r.choice([None, 1, 40, 90, 200])))
    return rows


def streamed(spark, tmp_path, rows, fold, seed=2, mixed_seconds=500):
    """Results of the fold over files that hold the rows in random cuts, nowhere later than the watermark allows."""
    r = random.Random(seed)
    shuffled = sorted(rows, key=lambda x: x[2] + datetime.timedelta(seconds=r.uniform(0, mixed_seconds)))
    end = (10**6, 99, BEGIN + datetime.timedelta(days=30), False, 0)  # moves the watermark past all others
    files, at = [], 0
    while at < len(shuffled):
        n = r.randint(1, 120)
        files.append(shuffled[at : at + n])
        at += n
    for i, part in enumerate([*files, [end], [(*end[:2], end[2] + datetime.timedelta(days=1), *end[3:])]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={i:03d}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = (
        ordered.in_order(source, "user_id", "ts", fold)
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    )
    query.awaitTermination(600)
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("user_id <> 99").collect()))


FOLDS = {
    "limit": folds.trailing_limit(3, 600),
    "failures": folds.failure_counter("failed", "event_id"),
    "paced": folds.paced("tokens", "event_id", 3, 150),
}


@pytest.mark.parametrize("name", FOLDS)
def test_streams_equal_batches(spark, tmp_path, name):
    rows = events()
    batch = ordered.in_order(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", FOLDS[name])
    assert streamed(spark, tmp_path, rows, FOLDS[name]) == sorted(map(tuple, batch.collect()))


def test_folds_equal_windows(spark):
    table = spark.createDataFrame(events(), SCHEMA)
    limited = activity.rate_limit(table, "user_id", "ts", 3, 600)
    assert sorted(map(tuple, ordered.in_order(table, "user_id", "ts", FOLDS["limit"]).collect())) == sorted(map(tuple, limited.collect()))
    runs = activity.failure_runs(table, "user_id", ["ts", "event_id"], F.col("failed"))
    found = ordered.in_order(table, "user_id", "ts", FOLDS["failures"])
    assert sorted(map(tuple, found.drop("active").collect())) == sorted(map(tuple, runs.collect()))
    last = {r["user_id"]: r["active"] for r in activity.deactivations(table, "user_id", ["ts", "event_id"], F.col("failed")).collect()}
    assert {r["user_id"]: r["active"] for r in found.orderBy("ts", "event_id").collect()} == last


def test_late_rows_have_no_part(spark, tmp_path):
    on_time = [(i, 1, BEGIN + datetime.timedelta(minutes=i), True, 1) for i in range(60)]
    late = (1000, 1, BEGIN, False, 1)
    spark.createDataFrame(on_time[:30], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/part=0"))
    spark.createDataFrame(on_time[30:31], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/part=1"))
    spark.createDataFrame([late, *on_time[31:]], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in/part=2"))
    for i in (3, 4):
        spark.createDataFrame([(2000 + i, 2, BEGIN + datetime.timedelta(days=i), True, 1)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ordered.in_order(source, "user_id", "ts", FOLDS["failures"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(600)
    found = spark.read.parquet(str(tmp_path / "out")).where("user_id = 1").collect()
    assert {r["event_id"]: r["failures"] for r in found} == {i: i + 1 for i in range(60)}


def test_a_client_that_sends_too_much_waits(spark):
    rows = [(i, 1, BEGIN, None, t) for i, t in enumerate([100, 50, 500, 1, 1, 1, 1])] + [(7, None, BEGIN, None, 1), (8, 1, None, None, 1)]
    found = ordered.in_order(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", FOLDS["paced"]).orderBy("event_id").collect()
    start = int(BEGIN.replace(tzinfo=datetime.UTC).timestamp())
    # the large one goes out alone; then three small ones, and one when these are a minute old
    assert [(r["sent"] // 1_000_000) - start for r in found] == [0, 0, 60, 120, 120, 120, 180]


def test_requests_go_out_as_early_as_the_limits_allow(spark):
    from fitforge.plans import ingestion  # noqa: F401 - registers its queries
    from fitforge.plans.queries import QUERIES

    span, most, budget = 3600 * 1_000_000, 3, 150
    data = "/root/testdata/sf0.001"
    arrived = {r["event_id"]: int(r["ts"].replace(tzinfo=datetime.UTC).timestamp() * 1_000_000 + 0.5) for r in spark.read.parquet(f"{data}/events.parquet").collect()}
    by_user: dict = {}
    for r in QUERIES["win10_paced_requests"](spark, data).collect():
        by_user.setdefault(r["user_id"], []).append((arrived[r["event_id"]], r["event_id"], r["sent"], r["tokens"]))
    assert sum(map(len, by_user.values())) == len(arrived)
    waited = 0
    for rows in by_user.values():
        rows.sort()
        before: list = []
        for at, _, sent, tokens in rows:
            earliest = max(at, before[-1][0] if before else at)

            def fits(now, tokens=tokens, before=before):
                inside = [x for x in before if now - x[0] < span]
                return not inside or (len(inside) < most and sum(x[1] for x in inside) + tokens <= budget)

            assert sent >= earliest and fits(sent)
            # what is in the way goes when one of those sent before is old enough, and not before
            chances = sorted({earliest} | {x[0] + span for x in before if x[0] + span >= earliest})
            first = next(c for c in chances if fits(c))
            assert first <= sent <= first + 100_000 * len(before)
            waited += sent > at
            before.append((sent, tokens))
    assert waited > 10
