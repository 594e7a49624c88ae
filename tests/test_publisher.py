"""A log in micro-batches against the batch operators: held deletes, stops that last, releases, restarts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cdcflow.operators import events, guards
from cdcflow.streaming.publisher import LogPublisher

ROW = "struct<id:bigint,name:string>"
LOG = f"raw_topic string, offset long, op string, before {ROW}, after {ROW}, db string, tbl string, ts_ms long"
WANTED = ["raw_topic", "seq", "sub", "op", "key", "before", "data", "event_ms"]
_n = itertools.count()


def publisher(spark, tmp_path, **more):
    return LogPublisher(spark, f"file://{tmp_path}/p{next(_n)}", spark.createDataFrame([], LOG).schema, ["id"], **more)


def a_log(topics=("t", "u"), n=60, seed=1, bad=()):
    rng, out = random.Random(seed), []
    for topic in topics:
        for i in range(n):
            k = rng.randint(1, 3)
            op = rng.choice("cuddcr") if i % 7 else None
            before = (k, f"b{i}") if op in ("u", "d") else None
            after = (rng.choice((k, k, 9)), f"a{i}") if op in ("c", "u", "r") else None
            if op == "c" and out and out[-1][2] == "d" and rng.random() < 0.7:
                after = (out[-1][3][0], f"a{i}")
            out.append((topic, 2 * i, op, before, after, " " if (topic, i) in bad else "db", "tbl", 1000 + i))
    return out


def got(df):
    return sorted(map(str, df.select(WANTED).collect()))


def whole(spark, log):
    return events.normalize(spark.createDataFrame(log, LOG), ["id"], by_offset=True)


def in_batches(log, size):
    """Cut each topic's records alike."""
    by_topic = {}
    for r in log:
        by_topic.setdefault(r[0], []).append(r)
    longest = max(map(len, by_topic.values()))
    return [[r for rs in by_topic.values() for r in rs[i : i + size]] for i in range(0, longest, size)]


@pytest.mark.parametrize("size", [1, 7, 60])
def test_batches_publish_what_the_whole_log_does(spark, tmp_path, size):
    log = a_log(n={1: 5, 7: 28, 60: 60}[size])
    p = publisher(spark, tmp_path)
    for i, batch in enumerate(in_batches(log, size)):
        assert p.run(spark.createDataFrame(batch, LOG), i)
        p = LogPublisher(spark, p.root, p.log_schema, ["id"])  # a restart
    p.flush()
    assert got(p.published()) == got(whole(spark, log))
    assert p.stopped().count() == 0 and p.held().count() == 0


def test_a_stop_lasts_over_batches_and_restarts(spark, tmp_path):
    log = a_log(bad={("t", 33)})
    if log[33][2] is None:
        log[33] = ("t", 66, "c", None, (1, "x"), " ", "tbl", 5)
    goes, held = guards.publish_prefix(whole(spark, log))
    p = publisher(spark, tmp_path)
    for i, batch in enumerate(in_batches(log, 20)):
        p.run(spark.createDataFrame(batch, LOG), i)
        p.run(spark.createDataFrame(batch, LOG), i)  # comes again
        p = LogPublisher(spark, p.root, p.log_schema, ["id"])
    p.flush()
    assert got(p.published()) == got(goes) and got(p.held()) == got(held) and held.count() > 5
    (stop,) = p.stopped().collect()
    assert (stop["owner"], stop["seq"], stop["reason"]) == ("t", 66, "missing source")
    p.release("t")  # what is wrong with the record is still wrong: it stops there again, and nothing is lost or comes twice
    p.flush()
    assert got(p.published()) == got(goes) and got(p.held()) == got(held) and p.stopped().count() == 1


def test_a_release_goes_on_from_the_stop(spark, tmp_path):
    limit = [10]

    def guard(df):
        return df.withColumn("guard_reason", F.when(F.length("data.name") >= limit[0], "too large"))

    log = [("t", i, "c", None, (i, "n" * (20 if i == 4 else 3)), "db", "tbl", 1) for i in range(10)] + [("u", 0, "c", None, (0, "n"), "db", "tbl", 1)]
    p = publisher(spark, tmp_path, guard=guard)
    for i, batch in enumerate(in_batches(log, 3)):
        p.run(spark.createDataFrame(batch, LOG), i)
    assert [r["seq"] for r in p.published().where("raw_topic = 't'").orderBy("seq").collect()] == [0, 1, 2, 3]
    assert [(r["seq"], r["reason"]) for r in p.stopped().collect()] == [(4, "too large")] and p.held().count() == 6
    limit[0] = 99
    p.flush()
    assert p.published().count() == 5  # only a release asks again
    p.release("t")
    p.run(spark.createDataFrame([("t", 10, "c", None, (10, "n"), "db", "tbl", 1)], LOG), 77)
    assert [r["seq"] for r in p.published().where("raw_topic = 't'").orderBy("seq").collect()] == list(range(11))
    assert p.stopped().count() == 0 and p.held().count() == 0 and p.state().count() == 1
    limit[0] = 2
    p.run(spark.createDataFrame([("t", 11, "c", None, (11, "nnn"), "db", "tbl", 1), ("t", 12, "c", None, (12, "n"), "db", "tbl", 1)], LOG), 78)
    assert p.published().count() == 12 and [r["seq"] for r in p.held().orderBy("seq").collect()] == [11, 12]


def test_a_delete_waits_only_while_its_topic_goes_on(spark, tmp_path):
    d, c = ("t", 0, "d", (1, "a"), None, "db", "tbl", 5), ("t", 1, "c", None, (1, "b"), "db", "tbl", 9)
    p = publisher(spark, tmp_path)
    p.run(spark.createDataFrame([d, ("u", 0, "d", (3, "z"), None, "db", "tbl", 1)], LOG), 0)
    assert p.published().count() == 0
    p.run(spark.createDataFrame([c], LOG), 1)
    out = {r["raw_topic"]: r for r in p.published().collect()}
    assert (out["t"]["op"], out["t"]["event_ms"], out["t"]["before"]["name"]) == ("UPDATE", 9, "a") and out["u"]["op"] == "DELETE"
    q = publisher(spark, tmp_path)
    q.run(spark.createDataFrame([d], LOG), 0)
    q.flush()
    q.run(spark.createDataFrame([c], LOG), 1)
    assert [r["op"] for r in q.published().orderBy("seq").collect()] == ["DELETE", "INSERT"]


def test_a_batch_that_fails_midway_leaves_one_effect(spark, tmp_path, monkeypatch):
    log = a_log(topics=("t",), n=24)
    batches = in_batches(log, 8)
    p = publisher(spark, tmp_path)
    p.run(spark.createDataFrame(batches[0], LOG), 0)
    monkeypatch.setattr(LogPublisher, "_finish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        p.run(spark.createDataFrame(batches[1], LOG), 1)
    monkeypatch.undo()
    assert p.published().count() < len(log)
    for i in (1, 2):
        assert p.run(spark.createDataFrame(batches[i], LOG), i)
    p.flush()
    assert got(p.published()) == got(whole(spark, log))


def test_a_query_restarts_from_its_checkpoint(spark, tmp_path):
    log = a_log(bad={("u", 30)}, n=42)
    p = publisher(spark, tmp_path)
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/raw")
    for batch in in_batches(log, 14):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/raw")
        p = LogPublisher(spark, p.root, p.log_schema, ["id"])
        p.start(stream(), f"file://{tmp_path}/check").awaitTermination()
    p.flush()
    goes, _ = guards.publish_prefix(whole(spark, log))
    assert got(p.published()) == got(goes)
