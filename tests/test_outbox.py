import random
from datetime import datetime, timedelta

import pytest

from townkit.streaming import outbox

SCHEMA = "family string, id string, at timestamp_ntz, done_at timestamp_ntz, reason string"
START = datetime(2024, 1, 1)


def rows_of(n, seed=4):
    r, out = random.Random(seed), []
    for i in range(n):
        at = START + timedelta(seconds=i * 67)
        done = None if r.random() < 0.001 else at + timedelta(minutes=r.randrange(0, 40))
        out.append((r.choice(["news", "news", "originals", "deals", None]), f"r{r.randrange(max(1, n // 25)):05d}" if r.random() < 0.5 else f"x{i:05d}", at, done, r.choice(["a reason that is long", "a reason that is long", "short    ", None])))
    seen = {}  # an id belongs to one family
    return [(seen.setdefault(i, f), i, at, done, why) for f, i, at, done, why in out]


def one_by_one(rows):
    table, out = [], {}
    for family, id_, at, done, reason in sorted(rows, key=lambda r: (r[2], r[1])):
        if family not in ("news", "originals") or not 10 <= len((reason or "").strip(" ")) <= 1000:
            out[(id_, at)] = "invalid"
        elif any(g[1] == id_ for g in table):
            out[(id_, at)] = "repeated"
        elif any(g[0] == family and (g[3] is None or g[3] > at) for g in table):
            out[(id_, at)] = "outstanding"
        elif any(g[0] == family and g[2] > at - timedelta(minutes=10) for g in table):
            out[(id_, at)] = "cooldown"
        else:
            table.append((family, id_, at, done))
            out[(id_, at)] = "granted"
    return out


@pytest.mark.parametrize("batch_rows", ["7", "10000"])
def test_batch_as_one_by_one(spark, batch_rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    rows = rows_of(600)
    found = {(r["id"], r["at"]): r["claim"] for r in outbox.claims(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == one_by_one(rows) and set(found.values()) == {"invalid", "repeated", "outstanding", "cooldown", "granted"}
    assert outbox.claims(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_refused_request_leaves_no_trace(spark):
    at = lambda m: START + timedelta(minutes=m)
    why = "a reason that is long"
    rows = [("news", "a", at(0), at(1), why), ("news", "b", at(5), None, why), ("news", "c", at(10), at(11), why), ("originals", "d", at(5), None, why), ("originals", "e", at(500), at(501), why), ("news", "a", at(60), None, why)]
    found = {(r["id"], r["at"]): r["claim"] for r in outbox.claims(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {("a", at(0)): "granted", ("b", at(5)): "cooldown", ("c", at(10)): "granted", ("d", at(5)): "granted", ("e", at(500)): "outstanding", ("a", at(60)): "repeated"}


def test_stream_as_one_by_one(spark, tmp_path):
    """Files batch by batch, stopped after the first ones and started again."""
    rows = rows_of(200, seed=9)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = outbox.claims_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    for n in range(3):
        part = rows[n * 70 : (n + 1) * 70]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n:
            run()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["id"], r["at"]): r["claim"] for r in found.collect()} == one_by_one(rows) and found.count() == len(rows)
