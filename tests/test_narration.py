"""Started, progressed, finished and timed-out operations: a stream says what the batch says."""

import random

from pyspark.sql import functions as F

from sieveline.streaming import narrate

SCHEMA = "op string, what string, at timestamp, n long"
KINDS = {"go": narrate.STARTED, "on": narrate.PROGRESSED, "end": narrate.FINISHED}


def events(spark, rows):
    df = spark.createDataFrame([(op, what, s, i) for i, (op, what, s) in enumerate(rows)], "op string, what string, s double, n long")
    return narrate.narration_events(df.withColumn("at", F.timestamp_seconds("s")), "op", "what", "at", "n", KINDS)


def told(df):
    return sorted((r.key, r.at_us / 1e6, r.state, r.n_progress, r.elapsed_us / 1e6) for r in df.collect())


def brute(rows, timeout, until):
    out, now = [], {}
    for op, what, s in sorted(rows, key=lambda r: r[2]):
        if op in now and s - now[op][1] > timeout:
            began, last, n = now.pop(op)
            out.append((op, last + timeout, "timed out", n, last + timeout - began))
        if what == "go":
            now[op] = (s, s, 0)
            out.append((op, s, "started", 0, 0.0))
        elif op in now and what == "on":
            now[op] = (now[op][0], s, now[op][2] + 1)
            out.append((op, s, "progressed", now[op][2], s - now[op][0]))
        elif op in now and what == "end":
            began, _, n = now.pop(op)
            out.append((op, s, "finished", n, s - began))
    return sorted(out + [(op, last + timeout, "timed out", n, last + timeout - began) for op, (began, last, n) in now.items() if last + timeout < until])


def drawn(seed, n=300, ops=12):
    r, at, out = random.Random(seed), 1000.0, []
    for _ in range(n):
        at += r.choice([0.5, 1.0, 4.0])
        out.append((f"op{r.randrange(ops)}", r.choice(["go", "on", "on", "end", "other"]), at))
    return out


def test_batch_is_the_state_machine(spark):
    for seed in (1, 2):
        rows = drawn(seed)
        got = told(narrate.narrated_batch(events(spark, rows), 30.0))
        assert got == brute([r for r in rows if r[1] != "other"], 30.0, max(r[2] for r in rows if r[1] != "other"))
    assert told(narrate.narrated_batch(events(spark, [("a", "on", 1.0), ("a", "end", 2.0)]), 5.0)) == []
    assert told(narrate.narrated_batch(events(spark, [("a", "go", 1.0)]).filter(F.lit(False)), 5.0)) == []


def test_stream_says_what_the_batch_says(spark, tmp_path):
    """Events in five batches, in order of time, and one far behind them that ends all waiting."""
    rows = drawn(3) + [("last", "go", 99_999.0)]
    e = events(spark, rows).orderBy("at_us").coalesce(1)
    kept = [r for r in rows if r[1] != "other"]
    cut = [kept[int(len(kept) * i / 5)][2] for i in range(5)] + [1e9]
    for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        e.filter((F.col("at_us") >= int(a * 1e6)) & (F.col("at_us") < int(b * 1e6))).write.parquet(f"{tmp_path}/in/{i}")
        for f in (tmp_path / "in" / str(i)).glob("part-*"):
            f.rename(tmp_path / f"events-{i}.parquet")
    (tmp_path / "all").mkdir()
    import os

    for i in range(5):
        os.rename(tmp_path / f"events-{i}.parquet", tmp_path / "all" / f"{i}.parquet")
        os.utime(tmp_path / "all" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        q = narrate.narrate(narrate.narrated_files(spark, str(tmp_path / "all"), e.schema, 1), str(tmp_path / "out"), str(tmp_path / "check"), 30.0)
        assert q.awaitTermination(240)
        assert len(q.recentProgress) >= 5
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = told(spark.read.schema(narrate.ROWS).parquet(str(tmp_path / "out")))
    assert got == told(narrate.narrated_batch(e, 30.0)) and any(r[2] == "timed out" for r in got)
