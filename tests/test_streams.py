"""Streams over several batches whose files are out of time order."""

import datetime

import pytest

from tickweave.streaming import streams

START = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path):
    """Six files of a day each, read newest first, with one event repeated in the last file."""
    for n, day in enumerate((5, 1, 4, 0, 3, 2)):
        at = [(day * 24 + h) for h in range(0, 24, 3)]
        rows = [(day * 100 + i, START + datetime.timedelta(hours=h), i % 2, "a", 1.0, "") for i, h in enumerate(at)]
        if n == 5:
            rows.append((500, START + datetime.timedelta(days=5), 0, "a", 1.0, ""))
        spark.createDataFrame(rows, streams.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_dedupe_over_batches(spark, folder):
    out = streams.run_once(streams.deduplicated(streams.event_stream(spark, folder, 1), ["event_id"]), spark, "append")
    assert sorted(r.event_id for r in out.collect()) == [d * 100 + i for d in range(6) for i in range(8)]


def test_sessions_over_batches(spark, folder):
    got = {n: streams.run_once(streams.sessions(streams.event_stream(spark, folder, n), "7 hours"), spark) for n in (1, 64)}
    rows = {n: sorted(map(tuple, df.collect())) for n, df in got.items()}
    assert rows[1] == rows[64] and sum(r[3] for r in rows[1]) == 49 and len(rows[1]) == 2


def test_panel_over_batches(spark, folder):
    got = streams.run_once(streams.minute_panel(streams.event_stream(spark, folder, 1)), spark)
    assert sum(r.n_trades for r in got.collect()) == 49


@pytest.mark.parametrize("files", [1, 64])
def test_update_mode_keeps_the_last_state_of_each_window(spark, folder, files):
    """Panels and sliding windows by keys, however the files fall into batches."""
    events = streams.event_stream(spark, folder, files)
    panel = streams.run_once(streams.minute_panel(events, "1 day"), spark, keys=["market", "bucket"]).collect()
    assert sorted(r.n_trades for r in panel) == [8, 8, 8, 8, 8, 9] and len({r.bucket for r in panel}) == 6
    slides = streams.run_once(streams.sliding(events, "2 days", "1 day"), spark, keys=["market", "bucket"]).collect()
    assert len(slides) == 7 and sum(r.n_trades for r in slides) == 98


ACTIONS = "market string, wallet bigint, sec bigint, action string, direction int, gross double"


def sequenced(spark, folder, files, gap, late):
    from pyspark.sql import functions as F

    from tickweave.streaming import sequences

    for rows in [*files, [(None, None, 10**6, "", 0, 0.0)], [(None, None, 10**6 + 1, "", 0, 0.0)]]:
        spark.createDataFrame(rows, ACTIONS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("at", F.timestamp_seconds("sec"))
    out = streams.run_once(sequences.sequences(stream, gap, f"{late} seconds"), spark, "append", settings=dict([sequences.PROVIDER]))
    return sorted((r.market, r.wallet, r.sequence, r.begin, r.finish, r.n_actions, r.gross, r.direction) for r in out.collect())


def test_sequences_do_not_depend_on_the_order_within_the_lateness(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(3), rng.randrange(400), f"x{i}", rng.choice([1, -1]), 1.0) for i in range(120)]
    files = {}
    for r in rows:
        files.setdefault((r[2] + rng.randrange(50)) // 80, []).append(r)
    want = []
    for key in sorted({r[:2] for r in rows}):
        own, number = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2:]), 0
        for at, r in enumerate(own):
            if at and own[at - 1][4] == r[4] and r[2] - own[at - 1][2] <= 20:
                last = want[-1]
                want[-1] = (*last[:4], r[2], last[5] + 1, last[6] + 1.0, r[4])
            else:
                number += 1
                want.append((*key, number, r[2], r[2], 1, 1.0, r[4]))
    assert sequenced(spark, f"{tmp_path}/in", [files[k] for k in sorted(files)], 20, 50) == sorted(want)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_rows_beyond_the_lateness_are_left_out(spark, tmp_path):
    files = [[("a", 1, 100, "x", 1, 1.0)], [("a", 1, 500, "y", 1, 1.0)], [("a", 1, 90, "late", 1, 1.0), ("a", 1, 505, "z", 1, 1.0)]]
    assert sequenced(spark, f"{tmp_path}/in", files, 20, 50) == [("a", 1, 1, 100, 100, 1, 1.0, 1), ("a", 1, 2, 500, 505, 2, 2.0, 1)]


def test_state_of_sequences_is_kept_by_groups_and_an_arrival_is_one_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from tickweave.streaming import sequences

    def put(*files):
        def write():
            for rows in files:
                spark.createDataFrame(rows, ACTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return write

    wallets = range(500)
    put([])()
    # the second file of the first arrival is older than the lateness allows after the first file
    arrivals = [put([("a", w, 500, "y", 1, 1.0) for w in wallets], [("a", w, 100, "x", 1, 1.0) for w in wallets]), put([(None, None, 10**6, "", 0, 0.0)]), put([(None, None, 10**6 + 1, "", 0, 0.0)])]
    stream = spark.readStream.schema(ACTIONS).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("sec"))
    timed = sequences.sequences(stream, 20, "50 seconds")
    out = streams.run_once(timed, spark, "append", settings=dict([sequences.PROVIDER]), arrivals=arrivals)
    assert sorted((r.wallet, r.sequence, r.begin, r.n_actions) for r in out.collect()) == [(w, k + 1, at, 1) for w in wallets for k, at in enumerate((100, 500))]
    spark.conf.set(*sequences.PROVIDER)
    try:
        query = timed.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        query.stop()
    finally:
        spark.conf.unset(sequences.PROVIDER[0])
    assert kept and 0 < max(kept) <= 4 * sequences.GROUPS  # actions, open sequences and a timer with its index
