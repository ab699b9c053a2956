import datetime as dt
import json
import time
import uuid

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweave.streaming import watch
from codeweave.streaming.live import spooled

T0 = dt.datetime(2024, 1, 1)


def events(spark, *rows):
    return spark.createDataFrame([(s, d, i, T0 + dt.timedelta(seconds=t)) for s, d, i, t in rows], watch.EVENT)


def test_relevance_and_head(spark):
    df = events(
        spark, ("/w/a.py", None, False, 0), ("/w/.git/HEAD", None, False, 1), ("/w/.git/index", None, False, 2), ("/w/src/HEAD", None, False, 3),
        ("/w/build/x.py", None, False, 4), ("/w/dir.py", None, True, 5), ("/w/x.tmp", "/w/x.go", False, 6), ("/wx/a.py", None, False, 7), (None, None, None, 8),
    )
    assert [(r["src_path"], r["head"]) for r in watch.dispatch(df, "/w/").orderBy("ts").collect()] == [("/w/a.py", False), ("/w/.git/HEAD", True), ("/w/x.tmp", False)]


def test_debounce_in_batch(spark):
    df = watch.dispatch(events(spark, ("/w/a.py", None, False, 0), ("/w/.git/HEAD", None, False, 1), ("/w/b.py", None, False, 9)), "/w")
    got = watch.debounce(df).orderBy("first_event").collect()
    assert [(r["n_events"], r["reason"]) for r in got] == [(2, "branch switched"), (1, "files changed")]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=40), st.integers(1, 60))
def test_bursts_over_stretches(spark, seconds, stretch):
    """Whatever the stretches, bursts are those of the events in order."""
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=t), t % 7 == 0) for t in seconds] + [(None, True)], "ts timestamp, head boolean")
    expected, last = [], None
    for t in sorted(seconds):
        if last is None or t - last > 5:
            expected.append([t, t, 0, False])
        expected[-1][1:] = [t, expected[-1][2] + 1, expected[-1][3] or t % 7 == 0]
        last = t
    got = [((r["first_event"] - T0).total_seconds(), (r["last_event"] - T0).total_seconds(), r["n_events"], r["reason"] == "branch switched") for r in watch.debounce(df, "5 seconds", stretch=stretch).collect()]
    assert sorted(got) == [tuple(e) for e in expected]


def test_stream_refreshes_once_a_burst_and_survives_errors(spark, tmp_path):
    source, seen = tmp_path / "in", []
    for n, rows in enumerate([[("/w/a.py", None, False, 0), ("/w/b.py", None, False, 1)], [("/w/.git/HEAD", None, False, 20)], [("/w/c.py", None, False, 60)]]):
        events(spark, *rows).coalesce(1).write.parquet(str(source / f"n={n}"))

    def refresh(reason):
        seen.append(reason)
        raise RuntimeError("logged only")

    stream = spark.readStream.schema(watch.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    q = watch.watch(stream, "/w", refresh, str(tmp_path / "checkpoint"), trigger={"processingTime": "0 seconds"})
    try:
        end = time.time() + 60
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.2)  # a query with a clock never has nothing to do, so processAllAvailable() would not return
    finally:
        q.stop()
    assert seen[:2] == ["files changed", "branch switched"]


def test_changes_of_a_tree_reach_its_stored_graph(spark, sample_repo, tmp_path):
    """A file that changes, one that comes and one that goes are one burst; the graph follows, a failed build is only logged."""
    from codeweave.plans.build import build_index, open_graph
    from codeweave.streaming.live import Poller, live, spooled

    home, spool, seen = str(tmp_path / "home"), str(tmp_path / "spool"), []
    build_index(spark, str(sample_repo), home, embeddings=False)
    poller = Poller(str(sample_repo), spool)
    assert poller.look() == 0
    query = live(spark, str(sample_repo), home, spooled(spark, spool), str(tmp_path / "checkpoint"), lambda why, stats: seen.append((why, stats["Symbol"])), gap="1 second", trigger={"processingTime": "0 seconds"})
    try:
        (sample_repo / "storage.py").write_text("def new_page(width):\n    return []\n")
        (sample_repo / "tide.go").write_text("package ferry\n\nfunc Tide() int { return board(1) }\n")
        (sample_repo / "ticket.ts").unlink()
        (sample_repo / "notes.md").write_text("no source")
        assert poller.look() == 3
        end = time.time() + 90
        while not seen and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[0] == ("files changed", 14 - 1 + 1 - 5)
    g = open_graph(spark, str(sample_repo), home)
    assert {r["name"] for r in g.callers("board").collect()} == {"Depart", "board", "Tide"} and g.get_symbol("open_book").isEmpty()


def saves(spool, *rows):
    """Spools events as a file, as a poller does."""
    name = uuid.uuid4().hex
    spool.mkdir(exist_ok=True)
    lines = "".join(json.dumps({"src_path": p, "dest_path": None, "is_directory": False, "ts": (T0 + dt.timedelta(seconds=t)).isoformat() + "Z"}) + "\n" for p, t in rows)
    (spool / f".{name}").write_text(lines)
    (spool / f".{name}").rename(spool / f"{name}.json")


def wait(until, seconds=60):
    end = time.time() + seconds
    while not until() and time.time() < end:
        time.sleep(0.05)


def test_one_save_and_then_silence(spark, tmp_path):
    """Nothing comes after the save; the clock ends the burst, once, and a save after that is a burst of its own."""
    spool, seen = tmp_path / "spool", []
    spool.mkdir()
    q = watch.watch(spooled(spark, str(spool)), "/w", lambda reason: seen.append((reason, time.time())), str(tmp_path / "checkpoint"))
    try:
        saves(spool, ("/w/warm.py", 0))
        wait(lambda: seen)
        began = time.time()
        saves(spool, ("/w/a.py", 100), ("/w/.git/HEAD", 100.2))
        wait(lambda: len(seen) > 1)
        assert seen[1][0] == "branch switched" and 1.4 < seen[1][1] - began < 4.5
        time.sleep(4)
        assert len(seen) == 2
    finally:
        q.stop()


def test_an_open_burst_survives_a_restart(spark, tmp_path):
    """The watch is stopped within the gap and started again from its checkpoint: the next event, after the gap, ends the burst."""
    spool, seen, checkpoint = tmp_path / "spool", [], str(tmp_path / "checkpoint")
    spool.mkdir()
    q = watch.watch(spooled(spark, str(spool)), "/w", seen.append, checkpoint, gap="20 seconds")
    saves(spool, ("/w/a.py", 0))
    wait(lambda: q.recentProgress and sum(p["numInputRows"] for p in q.recentProgress) > 0)
    q.stop()
    assert seen == []
    saves(spool, ("/w/b.py", 100))
    q = watch.watch(spooled(spark, str(spool)), "/w", seen.append, checkpoint, gap="20 seconds")
    try:
        wait(lambda: seen)
    finally:
        q.stop()
    assert seen == ["files changed"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=8), min_size=1, max_size=6))
def test_parts_of_bursts_make_the_bursts_of_all_events(partitions):
    made = lambda ts: watch.merged(pd.DataFrame({"first": ts, "last": ts, "n": [1] * len(ts), "head": [t % 7 == 0 for t in ts]}), 5)
    want, got = made(sorted(t for p in partitions for t in p)), watch.merged(pd.concat([made(p) for p in partitions]), 5)
    assert want.values.tolist() == got.values.tolist()
    gaps = want["first"].values[1:] - want["last"].values[:-1]
    assert (gaps > 5).all() and want["n"].sum() == sum(map(len, partitions))


def test_settings_stay_as_they_were(spark, tmp_path):
    (tmp_path / "spool").mkdir()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    watch.watch(spooled(spark, str(tmp_path / "spool")), "/w", print, str(tmp_path / "checkpoint")).stop()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
