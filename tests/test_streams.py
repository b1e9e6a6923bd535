"""Streaming queries over many files in no order of time."""

import os
import random

import pyarrow.parquet as pq
import pytest

from barloom.plans import registry
from barloom.streaming import intraday as st

SF = "/root/testdata/sf0.01"
ALL = registry.load_all()


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The same events as one file, and as 20 files that arrive shuffled, the latest among the first."""
    events = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    one, many = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("many")
    pq.write_table(events, one / "events.parquet")
    (many / "events.parquet").mkdir()
    step = -(-len(events) // 20)
    order = list(range(20))
    random.Random(1).shuffle(order)
    order.sort(key=lambda k: k < 10)  # stable: later halves first
    for at, k in enumerate(order):
        path = many / "events.parquet" / f"part-{k:02}.parquet"
        pq.write_table(events.slice(k * step, step), path)
        os.utime(path, (1_700_000_000 + 60 * at,) * 2)
    return str(one), str(many)


@pytest.mark.parametrize("name", ["stream_session_bars", "stream_session_vwap", "stream_upserted_sessions"])
def test_files_in_any_order_lose_no_tick(spark, folders, name):
    want, got = (sorted(map(tuple, ALL[name].run(spark, f).collect()), key=str) for f in folders)
    assert want and got == want


def arrive(folder, k, frame):
    frame.write.mode("overwrite").parquet(str(folder / f"batch{k}"))


def test_upsert_is_driven_by_the_stream_and_may_be_replayed(spark, tmp_path):
    """Bars that later files change replace their earlier form; a replayed batch changes nothing."""
    schema = "symbol string, ts timestamp, value double, seq long"
    early = [("A", f"2024-01-01 10:{m:02}:00", float(m), m) for m in range(10)] + [("B", "2024-01-01 11:00:00", 5.0, 1), ("A", "2024-01-02 09:00:00", 1.0, 1)]
    later = [("A", "2024-01-01 10:30:00", 99.0, 40), ("B", "2024-01-01 11:30:00", 7.0, 2)]
    rows = lambda part: spark.createDataFrame(part, "symbol string, at string, value double, seq long").selectExpr("symbol", "timestamp(at) ts", "value", "seq")
    source, store, state = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "state")

    def drain():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        st.keep_sessions(st.bars(stream), store, state)
        return sorted((r.symbol, str(r.bar_ts), r.open, r.close, r.volume) for r in spark.read.parquet(store).collect())

    arrive(source, 0, rows(early))
    first = drain()
    assert first == [("A", "2024-01-01 10:00:00", 0.0, 9.0, 10), ("A", "2024-01-02 09:00:00", 1.0, 1.0, 1), ("B", "2024-01-01 11:00:00", 5.0, 5.0, 1)]
    assert drain() == first  # nothing new: the stream goes on behind its last batch
    arrive(source, 1, rows([r for r in later if r[0] == "B"]))
    assert [r for r in drain() if r[0] == "B"][0][3:] in [(7.0, 2), (5.0, 1)]  # in the watermark or behind it, never a bar twice
    batch = spark.read.parquet(store).where("symbol = 'A'")
    for _ in range(2):
        st.upsert_sessions(store, ("symbol", "bar_ts"))(spark.createDataFrame(batch.collect(), batch.schema).withColumn("close", st.F.lit(-1.0)), 77)
        got = spark.read.parquet(store).collect()
        assert len(got) == 3 and {r.close for r in got if r.symbol == "A"} == {-1.0}


def test_a_title_is_news_again_after_thirty_days(spark, tmp_path):
    days = [("x", 0, 1), ("x", 29, 2), ("X!", 31, 3), ("y", 31, 4), ("x", 45, 5), ("x", 62, 6), ("y", 62, 7), ("z", 100, 8), ("x", 100, 9), ("x", 100, 10)]
    source = tmp_path / "in"
    for k, part in enumerate((days[:2], days[2:5], days[5:7], days[7:])):
        rows = spark.createDataFrame(part, "title string, day int, id int")
        arrive(source, k, rows.selectExpr("title", "timestamp(date_add(date'2024-01-01', day)) published_at", "id").coalesce(1))

    def drained(files):
        stream = (spark.readStream.schema("title string, published_at timestamp, id int").option("recursiveFileLookup", "true")
                  .option("maxFilesPerTrigger", files).parquet(str(source)))
        return sorted(r.id for r in st.run_once(st.distinct_stories(stream), mode="append").collect())

    assert drained(1) == [1, 3, 4, 6, 7, 8, 9] and drained(100) == [1, 3, 4, 6, 7, 8, 9]


def test_titles_that_share_a_shelf_stay_apart(spark, tmp_path):
    """A thousand titles and two shelves: a title's time is its own, and the empty and the null title are titles too."""
    source = tmp_path / "in"
    days = [[(f"t{k}", 0, k) for k in range(1000)] + [("", 0, 1000), (None, 0, 1001)],
            [(f"T{k}", 10, 2000 + k) for k in range(0, 1000, 2)] + [("", 10, 3000), (None, 10, 3001), ("new", 10, 3002)],
            [(f"t{k}!", 31 + k % 2, 4000 + k) for k in range(1000)] + [("new", 31, 5000)]]
    for k, part in enumerate(days):
        rows = spark.createDataFrame(part, "title string, day int, id int")
        arrive(source, k, rows.selectExpr("title", "timestamp(date_add(date'2024-01-01', day)) published_at", "id").coalesce(1))
    want = [*range(1002), 3002, *range(4000, 5000)]
    for files in (1, 100):
        stream = (spark.readStream.schema("title string, published_at timestamp, id int").option("recursiveFileLookup", "true")
                  .option("maxFilesPerTrigger", files).parquet(str(source)))
        assert sorted(r.id for r in st.run_once(st.distinct_stories(stream, shelves=2), mode="append").collect()) == want
