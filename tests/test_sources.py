"""Store, parsers, events and story merging."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import events as ev, panel as pn, quality as ql
from barloom.schemas import SchemaError, require_columns
from barloom.sources import actions as ca, calendar as cal, files as fl, news, symbols as sy


def test_store_replaces_one_day_and_refuses_empty(spark, panel, tmp_path):
    path = str(tmp_path / "bars")
    pn.write_day(panel, path)
    day = panel.where("idx = 50").withColumn("close", F.lit(1.0))
    pn.write_day(day, path)
    back = pn.read_store(spark, path)
    assert back.count() == panel.count()
    assert {r.close for r in back.where("idx = 50").collect()} == {1.0}
    with pytest.raises(pn.PanelError):
        pn.write_day(panel.where("idx < 0"), path)
    with pytest.raises(SchemaError):
        require_columns(panel.drop("close"))
    plan = pn.history(back, "2020-03-02", lookback=5, columns=["close"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session" in plan and "volume" not in plan.split("ReadSchema")[-1]


def test_history_rules(panel):
    with pytest.raises(pn.PanelError):
        pn.history(panel, "2020-03-02", lookback=3, start="2020-01-01")
    with pytest.raises(pn.PanelError):
        pn.history(panel, "2020-03-02", lookback=0)
    assert pn.history(panel, "2019-01-01", lookback=3).count() == 0     # nothing stored yet is an answer
    assert pn.history(panel, "2020-03-02", lookback=3).select("session").distinct().count() == 3
    with pytest.raises(Exception, match="no snapshot"):
        pn.load_day(panel, "2020-01-04").collect()


def test_coverage_without_calendar_is_not_complete(panel):
    r = pn.coverage(panel, None).first()
    assert r.days_loaded == 160 and r.missing is None and not r.complete and not r.calendar_checked


def test_dense_matrix(panel):
    m = pn.full_matrix(panel)
    assert m.count() == 8 * 160 and m.where("traded").count() == panel.count()


def test_assert_clean(spark, panel):
    none = spark.createDataFrame([], "symbol string, ex_date date, type string, factor double, amount double")
    ql.assert_clean(panel, none)
    with pytest.raises(ql.QualityError):
        ql.assert_clean(panel.withColumn("high", F.when(F.col("idx") == 9, F.col("low") / 2).otherwise(F.col("high"))), none)


@pytest.mark.parametrize("text,want", [
    ("Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share", ("split", 5.0, 0.0, None)),
    ("Bonus 1:2", ("bonus", 1.5, 0.0, None)),
    ("Bonus 1:1 / Stock Split From Rs 10 To Rs 5", ("split", 4.0, 0.0, None)),
    ("Interim Dividend - Rs 8.50 Per Share", ("dividend", 1.0, 8.5, None)),
    ("Dividend - Rs 1,250 And Special Dividend Re 1 Including Dividend Rs 9", ("dividend", 1.0, 1251.0, None)),
    ("Rights 1:4", (None, None, None, "moves the price but is no single factor")),
    ("Annual General Meeting", (None, None, None, "leaves the price alone")),
    ("", (None, None, None, "blank subject")),
    ("Bonus issue", (None, None, None, "unrecognised subject")),
    ("Bonus 1:1 / Stock Split", ("bonus", 2.0, 0.0, None)),
    ("Interim Dividend - Rs 5 Per Share / Stock Split", ("dividend", 1.0, 5.0, None)),
    ("Face Value Split From Rs 10 To Rs 2 And Bonus Debentures", ("split", 5.0, 0.0, None)),
    ("Bonus Debentures / Rights 1:15 @ Premium Rs 1247", (None, None, None, "moves the price but is no single factor")),
    ("Face Value Split From Rs 2 To Rs 10", (None, None, None, "split without a usable ratio")),
    ("Final Dividend Rs 20.50 Per Shar", ("dividend", 1.0, 20.5, None)),
    ("Bonus Issue Of Equity Shares In The Proportion Of 1:1", (None, None, None, "unrecognised subject")),
    ("Bonus Debentures 1:15", ("bonus", 16 / 15, 0.0, None)),
    ("Bonus Issue (1:1)", ("bonus", 2.0, 0.0, None)),
    ("Face Value Split From Rs.10/- To Rs.2/-", ("split", 5.0, 0.0, None)),
    ("Face Value Split From Rs. 2.50 To Re .50", ("split", 5.0, 0.0, None)),
    ("Splitting Of Share Certificates From Rs 10 To Rs 2", (None, None, None, "unrecognised subject")),
    ("Split Of Face Value\nFrom Rs 10 To Rs 2", (None, None, None, "unrecognised subject")),
    ("Dividend Policy Of The Company Revised, Rs 5", (None, None, None, "unrecognised subject")),
    ("\n \t", (None, None, None, "blank subject")), (None, (None, None, None, "blank subject")),
])
def test_subjects(spark, text, want):
    r = spark.createDataFrame([(text,)], "s string").select(ca.parse("s").alias("a")).first().a
    assert (r.type, r.factor, r.amount, r.reason) == want


# spellings of the exchange's archive: what stands around the amounts, and the amounts that count
PAID = ["Dividend - Rs {} Per Share", "Dividend-Rs.{} Per Share", "Dividend-Rs.{}/- Per Share", " Dividend -  Rs {}/- Per Share", "Dividend- Rs {} Per Share",
        "Dividend-Rs {} Per Share", "Dividend - Rs {}  Per Share", " Dividend Rs {} Per Sh", "Dividend Rs. {} Per Equity Share", "Interim Dividend - Re {} Per Share",
        "Interim Dividend - Re  {} Per Share", "Interim Dividend - Rs {}/- Per Share (Purpose Revised)", "Special Dividend - Rs {} Per Share",
        " Annual General Meeting/Dividend - Rs  {} Per Share", "Annual General Meeting/Dividend- Rs {} Per Share", "Annual General Meeting And Dividend Rs.{} Per Share",
        "Annual General Meeting And Dividend - Rs.{}/- Per Share", "Annual General Meeting/ Dividend Rs. {} Per Equity Share",
        "Annual General Meeting / Final Dividend Rs.{}/- Per Equity Share", "Dividend-Rs.{} Per Share (Including Special Dividend Of Rs.2/- Per Share)."]
PAID_TWICE = ["Dividend - Rs {} Per Share /Special Dividend - Rs {} Per Share", "Interim Dividend - Rs {} Per Share Special Dividend - Rs {} Per Share",
              "Interim Dividend Rs {} Per Share/ Special Dividend Rs {} Per Share", " Annual General Meeting/ Final Dividend Rs {} Per Shar/ Special Dividend - Rs {} Per Share",
              "Annual General Meeting/Special Dividend - Rs {} Per Share /Dividend - Rs {} Per Share"]


def test_every_spelling_of_a_dividend(spark):
    amounts = ("1", "5.5", "6", "8.50", "16.50", "4.30", "10.15", "22", "1,250.75")
    rows = [(s.format(a), float(a.replace(",", ""))) for s in PAID for a in amounts]
    rows += [(s.format(a, b), float(a.replace(",", "")) + float(b.replace(",", ""))) for s in PAID_TWICE for a in amounts for b in amounts]
    got = spark.createDataFrame(rows, "s string, want double").select("s", "want", ca.parse("s").alias("a")).collect()
    assert [r for r in got if (r.a.type, r.a.amount) != ("dividend", pytest.approx(r.want))] == []


@pytest.mark.parametrize("text,want", [("6:15 PM to 7:15 PM", ("18:15", "19:15")), ("6.15 to 7.15 p.m.", ("18:15", "19:15")), ("18:00-19:00", ("18:00", "19:00")),
                                       ("6:15 to 7:15", None), ("Closed", None), ("12:30 am to 1:00 am", ("00:30", "01:00"))])
def test_session_window(spark, text, want):
    r = spark.createDataFrame([(text,)], "s string").select(cal.session_window("s").alias("w")).first().w
    assert (r and (r.opens, r.closes)) == want


def test_unloaded_year_is_refused(spark):
    d = cal.dimension(spark.sql("select explode(sequence(date'2020-01-01', date'2020-12-31')) as day").withColumn("is_session", F.weekday("day") < 5))
    assert cal.sessions_between(d, "2020-03-02", "2020-03-06").count() == 5
    with pytest.raises(Exception, match="no data"):
        cal.sessions_between(d, "2020-12-28", "2021-01-05").collect()


def test_wrong_day_file_fails(spark):
    df = spark.sql("select date'2020-01-02' session union all select date'2020-01-03'")
    with pytest.raises(Exception, match="another day"):
        fl.one_day(df, "2020-01-02").collect()


def test_symbols(spark):
    df = spark.createDataFrame([(x,) for x in ("NSE:M&M", "tcs.ns", "500325.BO", "X.LON", "bad symbol", "INFY")], "raw string")
    got = [(r.base, r.exchange) for r in sy.parse(df, "raw").collect()]
    assert got == [("M&M", "NSE"), ("TCS", "NSE"), ("500325", "BSE"), (None, None), (None, None), ("INFY", "NSE")]


def test_adjustment_ignores_later_knowledge(spark):
    bars = spark.createDataFrame([("A", dt.date(2020, 1, d), 10.0 * d, 10.0 * d, 10.0 * d, 10.0 * d, 100.0) for d in range(1, 7)],
                                 "symbol string, session date, open double, high double, low double, close double, volume double")
    acts = spark.createDataFrame([("A", dt.date(2020, 1, 3), "split", 2.0, 0.0), ("A", dt.date(2020, 1, 5), "dividend", 1.0, 4.0), ("A", dt.date(2020, 1, 6), "bonus", 3.0, 0.0)],
                                 "symbol string, ex_date date, type string, factor double, amount double")
    f = [r.adj_factor for r in ql.adjust(bars, acts, "2020-01-05", dividends=True).orderBy("session").collect()]
    assert f == pytest.approx([.5 * .9, .5 * .9, .9, .9, 1, 1])


def test_next_event(spark):
    e = spark.createDataFrame([("A", dt.date(2020, 1, 10), "Results", True), ("A", dt.date(2020, 1, 5), "Chat", False)], "symbol string, event_date date, purpose string, moving boolean")
    a = spark.createDataFrame([("A", dt.date(2020, 1, 4), "1"), ("A", dt.date(2020, 1, 10), "2"), ("A", dt.date(2020, 1, 11), "3"), ("B", dt.date(2020, 1, 4), "4")], "symbol string, as_of date, ask string")
    got = {r.ask: (r.days_until, r.known) for r in ev.next_event(a, e).collect()}
    assert got == {"1": (6, True), "2": (0, True), "3": (None, True), "4": (None, False)}


def test_stories_equal_the_ordered_merge(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    words = [f"w{i:02d}x" for i in range(14)] + ["rises", "falls", "market", "stocks"]
    titles = [" ".join(rng.choice(words, rng.integers(3, 7), replace=False)) for _ in range(160)]
    base = dt.datetime(2026, 1, 1)
    rows = [(i, t, f"s{i % 3}", base + dt.timedelta(minutes=int(i)), i % 4 + 1) for i, t in enumerate(titles)]
    items = spark.createDataFrame(rows, "item_id long, title string, source string, published_at timestamp, tier int")

    norm = lambda t: " ".join(t.lower().split())
    tok = lambda t: {w for w in norm(t).split() if len(w) > 2 and w not in news.STOPWORDS}

    def opposed(a, b):
        au, ad, bu, bd = a & set(news.UP), a & set(news.DOWN), b & set(news.UP), b & set(news.DOWN)
        return not (au and ad) and not (bu and bd) and bool((au and bd) or (ad and bu))

    groups = {}
    for i, t in enumerate(titles):
        groups.setdefault(norm(t), []).append(i)
    gs, used, want = list(groups.values()), set(), []
    for i, g in enumerate(gs):
        if i in used:
            continue
        n = list(g)
        for j in range(i + 1, len(gs)):
            a, b = tok(titles[gs[i][0]]), tok(titles[gs[j][0]])
            if j not in used and len(a & b) / len(a | b) >= 0.5 and not opposed(a, b):
                n += gs[j]
                used.add(j)
        want.append((g[0], len(n)))
    got = sorted((r.item_id, r["items"]) for r in news.cluster(items, 0.5).collect())
    assert got == sorted(want)


def test_opposed_headlines(spark):
    pairs = [("Stocks rise on data", "Stocks fall on data", True), ("Stocks rise then fall", "Stocks fall", False), ("Stocks rise", "Stocks rally", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", news.opposed(news.tokens("a"), news.tokens("b")).alias("got"))
    assert all(r.got == r.want for r in df.collect())


def test_titles_of_the_same_words_meet_once_and_only_near_pairs_are_made(spark, monkeypatch):
    rows = [(k, f"merger talks stall {k % 100} {'again' if k % 2 else 'in'} {k // 100}") for k in range(400)]
    rows += [(1000 + k, f"zinc {' '.join(f'w{k}x{j}' for j in range(12))}") for k in range(60)]
    items = spark.createDataFrame(rows, "item_id long, title string").withColumns(
        {"published_at": F.timestamp_seconds("item_id"), "tier": F.lit(1), "source": F.lit("s")})
    met, plain = [], news.near_pairs
    monkeypatch.setattr(news, "near_pairs", lambda g, s: met.append((g.count(), plain(g, s).count())) or plain(g, s))
    got = {r.item_id: r["items"] for r in news.cluster(items, 0.6).collect()}
    assert met == [(62, 1)] and got == {0: 400, **{1000 + k: 1 for k in range(60)}}


def test_words_of_near_copies_meet_their_leader_alone(spark, monkeypatch):
    rows = [(k, f"harbour crane lifts seven copper rings beside quiet granite tower every morning item{k}", "s") for k in range(40)]
    rows += [(100, "wholly other matter entirely", None)]
    items = spark.createDataFrame(rows, "item_id long, title string, source string").withColumns({"published_at": F.timestamp_seconds("item_id"), "tier": F.lit(1)})
    stored, plain = [], news.cut_lineage
    monkeypatch.setattr(news, "cut_lineage", lambda df: stored.append(plain(df)) or stored[-1])
    got = {r.item_id: (r["items"], list(r.sources)) for r in news.cluster(items, 0.6).collect()}
    assert got == {0: (40, ["s"]), 100: (1, [])}  # a story whose source is not known stays
    assert sum("title" in d.columns for d in stored) == 1
    assert sum(d.count() for d in stored if {"tok", "words"} & set(d.columns) and "title" not in d.columns) <= 40
    assert sum(d.where("now = 'near'").count() for d in stored if "now" in d.columns) == 39  # of 780 pairs


def test_copies_of_an_early_leader_make_no_pairs(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(4)
    rows = [(k, f"harbour crane lifts seven copper rings beside quiet granite tower every morning item{k}") for k in range(0, 80, 2)]
    rows += [(k, " ".join(f"word{j}" for j in sorted(rng.choice(14, 6, replace=False)))) for k in range(1, 80, 2)]
    items = spark.createDataFrame(rows, "item_id long, title string").withColumns({"published_at": F.timestamp_seconds("item_id"), "tier": F.lit(1), "source": F.lit("s")})
    want = sorted((r.item_id, r["items"]) for r in news.cluster(items, 0.5).collect())
    met, plain = [], news.near_pairs
    monkeypatch.setattr(news, "near_pairs", lambda g, s: met.append(plain(g, s).count()) or plain(g, s))
    monkeypatch.setattr(news, "_SEEDS", 10, raising=False)
    assert sorted((r.item_id, r["items"]) for r in news.cluster(items, 0.5).collect()) == want
    assert (0, 40) in want and sum(met) < 780  # pairs of the forty copies alone
