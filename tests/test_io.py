import datetime as dt
import json

from pyspark.sql import functions as F

from panelspark.operators.entities import alias_table, load_channels, load_entities
from panelspark.operators.maintenance import write_panel
from panelspark.sources import landing as la
from panelspark.operators import clustering as cl
from panelspark.streaming import jobs


def test_csv_and_panel_dir(spark, tmp_path):
    (tmp_path / "A.csv").write_text("DATE,SECID,x\n2024-01-02,A,1\nbad,A,2\n")
    (tmp_path / "B.csv").write_text("SECID,DATE,y\nB,2024-01-01,3\n")
    (tmp_path / "C.csv").write_text("DAY,z\n2024-01-01,3\n")
    rows = la.read_panel_dir(spark, f"{tmp_path}/*.csv").collect()
    assert [(r["SECID"], str(r["DATE"]), r["x"], r["y"]) for r in rows] == [("A", "2024-01-02", "1", None), ("B", "2024-01-01", None, "3")]
    (tmp_path / "bars.csv").write_text("TRADEDATE,SECID,OPEN,HIGH,LOW,CLOSE,VOLUME,WAPRICE\n2024-01-02,A,1,2,0.5,NaN,10,\nx,A,1,2,3,4,5,6\n")
    rows = la.read_panel_csv(spark, f"{tmp_path}/bars.csv").collect()
    assert rows[0]["close"] is None and rows[0]["high"] == 2.0 and rows[1]["date"] is None
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2,3\n")
    assert la.read_delimited(spark, f"{tmp_path}/t.tsv").first().asDict() == {"a": "1", "b": "2,3"}


def test_reports_and_dates(spark, tmp_path):
    folder = tmp_path / "quarterly"
    folder.mkdir()
    (folder / "SBER_q.csv").write_text("x;2023Q3;2023Q4\nВыручка;1;2\n;;\n")
    rows = la.read_reports(spark, str(folder)).orderBy("row_no", "period").collect()
    assert [(r["ticker"], r["report_type"], r["label"], r["period"], r["text"]) for r in rows if r["label"]] == [("SBER", "quarterly", "Выручка", "2023Q3", "1"), ("SBER", "quarterly", "Выручка", "2023Q4", "2")]
    df = spark.createDataFrame([("x", "2024-01-01")], "begin string, end string")
    assert la.resolve_date_column(df, candidates=la.DATE_NAMES) == "end"
    assert la.resolve_date_column(df.toDF("TradeDay", "v")) == "TradeDay"
    assert la.resolve_date_column(df.toDF("a", "b")) is None


def test_jsonl_and_payloads(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"custom_id": "a", "n": 1}\n\nnot json\n{"n": 2}\n')
    good, bad = la.read_jsonl_log(spark, f"{tmp_path}/log.jsonl", "custom_id string, n int")
    assert [r["custom_id"] for r in good.collect()] == ["a"]
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "no id"]
    one = lambda v: spark.createDataFrame([("A", json.dumps(v))], "secid string, value string")
    metal = one({"history": {"columns": ["BOARDID", "TRADEDATE", "SECID", "CLOSE"], "data": [["CETS", "2024-01-01", "GOLD", 1.5], ["CETS", "2024-01-01", "GOLD", 2.5], ["X", "2024-01-01", "GOLD", 9], ["CETS", "2024-01-02", "GOLD", 0]]}})
    assert [(str(r["date"]), r["value"]) for r in la.parse_metal_json(metal).collect()] == [("2024-01-01", 2.5)]
    size = one({"description": {"columns": ["name", "title", "value"], "data": [["SECID", "t", "A"], ["ISSUESIZE", "t", "100"]]}})
    assert la.parse_issue_size_json(size).first()["issue_size"] == 100.0
    listing = one({"securities": {"columns": ["SECID", "SHORTNAME", "PREVPRICE"], "data": [["A", "a", 1], ["B", "b", None]]}})
    assert [r["secid"] for r in la.parse_listing_json(listing).collect()] == ["A"]
    (tmp_path / "fx.xml").write_text('<V><Record Date="01.02.2024" Id="R"><Nominal>10</Nominal><Value>95,5</Value></Record><Record Date="02.02.2024" Nominal="1"><Value>9,6</Value></Record></V>')
    rates, nominal = la.parse_fx_xml(spark, f"{tmp_path}/fx.xml")
    assert sorted((str(r["date"]), r["value"]) for r in rates.collect()) == [("2024-02-01", 9.55), ("2024-02-02", 9.6)]
    assert nominal.count() == 2
    (tmp_path / "c.json").write_text(json.dumps([{"cluster_id": "k", "cluster_date": "2024-01-01", "news": ["a", "b"], "datetime": ["2024-01-01T00:00:00", "bad"], "channel_name": ["x", "y"], "message_link": ["l", "m"]}]))
    assert [r["news"] for r in la.read_clusters(spark, f"{tmp_path}/c.json").orderBy("seq").collect()] == ["a", "b"]


def test_entity_configs(spark):
    raw = spark.createDataFrame([(json.dumps({"companies": {"SBER": {"names": ["Сбер", "Банк"]}, "VTB": {"names": ["банк"]}}, "indices": {"MOEX": "index"}}),)], "value string")
    rows = {(r["alias"], r["secid"]) for r in alias_table(load_entities(raw)).collect()}
    assert rows == {("sber", "SBER"), ("сбер", "SBER"), ("vtb", "VTB"), ("банк", "VTB"), ("moex", "MOEX")}
    chan = spark.createDataFrame([(json.dumps({"news": {"u": "n"}, "blogs": {}}),)], "value string")
    assert [tuple(r) for r in load_channels(chan).collect()] == [("news", "u", "n")]


def test_streams_equal_batch_and_rerun_adds_nothing(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    kind = "datetime string, channel_name string, message_link string, views long, news string"
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "c", "t.me/1", 1, "первая новость"), ("2024-01-01T00:01:00Z", "c", "t.me/1", 1, "первая новость"), ("2024-01-01T00:02:00Z", "c", "t.me/2", 1, "#x")], kind)
    rows.coalesce(1).write.json(src)
    for _ in range(2):
        jobs.clean_message_stream(spark, src, out, cp).awaitTermination()
    links = lambda: sorted(r["message_link"] for r in jobs.committed(spark, out).collect())
    assert links() == ["https://t.me/1"]
    more = spark.createDataFrame([("2023-12-31T00:00:00Z", "c", "t.me/0", 1, "старая новость"), ("2024-01-02T00:00:00Z", "c", "t.me/3", 1, "новая новость")], kind)
    more.coalesce(1).write.mode("append").json(src)
    jobs.clean_message_stream(spark, src, out, cp).awaitTermination()
    assert links() == ["https://t.me/1", "https://t.me/3"]


def test_replayed_batches_and_crashes_add_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    at = lambda *days: spark.createDataFrame([(dt.datetime(2024, 1, d), d) for d in days], "datetime timestamp, x int")
    got = lambda: sorted(r["x"] for r in jobs.committed(spark, out).collect())
    assert jobs.commit_batch(at(1, 2), 0, out, "datetime") and not jobs.commit_batch(at(1, 2), 0, out, "datetime")
    at(3, 4).write.parquet(f"{out}/rows/batch=1")  # a crash before the commit
    assert got() == [1, 2]
    assert jobs.commit_batch(at(2, 3, 4), 1, out, "datetime") and got() == [1, 2, 3, 4]
    assert jobs.commit_batch(at(4), 2, out, "datetime") and got() == [1, 2, 3, 4]


def test_bar_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = [("A", dt.date(2024, 1, i), 1.0, 1.0, 1.0, float(i), 1.0, 1.0) for i in (1, 2)]
    spark.createDataFrame(rows, jobs.BAR).write.mode("append").parquet(src)
    jobs.bar_stream(spark, src, out, cp).awaitTermination()
    spark.createDataFrame([*rows[1:], ("A", dt.date(2024, 1, 3), 1.0, 1.0, 1.0, 3.0, 1.0, 1.0)], jobs.BAR).write.mode("append").parquet(src)
    jobs.bar_stream(spark, src, out, cp).awaitTermination()
    assert sorted(r["close"] for r in spark.read.parquet(out).collect()) == [1.0, 2.0, 3.0]


def test_windows_from_the_first_midnight(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 3, 5) + dt.timedelta(hours=h),) for h in (0, 30, 60, 100, 121)], "datetime timestamp")
    got = sorted((r["datetime"], r["window"]) for r in cl.assign_windows(rows, 3, 2, from_first=True).collect())
    times = [dt.datetime(2024, 1, 3, 5) + dt.timedelta(hours=h) for h in (0, 30, 60, 100, 121)]
    first, want, k = dt.datetime(2024, 1, 3), [], 0
    while True:
        start = first + dt.timedelta(days=2 * k)
        left = start + dt.timedelta(days=3) > max(times)
        want += [(t, start.date()) for t in times if t >= start and (left or t < start + dt.timedelta(days=3))]
        k += 1
        if left:
            break
    assert got == sorted(want)


def test_the_last_window_takes_an_odd_number_of_days(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h),) for h in (0, 47, 50, 97, 100)], "datetime timestamp")
    got = sorted((r["datetime"].day, str(r["window"])[-2:]) for r in cl.assign_windows(rows, 3, 2, from_first=True).collect())
    assert got == [(1, "01"), (2, "01"), (3, "01"), (3, "03"), (5, "03"), (5, "03")]


def test_stream_of_windows_in_many_batches_equals_one_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    kind = "id long, datetime timestamp, channel_name string, message_link string, news string, embedding array<double>"
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), f"c{i % 4}", f"l{i}", "x" * (1 + i % 6), [1.0, 0.02 * (i % 3), float(i % 2)]) for i in range(24)]
    cfg = cl.ClusterConfig(min_docs=2)
    for lo in range(0, 24, 8):
        spark.createDataFrame(rows[lo : lo + 8], kind).coalesce(1).write.mode("append").parquet(src)
        jobs.representative_stream(spark, src, out, cp, cfg).awaitTermination()
    jobs.finish_windows(spark, src, out, cfg)
    whole = cl.assign_windows(spark.createDataFrame(rows, kind), from_first=True)
    want = cl.representatives(cl.cluster_windows(spark, whole, cfg).join(whole, ["window", "id"]))
    columns = ["window", "cluster", "id", "news"]
    assert sorted(map(tuple, spark.read.parquet(out).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_panel_folders(spark, tmp_path):
    write_panel(spark.createDataFrame([("A", 1.0), ("B", 2.0)], "secid string, x double"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("secid = 'B'").first()["x"] == 2.0


def test_a_line_that_names_both_columns_is_no_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffDATE,SECID,NOTE\n2024-01-01,A,x\n2024-01-02,B,ADATE SECID\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("x,y\nDATE,SECID\n")
    got = la.read_panel_dir(spark, f"{tmp_path}/*.csv").collect()
    assert sorted(r["SECID"] for r in got) == ["A", "B"]
