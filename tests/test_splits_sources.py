import datetime as dt
import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from helpers import column, days, panel
from tarnlight.functions.scalar import cross_rate, message, series_name
from tarnlight.operators import asof, splits, validate
from tarnlight.operators.validate import many_to_one
from tarnlight.sources import readers, sinks


def test_folds():
    folds = splits.walk_forward_folds(dt.date(2019, 1, 1), dt.date(2026, 9, 2))
    assert (folds[0].name, folds[0].split) == ("wf_2022", "y2022") and folds[-1].split == "oot" and folds[-1].test_start == dt.date(2025, 9, 1)
    splits.check_folds(folds)


def test_purge(spark):
    d = days(21)
    fold = splits.Fold("f", "wf_oos", d[7], d[7], d[14], d[14], d[20])
    df = panel(spark, [1.0] * 20)
    assert splits.train_rows(df, fold, 3).count() == 4 and splits.validation_rows(df, fold, 0).count() == 7


def test_overlapping_tests_are_refused():
    d = days(5)
    fold = splits.Fold("f", "x", d[0], d[0], d[1], d[1], d[4])
    with pytest.raises(ValueError):
        splits.check_folds([fold, splits.Fold("g", "x", d[0], d[0], d[2], d[2], d[4])])


def test_values_count_from_when_they_are_available(spark):
    ctx = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3), "ctx_x", 80.0)], "effective_date date, available_at date, name string, value double")
    assert column(asof.causal_context(panel(spark, [1, 1, 1]), ctx), "ctx_x") == [None, None, 80.0]


def test_forward_asof(spark):
    facts = spark.createDataFrame([("A", dt.date(2024, 1, 3), 7)], "k string, t date, v int")
    probes = spark.createDataFrame([("A", d) for d in days(4)], "k string, d date")
    got = asof.asof(probes, facts, ["k"], "d", "t", ["v"], "forward")
    assert column(got, "v", ("d",)) == [7, 7, 7, None]


EXTERNAL = "event_date date, available_at date, source string, series_id string, value double"


def test_external_contract(spark):
    day = dt.date(2024, 1, 2)
    good = spark.createDataFrame([(day, day, "s", "a b", 1.0)], EXTERNAL)
    assert validate.validate_external(good).count() == 1
    for rows in ([(day, dt.date(2024, 1, 1), "s", "a", 1.0)], [(day, day, "s", "a", None)], [(day, day, "s", "a", 1.0)] * 2, [(day, day, "s", "a b", 1.0), (day, day, "s", "a-b", 1.0)]):
        with pytest.raises(ValueError):
            validate.validate_external(spark.createDataFrame(rows, EXTERNAL))


def test_rate_xml(spark, tmp_path):
    file = tmp_path / "rates.xml"
    file.write_text('<ValCurs><Record Date="02.01.2024" Id="R1"><Nominal>10</Nominal><Value>82,5000</Value></Record></ValCurs>')
    r = readers.parse_rate_xml(spark, str(file), "TJS", "R1").first()
    assert (r["rub_per_unit"], r["effective_date"]) == (8.25, dt.date(2024, 1, 2))
    file.write_text('<ValCurs><Record Date="02.01.2024" Id="R1"><Nominal>x</Nominal><Value>1</Value></Record></ValCurs>')
    with pytest.raises(Exception, match="malformed"):
        readers.parse_rate_xml(spark, str(file), "TJS", "R1").collect()


def test_snapshot_is_fetched_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fetch(cbr_id):
        calls.add(1)
        return f'<ValCurs><Record Date="02.01.2024" Id="{cbr_id}"><Nominal>1</Nominal><Value>2,5</Value></Record><Record Date="03.01.2024" Id="{cbr_id}"><Nominal>1</Nominal><Value>2,6</Value></Record></ValCurs>'

    for _ in range(2):
        df = readers.fetch_snapshot(spark, fetch, {"A": "R1", "B": "R2"}, str(tmp_path / "rates"))
    assert df.count() == 4 and calls.value == 2 and {(r["currency"], r["cbr_id"]) for r in df.collect()} == {("A", "R1"), ("B", "R2")}
    with pytest.raises(Exception, match="no records of A"):
        readers.fetch_rates(spark, lambda _: "<ValCurs></ValCurs>", {"A": "R1"}).collect()


def test_paged_source(spark, tmp_path):
    pages = {0: [1, 2], 100: [3], 200: [4], 300: []}
    for start, values in pages.items():
        (tmp_path / f"{start}.json").write_text(json.dumps([{"date": f"2024-01-0{v}", "value": v} for v in values]))
    spark.dataSource.register(readers.PagedJson)

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            body = (tmp_path / f"{self.path.split('start=')[1]}.json").read_bytes()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for base, tasks in ((str(tmp_path), 1), (f"http://127.0.0.1:{server.server_port}/pages", 1), (str(tmp_path), 2)):
            df = spark.read.format("paged_json").option("base", base).option("readers", tasks).load()
            assert sorted(r["value"] for r in df.collect()) == [1, 2, 3, 4] and df.rdd.getNumPartitions() == tasks
    finally:
        server.shutdown()


def test_rates_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("currency,effective_date,rub_per_unit,is_fresh\nA,2024-01-02,8.25,true\n")
    r = readers.load_rates(spark, str(tmp_path / "r.csv")).first()
    assert (r["currency"], r["effective_date"], r["rub_per_unit"], r["is_fresh"]) == ("A", dt.date(2024, 1, 2), 8.25, True)
    with pytest.raises(FileNotFoundError, match="fetch them first"):
        readers.load_rates(spark, str(tmp_path / "none.csv"))


def test_many_to_one(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z"), (4, "z")], "k int, w string")
    assert sorted(map(tuple, many_to_one(left, right, ["k"]).collect())) == [(1, "a", "x"), (1, "b", "x"), (2, "c", "y")]
    with pytest.raises(Exception, match="several rows"):
        many_to_one(left, right.withColumn("k", F.least("k", F.lit(3))), ["k"]).collect()


def test_public_context_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("d,v\n2024-01-01,1.5\nbad,2\n2024-01-03,x\n")
    rows = readers.public_context_csv(spark, str(tmp_path / "c.csv"), "d", "v", "n", "s", 2).collect()
    assert [(r["available_at"], r["value"]) for r in rows] == [(dt.date(2024, 1, 3), 1.5)]


def test_text_library_checks(spark):
    one = {"signal": "a", "scenario": "s", "direction": "d", "speed": "fast", "push_title": "{currency}", "push_body": "x {effect_pct}%"}
    assert readers.text_library(spark, [one], ["bad"], {"a"}).count() == 1
    for change in ({"push_body": "{other}"}, {"speed": "slowish"}, {"push_body": "a Bad word"}):
        with pytest.raises(ValueError):
            readers.text_library(spark, [{**one, **change}], ["bad"])
    with pytest.raises(ValueError):
        readers.text_library(spark, [one, one])
    with pytest.raises(ValueError):
        readers.text_library(spark, [one], required={"b"})


def test_scalars(spark):
    row = spark.range(1).select(cross_rate(F.lit(80.0), F.lit(10.0)).alias("x"), series_name(F.lit(" A b--C ")).alias("n"), message(F.lit("{currency} {effect_pct}%"), F.lit("TJS"), F.lit(0.01234)).alias("m"), message(F.lit("{effect_pct}"), F.lit("T"), F.lit(None).cast("double")).alias("e")).first()
    assert (row["x"], row["n"], row["m"], row["e"]) == (8.0, "a_b_c", "TJS 1.23%", "—")


def test_upsert_and_markdown(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1.5)], "k int, v string, w double")
    out = sinks.upsert(old, new, ["k"])
    assert sorted((r["k"], r["v"], r["w"]) for r in out.collect()) == [(1, "a", None), (2, "c", 1.5)]
    assert sinks.markdown(out.orderBy("k")).splitlines()[-1] == "| 2 | c | 1.500 |"


def test_manifest_digests_the_files(spark, tmp_path):
    table = str(tmp_path / "table")
    sinks.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1), table, "csv")
    df = spark.read.option("header", True).csv(table)
    found = sinks.manifest(df, table, str(tmp_path / "m.json"), url="u")
    file = next(tmp_path.glob("table/part-*.csv"))
    listed = {f["file"]: f["sha256"] for f in json.loads((tmp_path / "m.json").read_text())["files"]}
    assert listed[file.name] == hashlib.sha256(file.read_bytes()).hexdigest() and found["rows"] == 2 and found["columns"] == ["k", "v"]


def test_stream_policy_matches_batch(spark, tmp_path):
    from tarnlight.operators.policy import calendar_policy
    from tarnlight.streaming.policy import stream_policy

    df = spark.createDataFrame([("A", d, True) for d in days(30)], "currency string, effective_date date, candidate boolean")
    df.filter("effective_date < '2024-01-15'").coalesce(1).write.parquet(str(tmp_path / "in/1"))
    df.filter("effective_date >= '2024-01-15'").coalesce(1).write.parquet(str(tmp_path / "in/2"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stream_policy(source).writeStream.format("memory").queryName("sent").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["effective_date"] for r in spark.table("sent").filter("policy_signal").collect()}
    assert got == {r["effective_date"] for r in calendar_policy(df, "candidate").filter("policy_signal").collect()}
