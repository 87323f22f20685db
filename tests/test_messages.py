import json

from pyspark.sql import functions as F

from tapeworks import schemas
from tapeworks.functions import times
from tapeworks.sources import kafka, messages, responses


def sent(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def envelope(**inner):
    return json.dumps({"Content": json.dumps(inner), "DataType": "X"})


def test_envelopes(spark):
    batch = sent(
        spark, envelope(Symbol="VCB", LastPrice="1.5", LastVol=2, TradingDate="5/1/2025"),
        json.dumps({"Content": "no json"}), json.dumps({"Other": 1}), "no json", json.dumps({"Content": "[1]"}),
        json.dumps({"Content": '{"Symbol":"A"} tail'}),
    )
    decoded = messages.decode_envelopes(batch, schemas.CHANNELS["trade"])
    good = messages.good(decoded).collect()
    assert len(good) == 1
    assert (good[0].symbol, good[0].last_price, good[0].last_vol, str(good[0].trading_date)) == ("VCB", 1.5, 2.0, "2025-01-05")
    assert good[0].ceiling is None
    reasons = [r.reject_reason for r in messages.quarantine(decoded).collect()]
    assert sorted(reasons) == ["content is not a JSON object"] * 3 + ["no content"] * 2


def test_status_date_is_read(spark):
    batch = sent(spark, envelope(Symbol="A", TradingDate="05/01/2025"))
    row = messages.good(messages.decode_envelopes(batch, schemas.CHANNELS["status"])).first()
    assert str(row.trading_date) == "2025-01-05"


def test_one_parse_per_message(spark):
    decoded = messages.good(messages.decode_envelopes(sent(spark, "x").repartition(1), schemas.CHANNELS["quote"]))
    assert decoded._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_ticks(spark):
    batch = sent(
        spark, '{"symbol":"BTC","price":68000.5,"volume":0.02,"timestamp":1710000000000}',
        '{"symbol":"A","price":"1.5","timestamp":"12"}', '{"price":1}', '{"symbol":"A","price":"x"}', "[1]",
        '{"symbol":"A","timestamp":9000000000000000000}',
    )
    decoded = messages.decode_ticks(batch)
    got = [(r.symbol, r.price, r.volume, r.timestamp) for r in messages.good(decoded).collect()]
    assert got == [("BTC", 68000.5, 0.02, 1710000000000), ("A", 1.5, 0.0, 12)]
    assert [r.reject_reason for r in messages.quarantine(decoded).collect()] == [
        "no symbol", "bad number", "not a JSON object", "bad number"]


def test_routing(spark):
    batch = spark.createDataFrame([("B:ALL", "a"), ("ZZ", "b"), ("X-TRADE:ALL", "c")], "channel string, value string")
    routed, unknown = kafka.route(batch)
    assert sorted((r.topic, r.value) for r in routed.collect()) == [("bars", "a"), ("market_data_trade", "c")]
    assert unknown.count() == 1


def test_kafka_options():
    options = kafka.reader_options("host:9092", "market_data_trade", group="chart-group")
    assert options["startingOffsets"] == "earliest" and "maxOffsetsPerTrigger" not in options
    assert kafka.reader_options("h", "t", max_messages=50_000)["maxOffsetsPerTrigger"] == "50000"
    assert kafka.reader_options("h", "t", start="latest", max_messages=None) == {
        "kafka.bootstrap.servers": "h", "subscribe": "t", "startingOffsets": "latest"}


def test_reject_rules(spark):
    fields = schemas.DAILY_INDEX
    blank = dict.fromkeys(wire for wire, _, _ in fields)
    given = [{"IndexId": " VN30 ", "TradingDate": " 1/9/2025", "Change": "", "TotalVal": "7"}, {"TradingDate": "1/9/2025"},
             {"IndexId": "X", "TradingDate": "2025-09-01"}, {"IndexId": "Y", "TradingDate": ""}]
    schema = ", ".join(f"{wire} string" for wire, _, _ in fields)
    raw = spark.createDataFrame([tuple({**blank, **g}.values()) for g in given], schema)
    loaded = responses.load_rows(raw, fields, "IndexId")
    assert [r.reject_reason for r in loaded.collect()] == [None, "no code", "bad date", None]
    first, last = responses.accepted(loaded).collect()
    assert (first.indexlist_id, str(first.trading_date), first.change, first.total_val) == ("VN30", "2025-09-01", None, 7.0)
    assert last.trading_date is None


def test_response_forms(spark):
    record = [{"a": 1}]
    bodies = [record, {"dataList": record}, {"dataList": [], "data": record}, {"data": {"dataList": record}},
              {"RepeatedInfo": record}, {"dataList": []}, {"data": None}, {}, []]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    got = responses.response_rows(df, "body", "a int", "i").collect()
    assert [(r.i, r.a) for r in got] == [(i, 1) for i in range(5)]


def test_html_table(spark):
    page = """<table><tbody><tr class="x"><td> 1 </td><td><b>VCB</b>
    </td><td>A &amp; B</td></tr><tr><td>only</td><td>two</td></tr><tr><td>2</td><td>ACB</td><td>c</td><td>more</td></tr></tbody></table>"""
    df = spark.createDataFrame([(page,)], "html string")
    got = responses.html_rows(df, "html", ["no", "symbol", "name"], "tr", "td").collect()
    assert [tuple(r) for r in got] == [(0, "1", "VCB", "A & B"), (2, "2", "ACB", "c")]


def test_html_rows_of_one_container(spark):
    page = "<TABLE><TR><TD>a</TD></TR></TABLE><tbody id='x'><tr><td>b</td></tr></tbody><tbody><tr><td>c</td></tr></tbody>"
    df = spark.createDataFrame([(page,)], "html string")
    rows = lambda **given: [r.x for r in responses.html_rows(df, "html", ["x"], "tr", "td", **given).collect()]
    assert rows() == ["a", "b", "c"] and rows(container="tbody") == ["b"]


def test_dates_of_implausible_years_are_missing(spark):
    df = spark.createDataFrame([("01/02/2025",), ("1/2/0001",), ("1/2/9999",), ("31/12/2199",)], "d string")
    got = [str(r[0]) for r in df.select(times.trading_date(F.col("d"))).collect()]
    assert got == ["2025-02-01", "None", "None", "2199-12-31"]


def test_sector_headers(spark):
    for header in ("Sector", "Brand"):
        df = spark.createDataFrame([(" Bank ", "VCB ", "HOSE")], f"{header} string, Symbol string, Market string")
        assert tuple(responses.load_sectors(df).first()) == ("Bank", "VCB", "HOSE")


def test_trades_as_ticks(spark):
    batch = sent(spark, envelope(Symbol=" A ", LastPrice=2, LastVol=3, TradingDate="01/02/2025", Time="09:30:00"))
    ticks = messages.trades_as_ticks(messages.good(messages.decode_envelopes(batch, schemas.CHANNELS["trade"])))
    row = ticks.select("symbol", "price", "volume", F.col("event_ts").cast("string")).first()
    assert tuple(row) == ("A", 2.0, 3.0, "2025-02-01 09:30:00")


def test_wire_dates(spark):
    texts = ["5/1/2025", " 05/01/2025 ", "31/02/2025", "29/2/2024", "0/1/2025", "1/13/2025", "1/1/1899", "1/1/2200", "", None, "1-1-2025"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(times.trading_date(F.col("t")).alias("d"))
    assert [r.d and str(r.d) for r in rows.collect()] == ["2025-01-05", "2025-01-05", None, "2024-02-29"] + [None] * 7
