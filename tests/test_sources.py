"""Readers, writers and the stream of overrides."""

from datetime import date

from pyspark.sql import functions as F

from leasegrid.operators import ledger
from leasegrid.plans import queries, sinks
from leasegrid.sources import tables
from leasegrid.sources.portfolio import Portfolio
from leasegrid.streaming.changes import keep_ledger

D = date.fromisoformat


def test_csv_with_loose_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Lease Start,Expiration,Monthly Base Rent\n45000,2024-03-14,1000\n3/15/24,03/14/2025,\n\nsoon,2025-01-01,5\n2024-01-01,2024-02-01,\"$1,000\"\n")
    periods, warnings = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.period_start, r.period_end, r.monthly_rent) for r in periods.collect()] == [(D("2023-03-15"), D("2024-03-14"), 1000.0), (D("2024-03-15"), D("2025-03-14"), 0.0)]
    assert warnings.count() == 2


def test_csv_rows_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("from,to,rent\n1/1/30,12/31/30,5,extra\n1/1/31,12/31/31\n1/1/32,12/31/32,7\n")
    periods, warnings = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(r.monthly_rent for r in periods.collect()) == [0.0, 5.0, 7.0]
    assert [r.message for r in warnings.collect()] == ["row has another number of fields than the header"] * 2


def test_header_detection():
    assert tables.detect_columns(["From", "To", "Rent"]) == {"period_start": "From", "period_end": "To", "monthly_rent": "Rent"}
    assert tables.detect_columns(["x"]) == {"period_start": None, "period_end": None, "monthly_rent": None}


def test_extraction_json(spark):
    body = '{"rentSchedule": [{"periodStart": "1/1/30", "periodEnd": "12/31/30", "monthlyRent": 5}], "cams": {"year1": 3}, "other": 1}'
    docs = spark.createDataFrame([(1, f"```json\n{body}\n```"), (2, "no json"), (3, None)], "doc_id int, payload string")
    assert [tuple(r) for r in tables.extracted_periods(docs).collect()] == [(1, 0, D("2030-01-01"), D("2030-12-31"), 5.0)]


def test_files_and_usable_text(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"plain text")
    (tmp_path / "b.pdf").write_bytes(bytes([0, 1, 200]) * 100)
    assert sorted((r.ext, r.scanned) for r in tables.files(spark, str(tmp_path)).collect()) == [("pdf", True), ("txt", False)]
    docs = spark.createDataFrame([("word " * 30,), ("1 " * 90,), (None,)], "t string")
    assert [r[0] for r in docs.select(tables.usable(F.col("t"))).collect()] == [True, False, False]


def test_workbook_and_stream(spark, tmp_path):
    p = Portfolio(spark, "/root/testdata/sf0.001")
    few = lambda df: df.where("lease_id < 20")
    x = queries.inputs(p)
    x = ledger.Inputs(few(x.leases), few(x.months), few(x.charges), few(x.concessions), few(x.overrides), few(x.one_time))
    sinks.write_workbook(x, str(tmp_path / "book"))
    sheets = {n: spark.read.parquet(str(tmp_path / "book" / n)).count() for n in ("lease_schedule", "annual_summary", "audit_trail", "renegotiation", "exit")}
    assert sheets["lease_schedule"] == sheets["audit_trail"] and sheets["renegotiation"] == 4 * 20 and sheets["exit"] == 5 * 20
    sinks.write_csv(spark.read.parquet(str(tmp_path / "book" / "lease_schedule")).select("lease_id", "month_num"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == sheets["lease_schedule"]

    events = spark.createDataFrame([(3, 0, "base_rent", D("1990-01-01"), 77.0)], "lease_id long, ord int, target_key string, effective_date date, amount double")
    events.write.parquet(str(tmp_path / "in"))
    query = keep_ledger(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), x, str(tmp_path / "overrides"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("lease_id", "scheduled_base_rent").distinct().collect()
    assert [tuple(r) for r in got] == [(3, 77.0)]
