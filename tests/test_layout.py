"""Tables from pieces of text on pages."""

from datetime import date

from leasegrid.sources import layout

D = date.fromisoformat
GLYPHS = "doc_id long, page long, x double, y double, ord int, str string"


def test_lines_and_tables(spark):
    rows = [
        (1, 0, 50.0, 700.2, 0, "Lease Start"), (1, 0, 200.0, 699.6, 0, " Lease End"), (1, 0, 300.0, 700.0, 0, "Base Rent"), (1, 0, 250.0, 700.0, 0, "  "),
        (1, 0, 300.0, 680.0, 0, "$1,000.50"), (1, 0, 50.0, 680.4, 0, "1/1/30"), (1, 0, 200.0, 679.5, 0, "12/31/30"), (1, 0, 50.0, 660.0, 0, "total"), (1, 1, 50.0, 700.0, 0, "1/1/31"), (1, 1, 200.0, 700.0, 0, "12/31/31"),
        (2, 0, 10.0, 10.0, 0, "From"), (2, 0, 20.0, 10.0, 0, "Expiry"), (3, 0, 1.0, 1.0, 0, "Start"), (3, 0, 2.0, 1.0, 0, "End"), (3, 0, 3.0, 1.0, 0, "Rent"), (4, 0, 1.0, 1.0, 0, " "),
        (5, 0, 5.0, 9.0, 1, "b"), (5, 0, 5.0, 9.0, 0, "a"),
    ]
    lines = layout.laid_out(spark.createDataFrame(rows, GLYPHS))
    got = {(r.doc_id, r.line): r.cells for r in lines.collect()}
    assert got[1, 1] == ["Lease Start", "Lease End", "Base Rent"] and got[1, 2] == ["1/1/30", "12/31/30", "$1,000.50"] and got[1, 3] == ["total"] and got[1, 4] == ["1/1/31", "12/31/31"] and got[5, 1] == ["a", "b"]
    periods, warnings = layout.rent_tables(lines)
    assert sorted(map(tuple, periods.collect())) == [(1, 2, D("2030-01-01"), D("2030-12-31"), 1000.5), (1, 4, D("2031-01-01"), D("2031-12-31"), 0.0)]
    assert sorted((r.doc_id, r.line) for r in warnings.collect()) == [(1, 3), (2, 0), (3, 0), (5, 0)]
