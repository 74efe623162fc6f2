"""Sheets without a trusted header."""

import math

import pytest

from alphaloom.sources import sheets, tables


def _csv(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_header_is_found(spark, tmp_path):
    path = _csv(tmp_path / "s.csv", ["Report,,,", "as of,2020-01-01,,", " Ticker ,Name,GICS Sector,", "brk/b US Equity,B,Financials,x", "a,A,Tech,", "None (2 securities),,,"])
    out = sheets.sector_map(sheets.headerless(spark, path))
    assert out.columns == ["ticker", "company_name", "sector"] and out.count() == 3
    assert sorted((r["ticker"], r["sector"]) for r in tables.universe(out).collect()) == [("A", "Tech"), ("BRK.B", "Financials")]
    with pytest.raises(ValueError, match="header"):
        sheets.find_header(sheets.headerless(spark, path), "isin")


def test_date_and_price(spark, tmp_path):
    path = _csv(tmp_path / "p.csv", ["Index,Dates,Last", "1,2020-01-02,10.5", ",01/03/2020,11", "x,2020-01-03,11", "x,no date,12", "x,2020-01-06,"])
    got = sheets.date_and_price(sheets.headerless(spark, path)).orderBy("date").collect()
    assert [(str(r["date"]), r["price"]) for r in got] == [("2020-01-02", 10.5), ("2020-01-03", 11.0)]
    for lines, word in ((["2020-01-02,1", "2020-01-02,2"], "1 with two"), (["2020-01-02,1", "2020-01-03,2", "2020-01-04,-1"], "1 dates with prices"), (["a,1"], "no date")):
        with pytest.raises(ValueError, match=word):
            sheets.date_and_price(sheets.headerless(spark, _csv(tmp_path / "q.csv", lines)))


def test_sector_indices(spark):
    rows = [(s, f"2020-01-0{k}", p * k) for s, p in (("A", 1.0), ("B", 1.0), ("C", 2.0)) for k in (1, 2, 3)]
    df = spark.createDataFrame([*rows, ("D", "2021-01-01", 1.0)], "sector string, date string, price double")
    out = {(r["sector"], r["date"]): (r["index_return"], r["index_momentum"]) for r in sheets.sector_indices(df, 2).collect()}
    assert out["A", "2020-01-01"] == (None, None) and out["A", "2020-01-02"][1] is None and math.isclose(out["A", "2020-01-03"][1], math.log(3))
    assert [sheets.same_index(df, "A", x) for x in ("B", "C", "D", "E")] == [True, False, False, None]
