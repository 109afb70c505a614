"""Reading and writing files."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfcast import schema as s
from shelfcast.operators.cleaning import parse_bill_date
from shelfcast.session import materialize, shared_dir
from shelfcast.sources import files
from shelfcast.sources import sales as io

ROWS = [("R", "S", "P", "2024-01-05 10:00", 2.0, 50.0, 1.0), ("R", "S", "Q", "2024-02-01", float("nan"), 70.0, -0.0)]


def test_parquet_round_trip(spark, make_sales, tmp_path):
    path = str(tmp_path / "sales")
    make_sales(ROWS).write.parquet(path)
    back = io.read_sales(spark, path)
    assert back.columns == s.SALES_SCHEMA.fieldNames()
    rows = {r.ProductName: r for r in back.collect()}
    assert rows["Q"].Quantity is None and str(rows["Q"].ProductLevelDiscAmount) == "0.0"


def test_csv_keeps_good_rows(spark, tmp_path):
    header = ",".join(("Extra", *s.REQUIRED))
    lines = ["x,R,S,P,2024-01-05,2,50,1", "y,R,S,P,soon,2,50,1"]
    (tmp_path / "sales.csv").write_text("\n".join([header, *lines]))
    path = str(tmp_path / "sales.csv")
    assert io.read_header(spark, path, fmt="csv")[0] == "Extra"
    sales = io.read_sales(spark, path, fmt="csv")
    assert sales.columns == list(s.REQUIRED)
    good = parse_bill_date(sales).collect()
    assert [(r.BillDate, r.Quantity) for r in good] == [(datetime.datetime(2024, 1, 5), 2.0)]


def test_history_reads_few_columns(spark, make_sales, tmp_path):
    path = str(tmp_path / "sales")
    make_sales(ROWS).drop(s.EMI_RAW).write.parquet(path)
    history = io.read_history(spark, path)
    assert s.MRP not in history.columns and s.EMI_RAW not in history.columns and s.TRUE_DEMAND_RAW in history.columns
    plan = history._jdf.queryExecution().executedPlan().toString()
    assert "ProductLevelDiscAmount" not in plan


def test_missing_columns(make_sales):
    assert s.missing_columns(make_sales(ROWS).drop("MRP", "Quantity")) == ["Quantity", "MRP"]
    with pytest.raises(ValueError, match="Quantity, MRP"):
        s.require_columns(make_sales(ROWS).drop("MRP", "Quantity"))


def test_side_tables_that_exist(spark, tmp_path):
    path = str(tmp_path / "bank")
    row = (datetime.date(2024, 1, 1), 2024, 1, 1.0, 2.0)
    spark.createDataFrame([row], s.SIDE_TABLES["bank_offers"]).write.parquet(path)
    found = io.read_side_tables(spark, {"bank_offers": path, "weather": str(tmp_path / "none")})
    assert list(found) == ["bank_offers"] and found["bank_offers"].count() == 1


def test_side_tables_by_name(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("Year,Extra,Week,Date,Card_Promotion_Level,Bank_Offer_Intensity\n2024,x,1,2024-01-07,7.0,3.0\n")
    (tmp_path / "discounts.csv").write_text("Date,Year,Week,Store_Discount_Level\n2024-01-07,2024,1,0.5\n")
    paths = {"bank_offers": str(tmp_path / "bank.csv"), "custom_discounts": str(tmp_path / "discounts.csv")}
    found = io.read_side_tables(spark, paths, fmt="csv")
    assert list(found) == ["bank_offers"]
    assert found["bank_offers"].first() == (datetime.date(2024, 1, 7), 2024, 1, 3.0, 7.0)
    swapped = spark.sql("SELECT '2.5' AS Card_Promotion_Level, 1L AS Week, 2024 AS Year, DATE'2024-01-07' AS Date, 4 AS Bank_Offer_Intensity")
    swapped.write.parquet(str(tmp_path / "bank"))
    swapped.drop("Week").write.parquet(str(tmp_path / "short"))
    found = io.read_side_tables(spark, {"bank_offers": str(tmp_path / "bank")})
    assert found["bank_offers"].first() == (datetime.date(2024, 1, 7), 2024, 1, 4.0, 2.5)
    assert not io.read_side_tables(spark, {"bank_offers": str(tmp_path / "short")})


def test_parquet_types_are_cast(spark, make_sales, tmp_path):
    path = str(tmp_path / "typed")
    make_sales(ROWS).withColumn("Quantity", F.lit("3").cast("string")).write.parquet(path)
    back = io.read_sales(spark, path)
    assert back.schema == s.SALES_SCHEMA and {r.Quantity for r in back.collect()} == {3.0}


def test_snapshot_and_reports(spark, make_sales, tmp_path):
    when = datetime.datetime(2024, 5, 6, 7, 8, 9)
    path = io.write_snapshot(make_sales(ROWS), str(tmp_path), when=when)
    assert path.endswith("/training_uploads/run=20240506_070809") and spark.read.parquet(path).count() == 2
    report = spark.createDataFrame([("A", "p, big", 3), ("B", "q", 4)], "Store string, Product string, Units int")
    io.write_report_csv(report, str(tmp_path / "csv"), by="Store")
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("Store")
    assert [(r.Store, r.Product, r.Units) for r in back.collect()] == [("A", "p, big", "3"), ("B", "q", "4")]
    io.write_report_csv(report, str(tmp_path / "one"))
    assert spark.read.option("header", True).csv(str(tmp_path / "one")).count() == 2


def test_pointer_is_replaced(spark, tmp_path):
    path = str(tmp_path / "CURRENT")
    assert files.read_pointer(spark, path) is None
    for text in ("first", "second version"):
        files.write_pointer(spark, path, text)
        assert files.read_pointer(spark, path) == text


def test_intermediate_tables_live_in_the_shared_folder(spark):
    table = materialize(spark.range(5).toDF("n"), "numbers")
    assert table.count() == 5
    assert shared_dir(spark) in table.inputFiles()[0]
