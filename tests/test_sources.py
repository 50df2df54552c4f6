from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from domain import rows
from pyspark.sql import functions as F

from checks import binding
from holdfast import schemas
from holdfast.functions import columns as C
from holdfast.operators.writeback import fill_missing
from holdfast.sources import csv, tables

AT = dt.datetime(2025, 9, 28, 2)


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "customers"
    path.mkdir()
    (path / "part.csv").write_text(
        "customer_id,first_name,last_name,age,city\n"
        'C1,  Asha  ,"Rao, K",NULL,\n'
        'C2,NULL,"says ""hi""",41,""\n'
    )
    schema = type(schemas.CUSTOMERS)([schemas.CUSTOMERS[c] for c in ("customer_id", "first_name", "last_name", "age", "city")])
    found = [tuple(r) for r in csv.read_csv(spark, str(path), schema).orderBy("customer_id").collect()]
    assert found == [("C1", "Asha", "Rao, K", None, None), ("C2", None, 'says "hi"', 41, None)]


def test_bad_number_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("customer_id,age\nC1,old\n")
    schema = type(schemas.CUSTOMERS)([schemas.CUSTOMERS["customer_id"], schemas.CUSTOMERS["age"]])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        csv.read_csv(spark, str(tmp_path / "x.csv"), schema).collect()


def test_defaults_only_for_absent_columns(spark, tmp_path):
    listed = ["policy_id", "customer_id", "product_type", "premium_amount", "start_date", "end_date", "status"]
    csv.write_csv(rows(spark, "policies", {"customer_id": "C1", "status": None}), str(tmp_path / "csv"), listed)
    store = tables.Tables(spark, str(tmp_path / "store"))
    row = tables.load(store, "policies", str(tmp_path / "csv"), AT, columns=listed).first()
    assert row.status is None
    assert (row.payment_frequency, row.ncb_percentage, row.auto_renew, row.created_at) == ("Annual", 0, True, AT)


def test_ordered_load_reports_orphans(spark, tmp_path):
    frames = {
        "customers": rows(spark, "customers", {"customer_id": "C1"}),
        "policies": rows(spark, "policies", {"policy_id": "P1", "customer_id": "C1"}, {"policy_id": "P2", "customer_id": "C9"}),
    }
    paths = {}
    for name, df in frames.items():
        paths[name] = str(tmp_path / name)
        csv.write_csv(df, paths[name], [c for c in df.columns if c != "created_at"])
    report = tables.load_all(tables.Tables(spark, str(tmp_path / "store")), paths, AT).collect()
    assert [(r.check, r.actual, r.passed) for r in report] == [("orphans policies.customer_id", 1, False)]


def test_versions(spark, tmp_path):
    store = tables.Tables(spark, str(tmp_path))
    assert not store.exists("t")
    store.append("t", spark.range(3))
    store.append("t", spark.range(3, 5).coalesce(1))
    assert store.read("t").count() == 5
    store.replace("t", store.read("t").filter("id > 2"))
    assert sorted(r.id for r in store.read("t").collect()) == [3, 4]
    (tmp_path / "t" / "v000009").mkdir()  # an unfinished version does not count
    assert store.read("t").count() == 2


def test_fill_missing_leaves_known_values(spark):
    target = spark.createDataFrame([(1, None, None), (2, 0.3, None), (3, None, "old")], "id int, s double, t string")
    source = spark.createDataFrame([(1, 0.1, "a"), (2, 0.2, "b")], "id int, s double, t string")
    found = {r.id: (r.s, r.t) for r in fill_missing(target, source, "id", ["s", "t"], "s").collect()}
    assert found == {1: (0.1, "a"), 2: (0.3, None), 3: (None, "old")}


def test_small_helpers(spark):
    df = spark.createDataFrame([("A", 0.125, 1234567)], "k string, p double, n bigint")
    row = df.select(
        C.map_value("k", {"A": 1}, 9).alias("mapped"),
        C.map_value("k", {"B": 1}, 9).alias("other"),
        C.number_text(F.lit(-0.5), 2).alias("half"),
        C.number_text(F.lit(-1.0), 2).alias("one"),
        C.number_text(F.lit(0.285), 2).alias("up"),
        C.thousands("n").alias("grouped"),
        C.percent("p").alias("pct"),
        C.numbered_id("NBA", F.lit(123456)).alias("wide"),
        C.known_or(F.lit(None).cast("string"), ["x"], "d").alias("known"),
        C.split_items(F.lit("a [+5pts] |  | b: c")).alias("items"),
    ).first()
    assert tuple(row) == (1, 9, "-0.5", "-1", "0.29", "1,234,567", "12%", "NBA123456", "d", ["a [+5pts]", "b: c"])


def test_empty_selection_keeps_everything(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    assert C.multi_filter(df, {"s": []}).count() == 2
    assert C.multi_filter(df, {"s": ["a"]}).count() == 1


def test_lines_are_worked_out_before_they_are_joined(spark, tmp_path):
    lines = [(1, 5, 6, 1, 30.0, 100.25, 0.08, 0.07, "R", "F"), (1, 5, 6, 2, 3.0, 100.25, 0.08, 0.07, "N", "O"), (2, 5, 6, 1, 41.0, 9.999, 0.0, 0.0, "N", "O")]
    lines += [(2, 5, 7, 2, 2.0, 50.0, 0.08, 0.06, "A", "F"), (3, 5, 7, 2, 2.0, None, None, 0.07, "A", "F"), (9, 5, 7, 2, 2.0, 1.0, 0.0, 0.0, "A", "F")]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    shipped = F.lit("2001-05-03 00:00:00").cast("timestamp_ntz").alias("l_shipdate")
    spark.createDataFrame(lines, names).select("*", shipped).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 10), (2, 20), (3, None)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    day, day_after = dt.date(2001, 5, 3), dt.date(2001, 6, 2)
    claims = sorted(tuple(r) for r in binding.claims(spark, str(tmp_path)).collect())
    assert claims == [
        ("1-1-5-6-30", 1, 10, day, Decimal("100.25"), None, "Rejected", "RF", day_after, "quantity 30"),
        ("2-1-5-6-41", 2, 20, day, Decimal("10.00"), None, "Pending", "NO", None, None),
    ]
    paid = binding.payments(spark, str(tmp_path))
    assert sorted((r.payment_id, r.customer_id, r.due_date, r.paid_date, r.amount, r.status, r.late_fee) for r in paid.collect()) == [
        ("1-2-5-6-3", 10, day, None, Decimal("100.25"), "Overdue", Decimal("5.01")),
        ("2-2-5-7-2", 20, day, day, Decimal("50.00"), "Paid", Decimal("0.00")),
        ("3-2-5-7-2", None, day, day, None, "Paid", Decimal("0.00")),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = binding.payments(spark, str(tmp_path)).groupBy("customer_id").agg(F.sum("late_fee"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    over_join = plan[: plan.index("Join Inner")]
    assert not any(c in over_join for c in ("l_tax", "l_discount", "l_extendedprice"))
