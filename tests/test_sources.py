import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bindings import queries
from tradeloom.materialize import materialize, new_path, release, released
from tradeloom.plans.staging import stage
from tradeloom.schemas import RAW_SCHEMAS
from tradeloom.sources import footers, versions, writers
from tradeloom.sources.readers import read_raw, read_table, read_warehouse
from tradeloom.sources.writers import export_csv, export_json, verify_write, write_table, write_warehouse


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_columns_by_name_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path / "prd.csv", 'prd_nm,prd_id,prd_key,prd_cost,prd_line,prd_start_dt,prd_end_dt\n'
                 '"say ""hi"", you",1,K1,NA,R ,2011-07-01,\n,2,K2,7.5,nan,2011-07-01,2012-01-01\n')
    rows = read_raw(spark, path, RAW_SCHEMAS["prd"]).orderBy("prd_id").collect()
    assert [r.prd_nm for r in rows] == ['say "hi", you', None]
    assert [r.prd_cost for r in rows] == [None, 7.5]
    assert [r.prd_line for r in rows] == ["R ", None]


@pytest.mark.parametrize("line", ["1,K,n,notanumber,R,d,d", "1,K,n,1.0"])
def test_bad_csv_stops_the_job(spark, tmp_path, line):
    path = write(tmp_path / "prd.csv", "prd_id,prd_key,prd_nm,prd_cost,prd_line,prd_start_dt,prd_end_dt\n" + line + "\n")
    with pytest.raises(Exception):
        read_raw(spark, path, RAW_SCHEMAS["prd"]).collect()


def test_a_file_with_another_header_stops_the_job(spark, tmp_path):
    write(tmp_path / "loc" / "a.csv", "CID,CNTRY\nA1,DE\n")
    assert read_raw(spark, str(tmp_path / "loc"), RAW_SCHEMAS["loc"]).collect() == [("A1", "DE")]
    write(tmp_path / "loc" / "b.csv", "CNTRY,CID\nFR,A2\n")
    with pytest.raises(Exception, match="header"):
        read_raw(spark, str(tmp_path / "loc"), RAW_SCHEMAS["loc"], row_order="_row").collect()


def test_csv_keeps_outer_spaces(spark, tmp_path):
    df = spark.createDataFrame([(" a ", 'say "x", y'), ("b", None)], "CID string, CNTRY string")
    export_csv(df, str(tmp_path / "out"))
    assert sorted(read_raw(spark, str(tmp_path / "out"), RAW_SCHEMAS["loc"]).collect()) == sorted(df.collect())


def test_row_order_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "a folder"
    for name, start in (("b.csv", 3000), ("a.csv", 0), ("c.csv", 4000)):
        count = 3000 if name == "a.csv" else 1000
        write(folder / name, "n\n" + "".join(f"{i}\n" for i in range(start, start + count)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    try:
        raw = read_raw(spark, str(folder), {"n": "bigint"}, row_order="_row")
        assert raw.rdd.getNumPartitions() > 3
        write_table(raw, str(tmp_path / "raw"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "raw")).orderBy("_row").collect()] == list(range(5000))


def test_stage_replaces_tables(spark, tmp_path):
    files = {"cat": write(tmp_path / "cat.csv", "ID,CAT,SUBCAT,MAINTENANCE\nAC_HE,Accessories,Helmets,Yes\n"),
             "loc": write(tmp_path / "loc.csv", "CID,CNTRY\nAW-1,NA\nAW-2,DE\n")}
    for _ in range(2):
        stored = stage(spark, files, str(tmp_path / "raw"))
    assert stored["cat"].drop("_cat_row").collect() == [("AC_HE", "Accessories", "Helmets", "Yes")]
    assert [tuple(r) for r in stored["loc"].orderBy("_loc_row").select("CID", "CNTRY").collect()] == [
        ("AW-1", None), ("AW-2", "DE")]


SALES = [(1, dt.date(2023, 1, 5)), (2, dt.date(2023, 2, 7)), (3, dt.date(2023, 2, 9)), (4, dt.date(2023, 3, 1))]


def test_warehouse_round_trip_prunes_months(spark, tmp_path):
    target = str(tmp_path / "warehouse")
    df = spark.createDataFrame(SALES, "n int, order_date date")
    write_warehouse(df, target)
    assert verify_write(spark, target, 4).count() == 4
    with pytest.raises(RuntimeError, match="holds 4 rows"):
        verify_write(spark, target, 5)
    assert read_warehouse(spark, target).columns == ["n", "order_date"]
    part = read_warehouse(spark, target, "2023-02-08", "2023-02-28")
    assert [r.n for r in part.collect()] == [3]
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "order_month" in filters
    write_warehouse(df.limit(1), target)
    assert read_warehouse(spark, target).count() == 1
    with pytest.raises(ValueError):
        write_warehouse(df, target, "jdbc")


def test_catalog_table(spark, tmp_path):
    df = spark.createDataFrame(SALES, "n int, order_date date")
    write_table(df, "tradeloom_sales", "table", path=str(tmp_path / "managed"))
    assert read_table(spark, "tradeloom_sales", "table").count() == 4
    spark.sql("DROP TABLE tradeloom_sales")


def test_exports_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame([*SALES, (None, None)], "n int, order_date date").repartition(3)
    export_csv(df, str(tmp_path / "csv"))
    export_json(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    lines = [line for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert '{"n":1,"order_date":"2023-01-05"}' in lines and '{"n":null,"order_date":null}' in lines


def test_a_block_releases_only_what_it_stored(spark):
    outer = materialize(spark.range(3))
    with pytest.raises(ValueError), released(spark):
        inner = materialize(spark.range(4))
        with released(spark):
            innermost = materialize(inner)
        with pytest.raises(Exception):
            innermost.collect()
        assert inner.count() == 4
        raise ValueError
    with pytest.raises(Exception):
        inner.collect()
    assert outer.count() == 3 and materialize(spark.range(2)).count() == 2


def test_materialize_keeps_schema_and_can_be_released(spark):
    df = spark.range(5).select(F.col("id").cast("decimal(18,2)").alias("d"), F.struct("id").alias("s"))
    stored = materialize(df)
    assert stored.dtypes == df.dtypes and stored.count() == 5
    release(spark)
    with pytest.raises(Exception):
        stored.collect()


def test_a_failed_replace_leaves_the_old_rows(spark):
    root = new_path(spark)
    first = versions.replace(spark.range(10).toDF("a"), root)
    assert (first["version"], first["rows"]) == (1, 10)
    broken = spark.range(0, 1000, 1, 8).selectExpr("if(id = 997, raise_error('lost'), id) as a")
    with pytest.raises(Exception, match="lost"):
        versions.replace(broken, root)
    assert versions.read(spark, root).count() == 10 and versions.versions(spark, root) == [1]
    with pytest.raises(RuntimeError, match="expected 4"):
        versions.replace(spark.range(3).toDF("a"), root, check=versions.expect_rows(4))
    assert versions.read(spark, root).count() == 10
    own = versions.read(spark, root).where("a < 6")  # a table may be replaced by what is read from it
    assert versions.replace(own, root) == {"version": 2, "rows": 6}
    assert versions.read(spark, root).count() == 6 and versions.read(spark, root, 1).count() == 10
    versions.replace(spark.range(1).toDF("a"), root)
    assert versions.versions(spark, root) == [2, 3]
    folders = [p for p in Path(root.removeprefix("file://").removeprefix("file:")).iterdir() if p.name.startswith("data-")]
    assert len(folders) == 2  # versions that expired and jobs that failed leave nothing
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, 1)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, new_path(spark))


def test_of_two_writers_of_a_version_the_second_stops(spark):
    root = new_path(spark)
    versions.replace(spark.range(2).toDF("a"), root)
    versions._commit(spark, root, 2, "data-0000000002-other")
    with pytest.raises(versions.VersionConflict):
        versions._commit(spark, root, 2, "data-0000000002-mine")


def test_a_write_counts_its_rows_and_nulls_without_a_second_read(spark):
    rows = spark.range(0, 100, 1, 7).selectExpr("id as a", "if(id % 4 = 0, null, id) as b", "cast(null as string) as `c.d`")
    root = new_path(spark)
    found = versions.replace(rows.repartition(3), root, metrics=versions.null_metrics(rows))
    assert found == {"version": 1, "rows": 100, "nulls:a": 0, "nulls:b": 25, "nulls:c.d": 100}
    assert versions.replace(rows.limit(0), root, metrics=versions.null_metrics(rows))["rows"] == 0
    assert versions.read(spark, root).count() == 0 and versions.read(spark, root).columns == ["a", "b", "c.d"]


def test_versions_by_month(spark):
    root = new_path(spark)
    rows = spark.range(60).selectExpr("id", "add_months(date'2020-01-01', cast(id % 3 as int)) as m")
    versions.replace(rows.hint("rebalance", "m"), root, partition_by=["m"])
    assert versions.read(spark, root).where("m = date'2020-02-01'").count() == 20


def test_counts_and_bounds_come_from_footers(spark, tmp_path):
    target = str(tmp_path / "w")
    rows = spark.range(100).selectExpr("id", "date_add(date'2020-01-01', cast(id as int)) as order_date", "if(id % 2 = 0, null, id) as b", "'x' as t")
    write_warehouse(rows, target)
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (
        footers.row_count(spark, target), footers.bounds(spark, target, ["order_date", "b"]), footers.folder_counts(spark, target))]
    assert all("PushedAggregation: [" in p and "PushedAggregation: []" not in p for p in plans)
    assert footers.row_count(spark, target).first()[0] == 100
    found = footers.bounds(spark, target, ["order_date", "b"]).first()
    assert tuple(found) == (dt.date(2020, 1, 1), dt.date(2020, 4, 9), 100, 1, 99, 50)
    assert footers.folder_counts(spark, target).orderBy("order_month").first()["records"] == 31
    with pytest.raises(TypeError, match="t string"):
        footers.bounds(spark, target, ["t"])
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session is as it was


def test_compressed_export_is_staged_like_a_plain_one(spark, tmp_path):
    rows = spark.range(300).selectExpr("cast(id as double) as cst_id", "concat('K', id) as cst_key", "'a, \"b\" ' as cst_firstname",
                                       "'x' as cst_lastname", "'M' as cst_marital_status", "'f' as cst_gndr", "'2010-01-01' as cst_create_date")
    found = []
    for name, options in (("plain", {}), ("small", {"compression": "gzip"})):
        writers.export_csv(rows, str(tmp_path / name), **options)
        raw = stage(spark, {"cust_info": str(tmp_path / name)}, str(tmp_path / f"raw_{name}"))["cust_info"]
        found.append(sorted(map(repr, raw.drop("_cust_info_row").collect())))
    assert found[0] == found[1] and len(found[0]) == 300
    assert list((tmp_path / "small").glob("*.csv.gz")) and not list((tmp_path / "small").glob("*.csv"))


def test_bucketed_sales_hold_only_what_the_fact_shows(spark, monkeypatch):
    stored = []
    write = writers.write_bucketed
    monkeypatch.setattr(writers, "write_bucketed", lambda df, *rest: stored.extend(df.columns) or write(df, *rest))
    shown = queries.wide_fact_bucketed(spark, "/root/testdata/sf0.001").columns
    assert stored and {"sls_prd_key": "prd_key", "sls_cust_id": "CID"}.get(stored[1]) in shown
    assert not [c for c in stored if c.startswith("_")]
