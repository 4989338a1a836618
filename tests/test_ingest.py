"""CSV loads in batch and as streams."""

import csv
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfscope.operators.filters import FilterSpec
from shelfscope.operators.sinks import append_products, overwrite_batch, write_report
from shelfscope.plans import facts, loading, packs, reports
from shelfscope.plans.loading import write_csv
from shelfscope.registry import SPECS
from shelfscope.schema import COLUMNS, PRODUCTS
from shelfscope.session import scratch_dir
from shelfscope.sources import catalog_csv
from shelfscope.sources.catalog_csv import csv_files, named_files, read_catalog, read_headers
from shelfscope.sources.adhoc import select_json
from shelfscope.streaming import ingest, refresh

RAGGED = """﻿product_id,style_id,title,brand
1,1,A,4711
2,2,short
3,3,long,B,x
4,4,empties,B,,
5,5,"q,uoted",B
6,6,,
7,7,"long, q",B,z
8,8,one empty,B,

   \t
9,9,"a ""q"" \\ b",B
10
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    return tmp_path / "in"


def test_ragged_rows(spark, folder):
    (folder / "a.csv").write_text(RAGGED, encoding="utf-8")
    df = read_catalog(spark, str(folder / "a.csv"))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in PRODUCTS]
    got = {r.product_id: (r.style_id, r.title, r.brand) for r in df.collect()}
    assert got == {
        1: (1, "A", "4711"), 2: (2, "short", None), 5: (5, "q,uoted", "B"), 6: (6, None, None),
        9: (9, 'a "q" \\ b', "B"), 10: (None, None, None),
    }
    # the same rows, however few columns are asked for
    assert df.count() == 6
    assert dict(df.groupBy("brand").count().collect()) == {"4711": 1, None: 3, "B": 2}
    assert df.filter("title IS NOT NULL").count() == 4


def test_binds_by_name_and_ignores_other_files(spark, folder):
    (folder / "a.csv").write_text("brand,product_id,colour,title\r\nX,11,red,NA\r\nnan,12.0,blue,T2\r\n")
    (folder / "b.csv").write_text("product_id,Brand\n13,upper\n")
    (folder / "only_header.csv").write_text("product_id,brand\n")
    (folder / "empty.csv").write_text("")
    (folder / "note.txt").write_text("brand\nY\n")
    (folder / "sub" / "c.csv").write_text("brand\nZ\n")
    rows = read_catalog(spark, csv_files(spark, str(folder))).select("product_id", "brand", "title").collect()
    assert sorted(map(tuple, rows), key=repr) == [(11, "X", None), (13, None, None), (None, None, "T2")]
    file = str(folder / "b.csv")
    assert read_headers(spark, [file]) == {file: ("product_id", "Brand")}
    for name in ("empty.csv", "only_header.csv"):
        nothing = read_catalog(spark, str(folder / name))
        assert nothing.count() == 0 and append_products(nothing, str(folder / "table")) == 0


def test_headers_of_many_files_are_read_in_tasks(spark, folder):
    for i in range(80):
        names = ["product_id", "brand", f"x{i % 3}"]
        (folder / f"{i}.csv").write_text("\ufeff" + ",".join(names[:: 1 if i % 2 else -1]) + f"\r\n{i},{i},{i}\r\n")
    (folder / "empty.csv").write_text("")
    files = [f"file:{folder}/{n}" for n in os.listdir(folder)]
    heads = read_headers(spark, files)
    assert heads[f"file:{folder}/0.csv"] == ("x0", "brand", "product_id")
    assert heads[f"file:{folder}/7.csv"] == ("product_id", "brand", "x1")
    assert heads[f"file:{folder}/empty.csv"] == ()
    rows = read_catalog(spark, files).select("product_id", "brand").collect()
    assert sorted(map(tuple, rows)) == [(i, str(i)) for i in range(80)]


def test_streams_take_new_files_once(spark, folder, tmp_path):
    table, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")

    def drain():
        files = ingest.stream_files(spark, str(folder))
        ingest.start_ingest_by_name(files, table, checkpoint).awaitTermination()
        return sorted(r.product_id for r in spark.read.parquet(table).collect())

    (folder / "a.csv").write_text("brand,product_id\nX,1\n")
    (folder / "note.txt").write_text("brand\nY\n")
    (folder / "sub" / "c.csv").write_text("brand,product_id\nZ,9\n")
    assert drain() == [1]
    assert drain() == [1]
    (folder / "b.csv").write_text("product_id\n2\n3\n")
    assert drain() == [1, 2, 3]


def test_stream_leaves_out_what_was_there_at_its_first_start(spark, folder, tmp_path):
    """By name: an old time stamp is no reason, and what comes while nothing runs is taken."""
    (folder / "old.csv").write_text("product_id\n1\n")
    home, table = str(tmp_path / "home"), str(tmp_path / "t")

    def run():
        known = ingest.record_known(spark, str(folder), f"{home}/known")
        files = ingest.stream_files(spark, str(folder), known=known)
        ingest.start_ingest_by_name(files, table, str(tmp_path / "c")).awaitTermination()

    run()
    (folder / "moved.csv").write_text("product_id\n2\n")
    old = (datetime.now() - timedelta(hours=1)).timestamp()
    os.utime(folder / "moved.csv", (old, old))
    run()
    assert [r.product_id for r in spark.read.parquet(table).collect()] == [2]


def _refresh(spark, folder, tmp_path, specs, known=None):
    files = ingest.stream_files(spark, str(folder), known=known)
    query = refresh.start_refresh(files, specs, str(tmp_path / "home"), str(tmp_path / "c"))
    query.awaitTermination()
    states = (refresh.latest(spark, f"{tmp_path}/home/{n}", query) for n in refresh.pack_states(specs))
    return {r.pack_id: r for r in packs.assemble(*states, specs).collect()}


def test_refresh_survives_batches_without_files(spark, folder, tmp_path):
    (folder / "old.csv").write_text("product_id,brand\n1,X\n")
    known = ingest.record_known(spark, str(folder), str(tmp_path / "known"))
    (folder / "new.csv").write_text("product_id,brand\n2,Y\n")
    late = (datetime.now() + timedelta(hours=1)).timestamp()
    os.utime(folder / "new.csv", (late, late))
    specs = {"all": SPECS["everything"]}
    assert _refresh(spark, folder, tmp_path, specs, known)["all"].kpis.products == 1
    (folder / "newer.csv").write_text("product_id,brand\n3,Z\n4,Z\n")
    os.utime(folder / "newer.csv", (late + 60, late + 60))
    assert _refresh(spark, folder, tmp_path, specs, known)["all"].kpis.products == 3


def test_other_specs_start_from_all_products(spark, folder, tmp_path):
    (folder / "a.csv").write_text("product_id,brand\n1,X\n2,Y\n")
    assert _refresh(spark, folder, tmp_path, {"pack": FilterSpec(brands=["X"])})["pack"].kpis.products == 1
    (folder / "b.csv").write_text("product_id,brand\n3,Y\n4,Y\n5,X\n")
    found = _refresh(spark, folder, tmp_path, {"pack": FilterSpec(brands=["Y"])})["pack"]
    assert found.kpis.products == 3 and [b.brand for b in found.tables.brand_concentration] == ["Y"]


def test_named_files_of_any_suffix(spark, folder):
    for name in ("d.txt", "D.CSV", "plain"):
        (folder / name).write_text("product_id\n7\n")
        files = named_files(spark, str(folder / name))
        assert [r.product_id for r in read_catalog(spark, files).collect()] == [7]
    (folder / "_d.csv").write_text("product_id\n7\n")
    with pytest.raises(ValueError, match="rename"):
        read_catalog(spark, named_files(spark, str(folder / "_d.csv")))


def test_report_file_reads_back_as_it_was(spark, tmp_path):
    rows = [('a "q" b, x', 258495563.45), ("  blanks ", 12.0), (None, None), ("tiny", 1e-300), ("third", 1 / 3)]
    report = spark.createDataFrame(rows, "title string, value double")
    write_report(report, str(tmp_path / "r"))
    (file,) = (tmp_path / "r").glob("*.csv")
    text = file.read_text().splitlines()
    assert text[:3] == ["title,value", '"a ""q"" b, x",258495563.45', "  blanks ,12.0"]
    with open(file, newline="") as lines:
        back = [(r[0] or None, float(r[1]) if r[1] else None) for r in list(csv.reader(lines))[1:]]
    assert back == rows


def test_errors_at_run_time_become_a_row(spark):
    (row,) = select_json(spark, "SELECT raise_error('no') FROM range(3)").collect()
    assert "no" in json.loads(row.row_json)["error"]


def test_fixed_layout_stream_equals_batch(spark, folder, tmp_path):
    (folder / "a.csv").write_text(",".join(COLUMNS) + "\n1,1,T,B,10.5,20,47.5,4.5,3,i.jpg,2\n2,2,short\n3,3,x,B,1,1,1,1,1,i,1,9\n")
    table = str(tmp_path / "t")
    ingest.start_ingest(ingest.stream_products(spark, str(folder)), table, str(tmp_path / "c")).awaitTermination()
    batch = read_catalog(spark, csv_files(spark, str(folder))).collect()
    assert sorted(spark.read.schema(PRODUCTS).parquet(table).collect(), key=str) == sorted(batch, key=str)
    assert len(batch) == 2


def test_running_state_equals_a_full_pass(spark, products, tmp_path):
    """Three files of different weight; one brand and one price dominate the last."""
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    part = F.col("style_id") % 3
    write_csv(products.filter(part == 0), folder)
    write_csv(products.filter(part == 1), folder)
    hot = products.filter(part == 2).withColumn("brand", F.lit("Brand#2")).withColumn("price", F.lit(7.0))
    write_csv(hot.coalesce(1), folder)
    specs = {n: SPECS[n] for n in ("everything", "one_brand_well_rated", "nothing")}
    query = refresh.start_refresh(ingest.stream_files(spark, folder), specs, home, str(tmp_path / "c"))
    query.awaitTermination()

    table = spark.read.parquet(f"{home}/products").select(COLUMNS)
    assert table.count() == products.count()
    levels = refresh.latest(spark, f"{home}/report_levels", query)
    for name, build in reports.AGGREGATES.items():
        assert build(facts.Levels(levels)).collect() == reports.report(name, table).collect(), name
    running = packs.assemble(
        *(refresh.latest(spark, f"{home}/{n}", query) for n in refresh.pack_states(specs)), specs
    )
    full = packs.insight_packs(table, specs)
    assert sorted(running.collect(), key=str) == sorted(full.collect(), key=str)
    last = query.lastProgress["batchId"]
    written = spark.read.schema(full.schema).json(f"{home}/packs/batch_id={last}").select(full.columns)
    assert sorted(written.collect(), key=str) == sorted(full.collect(), key=str)


def test_repeated_batch_leaves_the_state_as_it_was(spark, folder, tmp_path):
    home = str(tmp_path / "home")
    for name, brand in (("a", "X"), ("b", "Y")):
        (folder / f"{name}.csv").write_text(f"product_id,brand,price,mrp\n1,{brand},1,2\n2,{brand},2,2\n")
    files = ingest.stream_files(spark, str(folder))

    def run():
        query = refresh.start_refresh(files, {"all": SPECS["everything"]}, home, str(tmp_path / "c"))
        query.awaitTermination()
        return query

    run()
    before = sorted(spark.read.parquet(f"{home}/{refresh.pack_states({'all': SPECS['everything']})[0]}/batch_id=1").collect(), key=str)
    os.remove(tmp_path / "c" / "commits" / "1")  # as if the second batch had not been committed
    crc = tmp_path / "c" / "commits" / ".1.crc"
    if crc.exists():
        os.remove(crc)
    run()
    assert sorted(spark.read.parquet(f"{home}/{refresh.pack_states({'all': SPECS['everything']})[0]}/batch_id=1").collect(), key=str) == before
    assert spark.read.parquet(f"{home}/products").count() == 4


def test_scratch_lies_in_the_shared_folder_if_there_is_one(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = (scratch_dir(spark, "x") for _ in range(2))
    assert first != second
    assert first.startswith(f"{base.rstrip('/')}/x-") if base else os.path.isdir(first)


def test_command_line(spark, folder, tmp_path, capsys):
    from shelfscope.__main__ import main

    (folder / "a.csv").write_text("product_id,brand,price,mrp,discount_percent,rating_total\n1,X,5,10,50,3\n2,Y,10,10,0,0\n")
    table = str(tmp_path / "t")
    main(["load", "--table", table, str(folder), str(folder / "a.csv")])
    assert spark.read.parquet(table).count() == 4
    main(["report", "--table", table, "--out", str(tmp_path / "r")])
    assert "core_kpis: saved" in capsys.readouterr().out
    specs = '{"x": {"brands": ["X"], "top_limit": 1}, "none": {"brands": ["Z"]}}'
    main(["pack", "--table", table, "--out", str(tmp_path / "p"), "--filters-json", specs])
    found = {r.pack_id: r for r in spark.read.json(str(tmp_path / "p")).collect()}
    assert found["x"].kpis.products == 2 and len(found["x"].tables.top_discounted_rated) == 1
    assert found["none"].bullets == ["No items match the current filters."]
    main(["ask", "--table", table, "SELECT COUNT(*) AS n FROM products"])
    assert "|4  |" in capsys.readouterr().out


def test_files_a_task_cannot_open_are_left_to_the_session_reader(folder):
    from shelfscope.sources.catalog_csv import _open_first_line

    (folder / "a.csv").write_text("product_id,brand\r\n1,X\r\n")
    assert _open_first_line(f"file:{folder}/a.csv") == "product_id,brand"
    assert _open_first_line(f"file:{folder}/missing.csv") is None
    assert _open_first_line("nosuch://bucket/a.csv") is None


def test_only_files_with_quoted_line_breaks_are_read_whole(spark, tmp_path):
    plain, broken, odd = (str(tmp_path / n) for n in ("plain.csv", "bro ken%20x.csv", "odd.csv"))
    for path, text in (
        (plain, 'product_id,title\n1,"a ""quoted"" word"\n2,b\n'),
        (broken, 'product_id,title\n3,"two\nlines"\n4,"three\n\n""lines"", and",extra\n5,"x,\n"\n'),
        (odd, 'product_id,title\n6,5" screen\n7,c\n'),
    ):
        with open(path, "w") as f:
            f.write(text)
    assert catalog_csv.with_quoted_lines(spark, [plain, broken, odd]) == {catalog_csv._place(p) for p in (broken, odd)}
    rows = catalog_csv.read_catalog(spark, [plain, broken, odd]).select("product_id", "title").collect()
    assert sorted(map(tuple, rows)) == [(1, 'a "quoted" word'), (2, "b"), (3, "two\nlines"), (5, "x,\n"), (6, '5" screen'), (7, "c")]
    plan = catalog_csv.read_catalog(spark, [plain, broken])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 2


def test_unique_load_takes_each_key_once(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda *found: spark.createDataFrame(found, "product_id long, title string")
    batches = [
        rows((1, "b"), (1, "a"), (2, None), (None, "x"), (None, "x")),
        rows((2, "again"), (3, "c"), (None, "x")),
        rows(),
        rows((1, "late"), (3, "c")),
    ]
    expected = [[(1, "a"), (2, None), (None, "x"), (None, "x")], [(3, "c"), (None, "x")], [], []]
    for turn in (*range(4), 1, 0):  # the last two are repeated
        overwrite_batch(ingest.unseen(batches[turn], table, turn, "product_id"), table, turn)
        got = spark.read.schema("product_id long, title string").parquet(f"{table}/batch_id={turn}").collect()
        assert sorted(map(tuple, got), key=str) == sorted(expected[turn], key=str)
    assert "batch_id" in spark.read.parquet(table).columns


def test_batches_follow_the_bytes_not_the_files(spark, folder, tmp_path):
    for i in range(5):
        (folder / f"{i}.csv").write_text(f"product_id\n{i}\n")
    for most, batches in ((1 << 20, 1), (30, 3), (1, 5)):
        table, files = str(tmp_path / f"t{most}"), ingest.stream_files(spark, str(folder), batch_bytes=most)
        ingest.start_ingest_by_name(files, table, str(tmp_path / f"c{most}")).awaitTermination()
        rows = spark.read.parquet(table).collect()
        assert sorted(r.product_id for r in rows) == list(range(5))
        assert len({r.batch_id for r in rows}) == batches


def test_refresh_takes_a_load_of_many_files_at_once(spark, products):
    home, query = loading._refreshed(products.repartition(6), {"all": SPECS["everything"]})
    assert query.lastProgress["batchId"] == 1  # two loads, two batches
    assert spark.read.parquet(f"{home}/products").count() == products.count()


def test_unique_load_of_known_keys_moves_keys_alone(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    rows = spark.range(1000).select(F.col("id").alias("product_id"), F.lit("x").alias("title"), F.lit(None).cast("int").alias("n"))
    overwrite_batch(ingest.unseen(rows, table, 0, "product_id"), table, 0)
    more = rows.withColumn("product_id", F.col("product_id") + 990).union(rows).union(rows.withColumn("title", F.lit("w")))
    found, usual = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (ingest.FEW_KEYS, 0):
            monkeypatch.setattr(ingest, "FEW_KEYS", few)
            new = ingest.unseen(more, table, 1, "product_id")
            found.append(sorted(map(tuple, new.collect())))
            first = new._jdf.queryExecution().optimizedPlan().toString().index
            # few new keys are looked up before rows are moved, many are compared with what was moved
            assert (first("Join LeftSemi") > first("min(struct")) == (few > 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert found[0] == found[1] == [(i, "x", None) for i in range(1000, 1990)]
