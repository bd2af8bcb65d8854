import gzip
import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from refsieve import job
from refsieve.plans.dominant import dominant_token_works
from refsieve.plans.prepare import flatten_results
from refsieve.plans.reports import duplicate_titles
from refsieve.session import shared_folder, stored
from refsieve.sources import sinks, snapshot
from workload import views
from workload.queries import stop_lists


def test_snapshot_lines_and_items(spark, tmp_path):
    works = [
        {"DOI": "1", "title": ["T"], "reference": [{"unstructured": "a"}], "unknown": 1},
        {"DOI": "2", "issn-type": [{"value": "v", "type": "print"}]},
    ]
    (tmp_path / "lines.jsonl").write_text("\n".join(json.dumps(w) for w in works))
    (tmp_path / "items.json").write_text(json.dumps({"items": works}, indent=1))
    lines = snapshot.read_works(spark, str(tmp_path / "lines.jsonl"))
    items = snapshot.read_items(spark, str(tmp_path / "items.json"))
    assert sorted(map(str, lines.collect())) == sorted(map(str, items.collect()))
    assert lines.columns == items.columns and lines.count() == 2


def test_job_reads_files_and_writes_a_table(spark, tmp_path):
    references = [{"unstructured": f"Smith {c}x Atlantis Foo"} for c in "abcdefghijklmnopqrstuvwxyzab"]
    works = [
        {"DOI": "1", "type": "book", "title": ["T"], "reference": references, "reference-count": 28},
        {"DOI": "2", "reference": references[:3], "reference-count": 3},
    ]
    (tmp_path / "works.jsonl").write_text("\n".join(json.dumps(w) for w in works))
    (tmp_path / "tokens.json").write_text(json.dumps({"unwanted_tokens": ["Foo"]}))
    (tmp_path / "countries.json").write_text(json.dumps({"countries": ["Atlantis"]}))
    path = job.run(
        spark, str(tmp_path / "works.jsonl"), str(tmp_path / "out"),
        str(tmp_path / "tokens.json"), str(tmp_path / "countries.json"),
    )
    rows = snapshot.read_results(spark, path).collect()
    assert [(r["DOI"], r["token_vocabulary"]) for r in rows] == [("1", ["Smith"])]


def test_broken_lines_of_one_compressed_file_are_set_aside(spark, tmp_path):
    references = [{"unstructured": f"Smith {c}x"} for c in "abcdefghijklmnopqrstuvwxyzab"]
    work = {"type": "book", "title": ["T"], "reference": references, "reference-count": 28}
    good = [json.dumps({"DOI": str(i), **work}) for i in range(20)]
    broken = [good[0][:-1], "no record", json.dumps({"DOI": "x", "reference": "none"})]
    with gzip.open(tmp_path / "works.jsonl.gz", "wt") as file:
        file.write("\n".join([*good[:7], *broken, "", "  ", *good[7:]]))
    source = str(tmp_path / "works.jsonl.gz")
    lines = snapshot.read_lines(spark, source, tasks=4)
    assert lines.count() == 23 and snapshot.good_lines(lines).count() == 20
    assert sorted(r["value"] for r in snapshot.bad_lines(lines).collect()) == sorted(broken)
    parts = lines.select(F.spark_partition_id()).distinct().count()
    assert parts > 1 and snapshot.read_lines(spark, source).select(F.spark_partition_id()).distinct().count() == 1

    path = job.run(spark, source, str(tmp_path / "out"), tasks=4)
    assert snapshot.read_results(spark, path).count() == 20
    written = spark.read.text(job.bad_path(path)).collect()
    assert sorted(r["value"] for r in written) == sorted(broken)
    (tmp_path / "clean.jsonl").write_text("\n".join(good))
    clean = job.run(spark, str(tmp_path / "clean.jsonl"), str(tmp_path / "out"))
    assert snapshot.read_results(spark, clean).count() == 20 and not os.path.exists(job.bad_path(clean))


def test_empty_snapshot_has_no_lines(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("")
    lines = snapshot.read_lines(spark, str(tmp_path / "none.jsonl"), tasks=2)
    assert snapshot.good_lines(lines).count() == snapshot.bad_lines(lines).count() == 0


def test_results_and_reports_round_trip(spark, sf_dir, tmp_path):
    found = dominant_token_works(views.works(spark, sf_dir), stop_lists(spark, sf_dir), 0.3)
    path = sinks.write_results(found, str(tmp_path), datetime(2024, 8, 19, 15, 18, 19))
    assert os.path.basename(path).startswith("run-20240819-151819-")
    assert sinks.run_path("x", datetime(2024, 8, 19)) != sinks.run_path("x", datetime(2024, 8, 19))
    again = snapshot.read_results(spark, path)
    assert again.columns == found.columns and again.count() == found.count() > 0

    report = flatten_results(again)
    written = sinks.write_report(report, str(tmp_path / "report"))
    back = snapshot.read_report(spark, written, sinks.flat(report).schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, sinks.flat(report).collect()))
    assert duplicate_titles(back).count() == duplicate_titles(report).count()


def test_quotes_and_line_breaks_survive_csv(spark, tmp_path):
    frame = spark.createDataFrame([('a "b", c\nd', None), ("", "x")], "t string, u string")
    path = sinks.write_report(frame, str(tmp_path / "csv"))
    rows = {tuple(r) for r in snapshot.read_report(spark, path, frame.schema).collect()}
    assert ('a "b", c\nd', None) in rows


def test_stored_tables_lie_in_the_shared_folder(spark):
    frame = stored(spark.range(5), "numbers")
    assert frame.count() == 5
    folder = shared_folder(spark).removeprefix("file:")
    assert all(folder in name for name in frame.inputFiles())


def test_scan_reads_only_what_a_report_needs(spark, sf_dir, tmp_path):
    found = dominant_token_works(views.works(spark, sf_dir), stop_lists(spark, sf_dir), 0.3)
    results = snapshot.read_results(spark, sinks.write_results(found, str(tmp_path)))
    narrow = results.filter("work_type = 'book'").select("DOI")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(work_type,book)" in plan
    assert "ReadSchema: struct<DOI:string,work_type:string>" in plan
