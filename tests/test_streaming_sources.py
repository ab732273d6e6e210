import datetime as dt
import json
import shutil
import tarfile

import pytest
from pyspark.sql import functions as F

from attestry.operators import merge
from attestry.sources import records, scans, sinks
from attestry.streaming import events as ev


def test_inverted_abstract_and_xml(spark):
    df = spark.createDataFrame([({"plastic": [1], "Eating": [0], "is": [2, 4]},), (None,)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(records.text_of_inverted(F.col("m"))).collect()][0] == "Eating plastic is is"
    xml = "<article><body><sec><title>Methods</title><p>One <i>two</i></p><sec><title>Sub</title><table-wrap><td>1</td><td>2</td></table-wrap></sec></sec></body></article>"
    assert records.sections_of_xml(xml) == "## Methods\nOne two\n## Sub\n1 2" and records.sections_of_xml("<broken") == "" == records.sections_of_xml(None)


def test_article_ids_types_and_authors(spark):
    schema = "id string, source string, pmid string, pmcid string, title string, authorString string, authorList struct<author:array<struct<fullName:string>>>, pubTypeList struct<pubType:array<string>>, pubYear int, doi string, license string, isOpenAccess string, abstractText string, fullTextXml string, journalTitle string, citedByCount int"
    rows = [
        ("X1", "MED", "77", "PMC5", "A title.", "A B, C D.", ([("Ana B",), ("Cy D",)],), (["Journal Article"],), 2020, None, None, "Y", "x", "<article><front><title>T</title></front></article>", "J", 1),
        ("X2", "MED", "", "PMC6", "B", "A B, C D.", None, (["Preprint"],), 2021, None, None, "N", None, None, "J", 1), ("PPR1", "PPR", None, None, "C", None, None, None, 2021, None, None, "N", None, None, None, None),
    ]
    got = [(r.doc_id, r.doc_type, r.authors, r.full_text) for r in records.articles(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == ("europepmc:77", "article", ["Ana B", "Cy D"], "") and got[1][:3] == ("europepmc:PMC6", "preprint", ["A B", "C D"]) and got[2][:2] == ("europepmc:PPR1", "preprint")


def test_paging_and_retries():
    pages = {"*": ([{"i": 1}, {"i": 2}], "b"), "b": ([{"i": 3}], "b")}
    assert [r["i"] for r in records.cursor_pages(pages.get)] == [1, 2, 3] and len(list(records.cursor_pages(pages.get, limit=2))) == 2
    answers, waits = iter([(503, b""), (429, b""), (200, b"ok")]), []
    assert records.with_retries(lambda: next(answers), wait=waits.append) == b"ok" and waits == [1.0, 2.0]


def test_payloads_become_staging_rows(spark, tmp_path):
    work = {"id": "https://x.example/W12", "type": "dissertation", "title": "T", "authorships": [{"author": {"display_name": "A B"}}], "publication_year": 2020, "doi": "https://doi.org/10.1/X",
            "best_oa_location": {"license": "cc-by"}, "open_access": {"is_oa": True}, "abstract_inverted_index": {"b": [1], "a": [0]}, "cited_by_count": 3}
    (tmp_path / "w.json").write_text(json.dumps(work))
    rows = records.works(spark.read.schema(
        "id string, type string, title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, doi string, best_oa_location struct<license:string>, open_access struct<is_oa:boolean>, abstract_inverted_index map<string,array<int>>, cited_by_count int"
    ).json(str(tmp_path / "w.json")))
    r = rows.first()
    assert (r.doc_id, r.doc_type, r.doi, r.abstract, r.authors, json.loads(r.metadata)) == ("openalex:W12", "thesis", "10.1/x", "a b", ["A B"], {"cited_by": 3})
    assert rows.columns == list(records.STAGING_COLUMNS)


def test_pages_as_a_data_source_and_csv_in_tar(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    for i in range(3):
        (tmp_path / "pages" / f"{i}.json").write_text(json.dumps({"results": [{"n": i * 10 + j} for j in range(2)]}))
    spark.dataSource.register(records.JsonPages)
    got = spark.read.format("json_pages").option("path", str(tmp_path / "pages")).load()
    assert sorted(json.loads(r.payload)["n"] for r in got.collect()) == [0, 1, 10, 11, 20, 21]
    again = records.json_pages(spark, str(tmp_path / "pages")).collect()
    assert sorted(json.loads(r.payload)["n"] for r in again) == [0, 1, 10, 11, 20, 21] and {r.place for r in again} == {0, 1}
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.csv", "in/a.csv")
    assert sorted(map(tuple, records.csv_in_tar(spark, str(tmp_path / "t.tar.gz"), "a.csv", "x int, y string").collect())) == [(1, "a"), (2, "b")]
    assert records.load_csv(spark, str(tmp_path / "a.csv"), "x", ("y",)).columns == ["x"]
    text = spark.createDataFrame([("1", "true", "x"), (None, "False", "2")], "a string, b string, c string")
    assert dict(records.typed(text, ("a", "b", "c")).dtypes) == {"a": "double", "b": "boolean", "c": "string"}


def test_file_ingest_is_idempotent(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"k": "a", "v": 1}\n')
    schema = spark.createDataFrame([], "k string, v int").schema
    take = lambda: ev.ingest_files(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state"), lambda d: d, schema)
    assert take() == 1 == take()
    (source / "2.json").write_text('{"k": "b", "v": 2}\n')
    assert take() == 2


def test_upsert_stream(spark, tmp_path):
    source = tmp_path / "changes"
    source.mkdir()
    (source / "1.json").write_text('{"k": "a", "v": 1, "version": 1}\n{"k": "a", "v": 2, "version": 2}\n{"k": "b", "v": 5, "version": 1}\n')
    schema = spark.createDataFrame([], "k string, v int, version long").schema
    go = lambda: ev.upsert_stream(spark.readStream.schema(schema).json(str(source)), str(tmp_path / "t"), "k", str(tmp_path / "s"))
    go()
    (source / "2.json").write_text('{"k": "b", "v": 6, "version": 2}\n')
    go()
    assert {r.k: r.v for r in merge.current(spark, str(tmp_path / "t")).collect()} == {"a": 2, "b": 6}
    # a version that cannot be read is an error, not an empty table
    shutil.rmtree(next((tmp_path / "t").glob("v-*")))
    for p in (tmp_path / "t").glob("v-*"):
        shutil.rmtree(p)
    (source / "3.json").write_text('{"k": "c", "v": 7, "version": 1}\n')
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        go()
    assert not list((tmp_path / "t").glob("v-*"))


def test_approvals_at_the_limit(spark):
    q = spark.createDataFrame([(1, 7, 0), (2, 7, 500), (3, 8, 0)], "request_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    a = spark.createDataFrame([(7, 120, "reject"), (7, 119, "approve"), (7, 621, "approve")], "user_id long, s long, decision string").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.request_id: r.decision for r in ev.approvals(q, a, "user_id").collect()} == {1: "approve", 2: "timeout", 3: "timeout"}


def test_client_waits_and_tries_again():
    now, slept, answers = [0.0], [], iter([(200, b"a"), (503, b""), (200, b"b")])

    def sleep(x):
        slept.append(round(x, 3))
        now[0] += x

    client = scans.Client(lambda method, url, **kw: next(answers), interval=0.5, clock=lambda: now[0], sleep=sleep)
    assert client.request("GET", "u") == b"a" and client.request("GET", "u", page=2) == b"b" and slept == [0.5, 1.0]
    with pytest.raises(OSError):
        scans.Client(lambda *a, **k: (404, b""), sleep=sleep).request("GET", "u")
    asked = []
    assert list(scans.in_batches([str(i % 7) for i in range(20)], lambda b: asked.append(b) or [{"n": len(b)}], size=3)) == [{"n": 3}, {"n": 3}, {"n": 1}] and asked[0] == ["0", "1", "2"]


def test_scans(spark, tmp_path):
    rows = spark.createDataFrame([("d:1", 1), ("d:2", 2), ("d'; --", 3)], "doc_id string, v int")
    assert scans.statement(spark, "SELECT v FROM {t} WHERE doc_id = :id", {"id": "d'; --"}, t=rows).first().v == 3
    rows.createOrReplaceTempView("scanned")
    assert [tuple(r) for r in scans.column_names(spark, "scanned").collect()] == [("doc_id", "string"), ("v", "int")]
    ids = spark.createDataFrame([(" d:1",), ("d:1",), ("d'; --",), (None,), ("gone",)], "doc_id string")
    assert [r.v for r in scans.lookup(rows, ids, "doc_id").collect()] == [1]
    (tmp_path / "a.jsonl").write_text('{"k": "x", "v": 1}\n{"k": "y"}\n')
    (tmp_path / "a.csv").write_text("k,v\nx,1\n")
    assert scans.files(spark, str(tmp_path / "a.jsonl"), "json", "k string, v int").count() == 2 and scans.files(spark, str(tmp_path / "a.csv"), "csv", "k string, v int").first().v == 1
    assert bytes(scans.files(spark, str(tmp_path / "a.csv"), "binary").first().content) == b"k,v\nx,1\n"
    assert [r.v for r in scans.page(rows, ["v"], 1, 1).collect()] == [2] and scans.is_passage_index(["chunk_id"]) and not scans.is_passage_index(["doc_id"])
    assert records.table_or_path(spark, "scanned", "nowhere").count() == 3
    rows.write.parquet(str(tmp_path / "t"))
    assert records.table_or_path(spark, "no_such_table", str(tmp_path / "t")).count() == 3


def test_approved_set_is_kept_and_gates_fail_closed(spark):
    now, reads, fail = [0.0], [], [False]

    def read():
        reads.append(1)
        if fail[0]:
            raise OSError("away")
        return spark.createDataFrame([("a",)], "doc_id string")

    get = scans.approved_ids(read, 600, clock=lambda: now[0])
    assert get().count() == 1 and get() is get() and len(reads) == 1
    now[0], fail[0] = 601.0, True
    assert get().count() == 1 and len(reads) == 2  # the last known set goes on
    assert scans.approved_ids(read, 600, clock=lambda: now[0])() is None
    with pytest.raises(scans.Unreadable):
        scans.required(lambda: spark.read.parquet("/nowhere/at/all"), "the corpus")
    assert scans.required(lambda: spark.range(3), "x").count() == 3


def test_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("a", "{}"), ("a", "{}"), ("b", "{}")], "source string, payload string")
    staged = spark.createDataFrame([("a", "a:1"), ("c", "c:1")], "source string, doc_id string")
    for _ in range(2):  # a run written again replaces itself
        got = {r.source: (r.payloads, r.rows) for r in sinks.write_run(raw, staged, str(tmp_path / "runs"), "r1").collect()}
        assert got == {"a": (2, 1), "b": (1, 0), "c": (0, 1)} and spark.read.json(str(tmp_path / "runs" / "raw")).count() == 3
    target = spark.createDataFrame([("k1", 1, None, None), ("k2", 2, "x", None)], "k string, v int, approved_by string, approved_at timestamp")
    new = spark.createDataFrame([("k1", 9), ("k3", 3)], "k string, v int")
    assert {r.k: (r.v, r.approved_by, r.approved_at is not None) for r in sinks.merge_approved(target, new, "k", " Ana ").collect()} == {"k1": (9, "Ana", True), "k2": (2, "x", False), "k3": (3, "Ana", True)}
    for bad in ((new.unionByName(new), "Ana"), (new, " ")):
        with pytest.raises(ValueError):
            sinks.merge_approved(target, bad[0], "k", bad[1])
    (tmp_path / "x.sql").write_text("-- first; comment\nCREATE OR REPLACE TEMP VIEW made AS SELECT 'a;b' AS v; /* ; */\n;SELECT 1")
    assert sinks.apply_sql_file(spark, str(tmp_path / "x.sql")) == 2 and spark.table("made").first().v == "a;b"
    odd = spark.createDataFrame([("ü,\"q\"", None), ("", "z")], "name string, note string")
    sinks.write_sheet(odd, str(tmp_path / "sheet"))
    part = next((tmp_path / "sheet").glob("*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfname,")
    assert {(r.name, r.note or "") for r in sinks.read_sheet(spark, str(tmp_path / "sheet")).collect()} == {('ü,"q"', ""), ("", "z")}
    sinks.write_report(odd, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_fitted_pipelines_are_kept(spark, tmp_path):
    from attestry.operators import modelling

    df = spark.createDataFrame([(float(i % 10), "ab"[i % 2], float(i % 10 > 4)) for i in range(60)], "x double, s string, label double")
    fitted = modelling.pipeline(["x"], ["s"], "label").fit(df)
    sinks.save_fitted(fitted, str(tmp_path / "m"), {"x": "double", "s": "string"})
    again = sinks.load_fitted(spark, str(tmp_path / "m"), df)
    assert again.transform(df).where("prediction = label").count() == fitted.transform(df).where("prediction = label").count() == 60
    with pytest.raises(ValueError):
        sinks.load_fitted(spark, str(tmp_path / "m"), df.drop("s"))
    with pytest.raises(FileNotFoundError):
        sinks.load_fitted(spark, str(tmp_path / "none"))


def test_query_log_and_its_pages(spark):
    rows = [("q1", "arrival", 10, "what", "ana", None, None), ("q1", "completion", 12, None, None, "ok", None), ("q2", "arrival", 11, "how", "bo", None, None), ("q3", "arrival", 5, "why", "ana", None, None), ("q3", "completion", 6, None, None, None, "boom"), ("q4", "completion", 6, None, None, "ok", None)]
    events = spark.createDataFrame(rows, "query_id string, kind string, s long, query string, asked_by string, verdict string, error string").withColumn("ts", F.timestamp_seconds("s"))
    log = ev.query_log(events)
    got = {r.query_id: (r.answered, r.latency_ms, r.error) for r in log.collect()}
    assert got == {"q1": (True, 2000, None), "q2": (False, None, None), "q3": (False, 1000, "boom")}
    assert [r.query_id for r in ev.log_page(log).collect()] == ["q2", "q1", "q3"] and [r.query_id for r in ev.log_page(log, unanswered=True, limit=1).collect()] == ["q2"]
    assert [r.query_id for r in ev.log_page(log, asked_by="ana", since=dt.datetime.fromtimestamp(8)).collect()] == ["q1"] and ev.log_page(log, limit=0).count() == 1


def test_audit_never_stops_the_work():
    told = []

    def write(event):
        if event["n"] == 1:
            raise OSError("full")
        told.append(event["n"])

    audit, silent = ev.Audit(write), ev.Audit(write, enabled=False)
    for n in range(3):
        audit.tell(n=n)
        silent.tell(n=n)
    audit.close()
    silent.close()
    assert told == [0, 2] and audit.failed == 1 and silent.failed == 0


def test_fallback_is_announced():
    def live():
        yield {"event": "a"}
        raise TimeoutError

    got = list(ev.with_fallback(live, lambda: iter([{"event": "s"}])))
    assert [(e["event"], e["simulated"]) for e in got] == [("a", False), ("fallback", True), ("s", True)] and got[1]["reason"] == "TimeoutError"
    assert [e["simulated"] for e in ev.with_fallback(lambda: iter([{"event": "a"}]), live)] == [False]


def test_command_line_publishes_only_in_a_name(spark, tmp_path, capsys):
    from attestry.__main__ import main

    folder, out = "/root/testdata/sf0.001", str(tmp_path / "curated")
    assert main(["curate", "--tables", folder, "--out", out], spark) == 0 and not merge.published(spark, out)
    assert "nothing was published" in capsys.readouterr().out
    for _ in range(2):
        assert main(["curate", "--tables", folder, "--out", out, "--approve", "Ana"], spark) == 0
    rows = merge.current(spark, out)
    assert rows.count() == rows.select("chunk_id").distinct().count() > 0 and {r[0] for r in rows.select("approved_by").distinct().collect()} == {"Ana"}
    assert main(["extract", "--tables", folder, "--out", out], spark) == 0 and main(["query", "--tables", folder, "profile_total"], spark) == 0
