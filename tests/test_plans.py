import io
import zipfile

import pytest

from quirefold.plans.recipes import Parameter, Recipe, Step, flow_steps, quick_flow, recipe_from_flow, run_recipe
from quirefold.plans.registry import Registry, Runner, Tool, ToolError
from quirefold.plans.tools import default_registry


def upper(df, by=1):
    return df.selectExpr(f"x + {by} AS x")


def joined(*frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def broken(df):
    raise RuntimeError("no")


@pytest.fixture
def runner():
    return Runner(Registry([Tool("add-one", "1.0.0", ("launcher",), (), (), (), upper), Tool("join-all", "1.0.0", ("flow",), (), (), (), joined), Tool("fails", "1.0.0", ("flow",), (), (), (), broken), Tool("needs-gpu", "1.0.0", ("flow",), ("gpu",), (), (), upper)]))


def test_registry_checks():
    for tool in (Tool("Bad Id", "1.0.0", ("a",)), Tool("ok", "1", ("a",)), Tool("ok", "1.0.0", ())):
        with pytest.raises(ValueError):
            Registry([tool])
    with pytest.raises(ValueError):
        Registry([Tool("a", "1.0.0", ("x",)), Tool("a", "1.0.0", ("x",))])
    assert [t.id for t in default_registry().listed("launcher")]


def test_runs_leave_metrics(spark, runner):
    df = spark.range(3).selectExpr("id AS x")
    assert sorted(r["x"] for r in runner.run("add-one", df, by=2).collect()) == [2, 3, 4]
    for tool, code in (("none", "UNKNOWN_TOOL"), ("needs-gpu", "UNAVAILABLE"), ("fails", "FAILED")):
        with pytest.raises(ToolError) as error:
            runner.run(tool, df)
        assert error.value.code == code
    assert [m.outcome for m in runner.metrics] == ["succeeded", "failed", "failed", "failed"]
    assert [r["x"] for r in runner.collect(df.orderBy("x"), 60)] == [0, 1, 2]


def test_recipes_are_checked():
    step = Step("a", "t")
    for bad in ((), (step, step), (Step("a", "t", {}, ("a",)),), (Step("a", "t", {}, ("b",)), Step("b", "t", {}, ("a",))), (Step("a", "t", {}, ("zz",)),)):
        with pytest.raises(ValueError):
            Recipe("r", "n", tuple(bad))
    with pytest.raises(ValueError):  # the implied edge closes a cycle
        Recipe("r", "n", (Step("a", "t", {}, ("b",)), Step("b", "t")))
    with pytest.raises(ValueError):
        Recipe("r", "n", (step,), (Parameter("a", "p"), Parameter("a", "p")))
    with pytest.raises(ValueError):
        flow_steps([Step("a", "t", {}, ("b",)), Step("b", "t", {}, ())])
    assert recipe_from_flow(quick_flow("t", x=1), "r", "n").steps[0].parameters == {"x": 1}


def test_recipe_runs(spark, runner):
    df = spark.createDataFrame([(1,)], "x long")
    recipe = Recipe("r", "n", (Step("a", "add-one", {"by": 1}), Step("b", "add-one", {"by": 10}, ("a",)), Step("c", "join-all", {}, ("b", "a"))), (Parameter("a", "by", required=True),))
    done = run_recipe(recipe, df, runner, {"a": {"by": 5}})
    assert done.status == "succeeded" and [r["x"] for r in done.outputs["c"].collect()] == [16, 6]
    failing = Recipe("r", "n", (Step("a", "add-one"), Step("b", "fails"), Step("c", "add-one")))
    done = run_recipe(failing, df, runner)
    assert (done.status, done.failed_step, list(done.outputs)) == ("failed", "b", ["a"])
    with pytest.raises(ToolError):
        run_recipe(Recipe("r", "n", (Step("a", "add-one"), Step("b", "needs-gpu"))), df, runner)
    runner.cancelled = lambda: True
    assert run_recipe(failing, df, runner).status == "cancelled"


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark):
    from quirefold.sources.docx import read_docx, table_shape_error

    good = docx('<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>A</w:t><w:tab/><w:t>b</w:t><w:br/></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>')
    frame = spark.createDataFrame([("g", bytearray(good)), ("bad", bytearray(b"zip?"))], "path string, content binary")
    got = {r["path"]: r for r in read_docx(frame).collect()}
    assert got["g"]["text"] == "A\tb\n\n1\t2" and got["g"]["paragraphs"][0]["style"] == "Heading1" and got["g"]["tables"] == [[["1", "2"]]]
    assert got["bad"]["error"] and got["bad"]["text"] is None
    assert table_shape_error([["a"], ["b", "c"]]) and table_shape_error([["a"], ["b"]]) is None


def test_sources_and_sinks(spark, tmp_path):
    from quirefold.sources import documents, sinks

    for name, text in (("a.txt", b"same"), ("b.txt", b"same"), ("c.txt", "é".encode("latin-1"))):
        (tmp_path / name).write_bytes(text)
    files = documents.import_files(spark, str(tmp_path))
    assert files.count() == 2
    assert {r["text"] for r in documents.read_texts(files).collect()} == {"same", "é"}
    root = str(tmp_path / "store")
    ids = spark.createDataFrame([(1,)], "id long")
    documents.commit_derived(root, ids, ids, ids, ids)
    ids.withColumn("batch", ids["id"].cast("string")).write.mode("append").parquet(f"{root}/artifacts")  # a batch without its operation
    assert documents.committed(spark, root, "artifacts").count() == 1
    rows = spark.createDataFrame([(1, 1, 0, ["=x", "a,b", "-5"])], "doc_id long, page int, row int, cells array<string>")
    sinks.write_csv_rows(rows, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first()["value"] == "'=x,\"a,b\",-5"
    assert [r["kind"] for r in sinks.typed_rows(rows).orderBy("column").collect()] == ["string", "string", "number"]


def test_protocol(spark):
    import json

    from quirefold.sources.protocol import respond

    lines = spark.createDataFrame([(1, '{"id":"a","method":"extract","params":{"text":"Nome: y"}}'), (2, "broken"), (3, '{"id":"c","method":"segment","params":{"text":"a\\nb"}}'), (4, '{"id":"d","method":"zzz","params":{"text":"a"}}')], "line_no long, value string")
    got = {r["line_no"]: json.loads(r["value"]) for r in respond(lines).collect()}
    assert got[1]["id"] == "a" and got[1]["result"]["key_values"] == [{"key": "Nome", "value": "y"}]
    assert got[3]["result"]["segments"] == ["a\n", "b"]
    assert got[2]["error"] == "invalid request" and got[4]["error"] == "unknown method"


def test_streams(spark, tmp_path):
    from quirefold.streaming.leases import lease_stream, outcome_stream, session_stream

    source = tmp_path / "events"
    schema = "ts timestamp, job_id string, action string"
    batches = [[("2024-01-01 00:00:00", "a", "claim"), ("2024-01-01 00:00:10", "b", "claim"), ("2024-01-01 00:00:20", "b", "started")], [("2024-01-01 00:10:00", "c", "claim")], [("2024-01-01 00:20:00", "c", "finish")]]
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = lease_stream(stream).writeStream.format("memory").queryName("leases").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    try:
        for b in batches:
            spark.createDataFrame(b, "ts string, job_id string, action string").selectExpr("to_timestamp(ts) AS ts", "job_id", "action").coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        got = {(r["job_id"], r["outcome"]) for r in spark.sql("SELECT * FROM leases").collect()}
    finally:
        q.stop()
    assert {("a", "leased"), ("a", "requeued"), ("b", "reconcile"), ("c", "leased")} <= got
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    for k, make in enumerate((session_stream, outcome_stream)):
        q = make(events).writeStream.format("memory").queryName(f"s{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"d{k}")).start()
        try:
            q.processAllAvailable()
            assert spark.sql(f"SELECT * FROM s{k}").count() > 0
        finally:
            q.stop()
