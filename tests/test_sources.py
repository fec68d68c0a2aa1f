import datetime as dt

import pytest
from pyspark.sql import functions as F

from concordat.sources import documents, evidence, exports, sinks
from concordat.streaming import feed

CONTRACT = {"model": "string", "seed": "integer", "accuracy": "decimal"}


def scan(spark, tmp_path, text, separator=","):
    path = tmp_path / "e.csv"
    path.write_text(text, encoding="utf-8")
    rows = evidence.scan_delimited(spark, str(path), evidence.header(spark, str(path), separator), separator)
    return str(path), evidence.typed(rows, CONTRACT, blank_is_missing=separator == "\t")


def test_csv_cells_and_health(spark, tmp_path):
    path, rows = scan(spark, tmp_path, 'model,seed,extra,accuracy\n"a ""x"",b",1,z,0.5\n001,2,z,0.70\n')
    assert evidence.header_error(spark, path, list(CONTRACT)) is None
    assert evidence.header_error(spark, path, ["other"]) == "MISSING_COLUMN"
    assert [(r.model, r.seed, r.accuracy, r._error) for r in rows.orderBy("seed").collect()] == [('a "x",b', "1", "0.5", None), ("001", "2", "0.70", None)]
    assert evidence.health(rows, "s", ["model", "seed"]).count() == 0


@pytest.mark.parametrize(
    "body, error",
    [("a,1,0.5\na,1,0.6\n", "DUPLICATE_KEY"), ("a,01,0.5\n", "COLUMN_TYPE"), ("a,1,\n", "COLUMN_TYPE"), ("a,1\n", "MALFORMED_ROW"), ("a,1,0.5,9\n", "MALFORMED_ROW")],
)
def test_one_bad_cell_fails_the_source(spark, tmp_path, body, error):
    _, rows = scan(spark, tmp_path, "model,seed,accuracy\nb,7,1\n" + body)
    assert [r.error for r in evidence.health(rows, "s", ["model", "seed"]).collect()] == [error]


def test_blank_numbers_of_tsv_are_missing(spark, tmp_path):
    _, rows = scan(spark, tmp_path, "model\tseed\taccuracy\na\t1\t\n", "\t")
    r = rows.collect()[0]
    assert (r.model, r.accuracy, r._error) == ("a", None, None)


def test_duplicate_headers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,a\n1,2\n")
    assert evidence.header_error(spark, str(tmp_path / "d.csv"), ["a"]) == "DUPLICATE_HEADER"


def test_json(spark):
    texts = ['{"a": {"b/c": [1.50, "x"], "~": null}}', '{"a": 1, "a": 2}', "[NaN]", '{"a": 0.1000000000000000000000000000000000000000001}']
    rows = evidence.scan_json(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.json_error for r in rows] == [None, "JSON_INVALID", "JSON_INVALID", None] and [r.needs_exact for r in rows] == [False, False, False, True]
    d = evidence.scan_json(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"))
    at = {p: tuple(d.select(evidence.json_pointer(F.col("value"), p)).first()[0]) for p in ("/a/b~1c/1", "/a/~0", "/a/none", "/a/b~1c/7")}
    assert at == {"/a/b~1c/1": ("x", None), "/a/~0": (None, "MISSING_VALUE"), "/a/none": (None, "MISSING_VALUE"), "/a/b~1c/7": (None, "MISSING_VALUE")}
    leaves = {r.pointer: r.lexeme for r in evidence.json_leaves(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), depth=4).collect()}
    assert set(leaves) == {"/a/b~1c/0", "/a/b~1c/1", "/a/~0"} and float(leaves["/a/b~1c/0"]) == 1.5


def test_pages(spark):
    rows = spark.range(7).withColumn("k", -F.col("id"))
    page = evidence.page(rows, ["k"], 3, 3).collect()
    assert [(r.id, r.total, r.next_offset) for r in page] == [(3, 7, 6), (2, 7, 6), (1, 7, 6)]
    assert {r.next_offset for r in evidence.page(rows, ["k"], 6, 3).collect()} == {None}


def test_tracking_histories(spark):
    entry = "array<struct<value string, step string, timestamp string, model_id string, dataset_name string, dataset_digest string>>"
    pages = spark.createDataFrame([("r", "acc", 1, [("NaN", "2", "2000", None, None, None)], None), ("r", "acc", 0, [("0.5", "1", "1000", None, None, None), (None, "1.5", "1500", None, None, None)], "t")], f"run_id string, metric string, page int, entries {entry}, token string")
    runs = spark.createDataFrame([("r", "FINISHED", {"lr": "1"}), ("s", "RUNNING", {})], "run_id string, status string, params map<string,string>")
    metrics = spark.createDataFrame([("acc",), ("loss",)], "metric string")
    out = sorted((r.metric, r.record_index, r.value, r.status, r.step, r.timestamp_unit, r.lr) for r in exports.project_mlflow(runs, pages, metrics, ["lr"]).collect())
    assert out == [("acc", 0, "0.5", "observed", 1, "ms", "1"), ("acc", 1, None, "missing", None, "ms", "1"), ("acc", 2, None, "nonfinite", 2, "ms", "1"), ("loss", 0, None, "not_logged", None, None, "1")]
    assert exports.continuity(pages).count() == 0
    assert exports.continuity(pages.where("page = 0")).first().error == "PAGE_SEQUENCE"
    assert [r.error for r in exports.terminal(runs, "mlflow").orderBy("run_id").collect()] == [None, "ACTIVE_RUN"]
    history = spark.createDataFrame([("w", 0, {"acc": "1", "_step": "0", "_timestamp": "10.5"}), ("w", 1, {"_step": "1"})], "run_id string, row int, values map<string,string>")
    ended = spark.createDataFrame([("w", "finished", {"lr": "2"})], "run_id string, status string, config map<string,string>")
    got = sorted((r.metric, r.record_index, r.value, r.status, r.timestamp) for r in exports.project_wandb(ended, history, ["acc"], ["lr"]).collect())
    assert got == [("acc", 0, "1", "observed", 10), ("acc", 1, None, "missing", None)]
    a, b = spark.range(3), spark.range(1, 4)
    assert {(r.id, r.side) for r in exports.same_rows(a, b).collect()} == {(0, "left"), (3, "right")}


def test_histories_are_numbered_without_their_maps(spark):
    """the rows that are sorted to number records hold single values, not the maps that these came from."""
    history = spark.createDataFrame([("w", 3, {"acc": "2", "_step": "7"}), ("w", 1, {"loss": "1", "_step": "x"})], "run_id string, row int, values map<string,string>")
    runs = spark.createDataFrame([("w", "finished", {"lr": "2"}), ("v", "crashed", {}), ("u", "running", {})], "run_id string, status string, config map<string,string>")
    out = exports.project_wandb(runs, history, ["acc", "loss"], ["lr"])
    got = {(r.run_id, r.metric, r.record_index, r.value, r.status, r.step, r.lr) for r in out.collect()}
    assert got == {("w", "acc", 0, None, "missing", None, "2"), ("w", "acc", 1, "2", "observed", 7, "2"), ("w", "loss", 0, "1", "observed", None, "2"), ("w", "loss", 1, None, "missing", 7, "2"), ("v", "acc", 0, None, "not_logged", None, None), ("v", "loss", 0, None, "not_logged", None, None)}
    above, below = out._jdf.queryExecution().optimizedPlan().toString().split("Window [", 1)
    assert "element_at(" not in above and "element_at(values" in below and "element_at(config" in below


def test_notebooks(spark):
    text = '{"cells": [{"id": "a", "cell_type": "code", "source": "1", "outputs": [{"output_type": "stream", "text": "x"}], "execution_count": 1}, {"id": "b", "cell_type": "code", "source": "2", "outputs": [], "execution_count": null}, {"id": "b", "cell_type": "markdown", "source": "3"}, {"cell_type": "code", "source": "4", "outputs": [{"output_type": "error"}], "execution_count": 2}, {"id": "e", "cell_type": "code", "source": "5", "outputs": [{"output_type": "widget"}], "execution_count": 3}]}'
    rows = documents.notebook_cells(spark.createDataFrame([("n", text)], "path string, text string")).orderBy("ord").collect()
    assert [(r.status, r.error) for r in rows] == [("saved_outputs", None), ("unexecuted", "CELL_ID_DUPLICATE"), ("not_code", "CELL_ID_DUPLICATE"), ("saved_error", "CELL_ID_MISSING"), ("unsupported_output", None)]


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.tex").write_text("x 1")
    (tmp_path / "a" / "r.csv").write_text("h\n1\n")
    got = documents.corpus(spark, str(tmp_path), ["tex"]).collect()
    assert [(r.text, r.format) for r in got] == [("x 1", "latex")]
    assert evidence.content_identities(spark, str(tmp_path), ["csv"]).count() == 1
    report = spark.range(3)
    sinks.write_snapshot(report, str(tmp_path / "snap"), "v1")
    assert sinks.read_snapshot(spark, str(tmp_path / "snap"), "v1").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_snapshot(report, str(tmp_path / "snap"), "v1")
    found = spark.createDataFrame([("R", "occurrence:a", "unknown", "m.tex", 3, "msg")], "rule string, subject string, severity string, file string, line int, message string")
    sinks.write_sarif(found, str(tmp_path / "sarif"))
    line = spark.read.json(str(tmp_path / "sarif")).first()
    assert line.ruleId == "R" and line.level == "warning" and line.locations[0].physicalLocation.region.startLine == 3
    values = spark.createDataFrame([("f", 2, "b_c", "1.0", "latex"), ("f", 1, "a", "2.0", "latex"), ("g", 1, "x_y", "3", "markdown")], "fragment string, ord int, label string, value string, format string")
    sinks.write_fragments(values, str(tmp_path / "fragments"))
    for name, lines in (("f", ["a & \\ensuremath{2.0} \\\\", "b\\_c & \\ensuremath{1.0} \\\\"]), ("g", ["| x\\_y | 3 |"])):
        files = sorted((tmp_path / "fragments" / f"fragment={name}").glob("*.txt"))
        assert [x for f in files for x in f.read_text().splitlines()] == lines


def test_publishing_pins_the_inputs(spark, tmp_path):
    files = {"n": 1}

    def identities():
        return spark.createDataFrame([("p", f"h{files['n']}")], "path string, sha256 string")

    def check(batch):
        return batch.select("path")

    def moving(batch):
        files["n"] += 1
        return batch.select("path")

    batch = spark.createDataFrame([("p",)], "path string")
    feed.publish(identities, check, str(tmp_path))(batch, 0)
    feed.publish(identities, moving, str(tmp_path))(batch, 1)
    got = {r.generation: (r.state, r.error) for r in spark.read.parquet(str(tmp_path / "verdicts")).collect()}
    assert got == {0: ("current", None), 1: ("pending", "WATCH_PENDING")}
    known = spark.createDataFrame([("m", "1", None), ("m", "2", "E")], "kind string, input_fingerprint string, error string")
    wanted = spark.createDataFrame([("m", "1"), ("m", "2"), ("m", "3")], "kind string, input_fingerprint string")
    have, todo = feed.reusable(wanted, known)
    assert [r.input_fingerprint for r in have.collect()] == ["1"] and sorted(r.input_fingerprint for r in todo.collect()) == ["2", "3"]


def test_change_stream(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", "h1", 0), ("a", "h1", 1), ("a", "h2", 2), ("b", "h1", 0), ("a", None, 3)]
    spark.createDataFrame([(p, s, day + dt.timedelta(seconds=t)) for p, s, t in rows], "path string, sha256 string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, sha256 string, at timestamp").parquet(str(tmp_path / "in"))
    run = feed.content_changes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r.path, r.generation, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1, "added"), ("a", 2, "changed"), ("a", 3, "removed"), ("b", 1, "added")]


def test_changes_in_the_order_of_times_over_several_arrow_batches(spark, tmp_path):
    rows = [("a", "xy"[i // 4 % 2], dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(40)]
    schema = "path string, sha256 string, at timestamp"
    spark.createDataFrame(rows[::-1], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    try:
        feed.content_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert sorted(r.at for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [r[2] for r in rows[::4]]


def test_what_is_known_is_asked_for_once_a_batch():
    """The calls to the state don't grow with the rows."""
    import pandas as pd

    calls = []

    class State:
        def __init__(self, name):
            self.name, self.held = name, []

        def __getattr__(self, call):
            def run(*args):
                calls.append((self.name, call))
                if call in ("put", "appendList"):
                    self.held = [*args[0]] if call == "put" else [*self.held, *args[0]]
                elif call == "update":
                    self.held = args[0]
                return bool(self.held) if call == "exists" else self.held

            return run

    class Handle(State):
        def getValueState(self, name, schema):
            return State(name)

        getListState = getMapState = getValueState

    watch = feed._Watch(500)
    watch.init(Handle("handle"))
    times = pd.Timestamp("2024-01-01") + pd.to_timedelta(range(300), unit="s")
    rows = pd.DataFrame({"path": [f"p{i}" for i in range(300)], "sha256": "1", "at": times})
    first = pd.concat(watch.handleInputRows(("x",), iter([rows, rows]), None))
    assert (first.state == "pending").sum() == 300 and len(calls) < 10
    again = pd.concat(watch.handleInputRows(("x",), iter([rows.assign(at=times + pd.Timedelta(days=1))]), None))
    assert not (again.state == "pending").any() and len(calls) < 20


def test_verdict_states_of_a_watched_project(spark, tmp_path):
    """Two micro-batches, then a replay of the first one: bursts become generations, and what is known changes nothing."""
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    first = [("p", "a", "1", at(0)), ("p", "b", "1", at(0.2)), ("p", "a", "1", at(0.3)), ("p", "a", "2", at(5)), ("q", "a", "1", at(1))]
    second = [("p", "a", None, at(100)), ("q", None, None, at(101)), ("z", "x", "1", at(300))]
    schema = "project string, path string, sha256 string, at timestamp"
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, feed.STATE_STORE)
    try:
        for k, rows in enumerate((first, second, first)):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = feed.verdict_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), late="1 second")
            stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.project, []).append((r.at, r.generation, r.state, r.changes))
    assert sorted(got["p"]) == [(at(0), 0, "pending", 0), (at(0.7), 1, "running", 2), (at(5), 1, "pending", 0), (at(5.5), 2, "running", 1), (at(100), 2, "pending", 0), (at(100.5), 3, "running", 1)]
    assert sorted(got["q"]) == [(at(1), 0, "pending", 0), (at(1.5), 1, "running", 1), (at(101), 1, "stopped", 0)]


def test_publishing_again_replaces_the_generation(spark, tmp_path):
    ids = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    batch = spark.range(3).withColumn("x", F.lit("y"))
    run = feed.publish(lambda: ids, lambda b: b.groupBy("x").agg(F.count(F.lit(1)).alias("n")), str(tmp_path))
    run(batch, 4)
    run(batch, 4)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "verdicts")).select("generation", "state").collect()] == [(4, "current")]
    assert spark.read.parquet(str(tmp_path / "results")).count() == 1
