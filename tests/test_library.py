"""Guards, readers, sinks, suites and structure helpers on small fixtures."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from episcope import session
from episcope.functions.columns import close, image_sample_count
from episcope.operators import conversion as V
from episcope.operators import digests as H
from episcope.operators import expectations as E
from episcope.operators import frames as R
from episcope.operators import lineage as L
from episcope.operators import statistics as M
from episcope.operators import transforms as X
from episcope.sources import readers as S
from episcope.sources import sinks as W
from episcope.sources import store


def test_closeness(spark):
    df = spark.createDataFrame(
        [(0.0, 9e-6), (0.0, 2e-5), (1e6, 1e6 + 0.05), (1e6, 1e6 + 0.2), (float("nan"), 1.0), (None, 1.0), (float("nan"), float("nan"))],
        "a double, b double",
    )
    assert [r[0] for r in df.select(close(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False, False, False]


def test_image_sample_count(spark):
    df = spark.createDataFrame([(1,), (99,), (100,), (300,), (10_000,), (10_000_000,)], "n long")
    assert [r[0] for r in df.select(image_sample_count("n")).collect()] == [1, 99, 100, 100, 1000, 10_000]


def test_unique_guard_fails_the_job(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    with pytest.raises(PySparkException):
        L.guard_unique(df, ["k"]).collect()
    assert L.guard_unique(df.distinct(), ["k"]).count() == 2


def test_half_even_lookup(spark):
    tasks = spark.createDataFrame([(2, "two"), (3, "three")], "task_index long, task string")
    df = spark.createDataFrame([(2.5,), (3.5,), (2.4,)], "i double")
    out = L.resolve_reference(df, tasks, F.col("i")).orderBy("i").collect()
    assert [(r.lookup_index, r.resolved_text) for r in out] == [(2, "two"), (2, "two"), (4, None)]


def test_rename_by_pattern():
    names = ["observation/a", "observation/b", "action", "junk"]
    rules = {r"observation/(.*)": r"state/\1", r"j.*": None, r".*": "x"}
    assert X.renamed_by_pattern(names, rules) == {"observation/a": "state/a", "observation/b": "state/b", "action": "x", "junk": None}
    with pytest.raises(ValueError):
        X.renamed_by_pattern(["a", "b"], {"[ab]": "c"})
    with pytest.raises(ValueError):
        X.renamed_by_pattern(["a", "b"], {"b": "a/c"})


def test_missing_prompt_and_statistics_are_errors(spark):
    frames = spark.createDataFrame([(1,), (9,)], "task_index long")
    tasks = spark.createDataFrame([(1, "one")], "task_index long, task string")
    with pytest.raises(PySparkException):
        X.prompt_from_task(frames, tasks).collect()
    assert {r.prompt for r in X.prompt_from_task(frames, tasks, "any").collect()} == {"one", "any"}
    with pytest.raises(ValueError):
        X.require_columns(frames, ["state"])


def test_masks():
    assert X.run_length_mask(2, -2, 1) == [True, True, False, False, True]
    assert X.run_length_mask(2, 0, 1) == [True, True, True]


def test_converted_set_is_rejected(spark):
    from episcope.operators.conversion import convert_pose_columns

    df = spark.createDataFrame([([0.0] * 7, 2)], "pose array<double>, v int")
    with pytest.raises(PySparkException):
        convert_pose_columns(df, "pose", "v", 2).collect()


def test_suite_keeps_failure_to_run_apart(spark):
    df = spark.createDataFrame([("faulty", 1.0), ("faulty", float("nan")), ("reference", 2.0)], "branch string, x double")
    out = E.run_suite(df, [E.not_null("x"), E.between("x", 2.0), E.not_null("y")], by=["branch"])
    rows = {(r.branch, r.ordinal): (r.status, r.success, r.unexpected_count, r.element_count) for r in out.collect()}
    assert rows["faulty", 0] == ("EXECUTED", False, 1, 2)
    assert rows["faulty", 1] == ("EXECUTED", False, 1, 1)
    assert rows["reference", 2] == ("NOT_EXECUTED", None, None, None)
    outcome = {r.branch: r.success for r in E.suite_outcome(out, ["branch"]).collect()}
    assert outcome == {"faulty": None, "reference": None}


def test_verdict_ladder(spark):
    rows = [("a", 0, 1), ("b", 0, 0), ("c", 1, 1), ("d", 1, 0), ("e", None, 1)]
    flat = [(c, "arm", b, None if v is None else bool(v)) for c, f, r in rows for b, v in (("faulty", f), ("reference", r))]
    df = spark.createDataFrame(flat, "case string, arm string, branch string, success boolean")
    got = {r.case: r.verdict for r in E.paired_verdict(df).collect()}
    assert got == {"a": "DETECTED", "b": "ALWAYS_FAIL", "c": "MISSED", "d": "REFERENCE_FALSE_POSITIVE_ONLY", "e": "NOT_EXECUTED"}


def test_fit_suite_limits_value_sets(spark):
    df = spark.range(40).select(
        F.concat(F.lit("v"), (F.col("id") % 20).cast("string")).alias("few"), F.col("id").cast("string").alias("many"), "id"
    )
    kinds = [(e.type, e.kwargs.get("column")) for e in E.fit_suite(df)]
    assert ("distinct_in_set", "few") in kinds and ("distinct_in_set", "many") not in kinds
    assert ("between", "id") in kinds


def test_rule_registry():
    assert {"window_selection", "interval_chain", "anchor", "not_null", "unique"} <= set(E.RULES)


def test_digest_text_set(spark):
    df = spark.createDataFrame([("a", "b|a|c"), ("d", "b|a|c")], "d string, s string")
    assert [r[0] for r in df.select(E.digest_in_text(F.col("d"), F.col("s"))).collect()] == [True, False]


def test_disabled_columns_are_listed(spark):
    a = spark.createDataFrame([(1, 2)], "x long, y long")
    b = spark.createDataFrame([(3, 4)], "x long, z long")
    union, disabled = R.common_features_union({"a": a, "b": b})
    assert union.columns == ["x", "dataset_index"] and union.count() == 2
    assert {tuple(r) for r in disabled.collect()} == {("a", "y"), ("b", "z")}
    with pytest.raises(ValueError):
        R.common_features_union({"a": a.select("y"), "b": b.select("z")})


def test_chained_ledger(spark):
    """A ledger whose digests cover the predecessor; one altered payload breaks one digest only."""
    rows, previous = [], "0" * 64
    for i in range(1, 6):
        event = "RUN_COMPLETE" if i == 5 else "STEP"
        claimed = hashlib.sha256(f"{i}|{previous}|bind|{event}|p{i}".encode()).hexdigest()
        rows.append(("L", i, previous, claimed, "bind", event, f"p{i}"))
        previous = claimed
    schema = "ledger string, sequence long, previous string, claimed string, binding string, event string, payload string"
    hashed = ["sequence", "previous", "binding", "event", "payload"]
    good = H.ledger_verify(spark.createDataFrame(rows, schema), hashed).withColumn("ok", H.ledger_accepted()).first()
    assert good["ok"]
    rows[2] = (*rows[2][:6], "altered")
    bad = H.ledger_verify(spark.createDataFrame(rows, schema), hashed).first()
    assert (bad["digest_mismatches"], bad["predecessor_breaks"]) == (1, 0)


def test_files_json_and_reports(spark, tmp_path):
    (tmp_path / "objects").mkdir()
    for name, data in (("a.bin", b"alpha"), ("b.bin", b"beta")):
        (tmp_path / "objects" / name).write_bytes(data)
    objects = S.read_objects(spark, str(tmp_path / "objects")).withColumn("path", F.element_at(F.split("path", "/"), -1))
    manifest = spark.createDataFrame(
        [("a.bin", 5, hashlib.sha256(b"alpha").hexdigest()), ("b.bin", 4, "0" * 64), ("c.bin", 1, "0" * 64)],
        "path string, size long, sha256 string",
    )
    found = {r.path: r.problem for r in H.verify_digests(objects, manifest).collect()}
    assert found == {"b.bin": "content changed", "c.bin": "missing"}

    (tmp_path / "info.json").write_text(json.dumps({"fps": 15, "features": {"state": {"shape": [14]}}}, indent=2))
    info = S.read_json_document(spark, str(tmp_path / "info.json"))
    assert info.select("fps", "features.state.shape").first()[1] == [14]
    (tmp_path / "tasks.jsonl").write_text('{"task_index": 0, "task": "pick"}\n{"task_index": 1, "task": "place"}\n')
    assert S.read_json_lines(spark, str(tmp_path / "tasks.jsonl"), "task_index long, task string").count() == 2

    report = spark.createDataFrame([("b", 2), ("a", 1)], "g string, n long")
    W.write_report_csv(report, str(tmp_path / "csv"), ["g"])
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["g,n", "a,1", "b,2"]


def test_missing_shard_column(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError):
        S.read_episodes(spark, str(tmp_path / "e"), ["id", "nope"])


def test_coverage_gate_order(spark):
    declared = spark.createDataFrame([(10,)], "length long")

    def status(rows, bad, nulls=0, lengths=0, unknown=0):
        totals = spark.createDataFrame(
            [(rows, 1, bad, nulls, lengths)],
            "rows long, episodes long, violating_rows long, null_rows long, length_errors long",
        )
        found = spark.range(unknown)
        return R.coverage_gate(totals, found, declared).first()["status"]

    assert [status(10, 0), status(10, 3), status(9, 3)] == ["PASS", "CHECK_FAILED", "INCOMPLETE"]
    assert [status(10, 0, nulls=1), status(10, 0, lengths=1), status(10, 0, unknown=1)] == ["INCOMPLETE"] * 3


def test_an_append_that_is_run_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(2, 7), (1, 5), (3, 4)], "k long, length long")
    assert store.append_episodes(path, rows, ["k"], "a", per_file=2)
    assert not store.append_episodes(path, rows, ["k"], "a", per_file=2)
    # An append that died before its commit left rows behind; the next try writes over them.
    spark.range(50).write.parquet(f"{path}/episodes/commit=b")
    assert store.read_store(spark, path).count() == 3
    assert store.append_episodes(path, rows.where("k = 2"), ["k"], "b")
    got = store.read_store(spark, path).orderBy("episode_index").drop("k").collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 5, 0), (7, 1, 5, 12, 0), (4, 2, 12, 16, 1), (7, 3, 16, 23, 2)]
    assert store.append_episodes(path, rows.limit(0), ["k"], "empty")
    assert store.append_episodes(path, rows.where("k = 2"), ["k"], "c")
    assert store.read_store(spark, path).agg({"dataset_to_index": "max"}).first()[0] == 30
    with pytest.raises(ValueError):
        store.append_episodes(path, rows, ["k"], "../x")


def test_documents_of_unknown_shape(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('{"a": {"min": [1, 2.5], "deep": [[[3]], [[4], [5]]], "n": 6, "text": ["x"]}, "b": 7, "c": {}}')
    (tmp_path / "d" / "two.json").write_text('[1, 2]')
    documents = S.read_documents(spark, str(tmp_path / "d"))
    features = S.document_entries(documents, "document")
    metrics = S.document_entries(features.drop("file").withColumnRenamed("name", "feature"), "entry")
    got = S.document_values(metrics, "entry").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        ("a", "min", "0", 1.0), ("a", "min", "1", 2.5), ("a", "deep", "0/0/0", 3.0), ("a", "deep", "1/0/0", 4.0), ("a", "deep", "1/1/0", 5.0),
        ("a", "n", "", 6.0), ("a", "text", "0", None)], key=repr)
    inner = S.document_entries(documents, "document", "$.a").collect()
    assert {r["name"] for r in inner} == {"min", "deep", "n", "text"}


def test_what_a_rule_saw(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (7, "b", 1.0), (9, None, 0.5)], "x long, s string, y double")
    suite = [E.between("x", 0, 5), E.distinct_in_set("s", ["a"]), E.pair_greater("y", "x"), E.not_null("s"), E.row_count_equal(3), E.not_null("gone")]
    got = [r["observed"] for r in E.run_suite(df, suite, observed=True).orderBy("ordinal").collect()]
    assert got == ["7", "b", '{"y":0.5,"x":9}', None, "3", None]
    assert "observed" not in E.run_suite(df, suite).columns


def test_statistics_contract_over_discovered_features(spark):
    metrics = ("min", "q01", "q10", "q50", "q90", "q99", "max", "mean", "std", "count")
    good = {"min": [0.0], "q01": [0.1], "q10": [0.2], "q50": [1.0], "q90": [1.5], "q99": [1.9], "max": [2.0], "mean": [1.0], "std": [0.816496580927726], "count": [3.0]}
    bad = good | {"q10": [1.8], "std": [-0.5], "count": [4.0]}
    rows = [(3, *[good[m] for m in metrics], [1.0]), (3, *[bad[m] for m in metrics], [1.0]), (3, *[None] * 10, None)]
    names = [f"stats/frame_index/{m}" for m in metrics]
    meta = spark.createDataFrame(rows, "length long, " + ", ".join(f"`{n}` array<double>" for n in [*names, "stats/other/min"]))
    got = {r["counter"]: r["violations"] for r in M.contract_statistics(meta, 15.0).collect()}
    assert got["features_without_metrics"] == 1
    assert got["quantile_order_bad"] == got["negative_std"] == 1
    assert got["frame_index_closed_form"] == 2 and got["timestamp_closed_form"] == got["task_not_constant"] == 0
    none = {r["counter"]: r["violations"] for r in M.contract_statistics(meta.select("length", "`stats/other/min`")).collect()}
    assert none.pop("features_without_metrics") == 1 and set(none.values()) == {0}


def test_structure_accepts_what_values_do_not(spark):
    kind = "path string, row long, value array<double>"
    source = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 1, [3.0])], kind)
    same = source.withColumn("version", F.lit(2))
    swapped = spark.createDataFrame([("a", 1, [2.0, 1.0]), ("b", 1, [3.0])], kind).withColumn("version", F.lit(2))
    assert tuple(V.schema_baseline(source, swapped, "version", 2).first()) == (2, 2, True, 2, 2, 1, 2, 2, True)
    assert V.schema_baseline(source, same, "version", 2).first()["unchanged"] == 2
    wide = spark.createDataFrame([("a", 1, [2.0, 1.0, 0.0]), ("c", 1, [3.0])], kind).withColumn("version", F.lit(1))
    assert tuple(V.schema_baseline(source, wide, "version", 2).first()) == (2, 2, False, 0, 1, 0, 1, 1, False)


def test_fitted_parameters_equal_the_fitted_suite(spark):
    fixture = spark.createDataFrame([(1, 0.5, "a", True), (4, None, "b", False)], "i long, x double, s string, b boolean")
    rows = spark.createDataFrame([(0, 0.5, "a", True), (5, 0.4, "z", True), (2, None, None, None)], "i long, x double, s string, b boolean")
    row, late = E.fit_parameters(fixture)
    asked = E.run_suite(rows.crossJoin(F.broadcast(row)), late[1:]).where("success = false").select("type", "unexpected_count")
    known = E.run_suite(rows, E.fit_suite(fixture)[1:]).where("success = false").select("type", "unexpected_count")
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, known.collect())) != []


def test_scratch_tables_of_an_application_can_be_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_folder", lambda _: str(tmp_path))
    assert session.written(spark.range(5), "some").count() == 5
    assert session.release_scratch(spark) and not session.release_scratch(spark)
    assert not (tmp_path / spark.sparkContext.applicationId).exists()
