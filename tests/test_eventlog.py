from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagescore.operators import eventlog, matching, metrics, reports
from pagescore.sources.pages import from_citations, from_notes, primary_page
from pagescore.streaming.scorecards import dangling_refs, event_windows, score_arrivals


SONNET_LOW = {"model": "sonnet", "effort": "low"}


class Log:
    """A log under construction: each call adds a line; `given` replaces members of the line's event, None as a value too,
    and `without` leaves some out."""

    def __init__(self):
        self.lines = []

    def _line(self, event, given, without=()):
        self.lines.append(json.dumps({k: v for k, v in (event | given).items() if k not in without}))
        return self

    def raw(self, text):
        self.lines.append(text)
        return self

    def task(self, name="t-one", without=(), **given):
        return self._line({"event": "delegation", "id": name, "tier_chosen": SONNET_LOW, "tier_rubric_default": SONNET_LOW, "overfit_steps": 0, "predicted": {"tokens": 900}}, given, without)

    def done(self, name="t-one", **given):
        return self._line({"event": "disposition", "ref": name, "disposition": "accepted-with-edits", "actual_tokens": 1350}, given)

    def judged(self, name="t-one", **given):
        return self._line({"event": "review-verdict", "ref": name}, given)

    def opened(self, without=(), **given):
        return self._line({"event": "intervention", "id": "try-a", "refs": ["t-one"], "predicted_signal": {"share": 0.5}, "verdict": None}, given, without)

    def closed(self, without=(), **given):
        return self._line({"event": "intervention", "id": "try-a", "refs": ["t-one"], "verdict": "Corroborated", "diagnosis_outcome": "refuted"}, given, without)

    def frame(self, spark):
        rows = list(enumerate(self.lines, 1))
        return spark.createDataFrame(rows, "line long, raw string").select("line", F.try_parse_json("raw").alias("event"))


far = {"model": "opus", "effort": "medium"}  # a rung up in each


@pytest.mark.parametrize(
    "log,rules",
    [
        (Log().task().done().opened().closed(), set()),
        (Log().done().task(), {("error", "ref to no earlier delegation")}),
        (Log().task().task(), {("error", "duplicate delegation id")}),
        (Log().raw("[1,").task(), {("error", "not valid JSON")}),
        (Log().raw('{"event": "picnic"}'), {("error", "unknown event")}),
        (Log().task(tier_chosen={"model": "abacus", "effort": "low"}), {("error", "unknown model")}),
        (Log().task(tier_chosen={"model": "sonnet", "effort": "heroic"}), {("warning", "unknown effort")}),
        (Log().task(tier_chosen=far, overfit_steps=2), {("error", "tier gap without justification")}),
        (Log().task(tier_chosen=far, overfit_steps=2, justification="a proof is asked for"), set()),
        (Log().task(tier_chosen=far, overfit_steps=2, overkill_suspect=True), set()),
        (Log().task(tier_chosen={"model": "opus", "effort": "low"}), {("error", "overfit_steps understates the tier gap")}),
        (Log().task().done(disposition="cancelled", actual_tokens=None), set()),
        (Log().task().done(actual_tokens=None), {("warning", "no actual_tokens")}),
        (Log().task().done(disposition="mislaid"), {("error", "unknown disposition")}),
        (Log().task().judged(findings=[{"fault_layer": "weather"}]), {("error", "unknown fault_layer")}),
        (Log().task().opened(predicted_signal=None).closed(), set()),
        (Log().task().opened(without=["predicted_signal"]), {("error", "opening without predicted_signal")}),
        (Log().task().closed(), {("error", "closing without an earlier opening")}),
        (Log().task().opened().closed(without=["diagnosis_outcome"]), {("warning", "closing without diagnosis_outcome")}),
    ],
)
def test_rules(spark, log, rules):
    assert {(r["severity"], r["rule"]) for r in eventlog.problems(log.frame(spark)).collect()} == rules


def test_audit(spark):
    log = Log().task(tier_chosen=far).done().judged(retrospectively_sufficient_tier=SONNET_LOW)
    log.task("t-two").done("t-two", disposition="rework", actual_tokens=None).task("t-three").opened().closed()
    got = eventlog.audit(log.frame(spark)).first()
    assert (got["delegations"], got["overshoot_rate"], got["undershoot_rate"], got["rework_rate"]) == (3, 1.0, 0.0, 0.5) and got["review_linkage_fraction"] == pytest.approx(1 / 3)
    assert got["token_prediction_calibration"] == pytest.approx(1.5) and (got["intervention_success_rate"], got["diagnosis_hit_rate"]) == (1.0, 0.0)
    assert eventlog.audit(Log().task().frame(spark)).first()["diagnosis_hit_rate"] is None


ELEMENT = "doc_id int, element_type string, pos int, element_id string, pages array<int>, text string, char_offset int, attributes map<string,string>"


def test_matching(spark):
    gt = spark.createDataFrame(
        [(1, "note", 0, "a", [1], "first note text", 10, {}), (1, "note", 1, "b", [1], "second note here", 40, {"k": '"v"'}), (1, "note", 2, "c", [9], "far away", None, {}), (1, "note", 3, "d", [], "no page", None, {})], ELEMENT
    )
    pred = spark.createDataFrame(
        [(1, "note", 0, "x", [1], "second note hero", 40, {"k": '"w"'}), (1, "note", 1, "y", [1, 2], "first  note text", 10, {}), (1, "note", 2, "z", [3], "lone", None, {}), (1, "cite", 0, "q", [1], "other kind", None, {})], ELEMENT
    )
    got = matching.match_elements(gt, pred).cache()
    rows = {(r["gt_id"], r["pred_id"]): r for r in got.collect()}
    assert {k: r["match_type"] for k, r in rows.items()} == {("a", "y"): "exact", ("b", "x"): "partial", ("c", None): "missed", ("d", None): "missed", (None, "z"): "spurious", (None, "q"): "spurious"}
    partial = rows["b", "x"]
    assert partial["score"] == pytest.approx(0.3 + 0.5 * 30 / 32 + 0.0) and partial["error_details"] == {"text_mismatch": "true", "first_diff_pos": "15", "first_diff": "expected 'e', got 'o'", "attribute_diffs": '{"k":{"expected":"v","got":"w"}}'}
    by_type = metrics.match_metrics(got, ["element_type"]).cache()
    note = by_type.where("element_type = 'note'").first()
    assert (note["tp"], note["fp"], note["fn"], note["support"]) == (2, 1, 2, 4) and note["precision_"] == pytest.approx(2 / 3) and note["recall"] == 0.5
    errors = metrics.error_counts(got, ["element_type"]).cache()
    assert {(r["element_type"], r["error"]): r["n"] for r in errors.collect()}["note", "missed_not_found"] == 2
    total = metrics.micro_macro(by_type, []).first()
    assert (total["tp"], total["fp"], total["fn"]) == (2, 2, 2) and total["macro_precision"] == pytest.approx(1 / 3)
    base = by_type.select("element_type", F.lit(0.5).alias("f1")).where("element_type = 'note'")
    told = reports.text_report(by_type, "T", errors, base)
    assert "+0.071" in told and "missed_not_found: 2" in told
    data = json.loads(reports.json_report(by_type, errors))
    assert data["metrics"]["by_type"]["note"]["precision_"] == 0.6667 and data["top_errors"][0]["n"] == 2
    assert "class='bad'" in reports.html_report(by_type, "a<b", errors) and "a&lt;b" in reports.html_report(by_type, "a<b", errors)


def test_a_predicted_id_is_taken_once(spark):
    same = [(1, "n", k, f"g{k}", [1], "same text", None, {}) for k in range(3)]
    pred = [(1, "n", 0, "p", [1], "same text", None, {}), (1, "n", 1, "p", [1], "same text", None, {}), (1, "n", 2, "r", [1], "same text", None, {})]
    got = matching.match_elements(spark.createDataFrame(same, ELEMENT), spark.createDataFrame(pred, ELEMENT)).collect()
    assert sorted((r["gt_id"] or "", r["pred_id"] or "", r["match_type"]) for r in got) == [("g0", "p", "partial"), ("g1", "r", "partial"), ("g2", "", "missed")]


def test_notes_and_citations_of_a_document(spark):
    notes = spark.createDataFrame([(1, 0, "1", "old", "editor"), (1, 1, "1", "new", "editor")], "doc_id int, position int, label string, text string, note_type string")
    refs = spark.createDataFrame([(1, "1", 5), (1, "22", 99)], "doc_id int, label string, offset int")
    spans = spark.createDataFrame([(1, 7, 0, 10), (1, 8, 10, 20)], "doc_id int, page int, start int, end int")
    got = {r["element_id"]: r for r in from_notes(notes, refs, spans).withColumn("primary", primary_page(F.col("pages"))).collect()}
    told = {k: (r["text"], r["pages"], r["marker_text"], r["marker_page"], r["char_length"], r["attributes"]["note_type"], r["primary"]) for k, r in got.items()}
    assert told == {"fn_1": ("new", [7], "1", 7, 1, '"editor"', 7), "fn_22": ("", [], "22", -1, 2, '"author"', -1)}
    cites = spark.createDataFrame([(1, 12, "Roe 1987", {"year": "1987"}), (2, 3, "ibid", None)], "doc_id int, offset int, raw string, parsed map<string,string>")
    got = {r["element_id"]: (r["pages"], r["char_length"], r["attributes"]) for r in from_citations(cites, spans).collect()}
    assert got == {"cite_12": ([8], 8, {"year": "1987"}), "cite_3": ([], 4, {})}


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False), ("b", 4, True)], "id string, line long, defines boolean").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("id string, line long, defines boolean").parquet(source)
    query = dangling_refs(stream).writeStream.format("memory").queryName("bad").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("bad").collect()] == [("b", 3)]
    query = score_arrivals(stream, lambda df: df.groupBy("id").count(), str(tmp_path / "out"), str(tmp_path / "c2"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 01:10:00", "x", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["value"]) for r in event_windows(events).collect()) == [(1, 4.0), (2, 3.0)]
