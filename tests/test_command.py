"""The suite over documents in files, and its exit code."""

from __future__ import annotations

import copy
import json

from pagescore.__main__ import main
from tests.test_pages import PAGE


def put(folder, pages):
    folder.mkdir()
    for name, page in pages.items():
        (folder / f"{name}.json").write_text(json.dumps(page))
    return str(folder)


def test_folders_and_exit_codes(spark, tmp_path):
    blank = copy.deepcopy(PAGE)
    blank["regions"][2]["text"] = ""
    gt = put(tmp_path / "gt", {"a": PAGE, "b": PAGE, "lone": PAGE})
    cand = put(tmp_path / "cand", {"a": PAGE, "b": blank, "unasked": PAGE})
    assert main([gt, cand, "--out", str(tmp_path / "out")], spark) == 1
    lines = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    cards = {line["page_id"]: line["scorecard"] for line in lines}
    assert {k: c["passed"] for k, c in cards.items()} == {"a": True, "b": False, "lone": False}
    assert [r["id"] for r in cards["b"]["results"] if not r["passed"]] == ["text-fidelity"] and cards["lone"]["summary"]["crashed"] == 5


def test_bad_files_crash_their_own_pages_only(spark, tmp_path):
    """One file that is cut off, one with a key twice, one with NaN, on either side: five crashed results each, the rest is scored."""
    gt = put(tmp_path / "gt", {k: PAGE for k in ("good", "cut", "twice", "nan", "list", "none", "bare")})
    cand = put(tmp_path / "cand", {"good": PAGE, "bare": {}, "list": [PAGE]})
    text = json.dumps(PAGE)
    (tmp_path / "cand" / "cut.json").write_text(text[:-5])
    (tmp_path / "cand" / "twice.json").write_text(text[:-1] + ', "regions": []}')
    (tmp_path / "gt" / "nan.json").write_text(text.replace('"y0": 1.0', '"y0": NaN'))
    (tmp_path / "cand" / "nan.json").write_text(text)
    assert main([gt, cand, "--out", str(tmp_path / "out")], spark) == 1
    lines = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    cards = {line["page_id"]: line["scorecard"] for line in lines}
    error = {"cut": "JSONDecodeError", "twice": "RepeatedKey", "nan": "NotFinite", "list": "NotAnObject", "none": "MissingCandidate"}
    for page, name in error.items():
        card = cards[page]
        assert card["summary"] == {"total": 5, "passed": 0, "hard_failures": 5, "soft_failures": 0, "crashed": 5}, page
        assert all(r["metrics"] == {"crashed": True, "error": name} and r["detail"] == f"no verdict: {name}" for r in card["results"])
    assert cards["good"]["passed"] and cards["good"]["summary"]["passed"] == 5
    bare = {r["id"]: r for r in cards["bare"]["results"]}
    assert cards["bare"]["summary"]["crashed"] == 0 and bare["reading-order"]["metrics"]["missing"] == 4 and bare["text-fidelity"]["detail"].endswith("short of text: head, note, one, two")
    order = bare["reading-order"]
    assert order["detail"].endswith("without a place: head, one, two, note") and order["metrics"]["gt_order_signal"] == "declared" and order["metrics"]["order_signal"] == "array"


def test_a_check_of_ones_own_that_raises(spark):
    """Its page gets the exception's name; pages for which it doesn't raise keep their verdicts."""
    from pyspark.sql import functions as F

    from pagescore.operators import scorecard

    rows = [("a", json.dumps(PAGE)), ("b", '{"regions": 5}'), ("c", '{"regions": []}')]
    pages = spark.createDataFrame(rows, "page_id string, j string").select("page_id", F.parse_json("j").alias("gt"), F.parse_json("j").alias("cand"))

    def count(cand, gt):
        return len(cand["regions"]) > 0, f"{len(cand['regions'])} regions", {"n": len(cand["regions"])}

    suite = [scorecard.Checker("count", lambda: scorecard.page_check(pages, count), "soft"), scorecard.Checker("always-pass", lambda: scorecard.always_pass(pages), "info")]
    got = {(r["page_id"], r["checker"]): r for r in scorecard.run_suite(suite, pages).collect()}
    own = {p: (got[p, "count"]["passed"], got[p, "count"]["crashed"], got[p, "count"]["severity"]) for p in "abc"}
    assert own == {"a": (True, False, "soft"), "b": (False, True, "hard"), "c": (False, False, "soft")}
    assert json.loads(got["b", "count"]["metrics"]) == {"crashed": True, "error": "TypeError"} and "has no len" in got["b", "count"]["detail"]
    assert json.loads(got["a", "count"]["metrics"]) == {"own": {"n": 4}} and got["a", "count"]["detail"] == "4 regions" and all(got[p, "always-pass"]["passed"] for p in "abc")


def test_one_pair_of_files(spark, tmp_path, capsys):
    put(tmp_path / "x", {"truth": PAGE, "made": PAGE})
    assert main([f"{tmp_path}/x/truth.json", f"{tmp_path}/x/made.json"], spark) == 0
    assert "5/5 passed" in capsys.readouterr().out
