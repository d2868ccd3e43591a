"""Verdicts of checkers as rows, scorecards a page, and checkers of one's own."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pagescore.functions.text import short_numbers

#: The default suite, in its order. Fixed values.
SUITE = ("structural-contract", "text-fidelity", "reading-order", "footnote-anchor", "structure-typing")
SEVERITIES = ("hard", "soft", "info")
RESULT = "page_id, checker, ordinal, severity, passed, crashed, detail, metrics"


@dataclass(frozen=True)
class Checker:
    """A named check over all pages: `run` gives (page_id, passed, metric columns...) from whatever it closes over, and
    detail, a text on the verdict, and error, the name of what kept a page from one, if it has these.

    severity can be set for each instance; the checks of a suite are one union, so they run as one job.
    """

    name: str
    run: Callable[[], DataFrame]
    severity: str = "hard"


def verdicts(rows: DataFrame, name: str, ordinal: int, severity: str = "hard") -> DataFrame:
    """RESULT rows of one check, with error: all its columns but page_id, passed, detail and error go into metrics as JSON,
    nulls left out. A null verdict is a crash."""
    own = [c for c in rows.columns if c not in ("page_id", "passed", "detail", "error")]
    metrics = F.to_json(F.struct(*own)) if own else F.lit("{}")
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.col("page_id").cast("string").alias("page_id"), F.lit(name).alias("checker"), F.lit(ordinal).alias("ordinal"), F.lit(severity).alias("severity"),
        F.coalesce("passed", F.lit(False)).alias("passed"), F.col("passed").isNull().alias("crashed"), F.coalesce(text("detail"), F.lit("")).alias("detail"), metrics.alias("metrics"), text("error").alias("error"),
    )


def page_check(pages: DataFrame, check: Callable[[dict, dict], tuple[bool, str, dict]]) -> DataFrame:
    """(page_id, passed, detail, error, metrics of the check as one JSON column `own`) of a check that is a plain function of
    two documents, (candidate, ground truth) -> (passed, detail, metrics), over pages (page_id, gt variant, cand variant).

    The documents go to the function page by page in Arrow batches. A page for which it raises gets no verdict and the
    exception's name as its error; the other pages are not touched by that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gt, cand in zip(batch.column("gt").to_pylist(), batch.column("cand").to_pylist(), strict=True):
                try:
                    passed, detail, own = check(json.loads(cand), json.loads(gt))
                    out.append((bool(passed), str(detail), None, json.dumps(own)))
                except Exception as raised:  # noqa: BLE001 - whatever the check raises is this page's result
                    out.append((None, str(raised), type(raised).__name__, None))
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate((pa.bool_(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], names=["page_id", "passed", "detail", "error", "own"])

    texts = pages.select("page_id", F.to_json("gt").alias("gt"), F.to_json("cand").alias("cand"))
    return texts.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, passed boolean, detail string, error string, own string").withColumn("own", F.parse_json("own"))


def run_suite(checkers: Sequence[Checker], pages: DataFrame, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """RESULT rows of all checkers for every page, in suite order. pages: page_id, and error, the name of what is wrong with
    a page's documents, if there is such a column.

    A page that a check has no row for, or whose verdict is null, fails it hard as crashed, with the error that the check or
    else the page has ("NoVerdict" if neither). The checks are one union, which meets the pages in one join. store: writes
    the verdicts of a check and reads them back; each check is then planned and run by a thread of its own.
    """

    def part(place: tuple[int, Checker]) -> DataFrame:
        rows = verdicts(place[1].run(), place[1].name, place[0], place[1].severity)
        return store(rows, place[1].name) if store else rows

    if store:
        with ThreadPoolExecutor(len(checkers)) as threads:
            parts = list(threads.map(part, enumerate(checkers)))
    else:
        parts = list(map(part, enumerate(checkers)))
    own = reduce(DataFrame.unionByName, parts)
    error = F.col("error").cast("string") if "error" in pages.columns else F.lit(None).cast("string")
    names = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(c.name).alias("checker")) for k, c in enumerate(checkers)])
    every = pages.select(F.col("page_id").cast("string").alias("page_id"), error.alias("_error"), F.inline(names))
    crashed = F.coalesce("crashed", F.lit(True))
    why = F.coalesce("error", "_error", F.lit("NoVerdict"))
    told = F.concat(F.lit("no verdict: "), why, F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(", "), F.col("detail"))).otherwise(F.lit("")))
    return every.join(own.drop("checker"), ["page_id", "ordinal"], "left").select(
        "page_id", "checker", "ordinal", F.when(crashed, "hard").otherwise(F.col("severity")).alias("severity"), F.coalesce("passed", F.lit(False)).alias("passed"), crashed.alias("crashed"),
        F.when(crashed, told).otherwise(F.col("detail")).alias("detail"),
        F.when(crashed, F.to_json(F.struct(F.lit(True).alias("crashed"), why.alias("error")))).otherwise(F.col("metrics")).alias("metrics"),
    )


def always_pass(pages: DataFrame) -> DataFrame:
    """The check that reports nothing and passes: for severity info."""
    return pages.select("page_id", F.lit(True).alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    """One row a page: total, passed_checks, hard_failures, soft_failures, crashed_checks, passed, exit_code."""
    failed = ~F.col("passed")
    counts = results.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed_checks"), F.count_if(failed & (F.col("severity") == "hard")).alias("hard_failures"),
        F.count_if(failed & (F.col("severity") == "soft")).alias("soft_failures"), F.count_if("crashed").alias("crashed_checks"),
    )
    return counts.withColumn("passed", F.col("hard_failures") == 0).withColumn("exit_code", (F.col("hard_failures") > 0).cast("int"))


def as_json(results: DataFrame) -> DataFrame:
    """(page_id, scorecard): verdict, summary and the results in order, as JSON; a result's metrics are an object, whose numbers
    are written as SQL does."""
    own = F.to_json(F.struct(F.col("checker").alias("id"), "passed", "severity", "detail"))
    metrics = short_numbers(F.to_json(F.parse_json("metrics")))
    entry = F.concat(_open(own), F.coalesce(F.concat(F.lit(',"metrics":'), metrics), F.lit("")), F.lit("}"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", entry.alias("entry"))))
    lists = results.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda r: r["entry"]), ",").alias("results"))
    row = summary(results).join(lists, "page_id")
    inner = F.struct("total", F.col("passed_checks").alias("passed"), "hard_failures", "soft_failures", F.col("crashed_checks").alias("crashed"))
    head = _open(F.to_json(F.struct("passed", "exit_code", inner.alias("summary"))))
    return row.select("page_id", F.concat(head, F.lit(',"results":['), "results", F.lit("]}")).alias("scorecard"))


def _open(json: Column) -> Column:
    """A JSON object without its closing brace."""
    return F.substring(json, F.lit(1), F.length(json) - 1)


def rendered(rows: Sequence[Row]) -> str:
    """One page's verdicts, in order, as a text table with their details."""
    width = max([len("checker"), *(len(r["checker"]) for r in rows)])
    lines = [f"{'checker':<{width}}  severity  result  detail", *(f"{r['checker']:<{width}}  {r['severity']:<8}  {'pass' if r['passed'] else 'CRASH' if r['crashed'] else 'FAIL':<6}  {r['detail']}" for r in rows)]
    failed = [r["severity"] for r in rows if not r["passed"]]
    return "\n".join([*lines, f"{len(rows) - len(failed)}/{len(rows)} passed, {failed.count('hard')} hard and {failed.count('soft')} soft failures, exit {int('hard' in failed)}"])


def render(results: DataFrame, page_id: str) -> str:
    """One page's scorecard as a text table."""
    return rendered(results.where(F.col("page_id") == page_id).orderBy("ordinal").collect())  # a row for each checker
