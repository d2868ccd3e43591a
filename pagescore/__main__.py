"""Score page documents from a shell: python -m pagescore GROUND_TRUTH CANDIDATE [--json] [--out FOLDER]

Both are JSON files, or folders or patterns of them; pages are paired by file name, and a single file on each side is one
pair whatever their names. The exit code is 0 if no page has a hard failure. Without --out the scorecards are printed;
with it they are written as JSON lines by the tasks, and only the totals are printed.
"""

from __future__ import annotations

import argparse
import json
import sys
from itertools import groupby
from pathlib import PurePath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagescore.operators import scorecard
from pagescore.plans.documents import score
from pagescore.sources.pages import read_pages
from pagescore.sources.stored import stored


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagescore", description="Score page documents against ground truth.")
    parser.add_argument("ground_truth")
    parser.add_argument("candidate")
    parser.add_argument("--json", action="store_true", help="print scorecards as JSON")
    parser.add_argument("--out", help="folder to write scorecards to, as JSON lines")
    asked = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    gt, cand = read_pages(spark, asked.ground_truth), read_pages(spark, asked.candidate)
    if asked.ground_truth.endswith(".json") and asked.candidate.endswith(".json") and "*" not in asked.ground_truth + asked.candidate:
        cand = cand.withColumn("page_id", F.lit(PurePath(asked.ground_truth).stem))
    results = stored(score(gt, cand), "results")
    if asked.out:
        scorecard.as_json(results).select(F.to_json(F.struct("page_id", F.parse_json("scorecard").alias("scorecard")))).write.text(asked.out)
    elif asked.json:
        for row in scorecard.as_json(results).orderBy("page_id").toLocalIterator():
            print(json.dumps({"page_id": row["page_id"], **json.loads(row["scorecard"])}, indent=2))
    else:
        for page, rows in groupby(results.orderBy("page_id", "ordinal").toLocalIterator(), key=lambda r: r["page_id"]):
            print(f"{page}\n{scorecard.rendered(list(rows))}\n")
    total = scorecard.summary(results).agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("passed")).alias("failed")).first()
    print(f"{total['pages'] - total['failed']} of {total['pages']} pages passed", file=sys.stderr)
    return int(total["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
