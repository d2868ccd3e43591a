"""Registered page queries against their SQL, on conversations that earlier rounds' tables had none of."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from pagescore.functions.text import in_places, rounded
from pagescore.operators import scorecard
from pagescore.plans import documents
from pagescore.plans import page_queries as Q


def conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    return con


def test_declared_order_of_one_region(spark, tmp_path):
    # page 7 has one region, so its list of the first is none; page 28 has two
    rows = [(page, turn, "user", f"turn {turn} of page {page} in a few words") for page, turns in ((7, 1), (28, 2), (35, 2)) for turn in range(turns)]
    con = conversations(spark, tmp_path, rows)
    want = dict(con.execute(Q.ORACLES["scorecard_json"]).fetchall())
    got = {r["page_id"]: r["scorecard"] for r in Q.scorecard_json(spark, str(tmp_path)).collect()}
    assert got == want
    assert [json.loads(got[p])["results"][2]["metrics"]["order_signal"] for p in ("7", "28", "35")] == ["indices", "indices", "declared"]


def test_decimals_of_ties(spark, tmp_path):
    # seven of 128 letters changed: 0.9453125, which six decimals halve
    con = conversations(spark, tmp_path, [(26, 0, "user", " ".join(["ae"] * 7 + ["b" * 107]))])
    want = con.execute(Q.ORACLES["worst_retentions"]).fetchall()
    assert [tuple(r) for r in Q.worst_retentions(spark, str(tmp_path)).collect()] == want == [(26, "r0:0.945312")]


@pytest.mark.parametrize("places", [3, 6])
def test_decimals_as_printf(spark, places):
    numbers = [k / n for n in (128, 640, 3200, 16000, 7) for k in range(0, n, 3)]
    got = spark.createDataFrame([(numbers,), ([],), (None,)], "x array<double>").select(in_places("x", places)).collect()
    con = duckdb.connect()
    assert got[0][0] == [r[0] for r in con.execute(f"SELECT printf('%.{places}f', x) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [numbers]).fetchall()]
    assert got[1][0] == [] and got[2][0] is None


def test_small_numbers_on_cards(spark, tmp_path):
    # of page 4 neighbours have each other's text: one letter against 3,000 and against 12,000
    con = conversations(spark, tmp_path, [(page, turn, "user", text) for page, n in ((4, 3000), (58, 12000)) for turn, text in enumerate(("b" * n, "b"))])
    want = dict(con.execute(Q.ORACLES["scorecard_json"]).fetchall())
    assert {r["page_id"]: r["scorecard"] for r in Q.scorecard_json(spark, str(tmp_path)).collect()} == want
    worst = {page: card.partition('"worst_region_retention":')[2].partition("}")[0] for page, card in want.items()}
    assert worst["4"].startswith("0.000333") and worst["58"].startswith("8.33") and "e-05" in worst["58"]


def test_numbers_in_texts_stay(spark):
    metrics = ['{"a":9.5E-4,"b":-1.0E-4,"c":1.0E-5,"d":1.25E-12,"e":1.05E-4,"f":0.95,"g":1.0}', r'{"a":":1.0E-4,","b":[":1.0E-4,",""],"c":"\\\":1.0E-4,","d":{"e":9.0E-4}}']
    rows = [("p", "c", k, "hard", True, False, '"metrics":1.0E-4,', m) for k, m in enumerate(metrics)]
    results = spark.createDataFrame(rows, "page_id string, checker string, ordinal int, severity string, passed boolean, crashed boolean, detail string, metrics string")
    card = scorecard.as_json(results).first()["scorecard"]
    assert '"metrics":{"a":0.00095,"b":-0.0001,"c":1e-05,"d":1.25e-12,"e":0.000105,"f":0.95,"g":1}' in card
    read = json.loads(card)
    assert [r["metrics"] for r in read["results"]] == [json.loads(m) for m in metrics] and {r["detail"] for r in read["results"]} == {'"metrics":1.0E-4,'}


def test_rounding_as_sql(spark):
    numbers = [k / n for n in (800, 1600, 4000, 20000, 7) for k in range(n)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in numbers], "x double").select(rounded(F.col("x"), 4)).collect()]
    assert got == [r[0] for r in duckdb.connect().execute("SELECT round(x, 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [numbers]).fetchall()]


def test_rates_of_large_pages(spark):
    # 57 of 1,543 regions have a counterpart: F1 is 114 / 1,600, a little less than 0.07125
    gt = spark.range(1543).select(F.lit(1).alias("page_id"), F.col("id").cast("string").alias("region_id"), F.lit("body").alias("block_type"))
    cand = gt.where("cast(region_id as int) < 57")
    mapping = gt.select("page_id", F.col("region_id").alias("gt_id")).join(cand.select(F.col("region_id").alias("gt_id"), F.col("region_id").alias("cand_id")), "gt_id", "left")
    row = documents.type_verdicts(gt, cand, mapping).first()
    assert (row["micro_f1"], row["macro_f1"], row["body_f1"]) == (0.0712, 0.0712, 0.0712)


def test_suite_writes_what_it_reads(spark, tmp_path, monkeypatch):
    # split words are a second copy of each text that no check of the suite reads; candidates' last rows by id are sorted out once
    conversations(spark, tmp_path, [(page, turn, "user", f"turn {turn} of page {page}") for page in range(3) for turn in range(2)])
    wrote, plain = {}, documents.stored

    def stored(df, label):
        wrote.setdefault(label, []).append(df)
        return plain(df, label)

    monkeypatch.setattr(documents, "stored", stored)
    out = Q.results(spark, str(tmp_path))
    assert out.count() == 15 and not [label for label, rows in wrote.items() for df in rows if "words" in df.columns]
    sorts = [label for label, rows in wrote.items() for df in rows if "_last" in df._jdf.queryExecution().analyzed().toString()]
    assert sorted(sorts) == ["mapping", "own_cand"]
    assert wrote["own_cand"][0]._jdf.queryExecution().analyzed().toString().count("row_number") == 1
