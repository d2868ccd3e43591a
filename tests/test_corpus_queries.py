from __future__ import annotations

import random

import duckdb
import pytest

from pagescore.operators import eventlog, fidelity
from pagescore.plans import corpus_queries as Q


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_logs_are_read_whole(spark, tmp_path):
    rng = random.Random(4)
    ids = sorted({*range(3960, 4040), *rng.sample(range(5000, 90_000), 700), 2**33, 2**33 + 1})
    events = [(i, rng.randrange(60), rng.choice(["signup", "purchase", "view", "click", "odd"])) for i in ids]
    put(spark, tmp_path, "events", events, "event_id long, user_id long, event_type string")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {(r, s): n for r, s, n in con.execute(Q.ORACLES["log_guardrail"]).fetchall()}
    got = {(r["rule"], r["severity"]): r["n"] for r in Q.log_guardrail(spark, str(tmp_path)).collect()}
    assert got == want and len(want) == 16
    # some of it by hand, over all ids
    defined: dict = {}
    for i, user, kind in events:
        if kind == "signup":
            defined.setdefault(user, i)
    assert want["ref to no earlier delegation", "error"] == sum(defined.get(u, i) >= i for i, u, k in events if k in ("purchase", "view") or k == "click" and i % 2)
    assert want["not valid JSON", "error"] == sum(k == "click" and i % 2 == 0 for i, _, k in events) and want["unknown event", "error"] == sum(k == "odd" for *_, k in events)
    audit = con.execute(Q.ORACLES["log_audit"])
    want = dict(zip([c[0] for c in audit.description], audit.fetchall()[0], strict=True))
    got = Q.log_audit(spark, str(tmp_path)).first().asDict()
    assert got == pytest.approx(want) and all(v is not None for v in got.values()) and got["delegations"] == len(defined)
    plan = eventlog.problems(Q._as_log(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_elements_are_whole_turns(spark, tmp_path):
    same = " ".join(f"w{k}" for k in range(12))
    turns = [same + " " + " ".join(["ease"] * 40), same, " a  b\n" + same, None]
    put(spark, tmp_path, "conversations", [(4, k, "user", t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    gt, pred = Q.elements(spark, str(tmp_path))
    want = [None if t is None else " ".join(t.split()) for t in turns]
    assert [r["text"] for r in gt.orderBy("pos").collect()] == want
    got = {r["element_id"]: r["text"] for r in pred.collect()}
    assert got == {f"e{k}": t and (t.translate(str.maketrans("eo", "xy")) if (124 + k) % 4 == 0 else t) for k, t in enumerate(want) if (124 + k) % 9}
    # equal in 12 words, different after them: not an exact match
    first = {r["gt_id"]: r for r in Q.element_matches(spark, str(tmp_path)).collect()}["e0"]
    assert (first["match_type"], first["pred_id"]) == ("partial", "e0") and '"first_diff_pos":"%d"' % (len(same) + 1) in first["error_details"]


def test_words_of_any_script(spark, tmp_path):
    pairs = [("e\u0301te\u0301 au lait", "\u00e9t\u00e9 AU lait"), ("\u03bb\u03cc\u03b3\u03bf\u03c2 a b", "\u039b\u038c\u0393\u039f\u03a3 a b"), ("\ufb01ne Stra\u00dfe x", "fine STRASSE x"), ("Plain A-1", "plain a 1")]
    rows = [(2 * k + side, t) for k, pair in enumerate(pairs) for side, t in enumerate(pair)] + [(90, None), (91, "")]
    put(spark, tmp_path, "documents", rows, "doc_id long, text string")
    put(spark, tmp_path, "benchmark", [(k, b) for k, (_, b) in enumerate(pairs)], "item_id long, text string")
    got = {r["region_id"]: r["words"] for r in fidelity.worded(spark.createDataFrame([("p", k, t) for k, t in rows], "page_id string, region_id long, text string")).collect()}
    for k in range(len(pairs)):
        assert got[2 * k] == got[2 * k + 1] and len(got[2 * k]) == 3
    assert got[90] == got[91] == []
    sizes = {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["n_distinct"]) for r in Q.normalize_tokens(spark, str(tmp_path)).collect()}
    assert all(sizes[2 * k] == sizes[2 * k + 1] and sizes[2 * k][1:] == (3, 3) for k in range(len(pairs))) and sizes[90] == (None, 0, 0)
