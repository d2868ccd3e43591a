"""Page documents: flattening, order, the contract and the suite, with changes that trip one check each."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagescore.operators import contract, fidelity, mutate, order, regions, scorecard, structure
from pagescore.operators.alignment import align
from pagescore.sources.pages import read_elements, read_log, read_pages


def region(rid, label="text_block", text="", index=None, y=0.0, **more):
    return {"id": rid, "label": label, "text": text, "bbox": {"x0": 0.1, "y0": y, "x1": 0.9, "y1": y + 0.9}, **({"reading_order_index": index} if index is not None else {}), **more}


PAGE = {
    "regions": [
        region("head", "section_header", "First Book", 0, 0.0),
        region("one", "text_block", "Many words of a long body are kept here, with a mark¹ in their midst.", 1, 1.0, text_anchors=["¹"]),
        region("two", "text_block", "Another body speaks of other things and ends without a sign of any kind.", 2, 2.0),
        region("note", "note_area", "¹ A note tells where the first body has its words from.", 3, 3.0, semantic_labels=["note"]),
    ],
    "reading_order": ["head", "one", "two", "note"],
}


def frame(spark, docs):
    rows = [(k, json.dumps(d) if not isinstance(d, str) else d) for k, d in docs.items()]
    return spark.createDataFrame(rows, "page_id string, j string").select("page_id", F.parse_json("j").alias("doc"))


def suite(spark, gt, cand):
    """{page: {checker: passed}} of candidate documents against ground-truth documents."""
    a, b = frame(spark, gt), frame(spark, cand)
    ra, rb = regions.flatten(a).cache(), regions.flatten(b).cache()
    la, lb = regions.last_by_id(ra, ["page_id"]), regions.last_by_id(rb, ["page_id"])
    mapping = align(la, lb).cache()
    placed = order.positions(regions.reading_order(a, ra), regions.reading_order(b, rb), mapping)

    def both():
        x, y = contract.contract_check(a, contract.violations(a), "gt"), contract.contract_check(b, contract.violations(b), "candidate")
        return x.withColumnRenamed("passed", "p").join(y.withColumnRenamed("passed", "q"), "page_id").withColumn("passed", F.col("p") & F.col("q")).drop("p", "q")

    runs = (both, lambda: fidelity.text_fidelity(ra, lb, mapping), lambda: order.order_check(placed), lambda: structure.anchor_check(ra, lb, mapping), lambda: structure.type_check(structure.type_counts(ra, rb, mapping)))
    results = scorecard.run_suite([scorecard.Checker(n, r) for n, r in zip(scorecard.SUITE, runs, strict=True)], a.select("page_id")).cache()
    out = {}
    for r in results.collect():
        out.setdefault(r["page_id"], {})[r["checker"]] = r["passed"]
    return out, results


def changed(**edits):
    page = json.loads(json.dumps(PAGE))
    for k, v in edits.items():
        page[k] = v
    return page


def with_region(rid, **edits):
    page = json.loads(json.dumps(PAGE))
    for r in page["regions"]:
        if r["id"] == rid:
            r.update(edits)
    return page


def test_changes_trip_one_check_each(spark):
    swapped = changed(reading_order=["head", "two", "one", "note"])
    swapped["regions"][1]["reading_order_index"], swapped["regions"][2]["reading_order_index"] = 2, 1
    renamed = json.loads(json.dumps(PAGE).replace('"one"', '"uno"').replace('"two"', '"due"'))
    cases = {
        "same": (PAGE, set()),
        "renamed": (renamed, set()),
        "letter": (with_region("head", text="First Bock"), set()),
        "noanchor": (with_region("one", text=PAGE["regions"][1]["text"].replace("¹", "")), {"footnote-anchor"}),
        "order": (swapped, {"reading-order"}),
        "label": (with_region("head", label="text_block"), {"structure-typing"}),
        "blank": (with_region("head", text=""), {"text-fidelity"}),
        "smear": (with_region("two", text=" ".join(r["text"] for r in PAGE["regions"])), {"text-fidelity"}),
        "duplicate": (changed(regions=[*PAGE["regions"], PAGE["regions"][2]]), {"structural-contract"}),
        "partial": (changed(reading_order=["head"]), {"structural-contract"}),
        "mistyped": (changed(reading_order="head one"), {"structural-contract"}),
    }
    got, results = suite(spark, {k: PAGE for k in cases}, {k: v[0] for k, v in cases.items()})
    for k, (_, failing) in cases.items():
        failed = {c for c, ok in got[k].items() if not ok}
        assert failed == failing, (k, failed)
    told = {r["page_id"]: r for r in scorecard.summary(results).collect()}
    assert told["same"]["exit_code"] == 0 and told["order"]["exit_code"] == 1 and told["order"]["hard_failures"] == 1
    card = json.loads(scorecard.as_json(results).where("page_id = 'blank'").first()["scorecard"])
    assert card["summary"]["passed"] == 4 and [r["id"] for r in card["results"]] == list(scorecard.SUITE)
    assert set(card["results"][0]) == {"id", "passed", "severity", "detail", "metrics"} and card["results"][1]["metrics"]["gross"] == 1
    assert "4/5 passed, 1 hard and 0 soft failures, exit 1" in scorecard.render(results, "blank")


def test_flatten_and_order(spark):
    nested = {"regions": [region("P", index=5, children=[region("K", children=[region("L")]), "junk", region("M")]), 7, region("Q", index=1), {"label": "text_block", "children": [region("N")]}]}
    declared = {**nested, "regions": [nested["regions"][0], nested["regions"][2]], "reading_order": ["Q", "P", "K", "L", "M"]}
    broken = {**declared, "reading_order": ["Q", "K", "P", "L", "M"]}
    pages = frame(spark, {"n": nested, "d": declared, "b": broken, "e": {"regions": "none"}, "x": {}})
    flat = regions.flatten(pages)
    ids = lambda p: [r["region_id"] for r in flat.where(F.col("page_id") == p).orderBy("path").collect()]
    assert ids("n") == ["P", "K", "L", "M", "Q", "", "N"] and ids("e") == [] == ids("x")
    rows = regions.reading_order(pages, flat).orderBy("rank").collect()
    seq = lambda p: [r["region_id"] for r in rows if r["page_id"] == p]
    signal = {r["page_id"]: r["signal"] for r in rows}
    assert signal == {"n": "indices", "d": "declared", "b": "indices"}
    assert seq("d") == ["Q", "P", "K", "L", "M"] == seq("b") and seq("n") == ["Q", "N", "P", "K", "L", "M"]


def test_contract_kinds(spark):
    deep = region("d32")
    for k in range(31, -1, -1):
        deep = region(f"d{k}", children=[deep])
    bottom = deep
    while bottom["children"]:
        bottom = bottom["children"][0]
        bottom.setdefault("children", [])
    flawed = {
        "null": {"regions": [region("a"), None, 3]},
        "noid": {"regions": [{"text": "x"}, {"id": ""}, {"id": 7}]},
        "dup": {"regions": [region("a", children=[region("a")])]},
        "deep": {"regions": [deep]},
        "index": {"regions": [region("a", index=1.5), region("b", index=True), region("c", index=2)]},
        "order": {"regions": [region("a")], "reading_order": None},
        "empty": {"regions": [region("a")], "reading_order": []},
        "entries": {"regions": [region("a"), region("b")], "reading_order": ["a", 5, "a", "ghost"]},
        "against": {"regions": [region("a", index=1), region("b", index=0)], "reading_order": ["a", "b"]},
        "fine": PAGE,
    }
    found = {}
    for r in contract.violations(frame(spark, flawed)).collect():
        found.setdefault(r["page_id"], {}).setdefault(r["kind"], set()).add(r["offender"])
    n = lambda p: {k: len(v) for k, v in found.get(p, {}).items()}
    assert n("fine") == {} and n("null") == {"non_object_regions": 2} and n("noid") == {"regions_without_id": 3} and n("dup") == {"duplicate_region_ids": 1}
    assert n("deep") == {"regions_below_depth_cap": 1} and n("index") == {"non_integer_reading_order_index": 2} and n("order") == {"reading_order_not_a_list": 1}
    assert n("empty") == {"order_omits_regions": 1, "order_breaks_block_structure": 1}
    assert n("entries") == {"non_string_order_entries": 1, "duplicate_order_entries": 1, "order_refs_no_region": 1, "order_omits_regions": 1, "order_breaks_block_structure": 1}
    assert n("against") == {"order_contradicts_indices": 2}


def test_changes_of_whole_documents(spark):
    """Each change breaks the rules that it should, and leaves other members as they are."""
    deep = regions.DEPTH_CAP + 3
    page = frame(spark, {"p": PAGE | {"lang": "en"}})
    cases = {
        "cut": (mutate.truncate_reading_order(page), {"order_omits_regions": ["note", "one", "two"], "order_breaks_block_structure": 1}),
        "ghost": (mutate.phantom_reading_order(page, ["head", "x"]), {"order_refs_no_region": ["x"], "order_omits_regions": ["note", "one", "two"], "order_breaks_block_structure": 1}),
        "backwards": (mutate.reverse_root_indices(page), {"order_contradicts_indices": ["head", "note", "one", "two"]}),
        "typed": (mutate.mistype_reading_order(page, "head"), {"reading_order_not_a_list": ["STRING"]}),
        "null": (mutate.append_region(page, None), {"non_object_regions": 1}),
        "nameless": (mutate.append_region(page, {"text": "who am I"}), {"regions_without_id": 1}),
        "deep": (mutate.nest_regions(page, deep), {"regions_below_depth_cap": ["below32"], "order_omits_regions": 32, "order_breaks_block_structure": 1}),
    }
    every = None
    for name, (changed_pages, _) in cases.items():
        own = changed_pages.withColumn("page_id", F.lit(name))
        every = own if every is None else every.unionByName(own)
    assert {r[0] for r in every.select(F.variant_get("doc", "$.lang", "string")).collect()} == {"en"}
    got: dict = {}
    for r in contract.sorted_offenders(contract.violations(every)).collect():
        got.setdefault(r["page_id"], {})[r["kind"]] = r["offenders"]
    for name, (_, want) in cases.items():
        assert {k: len(v) if isinstance(want.get(k), int) else v for k, v in got[name].items()} == want, name


def test_lis_and_tau(spark):
    import itertools

    rows = [(str(k), f"r{i}", i, p) for k, perm in enumerate(itertools.permutations(range(4))) for i, p in enumerate(perm)] + [("none", "r0", 0, None)]
    placed = spark.createDataFrame(rows, "page_id string, gt_id string, pos int, cand_pos int")
    got = {r["page_id"]: r for r in order.order_check(placed).collect()}
    for k, perm in enumerate(itertools.permutations(range(4))):
        pairs = [(a, b) for i, a in enumerate(perm) for b in perm[i + 1 :]]
        best = max(len(c) for n in range(5) for c in itertools.combinations(perm, n) if list(c) == sorted(c))
        assert got[str(k)]["tau"] == pytest.approx(sum(1 if a < b else -1 for a, b in pairs) / 6) and got[str(k)]["lis_ratio"] == best / 4
    assert got["none"]["coverage"] == 0.0 and got["none"]["tau"] == 1.0 and not got["none"]["passed"]


def test_mutators(spark):
    flat = regions.flatten(frame(spark, {"p": PAGE}))
    text = lambda df: {r["region_id"]: r["text"] for r in df.collect()}
    letters = sum(c.isalpha() for r in PAGE["regions"] if r["label"] == "text_block" for c in r["text"])
    got = text(mutate.corrupt_letters(flat, 0.05, "#"))
    assert sum(t.count("#") for t in got.values()) == letters // 20 and got["note"] == PAGE["regions"][3]["text"]
    assert "¹" not in text(mutate.drop_anchors(flat))["one"]
    assert text(mutate.swap_values(flat, "one", "two", "text"))["one"] == PAGE["regions"][2]["text"]
    assert text(mutate.single_char_error(flat, "head", "Book", "Bock"))["head"] == "First Bock"
    assert spark.range(1).select(mutate.strip_standalone(F.lit("a1 1 b 1."), "1")).first()[0] == "a1  b ."
    assert {r["region_id"] for r in mutate.rename_ids(flat, "z").collect()} == {"z1", "z2", "z3", "z4"}
    assert mutate.duplicate_region(flat, "one").count() == 5 and text(mutate.blank_text(flat, "one"))["one"] == ""


def test_sources(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "p1.json").write_text(json.dumps(PAGE))
    assert regions.flatten(read_pages(spark, str(tmp_path / "pages"))).count() == 4
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "p2.json").write_text("[1]")
    (tmp_path / "bad" / "p3.json").write_text('{"a": 1, "a": 2}')
    (tmp_path / "bad" / "p4.json").write_text('{"a": NaN}')
    (tmp_path / "bad" / "p5.json").write_text('{"a": ')
    (tmp_path / "bad" / "p6.json").write_bytes(b'{"a": "\xff"}')
    (tmp_path / "bad" / "p7.json").write_text('{"a":' * 5000 + "1" + "}" * 5000)
    (tmp_path / "bad" / "p8.json").write_text("{}")
    got = {r["page_id"]: (r["doc"] is None, r["error"]) for r in read_pages(spark, str(tmp_path / "bad")).collect()}
    assert got.pop("p7") in ((True, "RecursionError"), (True, "Unreadable"))
    assert got == {"p2": (True, "NotAnObject"), "p3": (True, "RepeatedKey"), "p4": (True, "NotFinite"), "p5": (True, "JSONDecodeError"), "p6": (True, "JSONDecodeError"), "p8": (False, None)}
    (tmp_path / "log.jsonl").write_text('{"event":"a"}\n\n{oops\n')
    assert sorted((r["line"], r["event"] is None) for r in read_log(spark, str(tmp_path / "log.jsonl")).collect()) == [(1, False), (3, True)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many splits of one file
    try:
        (tmp_path / "long.jsonl").write_text("".join(f'{{"k":{k}}}\n' + "\n" * (k % 3 == 0) for k in range(900)))
        lines = [x for x in enumerate((tmp_path / "long.jsonl").read_text().split("\n"), 1) if x[1]]
        long = read_log(spark, str(tmp_path / "long.jsonl"))
        assert sorted((r["line"], r["raw"]) for r in long.collect()) == lines and long.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "gt.yaml").write_text(
        "elements:\n  citations:\n  - {id: c1, raw: 'Doe 1999', page: 2, char_offset: 5, parsed: {style: apa, year: 1999}}\n  footnotes:\n  - {id: f1, marker: {text: '*', page: 0, char_offset: 3}, content: [{text: 'one'}, {text: 'two '}], pages: [0, 1]}\n  page_numbers:\n  - {page: 4, displayed: iv, normalized: 4}\n"
        "  marginal_refs:\n  - {id: m1, markers: [{text: A}, {text: B, page: 3}]}\n  - {id: m2}\n"
    )
    got = read_elements(spark, str(tmp_path / "gt.yaml")).orderBy("position").collect()
    assert [(r["element_type"], r["element_id"], r["pages"], r["text"]) for r in got] == [
        ("footnote", "f1", [0, 1], "one two"), ("citation", "c1", [2], "Doe 1999"), ("marginal_ref", "m1", [3], "A B"), ("marginal_ref", "m2", [-1], ""), ("page_number", "pn_4", [4], "iv")
    ]
    assert [(r["marker_text"], r["marker_page"]) for r in got[2:4]] == [("A", 3), (None, None)]
    assert json.loads(got[0]["attributes"]["is_multi_page"]) is True and got[1]["char_length"] == 8
    with pytest.raises(Exception, match="(?i)path"):
        read_elements(spark, str(tmp_path / "none.yaml")).collect()
