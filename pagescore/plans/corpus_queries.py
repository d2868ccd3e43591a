"""Queries over documents, benchmark, labels and events, and over page documents made as JSON, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagescore.functions.geometry import ratio
from pagescore.functions.text import collapse, ngrams, normalize, tokens
from pagescore.operators import contract, eventlog, matching, metrics, regions
from pagescore.operators.alignment import overlap_matches
from pagescore.sources.pages import on_page
from pagescore.streaming.scorecards import event_windows

Query = Callable[[SparkSession, str], DataFrame]

_NORM = r"trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\p{L}\p{Nd}]+', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_NORM}, ' '), lambda x: x <> '')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalize_tokens(spark, sf_dir):
    """Of every document: normalised length, tokens and distinct tokens."""
    words = _table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("norm")).withColumn("words", tokens(F.col("norm")))
    return words.select("doc_id", F.length("norm").alias("n_chars"), F.size("words").alias("n_tokens"), F.size(F.array_distinct("words")).alias("n_distinct"))


def benchmark_in_documents(spark, sf_dir):
    """For each benchmark item: its trigrams, and how many of them some document has."""
    words = lambda name: _table(spark, sf_dir, name).withColumn("words", tokens(normalize(F.col("text"))))
    grams = lambda name, key: words(name).select(key, F.explode(ngrams(F.col("words"), F.lit(3))).alias("gram"))
    items = grams("benchmark", "item_id").groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("c"))
    seen = grams("documents", "doc_id").select("gram").join(items.select("gram").distinct(), "gram", "left_semi").distinct().withColumn("seen", F.lit(1))
    row = items.join(seen, "gram", "left").groupBy("item_id").agg(F.sum("c").alias("n_grams"), F.sum(F.when(F.col("seen") == 1, F.col("c")).otherwise(0)).alias("n_seen"))
    return row.select("item_id", "n_grams", "n_seen", ratio(F.col("n_seen"), F.col("n_grams"), 1.0).alias("containment"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a rule's guess: a document of under 200 tokens is of low quality."""
    docs = normalize_tokens(spark, sf_dir).select("doc_id", "n_tokens").join(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", (F.col("quality") == 0).alias("truth"), (F.col("n_tokens") < 200).alias("guess"))


def _prf_by_lang(verdicts: DataFrame) -> DataFrame:
    count = lambda truth, guess: F.count_if((F.col("truth") == truth) & (F.col("guess") == guess))
    rows = verdicts.groupBy("lang").agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"))
    p, r, f = metrics.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select("lang", "tp", "fp", "fn", p.alias("precision_"), r.alias("recall"), f.alias("f1"), metrics.status_class(f).alias("status"))


def label_prf_by_lang(spark, sf_dir):
    return _prf_by_lang(_verdicts(spark, sf_dir))


def baseline_delta(spark, sf_dir):
    """F1 by language over all documents, against a baseline: that over documents of even id, in en and fr only."""
    verdicts = _verdicts(spark, sf_dir)
    old = _prf_by_lang(verdicts.where((F.col("doc_id") % 2 == 0) & F.col("lang").isin("en", "fr")))
    return metrics.baseline_delta(_prf_by_lang(verdicts).select("lang", "f1"), old.select("lang", "f1"), "lang")


def position_pages(spark, sf_dir):
    """The page of every 97th character of a conversation, whose turns are its pages, one after the other; every 11th is left out."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("doc_id").orderBy("turn"))
    spans = turns.select("doc_id", F.col("turn").alias("page"), (upto - F.col("n")).alias("start"), upto.alias("end")).where((F.col("doc_id") + F.col("page")) % 11 != 0)
    whole = turns.groupBy("doc_id").agg(F.sum("n").alias("n"))
    return on_page(whole.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "n", F.lit(97).cast("long"))).alias("offset")), spans)


def label_prf_by_run(spark, sf_dir):
    """Counts and rates by run and language and by run, in one grouping: a run is a source of the labelled documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("run"))
    verdicts = _verdicts(spark, sf_dir).join(docs, "doc_id")
    hit = verdicts.select("run", F.col("lang").alias("type"), (F.col("truth") & F.col("guess")).alias("hit"), (~F.col("truth") & F.col("guess")).alias("extra"), (F.col("truth") & ~F.col("guess")).alias("lost"))
    out = metrics.by_level(hit, "run", "type", "hit", "extra", "lost")
    return out.withColumns({c: F.round(c, 12) for c in ("macro_precision", "macro_recall", "macro_f1")})


def elements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Elements made from conversations: a document of each, whole turns; predictions lose some, and change the text, place or
    kind of others."""
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", collapse(F.col("text")).alias("text"))
    base = turns.select(
        "doc_id", F.col("role").alias("element_type"), F.col("turn").cast("int").alias("pos"), F.concat(F.lit("e"), F.col("turn").cast("string")).alias("element_id"),
        F.array((F.col("turn") % 3).cast("int")).alias("pages"), "text", (F.col("turn") * 40).cast("int").alias("char_offset"),
        F.create_map(F.lit("kind"), F.concat(F.lit('"'), F.col("role"), F.lit('"'))).alias("attributes"), (F.col("doc_id") * 31 + F.col("turn")).alias("k"),
    )
    gt = base.drop("k")
    pred = base.where("k % 9 <> 0").select(
        "doc_id", "element_type", "pos", "element_id", "pages", F.when(F.col("k") % 4 == 0, F.translate("text", "eo", "xy")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") % 5 == 0, F.col("char_offset") + 10).otherwise(F.col("char_offset")).alias("char_offset"),
        F.create_map(F.lit("kind"), F.concat(F.lit('"'), F.when(F.col("k") % 14 == 10, "zz").when(F.col("k") % 7 == 3, F.concat("element_type", F.lit("s"))).otherwise(F.col("element_type")), F.lit('"'))).alias("attributes"),
    )
    return gt, pred


def element_matches(spark, sf_dir):
    """Matches without their floats' last digits."""
    out = matching.match_elements(*elements(spark, sf_dir))
    return out.select("doc_id", "element_type", "gt_id", "pred_id", "match_type", F.round("score", 9).alias("score"), F.to_json("error_details").alias("error_details"))


def element_scores(spark, sf_dir):
    """All pairs of elements that share a page, with their similarities."""
    out = matching.scored_pairs(*elements(spark, sf_dir))
    return out.select("doc_id", "element_type", F.col("g_element_id").alias("gt_id"), F.col("p_element_id").alias("pred_id"), *[F.round(c, 9).alias(c) for c in ("position_similarity", "text_similarity", "attribute_similarity", "score")])


def element_greedy_match(spark, sf_dir):
    """The greedy choice among them."""
    out = matching.best_matches(*elements(spark, sf_dir))
    return out.select("doc_id", "element_type", "g_pos", "p_pos", F.round("score", 9).alias("score"))


def match_metrics(spark, sf_dir):
    out = metrics.match_metrics(matching.match_elements(*elements(spark, sf_dir)), ["element_type"])
    return out.withColumns({c: F.round(c, 9) for c in ("mean_text_similarity", "mean_position_similarity")})


def _match_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_counts(matching.match_elements(*elements(spark, sf_dir)), ["element_type"])


def match_error_counts(spark, sf_dir):
    return _match_errors(spark, sf_dir).select("element_type", "error", "n")


def match_top_errors(spark, sf_dir):
    """The five most frequent, ties by what comes first."""
    return metrics.top_errors(_match_errors(spark, sf_dir), 5)


def exact_strategy_matches(spark, sf_dir):
    """With the exact text strategy all similarities are plain arithmetic: counts of match types."""
    out = matching.match_elements(*elements(spark, sf_dir), matching.MatchConfig(text_strategy="exact"))
    return out.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))


#: SQL: similarity of unequal texts. A row of the longest common subsequence as bits, in words of 60; a character of the other
#: text a step.
_LCS = """
h AS (SELECT a, b, CAST(ceil(length(a) / 60.0) AS BIGINT) AS limbs FROM (SELECT DISTINCT t.text AS a, p.text AS b FROM t JOIN p ON t.doc_id = p.doc_id AND t.role = p.role AND t.turn % 3 = p.turn % 3 AND t.text <> p.text AND t.text <> '' AND p.text <> '')),
hm AS (SELECT a, c, l, CAST(sum(1::UBIGINT << (i % 60)) AS UBIGINT) AS bits FROM (SELECT a, i, a[i + 1] AS c, i // 60 AS l FROM (SELECT a, unnest(range(CAST(length(a) AS BIGINT))) AS i FROM (SELECT DISTINCT a FROM h))) GROUP BY a, c, l),
hc AS (SELECT a, c, map_from_entries(list((l, bits))) AS m FROM hm GROUP BY a, c),
hs AS (SELECT a, b, any_value(limbs) AS limbs, list(CASE WHEN m IS NULL THEN list_transform(range(limbs), lambda l: 0::UBIGINT) ELSE list_transform(range(limbs), lambda l: coalesce(m[l], 0::UBIGINT)) END ORDER BY j) AS steps
  FROM (SELECT h.a, h.b, limbs, j, m FROM (SELECT a, b, limbs, unnest(range(CAST(length(b) AS BIGINT))) AS j FROM h) h LEFT JOIN hc ON hc.a = h.a AND hc.c = h.b[j + 1]) GROUP BY a, b),
hz AS (SELECT a, b, list_reduce(list_prepend(list_transform(range(limbs), lambda l: 1152921504606846975::UBIGINT), steps), lambda v, k:
  list_reduce(list_prepend([0::UBIGINT], list_transform(range(len(v)), lambda l: [v[l + 1] & k[l + 1], v[l + 1] & xor(k[l + 1], 1152921504606846975::UBIGINT), v[l + 1]])),
    lambda o, e: list_concat(o[:-2], [((e[3] + e[1] + o[-1]) & 1152921504606846975::UBIGINT) | e[2], (e[3] + e[1] + o[-1]) >> 60]))[:-2]) AS v FROM hs),
q AS (SELECT a, b, 2.0::DOUBLE * CAST(list_sum(list_transform(v, lambda x: 60 - bit_count(x))) AS DOUBLE) / CAST(length(a) + length(b) AS DOUBLE) AS r FROM hz),
"""


def _elements_sql(fuzzy: bool) -> str:
    """CTEs: t and p elements of both sides, s scored pairs, r the greedy choice step by step, m matches with their errors e."""
    similarities = _LCS if fuzzy else "\nq AS (SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b, 0.0::DOUBLE AS r),\n"
    return r"""
WITH RECURSIVE t AS (SELECT conv_id AS doc_id, turn, role, array_to_string(list_filter(string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' '), lambda x: x <> ''), ' ') AS text, conv_id * 31 + turn AS k FROM conversations),
p AS (SELECT doc_id, turn, role, CASE WHEN k % 4 = 0 THEN translate(text, 'eo', 'xy') ELSE text END AS text, turn * 40 + CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END AS off,
  CASE WHEN k % 14 = 10 THEN 'zz' WHEN k % 7 = 3 THEN role || 's' ELSE role END AS kind FROM t WHERE k % 9 <> 0),""" + similarities + """
s0 AS (SELECT t.doc_id, t.role, t.turn AS g, p.turn AS p, greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(abs(t.turn * 40 - p.off) AS DOUBLE) / 50.0::DOUBLE) AS position_similarity,
  CASE WHEN t.text = p.text THEN 1.0::DOUBLE WHEN t.text = '' OR p.text = '' THEN 0.0::DOUBLE ELSE coalesce(q.r, 0.0::DOUBLE) END AS text_similarity, CASE WHEN p.kind = t.role THEN 1.0::DOUBLE WHEN p.kind = 'zz' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS attribute_similarity,
  t.text AS a, p.text AS b, p.off, p.kind FROM t JOIN p ON t.doc_id = p.doc_id AND t.role = p.role AND t.turn % 3 = p.turn % 3 LEFT JOIN q ON q.a = t.text AND q.b = p.text),
s AS (SELECT *, 0.3::DOUBLE * position_similarity + 0.5::DOUBLE * text_similarity + 0.2::DOUBLE * attribute_similarity AS score FROM s0),
f AS (SELECT * FROM s WHERE score >= 0.5 AND score > 0),
o AS (SELECT doc_id, role, turn, row_number() OVER (PARTITION BY doc_id, role ORDER BY turn) AS n FROM t),
r AS (SELECT doc_id, role, 0 AS n, []::BIGINT[] AS used, NULL::BIGINT AS g, NULL::BIGINT AS p FROM (SELECT DISTINCT doc_id, role FROM o)
  UNION ALL SELECT r.doc_id, r.role, CAST(o.n AS INTEGER), CASE WHEN b.p IS NULL THEN r.used ELSE list_append(r.used, b.p) END, o.turn, b.p
  FROM r JOIN o ON o.doc_id = r.doc_id AND o.role = r.role AND o.n = r.n + 1
  LEFT JOIN LATERAL (SELECT p FROM f WHERE f.doc_id = r.doc_id AND f.role = r.role AND f.g = o.turn AND NOT list_contains(r.used, f.p) ORDER BY score DESC, p LIMIT 1) b ON true),
c AS (SELECT r.doc_id, r.role, r.g, r.p, f.* EXCLUDE (doc_id, role, g, p) FROM r LEFT JOIN f ON f.doc_id = r.doc_id AND f.role = r.role AND f.g = r.g AND f.p = r.p WHERE r.n > 0),
d AS (SELECT *, list_min(list_filter(range(CAST(least(length(a), length(b)) AS BIGINT)), lambda i: a[i + 1] <> b[i + 1])) AS first FROM c WHERE p IS NOT NULL AND score < 0.95),
x AS (SELECT doc_id, role, g, p, list_filter([
    CASE WHEN text_similarity < 0.95 AND length(a) <> length(b) THEN {'k': 'text_length_diff', 'v': CAST(length(b) - length(a) AS VARCHAR)} END, CASE WHEN text_similarity < 0.95 AND a <> b THEN {'k': 'text_mismatch', 'v': 'true'} END,
    CASE WHEN text_similarity < 0.95 AND first IS NOT NULL THEN {'k': 'first_diff_pos', 'v': CAST(first AS VARCHAR)} END,
    CASE WHEN text_similarity < 0.95 AND first IS NOT NULL THEN {'k': 'first_diff', 'v': 'expected ''' || a[first + 1] || ''', got ''' || b[first + 1] || ''''} END,
    CASE WHEN g * 40 <> off THEN {'k': 'position_diff', 'v': CAST(off - g * 40 AS VARCHAR)} END,
    CASE WHEN kind <> role THEN {'k': 'attribute_diffs', 'v': '{"kind":{"expected":"' || role || '","got":"' || kind || '"}}'} END], lambda e: e IS NOT NULL) AS e FROM d),
m AS (SELECT c.doc_id, c.role, 0 AS phase, c.g AS pos, 'e' || c.g AS gt_id, 'e' || c.p AS pred_id, CASE WHEN c.p IS NULL THEN 'missed' WHEN score >= 0.95 THEN 'exact' ELSE 'partial' END AS match_type, coalesce(score, 0.0::DOUBLE) AS score, position_similarity, text_similarity,
    CASE WHEN c.p IS NULL THEN [{'k': 'reason', 'v': 'not_found'}] WHEN len(x.e) > 0 THEN x.e END AS e FROM c LEFT JOIN x ON x.doc_id = c.doc_id AND x.role = c.role AND x.g = c.g
  UNION ALL SELECT doc_id, role, 1, turn, NULL, 'e' || turn, 'spurious', 0.0::DOUBLE, NULL, NULL, [{'k': 'reason', 'v': 'false_positive'}] FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND c.role = p.role AND c.p = p.turn)),
er AS (SELECT doc_id, role, phase, pos, i, CASE WHEN match_type = 'partial' THEN e[i].k ELSE match_type || '_' || e[i].v END AS error FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM m WHERE match_type <> 'exact'))
"""


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as a log: a signup defines its user, a purchase refers to it; lines are event ids."""
    events = _table(spark, sf_dir, "events")
    line = F.col("event_id").alias("line")
    return events.where("event_type = 'signup'").select(F.col("user_id").alias("id"), line), events.where("event_type = 'purchase'").select(F.col("user_id").alias("ref"), line)


def log_ref_integrity(spark, sf_dir):
    defined, refs = _log(spark, sf_dir)
    return eventlog.dangling(refs, defined).select("ref", "line")


def log_duplicates(spark, sf_dir):
    return eventlog.repeated(_log(spark, sf_dir)[0])


#: The task classes that the made log may name.
_CLASSES = ("extract", "verify")


def _as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full event log made from events: delegations, dispositions, reviews, interventions and broken lines by event type, with
    every rule of the log broken by some event ids."""
    e = _table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    user = F.col("user_id").cast("string")
    ref = F.concat(F.lit("D-"), user)
    by_number = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    tier = lambda k, model=None, effort=None: F.struct((model if model is not None else by_number(eventlog.MODELS[:3], k)).alias("model"), (effort if effort is not None else by_number(eventlog.EFFORTS, k)).alias("effort"))
    chosen = tier(i, F.when(i % 11 == 5, "abacus").otherwise(by_number(eventlog.MODELS[:3], i)), F.when(i % 13 == 6, "heroic").otherwise(by_number(eventlog.EFFORTS, i)))
    delegation = F.struct(
        F.lit("delegation").alias("event"), ref.alias("id"), F.when(i % 29 == 7, "picnic").otherwise("extract").alias("task_class"), chosen.alias("tier_chosen"), tier(i + 1).alias("tier_rubric_default"),
        F.when(i % 4 == 1, 2).otherwise(0).alias("overfit_steps"), F.when(i % 6 == 1, "a proof is asked for").alias("justification"), F.when(i % 10 == 3, True).alias("overkill_suspect"), F.struct((i % 7 * 1000 + 1000).alias("tokens")).alias("predicted"),
    )
    outcome = F.when(i % 17 == 3, "mislaid").when(i % 23 == 5, "cancelled").when(i % 3 == 0, "rework").otherwise("accepted")
    disposition = F.struct(F.lit("disposition").alias("event"), ref.alias("ref"), outcome.alias("disposition"), F.when(i % 19 != 4, i % 5 * 1000 + 500).alias("actual_tokens"))
    findings = F.array(F.struct(F.when(i % 7 == 2, "weather").otherwise("contract").alias("fault_layer")))
    review = F.struct(F.lit("review-verdict").alias("event"), ref.alias("ref"), tier(i + 2).alias("retrospectively_sufficient_tier"), findings.alias("findings"))
    opens = i % 4 == 1
    intervention = F.struct(
        F.lit("intervention").alias("event"), F.concat(F.lit("I-"), user).alias("id"), F.array(ref).alias("refs"), F.when(opens & (i % 9 != 2), "a share").alias("predicted_signal"),
        F.when(~opens, F.when(i % 3 == 0, "Corroborated").otherwise("Refuted")).alias("verdict"), F.when(~opens & (i % 5 > 0), by_number(("", "confirmed", "refuted", "underdetermined", "vibes"), i)).alias("diagnosis_outcome"),
    )
    body = (
        F.when(kind == "signup", F.to_json(delegation)).when(kind == "purchase", F.to_json(disposition)).when(kind == "view", F.to_json(review))
        .when((kind == "click") & (i % 2 == 1), F.to_json(intervention)).when(kind == "click", F.lit("{not json")).otherwise(F.to_json(F.struct(F.lit("mystery").alias("event"))))
    )
    return e.select(i.alias("line"), F.try_parse_json(body).alias("event"))


def log_guardrail(spark, sf_dir):
    """Broken rules of the made log, counted: all that there are."""
    return eventlog.problems(_as_log(spark, sf_dir), _CLASSES).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def log_audit(spark, sf_dir):
    return eventlog.audit(_as_log(spark, sf_dir))


_LOG = """
WITH e AS (SELECT event_id AS line, user_id, event_type FROM events),
d AS (SELECT line, user_id, CASE WHEN line % 11 <> 5 THEN line % 3 END AS m, CASE WHEN line % 13 <> 6 THEN line % 5 END AS f, (line + 1) % 3 AS dm, (line + 1) % 5 AS df, CASE WHEN line % 4 = 1 THEN 2 ELSE 0 END AS told FROM e WHERE event_type = 'signup'),
first AS (SELECT user_id, min(line) AS l FROM d GROUP BY user_id),
gap AS (SELECT line, told, greatest(coalesce(m - dm, 0), 0) + greatest(coalesce(f - df, 0), 0) AS g FROM d),
i AS (SELECT line, user_id, line % 4 = 1 AS opens FROM e WHERE event_type = 'click' AND line % 2 = 1),
opened AS (SELECT user_id, min(line) AS l FROM i WHERE opens GROUP BY user_id)
"""


def flatten_hierarchy(spark, sf_dir):
    """Pages of nested regions made as JSON: turn k hangs below turn k - 1 within runs of three. Depth-first rows."""
    return regions.flatten(_nested(spark, sf_dir)).select(F.col("page_id").cast("long").alias("page_id"), "region_id", "parent_id", "depth", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"), "block_type")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    label = F.when(F.col("role") == "user", "text_block").otherwise("note_area")
    by_run = turns.withColumn("run", F.floor(F.col("turn") / 3)).groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(F.struct("turn", label.alias("label")))).alias("t"))
    one = lambda k, inner: F.concat(F.lit('{"id":"r'), F.col("t")[k]["turn"].cast("string"), F.lit('","label":"'), F.col("t")[k]["label"], F.lit('"'), inner, F.lit("}"))
    third = F.when(F.size("t") > 2, F.concat(F.lit(',"children":['), one(2, F.lit("")), F.lit("]"))).otherwise(F.lit(""))
    second = F.when(F.size("t") > 1, F.concat(F.lit(',"children":['), one(1, third), F.lit("]"))).otherwise(F.lit(""))
    roots = by_run.select("conv_id", "run", one(0, second).alias("root"))
    page = roots.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "root"))), lambda r: r["root"]), ",").alias("roots"))
    return page.select(F.col("conv_id").cast("string").alias("page_id"), F.parse_json(F.concat(F.lit('{"regions":['), F.col("roots"), F.lit("]}"))).alias("doc"))


def _flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat pages as JSON, with faults by the page's number: ids repeated, missing or mistyped, odd orders and entries; every
    20th page is a chain of regions that goes deeper than the cap."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    c, t = F.col("conv_id"), F.col("turn")
    own = F.when((c % 10 == 1) & (t == 1), F.lit('"r0"')).when((c % 10 == 2) & (t == 0), F.lit("7")).otherwise(F.concat(F.lit('"r'), t.cast("string"), F.lit('"')))
    index = F.when(c % 10 == 3, F.concat(t.cast("string"), F.lit(".5"))).when(c % 10 == 4, (-t).cast("string")).otherwise(t.cast("string"))
    entry = F.when((c % 10 == 5) & (t == 0), F.lit('"loose"')).otherwise(F.concat(F.lit('{"id":'), own, F.lit(',"reading_order_index":'), index, F.lit("}")))
    page = turns.select("conv_id", "turn", entry.alias("e")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "e"))).alias("r"), F.max("turn").alias("last"))
    listed = F.array_join(F.transform("r", lambda x: F.concat(F.lit('"r'), x["turn"].cast("string"), F.lit('"'))), ",")
    order = (
        F.when(c % 10 == 6, F.lit("null")).when(c % 10 == 7, F.concat(F.lit('["r0",'), listed, F.lit("]"))).when(c % 10 == 8, F.concat(F.lit("["), listed, F.lit(',"ghost"]')))
        .when(c % 10 == 9, F.lit('["r0",5]')).otherwise(F.concat(F.lit("["), listed, F.lit("]")))
    )
    text = F.concat(F.lit('{"regions":['), F.array_join(F.transform("r", lambda x: x["e"]), ","), F.lit('],"reading_order":'), order, F.lit("}"))
    levels = regions.DEPTH_CAP + 2
    chain = "".join(f'{{"id":"d{k}","children":[' for k in range(levels - 1)) + f'{{"id":"d{levels - 1}"}}' + "]}" * (levels - 1)
    text = F.when(c % 20 == 10, F.lit(f'{{"regions":[{chain}]}}')).otherwise(text)
    return page.select(c.cast("string").alias("page_id"), F.parse_json(text).alias("doc"))


def contract_violations(spark, sf_dir):
    """Distinct offenders by kind and page of the flawed pages."""
    return contract.violations(_flawed(spark, sf_dir)).groupBy(F.col("page_id").cast("long").alias("page_id"), "kind").agg(F.countDistinct("offender").alias("n"))


def contract_offenders(spark, sf_dir):
    """The flawed pages' offenders themselves, sorted, of every kind."""
    rows = contract.sorted_offenders(contract.violations(_flawed(spark, sf_dir)))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "kind", "n", F.array_join("offenders", ",").alias("offenders"))


def order_signal(spark, sf_dir):
    """Of each flawed page: the signal that orders it, the number of ordered regions, and their ids in that order."""
    pages = _flawed(spark, sf_dir)
    order = regions.reading_order(pages, regions.flatten(pages))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "region_id"))), lambda x: x["region_id"])
    return order.groupBy(F.col("page_id").cast("long").alias("page_id"), "signal").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(ids, ",")).alias("ids_md5"))


_FLAWED = """
WITH t AS (SELECT conv_id AS p, turn, conv_id % 10 AS z FROM conversations WHERE conv_id % 20 <> 10),
deep AS (SELECT DISTINCT conv_id AS p FROM conversations WHERE conv_id % 20 = 10),
g AS (SELECT p, z, turn, CASE WHEN z = 5 AND turn = 0 THEN NULL WHEN z = 2 AND turn = 0 THEN '' WHEN z = 1 AND turn = 1 THEN 'r0' ELSE 'r' || turn END AS id,
  CASE WHEN z = 4 THEN -turn WHEN z = 3 THEN NULL ELSE turn END AS idx FROM t),
ids AS (SELECT p, z, id, count(*) AS n, arg_max(idx, turn) AS idx FROM g WHERE id <> '' GROUP BY ALL),
listed AS (SELECT p, z, 'r' || turn AS id, turn AS pos FROM t WHERE z NOT IN (6, 7, 8, 9) UNION ALL SELECT p, z, 'r' || turn, turn + 1 FROM t WHERE z = 7 UNION ALL SELECT DISTINCT p, z, 'r0', 0 FROM t WHERE z = 7
  UNION ALL SELECT p, z, 'r' || turn, turn FROM t WHERE z = 8 UNION ALL SELECT p, z, 'ghost', 1000 FROM t WHERE z = 8 AND turn = 0 UNION ALL SELECT p, z, 'r0', 0 FROM t WHERE z = 9 AND turn = 0),
once AS (SELECT p, z, id, count(*) AS n, max(pos) AS pos FROM listed GROUP BY ALL),
pages AS (SELECT DISTINCT p, z FROM t),
broken AS (SELECT p, z FROM pages WHERE z NOT IN (6) AND (
  (SELECT count(*) FROM listed l WHERE l.p = pages.p) <> (SELECT count(*) FROM g WHERE g.p = pages.p AND id <> '') OR EXISTS (SELECT 1 FROM once o WHERE o.p = pages.p AND (o.n > 1 OR NOT EXISTS (SELECT 1 FROM ids i WHERE i.p = o.p AND i.id = o.id))))),
bth AS (SELECT o.p, o.id, row_number() OVER (PARTITION BY o.p ORDER BY i.idx, o.id) AS a, row_number() OVER (PARTITION BY o.p ORDER BY o.pos) AS b FROM once o JOIN ids i ON i.p = o.p AND i.id = o.id WHERE i.idx IS NOT NULL)
"""
_CONTRACT = _FLAWED + """
SELECT p AS page_id, 'non_object_regions' AS kind, count(*) AS n FROM g WHERE id IS NULL GROUP BY p
UNION ALL SELECT p, 'regions_without_id', count(*) FROM g WHERE id = '' GROUP BY p
UNION ALL SELECT p, 'duplicate_region_ids', count(*) FROM ids WHERE n > 1 GROUP BY p
UNION ALL SELECT p, 'non_integer_reading_order_index', count(DISTINCT id) FROM g WHERE z = 3 AND id <> '' GROUP BY p
UNION ALL SELECT p, 'reading_order_not_a_list', 1 FROM pages WHERE z = 6
UNION ALL SELECT p, 'non_string_order_entries', 1 FROM pages WHERE z = 9
UNION ALL SELECT p, 'duplicate_order_entries', count(*) FROM once WHERE n > 1 GROUP BY p
UNION ALL SELECT o.p, 'order_refs_no_region', count(*) FROM once o WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.p = o.p AND i.id = o.id) GROUP BY o.p
UNION ALL SELECT i.p, 'order_omits_regions', count(*) FROM ids i WHERE i.z <> 6 AND NOT EXISTS (SELECT 1 FROM once o WHERE i.p = o.p AND i.id = o.id) GROUP BY i.p
UNION ALL SELECT p, 'order_breaks_block_structure', 1 FROM broken
UNION ALL SELECT p, 'order_contradicts_indices', count(*) FROM bth WHERE a <> b GROUP BY p
UNION ALL SELECT p, 'regions_below_depth_cap', 1 FROM deep
"""
_OFFENDERS = _FLAWED + """, x AS (SELECT p, 'duplicate_region_ids' AS kind, id FROM ids WHERE n > 1 UNION ALL SELECT p, 'duplicate_order_entries', id FROM once WHERE n > 1
  UNION ALL SELECT o.p, 'order_refs_no_region', o.id FROM once o WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.p = o.p AND i.id = o.id)
  UNION ALL SELECT i.p, 'order_omits_regions', i.id FROM ids i WHERE i.z <> 6 AND NOT EXISTS (SELECT 1 FROM once o WHERE i.p = o.p AND i.id = o.id)
  UNION ALL SELECT p, 'non_object_regions', 'depth 0 index ' || turn || ': STRING' FROM g WHERE id IS NULL UNION ALL SELECT p, 'regions_without_id', 'depth 0 index ' || turn FROM g WHERE id = ''
  UNION ALL SELECT DISTINCT p, 'non_integer_reading_order_index', id || ': DECIMAL' FROM g WHERE z = 3 AND id <> '' UNION ALL SELECT p, 'reading_order_not_a_list', 'VOID' FROM pages WHERE z = 6
  UNION ALL SELECT p, 'non_string_order_entries', 'index 1: BIGINT' FROM pages WHERE z = 9 UNION ALL SELECT p, 'order_breaks_block_structure', 'the declared list does not keep root blocks together' FROM broken
  UNION ALL SELECT p, 'order_contradicts_indices', id FROM bth WHERE a <> b UNION ALL SELECT p, 'regions_below_depth_cap', 'd32' FROM deep)
SELECT p AS page_id, kind, CAST(count(*) AS INTEGER) AS n, string_agg(id, ',' ORDER BY id) AS offenders FROM x GROUP BY p, kind
"""
# the fixture's roots all have an integer index, but for z = 3, whose declared order is whole; so order is by list or by turn
_SIGNAL = _FLAWED + """, f AS (SELECT p, z, id, min(turn) AS k FROM g WHERE id <> '' GROUP BY p, z, id),
s AS (SELECT *, CASE WHEN z <> 6 AND p NOT IN (SELECT p FROM broken) THEN 'declared' ELSE 'indices' END AS signal FROM f)
SELECT p AS page_id, signal, count(*) AS n, md5(string_agg(id, ',' ORDER BY k)) AS ids_md5 FROM s GROUP BY p, signal
UNION ALL SELECT p, 'array', 33, md5((SELECT string_agg('d' || i, ',' ORDER BY i) FROM range(33) r(i))) FROM deep
"""


def alignment_contended(spark, sf_dir):
    """Stacks of five boxes on each side, a page of every five customers, whose boxes overlap several of the other side, so that
    taking the greatest overlap first loses pairs: how many pairs, and their overlap."""
    rows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).withColumn("page_id", F.floor(F.col("k") / 5)).withColumn("i", F.col("k") % 5)
    box = lambda side, low, high: rows.select("page_id", F.concat(F.lit(side), F.col("i").cast("string")).alias("region_id"), F.lit(0.1).alias("x0"), low.alias("y0"), F.lit(0.9).alias("x1"), high.alias("y1"))
    k, i = F.col("k"), F.col("i").cast("double")
    low, other = i * 0.25 + (k * 37 % 20).cast("double") / 100.0, i * 0.25 + 0.1 + (k * 53 % 20).cast("double") / 100.0
    matches = overlap_matches(box("g", low, low + 1.0), box("c", other, other + 0.8 + (k % 3).cast("double") * 0.1), spark.createDataFrame([], "page_id long, gt_id string, cand_id string"))
    return matches.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("iou"), 9).alias("overlap"))


def event_windows_batch(spark, sf_dir):
    """Tumbling hours of events, by the operator that streams use, over the whole table at once."""
    out = event_windows(_table(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("value", 6).alias("value"))


def _prf_sql(where: str, name: str) -> str:
    """CTEs of rates by language over the verdicts that hold `where`; the last is `name`."""
    return f"""{name}c AS (SELECT lang, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn FROM v WHERE {where} GROUP BY lang),
        {name}r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision_, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall FROM {name}c),
        {name} AS (SELECT *, CASE WHEN precision_ + recall = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * precision_ * recall / (precision_ + recall) END AS f1 FROM {name}r)"""


_PRF = f"""WITH v AS (SELECT doc_id, lang, quality = 0 AS truth, len({_WORDS}) < 200 AS guess FROM documents JOIN labels USING (doc_id)),
        {_prf_sql("true", "f")}
"""

_ORACLES = {
    normalize_tokens: f"SELECT doc_id, CAST(length({_NORM}) AS INTEGER) AS n_chars, CAST(len({_WORDS}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_WORDS})) AS INTEGER) AS n_distinct FROM documents",
    benchmark_in_documents: f"""WITH g AS (SELECT item_id, array_to_string(w[s:s + 2], ' ') AS gram FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 2)) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))),
        d AS (SELECT DISTINCT array_to_string(w[s:s + 2], ' ') AS gram FROM (SELECT w, unnest(generate_series(1, len(w) - 2)) AS s FROM (SELECT {_WORDS} AS w FROM documents)))
        SELECT item_id, count(*) AS n_grams, count(d.gram) AS n_seen, CAST(count(d.gram) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS containment FROM g LEFT JOIN d USING (gram) GROUP BY item_id""",
    label_prf_by_lang: _PRF + "SELECT *, CASE WHEN f1 >= 0.9 THEN 'good' WHEN f1 >= 0.7 THEN 'ok' ELSE 'bad' END AS status FROM f",
    # every one-to-one choice of a page is made, a box of the ground truth a step
    alignment_contended: """WITH RECURSIVE b AS (SELECT c_custkey // 5 AS page_id, c_custkey % 5 AS i, (c_custkey % 5) * 0.25::DOUBLE + (c_custkey * 37 % 20) / 100.0::DOUBLE AS y, (c_custkey % 5) * 0.25::DOUBLE + 0.1::DOUBLE + (c_custkey * 53 % 20) / 100.0::DOUBLE AS z, (c_custkey % 3) * 0.1::DOUBLE AS more FROM customer),
        w AS (SELECT g.page_id, g.i AS g, c.i AS c, greatest(least(g.y + 1.0::DOUBLE, c.z + 0.8::DOUBLE + c.more) - greatest(g.y, c.z), 0.0::DOUBLE) AS h, 1.0::DOUBLE AS a, 0.8::DOUBLE + c.more AS d FROM b g JOIN b c ON g.page_id = c.page_id),
        v AS (SELECT page_id, g, c, h / (a + d - h) AS iou FROM w WHERE h / (a + d - h) >= 0.5),
        r AS (SELECT page_id, 0 AS step, 0 AS used, 0 AS n, 0.0::DOUBLE AS total FROM (SELECT DISTINCT page_id FROM v)
          UNION ALL SELECT r.page_id, r.step + 1, CASE WHEN v.c IS NULL THEN used ELSE used | (1 << CAST(v.c AS INTEGER)) END, n + CASE WHEN v.c IS NULL THEN 0 ELSE 1 END, total + coalesce(v.iou, 0.0::DOUBLE)
          FROM r JOIN (SELECT page_id, g, c, iou FROM v UNION ALL SELECT page_id, g, NULL, NULL FROM (SELECT DISTINCT p.page_id, s.g FROM v p, range(5) s(g))) v ON v.page_id = r.page_id AND v.g = r.step AND (v.c IS NULL OR used & (1 << CAST(v.c AS INTEGER)) = 0))
        SELECT page_id, CAST(max((n, total))[1] AS BIGINT) AS n, round(max((n, total))[2], 9) AS overlap FROM r WHERE step = 5 GROUP BY page_id""",
    baseline_delta: f"""{_PRF}, {_prf_sql("doc_id % 2 = 0 AND lang IN ('en', 'fr')", "old")}, b AS (SELECT f.lang, f.f1, old.f1 AS baseline_f1 FROM f LEFT JOIN old ON f.lang = old.lang)
        SELECT lang, f1, baseline_f1, f1 - baseline_f1 AS delta, CASE WHEN f1 > baseline_f1 THEN '+' ELSE '' END || printf('%.3f', f1 - baseline_f1) AS shown FROM b""",
    position_pages: """WITH t AS (SELECT conv_id AS doc_id, turn, length(coalesce(text, '')) AS n, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
        s AS (SELECT doc_id, turn AS page, e - n AS b, e FROM t WHERE (doc_id + turn) % 11 <> 0),
        o AS (SELECT doc_id, unnest(generate_series(0, CAST(max(e) AS BIGINT), 97)) AS "offset" FROM t GROUP BY doc_id)
        SELECT o.doc_id, o."offset", s.page FROM o LEFT JOIN s ON s.doc_id = o.doc_id AND o."offset" >= s.b AND o."offset" < s.e""",
    label_prf_by_run: f"""WITH v AS (SELECT doc_id, lang, coalesce(source, 'none') AS run, quality = 0 AS truth, len({_WORDS}) < 200 AS guess FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT run, lang AS type, grouping(lang) AS whole, count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn FROM v GROUP BY GROUPING SETS ((run, lang), (run))),
        r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision_, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall FROM g),
        f AS (SELECT *, CASE WHEN precision_ + recall = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * precision_ * recall / (precision_ + recall) END AS f1 FROM r)
        SELECT run, type, tp, fp, fn, precision_, recall, f1, CASE WHEN whole = 1 THEN round(avg(precision_) FILTER (whole = 0) OVER p, 12) END AS macro_precision, CASE WHEN whole = 1 THEN round(avg(recall) FILTER (whole = 0) OVER p, 12) END AS macro_recall,
          CASE WHEN whole = 1 THEN round(avg(f1) FILTER (whole = 0) OVER p, 12) END AS macro_f1 FROM f WINDOW p AS (PARTITION BY run)""",
    exact_strategy_matches: _elements_sql(False) + "SELECT match_type, count(*) AS n FROM m GROUP BY match_type",
    element_scores: _elements_sql(True) + "SELECT doc_id, role AS element_type, 'e' || g AS gt_id, 'e' || p AS pred_id, round(position_similarity, 9) AS position_similarity, round(text_similarity, 9) AS text_similarity, round(attribute_similarity, 9) AS attribute_similarity, round(score, 9) AS score FROM s",
    element_greedy_match: _elements_sql(True) + "SELECT doc_id, role AS element_type, CAST(g AS INTEGER) AS g_pos, CAST(p AS INTEGER) AS p_pos, round(score, 9) AS score FROM c WHERE p IS NOT NULL",
    element_matches: _elements_sql(True) + """SELECT doc_id, role AS element_type, gt_id, pred_id, match_type, round(score, 9) AS score,
        CASE WHEN e IS NOT NULL THEN '{' || array_to_string(list_transform(e, lambda z: CAST(to_json(z.k) AS VARCHAR) || ':' || CAST(to_json(z.v) AS VARCHAR)), ',') || '}' END AS error_details FROM m""",
    match_metrics: _elements_sql(True) + """, n AS (SELECT role AS element_type, count(*) FILTER (match_type IN ('exact', 'partial')) AS tp, count(*) FILTER (match_type = 'spurious') AS fp, count(*) FILTER (match_type = 'missed') AS fn, count(*) FILTER (match_type = 'exact') AS exact, count(*) FILTER (match_type = 'partial') AS partial,
          sum(text_similarity) FILTER (match_type IN ('exact', 'partial')) AS ts, sum(position_similarity) FILTER (match_type IN ('exact', 'partial')) AS ps FROM m GROUP BY role),
        z AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision_, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall FROM n)
        SELECT element_type, tp, fp, fn, exact, partial, precision_, recall, CASE WHEN precision_ + recall = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * precision_ * recall / (precision_ + recall) END AS f1, tp + fn AS support,
          CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE round(ts / CAST(tp AS DOUBLE), 9) END AS mean_text_similarity, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE round(ps / CAST(tp AS DOUBLE), 9) END AS mean_position_similarity FROM z""",
    match_error_counts: _elements_sql(True) + "SELECT role AS element_type, error, count(*) AS n FROM er GROUP BY role, error",
    match_top_errors: _elements_sql(True) + "SELECT error, count(*) AS n FROM er GROUP BY error ORDER BY count(*) DESC, min((role, doc_id, phase, pos, i)) LIMIT 5",
    log_ref_integrity: "SELECT p.user_id AS ref, p.event_id AS line FROM events p WHERE p.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'signup' AND d.user_id = p.user_id AND d.event_id < p.event_id)",
    log_duplicates: "SELECT user_id AS id, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY user_id HAVING count(*) > 1",
    log_guardrail: _LOG + """, x AS (SELECT 'not valid JSON' AS rule, count(*) AS n FROM e WHERE event_type = 'click' AND line % 2 = 0 UNION ALL SELECT 'unknown event', count(*) FROM e WHERE event_type NOT IN ('signup', 'purchase', 'view', 'click')
        UNION ALL SELECT 'duplicate delegation id', count(*) FROM d JOIN first USING (user_id) WHERE line > l
        UNION ALL SELECT 'ref to no earlier delegation', count(*) FROM e LEFT JOIN first USING (user_id) WHERE (event_type IN ('purchase', 'view') OR event_type = 'click' AND line % 2 = 1) AND (l IS NULL OR l >= line)
        UNION ALL SELECT 'unknown model', count(*) FROM d WHERE line % 11 = 5 UNION ALL SELECT 'unknown effort', count(*) FROM d WHERE line % 13 = 6 UNION ALL SELECT 'unknown task_class', count(*) FROM d WHERE line % 29 = 7
        UNION ALL SELECT 'overfit_steps understates the tier gap', count(*) FROM gap WHERE told < g UNION ALL SELECT 'tier gap without justification', count(*) FROM gap WHERE greatest(g, told) >= 2 AND line % 6 <> 1 AND line % 10 <> 3
        UNION ALL SELECT 'unknown disposition', count(*) FROM e WHERE event_type = 'purchase' AND line % 17 = 3 UNION ALL SELECT 'no actual_tokens', count(*) FROM e WHERE event_type = 'purchase' AND line % 19 = 4 AND NOT (line % 17 <> 3 AND line % 23 = 5)
        UNION ALL SELECT 'unknown fault_layer', count(*) FROM e WHERE event_type = 'view' AND line % 7 = 2 UNION ALL SELECT 'opening without predicted_signal', count(*) FROM i WHERE opens AND line % 9 = 2
        UNION ALL SELECT 'closing without an earlier opening', count(*) FROM i LEFT JOIN opened USING (user_id) WHERE NOT opens AND (l IS NULL OR l >= line)
        UNION ALL SELECT 'closing without diagnosis_outcome', count(*) FROM i WHERE NOT opens AND line % 5 = 0 UNION ALL SELECT 'unknown diagnosis_outcome', count(*) FROM i WHERE NOT opens AND line % 5 = 4)
        SELECT rule, CASE WHEN rule IN ('unknown effort', 'no actual_tokens', 'closing without diagnosis_outcome') THEN 'warning' ELSE 'error' END AS severity, n FROM x WHERE n > 0""",
    log_audit: _LOG + """, o AS (SELECT user_id, arg_min({'m': m, 'f': f, 'tok': line % 7 * 1000 + 1000}, line) AS d FROM d GROUP BY user_id),
        r AS (SELECT user_id, arg_max({'m': (line + 2) % 3, 'f': (line + 2) % 5}, line) AS r FROM e WHERE event_type = 'view' GROUP BY user_id),
        p AS (SELECT user_id, arg_max({'rework': line % 17 <> 3 AND line % 23 <> 5 AND line % 3 = 0, 'tok': CASE WHEN line % 19 <> 4 THEN line % 5 * 1000 + 500 END}, line) AS p FROM e WHERE event_type = 'purchase' GROUP BY user_id),
        j AS (SELECT d.m AS m, d.f AS f, d.tok AS tok, r.m AS rm, r.f AS rf, p.rework AS rework, p.tok AS ptok FROM o LEFT JOIN r USING (user_id) LEFT JOIN p USING (user_id))
        SELECT count(*) AS delegations, CAST(count(*) FILTER (rm < m OR (rm = m AND rf < f)) AS DOUBLE) / count(rm) AS overshoot_rate, CAST(count(*) FILTER (rm > m OR (rm = m AND rf > f)) AS DOUBLE) / count(rm) AS undershoot_rate,
          CAST(count(*) FILTER (rework) AS DOUBLE) / count(rework) AS rework_rate, CAST(count(rm) AS DOUBLE) / count(*) AS review_linkage_fraction,
          CAST(sum(ptok) AS DOUBLE) / CAST(sum(tok) FILTER (ptok IS NOT NULL) AS DOUBLE) AS token_prediction_calibration,
          (SELECT CAST(count(*) FILTER (line % 3 = 0) AS DOUBLE) / count(*) FROM i WHERE NOT opens) AS intervention_success_rate, (SELECT CAST(count(*) FILTER (line % 5 = 1) AS DOUBLE) / count(*) FROM i WHERE NOT opens AND line % 5 IN (1, 2)) AS diagnosis_hit_rate FROM j""",
    flatten_hierarchy: """WITH t AS (SELECT conv_id, turn, role, turn // 3 AS run, row_number() OVER (PARTITION BY conv_id, turn // 3 ORDER BY turn) - 1 AS depth, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 3) - 1 AS root FROM conversations)
        SELECT conv_id AS page_id, 'r' || turn AS region_id, coalesce(lag('r' || turn) OVER (PARTITION BY conv_id, run ORDER BY turn), '') AS parent_id, CAST(depth AS INTEGER) AS depth, root || repeat('.0', depth) AS path,
          CASE WHEN role = 'user' THEN 'body' ELSE 'footnote' END AS block_type FROM t""",
    contract_violations: _CONTRACT,
    contract_offenders: _OFFENDERS,
    order_signal: _SIGNAL,
    event_windows_batch: "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL",
}

QUERIES: dict[str, Query] = {f.__name__: f for f in _ORACLES}
ORACLES: dict[str, str] = {f.__name__: sql for f, sql in _ORACLES.items()}
