"""Queries over pages made from conversations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescore.functions.geometry import ratio
from pagescore.functions.text import in_places
from pagescore.operators import contract, fidelity, metrics, mutate, order, regions, scorecard, structure
from pagescore.operators.alignment import align
from pagescore.plans import documents
from pagescore.plans.conversation_pages import SQL, cand_documents, cand_regions, gt_documents, gt_regions, raw_documents
from pagescore.sources.pages import parse_pages
from pagescore.sources.stored import stored

Query = Callable[[SparkSession, str], DataFrame]


class Pages:
    """Both sides' regions and their alignment. once: they are written with their normalised texts, for checks that use them again
    and again."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False) -> None:
        self.gt, self.cand = gt_regions(spark, sf_dir), cand_regions(spark, sf_dir)
        if once:
            self.gt, self.cand = stored(fidelity.normed(self.gt), "gt"), stored(fidelity.normed(self.cand), "cand")
        self.mapping = align(self.gt, self.cand)
        if once:
            self.mapping = stored(self.mapping, "mapping")

    def worded(self) -> tuple[DataFrame, DataFrame]:
        return fidelity.worded(self.gt), fidelity.worded(self.cand)

    def aligned(self) -> DataFrame:
        return fidelity.aligned_text(*self.worded(), self.mapping)

    def placed(self) -> DataFrame:
        return order.positions(order.order_from_index(self.gt), order.order_from_index(self.cand), self.mapping)

    def types(self) -> DataFrame:
        return structure.type_counts(self.gt, self.cand, self.mapping)

    def paired(self) -> DataFrame:
        return structure.counterparts(self.gt, self.cand, self.mapping, ["text", "is_note"])


def page_containment(spark, sf_dir):
    return fidelity.page_containment(*Pages(spark, sf_dir).worded()).select("page_id", "n", "gt_ngrams", "contained", "containment")


def page_precision_excess(spark, sf_dir):
    return fidelity.page_containment(*Pages(spark, sf_dir).worded()).select("page_id", "cand_ngrams", "precision_", "excess")


def region_alignment(spark, sf_dir):
    return Pages(spark, sf_dir).mapping.select("page_id", "gt_id", "cand_id", "pass")


def region_retention(spark, sf_dir):
    return fidelity.retention(Pages(spark, sf_dir).aligned())


def region_misplacement(spark, sf_dir):
    pages = Pages(spark, sf_dir)
    gt, _ = pages.worded()
    return fidelity.misplacement(pages.aligned(), gt, fidelity.page_n(gt))


def _listed(rows, name):
    shown = F.zip_with(F.transform("offenders", lambda x: x["region_id"]), in_places(F.transform("offenders", lambda x: x["value"]), 6), lambda r, v: F.concat(r, F.lit(":"), v))
    return rows.select("page_id", F.array_join(shown, ",").alias(name))


def worst_retentions(spark, sf_dir):
    """Each page's regions whose retention fails the gate, worst first."""
    rows = fidelity.retention(Pages(spark, sf_dir).aligned(), both=False).where(F.col("retention") < fidelity.MIN_RETENTION)
    return _listed(fidelity.worst(rows, "retention"), "regions")


def worst_misplacements(spark, sf_dir):
    """Each page's misplaced regions, most foreign first."""
    pages = Pages(spark, sf_dir)
    gt, _ = pages.worded()
    rows = fidelity.misplacement(pages.aligned(), gt, fidelity.page_n(gt)).where(F.col("foreign_ratio") > fidelity.MAX_FOREIGN)
    return _listed(fidelity.worst(rows, "foreign_ratio", lowest=False), "regions")


def text_gate(spark, sf_dir):
    pages = Pages(spark, sf_dir, once=True)
    out = fidelity.text_fidelity(pages.gt, pages.cand, pages.mapping)
    return out.select("page_id", "containment", "precision_", "regions_scored", "gross", "minor", "minor_allowed", "misplaced", "worst_retention", "passed")


def reading_order_seq(spark, sf_dir):
    return order.order_from_index(cand_regions(spark, sf_dir)).select("page_id", "region_id", F.col("rank").cast("long").alias("rank"))


def kendall_tau(spark, sf_dir):
    return order.kendall_tau(Pages(spark, sf_dir).placed())


def order_coverage(spark, sf_dir):
    return order.order_check(Pages(spark, sf_dir).placed()).select("page_id", "n_shared", "missing", "coverage", "tau", "passed")


def lis_ratio(spark, sf_dir):
    return order.longest_increasing(Pages(spark, sf_dir).placed())


def block_type_counts(spark, sf_dir):
    return cand_regions(spark, sf_dir).groupBy("page_id", "block_type").agg(F.count(F.lit(1)).alias("n"))


def type_confusion(spark, sf_dir):
    return Pages(spark, sf_dir).types()


def type_prf(spark, sf_dir):
    p, r, f = metrics.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    summed = Pages(spark, sf_dir).types().groupBy("block_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return summed.select("block_type", "tp", "fp", "fn", p.alias("precision_"), r.alias("recall"), f.alias("f1"))


def type_micro_macro(spark, sf_dir):
    by_type = Pages(spark, sf_dir).types().groupBy("block_type").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return metrics.micro_macro(by_type, []).select("tp", "fp", "fn", "micro_precision", "micro_recall", "micro_f1", *[F.round(c, 12).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


def type_gate(spark, sf_dir):
    return structure.type_check(Pages(spark, sf_dir).types()).select("page_id", "false_positives", "false_negatives", "type_errors", "micro_f1", "passed")


def note_presence(spark, sf_dir):
    return structure.note_presence(Pages(spark, sf_dir).paired())


def anchor_preservation(spark, sf_dir):
    return structure.spans(Pages(spark, sf_dir).paired())


def scorecard_contract(spark, sf_dir):
    return documents.contracts(gt_documents(spark, sf_dir), cand_documents(spark, sf_dir)).drop("detail")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite's verdicts on every page document."""
    return documents.score(gt_documents(spark, sf_dir), cand_documents(spark, sf_dir))


def crash_isolation(spark, sf_dir):
    """The suite over texts of documents of which every 13th candidate is cut off, every 17th has a key twice and every 19th
    ground truth a NaN: each such page's checks crash with the error's name, all others are scored."""
    gt, cand = (parse_pages(raw_documents(docs(spark, sf_dir), side)) for docs, side in ((gt_documents, "gt"), (cand_documents, "candidate")))
    out = documents.score(gt, cand)
    return out.select(F.col("page_id").cast("long").alias("page_id"), "checker", "severity", "passed", "crashed", F.get_json_object("metrics", "$.error").alias("error"))


def scorecard_results(spark, sf_dir):
    return results(spark, sf_dir).select("page_id", "checker", "ordinal", "severity", "passed", "crashed", "detail")


def scorecard_summary(spark, sf_dir):
    return scorecard.summary(results(spark, sf_dir))


def scorecard_json(spark, sf_dir):
    return scorecard.as_json(results(spark, sf_dir))


def ngram_backoff(spark, sf_dir):
    gt = fidelity.worded(gt_regions(spark, sf_dir))
    return gt.select("page_id", "region_id", F.size("words").alias("n_tokens"), fidelity.backed_off(F.col("words"), 3).alias("region_n"))


def mutate_smear(spark, sf_dir):
    return mutate.smear_page_text(gt_regions(spark, sf_dir)).select("page_id", "region_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def mutate_corrupt(spark, sf_dir):
    """Every 20th letter of body regions replaced: how many letters changed."""
    gt = gt_regions(spark, sf_dir)
    changed = mutate.corrupt_letters(gt, 0.05, "#")
    return changed.select("page_id", "region_id", (F.length("text") - F.length(F.replace("text", F.lit("#"), F.lit("")))).alias("replaced"))


def mutate_drop_anchors(spark, sf_dir):
    return mutate.drop_anchors(gt_regions(spark, sf_dir)).select("page_id", "region_id", F.md5("text").alias("text_md5"))


def mutate_swap_text(spark, sf_dir):
    return mutate.swap_values(gt_regions(spark, sf_dir), "r0", "r1", "text").select("page_id", "region_id", F.md5("text").alias("text_md5"))


def mutate_reverse_indices(spark, sf_dir):
    return mutate.reverse_indices(gt_regions(spark, sf_dir)).select("page_id", "region_id", "reading_order_index")


def full_text(spark, sf_dir):
    """Texts of a candidate page in its reading order, a line each."""
    cand = cand_regions(spark, sf_dir).withColumn("path", F.array("turn"))
    whole = regions.full_text(cand, order.order_from_index(cand))
    count = cand.where("text <> ''").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_regions"))
    return whole.join(count, "page_id").select("page_id", F.md5("full_text").alias("text_md5"), "n_regions")


_ORACLES = {
    page_containment: "SELECT page_id, n, gt_ngrams, contained, containment FROM tg",
    page_precision_excess: "SELECT page_id, cand_ngrams, precision_, excess FROM tg",
    region_alignment: "SELECT page_id, gt_id, cand_id, CAST(pass AS INTEGER) AS pass FROM mp",
    region_retention: "SELECT page_id, region_id, by_ngram, by_chars, retention FROM rt",
    region_misplacement: "SELECT page_id, region_id, own_matched, foreign_, foreign_ratio FROM mr",
    worst_retentions: "SELECT page_id, string_agg(region_id || ':' || printf('%.6f', retention), ',' ORDER BY retention, region_id) AS regions FROM rt WHERE retention < 0.95 GROUP BY page_id",
    worst_misplacements: "SELECT page_id, string_agg(region_id || ':' || printf('%.6f', foreign_ratio), ',' ORDER BY foreign_ratio DESC, region_id) AS regions FROM mr WHERE foreign_ratio > 0.5 GROUP BY page_id",
    text_gate: "SELECT page_id, containment, precision_, regions_scored, gross, minor, minor_allowed, misplaced, worst_retention, containment >= 0.95 AND gross = 0 AND minor <= minor_allowed AND misplaced = 0 AS passed FROM tg",
    reading_order_seq: "SELECT page_id, region_id, rank FROM co",
    kendall_tau: "SELECT page_id, concordant, discordant, tau FROM kd",
    order_coverage: "SELECT page_id, n_shared, missing, coverage, tau, coverage >= 1 AND tau >= 1 AS passed FROM (SELECT page_id, count(cand_pos) AS n_shared, count(*) - count(cand_pos) AS missing, CAST(count(cand_pos) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS coverage FROM ps GROUP BY page_id) JOIN kd USING (page_id)",
    lis_ratio: """, ln AS (SELECT page_id, pos, cand_pos, 1 AS len FROM ps WHERE cand_pos IS NOT NULL UNION ALL SELECT p.page_id, p.pos, p.cand_pos, l.len + 1 FROM ln l JOIN ps p ON p.page_id = l.page_id AND p.pos > l.pos AND p.cand_pos > l.cand_pos)
        SELECT p.page_id, CAST(coalesce(max(len), 0) AS BIGINT) AS lis FROM (SELECT DISTINCT page_id FROM ps) p LEFT JOIN ln USING (page_id) GROUP BY p.page_id""",
    block_type_counts: "SELECT page_id, bt AS block_type, count(*) AS n FROM cn GROUP BY ALL",
    type_confusion: "SELECT page_id, block_type, tp, fp, fn FROM tc",
    type_prf: """, s AS (SELECT block_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM tc GROUP BY block_type),
        r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision_, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall FROM s)
        SELECT *, CASE WHEN precision_ + recall = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * precision_ * recall / (precision_ + recall) END AS f1 FROM r""",
    type_micro_macro: """, s AS (SELECT block_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM tc GROUP BY block_type),
        r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS p, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS r FROM s),
        f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * p * r / (p + r) END AS f FROM r),
        a AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(avg(p), 12) AS macro_precision, round(avg(r), 12) AS macro_recall, round(avg(f), 12) AS macro_f1 FROM f),
        b AS (SELECT *, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS micro_precision, CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) AS micro_recall FROM a)
        SELECT *, 2.0::DOUBLE * micro_precision * micro_recall / (micro_precision + micro_recall) AS micro_f1 FROM b""",
    type_gate: "SELECT page_id, CAST(sum(fp) AS BIGINT) AS false_positives, CAST(sum(fn) AS BIGINT) AS false_negatives, CAST(sum(fp) + sum(fn) AS BIGINT) AS type_errors, CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0::DOUBLE ELSE CAST(2 * sum(tp) AS DOUBLE) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) END AS micro_f1, sum(fp) + sum(fn) = 0 AS passed FROM tc GROUP BY page_id",
    note_presence: "SELECT * FROM np",
    anchor_preservation: "SELECT page_id, region_id, marker, gt_count, cand_count, state FROM st",
    ngram_backoff: "SELECT page_id, region_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(greatest(1, least(3, len(w))) AS INTEGER) AS region_n FROM gw",
    mutate_smear: """, s AS (SELECT page_id, string_agg(text, chr(10) ORDER BY region_id) AS t FROM gn WHERE text <> '' GROUP BY page_id)
        SELECT g.page_id, g.region_id, CAST(length(coalesce(t, '')) AS INTEGER) AS n_chars, md5(coalesce(t, '')) AS text_md5 FROM gn g LEFT JOIN s USING (page_id)""",
    mutate_corrupt: r""", l AS (SELECT *, CASE WHEN bt = 'body' THEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) ELSE 0 END AS n FROM gn),
        a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY page_id ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l)
        SELECT page_id, region_id, CAST((b + n) // 20 - b // 20 + length(text) - length(replace(text, '#', '')) AS INTEGER) AS replaced FROM a""",
    mutate_drop_anchors: "SELECT page_id, region_id, md5(replace(replace(text, 'the', ''), 'de ', '')) AS text_md5 FROM gn",
    mutate_swap_text: """, p AS (SELECT page_id, max(text) FILTER (region_id = 'r0') AS a, max(text) FILTER (region_id = 'r1') AS b FROM gn GROUP BY page_id)
        SELECT page_id, region_id, md5(CASE WHEN a IS NOT NULL AND b IS NOT NULL AND region_id = 'r0' THEN b WHEN a IS NOT NULL AND b IS NOT NULL AND region_id = 'r1' THEN a ELSE text END) AS text_md5 FROM gn JOIN p USING (page_id)""",
    mutate_reverse_indices: "SELECT page_id, region_id, min(idx) OVER (PARTITION BY page_id) + max(idx) OVER (PARTITION BY page_id) - idx AS reading_order_index FROM gn",
    full_text: "SELECT cn.page_id, md5(string_agg(text, chr(10) ORDER BY rank)) AS text_md5, count(*) AS n_regions FROM cn JOIN co USING (page_id, region_id) WHERE text <> '' GROUP BY cn.page_id",
}

#: The documents' own order: a candidate that declares a whole order (every fifth page) goes by it, others by index. xt adds what
#: verdicts say of offenders and regions, in CTEs over those of conversation_pages.
_DOCUMENTS = r""", cq AS (SELECT page_id, region_id, turn, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN page_id % 5 = 0 THEN turn ELSE idx END, region_id) - 1 AS rank FROM cn),
  pd AS (SELECT go.page_id, go.region_id AS gt_id, go.rank AS pos, cq.rank AS cand_pos FROM go JOIN mp ON mp.page_id = go.page_id AND mp.gt_id = go.region_id LEFT JOIN cq ON cq.page_id = mp.page_id AND cq.region_id = mp.cand_id),
  kq AS (SELECT a.page_id, count(*) FILTER (a.cand_pos < b.cand_pos) AS concordant, count(*) FILTER (a.cand_pos > b.cand_pos) AS discordant FROM pd a JOIN pd b ON a.page_id = b.page_id AND a.pos < b.pos GROUP BY a.page_id),
  tq AS (SELECT p.page_id, n_shared, missing, lost, CAST(coalesce(concordant, 0) AS BIGINT) AS concordant, CAST(coalesce(discordant, 0) AS BIGINT) AS discordant,
    CASE WHEN coalesce(concordant, 0) + coalesce(discordant, 0) = 0 THEN 1.0::DOUBLE ELSE CAST(concordant - discordant AS DOUBLE) / CAST(concordant + discordant AS DOUBLE) END AS tau,
    CAST(n_shared AS DOUBLE) / CAST(n_shared + missing AS DOUBLE) AS coverage
    FROM (SELECT page_id, count(cand_pos) AS n_shared, count(*) - count(cand_pos) AS missing, string_agg(gt_id, ', ' ORDER BY pos) FILTER (cand_pos IS NULL) AS lost FROM pd GROUP BY page_id) p LEFT JOIN kq USING (page_id)),
  gone AS (SELECT DISTINCT page_id FROM gn WHERE page_id NOT IN (SELECT page_id FROM cn)),
  om AS (SELECT page_id, string_agg(region_id, ', ' ORDER BY region_id) AS ids FROM (SELECT page_id, region_id, row_number() OVER (PARTITION BY page_id ORDER BY turn) AS k FROM cn WHERE page_id % 5 <> 0 AND page_id % 7 = 0) WHERE k > 1 GROUP BY page_id),
  ag_ AS (SELECT page_id, string_agg(region_id, ', ' ORDER BY region_id) AS ids FROM (SELECT page_id, region_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY page_id) AS m FROM cn WHERE page_id % 5 = 0 WINDOW w AS (PARTITION BY page_id ORDER BY turn)) WHERE 2 * k <> m + 1 GROUP BY page_id),
  cx AS (SELECT ct.*, CASE WHEN omitted > 0 THEN 'candidate order_omits_regions [' || om.ids || ']; candidate order_breaks_block_structure [the declared list does not keep root blocks together]'
    WHEN against > 0 THEN 'candidate order_contradicts_indices [' || ag_.ids || ']' ELSE 'both documents keep the contract' END AS detail FROM ct LEFT JOIN om USING (page_id) LEFT JOIN ag_ USING (page_id)),
  tx AS (SELECT tg.*, short, away FROM tg LEFT JOIN (SELECT page_id, string_agg(region_id, ', ' ORDER BY retention, region_id) AS short FROM rt WHERE retention < 0.95 GROUP BY page_id) USING (page_id)
    LEFT JOIN (SELECT page_id, string_agg(region_id, ', ' ORDER BY foreign_ratio DESC, region_id) AS away FROM mr WHERE foreign_ratio > 0.5 GROUP BY page_id) USING (page_id)),
  sc AS (SELECT page_id, count(*) FILTER (state <> 'skipped') AS gt_spans, count(*) FILTER (state = 'preserved') AS spans_preserved, count(*) FILTER (state IN ('missing', 'under', 'duplicated')) AS span_defects, count(*) FILTER (state = 'skipped') AS spans_skipped FROM st GROUP BY page_id),
  nx AS (SELECT np.*, sc.* EXCLUDE (page_id), lone, odd FROM np JOIN sc USING (page_id) LEFT JOIN (SELECT page_id, string_agg(region_id, ', ' ORDER BY region_id) FILTER (NOT c_found) AS lone, string_agg(region_id, ', ' ORDER BY region_id) FILTER (c_found AND c_bt <> 'footnote') AS odd FROM pr WHERE bt = 'footnote' GROUP BY page_id) USING (page_id)),
  ty AS (SELECT page_id, CAST(sum(fp) AS BIGINT) AS false_positives, CAST(sum(fn) AS BIGINT) AS false_negatives, CAST(sum(fp) + sum(fn) AS BIGINT) AS type_errors,
    CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) = 0 THEN 0.0::DOUBLE ELSE CAST(2 * sum(tp) AS DOUBLE) / CAST(2 * sum(tp) + sum(fp) + sum(fn) AS DOUBLE) END AS micro_f1, round(avg(f), 12) AS macro_f1,
    max(f) FILTER (block_type = 'body') AS body_f1, max(f) FILTER (block_type = 'footnote') AS footnote_f1, max(f) FILTER (block_type = 'heading') AS heading_f1
    FROM (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::DOUBLE ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f FROM tc) GROUP BY page_id),
  sv AS (SELECT page_id, 0 AS ordinal, omitted + against = 0 AS passed, detail FROM cx
    UNION ALL SELECT page_id, 1, containment >= 0.95 AND gross = 0 AND minor <= minor_allowed AND misplaced = 0,
      concat('contained ', contained, ' of ', gt_ngrams, ' n-grams; of ', regions_scored, ' regions ', gross, ' gross and ', minor, ' minor defects (', minor_allowed, ' allowed), ', misplaced, ' misplaced', '; short of text: ' || short, '; misplaced: ' || away) FROM tx
    UNION ALL SELECT page_id, 2, coverage >= 1 AND tau >= 1, concat(n_shared, ' of ', n_shared + missing, ' regions placed, ', concordant, ' pairs in order and ', discordant, ' not', '; without a place: ' || lost) FROM tq
    UNION ALL SELECT page_id, 3, missing_notes = 0 AND mistyped_notes = 0 AND span_defects = 0, concat(notes_matched, ' of ', gt_notes, ' notes matched, ', spans_preserved, ' of ', gt_spans, ' anchors kept', '; missing notes: ' || lone, '; notes of another type: ' || odd) FROM nx
    UNION ALL SELECT page_id, 4, type_errors = 0, concat(type_errors, ' type errors: ', false_positives, ' false positives, ', false_negatives, ' false negatives') FROM ty),
  vd AS (SELECT page_id, ordinal, ['structural-contract', 'text-fidelity', 'reading-order', 'footnote-anchor', 'structure-typing'][ordinal + 1] AS checker, passed AND page_id NOT IN (SELECT page_id FROM gone) AS passed, page_id IN (SELECT page_id FROM gone) AS crashed,
    CASE WHEN page_id IN (SELECT page_id FROM gone) THEN 'no verdict: MissingCandidate' ELSE detail END AS detail FROM sv)
"""
_COUNTS = ", ".join(
    f"CAST({ {'candidate_order_omits_regions': 'omitted', 'candidate_order_breaks_block_structure': 'sign(omitted)', 'candidate_order_contradicts_indices': 'against'}.get(name, 0)} AS BIGINT) AS {name}"
    for name in (f"{side}_{k}" for side in ("gt", "candidate") for k in contract.KINDS)
)
_ORACLES |= {
    scorecard_contract: f"SELECT page_id, {_COUNTS}, omitted + against = 0 AS passed FROM ct",
    scorecard_results: _DOCUMENTS + "SELECT CAST(page_id AS VARCHAR) AS page_id, checker, CAST(ordinal AS INTEGER) AS ordinal, 'hard' AS severity, passed, crashed, detail FROM vd",
    scorecard_summary: _DOCUMENTS + "SELECT CAST(page_id AS VARCHAR) AS page_id, count(*) AS total, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS hard_failures, CAST(0 AS BIGINT) AS soft_failures, count(*) FILTER (crashed) AS crashed_checks, bool_and(passed) AS passed, CAST(NOT bool_and(passed) AS INTEGER) AS exit_code FROM vd GROUP BY page_id",
    crash_isolation: _DOCUMENTS + """, er AS (SELECT page_id, CASE WHEN page_id % 19 = 4 THEN 'NotFinite' WHEN page_id IN (SELECT page_id FROM gone) THEN 'MissingCandidate' WHEN page_id % 13 = 2 THEN 'JSONDecodeError' WHEN page_id % 17 = 3 THEN 'RepeatedKey' END AS error FROM (SELECT DISTINCT page_id FROM gn))
        SELECT page_id, checker, 'hard' AS severity, passed AND error IS NULL AS passed, error IS NOT NULL AS crashed, error FROM vd JOIN er USING (page_id)""",
}


def _shown(number: str) -> str:
    """SQL: a double as JSON has it, whole ones without a point."""
    return f"CASE WHEN {number} = floor({number}) THEN CAST(CAST({number} AS BIGINT) AS VARCHAR) ELSE CAST({number} AS VARCHAR) END"


def _object(fields: dict[str, str]) -> str:
    """SQL: a JSON object of keys in order of their names; a null value leaves its key out."""
    return "concat('{', concat_ws(',', " + ", ".join(f"""'"{k}":' || {fields[k]}""" for k in sorted(fields)) + "), '}')"


def _same(*names: str) -> dict[str, str]:
    return {name: f"CAST({name} AS VARCHAR)" for name in names}


_SOME = {"candidate_order_omits_regions": "omitted", "candidate_order_breaks_block_structure": "CAST(sign(omitted) AS BIGINT)", "candidate_order_contradicts_indices": "against"}
_FIDELITY = _same("contained", "gt_ngrams", "n", "regions_scored") | {
    "containment": _shown("containment"), "excess_ngrams": "CAST(excess AS VARCHAR)", "gross_region_defects": "CAST(gross AS VARCHAR)", "gross_region_retention": "'0.6'", "min_containment": "'0.95'", "min_region_retention": "'0.95'",
    "minor_region_defects": "CAST(minor AS VARCHAR)", "minor_region_defects_allowed": "CAST(minor_allowed AS VARCHAR)", "misplaced_regions": "CAST(misplaced AS VARCHAR)", "precision": _shown("precision_"),
    "region_defects": "CAST(gross + minor AS VARCHAR)", "reward_block_reason": "'\"the region-defect aggregate is not weighted by magnitude\"'", "reward_ready": "'false'", "worst_region_retention": _shown("worst_retention"),
}
_NOTES = _same("gt_notes", "notes_matched", "missing_notes", "mistyped_notes", "gt_spans", "spans_preserved", "span_defects", "spans_skipped")
_ORDER = _same("missing", "n_shared") | {k: _shown(k) for k in ("coverage", "lis_ratio")} | {"kendall_tau": _shown("tau"), "gt_order_signal": "'\"indices\"'", "order_signal": "CASE WHEN page_id % 5 = 0 THEN '\"declared\"' ELSE '\"indices\"' END"}
_TYPES = _same("false_positives", "false_negatives", "type_errors") | {k: _shown(f"round({k}, 4)") for k in ("micro_f1", "macro_f1", "body_f1", "footnote_f1", "heading_f1")}
_JSON = f""", ln AS (SELECT page_id, pos, cand_pos, 1 AS len FROM pd WHERE cand_pos IS NOT NULL UNION ALL SELECT p.page_id, p.pos, p.cand_pos, l.len + 1 FROM ln l JOIN pd p ON p.page_id = l.page_id AND p.pos > l.pos AND p.cand_pos > l.cand_pos),
  od AS (SELECT tq.*, CASE WHEN n_shared = 0 THEN 1.0::DOUBLE ELSE CAST(lis AS DOUBLE) / CAST(n_shared AS DOUBLE) END AS lis_ratio FROM tq LEFT JOIN (SELECT page_id, max(len) AS lis FROM ln GROUP BY page_id) USING (page_id)),
  js AS (SELECT page_id, 0 AS ordinal, {_object({f"{side}_{k}": f"CAST({_SOME.get(f'{side}_{k}', '0')} AS VARCHAR)" for side in ("gt", "candidate") for k in contract.KINDS})} AS metrics FROM ct
    UNION ALL SELECT page_id, 1, {_object(_FIDELITY)} FROM tg
    UNION ALL SELECT page_id, 2, {_object(_ORDER)} FROM od
    UNION ALL SELECT page_id, 3, {_object(_NOTES)} FROM nx
    UNION ALL SELECT page_id, 4, {_object(_TYPES)} FROM ty)
"""
_ORACLES[scorecard_json] = _DOCUMENTS + _JSON + """SELECT CAST(page_id AS VARCHAR) AS page_id, concat('{"passed":', bool_and(passed), ',"exit_code":', CAST(NOT bool_and(passed) AS INTEGER),
    ',"summary":{"total":', count(*), ',"passed":', count(*) FILTER (passed), ',"hard_failures":', count(*) FILTER (NOT passed), ',"soft_failures":0,"crashed":', count(*) FILTER (crashed), '},"results":[',
    string_agg(concat('{"id":"', checker, '","passed":', passed, ',"severity":"hard","detail":"', detail, '","metrics":', CASE WHEN crashed THEN '{"crashed":true,"error":"MissingCandidate"}' ELSE metrics END, '}'), ',' ORDER BY ordinal),
    ']}') AS scorecard FROM vd JOIN js USING (page_id, ordinal) GROUP BY page_id"""

QUERIES: dict[str, Query] = {f.__name__: f for f in _ORACLES}
ORACLES: dict[str, str] = {f.__name__: f"WITH RECURSIVE {SQL}{sql if sql.startswith(',') else chr(10) + sql}" for f, sql in _ORACLES.items()}
