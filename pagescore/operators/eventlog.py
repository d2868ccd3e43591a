"""Integrity of append-only event logs: rules that lines break, and audit statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vocabularies of the log and its ladders, lowest first. Fixed values.
EVENTS = ("delegation", "disposition", "review-verdict", "intervention", "meta-audit")
MODELS = ("haiku", "sonnet", "opus", "fable")
EFFORTS = ("low", "medium", "high", "xhigh", "max")
DEFAULT_EFFORT = "medium"
DISPOSITIONS = ("accepted", "accepted-with-edits", "rework", "rejected", "cancelled")
FAULT_LAYERS = ("model-capacity", "contract", "context", "verification", "taste", "upstream")
OUTCOMES = ("confirmed", "refuted", "underdetermined")
MAX_GAP = 2


def text(path: str) -> Column:
    return F.try_variant_get("event", f"$.{path}", "string")


def rung(value: Column, ladder: tuple[str, ...]) -> Column:
    """The place on a ladder, from 0; null for what isn't on it."""
    at = F.array_position(F.array(*map(F.lit, ladder)), value)
    return F.when(at > 0, at - 1)


def effort(path: str) -> Column:
    own = text(path)
    return rung(F.when(own == "default", DEFAULT_EFFORT).otherwise(own), EFFORTS)


def tier_gap() -> Column:
    """Rungs by which the chosen model and effort exceed the rubric's; a rung below counts as none."""
    model = rung(text("tier_chosen.model"), MODELS) - rung(text("tier_rubric_default.model"), MODELS)
    work = effort("tier_chosen.effort") - effort("tier_rubric_default.effort")
    return F.greatest(F.coalesce(model, F.lit(0)), F.lit(0)) + F.greatest(F.coalesce(work, F.lit(0)), F.lit(0))


def dangling(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """References (ref, line) whose id has no definition (id, line) on an earlier line.

    Only the first line of each id matters, so the join is one of equal ids.
    """
    first = definitions.groupBy("id").agg(F.min("line").alias("first_line"))
    return references.join(first, references["ref"] == first["id"], "left").where("first_line is null or first_line >= line").drop("id", "first_line")


def repeated(definitions: DataFrame) -> DataFrame:
    """(id, n) of ids defined more than once."""
    return definitions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def problems(log: DataFrame, task_classes: tuple[str, ...] = ()) -> DataFrame:
    """(line, severity, rule) of every broken rule, from log rows (line, event variant; null event: no JSON).

    task_classes: the known ones, if they are to be checked. Each line of a repeated id but the first is a problem.
    One pass over the log makes every line's marks: rules that it breaks by itself, and ids that another line has to settle.
    A second one finds each id's first line; marks meet these in one join of equal ids.
    """
    member = lambda path, kind: F.try_variant_get("event", f"$.{path}", kind)
    layer = F.expr("transform(try_variant_get(event, '$.findings', 'array<variant>'), f -> try_variant_get(f, '$.fault_layer', 'string'))")
    tiers = {f"{side}_{what}": text(f"{path}.{what}") for side, path in (("chosen", "tier_chosen"), ("default", "tier_rubric_default")) for what in ("model", "effort")}
    # every member is taken out of the event once; rules are on these columns
    lines = log.select(
        "line", F.col("event").isNull().alias("no_json"), text("event").alias("kind"), *[text(c).alias(c) for c in ("id", "ref", "disposition", "verdict", "diagnosis_outcome", "task_class")], *[v.alias(k) for k, v in tiers.items()],
        tier_gap().alias("gap"), F.coalesce(member("overfit_steps", "int"), F.lit(0)).alias("told"), F.trim(text("justification")).alias("why"), member("overkill_suspect", "boolean").alias("overkill"),
        member("actual_tokens", "long").isNull().alias("no_tokens"), member("predicted_signal", "variant").isNull().alias("no_signal"), layer.alias("layers"), member("refs", "array<string>").alias("refs"),
    )
    kind = F.col("kind")
    is_kind = lambda name: F.coalesce(kind == name, F.lit(False))
    outside = lambda value, words: value.isNotNull() & ~value.isin(*words)
    delegation, disposition, review, intervention = map(is_kind, EVENTS[:4])
    closes = F.col("verdict").isNotNull() | F.col("diagnosis_outcome").isNotNull()
    gap, told = F.col("gap"), F.col("told")
    excused = (F.coalesce("why", F.lit("")) != "") | F.coalesce("overkill", F.lit(False))
    # a mark: need 'none' holds as it is, 'earlier' unless the id has an earlier line, 'first' if it has one
    mark = lambda rule, severity="error", space=None, name=None, need="none": F.struct(
        F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(space).cast("string").alias("space"), (F.lit(None) if name is None else name).cast("string").alias("id"), F.lit(need).alias("need")
    )
    dangling_ref = lambda ref: mark("ref to no earlier delegation", space="delegation", name=ref, need="earlier")
    told_of = [
        (F.col("no_json"), mark("not valid JSON")),
        (~F.col("no_json") & ~F.coalesce(kind.isin(*EVENTS), F.lit(False)), mark("unknown event")),
        (delegation & F.col("id").isNotNull(), mark("duplicate delegation id", space="delegation", name=F.col("id"), need="first")),
        (disposition | review, dangling_ref(F.col("ref"))),
        (delegation & (outside(F.col("chosen_model"), MODELS) | outside(F.col("default_model"), MODELS)), mark("unknown model")),
        (delegation & (outside(F.col("chosen_effort"), (*EFFORTS, "default")) | outside(F.col("default_effort"), (*EFFORTS, "default"))), mark("unknown effort", "warning")),
        (delegation & (told < gap), mark("overfit_steps understates the tier gap")),
        (delegation & (F.greatest(gap, told) >= MAX_GAP) & ~excused, mark("tier gap without justification")),
        (disposition & outside(F.col("disposition"), DISPOSITIONS), mark("unknown disposition")),
        (disposition & (F.coalesce("disposition", F.lit("")) != "cancelled") & F.col("no_tokens"), mark("no actual_tokens", "warning")),
        (review & F.exists("layers", lambda x: outside(x, FAULT_LAYERS)), mark("unknown fault_layer")),
        (intervention & ~closes & F.col("no_signal"), mark("opening without predicted_signal")),
        (intervention & closes, mark("closing without an earlier opening", space="opening", name=F.col("id"), need="earlier")),
        (intervention & closes & F.col("diagnosis_outcome").isNull(), mark("closing without diagnosis_outcome", "warning")),
        (intervention & closes & outside(F.col("diagnosis_outcome"), OUTCOMES), mark("unknown diagnosis_outcome")),
    ]
    if task_classes:
        told_of.append((delegation & outside(F.col("task_class"), task_classes), mark("unknown task_class")))
    own = F.filter(F.array(*[F.when(holds, what) for holds, what in told_of]), lambda x: x.isNotNull())
    refs = F.when(intervention, F.transform("refs", dangling_ref))
    marks = lines.select("line", F.inline(F.concat(own, F.coalesce(refs, F.slice(own, 1, 0)))))
    # a mark without an id meets nothing, and goes where its line's number sends it
    marks = marks.withColumn("space", F.coalesce("space", F.lit(""))).withColumn("id", F.coalesce("id", F.concat(F.lit("\x00"), F.col("line").cast("string"))))
    space = F.when(delegation, "delegation").when(intervention & ~closes, "opening")
    first = lines.where(space.isNotNull() & F.col("id").isNotNull()).groupBy(space.alias("space"), "id").agg(F.min("line").alias("first_line"))
    earlier = F.coalesce(F.col("first_line") < F.col("line"), F.lit(False))
    broken = (F.col("need") == "none") | ((F.col("need") == "earlier") & ~earlier) | ((F.col("need") == "first") & earlier)
    return marks.join(first, ["space", "id"], "left").where(broken).select("line", "severity", "rule")


def audit(log: DataFrame) -> DataFrame:
    """One row of statistics; a rate is null where nothing counts towards it.

    Rates are over distinct delegations: overshoot and undershoot over those with a review that names a sufficient tier
    (below or above the chosen one), rework over those with a disposition, linkage of all to a review. Calibration is
    actual over predicted tokens. Interventions count by their closing lines.
    """
    known = log.where("event is not null").withColumn("kind", text("event"))
    delegation = known.where("kind = 'delegation'").groupBy(text("id").alias("id")).agg(
        F.min_by(F.struct(rung(text("tier_chosen.model"), MODELS).alias("m"), effort("tier_chosen.effort").alias("e"), F.try_variant_get("event", "$.predicted.tokens", "double").alias("tokens")), "line").alias("d")
    )
    review = known.where("kind = 'review-verdict'").groupBy(text("ref").alias("id")).agg(
        F.max_by(F.struct(rung(text("retrospectively_sufficient_tier.model"), MODELS).alias("m"), effort("retrospectively_sufficient_tier.effort").alias("e")), "line").alias("r")
    )
    disposition = known.where("kind = 'disposition'").groupBy(text("ref").alias("id")).agg(
        F.max_by(F.struct(text("disposition").alias("what"), F.try_variant_get("event", "$.actual_tokens", "double").alias("tokens")), "line").alias("p")
    )
    row = delegation.join(review, "id", "left").join(disposition, "id", "left")
    below = (F.col("r.m") < F.col("d.m")) | ((F.col("r.m") == F.col("d.m")) & (F.col("r.e") < F.col("d.e")))
    above = (F.col("r.m") > F.col("d.m")) | ((F.col("r.m") == F.col("d.m")) & (F.col("r.e") > F.col("d.e")))
    rate = lambda hit, of: F.try_divide(F.count_if(F.coalesce(hit, F.lit(False))).cast("double"), F.count_if(of).cast("double"))
    judged = F.col("r.m").isNotNull()
    both = F.col("p.tokens").isNotNull() & F.col("d.tokens").isNotNull()
    stats = row.agg(
        F.count(F.lit(1)).alias("delegations"), rate(below, judged).alias("overshoot_rate"), rate(above, judged).alias("undershoot_rate"),
        rate(F.col("p.what") == "rework", F.col("p").isNotNull()).alias("rework_rate"), rate(F.col("r").isNotNull(), F.lit(True)).alias("review_linkage_fraction"),
        F.try_divide(F.sum(F.when(both, F.col("p.tokens"))), F.sum(F.when(both, F.col("d.tokens")))).alias("token_prediction_calibration"),
    )
    closed = known.where("kind = 'intervention'").select(text("verdict").alias("verdict"), text("diagnosis_outcome").alias("outcome"))
    ends = closed.agg(
        rate(F.col("verdict") == "Corroborated", F.col("verdict").isNotNull()).alias("intervention_success_rate"),
        rate(F.col("outcome") == "confirmed", F.coalesce(F.col("outcome").isin("confirmed", "refuted"), F.lit(False))).alias("diagnosis_hit_rate"),
    )
    return stats.join(F.broadcast(ends))  # one row each
