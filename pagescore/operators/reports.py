"""Reports of element metrics, from small result tables: text, JSON and HTML."""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescore.operators.metrics import baseline_delta, micro_macro, status_class, top_errors


def _collected(by_type: DataFrame, errors: DataFrame | None, baseline: DataFrame | None, top: int) -> dict:
    """What a report shows: a row for each element type, which are few."""
    types = [r.asDict() for r in by_type.withColumn("status", status_class(F.col("f1"))).orderBy("element_type").collect()]
    total = micro_macro(by_type, []).first() if types else None
    shown = {r["element_type"]: r["shown"] for r in baseline_delta(by_type, baseline, "element_type").collect()} if baseline is not None else {}
    return {"types": types, "total": total.asDict() if total else {}, "shown": shown, "errors": [r.asDict() for r in top_errors(errors, top).collect()] if errors is not None else []}


def text_report(by_type: DataFrame, title: str = "Evaluation", errors: DataFrame | None = None, baseline: DataFrame | None = None) -> str:
    """Totals, a table of types with their change against a baseline, micro and macro rates, the five most frequent errors."""
    got = _collected(by_type, errors, baseline, 5)
    total = got["total"]
    lines = [title, "=" * len(title), f"ground truth: {total.get('tp', 0) + total.get('fn', 0)}  predicted: {total.get('tp', 0) + total.get('fp', 0)}", ""]
    lines.append(f"{'type':<16}{'P':>8}{'R':>8}{'F1':>8}{'n':>7}{'change':>9}")
    lines += [f"{t['element_type']:<16}{t['precision_']:>8.3f}{t['recall']:>8.3f}{t['f1']:>8.3f}{t['support']:>7}{got['shown'].get(t['element_type']) or '':>9}" for t in got["types"]]
    if total:
        lines += ["", *(f"{kind}: P {total[f'{kind}_precision']:.3f}  R {total[f'{kind}_recall']:.3f}  F1 {total[f'{kind}_f1']:.3f}" for kind in ("micro", "macro"))]
    if got["errors"]:
        lines += ["", "most frequent errors:", *(f"  {e['error']}: {e['n']}" for e in got["errors"])]
    return "\n".join(lines)


def json_report(by_type: DataFrame, errors: DataFrame | None = None, now: datetime | None = None) -> str:
    """A versioned envelope with rates rounded to four places."""
    got = _collected(by_type, errors, None, 10)
    rounded = lambda row: {k: round(v, 4) if isinstance(v, float) else v for k, v in row.items()}
    when = (now or datetime.now(timezone.utc)).isoformat()
    return json.dumps({"version": "1.0", "generated_at": when, "metrics": {"by_type": {t["element_type"]: rounded(t) for t in got["types"]}, "overall": rounded(got["total"])}, "top_errors": got["errors"]}, indent=2)


def html_report(by_type: DataFrame, title: str = "Evaluation", errors: DataFrame | None = None) -> str:
    """A page with a summary, a table of types by status, and the ten most frequent errors."""
    got = _collected(by_type, errors, None, 10)
    rows = "".join(f"<tr class='{t['status']}'><td>{html.escape(str(t['element_type']))}</td><td>{t['precision_']:.3f}</td><td>{t['recall']:.3f}</td><td>{t['f1']:.3f}</td><td>{t['support']}</td></tr>" for t in got["types"])
    faults = "".join(f"<li>{html.escape(str(e['error']))}: {e['n']}</li>" for e in got["errors"])
    total = got["total"]
    summary = f"<p>micro F1 {total['micro_f1']:.3f}, macro F1 {total['macro_f1']:.3f}</p>" if total else "<p>nothing was matched</p>"
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{summary}<table><tr><th>type<th>P<th>R<th>F1<th>n</tr>{rows}</table>" + (f"<h2>Errors</h2><ul>{faults}</ul>" if faults else "")
