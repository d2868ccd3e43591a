"""Benchmark decontamination: a prefix-filtered set join of item windows with documents."""

from __future__ import annotations

from string import ascii_letters, ascii_lowercase, digits

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pagescore.llm.common import ascii_lower, table, written

#: Every character but the ASCII ones that are neither digits nor small letters. Java looks single characters up in a table,
#: which is ten times as fast as the same class by its complement; + takes whole runs and never gives any back.
WORD = f"[{digits}{ascii_lowercase}\\x{{80}}-\\x{{10FFFF}}]++"
#: The same words before A-Z are lower-cased, which changes no word's place or length.
ANY_CASE_WORD = f"[{digits}{ascii_letters}\\x{{80}}-\\x{{10FFFF}}]++"
#: Words of a window, and of the shingles that stand for it in the join.
WINDOW, SHINGLE = 10, 3
#: A side of a join is broadcast while its measured rows take no more bytes than this; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Words of the lower-cased text; none for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles(words: str, most: int) -> Column:
    """A hash of each run of `most` words, in text order; of fewer words, where the text has no more: one hash."""
    n = F.size(words)
    return F.expr(
        f"CASE WHEN size({words}) >= {most} THEN transform(sequence(0, size({words}) - {most}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(most))})) END"
    ) if most > 1 else F.when(n > 0, F.transform(words, lambda w: F.xxhash64(w)))


def positions(keyed: DataFrame, width: int) -> DataFrame:
    """_doc, _text_hash, _words_n, _at, _token: shingles("_words", width) of each row of keyed, one a row.

    Words are exploded and hashed with those that follow them, in generated code; a lambda over the array isn't compiled.
    """
    at = keyed.select("_doc", "_text_hash", "_words", F.size("_words").alias("_words_n"), F.posexplode("_words").alias("_at", "_word"))
    follow = [F.get("_words", F.col("_at") + k) for k in range(1, width)]
    return at.where(F.col("_at") + width <= F.col("_words_n")).select("_doc", "_text_hash", "_words_n", "_at", F.xxhash64("_word", *follow).alias("_token"))


def item_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct windows of all items: _win array<string>, _n int, _items array of item ids as strings."""
    words = items.select(F.col(item).cast("string").alias("_item"), words_of(F.col(text)).alias("_words")).where("size(_words) > 0")
    spans = words.withColumn("_start", F.explode(F.expr(f"sequence(0, greatest(size(_words) - {window}, 0))")))
    spans = spans.select("_item", F.slice("_words", F.col("_start") + 1, window).alias("_win"))
    return spans.groupBy("_win").agg(F.collect_set("_item").alias("_items")).withColumn("_n", F.size("_win"))


def prefix_tokens(windows: DataFrame) -> DataFrame:
    """The shingle that each window must share with a document that contains it: _token, _offset, _n, _win, _items, _width.

    Containment of the whole window needs every one of its shingles, so a prefix of one suffices: the rarest, by the
    number of windows that hold it, ties by hash. Windows of fewer words than a shingle are their own token.
    """
    cases = [F.when(F.col("_n") == k, shingles("_win", k)) for k in range(1, SHINGLE)]
    tokens = windows.withColumn("_width", F.least(F.lit(SHINGLE), F.col("_n"))).withColumn("_tokens", F.coalesce(*cases, shingles("_win", SHINGLE)))
    each = tokens.select("*", F.posexplode("_tokens").alias("_offset", "_token"))
    counted = each.withColumn("_held", F.count(F.lit(1)).over(Window.partitionBy("_width", "_token")))
    best = counted.groupBy("_win").agg(F.min_by(F.struct("_token", "_offset", "_n", "_items", "_width"), F.struct("_held", "_token", "_offset")).alias("_p"))
    return best.select("_win", "_p.*")


def measured(df: DataFrame, label: str, size: Column) -> tuple[DataFrame, int]:
    """The rows, written, and the sum of `size` over them."""
    seen = Observation()
    out = written(df.observe(seen, F.sum(size.cast("long")).alias("bytes")), label)
    return out, seen.get["bytes"] or 0


def hits(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """One row for each (doc, text) in which a window occurs: doc, _text_hash, _hit array<int> of word positions, _found item ids.

    The prefix tokens of the windows are joined with the documents' shingles; a match fixes where the window would
    start, so windows that would begin before the text or end after it go at once; the rest are compared word by word.
    """
    tokens, token_bytes = measured(prefix_tokens(item_windows(items, item, item_text, window)), "prefixes", F.octet_length(F.concat_ws(" ", "_win")) + F.octet_length(F.concat_ws(",", "_items")) + 64)
    small = lambda n: n <= BROADCAST_BYTES
    widths = sorted(r[0] for r in tokens.select("_width").distinct().collect())
    keyed = docs.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_text_hash"), words_of(F.col(text)).alias("_words"))
    bare = tokens.select("_width", "_token", "_offset", "_n").distinct()
    found = None
    for width in widths:
        own = bare.where(F.col("_width") == width)
        at = positions(keyed, width)
        part = at.join(F.broadcast(own) if small(token_bytes) else own, "_token").where("_at >= _offset and _at - _offset + _n <= _words_n")
        part = part.select("_doc", "_text_hash", F.struct((F.col("_at") - F.col("_offset")).alias("start"), F.col("_n").alias("n")).alias("_span"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = keyed.select("_doc", "_text_hash", F.struct(F.lit(0).alias("start"), F.lit(0).alias("n")).alias("_span")).where("false")
    spans = found.groupBy("_doc", "_text_hash").agg(F.collect_set("_span").alias("_spans")).withColumnRenamed("_doc", "_d").withColumnRenamed("_text_hash", "_h")
    spans, span_bytes = measured(spans, "spans", F.size("_spans") * 16 + 64)
    if small(span_bytes):
        spans = F.broadcast(spans)  # so that no text is dealt out
    # else only texts are; words are taken of those that have a candidate
    whole = docs.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    candidates = whole.join(spans, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_h")))
    claims = candidates.withColumn("_words", words_of(F.col("_text"))).select(
        "_doc", "_text_hash", F.explode(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), F.slice("_words", s["start"] + 1, s["n"]).alias("win")))).alias("_c")
    ).select("_doc", "_text_hash", F.col("_c.start").alias("_start"), F.col("_c.win").alias("_win"))
    known = tokens.select("_win", "_n", "_items")
    exact = claims.join(F.broadcast(known) if small(token_bytes) else known, "_win")
    return exact.groupBy("_doc", "_text_hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(_start, _start + _n - 1)"))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("item_ids"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add n_words long, n_hit long (words inside an occurrence of an item's window), item_ids array<string>.

    A window is `window` consecutive words of an item, or the whole of an item with fewer; items without words have
    none. Repeated rows get equal results; null texts have no words; an empty items table hits nothing. Extra columns
    pass through, but for those named as the results, which are replaced; names that start with _ are used here.
    """
    found = hits(docs, doc, text, items, item, item_text, window).withColumnRenamed("_doc", "_d").withColumnRenamed("_text_hash", "_h")
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_hit", "item_ids")]
    counted = docs.select(*kept, F.xxhash64(text).alias("_text_hash"), F.coalesce(F.regexp_count(F.col(text), F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = counted.join(found, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("_text_hash") == F.col("_h")), "left")
    return joined.select(*kept, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op6_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t FROM i),
lens AS (SELECT DISTINCT n FROM win),
p AS (SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS s, w FROM d, lens WHERE len(w) >= n),
q AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM p),
m AS (SELECT q.r, q.s, q.n, win.item_id FROM q JOIN win ON q.t = win.t AND q.n = win.n),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS k FROM m) GROUP BY r),
f AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN f ON d.r = f.r
"""
