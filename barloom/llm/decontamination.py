"""Benchmark decontamination: exact containment of item windows by a prefix-filtered join.

Both sides are sequences of words. An item gives windows of ten consecutive
words (a shorter item is one window), and a window occurs in a document only if
all its shingles do. So the shingles of the benchmark are put in one global
order, the rarest in the documents first, and of every window only the first
shingle of that order (the prefix that full containment needs) is joined with
the documents' shingles. Positional bounds drop matches whose window would begin
before the document or end after it, and what is left is verified word by word
against the window. A long document is never cut: it is looked at window by
window.

One pass reads the texts. It keeps, for every document, the places where a
shingle of the benchmark may stand (tested against a bit map of fixed size) with
the words around them; all later steps read only that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import cut_lineage

WINDOW, SHINGLE = 10, 3
#: Bits of the map that tests shingles, two tests each. More benchmark shingles only let more places through to the exact join.
MAP_BITS = 1 << 20
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cases A-Z and takes the runs of letters, digits and characters outside ASCII; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITALS, SMALL), F.lit(WORD), F.lit(0))


def _shingle(w: str, start: str, size: int) -> str:
    """SQL for the hash of ``size`` words of array ``w`` from the 0-based place ``start``; the size is part of it."""
    return f"xxhash64({size}, " + ", ".join(f"{w}[int({start}) + {k}]" for k in range(size)) + ")"


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct windows: (window: array<string>, size) with a row for each item that holds it (item_id as string)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = f"sequence(0, greatest(size(w) - {WINDOW}, 0))"
    return (w.select("item_id", "w", F.explode(F.expr(starts)).alias("k"))
            .select("item_id", F.expr(f"slice(w, k + 1, {WINDOW})").alias("window")).distinct())


def _bit_map(shingles: DataFrame) -> str:
    """SQL array of longs that has the two bits of every shingle set; MAP_BITS long whatever the benchmark's size."""
    bits = (shingles.select(F.explode(F.array(F.pmod("sh", F.lit(MAP_BITS)), F.pmod(F.shiftright("sh", 24), F.lit(MAP_BITS)))).alias("b"))
            .groupBy(F.floor(F.col("b") / 64).cast("int").alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("v")).collect())
    cells = [0] * (MAP_BITS // 64)
    for r in bits:
        cells[r["at"]] = r["v"]
    return f"cast(split('{','.join(map(str, cells))}', ',') AS array<bigint>)"  # folded to a constant by the optimizer


def _places(docs: DataFrame, windows: DataFrame, name: Column) -> DataFrame:
    """One row per document: doc_id (what ``name`` says), _row, n_words and ``places`` (at, sh, before, around) where a benchmark shingle may stand."""
    shingles = windows.select(F.explode(F.expr(
        f"transform(sequence(0, size(window) - least({SHINGLE}, size(window))), k -> struct(least({SHINGLE}, size(window)) AS size, "
        f"CASE size(window) WHEN 1 THEN {_shingle('window', 'k', 1)} WHEN 2 THEN {_shingle('window', 'k', 2)} ELSE {_shingle('window', 'k', 3)} END AS sh))"
    )).alias("s")).select("s.size", "s.sh").distinct()
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # at most SHINGLE values
    d = docs.select(name.alias("doc_id"), F.monotonically_increasing_id().alias("_row"), words(F.col("text")).alias("w"))
    if not sizes:
        return d.select("doc_id", "_row", F.size("w").cast("long").alias("n_words"), F.expr(
            "cast(array() AS array<struct<at: int, sh: bigint, before: int, around: array<string>>>)").alias("places"))
    m = _bit_map(shingles)
    found = []
    for n in sorted(sizes):
        has = " AND ".join(f"getbit({m}[int(pmod({h}, {MAP_BITS}L) div 64)], int(pmod({h}, {MAP_BITS}L) % 64)) = 1" for h in ("s.sh", "shiftright(s.sh, 24)"))
        found.append(f"""transform(filter(transform(sequence(0, size(w) - {n}), i -> struct(int(i) AS at, {_shingle('w', 'i', n)} AS sh)), s -> {has}),
            s -> struct(s.at AS at, s.sh AS sh, least(s.at, {WINDOW - n}) AS before,
                        slice(w, s.at + 1 - least(s.at, {WINDOW - n}), {2 * WINDOW - n}) AS around))""")
        found[-1] = f"CASE WHEN size(w) >= {n} THEN {found[-1]} ELSE array() END"
    places = found[0] if len(found) == 1 else f"concat({', '.join(found)})"
    return d.select("doc_id", "_row", F.size("w").cast("long").alias("n_words"), F.expr(places).alias("places"))


def occurrences(docs: DataFrame, items: DataFrame, name: Column) -> tuple[DataFrame, DataFrame]:
    """All documents (doc_id, _row, n_words), and where windows occur in them: (_row, start, window, items)."""
    windows = cut_lineage(item_windows(items).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    table = cut_lineage(_places(docs, windows, name))
    places = table.select("_row", "n_words", F.explode("places").alias("p")).select("_row", "n_words", "p.*")
    rarity = places.groupBy("sh").agg(F.count("*").alias("_n"))
    n = f"least({SHINGLE}, size(window))"
    each = windows.select("window", "items", F.posexplode(F.expr(f"transform(sequence(0, size(window) - {n}), k -> CASE size(window) "
                          f"WHEN 1 THEN {_shingle('window', 'k', 1)} WHEN 2 THEN {_shingle('window', 'k', 2)} ELSE {_shingle('window', 'k', 3)} END)")).alias("k", "sh"))
    # a shingle that no document has is the rarest of all: its windows occur nowhere
    rarest = Window.partitionBy("window").orderBy(F.coalesce("_n", F.lit(0)), "sh", "k")
    prefix = (each.join(rarity, "sh", "left").withColumn("_first", F.row_number().over(rarest)).where("_first = 1 AND _n IS NOT NULL")
              .select("sh", "k", "window", "items"))
    start = F.col("at") - F.col("k")
    met = places.join(prefix, "sh").where((start >= 0) & (start + F.size("window") <= F.col("n_words")))
    real = F.expr("slice(around, before - k + 1, size(window)) = window")
    return table.drop("places"), met.where(real).select("_row", start.alias("start"), "window", "items")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What of each document is benchmark text: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a window is hit, once. Null and
    empty texts have no words; items without words have no windows; items with
    equal windows all count; null item_ids are not counted. Repeated rows and
    null doc_ids are separate rows, and other columns are ignored. Without items
    or documents nothing is hit, or no row returned.
    """
    table, found = occurrences(docs, items, F.col("doc_id").cast("long"))
    found = cut_lineage(found)
    hit = (found.select("_row", F.explode(F.expr("sequence(start, start + size(window) - 1)")).alias("at")).distinct()
           .groupBy("_row").agg(F.count("*").alias("n_hit")))
    held = (found.select("_row", F.explode("items").alias("item")).distinct().groupBy("_row")
            .agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("_ids")))
    out = table.join(hit, "_row", "left").join(held, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce("_ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs, all columns kept."""
    digest = F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    table, found = occurrences(docs, items, digest)
    hit = table.join(found.select("_row").distinct(), "_row", "left_semi").select(F.col("doc_id").alias("_h")).distinct()
    named = docs.select(F.struct("*").alias("_doc"), digest.alias("_d"))
    return named.join(hit, F.col("_d") == F.col("_h"), "left_anti").select("_doc.*")


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[k + 1:k + {WINDOW}] AS win FROM (SELECT item, w, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM win),
grams AS (SELECT r, k, n, w[k + 1:k + n] AS win FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, k, n, item FROM grams JOIN win USING (win)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM found) GROUP BY r),
held AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""
