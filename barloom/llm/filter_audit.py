"""What each document filter removes, in every order in which the filters could be applied.

A document's failures are a mask of as many bits as there are filters, so a
corpus reduces to a few counts for each part (a source) and mask: the only step
over documents, and one that is summed before it is shuffled. The counts of a
part become a decision diagram: each level asks one filter, a node's low child
are the documents that pass it and its high child those that fail, equal nodes
are shared, and each node carries the documents below it. Swapping the filters
of two neighbouring levels touches only the nodes of those levels, and a chain of
such swaps visits every order. The path of low children of an order is the chain
of its steps: the high child beside the path is what a step removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import cut_lineage

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
OUTPUT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


class Diagram:
    """Decision diagram over failure masks whose nodes carry counts (documents, good, toxic).

    Every path asks every filter, so a node's level follows from its depth;
    nodes with the same children are one node.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int):
        self.order = list(range(filters))
        self._ids: dict[tuple, int] = {}
        self.low: list[int] = []
        self.high: list[int] = []
        self.weight: list[tuple[int, ...]] = []
        nothing = (0,) * (len(next(iter(counts.values()))) if counts else 1)
        # filter 0 is asked first, so it is the highest bit of a leaf's number
        layer = [self._leaf(counts.get(sum(1 << f for f in self.order if k >> (filters - 1 - f) & 1), nothing)) for k in range(1 << filters)]
        while len(layer) > 1:
            layer = [self._node(layer[k], layer[k + 1]) for k in range(0, len(layer), 2)]
        self.root = layer[0]

    def _add(self, key: tuple, low: int, high: int, weight: tuple[int, ...]) -> int:
        if key not in self._ids:
            self._ids[key] = len(self.weight)
            self.low.append(low)
            self.high.append(high)
            self.weight.append(weight)
        return self._ids[key]

    def _leaf(self, weight: tuple[int, ...]) -> int:
        return self._add(("leaf", weight), -1, -1, weight)

    def _node(self, low: int, high: int) -> int:
        return self._add((low, high), low, high, tuple(a + b for a, b in zip(self.weight[low], self.weight[high])))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the level below it."""
        done: dict[int, int] = {}

        def moved(node: int, depth: int) -> int:
            if node not in done:
                low, high = self.low[node], self.high[node]
                if depth < level:
                    done[node] = self._node(moved(low, depth + 1), moved(high, depth + 1))
                else:
                    done[node] = self._node(self._node(self.low[low], self.low[high]), self._node(self.high[low], self.high[high]))
            return done[node]

        self.root = moved(self.root, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept, removed) along the path of documents that pass everything."""
        node = self.root
        for f in self.order:
            yield f, self.weight[self.low[node]], self.weight[self.high[node]]
            node = self.low[node]


def all_orders(n: int) -> Iterator[int]:
    """Levels to swap with the next one, so that every order of n filters but the first is met once."""
    if n < 2:
        return
    inner = all_orders(n - 1)
    down = True
    while True:
        # the last filter walks through the order of the others, then they make one swap
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        nxt = next(inner, None)
        if nxt is None:
            return
        yield nxt + 1 if down else nxt
        down = not down


def audit(counts: dict[int, tuple[int, int, int]], names: str) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    diagram, seen, share, fails = Diagram(counts, len(names)), [], [0] * len(names), [0] * len(names)
    swaps = all_orders(len(names))
    while True:
        path = list(diagram.steps())
        seen.append(("".join(names[f] for f in diagram.order), path))
        for f, _, removed in path:
            share[f] += removed[0]
        fails[path[0][0]] = path[0][2][0]
        level = next(swaps, None)
        if level is None:
            break
        diagram.swap(level)
    alone = [counts.get(1 << f, (0, 0, 0))[0] for f in range(len(names))]
    return [(order, k + 1, kept[0], removed[0], fails[f] - removed[0], alone[f], removed[1], removed[2], share[f])
            for order, path in seen for k, (f, kept, removed) in enumerate(path)]


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text: too few words, too few different words, capitals, odd signs."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    # bound once: the word list is made once a text, not once a condition
    size = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": size["n"] < 200, "B": F.lit(100) * size["d"] < F.lit(50) * size["n"],
            "C": F.lit(100) * capitals > F.lit(2) * F.length(text), "D": text.rlike("[#$%&*|]")}


def failure_masks(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, mask (bits of A to E from the lowest).

    E needs the whole table: documents other than the smallest doc_id of their
    text. The smallest ids are found with a map-side aggregation by the text's
    128-bit digest, and met by (digest, doc_id), so the copies of one text are
    spread over all tasks by their ids.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    mask = sum((fails.cast("int") * (1 << k) for k, fails in enumerate(text_failures(F.col("_text")).values())), F.lit(0))
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("part"), text.alias("_text"))
                       .select("doc_id", "part", F.unhex(F.md5(F.encode("_text", "UTF-8"))).alias("_digest"), mask.alias("mask")))
    first = (rows.where("doc_id IS NOT NULL").groupBy("_digest").agg(F.min("doc_id").alias("doc_id"))
             .withColumn("_first", F.lit(True)))
    named = (rows.where("doc_id IS NOT NULL").join(first, ["_digest", "doc_id"], "left")
             .select("doc_id", "part", (F.col("mask") + F.when(F.col("_first"), 0).otherwise(16)).alias("mask")))
    return named.unionByName(rows.where("doc_id IS NULL").select("doc_id", "part", "mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones of every part and mask."""
    known = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")))
    rows = masks.where("doc_id IS NOT NULL").join(known, "doc_id", "left").unionByName(masks.where("doc_id IS NULL"), allowMissingColumns=True)
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).cast("long").alias("good"),
        F.coalesce(F.sum("_toxic"), F.lit(0)).cast("long").alias("toxic"))


def audit_parts(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """All orders and steps of each part, from rows (part, mask, n, good, toxic)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = audit({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in cells}, names)
                columns = [pa.array([part] * len(table), pa.string())]
                columns += [pa.array(list(c), t) for c, t in zip(zip(*table), [pa.string(), pa.int32()] + [pa.int64()] * 7)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in OUTPUT.split(", ")])

    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return per_part.mapInArrow(rows, OUTPUT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Interaction of five filters (A to E) within each source, for all 120 orders and every step.

    Returns part, filter_order, step, and the counts kept, removed, redundant
    (failing the step's filter, removed before), unique_fails (failing no other
    filter), good_lost, toxic_lost (removed ones with such a label) and shapley
    (removed by this filter, summed over all orders), zeros included.

    A null text counts as empty, a null or missing source as ''. Repeated rows
    count each; rows of one doc_id are not copies of each other. A row without
    doc_id has no label, is never a copy (E) and makes no other row one. Labels
    of a repeated doc_id count if one of them says so. Other columns are ignored;
    an empty table has no parts and gives no rows.

    At most 32 rows a part and map task are shuffled for the counts, and a part's
    diagram has at most 63 nodes for each order, whatever the size of the part.
    """
    return audit_parts(mask_counts(failure_masks(docs), labels))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS lowest FROM d),
f AS (SELECT doc_id, part, concat(
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
        CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
        CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN doc_id > lowest THEN 'E' ELSE '' END) AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
      WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
k AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS earlier
      FROM (SELECT DISTINCT part FROM c), o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
j AS (SELECT k.*, n, good, toxic, fails, contains(fails, letter) AS hit, translate(fails, earlier, '') <> fails AS gone FROM k JOIN c USING (part)),
g AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept,
      coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
      coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost,
      coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM j GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
"""
