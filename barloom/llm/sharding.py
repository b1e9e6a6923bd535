"""Contiguous shards with the smallest possible largest shard.

Rows with equal texts are one atomic group. Groups stand in the order of a hash
of their text, and the line of their sizes is cut into ``shards`` runs so that
the largest run is as small as it can be: a binary search over the capacity,
where a capacity is feasible if filling shards greedily up to it needs no more
than ``shards`` of them.

The line itself never leaves the executors. The driver holds only a histogram of
it: 4,096 cells at first, and wherever a cut could still fall, 256 finer ones in
place of a cell. The best cut at whole cells bounds the capacity from above, the
mean and the largest group bound it from below, and both bounds together tell
which cells a cut can reach. When each of those holds a single group, greedy
filling over cells is greedy filling over groups, so the capacity is exact. The
shards are then cut at cells: each near the mean of what is left, none above the
capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.common import cut_lineage

#: Bits of the group order in the first histogram, and bits added to a cell that is looked into.
FIRST_BITS, MORE_BITS = 12, 8
#: Rows of a shard are numbered in this many parts.
SLOT_PARTS = 256


@dataclass(frozen=True)
class Cell:
    """Groups whose order has the same leading bits: [low, high) in the order, their bytes, and whether it is one group."""
    low: int
    bits: int
    size: int
    single: bool


def group_order(text: Column) -> Column:
    """Place of a text in the line of groups; a null text is a group of its own beside the empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _cells(groups: DataFrame, bits: int, within: list[Cell] | None) -> list[Cell]:
    part = F.shiftright(F.col("_order"), 64 - bits)
    df = groups.withColumn("_part", part)
    if within is not None:
        parent = F.shiftright(F.col("_order"), 64 - within[0].bits)
        df = df.where(parent.isin([c.low >> (64 - c.bits) for c in within]))
    rows = df.groupBy("_part").agg(F.sum("_size").alias("s"), F.min("_order").alias("a"), F.max("_order").alias("b")).collect()
    return [Cell(r["_part"] << (64 - bits), bits, int(r["s"]), r["a"] == r["b"]) for r in rows]


def greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Indexes after which greedy filling cuts, or None if the capacity is too small; ``ends`` are running sums."""
    cuts, base, at = [], 0, 0
    while at < len(ends):
        if len(cuts) == shards:
            return None
        nxt = bisect_right(ends, base + capacity)
        if nxt == at:
            return None
        cuts.append(nxt)
        base, at = ends[nxt - 1], nxt
    return cuts


def minimax(sizes: list[int], shards: int, low: int = 0) -> tuple[int, list[int]]:
    """Smallest capacity, not below ``low``, with which the sizes fit into contiguous shards, and the cuts."""
    ends = list(accumulate(sizes))
    if not ends:
        return low, []
    low = max(low, max(sizes), -(-ends[-1] // shards))
    high = max(low, ends[-1])
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy(ends, low, shards)


def even_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Indexes after which shards end that are near the mean of what is left, never above ``capacity``, which must be feasible.

    Groups above the mean have a shard of their own and do not count in it. A
    shard ends where its sum comes nearest to the mean, unless the rest would then
    need more shards than are left.
    """
    def mean(rest: list[int], parts: int) -> float:
        while True:
            total = sum(rest)
            small = [x for x in rest if x * parts <= total]
            large = len(rest) - len(small)
            if not large or large >= parts or not small:
                return total / parts
            rest, parts = small, parts - large

    ends = list(accumulate(sizes))
    needed = [0] * (len(sizes) + 1)  # shards of that capacity that the groups from k on need
    for k in range(len(sizes) - 1, -1, -1):
        needed[k] = 1 + needed[bisect_right(ends, (ends[k - 1] if k else 0) + capacity)]
    cuts, at, base = [], 0, 0
    for left in range(shards, 0, -1):
        if at == len(sizes):
            break
        last = bisect_right(ends, base + capacity)
        want = base + mean(sizes[at:], left)
        end = min(max(bisect_right(ends, want), at + 1), last)
        if end < last and abs(ends[end] - want) < abs(want - ends[end - 1]):
            end += 1
        while needed[end] > left - 1:
            end += 1
        cuts.append(end)
        at, base = end, ends[end - 1]
    return cuts


def _reachable(cells: list[Cell], shards: int, low: int, high: int) -> list[Cell]:
    """Cells of several groups in which greedy filling could cut for some capacity from ``low`` to ``high``."""
    ends = list(accumulate(c.size for c in cells))
    open_cells: dict[int, Cell] = {}
    first, last = 0, 0
    for _ in range(shards):
        # at the earliest a cut stands at the start of the cell that the smallest capacity reaches, at the latest where the largest ends
        first_cell, last_cell = bisect_right(ends, first + low), bisect_right(ends, last + high)
        for k in range(first_cell, min(last_cell, len(cells) - 1) + 1):
            if not cells[k].single:
                open_cells[k] = cells[k]
        first = ends[first_cell - 1] if first_cell else 0
        last = min(ends[-1], last + high)
        if first_cell >= len(cells):
            break
    return list(open_cells.values())


def plan(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Exact smallest capacity and the orders at which shards 1, 2, ... begin, from groups (_order, _size)."""
    most = groups.agg(F.max("_size")).first()[0]
    if most is None:
        return 0, []
    cells = _cells(groups, FIRST_BITS, None)
    while True:
        cells.sort(key=lambda c: c.low)
        total = sum(c.size for c in cells)
        low = max(int(most), -(-total // shards))
        high, cuts = minimax([c.size for c in cells], shards, low)
        looked = _reachable(cells, shards, low, high)
        if not looked or high == low:
            break
        keep = set(looked)
        cells = [c for c in cells if c not in keep]
        for bits in sorted({c.bits for c in looked}):
            cells += _cells(groups, min(64, bits + MORE_BITS), [c for c in looked if c.bits == bits])
    cuts = even_cuts([c.size for c in cells], shards, high)
    return high, [cells[k].low for k in cuts[:-1]]


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law
    ('bytes'), shard, slot (0, 1, ... in its shard) and grown_shard (null, since
    shards change when their number does). Equal texts share a shard, so a text
    with a third of all bytes makes a shard of at least that size, which no
    order can avoid. Null and empty texts have size 1 and are two groups.
    Repeated rows and null doc_ids are rows like others; other columns are
    ignored; an empty table gives no rows. Cuts stand near the mean of what is
    left, so that the shards beside that of a large text share the rest evenly; a
    shard stays empty only if there are fewer groups than shards.

    Group sizes are summed map-side before their one shuffle. Slots are numbered
    in parts of a shard, with the parts' counts added up in a small window, so a
    hot text or shard is no single task.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("text_crc32"), group_order(text).alias("_order"))
    rows = cut_lineage(rows)
    groups = cut_lineage(rows.groupBy("_order").agg(F.sum("size").alias("_size")))
    _, begins = plan(groups, shards)
    number = F.lit(0)
    for b in begins:
        number = number + (F.col("_order") >= F.lit(b)).cast("int")
    rows = (rows.withColumn("shard", number)
            .withColumn("_part", F.pmod(F.xxhash64("doc_id", "_order"), F.lit(SLOT_PARTS)).cast("int")))
    count = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_part").orderBy("doc_id", "_order")
    return (rows.withColumn("_k", F.row_number().over(inside))
            .join(count, (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_base") + F.col("_k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
