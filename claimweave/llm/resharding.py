"""Resharding by minimum-cost flow: the fewest bytes move, then the affected files are rewritten.

The old layout is a shard of each row. Inside its shard a row has a position (a 63-bit hash of its
key and text), and the leading bits of positions cut each shard into BLOCKS blocks whose sizes Spark
sums: at most ``old shards * BLOCKS`` numbers reach the driver, however many rows there are. A
minimum-cost flow from old sizes to new capacities (staying is free, moving costs one per byte, or as
a given cost matrix says) tells how many bytes go from where to where. The flows out of a shard are
laid along its positions: whole blocks by their sums, and in the one block in which a flow ends the
rows up to a cutoff, which one more pass over those blocks finds. What rounding to whole rows leaves
is evened out on a sample of about EVEN_ROWS rows a shard, again with few bytes. A plan is a few
hundred intervals of positions and the moved rows of that sample, so applying it needs no shuffle.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import text_or_empty, work_table

BLOCK_BITS = 8
BLOCKS = 1 << BLOCK_BITS
#: Rows a shard, on average, among which rounding is evened out.
EVEN_ROWS = 256
#: Bytes of a row besides its text.
ROW_BYTES = 16
#: Text bytes aimed at in a rewritten file.
FILE_BYTES = 64 << 20


@dataclass
class Plan:
    """Where rows go: intervals ``(old shard, last position, new shard)`` in order, and single rows."""

    new_shards: int
    intervals: list[tuple[int, int, int]]
    rows: list[tuple[int, int, int]] = field(default_factory=list)
    flows: dict[tuple[int, int], int] = field(default_factory=dict)

    @property
    def moved_bytes(self) -> int:
        return sum(n for (i, j), n in self.flows.items() if i != j)

    @property
    def affected(self) -> set[int]:
        """Shards that gain or lose rows; the files of all others can stay as they are."""
        touched = {s for (i, j), n in self.flows.items() if i != j and n for s in (i, j)}
        touched |= {s for old, _, new in self.intervals if old != new for s in (old, new)}
        return touched | {s for old, _, new in self.rows for s in (old, new)}


def row_size(text: str | Column = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus ROW_BYTES."""
    return (F.octet_length(text_or_empty(text)) + ROW_BYTES).cast("long")


def row_position() -> Column:
    """63-bit position of a row in its shard; rows equal in doc_id and text share one."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("position"), "doc_id", "text"), 1)


def hash_layout(shards: int) -> Column:
    """The usual old layout: a hash of doc_id modulo the number of shards (null: like any value)."""
    return F.pmod(F.xxhash64(F.lit("layout"), "doc_id"), F.lit(shards)).cast("int")


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> dict[tuple[int, int], int]:
    """Flows ``{(i, j): amount}`` that ship all supply within the capacities at the least cost.

    Successive shortest augmenting paths (Dijkstra with potentials) over the bipartite graph, which
    has as many arcs as there are pairs of shards.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold all bytes")
    left, room = list(supply), list(capacity)
    flow = np.zeros((n, m), dtype=object)
    potential = [0.0] * (n + m)
    for source in range(n):
        while left[source]:
            dist = [float("inf")] * (n + m)
            before = [-1] * (n + m)
            dist[source], heap = 0.0, [(0.0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                if u < n:
                    arcs = ((n + j, cost[u, j]) for j in range(m))
                else:
                    arcs = ((i, -cost[i, u - n]) for i in range(n) if flow[i, u - n])
                for v, c in arcs:
                    nd = d + c + potential[u] - potential[v]
                    if nd < dist[v] - 1e-12:
                        dist[v], before[v] = nd, u
                        heapq.heappush(heap, (nd, v))
            sink = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j] + potential[n + j])
            potential = [p + min(d, dist[n + sink]) for p, d in zip(potential, dist)]
            path, v = [], n + sink
            while v != source:
                path.append((before[v], v))
                v = before[v]
            push = min([left[source], room[sink], *(flow[v, u - n] for u, v in path if u >= n)])
            for u, v in path:
                if u < n:
                    flow[u, v - n] += push
                else:
                    flow[v, u - n] -= push
            left[source] -= push
            room[sink] -= push
    return {(i, j): int(flow[i, j]) for i in range(n) for j in range(m) if flow[i, j]}


def even_out(sizes: np.ndarray, pools: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Moves ``(row number, from, to)`` of pool rows ``(row number, size)`` that narrow the sizes.

    Step by step the fullest shard gives one row to the emptiest, or swaps one for a smaller one,
    whichever halves their difference best; it ends where no step helps. Each step lowers the sum of
    squared sizes, so it does end.
    """
    sizes, pools, out = sizes.astype(np.int64).copy(), [list(p) for p in pools], {}
    while True:
        a, b = int(np.argmax(sizes)), int(np.argmin(sizes))
        gap = int(sizes[a] - sizes[b])
        if gap < 2 or not pools[a]:
            break
        give = np.array([s for _, s in pools[a]], dtype=np.int64)
        get = np.array(sorted([0, *(s for _, s in pools[b])]), dtype=np.int64)
        at = np.clip(np.searchsorted(get, give - gap / 2), 0, len(get) - 1)
        options = [(abs(int(give[i] - get[k]) - gap / 2), i, int(get[k])) for i in range(len(give)) for k in {at[i], max(0, at[i] - 1)}]
        off, i, back = min(options)
        change = int(give[i]) - back
        if not 0 < change < gap:
            break
        moved = pools[a].pop(i)
        pools[b].append(moved)
        out[moved[0]] = b
        if back:
            k = next(k for k, (row, s) in enumerate(pools[b]) if s == back and row != moved[0])
            returned = pools[b].pop(k)
            pools[a].append(returned)
            out[returned[0]] = a
        sizes[a] -= change
        sizes[b] += change
    return sorted(out.items())


def _destinations(plan: Plan) -> Column:
    """Shard of a row with ``old_shard`` and ``position`` by the plan's intervals and single rows."""
    by_old: dict[int, list[tuple[int, int]]] = {}
    for old, last, new in plan.intervals:
        by_old.setdefault(old, []).append((last, new))
    pairs = [x for old, steps in by_old.items() for x in (F.lit(old), F.array(*(F.struct(F.lit(last).cast("long").alias("last"), F.lit(new).alias("shard")) for last, new in steps)))]
    if not pairs:
        return F.col("old_shard")
    steps = F.element_at(F.create_map(*pairs), F.col("old_shard"))
    return F.get(F.filter(steps, lambda x: F.col("position") <= x["last"]), 0)["shard"]


def apply_plan(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``shard`` to rows with ``old_shard`` and ``position``, without a shuffle."""
    placed = rows.withColumn("shard", _destinations(plan))
    if not plan.rows:
        return placed
    single = rows.sparkSession.createDataFrame(plan.rows, "s_old int, s_position long, s_shard int")
    # about EVEN_ROWS rows a shard at most: see solve()
    joined = placed.join(F.broadcast(single), (F.col("position") == F.col("s_position")) & (F.col("old_shard") == F.col("s_old")), "left")
    return joined.withColumn("shard", F.coalesce("s_shard", "shard")).drop("s_old", "s_position", "s_shard")


def solve(rows: DataFrame, old_shards: int, new_shards: int, cost: np.ndarray | None = None) -> Plan:
    """The plan for rows ``(old_shard, position, size)``: near equal bytes, the fewest of them moved."""
    block = F.shiftright("position", 63 - BLOCK_BITS).cast("int")
    sums = np.zeros((old_shards, BLOCKS), dtype=np.int64)
    n_rows = 0
    for r in rows.groupBy("old_shard", block.alias("block")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():  # old_shards * BLOCKS rows at most
        sums[r.old_shard, r.block] = r.bytes
        n_rows += r.n
    supply = sums.sum(axis=1).tolist()
    total = sum(supply)
    capacity = [total // new_shards + (j < total % new_shards) for j in range(new_shards)]
    if cost is None:
        cost = np.ones((old_shards, new_shards)) - np.eye(old_shards, new_shards)
    flows = min_cost_flow(supply, capacity, cost)
    everything = (1 << 63) - 1
    ends: list[tuple[int, int, int, int]] = []  # (old, rank, block, bytes of the block before the cut)
    order: dict[int, list[int]] = {}
    for i in range(old_shards):
        targets = sorted((j for a, j in flows if a == i), key=lambda j: (j != i, j))
        order[i] = targets or [i if i < new_shards else 0]
        cum, at = np.cumsum(sums[i]), 0
        for rank, j in enumerate(targets[:-1]):
            at += flows[i, j]
            b = int(np.searchsorted(cum, at))
            ends.append((i, rank, b, at - int(cum[b] - sums[i, b])))
    cutoffs: dict[tuple[int, int], int] = {}
    if ends:
        asked = rows.sparkSession.createDataFrame(ends, "old_shard int, rank int, block int, want long")
        inside = rows.withColumn("block", block).join(F.broadcast(asked.select("old_shard", "block").distinct()), ["old_shard", "block"])
        # rows of one position share its sum, so that a cutoff takes all of them or none
        summed = inside.groupBy("old_shard", "block", "position").agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("old_shard", "block").orderBy("position"))
        halfway = summed.select("old_shard", "block", "position", (run - F.col("size") / 2).alias("mid"))
        found = halfway.join(F.broadcast(asked), ["old_shard", "block"]).filter("mid <= want").groupBy("old_shard", "rank").agg(F.max("position").alias("last"))
        cutoffs = {(r.old_shard, r.rank): r["last"] for r in found.collect()}  # a row for each flow at most
    intervals = []
    for i, targets in order.items():
        starts = {(i, rank): (b << (63 - BLOCK_BITS)) - 1 for o, rank, b, _ in ends if o == i}
        for rank, j in enumerate(targets):
            intervals.append((i, cutoffs.get((i, rank), starts.get((i, rank))) if rank < len(targets) - 1 else everything, j))
    plan = Plan(new_shards, intervals, flows=flows)
    placed = apply_plan(rows, plan)
    sizes = np.zeros(new_shards, dtype=np.int64)
    for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():
        sizes[r.shard] = r.bytes
    every = max(1, n_rows // (new_shards * EVEN_ROWS))
    pool = placed.groupBy("shard", "old_shard", "position").agg(F.sum("size").alias("size")).filter(F.pmod(F.xxhash64("position"), F.lit(every)) == 0).orderBy("position", "old_shard").collect()
    pools: list[list[tuple[int, int]]] = [[] for _ in range(new_shards)]
    for k, r in enumerate(pool):
        pools[r.shard].append((k, r.size))
    plan.rows = [(pool[k].old_shard, pool[k].position, to) for k, to in even_out(sizes, pools) if pool[k].shard != to]
    return plan


def _slotted(docs: DataFrame, plan: Plan, old_shard: Column, shards: list[int]) -> DataFrame:
    """The rows of ``shards`` with ``old_shard``, ``slot`` and ``shard``.

    A shard is cut into ranges of about FILE_BYTES bytes by position, which are numbered one by one;
    the ranges' row counts give each its first slot.
    """
    keyed = docs.withColumn("old_shard", old_shard).withColumn("position", row_position())
    placed = apply_plan(keyed, plan)
    if len(shards) < plan.new_shards:
        placed = placed.filter(F.col("shard").isin(shards))
    held = sum(plan.flows.values())
    ranges = max(1, -(-held // (plan.new_shards * FILE_BYTES)))
    ranged = placed.withColumn("range_no", F.least(F.floor(F.col("position") / F.lit(float(1 << 63)) * ranges), F.lit(ranges - 1)).cast("int"))
    counts = ranged.groupBy("shard", "range_no").agg(F.count(F.lit(1)).alias("n"))
    firsts = work_table(counts.withColumn("first_slot", F.sum("n").over(Window.partitionBy("shard").orderBy("range_no")) - F.col("n")).select("shard", "range_no", "first_slot"), "slots")
    numbered = ranged.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "range_no").orderBy("position", "doc_id")))
    # a row for each file at most, that is for each FILE_BYTES of input
    slotted = numbered.join(firsts.hint("shuffle_merge") if ranges > 64 else F.broadcast(firsts), ["shard", "range_no"]).withColumn("slot", F.col("first_slot") + F.col("nth") - 1)
    return slotted.select(*docs.columns, "old_shard", "slot", "shard")


def rewrite(docs: DataFrame, plan: Plan, old_shard: Column, path: str) -> DataFrame:
    """Write the affected shards' rows below ``path`` as ``shard=N`` and read them back.

    The files hold the columns of ``docs``, ``old_shard`` and ``slot``: the row's place in its shard,
    without gaps. All other shards' files stay as they are; :func:`reshard` returns their rows too.
    """
    out = _slotted(docs, plan, old_shard, sorted(plan.affected))
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def reshard(docs: DataFrame, path: str, old_shards: int, new_shards: int, cost: np.ndarray | None = None) -> DataFrame:
    """Grow or shrink a layout of ``old_shards`` (by :func:`hash_layout`) to ``new_shards``, by bytes.

    Returns all rows: those of affected shards from the rewritten files, those of the others from
    ``docs``, where they stay. Null texts have no bytes, null doc_ids lie in one shard; rows equal in
    doc_id and text stay together; an empty table gives an empty result.
    """
    rows = work_table(docs.select(hash_layout(old_shards).alias("old_shard"), row_position().alias("position"), row_size().alias("size")), "rows")
    plan = solve(rows, old_shards, new_shards, cost)
    stay = sorted(set(range(new_shards)) - plan.affected)
    if not plan.affected:
        return _slotted(docs, plan, hash_layout(old_shards), stay)
    moved = rewrite(docs, plan, hash_layout(old_shards), path)
    return moved.unionByName(_slotted(docs, plan, hash_layout(old_shards), stay)) if stay and rows.filter(~_in_affected(plan)).limit(1).count() else moved


def _in_affected(plan: Plan) -> Column:
    """Whether a row of an old layout lies in a shard that the plan touches."""
    return F.col("old_shard").isin(sorted(plan.affected))
