"""Byte-balanced shards by Karmarkar-Karp differencing.

Equal texts form an indivisible group whose weight is the bytes of its rows.  A
*partial partition* is a tuple of shard loads, of which the two with the largest
spread (largest less smallest load) are combined again and again: the heaviest shard
of one with the lightest of the other.

Scale: rows are folded to groups first, by partial aggregation.  Groups are hashed
into cells, and each cell is differenced in its own task down to one partial
partition of as many loads as there are shards.  Only these tuples come to the
driver, a few numbers for each cell, where differencing goes on over the cells.  Groups
that outweigh what a shard gets from a cell, fewer than the cells have loads, are
differenced on the driver first; their loads, scaled to a cell, are then one more
partial partition of each.  One cell is kept back and differenced last, together with
the loads of all that is placed, so residuals of the cells don't add up.

A group of copies that outweighs a shard's whole share can't be balanced as it is: the
law of near-equal bytes comes first, and such a group, however many rows it has, is cut
into pieces of whole rows before; there are fewer such groups than shards.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, documents, hot_keys, materialize, salted_join

SHARDS = 24
#: Bytes that each row takes besides its text.
OVERHEAD = 8
#: Groups that one task differences, and the number of cells up to which that is kept.
CELL_GROUPS, MOST_CELLS, LARGE_CELL = 16_384, 512, 1 << 20
#: Pieces for each share that a group too heavy for one shard is cut into.
PIECES = 4
#: Rows up to which the cells' names are broadcast.
NAMES = 1_000_000
#: Rows that one task numbers within a shard.
NUMBERED = 50_000


def difference(items: list[tuple[list[int], list[int]]], shards: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions (loads, tags): the tags of each shard.

    ``tags[i]`` names load i; an item has at most ``shards`` loads.  The answer has
    for each shard the numbers of the tags that fell to it, heaviest shard first.
    """
    parent: list[tuple[int, ...]] = []
    heap = []
    for n, (loads, tags) in enumerate(items):
        pairs = sorted(zip(loads, tags), key=lambda p: (-p[0], p[1]))
        pairs = [(load, ~tag) for load, tag in pairs]
        least = pairs[-1][0] if len(pairs) == shards else 0
        heap.append((-(pairs[0][0] - least) if pairs else 0, n, pairs))
    heapq.heapify(heap)
    n = len(items)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - shards
        if over <= 0:
            both = a + b
        else:
            both = []
            wide = a + [(0, None)] * (shards - len(a))
            turned = [(0, None)] * (shards - len(b)) + b[::-1]
            for (x, i), (y, j) in zip(wide, turned):
                if i is None or j is None:
                    node = i if j is None else j
                else:
                    parent.append((i, j))
                    node = len(parent) - 1
                both.append((x + y, node))
        both.sort(key=lambda p: -p[0])
        least = both[-1][0] if len(both) == shards else 0
        heapq.heappush(heap, (-(both[0][0] - least), n, both))
        n += 1
    out = []
    for _, node in heap[0][2] if heap else []:
        todo, tags = [node], []
        while todo:
            k = todo.pop()
            if k < 0:
                tags.append(~k)
            else:
                todo.extend(parent[k])
        out.append(tags)
    return out + [[] for _ in range(shards - len(out))]


def _cells(groups: int) -> int:
    return max(1, min(-(-groups // CELL_GROUPS), max(MOST_CELLS, -(-groups // LARGE_CELL))))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD, cells: int | None = None, numbered: int = NUMBERED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; law: near-equal bytes.

    size is the text's UTF-8 bytes (null: none) plus ``overhead``; text_crc32 that of
    the UTF-8 text (null: of no bytes).  Null and empty texts are one group.  Rows
    that repeat count each.  Equal texts share a shard, unless they outweigh a
    shard's share; then their rows are spread over several.  A row is never cut: one
    that outweighs a share makes its shard larger than the others.  Slots count from
    0 without gaps in each shard.  An empty table gives an empty table.
    """
    src = documents(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    key = ["h", "text_crc32", "size"]
    full = [*key, "piece"]
    # once written, a row's number tells also repeated rows apart
    rows = src.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    kept = [rows := materialize(rows, "shard-rows")]
    rowid = F.xxhash64("row")
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    kept.append(groups := materialize(groups, "shard-groups"))
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    share = total // shards + 1
    # fewer groups than shards can outweigh a shard's share
    heavy = groups.where((F.col("bytes") > share) & (F.col("n") > 1)).select(*key, F.ceil(F.col("bytes") * PIECES / share).cast("int").alias("pieces"))
    if not heavy.isEmpty():
        pieced = rows.join(F.broadcast(heavy), key, "left")
        rows = pieced.withColumn("piece", F.when(F.col("pieces").isNotNull(), F.pmod(rowid, F.col("pieces")).cast("int")).otherwise(0)).drop("pieces")
        groups = rows.groupBy(*full).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        kept.append(groups := materialize(groups, "shard-pieces"))
    else:
        rows = rows.withColumn("piece", F.lit(0))
        groups = groups.withColumn("piece", F.lit(0))
    placed = _place(groups.select(*full, "bytes"), full, total, cells or _cells(n_groups), shards)
    hot = hot_keys(groups, full, "n", n_rows)
    out = salted_join(rows, placed, full, rowid, "inner", hot=hot, measured=True)
    out = materialize(out.select("doc_id", "size", "text_crc32", "row", "shard"), "shard-placed")
    for table in kept:
        discard(table)
    return _slots(out, n_rows, shards, numbered)


def _place(groups: DataFrame, full: list[str], total: int, n_cells: int, shards: int) -> DataFrame:
    """(full, shard) for each group of (full, bytes)."""
    spark = groups.sparkSession
    groups = groups.withColumn("cell", F.pmod(F.xxhash64(*full), F.lit(n_cells)).cast("int"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.select(*full).schema)

    def differenced(part: DataFrame, loads: list[int], whole: int) -> DataFrame:
        """(full, bytes, cell, local): each cell's groups; ``loads`` are scaled to a cell by its share of ``whole``."""

        def within(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in full])
            weights = table.column("bytes").to_pylist()
            items = [([w], [i]) for i, w in enumerate(weights)]
            if loads:
                own = sum(weights) if whole else 1
                items.append(([load * own // max(1, whole) for load in loads], [len(weights) + s for s in range(shards)]))
            local = [0] * len(weights)
            for s, tags in enumerate(difference(items, shards)):
                at = next((t - len(weights) for t in tags if t >= len(weights)), s)
                for i in tags:
                    if i < len(weights):
                        local[i] = at
            return table.append_column("local", pa.array(local, pa.int32()))

        return part.groupBy("cell").applyInArrow(within, f"{fields}, bytes long, cell int, local int")

    if n_cells == 1:
        return materialize(differenced(groups, [], 0).select(*full, F.col("local").alias("shard")), "shard-groups-placed")
    # fewer than n_cells * shards groups can outweigh what a shard gets from a cell
    limit = total // (n_cells * shards) + 1
    above = [(*(r[c] for c in full), r.bytes) for r in groups.where(F.col("bytes") > limit).orderBy(*full).collect()]
    first = difference([([r[-1]], [i]) for i, r in enumerate(above)], shards) if above else []
    loads = [sum(above[i][-1] for i in tags) for tags in first]
    light = groups.where(F.col("bytes") <= limit)
    placed = materialize(differenced(light.where("cell > 0"), loads, total - sum(loads)), "shard-groups-cells")
    if above:
        fixed = [(*above[i][:-1], s) for s, tags in enumerate(first) for i in tags]
        named = placed.select(*full, F.col("local").alias("shard"), "bytes")
        for r in named.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
            loads[r.shard] += r.bytes
        named = named.drop("bytes").unionByName(spark.createDataFrame(fixed, f"{fields}, shard int"))
    else:
        sums = placed.groupBy("cell", "local").agg(F.sum("bytes").alias("bytes")).orderBy("cell", "local").collect()
        tuples: dict[int, tuple[list[int], list[int]]] = {}
        for tag, r in enumerate(sums):
            item = tuples.setdefault(r.cell, ([], []))
            item[0].append(r.bytes)
            item[1].append(tag)
        met = difference(list(tuples.values()), shards)
        loads = [sum(sums[tag].bytes for tag in tags) for tags in met]
        names = spark.createDataFrame([(sums[tag].cell, sums[tag].local, s) for s, tags in enumerate(met) for tag in tags], "cell int, local int, shard int")
        # a row for each cell and shard
        named = placed.join(F.broadcast(names) if n_cells * shards <= NAMES else names, ["cell", "local"]).select(*full, "shard")
    last = differenced(light.where("cell = 0"), loads, 0).select(*full, F.col("local").alias("shard"))
    out = materialize(named.unionByName(last), "shard-groups-placed")
    discard(placed)
    return out


def _slots(rows: DataFrame, n: int, shards: int, numbered: int) -> DataFrame:
    """Number each shard's rows from 0: bounded parts of a shard, and each part's offset."""
    parts = max(1, -(-n // (shards * numbered)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c")).select("shard", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "row")
    rows = rows.withColumn("at", F.row_number().over(own) - 1)
    return rows.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))
