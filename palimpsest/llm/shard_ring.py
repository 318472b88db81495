"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns `virtual_nodes` arcs of the ring. A text's hash puts it in an arc; the arc's shard takes it
while the shard has room, and what a full shard cannot take continues clockwise to the next virtual node.
Room is counted in rows. With slack 0 the shards' room sums to the number of rows, so counts are at most
one apart (law `rows`); with slack a the room is ceil((1 + a) n / shards), which moves fewer rows.

The ring is walked over counts by arc alone: shards x virtual_nodes numbers, however many rows there are.
The walk gives each arc a few ranges of ranks, and each range a shard and its first slot. The rank of a row
in its arc comes from a window over cells of about `cell_rows` rows: an arc is cut by further bits of the
text's hash, and a cell that stays large, as many copies of one text make it, by a hash of the key. So
neither a hot text nor the size of the table reaches one task.

Equal texts lie side by side on the ring, and part only where a cell or a shard ends. A null text is empty and of size 1;
a null key is a key as any other. Repeated rows get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import join_sized
from palimpsest.session import durable

POSITION_BITS = 16


def ring(shards: int, virtual_nodes: int, seed: int) -> list[tuple[int, int]]:
    """(position, shard), clockwise; positions in [0, 2^POSITION_BITS). A shard's nodes don't depend on how many shards there are."""
    nodes = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            z = ((shard << 32) + node + (seed << 16) + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
            for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                z = ((z ^ (z >> by)) * times) & ((1 << 64) - 1)
            nodes.append((z >> (64 - POSITION_BITS), shard))
    return sorted(nodes)


def arcs(nodes: list[tuple[int, int]]) -> list[int]:
    """For each position, the first node at or after it; beyond the last node comes the first."""
    out, node = [], 0
    for position in range(1 << POSITION_BITS):
        while node < len(nodes) and nodes[node][0] < position:
            node += 1
        out.append(node % len(nodes))
    return out


def rooms(n: int, shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [-(-int(n * (1 + slack) * 1000) // (1000 * shards)) + 1] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): hop by hop, what is left of each arc asks the next node."""
    left, taken, free, used, out = list(counts), [0] * len(counts), list(room), [0] * len(room), []
    for hop in range(len(owners)):
        if not any(left):
            break
        for arc, rest in enumerate(left):
            shard = owners[(arc + hop) % len(owners)]
            take = min(rest, free[shard])
            if take:
                out.append((arc, taken[arc], taken[arc] + take, shard, used[shard]))
                taken[arc] += take
                used[shard] += take
                free[shard] -= take
                left[arc] -= take
    return out


def shard_ring(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", virtual_nodes: int = 64, slack: float = 0.0, cell_rows: int = 512, seed: int = 0) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: one row a document. law is null where slack lets counts part."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("__key"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(body, F.lit(seed)).alias("__hash"))
    keyed = durable(keyed, "ring-keys")
    n = keyed.count()
    nodes = ring(shards, virtual_nodes, seed)
    owner = [s for _, s in nodes]
    arc_of = F.split(F.lit(",".join(map(str, arcs(nodes)))), ",")
    fine = 1 << max(0, (n // (len(nodes) * cell_rows)).bit_length())
    rows = keyed.withColumn("__arc", F.element_at(arc_of, F.shiftrightunsigned("__hash", 64 - POSITION_BITS).cast("int") + 1).cast("int"))
    rows = rows.withColumn("__fine", F.pmod(F.col("__hash"), F.lit(fine)))

    hot = rows.groupBy("__arc", "__fine").count().filter(F.col("count") > cell_rows)
    hot = durable(hot.select("__arc", "__fine", F.ceil(F.col("count") / cell_rows).alias("__salts")), "ring-hot")
    rows = join_sized(rows, hot, ["__arc", "__fine"], "left")
    rows = rows.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("__key", "__hash"), F.col("__salts")), F.lit(0)))

    cell = ["__arc", "__fine", "__salt"]
    before = Window.partitionBy("__arc").orderBy("__fine", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = durable(rows.groupBy(*cell).count(), "ring-cells")
    offsets = cells.select(*cell, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    held = {r[0]: r[1] for r in cells.groupBy("__arc").agg(F.sum("count")).collect()}  # one number an arc
    ranges = walk([held.get(a, 0) for a in range(len(nodes))], owner, rooms(n, shards, slack))
    plan = spark.createDataFrame(ranges, "__arc int, __low long, __high long, shard int, __first long")

    order = Window.partitionBy(*cell).orderBy("__hash", "__key", "size")
    ranked = rows.withColumn("__in_cell", F.row_number().over(order) - 1)
    ranked = join_sized(ranked, offsets, cell).withColumn("__rank", F.col("__before") + F.col("__in_cell"))
    placed = ranked.join(F.broadcast(plan), "__arc").filter((F.col("__rank") >= F.col("__low")) & (F.col("__rank") < F.col("__high")))
    law = F.lit("rows") if slack == 0 else F.lit(None).cast("string")
    slot = F.col("__first") + F.col("__rank") - F.col("__low")
    return placed.select(F.col("__key").alias(key), "size", "text_crc32", law.alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
