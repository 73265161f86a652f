"""Even shards that keep linked documents together: label propagation under quotas.

Documents are linked to a hub (here: their text), so a group of n documents has n links, not n * n.
Every round the hubs count their documents per shard and propose to each document the shard with most of its
group. The driver works out from one row per pair of shards how many may move: documents that change places along a cycle of
shards, and those for whom there is room. Rounds for any shard alternate with rounds for shards with room only, so
that a group larger than a shard fills one after another. Documents without links stay where they are and are the ballast: they give way at
the end, when shards above their quota hand surplus rows to those below, so that row counts differ by one at most.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved

SHARDS = 40
ROUNDS = 200  # rounds end when they have settled; more than these fail
SETTLED = 0.001  # after two rounds in a row that move a smaller share of the linked rows it is over
CHUNK = 20_000  # rows ranked in one sort, about
TOGETHER = 1_000  # rows of a group that are ranked next to one another at most


def granted(wishes: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many rows may move from shard i to shard j: what goes round in cycles, also through free places.

    Shortest cycles first. An extra node stands for free places: as many rows go into it as a shard has room, and rows come from it
    to any shard, as those that leave a shard need no successor.
    """
    n = len(wishes)
    left = [[*row, max(0, free)] for row, free in zip(wishes, room)] + [[1 << 62] * n + [0]]
    out = [[0] * n for _ in range(n)]
    for start in range(n):
        while True:
            before, queue = {}, deque([start])
            while queue and start not in before:
                i = queue.popleft()
                for j in range(n + 1):
                    if left[i][j] and j not in before and (i, j) != (n, start):
                        before[j] = i
                        queue.append(j)
            if start not in before:
                break
            steps, j = [], start
            while not steps or j != start:
                steps.append((before[j], j))
                j = before[j]
            size = min(left[i][j] for i, j in steps)
            for i, j in steps:
                left[i][j] -= size
                if i < n and j < n:
                    out[i][j] += size
    return out


def propagate(rows: DataFrame, shards: int, rounds: int, quota: int) -> DataFrame:
    """Move linked ``rows`` (hub, key, shard, any others) between shards until rounds have next to nothing to move; ``key`` is a hash of the row."""
    of_pair = lambda table: F.element_at(F.array(*[F.lit(v) for row in table for v in row]), F.col("shard") * shards + F.col("best") + 1)
    still = 0
    for turn in range(rounds):
        votes = saved(rows.groupBy("hub", "shard").agg(F.count("*").alias("n")))
        load = {r["shard"]: r["n"] for r in votes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
        if not load:
            return rows
        room = [max(0, quota - load.get(j, 0)) for j in range(shards)]
        open_votes = votes.filter(F.element_at(F.array(*[F.lit(free > 0) for free in room]), F.col("shard") + 1)) if turn % 2 else votes
        # most documents first; ties by a hash, so that groups of one document per shard do not all meet in shard 0, and another one
        # each round, so that a document without a successor may be the one to stay
        tie = lambda shard: F.xxhash64("hub", shard, F.lit(turn))
        order = F.struct("n", tie("shard"), "shard")
        choice = open_votes.groupBy("hub").agg(F.max(order).alias("best")).select("hub", F.col("best.n").alias("best_n"), F.col("best.shard").alias("best"))
        plan = saved(votes.join(choice, "hub").filter((F.col("best") != F.col("shard")) & (
            (F.col("best_n") > F.col("n")) | ((F.col("best_n") == F.col("n")) & (tie("best") > tie("shard"))))))
        wishes = [[0] * shards for _ in range(shards)]
        for r in plan.groupBy("shard", "best").agg(F.sum("n").alias("n")).collect():  # a row per pair of shards
            wishes[r["shard"]][r["best"]] = r["n"]
        quotas = granted(wishes, room)
        moving = sum(map(sum, quotas))
        still = still + 1 if moving <= SETTLED * sum(load.values()) else 0
        if still == 2:
            return rows
        if not moving:
            continue
        draw = F.shiftrightunsigned(F.xxhash64("key", F.lit(turn)), 11) / float(1 << 53)  # anew each round, also of those that stayed
        asked = rows.join(plan.select("hub", "shard", "best"), ["hub", "shard"], "left").withColumn("draw", draw)
        # between two shards with few wishes exactly so many rows go; of many a share of them by their draws
        few = F.col("best").isNotNull() & (of_pair(wishes) <= CHUNK)
        place = F.row_number().over(Window.partitionBy("shard", "best").orderBy("draw", "key"))
        some = asked.filter(few).withColumn("go", place <= of_pair(quotas))
        share = of_pair([[q / w if w else 0.0 for q, w in zip(*pair)] for pair in zip(quotas, wishes)])
        many = asked.filter(~few).withColumn("go", F.coalesce(F.col("draw") < share, F.lit(False)))
        moved = some.unionByName(many).withColumn("shard", F.when(F.col("go"), F.col("best")).otherwise(F.col("shard")))
        rows = saved(moved.select(*rows.columns))
    raise RuntimeError(f"shards have not settled after {rounds} rounds")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text).

    Row counts of shards differ by one at most, the first shards having one more; slots count from 0 in each
    shard. ``size`` is the UTF-8 length plus 16. Equal texts are linked; null texts count as
    empty and, like empty ones, are linked with one another. A group larger than a shard fills several. Repeated rows
    each get a slot of their own; null doc_ids are like any other. Other columns are ignored; no rows give no rows.
    Fails where the rounds have not settled after ``rounds``. Only linked rows are written anew in a round.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("hub"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "hub", F.monotonically_increasing_id()))  # repeated rows go their own ways
    groups = rows.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1").select("hub", "n", F.lit(True).alias("linked"))
    start = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).cast("int")
    # the order in a shard: small groups stand together, so that what a full shard hands over is whole groups; rows of others by themselves
    unit = F.shiftrightunsigned(F.when(F.col("n") <= TOGETHER, F.xxhash64("hub")).otherwise(F.col("key")), 11) / float(1 << 53)
    rows = saved(rows.withColumn("shard", start).join(groups, "hub", "left").withColumn("unit", unit)
                 .select("doc_id", "size", "text_crc32", "hub", "key", "unit", F.coalesce("linked", F.lit(False)).alias("linked"), "shard"))
    linked = propagate(rows.filter("linked"), shards, rounds, rows.count() // shards)
    rows = linked.unionByName(rows.filter("not linked"))

    # exact ranks in each shard, linked rows first: sorted in chunks of a hash, chunks put one after another
    counts = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
    total = sum(counts.values())
    chunks = max(1, math.ceil(max(counts.values(), default=0) / CHUNK))
    rows = rows.withColumn("chunk", F.when(F.col("linked"), 0).otherwise(chunks) + F.floor(F.col("unit") * chunks).cast("int"))
    sizes = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("unit", "hub", "key"))
    rows = rows.withColumn("place", place).join(before, ["shard", "chunk"]).withColumn("rank", F.col("before") + F.col("place") - 1)

    target = [total // shards + (j < total % shards) for j in range(shards)]
    have = [counts.get(j, 0) for j in range(shards)]
    extra, lack = [max(0, h - t) for h, t in zip(have, target)], [max(0, t - h) for h, t in zip(have, target)]
    extra_before, lack_before = [sum(extra[:j]) for j in range(shards)], [sum(lack[:j]) for j in range(shards)]

    def at(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)

    surplus = F.when(F.col("rank") >= at(target), at(extra_before) + F.col("rank") - at(target))
    rows = rows.withColumn("surplus", surplus)
    to, slot = F.col("shard"), F.col("rank")
    for j in range(shards):
        if lack[j]:
            here = (F.col("surplus") >= lack_before[j]) & (F.col("surplus") < lack_before[j] + lack[j])
            to, slot = F.when(here, j).otherwise(to), F.when(here, have[j] + F.col("surplus") - lack_before[j]).otherwise(slot)
    return rows.select("doc_id", "size", "text_crc32", to.cast("int").alias("to"), slot.cast("long").alias("slot")).withColumnRenamed("to", "shard")
