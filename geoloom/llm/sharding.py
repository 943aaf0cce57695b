"""Resharding by minimum-cost flow: rows move from shards that are too large to shards with room, as few bytes as can be.

Law: `bytes`. The new capacities are equal shares of all bytes. A flow network (old shard -> new shard; staying costs 0,
moving costs 1 a byte) is solved on the driver over the table of shard sizes, which has one row for each shard. Inside an
old shard the rows stand in blocks (class of size, salt of doc_id), largest class first; the flow's intervals over the
running sum of bytes say where each row goes, so that what moves are the small rows at the end and a shard's bytes miss
its capacity by about the size of one small row for each transfer. Running sums have two levels (blocks, rows in a
block), so no task holds a whole shard; a hot text spreads over all salts of its block.

Defined results: a null text has size 1 and crc 0; a null doc_id is a row like others; repeated rows are separate rows;
equal texts start in one old shard and leave it only where bytes must move; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import id_text, materialize

#: Blocks of one class of size in an old shard.
SALTS = 64
#: The second round evens out what the first missed, since rows are not divisible; it moves the smallest rows.
ROUNDS = 2


def min_cost_flow(sizes: list[int], capacities: list[int]) -> list[list[int]]:
    """flow[i][j]: bytes from old shard i to new shard j with all sizes placed, no capacity exceeded, fewest bytes moved.

    Successive shortest paths (Bellman-Ford) over one node for each old and new shard, a source and a sink.
    """
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, what is left, cost; edge k ^ 1 goes back
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, most: int, cost: int) -> None:
        at[a].append(len(edges))
        edges.append([b, most, cost])
        at[b].append(len(edges))
        edges.append([a, 0, -cost])

    for i, x in enumerate(sizes):
        edge(source, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, int(i != j))
    for j, x in enumerate(capacities):
        edge(n + j, sink, x, 0)
    while True:
        far = [1 << 60] * (n + m + 2)
        via = [-1] * (n + m + 2)
        far[source], queue = 0, [source]
        while queue:
            a = queue.pop(0)
            for k in at[a]:
                b, left, cost = edges[k]
                if left and far[a] + cost < far[b]:
                    far[b], via[b] = far[a] + cost, k
                    queue.append(b)
        if via[sink] < 0:
            break
        path, b = [], sink
        while b != source:
            path.append(via[b])
            b = edges[via[b] ^ 1][0]
        amount = min(edges[k][1] for k in path)
        for k in path:
            edges[k][1] -= amount
            edges[k ^ 1][1] += amount
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for k in at[i]:
            if k % 2 == 0:
                flow[i][edges[k][0] - n] = edges[k ^ 1][1]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def intervals(flow: list[list[int]]) -> list[list[tuple[int, int]]]:
    """For each old shard, (end of the interval, new shard) in the order of its rows: what stays comes first."""
    out = []
    for i, row in enumerate(flow):
        order = sorted((j for j, x in enumerate(row) if x), key=lambda j: (j != i, j))
        ends, at = [], 0
        for j in order:
            at += row[j]
            ends.append((at, j))
        out.append(ends)
    return out


def target(old: Column, middle: Column, ends: list[list[tuple[int, int]]]) -> Column:
    """The new shard of a row whose bytes have their middle there; rows past the last end take the last interval."""
    out = F.lit(None).cast("int")
    for i, own in enumerate(ends):
        if not own:
            continue
        to = F.lit(own[-1][1])
        for end, j in reversed(own[:-1]):
            to = F.when(middle < F.lit(end), F.lit(j)).otherwise(to)
        out = F.when(old == i, to).otherwise(out)
    return out


def transfer(rows: DataFrame, shards: int) -> DataFrame:
    """rows with `shard`, the shard that the flow from the present old_shard sends them to."""
    block = ["old_shard", "class", "salt"]
    rows = rows.select("doc_id", "size", "text_crc32", "first_shard", *block)
    blocks = rows.groupBy(block).agg(F.sum("size").alias("bytes"))
    sizes = {r[0]: r[1] for r in blocks.groupBy("old_shard").agg(F.sum("bytes")).collect()}  # a row for each shard
    old = [sizes.get(i, 0) for i in range(max([shards - 1, *sizes]) + 1)]
    flow = min_cost_flow(old, equal_capacities(sum(old), shards))
    before = Window.partitionBy("old_shard").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*block, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy(*block).orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(starts, block)
    middle = F.col("block_start") + F.col("upto") - F.col("size") / 2
    return placed.withColumn("shard", target(F.col("old_shard"), middle, intervals(flow))).drop("upto", "block_start")


def reshard(docs: DataFrame, shards: int = 16, old_shard: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and old_shard of every row.

    old_shard: where a row lies now, 0 to shards - 1; by default a hash of its text.
    """
    rows = (docs if old_shard is None else docs.withColumn("_old", old_shard)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        *([] if old_shard is None else [F.col("_old").cast("int").alias("old_shard")]),
    )
    if old_shard is None:
        rows = rows.withColumn("old_shard", F.pmod("text_crc32", F.lit(shards)).cast("int"))
    rows = rows.withColumns({"class": (-F.floor(F.log2("size"))).cast("int"), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    placed = materialize(rows, "reshard-rows").withColumn("first_shard", F.col("old_shard"))
    for _ in range(ROUNDS):
        placed = materialize(transfer(placed, shards), "reshard-placed").withColumns({"old_shard": F.col("shard")})
    placed = placed.withColumn("old_shard", F.col("first_shard"))
    block = ["old_shard", "class", "salt"]

    part = ["shard", *block]
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    first = Window.partitionBy("shard").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*part, F.coalesce(F.sum("n").over(first), F.lit(0)).alias("first"))
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy(*part).orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(firsts, part).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def resharded(docs: DataFrame, path: str, shards: int = 16) -> DataFrame:
    """Plan, write every shard under path, and give doc_id, size, text_crc32, law, shard, slot and grown_shard as the files say."""
    docs = id_text(docs)
    plan = materialize(reshard(docs, shards), "reshard-plan")
    rewrite(docs, plan, path, every=True)
    if plan.isEmpty():
        return plan.drop("old_shard")
    text = F.col("text")
    return docs.sparkSession.read.schema("doc_id long, text string, slot long, shard int").parquet(path).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def rewrite(docs: DataFrame, plan: DataFrame, path: str, old_shard: Column | None = None, every: bool = False) -> DataFrame:
    """Write the shards whose rows changed to path/shard=N; returns the shards that were left as they were.

    every: all shards are written, as for a folder that holds none yet; none is left then. Texts are shuffled once; a task
    writes one file for each shard that it meets, sorted by slot, so spark.sql.adaptive.advisoryPartitionSizeInBytes sets the
    size of files.

    docs are all rows of the plan, with doc_id and text. Rows of docs and plan meet by doc_id, size and crc of the text,
    and by their number among rows that are equal in these, so each has its own slot. old_shard is what reshard was given;
    where it tells equal rows apart, they keep to their own places. Other shards under path stay; those that the plan
    empties go.
    """
    changed = plan.where(F.lit(True) if every else F.col("shard") != F.col("old_shard"))
    touched = materialize(changed.select(F.explode(F.array("shard", "old_shard")).alias("shard")).distinct(), "reshard-touched")
    text = F.col("text").cast("string")
    parts = lambda doc_id, size, crc, old: {"_none": doc_id.isNull(), "_id": F.coalesce(doc_id, F.lit(0)), "_size": size, "_crc": crc} | ({} if old is None else {"_old": F.coalesce(old, F.lit(-1))})
    own = parts(F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")), None if old_shard is None else old_shard.cast("int"))
    names = list(own)  # no null among them, so that equality is all that the join asks
    places = plan.select(*(c.alias(k) for k, c in parts(F.col("doc_id"), F.col("size"), F.col("text_crc32"), None if old_shard is None else F.col("old_shard")).items()), "shard", "slot")
    places = places.withColumn("_k", F.row_number().over(Window.partitionBy(*names).orderBy("shard", "slot")))
    rows = docs.withColumns(own).drop("shard", "slot").withColumn("_k", F.row_number().over(Window.partitionBy(*names).orderBy("text")))
    moved = places.join(F.broadcast(touched), "shard", "left_semi")
    out = rows.join(moved, [*names, "_k"]).select(*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot")
    out = out.sortWithinPartitions("shard", "slot")
    conf, name = docs.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")  # rows that the window has already dealt by these keys aren't shuffled again for the join
    try:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    finally:
        conf.set(name, before)
    emptied = touched.join(plan, "shard", "left_anti").collect()  # at most a row for each shard
    if emptied:
        spark = docs.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        for (shard,) in emptied:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"shard={shard}"), True)
    return plan.select("shard").distinct().join(touched, "shard", "left_anti")
