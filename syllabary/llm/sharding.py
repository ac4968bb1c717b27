"""K-d tree sharding of documents by bytes.

A node's documents are split at the weighted median of its widest metadata dimension,
weights being document sizes, until each leaf holds its share of the bytes.  Medians
are found with histograms: each step sums sizes by bucket for all nodes of a level at
once, and zooms into the bucket that holds the cut.  Only histograms reach the driver.

The dimensions depend on the text alone, and within one value documents are ordered by
the text's crc32 and then doc_id, so a cut falls between groups of equal texts unless
that would miss the wanted weight by more than ``tolerance``; then it goes through the
group (a group may be larger than a shard).

Defined results: null texts have size 1; an empty table gives no rows; repeated rows
are placed together when no finer cut exists; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

DIMENSIONS = ("size", "chars", "words", "lines")
_BUCKETS = 2048


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.length(text).cast("long").alias("chars"),
        (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long").alias("words"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("lines"),
    )


def _cuts(rows: DataFrame, nodes: dict[int, tuple[str, float]], tolerance: float) -> dict[int, tuple]:
    """For each node, the first key (value, crc, doc_id) of its right half.

    ``nodes`` maps a node to its dimension and the share of its weight that goes left.
    Keys are compared in that order; a missing tail means the cut lies before all of it.
    """
    value = reduce(lambda c, n: c.when(F.col("node") == n, F.col(nodes[n][0])), list(nodes)[1:], F.when(F.col("node") == next(iter(nodes)), F.col(nodes[next(iter(nodes))][0])))
    left = rows.where(F.col("node").isin(*nodes)).select("node", "size", F.array(value, F.col("text_crc32"), F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("key"))
    found: dict[int, tuple] = {}
    state: dict[int, dict] = {n: {"fixed": (), "below": 0, "total": None} for n in nodes}
    for depth in range(3):
        open_ = [n for n in nodes if n not in found]
        if not open_:
            break
        here = reduce(lambda a, b: a | b, [(F.col("node") == n) & _equal(state[n]["fixed"]) for n in open_])
        part = left.where(here).select("node", "size", F.col("key")[depth].alias("v"))
        for r in part.groupBy("node").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("size").alias("w")).collect():
            s = state[r["node"]]
            s.update(lo=r["lo"], hi=r["hi"])
            if s["total"] is None:
                s["total"] = r["w"]
        while any(state[n]["hi"] > state[n]["lo"] for n in open_):
            active = [n for n in open_ if state[n]["hi"] > state[n]["lo"]]
            width = {n: (state[n]["hi"] - state[n]["lo"]) // _BUCKETS + 1 for n in active}
            pick = lambda what: reduce(lambda c, n: c.when(F.col("node") == n, F.lit(what(n))), active[1:], F.when(F.col("node") == active[0], F.lit(what(active[0]))))  # noqa: B023, E731
            lo, hi, w = pick(lambda n: state[n]["lo"]), pick(lambda n: state[n]["hi"]), pick(lambda n: width[n])
            counted = part.where(F.col("v").between(lo, hi)).groupBy("node", F.floor((F.col("v") - lo) / w).cast("long").alias("b")).agg(F.sum("size").alias("w")).collect()
            for n in active:
                s, bins = state[n], sorted((r["b"], r["w"]) for r in counted if r["node"] == n)
                goal = s["total"] * nodes[n][1]
                for b, weight in bins:
                    if s["below"] + weight >= goal or b == bins[-1][0]:
                        s["lo"], s["hi"] = s["lo"] + b * width[n], min(s["hi"], s["lo"] + (b + 1) * width[n] - 1)
                        s["here"] = weight
                        break
                    s["below"] += weight
        for n in open_:
            s = state[n]
            here_weight = s.get("here")
            if here_weight is None:  # one value in the whole node
                here_weight = s["total"] - s["below"]
            goal, slack = s["total"] * nodes[n][1], s["total"] * tolerance
            low, high = goal - s["below"], s["below"] + here_weight - goal
            if min(low, high) <= slack or depth == 2:
                found[n] = (*s["fixed"], s["lo"] if low <= high else s["lo"] + 1)
            else:
                s["fixed"] = (*s["fixed"], s["lo"])
                s["last"] = here_weight
                s["here"] = here_weight
    return found


def _equal(fixed: tuple) -> Column:
    return reduce(lambda a, b: a & b, [F.col("key")[k] == v for k, v in enumerate(fixed)], F.lit(True))


def _goes_left(dimension: str, cut: tuple) -> Column:
    keys = [F.col(dimension), F.col("text_crc32"), F.coalesce("doc_id", F.lit(-(1 << 62)))]
    out = F.lit(False)
    for k in range(len(cut) - 1, -1, -1):
        out = (keys[k] < cut[k]) | ((keys[k] == cut[k]) & out) if k < len(cut) - 1 else keys[k] < cut[k]
    return out


def assign(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.002) -> DataFrame:
    """Add ``shard`` (from 0) to a table as :func:`metadata` makes it.

    Give the number of shards, or the bytes that a leaf should hold.
    """
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    if not rows.columns or rows.isEmpty():
        return rows.withColumn("shard", F.lit(0))
    spread = {d: (r[f"lo_{d}"], r[f"hi_{d}"]) for r in [rows.agg(*[F.min(d).alias(f"lo_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"hi_{d}") for d in DIMENSIONS]).first()] for d in DIMENSIONS}
    leaves = {0: (0, shards)}  # node: first shard, number of shards
    node: Column = F.lit(0)
    following = 1
    while any(k > 1 for _, k in leaves.values()):
        now = rows.withColumn("node", node)
        inner = [n for n, (_, k) in leaves.items() if k > 1]
        widths = {r["node"]: r for r in now.where(F.col("node").isin(*inner)).groupBy("node").agg(*[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()}
        wanted = {}
        for n in inner:
            if n in widths:
                share = {d: widths[n][d] / max(1, spread[d][1] - spread[d][0]) for d in DIMENSIONS}
                wanted[n] = (max(DIMENSIONS, key=share.get), (leaves[n][1] // 2) / leaves[n][1])
        cuts = _cuts(now, wanted, tolerance) if wanted else {}
        split = F.col("__node")
        out = split
        for n in inner:
            first, k = leaves.pop(n)
            half = k // 2
            leaves[following], leaves[following + 1] = (first, half), (first + half, k - half)
            side = _goes_left(wanted[n][0], cuts[n]) if n in cuts else F.lit(True)
            out = F.when(split == n, F.when(side, F.lit(following)).otherwise(F.lit(following + 1))).otherwise(out)
            following += 2
        rows = rows.withColumn("__node", node).withColumn("__node", out)
        node = F.col("__node")
    numbers = F.create_map(*[F.lit(x) for n, (first, _) in leaves.items() for x in (n, first)])
    return rows.withColumn("shard", numbers[node].cast("int")).drop("__node")


def number_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, by doc_id.

    Rows are dealt by range of (shard, doc_id); each part counts its own rows and
    starts where the parts before it end, so no shard is gathered in one task.
    """
    n = partitions(rows.sparkSession)
    dealt = saved(rows.repartitionByRange(n, "shard", "doc_id", "text_crc32").withColumn("part", F.spark_partition_id()), "slots")
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return dealt.withColumn("within", within).join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.col("within")).cast("long")).drop("part", "within", "start")


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write documents as one folder a shard, from a table ``doc_id, shard, slot``."""
    docs.join(placed.select("doc_id", "shard", "slot"), "doc_id").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    rows = saved(metadata(spark.read.parquet(f"{sf_dir}/documents.parquet")), "shard-metadata")
    placed = number_slots(assign(rows, shards=8))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
