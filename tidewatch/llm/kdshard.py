"""K-d tree sharding, in DataFrame functions only.

The documents of a node are split at the weighted median (weight: bytes) along the metadata
dimension in which the node is widest, relative to the whole corpus, until every leaf has its
share of the target bytes. A node that is to make k leaves gives floor(k / 2) of them, and as
much of its bytes, to its lower child. Medians are exact: :func:`common.positions` gives every
row the bytes before it in its node's order by one range exchange and prefix sums.

Copies of a text count as one group with the metadata of the copy with the smallest doc_id, and
are neighbours along every dimension. A cut that would fall inside a group moves to its nearer
end if that takes it at most ``snap`` of a leaf's bytes away; a group where it takes more is cut, or
the sizes would not stay near equal.

Null texts count as empty (size 1). Null metadata sorts first; null ids are allowed. Repeated rows
are told apart by a row number. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import positions, stored

DIMENSIONS = ("chars", "lang", "source")


def document_items(docs: DataFrame) -> DataFrame:
    """Narrow rows: rid, doc_id, size, text_crc32, text_key and the metadata dimensions as numbers
    (names take the place of their crc32 between 0 and 1)."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = {c.lower() for c in docs.columns}
    name = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) / float(1 << 32)) if c in cols else F.lit(None).cast("double")
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("text_key"), F.length(t).cast("double").alias("chars"),
        name("lang").alias("lang"), name("source").alias("source"))


def kd_shards(items: DataFrame, leaves: int = 8, dims: tuple[str, ...] = DIMENSIONS, snap: float = 0.02) -> DataFrame:
    """Adds shard (0 to leaves - 1) and slot (gapless from 0 in doc_id order) to rows with rid, doc_id,
    size, text_key and ``dims``. For a byte target take leaves = ceil(total bytes / target)."""
    items = stored(items, "kd-items")
    first = items.groupBy("text_key").agg(F.min(F.struct("doc_id", "rid", *dims)).alias("_g"))
    nodes = items.drop(*dims).join(first, "text_key").select(
        *[c for c in items.columns if c not in dims],
        *[F.coalesce(F.col(f"_g.{d}"), F.lit(-1.0)).alias(d) for d in dims], F.lit(0).alias("_node"))
    nodes = stored(nodes, "kd-level")
    open_ = {0: leaves}  # first leaf number of a node -> its leaves
    whole: dict[str, float] = {}
    while any(k > 1 for k in open_.values()):
        stats = nodes.groupBy("_node").agg(
            F.sum("size").alias("bytes"), *[F.min(d).alias(f"lo_{d}") for d in dims],
            *[F.max(d).alias(f"hi_{d}") for d in dims]).collect()  # a row a node
        stats = [r for r in stats if open_[r["_node"]] > 1]
        if not stats:
            break
        wide = lambda r, d: r[f"hi_{d}"] - r[f"lo_{d}"]
        whole = whole or {d: max(wide(r, d) for r in stats) or 1.0 for d in dims}
        along, target, tolerance = F.lit(0.0), {}, {}
        for r in stats:
            k, node = open_[r["_node"]], r["_node"]
            d = max(dims, key=lambda d: (wide(r, d) / whole[d], -dims.index(d)))
            along = F.when(F.col("_node") == node, F.col(d)).otherwise(along)
            target[node] = r["bytes"] * (k // 2) / k
            tolerance[node] = snap * r["bytes"] / k
        active = nodes.filter(F.col("_node").isin(list(target)))
        rest = nodes.filter(~F.col("_node").isin(list(target)))
        at = positions(active.withColumn("_v", along), "_node", ["_v", "text_key", "doc_id", "rid"], "size", "kd-order")
        goal = F.lit(0.0)
        for node, x in target.items():
            goal = F.when(F.col("_node") == node, F.lit(x)).otherwise(goal)
        at = at.withColumn("_lower", F.col("_before") + F.col("size") / 2 < goal)
        # the group at each cut, and its extent
        edge = at.filter(~F.col("_lower")).groupBy("_node").agg(
            F.min(F.struct("_before", "_v", "text_key")).alias("e")).collect()  # a row a node
        cut = {}
        if edge:
            inside = F.lit(False)
            for r in edge:
                inside = inside | ((F.col("_node") == r["_node"]) & (F.col("_v") == r["e"]["_v"])
                                   & (F.col("text_key") == r["e"]["text_key"]))
            for r in at.filter(inside).groupBy("_node").agg(
                    F.min("_before").alias("a"), F.max(F.col("_before") + F.col("size")).alias("b")).collect():
                x = target[r["_node"]]
                nearer = r["a"] if x - r["a"] <= r["b"] - x else r["b"]
                if abs(nearer - x) <= tolerance[r["_node"]]:
                    cut[r["_node"]] = nearer
        side = F.col("_lower")
        for node, x in cut.items():
            side = F.when(F.col("_node") == node, F.col("_before") < x).otherwise(side)
        child = F.col("_node")
        for node in target:
            child = F.when((F.col("_node") == node) & ~side, F.lit(node + open_[node] // 2)).otherwise(child)
        nodes = stored(at.withColumn("_node", child.cast("int")).select(*nodes.columns).unionByName(rest), "kd-level")
        for node in target:
            k = open_[node]
            open_[node], open_[node + k // 2] = k // 2, k - k // 2
    at = positions(nodes, "_node", ["doc_id", "rid"], "size", "kd-slots")
    return at.withColumn("shard", F.col("_node")).withColumn("slot", F.col("_rank").cast("long")).drop(
        "_node", "_before", "_rank")
