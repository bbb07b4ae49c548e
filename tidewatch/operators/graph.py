"""Event-entity bipartite graph (G1, G2) as edge and node DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.feed import with_entity_map


def entity_edges(live: DataFrame, per_event: int = 3) -> DataFrame:
    """G1: event -> each of its first ``per_event`` entities (labels in JSON order, all
    labels, repeats give repeated edges)."""
    f = with_entity_map(live) if "ents" not in live.columns else live
    first = F.slice(X.flat_entities(F.col("ents")), 1, per_event)
    return (f.where(F.col("ents").isNotNull())
            .select("seq", "is_anomaly", F.posexplode_outer(first).alias("pos", "entity"))
            .where(F.col("pos").isNotNull())
            .select(F.concat(F.lit("ev_"), F.col("seq").cast("string")).alias("src"),
                    F.concat(F.lit("ent_"), F.col("entity")).alias("dst"), "pos", "seq", "entity", "is_anomaly"))


def entity_nodes(edges: DataFrame) -> DataFrame:
    """One node per event with an entity (size 10 red if anomaly else 5 green), one per
    distinct entity (size 15)."""
    an = F.coalesce(F.col("is_anomaly"), F.lit(False))
    ev = (edges.where(F.col("pos") == 0)
          .select(F.col("src").alias("node_id"), F.lit("").alias("label"),
                  F.when(an, 10).otherwise(5).alias("size"),
                  F.when(an, "#ef4444").otherwise("#10b981").alias("color"), F.lit("event").alias("kind")))
    ent = (edges.select(F.col("dst").alias("node_id"), F.col("entity").alias("label")).distinct()
           .select("node_id", "label", F.lit(15).alias("size"), F.lit(None).cast("string").alias("color"),
                   F.lit("entity").alias("kind")))
    return ev.unionByName(ent)
