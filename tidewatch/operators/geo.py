"""Geocoding from extracted entities.

The gazetteer is a fixed 24-entry table, so the lookup is a literal map evaluated in the
projection: no join, no shuffle, no broadcast needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import STR_ARRAY, _c


def first_known_place(ents) -> Column:
    """First GPE, then LOC, mention that the gazetteer knows (exact, case-sensitive)."""
    gaz = dims.gazetteer_map_col()
    m = _c(ents)
    cands = F.concat(F.coalesce(F.try_element_at(m, F.lit("GPE")), F.array().cast(STR_ARRAY)),
                     F.coalesce(F.try_element_at(m, F.lit("LOC")), F.array().cast(STR_ARRAY)))
    return F.try_element_at(F.filter(cands, lambda p: F.map_contains_key(gaz, p)), F.lit(1))


def geocode(df: DataFrame, ents_col: str = "ents", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Only when lat or lng is missing, set both from the first known place."""
    gaz = dims.gazetteer_map_col()
    hit = F.try_element_at(gaz, first_known_place(F.col(ents_col)))
    need = F.col(lat).isNull() | F.col(lng).isNull()
    tmp = "__geo_hit"
    return (df.withColumn(tmp, F.when(need, hit))
            .withColumn(lat, F.when(F.col(tmp).isNotNull(), F.col(tmp)["lat"]).otherwise(F.col(lat)))
            .withColumn(lng, F.when(F.col(tmp).isNotNull(), F.col(tmp)["lng"]).otherwise(F.col(lng)))
            .drop(tmp))

