"""Clusters around anchors: parallel rounds on distinct places, for any number of incidents.

The rule in order of time (see ``clustering``) is sequential.  This one has the same purpose, groups of incidents within
a radius of a centre, but every step is a join or an aggregate over distinct places:

* A place counts the more, the more incidents it has; then the later its last one; then by coordinates.
* In each round the foremost uncovered place of each cell of the globe contends.  A contender that beats all contenders
  within the radius becomes an anchor and covers the places within the radius.  Rounds end when no place is uncovered.
* Every place joins its nearest anchor.  Anchors are more than a radius apart.

A cell is small enough for all its places to lie within the radius of each other, so a dense city is one contender, and
no two places are ever paired but contenders and anchors with what is near them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import coded_cell, explode_cells, haversine_miles
from tremorline.operators.clustering import precise_events
from tremorline.session import cut_lineage

CELLS_PER_RADIUS = 1.8


def distinct_places(events: DataFrame, radius: float) -> DataFrame:
    """``latitude, longitude, rank, first_id, cell`` of the places of precise incidents; places without coordinates drop out."""
    return (precise_events(events).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .groupBy("latitude", "longitude")
            .agg(F.count("*").alias("n"), F.coalesce(F.max(F.unix_micros("occurred_at")), F.lit(0)).alias("last"),
                 F.min("id").alias("first_id"))
            .select("latitude", "longitude", "first_id",
                    F.struct((-F.col("n")).alias("n"), (-F.col("last")).alias("last"), "latitude", "longitude").alias("rank"),
                    coded_cell(F.col("latitude"), F.col("longitude"), radius / CELLS_PER_RADIUS).alias("cell")))


def _around(centres: DataFrame, radius: float) -> DataFrame:
    """``a_lat, a_lon, a_rank, a_id, cell``: every cell that may hold a place within the radius of a centre."""
    named = centres.select(F.col("latitude").alias("a_lat"), F.col("longitude").alias("a_lon"), F.col("rank").alias("a_rank"),
                           F.col("first_id").alias("a_id"))
    return explode_cells(named, "a_lat", "a_lon", radius / CELLS_PER_RADIUS, radius)


def _near(places: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    apart = haversine_miles(F.col("latitude"), F.col("longitude"), F.col("a_lat"), F.col("a_lon"))
    return places.join(_around(centres, radius), "cell").withColumn("miles", apart).where(F.col("miles") <= radius)


def place_anchors(places: DataFrame, radius: float) -> DataFrame:
    """The anchors among ``places``."""
    open_places, anchors = places, None
    while not open_places.isEmpty():
        contenders = cut_lineage(open_places.groupBy("cell").agg(F.min(F.struct("rank", "latitude", "longitude", "first_id")).alias("p"))
                                 .select("cell", "p.*"))
        beaten = _near(contenders, contenders, radius).where("a_rank < rank").select("latitude", "longitude")
        new = cut_lineage(contenders.join(beaten, ["latitude", "longitude"], "left_anti"))
        anchors = new if anchors is None else anchors.unionByName(new)
        covered = _near(open_places, new, radius).select("latitude", "longitude")
        open_places = cut_lineage(open_places.join(covered, ["latitude", "longitude"], "left_anti"))
    return places.limit(0) if anchors is None else anchors


def anchor_clusters(events: DataFrame, radius: float = C.CLUSTER_MILES) -> DataFrame:
    """``id, seed`` for precise incidents; ``seed`` is the least id at the anchor place."""
    places = cut_lineage(distinct_places(events, radius))
    nearest = (_near(places, place_anchors(places, radius), radius).groupBy("latitude", "longitude")
               .agg(F.min(F.struct("miles", "a_rank", "a_id"))["a_id"].alias("seed")))
    return precise_events(events).select("id", "latitude", "longitude").join(nearest, ["latitude", "longitude"]).select("id", "seed")
