"""Adaptive blocks over place and time, and the search of the best point under a score that falls with both distances.

Points are cut into nodes: first by key, cell of the globe and time bucket; a node of more than ``LEAF`` points is cut
again into a grid of 4 x 4 x 4, level by level, wherever distributed counts say so.  A node knows its number of points,
the box they fill and one of them.  A search goes down level by level for all queries at once: the point a node shows
gives a score that is reached (lower bound), its box gives a score that cannot be passed (upper bound), and a node that
cannot pass what its query has reached is not opened.  So a query meets few points however many share its surroundings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import coded_cell, explode_cells, haversine_miles
from tremorline.session import cut_lineage

#: Points of a node that is not cut any further, ways each axis is cut, and levels at most (a hundredth of an inch).
LEAF, WAYS, DEEPEST = 16, 4, 12
SLACK = 1e-9


def _east(lon: Column) -> Column:
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def root_cell(lat: Column, lon: Column, miles: float) -> Column:
    return coded_cell(lat, lon, 4.0 * miles)


def root_bucket(at: Column, micros: int) -> Column:
    return F.floor(at / F.lit(4 * micros))


def reached_roots(rows: DataFrame, miles: float, micros: int) -> DataFrame:
    """One row per root cell and bucket that can hold a point near enough: 8 cells by 2 buckets at most."""
    span = F.sequence(root_bucket(F.col("micros") - micros, micros), root_bucket(F.col("micros") + micros, micros))
    return explode_cells(rows, "latitude", "longitude", 4.0 * miles, miles).withColumn("bucket", F.explode(span))


class Blocks:
    """Nodes and leaves of points ``key..., cell, bucket, latitude, longitude, micros, id``.

    ``keys`` keep points apart; ``cell`` and ``bucket`` are the root a point lies in (``root_cell``, ``root_bucket``).
    Points should be cut off from their lineage, since every level reads them.
    """


    def __init__(self, points: DataFrame, keys: list[str], miles: float, micros: int, leaf: int = LEAF):
        degrees = math.degrees(4.0 * miles / C.EARTH_RADIUS_MILES)
        self.levels: list[DataFrame] = []
        leaves = []
        here, by = points, [*keys, "cell", "bucket"]
        shown = F.struct("latitude", "longitude", "micros", "id")
        for level in range(1, DEEPEST + 1):
            nodes = here.groupBy(*by).agg(
                F.count("*").alias("n"), F.min("latitude").alias("south"), F.max("latitude").alias("north"),
                F.min(_east(F.col("longitude"))).alias("west"), F.max(_east(F.col("longitude"))).alias("east"),
                F.min("micros").alias("since"), F.max("micros").alias("till"), F.min(shown).alias("shown"))
            nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id() + F.lit(level << 55)))
            self.levels.append(nodes.withColumn("is_leaf", F.col("n") <= (leaf if level < DEEPEST else 1 << 60)))
            placed = cut_lineage(here.join(self.levels[-1].select(*by, "node", "is_leaf"), by).select(
                "node", "is_leaf", "latitude", "longitude", "micros", "id"))  # every search reads the leaves
            leaves.append(placed.where("is_leaf"))
            if level == DEEPEST or nodes.where(F.col("n") > leaf).isEmpty():
                break
            cuts = WAYS**level
            here = placed.where("not is_leaf").select(
                F.col("node").alias("parent"), F.floor(F.col("latitude") / F.lit(degrees / cuts)).alias("_y"),
                F.floor(_east(F.col("longitude")) / F.lit(1.5 * degrees / cuts)).alias("_x"),
                F.floor(F.col("micros") / F.lit(4.0 * micros / cuts)).alias("_t"), "latitude", "longitude", "micros", "id")
            by = ["parent", "_y", "_x", "_t"]
        self.leaves = leaves[0].drop("is_leaf")
        for more in leaves[1:]:
            self.leaves = self.leaves.unionByName(more.drop("is_leaf"))


def _gap(low: Column, high: Column, x: Column) -> Column:
    return F.greatest(F.lit(0.0), low - x, x - high)


def least_miles(lat: Column, lon: Column) -> Column:
    """A distance that no point of a node's box undercuts."""
    dlat = F.radians(_gap(F.col("south"), F.col("north"), lat))
    x = _east(lon)
    dlon = F.radians(F.least(*[_gap(F.col("west"), F.col("east"), x + F.lit(turn)) for turn in (-360.0, 0.0, 360.0)]))
    narrow = F.least(F.cos(F.radians("south")), F.cos(F.radians("north")))
    chord = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat)) * narrow * F.sin(dlon / 2) ** 2
    return F.lit(2 * C.EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord))))


def leaf_candidates(frontier: DataFrame, blocks: Blocks, score, miles: float, micros: int) -> DataFrame:
    """Pairs of a query and a point that may be its best, from the root nodes each query starts with.

    ``frontier``: ``q, latitude, longitude, micros, similarity, reached`` (a score the query has from elsewhere, or null)
    and the columns of a node.  ``score(similarity, hours_apart, distance)`` must fall with both distances.  Output: ``q,
    similarity, reached``, the query's place and time, and the point as ``p_latitude, p_longitude, p_micros, p_id``.
    """
    lat, lon, at = F.col("latitude"), F.col("longitude"), F.col("micros")
    hours = lambda apart: apart / F.lit(1e6) / F.lit(3600.0)
    kept_columns = ["q", "latitude", "longitude", "micros", "similarity", "at_most", "reached", "node", "is_leaf"]
    own = Window.partitionBy("q")
    may_win = F.col("reached").isNull() | (F.col("at_most") >= F.col("reached") - F.lit(SLACK))
    done = []
    for level, _ in enumerate(blocks.levels):
        apart, far = F.greatest(F.lit(0), F.col("since") - at, at - F.col("till")), least_miles(lat, lon)
        shown_apart = F.abs(at - F.col("shown.micros"))
        shown_far = haversine_miles(lat, lon, F.col("shown.latitude"), F.col("shown.longitude"))
        bounded = frontier.where((apart <= micros) & (far <= F.lit(miles * (1 + SLACK) + 1e-6))).withColumns({
            "at_most": score(F.col("similarity"), hours(apart), far),
            "at_least": F.when((shown_apart <= micros) & (shown_far <= miles),
                               score(F.col("similarity"), hours(shown_apart), shown_far))})
        kept = bounded.withColumn("reached", F.max(F.greatest("reached", "at_least")).over(own)).where(may_win).select(*kept_columns)
        if level + 1 < len(blocks.levels):
            kept = cut_lineage(kept)
            children = blocks.levels[level + 1].drop("_y", "_x", "_t", "n")
            frontier = (kept.where("not is_leaf").withColumnRenamed("node", "parent")
                        .drop("at_most", "is_leaf").join(children, "parent").drop("parent"))
        done.append(kept.where("is_leaf"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    if len(done) > 1:  # a leaf kept on an upper level may be beaten by what was reached below
        found = found.withColumn("reached", F.max("reached").over(own)).where(may_win)
    points = blocks.leaves.select("node", F.col("latitude").alias("p_latitude"), F.col("longitude").alias("p_longitude"),
                                  F.col("micros").alias("p_micros"), F.col("id").alias("p_id"))
    return found.select("q", "latitude", "longitude", "micros", "similarity", "reached", "node").join(points, "node").drop("node")
