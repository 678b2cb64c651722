"""Greedy radius clusters of precise incidents, newest first.

Rule: take incidents by time, newest first; each joins the nearest cluster whose running-mean centre is within the
radius, or starts a new one.  State-level incidents are left to ``state_groups`` (see ``hotspots``); country-level
ones are dropped.

The rule is sequential, but only nearby incidents influence each other: a cluster never reaches an incident further
than sqrt(2) radii from all its members (the squared spread of its members stays below the squared radius), so
incidents linked by steps of 1.5 radii form components that can be clustered apart, with the same result.

* Components are found on occupied cells of the globe, not on incidents.  The surface holds about 210,000 cells of
  half a radius (37.5 miles), whatever the number of incidents, so that step has a fixed size.
* Each component is folded in time order by a grouped function.  When one component has more rows than a task should
  take, all components are cut into slices of bounded size by their exact rank in time order, and slices are folded
  one after the other; only cluster centres pass from slice to slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import cell, is_country_level, is_state_level
from tremorline.session import cut_lineage

ROWS_PER_TASK = 500_000
LINK_FACTOR = 1.5


def precise_events(events: DataFrame) -> DataFrame:
    return events.filter(~is_state_level(F.col("city"), F.col("state")) & ~is_country_level(F.col("city")))


def state_level_events(events: DataFrame) -> DataFrame:
    return events.filter(is_state_level(F.col("city"), F.col("state")))


def _link_cells(size: float, reach: float):
    """Grouped function: connected components of occupied cells; cells link when they come within ``reach``."""

    def link(pdf):
        import itertools

        import numpy as np
        import pandas as pd

        xyz = pdf[["x", "y", "z"]].to_numpy(dtype="int64")
        steps = int(np.ceil(reach / size)) + 1
        low = xyz.min(axis=0) - steps
        width = xyz.max(axis=0) - low + steps + 1

        def code(a):
            return ((a[:, 0] - low[0]) * width[1] + (a[:, 1] - low[1])) * width[2] + (a[:, 2] - low[2])

        codes = code(xyz)
        order = np.argsort(codes)
        ranked = codes[order]
        links = []
        for step in itertools.product(range(-steps, steps + 1), repeat=3):
            gap = sum(max(0, abs(s) - 1) ** 2 for s in step) ** 0.5 * size
            if step <= (0, 0, 0) or gap > reach:
                continue
            wanted = code(xyz + np.array(step))
            at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
            hit = ranked[at] == wanted
            links.append((np.nonzero(hit)[0].astype("int32"), order[at[hit]].astype("int32")))
        a = np.concatenate([i for i, _ in links])
        b = np.concatenate([j for _, j in links])
        label = np.arange(len(codes))
        while True:  # smallest label wins along links; jumping to the label's label shortens paths
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (label == before).all():
                break
        rows = np.bincount(label, weights=pdf["rows"].to_numpy(), minlength=len(label)).astype("int64")
        return pd.DataFrame({"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "component": label.astype("int64"),
                             "component_rows": rows[label]})

    return link


def with_cells(events: DataFrame, radius: float) -> DataFrame:
    return events.select("id", "latitude", "longitude", F.unix_micros("occurred_at").alias("micros"),
                         cell(F.col("latitude"), F.col("longitude"), radius / 2).alias("cell"))


def cell_components(rows: DataFrame, radius: float = C.CLUSTER_MILES) -> DataFrame:
    """``cell, component, component_rows`` of the occupied cells."""
    occupied = rows.groupBy("cell").agg(F.count("*").alias("rows")).select(
        F.lit(0).alias("globe"), "cell.x", "cell.y", "cell.z", "rows")
    labels = occupied.groupBy("globe").applyInPandas(
        _link_cells(radius / 2, LINK_FACTOR * radius),
        "x long, y long, z long, component long, component_rows long")
    return labels.select(F.struct("x", "y", "z").alias("cell"), "component", "component_rows")


def _fold(radius: float):
    """Grouped function: run the greedy rule over rows of one component, continuing from earlier centres."""
    earth = C.EARTH_RADIUS_MILES

    def fold(rows, centres):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values(["micros", "id"], ascending=[False, True], na_position="last")
        ids = rows["id"].to_numpy()
        lats, lons = rows["latitude"].to_numpy(), rows["longitude"].to_numpy()
        centres = centres.sort_values("place")
        k = len(centres)
        room = max(64, 2 * k)
        seeds, n = np.zeros(room, "int64"), np.zeros(room, "int64")
        lat, lon = np.zeros(room), np.zeros(room)
        seeds[:k], n[:k] = centres["seed"], centres["n"]
        lat[:k], lon[:k] = centres["latitude"], centres["longitude"]
        phi, lam = np.radians(lat), np.radians(lon)
        cosine = np.cos(phi)
        chosen = np.empty(len(ids), "int64")
        for i in range(len(ids)):
            p, q = np.radians(lats[i]), np.radians(lons[i])
            near, best = -1, np.inf
            if k:
                half = (np.sin((phi[:k] - p) / 2) ** 2
                        + np.cos(p) * cosine[:k] * np.sin((lam[:k] - q) / 2) ** 2)
                near = int(np.argmin(half))
                best = 2 * earth * np.arcsin(np.sqrt(min(1.0, half[near])))
            if best <= radius:
                m = n[near]
                lat[near] = (lat[near] * m + lats[i]) / (m + 1)
                lon[near] = (lon[near] * m + lons[i]) / (m + 1)
            else:
                if k == room:
                    room *= 2
                    seeds, n = np.resize(seeds, room), np.resize(n, room)
                    lat, lon = np.resize(lat, room), np.resize(lon, room)
                    phi, lam, cosine = np.resize(phi, room), np.resize(lam, room), np.resize(cosine, room)
                near, k = k, k + 1
                seeds[near], n[near], lat[near], lon[near] = ids[i], 0, lats[i], lons[i]
            n[near] += 1
            phi[near], lam[near] = np.radians(lat[near]), np.radians(lon[near])
            cosine[near] = np.cos(phi[near])
            chosen[i] = seeds[near]
        component = rows["component"].iloc[0] if len(rows) else 0
        members = pd.DataFrame({"component": component, "id": ids, "seed": chosen})
        state = pd.DataFrame({"component": component, "seed": seeds[:k], "place": np.arange(k), "n": n[:k],
                              "latitude": lat[:k], "longitude": lon[:k]})
        return members, state

    return fold


_CENTRES = "component long, seed long, place long, n long, latitude double, longitude double"


def _ranked_slices(rows: DataFrame, rows_per_slice: int) -> DataFrame:
    """Cut every component, in time order, into slices of ``rows_per_slice``.

    A range sort spreads even a single huge component, or a single huge instant, over all tasks; exact ranks then
    follow from the counts per sorted partition.
    """
    ordered = cut_lineage(rows.orderBy("component", F.desc_nulls_last("micros"), "id")
                          .withColumn("at", F.monotonically_increasing_id())
                          .withColumn("part", F.shiftright("at", 33)))
    parts = ordered.groupBy("component", "part").agg(F.count("*").alias("rows"), F.min("at").alias("start"))
    before = Window.partitionBy("component").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("component", "part", "start", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skip"))
    rank = F.col("skip") + F.col("at") - F.col("start")
    return ordered.join(parts, ["component", "part"]).withColumn(
        "slice", F.floor(rank / F.lit(rows_per_slice))).drop("at", "part", "skip", "start")


def greedy_clusters(events: DataFrame, radius: float = C.CLUSTER_MILES,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``id, seed`` for precise incidents; ``seed`` is the id of the incident that started the cluster."""
    points = with_cells(precise_events(events), radius)
    labels = cut_lineage(cell_components(points, radius))
    largest = labels.agg(F.max("component_rows")).first()[0] or 0
    rows = points.join(labels.select("cell", "component"), "cell").drop("cell")
    fold = _fold(radius)
    if largest <= rows_per_task:
        def whole(pdf):
            import pandas as pd

            empty = pd.DataFrame({c: [] for c in ("place", "seed", "n", "latitude", "longitude")})
            return fold(pdf, empty)[0][["id", "seed"]]

        return rows.groupBy("component").applyInPandas(whole, "id long, seed long")

    def step(pdf, centres):
        import pandas as pd

        members, state = fold(pdf, centres)
        if not len(pdf):
            members, state = members[:0], state[:0]
        return pd.concat([members.assign(kind="member"), state.assign(kind="centre", id=-1)])[
            ["kind", "component", "id", "seed", "place", "n", "latitude", "longitude"]].astype(
                {"place": "Int64", "n": "Int64"})

    sliced = cut_lineage(_ranked_slices(rows, rows_per_task))
    last = sliced.agg(F.max("slice")).first()[0]
    centres = rows.sparkSession.createDataFrame([], _CENTRES)
    done = []
    for number in range(last + 1):
        part = sliced.filter(F.col("slice") == number).drop("slice")
        out = cut_lineage(part.groupBy("component").cogroup(centres.groupBy("component")).applyInPandas(
            step, "kind string, component long, id long, seed long, place long, n long, latitude double, "
                  "longitude double"))
        done.append(out.filter("kind = 'member'").select("id", "seed"))
        centres = out.filter("kind = 'centre'").select("component", "seed", "place", "n", "latitude", "longitude")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result
