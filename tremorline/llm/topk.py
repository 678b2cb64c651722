"""Exact top-k search by inner product: lists sorted per dimension are read in step, without random access, until nobody else can qualify."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tremorline.llm.common import query
from tremorline.session import cut_lineage

#: Sums beyond this might not fit 64 bits.
SAFE = float(1 << 62)


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``id, v``: the vectors that take part, each component x as floor(scale * x).

    A vector that is null, or holds a null, a NaN or an infinity, takes no part.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor of a double is a long, saturated outside 64 bits: a product out of range is refused later
    return table.where(v.isNotNull() & fit).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _lists(table: pa.Table) -> pa.Table:
    """One row per dimension of a block: its values ascending, and where in the block each stands; dimension -1 has the rows."""
    rows = table.column("row").to_numpy()
    width = table.column("width")[0].as_py()
    x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(rows), width).T
    order = np.argsort(x, 1, kind="stable")
    block = np.full(width + 1, table.column("block")[0].as_py(), np.int64)
    ids = table.column("id").combine_chunks()
    known = np.asarray(ids.is_valid())
    places = [np.flatnonzero(known), *order]
    values = [ids.fill_null(0).to_numpy(), *np.take_along_axis(x, order, 1)]
    return pa.table({"width": pa.array(np.full(width + 1, width), pa.int32()), "block": pa.array(block),
                     "dim": pa.array(np.arange(-1, width), pa.int32()),
                     "places": pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())),
                     "values": pa.array([v.astype(np.int64) for v in values], pa.list_(pa.int64())),
                     "rows": pa.array([rows, *[None] * width], pa.list_(pa.int64()))})


def sorted_lists(vectors: DataFrame, per_block: int = 1 << 17) -> DataFrame:
    """The index: vectors ``row, id, v`` dealt at random into blocks of about ``per_block`` components, one sorted list per dimension.

    Vectors of different lengths never meet.  A block's lists are built by one task; blocks have a fixed size.
    """
    widths = vectors.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") * F.greatest("width", F.lit(1)) / F.lit(per_block))
    dealt = (vectors.withColumn("width", F.size("v")).join(widths, "width")
             .withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("long")).drop("n"))
    return dealt.groupBy("width", "block").applyInArrow(
        _lists, "width int, block long, dim int, places array<int>, `values` array<long>, rows array<long>")


class Block:
    """The lists of a block, read from both ends in step, for many queries at once."""

    def __init__(self, places: np.ndarray, values: np.ndarray):
        """``places`` and ``values``: (dimensions, rows), values ascending in each list."""
        self.places, self.values = places, values
        self.width, self.n = places.shape
        self.depth_read: list[int] = []  # of each query, when it stopped

    def candidates(self, queries: np.ndarray, k: int, barred: np.ndarray, step: int = 256) -> list[np.ndarray]:
        """For each query the places that may be among its ``k`` best, ties included; place ``barred`` (or -1) is no candidate.

        A query reads each list from the high end where its own component is positive, from the low end where it is
        negative.  What has been read of a row, plus for each list that has not shown it the list's worst value (lower
        bound) or the value just read there (upper bound), encloses its score.  A query stops as soon as no row outside
        the ``k`` best lower bounds, seen or not, can reach the k-th of them, but for a few that tie; or at the end.
        Bounds are sums over lists, so those of all queries at one depth are two products of matrices.
        """
        out: list = [None] * len(queries)
        size = np.minimum(k, self.n - (barred >= 0))
        for i in np.flatnonzero(size <= 0):
            out[i] = np.empty(0, np.int64)
        q = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(float)  # what reads high ends, low ends
        active, depth = np.flatnonzero(size > 0), 0
        values = self.values.astype(float)
        worst = np.concatenate([values[:, 0], values[:, -1]]) if self.n else np.empty(0)
        slack = 1e-9 * (1 + np.abs(q) @ np.tile(np.abs(values).max(1, initial=0), 2))
        read, shown = np.zeros((self.n, 2 * self.width)), np.zeros((self.n, 2 * self.width), bool)
        lists = np.arange(self.width)[:, None]
        while len(active):
            to = min(depth + step, self.n)
            for ends, side in ((slice(self.n - to, self.n - depth), 0), (slice(depth, to), self.width)):
                read[self.places[:, ends], side + lists] = values[:, ends]
                shown[self.places[:, ends], side + lists] = True
            frontier = np.concatenate([values[:, self.n - to], values[:, to - 1]])
            mine = q[active].T
            lower = (np.where(shown, read, worst) @ mine).T
            upper = (np.where(shown, read, frontier) @ mine).T
            own = np.flatnonzero(barred[active] >= 0)
            lower[own, barred[active[own]]] = upper[own, barred[active[own]]] = -np.inf
            going = []
            for row, i in enumerate(active):
                threshold = np.partition(lower[row], self.n - size[i])[self.n - size[i]] - slack[i]
                left = np.flatnonzero(upper[row] >= threshold)
                if to == self.n or len(left) <= 2 * k:
                    out[i] = left
                    self.depth_read.append(to)
                else:
                    going.append(i)
            active, depth = np.array(going, np.int64), to
        return out


def _search(k: int, together: int = 128):
    """The ``k`` best of a block for each of some queries, of which ``together`` are worked on at a time."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            left = left.sort_by("dim")
            lists = [(np.asarray(p.values), np.asarray(v.values)) for p, v in zip(left.column("places"), left.column("values"))]
            rows = np.asarray(left.column("rows")[0].values)
            (known, named), width = lists[0], len(lists) - 1
            ids = np.full(len(rows), np.iinfo(np.int64).max)  # null ids come last
            missing = np.ones(len(rows), bool)
            ids[known], missing[known] = named[known], False
            places = np.array([p for p, _ in lists[1:]], np.int64).reshape(width, len(rows))
            values = np.array([v for _, v in lists[1:]], np.int64).reshape(width, len(rows))
            block = Block(places, values)
            vectors = np.empty((len(rows), width), np.int64)
            vectors[places, np.arange(width)[:, None]] = values  # the lists hold whole vectors, dealt apart
            most = float(np.abs(values).astype(float).max(initial=0))
            place = {r: i for i, r in enumerate(rows.tolist())}
            asked, names = right.column("row").to_pylist(), right.column("id").to_pylist()
            queries = right.column("v").combine_chunks().flatten().to_numpy().reshape(right.num_rows, width)
            if most * np.abs(queries).astype(float).sum(1).max() > SAFE:
                raise ValueError("scores may not fit 64 bits")
            barred = np.array([place.get(r, -1) for r in asked])
            for s in range(0, len(asked), together):
                for i, found in enumerate(block.candidates(queries[s:s + together], k, barred[s:s + together]), s):
                    score = vectors[found] @ queries[i]  # final scores, in integers
                    best = np.lexsort((ids[found], -score))[:k]
                    out["query_row"] += [asked[i]] * len(best)
                    out["query_id"] += [names[i]] * len(best)
                    out["vec_id"] += [None if missing[p] else int(ids[p]) for p in found[best]]
                    out["score"] += score[best].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return work


def top_k(table: DataFrame, queries: str = "id % 100 = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024, per_block: int = 1 << 17, per_chunk: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row the ``k`` rows of highest inner product of whole components.

    ``queries`` is a condition on ``id``; candidates are all rows but the query's own.  Each block of the index answers
    each chunk of about ``per_chunk`` queries by its own ``k`` best, found by reading its sorted lists; the best of all
    blocks are ranked, of which Spark keeps ``k`` per task before it shuffles them.

    Ties go to the smaller id, null last.  Rows of equal id are rows of their own: each is a query, and a candidate of
    the others.  Vectors that are null or hold nulls, NaN or infinities take no part; vectors meet only vectors of their
    length; scores that might not fit 64 bits raise an error.  Fewer than ``k`` candidates give fewer rows; an empty table
    gives an empty table.  Other columns are ignored, so their names cannot clash.
    """
    spark = table.sparkSession
    vectors = cut_lineage(whole_vectors(table, id_col, vector_col, scale).withColumn("id", F.col("id").cast("long"))
                          .withColumn("row", F.monotonically_increasing_id()))
    lists = cut_lineage(sorted_lists(vectors, per_block))
    asked = vectors.where(queries).withColumn("width", F.size("v"))
    chunks = asked.groupBy("width").agg(F.ceil(F.count("*") / F.lit(per_chunk)).alias("chunks"))
    blocks = lists.where("dim = -1").groupBy("width").agg(F.count("*").alias("blocks"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["width", "block", "chunk"]
    tiles = blocks.join(chunks, "width").agg(F.sum(F.col("blocks") * F.col("chunks"))).first()[0] or 1
    parts = int(min(tiles, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 16))
    left = lists.join(chunks, "width").withColumn("chunk", each("chunks")).drop("chunks").repartition(parts, *keys)
    right = (asked.join(chunks, "width").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks"))).join(blocks, "width")
             .withColumn("block", each("blocks")).select(*keys, "row", "id", "v").repartition(parts, *keys))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _search(k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id != c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query(SQL)
def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
