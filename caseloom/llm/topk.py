"""Exact top-k inner-product search: ball-tree branch and bound over shards.

Rows are dealt by the nearest of at most MOST_PIVOTS pivots, vectors of the table that a hash draws; a pivot's rows
make a ball around it, and are cut into shards of bounded size by a hash, as are queries into blocks. First each query
probes one shard of the ball whose pivot has the highest product with it: the kth score that it finds there is a floor.
The inner product with any row of a ball is bounded by that with its pivot and by its radius; only shards of balls whose
bound reaches the floor are searched, and their rows go only to the blocks with such queries. In a task, one block and
one shard, the nodes of the shard's ball tree are bounded for the whole block at once, subtrees below a query's floor
are cut off, and each query visits its remaining leaves in descending order of the inner-product upper bound, until the
bound falls below its current kth score. ``Plan.pairs`` tells how many pairs of query and shard were left.

Scores are exact integers. Rows whose id or vector is null, or whose vector holds a null or non-finite
component, take no part; neither do candidates of another length than the query, or with the query's own
id. Repeated ids each count as candidates; rows that repeat id and vector are counted before they are dealt, so
that no shard outgrows its size. Where the query's own id repeats with other vectors, its least vector asks. Ties
go to the smaller id. Scores must fit 64 bits. An empty table, or one without queries, gives no row. Columns but id and
vector are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, discard, materialize, schema_with

LEAF = 64
#: Pivots at most: a pass over the rows takes as many products a row, and the driver and each task hold them.
MOST_PIVOTS = 2048
#: Whole numbers up to this are exact as doubles.
EXACT = float(1 << 53)


class BallTree:
    """Over whole-number vectors, halved along the widest axis down to leaves of at most LEAF rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.arange(len(ids))
        self.first, self.last, self.child = [0], [len(ids)], [0]
        centres, radii = [], []
        at = 0
        while at < len(self.first):
            low, high = self.first[at], self.last[at]
            v = vectors[order[low:high]].astype(float)
            centre = v.mean(axis=0)
            away = v - centre
            centres.append(centre)
            radii.append(float(np.sqrt((away * away).sum(axis=1).max())))
            if high - low > LEAF:
                axis = int(away.var(axis=0).argmax()) if v.shape[1] else 0
                if v.shape[1]:
                    order[low:high] = order[low:high][np.argsort(v[:, axis], kind="stable")]
                middle = (low + high) // 2
                self.child[at] = len(self.first)
                self.first += [low, middle]
                self.last += [middle, high]
                self.child += [0, 0]
            at += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds, queries x nodes, of the inner product with any row of a node; a little above, for rounding."""
        q = queries.astype(float)
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        slack = 1e-9 * (1 + np.abs(q) @ np.abs(self.centres).T + size * self.radii)
        return q @ self.centres.T + size * self.radii + slack


class Best:
    """The k best of each query so far: score, then smaller id."""

    def __init__(self, n: int, k: int, kind: type, floor: np.ndarray) -> None:
        self.lowest = -np.inf if kind is float else np.iinfo(np.int64).min
        self.score = np.full((n, k), self.lowest, kind)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor.astype(kind)

    def least(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[at], self.score[at, -1])

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores (queries at x ids) that are allowed."""
        good = allowed & (score >= self.least(at)[:, None])
        some = np.flatnonzero(good.any(axis=1))
        if not len(some):
            return
        rows, k = at[some], self.score.shape[1]
        score = np.concatenate([self.score[rows], np.where(good[some], score[some], self.lowest)], axis=1)
        both = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((both, -score if score.dtype == float else ~score), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(both, order, 1)


def search_tree(tree: BallTree, own: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Improve best by a tree's rows other than each query's own."""
    bound = tree.bounds(queries)
    child = np.array(tree.child)
    alive = np.ones(bound.shape, bool)
    for node in range(len(child)):  # a parent comes before its children
        alive[:, node] &= bound[:, node] >= best.floor
        if child[node]:
            alive[:, child[node]] = alive[:, child[node] + 1] = alive[:, node]
    leaves = np.flatnonzero(child == 0)
    bound = np.where(alive[:, leaves], bound[:, leaves], -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    kind = best.score.dtype
    vectors, asked = tree.vectors.astype(kind), queries.astype(kind)
    open_ = np.arange(len(queries))
    for turn in range(len(leaves)):
        leaf = order[open_, turn]
        upper = bound[open_, leaf]
        go = (upper > -np.inf) & (upper >= best.least(open_))
        open_, leaf = open_[go], leaf[go]
        if not len(open_):
            return
        by = np.argsort(leaf, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            at, node = open_[part], leaves[leaf[part[0]]]
            low, high = tree.first[node], tree.last[node]
            ids = tree.ids[low:high]
            best.offer(at, asked[at] @ vectors[low:high].T, ids, ids != own[at][:, None])


def searched(asks: pd.DataFrame, have: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, vec_id and score of the k best rows of have (id, v, n copies) for each query (own, q, floor)."""
    out = []
    size = have["v"].map(len)
    for length, mine in asks.groupby(asks["q"].map(len)):
        there = have[size == length]
        if not len(there):
            continue
        stack = lambda v, length=length: np.stack(v.to_numpy()).astype(np.int64).reshape(len(v), length)
        copies = np.minimum(there["n"].to_numpy(), k)
        vectors, queries = stack(there["v"]), stack(mine["q"])
        most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * length
        tree = BallTree(np.repeat(there["id"].to_numpy(), copies), np.repeat(vectors, copies, axis=0))
        floor = mine["floor"].to_numpy(float, na_value=-np.inf)
        best = Best(len(mine), k, float, floor) if most < EXACT else Best(len(mine), k, np.int64, np.maximum(floor - np.abs(floor) * 1e-9, -float(1 << 62)))
        search_tree(tree, mine["own"].to_numpy(), queries, best)
        row, place = np.nonzero(best.score > best.lowest)
        out.append(pd.DataFrame({"query_id": mine["own"].to_numpy()[row], "vec_id": best.id[row, place], "score": best.score[row, place].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Pivots:
    """Pivots by the length of their vectors. A length without one has a ball around zero."""

    def __init__(self, vectors: list[list[int]]) -> None:
        distinct = sorted({tuple(v) for v in vectors})
        self.n = len(distinct)
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {len(v) for v in distinct}:
            at = [i for i, v in enumerate(distinct) if len(v) == length]
            self.of[length] = np.array(at), np.array([distinct[i] for i in at], float).reshape(len(at), length)

    def balls(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the balls of vectors of this length, and their centres."""
        return self.of.get(length, (np.array([self.n + length]), np.zeros((1, length))))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ball of each row, and its distance from the centre."""
        at, centres = self.balls(v.shape[1])
        near = ((centres * centres).sum(axis=1) - 2 * (v @ centres.T)).argmin(axis=1)
        away = v - centres[near]
        return at[near], np.sqrt((away * away).sum(axis=1))

    def bounds(self, q: np.ndarray, radius: dict[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Balls that hold rows, the products of their centres with the queries, and upper bounds of any row's product."""
        at, centres = self.balls(q.shape[1])
        held = np.array([i in radius for i in at.tolist()], bool)
        at, centres = at[held], centres[held]
        reach = np.array([radius[i] for i in at.tolist()])
        size = np.sqrt((q * q).sum(axis=1))[:, None]
        product = q @ centres.T
        return at, product, product + size * reach + 1e-9 * (1 + np.abs(q) @ np.abs(centres).T + size * reach)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each length, and their vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    for length in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == length)
        yield at, column.take(pa.array(at)).flatten().to_numpy().astype(float).reshape(len(at), length)


@dataclass(frozen=True)
class Plan:
    """What search prepares: queries and candidates in their balls, and the pairs of query and shard that are left."""

    queries: DataFrame
    candidates: DataFrame
    pairs: DataFrame
    n_shards: int


def in_balls(rows: DataFrame, vector: str, pivots: Broadcast) -> DataFrame:
    """rows with ball and away, its centre's distance."""
    place = rows.columns.index(vector)
    schema = schema_with(rows, "ball int, away double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ball, away = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, v in by_length(b.column(place)):
                ball[at], away[at] = pivots.value.nearest(v)
            yield beside(b.columns, [pa.array(ball), pa.array(away)], schema)

    return rows.mapInArrow(run, schema)


def packed(sizes: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(ball, first block, blocks): balls of few queries share a block, those of more than most are cut."""
    out, block, held = [], 0, 0
    for ball, n in sorted(sizes.items()):
        if held and held + n > most:
            block, held = block + 1, 0
        blocks = -(-n // most)
        out.append((ball, block, blocks))
        held += n
        if blocks > 1:
            block, held = block + blocks, 0
    return out


def choices(queries: DataFrame, pivots: Broadcast, radius: dict[int, float], shards: dict[int, int], probe: bool) -> DataFrame:
    """own, q, floor, block and the shards (ball, part) that a query asks: one to probe, or all that may reach its floor."""
    schema = schema_with(queries, "asked array<struct<ball:int,part:int>>")
    q_at, floor_at = queries.columns.index("q"), queries.columns.index("floor")
    draw_at = queries.columns.index("draw")
    known = queries.sparkSession.sparkContext.broadcast((radius, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, shards = known.value
        for b in batches:
            floor = b.column(floor_at).to_numpy(zero_copy_only=False).astype(float)
            draw = b.column(draw_at).to_numpy()
            asked: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for at, q in by_length(b.column(q_at)):
                balls, product, bound = pivots.value.bounds(q, radius)
                if not len(balls):
                    continue
                if probe:
                    for row, ball in zip(at.tolist(), balls[product.argmax(axis=1)].tolist(), strict=True):
                        asked[row] = [{"ball": ball, "part": int(draw[row] % shards[ball])}]
                else:
                    low = np.where(np.isnan(floor[at]), -np.inf, floor[at])[:, None]
                    for row, here in zip(at.tolist(), bound >= low, strict=True):
                        asked[row] = [{"ball": ball, "part": p} for ball in balls[here].tolist() for p in range(shards[ball])]
            yield beside(b.columns, [pa.array(asked, pa.list_(pa.struct([("ball", pa.int32()), ("part", pa.int32())])))], schema)

    found = queries.mapInArrow(run, schema)
    return found.select("own", "q", "floor", "block", F.inline("asked"))


def met(asks: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of each block in each shard that it asks; rows go to such blocks alone."""
    keys = ["ball", "part", "block"]
    wanted = asks.select(*[F.col(c).alias(f"w_{c}") for c in keys]).distinct()
    have = candidates.join(wanted, (F.col("ball") == F.col("w_ball")) & (F.col("part") == F.col("w_part"))).select("id", "v", "n", *wanted.columns)
    run = lambda a, b: searched(a, b, k)
    return asks.groupBy(*keys).cogroup(have.groupBy(*wanted.columns)).applyInPandas(run, "query_id long, vec_id long, score long")


def prepare(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, k: int, scale: int, shard_rows: int, block_rows: int, most_pivots: int) -> Plan:
    spark = vectors.sparkSession
    good = vectors.where(F.col(id_col).isNotNull() & F.coalesce(usable(F.col(vector_col)), F.lit(False)))
    rows = good.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
    rows = materialize(rows.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")), "vectors")
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("v"), "v").limit(min(most_pivots, max(1, -(-n // shard_rows)))).select("v").collect()
    pivots = spark.sparkContext.broadcast(Pivots([r[0] for r in drawn]))
    dealt = materialize(in_balls(rows, "v", pivots), "balls")
    discard(rows)
    balls = {r["ball"]: r for r in dealt.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # one row a ball
    shards, radius = {b: -(-r["n"] // shard_rows) for b, r in balls.items()}, {b: r["radius"] for b, r in balls.items()}
    parts = F.broadcast(spark.createDataFrame([*shards.items()], "ball int, shards int"))
    candidates = dealt.join(parts, "ball").select("id", "v", "n", "ball", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int").alias("part"))

    queries = in_balls(dealt.where("asks").groupBy(F.col("id").alias("own")).agg(F.min("v").alias("q")), "q", pivots).withColumnRenamed("ball", "block_ball")
    sizes = {r["block_ball"]: r["count"] for r in queries.groupBy("block_ball").count().collect()}  # one row a ball
    blocks = F.broadcast(spark.createDataFrame(packed(sizes, block_rows), "block_ball int, first int, blocks int"))
    draw = F.pmod(F.xxhash64("own", F.lit("draw")), F.lit(1 << 30)).cast("int").alias("draw")
    queries = queries.join(blocks, "block_ball").select("own", "q", (F.col("first") + F.pmod(F.xxhash64("own", F.lit("block")), F.col("blocks"))).cast("int").alias("block"), draw)
    probes = choices(queries.withColumn("floor", F.lit(None).cast("double")), pivots, radius, shards, True)
    best = met(probes, candidates, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").cast("double").alias("least"))
    floors = best.select(F.col("query_id").alias("own"), F.when(F.col("found") == k, F.col("least")).alias("floor"))
    queries = materialize(queries.join(floors, "own", "left"), "queries")
    return Plan(queries, candidates, choices(queries, pivots, radius, shards, False), sum(shards.values()))


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    shard_rows: int = 4096,
    block_rows: int = 4096,
    most_pivots: int = MOST_PIVOTS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows."""
    plan = prepare(vectors, is_query, id_col, vector_col, k, scale, shard_rows, block_rows, most_pivots)
    found = met(plan.pairs, plan.candidates, k)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
