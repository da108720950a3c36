"""Exact top-k search by block-at-a-time pruning over quantised vectors.

Vectors are dealt into groups by the nearest of a few pivots (large ones in parts of GROUP_ROWS), so that a group's
vectors lie together; in a task they are ordered by halving along the widest dimension and cut into blocks of BLOCK_ROWS.
A block keeps, for each of its dimensions ("terms"), the least and largest weight, and its forward index: the dense
rows. A query's blocks are ordered by the sum of the terms' largest contributions; blocks are scored through their
forward indexes in that order until no block's bound can reach the query's k-th score.

A query first searches its own group, which gives a floor for its k-th score. It then goes only to groups whose own
bound reaches that floor, and takes the floor with it. Tasks are groups by cells of at most QUERY_CELL queries, so memory
is bounded whatever the numbers of vectors and queries; groups' bounds come to the driver GROUPS_AT_ONCE at a time; the
lists meet in a window that keeps k rows a query. Which pivots are taken changes the work, never the result. Where
vectors point evenly in all directions no bound can prune, and every query is scored against every vector.

Scores are exact integers: sums that may pass 2^53 are taken in integers of any length. A score beyond a long is given
as the nearest long, in the order of its true value.

Cases: null vectors and vectors with null or non-finite components take no part; rows with a null vec_id can be no
query's result and are left out; shorter vectors count as padded with zeros; repeated vec_ids are candidates each, but
never for the query with their own id; ties go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

BLOCK_ROWS = 128
GROUP_ROWS = 16_384
QUERY_CELL = 4096
GROUPS_AT_ONCE = 4096
#: Pivots at most, and vectors for a pivot at least.
PIVOTS, PIVOT_ROWS = 64, 4096
K = 5
SCALE = 256
_FOUND = "query_id long, vec_id long, score long, above boolean, exact string"


def quantised(x: Column) -> Column:
    """Whole numbers, as doubles, which hold them exactly."""
    return F.transform(x, lambda v: F.when(F.abs(v.cast("double")) < float(1 << 53), F.floor(v.cast("double") * SCALE).cast("double")).otherwise(v.cast("double") * SCALE))


def usable(x: Column) -> Column:
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def block_order(vs: np.ndarray) -> np.ndarray:
    """Rows in an order in which every BLOCK_ROWS lie near each other: halves along the widest dimension."""
    out, todo = [], [np.arange(len(vs))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK_ROWS:
            out.append(rows)
            continue
        wide = np.argmax(np.ptp(vs[rows], axis=0))
        half = -(-len(rows) // (2 * BLOCK_ROWS)) * BLOCK_ROWS
        rows = rows[np.argsort(vs[rows, wide], kind="stable")]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def bounds(qs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Queries x blocks: the summed term maxima, and a hair more where they are rounded."""
    top = np.maximum(qs, 0) @ high.T + np.minimum(qs, 0) @ low.T
    slack = np.abs(qs) @ np.maximum(np.abs(low), np.abs(high)).T
    return np.where(slack < float(1 << 53), top, top + slack * 1e-9)


def exact_scores(qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, as doubles where these are exact, else as integers of any length."""
    if not len(qs) or not len(rows) or np.abs(qs).max() * np.abs(rows).max() * qs.shape[1] < float(1 << 53):
        return qs @ rows.T
    whole = np.vectorize(int, otypes=[object])
    return whole(qs) @ whole(rows).T


def search(qid: np.ndarray, qs: np.ndarray, floor: list, vid: np.ndarray, vs: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], int, int]:
    """Each query's up to k best (score, vec_id) of these vectors that reach its floor (None: none), blocks scored and
    blocks in all."""
    order = np.argsort(vid, kind="stable")
    order = order[block_order(vs[order])]
    vid, vs = vid[order], vs[order]
    edges = list(range(0, len(vid), BLOCK_ROWS))
    low, high = (np.stack([f(vs[a : a + BLOCK_ROWS], axis=0) for a in edges]) for f in (np.min, np.max))
    most = bounds(qs, low, high)
    turns = np.argsort(-most, axis=1, kind="stable")
    best: list[list[tuple[int, int]]] = [[] for _ in qid]
    least = np.array([-np.inf if x is None else float(x) for x in floor])
    scored = 0
    for turn in range(turns.shape[1]):
        due = turns[:, turn]
        live = most[np.arange(len(qid)), due] >= least  # equal scores may win by a smaller vec_id
        if not live.any():
            break
        for b in np.unique(due[live]):
            who = np.flatnonzero(live & (due == b))
            rows, ids = vs[edges[b] : edges[b] + BLOCK_ROWS], vid[edges[b] : edges[b] + BLOCK_ROWS]
            s = exact_scores(qs[who], rows)
            scored += len(who)
            near = (s >= least[who, None]) & (qid[who, None] != ids[None, :])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                w, at = who[i], np.flatnonzero(near[i])
                if len(at) > k and s.dtype != object:  # the k best of a row, ties included
                    at = at[s[i, at] >= np.partition(s[i, at], len(at) - k)[len(at) - k]]
                best[w] = sorted([*best[w], *((int(s[i, j]), int(ids[j])) for j in at)], key=lambda x: (-x[0], x[1]))[:k]
                if len(best[w]) == k:
                    # A double just under an integer of any length: nothing that ties is lost.
                    least[w] = max(least[w], np.nextafter(float(best[w][-1][0]), -np.inf))
    return best, scored, len(qid) * len(edges)


def _rows(qid: np.ndarray, best: list[list[tuple[int, int]]]) -> pd.DataFrame:
    rows = [(int(q), v, s) for q, own in zip(qid, best, strict=True) for s, v in own]
    long = [max(-(1 << 63), min((1 << 63) - 1, s)) for _, _, s in rows]
    # Sorts like the number: digits of the score's distance from the least one.
    exact = [None if x == s else f"{s + (1 << 2200):0700d}" for x, (_, _, s) in zip(long, rows, strict=True)]
    above = [None if x == s else s > 0 for x, (_, _, s) in zip(long, rows, strict=True)]
    return pd.DataFrame({"query_id": pd.Series([r[0] for r in rows], dtype="int64"), "vec_id": pd.Series([r[1] for r in rows], dtype="int64"), "score": pd.Series(long, dtype="int64"), "above": pd.Series(above, dtype="object"), "exact": pd.Series(exact, dtype="object")})


def _cell(k: int):
    def run(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return _rows(np.zeros(0), [])
        dims = max(queries["v"].map(len).max(), vectors["v"].map(len).max())
        qid = queries["vec_id"].to_numpy()
        floor = queries["floor"].tolist() if "floor" in queries else [None] * len(qid)
        floor = [None if x is None or x != x else x for x in floor]
        return _rows(qid, search(qid, _matrix(queries["v"], dims), floor, vectors["vec_id"].to_numpy(), _matrix(vectors["v"], dims), k)[0])

    return run


def _nearest_pivot(pivots: list[list[float]]):
    def run(frames):
        for frame in frames:
            dims = max([*map(len, pivots), *frame["v"].map(len)])
            p = _matrix(pd.Series(pivots), dims)
            near = _matrix(frame["v"], dims) @ p.T - 0.5 * (p * p).sum(axis=1)
            yield frame.assign(p=near.argmax(axis=1).astype("int32"))

    return run


def _extremes(key, vectors: pd.DataFrame) -> pd.DataFrame:
    v = _matrix(vectors["v"], vectors["v"].map(len).max())
    return pd.DataFrame({"g": [key[0]], "low": [v.min(axis=0)], "high": [v.max(axis=0)]})


def _reached(groups: list[tuple[str, list[float], list[float]]]):
    """The groups, other than a query's own, whose bound reaches its floor."""

    def run(frames):
        names = np.array([g for g, _, _ in groups])
        for frame in frames:
            dims = max([*(len(x) for _, x, _ in groups), *frame["v"].map(len)])
            low, high = (_matrix(pd.Series([x[i] for x in groups]), dims) for i in (1, 2))
            short = np.array([len(x[1]) for x in groups])[:, None] <= np.arange(dims)  # padding is zero
            low[short], high[short] = np.minimum(low[short], 0), np.maximum(high[short], 0)
            most = bounds(_matrix(frame["v"], dims), low, high)
            q, g = np.nonzero((most >= frame["floor"].fillna(-np.inf).to_numpy()[:, None]) & (frame["g"].to_numpy()[:, None] != names[None, :]))
            yield frame.iloc[q].assign(g=names[g])

    return run


def grouped(vectors: DataFrame) -> DataFrame:
    """The vectors (vec_id, v, is_query) and their group g."""
    n = vectors.count()
    pivots = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(PIVOTS, n // PIVOT_ROWS))).select("v").collect()]
    if not pivots:
        return vectors.withColumn("g", F.lit("0"))
    near = written(vectors.mapInPandas(_nearest_pivot(pivots), "vec_id long, v array<double>, is_query boolean, p int"), "pivots")
    parts = near.groupBy("p").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("parts"))  # PIVOTS rows at most
    return near.join(F.broadcast(parts), "p").select("vec_id", "v", "is_query", F.concat_ws("-", "p", F.pmod(F.xxhash64("vec_id"), "parts")).alias("g"))


def _searched(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Results of queries (with g) in their groups, a cell of queries a task; a group's vectors go to its cells only."""
    cells = queries.groupBy("g").agg(F.ceil(F.count("*") / QUERY_CELL).cast("int").alias("cells"))
    queries = queries.join(cells, "g").withColumn("c", F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int"))
    base = base.join(cells, "g").select("vec_id", "v", "g", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("c"))
    queries, base = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (queries, base))
    return queries.groupBy("g", "c").cogroup(base.groupBy("g", "c")).applyInPandas(_cell(k), _FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of integer vectors (vec_id, v); the queries are the rows where is_query holds."""
    base = written(grouped(vectors.select("vec_id", F.col("v").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))), "groups")
    queries = base.where("is_query").select("vec_id", "v", "g")
    home = written(_searched(queries, base.select("vec_id", "v", "g"), k), "home")
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("above") == False, float("-inf")).otherwise(F.col("score").cast("double"))).alias("floor"))  # noqa: E712
    # A k-th score as a double may be rounded up: the floor lies a hair below.
    floors = floors.where(F.col("n") >= k).select("query_id", (F.col("floor") - F.abs("floor") * 1e-15).alias("floor"))
    out_ = written(queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "g", "floor"), "queries")
    groups = written(base.groupBy("g").applyInPandas(_extremes, "g string, low array<double>, high array<double>"), "bounds")
    found, after = [home], ""
    while part := groups.where(F.col("g") > after).orderBy("g").limit(GROUPS_AT_ONCE).collect():
        after = part[-1]["g"]
        away = written(out_.mapInPandas(_reached([(r["g"], r["low"], r["high"]) for r in part]), "vec_id long, v array<double>, g string, floor double"), "away")
        found.append(written(_searched(away, base.select("vec_id", "v", "g"), k), "found"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # Scores within a long have no exact string; those beyond one side of it go before or after them.
    side = F.when(F.col("above"), 1).when(~F.col("above"), -1).otherwise(0)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(side), F.desc("score"), F.desc("exact"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP10_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
