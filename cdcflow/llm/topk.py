"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights; a term is a component's position. Vectors and queries are dealt to blocks of bounded size,
and each pair of blocks (a cell) is one group: its task inverts the vectors into postings by term, lets every query row scatter
its weighted postings into a dense array of scores, takes the k best by partition selection, and the cells' winners are merged by query.
All pairs are scored, so results are exact; a cell holds vectors_per_block + queries_per_block rows however large the tables are.

Defined cases: rows without an id, and vectors that are null or hold null or non-finite components, take no part; shorter vectors are filled up with zeros;
ties go to the smaller id; a query's own row is no candidate, but another row that repeats its id is, and each query row of a repeated id has a
result of its own; no queries or no candidates give no rows; other columns aren't read. Scores must fit 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

MANY = 0.5  # postings of a term that more than this share of a block has are kept as a whole column


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null where a component is null or not finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    rows = column.combine_chunks()
    rows = rows if isinstance(rows, pa.Array) else pa.concat_arrays(rows.chunks)
    flat, ends = rows.flatten().to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
    out, sizes = np.zeros((len(rows), width), dtype=np.int64), np.diff(ends)
    at = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)
    out[np.repeat(np.arange(len(rows)), sizes), at] = flat
    return out


def score_cell(queries: np.ndarray, vectors: np.ndarray, step: int = 64):
    """Yields (first query, scores of step queries against all vectors), term at a time."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    kind = np.int32 if most < 2**31 else np.int64
    postings = []
    for t in range(vectors.shape[1]):
        ids = np.flatnonzero(vectors[:, t])
        ids = slice(None) if len(ids) > MANY * len(vectors) else ids
        postings.append((ids, vectors[ids, t].astype(kind)))
    for start in range(0, len(queries), step):
        part = queries[start : start + step].astype(kind)
        scores = np.zeros((len(part), len(vectors)), dtype=kind)
        for t, (ids, weights) in enumerate(postings):
            rows = np.flatnonzero(part[:, t])
            if len(weights) and len(rows):
                if isinstance(ids, slice):
                    scores[rows] += np.multiply.outer(part[rows, t], weights)
                else:
                    scores[np.ix_(rows, ids)] += np.multiply.outer(part[rows, t], weights)
        yield start, scores


def _cell_winners(k: int):
    schema = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score")])

    def best(cell: pa.Table) -> pa.Table:
        width = max(1, pc.max(pc.list_value_length(cell["q"])).as_py() or 1)
        asks = cell["asks"].to_numpy()
        ids, own, weights = cell["vec_id"].to_numpy(), cell["own"].to_numpy(), _matrix(cell["q"], width)
        order = np.argsort(ids[~asks], kind="stable")
        vec_ids, vec_own, vectors = ids[~asks][order], own[~asks][order], weights[~asks][order]
        asked, queries = list(zip(own[asks], ids[asks])), weights[asks]
        out: list[tuple] = []
        if len(vec_ids):
            for start, scores in score_cell(queries, vectors):
                for (query, query_id), row in zip(asked[start : start + len(scores)], scores):
                    n = min(len(row), k + 1)  # one more, as the query's own row may be among them
                    least = np.partition(row, len(row) - n)[len(row) - n]
                    above, ties = np.flatnonzero(row > least), np.flatnonzero(row == least)[:n]
                    found = np.concatenate([above, ties])  # ids ascend with the position, so the first ties win
                    found = found[vec_own[found] != query]
                    found = found[np.lexsort((found, -row[found].astype(np.int64)))][:k]
                    out.append((np.full(len(found), query), np.full(len(found), query_id), vec_ids[found], row[found]))
        columns = [np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in range(4)]
        return pa.table([pa.array(c) for c in columns], schema=schema)

    return best


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vectors_per_block: int = 2048, queries_per_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (vec_id, q: integer weights) with the highest inner product for each query."""
    # equal rows are told apart by a number, so that each row has a mark of its own
    rows = vectors.where("vec_id is not null and q is not null").groupBy("vec_id", "q").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("own", F.xxhash64("vec_id", "q", "copy"))
    rows = rows.select("vec_id", "own", "q", is_query.alias("asks"))
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).first()
    v_blocks, q_blocks = max(1, math.ceil(n / vectors_per_block)), max(1, math.ceil(n_queries / queries_per_block))
    block = lambda blocks: F.pmod("own", F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    given = rows.select("vec_id", "own", "q", F.lit(False).alias("asks"), block(v_blocks).alias("v"), every(q_blocks).alias("b"))
    asked = rows.where("asks").select("vec_id", "own", "q", "asks", every(v_blocks).alias("v"), block(q_blocks).alias("b"))
    cells = given.unionByName(asked).groupBy("v", "b")
    won = cells.applyInArrow(_cell_winners(k), "query long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return won.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("q"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.own <> b.own WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
