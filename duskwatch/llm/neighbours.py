"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits space by random directions at the median of a bounded sample; every vector goes down each tree to
a leaf. A query keeps one queue for all trees, ordered by the least margin by which a branch was missed, and takes
the best leaves from it. Leaves and the queries that visit them meet by key, a large leaf in
several blocks; inside, candidates are ranked by their exact inner products in double precision.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, map_batches

TREES = 4
DEPTH = 4  # so 16 leaves in a tree
VISITS = 24  # leaves that a query takes from the shared queue
SAMPLE = 16_384  # vectors from which directions and medians are drawn
LEAST_SPLIT = 8  # sampled vectors below which a node is not split
BLOCK = 4_096  # rows of a leaf that are searched at once
SEED = 7


class Forest:
    """Trees as arrays: node i of a tree has its children at 2i + 1 and 2i + 2; a node without a direction is a leaf."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1] if len(sample) else 0
        self.trees = []
        for _ in range(trees):
            normals, cuts = {}, {}
            inside = {0: np.arange(len(sample))}
            for node in range(2**depth - 1):
                rows = inside.pop(node, np.zeros(0, np.int64))
                if len(rows) < LEAST_SPLIT:
                    continue
                normal = rng.normal(size=self.dim)
                # Towards the difference of two vectors, as far as the sample differs at all.
                a, b = sample[rows[rng.integers(len(rows))]], sample[rows[rng.integers(len(rows))]]
                length = np.linalg.norm(a - b)
                normal = (a - b) / length if length > 0 else normal / np.linalg.norm(normal)
                values = sample[rows] @ normal
                cut = float(np.median(values))
                if not (values > cut).any():
                    continue
                normals[node], cuts[node] = normal, cut
                inside[2 * node + 1], inside[2 * node + 2] = rows[values <= cut], rows[values > cut]
            self.trees.append((normals, cuts))

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(vectors), len(self.trees)), np.int32)
        for t, (normals, cuts) in enumerate(self.trees):
            todo = {0: np.arange(len(vectors))}
            while todo:
                node, rows = todo.popitem()
                if node not in normals or not len(rows):
                    out[rows, t] = node
                    continue
                right = vectors[rows] @ normals[node] > cuts[node]
                todo[2 * node + 1], todo[2 * node + 2] = rows[~right], rows[right]
        return out

    def visit(self, query: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves a query takes: branches of all trees wait in one queue, those missed by least first."""
        queue = [(-np.inf, t, 0) for t in range(len(self.trees))]
        heapq.heapify(queue)
        found = []
        while queue and len(found) < visits:
            missed, t, node = heapq.heappop(queue)
            normals, cuts = self.trees[t]
            while node in normals:
                margin = float(query @ normals[node]) - cuts[node]
                near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(missed, abs(margin)), t, far))
                node = near
            found.append((t, node))
        return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that take part: not null, not empty, no null or non-finite component, not zero."""
    v = column(vector_col)
    rows = vectors.select(column(id_col).alias("id"), v.cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", *,
    trees: int = TREES, depth: int = DEPTH, visits: int = VISITS, sample: int = SAMPLE, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (same columns) the ``k`` nearest found among ``vectors``, itself left out by id.

    score is the exact inner product in double precision; ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without an id, nor vectors of another length than the most frequent one of the sample. Every
    other row is indexed. Of equal vectors only the k + 1 smallest ids can be among a query's k
    nearest, so only those are searched. A query that finds fewer than k in its leaves takes them all from all leaves. Rows alike count once.
    """
    spark = vectors.sparkSession
    all_rows = usable(vectors, id_col, vector_col).filter(F.col("id").isNotNull())
    drawn = all_rows.select("v", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(sample).collect()
    sizes = [len(r["v"]) for r in drawn]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    forest = Forest(np.array([r["v"] for r in drawn if len(r["v"]) == dim], float).reshape(-1, max(dim, 1)), trees, depth, seed)
    sent = spark.sparkContext.broadcast(forest)
    fitting = all_rows.filter(F.size("v") == dim)
    alike = Window.partitionBy("v").orderBy("id")
    distinct = fitting.distinct().withColumn("__n", F.row_number().over(alike)).filter(F.col("__n") <= k + 1).drop("__n")
    id_type = vectors.schema[id_col].dataType.simpleString()

    def index(batch):
        for i in range(0, batch.num_rows, 2_048):
            part = batch.slice(i, 2_048)
            leaves = sent.value.leaves(_matrix(part.column(1), dim))
            n, t = leaves.shape
            rows = pa.array(np.repeat(np.arange(n), t))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(leaves.ravel()), part.column(0).take(rows), part.column(1).take(rows)], names=["tree", "leaf", "id", "v"])

    indexed = cut_lineage(map_batches(distinct, index, f"tree int, leaf int, id {id_type}, v array<double>"))
    sizes_of = cut_lineage(indexed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))

    def visiting(batch):
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            found = [sent.value.visit(q, visits) for q in _matrix(part.column(1), dim)]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            tree, leaf = ([f[j] for each in found for f in each] for j in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), part.column(0).take(rows), part.column(1).take(rows)], names=["tree", "leaf", "query_id", "q"])

    asked = usable(queries, id_col, vector_col).filter(F.col("id").isNotNull() & (F.size("v") == dim)).distinct()
    visits_of = map_batches(asked, visiting, f"tree int, leaf int, query_id {id_type}, q array<double>")

    def searched(asking: DataFrame) -> DataFrame:
        """The k best of each query in each block that it visits, merged."""
        left = indexed.join(sizes_of, ["tree", "leaf"]).select("tree", "leaf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "v")
        right = asking.join(sizes_of, ["tree", "leaf"]).select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "q")
        rank = lambda key, rows, asks: rank_block(rows, asks, dim, k)
        parts = left.groupBy("tree", "leaf", "block").cogroup(right.groupBy("tree", "leaf", "block")).applyInArrow(rank, f"query_id {id_type}, vec_id {id_type}, score double")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return parts.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = cut_lineage(searched(visits_of))
    # Leaves may hold fewer than k rows in all; such queries search every leaf of the first tree, which holds every row.
    met = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("met"))
    short = asked.join(met, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("met", F.lit(0)) < k).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    short = cut_lineage(short)
    if short.isEmpty():
        return found
    everywhere = short.withColumn("tree", F.lit(0)).join(sizes_of.filter("tree = 0").select("tree", "leaf"), "tree")
    again = searched(everywhere.select("tree", "leaf", "query_id", "q"))
    return found.join(short, "query_id", "left_anti").unionByName(again)


def rank_block(rows: pa.Table, asks: pa.Table, dim: int, k: int) -> pa.Table:
    """The k nearest of ``rows`` (id, v) for each of ``asks`` (query_id, q); queries are taken some hundreds at a time."""
    ids, names = rows.column("id").to_numpy() if rows.num_rows else np.zeros(0), asks.column("query_id").to_numpy() if asks.num_rows else np.zeros(0)
    query_ids, vec_ids, scores = [], [], []
    if len(ids) and len(names):
        v = _matrix(rows.column("v").combine_chunks(), dim)
        q = _matrix(asks.column("q").combine_chunks(), dim)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        for i in range(0, len(names), 256):
            near = q[i : i + 256] @ v.T
            near[names[i : i + 256, None] == ids[None, :]] = -np.inf
            for j, row in enumerate(near):
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    some = np.flatnonzero(row >= least)  # with ties at the k-th place
                else:
                    some = np.arange(len(row))
                some = some[np.argsort(-row[some], kind="stable")][:k]
                some = some[row[some] > -np.inf]
                query_ids.append(np.full(len(some), names[i + j]))
                vec_ids.append(ids[some])
                # Summed in one order whatever the block, so a pair's score doesn't depend on where it met.
                scores.append(np.array([float((v[s] * q[i + j]).sum()) for s in some]))
    columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((query_ids, names.dtype if len(names) else np.int64), (vec_ids, ids.dtype if len(ids) else np.int64), (scores, float))]
    return pa.table({"query_id": pa.array(columns[0], asks.schema.field("query_id").type), "vec_id": pa.array(columns[1], rows.schema.field("id").type), "score": pa.array(columns[2], pa.float64())})
