"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample; every row is dealt to a leaf. A query walks the tree
with a priority queue of bins, the bin whose centre has the largest inner product first, and
visits leaves until they hold as many rows as calibration asks for: visits are widened, over
calibration queries whose neighbours are known from all rows by brute force, until the recall
wanted is reached. Where that is fewer rows than neighbours asked for, the walk goes on until
it isn't. Neighbouring leaves are one task's group of rows; a query goes to a group once, with
the leaves that it visits there, and meets the rows of these alone. Groups that are too large,
or that many queries visit, are split among tasks.

Scores are inner products in double precision on the original vectors, summed in one order
for every row, so equal vectors tie exactly and the smaller vec_id comes first.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or
are not of the length most rows have, and rows without a vec_id take no part; rows that
repeat a vec_id are candidates each, are never candidates of their own id's query, and the
least of their vectors is the query; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.llm.scratch import Scratch
from notelens.llm.vectors import matrix, takes_part

NEIGHBOURS = 20
#: Rows that the tree is fitted on, at most (it has a leaf for 8 of them at most); queries that calibrate it, at most.
SAMPLE, CALIBRATION = 32768, 128
RECALL = 0.95
BRANCHES = 8
#: Rows of a leaf, about; rows and queries of one task's group, about: at least, and a share of all rows.
LEAF_ROWS, BLOCK, GROUPS = 128, 2000, 2048


class Tree:
    """Centres of each node's branches; leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.random = np.random.default_rng(5)
        self.leaves = 0
        self.root = self._grow(sample, max(1, len(sample) // leaves))

    def _grow(self, rows: np.ndarray, small: int):
        if len(rows) <= max(small, BRANCHES) or (rows == rows[:1]).all():
            self.leaves += 1
            return self.leaves - 1
        centres = rows[self.random.choice(len(rows), min(BRANCHES, -(-len(rows) // small)), replace=False)]
        for _ in range(8):
            own = nearest(rows, centres)
            centres = np.array([rows[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        own = nearest(rows, centres)
        if len(np.unique(own)) == 1:
            self.leaves += 1
            return self.leaves - 1
        used = np.unique(own)
        return centres[used], [self._grow(rows[own == k], small) for k in used]

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                out[at] = node
                continue
            own = nearest(rows[at], node[0])
            stack += [(child, at[own == k]) for k, child in enumerate(node[1])]
        return out

    def visits(self, query: np.ndarray, held: np.ndarray, least: int) -> list[int]:
        """Leaves in the order of the best bin first, until they hold ``least`` rows by ``held``."""
        queue, found, order, rows = [(0.0, 0, self.root)], [], 0, 0
        while queue and rows < least:
            _, _, node = heapq.heappop(queue)
            if isinstance(node, int):
                found.append(node)
                rows += int(held[node])
                continue
            for score, child in zip((node[0] @ query).tolist(), node[1], strict=True):
                order += 1
                heapq.heappush(queue, (-score, order, child))
        return found


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, leaf: np.ndarray | None = None, asked: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: positions, ids and exact scores of its ``k`` best rows, own id left out.

    With ``leaf``, the rows' leaves in ascending order, a query meets rows of the leaves that it has ``asked`` for.
    """
    if leaf is not None:
        names, first = np.unique(leaf, return_index=True)
        edges = np.append(first, len(leaf))
        wanted = np.array([np.isin(names, a) for a in asked])
    for at in range(0, len(queries), 64):
        q, own = queries[at : at + 64], query_ids[at : at + 64]
        if leaf is None:
            rough = q @ rows.T
        else:
            rough = np.full((len(q), len(rows)), -np.inf)
            for n in range(len(names)):
                met = np.flatnonzero(wanted[at : at + 64, n])
                rough[met, edges[n] : edges[n + 1]] = q[met] @ rows[edges[n] : edges[n + 1]].T
        rough[own[:, None] == ids[None, :]] = -np.inf
        n = min(k, rows.shape[0])
        least = np.partition(rough, rough.shape[1] - n, axis=1)[:, -n]
        scale = 1e-9 * np.maximum(1.0, np.abs(least))
        for i in range(len(q)):
            near = np.flatnonzero((rough[i] >= least[i] - scale[i]) & np.isfinite(rough[i])) if np.isfinite(least[i]) else np.flatnonzero(np.isfinite(rough[i]))
            score = (rows[near] * q[i]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            yield at + i, near[best], ids[near[best]], score[best]


def _best(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of several packed lists of one query: ids, scores, leaves."""
    ids, scores, leaves = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("ids", np.int64), ("scores", np.float64), ("leaves", np.int32)))
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best], leaves[best]


LISTS = "query_id long, ids binary, scores binary, leaves binary"


def _lists(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["query_id", "ids", "scores", "leaves"])


def brute_force(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, tree: Tree | None, k: int = NEIGHBOURS) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Exact neighbours of a few given queries among all rows, with the leaves that these lie in."""
    shared = rows.sparkSession.sparkContext.broadcast((query_ids, queries, tree))
    dim = queries.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, bins = shared.value
        held: dict[int, tuple] = {}
        for batch in batches:
            v, ids = matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
            leaf = bins.leaf_of(v) if bins else np.zeros(len(v), np.int32)
            for i, near, found, score in top(q, own, v, ids, k):
                a, b, c = (np.concatenate(x) for x in zip(held.get(i, (ids[:0], score[:0], leaf[:0])), (found, score, leaf[near]), strict=True))
                best = np.lexsort((a, -b))[:k]
                held[i] = a[best], b[best], c[best]
        yield from _lists([(int(own[i]), *(x.tobytes() for x in found)) for i, found in held.items()]).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        return _lists([(table.column("query_id")[0].as_py(), *(x.tobytes() for x in _best(table, k)))])

    found = rows.mapInArrow(scan, LISTS).groupBy("query_id").applyInArrow(merge, LISTS).collect()  # a row for each given query
    return {r["query_id"]: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["scores"], np.float64), np.frombuffer(r["leaves"], np.int32)) for r in found}


def calibrate(tree: Tree, known: dict, vectors: dict[int, np.ndarray], held: np.ndarray, recall: float) -> int:
    """The fewest rows that a walk has to visit for the wanted share of the known neighbours."""
    needed: list[np.ndarray] = []
    for query, (_, _, leaves) in known.items():
        order = tree.visits(vectors[query], held, int(held.sum()) + 1)
        rows = np.zeros(len(held), np.int64)
        rows[order] = np.cumsum(held[order])
        needed.append(rows[leaves])
    every = np.sort(np.concatenate([np.zeros(0, np.int64), *needed]))
    return int(every[max(0, math.ceil(recall * len(every)) - 1)]) if len(every) else 0


def search(rows: DataFrame, every: int, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows whose vec_id is divisible by ``every``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(takes_part(F.col("v")) & F.col("vec_id").isNotNull())
    common = valid.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = common["dim"], common["count"]
    valid = valid.filter(F.size("v") == dim)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()
    points, named = matrix(sample.column("v").combine_chunks(), dim), sample.column("vec_id").to_pylist()
    tree = Tree(points, min(max(n // LEAF_ROWS, 2 * BRANCHES), max(1, len(points) // 8)))
    shared = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf_of(matrix(batch.column("v"), dim)))], ["vec_id", "v", "leaf"])

    kind = valid.schema["v"].dataType.simpleString()
    dealt = scratch.write(valid.mapInArrow(deal, f"vec_id long, v {kind}, leaf int"), "dealt")
    held = np.zeros(tree.leaves, np.int64)
    for r in dealt.groupBy("leaf").count().collect():  # a row for each leaf
        held[r["leaf"]] = r["count"]
    vectors = {named[i]: points[i] for i in range(min(CALIBRATION, len(named)))}
    known = brute_force(valid, np.array(list(vectors)), np.array(list(vectors.values())), tree, k)
    visited = calibrate(tree, known, vectors, held, recall)
    # leaves that follow each other, some `block` rows in all
    block = max(BLOCK, n // GROUPS)
    group_of = ((np.cumsum(held) - held) // block).astype(np.int32)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at, groups, leaves = batch.column("own").to_numpy(), [], [], []
            for i, q in enumerate(matrix(batch.column("v"), dim)):
                found = np.sort(np.array(shared.value.visits(q, held, max(visited, k + int(own[i]))), np.int32))
                for part in np.split(found, np.flatnonzero(np.diff(group_of[found])) + 1):
                    at.append(i)
                    groups.append(group_of[part[0]])
                    leaves.append(part)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns[:2]), pa.array(groups, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], ["vec_id", "v", "group", "leaves"])

    # rows of a query's own id are no candidates
    asked = valid.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    met = scratch.write(asked.mapInArrow(walk, f"vec_id long, v {kind}, group int, leaves array<int>"), "walked")
    of_leaf = F.broadcast(spark.createDataFrame(list(zip(range(tree.leaves), group_of.tolist(), strict=True)), "leaf int, group int"))
    placed = dealt.join(of_leaf, "leaf")
    parts = placed.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("row_parts"))
    parts = parts.join(met.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("query_parts")), "group")
    parts = F.broadcast(parts)  # a row for each group, a leaf or more

    def salt(parts_of: str):
        return F.pmod(F.xxhash64("vec_id"), F.col(parts_of)).cast("int")

    def all_of(parts_of: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts_of) - 1))

    key = ["group", "row_part", "query_part"]
    left = met.join(parts, "group").withColumn("query_part", salt("query_parts")).withColumn("row_part", all_of("row_parts")).select(*key, "vec_id", "v", "leaves")
    right = placed.join(parts, "group").withColumn("row_part", salt("row_parts")).withColumn("query_part", all_of("query_parts")).select(*key, "vec_id", "v", "leaf")

    def meet(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return _lists([])
        candidates = candidates.sort_by("leaf").combine_chunks()
        own, ids = queries.column("vec_id").to_numpy(), candidates.column("vec_id").to_numpy()
        q, v = (matrix(t.column("v").combine_chunks(), dim) for t in (queries, candidates))
        flat, sizes = queries.column("leaves").combine_chunks().flatten().to_numpy(), queries.column("leaves").combine_chunks().value_lengths().to_numpy()
        leaves = np.split(flat, np.cumsum(sizes)[:-1])
        empty = np.empty(0, np.int32).tobytes()
        return _lists([(int(own[i]), found.tobytes(), score.tobytes(), empty) for i, _, found, score in top(q, own, v, ids, k, candidates.column("leaf").to_numpy(), leaves)])

    def rank(table: pa.Table) -> pa.Table:
        ids, scores = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("ids", np.int64), ("scores", np.float64)))
        best = np.lexsort((ids, -scores))[:k]
        m = len(best)
        return pa.table([pa.array([table.column("query_id")[0].as_py()] * m, pa.int64()), pa.array(np.arange(1, m + 1, dtype=np.int32)), pa.array(ids[best]), pa.array(scores[best])], names=["query_id", "rank", "vec_id", "score"])

    lists = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, LISTS)
    return lists.groupBy("query_id").applyInArrow(rank, "query_id long, rank int, vec_id long, score double")
