"""Near duplicates among embeddings by collision counting on projections.

Each unit vector is projected on ``LINES`` random lines. Two vectors at cosine t differ on a
line by a normal variable of deviation sqrt(2 - 2t), so their chance to lie within a window
around each other is known, and so is the number of lines on which a pair at the threshold
does, with all but a stated share. The vectors are sorted along the first line and cut into
slabs, and every slab's projections are sorted on every line. Slabs whose ends lie within the
first line's window meet: a query's window on a line is a run of the other slab's sorted
projections, found by two binary searches, and its members are the difference of two prefix
sets of that order. Members are counted over the lines in bit-sliced counters, 64 vectors an
operation; pairs that reach the count are verified in double precision on the original vectors.

Equal vectors are one node with a weight, so copies are never listed as pairs; a block hands
on sums of links and a spanning forest, not links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; vectors of different lengths never link (each length is a run of its own);
repeated rows link with each other; a null ``vec_id`` names a component only if it has no
other (and then null); an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelens.llm.graph import components, spanning
from notelens.llm.scratch import Scratch
from notelens.llm.vectors import matrix, takes_part

COSINE = 0.95
LINES = 32
#: Share of pairs at the threshold that the count, and the first line's window, may miss.
MISSED = 1e-6
FIRST_MISSED = 6e-5
#: A slab has an eighth of the rows, but so many at least and at most, and at most so many bytes.
SLABS, LEAST_SLAB, MOST_SLAB, MOST_BYTES = 8, 1024, 16384, 8 << 20
#: Rows of a slab that are counted at a time, and queries that meet them.
TILE, QUERIES = 1024, 512
#: A window's half width, as deviations of a pair at the threshold.
WIDTH = 1.5


def _tail(p: float, least: int) -> float:
    return sum(math.comb(LINES, k) * p**k * (1 - p) ** (LINES - k) for k in range(least, LINES + 1))


def calibrated(cosine: float) -> tuple[float, int, float]:
    """Half width of a window, collisions asked for, and the half width that no pair's first line may exceed."""
    deviation = math.sqrt(max(2 - 2 * cosine, 1e-6))
    within = math.erf(WIDTH / math.sqrt(2))
    count = max(k for k in range(LINES + 1) if _tail(within, k) >= 1 - MISSED)
    low, high = 0.0, 12.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) > FIRST_MISSED else (low, mid)
    return WIDTH * deviation, count, high * deviation


def prefix_sets(order: np.ndarray) -> np.ndarray:
    """Row k: the set of the first k of ``order`` (positions below its length), a bit each."""
    n = len(order)
    out = np.zeros((n + 1, (n + 63) // 64), np.uint64)
    out[np.arange(1, n + 1), order >> 6] = np.uint64(1) << (order & 63).astype(np.uint64)
    return np.bitwise_or.accumulate(out, axis=0, out=out)


def counted(sets: list[np.ndarray], least: int) -> np.ndarray:
    """Bits that are set in ``least`` or more of the sets: full adders on bit-sliced counters, then a comparison."""
    levels: list[list[np.ndarray]] = [[]]
    for s in sets:
        levels[0].append(s)
        at = 0
        while len(levels[at]) == 3:
            a, b, c = levels[at]
            both = a ^ b
            levels[at] = [both ^ c]
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append((a & b) | (both & c))
            at += 1
    planes, carry = [], None
    for held in levels:
        rows = held + ([carry] if carry is not None else [])
        carry = None
        if len(rows) == 3:
            a, b, c = rows
            planes.append(a ^ b ^ c)
            carry = (a & b) | ((a ^ b) & c)
        elif len(rows) == 2:
            planes.append(rows[0] ^ rows[1])
            carry = rows[0] & rows[1]
        else:
            planes.append(rows[0] if rows else np.zeros_like(sets[0]))
    if carry is not None:
        planes.append(carry)
    if least >> len(planes):
        return np.zeros_like(sets[0])
    more, level = np.zeros_like(sets[0]), np.full_like(sets[0], ~np.uint64(0))
    for bit in range(len(planes) - 1, -1, -1):
        if least >> bit & 1:
            level &= planes[bit]
        else:
            more |= level & planes[bit]
            level &= ~planes[bit]
    return more | level


class Tile:
    """Rows of a slab with their projections (a row for each line) sorted on every line."""

    def __init__(self, lines: np.ndarray):
        order = np.argsort(lines, axis=1, kind="stable")
        self.sorted = np.take_along_axis(lines, order, axis=1)
        self.sets = [prefix_sets(o) for o in order]

    def collisions(self, queries: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries (columns) and rows that lie in the query's window on ``least`` or more lines."""
        windows = []
        for line, sets, q in zip(self.sorted, self.sets, queries, strict=True):
            windows.append(sets[np.searchsorted(line, q + half, side="right")] ^ sets[np.searchsorted(line, q - half)])
        bits = np.unpackbits(counted(windows, least).view(np.uint8), axis=1, bitorder="little")
        i, j = np.nonzero(bits)
        return i, j


def _block_links(left: dict, right: dict, same: bool, half: float, count: int, first: float, cosine: float):
    """Positions of linked pairs of two slabs."""
    n = right["lines"].shape[1]
    for t in range(0, n, TILE):
        part = slice(t, min(t + TILE, n))
        ends = right["lines"][0, part][[0, -1]]  # slabs are sorted on the first line
        low, high = np.searchsorted(left["lines"][0], [ends[0] - first, ends[1] + first])
        if same:
            high = min(high, part.stop)  # each pair once
        if low >= high:
            continue
        tile = Tile(right["lines"][:, part])
        for at in range(int(low), int(high), QUERIES):
            i, j = tile.collisions(left["lines"][:, at : min(at + QUERIES, int(high))], half, count)
            i, j = i + at, j + t
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                ok = np.einsum("ij,ij->i", left["vectors"][x], right["vectors"][y]) / (left["norms"][x] * right["norms"][y]) >= cosine
                if ok.any():
                    yield x[ok], y[ok]


def _links(nodes: DataFrame, dim: int, cosine: float, scratch: Scratch, tag: str) -> DataFrame:
    """Kind 0: node, links. Kind 1: node, other, of a forest within each block. From ``node, weight, vector``."""
    half, count, first = calibrated(cosine)
    n = nodes.count()
    slabs = n // max(1, min(max(n // SLABS, LEAST_SLAB), MOST_SLAB, MOST_BYTES // (8 * dim))) + 1
    lines = np.random.default_rng(dim).standard_normal((dim, LINES))

    def projected(v: np.ndarray) -> np.ndarray:
        return v @ lines / np.linalg.norm(v, axis=1, keepdims=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(projected(matrix(batch.column("vector"), dim))[:, 0])], ["node", "weight", "vector", "first"])

    kind = nodes.schema["vector"].dataType.elementType.simpleString()
    placed = nodes.mapInArrow(place, f"node long, weight long, vector array<{kind}>, first double")
    cut = scratch.write(placed.repartitionByRange(slabs, "first").withColumn("slab", F.spark_partition_id()), f"placed-{tag}")

    def gather(table: pa.Table) -> pa.Table:
        on_line = table.column("first").to_numpy()
        table = table.take(pa.array(np.argsort(on_line, kind="stable"))).combine_chunks()
        v = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        packed = (table.column("node").to_numpy(), table.column("weight").to_numpy(), v)
        return pa.table([table.column("slab")[:1], pa.array([on_line.min()]), pa.array([on_line.max()]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["slab", "low", "high", "nodes", "weights", "vectors"])

    packed = scratch.write(cut.groupBy("slab").applyInArrow(gather, "slab int, low double, high double, nodes binary, weights binary, vectors binary"), f"slabs-{tag}")
    scratch.drop(f"placed-{tag}")
    # slabs are ranges of the first line: each meets itself and those after it that begin within the window
    ends = packed.select("slab", "low").orderBy("slab").toArrow()  # two numbers for each slab
    names, lows = ends.column("slab").to_numpy(), ends.column("low").to_numpy()

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab, high in zip(batch.column("slab").to_numpy(), batch.column("high").to_numpy(), strict=True):
                met = names[np.searchsorted(names, slab) : max(np.searchsorted(lows, high + first, side="right"), np.searchsorted(names, slab) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), slab, np.int32)), pa.array(met)], ["left", "right"])

    near = packed.select("slab", "high").mapInArrow(partners, "left int, right int")
    of_slab = ["nodes", "weights", "vectors"]
    blocks = near.join(packed.select(F.col("slab").alias("left"), *[F.col(c).alias(f"left_{c}") for c in of_slab]), "left")
    blocks = blocks.join(packed.select(F.col("slab").alias("right"), *[F.col(c).alias(f"right_{c}") for c in of_slab]), "right")
    of = np.float32 if kind == "float" else np.float64

    def side(row: dict, name: str) -> dict:
        v = np.frombuffer(row[f"{name}_vectors"], of).astype(np.float64).reshape(-1, dim)
        return {
            "nodes": np.frombuffer(row[f"{name}_nodes"], np.int64),
            "weights": np.frombuffer(row[f"{name}_weights"], np.int64),
            "vectors": v,
            "norms": np.linalg.norm(v, axis=1),
            "lines": np.ascontiguousarray(projected(v).T),
        }

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                left, same = side(row, "left"), row["left"] == row["right"]
                right = left if same else side(row, "right")
                m = len(left["nodes"])
                both = left["nodes"] if same else np.concatenate([left["nodes"], right["nodes"]])
                links, label = np.zeros(len(both), np.int64), np.arange(len(both))
                for x, y in _block_links(left, right, same, half, count, first, cosine):
                    far = y if same else y + m
                    np.add.at(links, x, right["weights"][y])
                    np.add.at(links, far, left["weights"][x])
                    label = spanning(label[x], label[far], len(both))[label]
                some, hung = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * len(some) + [1] * len(hung), pa.int32()),
                        pa.array(np.concatenate([both[some], both[hung]])),
                        pa.array(np.concatenate([links[some], both[label[hung]]])),
                    ],
                    ["kind", "node", "value"],
                )

    out = scratch.write(blocks.mapInArrow(meet, "kind int, node long, value long"), f"links-{tag}")
    scratch.drop(f"slabs-{tag}")
    return out


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "near-vectors")
    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("node", F.when(takes_part(F.col("embedding")), F.xxhash64("embedding")))
    nodes = scratch.write(ids.filter("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.first("embedding").alias("vector")), "nodes")
    parts = [_links(nodes.filter(F.size("vector") == dim), dim, cosine, scratch, str(dim)) for dim in sorted(r[0] for r in nodes.select(F.size("vector")).distinct().collect())]
    named = ids.join(nodes.select("node", "weight"), "node", "left").select("vec_id", "node", "weight")
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        linked = found.filter("kind = 0").groupBy("node").agg(F.sum("value").alias("links"))
        joined = components(found.filter("kind = 1").select(F.col("node").alias("a"), F.col("value").alias("b")), scratch, "components")
        named = named.join(linked, "node", "left").join(joined, "node", "left")
    else:
        named = named.withColumns({"links": F.lit(0), "root": F.lit(None).cast("long")})
    named = scratch.write(named.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("root", "node", F.xxhash64("vec_id", F.lit("alone"))).alias("root"), F.col("node").isNotNull().alias("part")), "named")
    scratch.keep("named")
    # vectors that take no part are their own roots, so that no key is shared by all of them
    least = named.filter("part").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = named.join(least, "root", "left").select("vec_id", "n_links", F.when(F.col("part"), F.col("least")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
