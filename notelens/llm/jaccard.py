"""Exact Jaccard self-join on word shingles with adaptive multi-match prefixes.

A document's set is its distinct shingles of ``WORDS`` words. Documents of equal sets are one
node. Shingles have one global order: by an estimate of how many documents hold them, rarest
first, then by hash. If two sets of similarity t share tokens, their first k common ones lie in
both sets' prefixes of n - ceil(t n) + k tokens; so each document chooses k by the candidates
that its prefix is estimated to bring (longer prefix, more matches asked for), and a pair is a
candidate if it shares as many prefix tokens as the smaller k of the two, and as many as its
sizes ask for beyond what the rest can still give. Candidates are verified on whole sets.

Only components are wanted, so pairs inside known components are never listed: a first turn
verifies one pair for each node, with the node it shares most prefix tokens with among the
least nodes of its tokens; a second turn takes the remaining candidates, which lie between
components, and verifies them all. Those that meet only at tokens of few nodes are listed as
pairs. Nodes that meet at a token of many nodes and several components form groups (connected
by such tokens); a group's nodes are dealt into blocks of a bounded size, and each pair of
blocks is verified as a whole, so no pair within a group is ever a row.

The frequency estimate is a sketch over every shingle of every document, with a counter for
16 words of input up to a fixed number of counters. A node's name is a 64-bit hash of its
set, a token's a hash of the shingle.

Defined results: null and empty texts have no shingles and link with nothing; repeated rows
are linked with each other if they have words; a null ``doc_id`` never names a component
unless it has no other; an empty table gives no rows; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.llm.graph import components, spanning
from notelens.llm.scratch import Scratch, filter_bits
from notelens.llm.spans import hashed_words, mix, random_words

WORDS = 5
#: Similarity NUM / DEN or more.
NUM, DEN = 3, 4
SKETCH_BITS, SKETCH_SLICES = (16, 25), 64
#: Counters stop here.
MOST_COUNTED = 65535
#: Matches a document may ask for.
MATCHES = np.array([1, 2, 4, 8, 16, 32])
#: Prefix tokens of one bucket, about; rows that a task holds before it hands them on.
BUCKET_TOKENS, HELD_TOKENS = 100_000, 1_000_000
#: Postings in one packed row.
PACKED = 1 << 16
#: Nodes of one token up to which its pairs are listed; nodes of a block.
SMALL_RUN, BLOCK_NODES = 32, 1024

_PLACE = random_words(WORDS, 7)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = hashed_words(column, True)
    total = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        total += h[k : k + len(total)] * _PLACE[k]
    total = mix(total)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(total[a : b - WORDS + 1])
        elif b > a:
            yield mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def node_of(shingles: np.ndarray) -> int:
    name = mix(shingles ^ np.uint64(0x5BD1E995C2B2AE3D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles))
    return int(mix(name).view(np.int64)[0])


def _place_of(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u2").tobytes(), 1)


def _unpacked_counts(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), "<u2")


def _scan(docs: DataFrame, bits: int) -> DataFrame:
    """Kind 0: doc_id, text_hash, node, n of each document. Kind 1: this task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, np.uint32)
        names = ["kind", "doc_id", "text_hash", "node", "n", "slice", "counts"]
        for batch in batches:
            nodes, sizes, held = [], [], []
            for s in shingle_sets(batch.column("text")):
                nodes.append(node_of(s) if len(s) else None)
                sizes.append(len(s))
                held.append(s)
            if held:
                np.add.at(sketch, _place_of(np.concatenate(held), bits), np.uint32(1))
            k = len(nodes)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        parts = [_packed(np.minimum(p, MOST_COUNTED)) for p in np.split(sketch, SKETCH_SLICES)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.mapInArrow(run, "kind int, doc_id long, text_hash long, node long, n long, slice int, counts binary").withColumn("part", F.spark_partition_id())


def _sum_sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """Sums the tasks' sketches in a tree of up to 64 parts a step; the result has a fixed size."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(_unpacked_counts(b).astype(np.int64) for b in table.column("counts").to_pylist())
        return pa.table([table.column("slice")[:1], table.column("part")[:1], pa.array([_packed(np.minimum(total, MOST_COUNTED))], pa.binary())], names=["slice", "part", "counts"])

    most = parts.agg(F.max("part")).first()[0]
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / 64).cast("int"))
        parts = parts.groupBy("slice", "part").applyInArrow(add, "slice int, part int, counts binary")
        most = (most or 0) // 64
        if most == 0:
            break
    out = np.zeros((SKETCH_SLICES, (1 << bits) // SKETCH_SLICES), np.uint16)
    for r in parts.collect():  # none where the table has no partitions
        out[r["slice"]] = _unpacked_counts(r["counts"])
    return out.ravel()


def _rest(n):
    """ceil(t n): common tokens that a partner of a set of n has at least."""
    return (NUM * n + DEN - 1) // DEN


def prefix_of(shingles: np.ndarray, sketch: np.ndarray, noise: float) -> tuple[np.ndarray, int]:
    """The chosen prefix as order keys (estimate, then hash), and the number in MATCHES of its matches."""
    estimate = sketch[_place_of(shingles, int(len(sketch)).bit_length() - 1)].astype(np.uint64)
    keys = np.sort((estimate << np.uint64(48)) | (mix(shingles) >> np.uint64(16)))
    n = len(keys)
    partners = np.cumsum(np.maximum(0.0, (keys >> np.uint64(48)).astype(np.float64) - 2 * noise - 1))
    choices = MATCHES[_rest(n) >= MATCHES]
    ends = n - _rest(n) + choices
    chosen = int(np.argmin(choices + partners[ends - 1] / choices))
    return keys[: ends[chosen]], chosen


def _postings(docs: DataFrame, sketch, noise: float, buckets: int) -> DataFrame:
    """Prefix tokens by bucket of the token: packed arrays of token, node, and size with matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        held: list[tuple[np.ndarray, int, int]] = []
        rows = 0

        def hand_on() -> pa.RecordBatch:
            token = np.concatenate([t for t, _, _ in held]) & np.uint64((1 << 48) - 1)
            sizes = [len(t) for t, _, _ in held]
            node = np.repeat(np.array([x for _, x, _ in held], np.int64), sizes)
            shape = np.repeat(np.array([x for _, _, x in held], np.uint32), sizes)
            bucket = ((token >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low = token.astype(np.uint32)
            out = [(b, low[i].tobytes(), node[i].tobytes(), shape[i].tobytes()) for b in range(buckets) if len(i := order[edges[b] : edges[b + 1]])]
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "tokens", "nodes", "shapes"])

        for batch in batches:
            for s in shingle_sets(batch.column("text")):
                if len(s):
                    keys, chosen = prefix_of(s, counts, noise)
                    held.append((keys, node_of(s), len(s) << 4 | chosen))
                    rows += len(keys)
            if rows >= HELD_TOKENS:
                yield hand_on()
                held, rows = [], 0
        if held:
            yield hand_on()

    return docs.select("text").mapInArrow(run, "bucket int, tokens binary, nodes binary, shapes binary")


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes allow the similarity."""
    low, high = np.minimum(a, b) >> 4, np.maximum(a, b) >> 4
    return DEN * low.astype(np.int64) >= NUM * high.astype(np.int64)


def _counted(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> list[pa.Array]:
    """Pairs and how often each stands there."""
    order = np.lexsort((b, a))
    a, b, sa, sb = a[order], b[order], sa[order], sb[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return [pa.array(a[first]), pa.array(b[first]), pa.array(sa[first].astype(np.int64)), pa.array(sb[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(a))))]


PAIR = ["a", "b", "shape_a", "shape_b", "shared"]
PAIRS = "a long, b long, shape_a long, shape_b long, shared long"


def _runs(postings: DataFrame) -> DataFrame:
    """Kind 0: pairs of a token's least node with each other one. Kind 1: tokens of several nodes, packed."""

    def run(table: pa.Table) -> pa.Table:
        token = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("tokens").to_pylist()])
        node = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()])
        shape = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("shapes").to_pylist()])
        order = np.argsort(token, kind="stable")
        t = token[order]
        several = np.zeros(len(t), bool)
        several[1:] |= t[1:] == t[:-1]
        several[:-1] |= t[1:] == t[:-1]
        order = order[several]
        order = order[np.lexsort((node[order], token[order]))]
        t, x, s = token[order], node[order], shape[order]
        for _ in range(2):  # copies of a document count once; then tokens of one node go
            keep = np.ones(len(t), bool)
            if _ == 0:
                keep[1:] = (t[1:] != t[:-1]) | (x[1:] != x[:-1])
            else:
                same = t[1:] == t[:-1]
                keep = np.append(False, same) | np.append(same, False) if len(t) else keep
            t, x, s = t[keep], x[keep], s[keep]
        start = np.ones(len(t), bool)
        start[1:] = t[1:] != t[:-1]
        lead = np.maximum.accumulate(np.where(start, np.arange(len(t)), 0)) if len(t) else np.empty(0, np.int64)
        pick = np.flatnonzero(~start)
        pick = pick[_fits(s[pick], s[lead[pick]])]
        pairs = _counted(x[lead[pick]], x[pick], s[lead[pick]], s[pick])
        k, cuts = len(pairs[0]), range(0, len(t), PACKED)
        m, bucket = len(cuts), table.column("bucket")[0].as_py()
        return pa.table(
            [pa.array([0] * k + [1] * m, pa.int32()), pa.array([bucket] * (k + m), pa.int32())]
            + [pa.concat_arrays([p.cast(pa.int64()), pa.nulls(m, pa.int64())]) for p in pairs]
            + [pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array([v[c : c + PACKED].tobytes() for c in cuts], pa.binary())]) for v in (t, x, s)],
            names=["kind", "bucket", *PAIR, "tokens", "nodes", "shapes"],
        )

    return postings.groupBy("bucket").applyInArrow(run, f"kind int, bucket int, {PAIRS}, tokens binary, nodes binary, shapes binary")


def _unpacked(runs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                token, node, shape = (np.frombuffer(r[k], kind) for k, kind in (("tokens", np.uint32), ("nodes", np.int64), ("shapes", np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), r["bucket"], np.int32)), pa.array(token.astype(np.int64)), pa.array(node), pa.array(shape.astype(np.int64))], ["bucket", "token", "node", "shape"])

    return runs.filter("kind = 1").select("bucket", "tokens", "nodes", "shapes").mapInArrow(run, "bucket int, token long, node long, shape long")


def _between(posted: DataFrame) -> DataFrame:
    """Kind 0: pairs of nodes in different components that meet at a token of few nodes. Kind 1: nodes (a) of a
    token (b) of many nodes and several components."""

    def run(table: pa.Table) -> pa.Table:
        token, node, shape, root = (table.column(c).to_numpy() for c in ("token", "node", "shape", "root"))
        order = np.lexsort((node, token))
        token, node, shape, root = token[order], node[order], shape[order], root[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        mixed = np.maximum.reduceat(root, start) != np.minimum.reduceat(root, start) if len(start) else np.empty(0, bool)
        parts = [[np.empty(0, np.int64)] * 4]
        for m in np.unique(size[mixed & (size <= SMALL_RUN)]).tolist():
            i, j = np.triu_indices(m, 1)
            first = start[mixed & (size == m)][:, None]
            i, j = (first + i).ravel(), (first + j).ravel()
            ok = (root[i] != root[j]) & _fits(shape[i], shape[j])
            i, j = i[ok], j[ok]
            parts.append([node[i], node[j], shape[i], shape[j]])
        pairs = _counted(*(np.concatenate(c) for c in zip(*parts, strict=True)))
        large = np.repeat(mixed & (size > SMALL_RUN), size) if len(size) else np.empty(0, bool)
        k, many = len(pairs[0]), int(large.sum())
        name = mix(token[large].astype(np.uint64) + np.uint64(table.column("bucket")[0].as_py() << 32)).view(np.int64)
        more = [node[large], name, *[np.zeros(many, np.int64)] * 3]
        return pa.table([pa.array([0] * k + [1] * many, pa.int32()), *(pa.concat_arrays([p.cast(pa.int64()), pa.array(x)]) for p, x in zip(pairs, more, strict=True))], names=["kind", *PAIR])

    return posted.groupBy("bucket").applyInArrow(run, f"kind int, {PAIRS}")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right."""
    out = np.zeros((len(left), len(right)), np.int32)
    a, b = np.concatenate(left), np.concatenate(right)
    row, column = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(np.unique(a), np.unique(b))
    keep_a, keep_b = np.isin(a, shared), np.isin(b, shared)
    a, row, b, column = a[keep_a], row[keep_a], b[keep_b], column[keep_b]
    row, column = row[np.argsort(a, kind="stable")], column[np.argsort(b, kind="stable")]
    edge_a, edge_b = np.searchsorted(np.sort(a), shared).tolist() + [len(a)], np.searchsorted(np.sort(b), shared).tolist() + [len(b)]
    for k in range(len(shared)):
        i, j = row[edge_a[k] : edge_a[k + 1]], column[edge_b[k] : edge_b[k + 1]]
        if len(i) == 1:
            out[i[0], j] += 1
        else:
            out[i[:, None], j] += 1
    return out


def _blocks(scratch: Scratch, met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within groups of nodes that meet at tokens of many nodes, as a forest of each pair of blocks."""
    joined = components(met, scratch, "groups")
    members = met.select(F.col("a").alias("node")).distinct().join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    members = scratch.write(members, "members")
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("blocks"))
    dealt = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(sets, "node")
    turns = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    turns = turns.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "shingles")

    def run(table: pa.Table) -> pa.Table:
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        i = table.column("i")[0].as_py()
        left = np.flatnonzero(block == i)
        right = left if table.column("j")[0].as_py() == i else np.flatnonzero(block != i)
        label = np.arange(len(node))
        if len(left) and len(right):
            shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
            x, y = np.nonzero(DEN * shared >= NUM * (size[left][:, None] + size[right][None, :] - shared))
            label = spanning(left[x], right[y], len(node))
        hung = np.flatnonzero(label != np.arange(len(node)))
        return pa.table([pa.array(node[hung]), pa.array(node[label[hung]])], names=["a", "b"])

    return turns.groupBy("group", "i", "j").applyInArrow(run, "a long, b long")


def _asked(pairs: DataFrame) -> Column:
    """Shared prefix tokens that a similar pair has at least."""
    matches = F.array(*[F.lit(int(m)) for m in MATCHES])

    def size(shape: str) -> Column:
        return F.shiftright(F.col(shape), 4)

    def wanted(shape: str) -> Column:
        return F.element_at(matches, (F.col(shape).bitwiseAND(15) + 1).cast("int"))

    def beyond(shape: str) -> Column:
        return F.ceil(size(shape) * NUM / DEN) - wanted(shape)

    overlap = F.ceil((size("shape_a") + size("shape_b")) * NUM / (NUM + DEN))
    return F.greatest(F.least(wanted("shape_a"), wanted("shape_b")), overlap - F.greatest(beyond("shape_a"), beyond("shape_b")))


def _wanted_filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each wanted node's hash; as many as the nodes ask for, up to a fixed size."""
    bits = filter_bits(nodes.count())
    words = nodes.select(F.pmod("node", F.lit(1 << bits)).alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    found = words.toArrow()  # 2**23 rows at most
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles`` of the wanted nodes."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bits.value, set()
        size = 32 * len(wanted)
        for batch in batches:
            names, sets = [], []
            for s in shingle_sets(batch.column("text")):
                if len(s):
                    name = node_of(s)
                    bit = name % size
                    if int(wanted[bit >> 5]) >> (bit & 31) & 1 and name not in seen:
                        seen.add(name)
                        names.append(name)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    found = docs.select("text").mapInArrow(run, "node long, shingles binary")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar."""
    with_b = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(DEN * shared >= NUM * (len(x) + len(y) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document."""
    return near_duplicate_rows(docs).select("doc_id", "n_shingles", "component_id")


def text_hash(text: Column) -> Column:
    """What tells texts of one ``doc_id`` apart."""
    return F.xxhash64(text.cast("string"))


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, component_hash``: each row, and the least row of its component."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash(F.col("text")).alias("text_hash"))
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = min(max((words // 16).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    scanned = scratch.write(_scan(docs, bits), "scan")
    base = scanned.filter("kind = 0").select("doc_id", "text_hash", "node", "n")
    sketch = _sum_sketch(scanned.filter("kind = 1").select("slice", "part", "counts"), bits)
    tokens = base.agg(F.sum("n")).first()[0] or 0
    buckets = min(1 << 30, tokens * (DEN - NUM) // DEN // BUCKET_TOKENS + 1)

    runs = scratch.write(_runs(_postings(docs, spark.sparkContext.broadcast(sketch), float(sketch.mean()), buckets)), "runs")
    led = runs.filter("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("shape_a").alias("shape_a"), F.first("shape_b").alias("shape_b"))
    likely = led.filter(F.col("shared") * 2 >= _asked(led)).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
    likely = scratch.write(likely.select("a", "b"), "likely")
    first = scratch.write(_verified(likely, _sets(docs, _ends(likely))), "first")
    joined = components(first, scratch, "first-components")

    posted = _unpacked(runs).join(joined, "node", "left").select("bucket", "token", "node", "shape", F.coalesce("root", "node").alias("root"))
    between = scratch.write(_between(posted), "between")
    pairs = between.filter("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("shape_a").alias("shape_a"), F.first("shape_b").alias("shape_b"))
    # a hash clash within one document may hide one shared token, so one less is let through
    rest = scratch.write(pairs.filter(F.col("shared") + 1 >= _asked(pairs)).select("a", "b"), "rest")
    met = between.filter("kind = 1").select("a", "b")
    more = []
    if not rest.isEmpty() or not met.isEmpty():
        sets = scratch.write(_sets(docs, _ends(rest).unionByName(met.select(F.col("a").alias("node"))).distinct()), "sets")
        more = [_verified(rest, sets), *([] if met.isEmpty() else [_blocks(scratch, met, sets)])]
    if more:
        links = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        for m in more:
            links = links.unionByName(m)
        joined = components(links, scratch, "components")

    # documents without words are their own roots, so that no key is shared by all of them
    alone = F.when(F.col("n") == 0, F.xxhash64("doc_id", "text_hash", F.lit("alone")))
    named = base.join(joined, "node", "left").select("doc_id", "text_hash", "n", F.coalesce("root", "node", alone).alias("root"))
    named = scratch.write(named, "named")
    scratch.keep("named")
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    least = named.filter("n > 0").groupBy("root").agg(F.min(row).alias("least"))

    def of_component(name: str) -> Column:
        return F.when(F.col("n") > 0, F.col(f"least.{name}")).otherwise(F.col(name))

    return named.join(least, "root", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), of_component("doc_id").alias("component_id"), of_component("text_hash").alias("component_hash"))
