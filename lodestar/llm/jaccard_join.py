"""N-gram Jaccard join by a count-vector R-tree.

A document is the set of its distinct word n-grams, hashed to 64 bits. Two documents link when
``100 * intersection >= percent * union``. The elements of a set are hashed into ``GROUPS`` groups and
the counts by group are a point; the sum of the smaller coordinates of two points bounds their
overlap from above, and the same sum with the upper corner of an R-tree node bounds it for all points
below that node. Linked sets must share one of the first elements of a common order (a set of n needs only its
first n - ceil(percent n / 100) + 1), so documents meet by those in tasks; there the tree leaves few pairs, and those are
verified on the whole sets (of 64-bit hashes). No link is lost: bounds are never below the true overlap, and the order,
by hash with elements common to very many texts last, is the same for all sets.

Equal sets are one node. Nodes meet first by their smallest hash alone and link around the points nearest to the mean of
their group. Then they meet by all of their first elements, but only groups whose nodes are not yet all connected
look further, so a group of near copies of any size costs about one verified pair per member instead of all pairs.
A meeting carries a coarse point. What passes it is looked at again with a fine point, which has
more groups the larger the set (a fine point folds to a coarser one by adding coordinates).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import WordHashes, binaries, components, discard, durable, files, fits, shingles, slices, small, worker_cache

GROUPS = 32
#: Node ids of at most so many are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Texts of which common shingles are counted: one of so many; texts that hold one there, at least; shingles, at most (8 bytes each).
SHARE, MANY, COMMON = 16, 8, 1_000_000
#: Elements that a task keeps before it passes their counts on.
FLUSH = 500_000
#: Members of a group that one task looks at; larger groups are split into blocks, and each pair of blocks meets.
BLOCK = 20_000
#: Groups up to so many members emit every pair that passes the bound at once.
SMALL_GROUP = 4
#: Groups of fine points: so many for sets up to so many elements.
FINE = ((256, 512), (1024, 4096), (4096, 1 << 62))
#: Groups to which fine points are folded in trees.
TREE = 64
#: In the first later round, so many best candidates for each node and component; 16 times more in each next.
FIRST_LIST = 8

# Codes of group counts: exact up to 160, then steps of 4 %, always rounded up.
UPPER = np.array([*range(161), *np.ceil(160 * 1.04 ** np.arange(1, 94)).astype(int), 2**30, 2**30], dtype=np.int32)


def point(elements: np.ndarray, groups: int = GROUPS) -> bytes:
    """The coded counts by group of a set."""
    counts = np.bincount((elements & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return (counts if counts.max() <= 160 else np.searchsorted(UPPER, counts)).astype(np.uint8).tobytes()


def fine_point(elements: np.ndarray) -> bytes:
    return point(elements, next(g for g, most in FINE if len(elements) <= most))


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts with fewer groups: rows of counts, coordinates added."""
    return counts.reshape(len(counts), -1, groups).sum(axis=1)


def bound(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Upper bounds of the overlaps of pairs of fine points."""
    out = np.empty(len(left), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)]).reshape(-1, 2)
    for x, y in np.unique(sizes, axis=0):
        at, least = np.flatnonzero((sizes == (x, y)).all(axis=1)), min(x, y)
        a, b = (folded(UPPER[np.frombuffer(b"".join(side[i] for i in at), np.uint8)].reshape(len(at), -1), least) for side in (left, right))
        out[at] = np.minimum(a, b).sum(axis=1)
    return out


class CountTree:
    """Packed R-tree over count vectors: leaves of 64 points in order of size and first coordinates.

    A node keeps the upper corner of its points and their least and largest size.
    """

    LEAF = FAN = 64

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, percent: int):
        self.percent = percent
        spread = np.argsort(-counts.var(axis=0), kind="stable")[:2] if len(sizes) > 1 else np.array([0, 1])
        self.order = np.lexsort((counts[:, spread[1]], counts[:, spread[0]], sizes))
        self.sizes, self.counts = sizes[self.order], counts[self.order]
        self.levels = []
        low, high, top = self.sizes, self.sizes, self.counts
        while len(low) > self.LEAF:
            cut = np.arange(0, len(low), self.FAN)
            low, high, top = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(top, cut)
            self.levels.append((low, high, top))

    def _may(self, size: int, counts: np.ndarray, low, high, top) -> tuple[np.ndarray, np.ndarray]:
        overlap = np.minimum(top, counts).sum(axis=1)
        p = self.percent
        return (p * low <= 100 * size) & (100 * high >= p * size) & ((100 + p) * overlap >= p * (low + size)), overlap

    def query(self, size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of the input order) that may link with the point, and their overlap bounds."""
        rows = None
        for low, high, top in reversed(self.levels):
            rows = np.arange(len(low)) if rows is None else rows[rows < len(low)]
            rows = rows[self._may(size, counts, low[rows], high[rows], top[rows])[0]]
            rows = (rows[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        rows = np.arange(len(self.sizes)) if rows is None else rows[rows < len(self.sizes)]
        passed, overlap = self._may(size, counts, self.sizes[rows], self.sizes[rows], self.counts[rows])
        return self.order[rows[passed]], overlap[passed]


class Forest:
    """A tree over fine points folded to ``TREE`` groups; what it leaves is bounded again by the whole fine points."""

    def __init__(self, sizes: np.ndarray, points: list[bytes], percent: int):
        self.sizes, self.percent = sizes, percent
        length = np.array([len(x) for x in points])
        self.length, self.place = length, np.empty(len(points), np.int64)
        self.codes, coarse = {}, np.empty((len(points), TREE), np.int64)
        for g in np.unique(length):
            at = np.flatnonzero(length == g)
            self.place[at] = np.arange(len(at))
            self.codes[g] = np.frombuffer(b"".join(points[i] for i in at), np.uint8).reshape(len(at), g)
            for k in range(0, len(at), 1024):
                coarse[at[k : k + 1024]] = folded(UPPER[self.codes[g][k : k + 1024]], TREE)
        self.coarse, self.tree = coarse, CountTree(sizes, coarse, percent)

    def from_mean(self) -> np.ndarray:
        """Positions by their distance to the mean."""
        return np.argsort(np.abs(self.coarse - self.coarse.mean(axis=0)).sum(axis=1), kind="stable")

    def query(self, i: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions (``among`` those marked) that may link with position ``i``, and their overlap bounds."""
        hits, _ = self.tree.query(self.sizes[i], self.coarse[i])
        if among is not None:
            hits = hits[among[hits]]
        hits = hits[hits != i]
        overlap, own = np.empty(len(hits), np.int64), self.length[i]
        mine = UPPER[self.codes[own][self.place[i]]][None, :]
        for g in np.unique(self.length[hits]):
            at, least = np.flatnonzero(self.length[hits] == g), min(g, own)
            rows, x = self.codes[g][self.place[hits[at]]], folded(mine, least)
            for k in range(0, len(at), 1024):
                overlap[at[k : k + 1024]] = np.minimum(folded(UPPER[rows[k : k + 1024]], least), x).sum(axis=1)
        may = (100 + self.percent) * overlap >= self.percent * (self.sizes[hits] + self.sizes[i])
        return hits[may], overlap[may]


def name_of(elements: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).astype(np.int64))


def sets_of(width: int):
    """Arrow function: (node, elements), the name and the sorted hashes of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("words", WordHashes)
        for batch in slices(batches):
            found = [shingles(hashes.of((text or b"").lower().split()), width) for text in binaries(batch.column("text"))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(map(name_of, found), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["node", "elements"])

    return run


def counted_shingles(width: int):
    """Arrow function: (h, n), partial counts of the texts that hold each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept, size = worker_cache("words", WordHashes), [], 0

        def batch_of() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.empty(0, np.uint64), *kept]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in slices(batches):
            kept += [shingles(hashes.of((text or b"").lower().split()), width) for text in binaries(batch.column("text"))]
            size = sum(map(len, kept))
            if size >= FLUSH:
                yield batch_of()
                kept = []
        yield batch_of()

    return run


def common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that very many texts hold, at most ``COMMON`` of them.

    They are counted over one of ``SHARE`` texts and only order the elements of sets: any order finds all links, but
    with common elements last those who share no more than a passage or a line seldom meet.
    """
    part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARE)) == 0)
    many, found = MANY, durable(part.mapInArrow(counted_shingles(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MANY), "jaccard-common", files(rows.sparkSession, COMMON))
    while not fits(found.where(F.col("n") >= many), COMMON):
        many *= 2
    out = np.sort(found.where(F.col("n") >= many).select("h").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    discard(found)
    return out


def signatures_of(width: int, percent: int, common):
    """Arrow function: (doc_id, n, node, point, fine, first, prefix) of each text.

    ``first`` is the smallest hash; ``prefix`` the elements of which linked sets share one, common elements ordered last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = worker_cache("words", WordHashes), common.value
        for batch in slices(batches):
            n, node, points, fine, first, prefix = [], [], [], [], [], []
            for text in binaries(batch.column("text")):
                elements = shingles(hashes.of((text or b"").lower().split()), width)
                k = len(elements)
                n.append(k)
                node.append(name_of(elements) if k else None)
                points.append(point(elements))
                fine.append(fine_point(elements))
                first.append(int(elements[:1].view(np.int64)[0]) if k else None)
                if len(last) and k:
                    late = last[np.minimum(np.searchsorted(last, elements), len(last) - 1)] == elements
                    elements = np.concatenate([elements[~late], elements[late]]) if late.any() else elements
                prefix.append(elements[: k - -(-percent * k // 100) + 1 if k else 0].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefix])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), pa.array(first, pa.int64()), prefix],
                names=["doc_id", "n", "node", "point", "fine", "first", "prefix"],
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Whole groups of rows sorted by the first column: the columns and where groups begin, ends included."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = []
        for name in names:
            column = batch.column(name)
            if name == "point":
                data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
                now.append(data[column.offset * GROUPS : (column.offset + len(column)) * GROUPS].reshape(-1, GROUPS))
            elif name == "fine":
                fine = np.empty(len(column), object)
                fine[:] = column.to_pylist()
                now.append(fine)
            else:
                now.append(column.to_numpy(zero_copy_only=False))
        if kept is not None:
            now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
        starts = np.flatnonzero(np.concatenate([[True], now[0][1:] != now[0][:-1]]))
        if len(starts) > 1:
            yield [x[: starts[-1]] for x in now], starts
        kept = [x[starts[-1] :].copy() for x in now]
    if kept is not None:
        yield kept, np.array([0, len(kept[0])])


def _batch(kind: int, a: list, b: list) -> pa.RecordBatch:
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])


def meetings(percent: int):
    """Arrow function over (h, node, root, n, point) sorted by h: kind 0, pairs (a, b) of different roots whose coarse points may link, of groups of few; kind 1, (h, node) of larger groups that are in such pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h, node, root, n, code), starts in _groups(batches, ["h", "node", "root", "n", "point"]):
            a, b, gh, gn = [], [], [], []
            sizes = np.diff(starts)
            for k in range(2, SMALL_GROUP + 1):
                first = starts[:-1][sizes == k]
                for x in range(k if len(first) else 0):
                    for y in range(x + 1, k):
                        i, j = first + x, first + y
                        overlap = np.minimum(UPPER[code[i]], UPPER[code[j]]).sum(axis=1)
                        may = ((100 + percent) * overlap >= percent * (n[i] + n[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (root[i] != root[j])
                        a.append(np.minimum(node[i[may]], node[j[may]]))
                        b.append(np.maximum(node[i[may]], node[j[may]]))
            for s, k in zip(starts[:-1][sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
                _, own = np.unique(node[s : s + k], return_index=True)
                own = own + s
                size, counts = n[own], UPPER[code[own]]
                _, of, many = np.unique(root[own], return_inverse=True, return_counts=True)
                if len(many) < 2:
                    continue
                tree, may = CountTree(size, counts, percent), np.zeros(len(own), bool)
                for c in np.flatnonzero(of != np.argmax(many)):  # every pair of different roots has a side outside the main root
                    hits = tree.query(size[c], counts[c])[0]
                    hits = hits[of[hits] != of[c]]
                    may[hits] = True
                    may[c] |= len(hits) > 0
                if may.any():
                    gh.append(np.full(may.sum(), h[s]))
                    gn.append(node[own[may]])
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
                yield _batch(0, [pairs[:, 0]], [pairs[:, 1]])
            if gh:
                yield _batch(1, gh, gn)

    return run


def fine_pairs(percent: int):
    """Arrow function over (a, b, total, left, right): the pairs (a, b) whose fine points may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):  # counts are eight bytes a coordinate there
            overlap = bound(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            may = (100 + percent) * overlap >= percent * batch.column("total").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return run


def first_links(percent: int):
    """Arrow function over (h, node, n, fine) sorted by h: pairs (a, b) to verify, about one for each member of a group.

    Each node in order of its distance to the mean takes those that may link with it out of the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, node, n, fine), starts in _groups(batches, ["h", "node", "n", "fine"]):
            a, b = [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                _, own = np.unique(node[s:e], return_index=True)
                own = own + s
                ids, forest, alive = node[own], Forest(n[own], list(fine[own]), percent), np.ones(len(own), bool)
                for c in forest.from_mean():
                    if alive[c]:
                        alive[c] = False
                        hits = forest.query(c, alive)[0]
                        a.append(np.minimum(ids[hits], ids[c]))
                        b.append(np.maximum(ids[hits], ids[c]))
                        alive[hits] = False
            yield _batch(0, a, b)

    return run


def later_links(percent: int, most: int):
    """Arrow function over (h, node, root, n, fine) sorted by h: pairs of different roots, the ``most`` best for each node and root; kind 1 where some are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (h, node, root, n, fine), starts in _groups(batches, ["h", "node", "root", "n", "fine"]):
            a, b, gh, gn = [], [], [], []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                _, own = np.unique(node[s:e], return_index=True)
                own = own + s
                ids, size = node[own], n[own]
                _, of, many = np.unique(root[own], return_inverse=True, return_counts=True)
                if len(many) < 2:
                    continue
                forest, left = Forest(size, list(fine[own]), percent), False
                main = np.argmax(many)
                for c in np.flatnonzero(of != main):
                    other = (of != of[c]) & (of == main)
                    other[c + 1 :] |= of[c + 1 :] != of[c]
                    hits, overlap = forest.query(c, other)
                    if not len(hits):
                        continue
                    order = np.lexsort((ids[hits], -overlap / (size[hits] + size[c]), of[hits]))
                    hits = hits[order]
                    first = np.flatnonzero(np.concatenate([[True], of[hits][1:] != of[hits][:-1]]))
                    rank = np.arange(len(hits)) - np.repeat(first, np.diff([*first, len(hits)]))
                    left |= bool((rank >= most).any())
                    hits = hits[rank < most]
                    a.append(np.minimum(ids[hits], ids[c]))
                    b.append(np.maximum(ids[hits], ids[c]))
                if left:
                    gh.append(np.full(len(own), h[s]))
                    gn.append(ids)
            if a:
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
                yield _batch(0, [pairs[:, 0]], [pairs[:, 1]])
            if gh:
                yield _batch(1, gh, gn)

    return run


LINKS = "kind int, a long, b long"


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) of ``docs``, one for each input row.

    Words are runs of non-blank ASCII-whitespace-separated bytes with A-Z lower-cased. A null or blank
    text has an empty set, links with nothing and is its own component. Rows with equal sets link;
    repeated rows stay, each with the same result. A null id takes no part: its row has its n_shingles
    and a null component. An empty table gives no rows. Other columns of the input are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(rows, width))
    signed = durable(rows.mapInArrow(signatures_of(width, percent, common), "doc_id long, n long, node long, point binary, fine binary, first long, prefix array<long>"), "jaccard-signatures")
    known = signed.where("node is not null and doc_id is not null")
    narrow = files(spark, signed.count())
    lowest = durable(known.groupBy("node").agg(F.min("doc_id").alias("low")), "jaccard-classes", narrow)
    repeated = known.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0  # an id with several rows
    reps = known.join(lowest.select("node", F.col("low").alias("doc_id")), ["node", "doc_id"], "left_semi")
    reps = reps.dropDuplicates(["node"]) if repeated else reps
    points = reps.select("node", "n", "fine")

    def dealt(found: DataFrame, names: list[str], run) -> DataFrame:
        return durable(found.select("h", *names).repartition("h").sortWithinPartitions("h").mapInArrow(run, LINKS), "jaccard-links")

    def grouped(links: DataFrame) -> DataFrame:
        return links.where("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("node"))

    def verified(found: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets; found among the pairs of ``links``."""
        most = files(spark, links.where("kind = 0").count())
        found = durable(found.distinct(), "jaccard-pairs", most)
        wanted = durable(found.select(F.col("a").alias("node")).union(found.select("b")).distinct().join(lowest, "node").select("node", F.col("low").alias("doc_id")), "jaccard-wanted", min(narrow, 2 * most))
        sets = rows.join(small(wanted.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi").select("text").mapInArrow(sets_of(width), "node long, elements array<long>")
        sets = durable(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]) if repeated else sets, "jaccard-sets")
        left = found.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("left")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("right")), "b")
        shared = both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("shared"), (F.size("left") + F.size("right")).alias("total"))
        edges = durable(shared.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b"), "jaccard-edges", most)
        discard(found, wanted, sets)
        return edges

    # First, nodes meet by their smallest hash alone. Parts of a large group share their least node.
    firsts = reps.select(F.col("first").alias("h"), "node")
    many = durable(firsts.groupBy("h").agg(F.count("*").alias("many"), F.min("node").alias("least")).where("many > 1"), "jaccard-firsts", narrow)
    parts = F.ceil(F.col("many") / BLOCK).cast("int")
    dealt_firsts = firsts.join(many, "h").select("node", F.when(parts > 1, F.xxhash64("h", F.pmod(F.xxhash64("node"), parts))).otherwise(F.col("h")).alias("h"))
    shared_least = many.where(parts > 1).select(F.col("least").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64("h", i))).alias("h"))
    links = dealt(dealt_firsts.union(shared_least).join(points, "node"), ["node", "n", "fine"], first_links(percent))
    edges = [verified(links.select("a", "b"), links)]
    roots = components(edges[0])
    discard(links, many)

    # Then by all of their prefixes, but only in groups of several roots. Large groups meet as pairs of blocks.
    # What a group holds is counted by partial sums and joined back, as a join splits a hot element and a window does not.
    prefixes = durable(reps.select("node", "prefix").join(roots.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "prefix"), "jaccard-prefixes", narrow)
    placed = prefixes.select(F.explode("prefix").alias("h"), "node", "root")
    mixed = placed.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("many")).where("least <> most")
    mixed = durable(mixed.select("h", "many"), "jaccard-mixed", narrow)
    placed = placed.join(mixed, "h")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("node"), blocks)
    cells = F.when(blocks > 1, F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.xxhash64("h", F.least(i, block), F.greatest(i, block)))).otherwise(F.array("h"))
    placed = durable(placed.select(F.explode(cells).alias("h"), "node", "root"), "jaccard-placed", narrow)
    discard(prefixes, mixed)
    links = dealt(placed.join(reps.select("node", "n", "point"), "node"), ["node", "root", "n", "point"], meetings(percent))
    discard(placed)
    pairs = links.where("kind = 0").select("a", "b").distinct()
    left, right = points.toDF("a", "n", "left"), points.toDF("b", "m", "right")
    pairs = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n") + F.col("m")).alias("total"), "left", "right").mapInArrow(fine_pairs(percent), "a long, b long")

    def joined(more: DataFrame) -> DataFrame:
        """The roots with ``more`` links beside those known."""
        nonlocal roots
        edges.append(more)
        if more.limit(1).count():
            before, roots = roots, components(reduce(DataFrame.union, edges))
            discard(before)
        return roots

    roots, most = joined(verified(pairs, links)), FIRST_LIST
    while True:
        placed = grouped(links).join(roots.select("node", "root"), "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
        mixed = placed.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
        again = durable(placed.join(mixed, "h", "left_semi"), "jaccard-again", narrow)
        discard(links)
        if again.limit(1).count() == 0:
            break
        links = dealt(again.join(points, "node"), ["node", "root", "n", "fine"], later_links(percent, most))
        discard(again)
        if links.where("kind = 0").limit(1).count():
            roots = joined(verified(links.where("kind = 0").select("a", "b"), links))
        most *= 16

    lows = roots.select("node", "root").join(lowest, "node")
    comps = lows.join(lows.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    placed = lowest.join(comps, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "node").join(placed, "node", "left")
    out = durable(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "jaccard-result", narrow)
    discard(again, signed, lowest, roots, *edges)
    return out


def oracle(table: str = "documents", width: int = 4, percent: int = 85) -> str:
    """The same in DuckDB's SQL, by the inverted index and recursive reachability; for small tables with distinct ids."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i+{width - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM {table} UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT r.d AS doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY 1"""
