"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one entry from each of ``BOOKS`` full-dimensional codebooks. The books are
trained one after another on what the earlier ones leave of a bounded sample, then refitted together by least
squares. Beam search encodes: it keeps the best partial sums, not only the greedy one. Every row
is encoded, with the ratio of its norm to that of its code. A query's inner products with all codebook
entries are a lookup table; the sum of the looked-up entries times the ratio estimates the score.

Rows are listed by their entry in the first book, and lists that lie beside one another are cells of ``PART`` rows or more; a list
of very many rows is several cells. The search has two steps, both over cells and blocks of queries:

* A query goes to the cells that hold some of its nearest lists, and only rows of these lists are estimated. A cell gives the
  more candidates the nearer it is, and they are scored on the vectors. The k-th best score found is the query's floor.
* No row below the floor can be among the k nearest. What a code leaves of its vector has a length, which is kept with it, so
  the estimate plus that length times the query's is a bound of the score; so is the product with a list's centre plus the
  length of the farthest row of the list. A query goes to the cells with a list whose bound reaches its floor, and every row whose
  bound reaches it is scored on the vectors.

So the nearest are all found, whatever the vectors; ``lists`` and ``rerank`` only say how much is spent on the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import discard, durable

#: Rows that train the codebooks, at most; codebooks, entries of each, and kept partial sums in encoding.
SAMPLE, BOOKS, ENTRIES, BEAM = 20_000, 16, 256, 8
#: Lists of the first book that a query visits for its floor, and rows that are scored for it.
LISTS, RERANK = 160, 500
#: Rows of a cell, at least, and at most, as they bring their vectors; and queries that meet a cell in one task.
PART, CELL, QUERIES = 2_048, 16_384, 16_384
#: Cells that a table has at least if their rows allow it; each query meets most of them.
CELLS = 24


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, at, x)
        full = n > 0
        centres[full] = total[full] / n[full, None]
        if (~full).any():
            centres[~full] = x[rng.choice(len(x), (~full).sum())]
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (row, book) by beam search."""
    m, k, _ = books.shape
    out = np.empty((len(x), m), np.uint8)
    for start in range(0, len(x), 512):
        part = x[start : start + 512]
        rows = len(part)
        codes, left = np.zeros((rows, 1, 0), np.uint8), part[:, None, :]
        for book in books:
            width = left.shape[1]
            cost = (left**2).sum(axis=2)[:, :, None] - 2 * np.einsum("rwd,kd->rwk", left, book, optimize=True) + (book**2).sum(axis=1)[None, None, :]
            keep = min(beam, width * k)
            best = np.argpartition(cost.reshape(rows, -1), keep - 1, axis=1)[:, :keep]
            w, e = best // k, best % k
            at = np.arange(rows)[:, None]
            left = left[at, w] - book[e]
            codes = np.concatenate([codes[at, w], e[:, :, None].astype(np.uint8)], axis=2)
        out[start : start + 512] = codes[np.arange(rows), (left**2).sum(axis=2).argmin(axis=1)]
    return out


def train(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, seed: int = 7) -> np.ndarray:
    """Codebooks (book, entry, dimension): residual k-means, then one joint least-squares refit."""
    rng = np.random.default_rng(seed)
    entries = min(entries, max(1, len(x)))
    left, found = x.copy(), []
    for _ in range(books):
        book = kmeans(left, entries, rng)
        found.append(book)
        left = left - book[nearest(left, book)]
    trained = np.stack(found)
    codes = encode(x, trained)
    flat = codes.astype(np.int64) + np.arange(books) * entries
    size = books * entries
    gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
    for i in range(books):
        np.add.at(right, flat[:, i], x)
        for j in range(books):
            np.add.at(gram, (flat[:, i], flat[:, j]), 1.0)
    gram[np.arange(size), np.arange(size)] += 1.0
    right += trained.reshape(size, -1)
    refit = np.linalg.solve(gram, right).reshape(trained.shape)
    refit[0] = trained[0]  # the first book's entries stay the lists' centres
    return refit


def matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


CODED = "vec_id long, list int, code binary, ratio double, rest double, far double, v binary"


def codes_of(books: np.ndarray):
    """Arrow function: each vector's list, code, norm ratio, length of what the code leaves, distance to the list's centre, and its doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            codes = encode(x, books)
            approx = decoded(books, codes)
            norm = np.linalg.norm(approx, axis=1)
            ratio = np.where(norm > 0, np.linalg.norm(x, axis=1) / np.maximum(norm, 1e-300), 1.0)
            rest, far = (np.linalg.norm(x - y, axis=1) for y in (approx * ratio[:, None], books[0][codes[:, 0]]))
            packed = (pa.array([r.tobytes() for r in y], pa.binary()) for y in (codes, x))
            columns = [batch.column("vec_id"), pa.array(codes[:, 0].astype(np.int32)), next(packed), pa.array(ratio), pa.array(rest), pa.array(far), next(packed)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "list", "code", "ratio", "rest", "far", "v"])

    return run


def decoded(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def unpacked(column, kind: type = np.float64) -> np.ndarray:
    """A matrix of the rows of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added in the order of dimensions: the score, to the last digit."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, y.T, strict=True):
        total += a * b
    return total


def slack(size: int, one, other):
    """More than rounding can change in an inner product of vectors of these lengths."""
    return 16 * (size + 16) * np.finfo(float).eps * one * other


def cells_of(counts: np.ndarray, centres: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first cell, and how many cells it has; neighbouring lists of few rows share one cell of ``part`` rows."""
    axis = np.linalg.svd(centres - centres.mean(axis=0), full_matrices=False)[2][0]
    first, many, cell, filled = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for i in np.argsort(centres @ axis, kind="stable"):
        if counts[i] > part:
            cell += filled > 0
            first[i], many[i], filled = cell, -(-int(counts[i]) // part), 0
            cell += many[i]
            continue
        if filled and filled + counts[i] > part:
            cell, filled = cell + 1, 0
        first[i] = cell
        filled += counts[i]
    return first, many


VISITS = "query_id long, cell int, rank int, floor double, v binary, lists binary"


def visits_of(books: np.ndarray, lists: int, first: np.ndarray, many: np.ndarray, far: np.ndarray | None = None):
    """Arrow function: a row for each query and cell with some of its ``lists`` nearest lists; rank 0 is the nearest cell.

    With ``far``, the distance of each list's farthest row (-1: no rows): with some list that can reach the query's floor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            x = unpacked(batch.column("v")) if batch.num_rows else np.empty((0, books.shape[2]))
            for query, v, floor in zip(batch.column("vec_id").to_pylist(), x, batch.column("floor").to_pylist(), strict=True):
                near = books[0] @ v
                if far is None:
                    taken = np.argsort(-near, kind="stable")[:lists]
                else:
                    length, centre = np.linalg.norm(v), np.linalg.norm(books[0], axis=1)
                    taken = np.flatnonzero((far >= 0) & ~(near + length * far + slack(len(v), length, centre + far) < floor))
                by_cell: dict[int, list[int]] = {}
                for i in taken.tolist():
                    for c in range(first[i], first[i] + many[i]):
                        by_cell.setdefault(c, []).append(i)
                packed = v.tobytes()
                out += [(query, c, rank, floor, packed, np.array(held, np.uint8).tobytes()) for rank, (c, held) in enumerate(by_cell.items())]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()]
            names = ["query_id", "cell", "rank", "floor", "v", "lists"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def share_of(rank: int, rerank: int, k: int) -> int:
    """Candidates that a query takes from its cell of that rank."""
    return k + -(-rerank // (2 + rank))


def scored_by(books: np.ndarray, rerank: int, k: int, every: bool):
    """Grouped Arrow function over a cell and a block of queries: for each query the ``k`` best scores among the best by estimate of
    its lists there (``every``: all of them), less what rounding can change.
    """

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0)]]
        if queries.num_rows and rows.num_rows:
            ids, ratio, vectors = rows.column("vec_id").to_numpy(), rows.column("ratio").to_numpy(), unpacked(rows.column("v"))
            codes = unpacked(rows.column("code"), np.uint8)
            order = np.lexsort((ids, codes[:, 0]))
            ids, ratio, codes, vectors = ids[order], ratio[order], codes[order], vectors[order]
            held, length = np.searchsorted(codes[:, 0], np.arange(257)), np.linalg.norm(vectors, axis=1)
            q, rank, x = queries.column("query_id").to_numpy(), queries.column("rank").to_numpy(), unpacked(queries.column("v"))
            visited = queries.column("lists").to_pylist()
            for start in range(0, len(q), 128):
                block = slice(start, min(start + 128, len(q)))
                table = np.einsum("qd,mkd->mqk", x[block], books, optimize=True)
                near = np.zeros((len(q[block]), 256), bool)
                for i, v in enumerate(visited[block]):
                    near[i, np.frombuffer(v, np.uint8)] = True
                found: list[list] = [[] for _ in range(len(near))]
                for at in np.flatnonzero(near.any(axis=0) & (held[1:] > held[:-1])):
                    part, asked = np.arange(held[at], held[at + 1]), np.flatnonzero(near[:, at])
                    estimate = sum(table[m][np.ix_(asked, codes[part, m])] for m in range(len(books))) * ratio[part][None, :]
                    for i, e in zip(asked, estimate, strict=True):
                        found[i].append((part, e))
                for i, parts in enumerate(found):
                    if parts:
                        who, score = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
                        other = ids[who] != q[start + i]
                        who, score = who[other], score[other]
                        take = len(who) if every else min(len(who), share_of(int(rank[start + i]), rerank, k))
                        if take < len(who):
                            who = who[np.argpartition(-score, take - 1)[:take]]
                        v = x[start + i]
                        best = np.sort(vectors[who] @ v - slack(len(v), np.linalg.norm(v), length[who]))[::-1][:k]
                        out[0].append(np.full(len(best), q[start + i]))
                        out[1].append(best)
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["query_id", "score"])

    return run


def proved_by(books: np.ndarray, k: int):
    """Grouped Arrow function over a cell and a block of queries: each query's ``k`` best rows there of those at its floor or above."""

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
        if queries.num_rows and rows.num_rows:
            ids, vectors = rows.column("vec_id").to_numpy(), unpacked(rows.column("v"))
            # Of equal vectors only the least ids can be among the nearest, one more than k as the query itself may be one.
            same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
            order = np.lexsort((ids, same))
            order = order[np.arange(len(ids)) - np.searchsorted(same[order], same[order]) <= k]
            ids, vectors, rest = ids[order], vectors[order], rows.column("rest").to_numpy()[order]
            codes = decoded(books, unpacked(rows.column("code"), np.uint8)[order]) * rows.column("ratio").to_numpy()[order][:, None]
            q, floors, x = queries.column("query_id").to_numpy(), queries.column("floor").to_numpy(), unpacked(queries.column("v"))
            order = np.argsort(np.argmax(x @ books[0].T, axis=1), kind="stable")  # queries that lie together ask for the same rows
            q, floors, x = q[order], floors[order], x[order]
            length, longest = np.linalg.norm(x, axis=1), np.linalg.norm(vectors, axis=1).max()
            for start in range(0, len(q), 256):
                block = slice(start, start + 256)
                low = (floors[block] - slack(x.shape[1], length[block], longest))[:, None]
                bound = x[block] @ codes.T
                bound += length[block][:, None] * rest[None, :]
                asked = np.flatnonzero((~(bound < low)).any(axis=0))  # so that NaN, of products beyond the largest double, stays
                score = x[block] @ vectors[asked].T
                score[q[block][:, None] == ids[asked][None, :]] = -np.inf
                if len(asked) > k:
                    enough = np.flatnonzero((~(score < low)).sum(axis=1) > k)
                    last = np.partition(score[enough], len(asked) - k, axis=1)[:, len(asked) - k]
                    low[enough, 0] = np.fmax(low[enough, 0], last - 2 * slack(x.shape[1], length[block][enough], longest))
                i, j = np.nonzero(~(score < low) & (q[block][:, None] != ids[asked][None, :]))
                exact, i, j = products(x[block][i], vectors[asked][j]), q[block][i], ids[asked][j]
                order = np.lexsort((j, -exact, i))
                i, j, exact = i[order], j[order], exact[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                for o, y in zip(out, (i, j, exact), strict=True):
                    o.append(y[best])
        return pa.table([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a finite, non-zero vector without nulls."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, lists: int = LISTS, rerank: int = RERANK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` with the largest inner products for each query, all of them.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. Ties go to the smaller
    vec_id. Vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor do null ids; rows that repeat
    an id count once, by their least vector. All vectors have the length of the most; others take no part. An empty table
    gives no rows.
    """
    stored = rows = durable(usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not lengths:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    total, size = lengths[0]["count"], lengths[0]["size"]
    rows = rows.where(F.size("v") == size)
    share = min(1.0, SAMPLE / total)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    books = train(matrix(chosen.select("v").limit(SAMPLE).toArrow().column(0).combine_chunks()))

    coded = durable(rows.mapInArrow(codes_of(books), CODED), "ann-codes")
    discard(stored)
    counts, far = np.zeros(books.shape[1], np.int64), np.full(books.shape[1], -1.0)
    for r in coded.groupBy("list").agg(F.count("*").alias("count"), F.max("far").alias("far")).collect():
        counts[r["list"]], far[r["list"]] = r["count"], r["far"]
    first, many = cells_of(counts, books[0], min(CELL, max(PART, total // CELLS)))
    place = coded.sparkSession.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, many, strict=True))], "list int, first int, many int")
    of = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int")
    celled = coded.join(F.broadcast(place), "list").select(of.alias("cell"), "vec_id", "code", "ratio", "rest", "v")  # one row for each list
    asked = coded.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select("vec_id", "v")
    blocks = max(1, -(-asked.count() // QUERIES))
    met = celled.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).groupBy("cell", "block")

    def searched(queries: DataFrame, visits, by, schema: str) -> DataFrame:
        dealt = queries.mapInArrow(visits, VISITS).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("long")))
        return dealt.groupBy("cell", "block").cogroup(met).applyInArrow(by, schema)

    found = searched(asked.withColumn("floor", F.lit(0.0)), visits_of(books, lists, first, many), scored_by(books, rerank, k, rerank >= total), "query_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    floors = durable(found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")), "ann-floors")
    # A query that found fewer than k rows has no floor and meets every row.
    low = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    near = searched(low, visits_of(books, lists, first, many, far), proved_by(books, k), "query_id long, vec_id long, score double")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = durable(near.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k), "ann-near")
    return near.select("query_id", "rank", "vec_id", "score")
