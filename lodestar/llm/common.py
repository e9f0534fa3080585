"""What the operators of this package share: durable tables, word hashing and connected components."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes shuffle files at the end of an execution.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of narrow intermediate tables that one file holds.
FILE_ROWS = 50_000
#: Distinct words that a Python worker remembers; beyond it the memory starts afresh. Longer words are not remembered.
CACHE_WORDS, CACHED_LENGTH = 100_000, 64


_own_dirs: dict[str, str] = {}
_writing, _lock = {}, threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for intermediate tables.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the master is local (tests, a laptop) a
    temporary folder is made for the application and removed when the driver ends. On a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors and driver need a shared folder for intermediate tables")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            path = tempfile.mkdtemp(prefix="lodestar-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _own_dirs[app] = f"file://{path}"
        found = _own_dirs[app]
    return found.rstrip("/")


def _clean_up(spark: SparkSession, by: int) -> None:
    """Shuffle files are removed after use while any write of the session goes on; its own setting returns after the last."""
    with _lock:
        key = id(spark._jsparkSession)
        n, before = _writing.get(key, (0, None))
        if n == 0:
            before = spark.conf.get(CLEAN_UP, "false")
            spark.conf.set(CLEAN_UP, "true")
        _writing[key] = (n + by, before)
        if n + by == 0:
            spark.conf.set(CLEAN_UP, before)
            del _writing[key]


def files(spark: SparkSession, rows: int) -> int:
    """Files for a narrow table of ``rows`` rows: two for each core, more where they would hold over ``FILE_ROWS`` each."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def durable(df: DataFrame, tag: str, most: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder, of ``most`` files at most, and read it again.

    This cuts the lineage: a lost executor costs the rereading of files, never a recomputation. The
    shuffle files of the write are removed when it ends, as nothing reads them again. Each file costs a task, and
    on local folders processes that the JVM starts for its permissions and that count as large as the JVM until they run.
    """
    spark = df.sparkSession
    df = df if most is None else df.coalesce(most)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _clean_up(spark, 1)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _clean_up(spark, -1)
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` returned, once all that reads them is written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.durable_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; the check before any broadcast."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows, else as it is (a shuffled join)."""
    return F.broadcast(df) if fits(df, rows) else df


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, kept for later tasks of the same Python worker until one asks for something else."""
    kept = vars(sys).setdefault("_lodestar_worker_cache", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered per worker up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of fewer words, the whole sequence as one."""
    n = len(hashes)
    if n == 0:
        return hashes
    take = min(n, width)
    run = np.full(n - take + 1, take, dtype=np.uint64)
    for i in range(take):
        run = run * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - take + 1 + i]
    return np.unique(mix(run))


def slices(batches: Iterable, rows: int = 256) -> Iterable:
    """Parts of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binaries(column) -> Iterable[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the smallest node reachable.

    Minimum labels spread along the links and jump to their label's label in each round, so a round
    at least doubles the distance covered. Each round's labels are a durable table; joins are on node
    ids, so that a node with very many links is split like any skewed join. Empty edges give no rows.
    """
    most = files(edges.sparkSession, 2 * edges.count())
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), tag, most)
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"), F.lit(False).alias("moved")), tag, most)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        low = F.least("root", "next")
        after = durable(moved.join(up, "root").select("node", low.alias("root"), (low != F.col("was")).alias("moved")), tag, most)
        discard(labels)
        labels = after
        if labels.where("moved").limit(1).count() == 0:
            discard(both)
            return labels
