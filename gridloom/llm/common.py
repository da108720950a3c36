"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python, and bytes after which Spark ends one early: a very long text is a batch alone.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Spark removes a query's shuffle files at its end if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What this Python worker keeps for its next tasks, by what made it: one thing at most.
_KEPT: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; survives the loss of executors. The shuffle files that
    led to the table go as soon as it is there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the bounds above; plans read them when they run, so they stay lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).lower().removesuffix("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def kept(make: Callable, *args):
    """make(*args), kept in this Python worker for its next tasks until those of another operator come."""
    if (make, args) not in _KEPT:
        let_go()
        _KEPT[make, args] = make(*args)
    else:
        trim()
    return _KEPT[make, args]


def let_go() -> None:
    """Free what tasks of other operators keep in this Python worker: Spark hands workers on from stage to stage, with
    all that is in them, and an executor's memory is theirs and its JVM's together."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # of glibc only
        libc.malloc_trim(0)


def own_name(name: str, taken: list[str]) -> str:
    """A name that no column has."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a DataFrame reads, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 cut points of a long column, from its quantile sketch; bounded by n, not by the data."""
    if n < 2:
        return []
    cuts = df.approxQuantile(key, [i / n for i in range(1, n)], 1 / (8 * n))
    return sorted({int(c) for c in cuts})


def bucket_of(key: str, bounds: list[int]):
    """Number of cut points at or below the key: 0 to len(bounds)."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.size(F.filter(cuts, lambda c: c <= F.col(key)))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, words): text i, split at spaces, is words[c] for c in codes[offsets[i]:offsets[i + 1]]."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.values.dictionary_encode()
    return lists.offsets.to_numpy(), coded.indices.to_numpy(), coded.dictionary


class IdLists:
    """Lists of ids by their keys, in arrays, so that many keys' lists are put together at once."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.n = 0
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def append(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        """The lengths of new lists, and the lists one after another."""
        n, m = self.n, self.n + len(lengths)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while m > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.lengths))
        self.ids[self.used : self.used + len(ids)] = ids
        self.lengths[n:m] = lengths
        self.starts[n:m] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.n = m

    def add(self, keys: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.index.update(zip(keys, range(self.n, self.n + len(keys)), strict=True))
        self.append(lengths, ids)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the lists with these numbers."""
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return lengths, self.ids[np.repeat(self.starts[which] - (ends - lengths), lengths) + np.arange(total)]


class WordTable:
    """IdLists whose keys are in an Arrow array, so that many words are looked up at once. Number 0 is the empty word.
    A look-up costs time by the table's size, so shrink() leaves the words used most."""

    def __init__(self):
        self.lists, self.keys = IdLists(), pa.array([""], pa.string())
        self.lists.append(np.zeros(1, np.int64), np.zeros(0, np.int32))
        self.uses = np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def used(self, numbers: np.ndarray) -> None:
        """Count the uses of words by their numbers."""
        counts = np.bincount(numbers, minlength=len(self))
        counts[: len(self.uses)] += self.uses
        self.uses = counts

    def shrink(self, keep: int) -> None:
        """Leave about keep words, those used most; numbers change, but that of the empty word."""
        least = np.partition(self.uses, len(self.uses) - keep)[len(self.uses) - keep] if keep < len(self.uses) else 0
        stay = np.flatnonzero(self.uses > least)
        stay = np.concatenate([[0], stay[stay > 0]])
        lengths, ids = self.gather(stay)
        keys, uses = self.keys.take(pa.array(stay)), self.uses[stay]
        self.lists = IdLists()
        self.lists.append(lengths, ids)
        self.keys, self.uses = keys, uses // 2

    def find(self, words: pa.Array) -> np.ndarray:
        """The words' numbers, -1 for unknown ones."""
        return pc.fill_null(pc.index_in(words, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, words: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """New, distinct words with their lists; their numbers."""
        at = len(self.keys)
        self.lists.append(lengths, ids)
        self.keys = pa.concat_arrays([self.keys, words])
        return np.arange(at, at + len(words))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.lists.gather(which)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
