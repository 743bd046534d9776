"""What the operators of this subpackage share: table paths, the shared
folder, and walking Arrow batches in bounded pieces."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one numpy pass takes at once; a longer text goes alone.
PIECE = 600_000

_own_folder: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares (spark.checkpoint.dir).
    Only where that is unset and all runs in this process, as in tests, a
    temporary one is made and set; other machines couldn't read that."""
    global _own_folder
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            _own_folder = _own_folder or tempfile.mkdtemp(prefix="sleuthframe-")
            spark.sparkContext.setCheckpointDir(f"file://{_own_folder}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/sleuthframe-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a
    lost executor loses none of it."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith(("s3a:", "s3n:")):
        uri = f"s3:{uri[4:]}"
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> None:
    """Write a file. Its name must hold the task's attempt (see attempt_name), so
    that none is there yet, and the table that the task returns must tell it: of
    a task that ran twice one attempt's rows count, whichever it was, and the
    other's file is never read."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        write(out)


def attempt_name(context: TaskContext) -> str:
    """A name that no other attempt of any task of this application has."""
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together hold about `most` bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = 0
    total = np.cumsum(size)
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
    tidy()


_held: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """What a worker keeps from task to task. It keeps one thing: Spark uses
    workers again for other stages, where it would only take up memory."""
    if key not in _held:
        _held.clear()
        tidy()
        _held[key] = make()
    return _held[key]


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def tidy() -> None:
    """Give memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _gathered(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs begin : begin + size, one after another, and where each starts among them."""
    start = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - start, size), start


def same_text(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether left[a : a + size] equals right[b : b + size], for each run; sizes are 1 or more."""
    if not len(size):
        return np.zeros(0, bool)
    (i, start), (j, _) = _gathered(a, size), _gathered(b, size)
    return np.logical_and.reduceat(left[i] == right[j], start)


class Remembered:
    """Values of short texts in arrays, which take a few bytes a text where a
    dictionary takes a hundred. A text is looked up by a 64-bit key and then
    compared with the text that the key stands for, so equal keys of different
    texts do no harm: the later text is not remembered. like: no values, of the
    shape and type to hold; most: so many are held, then it starts anew."""

    #: Longer texts are worked out each time.
    LONGEST = 64

    def __init__(self, like: np.ndarray, most: int = 1_000_000):
        self.like, self.most = like, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64), self.like
        self.begin, self.size, self.codes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def values_of(self, keys: np.ndarray, exact: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The value of each text codes[begin:end], whose keys are given, and which
        of them are exact, that is equal for equal texts only (see text_keys).
        make(indices) works out those of some of the texts."""
        size = end - begin
        if len(self) > self.most:
            self.forget()
        out = np.zeros((len(keys), *self.like.shape[1:]), self.like.dtype)
        short = np.flatnonzero(size <= self.LONGEST)
        names, first, back = np.unique(keys[short], return_index=True, return_inverse=True)
        first = short[first]
        # every text against the first one of its key
        alike = exact[short] | (size[short] == size[first][back])
        ask = np.flatnonzero(alike & ~exact[short] & (first[back] != short))
        alike[ask] = same_text(codes, begin[short][ask], codes, begin[first][back][ask], size[short][ask])
        at = np.searchsorted(self.keys, names)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == names[known]
        slot = np.zeros(len(names), np.int64)
        slot[known] = self.slots[at[known]]
        clash = known & ~exact[first]
        clash[clash] = self.size[slot[clash]] != size[first][clash]
        some = known & ~clash & ~exact[first]
        clash[some] = ~same_text(codes, begin[first][some], self.codes, self.begin[slot[some]], size[first][some])
        new = np.flatnonzero(~known)
        if len(new):
            i, start = _gathered(begin[first[new]], size[first[new]])
            slot[new] = np.arange(len(new)) + len(self.begin)
            self.begin, self.size = np.append(self.begin, start + len(self.codes)), np.append(self.size, size[first[new]])
            self.codes = np.append(self.codes, codes[i])
            self.values = np.append(self.values, make(first[new]), axis=0)
            self.keys, self.slots = np.insert(self.keys, at[new], names[new]), np.insert(self.slots, at[new], slot[new])
        told = alike & ~clash[back]
        out[short[told]] = self.values[slot[back[told]]]
        alone = np.sort(np.append(np.flatnonzero(size > self.LONGEST), short[~told]))
        if len(alone):
            out[alone] = make(alone)
        return out


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from sorted batches, one at a time. Only the group
    at hand is held, so groups must be bounded by whoever made the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def dealt_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str, most: int = 50_000) -> DataFrame:
    """left joined (inner or left) by shuffling with right, whose keys are unique.
    Keys with more than `most` rows of left are dealt, by the column `by`, to as
    many tasks as they need, and their row of right is repeated for each. There
    is at most one such key for each `most` rows; they are broadcast only if
    counted to be few."""
    hot = left.groupBy(F.col(key).alias("_hot")).count().filter(F.col("count") > most)
    hot = written(hot.select("_hot", F.ceil(F.col("count") / most).cast("int").alias("_tasks")))
    n = hot.count()
    if not n:
        return left.join(right, key, how)
    hot = F.broadcast(hot) if n <= 100_000 else hot

    def marked(df: DataFrame) -> DataFrame:
        return df.join(hot, df[key] == hot["_hot"], "left").drop("_hot")

    dealt = marked(left).withColumn("_task", F.coalesce(F.pmod(F.xxhash64(by), F.col("_tasks")), F.lit(0)).cast("int")).drop("_tasks")
    spread_out = marked(right).withColumn("_task", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_tasks"), F.lit(1)) - 1))).drop("_tasks")
    return dealt.join(spread_out, [key, "_task"], how).drop("_task")
