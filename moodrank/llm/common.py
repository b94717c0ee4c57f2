"""What the operators of this subpackage share: words, hashes, saved tables."""

from __future__ import annotations

import ctypes
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = r"[^\x20\x09-\x0D]+"
"""A word, as a pattern of Java and RE2 alike. ``bytes.split()`` cuts the same."""

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
"""Lower-cases A-Z and nothing else."""


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SLICE_BYTES = 4_000_000
"""Bytes of text that a Python worker turns into objects at once, about; a longer text is a slice by itself."""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table. Batches between JVM and Python are bounded by bytes, unless the session says how large they are."""
    if spark.conf.get(BATCH_BYTES, "64m") in ("64m", "64MB", "67108864b"):  # Spark's own default
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a new local one if
    all of Spark runs in one process, as in tests; an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="moodrank-")
    return _local_dirs[app]


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: this cuts its lineage and
    survives the loss of executors. Without a codec the session's compresses it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a saved() table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system, since a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Whole rows of a batch, about `most` bytes of its column text at once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def mapped(docs: DataFrame, keep: tuple[str, ...], new: T.StructType, prepare: Callable[[], Callable[[pa.RecordBatch], list]], also: tuple[str, ...] = ()) -> DataFrame:
    """docs -> its columns `keep` as they are and the columns `new`. prepare() is called once a task and returns
    what makes, from a slice of rows with the columns text and `also`, one array or list for each new column."""
    schema = T.StructType([*docs.select(*keep).schema, *new])
    columns = list(dict.fromkeys([*keep, "text", *also]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        make = prepare()
        for batch in batches:
            for part in slices(batch):
                made = [x if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=True) for x, f in zip(make(part), list(arrow)[len(keep) :])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=arrow.names)
        del make
        give_back()

    return docs.select(*columns).mapInArrow(run, schema)


def packed_rest(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with the columns `own` and all others in one column `_rest`, so that no operator's columns clash with
    them; and what restores the columns of docs, given new values for some, and `also` those named."""
    rest = [c for c in docs.columns if c not in own]
    narrow = docs.select(*own, F.struct(*rest).alias("_rest") if rest else F.lit(None).cast("int").alias("_rest"))

    def restore(df: DataFrame, new: dict[str, Column] = {}, also: tuple[str, ...] = ()) -> DataFrame:  # noqa: B006
        return df.select(*[(new[c] if c in new else F.col(c) if c in own else F.col("_rest").getField(c)).alias(c) for c in docs.columns], *also)

    return narrow, restore


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


class WordHashes(dict):
    """64-bit hashes of words, computed once for each word that comes again."""

    most = 120_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, from the words' hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    odd = 0x9E3779B97F4A7C15
    for i in range(width):
        total += words[i : i + n] * np.uint64(odd)
        odd = odd * 0xD1342543DE82EF95 % 2**64 | 1
    return mixed(total)


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences, byte plane by byte plane, so
    that the high planes are runs of zeros, which shuffles compress away."""
    n = len(values)
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return struct.pack("<I", n) + steps.view(np.uint8).reshape(n, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", blob)
    planes = np.frombuffer(blob, np.uint8, 8 * n, 4).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def plane_packed(values: np.ndarray) -> bytes:
    """Unordered integers below 2**32, byte plane by byte plane."""
    return values.astype("<u4").view(np.uint8).reshape(len(values), 4).T.tobytes()


def plane_unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, len(blob) // 4)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def text_size(docs: DataFrame) -> int:
    """Bytes of text in all rows; sizes the number of buckets."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0


def squeezed(docs: DataFrame) -> DataFrame:
    """docs with its column text compressed, as `z`: half as much to shuffle as Spark's own codec makes of it."""

    def prepare() -> Callable[[pa.RecordBatch], list]:
        press = zstandard.ZstdCompressor(level=3)
        return lambda rows: [[None if t is None else press.compress(encoded(t)) for t in rows.column("text").to_pylist()]]

    return mapped(docs, tuple(c for c in docs.columns if c != "text"), T.StructType([T.StructField("z", T.BinaryType())]), prepare)


def opened(z: bytes) -> str:
    return zstandard.decompress(z).decode("utf-8", "surrogatepass")
