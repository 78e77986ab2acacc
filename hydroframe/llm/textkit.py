"""Shared vectorised text primitives of the training-data operators.

Everything works on the Arrow buffers of a text column: one flat byte array and
row offsets, cut into chunks of bounded size, so memory follows the chunk and
not the batch.  Nulls read as empty text.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
MAX_BATCH_BYTES = 4 << 20
#: The same where several operators share the executors.
LEAN_BATCH_BYTES = 1 << 20

_U = np.uint64
_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled when outgrown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1, 0 if have is None else 2 * len(have))
        have = np.empty(size, _U)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                more = min(done, size - done)
                have[done : done + more] = have[:more] * _U(pow(base, done, 1 << 64))
                done += more
        _powers[base] = have
    return have


def byte_table(keep_case: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z unless keep_case."""
    with np.errstate(over="ignore"):
        table = splitmix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    if not keep_case:
        table[65:91] = table[97:123]
    return table


FOLDED = byte_table()
EXACT = byte_table(keep_case=True)


def class_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte that is in none of the inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: Words are runs without ASCII white space.
SPACED = class_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII letters, digits and bytes from 0x80.
ALNUM = class_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows; a longer row stands alone."""
    n, row = len(at) - 1, 0
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row's offset."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.empty(n, bool)
    edge[1:] = inside[:-1]
    edge[0] = False
    edge[at[:-1][at[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~edge)
    edge[:-1] = inside[1:]
    edge[-1] = False
    last = at[1:]
    edge[last[last > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~edge) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each span of bytes: polynomial prefix sums, then a finaliser."""
    total = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(table[data] * powers(_BASE, len(data) + 1)[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts]
        return splitmix(value + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


#: Positions of a word that have a table of their own; further ones mix theirs in.
PLACES = 32


def places_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte at each of PLACES positions, A-Z as a-z: entry 256 * position + byte."""
    with np.errstate(over="ignore"):
        table = splitmix(np.arange(1, 256 * PLACES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed) * _U(0xD1342543DE82EF95)).reshape(PLACES, 256)
    table[:, 65:91] = table[:, 97:123]
    return table.reshape(-1)


PLACED = (places_table(1), places_table(2))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """64-bit hashes of disjoint spans, ascending: sums of a random value for each byte and place (tabulation), then a finaliser.

    Each number in `which` stands for a table of its own, so two give 128 bits.
    Unlike a polynomial's, the values at different places have nothing to do with each
    other, so no pair of words is bound to collide.
    """
    if not len(starts):
        return [np.empty(0, _U) for _ in which]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(first[-1] + lengths[-1])) - np.repeat(first, lengths)
    code = ((place & (PLACES - 1)) << 8) | data[place + np.repeat(starts, lengths)]
    far = np.flatnonzero(place >= PLACES) if int(lengths.max()) > PLACES else ()
    out = []
    with np.errstate(over="ignore"):
        for i in which:
            value = PLACED[i][code]
            if len(far):
                value[far] = splitmix(value[far] ^ ((place[far] >> 5).astype(_U) * _U(0xA24BAED4963EE407)))
            out.append(splitmix(np.add.reduceat(value, first) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93)))
    return out


def rows_of(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(at, starts, "right") - 1


def sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring hashes, without regard to rows; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for j in range(k):
            out += hashes[j : j + n] * _U(pow(0xA24BAED4963EE407, j + 1, 1 << 64))
        return splitmix(out)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0 .. c-1 for each count c, in a row."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


_keeps: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Say how to drop what an operator keeps in a worker from one task to the next."""
    _keeps[owner] = drop


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()  # Arrow keeps what it freed apart from malloc
    if f := getattr(ctypes.CDLL(None), "malloc_trim", None):
        f(0)


def trimming(run, owner: str = ""):
    """run, for one operator in a worker that others use too.

    What other operators keep is dropped first; freed memory goes back to the
    system at the end, as idle workers stay beside later stages.
    """

    def wrapped(batches):
        for name, drop in _keeps.items():
            if name != owner:
                drop()
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def bounded_batches(spark: SparkSession, most: int = MAX_BATCH_BYTES) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't make large batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = spark.conf.get(key)
        if int(now) > most:
            spark.conf.set(key, str(most))
    except Exception as e:  # a build without the setting, or one with a unit, keeps its own
        if "INVALID" not in str(e) and "NoSuchElement" not in str(e) and not isinstance(e, ValueError):
            raise


def lean(spark: SparkSession) -> None:
    """Settings that keep an executor's memory outside its heap small, for operators that run one after another.

    Parquet's vectored reads hold a direct buffer as large as a column chunk in
    every thread that read one; Arrow buffers follow the batch.
    """
    bounded_batches(spark, LEAN_BATCH_BYTES)
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


_local: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a temporary folder, gone at exit, serves with a local
    master (as in tests); a cluster has no folder that is known to be shared.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="hydroframe-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        top = f"file://{_local[0]}"
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query that has ended; what was written doesn't need them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back: a cut of the lineage."""
    return _write(df, shared_dir(df.sparkSession, name))


class Tables:
    """Tables in the shared folder that an operator writes on its way, and drops when what follows is written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_dir(self.spark, f"{self.name}-{name}")
        out = _write(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete those tables, or all that are left."""
        for key in [id(f) for f in frames] or list(self.paths):
            _, path = self.paths.pop(key)
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def least(rows: DataFrame, most: int) -> DataFrame:
    """Of rows (grp string, name long, tie long), the `most` least distinct (name, tie) of each grp.

    Every task keeps as many, then 32 tasks merge what these kept, then one: no task
    reads more than `most` rows of a group from each that it merges, however the rows lie.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = lambda parts: pd.concat(parts).drop_duplicates().sort_values(["name", "tie"]).groupby("grp").head(most)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > 200_000:
                held = [cut(held)]
                size = 0
        if held:
            yield cut(held)

    schema = "grp string, name long, tie long"
    once = rows.select("grp", "name", "tie").mapInPandas(trimming(keep), schema).withColumn("salt", F.spark_partition_id() % 32)
    return once.repartition(32, "salt").select("grp", "name", "tie").mapInPandas(keep, schema).repartition(1).mapInPandas(keep, schema)


def chosen(rows: DataFrame, group: str, most: int) -> DataFrame:
    """(name, group, text) of rows with the `most` least (name, hash of the text) of each group; rows that are alike in all count once.

    Two scans: one of hashes for the bounds, one for the texts within them.
    """
    tied = rows.select("name", group, "text", F.xxhash64("text").alias("tie"))
    bounds = least(tied.select(F.col(group).cast("string").alias("grp"), "name", "tie"), most).groupBy("grp").agg(F.max(F.struct("name", "tie")).alias("last"))
    bounds = bounds.select("grp", F.col("last.name").alias("last_name"), F.col("last.tie").alias("last_tie")).toArrow()  # one row a group
    bounds = rows.sparkSession.createDataFrame(bounds)  # of Arrow: of a list it is an RDD, with Python workers of its own
    within = (F.col("name") < F.col("last_name")) | ((F.col("name") == F.col("last_name")) & (F.col("tie") <= F.col("last_tie")))
    met = tied.join(F.broadcast(bounds), (F.col(group).cast("string") == F.col("grp")) & within)
    return met.groupBy("name", group, "tie").agg(F.first("text").alias("text")).select("name", group, "text")


def fresh(name: str, columns: list[str]) -> str:
    """A name for a column of an operator's own that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is: the folder in TOKENIZER_DIR, else the installed package's."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
