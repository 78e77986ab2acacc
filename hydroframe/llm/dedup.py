"""Exact dedup (operator 12): a minimal perfect hash over the distinct digests of a history, and what a delivery adds to it.

Texts are equal when they are identical without ASCII white space; their digest is
the SHA-256 of what is left.  The history's digests lie in shards by their leading
bits, so shards are even however often a text repeats.  A shard is one row: levels of
bits that give every digest a slot of its own and leave none empty (a level keeps the
digests that meet no other there; the others go on to the next), and slots with the
full digest and the locator of the row that stays.

A delivery is grouped by digest before it is shuffled, then looked up shard by shard.
A perfect hash sends nonmembers to some slot too, so all 32 bytes are compared: a match
is a repeat and joins the slot's group; the others group on their own.  Every row of
a table then finds its group by `with_groups`, also where a third of all rows are copies.

Rules: null and empty texts are equal to each other.  Of equal texts the row with the
most code points in the original stays, then the one of smallest doc_id; rows without
a doc_id come last, and of rows alike in both exactly one stays, whichever was written
first.  Rows that share a doc_id are rows of their own.  Empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.groups import with_groups
from hydroframe.llm.textkit import Tables, splitmix

#: ASCII white space, which equal texts may differ in.
WHITE = " \t\n\x0b\x0c\r"
#: Digests of a shard on average at most; and the least number of shards, in bits.
SHARD, LEAST_BITS, MOST_BITS = 50_000, 8, 30
#: Bits a digest of a level.
ROOM = 2
#: What decides which row of a group stays, least first: code points below zero, whether there is no doc_id, the doc_id, the row's number.
PLACE = ("shorter", "nameless", "name", "row")

_U = np.uint64


class PerfectHash:
    """Slots 0 .. n-1 of n distinct digests, four 64-bit words each."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - 1

    @staticmethod
    def _spot(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (splitmix(words[:, level % 4] ^ splitmix(np.full(1, level + 1, _U))) % _U(size)).astype(np.int64)

    @classmethod
    def of(cls, words: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [np.empty(0, bool)], words
        while len(left):
            size = ROOM * len(left) + 1
            spot = cls._spot(left, len(sizes), size)
            alone = np.bincount(spot, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[spot]]
        return cls(sizes, np.concatenate(levels))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest; of one that isn't a member, any slot or -1."""
        out, left, first = np.full(len(words), -1), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            spot = first + self._spot(words[left], level, size)
            held = self.bits[spot]
            out[left[held]] = self.rank[spot[held]]
            left, first = left[~held], first + size
        return out


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", *more: Column) -> DataFrame:
    """key, points (code points of the original), digest (32 bytes) of every row, and what more is asked for."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias(key), F.length(whole).cast("long").alias("points"), F.unhex(F.sha2(F.translate(whole, WHITE, "").cast("binary"), 256)).alias("digest"), *more)


def grouped(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """digest, PLACE of the row that stays, size: one row a distinct digest, combined before the shuffle."""
    place = F.struct((-F.col("points")).alias("shorter"), F.col(key).isNull().cast("long").alias("nameless"), F.coalesce(F.col(key), F.lit(0)).alias("name"), F.col("row"))
    return rows.groupBy("digest").agg(F.min(place).alias("best"), F.count("*").alias("size")).select("digest", "best.*", "size")


_GROUPS = "digest binary, shorter long, nameless long, name long, row long, size long"


def _words(table: pa.Table) -> np.ndarray:
    flat = b"".join(table.column("digest").to_pylist())
    return np.frombuffer(flat, "<u8").reshape(-1, 4)


def _numbers(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in (*PLACE, "size")], axis=1).astype(np.int64).reshape(-1, 5)


def _groups(words: np.ndarray, numbers: np.ndarray) -> dict[str, pa.Array]:
    raw = np.ascontiguousarray(words).tobytes()
    out = {"digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())}
    return out | {c: pa.array(numbers[:, i], pa.int64()) for i, c in enumerate((*PLACE, "size"))}


def _earlier(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the place x comes before y, row by row."""
    out, equal = np.zeros(len(x), bool), np.ones(len(x), bool)
    for i in range(len(PLACE)):
        out |= equal & (x[:, i] < y[:, i])
        equal &= x[:, i] == y[:, i]
    return out


class History:
    """Perfect hashes of the distinct digests of earlier rows, by shard."""

    def __init__(self, shards: DataFrame, bits: int) -> None:
        self.shards, self.bits = shards, bits

    @staticmethod
    def _shard(bits: int) -> Column:
        return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits).cast("int")

    @classmethod
    def of(cls, groups: DataFrame, n: int, tables: Tables) -> History:
        """The index of `grouped` rows, n or fewer of them."""
        bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(n, 1) / SHARD)))))

        def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            words, numbers = _words(table), _numbers(table)
            made = PerfectHash.of(words)
            order = np.argsort(made.slots(words))
            row = {"shard": key[0].as_py(), "sizes": made.sizes, "bits": np.packbits(made.bits).tobytes(), "digests": words[order].tobytes(), "winners": numbers[order].tobytes()}
            return pa.Table.from_pylist([row], pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary()), ("winners", pa.binary())]))

        shards = groups.withColumn("shard", cls._shard(bits)).groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, digests binary, winners binary")
        return cls(tables.write(shards, "history"), bits)

    def joined(self, groups: DataFrame) -> DataFrame:
        """The groups of history and delivery together, with known: whether the history had the digest."""

        def look_up(old: pa.Table, new: pa.Table) -> pa.Table:
            words, numbers = (_words(new), _numbers(new)) if new.num_rows else (np.empty((0, 4), _U), np.empty((0, 5), np.int64))
            held, winners, member = np.empty((0, 4), _U), np.empty((0, 5), np.int64), np.zeros(len(words), bool)
            for shard in old.to_pylist():
                sizes = shard["sizes"]
                index = PerfectHash(sizes, np.unpackbits(np.frombuffer(shard["bits"], np.uint8), count=sum(sizes)).astype(bool))
                held, winners = np.frombuffer(shard["digests"], "<u8").reshape(-1, 4), np.frombuffer(shard["winners"], np.int64).reshape(-1, 5).copy()
                slot = index.slots(words)
                member = (slot >= 0) & (held[slot] == words).all(axis=1)
                at, repeats = slot[member], numbers[member]
                better = _earlier(repeats, winners[at])
                winners[at[better], :4] = repeats[better, :4]
                winners[at, 4] += repeats[:, 4]
            out = _groups(np.concatenate([held, words[~member]]), np.concatenate([winners, numbers[~member]]))
            return pa.table(out | {"known": pa.array(np.arange(len(out["digest"])) < len(held))})

        new = groups.withColumn("shard", self._shard(self.bits))
        return self.shards.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(look_up, f"{_GROUPS}, known boolean")


def classes(docs: DataFrame, historical: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and repeats_history of every row of docs.

    Rows for which historical holds are the history, all others (null too) the delivery
    that is looked up in it; the classes are those of both, however they are dealt.
    """
    tables = Tables(docs.sparkSession, "dedup")
    rows = tables.write(digests(docs, text, key, F.coalesce(historical, F.lit(False)).alias("old")).withColumn("row", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    history = History.of(grouped(rows.where("old"), key), n, tables)
    groups = tables.write(history.joined(grouped(rows.where("not old"), key)).where("size > 1").withColumnRenamed("row", "winner"), "groups")
    met = with_groups(rows, groups, "digest", n, "size")
    alone = F.col("size").isNull()
    return met.select(
        F.col(key), F.when(alone, F.col(key)).when(F.col("nameless") == 0, F.col("name")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("winner") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), (~F.col("old") & F.coalesce("known", F.lit(False))).alias("repeats_history"),
    )
