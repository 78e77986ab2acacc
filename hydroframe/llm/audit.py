"""Filter interaction audit (operator 11): what each filter removes, in every order of the filters.

A document's failures are a set of filters, and what an order has removed so far only
depends on the set of filters applied.  So documents are counted by part and failure
set once, and all orders are read from the lattice of sets: its edges add one filter
to a set, and an edge's weights are the documents that pass the set and fail the filter.
Forward, the orders that reach a set are counted, backward those that leave it; an edge
lies on the product of both counts of orders.  A filter's Shapley sum weights its edges
so, and the steps of an order are the edges on its path.

Documents become one row a part and failure set (at most 2 ** filters a part) before
anything is expanded, so only parts times orders grow from then on.

Rules: a null text is empty, and an empty text has no words (it fails "few words", and
neither the shares nor the signs).  Repeats compare whole texts by SHA-256 with those of
smaller doc_ids; a row without a doc_id neither fails so nor makes others fail, and rows
of one doc_id don't make each other fail.  A doc_id is good or toxic if any of its labels
says so; every row of a repeated doc_id counts.  Parts are the values of a column, null
and empty text being one.  An empty table has no parts, and gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.dedup import WHITE
from hydroframe.llm.groups import with_groups
from hydroframe.llm.textkit import Tables

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Lattice:
    """Sets of n filters as bit masks; edges (set, filter) with the orders through them."""

    def __init__(self, n: int) -> None:
        self.n, self.full = n, (1 << n) - 1
        self.reach, self.leave = [0] * (1 << n), [0] * (1 << n)
        self.reach[0] = self.leave[self.full] = 1
        self.edges = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
        for s, f in self.edges:  # a set's number is above those of its subsets
            self.reach[s | 1 << f] += self.reach[s]
        for s, f in reversed(self.edges):
            self.leave[s] += self.leave[s | 1 << f]

    def through(self, s: int, f: int) -> int:
        """How many orders apply the filter f right after the set s."""
        return self.reach[s] * self.leave[s | 1 << f]

    def orders(self) -> dict[tuple[int, int], list[str]]:
        """The orders (as letters A, B, ...) through each edge."""
        out: dict[tuple[int, int], list[str]] = {e: [] for e in self.edges}
        for order in permutations(range(self.n)):
            s, name = 0, "".join(chr(65 + f) for f in order)
            for f in order:
                out[s, f].append(name)
                s |= 1 << f
        return out


def text_failures(text: Column) -> list[Column]:
    """Few words, repeated words, capitals, signs: whether a text (not null) fails each."""
    words = F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, part: str, tables: Tables, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, part, mask of every row: bit i is set if it fails the filter i; the last filter is that of repeats."""
    whole = F.coalesce(F.col(text), F.lit(""))
    tests = text_failures(whole)
    mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)])
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"))
    rows = tables.write(rows, "rows")
    first = tables.write(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1"), "repeats")
    late = F.col("doc_id") > F.col("first")
    return with_groups(rows, first, "digest", rows.count(), "size").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(late, 1 << len(tests)).otherwise(0)).alias("mask"))


def counted(failed: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask, n, good, toxic: the rows of each failure set, and those among them with a good or toxic label."""
    of = labels.groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max((F.col(quality) == 1).cast("long")).alias("good"), F.max((F.col(toxic) == 1).cast("long")).alias("toxic"))
    docs = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    met = docs.join(of, "doc_id", "left")
    share = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def _each(values: list[tuple], fields: str) -> Column:
    """The rows of a small fixed table as an array of structs."""
    names = fields.split()
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, row, strict=True)]) for row in values])


def edges(sets: DataFrame, n: int) -> DataFrame:
    """One row a part and edge of the lattice: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and the filter's shapley."""
    lattice = Lattice(n)
    rows = sets.select("*", F.explode(_each([(s, f, 1 << f, lattice.through(s, f)) for s, f in lattice.edges], "done filter bit through")).alias("e")).select("part", "mask", "n", "good", "toxic", "e.*")
    mask, done, bit = F.col("mask"), F.col("done"), F.col("bit")
    earlier, fails = mask.bitwiseAND(done) != 0, mask.bitwiseAND(bit) != 0
    total = lambda when, of="n": F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).cast("long")
    here = ~earlier & fails
    out = rows.groupBy("part", "done", "filter", "through").agg(
        total(~earlier & ~fails).alias("kept"), total(here).alias("removed"), total(earlier & fails).alias("redundant"), total(mask == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost")
    )
    whole = out.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("through")).cast("long").alias("shapley"))
    return out.join(whole, ["part", "filter"])


def orders(edges: DataFrame, n: int) -> DataFrame:
    """part, filter_order, step and the figures of the edge that the order takes at this step."""
    lattice = Lattice(n)
    paths = lattice.orders()
    table = F.create_map(*[x for (s, f), names in paths.items() for x in (F.lit(s * n + f), F.array(*map(F.lit, names)))])
    rows = edges.withColumn("filter_order", F.explode(table[F.col("done") * n + F.col("filter")]))
    step = (F.bit_count("done") + 1).cast("int").alias("step")
    return rows.select("part", "filter_order", step, "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a part, order of the five filters ABCDE and step."""
    tables = Tables(docs.sparkSession, "audit")
    sets = tables.write(counted(failures(docs, part, tables, text, key), labels, key), "sets")
    tables.drop(*[f for f, _ in list(tables.paths.values()) if f is not sets])
    return orders(edges(sets, 5), 5)
