"""N-gram Jaccard join (operator 4): exact classes of texts whose shingle sets are alike.

Size-aware heavy-light join.  Two sets of n and m shingles link when they share
at least ceil(num * (n + m) / (num + den)) of them.

* Equal sets become one node first.
* Small sets enumerate the subsets of exactly that size, for each partner size
  they can have; small partners that link have such a subset in common.
* Large sets scan the inverted lists of the shingles in their prefix: in one
  order for the whole corpus, which puts frequent shingles last, any two sets
  that link share one of the first n - ceil(num * n / den) + 1.  Small sets that
  a large one can link with stand in these lists too.
* The boundary is the size with the least cost: subsets against expected list
  lengths, from the sizes and frequencies of the whole corpus.

Lists aren't expanded into pairs.  Every node is first compared with one leader
of its lists and joins the leader's star if they link.  Jaccard distance is a
metric, so nodes of two stars can link only if the centres are near enough; list
neighbours of different components are compared star by star, and member by
member only where the centres allow a link.  A set whose prefix reaches the
frequent shingles has all its rare ones in lists; so a rare shingle of another
set that stands in no list twice isn't in it, which bounds what the two share.
No link between components is lost, and links within one don't change it.

What isn't exact by proof: shingles count as equal if 128-bit hashes are (tabulated
by byte and place in the word, so no texts are bound to collide), and a set's size
counts 64-bit hashes; a text of n words is miscounted with a chance of n * n / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm import textkit
from hydroframe.llm.components import components
from hydroframe.llm.textkit import Tables, splitmix

U = np.uint64
#: Bits of the number of a set's buckets: a bucket for two to four of its shingles, within these bounds.
LEAST_BUCKETS, MOST_BUCKETS = 4, 13
#: Frequent shingles are those in HEAVY sets or more, the most frequent MOST_HEAVY of them; this bounds what is broadcast (16 MB) and only orders shingles.
HEAVY, MOST_HEAVY = 100, 2_000_000
#: Bits of the filter that spares shuffling the texts of documents without candidates, by their number.
FILTER_BITS = (16, 27)
#: So many ids at most are broadcast; more are joined by a shuffle.
MOST_IDS = 250_000
#: Texts that are compared with one in a task; more of them take further tasks.
SHARE = 256


class Rule:
    """Words a shingle, and the least Jaccard similarity num / den."""

    def __init__(self, words: int, num: int, den: int) -> None:
        self.words, self.num, self.den = words, num, den

    def overlap(self, n: int, m: int) -> int:
        return -(-self.num * (n + m) // (self.num + self.den))

    def partners(self, n: int) -> range:
        return range(-(-self.num * n // self.den), self.den * n // self.num + 1)

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1

    def subsets(self, n: int, most: int) -> int:
        """How many subsets a set of n shingles enumerates for partners of up to `most`."""
        return sum(math.comb(n, o) for m in self.partners(n) if m <= most and (o := self.overlap(n, m)) <= min(n, m) and not (m == n and o == n))

    def boundary(self, sizes: dict[int, int], list_length: float, most: int = 64) -> int:
        """The largest size of small sets, by cost."""
        best, least, before = 0, math.inf, 0.0
        sizes = {n: c for n, c in sizes.items() if n <= most}
        for b in range(most + 1):
            cost = sum(c * (self.subsets(n, b) if n <= b else self.prefix(n) * (1 + list_length)) for n, c in sizes.items())
            cost += sum(c * self.prefix(n) for n, c in sizes.items() if n <= b and n * self.den >= self.num * (b + 1))
            if cost < least:
                best, least = b, cost
            if b and self.subsets(b, b) > 100_000:
                break
        return best


@cache
def _picks(n: int, o: int) -> np.ndarray:
    return np.array(list(combinations(range(n), o)), np.intp).reshape(-1, o)


def subset_keys(rule: Rule, values: np.ndarray, boundary: int) -> list[np.ndarray]:
    """A key for each subset of a small set, by sizes of the pair that it can prove."""
    n, mixed, out = len(values), splitmix(values ^ U(0x5851F42D4C957F2D)), []
    for m in rule.partners(n):
        o = rule.overlap(n, m)
        if m > boundary or o > min(n, m) or (m == n and o == n):
            continue
        with np.errstate(over="ignore"):
            sums = mixed[_picks(n, o)].sum(axis=1, dtype=U)
            out.append(splitmix(sums + U(min(n, m) * 1_000_003 + max(n, m))))
    return out


def shingles(data: np.ndarray, at: np.ndarray, k: int, wide: bool = False) -> tuple[np.ndarray, ...]:
    """Distinct shingle hashes of each row, ascending, and the number in each row; if wide, also a second hash of each."""
    rows = len(at) - 1
    starts, ends = textkit.runs(textkit.SPACED[data], at)
    row = textkit.rows_of(starts, at)
    n_words = np.bincount(row, minlength=rows)
    first = np.cumsum(n_words) - n_words
    whole = row[: max(len(row) - k + 1, 0)] == row[k - 1 :]
    short = [(j, np.flatnonzero(n_words == j)) for j in range(1, k)]  # fewer words than k: the whole text is one shingle
    of = np.concatenate([row[: len(whole)][whole], *(x for _, x in short)])
    hashes = []
    for words in textkit.word_hashes(data, starts, ends, (0, 1) if wide else (0,)):
        parts = [textkit.sequence_hashes(words, k)[whole]]
        for j, those in short:
            with np.errstate(over="ignore"):
                total = np.full(len(those), j, U)
                for i in range(j):
                    total += words[first[those] + i] * U(pow(0xA24BAED4963EE407, i + 1, 1 << 64))
            parts.append(splitmix(total))
        hashes.append(np.concatenate(parts))
    order = np.lexsort((*hashes[::-1], of))
    of, hashes = of[order], [h[order] for h in hashes]
    keep = np.ones(len(of), bool)
    keep[1:] = of[1:] != of[:-1]
    for h in hashes:
        keep[1:] |= h[1:] != h[:-1]
    return *(h[keep] for h in hashes), np.bincount(of[keep], minlength=rows)


def in_common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets have in common, by both hashes."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]):
        return 0
    at = np.searchsorted(y[0], x[0])
    same = y[0][np.minimum(at, len(y[0]) - 1)] == x[0]
    both = same & (y[1][np.minimum(at, len(y[1]) - 1)] == x[1])
    odd = np.flatnonzero(same & ~both)  # the first hash agrees: the second decides, if several share the first
    return int(both.sum()) + sum(x[1][i] in y[1][at[i] : np.searchsorted(y[0], x[0][i], "right")] for i in odd.tolist())


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


def fingerprints(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the shingles of each row."""
    return _sums(splitmix(grams), counts).view(np.int64), _sums(splitmix(grams ^ U(0x2545F4914F6CDD1D)), counts).view(np.int64)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = textkit.buffers(batch.column(1))
    return textkit.chunks(data, at)


def statistics(docs: DataFrame, rule: Rule) -> DataFrame:
    """(kind, key, n): kind 0, in how many texts a shingle is; kind 1, how many texts have a size up to 64.

    Only shingles that a task met twice count, as others aren't frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, held, size = np.zeros(65, np.int64), [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(int(often.sum()), np.int32)), pa.array(key[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["kind", "key", "n"])

        for batch in batches:
            for _, _, data, at in _chunks(batch):
                grams, counts = shingles(data, at, rule.words)
                sizes += np.bincount(counts[counts <= 64], minlength=65)
                held.append(grams)
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(65, np.int32)), pa.array(np.arange(65)), pa.array(sizes)], ["kind", "key", "n"])

    return docs.mapInArrow(textkit.trimming(run), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def signatures(docs: DataFrame, rule: Rule, heavy: np.ndarray, boundary: int) -> DataFrame:
    """Of every document: doc_id, n, fingerprints a and b, row number rid, counts of shingles by bucket, keys, and of large sets how many keys are of rare shingles and whether these are all that the set has."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)  # MOST_HEAVY at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        frequent = sent.value
        coarse = np.zeros(1 << 16, bool)
        coarse[(frequent >> U(48)).astype(np.intp)] = True
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, end, data, at in _chunks(batch):
                grams, counts = shingles(data, at, rule.words)
                a, b = fingerprints(grams, counts)
                of = np.repeat(np.arange(end - first), counts)
                bits = np.clip(np.ceil(np.log2(np.maximum(counts, 1) / 4)), LEAST_BUCKETS, MOST_BUCKETS).astype(np.int64)
                edges = np.concatenate([[0], np.cumsum(1 << bits)])
                filled = np.bincount(np.repeat(edges[:-1], counts) + (splitmix(grams) >> np.repeat(64 - bits, counts).astype(U)).astype(np.intp), minlength=edges[-1])
                rank = grams >> U(2)
                maybe = np.flatnonzero(coarse[(grams >> U(48)).astype(np.intp)])
                if len(frequent) and len(maybe):
                    place = np.minimum(np.searchsorted(frequent, grams[maybe]), len(frequent) - 1)
                    there = maybe[frequent[place] == grams[maybe]]
                    rank[there] = (rank[there] & U((1 << 62) - 1)) | U(1 << 63)
                ordered = grams[np.lexsort((rank, of))]
                starts = np.cumsum(counts) - counts
                large = counts * rule.den >= rule.num * (boundary + 1)
                length = np.where(large & (counts > 0), rule.prefix(counts), 0)
                taken = ordered[np.repeat(starts, length) + textkit.ragged(length)] if length.sum() else np.zeros(0, U)
                # The lowest bit of a key tells whether its shingle is frequent.
                kinds = rank[np.lexsort((rank, of))][np.repeat(starts, length) + textkit.ragged(length)] >> U(63) if length.sum() else taken
                tagged = (splitmix(taken) & ~U(1)) | kinds
                rare = np.add.reduceat(np.append(1 - kinds.astype(np.int64), 0), np.minimum(np.cumsum(length) - length, len(kinds))) * (length > 0)
                reach = (counts > boundary) & (rare < length)
                keys: list[np.ndarray] = np.split(tagged, np.cumsum(length)[:-1])
                for i in np.flatnonzero((counts > 0) & (counts <= boundary)).tolist():
                    keys[i] = np.unique(np.concatenate([keys[i], *(x & ~U(1) for x in subset_keys(rule, grams[starts[i] : starts[i] + counts[i]], boundary))]))
                lengths = np.array([len(x) for x in keys])
                flat = np.concatenate(keys).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
                raw, cut = np.minimum(filled, 255).astype(np.uint8).tobytes(), edges.tolist()
                bins = [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(counts, pa.int64()), pa.array(a), pa.array(b), pa.array(rid + np.arange(end - first)), pa.array(bins, pa.binary()), lists, pa.array(np.where(counts > boundary, rare, -1), pa.int64()), pa.array(reach)],
                    ["doc_id", "n", "a", "b", "rid", "bins", "keys", "rare", "reach"],
                )
                rid += end - first

    return docs.mapInArrow(textkit.trimming(run), "doc_id long, n long, a long, b long, rid long, bins binary, keys array<long>, rare long, reach boolean")


def _bound(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """What pairs of sets can share at most, by their counts in buckets; many for sets that these can't bound."""
    out = np.empty(len(x), np.int64)
    sizes = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)])
    for m, n in np.unique(sizes, axis=0).tolist():
        some = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == n))
        p, q = (np.frombuffer(b"".join([side[i] for i in some.tolist()]), np.uint8).reshape(len(some), w) for side, w in ((x, m), (y, n)))
        full = (p == 255).any(axis=1) & (q == 255).any(axis=1)
        less = min(m, n)
        p, q = (z.reshape(len(some), less, -1).sum(axis=2, dtype=np.int64) for z in (p, q))
        out[some] = np.where(full, 1 << 40, np.minimum(p, q).sum(axis=1))
    return out


def _near(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Those pairs (u, v, slack) whose bucket counts allow a similarity of num / den - slack."""
    side = nodes.select("rid", "n", "bins")
    both = pairs.join(side.select(F.col("rid").alias("u"), F.col("n").alias("un"), F.col("bins").alias("ub")), "u").join(side.select(F.col("rid").alias("v"), F.col("n").alias("vn"), F.col("bins").alias("vb")), "v")
    least = rule.num / rule.den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                n, m, slack = (part.column(c).to_numpy() for c in (3, 5, 2))
                most = np.minimum(_bound(part.column(4).to_pylist(), part.column(6).to_pylist()), np.minimum(n, m))
                j = np.maximum(least - slack - 1e-9, 0)
                keep[i : i + 1024] = most * (1 + j) >= j * (n + m) - 1e-6
            yield batch.filter(pa.array(keep)).select(["u", "v", "slack"])

    return both.select("u", "v", "slack", "un", "ub", "vn", "vb").mapInArrow(textkit.trimming(run), "u long, v long, slack double")


def _texts(docs: DataFrame, asked: DataFrame, n: int, rule: Rule) -> DataFrame:
    """The n rows of asked (doc_id, a, b, ...) with the bytes of their texts, from a scan of docs.

    A filter over the doc_ids, with 16 bits for each, passes by other documents; it only
    saves work, the join by doc_id and fingerprints decides.
    """
    bits = min(max((16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    words = asked.select(slot.alias("s")).groupBy(F.expr("s div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("bits")).toPandas()  # 2**bits / 32 rows at most
    table = np.zeros((1 << bits) // 32, np.uint32)
    table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = sent.value, set()
        for batch in batches:
            s = batch.column(2).to_numpy().astype(np.int64)
            some = (table[s >> 5] >> (s & 31).astype(np.uint32)) & np.uint32(1)
            batch = batch.filter(pa.array(some.astype(bool)))
            for first, end, data, at in _chunks(batch):
                grams, counts = shingles(data, at, rule.words)
                a, b = fingerprints(grams, counts)
                names = list(zip(batch.column(0).slice(first, end - first).to_pylist(), a.tolist(), b.tolist(), strict=True))
                new = [i for i, x in enumerate(names) if x not in done and not done.add(x)]  # of repeated rows one is enough
                raw, cut = data.tobytes(), at.tolist()
                yield pa.RecordBatch.from_arrays([*(pa.array([names[i][c] for i in new], pa.int64()) for c in range(3)), pa.array([raw[cut[i] : cut[i + 1]] for i in new], pa.binary())], ["doc_id", "a", "b", "body"])

    made = docs.select("doc_id", "text", slot.alias("s")).where("doc_id is not null").mapInArrow(textkit.trimming(run), "doc_id long, a long, b long, body binary")
    return made.join(F.broadcast(asked) if n <= MOST_IDS else asked, ["doc_id", "a", "b"])


def _similar(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, rule: Rule, tables: Tables) -> DataFrame:
    """(u, v, slack, inter, n, m) of the pairs, by their whole sets.

    Each v goes, once for every SHARE of its pairs, to where these are compared, and
    their u with it: a text is shuffled once for each pair, and no task holds all
    that meet one v.  Repeated rows of a document can repeat pairs.
    """
    near = tables.write(_near(pairs, nodes, rule), "pairs")
    shares = near.groupBy("v").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    there = near.join(shares, "v").select(F.col("v").alias("home"), F.pmod(F.xxhash64("u"), F.col("shares")).alias("share"), F.col("u").alias("rid"), "slack")
    both = there.unionByName(there.select("home", "share", F.col("home").alias("rid"), F.lit(None).cast("double").alias("slack")).distinct())
    asked = tables.write(both.join(nodes.select("rid", "doc_id", "a", "b"), "rid"), "asked")
    tables.drop(near)
    if not (n := asked.count()):
        return docs.sparkSession.range(0).selectExpr("id u", "id v", "0d slack", "id inter", "id n", "id m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, right = None, None
        for batch in batches:
            home, share, rid = (batch.column(c).to_numpy() for c in (0, 1, 2))
            slacks, out = batch.column(3).to_pylist(), []
            for first, end, data, at in textkit.chunks(*textkit.buffers(batch.column(4))):
                one, two, counts = shingles(data, at, rule.words, wide=True)
                cut = np.concatenate([[0], np.cumsum(counts)])
                for i in range(first, end):
                    of = slice(cut[i - first], cut[i - first + 1])
                    here = (one[of], two[of])
                    if slacks[i] is None:
                        place, right = (home[i], share[i]), here
                    elif place == (home[i], share[i]):
                        out.append((rid[i], home[i], slacks[i], in_common(here, right), len(here[0]), len(right[0])))
                    else:
                        raise RuntimeError("a text came before the one that it is compared with")
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64() if i == 2 else pa.int64()) for i, c in enumerate(cols)], ["u", "v", "slack", "inter", "n", "m"])

    met = _texts(docs, asked, n, rule).repartition("home", "share").sortWithinPartitions("home", "share", F.col("slack").isNotNull())
    return met.select("home", "share", "rid", "slack", "body").mapInArrow(textkit.trimming(run), "u long, v long, slack double, inter long, n long, m long")


def classes(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of docs (doc_id, text).

    component_id is the least doc_id among the documents that links reach.  A text
    without words, empty or null has no shingles and is linked with nothing; its
    component is its own doc_id.  Rows that repeat stay repeated, and count as
    documents with equal sets; a null doc_id is never a component's, unless a
    component has no other, and its text is compared only through equal texts
    with a doc_id.  Other columns are left out.
    """
    textkit.bounded_batches(docs.sparkSession)
    rule, tables = Rule(words, num, den), Tables(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = tables.write(statistics(docs, rule), "stats")
    often = seen.where(f"kind = 0 and n >= {HEAVY}").orderBy(F.desc("n"), "key").limit(MOST_HEAVY).select("key").toPandas()["key"].to_numpy(np.int64)  # bounded
    light = seen.where(f"kind = 0 and n < {HEAVY}").agg(F.coalesce(F.sum(F.col("n") * F.col("n")) / F.sum("n"), F.lit(1.0))).first()[0]
    sizes = {r["key"]: r["n"] for r in seen.where("kind = 1").collect()}  # 65 rows
    boundary = rule.boundary(sizes, float(light))
    tables.drop(seen)
    made = tables.write(signatures(docs, rule, np.sort(often.view(U)), boundary), "signatures")

    groups = made.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("label"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("least"), F.count("*").alias("c"))
    groups = tables.write(groups.select("n", "a", "b", "label", F.col("least.rid").alias("rid"), "c"), "groups")
    # Rows that don't stand for their group, or whose group has no label; usually few, so that keys needn't be shuffled to leave them out.
    several = groups.where("c > 1 or label is null").select("n", "a", "b", F.when(F.col("label").isNotNull(), F.col("rid")).alias("first"))
    spare = tables.write(made.select("rid", "n", "a", "b").join(several, ["n", "a", "b"]).where("first is null or rid <> first").select("rid"), "spare")
    nodes = made.select("rid", "doc_id", "a", "b", "n", "bins").where("n > 0").join(F.broadcast(spare) if spare.count() <= MOST_IDS else spare, "rid", "left_anti")
    # A frequent shingle's list is taken as it is; of other lists, which are short, those of one node are left out.
    packed = (F.col("n") * (1 << 32) + (F.col("rare") + 1) * 2 + F.col("reach").cast("long")).alias("info")
    alone = made.where("n > 0").join(F.broadcast(spare) if spare.count() <= MOST_IDS else spare, "rid", "left_anti")
    entries = alone.select("rid", packed, F.explode("keys").alias("key"))
    frequent = F.col("key").bitwiseAND(1) == 1
    dealt = entries.where(~frequent).repartition(F.col("key"))
    common = dealt.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    rare = tables.write(dealt.join(common, "key").select("key", "rid", "info").unionByName(entries.where(frequent).select("key", "rid", "info")), "lists")
    lists = rare.select("key", "rid", F.shiftright("info", 32).alias("n"), (F.shiftright(F.col("info").bitwiseAND((1 << 32) - 1), 1) - 1).alias("rare"), (F.col("info").bitwiseAND(1) == 1).alias("reach"))

    # Stars: each node with the leader that shares most of its lists.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(math.sqrt(den / num)))
    leaders = lists.groupBy("key", band.alias("band")).agg(F.min(F.struct("rare", "rid", "n")).alias("lead"))  # the fewest rare shingles: the middle of a group
    fits = f"least(n, lead.n) * {den} >= {num} * greatest(n, lead.n)"
    shifted = lists.select("key", "rid", "n", "rare", band.alias("band"))
    asked = shifted.join(leaders, ["key", "band"]).where(f"(rare, rid) > (lead.rare, lead.rid) and {fits}").groupBy("rid", F.col("lead.rid").alias("leader")).agg(F.count("*").alias("c"))
    best = asked.groupBy("rid").agg(F.max(F.struct("c", (-F.col("leader")).alias("back"))).alias("best")).select(F.col("rid").alias("u"), (-F.col("best.back")).alias("v"), F.lit(0.0).alias("slack"))
    linked = f"inter * {den} >= {num} * (n + m - inter)"
    stars = tables.write(_similar(docs, best, nodes, rule, tables).where(linked).select("u", "v", (1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))).alias("d")).distinct(), "stars")
    comps = components(stars.select("u", "v"), tables)

    # Lists that hold more than one component: compare stars by their centres.
    # most: what a set can share with one that reaches; over: that, less what a partner's size adds to the overlap needed.
    known = lists.groupBy("rid").agg(F.first("rare").alias("rare"), F.first("reach").alias("reach"), F.first("n").alias("n"), F.sum(F.when(F.col("key").bitwiseAND(1) == 0, 1).otherwise(0)).alias("met"))
    most = F.when(F.col("rare") < 0, F.col("n")).otherwise(F.col("n") - F.col("rare") + F.col("met"))
    known = known.select("rid", "n", "reach", (most * (num + den) - F.col("n") * num).alias("over"))
    known = known.join(stars.select(F.col("u").alias("rid"), F.col("v").alias("centre"), "d"), "rid", "left").join(comps.withColumnRenamed("id", "rid"), "rid", "left")
    known = tables.write(known.select("rid", "n", "reach", "over", F.coalesce("centre", "rid").alias("star"), F.coalesce("comp", "rid").alias("comp"), F.coalesce("d", F.lit(0.0)).alias("d")), "known")
    placed = lists.select("key", "rid").join(known, "rid")
    held = placed.groupBy("key", "star", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("over").alias("over"), F.min("reach").alias("reach"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    held = tables.write(held.join(mixed, "key"), "held")
    tables.drop(rare)
    left, right = (held.select("key", *(F.col(c).alias(f"{c}{i}") for c in ("star", "comp", "lo", "hi", "over", "reach"))) for i in (1, 2))
    sized = f"star1 < star2 and comp1 <> comp2 and hi1 * {den} >= {num} * lo2 and hi2 * {den} >= {num} * lo1"
    shared = f"not (reach2 and over1 < {num} * lo2) and not (reach1 and over2 < {num} * lo1)"
    meet = left.join(right, "key").where(f"{sized} and {shared}").select("star1", "star2").distinct()
    radius = stars.groupBy("v").agg(F.max("d").alias("r"))
    meet = meet.join(radius.select(F.col("v").alias("star1"), F.col("r").alias("r1")), "star1", "left").join(radius.select(F.col("v").alias("star2"), F.col("r").alias("r2")), "star2", "left")
    meet = meet.select(F.col("star1").alias("u"), F.col("star2").alias("v"), (F.coalesce("r1", F.lit(0.0)) + F.coalesce("r2", F.lit(0.0))).alias("slack"))
    close = tables.write(_similar(docs, meet, nodes, rule, tables), "close")
    tables.drop(held)
    direct = close.where(linked).select("u", "v")
    open_pairs = close.where(f"slack > 0 and not ({linked}) and inter / (n + m - inter) >= {num / den} - slack - 1e-9")
    links = stars.select("u", "v").unionByName(direct)
    if open_pairs.limit(1).count():
        # A member can only reach the other star's if it is as far from its own centre as the centres leave open.
        apart = (1 - F.col("inter") / (F.col("n") + F.col("m") - F.col("inter"))).alias("apart")
        some = open_pairs.select(F.col("u").alias("star1"), F.col("v").alias("star2"), apart)
        one, two = (known.select(F.col("star").alias(f"star{i}"), F.col("rid").alias(f"rid{i}"), F.col("n").alias(f"n{i}"), F.col("d").alias(f"d{i}")) for i in (1, 2))
        near = some.join(one, "star1").join(two, "star2").where(f"d1 + d2 >= apart - {1 - num / den} - 1e-9 and least(n1, n2) * {den} >= {num} * greatest(n1, n2)")
        asked = near.select(F.col("rid1").alias("u"), F.col("rid2").alias("v"), F.lit(0.0).alias("slack"))
        links = links.unionByName(_similar(docs, asked, nodes, rule, tables).where(linked).select("u", "v"))
    final = components(links, tables)
    named = groups.join(final.withColumnRenamed("id", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    least = named.groupBy("comp").agg(F.min("label").alias("component_id"))
    label = named.join(least, "comp").select("n", "a", "b", "component_id")
    out = made.select("doc_id", "n", "a", "b").join(label, ["n", "a", "b"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = textkit.written(out, "jaccard-classes")
    tables.drop()
    return out
