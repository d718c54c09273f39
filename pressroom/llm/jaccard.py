"""Similarity join of documents by word n-gram Jaccard similarity, and the components of its links.

Sets are the distinct hashes of n-word shingles. Equal sets are one representative from the start. A
count vector, how many shingles fall into each of GROUPS groups, is a point; the coordinate minima of two points,
summed, bound the overlap, for boxes of points as for points, so an R-tree over the points, packed by sorting and tiling, is joined with itself level
by level, and only pairs of points that every level lets through are left. They are bounded again by vectors of FINE groups, in cells of blocks of sets, so that what is
shuffled does not grow with the pairs, and only the sets of those that remain are shuffled and compared.

Linked sets share one of the first shingles of each, in any order that is the same for all. Common shingles come last in it, as what they bring together grows with the square of the
texts, the others by their hashes; which ones are common is estimated from a bounded number of texts, and changes no result. Sets that share such a key also share a key with the least of its holders, the key's head, so there is one tree
for each head and not for each key: long near copies share hundreds of keys, but few heads, and their pairs are looked at a few times only. Trees lie in different
tasks; the points of a head that very many sets hang on are dealt into blocks with a tree each, and pairs of blocks are joined. A first pass links the members of a key to the least of them, which joins large groups
of near copies with few comparisons; the second looks at every pair of different components that a head brings together.

Defined results: null and blank texts have no set and stay alone. Texts with fewer than n words
have one shingle, all their words. Repeated doc_ids are one document with the sets of its rows,
linked to whatever any of them is linked to. Empty tables give no rows. A very long text is one set, held whole by the tasks that
read it. Extra columns are passed on by one_of_each() and not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import HOT, drop, joined, pieces, read, stored, texts

WORDS, PERCENT = 4, 85
GROUPS = 256
#: Groups, each of several of those, by which the R-tree is built and searched.
COARSE = 64
#: Groups of the vectors that bound the pairs left by the R-tree.
FINE = 1024
#: Keys of the first pass.
ANCHORS = 3
#: Texts, about, in which common shingles are looked for; a shingle of so many of them is common; the most common ones that every task gets.
COMMON_TEXTS, COMMON_IN, MOST_COMMON = 16_384, 4, 100_000
#: Points in a leaf of the R-tree, and boxes below a box.
FAN = 16
#: Groups of up to so many points, half a leaf, are compared many groups at once.
SMALL = 8
#: Pairs of boxes that are opened together.
CHUNK = 256
#: Pairs of points that leave a task together.
PAIRS = 100_000
#: Points of a hot group in one block, sets of a block of bounded(), partners of one set in a task of beside().
BLOCK = 4096
ORACLE_SQL = rf"""WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
  sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - {WORDS - 2})), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM words),
  shingles AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS h FROM sets),
  links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.r < b.r GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
  edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets"""

FEATURES = "doc_id long, n_shingles long, digest binary, point binary, fine binary, anchors array<long>, keys array<long>"


class Hashes(dict):
    """Hashes of the words met so far; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, hashes: Hashes, n: int) -> np.ndarray:
    """The text's set, ascending."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    row = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(row))
    count = len(row) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out = mixed(out + row[k : k + count])
    return np.unique(out)


def packed(counts: np.ndarray) -> bytes:
    """A count vector in a unit, four bytes, and a byte for each group; rounded up, so that minima still bound the overlap."""
    unit = int(counts.max()) // 255 + 1
    return np.uint32(unit).tobytes() + (-(-counts // unit)).astype(np.uint8).tobytes()


def unpacked(points: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), 4 + GROUPS)
    return rows[:, 4:].astype(np.int32) * np.ascontiguousarray(rows[:, :4]).view("<i4")


def common(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of shingles that many texts share, ascending: MOST_COMMON at most. None where all texts together make no large group."""
    rows = texts(docs)
    count = rows.count()
    if count <= BLOCK:
        return np.empty(0, np.uint64)
    asked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1, COMMON_TEXTS / count) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in pieces(batches):
            found = [shingles(text, hashes, n) for text in batch.column(1).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    counts = asked.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= COMMON_IN)
    most = counts.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").toArrow()
    return np.sort(most.column(0).to_numpy().view(np.uint64))


def first_keys(found: np.ndarray, count: int, late: np.ndarray) -> np.ndarray:
    """The first `count` of a set (ascending), those in `late` (ascending) after all others."""

    def parted(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = late[np.minimum(np.searchsorted(late, some), len(late) - 1)] == some
        return some[~held], some[held]

    if not len(late) or not count:
        return found[:count]
    # Mostly a few more than asked for hold enough of them.
    early, _ = parted(found[: 2 * count])
    return early[:count] if len(early) >= count else np.concatenate(parted(found))[:count]


def features(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    late = docs.sparkSession.sparkContext.broadcast(common(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, squeeze = Hashes(), zstandard.ZstdCompressor(level=1).compress
        for batch in pieces(batches):
            sizes, digests, points, fine, anchors, keys = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, hashes, n)
                size = len(found)
                prefix = size - (percent * size + 99) // 100 + 1 if size else 0
                sizes.append(size)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                counts = np.bincount((found & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE)
                points.append(packed(counts.reshape(-1, GROUPS).sum(0)))
                fine.append(squeeze(counts.astype("<u4").tobytes()))
                # Near copies have keys of their own first; the least-hashed of all shingles are those they have in common.
                anchors.append(found[: min(prefix, ANCHORS)].view(np.int64))
                keys.append(first_keys(found, prefix, late.value).view(np.int64))
            lists = lambda rows: pa.array(rows, pa.list_(pa.int64()))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(points, pa.binary()), pa.array(fine, pa.binary()), lists(anchors), lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "point", "fine", "anchors", "keys"])

    return texts(docs).mapInArrow(run, FEATURES)


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node that it reaches), by alternating large and small stars; edges (a, b)."""
    both = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        ends = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = joined(ends, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct())
        low = stored(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = joined(large, low, ["a"], "n").select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        new = stored(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        same = [f.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for f in (both, new)]
        drop(both, least, large, low)
        both = new
        if same[0] == same[1]:
            return both.select(F.col("a").alias("node"), F.col("b").alias("root"))


class Tree:
    """An R-tree packed over points: `order` puts them into leaves of FAN, each level above has a box for FAN of the one below.

    A box is the coordinate maxima of its points, with the least and the most n; minima are not needed to bound overlaps from above.
    """

    def __init__(self, point: np.ndarray, n: np.ndarray):
        coarse = point.reshape(len(n), COARSE, -1).sum(2)
        spread = np.argsort(-coarse.var(0), kind="stable")[:2]
        slabs = max(1, int(math.sqrt(len(n) / FAN)))
        # Slabs of n, in each of them tiles of the widest coordinates.
        slab = np.empty(len(n), np.int64)
        slab[np.argsort(n, kind="stable")] = np.arange(len(n)) * slabs // len(n)
        self.order = np.lexsort((coarse[:, spread[-1]], coarse[:, spread[0]], slab))
        self.point = point
        high, low, top = coarse[self.order], n[self.order], n[self.order]
        self.levels = [(high, low, top)]
        while len(low) > 1:
            cuts = np.arange(0, len(low), FAN)
            high, low, top = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((high, low, top))


def tree_join(one: Tree, two: Tree, percent: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both point lists of the pairs that no level rules out; within: both trees are the same, each pair once."""

    def passing(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (high, least, most), (other, low, top) = one.levels[min(level, len(one.levels) - 1)], two.levels[min(level, len(two.levels) - 1)]
        bound = np.minimum(high[i], other[j]).sum(1)
        # Two sets of a box pair overlap by `bound` at most, have these least sizes together, and may be this close in size.
        return ((100 + percent) * bound >= percent * (least[i] + low[j])) & (100 * most[i] >= percent * low[j]) & (100 * top[j] >= percent * least[i])

    def below(tree: Tree, level: int, k: np.ndarray) -> np.ndarray:
        """FAN places a level down for every place; beyond the tree's end they are cut off later. A lower tree waits."""
        return k[:, None] * FAN + np.arange(FAN) if level < len(tree.levels) else k[:, None]

    height = max(len(one.levels), len(two.levels)) - 1
    root = np.zeros(1, np.int64)
    stack = [(height, root, root)] if passing(height, root, root)[0] else []
    while stack:
        level, i, j = stack.pop()
        if not level:
            keep = i < j if within else slice(None)
            a, b = one.order[i[keep]], two.order[j[keep]]
            good = (100 + percent) * np.minimum(one.point[a], two.point[b]).sum(1) >= percent * (one.levels[0][1][i[keep]] + two.levels[0][1][j[keep]])
            if good.any():
                yield a[good], b[good]
            continue
        a, b = below(one, level, i), below(two, level, j)
        a, b = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, a.shape[1]).ravel()
        real = (a < len(one.levels[min(level - 1, len(one.levels) - 1)][1])) & (b < len(two.levels[min(level - 1, len(two.levels) - 1)][1]))
        if within:
            real &= a <= b
        a, b = a[real], b[real]
        good = passing(level - 1, a, b)
        a, b = a[good], b[good]
        stack += [(level - 1, a[at : at + CHUNK], b[at : at + CHUNK]) for at in range(0, len(a), CHUNK)]


def candidates(grouped: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs a, b of different components whose points do not rule them out; grouped: key, i, j, first, second, rep, comp, n, point.

    A pair is looked at in the cell (i, j) of the blocks of both, where first and second tell whether a row stands for block i, block j or both.
    """

    def few(members, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The groups of a leaf at most, all at once: each row with the one d places on, for every d."""
        rep, comp, n, point = members
        for d in range(1, SMALL):
            i = np.nonzero((group[:-d] == group[d:]) & (comp[:-d] != comp[d:]))[0]
            i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
            i = i[(100 + percent) * np.minimum(point[i], point[i + d]).sum(1) >= percent * (n[i] + n[i + d])]
            yield np.maximum(rep[i], rep[i + d]), np.minimum(rep[i], rep[i + d])

    def near(members, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        within = bool(first[0] and second[0])
        sides = [[c[s] for c in members] for s in (first, second)]
        if not len(sides[0][0]) or not len(sides[1][0]):
            return
        one = Tree(sides[0][3], sides[0][2])
        two = one if within else Tree(sides[1][3], sides[1][2])
        (rep, comp, *_), (other, its_comp, *_) = sides
        for a, b in tree_join(one, two, percent, within):
            ok = comp[a] != its_comp[b]
            a, b = rep[a[ok]], other[b[ok]]
            yield np.maximum(a, b), np.minimum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the last group, which may go on in the next batch

        def found(columns: list[np.ndarray]):
            keys, (first, second), members = columns[:3], columns[3:5], columns[5:]
            new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            group = np.cumsum(new) - 1
            starts = np.append(np.nonzero(new)[0], len(group))
            sizes = np.diff(starts)
            whole = first & second
            little = np.isin(group, np.nonzero((sizes > 1) & (sizes <= SMALL))[0]) & whole
            yield from few([c[little] for c in members], group[little])
            for g in np.nonzero((sizes > 1) & ((sizes > SMALL) | ~whole[starts[:-1]]))[0].tolist():
                part = slice(starts[g], starts[g + 1])
                yield from near([c[part] for c in members], first[part], second[part])

        def close(rows: list[list[np.ndarray]]):
            pairs, size = [], 0
            for a, b in found([np.concatenate(c) for c in zip(*rows, strict=True)]):
                if len(a):
                    pairs.append((a, b))
                    size += len(a)
                if size > PAIRS:
                    yield made(pairs)
                    pairs, size = [], 0
            if pairs:
                yield made(pairs)

        def made(pairs):
            a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)), unpacked(batch.column(8).to_pylist())]
            keys = columns[:3]
            differs = np.any([k != k[-1] for k in keys], axis=0)
            cut = int(np.nonzero(differs)[0][-1]) + 1 if differs.any() else 0
            if cut or held and any(held[-1][k][-1] != keys[k][-1] for k in range(3)):
                yield from close([*held, [c[:cut] for c in columns]])
                held = []
            held.append([c[cut:] for c in columns])
        if held:
            yield from close(held)

    cells = ["key", "i", "j"]
    ordered = grouped.select(*cells, "first", "second", "rep", "comp", "n", "point")
    return ordered.repartition(*cells).sortWithinPartitions(*cells).mapInArrow(run, "a long, b long").distinct()


def gathered(placed: DataFrame) -> DataFrame:
    """key, rep, as a table: sets that share one of their keys are under one key at least, which is the least rep that holds it; placed: rep, comp, keys."""
    # Keys of one component alone bring nothing together.
    spans = placed.select(F.explode("keys").alias("key"), "rep", "comp").groupBy("key")
    spans = spans.agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("rep").alias("head"), F.count("*").alias("rows"))
    mixed_keys = stored(spans.where("low <> high").select("key", "head", "rows"))
    # As joined(), but rows are told apart by the list of the hot keys, HOT at most: nearly all are cold, and go through one join.
    total = mixed_keys.agg(F.sum("rows")).first()[0] or 0
    hot = [r.key for r in mixed_keys.where(F.col("rows") * HOT >= total).select("key").collect()]
    rows, known = placed.select(F.explode("keys").alias("key"), "rep"), mixed_keys.drop("rows")
    met = rows.where(~F.col("key").isin(hot)).join(known, "key")
    if hot:
        met = met.unionByName(rows.where(F.col("key").isin(hot)).join(F.broadcast(known.where(F.col("key").isin(hot))), "key"))
    out = stored(met.select(F.col("head").alias("key"), "rep").distinct())
    drop(mixed_keys)
    return out


def celled(grouped: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of grouped with i, j, first, second: hot keys, dealt into blocks of BLOCK points, go to the cells of all pairs of their blocks.

    sizes: key, rows.
    """
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    large = sizes.where((F.col("rows") > BLOCK) & (F.col("rows") * HOT >= total))  # HOT rows at most
    blocks = F.coalesce(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int")
    mine = F.col("_block")
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"), (i == mine).alias("first"), (j == mine).alias("second"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: cell(F.least(k, mine), F.greatest(k, mine)))
    dealt = grouped.join(F.broadcast(large), "key", "left").withColumn("_blocks", blocks).withColumn("_block", block)
    return dealt.withColumn("_cell", F.explode(cells)).select(*grouped.columns, "_cell.*")


def bounded(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a stored table that the minima of their fine count vectors do not rule out; vectors: rep, fine. For tables with many pairs of few sets.

    Reps are dealt into blocks of about BLOCK, and a pair belongs to the cell of the blocks of both. A vector goes once to each cell that has pairs of it, and not once
    to each pair, so many pairs around one passage make no more of it; a task goes through its cells one by one, and holds one's vectors.
    """
    both = lambda df: df.select("a").union(df.select("b")).toDF("rep")
    blocks = F.lit(1 + both(pairs).distinct().count() // BLOCK)
    block = lambda rep: F.pmod(F.xxhash64(rep), blocks)
    placed = pairs.select(block("a").alias("i"), block("b").alias("j"), "a", "b")
    asked = placed.select("i", "j", F.col("a").alias("rep")).union(placed.select("i", "j", "b")).distinct().join(vectors, "rep")
    rows = asked.select("i", "j", F.lit(None).cast("long").alias("a"), F.col("rep").alias("b"), "fine").unionByName(placed.withColumn("fine", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        cell, held = None, {}
        for batch in pieces(batches, 4):
            out = []
            for i, j, a, b, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (i, j) != cell:
                    cell, held = (i, j), {}
                if a is None:
                    vector = np.frombuffer(expand(value), "<u4")
                    held[b] = vector, int(vector.sum())
                else:
                    (one, n), (two, m) = held[a], held[b]
                    if (100 + percent) * int(np.minimum(one, two).sum()) >= percent * (n + m):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], ["a", "b"])

    # Vectors come before the pairs of their cell: a is null.
    return rows.repartition("i", "j").sortWithinPartitions("i", "j", F.asc_nulls_first("a")).mapInArrow(run, "a long, b long")


def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs (a, b) of a stored table with value_a and value_b; values: rep, value. A value of a goes to that of b; the partners of a b that has more than BLOCK are dealt over several tasks."""
    salts = F.ceil(F.col("count") / BLOCK).cast("int").alias("salts")
    many = pairs.groupBy("b").count().where(F.col("count") > BLOCK).select("b", salts)  # one row for BLOCK pairs at most
    one = pairs.join(F.broadcast(many), "b", "left").join(values.toDF("a", "value_a"), "a")
    few = one.where("salts IS NULL").join(values.toDF("b", "value_b"), "b").select("a", "b", "value_a", "value_b")
    dealt = one.where("salts IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    copies = values.toDF("b", "value_b").join(F.broadcast(many), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return few.unionByName(dealt.join(copies, ["b", "salt"]).select("a", "b", "value_a", "value_b"))


def verified(pairs: DataFrame, vectors: DataFrame, docs: DataFrame, n: int, percent: int, crowded: bool = False) -> DataFrame:
    """The pairs (a, b), as a table, whose sets are similar; vectors: rep, fine. crowded: there are many pairs of few sets, which are bounded by fine vectors in cells."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in pieces(batches):
            found = [shingles(text, hashes, n).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["rep", "value"])

    def filtered(rows: DataFrame, alike) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 2):
                keep = [alike(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        return rows.mapInArrow(compare, "a long, b long")

    def near(a: bytes, b: bytes) -> bool:
        expand = zstandard.ZstdDecompressor().decompress
        a, b = np.frombuffer(expand(a), "<u4"), np.frombuffer(expand(b), "<u4")
        return (100 + percent) * int(np.minimum(a, b).sum()) >= percent * int(a.sum() + b.sum())

    def linked(a: bytes, b: bytes) -> bool:
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= percent * (len(a) + len(b) - both)

    given = stored(pairs)
    pairs = stored(bounded(given, vectors, percent) if crowded else filtered(beside(given, vectors.withColumnRenamed("fine", "value")), near))
    drop(given)
    wanted = pairs.select("a").union(pairs.select("b")).toDF("rep").distinct()
    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep", "left_semi")
    known = stored(rows.mapInArrow(sets, "rep long, value binary"))
    out = stored(filtered(beside(pairs, known), linked).distinct())
    drop(pairs, known)
    return out


def classes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row."""
    all_rows = stored(features(docs, n, percent))
    full = all_rows.where("n_shingles > 0")
    first = stored(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    ids = stored(all_rows.select("doc_id", "n_shingles"))
    members = stored(joined(full.select("doc_id", "digest"), first, ["digest"], "rows").select("doc_id", "rep").where("doc_id <> rep").distinct())
    # A representative's rows of that set are one; a doc_id with several texts may be the representative of several sets.
    own = full.select("digest", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "point", "fine", "anchors", "keys").dropDuplicates(["digest", "rep"])
    sets = stored(own.join(first.drop("rows"), ["digest", "rep"], "left_semi").drop("digest"))
    drop(all_rows, first)
    source = texts(docs)
    anchor = stored(sets.select(F.explode("anchors").alias("key"), "rep"))
    heads = stored(anchor.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("rows")).where("rows > 1"))
    stars = joined(anchor, heads, ["key"], "rows").where("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    vectors = sets.select("rep", "fine")
    linked = verified(stars, vectors, source, n, percent)
    drop(anchor, heads)
    early = components(linked)
    placed = sets.select("rep", "n", "point", "keys").join(early, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "rep"))
    placed = stored(placed.select("rep", "comp", F.col("n").cast("long").alias("n"), "point", "keys"))
    shared = gathered(placed)
    by_head = stored(shared.groupBy("key").agg(F.count("*").alias("rows")))
    late = verified(candidates(celled(shared.join(placed.drop("keys"), "rep"), by_head), percent), vectors, source, n, percent, crowded=True)
    drop(by_head, shared, placed, sets)
    same = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(linked.unionByName(late).unionByName(same))
    drop(linked, late, members)
    return ids.join(roots, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents whose component has no lower doc_id, with all their columns; of rows with the same doc_id and text, one."""
    kept = classes(docs, n, percent).where("doc_id = component_id").select("doc_id").distinct()
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")))
    if not repeated.isEmpty():
        again = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_id"]), "left_semi")
        copies = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy(F.xxhash64(*docs.columns))
        one = again.select("*", F.row_number().over(copies).alias("_copy")).where("_copy = 1").drop("_copy")
        docs = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["_id"]), "left_anti").unionByName(one)
    return docs.join(kept, docs["doc_id"] == kept["doc_id"], "left_semi")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The contract's classes over the whole documents table."""
    return classes(read(spark, sf_dir, "documents"))
