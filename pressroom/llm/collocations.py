"""Phrases that occur together more often than their parts would by chance.

Texts are put together into shards of one language and about SHARD bytes. A shard is a row of word numbers, and an FM-index over it gives
every n-gram up to a depth with its count: the interval of the rows that begin with a phrase becomes the intervals of the phrases one word longer to
the left by the Burrows-Wheeler transform, and lies within the interval of the phrase one word shorter on the right. The index is
sorted to the depth that is asked for, not further; the mapping between rows holds up to it.

Counts of shards are summed, and only phrases that are frequent in all are written out. A phrase can only be frequent if its words and pairs are, so shards hear which of
their words are before they look for pairs, and which of their pairs are before they look for longer phrases. What they send for that is a census: hashes of phrases
with counts, packed into blocks of a range of hashes, of which the frequent ones come back. Phrases that share a hash are counted together there, which lets some more pass but
none less; the counts themselves are then made of the phrases that passed, by their words. A phrase's extensions to both sides are the phrases one word longer that hold it.

Defined results: a null text is empty and a null language `und`. Repeated rows count each. Very long texts are cut into several shards between pieces, so a piece is
never cut. Texts without words, and languages without frequent phrases, give no rows; nor does an empty table. Ties are ranked by the bytes of the phrase. Columns
beyond lang and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.llm.common import pieces, read, stored

#: Bytes of text in a shard: what one task holds at a time.
SHARD = 16 << 20
#: Phrases that one task sums at a time in a census, about.
RANGE_ENTRIES = 2_000_000
#: Of a phrase's hash: 10^12 values.
HASH_BITS = 40
LEAST, LONGEST, TOP = 100, 5, 2000
#: A-Z in lower case, all that parts pieces as a full stop, tabs as blanks.
_BYTES = bytes(range(256)).lower().translate(bytes.maketrans(b",;:!?\n\v\f\r\t", b"........." + b" "))
_SHARDS = "shard string, lang string, words array<string>, counts array<bigint>, ids binary"
_CENSUS = "range int, shard string, packed binary"
_STOP = 0


class FmIndex:
    """Rows of a sequence of numbers (0 parts pieces) in the order of their first `depth` numbers, and its Burrows-Wheeler transform."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.sequence = np.append(sequence, np.full(1, _STOP, sequence.dtype))
        n, width, rank = len(self.sequence), 1, self.sequence
        order = None if depth > 1 else np.argsort(rank, kind="stable").astype(np.int32)
        while width < depth:
            # Numbers of 32 bits but for the key, as memory is what bounds a shard.
            key = rank.astype(np.int64)
            key *= int(rank.max()) + 1
            key[:-width] += rank[width:]
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.int32)
            width *= 2
        del rank
        self.order = order
        self.first = self.sequence[order]
        self.transform = self.sequence[order - 1]
        #: For each row, the row that begins one number further on.
        self.following = np.argsort(self.transform, kind="stable").astype(np.int32)

    def intervals(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length up to depth: a place of every phrase in the sequence, and how often it occurs."""
        below = np.zeros(len(self.order), np.int32)
        for _ in range(depth):
            # Extended to the left: the rows whose next one lies in an interval of the length before.
            inside = below[self.following]
            known = (self.first != _STOP) & (inside >= 0)
            new = np.append(True, (self.first[1:] != self.first[:-1]) | (inside[1:] != inside[:-1])) & known
            below = np.where(known, np.cumsum(new, dtype=np.int32) - np.int32(1), np.int32(-1))
            yield self.order[new], np.bincount(below[known], minlength=int(new.sum()))


def _tokens(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a translated text, and their numbers from 1 in order, 0 between pieces."""
    data = data.replace(b".", b" . ") + b" . "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.append(0, ends).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    seen = coded.dictionary
    blank, stop = pc.equal(seen, b" ").to_numpy(zero_copy_only=False), pc.equal(seen, b". ").to_numpy(zero_copy_only=False)
    number = np.where(blank, -1, np.where(stop, _STOP, np.cumsum(~(blank | stop)))).astype(np.int32)
    ids = number[coded.indices.to_numpy()]
    ids = ids[ids >= 0]
    words = pc.utf8_rtrim(seen.filter(pa.array(~(blank | stop))).cast(pa.string()), " ")
    # Frequent words get small numbers, which take less space.
    order = np.argsort(-np.bincount(ids, minlength=len(words) + 1)[1:], kind="stable")
    place = np.zeros(len(words) + 1, np.int32)
    place[order + 1] = np.arange(1, len(words) + 1)
    return words.take(pa.array(order)), _single_stops(place[ids])


def _single_stops(ids: np.ndarray) -> np.ndarray:
    return ids[np.append(True, (ids[1:] != _STOP) | (ids[:-1] != _STOP))]


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """A translated text in stretches of about `most` bytes that end between pieces."""
    at = 0
    while len(text) - at > most:
        end = text.find(b".", at + most) + 1 or len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """shard, lang, words (distinct), counts, ids (compressed numbers of words, from 1, 0 between pieces), stored."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, made = defaultdict(list), defaultdict(int), 0
        task = TaskContext.get().partitionId()

        def shard(lang: str) -> pa.RecordBatch:
            words, ids = _tokens(b".".join(held.pop(lang)))
            sizes.pop(lang)
            counts = np.bincount(ids, minlength=len(words) + 1)[1:]
            columns = [pa.array([f"{task}-{made}"]), pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([_packed_ids(ids)], pa.binary())], ["shard", "lang", "words", "counts", "ids"])

        for batch in pieces(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in _cut(text.encode().translate(_BYTES), size):
                    held[lang].append(part)
                    sizes[lang] += len(part)
                    if sizes[lang] >= size:
                        yield shard(lang)
                        made += 1
        for lang in list(held):
            yield shard(lang)
            made += 1

    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return stored(rows.mapInArrow(dealt, _SHARDS))


def _mixed(codes: np.ndarray, sequence: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Hashes of HASH_BITS bits of phrases, from those of their words."""
    out = np.full(len(places), length, np.uint64)
    for k in range(length):
        out = (out ^ codes[sequence[places + k]]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out >> np.uint64(64 - HASH_BITS)


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


_HASH_BYTES, _COUNT_BYTES, _ID_BYTES = HASH_BITS // 8, 5, 4


def _packed_ids(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(_planes(ids, _ID_BYTES))


def _packed(hashes: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of differences of sorted hashes, byte plane by byte plane, and their counts; for each range of hashes that has any."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    place = (hashes * np.uint64(ranges)) >> np.uint64(HASH_BITS)
    pack = zstandard.ZstdCompressor(level=1)
    for part in np.split(np.arange(len(hashes)), np.flatnonzero(np.diff(place)) + 1):
        if len(part):
            steps = np.diff(hashes[part], prepend=np.uint64(0))
            yield int(place[part[0]]), pack.compress(_planes(steps, _HASH_BYTES) + _planes(counts[part], _COUNT_BYTES))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // (_HASH_BYTES + _COUNT_BYTES)
    return np.cumsum(_from_planes(raw[: n * _HASH_BYTES], n, _HASH_BYTES), dtype=np.uint64), _from_planes(raw[n * _HASH_BYTES :], n, _COUNT_BYTES)


def _blocks(shard: str, hashes: np.ndarray, counts: np.ndarray, ranges: int, *more: tuple[int, bytes]) -> pa.Table:
    found = [*_packed(hashes, counts, ranges), *more]
    return pa.table([pa.array([r for r, _ in found], pa.int32()), pa.array([shard] * len(found), pa.string()), pa.array([b for _, b in found], pa.binary())], ["range", "shard", "packed"])


def _frequent(census: DataFrame, least: int) -> DataFrame:
    """shard, packed: of a census (range, shard, packed), the hashes of each shard that are counted `least` times or more in all."""

    def summed(blocks: pa.Table) -> pa.Table:
        parts = [_unpacked(b.as_py()) for b in blocks["packed"]]
        hashes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
        many = hashes[order][starts][np.add.reduceat(counts[order], starts) >= least]
        shards, packed = [], []
        for shard, (own, _) in zip(blocks["shard"].to_pylist(), parts, strict=True):
            kept = own[np.isin(own, many, assume_unique=False)]
            for _, block in _packed(kept, np.zeros(len(kept), np.uint64), 1):
                shards.append(shard)
                packed.append(block)
        return pa.table([pa.array(shards, pa.string()), pa.array(packed, pa.binary())], ["shard", "packed"])

    return census.groupBy("range").applyInArrow(summed, "shard string, packed binary")


def _heard(known: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows of a shard's frequent words, and the sorted hashes of its frequent phrases."""
    blocks = [_unpacked(b)[0] for b in known["packed"].to_pylist() if b is not None]
    return known.filter(pc.is_valid(known["number"])), np.sort(np.concatenate([np.zeros(0, np.uint64), *blocks]))


def _codes(words: pa.Table) -> np.ndarray:
    """The hash of each of a shard's frequent words, by its number."""
    numbers = words["number"].to_numpy()
    codes = np.zeros(int(numbers.max()) + 1, np.uint64)
    codes[numbers] = words["code"].to_numpy().view(np.uint64)
    return codes


def _ids(index: pa.Table) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(index["ids"][0].as_py())
    return _from_planes(raw, len(raw) // _ID_BYTES, _ID_BYTES).astype(np.int32)


def _among(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(found), bool)
    return known[np.minimum(np.searchsorted(known, found), len(known) - 1)] == found


def _pair_census(ranges: int):
    def run(index: pa.Table, known: pa.Table) -> pa.Table:
        """The pairs of a shard's frequent words."""
        if not index.num_rows or not known.num_rows:
            return _blocks("", np.zeros(0, np.uint64), np.zeros(0, np.uint64), ranges)
        ids, codes = _ids(index), _codes(known)
        frequent = np.zeros(int(max(ids.max(initial=0), known["number"].to_numpy().max())) + 1, bool)
        frequent[known["number"].to_numpy()] = True
        fm = FmIndex(_single_stops(np.where(frequent[ids], ids, _STOP)), 2)
        *_, (places, counts) = fm.intervals(2)
        return _blocks(index["shard"][0].as_py(), _mixed(codes, fm.sequence, places, 2), counts, ranges)

    return run


def _longer_census(ranges: int, longest: int):
    def run(index: pa.Table, known: pa.Table) -> pa.Table:
        """The phrases of three words and more of a shard all of whose pairs are frequent; and, as range -1, what is left of its sequence."""
        words, pairs = _heard(known)
        if not index.num_rows or not words.num_rows or not len(pairs):
            return _blocks("", np.zeros(0, np.uint64), np.zeros(0, np.uint64), ranges)
        ids, codes = _ids(index), _codes(words)
        codes = np.append(codes, np.zeros(max(0, int(ids.max(initial=0)) + 1 - len(codes)), np.uint64))
        both = (codes[ids[:-1]] != 0) & (codes[ids[1:]] != 0)
        at = np.flatnonzero(both)
        linked = np.zeros(len(ids), bool)
        linked[at[_among(_mixed(codes, ids, at, 2), pairs)]] = True
        kept = linked | np.append(False, linked[:-1])
        ends = ~linked[kept]
        sequence = np.full(int(kept.sum() + ends.sum()), _STOP, np.int32)
        sequence[np.arange(len(ends)) + np.cumsum(ends) - ends] = ids[kept]
        fm, found = FmIndex(sequence, longest), [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for length, (places, counts) in enumerate(fm.intervals(longest), 1):
            if length > 2:
                found.append((_mixed(codes, fm.sequence, places, length), counts))
        hashes, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        return _blocks(index["shard"][0].as_py(), hashes, counts, ranges, (-1, _packed_ids(sequence)))

    return run


def _counted(ranges: int, longest: int):
    names = {"phrase": pa.string(), "words": pa.int32(), "count": pa.int64()}

    def run(index: pa.Table, known: pa.Table) -> pa.Table:
        """range, lang, and lists phrase, words, count: a shard's phrases of two words and more that passed, a row for each range of their hashes."""
        words, longer = _heard(known)
        hashes, out, lang = [np.zeros(0, np.uint64)], [pa.table({n: pa.array([], kind) for n, kind in names.items()})], ""
        if index.num_rows and words.num_rows:
            codes = _codes(words)
            row = np.zeros(len(codes), np.int64)
            row[words["number"].to_numpy()] = np.arange(words.num_rows)
            said, lang = words["phrase"].combine_chunks(), words["lang"][0].as_py()
            fm = FmIndex(_ids(index), longest)
            for length, (places, counts) in enumerate(fm.intervals(longest), 1):
                if length == 1:
                    continue
                own = _mixed(codes, fm.sequence, places, length)
                passed = _among(own, longer) if length > 2 else np.ones(len(own), bool)
                places, counts = places[passed], counts[passed]
                phrase = pc.binary_join_element_wise(*(said.take(pa.array(row[fm.sequence[places + k]])) for k in range(length)), " ")
                hashes.append(own[passed])
                out.append(pa.table([phrase, pa.array(np.full(len(places), length, np.int32)), pa.array(counts, pa.int64())], schema=out[0].schema))
        place = ((np.concatenate(hashes) * np.uint64(ranges)) >> np.uint64(HASH_BITS)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(place[order]) != 0)[: len(place)])
        found = pa.concat_tables(out).take(pa.array(order))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)), pa.int32()), found[n].combine_chunks()) for n in names]
        return pa.table([pa.array(place[order][starts]), pa.array([lang] * len(starts), pa.string()), *lists], ["range", "lang", *names])

    return run


def _summed(least: int):
    def run(lists: pa.Table) -> pa.Table:
        """lang, phrase, words, count: sums of a range's lists, from `least` on."""
        sizes = pc.list_value_length(lists["count"]).to_numpy()
        langs = lists["lang"].take(pa.array(np.repeat(np.arange(lists.num_rows), sizes)))
        flat = pa.table([langs, *(pc.list_flatten(lists[n]) for n in ("phrase", "words", "count"))], ["lang", "phrase", "words", "count"])
        sums = flat.group_by(["lang", "phrase", "words"]).aggregate([("count", "sum")]).rename_columns(["lang", "phrase", "words", "count"])
        return sums.filter(pc.greater_equal(sums["count"], least))

    return run


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words (their number), count of all phrases of one to `longest` words that occur `least` times or more; and lang, n: occurrences of all words.

    most_left and most_right: how often the phrase's most frequent extension by a word on that side occurs, null if less than `least` times or longer than `longest`.
    """
    index = shards(docs, size)
    totals = index.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    ranges = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // RANGE_ENTRIES
    each = index.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w"))
    each = each.select("shard", "lang", (F.col("number") + 1).alias("number"), F.col("w.words").alias("phrase"), F.col("w.counts").alias("count"))
    in_all = F.sum("count").over(Window.partitionBy("lang", "phrase")).alias("f")
    # No hash is 0, which stands for words that are not frequent.
    code = F.coalesce(F.nullif(F.xxhash64("lang", "phrase"), F.lit(0).cast("long")), F.lit(1).cast("long")).alias("code")
    words = stored(each.select("shard", "lang", "number", "phrase", in_all).where(F.col("f") >= least).select("*", code))
    found = words.groupBy("lang", "phrase").agg(F.lit(1).alias("words"), F.max("f").alias("count"))
    if longest > 1:
        sequences = index.select("shard", "ids").groupBy("shard")
        nothing = F.lit(None).cast("binary").alias("packed")
        passed = lambda census: census.select("shard", *(F.lit(None).cast(kind).alias(c) for c, kind in words.select("number", "code", "lang", "phrase").dtypes), "packed")
        heard = words.select("shard", "number", "code", "lang", "phrase", nothing)
        census = sequences.cogroup(words.select("shard", "number", "code").groupBy("shard")).applyInArrow(_pair_census(ranges), _CENSUS)
        # Stored, so that the census behind them need not last while the next one is taken.
        pairs = stored(_frequent(census, least))
        known = heard.drop("lang", "phrase").unionByName(passed(pairs).drop("lang", "phrase"))
        census = stored(sequences.cogroup(known.groupBy("shard")).applyInArrow(_longer_census(ranges, longest), _CENSUS))
        rest = census.where("range = -1").select("shard", F.col("packed").alias("ids"))
        known = heard.unionByName(passed(_frequent(census.where("range >= 0"), least)))
        lists = rest.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_counted(ranges, longest), "range int, lang string, phrase array<string>, words array<int>, count array<bigint>")
        found = found.unionByName(lists.groupBy("range").applyInArrow(_summed(least), "lang string, phrase string, words int, count long"))
    found = stored(found)
    blank = F.length("phrase") - F.length(F.substring_index("phrase", " ", -1)) - 1
    shorter = F.array(
        F.struct(F.substring("phrase", F.length(F.substring_index("phrase", " ", 1)) + 2, F.length("phrase")).alias("phrase"), F.lit(True).alias("left")),
        F.struct(F.substring("phrase", F.lit(1), blank).alias("phrase"), F.lit(False).alias("left")),
    )
    extended = found.where("words > 1").select("lang", F.explode(shorter).alias("s"), "count").select("lang", "s.*", "count")
    extended = extended.groupBy("lang", "phrase").agg(F.max(F.when(F.col("left"), F.col("count"))).alias("most_left"), F.max(F.when(~F.col("left"), F.col("count"))).alias("most_right"))
    return found.join(extended, ["lang", "phrase"], "left"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    a: the phrase's count; l, r: counts of its parts at the cut where 1000 * a * n / (l * r), floored, is least (ties: the first cut); n: words of the language. Phrases that a longer one holds and that
    occur no more often than it are left out. A longer one of several words more need not be looked for: what lies between occurs as often.
    """
    known, totals = phrases(docs, least, longest, size)
    whole = known.where("words > 1 AND greatest(most_left, most_right, 0) < count").select("lang", "phrase", F.col("count").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = whole.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    counted = known.select("lang", "phrase", "count")
    cuts = cuts.join(counted.toDF("lang", "first", "l"), ["lang", "first"]).join(counted.toDF("lang", "rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # Decimals of 38 digits: exact far beyond 64 bits.
    score = F.expr("(1000BD * CAST(a AS DECIMAL(17, 0)) * CAST(n AS DECIMAL(17, 0))) DIV (CAST(l AS DECIMAL(17, 0)) * CAST(r AS DECIMAL(17, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within parts of a language, so that one task never ranks all of its phrases.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of every language of the whole documents table."""
    return collocations(read(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM pieces)" for m in range(1, LONGEST + 1))
#: The same in SQL, all n-grams counted.
ORACLE_SQL = rf"""WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM split),
  f AS (SELECT lang, m, phrase, count(*) AS n FROM ({_GRAMS}) GROUP BY ALL),
  totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
  cands AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= {LEAST}),
  kept AS (SELECT * FROM cands c WHERE NOT EXISTS (SELECT 1 FROM cands d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
  cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
  scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.n AS l, r.n AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
  lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= {TOP}"""
