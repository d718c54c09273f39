"""The duplicate cascade: exact URL, near title, shared entities, similar vectors, and what follows from them.

Articles come in the order of (crawled_at, id); an article may only be the duplicate of an earlier one.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions.text import hamming, preprocess_title, simhash64, title_tokens
from pressroom.functions.urls import url_hash
from pressroom.lineage import cut, drop
from pressroom.operators.vectors import similar_vectors
from pressroom.ordered import running

__all__ = ["cascade", "cascade_pairs", "dedup_rate", "dedup_summary", "exact_url", "near_titles", "shared_entities", "similar_vectors", "with_simhash"]

HOUR = 3_600_000_000
#: Articles, their keys and their pairs of similar vectors, together, that a task of the cascade goes through in order.
STRETCH_ROWS = 200_000
_NEVER = -(2**62)


def exact_url(articles: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """L1: id, url_hash, duplicate_of: the earliest row of the same normalised URL, null on that row itself.

    Rows of `history` (id, url_hash) come before all others. A null URL equals no other.
    """
    hashed = articles.select("id", "crawled_at", url_hash(F.col("url")).alias("url_hash"))
    known = hashed.where("url_hash IS NOT NULL").groupBy("url_hash").agg(F.min_by("id", F.struct("crawled_at", "id")).alias("first_id"))
    out = hashed.join(known, "url_hash", "left")
    first = F.when(F.col("first_id") != F.col("id"), F.col("first_id"))
    if history is not None:
        before = history.groupBy("url_hash").agg(F.min("id").alias("old_id"))
        out, first = out.join(before, "url_hash", "left"), F.coalesce("old_id", first)
    return out.select("id", "url_hash", first.alias("duplicate_of"))


def with_simhash(articles: DataFrame) -> DataFrame:
    """id, crawled_at, language, hash of the articles whose title has one."""
    title = preprocess_title(F.col("title"))
    hashed = articles.where(F.length(title) > 0).select(
        "id", "crawled_at", F.coalesce("language", F.lit("en")).alias("language"), simhash64(title_tokens(title, F.col("language"))).alias("hash")
    )
    return hashed.where("hash <> 0")


def near_hashes(hashes: DataFrame, distance: int) -> DataFrame:
    """language, hash, other, distance: the different hashes of a language at most `distance` bits (up to 3) apart, other in the same week or the one before.

    They agree on one of four bands of 16 bits; articles of one hash and week are one row here, whatever their number.
    """
    bands = F.posexplode(F.array(*(F.shiftrightunsigned("hash", 16 * k).bitwiseAND(0xFFFF) for k in range(4)))).alias("band", "bits")
    banded = hashes.select("language", "hash", "week", bands)
    both = banded.select("language", F.col("hash").alias("other"), F.explode(F.array("week", F.col("week") + 1)).alias("week"), "band", "bits").distinct()
    apart = hamming(F.col("hash"), F.col("other"))
    pairs = banded.join(both, ["language", "week", "band", "bits"]).where((F.col("hash") != F.col("other")) & (apart <= distance))
    return pairs.select("language", "hash", "other", apart.alias("distance")).distinct()


def earliest_within(probes: DataFrame, rows: DataFrame, key: list[str], hours: int) -> DataFrame:
    """probes with `other`: the least id of the rows of the same key before the probe, but less than `hours` before; null if none.

    Hours in between are looked up by their least ids, the two hours at the ends by running minima, so a key shared by
    very many rows is split by the hour and costs no more than sorting them.
    """
    time = F.unix_micros("crawled_at")
    hour = F.floor(F.col("_t") / HOUR).alias("_hour")
    e = rows.select(*key, time.alias("_t"), F.col("id").alias("_row")).select("*", hour)
    p = probes.withColumn("_t", time).withColumn("_hour", F.floor(F.col("_t") / HOUR))
    none = F.lit(None).cast("long")

    def edge(back: int, order) -> DataFrame:
        """Least id of the rows on the right side of each probe within its hour, `back` hours ago."""
        asked = p.select(*key, (F.col("_hour") - back).alias("_hour"), (F.col("_t") - back * HOUR).alias("_t"), F.col("id").alias("_id"), none.alias("_row"))
        both = asked.unionByName(e.select(*key, "_hour", "_t", F.col("_row").alias("_id"), "_row"))
        seen = Window.partitionBy(*key, "_hour").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_least", F.min("_row").over(seen)).where("_row IS NULL AND _least IS NOT NULL")
        return found.select(*key, F.col("_id").alias("id"), F.col("_least").alias("other"))

    # A probe comes before the row of the same time and id, which is itself; a row of just `hours` before is out.
    late = edge(0, [F.asc("_t"), F.asc("_id"), F.asc_nulls_first("_row")])
    soon = edge(hours, [F.desc("_t"), F.asc_nulls_first("_row")])
    by_hour = e.groupBy(*key, "_hour").agg(F.min("_row").alias("_row"))
    asked = p.select(*key, "_hour").distinct().withColumn("_row", none)
    between = Window.partitionBy(*key).orderBy("_hour").rangeBetween(-hours + 1, -1)
    middle = asked.withColumn("_asked", F.lit(True)).unionByName(by_hour.withColumn("_asked", F.lit(False)))
    middle = middle.withColumn("other", F.min("_row").over(between)).where("_asked AND other IS NOT NULL")
    middle = p.join(middle.select(*key, "_hour", "other"), [*key, "_hour"]).select(*key, "id", "other")
    found = late.unionByName(soon).unionByName(middle).groupBy(*key, "id").agg(F.min("other").alias("other"))
    return probes.join(found, [*key, "id"], "left")


def near_titles(articles: DataFrame, distance: int = 3, days: int = 7) -> DataFrame:
    """L2: id, duplicate_of, distance: the nearest earlier title of the same language within the look-back; ties go to the lowest id."""
    hashed = cut(with_simhash(articles))
    week = F.floor(F.unix_micros("crawled_at") / (HOUR * 24 * days)).alias("week")
    near = near_hashes(hashed.select("language", "hash", week).distinct(), distance)
    same = hashed.select("id", "crawled_at", "language", "hash", F.lit(0).alias("distance"))
    others = hashed.join(near, ["language", "hash"]).select("id", "crawled_at", "language", F.col("other").alias("hash"), "distance")
    found = earliest_within(same.unionByName(others), hashed, ["language", "hash"], 24 * days).where("other IS NOT NULL")
    best = F.min(F.struct("distance", "other"))
    return found.groupBy("id").agg(best.alias("b")).select("id", F.col("b.other").alias("duplicate_of"), F.col("b.distance").alias("distance"))


def _earlier(later: str, earlier: str):
    at = lambda side: F.struct(F.col(f"{side}.crawled_at"), F.col(f"{side}.id"))
    return at(earlier) < at(later)


def shared_entities(articles: DataFrame, least: int = 2, hours: int = 24) -> DataFrame:
    """L3 candidates: id, other (earlier, same language, within the look-back), overlap of at least `least` entities.

    articles: id, crawled_at, language, entities array<string>. Two shared entities are a shared pair, so
    articles meet by pairs of entities and by time, never by one popular name.
    """
    known = articles.select("id", "crawled_at", "language", "entities").where(F.size("entities") >= least)
    pairs = F.flatten(F.transform("entities", lambda a, i: F.transform(F.slice("entities", i + 2, F.size("entities")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    if least == 1:
        pairs = F.transform("entities", lambda a: F.struct(a.alias("a"), a.alias("b")))
    bucket = F.floor(F.unix_micros("crawled_at") / (HOUR * hours))
    keyed = known.select("*", bucket.alias("bucket"), F.explode(pairs).alias("pair"))
    later, earlier = keyed.alias("l"), keyed.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") + 1))).alias("e")
    same = [F.col(f"l.{c}") == F.col(f"e.{c}") for c in ("language", "bucket", "pair")]
    back = F.col("e.crawled_at") > F.col("l.crawled_at") - F.expr(f"INTERVAL {hours} HOURS")
    met = later.join(earlier, [*same, back, _earlier("l", "e")])
    overlap = F.size(F.array_intersect("l.entities", "e.entities"))
    return met.select(F.col("l.id").alias("id"), F.col("e.id").alias("other"), overlap.alias("overlap")).distinct()


def pair_keys(language: Column, entities: Column, least: int = 2) -> Column:
    """A text for every two entities of an article, together with its language; none for fewer entities or no language."""
    entities = F.array_sort(F.array_distinct(entities))
    pairs = F.flatten(F.transform(entities, lambda a, i: F.transform(F.slice(entities, i + 2, F.size(entities)), lambda b: F.to_json(F.array(language, a, b)))))
    return F.when(language.isNotNull() & (F.size(entities) >= least), pairs).otherwise(F.array().cast("array<string>"))


def _decided(look_back: int):
    def run(articles: pd.DataFrame, context: pd.DataFrame) -> pd.DataFrame:
        """What an article's stretch of time decides, one article after the other.

        articles: id, t, keys, all undecided. context: what came before the stretch (kind 0: a key's last original and last undecided article), its own
        originals (kind 1), and similar vectors (kind 2: other, state 1 if that is an original, 2 if undecided). An article that has an original in reach is a duplicate; one
        that has neither that nor an undecided one is an original; all others wait.
        """
        originals: dict[str, int] = {}
        waiting: dict[str, int] = {}
        alike: dict[int, list[tuple[int, int]]] = {}
        own, known = [], {}
        for kind, key, t, article, wait, other, state in context[["kind", "key", "t", "id", "wait", "other", "state"]].itertuples(index=False):
            if kind == 0:
                originals[key], waiting[key] = t, wait
            elif kind == 1:
                own.append((t, article, key))
            else:
                alike.setdefault(article, []).append((other, state))
        own.sort(reverse=True)
        for t, article, keys in sorted(zip(articles["t"].tolist(), articles["id"].tolist(), articles["keys"], strict=True), key=lambda x: x[:2]):
            while own and own[-1][:2] < (t, article):
                at, _, key = own.pop()
                originals[key] = at
            others = [known.get(other, state) for other, state in alike.get(article, ())]
            if 1 in others or any(originals.get(k, _NEVER) > t - look_back for k in keys):
                known[article] = 0
            elif 2 in others or any(waiting.get(k, _NEVER) > t - look_back for k in keys):
                waiting.update(dict.fromkeys(keys, t))
            else:
                known[article] = 1
                originals.update(dict.fromkeys(keys, t))
        return pd.DataFrame({"id": list(known), "original": [v == 1 for v in known.values()]}).astype({"id": "int64", "original": "bool"})

    return run


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _last_of_key(rows: DataFrame, **latest: Column) -> DataFrame:
    """key, stretch and for each name the greatest value that the key has in earlier stretches: one row for each key of a stretch, whatever its number of articles."""
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    marks = rows.groupBy("key", "stretch").agg(*(F.max(value).alias(name) for name, value in latest.items()))
    return marks.select("key", "stretch", *(F.max(name).over(before).alias(name) for name in latest))


def cascade(articles: DataFrame, l2: DataFrame, l4: DataFrame, before: DataFrame | None = None, hours: int = 24) -> DataFrame:
    """id, dedup_level (2, 3, 4 or null), duplicate_of: the first level that hits, where L3 and L4 only point to originals.

    articles: id, crawled_at, language, entities; l2: id, duplicate_of; l4: id, other, cosine; before: originals decided earlier, as articles. L3 is the earlier original of
    the language within `hours` that shares most entities, two at least (ties: the latest). No pairs of articles are made for it: whatever shares two entities shares a key, and
    originals of a key are `hours` apart, so an article asks for the last original of each of its keys.

    Articles are dealt into stretches of time of about STRETCH_ROWS keys and vector pairs. In each round, tasks go through their stretches in order and decide what the last
    original and the last undecided article of every key before the stretch allow; the earliest undecided article is decided in every round. Rounds
    are few unless every article hangs on one of the stretch before.
    """
    # Each is read several times.
    l2, l4, articles = cut(l2.select("id", "duplicate_of")), cut(l4.select("id", "other", "cosine")), cut(articles.select("id", "crawled_at", "language", "entities"))
    titled = l2.select("id").distinct()
    rows = articles.select("id", "crawled_at", "language", "entities", F.lit(False).alias("known"))
    if before is not None:
        rows = rows.unionByName(before.select("id", "crawled_at", "language", "entities", F.lit(True).alias("known")))
    rows = rows.join(titled, "id", "left_anti")
    keys = F.coalesce(pair_keys(F.col("language"), F.col("entities")), F.array().cast("array<string>"))
    rows = rows.select("id", F.unix_micros("crawled_at").alias("t"), "known", keys.alias("keys"))
    edges = l4.select("id", "other").join(rows.where("NOT known").select("id"), "id")
    edges = edges.join(rows.select(F.col("id").alias("other"), F.when(F.col("known"), 1).otherwise(2).alias("state")), "other")
    weighed = rows.join(edges.groupBy("id").agg(F.count("*").alias("edges")), "id", "left").withColumn("weight", F.size("keys") + F.coalesce("edges", F.lit(0)) + 1)
    stretch = F.floor(F.col("before") / STRETCH_ROWS).alias("stretch")
    placed = cut(running(weighed, ["t", "id"], before=F.col("weight")).select("id", "t", "known", "keys", stretch))
    keyed = lambda df: df.select("stretch", "t", "id", F.explode("keys").alias("key"))

    left = cut(placed.where("NOT known").select("id", "t", "keys", "stretch"))
    edges = cut(edges.join(left.select("id", "stretch"), "id").select("stretch", "id", "other", "state"))
    origins, verdicts = [cut(keyed(placed.where("known")))], [cut(placed.where("known").select("id", F.lit(True).alias("original")))]
    never, none = F.lit(_NEVER), F.lit(-1).cast("long")
    while not left.isEmpty():
        original = _union(origins).withColumn("wait", F.lit(None).cast("long"))
        undecided = keyed(left).withColumn("wait", F.col("t"))
        last = _last_of_key(original.unionByName(undecided), t=F.when(F.col("wait").isNull(), F.col("t")), wait=F.col("wait"))
        context = _union(
            [
                last.where("t IS NOT NULL OR wait IS NOT NULL").select("stretch", F.lit(0).alias("kind"), "key", F.coalesce("t", never).alias("t"), none.alias("id"), F.coalesce("wait", never).alias("wait"), none.alias("other"), F.lit(0).alias("state")),
                original.select("stretch", F.lit(1).alias("kind"), "key", "t", "id", never.alias("wait"), none.alias("other"), F.lit(0).alias("state")),
                edges.select("stretch", F.lit(2).alias("kind"), F.lit("").alias("key"), never.alias("t"), "id", never.alias("wait"), "other", "state"),
            ]
        ).join(left.select("stretch").distinct(), "stretch", "left_semi")
        new = cut(left.groupBy("stretch").cogroup(context.groupBy("stretch")).applyInPandas(_decided(hours * HOUR), "id long, original boolean"))
        verdicts.append(new)
        origins.append(cut(keyed(left.join(new.where("original"), "id", "left_semi"))))
        open_edges = edges.join(new.select("id"), "id", "left_anti").join(new.toDF("other", "_now"), "other", "left").where("_now IS NULL OR _now")
        after = cut(left.join(new.select("id"), "id", "left_anti")), cut(open_edges.select("stretch", "id", "other", F.when(F.col("_now"), 1).otherwise(F.col("state")).alias("state")))
        drop(left, edges)
        left, edges = after
    drop(left, edges)
    decided = _union(verdicts)
    duplicates = placed.join(decided.where("NOT original"), "id", "left_semi")
    original, asking = _union(origins), keyed(duplicates)
    # The last original of each key before an article, in its stretch or before that.
    both = original.withColumn("found", F.struct("t", F.col("id").alias("other"))).unionByName(asking.withColumn("found", F.lit(None).cast("struct<t: long, other: long>")))
    within = Window.partitionBy("key", "stretch").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    in_order = both.select("key", "stretch", "t", "id", "found", F.last("found", ignorenulls=True).over(within).alias("own")).where("found IS NULL")
    asked = in_order.join(_last_of_key(both, last=F.col("found")), ["key", "stretch"], "left").withColumn("hit", F.coalesce("own", "last"))
    met = asked.where(F.col("hit.t") > F.col("t") - hours * HOUR).select("id", F.col("hit.other").alias("other")).distinct()
    named = articles.select("id", "crawled_at", "entities")
    others = named if before is None else named.unionByName(before.select(named.columns))
    met = met.join(named.select("id", F.col("entities").alias("mine")), "id").join(others.toDF("other", "at", "theirs"), "other")
    best3 = met.groupBy("id").agg(F.max_by("other", F.struct(F.size(F.array_intersect("mine", "theirs")), "at", "other")).alias("d3"))
    best4 = l4.join(duplicates.select("id"), "id", "left_semi").join(decided.where("original").select(F.col("id").alias("other")), "other", "left_semi")
    best4 = best4.groupBy("id").agg(F.max_by("other", F.struct("cosine", (-F.col("other")).alias("o"))).alias("d4"))
    out = articles.select("id").join(l2.withColumnRenamed("duplicate_of", "d2"), "id", "left").join(best3, "id", "left").join(best4, "id", "left")
    level = F.when(F.col("d2").isNotNull(), 2).when(F.col("d3").isNotNull(), 3).when(F.col("d4").isNotNull(), 4)
    return out.select("id", level.alias("dedup_level"), F.coalesce("d2", "d3", "d4").alias("duplicate_of"))


def cascade_pairs(l1: DataFrame, l2: DataFrame, l3: DataFrame, l4: DataFrame) -> DataFrame:
    """id, other, level: the pairs of all levels (id and the earlier id each), each at its first level."""
    levels = [df.toDF("id", "other").withColumn("level", F.lit(k)) for k, df in enumerate((l1, l2, l3, l4), 1)]
    union = levels[0]
    for df in levels[1:]:
        union = union.unionByName(df)
    return union.groupBy("id", "other").agg(F.min("level").alias("level"))


def dedup_summary(articles: DataFrame) -> DataFrame:
    """is_duplicate, dedup_level, count."""
    return articles.groupBy("is_duplicate", "dedup_level").count()


def dedup_rate(articles: DataFrame) -> DataFrame:
    """total, duplicates, rate in percent, rounded to 2."""
    out = articles.agg(F.count("*").alias("total"), F.count_if("is_duplicate").alias("duplicates"))
    return out.withColumn("rate", F.when(F.col("total") > 0, F.round(100.0 * F.col("duplicates") / F.col("total"), 2)).otherwise(0.0))
