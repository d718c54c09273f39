"""The duplicate cascade against plain replays and all pairs."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressroom import views
from pressroom.operators import clusters, dedup, entities, vectors
from pressroom.plans import dedup as plans

DATA = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
ARTICLE = "id long, crawled_at timestamp, language string, title string"


def test_near_titles_against_all_pairs(spark):
    """Hot titles, equal times, hour and window edges, titles a few bits apart, null and empty ones."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    long_one = " ".join(words)
    titles = [long_one, long_one + " x", long_one + " y z", "hot title of the day", "", None, "!!"]
    rows = []
    for k in range(400):
        at = START + timedelta(hours=rng.choice([0, 1, 24, 167, 168, 169, 336, 337]), seconds=rng.choice([0, 0, 1, 1800, 3599]))
        rows.append((k, at, rng.choice(["en", "de", None]), rng.choice(titles)))
    df = spark.createDataFrame(rows, ARTICLE)
    hashes = {r.id: (r.hash, r.language, r.crawled_at) for r in dedup.with_simhash(df).collect()}
    assert {bin(a[0] ^ b[0]).count("1") for a in hashes.values() for b in hashes.values()} & {1, 2, 3}
    wanted = {}
    for a, (h, lang, at) in hashes.items():
        near = [(bin(h ^ g).count("1"), b) for b, (g, other, t) in hashes.items() if other == lang and (t, b) < (at, a) and t > at - timedelta(days=7)]
        near = [n for n in near if n[0] <= 3]
        if near:
            wanted[a] = min(near)
    assert {r.id: (r.distance, r.duplicate_of) for r in dedup.near_titles(df).collect()} == wanted


def test_near_hashes_finds_every_pair(spark):
    rng = random.Random(1)
    hashes = [rng.getrandbits(63) for _ in range(60)]
    for h in hashes[:40]:
        for _ in range(3):
            flipped = h
            for bit in rng.sample(range(63), rng.randint(1, 4)):
                flipped ^= 1 << bit
            hashes.append(flipped)
    weeks = {h: rng.randint(0, 2) for h in hashes}
    found = dedup.near_hashes(spark.createDataFrame([("en", h, w) for h, w in weeks.items()], "language string, hash long, week long"), 3)
    wanted = {(a, b, bin(a ^ b).count("1")) for a in weeks for b in weeks if a != b and bin(a ^ b).count("1") <= 3 and weeks[a] - weeks[b] in (0, 1)}
    assert {(r.hash, r.other, r.distance) for r in found.collect()} == wanted


def test_exact_url_with_history_and_null(spark):
    rows = [(5, "http://a.com/x", 0), (1, "http://www.a.com/x/", 9), (2, None, 0), (3, None, 1), (4, "http://a.com/old#z", 2)]
    df = spark.createDataFrame(rows, "id long, url string, at int").withColumn("crawled_at", F.timestamp_seconds("at"))
    found = {r.id: r.duplicate_of for r in dedup.exact_url(df).collect()}
    assert found == {5: None, 1: 5, 2: None, 3: None, 4: None}
    history = dedup.exact_url(df.where("id = 4")).select(F.lit(99).cast("long").alias("id"), "url_hash")
    assert {r.id: r.duplicate_of for r in dedup.exact_url(df, history).collect()} == found | {4: 99}
    assert dedup.exact_url(df.where("id < 0")).count() == 0


def replay(articles, l2, l3, l4):
    """One article after the other, as they come."""
    duplicates, out = set(), {}
    for a in articles:
        hit = (2, l2[a]) if a in l2 else None
        if not hit:
            best = [(overlap, at, other) for other, overlap, at in l3.get(a, []) if other not in duplicates]
            hit = (3, max(best)[2]) if best else None
        if not hit:
            best = [(cosine, -other) for other, cosine in l4.get(a, []) if other not in duplicates]
            hit = (4, -max(best)[1]) if best else None
        if hit:
            duplicates.add(a)
        out[a] = hit or (None, None)
    return out


def _replayed(articles, l2, l4):
    """replay() over all pairs that shared_entities gives."""
    at = {r.id: r.crawled_at for r in articles.select("id", "crawled_at").collect()}
    by_id3, by_id4 = {}, {}
    for r in dedup.shared_entities(articles).collect():
        by_id3.setdefault(r.id, []).append((r.other, r.overlap, at[r.other]))
    for r in l4.collect():
        by_id4.setdefault(r.id, []).append((r.other, r.cosine))
    return replay(sorted(at, key=lambda a: (at[a], a)), {r.id: r.duplicate_of for r in l2.collect()}, by_id3, by_id4)


def _verdicts(df):
    return {r.id: (r.dedup_level, r.duplicate_of) for r in df.collect()}


@pytest.mark.parametrize("stretch", [200_000, 300, 7])
def test_cascade_against_replay(spark, monkeypatch, stretch):
    """In one stretch, in several, and in stretches of a few articles."""
    monkeypatch.setattr(dedup, "STRETCH_ROWS", stretch)
    named, l2, _, l4 = plans._levels(spark, DATA)
    found = _verdicts(dedup.cascade(named, l2, l4))
    assert {level for level, _ in found.values()} >= {None, 2, 3}
    assert found == _replayed(named, l2, l4)


ENTITIES = "id long, crawled_at timestamp, language string, entities array<string>"
L2, L4 = "id long, duplicate_of long, distance int", "id long, other long, cosine double"


@pytest.mark.parametrize("stretch", [100_000, 25])
def test_cascade_of_random_articles(spark, monkeypatch, stretch):
    """Equal times, look-backs just met and just missed, missing languages and entities, chains by vectors across languages."""
    monkeypatch.setattr(dedup, "STRETCH_ROWS", stretch)
    rng = random.Random(8)
    rows = []
    for k in range(160):
        at = START + timedelta(hours=rng.choice([0, 6, 23, 24, 25, 47, 48, 70]), seconds=rng.choice([0, 0, 1]))
        names = sorted(rng.sample("abcdefghij", rng.randrange(5)))
        rows.append((k, at, rng.choice(["en", "en", "de", None]), None if k % 31 == 0 else names))
    articles = spark.createDataFrame(rows, ENTITIES)
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    l2 = spark.createDataFrame([(order[k], order[k // 2], 1) for k in range(3, 160, 17)], L2)
    l4 = spark.createDataFrame([(order[k], order[k - back], 0.9 - back / 100) for k in range(9, 160, 4) for back in (1, 2, 7)], L4)
    found = _verdicts(dedup.cascade(articles, l2, l4))
    assert {level for level, _ in found.values()} == {None, 2, 3, 4}
    assert found == _replayed(articles, l2, l4)


def test_cascade_writes_no_pairs(spark, monkeypatch):
    """A thousand articles of two days that all share two names."""
    written = []
    monkeypatch.setattr(dedup, "cut", lambda df, real=dedup.cut: (written.append(out := real(df)), out)[1])
    monkeypatch.setattr(dedup, "drop", lambda *_: None)
    monkeypatch.setattr(dedup, "STRETCH_ROWS", 200)
    rows = [(k, START + timedelta(minutes=3 * k), "en", ["A", "B"]) for k in range(1000)]
    articles = spark.createDataFrame(rows, ENTITIES)
    none2, none4 = spark.createDataFrame([], L2), spark.createDataFrame([], L4)
    found = _verdicts(dedup.cascade(articles, none2, none4))
    originals = [k for k, (level, _) in found.items() if level is None]
    assert sorted(originals) == [0, 480, 960] and all(found[k] == (3, k - k % 480) for k in found if k % 480)
    assert max(df.count() for df in written) <= 1000


def test_cascade_with_earlier_originals(spark):
    """Decided before: 1 is an original. 2 is late and older than it, 3 and 4 have it in reach, 5 not."""
    hour = lambda k: START + timedelta(hours=k)
    before = spark.createDataFrame([(1, hour(10), "en", ["A", "B"])], ENTITIES)
    rows = [(2, hour(9), "en", ["A", "B", "C"]), (3, hour(11), "en", ["A", "B", "C"]), (4, hour(20), "en", ["B", "A"]), (5, hour(34), "en", ["A", "B"]), (6, hour(12), "en", [])]
    l4 = spark.createDataFrame([(6, 1, 0.9)], L4)
    found = _verdicts(dedup.cascade(spark.createDataFrame(rows, ENTITIES), spark.createDataFrame([], L2), l4, before))
    assert found == {2: (None, None), 3: (3, 2), 4: (3, 1), 5: (None, None), 6: (4, 1)}


def test_cascade_scenarios(spark):
    """A original, B like A, C only like B: C is an original. D has a near title of B: its cluster is A's. E's best match is a duplicate, its next no."""
    names = {1: "pq", 2: "pqrs", 3: "rs", 4: "rs", 5: "pqrs", 6: ""}
    articles = spark.createDataFrame([(k, START + timedelta(hours=k), "en", list(n)) for k, n in names.items()], ENTITIES)
    l2 = spark.createDataFrame([(4, 2, 1)], L2)
    l4 = spark.createDataFrame([(6, 2, 0.99), (6, 3, 0.9), (6, 1, 0.9)], L4)
    resolved = dedup.cascade(articles, l2, l4)
    assert _verdicts(resolved) == {1: (None, None), 2: (3, 1), 3: (None, None), 4: (2, 2), 5: (3, 3), 6: (4, 1)}
    assert {r.id: r.cluster for r in clusters.assign_clusters(resolved).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 3, 6: 1}
    assert dedup.cascade(articles.where("id < 0"), l2.where("false"), l4.where("false")).count() == 0


def test_shared_entities_limits(spark):
    day = timedelta(hours=24)
    rows = [(1, START, "en", ["A", "B", "C"]), (2, START + day, "en", ["A", "B"]), (3, START + day - timedelta(seconds=1), "en", ["B", "C"]), (4, START, "de", ["A", "B"]), (5, START, "en", ["A"])]
    df = spark.createDataFrame(rows, "id long, crawled_at timestamp, language string, entities array<string>")
    assert [tuple(r) for r in dedup.shared_entities(df).collect()] == [(3, 1, 2)]


@pytest.fixture(scope="module")
def close_vectors(spark):
    """Vectors with near copies, one of zeros and one missing; and the pairs above 0.85 within three days."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    near = base[:20] + rng.standard_normal((20, 64)) * 0.3
    rows = np.concatenate([base, near, np.zeros((1, 64))])
    at = [START + timedelta(hours=int(h)) for h in rng.integers(0, 200, len(rows))]
    df = spark.createDataFrame([(k, at[k], v.tolist()) for k, v in enumerate(rows)] + [(500, START, None)], "id long, crawled_at timestamp, embedding array<double>")
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    cosine = unit @ unit.T
    wanted = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if (at[j], j) < (at[i], i) and at[j] > at[i] - timedelta(days=3) and cosine[i, j] > 0.85}
    assert len(wanted) > 5
    return df.cache(), wanted


@pytest.mark.parametrize("block", [2000, 7])
def test_similar_vectors(spark, monkeypatch, close_vectors, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    df, wanted = close_vectors
    assert {(r.id, r.other) for r in vectors.similar_vectors(df).collect()} == wanted
    centres = vectors.train(df, 8)
    assert {(r.id, r.other) for r in vectors.similar_vectors(df, centres=centres).collect()} == wanted
    counts = vectors.recall_of(vectors.similar_vectors(df, centres=centres, probes=2), vectors.similar_vectors(df)).first()
    assert counts.exact == len(wanted) and counts.recall >= 0.9
    assert vectors.similar_vectors(df.where("id < 0"), centres=vectors.train(df.where("id < 0"), 4)).count() == 0


def test_cells_and_probes_for_a_recall(spark):
    """Cells are the same however the vectors lie in partitions; so many are probed that the share asked for is found, all of them where there is nothing to measure."""
    draw = random.Random(3)
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=20 * k), [draw.gauss(0, 1) for _ in range(16)]) for k in range(1500)]
    df = spark.createDataFrame(rows, "id long, crawled_at timestamp, embedding array<double>")
    centres, again = (vectors.train(df.repartition(n, "crawled_at"), 16) for n in (1, 7))
    placed = lambda c: sorted([round(x, 9) for x in r.centre] for r in c.collect())
    assert placed(centres) == placed(again)
    few = vectors.recall_of(vectors.similar_vectors(df, 0.5, centres=centres, probes=3), vectors.similar_vectors(df, 0.5)).first()
    probes = vectors.probes_for(df, centres, 0.5, least=3)
    enough = vectors.recall_of(vectors.similar_vectors(df, 0.5, centres=centres, probes=probes), vectors.similar_vectors(df, 0.5)).first()
    assert few.recall < 0.9 <= enough.recall and 3 < probes < 16
    assert vectors.probes_for(df, centres, 0.5, least=15) == 15 and vectors.probes_for(df, centres, 0.999) == 16


def test_threshold_of_vectors(spark):
    edge = spark.createDataFrame([(1, START, [1.0, 0.0]), (2, START, [0.85, (1 - 0.85**2) ** 0.5])], "id long, crawled_at timestamp, embedding array<double>")
    assert vectors.similar_vectors(edge, 0.8500001).count() == 0 and vectors.similar_vectors(edge, 0.8499).count() == 1


def test_stored_vector_index(spark, close_vectors, tmp_path):
    """Look-backs are added one by one, and a search reads those it needs only."""
    df, wanted = close_vectors
    path, centres = f"file://{tmp_path}/index", vectors.train(df, 8)
    three_days = F.floor(F.unix_micros("crawled_at") / (3 * vectors.DAY))
    buckets = sorted(r[0] for r in df.select(three_days).distinct().collect())
    for b in [*buckets, buckets[0]]:
        vectors.write_index(df.where(three_days == b), centres, path)
    assert spark.read.parquet(f"{path}/vectors").count() == 81
    last = df.where(three_days == buckets[-1])
    found = vectors.search_index(last, path)
    ids = {r.id for r in last.collect()}
    assert {(r.id, r.other) for r in found.collect()} == {p for p in wanted if p[0] in ids}
    read = spark.read.parquet(f"{path}/vectors").where(F.col("bucket").between(buckets[-1] - 1, buckets[-1]))
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().toString()
    assert vectors.search_index(df.where("id < 0"), path).count() == 0


def test_cells_are_trained_on_a_sample(spark, monkeypatch, close_vectors):
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 30)
    df, wanted = close_vectors
    centres = vectors.train(df, 5)
    assert 1 < centres.count() <= 5
    assert {(r.id, r.other) for r in vectors.similar_vectors(df, centres=centres).collect()} == wanted


def test_entities(spark):
    known = spark.createDataFrame([("brand", "Toyota", "丰田"), ("brand", "Ram", "ram"), ("model", "Camry", "camry"), ("model", "911", "911")], "kind string, canonical string, alias string")
    rows = [(1, "Toyota Camry 2026", "Toyota announced the new Camry 2026."), (2, "丰田 program", "x" * 200 + "911"), (3, None, None), (4, "A 911, a RAM.", "")]
    df = spark.createDataFrame(rows, "id long, title string, content string")
    found = {r.id: (r.entities.brands, r.entities.models) for r in entities.extract_entities(df, known).collect()}
    assert found == {1: (["Toyota"], ["Camry"]), 2: (["Ram", "Toyota"], []), 3: ([], []), 4: (["Ram"], ["911"])}
    found = {r.id: (r.entities.brands, r.entities.models) for r in entities.extract_entities(df, known, word_boundary=True).collect()}
    assert found == {1: (["Toyota"], ["Camry"]), 2: (["Toyota"], []), 3: ([], []), 4: (["Ram"], ["911"])}


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_clusters_of_chains(spark, n):
    rows = [(k, k - 1 if k else None) for k in range(n)] + [(100, 999)]
    found = {r.id: r.cluster for r in clusters.assign_clusters(spark.createDataFrame(rows, "id long, duplicate_of long")).collect()}
    assert found == {k: 0 for k in range(n)} | {100: 100}


def test_cluster_scores(spark):
    rows = [(1, 1, "en", "US"), (2, 1, "de", "GB"), (3, 1, "de", "DE"), (4, 4, "en", "US"), (5, 5, "", None)]
    df = spark.createDataFrame(rows, "id long, cluster long, language string, country string").withColumn("crawled_at", F.timestamp_seconds("id"))
    assert {r.cluster: r.importance_score for r in clusters.cluster_stats(df).collect()} == {1: 2.7, 4: 1.0, 5: 0.4}
    assert views.articles(spark, DATA).count() > 0


def test_many_aliases(spark, monkeypatch):
    """A hundred thousand aliases, some within others; then the same dictionary in slices."""
    rng = random.Random(2)
    names = [("brand" if k % 2 else "model", f"Name {k:06d}", f"n{k:06d}x") for k in range(100_000)]
    names += [("brand", "Outer", "n000007x n000008x"), ("model", "Inner", "8X N0"), ("brand", "Blank", " "), ("brand", "Bare", None), ("other", "Unknown", "n000001x")]
    known = spark.createDataFrame(names, "kind string, canonical string, alias string")
    rows = [(k, " ".join(f"N{i:06d}x" for i in sorted(rng.sample(range(100_000), 3))), None) for k in range(40)] + [(100, "N000007X N000008x n000001x bare", "x")]
    df = spark.createDataFrame(rows, "id long, title string, content string").repartition(2)
    wanted = {}
    for k, title, _ in rows[:40]:
        ids = [int(w[1:7]) for w in title.split()]
        # All numbers begin with 0, so an 8 at the end of one word makes the alias that lies across two.
        across = ["Inner"] if any(i % 10 == 8 for i in ids[:-1]) else []
        wanted[k] = (sorted(f"Name {i:06d}" for i in ids if i % 2), across + sorted(f"Name {i:06d}" for i in ids if i % 2 == 0))
    wanted[100] = (["Bare", "Name 000001", "Name 000007", "Outer"], ["Inner", "Name 000008"])
    found = lambda: {r.id: (r.entities.brands, r.entities.models) for r in entities.extract_entities(df, known).collect()}
    assert found() == wanted
    monkeypatch.setattr(entities, "SLICE", 700_000)
    assert found() == wanted


def test_timeline_of_a_hot_cluster(spark):
    """Equal times, no times, and an event that holds nearly all articles."""
    rng = random.Random(9)
    rows = [(k, 1 if rng.random() < 0.95 else k % 7, rng.choice([None, START + timedelta(hours=rng.randrange(50))]), rng.choice([None, START + timedelta(hours=rng.randrange(50))])) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, cluster long, published_at timestamp, crawled_at timestamp").repartition(4)
    wanted, late = {}, datetime(9999, 1, 1)
    for k, cluster, published, crawled in sorted(rows, key=lambda r: (r[2] or r[3] or late, r[0]), reverse=True):
        wanted.setdefault(cluster, []).append(k)
    found = {}
    for r in clusters.timeline(df).orderBy("cluster", "rank").collect():
        found.setdefault(r.cluster, []).append((r.rank, r.id))
    assert found == {c: list(enumerate(ids, 1)) for c, ids in wanted.items()}
    top = {}
    for r in clusters.cluster_articles(df, 3).orderBy("rank").collect():
        top.setdefault(r.cluster, []).append(r.id)
    by_crawl = sorted(rows, key=lambda r: (r[3] or late, r[0]), reverse=True)
    assert top == {c: [r[0] for r in by_crawl if r[1] == c][:3] for c in wanted}
