"""Similar vectors of articles: exact, or by an index of cells that is trained once, stored, and searched cell by cell.

Vectors are compared as unit vectors; a null vector is in no pair, and one of zeros is like nothing. Articles come in the order of (crawled_at, id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.lineage import cut, drop

DAY = 24 * 3_600_000_000
#: Vectors compared with each other in one group of rows.
BLOCK_ROWS = 2000
#: Rows that cells are trained on, at most. Every vector is indexed, whatever their number.
SAMPLE_ROWS = 100_000
#: Partitions of that sample, the same on every cluster.
TRAIN_PARTS = 16
#: Vectors whose matches are looked up in full to see how many cells hold them, at most, and how many standard deviations the share found must be above the one asked for.
ASKED_ROWS, SURE = 2000, 3.0
#: Bytes of all centres together, which every task gets.
MOST_CENTRES = 64_000_000
PLACED = "id long, t long, v array<float>, cell int, far float"


def _timed(vectors: DataFrame, days: int) -> DataFrame:
    """id, t, bucket (spans of the look-back), v."""
    t = F.unix_micros("crawled_at")
    return vectors.where("embedding IS NOT NULL").select("id", t.alias("t"), F.floor(t / (days * DAY)).alias("bucket"), F.col("embedding").cast("array<double>").alias("v"))


def _unit(column: pd.Series) -> np.ndarray:
    matrix = np.array(column.tolist(), np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _meet(later: DataFrame, earlier: DataFrame, threshold: float, days: int) -> DataFrame:
    """id, other, cosine of the later rows (id, t, v, bucket, cell) and the earlier ones of the same bucket and cell that are as alike and not too old.

    Both sides of a cell are dealt into blocks of BLOCK_ROWS, and a task multiplies two blocks at a time, so a full cell is many tasks' work; only pairs above the threshold leave it.
    """
    key, span = ["bucket", "cell"], days * DAY
    sizes = lambda rows, name: rows.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
    blocks = sizes(later, "later_blocks").join(sizes(earlier, "earlier_blocks"), key)

    def dealt(rows: DataFrame, own: str, other: str, late: bool) -> DataFrame:
        mine, theirs = F.pmod(F.xxhash64("id"), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        placed = rows.join(blocks, key).select("id", "t", "v", *key, mine.alias(own), theirs.alias(other))
        return placed.select("id", "t", "v", *key, F.col("later_blocks").alias("i"), F.col("earlier_blocks").alias("j"), F.lit(late).alias("later"))

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = frame[frame["later"]], frame[~frame["later"]]
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        cosine = _unit(a["v"]) @ _unit(b["v"]).T
        t, s = a["t"].to_numpy()[:, None], b["t"].to_numpy()[None]
        i, j = a["id"].to_numpy()[:, None], b["id"].to_numpy()[None]
        x, y = np.nonzero((cosine > threshold) & (s > t - span) & ((s < t) | ((s == t) & (j < i))))
        return pd.DataFrame({"id": a["id"].to_numpy()[x], "other": b["id"].to_numpy()[y], "cosine": cosine[x, y]})

    both = dealt(later, "later_blocks", "earlier_blocks", True).unionByName(dealt(earlier, "earlier_blocks", "later_blocks", False))
    return both.groupBy(*key, "i", "j").applyInPandas(close, "id long, other long, cosine double")


def _looking_back(rows: DataFrame) -> DataFrame:
    """Rows in their own bucket and in the one before."""
    return rows.withColumn("bucket", F.explode(F.array("bucket", F.col("bucket") - 1)))


def similar_vectors(vectors: DataFrame, threshold: float = 0.85, days: int = 3, centres: DataFrame | None = None, probes: int | None = None) -> DataFrame:
    """L4 candidates: id, other (earlier, within the look-back), cosine above the threshold. vectors: id, crawled_at, embedding.

    Without centres every two vectors of a look-back are compared, which is quadratic in what three days hold. With the centres of train() a vector meets those in the cells it
    probes: the `probes` nearest ones (recall is measured by recall_of), or, without a number, every cell that can hold a match, which is exact.
    """
    rows = _timed(vectors, days)
    if centres is None:
        rows = rows.withColumn("cell", F.lit(0))
        return _meet(_looking_back(rows), rows, threshold, days)
    rows = rows.select("id", "t", "v", "bucket")
    return _meet(_looking_back(_probing(rows, centres, threshold, probes)), _placed(rows, centres), threshold, days)


def train(vectors: DataFrame, cells: int, seed: int = 1) -> DataFrame:
    """cell, centre, of k-means over the directions of SAMPLE_ROWS vectors at most, those of the least hashed ids; `cells` should grow like the root of the number of vectors.

    The rows are dealt out and put in order by their ids, so the cells hang neither on the number of files nor on that of cores.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("v")).where(norm > 0)
    count = rows.count()
    if count > SAMPLE_ROWS:
        # Half as many again by hash, then exactly so many: a top-k of a few rows a task.
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(1.5 * SAMPLE_ROWS / count * (1 << 30))).orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS)
    sample = cut(rows.select("id", F.transform("v", lambda x: x / norm).alias("v")))
    spark = vectors.sparkSession
    schema = "cell int, centre array<double>"
    if sample.isEmpty():
        return spark.createDataFrame([], schema)
    dealt = sample.repartition(TRAIN_PARTS, "id").sortWithinPartitions("id", "v").select(array_to_vector("v").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(dealt)
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], schema)


def _held(centres: DataFrame):
    """The centres as a broadcast matrix, of a checked size."""
    found = centres.orderBy("cell").select("centre").toPandas()["centre"] if centres.count() else []
    matrix = np.array([list(c) for c in found], np.float64)
    if matrix.nbytes > MOST_CENTRES:
        raise ValueError(f"{matrix.nbytes} bytes of centres are more than {MOST_CENTRES}: train fewer cells")
    return centres.sparkSession.sparkContext.broadcast(matrix)


def _distances(column: pd.Series, matrix: np.ndarray) -> np.ndarray:
    unit = _unit(column)
    return np.sqrt(np.maximum((unit**2).sum(1)[:, None] + (matrix**2).sum(1)[None] - 2 * unit @ matrix.T, 0))


def _placed(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (id, t, v, bucket) with the nearest cell and how far its centre is."""
    held = _held(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            far = _distances(frame["v"], held.value) if len(held.value) and len(frame) else np.zeros((len(frame), 1))
            yield frame.assign(cell=far.argmin(1).astype("int32"), far=far.min(1, initial=np.inf))

    return rows.mapInPandas(run, "id long, t long, v array<double>, bucket long, cell int, far double")


def _probing(rows: DataFrame, centres: DataFrame, threshold: float, probes: int | None) -> DataFrame:
    """rows (id, t, v, bucket) once for each cell to look into.

    A match x of q is within d of it, and no nearer to any centre than to that of its cell c. So |q - c| - d <= |x - c| <= |x - n| <= |q - n| + d for the centre n nearest to q: cells beyond hold no match.
    """
    held, reach = _held(centres), 2 * np.sqrt(2 - 2 * threshold) + 1e-6

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            far = _distances(frame["v"], held.value) if len(held.value) and len(frame) else np.zeros((len(frame), 1))
            near = far <= far.min(1, initial=np.inf)[:, None] + reach
            if probes is not None:
                near &= far.argsort(1, kind="stable").argsort(1, kind="stable") < probes
            row, cell = np.nonzero(near)
            yield frame.iloc[row].assign(cell=cell.astype("int32"))

    return rows.mapInPandas(run, "id long, t long, v array<double>, bucket long, cell int")


def probes_for(vectors: DataFrame, centres: DataFrame, threshold: float = 0.85, recall: float = 0.9, least: int = 1, days: int = 3) -> int:
    """The number of nearest cells, `least` or more, that a search has to look into so as to find the share `recall` of all matches.

    It is measured: ASKED_ROWS vectors at most, those of the least hashed ids, are compared with all of their look-back, and the cells of what they match are counted by
    their place among the nearest. Where the matches are too few to be sure by SURE deviations, more cells are taken, in the end all.
    """
    rows = cut(_timed(vectors, days))
    cells = centres.count()
    if cells <= least:
        return cells
    asked = rows.orderBy(F.xxhash64("id")).limit(ASKED_ROWS)
    whole = lambda df: df.withColumn("cell", F.lit(0))
    pairs = _meet(_looking_back(whole(asked)), whole(rows), threshold, days).select("id", "other")
    held = _held(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nearest = _distances(frame["v"], held.value).argsort(1, kind="stable") if len(frame) else []
            yield pd.DataFrame({"id": frame["id"], "nearest": list(nearest)})

    nearest = asked.select("id", "v").mapInPandas(run, "id long, nearest array<int>")
    cell = _placed(rows, centres).select(F.col("id").alias("other"), "cell")
    place = F.array_position("nearest", F.col("cell")).alias("place")
    # One row for each cell at most.
    counts = dict(pairs.join(nearest, "id").join(cell, "other").groupBy(place).count().collect())
    drop(rows)
    matches, found = sum(counts.values()), 0
    for probes in range(1, cells):
        found += counts.get(probes, 0)
        if probes >= least and matches and found / matches >= recall + SURE * np.sqrt(recall * (1 - recall) / matches):
            return probes
    return cells


def write_index(vectors: DataFrame, centres: DataFrame, path: str, days: int = 3) -> None:
    """The vectors in their cells below path/vectors, a folder for each look-back, and the centres below path/centres.

    Look-backs that are written again replace those of before, others stay: a day's vectors can be added by writing its look-back anew.
    """
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    placed = _placed(_timed(vectors, days), centres)
    placed.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "far").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/vectors")


def search_index(vectors: DataFrame, path: str, threshold: float = 0.85, days: int = 3, probes: int | None = None) -> DataFrame:
    """id, other, cosine of vectors (id, crawled_at, embedding) and the earlier ones of a stored index; only the folders of their look-backs are read."""
    spark: SparkSession = vectors.sparkSession
    asked = _timed(vectors, days)
    span = asked.agg(F.min("bucket") - 1, F.max("bucket")).first()
    stored = spark.read.parquet(f"{path}/vectors").where(F.col("bucket").between(*(span if span[0] is not None else (1, 0))))
    centres = spark.read.parquet(f"{path}/centres")
    return _meet(_looking_back(_probing(asked, centres, threshold, probes)), stored.select("id", "t", "v", F.col("bucket").cast("long").alias("bucket"), "cell"), threshold, days)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """exact, found, recall: how many of the exact pairs an index finds."""
    pairs = exact.select("id", "other").join(found.select("id", "other", F.lit(True).alias("_hit")), ["id", "other"], "left")
    counts = pairs.agg(F.count("*").alias("exact"), F.count("_hit").alias("found"))
    return counts.withColumn("recall", F.when(F.col("exact") > 0, F.col("found") / F.col("exact")).otherwise(1.0))
