"""Language identification: word first, backing off to shorter and shorter character n-grams.

A known word scores its log frequency in each language. An unseen word is scored by its known n-grams: at
every place the longest one, of LONGEST to one character, that the model holds. A text's scores are the means over its words.

The model is fit on a bounded sample: SAMPLE_ROWS labelled rows at most, the same quota for each language, those of least hash
of doc_id first. It keeps every word and n-gram of the sample, so its size is bounded by
the sample's, whatever the corpus holds. All rows are predicted, from whole texts.

Defined results: a null text and one without letters are `und`, score 0; so is everything if no row names a language. Ties
go to the first language by name. Repeated rows count as often. Empty tables give no rows. A text is read in slices of words, so a
very long one needs little more memory than itself. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.llm.common import pieces, read

#: Labelled rows that the model is fit on, over all languages; languages beyond that number are not learnt.
SAMPLE_ROWS = 2000
#: Rows beyond twice its quota that a language is thinned to, so that none of a few rows is thinned away.
SPARE = 20
LONGEST = 5
#: A language scores words and n-grams that only others know as if seen so often among its own.
UNSEEN = 0.1
#: Distinct words whose scores a worker remembers; it starts anew beyond them.
CACHE_WORDS = 300_000
#: Scores gathered at once for the words of a text.
GATHERED = 4 << 20
ORACLE_SQL = None
LETTERS = regex.compile(r"\p{L}+")


def sample(rows: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """lang, text of at most `most` labelled rows (and rows that share their doc_id).

    Every language has the same quota. Rows are thinned by a hash of doc_id to about twice the quota before they are ranked, so
    that no task ranks all rows of a language, and only keys are ranked, not texts.
    """
    named = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.crc32(F.concat(F.lit("sample "), F.col("doc_id").cast("string")).cast("binary"))
    sizes = named.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(most)
    quota = F.greatest(F.lit(1), F.floor(F.lit(most) / F.count("*").over(Window.partitionBy())))  # over `most` rows at most
    share = sizes.withColumn("quota", quota).select("lang", "quota", ((2 * F.col("quota") + SPARE) / F.col("size")).alias("share"))
    thin = named.select("doc_id", "lang", order.alias("order")).join(F.broadcast(share), "lang").where(F.col("order") < F.col("share") * 2**32)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = thin.withColumn("rank", rank).where("rank <= quota").orderBy("rank", "lang", "doc_id").limit(most).select("doc_id").distinct()
    return named.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")  # at most `most` ids


class Model:
    """Units (words, k = 0, and n-grams of k characters) by k: {unit: row of `logs`}; logs: one column for each language."""

    def __init__(self, counts: list[tuple[str, int, str, int]]):
        self.langs = sorted({lang for lang, *_ in counts})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.units: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        sums = np.zeros((LONGEST + 1, len(place)))
        size = 0
        for lang, k, unit, n in counts:
            sums[k, place[lang]] += n
            if unit not in self.units[k]:
                self.units[k][unit] = size
                size += 1
        self.logs = np.empty((size, len(place)), np.float32)
        floors = np.log(UNSEEN / np.maximum(sums, 1))
        for k, units in enumerate(self.units):
            self.logs[np.fromiter(units.values(), np.int64, len(units))] = floors[k]
        for lang, k, unit, n in counts:
            self.logs[self.units[k][unit], place[lang]] = np.log(n / sums[k, place[lang]])
        self.scores = Scores(self)

    def __getstate__(self):
        return {name: value for name, value in self.__dict__.items() if name != "scores"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.scores = Scores(self)

    def rows(self, word: str) -> list[int]:
        """Rows of the word itself, or of the longest known n-gram at each of its places, its ends marked by blanks."""
        known = self.units[0].get(word)
        if known is not None:
            return [known]
        padded, out = f" {word} ", []
        size = len(padded)
        for at in range(size):
            for k in range(min(LONGEST, size - at), 0, -1):
                found = self.units[k].get(padded[at : at + k])
                if found is not None:
                    out.append(found)
                    break
        return out

    def fresh_scores(self) -> Scores:
        """The scores met so far in this worker, or none where they are too many."""
        if len(self.scores) > CACHE_WORDS:
            self.scores = Scores(self)
        return self.scores


class Scores(dict):
    """Word: row of `table`, its mean log frequencies by language; words are scored once, many together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table = model, np.zeros((1024, len(model.langs)), np.float32)

    def add(self, words: list[str]) -> None:
        rows = [self.model.rows(word) for word in words]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((r for row in rows for r in row), np.int64, int(lengths.sum()))
        means = np.zeros((len(rows), len(self.model.langs)), np.float32)
        some = lengths > 0
        if len(flat):
            starts = (np.cumsum(lengths) - lengths)[some]
            means[some] = np.add.reduceat(self.model.logs[flat], starts, axis=0) / lengths[some, None]
        size = len(self)
        while size + len(rows) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[size : size + len(rows)] = means
        self.update(zip(words, range(size, size + len(rows)), strict=True))

    def mean(self, words: list[str]) -> np.ndarray:
        step, total = max(1, GATHERED // len(self.model.langs)), np.zeros(len(self.model.langs))
        for at in range(0, len(words), step):
            some = words[at : at + step]
            total += self.table[np.fromiter(map(self.__getitem__, some), np.int64, len(some))].sum(0, dtype=np.float64)
        return total / len(words)


def learn(rows: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """The model of the sample of doc_id, text, lang; its counts are bounded by the sample."""
    words = F.explode(F.split(F.lower("text"), r"\P{L}+")).alias("unit")
    counts = sample(rows, most).select("lang", words).where("unit <> ''").groupBy("lang", "unit").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("unit"), F.lit(" "))

    def grams(k: int):
        """Places of n-grams of one character are those of the word; longer ones take in its marked ends."""
        whole, size = (F.col("unit"), F.length("unit")) if k == 1 else (padded, F.length("unit") + 3 - k)
        places = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), whole.substr(i, F.lit(k)).alias("unit")))

    word = F.array(F.struct(F.lit(0).alias("k"), F.col("unit").alias("unit")))
    all_units = F.flatten(F.array(word, *(grams(k) for k in range(1, LONGEST + 1))))
    units = counts.select("lang", "n", F.explode(all_units).alias("u")).groupBy("lang", "u.k", "u.unit").agg(F.sum("n").alias("n"))
    return Model(list(units.select("lang", "k", "unit", "n").toPandas().itertuples(index=False, name=None)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score: the most likely language and its share of the likelihoods, by mean log frequency of a word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = shared.value.langs
        for batch in pieces(batches):
            said = [LETTERS.findall(text.lower()) if text and langs else [] for text in batch.column(1).to_pylist()]
            scores = shared.value.fresh_scores()
            new = {word for words in said for word in words if word not in scores}
            if new:
                scores.add(list(new))
            found, sure = [], []
            for words in said:
                if not words:
                    found.append("und")
                    sure.append(0.0)
                    continue
                mean = scores.mean(words)
                odds = np.exp(mean - mean.max())
                best = int(mean.argmax())
                found.append(langs[best])
                sure.append(float(odds[best] / odds.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: learns from the rows not held out, predicts all from text alone."""
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify(docs, learn(docs.where(~held).select("doc_id", "text", "lang")))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
