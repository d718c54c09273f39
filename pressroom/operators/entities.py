"""Entities of articles: which names of a dictionary occur in title and lead."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.lineage import cut, drop

#: Characters of the body that are searched besides the title.
LEAD = 200
#: Characters of names that an automaton holds; a larger dictionary is searched for slice by slice.
SLICE = 8_000_000
KINDS = ("brand", "model")
ENTITIES = "struct<brands: array<string>, models: array<string>>"


def _whole_words(name: str) -> str:
    return f" {' '.join(''.join(c if c.isalnum() or c == '_' else ' ' for c in name).split())} "


def _slices(dictionary: DataFrame, word_boundary: bool) -> Iterator[dict[str, list[tuple[int, str]]]]:
    """Names as they are looked for, each with what it stands for (place in KINDS, canonical name), some SLICE characters at a time."""
    rows = dictionary.where(F.col("kind").isin(*KINDS) & F.col("canonical").isNotNull()).select("kind", "canonical", "alias").distinct()
    # One row for each alias, read partition by partition: the driver holds one slice.
    found: dict[str, list[tuple[int, str]]] = {}
    size = 0
    for row in rows.toLocalIterator():
        for name in {row.canonical, row.alias or row.canonical}:
            name = _whole_words(name.lower()) if word_boundary else name.lower()
            if name.strip():
                found.setdefault(name, []).append((KINDS.index(row.kind), row.canonical))
                size += len(name)
        if size >= SLICE:
            yield found
            found, size = {}, 0
    if found or not size:
        yield found


def _searched(names: dict[str, list[tuple[int, str]]], spark):
    """An expression function: the entities of a text, found in one pass by an automaton that each task builds from a broadcast."""
    held = spark.sparkContext.broadcast(list(names.items()))
    kind = pa.struct([("brands", pa.list_(pa.string())), ("models", pa.list_(pa.string()))])

    @F.arrow_udf(ENTITIES)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for name, means in held.value:
            automaton.add_word(name, means)
        automaton.make_automaton()
        for batch in texts:
            out = []
            for text in batch.to_pylist():
                met = {m for _, means in automaton.iter(text) for m in means} if len(automaton) else set()
                out.append({f"{k}s": sorted(name for place, name in met if place == i) for i, k in enumerate(KINDS)})
            yield pa.array(out, kind)

    return search


def extract_entities(articles: DataFrame, dictionary: DataFrame, word_boundary: bool = False) -> DataFrame:
    """The articles with entities struct<brands, models>; dictionary: kind, canonical, alias (both names count; blank ones are not looked for).

    Names are looked for anywhere, also within and across each other, whatever their case; with word_boundary only as whole words. The time goes with the
    text and the hits, not with the number of names; a dictionary of more than SLICE characters is searched for in as many rounds as it has slices, which a stream cannot do.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, LEAD)))
    if word_boundary:
        text = F.concat(F.lit(" "), F.regexp_replace(text, r"(?U)\W+", " "), F.lit(" "))
    out, stored = articles.withColumn("_text", text), None
    both = lambda name: F.array_sort(F.array_union(f"entities.{name}", f"_more.{name}")).alias(name)
    for number, names in enumerate(_slices(dictionary, word_boundary)):
        search = _searched(names, articles.sparkSession)
        if not number:
            out = out.withColumn("entities", search("_text"))
            continue
        if articles.isStreaming:
            raise ValueError(f"a stream's dictionary may have {SLICE} characters")
        before, stored = stored, cut(out)
        if before is not None:
            drop(before)
        out = stored.withColumn("_more", search("_text")).withColumn("entities", F.struct(both("brands"), both("models"))).drop("_more")
    return out.drop("_text")


def entity_set(entities: Column) -> Column:
    """All names of an article, sorted."""
    return F.array_sort(F.array_union(entities["brands"], entities["models"]))
