"""A Merkle manifest of a dataset: a tree of digests for each source, one over their roots, and proofs for every document.

Nodes of a level are numbered within their tree. Every level is joined with itself, on the tree and the computed
number of a sibling: the nodes of a run of three stand at slots 0, 1 and 2, and each meets those one and two slots further on, counted
round. What a node's siblings are is thus known for every node, which is what a proof is made of, and the nodes at slot 0 emit the
parents. Levels shrink threefold and are written one by one; proofs are handed down from the root, each node's siblings before its parent's.

Numbers of very large sources come from running counts over ranges, and joins are on (tree, number), so no source is one task's work. Digests are
binary (32 bytes) in tables and hexadecimal where they are hashed. Everything is a built-in expression.

Defined results: a null is hashed as `-`, an empty text as `0:`. Documents of no source are a tree of their own, the first. Null doc_ids come first; repeated rows
and equal doc_ids are leaves each, equal doc_ids in the order of their digests. A lone leaf is its source's root, a lone source's root the whole root, its proof the digest
of nothing. Very long texts are hashed whole. An empty table gives no rows. Further columns are neither hashed nor kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.lineage import cut
from pressroom.llm.common import CRC32_SQL, drop, read, stored
from pressroom.ordered import running

RUN = 3
HASHED = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _leaf(docs: DataFrame, **instead: Column) -> Column:
    """Digest of a document's columns, each with its length in bytes; `instead` replaces columns."""
    parts = [instead.get(c, docs[c]).cast("string") for c in HASHED]
    return _sha256(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in parts)))


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (tree, place, n, h, ...) with left and right: the digests of the siblings before and after each, put together."""
    slot = F.col("place") % RUN
    out = nodes
    for shift in (1, 2):
        sibling = F.col("place") - slot + (slot + shift) % RUN
        other = nodes.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), F.col("h").alias(f"s{shift}"))
        asked = out.withColumn("_sibling", sibling)
        out = asked.join(other, (asked["tree"] == other["_tree"]) & (asked["_sibling"] == other["_place"]), "left").drop("_tree", "_place", "_sibling")
    nothing = F.unhex(F.lit(""))
    one, two = (F.coalesce(f"s{k}", nothing) for k in (1, 2))
    both = F.concat(one, two)
    left = F.when(slot == 0, nothing).when(slot == 1, two).otherwise(both)
    right = F.when(slot == 0, both).when(slot == 1, one).otherwise(nothing)
    return out.select(*nodes.columns, left.alias("left"), right.alias("right"))


def grown(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, each stored, and tree, h of their roots. leaves: tree, place, n (leaves of the tree, `most` at most), h and further columns."""
    levels, roots, nodes = [], leaves.where("n = 1").select("tree", "h"), leaves
    while most > 1:
        level = cut(_with_siblings(nodes.where("n > 1")))
        levels.append(level)
        digest = _sha256(F.concat(_hex(F.col("h")), _hex(F.col("right"))))
        nodes = level.where(F.col("place") % RUN == 0).select("tree", F.floor(F.col("place") / RUN).alias("place"), F.ceil(F.col("n") / RUN).alias("n"), digest.alias("h"))
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "h"))
        most = -(-most // RUN)
    return levels, cut(roots)


def proofs(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The nodes of the first level with path: left and right siblings level by level; roots: tree, path beyond the tree's root and columns to hand down."""
    handed = [c for c in roots.columns if c not in ("tree", "path")]
    above = None
    for level in reversed(levels):
        step = F.array(F.struct("left", "right"))
        mine = [c for c in level.columns if c not in ("left", "right")]
        own = level.alias("l")
        onward = [F.concat(step, F.col("a.path")).alias("path"), *(F.col(f"a.{c}").alias(c) for c in handed)]
        # The last runs lie below the root; the others below nodes of the next level.
        found = own.where(F.col("l.n") <= RUN).join(roots.alias("a"), F.col("l.tree") == F.col("a.tree")).select(*(F.col(f"l.{c}") for c in mine), *onward)
        if above is not None:
            parent = F.floor(F.col("l.place") / RUN) == F.col("a.place")
            found = found.unionByName(own.where(F.col("l.n") > RUN).join(above.alias("a"), parent & (F.col("l.tree") == F.col("a.tree"))).select(*(F.col(f"l.{c}") for c in mine), *onward))
        above = found
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give, in hexadecimal."""
    return F.aggregate(path, _hex(leaf), lambda h, step: F.sha2(F.concat(_hex(step["left"]), h, _hex(step["right"])), 256))


def manifest(docs: DataFrame, shown: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path and folded: the root recomputed from the leaf of the text `shown` (the documents' own if not given), digests in hexadecimal."""
    tree = F.coalesce(F.concat(F.lit("1"), docs["source"]), F.lit("0"))
    again = _leaf(docs) if shown is None else _leaf(docs, text=shown)
    leaves = running(docs.select("doc_id", tree.alias("tree"), _leaf(docs).alias("h"), again.alias("shown")), ["tree", "doc_id", "h"], row=F.lit(1))
    sizes = cut(leaves.groupBy("tree").agg(F.min("row").alias("first"), F.count("*").alias("n")))
    leaves = cut(leaves.join(sizes, "tree").select("doc_id", "shown", "tree", (F.col("row") - F.col("first")).alias("place"), "n", "h"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    levels, subroots = grown(leaves, most)
    top = running(subroots, ["tree"], place=F.lit(1))
    trees = sizes.count()
    top = cut(top.select(F.lit("").alias("tree"), "place", F.lit(trees).cast("long").alias("n"), "h", F.col("tree").alias("source")))
    top_levels, roots = grown(top, trees)
    root = roots.first()
    alone = F.array().cast("array<struct<left: binary, right: binary>>").alias("path")
    above = proofs(top_levels, roots.select("tree", alone)) if top_levels else top.withColumn("path", alone)
    above = stored(above.select(F.col("source").alias("tree"), F.col("h").alias("subroot"), "path"))
    lone = leaves.where("n = 1").join(above, "tree").select("doc_id", "shown", "tree", "h", "path", "subroot")
    found = proofs(levels, above).select(lone.columns).unionByName(lone) if levels else lone
    drop(sizes)
    source = F.when(F.col("tree") != "0", F.substring("tree", 2, 2**31 - 1)).alias("source")
    digests = [_hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.lit(root["h"] if root else b"")).alias("root")]
    return found.select("doc_id", source, *digests, "path", fold(F.col("shown"), F.col("path")).alias("folded"))


def tampered(docs: DataFrame) -> Column:
    """The text without line feeds, in documents whose number has an even checksum; else as it is."""
    odd = F.crc32(F.encode(docs["doc_id"].cast("string"), "utf-8")) % 2 == 0
    return F.when(odd, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of the whole documents table, and what tampering does to them."""
    docs = read(spark, sf_dir, "documents")
    out = manifest(docs, tampered(docs))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), ""), 256)
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


def _leaf_sql(text: str) -> str:
    parts = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in HASHED]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')" for x in parts) + ")"


def _levels_sql(name: str, leaves: str) -> str:
    """Recursive table name(tree, k, place, n, h) of all levels over leaves(tree, place, n, h), and name_sides with the siblings of each."""
    return f"""{name}(tree, k, place, n, h) AS (SELECT tree, 0, place, n, h FROM {leaves}
    UNION ALL SELECT tree, k + 1, place // {RUN}, (n + {RUN - 1}) // {RUN}, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, k, place // {RUN}, n),
  {name}_sides AS (SELECT tree, k, place, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1 WINDOW run AS (PARTITION BY tree, k, place // {RUN} ORDER BY place))"""


#: The same in SQL, level by level.
ORACLE_SQL = f"""WITH RECURSIVE {CRC32_SQL.format(key="doc_id", text="CAST(doc_id AS VARCHAR)", source="(SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)")},
  hashed AS (SELECT d.doc_id, coalesce('1' || source, '0') AS tree, {_leaf_sql("text")} AS leaf,
      CASE WHEN crc % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown FROM documents d LEFT JOIN checked c USING (doc_id)),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM hashed),
  {_levels_sql("nodes", "leaves")},
  subroots AS (SELECT tree AS source, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n, 0 AS tree FROM nodes WHERE n = 1),
  {_levels_sql("tops", "subroots")},
  steps AS (SELECT l.tree, l.place, s.k, s.l || '|' || s.r AS step FROM leaves l JOIN nodes_sides s ON s.tree = l.tree AND s.place = l.place // CAST({RUN} ** s.k AS BIGINT)
    UNION ALL SELECT l.tree, l.place, 1000 + s.k, s.l || '|' || s.r FROM leaves l JOIN subroots b ON b.source = l.tree JOIN tops_sides s ON s.place = b.place // CAST({RUN} ** s.k AS BIGINT)),
  paths AS (SELECT tree, place, list(step ORDER BY k) AS path FROM steps GROUP BY 1, 2),
  folded AS (SELECT l.*, b.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(path, []) AS path FROM leaves l JOIN subroots b ON b.source = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.place = l.place),
  found AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
    list_reduce(path, lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2)), shown) AS folded_root FROM folded)
SELECT *, folded_root = root AS verified FROM found"""
