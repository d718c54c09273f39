"""Cleaning a corpus: each stage reads what its predecessor kept, and what it decides takes effect.

Every stage takes documents (doc_id, text, lang and whatever else) and, but for the last, gives rows with the same columns. For all of them: an empty table gives no
rows, a null text counts as an empty one, very long texts are read whole, columns that a stage does not need are passed on unread whatever their
names, and the result hangs neither on the order of the rows nor on how they are dealt out. What ties and repeated rows mean is said at each stage.
"""

from __future__ import annotations

from pressroom.llm import bpe, decontaminate, jaccard, pii, quality
from pressroom.llm.common import read, stored


def good(spark, docs, sf_dir):
    """Without the documents that the quality rules reject: null and empty texts among them. Repeated rows are judged alike, so all stay or go; there are no ties."""
    return quality.clean(docs)


def unlike(spark, docs, sf_dir):
    """One document of each group of near copies (five words, 0.8): the one of the least doc_id. Of rows with the same doc_id and text one stays, the one of the least hash.

    Null and empty texts are like nothing and stay; rows of a null doc_id go.
    """
    return jaccard.one_of_each(docs)


def uncontaminated(spark, docs, sf_dir):
    """Without the documents that hold benchmark questions, as they are or re-parameterised. Null and empty texts stay; repeated rows stay or go together; an empty benchmark keeps all."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def private(spark, docs, sf_dir):
    """Personal data redacted, every row by itself; a null text stays null. Overlapping spans become one, of the kind of the first, or at one start of the longest."""
    return pii.redact(docs)


def tokens(spark, docs, sf_dir):
    """doc_id and ids of each text, every row by itself; a null or empty text has no ids."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", good),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", uncontaminated),
    ("PII", private),
    ("byte-level BPE", tokens),
]

#: The stages' string work is beyond SQL; the tests hold the rows against a plain version of every stage.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
