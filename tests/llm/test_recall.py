"""How much of what a plain search of all bytes finds the chunks find."""

from pressroom.llm import chunks
from pressroom.llm.common import read

DATA = "/root/testdata/sf0.01"


def test_chunks_against_all_bytes(spark):
    """Bytes within a string of LEAST_RUN bytes that occurred before: no other byte goes, and nearly all of these do."""
    docs = read(spark, DATA, "documents").select("doc_id", "text")
    # In the order that decides which occurrence is the first.
    rows = sorted({(r.doc_id, (r.text or "").encode()) for r in docs.collect()}, key=lambda r: (r[0], chunks._row(r[1])))
    seen, repeated = set(), {}
    for doc, data in rows:
        covered = bytearray(len(data))
        for at in range(len(data) - chunks.LEAST_RUN + 1):
            key = hash(data[at : at + chunks.LEAST_RUN])
            if key in seen:
                covered[at : at + chunks.LEAST_RUN] = b"\1" * chunks.LEAST_RUN
            seen.add(key)
        repeated[(doc, chunks._row(data))] = covered
    removed = wrong = 0
    for r in chunks.repeats(docs).collect():
        for span in r.spans:
            part = repeated[(r.doc_id, r.row)][span["at"] : span["end"]]
            removed += sum(part)
            wrong += len(part) - sum(part)
    total = sum(map(sum, repeated.values()))
    assert total > 300_000 and wrong == 0
    assert removed >= 0.985 * total, removed / total
