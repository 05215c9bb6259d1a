"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factlode.llm.bpe import SegmentEncoder
from factlode.llm.rows import map_slices, text_rows


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row for each row of `docs`.

    `path` is a byte-level BPE file. A null text counts as empty: no bytes, no tokens. Rows with a null id and repeated rows are
    counted like any other; further columns are left out. No row needs another one, so nothing is shuffled.
    """

    def make():
        encoder = SegmentEncoder(path, ids=False)

        def work(part):
            counts = encoder.encode(part["text"])
            return {
                "doc_id": part["doc_id"], "n_bytes": [len((t or "").encode()) for t in part["text"]], "n_tokens": counts,
                "over_limit": [n > limit for n in counts],
            }

        return work

    return map_slices(text_rows(docs, id_column, text_column), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
