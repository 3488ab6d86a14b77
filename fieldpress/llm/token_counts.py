"""Token counts: pieces of each distinct pre-token once, times its occurrences in each document.

A worker cuts a slice of texts into pre-tokens, counts the vocabulary pieces of each distinct one
once (a bounded cache carries them over to its later slices), forms the frequency of each distinct
pre-token in each document, joins the two by integer codes, and sums per document. No document's ids
are made, and nothing is shuffled: pre-tokens of all documents would be a table as large as the texts. A text
that holds an added token's string of the vocabulary, or a vocabulary for which no cut is proven, goes to the
library whole, and only its number of ids is kept.

Defined cases: null or empty text counts 0; repeated rows are counted each; an empty table gives no
rows; columns other than doc_id and text are ignored; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fieldpress.llm.pieces import encoder
from fieldpress.llm.shared import bounded_batches, col, slices, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per document its UTF-8 bytes and the tokens that the vocabulary file's library would give for its text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in slices(batches):
            text = col(part, "text")
            n = pa.array(enc.counts(text))
            yield pa.record_batch([col(part, "doc_id").cast(pa.int64()), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs, "doc_id").mapInArrow(run, SCHEMA)
