"""Token counts of texts by a public tokenizer, a file whose place is a parameter."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: how the byte-pair vocabulary of 50,257 entries cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in stretches of about this many characters, cut where a single space stands between words: no
#: token of this vocabulary spans such a place, so the count is exact. A run without any such place is encoded whole, however long.
STRETCH = 20_000
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    own, at, total = encoding(path), 0, 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + STRETCH)
        stop = cut.start() if cut else len(text)
        total += len(own.encode_ordinary(text[at:stop]))
        at = stop
    return total


def with_token_counts(documents: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``documents`` (doc_id, text, further columns) with tokens in place of text; null and empty texts have none.

    Texts of any length are read whole. The vocabulary is a file of the driver's that Spark sends to the executors.
    """
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    kept = [c for c in documents.columns if c != "text"]
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SparkFiles.get(name)
        for batch in batches:
            counts = [count_tokens(t, own) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(counts, pa.int64())], [*kept, "tokens"])

    return documents.select(*kept, F.col("text")).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", tokens long")
