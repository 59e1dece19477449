"""Token counts of a public tokenizer, computed in Arrow batches."""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import widen

#: Default vocabulary; the path is a parameter of every operator that counts tokens.
TOKENIZER = os.environ.get("WEFTLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How byte-level BPE vocabularies of this family split text into pieces. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoding(blob: bytes):
    import tiktoken

    kept = sys.__dict__.setdefault("_weftline_encodings", {})
    key = hash(blob)
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line)}
        kept[key] = tiktoken.Encoding("weftline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) with the tokens of the whole text; null texts and null ids are left out, empty texts have 0.

    The vocabulary file is read on the driver (it is a megabyte or so) and broadcast, so executors need no copy of it.
    """
    rows = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    with open(tokenizer, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})

    return widen(rows).mapInPandas(count, "doc_id bigint, tokens bigint")
