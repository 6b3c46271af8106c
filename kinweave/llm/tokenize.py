"""Encoding a corpus with a public byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .bpe import TOKENIZER_DIR, VOCABULARY, batch_encoder


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id_col, ids``: the token ids of each text, without special tokens.

    Null and empty texts have an empty list; strings that spell special tokens are ordinary text. Rows are neither joined
    nor dropped: a repeated row comes out as often as it came in. Only the two named columns are read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(directory, vocabulary)
        for b in batches:
            counts, ids = encoder.encode(b.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)])
            step = 0
            while step < len(counts):  # a list array counts its values in 32 bits
                end = int(np.searchsorted(offsets, offsets[step] + (1 << 26), side="right")) - 1
                end = min(max(end, step + 1), len(counts))
                part = (offsets[step : end + 1] - offsets[step]).astype(np.int32)
                values = pa.array(ids[offsets[step] : offsets[end]], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(step, end - step), pa.ListArray.from_arrays(pa.array(part), values)], names=[id_col, "ids"])
                step = end

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType(), False))])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", name: str = "n_tokens", directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text, 0 for a null or empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(directory, vocabulary)
        for b in batches:
            counts, _ = encoder.encode(b.column(b.num_columns - 1).to_pylist(), counts_only=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, name])

    schema = StructType([*(docs.schema[k] for k in keep), StructField(name, LongType())])
    return docs.select(*keep, F.col(text_col)).mapInArrow(run, schema)
