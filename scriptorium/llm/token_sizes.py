"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The public WordPunct pattern, Unicode-aware.
WORD_PUNCT = r"(?U)\w+|[^\w\s]+"


def token_count(text: Column, known: Column | None = None) -> Column:
    """WordPunct tokens of a text; ``known``, where not null, is taken as the exact count. Null text has 0."""
    counted = F.coalesce(F.regexp_count(text, F.lit(WORD_PUNCT)), F.lit(0)).cast("long")
    return counted if known is None else F.coalesce(known.cast("long"), counted)


def vocabulary_count(df: DataFrame, tokenizer_file: str, text: str = "text", out: str = "n_vocab_tokens") -> DataFrame:
    """``df`` with the token count of ``text`` under a tokenizer file of the tokenizers library; the path is read on the executors."""
    schema = df.schema.add(out, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            sizes = [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)
