"""Token counts of whole texts under a public piece tokenizer, without a shuffle of pre-tokens.

A pre-token is a run of spaces with the run of other characters behind it, or a line end. No piece of the
vocabulary reaches over such a border (checked when the operator starts), so a text's count is the sum over
its pre-tokens. Two tiers look them up in each task: a broadcast table of frequent pre-tokens, gathered
from a bounded sample of documents, then a cache in the worker; only what neither holds is encoded. The
sample decides on speed alone, never on a count.

Null text counts as empty: 0 bytes, 0 tokens. Texts count whole, however long. Repeated rows count each; an empty
table stays empty. Columns named as results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, schema_with

PRETOKEN = re.compile(r" *[^ \n]+| +|\n")
CACHED_PRETOKENS = 300_000
#: Longer pre-tokens are encoded each time.
CACHED_CHARS = 64


def pretokens(text: str) -> list[str]:
    """With the mark for a space that the library puts before each text, and its literal form as a space."""
    return PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


class PretokenLengths(dict):
    """Pre-token -> number of tokens: the worker's cache behind the broadcast table."""

    def __init__(self, encode, frequent: dict[str, int]) -> None:
        self.encode, self.frequent = encode, frequent
        self.update(frequent)

    def __missing__(self, token: str) -> int:
        # The library puts a space in front of any text: a line end keeps it apart, at two tokens.
        n = len(self.encode("\n" + token)) - 2
        if len(token) <= CACHED_CHARS:
            self[token] = n
        return n

    def trim(self) -> None:
        if len(self) > len(self.frequent) + CACHED_PRETOKENS:
            self.clear()
            self.update(self.frequent)


def check_borders(processor) -> None:
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if re.search("[^▁]▁|\n| ", piece):
            raise ValueError(f"the piece {piece!r} reaches over a border of pre-tokens")


def frequent_pretokens(docs: DataFrame, text_col: str, sample_docs: int, size: int) -> list[str]:
    """The commonest pre-tokens of about sample_docs documents: at most size, of at most CACHED_CHARS."""
    total = docs.count()
    if not total:
        return []
    sample = docs.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, sample_docs / total), seed=7)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counted in each task, and passed on before there are too many to hold."""
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(x for x in pretokens(t) if len(x) <= CACHED_CHARS and "\x00" not in x)
                if len(seen) > CACHED_PRETOKENS:
                    yield pd.DataFrame(seen.items(), columns=["token", "n"])
                    seen.clear()
        yield pd.DataFrame(seen.items(), columns=["token", "n"])

    counted = sample.mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), "token").limit(size).collect()]


def count_tokens(
    docs: DataFrame,
    model_file: str,
    text_col: str = "text",
    limit: int = 4096,
    sample_docs: int = 2000,
    table_size: int = 65_536,
) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit added; columns of those names are replaced.

    model_file must exist at the same place on each worker, as an installed vocabulary does.
    """
    import sentencepiece

    spark = docs.sparkSession
    processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
    check_borders(processor)
    tokens = frequent_pretokens(docs, text_col, sample_docs, table_size)
    known = PretokenLengths(processor.encode, {})
    table = spark.sparkContext.broadcast(("\x00".join(tokens), np.array([known[x] for x in tokens], np.uint16)))
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c.lower() not in added]
    schema = schema_with(docs.select(*kept), "n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        joined, lengths = table.value
        frequent = dict(zip(joined.split("\x00"), lengths.tolist(), strict=False)) if len(lengths) else {}
        cache = PretokenLengths(lambda x: processor.encode(x, num_threads=1), frequent)
        for b in batches:
            counts = []
            for text in b.column(text_col).to_pylist():
                counts.append(sum(map(cache.__getitem__, pretokens(text))))
                cache.trim()
            yield beside(b.columns, [pa.array(counts, pa.int64())], schema)

    counted = docs.select(*kept).mapInArrow(run, schema)
    n_bytes = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return counted.select(*kept, n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
