"""Repeated passages, removed word by word: a relative Lempel-Ziv parse of all documents against all of them.

The reference is the table itself, in the order of ids and of places within a document. It is indexed by blocks
that its content cuts: every window of ``window`` words has a least gram (of ``gram`` words, by hash), and the
consecutive windows that share it make a block. Equal windows have the same least gram, wherever they stand, so a
block's gram is the key under which its windows can be found. Of blocks with equal words the index keeps the first
place alone.

A document is parsed greedily: a block that has an earlier place in the index begins a factor, which goes on as long
as the next blocks, too, are indexed at the next places of the same source. At the boundaries of factors, where a
passage ends within a block, no whole block is equal; there windows are looked up one by one, but only in blocks
whose gram also stands in another block, and of equal blocks only in the first. All windows of a factor repeat an
earlier place, so its words go.

All lookups are joins by hashes of 128 bits, of one row a block (some seven words) or window; groups are reduced to
their least place before they are shuffled, joins on hot blocks can be split, and no pair within a group of copies is
ever made. A document's own blocks and factors meet in one row; nothing reaches the driver.

Null text has no words. Null ids come before all others. Rows that repeat id and text are one document and share its
result; of rows that repeat an id alone, the order is that of a hash of their text. An empty table gives none. Texts
of fewer words than a window stay whole. Columns named as results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, discard, materialize, schema_with

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Odd multipliers of the rolling hashes, with good bits.
GRAM, RUN, SECOND, MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))
ADDED = "n_words long, n_removed long, kept string, factors array<struct<start:int,length:int,source_id:{0},source_start:int>>"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, map(re.Match.group, WORD.finditer(text))), np.uint64)


def rolling(h: np.ndarray, size: int, by: np.uint64) -> np.ndarray:
    """A hash of each size consecutive entries of h."""
    total = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        total = total * by + h[j : j + len(total)]
    return mixed(total)


def stretch_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, by: np.uint64) -> np.ndarray:
    """A hash of each stretch of h: sums over prefixes, brought to the power of the first word."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(by, len(h)), out=sums[1:])
    back = np.uint64(pow(int(by), -1, 1 << 64))
    return mixed((sums[ends] - sums[starts]) * powers(back, len(h))[starts] + (ends - starts).astype(np.uint64) * MIX)


def powers(by: np.uint64, n: int) -> np.ndarray:
    found = np.full(n, by)
    found[0] = 1
    return np.cumprod(found)


def blocks_of(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: the hash of its gram, of its words, the first window's start, and how many windows it has."""
    grams = rolling(h, gram, GRAM)
    choices = window - gram + 1
    least = np.arange(len(h) - window + 1) + np.lib.stride_tricks.sliding_window_view(grams, choices).argmin(axis=1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    ends = np.r_[starts[1:], len(least)]
    return grams[least[starts]].view(np.int64), stretch_hashes(mixed(h), starts, ends + window - 1, RUN).view(np.int64), starts, ends - starts


def blocks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, k, gram, words, start, n of each block of docs (id, k, text)."""
    schema = schema_with(docs.select("id", "k"), "gram long, words long, start int, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for row, text in enumerate(b.column(2).cast(pa.binary())):
                h = word_hashes(text.as_py() or b"")
                if len(h) >= window:
                    found.append(blocks_of(h, window, gram))
                    rows.append(np.full(len(found[-1][0]), row))
            if found:
                at = pa.array(np.concatenate(rows))
                made = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield beside([b.column(0).take(at), b.column(1).take(at)], [pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], schema)

    return docs.select("id", "k", "text").mapInArrow(run, schema)


def windows(docs: DataFrame, window: int) -> DataFrame:
    """id, k, start, w_a, w_b: the hashes of each window in the blocks of docs (id, k, text, blocks: start and n)."""
    schema = schema_with(docs.select("id", "k"), "start int, w_a long, w_b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for row, (text, wanted) in enumerate(zip(b.column(2).cast(pa.binary()), b.column(3), strict=True)):
                h = word_hashes(text.as_py() or b"")
                wanted = wanted.values
                first, n = (np.asarray(wanted.field(k)) for k in ("start", "n"))
                starts = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append((starts, *(rolling(x, window, by)[starts].view(np.int64) for x, by in ((h, RUN), (mixed(h), SECOND)))))
                rows.append(np.full(len(starts), row))
            if found:
                at = pa.array(np.concatenate(rows))
                made = [np.concatenate(c) for c in zip(*found, strict=True)]
                yield beside([b.column(0).take(at), b.column(1).take(at)], [pa.array(c, k) for c, k in zip(made, (pa.int32(), pa.int64(), pa.int64()), strict=True)], schema)

    return docs.select("id", "k", "text", "blocks").mapInArrow(run, schema)


def place() -> Column:
    return F.struct("id", "k", "start")


def repeats(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, k, start, n, first: blocks and single windows that have an earlier place. docs: id, k, text.

    What is looked up is written first, so that each join has a plain shuffle on both sides, whose hot keys Spark splits.
    """
    found = materialize(blocks(docs, window, gram), "blocks")
    grams = materialize(found.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("gram"), "grams")
    shared = materialize(found.join(grams, "gram"), "shared")
    discard(found)
    discard(grams)
    least = [F.min(place()).alias("first"), F.count(F.lit(1)).alias("times")]
    firsts = materialize(shared.groupBy("gram", "words").agg(*least, F.min("n").alias("windows")), "firsts")
    again = firsts.where("times > 1").select("gram", "words", "first")
    whole = shared.join(again, ["gram", "words"]).where(place() != F.col("first")).select("id", "k", "start", "n", "first")
    # Blocks that no equal one precedes, under grams of several blocks: their windows are looked up.
    several = materialize(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram"), "several")
    alone = firsts.join(several, "gram").select("first.*", F.col("windows").alias("n"))
    wanted = alone.groupBy(F.col("id").alias("b_id"), F.col("k").alias("b_k")).agg(F.collect_list(F.struct("start", "n")).alias("blocks"))
    texts = docs.join(wanted, (F.col("k") == F.col("b_k")) & F.col("id").eqNullSafe(F.col("b_id")))
    single = materialize(windows(texts, window), "windows")
    twice = materialize(single.groupBy("w_a", "w_b").agg(*least).where("times > 1").drop("times"), "twice")
    late = single.join(twice, ["w_a", "w_b"]).where(place() != F.col("first"))
    return whole.unionAll(late.select("id", "k", "start", F.lit(1).alias("n"), "first"))


def parse(found: list[tuple[int, int, object, int]], window: int) -> list[tuple[int, int, object, int]]:
    """Factors (start, length in words, source, its start) of repeats (start, windows, source, its start) in order."""
    factors: list[tuple[int, int, object, int]] = []
    for start, n, source, source_start in found:
        if factors:
            at, length, of, of_start = factors[-1]
            if at + length - window + 1 == start and of == source and source_start - of_start == start - at:
                factors[-1] = (at, length + n, of, of_start)
                continue
        factors.append((start, n + window - 1, source, source_start))
    return factors


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8) -> DataFrame:
    """docs with n_words, n_removed, kept (the words left, joined by one space) and factors.

    A word is removed if it lies in a window whose words also stand earlier, in a smaller id or further up in its text.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram has a word at least, and is no longer than a window")
    added = {"n_words", "n_removed", "kept", "factors"}
    names = [c for c in docs.columns if c.lower() not in added]
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    found = repeats(keyed, window, gram)
    # Rows that repeat id and text repeat these, too: a set holds each once.
    piece = F.struct("start", "n", F.col("first.id").alias("source_id"), F.col("first.start").alias("source_start"))
    of_doc = found.groupBy(F.col("id").alias("r_id"), F.col("k").alias("r_k")).agg(F.sort_array(F.collect_set(piece)).alias("pieces"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    met = rows.join(of_doc, (F.col("k") == F.col("r_k")) & F.col("id").eqNullSafe(F.col("r_id")), "left").select("row", "text", "pieces")
    schema = schema_with(met.select("row"), ADDED.format(id_type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept, factors = [], [], [], []
            for text, pieces in zip(b.column(1).cast(pa.binary()), b.column(2), strict=True):
                words = WORD.findall(text.as_py() or b"")
                parsed = parse([(p["start"], p["n"], p["source_id"], p["source_start"]) for p in pieces.as_py() or []], window)
                gone = np.zeros(len(words), bool)
                for start, length, _, _ in parsed:
                    gone[start : start + length] = True
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
                factors.append([dict(zip(("start", "length", "source_id", "source_start"), f, strict=True)) for f in parsed])
            piece_type = b.column(2).type.value_type
            factor_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source_id", piece_type.field("source_id").type), ("source_start", pa.int32())]))
            yield beside([b.column(0)], [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, factor_type)], schema)

    return met.mapInArrow(run, schema).select("row.*", "n_words", "n_removed", "kept", "factors")
