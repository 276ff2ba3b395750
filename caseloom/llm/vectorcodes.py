"""Compression of vectors to short codes: a codebook for each part of the vector, searched by annular norm pruning.

Vectors become whole numbers, floor(scale * x), and are cut into consecutive parts; each part is replaced by the
number of its nearest codebook entry. Entries are sorted by their norm: by the triangle inequality an entry at
distance d of x has a norm within d of that of x, so a binary search on the norms gives the annulus that the best
distance so far allows, and only its entries are evaluated, exactly and its ends included. The search starts at the
entry of nearest norm, goes outwards and narrows the annulus with each better entry. Ties go to the lower number.

Codebooks start as the parts of the vectors of smallest id. Each round is one pass over the vectors: a task sums up
the parts of each entry, sums of tasks meet in Spark, and parts x entries x width numbers reach the driver, whatever
the number of vectors. Entries become the floored means of their parts; unused ones stay.

Rows whose vector is null, or holds null or non-finite components, are dropped. Codebooks have the width of the
vector of smallest id; vectors of another length keep a null code and error, and train nothing. If the width is no
multiple of the parts, part j goes from floor(j * width / parts). Null ids are coded but start no entry; rows that
repeat an id are rows of their own, the lesser vector first. Fewer ids than entries make fewer entries; without any
id, codes are null. Whole numbers are held within 2^27, x of 32,768 at scale 4096, so that all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, schema_with

LIMIT = 1 << 27


class Annuli:
    """The entries of one part, in the order of their norms."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and squared distance, for each row of x."""
        size = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        right = np.searchsorted(self.norms, size).clip(1, len(self.norms) - 1) if len(self.norms) > 1 else np.zeros(len(x), int)
        left = np.maximum(right - 1, 0)
        start = np.where(size - self.norms[left] <= self.norms[right] - size, left, right)
        best = ((x - self.entries[start]) ** 2).sum(axis=1)
        number = self.order[start]
        low, high = self._annulus(size, best)
        for step in range(1, len(self.norms)):
            open_rows = np.flatnonzero((start - step >= low) | (start + step < high))
            if not len(open_rows):
                break
            for rank in (start[open_rows] - step, start[open_rows] + step):
                inside = (rank >= low[open_rows]) & (rank < high[open_rows])
                at, rank = open_rows[inside], rank[inside]
                away = ((x[at] - self.entries[rank]) ** 2).sum(axis=1)
                better = (away < best[at]) | ((away == best[at]) & (self.order[rank] < number[at]))
                at, away, rank = at[better], away[better], rank[better]
                best[at], number[at] = away, self.order[rank]
                low[at], high[at] = self._annulus(size[at], away)
        return number, best

    def _annulus(self, size: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks whose norms lie within the root of best of size; a little more, for rounding."""
        reach = np.sqrt(best.astype(float)) * (1 + 1e-9) + 1e-6 + 1e-9 * size
        return np.searchsorted(self.norms, size - reach, "left"), np.searchsorted(self.norms, size + reach, "right")


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    return [(j * width // parts, (j + 1) * width // parts) for j in range(parts)]


def assign(vectors: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows x parts: numbers of the nearest entries, and squared distances."""
    found = [Annuli(book).nearest(vectors[:, low:high]) for book, (low, high) in zip(codebooks, bounds(vectors.shape[1], len(codebooks)), strict=True)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def whole(column: pa.Array, width: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have this length, and their vectors as whole numbers."""
    fits = np.diff(column.offsets.to_numpy()) == width
    values = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(float)
    return fits, np.clip(np.floor(scale * values), -LIMIT, LIMIT).astype(np.int64).reshape(int(fits.sum()), width)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def seeds(rows: DataFrame, id_col: str, entries: int, parts: int, scale: float) -> list[np.ndarray]:
    """Codebooks as they start: parts of the vectors of the smallest ids, one array a part."""
    first = [r[0] for r in rows.where(F.col(id_col).isNotNull()).orderBy(id_col, "v").limit(entries).select("v").collect()]
    same = [np.array(v, float) for v in first if len(v) == len(first[0])]
    if not same:
        return []
    vectors = np.clip(np.floor(scale * np.stack(same)), -LIMIT, LIMIT).astype(np.int64)
    return [vectors[:, low:high] for low, high in bounds(vectors.shape[1], parts)]


def part_sums(rows: DataFrame, codebooks: list[np.ndarray], width: int, scale: float) -> DataFrame:
    """(part, entry, place, total, n): sums of the parts that each entry is nearest to; place -1 carries n alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, np.int64) for b in codebooks]
        counts = [np.zeros(len(b), np.int64) for b in codebooks]
        for batch in batches:
            _, vectors = whole(batch.column(0), width, scale)
            numbers, _ = assign(vectors, codebooks)
            for j, (low, high) in enumerate(bounds(width, len(codebooks))):
                np.add.at(totals[j], numbers[:, j], vectors[:, low:high])
                counts[j] += np.bincount(numbers[:, j], minlength=len(counts[j]))
        made = [(j, e, p, total, 0) for j, t in enumerate(totals) for e in np.flatnonzero(counts[j]).tolist() for p, total in enumerate(t[e].tolist())]
        made += [(j, e, -1, 0, n) for j, c in enumerate(counts) for e, n in enumerate(c.tolist()) if n]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["part", "entry", "place", "total", "n"])

    made = rows.select("v").mapInArrow(run, "part int, entry int, place int, total long, n long")
    return made.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def train(rows: DataFrame, id_col: str, entries: int, parts: int, rounds: int, scale: float) -> list[np.ndarray]:
    codebooks = seeds(rows, id_col, entries, parts, scale)
    width = sum(b.shape[1] for b in codebooks)
    for _ in range(rounds if codebooks else 0):
        found = part_sums(rows, codebooks, width, scale).collect()  # parts x entries x width numbers
        n = {(r["part"], r["entry"]): r["n"] for r in found if r["place"] < 0}
        codebooks = [b.copy() for b in codebooks]
        for r in found:
            if r["place"] >= 0:
                codebooks[r["part"]][r["entry"], r["place"]] = int(r["total"]) // n[r["part"], r["entry"]]
    return codebooks


def encode(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: float = 4096.0,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Usable rows of df with code (two hex digits a part) and error (squared distance) added, and the codebooks.

    Columns of those names are replaced.
    """
    if not 0 < entries <= 256 or parts < 1:
        raise ValueError("a code has one part at least, and 256 entries at most")
    kept = [c for c in df.columns if c.lower() not in ("code", "error", "v")]
    usable_rows = df.where(usable(F.col(vector_col)))
    of = [F.col(f"`{c}`") for c in kept]
    codebooks = train(usable_rows.select(F.col(id_col), F.col(vector_col).alias("v")), id_col, entries, parts, rounds, scale)
    width = sum(b.shape[1] for b in codebooks)
    schema = schema_with(usable_rows.select(*of), "code string, error long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            if codebooks:
                fits, vectors = whole(b.column(len(kept)), width, scale)
                numbers, away = assign(vectors, codebooks)
                digits = numbers.astype(np.uint8).tobytes().hex()
                codes[fits] = [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)]
                errors[fits] = away.sum(axis=1)
            yield beside(b.columns[: len(kept)], [pa.array(codes, pa.string()), pa.array(errors, pa.int64())], schema)

    return usable_rows.select(*of, F.col(vector_col).alias("v")).mapInArrow(run, schema), codebooks
