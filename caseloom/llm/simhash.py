"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Texts have A-Z lower-cased and are cut into words at white space; shingles of three words, repeats included,
are hashed by XXH64 (seed 42), and a fingerprint bit is 1 if set in over half the hashes. Fingerprints that
differ in at most 3 bits link.

Differing in 3 bits, two fingerprints share at least 5 of their 8 positional bytes. Postings of single bytes
would pair one row with each 256th, so a posting's key is a set of four positions with their bytes. The sets
are chosen so that any five positions hold one, so pairs that may link meet in at least one posting. For pairs
that meet, shared positional bytes are tallied; pairs that reach 5 are verified bit by bit. A posting yields a
spanning forest of its links, not its pairs. Its fingerprints are distinct, copies having been merged before.

A posting of more than POSTING fingerprints is cut into finer ones: the bits that its key leaves open fall into
four parts, of which two fingerprints that link share at least one, since they differ in 3 bits at most. Each part
with its bits is a posting of its own, and is cut again while it is too long; 11 open bits leave no more than
POSTING distinct fingerprints. Sizes are counted before postings are dealt, so no task receives a long one.

Null and wordless texts have fingerprint zero, linked like any other. Texts count whole, however long. A
component's id is its smallest non-null id. Rows that repeat an id are rows of their own. An empty table gives no
row. near_duplicates leaves out columns but id and text, whatever their names; keep_one keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, beside, keyed, materialize, row_key, schema_with
from .components import connected_components

BITS, BYTES, NEAR = 64, 8, 3
SHARED = BYTES - NEAR
#: Fingerprints of a posting that are compared with each other.
POSTING = 2048
#: Odd factors that finer keys are mixed with: postings that fall together by chance are verified like any other.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def position_sets(size: int = SHARED - 1) -> list[tuple[int, ...]]:
    """Sets of positions such that any SHARED positions hold one of them."""
    open_sets = set(combinations(range(BYTES), SHARED))
    chosen = []
    while open_sets:
        best = max(combinations(range(BYTES), size), key=lambda c: (sum(set(c) <= set(o) for o in open_sets), [-x for x in c]))
        chosen.append(best)
        open_sets = {o for o in open_sets if not set(best) <= set(o)}
    return chosen


def fingerprint(text: str | None, width: int = 3) -> int:
    """As a signed 64-bit number."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else [b" ".join(w)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """KEY, k_id and fp for each row."""
    rows = keyed(docs, id_col, text_col)
    schema = schema_with(rows.drop("k_body"), "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *kept, body = b.columns
            yield beside(kept, [pa.array([fingerprint(t, width) for t in body.to_pylist()], pa.int64())], schema)

    return rows.mapInArrow(run, schema)


def postings(fps: DataFrame) -> DataFrame:
    """(key, open, fp): the key holds the number of a position set and a hash-free join of its bytes; open: the other bits."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]

    def posting(number: int, positions: tuple[int, ...]) -> Column:
        k = F.lit(number).cast("long")
        for p in positions:
            k = F.shiftleft(k, 8).bitwiseOR(byte[p])
        rest = sum(255 << 8 * i for i in range(BYTES) if i not in positions)
        return F.struct(k.alias("key"), F.lit(signed(rest)).cast("long").alias("open"))

    made = F.array(*[posting(n, p) for n, p in enumerate(position_sets())])
    return fps.select("fp", F.explode(made).alias("p")).select("p.*", "fp")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def parts(open_bits: int) -> list[int]:
    """The open bits in NEAR + 1 parts: whoever differs in NEAR bits shares a part."""
    bits = [1 << i for i in range(BITS) if open_bits >> i & 1]
    return [sum(bits[i :: NEAR + 1]) for i in range(NEAR + 1)]


def cut(long: DataFrame) -> DataFrame:
    """The finer postings (key, open, fp) of postings that are too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for open_bits, rows in b.groupby("open"):
                key, fp = rows["key"].to_numpy().view(np.uint64), rows["fp"].to_numpy()
                for part in parts(int(open_bits) & ((1 << BITS) - 1)):
                    inside = fp.view(np.uint64) & np.uint64(part)
                    finer = key * np.uint64(MIX[0]) + inside * np.uint64(MIX[1]) + np.uint64(part) * np.uint64(MIX[2])
                    finer = (finer ^ (finer >> np.uint64(29))) * np.uint64(MIX[0])
                    yield pd.DataFrame({"key": finer.view(np.int64), "open": np.int64(int(open_bits) & ~signed(part)), "fp": fp})

    return long.mapInPandas(run, "key long, open long, fp long")


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: tally shared bytes, then verify."""
    n = len(fp)
    bits = fp.view(np.uint64)
    as_bytes = fp.view(np.uint8).reshape(n, BYTES)
    label = np.arange(n)
    for at in range(n):
        shared = (as_bytes[at + 1 :] == as_bytes[at]).sum(axis=1)
        later = at + 1 + np.flatnonzero(shared >= SHARED)
        later = later[np.bitwise_count(bits[later] ^ bits[at]) <= NEAR]
        if len(later):
            met = np.unique(label[[at, *later]])
            label[np.isin(label, met)] = met[0]
    joined = np.flatnonzero(label != np.arange(n))
    return fp[label[joined]], fp[joined]


def posting_links(level: DataFrame) -> DataFrame:
    """Links (a, b) that span the components within each posting."""
    n = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = level.select("key", "fp").repartition(n, "key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams sorted postings; most hold one fingerprint alone and are skipped."""
        key, held = None, [np.zeros(0, np.int64)]

        def close() -> Iterator[pd.DataFrame]:
            fp = np.concatenate(held)
            if len(fp) > 1:
                a, b = forest(fp)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

        for batch in batches:
            keys, fp = batch["key"].to_numpy(), batch["fp"].to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(keys)]
            long = ends - starts > 1
            if len(long):
                long[0] = long[-1] = True
            for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                if keys[s] != key:
                    yield from close()
                    key, held = keys[s], []
                held.append(fp[s:e])
        yield from close()

    return dealt.mapInPandas(run, "a long, b long")


def links(fps: DataFrame, posting: int = POSTING) -> DataFrame:
    """Links (a, b) that span each component of the distinct fingerprints fps; postings longer than posting are cut."""
    level, found = postings(fps), []
    while True:
        size = level.groupBy("key", "open").count()
        long = materialize(size.where((F.col("count") > posting) & (F.bit_count("open") > max(NEAR, posting.bit_length() - 1))).select("key", "open"), "long")
        if not long.head(1):
            found.append(materialize(posting_links(level), "links"))
            return reduce(DataFrame.unionAll, found)
        found.append(materialize(posting_links(level.join(long, ["key", "open"], "left_anti")), "links"))
        level = materialize(cut(level.join(long, ["key", "open"], "left_semi")), "postings")


def classified(docs: DataFrame, id_col: str, text_col: str, posting: int) -> DataFrame:
    """KEY, k_id, fp, label (of the component) and component_id for each row."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("k_id").alias("least")), "classes")
    classes = connected_components(links(fps.select("fp"), posting))
    of_fp = fps.join(classes, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of_fp.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(of_fp.select("fp", "label").join(least, "label"), "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hexadecimal digits), component_id."""
    found = classified(docs, id_col, text_col, posting)
    return found.select(F.col("k_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING) -> DataFrame:
    """Of each component the row with the smallest id stays, with all columns.

    If that id repeats within the component, one row of them stays, that of the least key and then of the least
    columns, read as JSON; so it does if all ids are null.
    """
    found = classified(docs, id_col, text_col, posting)
    heads = found.where(F.col("k_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min(F.struct(*KEY)).alias("head")).select("head.*")
    own = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return own.join(heads, KEY, "left_semi").groupBy(*KEY).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
