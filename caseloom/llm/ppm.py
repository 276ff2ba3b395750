"""Language-model scores: prediction by partial matching over bytes, and a smoothed word baseline.

The model counts each symbol, a byte or the mark of a text's end, behind the contexts of up to ``order``
symbols before it, over all training texts; what it gathers grows with them. A symbol's probability in a
context follows escape method C with symbol exclusion: of n symbols, d of them distinct, seen in a context, one
seen c times gets c / (n + d) and the escape d / (n + d); the escape leads to the next shorter context without
the symbols already seen, and at last to equal shares of what is left.

A window is a context of full length and its symbol, written as one number. Windows are counted in tasks, then
by Spark; the counts lie in the shared folder. A broadcast tier of the commonest serves most lookups. The
others of a document, each once with its number of times, are joined by window; windows never seen in training
descend to shorter contexts, each once, whatever number of documents holds it.

The word baseline counts words over all training texts. A broadcast tier of the commonest words, bounded by their
number and their bytes, serves most lookups. The others of a document, each once with its number of times, are joined
by word: one row a document and word. Such a word is rare, or longer than TIER_WORD bytes; Spark splits the join's keys.

Null text counts as empty: the end mark alone. Long texts are counted and scored in stretches of CHUNK bytes, each
with the context before it. Rows that repeat an id are scored each; null ids train. An empty table gives no row;
columns of the documents but id and text are left out, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket, materialize, schema_with

SYMBOLS, END = 257, 256
#: Longest order whose windows fit 64 bits.
MOST_ORDER = 6
#: Bytes that are counted at once, and distinct words and windows that a task holds before it passes them on.
CHUNK, HELD_WORDS, HELD_WINDOWS = 4 << 20, 400_000, 2_000_000
#: Words of the broadcast tier: at most this many, of at most so many bytes together, none longer than TIER_WORD bytes.
TIER, TIER_TOTAL, TIER_WORD = 131_072, 16 << 20, 1 << 16
#: Windows of the broadcast tier at most, and steps of a doubling by which their least count is found.
WINDOW_TIER, STEPS = 1_048_576, 16
#: Bytes that are scored at once, as far as texts allow, few enough for a processor's cache, and factors that windows are hashed by.
SCORED, FACTORS = 1 << 18, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def encoded(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; null counts as empty."""
    for t in texts.cast(pa.binary()):
        yield t.as_py() or b""


def cells(texts: list[bytes], order: int = 2) -> np.ndarray:
    """The window (order symbols before, symbol) of each symbol of some texts, ends included."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + order + 1) - 1
    symbols = np.full(int(ends[-1]) + 1 if len(texts) else 0, END, np.int64)
    inside = np.ones(len(symbols), bool)
    for k in range(order + 1):
        inside[ends - size * (k > 0) - k] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8)
    inside[ends] = True
    window = np.zeros(len(symbols) - order if len(texts) else 0, np.int64)
    for k in range(order + 1):
        window *= SYMBOLS
        window += symbols[k : k + len(window)]
    return window[inside[order:]]


def chunks(texts: Iterator[bytes], most: int = CHUNK, alone: int = CHUNK) -> Iterator[list[bytes]]:
    """Texts of about most bytes together; one of over alone bytes comes by itself."""
    held, size = [], 0
    for t in texts:
        if held and len(t) > alone:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def stretches(part: list[bytes], order: int, most: int = CHUNK) -> Iterator[np.ndarray]:
    """cells of a part from chunks; those of one long text in stretches, which hold the same windows."""
    if len(part) != 1 or len(part[0]) <= most:
        yield cells(part, order)
        return
    text = part[0]
    for at in range(0, len(text), most):
        window = cells([text[max(0, at - order) : at + most]], order)
        yield window[min(at, order) : None if at + most >= len(text) else -1]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, ascending, and the sums of their counts."""
    window, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(window, kind="stable")
    window, n = window[by], n[by]
    first = np.flatnonzero(np.diff(window, prepend=-1))
    return window[first], np.add.reduceat(n, first) if len(first) else n


def window_counts(training: DataFrame, text_col: str, order: int) -> DataFrame:
    """w, n: the windows of all training texts, combined in each task first."""

    def batch(window: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(window, pa.int64()), pa.array(n, pa.int64())], ["w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh, size = None, [], 0
        for part in chunks(t for b in batches for t in encoded(b.column(0))):
            for window in stretches(part, order):
                fresh.append(np.unique(window, return_counts=True))
                size += len(fresh[-1][0])
                if size > HELD_WINDOWS:
                    held = merged([*([held] if held else []), *fresh])
                    fresh, size = [], 0
                    if len(held[0]) > HELD_WINDOWS:
                        yield batch(*held)
                        held = None
        if held or fresh:
            yield batch(*merged([*([held] if held else []), *fresh]))

    return training.select(F.col(text_col)).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def seen_windows(counts: DataFrame) -> DataFrame:
    """w, n, lp: log10 of the probability of windows seen in training, which never escape."""
    own = W.partitionBy(F.expr(f"w div {SYMBOLS}"))
    n, d = F.sum("n").over(own), F.count(F.lit(1)).over(own)
    return counts.select("w", "n", F.log10(F.col("n") / (n + F.when(d < SYMBOLS, d).otherwise(0))).alias("lp"))


def commonest(counted: DataFrame, size: int, weight: Column | None = None, total: int = 0) -> DataFrame:
    """At most size rows whose n is highest, of at most total in weight, if one is given.

    Rows of a like n go together, so that no task and no driver sorts them.
    """
    step = F.floor(F.log2("n") * STEPS).cast("int")
    of = F.lit(0) if weight is None else weight
    least = None
    for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.sum(of).alias("weight")).orderBy(F.desc("step")).collect():
        size, total = size - r["rows"], total - r["weight"]
        if min(size, total) < 0:
            break
        least = r["step"]
    return counted.where(step >= least if least is not None else F.lit(False))


def window_table(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their lp."""
    table = found.select("w", "lp").toArrow()
    return table["w"].to_numpy(), table["lp"].to_numpy().astype(np.float32)


class NearWindows:
    """lp by window, in one of two slots each; windows that find both taken are left to the join."""

    def __init__(self, window: np.ndarray, lp: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(window)).bit_length())
        self.window, self.lp = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        for factor in FACTORS:
            at = self.slot(window, factor)
            free = self.window[at] < 0
            self.window[at[free]] = window[free]
            self.lp[at[free]] = lp[free]
            own = self.window[at] == window
            self.lp[at[own]] = lp[own]
            window, lp = window[~own], lp[~own]

    def slot(self, window: np.ndarray, factor: int) -> np.ndarray:
        return ((window.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - self.bits)).view(np.int64)

    def look_up(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """lp, 0 where not held, and the places of windows that are not held."""
        at = self.slot(window, FACTORS[0])
        met = self.window[at] == window
        lp = np.where(met, self.lp[at], 0.0).astype(float)
        lost = np.flatnonzero(~met)
        at = self.slot(window[lost], FACTORS[1])
        met = self.window[at] == window[lost]
        lp[lost[met]] = self.lp[at[met]]
        return lp, lost[~met]


def suffixes(order: int, n: str) -> Column:
    """Structs (k, w, n) of a window cut down to each order k."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("w") % SYMBOLS ** (k + 1)).alias("w"), F.col(n).alias("n")) for k in range(order + 1)]))


def escaped_windows(counts: DataFrame, unseen: DataFrame, order: int) -> DataFrame:
    """w, lp for each w of unseen, distinct windows that counts lacks."""
    context = F.expr(f"w div {SYMBOLS}")
    levels = materialize(counts.select(suffixes(order, "n").alias("s")).select("s.*").groupBy("k", "w").agg(F.sum("n").alias("n")), "levels")
    shorter = levels.select((F.col("k") + 1).alias("k"), F.col("w").alias("up"), F.col("n").alias("x"))
    place = F.element_at(F.array(*[F.lit(SYMBOLS**k) for k in range(order + 1)]), F.col("k") + 1)
    # of a context: symbols, distinct ones, and how often the next shorter context met these
    nodes = materialize(
        levels.withColumn("up", F.col("w") % place).join(shorter, ["k", "up"], "left").groupBy("k", context.alias("ctx")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.sum("x").alias("x")), "contexts"
    )
    asked = unseen.select("w", suffixes(order, "w").alias("s")).select(F.col("s.n").alias("of"), "s.k", "s.w").withColumn("ctx", context)

    def looked_up(left: DataFrame, right: DataFrame, on: list[str], few: int) -> DataFrame:
        """Left join; orders up to few have at most 257 ** 2 + 258 rows and are broadcast, as all rows ask for them."""
        low = left.where(F.col("k") <= few).join(F.broadcast(right.where(F.col("k") <= few)), on, "left")
        return low.unionByName(left.where(F.col("k") > few).join(right.where(F.col("k") > few), on, "left"))

    met = looked_up(looked_up(asked, levels.withColumnRenamed("n", "c"), ["k", "w"], 1), nodes, ["k", "ctx"], 2)
    path = F.reverse(F.array_sort(F.collect_list(F.struct("k", "c", "n", "d", "x"))))
    start = F.struct(F.lit(False).alias("done"), F.lit(0.0).alias("lp"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("d"))

    def step(state: Column, at: Column) -> Column:
        n, d = at["n"] - state["x"], at["d"] - state["d"]
        whole = n + F.when(at["d"] < SYMBOLS, d).otherwise(0)
        share = F.when(n > 0, F.log10(F.coalesce(at["c"], d) / whole)).otherwise(0.0)
        down = F.struct(at["c"].isNotNull().alias("done"), (state["lp"] + share).alias("lp"), F.coalesce(at["x"], F.lit(0)).alias("x"), at["d"].alias("d"))
        return F.when(state["done"] | at["n"].isNull(), state).otherwise(down)

    rest = lambda state: state["lp"] - F.when(state["done"], 0.0).otherwise(F.log10(F.greatest(SYMBOLS - state["d"], F.lit(1)).cast("double")))
    return met.groupBy("of").agg(path.alias("path")).select(F.col("of").alias("w"), F.aggregate("path", start, step, rest).alias("lp"))


def word_counts(training: DataFrame, text_col: str) -> DataFrame:
    """word (bytes, A-Z lower-cased), n: over all training texts, combined in each task first."""

    def batch(seen: Counter[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for text in encoded(b.column(0)):
                seen.update(text.lower().split())
                if len(seen) > HELD_WORDS:
                    yield batch(seen)
                    seen.clear()
        yield batch(seen)

    return training.select(F.col(text_col)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tier(dict):
    """Word -> (log10 probability, known), nan for words of the other tier."""

    def __missing__(self, word: bytes) -> float:
        return np.nan


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, held_remainder: int = 0, tier_size: int = TIER, order: int = 2, window_tier: int = WINDOW_TIER) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    Rows whose bucket is held_remainder are held out of all counts. order is the length of the longest context.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order must lie between 1 and {MOST_ORDER}")
    spark = docs.sparkSession
    held: Column = F.coalesce(bucket(id_col, modulus) == held_remainder, F.lit(False))
    training = docs.where(~held)
    counts = materialize(word_counts(training, text_col), "words")
    n_texts = training.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = n_words + n_texts, distinct + (n_texts > 0)
    whole = total + 0.1 * (kinds + 1)
    common = commonest(counts.where(F.length("word") <= TIER_WORD), tier_size, F.length("word"), TIER_TOTAL).select("word", "n").toArrow()
    tier = spark.sparkContext.broadcast(dict(zip(common["word"].to_pylist(), common["n"].to_pylist(), strict=True)))
    del common
    windows = materialize(window_counts(training, text_col, order), "windows")
    seen = materialize(seen_windows(windows), "seen")
    near_windows = spark.sparkContext.broadcast(window_table(commonest(seen, window_tier)))

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), held.alias("held_out"), F.monotonically_increasing_id().alias("rid"))
    schema = schema_with(rows.drop("text"), "n_tokens long, near_known long, near_score double, score double, rare array<struct<word:binary,m:long>>, far array<struct<w:long,m:long>>")
    end_score = float(np.log10((n_texts + 0.1) / whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = NearWindows(*near_windows.value)
        near = Tier({w: float(np.log10((c + 0.1) / whole)) for w, c in tier.value.items()})
        pair = pa.struct([("w", pa.int64()), ("m", pa.int64())])
        for b in batches:
            out: list[list] = [[], [], [], []]
            rare_w, rare_m, rare_size = [], [], []
            far_w, far_m, far_size = [], [], []
            for part in chunks(encoded(b.column(0)), SCORED):
                if len(part) == 1:
                    sums, missed = [], []
                    for window in stretches(part, order):
                        lp, lost = model.look_up(window)
                        sums.append(float(lp.sum()))
                        missed.append(np.unique(window[lost], return_counts=True))
                    distinct, m = merged(missed)
                    out[3].append(sum(sums))
                    far_w.append(distinct)
                    far_m.append(m)
                    far_size.append(np.array([len(distinct)]))
                else:
                    size = np.fromiter(map(len, part), np.int64, len(part)) + 1
                    window = cells(part, order)
                    lp, lost = model.look_up(window)
                    out[3] += np.add.reduceat(lp, np.cumsum(size) - size).tolist()
                    distinct, which = np.unique(window[lost], return_inverse=True)
                    each_doc = max(1, len(distinct))
                    code, m = np.unique(np.searchsorted(np.cumsum(size), lost, "right") * each_doc + which, return_counts=True)
                    far_w.append(distinct[code % each_doc])
                    far_m.append(m)
                    far_size.append(np.bincount(code // each_doc, minlength=len(part)))
                for text in part:
                    found = text.lower().split()
                    each = np.fromiter(map(near.__getitem__, found), float, len(found))
                    far = np.flatnonzero(np.isnan(each)).tolist()
                    out[0].append(len(found) + 1)
                    out[1].append(len(found) - len(far) + (n_texts > 0))
                    out[2].append(float(np.nansum(each)) + end_score)
                    rare = Counter([found[i] for i in far])
                    rare_w += rare.keys()
                    rare_m += rare.values()
                    rare_size.append(len(rare))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            rare_pairs = pa.StructArray.from_arrays([pa.array(rare_w, pa.binary()), pa.array(rare_m, pa.int64())], names=["word", "m"])
            rare_lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *rare_size]), pa.int32()), rare_pairs)
            none = [np.zeros(0, np.int64)]
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(none + x), pa.int64()) for x in (far_w, far_m)], fields=list(pair))
            ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *far_size]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True)), rare_lists, lists], schema.names)

    near = materialize(rows.mapInArrow(run, schema), "scored")
    rare = near.select("rid", F.explode("rare").alias("rare")).select("rid", "rare.*").join(counts, "word", "left")
    lost = near.select("rid", F.explode("far").alias("far")).select("rid", "far.*")
    unseen = materialize(lost.select("w").distinct().join(seen, "w", "left_anti"), "unseen")
    priced = seen.select("w", "lp").unionByName(escaped_windows(windows, unseen, order))
    c = F.coalesce("n", F.lit(0))
    by_word = rare.select("rid", (F.col("m") * F.log10((c + 0.1) / whole)).alias("far_score"), F.when(c > 0, F.col("m")).otherwise(0).alias("far_known"), F.lit(0.0).alias("far_lp"))
    by_window = lost.join(priced, "w").select("rid", F.lit(0.0).alias("far_score"), F.lit(0).cast("long").alias("far_known"), (F.col("m") * F.col("lp")).alias("far_lp"))
    far = by_word.unionByName(by_window).groupBy("rid").agg(*[F.sum(x).alias(x) for x in ("far_score", "far_known", "far_lp")])
    joined = near.drop("rare", "far").join(far, "rid", "left")
    return joined.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("near_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("near_score") + F.coalesce("far_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("far_lp", F.lit(0.0))).alias("score"),
    )
