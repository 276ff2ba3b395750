"""Benchmark decontamination with DataFrame functions alone.

Benchmark items become windows of n consecutive normalised words (a shorter item is one window). Of each
window, all its grams of n // 2 + 1 words are put into a hash set, which is broadcast while it is small enough,
and joined by shuffle beyond that. One scan looks at every document's grams at every so many words, such that
each window of it holds exactly one scanned gram. Where a gram is in the set, the windows around it are looked up
by hash and verified word by word. A scanned gram carries the words around it, never a whole text, so the work is
linear in a text's length. A window that a document, or its copies, hold again and again is gathered once a place.

Null or wordless texts have no words and no hits; null or wordless items give no window. Rows that repeat
id and text share one result, null ids among them; items that repeat an id count as one. An empty benchmark hits
nothing, and no documents give no row. Columns of the documents that are named as results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, keyed, materialize, row_key, words

#: The hash set and its windows are broadcast up to this many bytes of words and items, in all.
BROADCAST_BYTES = 200 << 20


def gram_size(n: int) -> tuple[int, int]:
    """Words of a gram, and how far scanned grams lie apart: a window of n words holds one scanned gram."""
    size = n // 2 + 1
    return size, n - size + 1


def hash_of(word_list: Column, start: Column | int, n: int) -> Column:
    return F.xxhash64(*[F.get(word_list, start + F.lit(i)) for i in range(n)])


def scanned_grams(word_list: Column, n: int) -> Column:
    """Structs (start, h, c): c holds the words of all windows around the gram, null beyond the text's ends."""
    size, step = gram_size(n)
    around = lambda p: F.transform(F.sequence(p - (step - 1), p + (n - 1)), lambda i: F.get(word_list, i))
    at = F.sequence(F.lit(0), F.size(word_list) - size, F.lit(step))
    grams = F.transform(at, lambda p: F.struct((p - (step - 1)).alias("start"), hash_of(word_list, p, size).alias("h"), around(p).alias("c")))
    return F.when(F.size(word_list) >= n, grams)


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """Distinct windows: size, win (its words), items (sorted ids as strings)."""
    lists = benchmark.select(F.col(item_col).cast("string").alias("item"), words(ascii_lower(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    each = lists.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("win"))
    return each.groupBy("size", "win").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13) -> DataFrame:
    """Documents with hits: their key, n_hit (words inside any window), hit (those positions), items (sorted)."""
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, n).withColumn("no", F.monotonically_increasing_id()), "benchmark")
    strings = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 16)
    sizes = sorted((r[0], r[1]) for r in windows.groupBy("size").agg(F.sum(strings(F.col("win")) + strings(F.col("items")) + 16 * F.col("size"))).collect())
    small = sum(bytes_ for _, bytes_ in sizes) <= BROADCAST_BYTES
    near = lambda df: F.broadcast(df) if small else df
    lists = keyed(docs, id_col, text_col).select(*KEY, words(ascii_lower(F.col("k_body"))).alias("w"))
    if not sizes:
        none = lists.where(F.lit(False)).select(*KEY)
        return none.select(*KEY, F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))

    def by_size(make: Callable[[int], Column]) -> Column:
        chosen = F.when(F.col("size") == sizes[0][0], make(sizes[0][0]))
        for size, _ in sizes[1:]:
            chosen = chosen.when(F.col("size") == size, make(size))
        return chosen

    def grams(size: int) -> Column:
        gram, step = gram_size(size)
        return F.array(*[hash_of(F.col("win"), i, gram) for i in range(step)])

    def around(size: int) -> Column:
        return F.array(*[F.struct((F.col("start") + i).alias("at"), F.slice("c", i + 1, size).alias("text_win"), hash_of(F.col("c"), i, size).alias("h")) for i in range(gram_size(size)[1])])

    one = windows.select("size", by_size(lambda size: hash_of(F.col("win"), 0, size)).alias("h"), "win", "no")
    known = windows.select("size", F.explode(by_size(grams)).alias("h")).distinct()
    none = F.array().cast("array<struct<size:int,start:int,h:bigint,c:array<string>>>")
    sized = lambda size: F.transform(scanned_grams(F.col("w"), size), lambda g: F.struct(F.lit(size).alias("size"), g["start"].alias("start"), g["h"].alias("h"), g["c"].alias("c")))
    found = F.concat(*[F.coalesce(sized(size), none) for size, _ in sizes])
    scanned = lists.select(*KEY, F.explode(found).alias("gram")).select(*KEY, "gram.*")
    met = scanned.join(near(known), ["size", "h"], "left_semi").select(*KEY, "size", F.explode(by_size(around)).alias("x")).select(*KEY, "size", "x.*")
    hit = met.join(near(one), ["size", "h"]).where(F.col("text_win") == F.col("win"))
    runs = F.flatten(F.transform("runs", lambda r: F.sequence(r["at"], r["at"] + (r["size"] - 1))))
    sets = hit.groupBy(*KEY).agg(F.collect_set(F.struct("at", "size")).alias("runs"), F.collect_set("no").alias("nos"))
    # Read twice, so written: else the scan of all texts would run twice.
    sets = materialize(sets.select(*KEY, F.array_sort(F.array_distinct(runs)).alias("hit"), "nos"), "hits")
    # Hits carry a window's number; its items, which may be very many, are joined once a document and window.
    items = sets.select(*[F.col(c).alias(f"of_{c}") for c in KEY], F.explode("nos").alias("no")).join(near(windows.select("no", "items")), "no")
    items = items.select(*[f"of_{c}" for c in KEY], F.explode("items").alias("item")).groupBy(*[f"of_{c}" for c in KEY]).agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"of_{c}") for c in KEY])
    return sets.join(items, same).select(*KEY, F.size("hit").cast("long").alias("n_hit"), "hit", "items")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, least_share: float = 0.05) -> DataFrame:
    """One row per document: its id, n_words, n_hit, n_items, items (sorted), contaminated."""
    per = round(1 / least_share)
    all_docs = keyed(docs, id_col, text_col).select(*KEY, "k_id", F.size(words(F.col("k_body"))).cast("long").alias("n_words"))
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, n).drop("hit")
    joined = all_docs.join(found, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        F.col("k_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        ((n_hit > 0) & (n_hit * per >= F.col("n_words"))).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, least_share: float = 0.05, spans: bool = False) -> DataFrame:
    """docs without contaminated documents; with spans, contaminated ones stay but lose the words that were hit."""
    per = round(1 / least_share)
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, n)
    columns = docs.columns
    own = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    joined = own.join(found.select(*KEY, "n_hit", "hit"), KEY, "left")
    text = F.col(f"row.`{text_col}`")
    dirty = F.col("n_hit").isNotNull() & (F.col("n_hit") * per >= F.size(words(text)))
    if not spans:
        return joined.where(~dirty).select("row.*")
    chunk = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    after = lambda k: F.coalesce(F.get("hit", k - 1) + 1, F.lit(0))
    clean = F.transform(F.sequence(F.lit(0), F.size("hit")), lambda k: F.slice("chunk", after(k) + 1, F.coalesce(F.get("hit", k), F.size("chunk")) - after(k)))
    cut = F.concat(F.array_join(F.flatten(clean), ""), tail)
    joined = joined.withColumn("chunk", F.when(dirty, chunk))
    return joined.select(*[(F.when(dirty, cut).otherwise(text) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns])
