"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the
sum over all ways to cut it into pieces (forward algorithm); a text's is the product over its words. Piece
probabilities are fitted by expectation maximisation on word counts of a bounded labelled sample.

A word is a run of letters, in lower case, with a mark before it. Forward sums are rescaled on the way, so that
words of any length keep their probability, at a memory of some hundred bytes a letter of the longest word.

Null text, or text without a letter: ``und`` with score 0. Ties go to the alphabetically first language.
Repeated rows are scored each; without training rows, or in an empty table, no language is learnt and every text
is ``und``. Columns named as results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, schema_with

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker's cache holds, and letters of the longest of them.
CACHED_WORDS, CACHED_LETTERS = 600_000, 64
#: Steps after which forward sums are rescaled: none falls below UNSEEN ** RESCALED.
RESCALED = 16
#: Probability of a letter that no piece covers.
UNSEEN = 1e-7


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    pieces: list[str]
    probability: np.ndarray  # pieces x languages


def vocabulary(model_file: str) -> list[str]:
    """Lower-case letter pieces of a public piece model; a leading mark stands for a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = set()
    for i in range(model.get_piece_size()):
        body = (piece := model.id_to_piece(i)).removeprefix("▁")
        if (piece == "▁" or body.isalpha()) and body == body.lower():
            found.add(piece)
    return sorted(found)


class Segmenter:
    """Forward and backward sums over all segmentations, for many words of one length at a time."""

    def __init__(self, pieces: list[str]) -> None:
        self.chars = {c: i + 1 for i, c in enumerate(sorted(set("".join(pieces))))}
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in self.chars]] = list(self.chars.values())
        nodes = {"": 1}
        for p in pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes) + 1)
        self.n_nodes, self.width = len(nodes) + 1, len(self.chars) + 1
        self.longest = max(map(len, pieces), default=1)
        self.node_of = np.array([nodes[p] for p in pieces], np.int64)
        edges = sorted((nodes[p[:-1]] * self.width + self.chars[p[-1]], n) for p, n in nodes.items() if p)
        self.edge = np.array([e for e, _ in edges] or [-1], np.int64)
        self.target = np.array([n for _, n in edges] or [0], np.int32)
        self.single = np.zeros(self.n_nodes, bool)
        self.single[[0, *(n for p, n in nodes.items() if len(p) == 1)]] = True
        self.dense = None
        if self.n_nodes * self.width <= 1 << 24:
            self.dense = np.zeros(self.n_nodes * self.width, np.int32)
            self.dense[self.edge[self.edge >= 0]] = self.target[self.edge >= 0]

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next node; 0 if none."""
        key = node.astype(np.int64) * self.width + char
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.target[at], 0)

    def nodes(self, words: list[str]) -> list[np.ndarray]:
        """For each piece length, the node that each start reaches; words are of one length."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        char = self.code[text].reshape(len(words), -1)
        found, node = [], np.ones(char.shape, np.int32)
        for k in range(min(self.longest, char.shape[1])):
            node = self.step(node[:, : char.shape[1] - k], char[:, k:])
            node[char[:, k:] == 0] = 0
            found.append(node)
        return found

    def by_node(self, probability: np.ndarray) -> np.ndarray:
        table = np.zeros((self.n_nodes, probability.shape[1]))
        table[self.node_of] = probability
        return table

    def steps(self, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities by node: of pieces of one letter, none of which is impossible, and of all others."""
        table = self.by_node(probability)
        return np.where(self.single[:, None], np.maximum(table, UNSEEN), table), table

    def forward(self, nodes: list[np.ndarray], tables: tuple[np.ndarray, np.ndarray], back: bool = False, whole: bool = False) -> np.ndarray:
        """Log sums over all segmentations of the first 0, 1, .. letters (with back, of the last), or with whole of all letters alone."""
        m, n = nodes[0].shape
        recent = [np.ones((m, tables[0].shape[1]))]
        shift = np.zeros(recent[0].shape)
        found = [shift]
        for done in range(1, n + 1):
            total = np.zeros(shift.shape)
            for k in range(min(len(nodes), done)):
                at = nodes[k][:, n - done if back else done - k - 1]
                total += recent[-1 - k] * tables[k > 0][at]
            recent = [*recent[1 - len(nodes) :], total] if len(nodes) > 1 else [total]
            if not whole:
                found.append(np.log(total) + shift)
            if done % RESCALED == 0:
                recent = [r / total for r in recent]
                shift = np.log(total) + shift
        return np.log(recent[-1]) + shift if whole else np.stack(found)

    def expected(self, words: list[str], count: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected uses of each node in these words under one language's probabilities (one column)."""
        uses = np.zeros(self.n_nodes)
        tables = self.steps(probability)
        logs = [np.log(np.maximum(t[:, 0], 1e-300)) for t in tables]
        for same in by_length(words):
            nodes = self.nodes([words[i] for i in same])
            before, behind = (self.forward(nodes, tables, back)[:, :, 0].T for back in (False, True))
            n = before.shape[1] - 1
            for k, at in enumerate(nodes):
                p = np.exp(before[:, : n - k] + logs[k > 0][at] + behind[:, : n - k][:, ::-1] - before[:, n:])
                weight = p * count[same][:, None] * (tables[k > 0][:, 0][at] > 0)
                uses += np.bincount(at.ravel(), weight.ravel(), self.n_nodes)
        return uses

    def log_probability(self, words: list[str], probability: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), probability.shape[1]))
        tables = self.steps(probability)
        for same in by_length(words):
            out[same] = self.forward(self.nodes([words[i] for i in same]), tables, whole=True)
        return out


def by_length(words: list[str], most: int = 20_000) -> Iterator[np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        for at in range(0, len(same), most):
            yield same[at : at + most]


def gathered(batches: Iterator[pd.DataFrame], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Batches put together to about so many rows: words are small, unlike documents."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= rows:
            yield pd.concat(held)
            held, size = [], 0
    if held:
        yield pd.concat(held)


def _letters(text: str | None) -> list[str]:
    return ["▁" + w for w in WORD.findall(text.lower())] if text else []


def train(
    docs: DataFrame,
    pieces: list[str],
    text_col: str = "text",
    lang_col: str = "lang",
    keep: Column | None = None,
    order_by: str = "doc_id",
    docs_per_language: int = 2000,
    rounds: int = 3,
) -> LanguageModel:
    """Fit piece probabilities on about docs_per_language rows of each language, chosen by a hash of order_by.

    Priors are shares over all labelled rows. Rows with null text or language take no part; null keys are hashed like
    others, so that they are drawn together or not at all.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if keep is None else keep))
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    languages = sorted(counts)
    total = sum(counts.values())
    prior = np.log(np.array([counts[x] / total for x in languages])) if total else np.zeros(0)
    segmenter, k = Segmenter(pieces), len(languages)
    probability = np.full((len(pieces), k), 1 / max(1, len(pieces)))
    if not k:
        return LanguageModel([], prior, pieces, probability)
    place = F.lit(None)
    share = F.lit(1.0)
    for i, lang in enumerate(languages):
        place = F.when(F.col(lang_col) == lang, i).otherwise(place)
        share = F.when(F.col(lang_col) == lang, min(1.0, docs_per_language / counts[lang])).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.col(order_by), F.lit("langid")), F.lit(1 << 20)) < share * (1 << 20)
    # Rows that repeat an id and text are drawn together, so each text counts once: the sample stays bounded.
    sample = rows.where(drawn).select(place.cast("int").alias("lang"), F.col(text_col).alias("text")).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_letters(t) for t in b["text"]]
            lang = np.repeat(b["lang"].to_numpy(), [len(x) for x in found])
            part = pd.DataFrame({"lang": lang, "word": list(chain.from_iterable(found))})
            yield part.value_counts(sort=False).rename("n").reset_index()

    spread = max(8, spark.sparkContext.defaultParallelism)
    types = sample.mapInPandas(split, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    types = types.repartition(spread, "lang", "word").persist()
    try:
        for _ in range(rounds):
            held = spark.sparkContext.broadcast(probability)

            def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                own = Segmenter(pieces)
                uses = np.zeros((k, own.n_nodes))
                for b in gathered(batches):
                    for lang, part in b.groupby("lang"):
                        uses[lang] += own.expected(part["word"].tolist(), part["n"].to_numpy(float), held.value[:, [lang]])
                lang, node = np.nonzero(uses)
                yield pd.DataFrame({"lang": lang, "node": node, "uses": uses[lang, node]})

            table = np.zeros((k, segmenter.n_nodes))
            sums = types.mapInPandas(expect, "lang int, node int, uses double").groupBy("lang", "node").agg(F.sum("uses").alias("uses")).toArrow()
            table[sums["lang"].to_numpy(), sums["node"].to_numpy()] = sums["uses"].to_numpy()
            seen = table[:, segmenter.node_of].T + 0.01
            probability = seen / seen.sum(axis=0)
            held.unpersist()
    finally:
        types.unpersist()
    return LanguageModel(languages, prior, pieces, probability)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of lang_pred) added; columns of those names are replaced."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.languages, model.log_prior, model.pieces, model.probability))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    schema = schema_with(docs.select(*kept), "lang_pred string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*held.value)
        segmenter = Segmenter(model.pieces)
        cache = WordScores(segmenter, model.probability)
        for b in batches:
            lang, score = classify(b.column(text_col).to_pylist(), model, cache)
            yield beside(b.columns, [pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema)

    return docs.select(*kept).mapInArrow(run, schema)


class WordScores(dict):
    """Word -> row of its log probabilities. Words of over CACHED_LETTERS letters are forgotten after use, all beyond CACHED_WORDS."""

    def __init__(self, segmenter: Segmenter, probability: np.ndarray) -> None:
        self.segmenter, self.probability = segmenter, probability
        self.new: list[str] = []
        self.rows = np.zeros((0, probability.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = at = len(self)
        return at

    def of(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        long = False
        if self.new:
            self.rows = np.concatenate([self.rows, self.segmenter.log_probability(["▁" + w for w in self.new], self.probability).astype(np.float32)])
            long = max(map(len, self.new)) > CACHED_LETTERS
            self.new = []
        found = self.rows[at]
        if len(self) > CACHED_WORDS:
            self.clear()
            self.rows = self.rows[:0]
        elif long:
            kept = [w for w in self if len(w) <= CACHED_LETTERS]
            self.rows = self.rows[[self[w] for w in kept]]
            self.clear()
            self.update(zip(kept, range(len(kept)), strict=True))
        return found


def classify(texts: Iterable[str | None], model: LanguageModel, cache: WordScores, most: int = 500_000) -> tuple[list[str], list[float]]:
    """Language and score of each text; about ``most`` words are looked up at once."""
    langs: list[str] = []
    scores: list[float] = []
    held: list[str] = []
    ends: list[int] = []

    def flush() -> None:
        if not ends:
            return
        each = cache.of(held)
        starts = np.array([0, *ends[:-1]], np.int64)
        filled = starts < np.array(ends)
        total = np.zeros((len(ends), len(model.languages)))
        if filled.any():
            total[filled] = np.add.reduceat(each, starts[filled], axis=0, dtype=float)
        total += model.log_prior
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        share = odds[np.arange(len(ends)), best] / odds.sum(axis=1)
        langs.extend(model.languages[b] if f else UNKNOWN for b, f in zip(best, filled, strict=True))
        scores.extend(np.where(filled, share, 0.0).tolist())
        held.clear()
        ends.clear()

    for text in texts:
        if model.languages and text and any(map(str.isalpha, text)):
            held += WORD.findall(text.lower())
        ends.append(len(held))
        if len(held) >= most:
            flush()
    if not model.languages:
        return [UNKNOWN] * len(ends), [0.0] * len(ends)
    flush()
    return langs, scores
