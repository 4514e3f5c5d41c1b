"""Toxicity by the nearest labelled examples (operator 9).

Terms are words without punctuation around them. A bounded, documented sample of the labelled rows (up to PER_CLASS rows of each class,
smallest id hashes first) is the example set; the index holds all its terms. A term weighs (1 + log tf) * idf, with document frequencies
counted over all documents, times a factor of how far it goes with the label, LEAST_FACTOR at least. Examples with the same vector
are one entry with class counts. Entries lie in blocks, and the index holds each term's largest weight in each
block; a query reads the blocks of the largest sums of bounds, and then those others whose sum can still bring an entry into the
nearest K. The similarities are exact cosines; votes weighted by similarity and by the classes' share among all labelled rows,
with a prior, give a raw score, and a logistic curve fitted to the examples' own scores, each without its own vote, calibrates it.
The nearest examples are the evidence.

Defined results: a null or empty text, and a text that shares no term with an example, takes the vote of the
prior; ties in similarity go to the entry with the smaller first example; repeated rows score
alike; without labelled rows all scores are PRIOR; a null label isn't an example; texts are read whole, however long; an empty
table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.common import doc_slices, drop_written, id_text, lean, written

#: Bound of the example set; a parameter of `toxicity`.
PER_CLASS = 800
NEAREST = 12
BLOCK = 64
FIRST_BLOCKS = 4
#: Deviations at which a term's share in the classes is beyond chance, and the factor of terms that say nothing of the label.
LEAST_SHARE, LEAST_FACTOR = 4.0, 0.05
PRIOR = 0.1
PRIOR_WEIGHT = 0.5
CACHE_WORDS = 1 << 19
EDGES = ".,;:!?\"'()[]{}*#|<>&%$-"


def term_of(word: bytes) -> str:
    """The word in lower case without punctuation around it; may be empty."""
    return word.decode("utf-8", "ignore").strip(EDGES).lower()


class Columns(dict):
    """Column of each word as it comes, -1 for words that aren't terms of the index; emptied when it has grown large."""

    def __init__(self, column: dict[str, int]):
        super().__init__()
        self.column = column

    def __missing__(self, word: bytes) -> int:
        self[word] = at = self.column.get(term_of(word), -1)
        return at

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(columns in order, their counts) of a whole text."""
        if len(self) > CACHE_WORDS:
            self.clear()
        bag = Counter(text.split())
        cols = np.fromiter(map(self.__getitem__, bag), dtype=np.int64, count=len(bag))
        n = np.fromiter(bag.values(), dtype=np.int64, count=len(bag))
        cols, which = np.unique(cols, return_inverse=True)
        n = np.bincount(which, n, minlength=len(cols))
        return (cols[1:], n[1:]) if len(cols) and cols[0] < 0 else (cols, n)


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


class Index:
    """Block-max inverted index over the distinct example vectors; `weight_of` has each term's weight."""

    def __init__(self, rows: list[tuple[int, int, dict]], class_weight: dict[int, float], weight_of: dict[str, float], nearest: int = NEAREST):
        self.nearest, self.class_weight = nearest, class_weight
        self.curve = (1.0, 0.0)
        self.terms = sorted(weight_of)
        self.column = {t: j for j, t in enumerate(self.terms)}
        self.scale = np.array([weight_of[t] for t in self.terms])
        entries: dict[tuple, list] = {}
        for doc_id, y, bag in rows:
            vec = self.vector(bag)
            if vec:
                entry = entries.setdefault(vec, [doc_id, 0, 0])
                entry[0] = min(entry[0], doc_id)
                entry[1 + y] += 1
        # entries with one main term lie together, so that a block's bounds are close
        known = sorted(entries.items(), key=lambda e: (max((x, t) for t, x in e[0])[1], e[1][0]))
        self.place = {vec: n for n, (vec, _) in enumerate(known)}
        self.first = np.array([e[1][0] for e in known], dtype=np.int64)
        self.votes = np.array([[e[1][1] * class_weight.get(0, 1.0), e[1][2] * class_weight.get(1, 1.0)] for e in known]).reshape(-1, 2)
        flat = [(self.column[t], n, x) for n, (vec, _) in enumerate(known) for t, x in vec]
        term, entry, weight = (np.array(c, dtype=kind) for c, kind in zip(zip(*flat, strict=True) if flat else ((), (), ()), (np.int64, np.int64, np.float64), strict=True))
        by = np.lexsort((entry, term))
        term, self.entry, self.weight = term[by], entry[by], weight[by]
        self.n_blocks = -(-len(known) // BLOCK)
        # the postings of a term in a block are a cell; `cells` is where a term's cells begin
        cell, self.start = np.unique(term * max(self.n_blocks, 1) + self.entry // BLOCK, return_index=True)
        self.end = np.r_[self.start[1:], len(term)]
        self.block = cell % max(self.n_blocks, 1)
        self.bound = np.maximum.reduceat(self.weight, self.start) if len(cell) else np.zeros(0)
        self.cells = np.searchsorted(cell // max(self.n_blocks, 1), np.arange(len(self.column) + 1))

    def vector(self, bag: dict[str, int]) -> tuple[tuple[str, float], ...]:
        """Normalised weights of the index's terms."""
        cols, x = self.weights(*self.arrays(bag))
        return tuple((self.terms[c], v) for c, v in zip(cols.tolist(), x.tolist(), strict=True))

    def arrays(self, bag: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """(columns in order, values) of the index's terms."""
        pairs = sorted((self.column[t], n) for t, n in dict(bag).items() if t in self.column)
        return np.array([c for c, _ in pairs], dtype=np.int64), np.array([n for _, n in pairs], dtype=np.float64)

    def weights(self, cols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1.0 + np.log(n)) * self.scale[cols]
        return cols, np.round(x / max(math.sqrt(float(x @ x)), 1e-300), 9)

    def cosines(self, cells: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Sums over the postings of some cells: cosines of their blocks' entries, 0 for others."""
        start, sizes = self.start[cells], self.end[cells] - self.start[cells]
        at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.entry[at], self.weight[at] * np.repeat(q, sizes), minlength=len(self.first))

    def search(self, cols: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries with the K largest cosines, exact: the blocks of the largest bounds give a K-th cosine, and then all blocks
        are read whose bound reaches it."""
        sizes = self.cells[cols + 1] - self.cells[cols]
        cells = np.repeat(self.cells[cols] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        q = np.repeat(q, sizes)
        block = self.block[cells]
        bounds = np.bincount(block, q * self.bound[cells], minlength=self.n_blocks)
        live = np.zeros(self.n_blocks, dtype=bool)
        live[np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]] = True
        mine = live[block]
        cos = self.cosines(cells[mine], q[mine])
        least = float(np.partition(cos, -self.nearest)[-self.nearest]) if len(cos) >= self.nearest else 0.0
        rest = (bounds > 0) & (bounds >= least - 1e-9) & ~live
        if rest.any():
            mine = rest[block]
            cos += self.cosines(cells[mine], q[mine])
        at = np.flatnonzero((cos > 0) & (cos >= least - 1e-9))
        at = at[np.lexsort((self.first[at], -np.round(cos[at], 9)))[: self.nearest]]
        return at, cos[at]

    def raw(self, cols: np.ndarray, q: np.ndarray, entry: int = -1, without: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
        """(share of the votes for toxic, entries, cosines); an example of class `without` in `entry` doesn't vote."""
        where, cos = self.search(cols, q) if len(cols) and len(self.first) else (np.zeros(0, dtype=np.int64), np.zeros(0))
        votes = self.votes[where]
        votes[where == entry, without] -= self.class_weight.get(without, 1.0)
        no, yes = (cos[:, None] ** 4 * votes / votes.sum(1, keepdims=True).clip(1.0) ** 0.5).sum(0) if len(where) else (0.0, 0.0)
        return float((max(yes, 0.0) + PRIOR * PRIOR_WEIGHT) / (max(yes, 0.0) + max(no, 0.0) + PRIOR_WEIGHT)), where, cos

    def left_out(self, bag: dict[str, int], y: int) -> float:
        """The share of the votes for an example without its own."""
        return self.raw(*self.weights(*self.arrays(bag)), self.place.get(self.vector(bag), -1), y)[0]

    def score(self, cols: np.ndarray, n: np.ndarray) -> tuple[float, list[int], list[float]]:
        """(score, first examples, cosines) of a text's columns and counts."""
        share, where, cos = self.raw(*self.weights(cols, n))
        return calibrated(share, self.curve), self.first[where].tolist(), cos.tolist()


def logit(p: np.ndarray | float):
    return np.log(p) - np.log1p(-np.asarray(p))


def calibrated(share: float, curve: tuple[float, float]) -> float:
    a, b = curve
    return float(1 / (1 + np.exp(-np.clip(a * logit(min(max(share, 1e-9), 1 - 1e-9)) + b, -30, 30))))


def fitted_curve(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the labels over the shares' logits, by Newton steps with a weak pull to (1, 0)."""
    x, theta = np.stack([logit(np.clip(shares, 1e-9, 1 - 1e-9)), np.ones(len(shares))]), np.array([1.0, 0.0])
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        slope = x @ (weights * (p - labels)) + (theta - (1.0, 0.0))
        step = np.linalg.solve((x * (weights * p * (1 - p))) @ x.T + np.eye(2), slope)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.05), float(theta[1])


def term_bag(text: bytes) -> Counter:
    """Term counts of a whole text."""
    bag: Counter = Counter()
    for word, n in Counter(text.split()).items():
        bag[term_of(word)] += n
    del bag[""]
    return bag


def examples(docs: DataFrame, labels: DataFrame, per_class: int, folds: int) -> tuple[list[tuple[int, int, dict]], dict[int, float], dict[str, float]]:
    """The bounded example set, what one example of a class stands for among all labelled training rows, and the weight of
    the examples' terms."""
    labelled = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)").where(~held_out(folds=folds))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    totals = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = labelled.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.join(F.broadcast(picked), "doc_id")  # 2 * per_class rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, at = batch.column(2).to_pylist(), 0
            for ids, texts in doc_slices(iter([batch])):
                bags = [term_bag(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ys[at : at + len(ids)], pa.int32()), pa.array([list(b) for b in bags], pa.list_(pa.string())), pa.array([list(b.values()) for b in bags], pa.list_(pa.int32()))],
                    ["doc_id", "y", "terms", "n"],
                )
                at += len(ids)

    one_each = written(sample.select("doc_id", "text", "y").mapInArrow(lean(run), "doc_id long, y int, terms array<string>, n array<int>"), "examples")
    rows = one_each.collect()  # terms of 2 * per_class rows
    drop_written(one_each)
    # of rows that share an id the last one in order
    found = {r["doc_id"]: (r["doc_id"], r["y"], dict(zip(r["terms"], r["n"], strict=True))) for r in sorted(rows, key=lambda r: (r["doc_id"], sorted(r["terms"])))}
    sizes = Counter(y for _, y, _ in found.values())
    in_class = [Counter(t for _, y, bag in found.values() if y == k for t in bag) for k in (0, 1)]
    df, n_docs = frequencies(docs, sorted(in_class[0] | in_class[1]))
    weight_of = {t: (math.log((n_docs + 1) / (n + 1)) + 1.0) * factor(in_class[1][t], in_class[0][t], sizes[1], sizes[0]) for t, n in df.items()}
    return [found[i] for i in sorted(found)], {y: totals.get(y, 0) / sizes[y] for y in sizes}, weight_of


def factor(a: int, b: int, n1: int, n0: int) -> float:
    """How far a term of `a` of n1 toxic and `b` of n0 clean examples goes with the label: from LEAST_FACTOR to 1."""
    if a + b < 3:
        return LEAST_FACTOR
    odds = abs(math.log((a + 0.1) / (n1 + 0.2)) - math.log((b + 0.1) / (n0 + 0.2)))
    deviations = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    if not b and a >= 5:
        deviations = LEAST_SHARE
    return max(LEAST_FACTOR, min(1.0, (deviations / LEAST_SHARE) ** 4))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """(in how many of all documents each term of the examples is, documents)."""
    shared = docs.sparkSession.sparkContext.broadcast({t: j for j, t in enumerate(vocabulary)})  # terms of the bounded example set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, n, total = Columns(shared.value), np.zeros(len(shared.value), dtype=np.int64), 0
        for _, texts in doc_slices(batches):
            total += len(texts)
            for text in texts:
                n[columns.of(text)[0]] += 1
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen].astype(np.int32)), pa.array(np.r_[total, n[seen]])], ["term", "n"])

    counts = {r["term"]: r["n"] for r in docs.select("doc_id", "text").mapInArrow(lean(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    shared.unpersist()
    return {t: counts.get(j, 0) for j, t in enumerate(vocabulary)}, counts.get(-1, 0)


def calibrate(spark, index: Index, rows: list[tuple[int, int, dict]]) -> tuple[float, float]:
    """The curve of the examples' scores, each without its own vote; searched in tasks."""
    if not rows:
        return 1.0, 0.0
    shared = spark.sparkContext.broadcast((index, rows))
    parts = min(len(rows), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = shared.value
        for batch in batches:
            at = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.left_out(rows[i][2], rows[i][1]) for i in at], pa.float64())], ["id", "share"])

    shares = {r["id"]: r["share"] for r in spark.range(0, len(rows), 1, parts).mapInArrow(lean(run), "id long, share double").collect()}
    shared.unpersist()
    labels = np.array([y for _, y, _ in rows], dtype=np.float64)
    weights = np.array([index.class_weight.get(y, 1.0) for _, y, _ in rows])
    return fitted_curve(np.array([shares[i] for i in range(len(rows))]), labels, weights / weights.mean())


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, nearest: int = NEAREST, folds: int = 5, **cols: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, similarity) of every row of `docs`."""
    texts = id_text(docs, **cols)
    rows, weight, weight_of = examples(texts, labels, per_class, folds)
    smallest = min(weight.values(), default=1.0)
    index = Index(rows, {y: w / smallest for y, w in weight.items()}, weight_of, nearest)
    index.curve = calibrate(texts.sparkSession, index, rows)
    index.place = {}  # only the calibration needs it
    shared = texts.sparkSession.sparkContext.broadcast(index)  # bounded by per_class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        columns = Columns(index.column)
        for ids, part in doc_slices(batches):
            got = [index.score(*columns.of(text)) for text in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s for s, _, _ in got], pa.float64()), pa.array([e for _, e, _ in got], pa.list_(pa.int64())), pa.array([c for _, _, c in got], pa.list_(pa.float64()))],
                ["doc_id", "score", "evidence", "similarity"],
            )

    scored = texts.mapInArrow(lean(run), "doc_id long, score double, evidence array<long>, similarity array<double>")
    return scored.select(
        "doc_id", F.coalesce(held_out(folds=folds), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "evidence", "similarity",
    )
