"""Quality classifier from weak labels (operator 5).

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over
the counts of vote patterns (at most 3 ** labellers rows, counted over all documents) estimates each
labeller's vote rates under either hidden class; the posterior of a pattern is its documents' label. The
posteriors of a bounded sample (TRAIN_DOCS documents of smallest id hash) train a logistic linear scorer
over hashed features of the text alone (its words, their shapes, and classes of its length, variety and stutter); the votes are no
features, so the scorer can't look the posterior up. It then scores every document; the votes are cast again there, as the pattern and the
posterior go into the result and a join by id would move all rows.

Defined results: a null or empty text has no features and scores by the bias; ties and repeated rows score alike; a null id
is scored like any other; very long texts are read whole; with no documents at all the result is empty; columns other than the id
and the text are not read and may have any names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.common import doc_slices, id_text, lean, written
from twofold.llm.quality import SYMBOLS, duplicate_lines, repeat_words

#: Bound of the training sample, a parameter of `weak_quality`.
TRAIN_DOCS = 6000
SLOTS = 1 << 18
EPOCHS, RATE, L2 = 12, 0.5, 1e-4
GOOD, BAD, NONE = 1, 0, 2
CACHE_WORDS = 1 << 19

# Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    b"the of and to in a is that it for on with as by this are "
    b"der die das und ist in zu den von mit des auf ein eine nicht "
    b"le la les de des et est un une que dans pour par sur qui "
    b"el los las del y que en un una es por con para se no".split()
)
LABELLERS = ("length", "repeats", "symbols", "word_size", "function_words", "line_ends", "lines", "variety")


def votes(text: bytes, words: list[bytes], nums: np.ndarray) -> list[int]:
    """One vote for each of LABELLERS."""
    n = len(words)
    if not n:
        return [BAD] + [NONE] * (len(LABELLERS) - 1)
    say = lambda bad, good: BAD if bad else GOOD if good else NONE
    repeated = repeat_words(nums) / n
    symbols = (len(text) - len(text.translate(None, SYMBOLS))) / n
    size = (len(text) - text.count(b" ") - text.count(b"\n")) / n
    common = sum(map(FUNCTION_WORDS.__contains__, words[:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
    same = int((nums[1:] == nums[:-1]).sum()) / n
    variety = len(np.unique(nums)) / n
    return [
        say(n < 3, n >= 10),
        say(repeated > 0.2 or same > 0.1, repeated < 0.05 and same < 0.02),
        say(symbols > 0.08, symbols < 0.02),
        say(size < 2.5 or size > 14, 3.5 <= size <= 10),
        say(common == 0 and n > 15, common / n > 0.03),
        say(ended < 0.2, ended > 0.6),
        say(duplicate_lines(text) > 0.3 * len(lines), len(lines) > 1 and len(set(lines)) == len(lines)),
        say(variety < 0.25 and n < 2000, variety > 0.5),
    ]


def vote_table(docs: DataFrame, **cols: str) -> DataFrame:
    """(doc_id, pattern): the votes as digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in doc_slices(batches):
            index: dict[bytes, int] = defaultdict(count().__next__)
            out = []
            for text in texts:
                words = text.split()
                nums = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
                out.append("".join(map(str, votes(text, words, nums))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], ["doc_id", "pattern"])

    return id_text(docs, **cols).mapInArrow(lean(run), "doc_id long, pattern string")


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM: (posterior of good per pattern, rates[class, labeller, vote], prior of good)."""
    if not patterns:
        return np.zeros(0), np.zeros((2, 0, 3)), 0.5
    v = np.array([[int(c) for c in p] for p in patterns])
    m = v.shape[1]
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    post = (good + 1.0) / (good + bad * 3.0 + 2.0)  # a bad vote is rarer and says more
    rates, prior = np.full((2, m, 3), 1e-12), 0.5
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])
        prior = float((w[1].sum() + 1) / (counts.sum() + 2))
        for j in range(m):
            for k in (BAD, GOOD):  # an empty vote says nothing about the class
                rates[:, j, k] = w[:, v[:, j] == k].sum(1) + 0.5
        rates /= rates.sum(2, keepdims=True)
        ll = np.where(v == NONE, 0.0, np.log(rates)[:, np.arange(m), v]).sum(2) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -60, 60)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, rates, prior


SHAPE = [(re.compile(rb"[A-Z]"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0")]


def shape(word: bytes) -> bytes:
    for what, to in SHAPE:
        word = what.sub(to, word)
    return word[:12]


class Features:
    """Hashed slots of words: the lower-cased word, and its shape; known words of a task are kept."""

    def __init__(self):
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.slots = np.zeros((0, 2), dtype=np.int32)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """(words, 2) slots for each text."""
        if len(self.index) > CACHE_WORDS:
            self.__init__()
        at = len(self.index)
        ids = [np.fromiter(map(self.index.__getitem__, w), dtype=np.int64, count=len(w)) for w in map(bytes.split, texts)]
        new = [(slot(w.lower(), 1), slot(shape(w), 2)) for w in list(self.index)[at:]]
        if new:
            self.slots = np.concatenate([self.slots, np.array(new, dtype=np.int32)])
        return [self.slots[i] for i in ids]


def slot(name: bytes, seed: int) -> int:
    return xxhash.xxh32_intdigest(name, seed) & (SLOTS - 1)


def form(slots: np.ndarray) -> list[int]:
    """Slots of a text's form: its doublings of length, tenths of variety, and fiftieths of words that repeat the one before."""
    words, n = slots[:, 0], len(slots)
    if not n:
        return []
    variety = 10 * len(np.unique(words)) // n
    stutter = min(50 * int((words[1:] == words[:-1]).sum()) // n, 9)
    return [slot(f"{name}{value}".encode(), 3) for name, value in (("n", (n + 1).bit_length()), ("v", variety), ("s", stutter))]


def row(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: the shares of its words and shapes, and its form."""
    dims, n = np.unique(slots.ravel(), return_counts=True)
    more = form(slots)
    return np.r_[dims, np.array(more, dtype=dims.dtype)], np.r_[n / max(len(slots), 1), np.ones(len(more))]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by AdaGrad, in a fixed order."""
    w, g2, bias, bias2 = np.zeros(SLOTS), np.full(SLOTS, 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        for (dims, x), y in zip(rows, labels, strict=True):
            p = 1 / (1 + np.exp(-np.clip(w[dims] @ x + bias, -30, 30)))
            step = (p - y) * x + L2 * w[dims]
            g2[dims] += step**2
            w[dims] -= RATE * step / np.sqrt(g2[dims])
            bias2 += (p - y) ** 2
            bias -= RATE * (p - y) / np.sqrt(bias2)
    return w.astype(np.float32), float(bias)


def weak_quality(docs: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = 0.8, **cols: str) -> DataFrame:
    """(doc_id, pattern, posterior, score, kept) of every row."""
    spark = docs.sparkSession
    texts = id_text(docs, **cols)
    voted = written(vote_table(texts), "votes")
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3 ** labellers at most
    post, _, _ = estimate([r["pattern"] for r in seen], np.array([r["n"] for r in seen], dtype=np.float64))
    posterior = {r["pattern"]: float(p) for r, p in zip(seen, post, strict=True)}
    order = F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")))
    chosen = texts.select("doc_id").distinct().orderBy(order, "doc_id").limit(train_docs)  # bounded: train_docs ids

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for ids, part in doc_slices(batches):
            words = of(part)
            index: dict[bytes, int] = defaultdict(count().__next__)
            pats = []
            for text in part:
                ws = text.split()
                pats.append("".join(map(str, votes(text, ws, np.fromiter(map(index.__getitem__, ws), dtype=np.int64, count=len(ws))))))
            rows = [row(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pats), pa.array([d.astype("<i4").tobytes() for d, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary())],
                ["doc_id", "pattern", "dims", "x"],
            )

    picked = texts.join(F.broadcast(chosen), texts["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")
    sampled = (
        picked.mapInArrow(lean(sample), "doc_id long, pattern string, dims binary, x binary")
        .orderBy(order, "doc_id", "pattern", "dims").limit(train_docs).collect()
    )
    rows = [(np.frombuffer(r["dims"], "<i4"), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in sampled]
    weights, bias = train(rows, np.array([posterior[r["pattern"]] for r in sampled]))
    model = spark.sparkContext.broadcast((weights, bias, posterior))  # SLOTS floats and 3 ** labellers posteriors

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, known = model.value
        of = Features()
        for ids, part in doc_slices(batches):
            pats, out = [], []
            index: dict[bytes, int] = defaultdict(count().__next__)
            for text, slots in zip(part, of(part), strict=True):
                ws = text.split()
                pats.append("".join(map(str, votes(text, ws, np.fromiter(map(index.__getitem__, ws), dtype=np.int64, count=len(ws))))))
                z = float(w[slots].sum(dtype=np.float64)) / max(len(slots), 1) + float(w[form(slots)].sum(dtype=np.float64)) + b
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            out = np.array(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pats), pa.array([known[p] for p in pats]), pa.array(out), pa.array(out >= threshold)],
                ["doc_id", "pattern", "posterior", "score", "kept"],
            )

    return texts.mapInArrow(lean(score), "doc_id long, pattern string, posterior double, score double, kept boolean")
