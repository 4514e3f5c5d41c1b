"""Benchmark decontamination by BM25 with block-max WAND (operator 3).

Test items are indexed; every passage of every training text is a query. A passage is a window of words at every quarter of its
width; the width goes with an item's own length (the least power of two that holds it twice, 64 at least), so items fall into
width classes. Weights are BM25 impacts; inverse document frequencies and the mean length are those of the whole benchmark,
counted before the index is cut into blocks, so that results don't depend on the blocks.

An item is reported for a passage that holds at least `least_overlap` of the 5-word shingles of both its question and its answer
(of a shorter part, the whole part). Its retrieval threshold is the least score such a passage can have: the item's full score
less the most that the words of so many missing shingles can weigh. So retrieval loses no item, and impacts are
divided by their item's threshold, which makes one threshold, 1, of all.

1. Essential lists: of each item the words that are commonest in the texts are set aside while they weigh less than COMMON of the
   threshold; only passages whose other words reach the rest go on. Frequencies decide how many passages that are, not which items are found.
2. Block-max WAND: cursors on the passage's posting lists; the pivot is the first item where the lists' maxima add up to the
   threshold; it is scored if the maxima of its blocks reach it as well, else the cursors skip to the end of a block.
3. The shingles of question and answer are looked up in the passage.

The index goes to the executors in blocks of items of at most `block_bytes` of text each; a text is split into words once and
matched against each block in turn. Defined results: null or empty texts and items match nothing; items without words are skipped; repeated
rows are reported one by one; repeated items each match, and equal scores are all reported; very long texts are read whole, in one task, with
memory in proportion to the text; an empty table of either kind gives an empty result; other columns are not read, or pass through
`clean` with any names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.common import doc_slices, drop_written, id_text, keep_rows, lean, written

PASSAGE = 64
LEAST_OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
COMMON = 0.4
CELLS = 4
CHUNK_WORDS = 1 << 18
ITEM_BLOCK = 32
INDEX_BYTES = 4 << 20
ANSWER_SHARE = 0.3
SLACK = 1e-9
MARK = re.compile(r"\n(?:answer|a)\s*:|\?", re.IGNORECASE)
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower())


def item_parts(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: up to the last question mark or answer label, and after it; an item
    without either has its last ANSWER_SHARE words as the answer."""
    marks = list(MARK.finditer(text))
    if marks:
        question, answer = words_of(text[: marks[-1].end()]), words_of(text[marks[-1].end() :])
        if question and answer:
            return question, answer
    words = words_of(text)
    cut = max(1, round(len(words) * (1 - ANSWER_SHARE)))
    return words[:cut], words[cut:]


def shingles(words: list, n: int) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def overlap(part: list, around: list, cache: dict[int, set[tuple]]) -> float:
    """Share of the part's shingles that stand in the words; 1 for an empty part."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    if n not in cache:
        cache[n] = shingles(around, n)
    own = shingles(part, n)
    return len(own & cache[n]) / len(own)


def passage_width(n_words: int) -> int:
    """Width of the passages in which an item of so many words is looked for."""
    return max(PASSAGE, 1 << (2 * n_words - 1).bit_length())


def most_missing(part: list[str], impact: dict[str, float], least_overlap: float) -> float:
    """The most that the words of a part can weigh which a text with that overlap may lack. Of S shingles floor((1 - overlap) * S)
    may be missing; a missing word takes all its shingles with it, a shingle is taken by n words at most: a fractional knapsack."""
    if not part:
        return 0.0
    n = min(SHINGLE, len(part))
    own = shingles(part, n)
    free = int(np.floor((1 - least_overlap) * len(own) + 1e-9))
    in_shingles = Counter(w for s in own for w in set(s))
    room, weight = n * free, 0.0
    for w, k in sorted(((w, k) for w, k in in_shingles.items() if k <= free), key=lambda x: -impact[x[0]] / x[1]):
        weight += impact[w] * min(1.0, room / k)
        room -= k
        if room <= 0:
            break
    return weight


def least_score(parts: tuple[list[str], list[str]], impact: dict[str, float], least_overlap: float) -> float:
    """The least score of a passage that holds `least_overlap` of both parts: impacts add up to 1 for the whole item."""
    bound = 1.0 - sum(most_missing(p, impact, least_overlap) for p in parts)
    for part in parts:
        if part:
            bound = max(bound, min(sum(impact[w] for w in set(s)) for s in shingles(part, min(SHINGLE, len(part)))))
    return bound


class Stats:
    """Counts of the whole benchmark: items, their mean length, and in how many items a term is."""

    def __init__(self, n: int, mean: float, df: dict[str, int]):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Stats:
        bags = [b for b in (Counter(words_of(t)) for _, t in items) if b]
        return cls(len(bags), sum(sum(b.values()) for b in bags) / max(len(bags), 1), Counter(t for b in bags for t in b))

    def impacts(self, bag: Counter) -> dict[str, float]:
        """BM25 impacts of an item's words, as shares of its full score."""
        length = sum(bag.values())
        raw = {
            t: np.log(1 + (self.n - self.df[t] + 0.5) / (self.df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))
            for t, tf in bag.items()
        }
        whole = sum(raw.values())
        return {t: float(x / whole) for t, x in raw.items()}


class Lists:
    """Posting lists of the items of one width class, with block maxima; impacts are divided by the item's threshold."""

    def __init__(self, width: int, items: list[int], rows: list[tuple[int, int, float]], n_terms: int):
        self.width, self.step, self.ids = width, width // CELLS, items
        term, item, impact = (np.array(c, dtype=k) for c, k in zip(zip(*sorted(rows), strict=True), (np.int64, np.int64, np.float64), strict=True))
        self.term_of, self.items, self.impact = term, item, impact
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        self.tune(np.zeros(n_terms))
        self.lists: dict[int, tuple[list, list, list, list, float]] = {}

    def tune(self, frequency: np.ndarray) -> None:
        """Sets aside each item's words that are commonest among the texts, up to COMMON of the threshold."""
        by = np.lexsort((self.term_of, -frequency[self.term_of], self.items))
        item, x = self.items[by], self.impact[by]
        run = np.cumsum(x)
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        before = np.repeat(np.r_[0.0, run][first], np.diff(np.r_[first, len(item)]))
        held = np.zeros(len(item), dtype=bool)
        held[by] = run - before >= COMMON
        self.e_items, self.e_impact = self.items[held], self.impact[held]
        self.e_start = np.searchsorted(self.term_of[held], np.arange(len(self.start)))

    def passages(self, nums: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """First cells of the passages in which some item's essential impacts reach what its common words can't make up.
        `cell` numbers runs of `step` words; texts lie CELLS numbers apart."""
        at = np.flatnonzero(nums >= 0)
        at = at[self.e_start[nums[at] + 1] > self.e_start[nums[at]]]
        terms = nums[at]
        sizes = self.e_start[terms + 1] - self.e_start[terms]
        ends = np.cumsum(sizes)
        post = np.repeat(self.e_start[terms] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        n = len(self.ids)
        # a word counts once in a passage; counting it again in another cell only lets more passages through
        key, first = np.unique((np.repeat(cell[at], sizes) * n + self.e_items[post]) * len(self.start) + np.repeat(terms, sizes), return_index=True)
        key //= len(self.start)
        weight = self.e_impact[post][first]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        key, weight = key[cut], np.add.reduceat(weight, cut) if len(cut) else weight
        spread = (key[None, :] - np.arange(CELLS)[:, None] * n).ravel()
        spread, back = np.unique(spread, return_inverse=True)
        total = np.bincount(back, np.tile(weight, CELLS), minlength=len(spread))
        return np.unique(spread[total >= 1 - COMMON - 1e-6] // n)

    def list_of(self, term: int) -> tuple[list, list, list, list, float]:
        """(items, impacts, last items of the blocks, block maxima, maximum) of a term."""
        found = self.lists.get(term)
        if found is None:
            a, b = self.start[term], self.start[term + 1]
            items, impact = self.items[a:b], self.impact[a:b]
            block = items // ITEM_BLOCK
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            top = np.maximum.reduceat(impact, cut)
            found = items.tolist(), impact.tolist(), ((block[cut] + 1) * ITEM_BLOCK - 1).tolist(), top.tolist(), float(impact.max())
            self.lists[term] = found
        return found

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all items (number, score) whose score for the passage's distinct terms reaches the threshold."""
        cursors = [[items[0], 0, 0, items, impact, last, top, most] for items, impact, last, top, most in map(self.list_of, terms)]
        hits, least = [], 1.0 - SLACK
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, p = 0.0, -1
            for p, c in enumerate(cursors):
                bound += c[7]
                if bound >= least:
                    break
            else:
                break  # not even all lists together
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            bound, until = 0.0, None
            for c in cursors[: p + 1]:
                if c[5][c[2]] < pivot:
                    c[2] = bisect_left(c[5], pivot, c[2])
                if c[2] < len(c[5]) and c[5][c[2]] - pivot < ITEM_BLOCK:  # the list has postings in the pivot's block
                    bound += c[6][c[2]]
            if bound >= least:
                score = 0.0
                for c in cursors[: p + 1]:
                    if c[0] < pivot:
                        c[1] = bisect_left(c[3], pivot, c[1])
                    if c[1] < len(c[3]) and c[3][c[1]] == pivot:
                        score += c[4][c[1]]
                        c[1] += 1
                    c[0] = c[3][c[1]] if c[1] < len(c[3]) else -1
                if score >= least:
                    hits.append((pivot, score))
            else:
                # no item up to the end of the pivot's block, or to the next list's item, can reach it
                until = (pivot // ITEM_BLOCK + 1) * ITEM_BLOCK
                if p + 1 < len(cursors):
                    until = min(until, cursors[p + 1][0])
                for c in cursors[: p + 1]:
                    c[1] = bisect_left(c[3], until, c[1])
                    c[0] = c[3][c[1]] if c[1] < len(c[3]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return hits


class ItemIndex:
    """The items of a block: numbered terms, their parts in these numbers, and posting lists by width class."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats, least_overlap: float = LEAST_OVERLAP):
        items = [(i, t) for i, t in items if words_of(t)]
        self.ids, self.least_overlap = [i for i, _ in items], least_overlap
        bags = [Counter(words_of(t)) for _, t in items]
        self.terms = {t: n for n, t in enumerate(sorted({t for b in bags for t in b}))}
        self.parts, self.least = [], []
        classes: dict[int, list[int]] = {}
        impacts = []
        for j, ((_, text), bag) in enumerate(zip(items, bags, strict=True)):
            parts, impact = item_parts(text), stats.impacts(bag)
            self.parts.append(tuple([self.terms[w] for w in p] for p in parts))
            self.least.append(least_score(parts, impact, least_overlap))
            impacts.append(impact)
            classes.setdefault(passage_width(sum(bag.values())), []).append(j)
        self.classes = []
        for width, of in sorted(classes.items()):
            rows = [(self.terms[t], n, x / self.least[j]) for n, j in enumerate(of) for t, x in impacts[j].items()]
            self.classes.append(Lists(width, of, rows, len(self.terms)))

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.terms.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def search(self, texts: list[list[str]]) -> list[list[tuple]]:
        """For each text (item_id, score, passages, first word, question overlap, answer overlap) of its verified items."""
        out: list[dict[int, list]] = [{} for _ in texts]
        nums = [self.numbers(w) for w in texts]
        for lists in self.classes:
            frequency = None
            for group in chunks(texts, lists):
                base, cells, all_nums, first = CELLS, [], [], []
                for k, a, b in group:
                    first.append(base)
                    all_nums.append(nums[k][a:b])
                    cells.append(base + np.arange(b - a) // lists.step)
                    base += -(-(b - a) // lists.step) + CELLS
                one = np.concatenate(all_nums)
                if frequency is None:
                    frequency = np.bincount(one[one >= 0], minlength=len(self.terms)).astype(np.float64)
                    lists.tune(frequency)
                for c in lists.passages(one, np.concatenate(cells)).tolist():
                    which = int(np.searchsorted(first, c + CELLS - 1, side="right")) - 1
                    k, a, b = group[which]
                    at = a + max(c - first[which], 0) * lists.step
                    until = min(a + (c - first[which] + CELLS) * lists.step, b)
                    self.verify(lists, nums[k][at:until], at, out[k])
        return [[(self.ids[j], x[0], len(x[1]), *x[2:]) for j, x in sorted(found.items())] for found in out]

    def verify(self, lists: Lists, passage: np.ndarray, at: int, found: dict[int, list]) -> None:
        terms = np.unique(passage)
        cache: dict[int, set[tuple]] = {}
        words = None
        for n, score in lists.retrieve([t for t in terms[terms >= 0].tolist() if lists.start[t] < lists.start[t + 1]]):
            j = lists.ids[n]
            words = passage.tolist() if words is None else words
            q, w = (overlap(p, words, cache) for p in self.parts[j])
            if q >= self.least_overlap - SLACK and w >= self.least_overlap - SLACK:
                have = found.setdefault(j, [0.0, set(), at, 0.0, 0.0])
                have[0] = max(have[0], score * self.least[j])
                have[1].add(at)
                have[2] = min(have[2], at)
                have[3], have[4] = max(have[3], q), max(have[4], w)


def chunks(texts: list[list[str]], lists: Lists) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of about CHUNK_WORDS words; a longer text is cut, its parts overlap by a passage."""
    group, size = [], 0
    width = max(CHUNK_WORDS // lists.step, CELLS) * lists.step
    for k, words in enumerate(texts):
        for a in range(0, max(len(words) - lists.width, 1), width):
            b = min(a + width + lists.width, len(words))
            group.append((k, a, b))
            size += b - a
            if size >= CHUNK_WORDS:
                yield group
                group, size = [], 0
    if group:
        yield group


SCHEMA = "doc_id long, item_id long, score double, n_passages long, first_word long, question_overlap double, answer_overlap double"
ARROW = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in SCHEMA.split(", ")])


def item_table(items: DataFrame) -> tuple[DataFrame, int, float]:
    """((doc_id, text, terms, df) of each item with words, their number, their mean length): `df` says in how many items of the
    whole benchmark each of the item's terms is."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in doc_slices(batches):
            words = [words_of(t.decode()) for t in texts]
            rows = [(i, t, len(w), sorted(set(w))) for i, t, w in zip(ids, texts, words, strict=True) if w]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()))
            texts_of = [t.decode() for t in cols[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((cols[0], texts_of, cols[2], cols[3]), kinds, strict=True)], ["doc_id", "text", "size", "terms"])

    held = written(items.mapInArrow(lean(split), "doc_id long, text string, size long, terms array<string>").withColumn("item", F.monotonically_increasing_id()), "items")
    n, mean = held.agg(F.count("*"), F.avg("size")).first()
    each = held.select("item", F.explode("terms").alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    facts = each.join(df, "term").groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("facts"))  # an item's own terms
    whole = written(held.join(facts, "item").select("doc_id", "text", F.col("facts.term").alias("terms"), F.col("facts.df").alias("df")), "item-terms")
    drop_written(held)
    return whole, n, mean or 1.0


def item_blocks(items: DataFrame, block_bytes: int, least_overlap: float) -> list:
    """Broadcast indexes over the items in blocks of bounded size; the driver holds one block at a time."""
    whole, n, mean = item_table(items)
    sc, out = items.sparkSession.sparkContext, []

    def index(block: list) -> None:
        df = {t: k for r in block for t, k in zip(r["terms"], r["df"], strict=True)}
        out.append(sc.broadcast(ItemIndex([(r["doc_id"], r["text"]) for r in block], Stats(n, mean, df), least_overlap)))  # at most block_bytes of item texts

    block, size = [], 0
    for r in whole.orderBy("doc_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > block_bytes:
            index(block)
            block, size = [], 0
        block.append(r)
        size += len(r["text"])
    if block:
        index(block)
    drop_written(whole)
    return out


def found_in(blocks: list, texts: list[bytes]) -> list[list[tuple]]:
    """Verified items of each text, of all blocks; of several blocks one is held at a time."""
    words = [words_of(t.decode()) for t in texts]
    out: list[list[tuple]] = [[] for _ in texts]
    for shared in blocks:
        for mine, hits in zip(out, shared.value.search(words), strict=True):
            mine += hits
        if len(blocks) > 1:
            shared._value = None
            del shared._value
    return out


def leaks(
    docs: DataFrame, items: DataFrame, least_overlap: float = LEAST_OVERLAP, item_id: str = "item_id", item_text: str = "text", block_bytes: int = INDEX_BYTES, **cols: str
) -> DataFrame:
    """One row for each row of `docs` and benchmark item verified in it."""
    blocks = item_blocks(id_text(items, id_col=item_id, text_col=item_text), block_bytes, least_overlap)
    slice_bytes = SLICE_BYTES if len(blocks) < 2 else LONG_SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in doc_slices(batches, slice_bytes):
            rows = [(doc_id, *hit) for doc_id, hits in zip(ids, found_in(blocks, part), strict=True) for hit in hits]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(ARROW), ARROW.types, strict=True)], schema=ARROW)

    return id_text(docs, **cols).mapInArrow(lean(run), SCHEMA)


def clean(
    docs: DataFrame, items: DataFrame, least_overlap: float = LEAST_OVERLAP, item_id: str = "item_id", item_text: str = "text", block_bytes: int = INDEX_BYTES, text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` in which no item is verified, with all their columns."""
    blocks = item_blocks(id_text(items, id_col=item_id, text_col=item_text), block_bytes, least_overlap)
    return keep_rows(docs, lambda: lambda texts: [not found for found in found_in(blocks, texts)], text_col)


#: Texts matched at a time: against one index, and against several, which are loaded anew for each slice.
SLICE_BYTES, LONG_SLICE_BYTES = 4 << 20, 16 << 20
