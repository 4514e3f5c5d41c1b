"""Byte-pair token counts by rank-synchronous merging of ragged arrays (operator 6).

For a piece model with byte fallback (BPE, identity normaliser, dummy prefix, spaces kept). No piece of such a
model holds a space after another character, so a text falls into pre-tokens (spaces, then
non-spaces) that merge independently. The distinct new pre-tokens of a slice become one ragged array
of symbols, cut into sequences wherever no piece holds both neighbours; each round finds every sequence's
pair of lowest rank and merges all its places at once (left to right where they overlap); sequences without a
pair leave. All places at once is what one merge after the other gives, as long as no pair with the merged
symbol has a lower rank than the merge; for the few symbols where one has, a round merges the leftmost place only.
Counts of pre-tokens are kept in a bounded cache.

Defined results: a null or empty text has no tokens; special strings in a text are ordinary text; unbroken text of
any length is one pre-token, with rounds that grow with the pieces in it and not with its length; repeated rows
are counted one by one; an empty table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twofold.llm.common import doc_slices, id_text, lean

SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE_ENTRIES = 1 << 19
#: Longer pre-tokens aren't cached.
CACHE_LENGTH = 256
NO_RANK = np.int64(1) << 40


class PieceModel:
    """Merge tables of a sentencepiece BPE model: char -> symbol, (symbol, symbol) -> rank and symbol."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        chars = np.zeros(0x110000, dtype=np.int32)
        points = np.arange(0x110000)
        cost = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        chars[:] = -1
        for piece, i in self.ids.items():
            if len(piece) == 1:
                chars[ord(piece)] = i
        self.chars, self.cost = chars, np.where(chars < 0, cost, 1).astype(np.int64)
        order = sorted(self.ids, key=lambda p: (-sp.get_score(self.ids[p]), self.ids[p]))
        rank = {p: r for r, p in enumerate(order)}
        keys, ranks, made = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    ranks.append(rank[piece])
                    made.append(i)
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[by]
        self.ranks = np.array(ranks, dtype=np.int64)[by]
        self.made = np.array(made, dtype=np.int32)[by]
        # neighbours that some piece holds
        self.inside = np.unique([self.ids[a] * size + self.ids[b] for p in self.ids for a, b in zip(p, p[1:], strict=False) if a in self.ids and b in self.ids])
        # symbols that a lower rank than their own can merge on
        least = np.full(size, NO_RANK)
        np.minimum.at(least, self.keys // size, self.ranks)
        np.minimum.at(least, self.keys % size, self.ranks)
        own = np.full(size, NO_RANK)
        own[self.made] = self.ranks
        self.one_by_one = least < own

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether no piece holds the two characters next to each other."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        return (self.inside[at] != key) | (left < 0) | (right < 0)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of adjacent symbols; NO_RANK where they don't merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def segment(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ragged result (symbols, lengths, cost): surviving symbols of each pre-token; unknown characters are -1
        and cost one token for each of their UTF-8 bytes."""
        points = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        symbols, cost = self.chars[points], self.cost[points]
        of = np.repeat(np.arange(len(pretokens)), lengths)
        done_sym, done_cost, done_owner = [], [], []
        if len(symbols):
            cut = np.r_[True, (of[1:] != of[:-1]) | self.apart(symbols[:-1], symbols[1:])]
            owner = np.cumsum(cut) - 1
            of = of[cut]
            rank, made = self._ranks(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            live = best < NO_RANK
            if not live.all():
                keep = np.repeat(live, sizes)
                out = ~keep
                done_sym.append(symbols[out]), done_cost.append(cost[out]), done_owner.append(owner[out])
                symbols, cost, owner, rank, made = symbols[keep], cost[keep], owner[keep], rank[keep], made[keep]
                if not len(symbols):
                    break
                best, sizes = best[live], sizes[live]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            at_best = np.flatnonzero(rank == np.repeat(best, sizes))
            # of places that overlap every other one, from the left
            head = np.r_[True, (at_best[1:] != at_best[:-1] + 1) | (owner[at_best[1:]] != owner[at_best[:-1]])]
            run = np.flatnonzero(head)[np.cumsum(head) - 1]
            leftmost = np.zeros(len(at_best), dtype=bool)
            leftmost[np.searchsorted(at_best, starts)] = True
            first = at_best[np.where(self.one_by_one[made[at_best]], leftmost, (np.arange(len(at_best)) - run) % 2 == 0)]
            symbols[first] = made[first]
            keep = np.ones(len(symbols), dtype=bool)
            keep[first + 1] = False
            symbols, cost, owner, rank, made = symbols[keep], cost[keep], owner[keep], rank[keep], made[keep]
            here = first - np.arange(len(first))  # places of the merged symbols after removal
            for i in (here, here - 1):
                i = i[i >= 0]
                nxt = np.minimum(i + 1, len(symbols) - 1)
                r, m = self.pair(symbols[i], symbols[nxt])
                joined = (owner[i] == owner[nxt]) & (nxt > i)
                rank[i], made[i] = np.where(joined, r, NO_RANK), m
        if not done_sym:
            return symbols, np.zeros(len(pretokens), dtype=np.int64), cost
        sym, cst, own = map(np.concatenate, (done_sym, done_cost, done_owner))
        by = np.argsort(own, kind="stable")
        return sym[by], np.bincount(of[own], minlength=len(pretokens)), cst[by]

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.full(len(symbols), NO_RANK)
        made = np.zeros(len(symbols), dtype=np.int32)
        r, m = self.pair(symbols[:-1], symbols[1:])
        rank[:-1], made[:-1] = np.where(owner[1:] == owner[:-1], r, NO_RANK), m
        return rank, made

    def counts(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        _, lengths, cost = self.segment(pretokens)
        total = np.r_[0, np.cumsum(cost)]
        ends = np.cumsum(lengths)
        return total[ends] - total[ends - lengths]


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def pre_tokens(text: str) -> Iterable[str]:
    """Pre-tokens of a whole text, the dummy prefix included; a newline, which no piece holds, cuts as well."""
    if not text:
        return ()
    return PRE_TOKEN.findall((SPACE + text).replace(" ", SPACE))


class TokenCounter:
    """Token counts of texts; the distinct pre-tokens of a slice are merged together, known ones come from a cache."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str]) -> list[int]:
        bags = [Counter(pre_tokens(t)) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        known = self.known
        fresh = list({p for bag in bags for p in bag if p not in known})
        for at in range(0, len(fresh), 1 << 16):
            part = fresh[at : at + (1 << 16)]
            known.update(zip(part, self.model.counts(part).tolist(), strict=True))
        counts = [sum(known[p] * n for p, n in bag.items()) for bag in bags]
        for p in fresh:
            if len(p) > CACHE_LENGTH:
                del known[p]
        return counts


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, **cols: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; over_limit: more than `limit` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter(piece_model(model_path))
        for ids, texts in doc_slices(batches):
            n = np.array(count([t.decode("utf-8") for t in texts]), dtype=np.int64)
            size = np.array([len(t) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(docs, **cols).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
