"""Language-model scores from an Elias-Fano n-gram trie (operator 8).

Counts come from all training texts (crc32 of the id as text, modulo FOLDS, isn't 0). Words are known by 128 bits of a hash.
The trie has three levels of monotone Elias-Fano sequences, in files of the shared folder that tasks memory-map:

* words, by hash range: sorted hashes and the running sum of their counts; a word's id is its place;
* pairs: the ids of contexts, pointers to each context's successors, and the successors, each as context number * words + id;
* triples: pointers from each pair to its successors, and the successors in the same way.

Pairs and triples carry a 16-bit code of their absolutely discounted probability, pairs also one of the weight that they leave to
the shorter context; words leave what their number of successors says. A look-up is a successor search between a
context's pointers; the probability is interpolated from the longest context to the words. Nothing is pruned: n-grams seen once are stored.

Pairs and triples are dealt by ranges of (word, word, word), whose bounds follow from the words' counts: an n-gram's range is
the place that it would have among all tokens if words were independent. So each range has about SHARD_TOKENS tokens, and the
successors of a frequent word or pair are split over many. A range's first context may go on from the range before: what it lacks
there (its number of successors, its count) is put together from one report of each range.

Two passes over the texts count words, then n-grams in runs of RUN_BYTES; a range's runs are merged as they come. Only a few
numbers of each range come to the driver. Where the shared folder has no file path, levels go out as a broadcast, up to BROADCAST_BYTES.

Defined results: a null or empty text is one end token; a null id is held out; without training texts all scores are
those of an empty model; repeated rows count as often as they occur; ties need no rule; texts are read whole, however long; an empty
table gives an empty result; other columns are not read and may have any names.
"""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.common import WORD_SPACE, doc_slices, id_text, lean, scratch_dir
from twofold.llm.eliasfano import EliasFano

FOLDS = 10
DISCOUNT = 0.75
ADD = 0.1
BEGIN, END = 0, 1  # numbers of a run; BEGIN is also the id 0 of the trie
#: Bytes of text whose n-grams are counted, and scored, together.
RUN_BYTES, SCORE_BYTES = 6 << 20, 4 << 20
SHARD_TOKENS = 1 << 21
LEAST_SHARDS = 8
CACHE_WORDS = 1 << 20
BROADCAST_BYTES = 1 << 30
#: Codes of log10 values from -16 to 0.
CODES, LOWEST = 65535, -16.0


def held_out(folds: int = FOLDS) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))


def coded(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities; 0 stands for the lowest."""
    return np.rint((np.log10(np.clip(p, 10.0**LOWEST, 1.0)) / -LOWEST + 1) * CODES).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    return 10.0 ** ((code.astype(np.float64) / CODES - 1) * -LOWEST)


def planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, as many as the largest needs, plane by plane; high planes compress."""
    x = x.astype(np.uint64)
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + len(x).to_bytes(8, "little") + b"".join((x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width))


def unplaned(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[1:9], "little")
    out = np.zeros(n, dtype=np.uint64)
    for k in range(raw[0]):
        out |= np.frombuffer(raw, dtype=np.uint8, count=n, offset=9 + k * n).astype(np.uint64) << np.uint64(8 * k)
    return out


# files of levels


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one file: their places as JSON, then the arrays."""
    facts, at, parts = {}, 0, []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x).tobytes()
        facts[name] = (x.dtype.str, at, len(x))
        parts.append(raw + bytes(-len(raw) % 8))
        at += len(parts[-1])
    head = json.dumps(facts).encode()
    head += b" " * (-len(head) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def unpacked(raw) -> dict[str, np.ndarray]:
    size = int.from_bytes(raw[:8], "little")
    return {name: np.frombuffer(raw, dtype=kind, count=n, offset=8 + size + at) for name, (kind, at, n) in json.loads(bytes(raw[8 : 8 + size])).items()}


def fields(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{f}": x for f, x in ef.arrays().items()}


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(*(arrays[f"{name}.{f}"] for f in EliasFano.FIELDS))


class Store:
    """Files of one trie: in the shared folder, or, where that has no file path, the bytes that tasks hand back, in a broadcast."""

    def __init__(self, folder: str | None):
        self.folder, self.shared, self.maps = folder, None, {}

    def __getstate__(self):
        return {"folder": self.folder, "shared": self.shared, "maps": {}}

    @classmethod
    def new(cls, spark) -> Store:
        where = urlparse(scratch_dir(spark))
        if where.scheme not in ("", "file"):
            return cls(None)
        folder = os.path.join(where.path, f"trie-{uuid.uuid4().hex}")
        os.makedirs(folder)
        return cls(folder)

    def put(self, name: str, arrays: dict[str, np.ndarray]) -> bytes:
        """Called by tasks: a repeated attempt replaces the file by an equal one."""
        raw = packed(arrays)
        if not self.folder:
            return raw
        part = os.path.join(self.folder, f"{name}.{uuid.uuid4().hex}")
        with open(part, "wb") as out:
            out.write(raw)
        os.replace(part, os.path.join(self.folder, name))
        return b""

    def published(self, sc, more: dict[str, bytes]) -> Store:
        """The store with the files that tasks have handed back."""
        out = Store(self.folder)
        if not self.folder:
            every = (self.shared.value if self.shared else {}) | more
            size = sum(map(len, every.values()))
            if size > BROADCAST_BYTES:
                raise ValueError(f"{size} bytes of model: a shared folder with a file path is needed beyond {BROADCAST_BYTES}")
            out.shared = sc.broadcast(every)
        return out

    def open(self, name: str) -> dict[str, np.ndarray]:
        if not self.folder:
            return unpacked(self.shared.value[name])
        if name not in self.maps:
            with open(os.path.join(self.folder, name), "rb") as file:
                self.maps[name] = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        return unpacked(self.maps[name])

    def let_go(self) -> None:
        """The pages read so far may leave this process; the system's cache keeps them."""
        for m in self.maps.values():
            m.madvise(mmap.MADV_DONTNEED)


# words


#: Words up to so many bytes are hashed together, longer ones one by one.
SHORT = 64
SPACES = np.zeros(256, dtype=bool)
SPACES[list(WORD_SPACE)] = True
MIX = [np.array(x, dtype=np.uint64) for x in ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xFF51AFD7ED558CCD, 0xA0761D6478BD642F), (0xC4CEB9FE1A85EC53, 0xE7037ED1A0B428DB))]
END_HASH = np.zeros((1, 2), dtype=np.uint64)  # sorts first


def word_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words at `start`; `raw` ends in 8 bytes of padding. Eight bytes at a time, the last ones masked."""
    eight = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    out = []
    for lane in range(2):
        h = size.astype(np.uint64) * MIX[0][lane]
        for at in range(0, min(int(size.max(initial=0)), SHORT), 8):
            which = np.flatnonzero(size > at) if at else slice(None)
            x = eight[start[which] + at].astype(np.uint64)
            rest = 8 - np.minimum(size[which] - at, 8)
            x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (rest.astype(np.uint64) << np.uint64(3))
            x ^= h[which]
            x = (x ^ (x >> np.uint64(32))) * MIX[1][lane]
            x = (x ^ (x >> np.uint64(29))) * MIX[2][lane]
            h[which] = x ^ (x >> np.uint64(32))
        out.append(h)
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = xxhash.xxh3_128_intdigest(raw[start[i] : start[i] + size[i]].tobytes())
        out[0][i], out[1][i] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
    return out[0], out[1]


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the different words with END's first, in order; all numbers, BEGIN and END of each text included; the lengths
    with them). Numbers follow the order of the hashes after BEGIN, so they are in the order of ids."""
    raw = np.frombuffer(b"\n".join([*texts, b""]).lower() + bytes(8), dtype=np.uint8)
    n = len(raw) - 8
    space = SPACES[raw[:n]]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    hi, lo = word_hashes(raw, start, size)
    kinds, first, which = np.unique(hi, return_index=True, return_inverse=True)
    hashes = np.stack([kinds, lo[first]], axis=1)
    if (hashes[which, 1] != lo).any():  # different words share 64 bits
        by = np.lexsort((lo, hi))
        new = np.r_[True, (hi[by][1:] != hi[by][:-1]) | (lo[by][1:] != lo[by][:-1])]
        hashes = np.stack([hi[by][new], lo[by][new]], axis=1)
        which = np.empty(len(hi), dtype=np.int64)
        which[by] = np.cumsum(new) - 1
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    lengths = np.diff(np.r_[0, np.searchsorted(start, ends)]) + 2
    last = np.cumsum(lengths)
    nums = np.full(int(lengths.sum()), END, dtype=np.int64)
    nums[last - lengths] = BEGIN
    inner = np.ones(len(nums), dtype=bool)
    inner[last - 1] = inner[last - lengths] = False
    nums[inner] = which + 2
    return np.concatenate([END_HASH, hashes]), nums, lengths


def runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[bytes]]:
    """Whole texts in runs of about `limit` bytes, over batches."""
    run, size = [], 0
    for _, texts in doc_slices(batches, limit):
        run += texts
        size += sum(map(len, texts))
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


WORDS_DDL = "shard int, hi binary, lo binary, n binary"
WORDS_SCHEMA = pa.schema([("shard", pa.int32()), ("hi", pa.binary()), ("lo", pa.binary()), ("n", pa.binary())])
REPORT_DDL = "shard int, facts string, raw binary"
REPORT_SCHEMA = pa.schema([("shard", pa.int32()), ("facts", pa.string()), ("raw", pa.binary())])


def report(shard: int, facts: dict, raw: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"shard": shard, "facts": json.dumps(facts), "raw": raw}], schema=REPORT_SCHEMA)


def hash_range(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def count_words(shards: int):
    """Counts of a task's words, by hash range."""

    def flush(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.searchsorted(hash_range(hi, shards), np.arange(shards + 1)).tolist()
        rows = [(s, planes(hi[a:b]), lo[a:b].astype("<u8").tobytes(), planes(n[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), WORDS_SCHEMA.types, strict=True)], schema=WORDS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for texts in runs(batches, RUN_BYTES):
            hashes, nums, _ = numbered(texts)
            sums.add(hashes[:, 0], hashes[:, 1], np.bincount(nums, minlength=len(hashes) + 1)[1:])
            if sums.size > CACHE_WORDS and len(sums.held) == 1:
                yield from flush(*sums.settle())
                sums = Sums()
        if sums.held:
            yield from flush(*sums.settle())

    return run


class Sums:
    """Rows of sorted keys with counts, added up as they come: held rows are settled whenever they have doubled."""

    def __init__(self, least: int = 1 << 20):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.least, self.limit = 0, least, least

    def add(self, *cols: np.ndarray) -> None:
        """Key columns, the main one first, then counts."""
        self.held.append(cols)
        self.size += len(cols[0])
        if self.size > self.limit:
            self.settle()
            self.limit = max(self.least, 2 * self.size)

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return (np.zeros(0, dtype=np.uint64),) * 3
        *keys, n = map(np.concatenate, zip(*self.held, strict=True))
        by = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        keys, n = [k[by] for k in keys], n[by]
        if len(n):
            head = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            keys, n = [k[head] for k in keys], np.add.reduceat(n, head)
        self.held, self.size = [(*keys, n)], len(n)
        return *keys, n


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows sorted by shard, as (shard, its rows one after the other)."""
    rows = (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
    yield from groupby(rows, key=lambda r: r["shard"])


def build_words(store: Store):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_shard(batches):
            sums = Sums()
            for r in rows:
                sums.add(unplaned(r["hi"]), np.frombuffer(r["lo"], "<u8").astype(np.uint64), unplaned(r["n"]).astype(np.int64))
            hi, lo, n = sums.settle()
            total = int(n.sum())
            raw = store.put(
                f"words{shard}", fields("hashes", EliasFano.build(hi, 1 << 64)) | {"lo": lo} | fields("sums", EliasFano.build(np.r_[0, np.cumsum(n)], total + 1))
            )
            yield report(shard, {"n": len(n), "total": total}, raw)

    return run


@dataclass
class Shape:
    """Sizes of the level of words: for each hash range the words and tokens before it."""

    shards: int
    words: np.ndarray
    tokens: np.ndarray
    n_texts: int = 0
    n_ranges: int = LEAST_SHARDS

    @property
    def total(self) -> int:
        return int(self.tokens[-1])

    @property
    def size(self) -> int:
        return int(self.words[-1])

    @property
    def ids(self) -> int:
        """Ids of the trie: BEGIN and the words."""
        return self.size + 1


class Words:
    """The level of words. Ids are places + 1; the id 0 is BEGIN, which occurs once a text and comes first in the sums."""

    def __init__(self, store: Store, shape: Shape):
        self.store, self.shape, self.levels = store, shape, {}

    def level(self, s: int) -> tuple[EliasFano, np.ndarray, EliasFano]:
        if s not in self.levels:
            arrays = self.store.open(f"words{s}")
            self.levels[s] = sequence(arrays, "hashes"), arrays["lo"], sequence(arrays, "sums")
        return self.levels[s]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by their hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        of = hash_range(hashes[:, 0], self.shape.shards)
        for s in np.unique(of).tolist():
            if self.shape.words[s] == self.shape.words[s + 1]:
                continue
            which = np.flatnonzero(of == s)
            sorted_hi, lo, _ = self.level(s)
            hi, low = hashes[which, 0], hashes[which, 1]
            at, hit = sorted_hi.successor(hi)
            live = np.flatnonzero(hit)
            while len(live):  # one round, unless words share 64 bits
                same = lo[at[live]] == low[live]
                out[which[live[same]]] = at[live[same]] + self.shape.words[s] + 1
                live = live[~same]
                at[live] += 1
                live = live[at[live] < sorted_hi.n]
                live = live[sorted_hi.access(at[live]) == hi[live]]
        return out

    def sums(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens before each id's, its own tokens); none for -1."""
        before, own = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        own[ids == 0] = self.shape.n_texts
        of = np.searchsorted(self.shape.words, ids - 1, side="right") - 1
        for s in np.unique(of[ids > 0]).tolist():
            which = np.flatnonzero((of == s) & (ids > 0))
            at = ids[which] - 1 - self.shape.words[s]
            sums = self.level(s)[2]
            a, b = (x.astype(np.int64) for x in sums.access_two(at))
            before[which], own[which] = a + self.shape.tokens[s] + self.shape.n_texts, b - a
        return before, own

    def facts(self, hashes: np.ndarray) -> np.ndarray:
        """Rows (id, tokens before, own tokens) of the numbers of a run: BEGIN, then its words."""
        ids = np.r_[0, self.ids(hashes)]
        return np.stack([ids, *self.sums(ids)])


# pairs and triples


def ranges(shape: Shape, facts: np.ndarray, u: np.ndarray, v: np.ndarray | None = None, w: np.ndarray | None = None) -> np.ndarray:
    """Range of each n-gram of numbers in rows of `facts`: monotone in (u, v, w); a word lies before its pairs, a pair before its triples."""
    t = float(max(shape.total + shape.n_texts, 1))
    before, own = facts[1].astype(np.float64), facts[2].astype(np.float64)
    at = before[u]
    if v is not None:
        inner = before[v]
        if w is not None:
            inner += own[v] * (before / t)[w]
        inner /= t
        inner *= own[u]
        at += inner
    at /= t
    at *= shape.n_ranges
    return np.minimum(at.astype(np.int64), shape.n_ranges - 1)


GRAMS_DDL = "shard int, u binary, v binary, n binary, found binary, w binary, m binary, carried binary"
GRAMS_SCHEMA = pa.schema([("shard", pa.int32())] + [(c.split()[0], pa.binary()) for c in GRAMS_DDL.split(", ")[1:]])


def count_grams(store: Store, shape: Shape):
    """Pairs and triples of a task's runs, by range. A row has the pairs of a range, how many of the triples follow each, and the
    triples' last words; triples at its head may belong to a pair of a range before, which is `carried`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(store, shape)
        for texts in runs(batches, RUN_BYTES):
            hashes, nums, _ = numbered(texts)
            yield from flush(nums, words.facts(hashes))
            words.store.let_go()

    def flush(nums: np.ndarray, facts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = facts.shape[1].bit_length()
        inner = nums != BEGIN
        pair, which, n = np.unique(((nums[:-1] << bits) | nums[1:])[inner[1:]], return_inverse=True, return_counts=True)
        longer = np.flatnonzero((inner[:-1])[inner[1:]])  # the pair before ends where this one begins
        triple, m = np.unique((which[longer - 1] << bits) | nums[1:][inner[1:]][longer], return_counts=True)
        low = (1 << bits) - 1
        u, v, of, w = pair >> bits, pair & low, triple >> bits, triple & low
        bounds = np.arange(shape.n_ranges + 1)
        p = np.searchsorted(ranges(shape, facts, u, v), bounds).tolist()
        t = np.searchsorted(ranges(shape, facts, u[of], v[of], w), bounds).tolist()
        ids = facts[0]
        for s in range(shape.n_ranges):
            a, b, x, y = p[s], p[s + 1], t[s], t[s + 1]
            if a == b and x == y:
                continue
            head = int(np.searchsorted(of[x:y], a))  # triples of a pair before this range
            carried = planes(np.array([ids[u[of[x]]], ids[v[of[x]]], head])) if head else b""
            found = np.bincount(of[x + head : y] - a, minlength=b - a)
            cols = [ids[u[a:b]], ids[v[a:b]], n[a:b], found, ids[w[x:y]], m[x:y]]
            row = [s, *map(planes, cols), carried]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row, GRAMS_SCHEMA.types, strict=True)], schema=GRAMS_SCHEMA)

    return run


def build_grams(store: Store, shape: Shape):
    """The levels of pairs and triples of a range, and what its neighbours have to know of its first and last contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(store, shape)
        for shard, rows in by_shard(batches):
            pairs, triples = Sums(), Sums()
            for r in rows:
                u, v, n, found, w, m = (unplaned(r[c]) for c in ("u", "v", "n", "found", "w", "m"))
                key = u * np.uint64(shape.ids) + v
                of = np.repeat(key, found.astype(np.int64))
                if r["carried"]:
                    cu, cv, head = unplaned(r["carried"])
                    of = np.concatenate([np.full(int(head), cu * np.uint64(shape.ids) + cv), of])
                pairs.add(key, n.astype(np.int64))
                triples.add(of, w, m.astype(np.int64))
            yield report(shard, *level(shard, pairs.settle(), triples.settle(), words))

    def level(shard: int, pairs: tuple, triples: tuple, words: Words) -> tuple[dict, bytes]:
        size = np.uint64(shape.ids)
        key, n = pairs[0], pairs[1].astype(np.int64)
        u, v = (key // size).astype(np.int64), key % size
        of, w, m = triples
        head = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, dtype=np.int64)
        context = u[head]
        found = np.diff(np.r_[head, len(u)])
        number = np.repeat(np.arange(len(head)), found)
        total = words.sums(context)[1]
        # triples: context 0 is a pair carried over from a range before, the others are this range's pairs
        at = np.searchsorted(key, of) if len(key) else np.zeros(len(of), dtype=np.int64)
        mine = (key[np.minimum(at, len(key) - 1)] == of) if len(key) else np.zeros(len(of), dtype=bool)
        j = np.where(mine, at + 1, 0)
        follow = np.bincount(j, minlength=len(key) + 1)
        carried = int(m[~mine].sum())
        of_all = np.r_[max(carried, 1), n]
        arrays = (
            fields("contexts", EliasFano.build(context, int(size)))
            | fields("pointers", EliasFano.build(np.r_[0, np.cumsum(found)], len(u) + 1))
            | fields("pairs", EliasFano.build(number.astype(np.uint64) * size + v, max(len(head), 1) * int(size)))
            | {"pair_code": coded((n - DISCOUNT) / np.maximum(total, 1)[number]), "left_code": coded(1 - left(follow[1:], n))}
            | fields("pointers3", EliasFano.build(np.r_[0, np.cumsum(follow)], len(of) + 1))
            | fields("triples", EliasFano.build(j.astype(np.uint64) * size + w, (len(key) + 1) * int(size)))
            | {"triple_code": coded((m - DISCOUNT) / of_all[j])}
        )
        facts = {"contexts": [[int(context[i]), int(found[i])] for i in {0, len(head) - 1}] if len(head) else []}
        if carried:
            facts["carried"] = [int(of[0] // size), int(of[0] % size), int(follow[0]), carried]
        if len(key):
            facts["last"] = [int(u[-1]), int(v[-1]), int(follow[-1]), int(n[-1])]
        return facts, store.put(f"grams{shard}", arrays)

    return run


def left(followers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a context's own n-grams weigh: all but the discount of each different follower."""
    return 1 - DISCOUNT * followers / np.maximum(n, 1)


@dataclass
class Seams:
    """Contexts at the ends of ranges, which may lie in several: the followers of a word, the weight that a pair leaves, and the part of its pair's count
    that a range's carried triples have."""

    followers: dict[int, int]
    left: dict[tuple[int, int], float]
    carried: dict[int, tuple[int, int, float]]

    @classmethod
    def of(cls, reports: dict[int, dict]) -> Seams:
        seen: dict[int, list[int]] = defaultdict(list)
        for facts in reports.values():
            for u, found in facts["contexts"]:
                seen[u].append(found)
        last = {tuple(f["last"][:2]): f["last"][2:] for f in reports.values() if "last" in f}
        more: dict[tuple[int, int], int] = defaultdict(int)
        for f in reports.values():
            if "carried" in f:
                more[tuple(f["carried"][:2])] += f["carried"][2]
        # a pair whose triples go on in other ranges is the last pair of its own
        weights = {k: DISCOUNT * (last[k][0] + n) / last[k][1] for k, n in more.items()}
        scale = {s: (*f["carried"][:2], f["carried"][3] / last[tuple(f["carried"][:2])][1]) for s, f in reports.items() if "carried" in f}
        return cls({u: sum(x) for u, x in seen.items()}, weights, scale)


def train(texts: DataFrame, folds: int = FOLDS, shard_tokens: int = SHARD_TOKENS) -> tuple[Store, Shape, Seams, set[int]]:
    """The levels, their shape, the contexts in several ranges, and the ranges that hold n-grams."""
    sc = texts.sparkSession.sparkContext
    learn = texts.where(~held_out(folds))
    store = Store.new(texts.sparkSession)
    shards = max(LEAST_SHARDS, learn.rdd.getNumPartitions())
    counted = learn.mapInArrow(lean(count_words(shards)), WORDS_DDL).repartition(shards, "shard").sortWithinPartitions("shard")
    found = {r["shard"]: r for r in counted.mapInArrow(lean(build_words(store)), REPORT_DDL).collect()}  # two numbers of each range
    sizes = [json.loads(found[s]["facts"]) if s in found else {"n": 0, "total": 0} for s in range(shards)]
    shape = Shape(shards, *(np.r_[0, np.cumsum([x[k] for x in sizes])].astype(np.int64) for k in ("n", "total")))
    store = store.published(sc, {f"words{s}": bytes(r["raw"]) for s, r in found.items()})
    words = Words(store, shape)
    shape.n_texts = int(words.sums(words.ids(END_HASH))[1][0])  # as many as ends
    shape.n_ranges = max(LEAST_SHARDS, shape.total // shard_tokens)
    grams = learn.mapInArrow(lean(count_grams(store, shape)), GRAMS_DDL).repartition(shape.n_ranges, "shard").sortWithinPartitions("shard")
    rows = grams.mapInArrow(lean(build_grams(store, shape)), REPORT_DDL).collect()  # a few numbers of each range
    reports = {r["shard"]: json.loads(r["facts"]) for r in rows}
    return store.published(sc, {f"grams{r['shard']}": bytes(r["raw"]) for r in rows}), shape, Seams.of(reports), set(reports)


class Grams:
    """The levels of pairs and triples of one range."""

    def __init__(self, arrays: dict[str, np.ndarray], size: int):
        self.size = np.uint64(size)
        self.contexts, self.pointers, self.pairs, self.pointers3, self.triples = (
            sequence(arrays, x) for x in ("contexts", "pointers", "pairs", "pointers3", "triples")
        )
        self.pair_code, self.left_code, self.triple_code = (arrays[f"{x}_code"] for x in ("pair", "left", "triple"))

    def context(self, u: np.ndarray) -> np.ndarray:
        """Rows (number, first successor, the one after the last) of words as contexts; no successors where there is none."""
        number, hit = self.contexts.successor(u)
        out = np.zeros((3, len(u)), dtype=np.int64)
        out[0, hit] = number[hit]
        out[1:, hit] = self.pointers.access_two(number[hit])
        return out

    def pair(self, context: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Places of pairs, -1 where there is none: a successor search between the context's pointers."""
        number, a, b = context
        place, hit = self.pairs.successor(number.astype(np.uint64) * self.size + v.astype(np.uint64), a, b)
        return np.where(hit, place, -1)

    def triple(self, pair: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Places of triples of the contexts `pair` (the carried one is -1), -1 where there is none."""
        j = pair + 1
        a, b = (x.astype(np.int64) for x in self.pointers3.access_two(j))
        place, hit = self.triples.successor(j.astype(np.uint64) * self.size + w.astype(np.uint64), a, b)
        return np.where(hit, place, -1)


class Trie:
    def __init__(self, store: Store, shape: Shape, seams: Seams, held: set[int]):
        self.store, self.shape, self.seams, self.held = store, shape, seams, held
        self.words, self.ranges = Words(store, shape), {}

    def range_(self, s: int) -> Grams:
        if s not in self.ranges:
            self.ranges[s] = Grams(self.store.open(f"grams{s}"), self.shape.ids)
        return self.ranges[s]

    def by_range(self, of: np.ndarray, among: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(range, places) of the places `among` by range; ranges without n-grams are left out."""
        among = among[np.argsort(of[among], kind="stable")]
        cut = np.flatnonzero(np.r_[True, of[among][1:] != of[among][:-1]]) if len(among) else []
        for part in np.split(among, cut[1:]) if len(among) else []:
            if int(of[part[0]]) in self.held:
                yield int(of[part[0]]), part

    def contexts(self, facts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows (first range, number, first and last successor there) of words as contexts; the weight that each leaves to the
        level of words, 1 where nothing follows it)."""
        ids, own = facts[0], facts[2]
        found = np.zeros((4, len(ids)), dtype=np.int64)
        found[0] = ranges(self.shape, facts, np.arange(len(ids)))
        for s, which in self.by_range(found[0], np.flatnonzero((ids >= 0) & (own > 0))):
            found[1:, which] = self.range_(s).context(ids[which])
        followers = found[3] - found[2]
        if self.seams.followers:
            split = self.seams.followers
            for i in np.flatnonzero(np.isin(ids, np.fromiter(split, dtype=np.int64, count=len(split)))).tolist():
                followers[i] = split[int(ids[i])]
        return found, np.where(followers > 0, 1 - left(followers, own), 1.0)

    def pairs(self, facts: np.ndarray, contexts: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """For numbers in rows of `facts` and `contexts`: (range, place, own probability, weight left) of pairs; place -1 and 0, 1
        where there is none."""
        of, ids = ranges(self.shape, facts, u, v), facts[0]
        place, p, rest = np.full(len(of), -1, dtype=np.int64), np.zeros(len(of)), np.ones(len(of))
        for s, which in self.by_range(of, np.flatnonzero((ids[u] >= 0) & (ids[v] > 0))):
            level = self.range_(s)
            known = contexts[:, u[which]]
            far = np.flatnonzero(known[0] != s)  # the context goes on in this range
            known = known[1:]
            if len(far):
                known[:, far] = level.context(ids[u[which[far]]])
            at = level.pair(known, ids[v[which]])
            hit = at >= 0
            place[which[hit]] = at[hit]
            p[which[hit]], rest[which[hit]] = decoded(level.pair_code[at[hit]]), decoded(level.left_code[at[hit]])
        if self.seams.left:
            size = np.int64(self.shape.ids)
            keys = {a * int(size) + b: x for (a, b), x in self.seams.left.items()}
            mine = ids[u] * size + ids[v]
            for i in np.flatnonzero((place >= 0) & np.isin(mine, np.fromiter(keys, dtype=np.int64, count=len(keys)))).tolist():
                rest[i] = keys[int(mine[i])]
        return of, place, p, rest

    def triples(self, facts: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, home: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Own probabilities of triples whose pair lies in range `home` at `place`; 0 where there is none."""
        of, ids = ranges(self.shape, facts, u, v, w), facts[0]
        p = np.zeros(len(of))
        for s, which in self.by_range(of, np.flatnonzero((place >= 0) & (ids[w] > 0))):
            level = self.range_(s)
            at_home = home[which] == s
            pair = np.where(at_home, place[which], -1)
            scale = np.ones(len(which))
            if not at_home.all():
                a, b, share = self.seams.carried.get(s, (-1, -1, 0.0))
                ours = (ids[u[which]] == a) & (ids[v[which]] == b) & ~at_home
                scale[ours] = share
                which, pair, scale = (x[at_home | ours] for x in (which, pair, scale))
            at = level.triple(pair, ids[w[which]])
            hit = at >= 0
            p[which[hit]] = decoded(level.triple_code[at[hit]]) * scale[hit]
        return p


def scores(docs: DataFrame, folds: int = FOLDS, shard_tokens: int = SHARD_TOKENS, **cols: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    texts = id_text(docs, **cols)
    model = train(texts, folds, shard_tokens)
    total, size = model[1].total, model[1].size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*model)
        for ids, part in doc_slices(batches, SCORE_BYTES):
            hashes, nums, lengths = numbered(part)
            facts = trie.words.facts(hashes)
            contexts, leave = trie.contexts(facts)
            known = facts[2].copy()
            known[BEGIN] = 0
            base = (known + ADD) / (total + ADD * (size + 1))
            bits = facts.shape[1].bit_length()
            at = np.flatnonzero(nums != BEGIN)
            pair, which = np.unique((nums[at - 1] << bits) | nums[at], return_inverse=True)
            u, v = pair >> bits, pair & (1 << bits) - 1
            home, place, p, rest = trie.pairs(facts, contexts, u, v)
            p2 = p + leave[u] * base[v]
            prob = p2[which]
            longer = np.flatnonzero(nums[at - 1] != BEGIN)
            triple, back = np.unique((which[longer - 1] << bits) | nums[at[longer]], return_inverse=True)
            of, w = triple >> bits, triple & (1 << bits) - 1
            own = trie.triples(facts, u[of], v[of], w, home[of], place[of])
            prob[longer] = own[back] + rest[of][back] * prob[longer]
            owner = np.repeat(np.arange(len(part)), lengths - 1)
            n = len(part)
            word = nums[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(lengths - 1), pa.array(np.bincount(owner, known[word] > 0, minlength=n).astype(np.int64)),
                    pa.array(np.full(n, total, dtype=np.int64)), pa.array(np.bincount(owner, np.log10(base)[word], minlength=n)),
                    pa.array(np.bincount(owner, np.log10(np.minimum(prob, 1.0)), minlength=n)),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            trie.store.let_go()

    out = texts.mapInArrow(lean(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", held_out(folds).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
