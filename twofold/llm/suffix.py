"""Suffix-array deduplication over common-prefix intervals (operator 2).

Bytes that a string of `length` bytes covers which also starts earlier are removed. Sorting all suffixes of a
corpus would move many times its size, so suffixes are sampled where equal strings must be sampled alike: every
window of `length` bytes picks its smallest 32-byte gram as an anchor, and only windows around equal
anchors can be equal.

1. Each task finds the anchors of its texts, (gram hash, hash of the bytes around, place). Equal surroundings within a
   task are settled there (all but the first are removed), so a task sends at most one row for each surroundings.
2. Shuffled by gram hash and sorted, equal surroundings are settled across tasks in one streaming pass; a gram
   with several different surroundings needs their bytes.
3. Those bytes are fetched from the texts, and an enhanced suffix array is built over the suffixes of
   each gram's surroundings: suffixes in order, common prefixes of neighbours, and a stack scan over the tree of
   common-prefix intervals. An interval whose occurrences differ in the byte to the left is a maximal
   repeat, with all its occurrences; all but the earliest are removed. A gram with more than HOT surroundings goes on
   as its single windows, keyed by their own hash, so that no task holds the group.
4. The intervals of a document are merged with its text.

Texts are shuffled once; both fetches read that exchange.

Defined results: a null text is empty; texts under `length` bytes lose nothing; rows of one id count as the
same document, equal rows are cut alike; a null id sorts first; of strings that tie in content the earliest stays; periodic
texts keep their first period's window; very long texts are read whole, in one task; an empty table gives an empty result;
columns other than the id and the text are not read, or pass through in the struct `rest` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twofold.llm.common import lean, quoted, written

LENGTH = 100
GRAM = 32
#: Surroundings of one gram that one task may hold.
HOT = 50_000
ROWS = 1 << 18
#: Texts searched for anchors at a time, whole ones: about ten arrays of eight bytes a byte are held for them.
SLICE_BYTES = 1 << 18
#: Anchors that a task settles and sends at a time, and places whose windows are measured at a time.
SENT = 1 << 16
REACH = 1 << 11
#: Surroundings whose suffix array is built at a time, but for those of one gram, and texts cut at a time.
CONTEXTS = 1 << 12
CUT_ROWS = 1 << 10
NO_ID = -(1 << 63)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
BASE = 0xA0761D6478BD642F
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; `raw` ends in 7 bytes of padding."""
    return np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    return x ^ (x >> np.uint64(29))


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op (minimum or maximum) over x[i : i + width]."""
    have, out = 1, x
    while 2 * have <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1]) if have < width else out


class Hashes:
    """Sums that give the hash of any byte range of a buffer."""

    def __init__(self, gram8: np.ndarray):
        n = len(gram8)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mixed(gram8 * MIX[0]) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of bytes a to b, at least 8."""
        return mixed((self.sums[b - 7] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64) * MIX[2])


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, gram hash, surroundings hash, from, to) of each anchor, places within the text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(texts) + bytes(length + 8), dtype=np.uint8)
    n = int(ends[-1]) if len(ends) else 0
    e = eights(raw)
    m = n - GRAM + 1
    span = length - GRAM + 1  # grams in a window
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    g = mixed(e[:m] * MIX[0] + mixed(e[8 : 8 + m] * MIX[1]) + mixed(e[16 : 16 + m] * MIX[2]) * MIX[3] + e[24 : 24 + m] * MIX[2])
    g |= np.uint64(1)
    least = sliding(np.minimum, g, span)
    valid = np.zeros(len(least) + 1, dtype=np.int64)
    whole = sizes >= length
    np.add.at(valid, (ends - sizes)[whole], 1)
    np.add.at(valid, (ends - length + 1)[whole], -1)
    least[np.cumsum(valid)[:-1] == 0] = 0
    padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), least, np.zeros(span - 1, dtype=np.uint64)])
    at = np.flatnonzero(sliding(np.maximum, padded, span)[:m] == g)
    owner = np.searchsorted(ends, at, side="right")
    first, last = (ends - sizes)[owner], ends[owner]
    # a window belongs to its leftmost smallest gram: those of one gram start from a to b
    lo, hi = reach(g, at, span)
    a, b = np.maximum(first, lo), np.minimum(last - length, hi) + length
    own = a + length <= b
    owner, at, a, b, first = owner[own], at[own], a[own], b[own], first[own]
    return owner, g[at], Hashes(e[: n + 8]).of(a, b), a - first, b - first


def reach(g: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows of `span` grams whose leftmost smallest gram is at each place."""
    lo, hi = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
    off = np.arange(1, span)
    for k in range(0, len(at), REACH):
        i = at[k : k + REACH, None]
        own = g[i]
        left = (g[np.maximum(i - off, 0)] <= own) & (i >= off)
        right = (g[np.minimum(i + off, len(g) - 1)] < own) & (i + off < len(g))
        i = i[:, 0]
        lo[k : k + len(i)] = i - np.where(left.any(axis=1), left.argmax(axis=1), span - 1)
        hi[k : k + len(i)] = np.where(right.any(axis=1), i + right.argmax(axis=1) + 1 - span, i)
    return lo, hi


def merged(doc: np.ndarray, tag: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching ranges of a document as one; ranges sorted by document and start."""
    if not len(doc):
        return doc, tag, a, b
    by = np.lexsort((a, tag, doc))
    doc, tag, a, b = doc[by], tag[by], a[by], b[by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    group = np.cumsum(new) - 1
    lift = group * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    cut = np.flatnonzero(np.r_[True, new[1:] | (a[1:] > reach[:-1])])
    return doc[cut], tag[cut], a[cut], np.maximum.reduceat(b, cut)


ANCHOR = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("done", pa.bool_())])
ANCHOR_DDL = "a long, c long, doc long, tag long, s long, e long, done boolean"


def rows(a, c, doc, tag, s, e, done) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in (a, c, doc, tag, s, e)] + [pa.array(np.full(len(doc), done))], schema=ANCHOR
    )


def settle(a, c, doc, tag, s, e):
    """Sorted by (a, c, place): mask of rows whose surroundings start the run, and of those that repeat an earlier place."""
    head = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    first = np.maximum.accumulate(np.where(head, np.arange(len(a)), 0))
    return head, (doc > doc[first]) | ((doc == doc[first]) & (s > s[first]))


def find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(2).cast(pa.binary())
            sizes = pc.binary_length(texts).to_pylist()
            at = 0
            while at < len(texts):
                until, total = at, 0
                while until < len(texts) and total < SLICE_BYTES:
                    total += sizes[until]
                    until += 1
                owner, a, c, s, e = anchors(texts.slice(at, until - at).to_pylist(), length)
                held.append((a, c, docs[at:until][owner], tags[at:until][owner], s, e))
                size += len(a)
                at = until
                if size >= SENT:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held or not sum(len(x[0]) for x in held):
            return
        a, c, doc, tag, s, e = map(np.concatenate, zip(*held, strict=True))
        by = np.lexsort((s, doc, c, a))
        a, c, doc, tag, s, e = (x[by] for x in (a, c, doc, tag, s, e))
        head, later = settle(a, c, doc, tag, s, e)
        d, t, x, y = merged(doc[later], tag[later], s[later], e[later])
        yield rows(a[~later], c[~later], doc[~later], tag[~later], s[~later], e[~later], False)
        if len(d):
            spread = mixed(d.view(np.uint64) * MIX[0] + x.view(np.uint64))  # settled ranges go along, to any task
            yield rows(spread, spread, d, t, x, y, True)

    return run


def settle_groups(hot: int):
    """One streaming pass over rows sorted by (a, c, doc, s): settled ranges, and the surroundings to compare (c = 1 where hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: tuple | None = None  # first rows of the surroundings of the gram at hand
        is_hot = False
        for batch in batched(batches):
            a, c, doc, tag, s, e = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            done = batch.column(6).to_numpy(zero_copy_only=False).astype(bool)
            if done.any():
                yield rows(a[done], c[done], doc[done], tag[done], s[done], e[done], True)
                a, c, doc, tag, s, e = (x[~done] for x in (a, c, doc, tag, s, e))
            if not len(a):
                continue
            fresh = 0
            if keep is not None:
                fresh = len(keep[0])
                a, c, doc, tag, s, e = (np.concatenate(p) for p in zip(keep, (a, c, doc, tag, s, e), strict=True))
            head, later = settle(a, c, doc, tag, s, e)
            if later.any():
                d, t, x, y = merged(doc[later], tag[later], s[later], e[later])
                yield rows(d, d, d, t, x, y, True)
            group = a != a[-1]
            full = head & group
            if full.any() and is_hot and fresh:  # the gram that was hot ends in this batch
                old = full & (a == a[0])
                new = old & (np.arange(len(a)) >= fresh)
                if new.any():
                    yield rows(a[new], np.ones(new.sum(), dtype=np.int64), doc[new], tag[new], s[new], e[new], False)
                full &= ~old
            if full.any():
                b = a[full]
                _, back, n = np.unique(b, return_inverse=True, return_counts=True)
                several = n[back] > 1
                if several.any():
                    flag = (n[back][several] > hot).astype(np.int64)
                    at = np.flatnonzero(full)[several]
                    yield rows(a[at], flag, doc[at], tag[at], s[at], e[at], False)
            at = np.flatnonzero(head & ~group)
            if is_hot and fresh and a[0] == a[-1]:
                new = at[at >= fresh]
                if len(new):
                    yield rows(a[new], np.ones(len(new), dtype=np.int64), doc[new], tag[new], s[new], e[new], False)
                at = at[-1:]  # later rows may still repeat the last surroundings
            else:
                is_hot = len(at) > hot
                if is_hot:
                    yield rows(a[at], np.ones(len(at), dtype=np.int64), doc[at], tag[at], s[at], e[at], False)
                    at = at[-1:]
            keep = tuple(x[at] for x in (a, c, doc, tag, s, e))
        if keep is not None and not is_hot and len(keep[0]) > 1:
            a, c, doc, tag, s, e = keep
            yield rows(a, np.zeros(len(a), dtype=np.int64), doc, tag, s, e, False)

    return run


def batched(batches: Iterator[pa.RecordBatch], least: int = ROWS) -> Iterator[pa.Table]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= least:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


CONTEXT = pa.schema([("a", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("s", pa.int64()), ("bytes", pa.binary())])


def fetch(length: int):
    """Bytes of the surroundings; those of hot grams window by window, keyed by the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            docs, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts, wants = batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3)
            for i, (doc, tag, text) in enumerate(zip(docs, tags, texts, strict=True)):
                want = dict(zip([f.name for f in wants.type.value_type], wants[i].values.flatten(), strict=True))
                for a, flag, s, e in zip(*(want[k].to_pylist() for k in ("a", "flag", "s", "e")), strict=True):
                    if not flag:
                        out.append((a, doc, tag, s, text[s:e]))
                        continue
                    raw = np.frombuffer(text[s:e] + bytes(8), dtype=np.uint8)
                    at = np.arange(e - s - length + 1)
                    keys = Hashes(eights(raw)).of(at, at + length).view(np.int64)
                    out += [(k, doc, tag, s + j, text[s + j : s + j + length]) for j, k in enumerate(keys.tolist())]
                if len(out) >= 1 << 14:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CONTEXT.types, strict=True)], schema=CONTEXT)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), CONTEXT.types, strict=True)], schema=CONTEXT)

    return run


def suffix_array(raw: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (group, bytes from start to end), and the common prefix of each with the one before it;
    0 where the group changes. `raw` ends in 8 bytes of padding."""
    longest = int((end - start).max(initial=0))
    big = eights(raw).byteswap()
    words = []
    for j in range(0, longest, 8):
        left = end - start - j
        x = big[np.minimum(start + j, len(big) - 1)]
        cut = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
        words.append(np.where(left > 0, (x >> cut) << cut, np.uint64(0)))
    order = np.lexsort((end - start, *words[::-1], group)) if words else np.arange(0)
    common = np.zeros(len(order), dtype=np.int64)
    if len(order) > 1:
        open_ = group[order[1:]] == group[order[:-1]]
        size = np.minimum((end - start)[order[1:]], (end - start)[order[:-1]])
        for w in words:
            diff = w[order[1:]] ^ w[order[:-1]]
            same = np.full(len(diff), 8, dtype=np.int64)
            odd = np.flatnonzero(diff)
            same[odd] = 7 - np.floor(np.log2(diff[odd].astype(np.float64))).astype(np.int64) // 8
            # a float of 53 bits may round up to the next power of two; compare the byte itself
            low = same[odd]
            fix = (low < 7) & ((diff[odd] >> ((7 - np.clip(low, 0, 7)) * 8).astype(np.uint64)) == 0)
            same[odd[fix]] += 1
            same = np.maximum(same, 0)
            common[1:] += np.where(open_, same, 0)
            open_ &= same == 8
        common[1:] = np.minimum(common[1:], size)
    return order, common


def maximal_repeats(common: np.ndarray, left: np.ndarray, place: np.ndarray, least: int) -> tuple[list[int], list[int]]:
    """Stack scan over the tree of common-prefix intervals of at least `least` bytes.

    `left` is the byte before each suffix, -1 where there is none to compare; `place` its rank in the corpus; both in
    suffix order. Returns (suffix, length) for the occurrences of each maximal repeat that aren't its earliest. An
    interval hands only its earliest occurrence to the interval around it: the others have a longer repeat. Where all
    occurrences follow the same byte, the repeat that starts one byte earlier holds them.
    """
    found: list[int] = []
    length: list[int] = []
    n = len(common)
    depths = np.where(common >= least, common, 0).tolist()[1:] + [0]
    byte_of = [None if b < 0 else b for b in left.tolist()]
    place_of = place.tolist()
    stack: list[list] = [[0, [], None]]  # depth, occurrences, the byte before all of them or None

    def close(node: list) -> tuple[int, int | None]:
        depth, members, byte = node
        first = min(members, key=place_of.__getitem__)
        if byte is None:
            for m in members:
                if place_of[m] > place_of[first]:
                    found.append(m)
                    length.append(depth)
        return first, byte

    def join(node: list, member: int, byte: int | None) -> None:
        if node[0]:
            node[1].append(member)
            if node[2] != byte:
                node[2] = None

    for i in range(n):
        depth = depths[i]  # between suffix i and the next
        if depth > stack[-1][0]:
            stack.append([depth, [i], byte_of[i]])
            continue
        join(stack[-1], i, byte_of[i])
        while depth < stack[-1][0]:
            first, byte = close(stack.pop())
            if depth > stack[-1][0]:
                stack.append([depth, [first], byte])
            else:
                join(stack[-1], first, byte)
    return found, length


def repeats_of(group: np.ndarray, doc: np.ndarray, tag: np.ndarray, s: np.ndarray, texts: list[bytes], length: int):
    """Ranges (doc, tag, from, to) that repeat an earlier one, among texts that are compared within their group."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    by = np.lexsort((sizes, tag, s, doc, group))
    again = np.zeros(len(by), dtype=bool)  # repeated rows bring the same place twice
    again[1:] = np.logical_and.reduce([x[by][1:] == x[by][:-1] for x in (group, doc, s, tag, sizes)])
    by = by[~again]
    group, doc, tag, s = group[by], doc[by], tag[by], s[by]
    texts = [texts[i] for i in by.tolist()]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = first[owner] + j
    key = Hashes(eights(raw)).of(start, start + length) + mixed(group.view(np.uint64) * MIX[3])[owner]
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[back] > 1  # no other suffix has a common prefix of this length
    owner, j, start = owner[twice], j[twice], start[twice]
    if not len(owner):
        return None
    order, common = suffix_array(raw, group[owner], start, (first + sizes)[owner])
    owner, j, start = owner[order], j[order], start[order]
    at = s[owner] + j
    rank = np.lexsort((at, doc[owner]))
    step = np.r_[0, ((doc[owner][rank][1:] != doc[owner][rank][:-1]) | (at[rank][1:] != at[rank][:-1])).astype(np.int64)]
    place = np.empty(len(rank), dtype=np.int64)
    place[rank] = np.cumsum(step)
    left = np.where(j > 0, raw[np.maximum(start - 1, 0)].astype(np.int64), -1)
    found, lengths = maximal_repeats(common, left, place, length)
    if not found:
        return None
    f = np.array(found)
    return merged(doc[owner[f]], tag[owner[f]], at[f], at[f] + np.array(lengths))


def compare(length: int):
    """Maximal repeats of the surroundings of each gram; rows come sorted by gram."""

    def settle_table(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, doc, tag, s = (t.column(i).to_numpy() for i in range(4))
        found = repeats_of(a, doc, tag, s, t.column(4).to_pylist(), length)
        if found is not None:
            d, g, x, y = found
            yield rows(d, d, d, g, x, y, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for t in (big.slice(k, CONTEXTS) for big in batched(batches, CONTEXTS) for k in range(0, big.num_rows, CONTEXTS)):
            t = t if rest is None else pa.concat_tables([rest, t])
            a = t.column(0).to_numpy()
            cut = int(np.flatnonzero(a != a[-1])[-1]) + 1 if a[0] != a[-1] else 0
            if cut:
                yield from settle_table(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from settle_table(rest)

    return run


def cut_out(whole_chars: bool):
    """Texts without their removed ranges; with `whole_chars` without the rests of characters that a cut has split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, CUT_ROWS) for whole in batches for k in range(0, whole.num_rows, CUT_ROWS)):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            gone = batch.column(4)
            size, lost, spans, kept = [], [], [], []
            for i, text in enumerate(texts):
                parts, at, n = [], 0, 0
                if gone[i].is_valid and len(gone[i].values):
                    s, e = (x.to_numpy() for x in gone[i].values.flatten())
                    zero = np.zeros(len(s), dtype=np.int64)
                    _, _, s, e = merged(zero, zero, s, e)
                    for a, b in zip(s.tolist(), e.tolist(), strict=True):
                        parts.append(text[at:a])
                        at, n = b, n + 1
                parts.append(text[at:])
                left = b"".join(parts)
                size.append(len(text))
                lost.append(len(text) - len(left))
                kept.append(b"".join(p.decode("utf-8", "ignore").encode() for p in parts) if whole_chars and n else left)
                spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "rest", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def deduplicate(
    docs: DataFrame, length: int = LENGTH, hot: int = HOT, rest: list[str] | None = None, whole_chars: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, rest (a struct of the columns named), n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row."""
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.struct(*[F.col(quoted(c)) for c in rest] if rest else [F.lit(True).alias("none")]).alias("rest"),
    ).select("doc", F.xxhash64("text").alias("tag"), "text", "rest")
    found = texts.select("doc", "tag", "text").mapInArrow(lean(find_anchors(length)), ANCHOR_DDL)
    settled = written(
        found.repartition("a").sortWithinPartitions("a", "c", "doc", "s").mapInArrow(lean(settle_groups(hot)), ANCHOR_DDL), "ranges"
    )
    wanted = (
        settled.where("not done").groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("a", F.col("c").alias("flag"), "s", "e")).alias("want"))  # at most a document's own anchors
    )
    fetched = (
        texts.join(wanted.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "want", "rest")
        .mapInArrow(lean(fetch(length)), "a long, doc long, tag long, s long, bytes binary")
    )
    compared = fetched.repartition("a").sortWithinPartitions("a").mapInArrow(lean(compare(length)), ANCHOR_DDL)
    gone = (
        settled.where("done").unionByName(compared).groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("s", "e")).alias("gone"))
    )
    number = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    made = T.StructType([T.StructField("doc_id", T.LongType()), texts.schema["rest"], *number, T.StructField("kept", T.BinaryType())])
    out = (
        texts.join(gone.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "tag", "text", "rest", "gone")
        .mapInArrow(lean(cut_out(whole_chars)), made)
    )
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
