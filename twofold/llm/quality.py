"""Quality rules from tokeniser fertility (operator 1).

Public vocabularies are applied to the words of a text. Three figures per document: characters per
token, the share of byte-fallback tokens, and the entropy of its tokens over the logarithm of their
number, or of ENTROPY_TOKENS if there are more (a long text uses its tokens again, whatever its script). A
document is rejected where a figure leaves the band of its language, or of its script where
the language has none. Word counts, symbols, repeated lines and repeated 5-word windows are taken as well.

Defined results: a null or empty text has no words and fails the base rule; a null or unknown language
takes the band of the text's script; ties and repeated rows are judged each by itself; very long texts
are read whole, with memory in proportion to the one text; words over BYTE_RUN characters are encoded by the byte-level
vocabulary in runs of that length; an empty table gives an empty result; other columns are not read, or pass through
`keep_good` with any names.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.bpe import CACHE_ENTRIES, SPACE, PieceModel, piece_model
from twofold.llm.common import WORD_SPACE, doc_slices, keep_rows, lean

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
WINDOW = 5
#: Odd multipliers of a 5-word window's 64-bit hash.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)

#: (least, most) characters per piece token; most share of byte fallback; least entropy ratio; least characters
#: per token of the byte-level vocabulary. Fixed values; "*" holds for any other script.
BANDS = {
    "en": (1.25, 9.0, 0.20, 0.45, 1.95),
    "de": (1.25, 9.0, 0.20, 0.45, 1.80),
    "fr": (1.25, 9.0, 0.20, 0.45, 1.75),
    "es": (1.25, 9.0, 0.20, 0.45, 1.68),
    "Latin": (1.15, 9.0, 0.25, 0.45, 0.9),
    "Cyrillic": (1.0, 9.0, 0.25, 0.45, 0.6),
    "Han": (0.25, 4.0, 0.75, 0.45, 0.3),
    "Kana": (0.25, 4.0, 0.75, 0.45, 0.3),
    "Hangul": (0.25, 4.0, 0.95, 0.40, 0.2),
    "*": (0.25, 9.0, 0.95, 0.35, 0.2),
}
ENTROPY_TOKENS = 1024
BYTE_RUN = 256

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "chars_per_token double, fallback_share double, entropy_ratio double, chars_per_byte_token double, "
    "band string, base_failed boolean, kept boolean"
)


@lru_cache(maxsize=2)
def byte_encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_byte_tokens(symbols: np.ndarray, lengths: np.ndarray, cost: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, their number for each word): each unknown symbol becomes the tokens of its UTF-8 bytes, -1 less the byte.
    `unknown` holds the code points of the unknown symbols; these never merge, so they are in order."""
    tokens = np.repeat(symbols, cost)
    raw = "".join(map(chr, unknown.tolist())).encode("utf-8", "surrogatepass")
    tokens[tokens < 0] = -1 - np.frombuffer(raw, dtype=np.uint8).astype(tokens.dtype)
    total = np.r_[0, np.cumsum(cost)]
    ends = np.cumsum(lengths)
    return tokens, total[ends] - total[ends - lengths]


class WordTokens:
    """Distinct words of a task with their tokens under both vocabularies; emptied when it has grown large."""

    def __init__(self, pieces: PieceModel, encoding):
        self.pieces, self.encoding = pieces, encoding
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.tokens = np.zeros(0, dtype=np.int32)
        self.n_symbols = self.n_tokens = self.n_fallback = self.n_bytes_tokens = np.zeros(0, dtype=np.int64)

    def add(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Word numbers of each text."""
        if len(self.index) > CACHE_ENTRIES:
            self.clear()
        at = len(self.index)
        ids = [np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]
        words = [w.decode("utf-8") for w in list(self.index)[at:]]
        for i in range(0, len(words), 1 << 16):
            part = words[i : i + (1 << 16)]
            symbols, lengths, cost = self.pieces.segment([SPACE + w for w in part])
            ends = np.cumsum(lengths)
            total, lost = np.r_[0, np.cumsum(cost)], np.r_[0, np.cumsum(np.where(symbols < 0, cost, 0))]
            encode = self.encoding.encode_ordinary  # the batch call starts a thread for each word
            byte_level = [len(encode(" " + w)) if len(w) <= BYTE_RUN else sum(len(encode(w[k : k + BYTE_RUN])) for k in range(0, len(w), BYTE_RUN)) for w in part]
            points = np.frombuffer("".join(SPACE + w for w in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            tokens, n_tokens = with_byte_tokens(symbols, lengths, cost, points[self.pieces.chars[points] < 0])
            self.tokens = np.concatenate([self.tokens, tokens])
            self.n_symbols = np.concatenate([self.n_symbols, n_tokens])
            self.n_tokens = np.concatenate([self.n_tokens, total[ends] - total[ends - lengths]])
            self.n_fallback = np.concatenate([self.n_fallback, lost[ends] - lost[ends - lengths]])
            self.n_bytes_tokens = np.concatenate([self.n_bytes_tokens, np.array(byte_level, dtype=np.int64)])
        self.starts = np.cumsum(self.n_symbols) - self.n_symbols
        return ids

    def entropy_ratio(self, ids: np.ndarray) -> float:
        """Entropy of the tokens over log2 of their number or of ENTROPY_TOKENS; 1 for fewer than two tokens."""
        lengths = self.n_symbols[ids]
        n = int(lengths.sum())
        if n < 2:
            return 1.0
        where = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(n)
        share = np.unique(self.tokens[where], return_counts=True)[1] / n
        return float(-(share * np.log2(share)).sum() / np.log2(min(n, ENTROPY_TOKENS)))


def repeat_words(ids: np.ndarray) -> int:
    """Words in 5-word windows that are found twice or more in the text."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    x = (ids.astype(np.uint64) + np.uint64(1)) * MIX[0]
    x ^= x >> np.uint64(29)
    x *= MIX[1]
    x ^= x >> np.uint64(32)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        h = (h ^ (h >> np.uint64(31))) * MIX[2] + x[j : j + n] * MIX[j]
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    twice = np.zeros(n + 1, dtype=bool)
    twice[:-1][by[1:][same]] = True
    twice[:-1][by[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[: n] += twice[:-1]
    edge[WINDOW : WINDOW + n] -= twice[:-1]
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(WORD_SPACE)]
    return len(lines) - len(set(lines))


def script_of(text: bytes) -> str:
    """Script with most letters: by lead bytes of UTF-8, without decoding."""
    n = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    counts = {
        "Latin": n[0x41:0x5B].sum() + n[0x61:0x7B].sum() + n[0xC3:0xCA].sum(), "Cyrillic": n[0xD0:0xD4].sum(),
        "Han": n[0xE4:0xEA].sum(), "Kana": n[0xE3], "Hangul": n[0xEA:0xEE].sum(),
    }
    counts["*"] = n[0xCA:0xF8].sum() - sum(int(counts[k]) for k in ("Cyrillic", "Han", "Kana", "Hangul"))
    return max(counts, key=lambda k: int(counts[k]))


def quality_metrics(
    docs: DataFrame, piece_path: str, byte_path: str, bands: dict[str, tuple] = BANDS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per input row with the base counts, the fertility figures and `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordTokens(piece_model(piece_path), byte_encoding(byte_path))
        for batch in batches:
            langs, at = batch.column(2).to_pylist(), 0
            for ids, texts in doc_slices(iter([batch])):
                rows = []
                words = [t.split() for t in texts]
                for doc_id, text, ws, nums in zip(ids, texts, words, words_of.add(words), strict=True):
                    rows.append((doc_id, *judge(text, ws, nums, langs[at], words_of, bands)))
                    at += 1
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r, strict=True)) for r in rows], schema=ARROW)

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    return picked.mapInArrow(lean(run), SCHEMA)


def judge(text: bytes, words: list[bytes], nums: np.ndarray, lang: str | None, known: WordTokens, bands: dict) -> tuple:
    n = len(words)
    chars = len(text.translate(None, WORD_SPACE + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeated = repeat_words(nums)
    tokens, fallback = int(known.n_tokens[nums].sum()), int(known.n_fallback[nums].sum())
    per_token = chars / tokens if tokens else 0.0
    per_byte_token = chars / max(int(known.n_bytes_tokens[nums].sum()), 1)
    share = fallback / tokens if tokens else 0.0
    ratio = known.entropy_ratio(nums)
    band = lang if lang in bands else script_of(text)
    least, most, most_share, least_ratio, least_byte = bands.get(band, bands["*"])
    base_failed = n < 10 or 100 * repeated > 20 * n
    fine = least <= per_token <= most and share <= most_share and ratio >= least_ratio and per_byte_token >= least_byte
    return (
        n, chars, symbols, duplicate_lines(text), repeated,
        per_token, share, ratio, per_byte_token, band, base_failed, not base_failed and fine,
    )


def keep_good(docs: DataFrame, piece_path: str, byte_path: str, bands: dict[str, tuple] = BANDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that `quality_metrics` keeps, with all their columns."""

    def maker():
        words_of = WordTokens(piece_model(piece_path), byte_encoding(byte_path))

        def judged(texts: list[bytes], langs: list[str | None]) -> list[bool]:
            words = [t.split() for t in texts]
            nums = words_of.add(words)
            return [judge(t, w, n, lang, words_of, bands)[-1] for t, w, n, lang in zip(texts, words, nums, langs, strict=True)]

        return judged

    return keep_rows(docs, maker, text_col, (lang_col,))


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema(
    [(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in SCHEMA.split(", ")]
)
