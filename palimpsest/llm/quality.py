"""Quality rules by tokeniser fertility.

Every distinct word of a piece of the table is tokenised once, on its own, by two public vocabularies: a byte-level one (for characters per token and
the entropy of tokens) and one of pieces with byte fallback (for the share of tokens that are bare bytes). A text's measures follow from its words'.
Entropy is compared at equal length: it is the mean over consecutive windows of about SPAN tokens that cover the whole text, since that of running prose levels off while its bound would go on growing.
A text is rejected whose measure leaves its language's band; languages without a band of their own use that of the script most letters have, else a wide one.

Base: repeated 8-word windows, repeated lines, symbols and word counts by the contract's definitions.

Nulls: a null or empty text has no words, so base_failed is true and kept false; its measures are null. A null language has no band of its own.
Each row is judged alone: repeated rows get equal results. Very long texts are measured whole. Other columns pass through `judge`.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoding
from .common import add_columns

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Tokens in a window of the entropy; a text is dealt evenly into windows nearest to this, one if it is shorter.
SPAN = 4000
#: What windows' hashes are mixed by.
MIXERS = (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD)
SYMBOLS = b"[#*$%&|<>]"[1:-1]
#: (least characters per token, most; most byte-fallback share; least entropy of tokens as a share of the most that so many tokens can have).
LATIN, OTHER = (1.5, 8.0, 0.10, 0.40), (0.3, 12.0, 0.60, 0.30)
BANDS = {"en": (1.90, 8.0, 0.05, 0.45), "de": (1.95, 8.0, 0.05, 0.45), "fr": (1.75, 8.0, 0.05, 0.45), "es": (1.80, 8.0, 0.05, 0.45)}
#: Scripts that a vocabulary may know little of: letters of 2 bytes give half a character a token at least, those of 3 bytes a third; bare bytes are no flaw there, flat or endlessly repeated tokens are.
TWO_BYTES, THREE_BYTES = (0.45, 8.0, 0.95, 0.35), (0.30, 6.0, 0.98, 0.30)
SCRIPTS = [
    ("latin", re.compile(r"[A-Za-zÀ-ɏ]"), LATIN),
    ("cyrillic", re.compile(r"[Ѐ-ԯ]"), TWO_BYTES),
    ("greek", re.compile(r"[Ͱ-Ͽἀ-῿]"), TWO_BYTES),
    ("hebrew", re.compile(r"[֐-׿]"), TWO_BYTES),
    ("arabic", re.compile(r"[؀-ۿݐ-ݿ]"), TWO_BYTES),
    ("devanagari", re.compile(r"[ऀ-ॿ]"), THREE_BYTES),
    ("thai", re.compile(r"[฀-๿]"), THREE_BYTES),
    ("hangul", re.compile(r"[가-힣ᄀ-ᇿ]"), THREE_BYTES),
    ("han", re.compile(r"[㐀-鿿぀-ヿ]"), THREE_BYTES),
]

FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, chars_per_token double, fallback_share double, token_entropy double, kept boolean"


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken"):
    """A byte-level vocabulary, read once a worker; encoding uses the same."""
    return encoding(name)


def _path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class _Numbers(dict):
    """word -> number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def repeated(ids: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words lie in a window of `window` words that its text has twice or more. ids: all texts' words; starts: where texts begin, and the end."""
    n = len(ids)
    covered = np.zeros(n + 1, np.int64)
    if n >= window:
        lengths = np.diff(starts)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(MIXERS[0])
        mixed ^= mixed >> np.uint64(29)
        h = doc.astype(np.uint64)[at] * np.uint64(MIXERS[1])
        for j in range(window):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(MIXERS[1]) + mixed[at + j]
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = h[order][1:] == h[order][:-1]
        a, b = at[order][1:][same[1:]], at[order][:-1][same[1:]]
        if any((ids[a + j] != ids[b + j]).any() for j in range(window)) or (doc[a] != doc[b]).any():  # two windows share a hash: compare the words
            rows = np.stack([doc[at], *(ids[at + j] for j in range(window))], 1)
            _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            hit = at[counts[inverse.ravel()] > 1]
        else:
            hit = np.union1d(a, b)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
    return np.cumsum(covered)[:n] > 0


def dup_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


class Fertility:
    """Measures words by the two vocabularies."""

    def __init__(self, bytes_name: str = "byte_bpe_multi_50k.tiktoken", pieces_name: str = "piece_bpe_32k.model"):
        import sentencepiece

        self.tokens = vocabulary(bytes_name)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=_path(pieces_name))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])

    def measure(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word: tokens of the byte-level vocabulary (all, and how many), pieces, pieces that are bytes."""
        encode = self.tokens.encode_ordinary
        ids = [encode(" " + w) for w in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))
        pieces = self.pieces.encode(words, num_threads=1) if words else []
        m = np.fromiter(map(len, pieces), np.int64, len(pieces))
        byte = self.is_byte[np.fromiter((i for x in pieces for i in x), np.int32, int(m.sum()))]
        return flat, n, m, _sums(byte, np.concatenate([[0], np.cumsum(m)]))


@functools.cache
def fertility() -> Fertility:
    """Both vocabularies, once a worker and not once a task."""
    return Fertility()


def entropy_share(flat: np.ndarray, starts: np.ndarray, words: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """For each text the mean, over all its tokens' windows, of a window's entropy over the logarithm of its length; 1 for a single token."""
    out = np.ones(len(word_starts) - 1)
    for d in range(len(out)):
        w = words[word_starts[d] : word_starts[d + 1]]
        n = starts[w + 1] - starts[w]
        total = int(n.sum())
        if total > 1:
            at = np.repeat(starts[w] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
            k = max(1, round(total / SPAN))
            window = np.arange(total) * k // total
            ids = np.sort((window << 32) + flat[at])
            edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
            c, size = np.diff(edges), np.bincount(window)
            lost = np.bincount(ids[edges[:-1]] >> 32, c * np.log(c), k)
            out[d] = max(0.0, float((size - lost / np.log(size)).sum() / total))
    return out


def band_of(lang: str | None, text: bytes, bands: dict = BANDS) -> tuple:
    if lang in bands:
        return bands[lang]
    letters = [c for c in text.decode("utf-8", "replace") if c.isalpha()]
    for _, letter, band in SCRIPTS:
        if letters and sum(1 for c in letters if letter.match(c)) > 0.5 * len(letters):
            return band
    return OTHER


def measure_texts(texts: list[bytes], langs: list[str | None], fertility: Fertility, bands: dict = BANDS) -> list:
    """The columns of FIELDS."""
    import pyarrow as pa

    split = [t.split() for t in texts]
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
    numbers = _Numbers()
    ids = np.fromiter((numbers[w] for ws in split for w in ws), np.int64, int(starts[-1]))
    distinct = [w.decode("utf-8", "replace") for w in numbers]
    n_words = np.diff(starts)
    chars = np.fromiter(map(len, distinct), np.int64, len(distinct))
    symbols = np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in numbers), np.int64, len(numbers))
    flat, n_tokens, n_pieces, n_bytes = fertility.measure(distinct)
    word_chars, tokens, pieces, fallback = (_sums(x[ids] if len(ids) else ids, starts) for x in (chars, n_tokens, n_pieces, n_bytes))
    repeat = _sums(repeated(ids, starts), starts)
    entropy = entropy_share(flat, np.concatenate([[0], np.cumsum(n_tokens)]), ids, starts)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    with np.errstate(all="ignore"):
        per_token, share = word_chars / tokens, fallback / pieces
    kept = ~failed
    for d in np.flatnonzero(kept):
        low, high, bare, flatness = band_of(langs[d], texts[d], bands)
        kept[d] = low <= per_token[d] <= high and share[d] <= bare and entropy[d] >= flatness
    none = n_words == 0
    return [
        *map(pa.array, (n_words, word_chars, _sums(symbols[ids] if len(ids) else ids, starts), np.fromiter(map(dup_lines, texts), np.int64, len(texts)), repeat, failed)),
        *[pa.array(x, mask=none) for x in (per_token, share, entropy)],
        pa.array(kept),
    ]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", bands: dict = BANDS) -> DataFrame:
    """docs with FIELDS."""

    def make(texts, langs):
        return measure_texts(texts.to_pylist(), langs.to_pylist(), fertility(), bands)

    return add_columns(docs, FIELDS, make, text, (lang,))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", *[f.split()[0] for f in FIELDS.split(", ")])
