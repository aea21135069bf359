"""Operator 8: quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token and the entropy of
the token distribution under a byte-level BPE made for many languages, and the
share of byte-fallback tokens under a piece vocabulary.  A text is rejected if
a measure leaves the band of its language.  The usual counts of words, symbols
and repetition stand beside them.

Tokens are computed once for each distinct word a Python worker meets and
gathered, so the cost follows the words of the corpus, not the tokenizer; the
one pass over the texts has no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import PerPiece, blocks, id_and_text, read_table, runs_hash, sum_by, word_spans, pieces_hash

#: language: (least and most characters per token, most byte-fallback share, least and most bits of token entropy).
#: Texts of fewer than MIN_TOKENS tokens have no stable entropy and only meet the first two bands.
BANDS = {
    "en": (1.75, 8.0, 0.15, 4.2, 14.0),
    "de": (1.85, 8.0, 0.15, 4.2, 14.0),
    "fr": (1.60, 8.0, 0.15, 4.2, 14.0),
    "es": (1.62, 8.0, 0.15, 4.2, 14.0),
    "*": (0.70, 12.0, 0.40, 3.0, 15.0),
}
MIN_TOKENS = 60
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True

MEASURES = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)
_ARROW = pa.schema(
    [("id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")]
    + [(n, pa.float64()) for n in ("chars_per_token", "byte_share", "token_entropy")]
)


@lru_cache(maxsize=2)
def _word_tokens(bpe_path: str, piece_path: str) -> PerPiece:
    """For each word: its piece tokens, those that are byte fallback, then its BPE ids."""
    import sentencepiece
    import tiktoken

    with open(bpe_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("many", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    is_byte = np.array([pieces.IsByte(i) for i in range(pieces.GetPieceSize())])

    def compute(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths, values = [], []
        texts = [w.decode() for w in words]
        for text, sub in zip(texts, pieces.encode(texts, num_threads=1), strict=True):
            ids = bpe.encode_ordinary(" " + text)
            values += [len(sub), int(is_byte[sub].sum()) if not text.isascii() or len(sub) > len(text) else 0, *ids]
            lengths.append(len(ids) + 2)
        return np.array(lengths, np.int64), np.array(values, np.uint32)

    return PerPiece(compute, np.uint32)


def _repeat_words(words: np.ndarray, first: np.ndarray, n: int = WINDOW) -> np.ndarray:
    """Words of each document in n-word windows that it has twice or more."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    runs = runs_hash(words, n)
    inside = doc[: len(runs)] == doc[n - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    keys = runs[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, row, count = np.unique(keys, return_inverse=True, return_counts=True)
    hit = at[count[row] > 1] if len(at) else at
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return sum_by(np.cumsum(edge[:-1]) > 0, first)


def _dup_lines(data: np.ndarray, at: np.ndarray, words_at: np.ndarray) -> np.ndarray:
    """Lines of each document that have a word and equal an earlier line of it."""
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    start = start[start < len(data)]
    end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
    end = end - (data[end - 1] == 0x0A) if len(start) else end
    full = np.searchsorted(words_at, end) > np.searchsorted(words_at, start)
    start, end = start[full], end[full]
    doc = np.searchsorted(at, start, "right") - 1
    keys = pieces_hash(data, start, end) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    return np.bincount(doc[again], minlength=len(at) - 1)


def _measure(batches: Iterator[pa.RecordBatch], bpe_path: str, piece_path: str) -> Iterator[pa.RecordBatch]:
    tokens = _word_tokens(bpe_path, piece_path)
    for batch, data, at in blocks(batches):
        start, end, first = word_spans(data, at)
        n_words = np.diff(first)
        head = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(head)])
        word_chars = sum_by(chars[end] - chars[start], first)
        row, place, values = tokens.rows(data, start, end)
        n_pieces, n_bytes = sum_by(values[place[row]], first), sum_by(values[place[row] + 1], first)
        lengths = place[row + 1] - place[row] - 2
        n_tokens = sum_by(lengths, first)
        # entropy: ids of a document are counted by sorting (document, id) pairs
        total = int(lengths.sum())
        ids = values[np.repeat(place[row] + 2 - np.cumsum(lengths) + lengths, lengths) + np.arange(total)]
        doc = np.repeat(np.arange(batch.num_rows), n_tokens)
        pair, count = np.unique(doc * (1 << 17) + ids, return_counts=True)
        weight = np.bincount(pair >> 17, weights=count * np.log2(count), minlength=batch.num_rows)
        some = np.maximum(n_tokens, 1)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *map(pa.array, (n_words, word_chars, sum_by(_IS_SYMBOL[data], at), _dup_lines(data, at, start), _repeat_words(pieces_hash(data, start, end), first), n_tokens)),
                *map(pa.array, (word_chars / some, n_bytes / np.maximum(n_pieces, 1), np.where(n_tokens > 0, np.log2(some) - weight / some, 0.0))),
            ],
            schema=_ARROW,
        )


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bpe_path: str | None = None, piece_path: str | None = None) -> DataFrame:
    """One row per text with MEASURES.

    Null and empty texts have 0 in every column; repeated rows give repeated rows; a null id stays null.
    """
    bpe = bpe_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    piece = piece_path or public_tokenizers.path("piece_bpe_32k.model")
    return id_and_text(df, id_col, text_col).mapInArrow(lambda it: _measure(it, bpe, piece), MEASURES)


def within_bands(lang: Column, bands: dict = BANDS, min_tokens: int = MIN_TOKENS) -> Column:
    """Whether a row of measures is inside the bands of its language (those of "*" if it has none or another)."""
    verdict = None
    for name, (low, high, most_bytes, low_bits, high_bits) in bands.items():
        entropy = (F.col("n_tokens") < min_tokens) | F.col("token_entropy").between(low_bits, high_bits)
        inside = F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= most_bytes) & entropy
        if name != "*":
            verdict = F.when(lang == name, inside) if verdict is None else verdict.when(lang == name, inside)
        else:
            rest = inside
    return rest if verdict is None else verdict.otherwise(rest)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict = BANDS, **paths: str) -> DataFrame:
    """Measures with base_failed (too short or too repetitive) and kept.

    Empty and null texts fail the base rules.  A null language takes the bands of "*".
    """
    # the language rides along with the id, as ids may repeat
    own = df.select(F.struct(F.col(id_col).cast("long").alias("i"), F.col(lang_col).cast("string").alias("l")).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bpe = paths.get("bpe_path") or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    piece = paths.get("piece_path") or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            langs, ids = key.field("l"), key.field("i")
            if key.offset:
                langs, ids = langs.slice(0, len(key)), ids.slice(0, len(key))
            done = 0
            for out in _measure(iter([pa.RecordBatch.from_arrays([ids, batch.column(1)], ["id", "text"])]), bpe, piece):
                yield pa.RecordBatch.from_arrays([*out.columns, langs.slice(done, out.num_rows)], [*_ARROW.names, "lang"])
                done += out.num_rows

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = own.mapInArrow(run, f"{MEASURES}, lang string")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & within_bands(F.col("lang"), bands))


def op8_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(read_table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id").drop("lang")
