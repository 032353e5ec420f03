"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of all words that are not yet known are laid out in one flat array.
Each round looks every adjacent pair up in the sorted array of pair keys by
binary search, finds the lowest rank of each word, and merges all occurrences
of that pair, left to right.  Words without a mergeable pair leave the array.
Encoded words are remembered per process, up to a bound that changes no result.

Defined results: null text encodes as the empty text (no ids); the string of an
added special token becomes that token's single id, as the tokenizers library
does by default; decoding replaces invalid UTF-8 by U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Words that one process remembers; when full, it starts anew.
CACHE_WORDS = 400_000
#: Words longer than this (in bytes) are encoded but not remembered.
CACHE_WORD_BYTES = 64
_NO_RANK = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    """Path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranges(categories: str, top: int) -> str:
    """Character-class text of all code points up to top whose general category starts with one of the letters."""
    out, begin = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] in categories
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"{re.escape(chr(begin))}-{re.escape(chr(c - 1))}")
            begin = None
    return "".join(out)


#: The code points with the White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=3)
def word_pattern(top: int) -> re.Pattern:
    """The byte-level splitter for texts whose largest code point is at most top."""
    letters, numbers = _ranges("L", top), _ranges("N", top)
    return re.compile(
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


def split_words(text: str) -> list[str]:
    if text.isascii():
        return word_pattern(0x7F).findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return word_pattern(sys.maxunicode).findall(text)
    return word_pattern(0xFF).findall(text)


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.pair_ids = keys[order], order.astype(np.int32), merged[order]
        lengths = np.array([len(x) for x in self.pieces], np.int64)
        self.piece_bytes, self.piece_len = np.frombuffer(b"".join(self.pieces), np.uint8), lengths
        self.piece_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    # -- merge rounds ------------------------------------------------------

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one array, number of ids of each word); words are not empty.

        The rank of a pair is looked up once, and again only when a merge changed one of its sides.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        place = np.full(len(symbols), -1, np.int32)
        self._look_up(symbols, place, np.flatnonzero(~last))
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.where(place >= 0, self.pair_ranks[place], _NO_RANK)
            first = np.flatnonzero(np.concatenate(([True], last[:-1])))
            sizes = np.diff(np.append(first, len(symbols)))
            per_symbol = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = per_symbol == _NO_RANK
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
            t = np.flatnonzero((rank == per_symbol) & ~over)
            # overlapping occurrences (x x x): every second one from the left of each run
            if len(t) > 1:
                begins = np.concatenate(([True], np.diff(t) != 1))
                if not begins.all():
                    run = np.maximum.accumulate(np.where(begins, np.arange(len(t)), 0))
                    t = t[(np.arange(len(t)) - run) % 2 == 0]
            symbols[t] = self.pair_ids[place[t]]
            last[t] = last[t + 1]
            keep = ~over
            keep[t + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[t] = True
            symbols, word, last, place, changed = symbols[keep], word[keep], last[keep], place[keep], changed[keep]
            t = np.flatnonzero(changed)
            place[t] = -1
            before = t[t > 0] - 1
            before = before[~last[before]]
            place[before] = -1
            self._look_up(symbols, place, t[~last[t]])
            self._look_up(symbols, place, before)
        if not done_symbols:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        ids, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _look_up(self, symbols: np.ndarray, place: np.ndarray, t: np.ndarray) -> None:
        """Sets place[t] to where the pair (t, t + 1) stands in the sorted keys, if it does."""
        if not len(self.pair_keys) or not len(t):
            return
        keys = (symbols[t] << 32) | symbols[t + 1]
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        place[t] = np.where(self.pair_keys[at] == keys, at, -1)

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.merge_words([w.encode("utf-8", "surrogatepass") for w in words])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.known) + len(words) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        n = len(self.known)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.length[n : n + len(words)] = counts
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words))))

    # -- texts ---------------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text."""
        split: list[list[str]] = []
        for text in texts:
            if not text:
                split.append([])
            elif self.special_pattern and self.special_pattern.search(text):
                parts = self.special_pattern.split(text)
                split.append(list(chain.from_iterable([p] if k % 2 else split_words(p) for k, p in enumerate(parts))))
            else:
                split.append(split_words(text))
        if len(self.known) > CACHE_WORDS:
            self._reset()
        known = self.known
        fresh = {w for w in set(chain.from_iterable(split)) if w not in known}
        special = fresh & self.special.keys()
        fresh -= special
        if fresh:
            self._learn(sorted(fresh))
        for w in sorted(special):
            self._learn_special(w)
        for words in split:
            if not words:
                yield np.zeros(0, np.uint32)
                continue
            index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            yield _gather(self.flat, self.start[index], self.length[index])
        for w in [w for w in fresh if len(w) > CACHE_WORD_BYTES]:
            if self.used > 16 * CACHE_WORDS:
                self._reset()
            break

    def _learn_special(self, w: str) -> None:
        n = len(self.known)
        if n + 1 > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length))
        if self.used + 1 > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used], self.start[n], self.length[n] = self.special[w], self.used, 1
        self.used += 1
        self.known[w] = n

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return _gather(self.piece_bytes, self.piece_start[ids], self.piece_len[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    step = np.repeat(start - (ends - length), length)
    step += np.arange(total)
    return flat[step]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """One per process."""
    return ByteBPE(path)


def slices(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about ``most`` bytes of text each (one row at least)."""
    sizes = np.array([s or 0 for s in pc.binary_length(batch.column(text)).to_pylist()], np.int64)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def ids_text(ids: np.ndarray) -> bytes:
    """Decimal ids joined by commas."""
    return ",".join(map(str, ids.tolist())).encode()


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Digest of every row's ids and of the text decoded from them: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        bpe = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, 1):
                n, digest, decoded = [], [], []
                for ids in bpe.encode_batch(batch.column(1).to_pylist()):
                    n.append(len(ids))
                    digest.append(hashlib.sha256(ids_text(ids)).hexdigest())
                    raw = bpe.decode_bytes(ids)
                    try:
                        raw.decode()
                    except UnicodeDecodeError:
                        raw = raw.decode("utf-8", "replace").encode()
                    decoded.append(hashlib.sha256(raw).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
