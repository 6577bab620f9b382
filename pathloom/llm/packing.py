"""Harmonic packing of token sequences (operator 8).

A bin holds CAPACITY tokens. A piece of length n is of class k = CAPACITY div n, and a bin of class k takes exactly k
pieces of it, so that each task fills its bins alone, in one pass and with one open bin per class. Documents may be cut:
whole bins come first, then pieces of half a bin, a quarter and so on down to LEAST tokens, which fill bins of their
class to the brim; only the tail is shorter. What is open when a task's rows end goes into bins of powers of two, which
need no padding, or end to end into bins of tails.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import batch_of, pieces, tidy

CAPACITY = 1024
#: Tokens of the shortest piece that a document is cut into besides its tail.
LEAST = 64
#: Words whose ids a task keeps, about, and bytes of text that it encodes at once.
CACHE_WORDS, TEXT_BYTES = 300_000, 2 << 20

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


#: What the tokenizer may take for white space, besides what is none to it; fixed values of Unicode.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class WordIds:
    """Token ids of words, encoded by the tokenizer when first met.

    A byte-level tokenizer begins a new token group at each space before a word, so the ids of a text are those of its
    words, each with the space before it. Where that need not hold, the tokenizer encodes the whole text: where a space
    follows other white space, where a text holds an added token or a byte that only some tables call white space, and
    always if the tokenizer is not a plain byte-level one.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        pre = json.loads(self._tokenizer.to_str())["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and self._tokenizer.normalizer is None
        added = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._whole = "|".join([f"{_WHITE} ", r"[\x00\x1C-\x1F\x{85}]", *added]) if plain else ""
        size = max(self._tokenizer.get_vocab().values(), default=0) + 1
        self._opens = np.zeros(size, bool)  # which tokens begin with a space, which byte-level vocabularies write so
        self._opens[[i for t, i in self._tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self._words, self._met = pa.array([], pa.large_string()), np.zeros(0, np.int64)  # how often each was met
        self._flat, self._ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # the ids of all words, one after the other

    def _forget(self) -> None:
        """Keeps the half of the words that was met most often, of late above all."""
        kept = np.sort(np.argsort(-self._met, kind="stable")[: CACHE_WORDS // 2])
        self._flat, ends = self._ids(kept)
        self._words, self._ends, self._met = self._words.take(pa.array(kept)), ends, self._met[kept] // 2

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places, one after the other, and where each word's begin and end there."""
        start, n = self._ends[at], self._ends[at + 1] - self._ends[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        return self._flat[np.repeat(start - ends[:-1], n) + np.arange(ends[-1])], ends

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> None:
        """Adds words that it does not hold. Those that begin with a space and have no white space behind it or at their
        end are encoded end to end, many at once, and told apart by the tokens that begin with a space."""
        black = _WHITE.replace("[", "[^", 1)
        plain = pc.match_substring_regex(words, f"(?s)^ {black}(?:.*{black})?$")
        words = pa.concat_arrays([words.filter(plain), words.filter(pc.invert(plain))])
        names, n = words.to_pylist(), pc.sum(plain).as_py() or 0
        flat, ends, last = [self._flat], [self._ends], self._ends[-1]
        parts = [names[at : min(at + 100, n)] for at in range(0, n, 100)]
        for part, ids in zip(parts, self._encoded(["".join(part) for part in parts])):
            first = np.flatnonzero(self._opens[ids])
            if len(first) != len(part):
                each = self._encoded(part)
                ids, first = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            flat.append(ids)
            ends.append(last + np.append(first[1:], len(ids)))
            last += len(ids)
        for ids in self._encoded(names[n:]):
            flat.append(ids)
            last += len(ids)
            ends.append(np.array([last]))
        self._flat, self._ends, self._words = np.concatenate(flat), np.concatenate(ends), pa.concat_arrays([self._words, words])
        self._met = np.append(self._met, np.zeros(len(words), np.int64))

    def texts(self, column: pa.Array) -> list[bytes]:
        """The ids of each text, 32-bit and little-endian; null counts as empty."""
        if len(self._words) > CACHE_WORDS:
            self._forget()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(column, self._whole)
        cut = column.filter(pc.invert(whole))  # these hold no zero byte, so one can stand before each space
        lists = pc.split_pattern(pc.replace_substring(cut, " ", "\0 "), "\0")
        words, per_text = pc.list_flatten(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        at = pc.index_in(words, value_set=self._words)
        if at.null_count:
            missing = at.is_null()
            known = len(self._words)
            self._learn(pc.unique(words.filter(missing)))
            new = pc.index_in(words.filter(missing), value_set=self._words.slice(known))
            at = at.to_numpy(zero_copy_only=False)
            at[missing.to_numpy(zero_copy_only=False)] = known + new.to_numpy(zero_copy_only=False)
            at = at.astype(np.int64)
        else:
            at = at.to_numpy(zero_copy_only=False)
        self._met += np.bincount(at, minlength=len(self._met))
        flat, ends = self._ids(at)
        flat = flat.tobytes()
        limits = 4 * ends[np.concatenate(([0], np.cumsum(per_text, dtype=np.int64)))]
        found = iter([flat[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())])
        alone = iter([self._encoded([t])[0].tobytes() for t in column.filter(whole).to_pylist()])
        return [next(alone if w else found) for w in whole.to_pylist()]


@lru_cache(maxsize=1)
def _word_ids(path: str, changed: int) -> WordIds:
    """One of a worker, which lives on between its tasks, with the words that it has met."""
    return WordIds(path)


def cuts(tokens: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Lengths of a document's pieces."""
    out = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while rest and size >= least and size * 2 > least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Packer:
    """Open bins of one task: at most one per class."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next_id, self.open = capacity, first_id, {}

    def _bin(self, pieces: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for p in pieces:
            out.append((*p, self.next_id, offset))
            offset += p[2]
        self.next_id += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """piece: (doc_id, start, length, ...). The pieces of the bin that it completes, with sequence_id and offset."""
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) < k:
            return []
        del self.open[k]
        return self._bin(bin_)

    def close(self) -> list[tuple]:
        """Bins for what is still open: equal powers of two by powers of two, and tails end to end."""
        out, tails = [], []
        for k in sorted(self.open):
            rest = self.open[k]
            if len({p[2] for p in rest}) == 1 and rest[0][2] * k == self.capacity and k & (k - 1) == 0:
                while rest:
                    n = 1 << (len(rest).bit_length() - 1)
                    out += self._bin(rest[:n])
                    rest = rest[n:]
            else:
                tails += rest
        while tails:
            total, n = 0, 0
            while n < len(tails) and total + tails[n][2] <= self.capacity:
                total, n = total + tails[n][2], n + 1
            out += self._bin(tails[:n])
            tails = tails[n:]
        self.open = {}
        return out


def _pack(tokenizer: str, path: str | None):
    def pack(batches):
        import os

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        own = path
        if own is None:
            import public_tokenizers

            own = public_tokenizers.path(tokenizer)
        ids_of = _word_ids(str(own), os.stat(own).st_mtime_ns)
        packer = Packer(TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*((d, s, n, crc, t, q, o, ids) for d, s, n, ids, crc, t, q, o in rows)))
            rows.clear()
            return batch_of(_PIECES, *cols)

        for b in batches:
            for part in pieces(b, "text", TEXT_BYTES):
                for doc, own_ids in zip(part.column("doc_id").to_pylist(), ids_of.texts(part.column("text"))):
                    ids = own_ids + b"\0\0\0\0"
                    tokens, start = len(ids) // 4, 0
                    for n in cuts(tokens):
                        part_ids = ids[4 * start : 4 * (start + n)]
                        rows.extend(packer.add((doc, start, n, part_ids, zlib.crc32(part_ids), tokens)))
                        start += n
                if rows:
                    yield batch()
        rows.extend(packer.close())
        if rows:
            yield batch()

    return pack


def packed(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit, little-endian).

    A document's tokens are its text's ids and an id 0. Tasks pack their own rows, so nothing is shuffled; sequence_id
    holds the task's number in its upper half, so which pieces lie together depends on how the table is dealt. A sequence
    is padded to CAPACITY unless its length is a power of two. The tokenizer is read on the executors from `path`, or by
    its name from the installed public tokenizers; the strings of its added tokens become their ids, as it does by itself.

    Whole texts are packed, however long. A null or empty text is the id 0 alone. Null and repeated doc_ids, equal rows and
    pieces of equal length are packed like others, in the order of the table; other columns are ignored, and an empty table
    gives an empty one.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_pack(tokenizer, path)), schema)
