"""Token counts of whole texts, huge ones by overlap resynchronisation (operator 12).

A byte-pair encoder merges the pair of best score first, of equal ones the leftmost. So a merge depends on what touches it
and on nothing else, and two facts follow. A run of tokens out of an encoding is the encoding of its own characters. And a
sequence of tokens is an encoding if each two neighbours are neighbours in some encoding: the first merge across a border
would also be made where the two stand alone. Hence two encodings of overlapping chunks that have one token at the same
place can be spliced before it: the left one up to there and the right one from there on are what the whole text gives.

* A text longer than CORE characters is cut into chunks that overlap by OVERLAP characters on both sides of a border, each
  encoded with offsets by some task. The tokens that both chunks of a border have in common are looked up there, and the
  counts before the first one differ by what the border adds. Where no token is common, the text is cut anew with overlaps
  four times as wide, and in the end not at all.
* A shorter text is cut at its spaces where the vocabulary proves that no token spans them, that is, if none holds a space
  after another character. The tokens of a word are then counted once, however often the word stands in a task's texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ._common import batch_of, discard, pieces, stored, tidy
from ._text import raw

#: Characters of a chunk, and of an overlap on each side of a border.
CORE, OVERLAP = 1 << 16, 256
#: Words whose counts a task keeps, about, and bytes of text that are cut into words at once.
CACHE_WORDS, TEXT_BYTES = 300_000, 2 << 20
LIMIT = 4096

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
_CHUNKS = pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("at", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("text", pa.string())])
_ZONE = pa.list_(pa.struct([("place", pa.int64()), ("token", pa.int32())]))
_SIDES = pa.schema([("row", pa.int64()), ("border", pa.int32()), ("first", pa.bool_()), ("zone", _ZONE), ("before", pa.list_(pa.int64())), ("total", pa.int64())])


class Encoder:
    """The tokenizer of a model file and what its vocabulary proves."""

    def __init__(self, model: str, path: str | None = None) -> None:
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(model)
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pairs, self.words = self._proofs()
        self.space = int(np.diff(self.counts(["a", "a "]))[0])  # tokens of a word that is empty, behind a text's last space
        self._known, self._n = pa.array([], pa.large_string()), np.zeros(0, np.int64)

    def _proofs(self) -> tuple[bool, bool]:
        """Whether it merges pairs and leaves characters as they are, and whether no token holds a space after another
        character. Without the first fact texts are never cut."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as model
        except ImportError:
            return False, False
        m = model.ModelProto()
        m.ParseFromString(self.processor.serialized_model_proto())
        norm, kinds = m.normalizer_spec, {p.type for p in m.pieces}
        same = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
        pairs = m.trainer_spec.model_type == 2 and same and not kinds & {4, 5} and m.trainer_spec.byte_fallback  # no tokens of the user's, none unused
        return pairs, pairs and norm.add_dummy_prefix and not any("▁" in p.piece.lstrip("▁") for p in m.pieces if p.type == 1)

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.array([len(x) for x in self.processor.encode(texts, num_threads=1, return_type="numpy")], np.int64)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the places, in characters, where they begin; tokens of one character's bytes share a place."""
        out = self.processor.encode(text, return_type="offset_mapping")
        return np.array(out["ids"], np.int32), np.array([a for a, _ in out["offsets"]], np.int64)

    def totals(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not self.words:
            return self.counts(column.to_pylist())
        whole = pc.match_substring(column, "▁")  # what the encoder writes for a space
        out = np.zeros(len(column), np.int64)
        if pc.any(whole).as_py():
            out[whole.to_numpy(zero_copy_only=False)] = self.counts(column.filter(whole).to_pylist())
        return out + self._by_words(pc.if_else(whole, "", column))

    def _by_words(self, column: pa.Array) -> np.ndarray:
        """A word is what lies between two spaces that follow another character; more spaces belong to the next word. The
        encoder puts a space before a text, so a word has the tokens of a text that is this word."""
        data, limits = raw(column)
        if not len(data):
            return np.zeros(len(column), np.int64)
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 32) & (data[:-1] != 32)
        cut[limits[:-1][limits[:-1] < len(data)]] = False
        place = np.flatnonzero(cut)
        gone = np.concatenate(([0], np.cumsum(cut)))
        starts = limits[:-1][np.diff(limits) > 0]  # texts with words begin one
        bounds = np.sort(np.concatenate((starts - gone[starts], place - gone[place])))
        words = pa.LargeStringArray.from_buffers(len(bounds), pa.py_buffer(np.append(bounds, len(data) - len(place)).astype(np.int64)), pa.py_buffer(data[~cut]))
        coded = words.dictionary_encode()
        n = self._lookup(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        per_text = np.where(np.diff(limits) > 0, 1 + gone[limits[1:]] - gone[limits[:-1]], 0)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(per_text)))]
        return np.diff(ends)

    def _lookup(self, words: pa.Array) -> np.ndarray:
        if len(self._known) > CACHE_WORDS:
            self._known, self._n = self._known.slice(0, 0), self._n[:0]
        at = pc.index_in(words, value_set=self._known)
        new = at.is_null()
        if at.null_count:
            missing = words.filter(new)
            texts = missing.to_pylist()
            n = self.counts(texts)
            n[np.array([not t for t in texts])] = self.space
            at = at.to_numpy(zero_copy_only=False)
            at[new.to_numpy(zero_copy_only=False)] = len(self._n) + np.arange(len(texts))
            self._known, self._n = pa.concat_arrays([self._known, missing]), np.concatenate((self._n, n))
            return self._n[at.astype(np.int64)]
        return self._n[at.to_numpy(zero_copy_only=False)]


def _short(model: str, path: str | None):
    def short(batches):
        encoder = Encoder(model, path)
        for batch in batches:
            for part in pieces(batch, "text", TEXT_BYTES):
                yield batch_of(_COUNTS, part.column("doc_id"), part.column("n_bytes"), encoder.totals(part.column("text")))

    return short


def _chunked(core: int, overlap: int):
    """Rows of chunks: where the text begins, and the places of the borders at its left and right."""

    def chunked(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                n = max(1, -(-len(text) // core))
                for k in range(n):
                    left, right = k * core, min((k + 1) * core, len(text))
                    at = max(left - overlap, 0)
                    yield batch_of(_CHUNKS, [row], [k], [n], [at], [left], [right], [text[at : right + overlap]])

    return chunked


def _sides(model: str, path: str | None, overlap: int):
    """For each border of a chunk the tokens near it: their places, their ids and how many tokens of the chunk lie before;
    the last chunk has its number of tokens as well, at a border of its own."""

    def sides(batches):
        encoder = Encoder(model, path)
        for batch in batches:
            for row, chunk, chunks, at, left, right, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids, place = encoder.tokens(text)
                place = place + at
                fresh = np.flatnonzero(np.diff(place) > 0) + 1  # tokens that begin where no other does
                for border, here in ((chunk, left), (chunk + 1, right)):
                    if 0 < border < chunks:
                        near = fresh[np.abs(place[fresh] - here) < overlap]
                        zone = pa.array([{"place": p, "token": t} for p, t in zip(place[near].tolist(), ids[near].tolist())], _ZONE.value_type)
                        zone = pa.ListArray.from_arrays([0, len(zone)], zone)
                        yield batch_of(_SIDES, [row], [border], [border == chunk + 1], zone.cast(_ZONE), [near.tolist()], [0])
                if chunk + 1 == chunks:
                    yield batch_of(_SIDES, [row], [chunks], [True], [[]], [[]], [len(ids)])

    return sides


def _spliced(texts: DataFrame, model: str, path: str | None, core: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of long texts (row, text): the last chunk's tokens, and for each border those that the chunk before
    it has up to a common token less those that the chunk behind it has."""
    out, left = None, texts
    while True:
        chunks = left.mapInArrow(tidy(_chunked(core, overlap)), "row long, chunk int, chunks int, at long, left long, right long, text string")
        sides = chunks.repartition("row", "chunk").mapInArrow(tidy(_sides(model, path, overlap)), "row long, border int, first boolean, zone array<struct<place:long,token:int>>, before array<long>, total long")
        own = sides.groupBy("row", "border").agg(
            *(F.max(F.when(F.col("first") == first, F.struct("zone", "before"))).alias(name) for first, name in ((True, "a"), (False, "b"))), F.sum("total").alias("total"))
        common = own.select("row", "total", "a", "b", F.when(F.col("b").isNotNull(), F.array_intersect("a.zone", "b.zone")).alias("common"))
        place = lambda side: F.col(f"{side}.before")[(F.array_position(f"{side}.zone", F.col("common")[0]) - 1).cast("int")]
        gain = F.when(F.col("b").isNull(), F.col("total")).when(F.size("common") > 0, place("a") - place("b"))
        per = stored(common.select("row", gain.alias("gain")).groupBy("row").agg(F.sum("gain").alias("n_tokens"), F.bool_or(F.col("gain").isNull()).alias("apart")), "spliced")
        done = per.where("not apart").select("row", "n_tokens")
        out = done if out is None else out.unionByName(done)
        apart = per.where("apart").select("row")
        if apart.isEmpty():
            return out
        overlap *= 4
        core = max(core, 4 * overlap)
        left = texts.join(apart, "row", "left_semi")


def counted(docs: DataFrame, model: str = "piece_bpe_32k.model", path: str | None = None, limit: int = LIMIT, core: int = CORE, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Tokens are those that the model gives the whole text, without begin and end; strings like its special tokens are text.
    Texts of more than `core` bytes are cut into chunks that any task may encode, the others are counted where they are read.
    The model is read on the executors from `path`, or by its name from the installed public tokenizers. A model that merges
    no pairs, or changes characters first, is never asked for parts of a text.

    A null or empty text has no bytes and no tokens. Null and repeated doc_ids and equal rows are counted one by one, a count
    of just `limit` is not over it, other columns are ignored, and an empty table gives an empty one.
    """
    if core < 4 * overlap:
        raise ValueError("chunks must be at least four overlaps long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    long = F.col("n_bytes") > core if Encoder(model, path).pairs else F.lit(False)
    short = rows.where(~long).mapInArrow(tidy(_short(model, path)), "doc_id long, n_bytes long, n_tokens long")
    texts = stored(rows.where(long).withColumn("row", F.monotonically_increasing_id()), "long")
    whole = texts.join(_spliced(texts.select("row", "text"), model, path, core, overlap), "row").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit)
