"""Language of a text by a blended-spectrum string kernel (operator 10).

A text is the set of its character n-grams of 1 to SPECTRUM characters, hashed to DIMENSIONS cells; the kernel of two texts
is the size of the sets' intersection over the root of the product of their sizes. LANDMARKS training texts span the space
(Nystroem), and one-versus-rest kernel ridge regression gives a weight per landmark and language. The kernel is a product
of presence rows, so landmarks and weights are multiplied once, to a weight per cell and language; a batch of texts is
scored by the product of its sparse presence rows with that matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import batch_of, give_back, pieces, tidy
from ._text import U, mix

#: Training texts at most, of each language an equal share, those with the least hash; and so languages at most, those of
#: most texts.
MAX_ROWS = 1600
LANDMARKS = 192
SPECTRUM = 3
DIMENSIONS = 1 << 16
RIDGE = 1e-3
#: Texts whose presence rows are made at once.
BATCH = 128


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which cells the n-grams of each text's lowered characters fall in: the cells of all texts one after the other, each
    once, and the n + 1 limits between texts."""
    lowered = [" " + t.lower() + " " for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    limits = np.cumsum([0, *map(len, lowered)])
    # each character's number is mixed once; an n-gram's is a sum with a factor for the place
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMENSIONS, np.diff(limits))
    white = (chars == 9) | (chars == 10) | (chars == 13)
    h = (np.where(white, 32, chars).astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    total, there = np.zeros(len(chars), np.uint32), np.zeros(len(texts) * DIMENSIONS, bool)
    for n in range(1, SPECTRUM + 1):
        total = total[: len(chars) - n + 1] * np.uint32(0x85EBCA6B) + h[n - 1 :] if n > 1 else h
        last = owner[n - 1 :]
        g = total ^ (total >> np.uint32(13))
        cell = ((g * np.uint32(0xC2B2AE35)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
        same = owner[: len(cell)] == last
        there[(cell + last)[same]] = True
    at = np.flatnonzero(there)
    return at % DIMENSIONS, np.searchsorted(at, np.arange(len(texts) + 1) * DIMENSIONS)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # of each cell and language
    constants: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        cells, limits = presence(texts)  # no text is without a cell
        sums = np.add.reduceat(self.weights[cells], limits[:-1], axis=0)
        return np.clip(sums / np.sqrt(np.diff(limits))[:, None] + self.constants, 0, 1)


def fit_cells(sets: list[np.ndarray], languages: list[str]) -> Model:
    """From the cells of each text."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    order = sorted(range(len(sets)), key=lambda i: (mix(np.array([int(sets[i].sum()) * 31 + len(sets[i])], np.uint64))[0], languages[i], sets[i].tobytes()))
    sets, languages = [sets[i] for i in order], [languages[i] for i in order]
    picked: list[int] = []  # landmarks in turn from each language
    own = {n: [i for i, v in enumerate(languages) if v == n] for n in names}
    for step in range(max(map(len, own.values()))):
        picked += [own[n][step] for n in names if step < len(own[n])]
    marks = np.zeros((len(picked[:LANDMARKS]), DIMENSIONS), np.float32)
    for r, i in enumerate(picked[:LANDMARKS]):
        marks[r, sets[i]] = 1 / np.sqrt(len(sets[i]))
    kernel = np.stack([marks[:, s].sum(axis=1) / np.sqrt(len(s)) for s in sets])  # of each text and landmark
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    some = values > 1e-6 * values[-1]
    to_space = vectors[:, some] / np.sqrt(values[some])
    z = kernel.astype(np.float64) @ to_space
    z = np.concatenate((z, np.ones((len(z), 1))), axis=1)
    y = np.array([[v == n for n in names] for v in languages], float)
    share = y.sum(axis=0)
    weight = (y / share).sum(axis=1) / len(names)  # languages count alike
    a = np.linalg.solve((z * weight[:, None]).T @ z + RIDGE * np.diag([1.0] * (z.shape[1] - 1) + [1e-9]), (z * weight[:, None]).T @ y)
    return Model(names, (marks.T @ (to_space @ a[:-1])).astype(np.float32), a[-1])


def fit_texts(texts: list[str], languages: list[str]) -> Model:
    return fit_cells([presence([t])[0] for t in texts], languages)


def _sample(batches):
    """Presence rows as bits, DIMENSIONS / 8 bytes for a text of any length."""
    for batch in batches:
        rows = []
        for t in batch.column("text").to_pylist():
            bits = np.zeros(DIMENSIONS, bool)
            bits[presence([t])[0]] = True
            rows.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], names=["lang", "bits"])


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most `max_rows` texts whose language is known, up to an equal number of each language: those whose hash
    of doc_id and text is least, ties in the order of the text."""
    known = docs.where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()}
    if not counts:
        return fit_texts([], [])
    each, space = max(1, max_rows // len(counts)), 1 << 30
    # shares that leave a language short once in 10^9 draws; the rest of the choice is by rank
    shares = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, (each + 6 * each**0.5 + 40) / n) * space))))
    h = F.xxhash64("doc_id", "text")
    rows = known.select("lang", "text", h.alias("h")).where(F.pmod("h", F.lit(space)) < F.element_at(shares, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    got = rows.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text").mapInArrow(tidy(_sample), "lang string, bits binary").toArrow()
    sets = [np.flatnonzero(np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8))) for b in got.column("bits")]
    model = fit_cells(sets, got.column("lang").to_pylist())
    del got, sets
    give_back()
    return model


_PREDICTIONS = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predicted(model: Model):
    def predicted(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                for at in range(0, part.num_rows, BATCH):
                    rows = part.slice(at, BATCH)
                    texts = rows.column("text").to_pylist()
                    some = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
                    names, scores = ["und"] * len(texts), [0.0] * len(texts)
                    if some and model.languages:
                        got = model.scores([texts[i] for i in some])
                        for i, k, s in zip(some, got.argmax(axis=1), got.max(axis=1)):
                            names[i], scores[i] = model.languages[k], float(s)
                    yield batch_of(_PREDICTIONS, rows.column("doc_id"), names, scores)

    return predicted


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1).

    Whole texts are scored, however long. A text that is null or has no letter is `und` at score 0, and so is each text if
    nothing was learnt; of languages with one score the first by name is taken. Null and repeated doc_ids are scored like
    others, other columns are ignored, and an empty table gives an empty one.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_predicted(model)), "doc_id long, lang_pred string, score double")


def held_out() -> "F.Column":
    """The documents that nothing is learnt from: those whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identified(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Fits on the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()), max_rows)
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
