"""Severity of toxicity by cumulative-link ordinal regression over sparse text features (operator 2).

Features are the words of a text and their first bytes, lowered, each with the square root of its share of the words;
sub-words let the model know an insult's stem in words it has not seen. One weight vector serves all grades, and ordered
thresholds cut its score: P(grade > k) = 1 / (1 + exp(threshold_k - score)). The sum of these is the expected severity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._common import batch_of, pieces, tidy
from ._text import raw, runs, span_hashes

#: Labelled rows that a model is fitted on, at most: those whose doc_id has the least hash, a text for each.
MAX_ROWS = 5000
#: Bytes of the word beginnings that are features beside whole words.
PREFIXES = (5, 6, 7)
#: Features a model keeps, those that tell the labels apart best.
MAX_FEATURES = 1500
#: Texts of the sample that a feature must be in.
MIN_TEXTS = 5
GRADES = 4

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def occurrences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and feature hash of each occurrence, and the number of words of each text."""
    data, limits = raw(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends = runs(_LETTER[data], limits)
    owner = np.searchsorted(limits, starts, "right") - 1
    owners, found = [owner], [span_hashes(data, starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        owners.append(owner[long])
        found.append(span_hashes(data, starts[long], starts[long] + n))
    return np.concatenate(owners), np.concatenate(found), np.bincount(owner, minlength=len(column))


def _value(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, 0.15 + 3.5 * np.sqrt(count / np.maximum(n_words, 1)))


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and k."""
        owner, found, n_words = occurrences(column)
        table = np.zeros(1 << 20, bool)
        table[self.features & np.uint64((1 << 20) - 1)] = True
        some = table[found & np.uint64((1 << 20) - 1)]
        owner, found = owner[some], found[some]
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        some = self.features[at] == found if len(self.features) else np.zeros(0, bool)
        cell, count = np.unique(owner[some] * len(self.features) + at[some], return_counts=True)
        texts, which = cell // max(1, len(self.features)), cell % max(1, len(self.features))
        z = np.bincount(texts, _value(count, n_words[texts]) * self.weights[which], minlength=len(column))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


_SAMPLE = pa.schema([("toxic", pa.int32()), ("hashes", pa.binary()), ("values", pa.binary())])


def _sample(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            owner, found, n_words = occurrences(part.column("text"))
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            at = np.searchsorted(owner, np.arange(part.num_rows + 1))
            hashes, values = [], []
            for i in range(part.num_rows):
                h, count = np.unique(found[at[i] : at[i + 1]], return_counts=True)
                hashes.append(h.tobytes())
                values.append(_value(count, n_words[i]).astype(np.float32).tobytes())
            yield batch_of(_SAMPLE, part.column("toxic").cast(pa.int32()), hashes, values)


_MODEL = pa.schema([("features", pa.binary()), ("weights", pa.binary()), ("thresholds", pa.binary())])


def _fitted(batches):
    toxic, hashes, values = [], [], []
    for batch in batches:
        toxic += batch.column("toxic").to_pylist()
        hashes += [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("hashes")]
        values += [np.frombuffer(v.as_buffer(), np.float32) for v in batch.column("values")]
    model = fit_sample(np.array(toxic, np.int64), hashes, values)
    yield batch_of(_MODEL, [model.features.astype(np.uint64).tobytes()], [model.weights.tobytes()], [model.thresholds.tobytes()])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most `max_rows` labelled texts, in one task that sees no other texts; the driver gets the model alone, of at
    most MAX_FEATURES weights. Labels say toxic or not; grades of toxic texts are the terciles of how dense the features are
    that most set toxic texts apart."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))  # of rows that repeat an id
    rows = rows.withColumn("at", first).where("at = 1").select("text", "toxic")
    sample = rows.mapInArrow(tidy(_sample), "toxic int, hashes binary, values binary")
    got = sample.repartition(1).mapInArrow(tidy(_fitted), "features binary, weights binary, thresholds binary").collect()
    if not got:  # no task ran, as there was nothing to learn from
        return fit_sample(np.zeros(0, np.int64), [], [])
    return Model(np.frombuffer(got[0].features, np.uint64), np.frombuffer(got[0].weights, np.float64), np.frombuffer(got[0].thresholds, np.float64))


#: Places that features are summed at first, before the few that matter are told apart by their whole hash.
_PLACES = np.uint64((1 << 22) - 1)


def _likely(toxic: np.ndarray, hashes: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Which places hold features that tell the labels apart, twice as many as are kept; in memory of a fixed size."""
    size = int(_PLACES) + 1
    texts, sums, square = np.zeros(size, np.int32), np.zeros((2, size), np.float32), np.zeros(size, np.float32)
    for t, h, v in zip(toxic, hashes, values):
        place = (h & _PLACES).astype(np.int64)
        texts[place] += 1
        sums[int(t > 0), place] += v
        square[place] += v * v
    bad = max(1, int((toxic > 0).sum()))
    gap = np.abs(sums[1] / bad - sums[0] / max(1, len(toxic) - bad)) / np.sqrt(square / len(toxic) + 1e-4)
    gap[texts < MIN_TEXTS] = 0
    out = np.zeros(size, bool)
    out[np.argpartition(-gap, 2 * MAX_FEATURES)[: 2 * MAX_FEATURES]] = True
    return out


def fit_sample(toxic: np.ndarray, hashes: list[np.ndarray], values: list[np.ndarray], rounds: int = 400, penalty: float = 3e-5) -> Model:
    n = len(toxic)
    if n == 0 or toxic.min() == toxic.max() or not sum(map(len, hashes)):
        nothing = np.zeros(0)
        return Model(np.zeros(0, np.uint64), nothing, np.full(GRADES - 1, 50.0 if n == 0 or not toxic.any() else -50.0))
    # the same sample fits the same model
    order = sorted(range(n), key=lambda i: (int(toxic[i]), len(hashes[i]), int(hashes[i].sum(dtype=np.uint64))))
    toxic, hashes, values = toxic[order], [hashes[i] for i in order], [values[i] for i in order]
    likely = _likely(toxic, hashes, values)
    keep = [likely[h & _PLACES] for h in hashes]
    names, column = np.unique(np.concatenate([h[k] for h, k in zip(hashes, keep)]), return_inverse=True)
    row, value = np.repeat(np.arange(n), [int(k.sum()) for k in keep]), np.concatenate([v[k] for v, k in zip(values, keep)]).astype(np.float64)
    texts = np.bincount(column, minlength=len(names))
    on = toxic[row] > 0
    mean = [np.bincount(column[m], value[m], minlength=len(names)) / max(1, (toxic == c).sum()) for c, m in ((0, ~on), (1, on))]
    square = np.bincount(column, value**2, minlength=len(names)) / n
    gap = (mean[1] - mean[0]) / np.sqrt(square + 1e-4)
    gap[texts < MIN_TEXTS] = 0
    best = np.argsort(-np.abs(gap), kind="stable")[:MAX_FEATURES]
    best = np.sort(best[texts[best] >= MIN_TEXTS])
    if not len(best):  # no feature is in texts enough: what is known is the share of toxic ones
        rate = np.mean(toxic > 0) * np.arange(GRADES - 1, 0, -1) / (GRADES - 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.log((1 - rate) / rate))
    place = np.full(len(names), -1)
    place[best] = np.arange(len(best))
    some = place[column] >= 0
    x = np.zeros((n, len(best)), np.float32)
    x[row[some], place[column[some]]] = value[some]
    marks = gap[best] > np.sort(gap[best])[-min(50, len(best))] - 1e-12
    dense = (x[:, marks] ** 2).sum(axis=1)
    grade = np.zeros(n, np.int64)
    if len(bad := np.flatnonzero(toxic > 0)):
        grade[bad] = 1 + np.searchsorted(np.quantile(dense[bad], [1 / 3, 2 / 3]), dense[bad], "left")
    # Adam steps; the thresholds are a first one and the logarithms of the gaps that follow
    v, k = np.concatenate((np.zeros(len(best)), [2.0, *([0.0] * (GRADES - 2))])), len(best)
    m1, m2 = np.zeros_like(v), np.zeros_like(v)
    for step in range(1, rounds + 1):
        w, t = v[:k], v[k:]
        theta = np.concatenate((t[:1], t[0] + np.cumsum(np.exp(t[1:]))))
        z = x @ w.astype(np.float32)
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -30, 30)))  # P(grade > k)
        full = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
        p = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
        ds = np.zeros_like(full)
        ds[np.arange(n), grade] += 1 / p
        ds[np.arange(n), grade + 1] -= 1 / p
        dz = -(ds[:, 1:-1] * s * (1 - s)) / n  # of the mean loss, by z - theta_k
        gtheta = -dz.sum(axis=0)
        g = np.concatenate((x.T @ dz.sum(axis=1).astype(np.float32) + penalty * w, [gtheta.sum()], np.exp(t[1:]) * gtheta[1:][::-1].cumsum()[::-1]))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g**2
        v = v - 0.1 * (1 - step / (rounds + 1)) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w, t = v[:k], v[k:]
    return Model(names[best], w, np.concatenate((t[:1], t[0] + np.cumsum(np.exp(t[1:])))))


_SCORES = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32())])


def _scored(model: Model):
    def scored(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                p = model.score(part.column("text"))
                p[np.array(part.column("text").is_null())] = 0
                yield batch_of(_SCORES, part.column("doc_id"), p.sum(axis=1), p[:, 0], (p >= 0.5).sum(axis=1))

    return scored


def severity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, expected_severity (0 to 3), p_toxic, grade (0 to 3) and toxic (p_toxic >= 0.5).

    Whole texts are scored. A null text scores 0; a text without words gets the base rate. Labels that are null are not
    learnt from; with no labels of one of the two kinds the model holds what all labels say, without any label nothing is
    toxic, and where no feature is in MIN_TEXTS labelled texts the score is their share of toxic ones. A doc_id with
    several labels counts as the most toxic, and one with several texts is learnt from by one of them. p_toxic of just 0.5
    is toxic. Repeated rows and null ids are scored like others, other columns are ignored, and an empty table gives an
    empty one. The same tables, however dealt, fit the same model.
    """
    model = fit(docs, labels, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_scored(model)), "doc_id long, expected_severity double, p_toxic double, grade int")
    return rows.withColumn("toxic", F.col("p_toxic") >= 0.5)


def _clean(model: Model):
    def clean(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                p = model.score(part.column("text"))[:, 0]
                yield part.filter(pa.array((p < 0.5) | np.array(part.column("text").is_null())))

    return clean


def clean(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs without the rows that `severity` calls toxic; all columns stay, null texts and an empty table too."""
    return docs.mapInArrow(tidy(_clean(fit(docs, labels, max_rows))), docs.schema)
