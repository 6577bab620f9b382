"""Learned decision lists over text statistics (operator 5).

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled statistics and pruned on
the last third; the rows that it covers go, and the next rule is learnt from the rest. The list is one ordered Spark
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._common import batch_of, pieces, stored, tidy
from ._text import U, mix, raw, span_hashes, windows, words

#: Labelled rows of statistics that a list is learnt from, at most: those whose doc_id has the least hash.
MAX_ROWS = 20000
MAX_RULES, MAX_TERMS = 12, 3
#: What a rule must reach on the rows it is pruned on: share of low quality, and rows.
MIN_PRECISION, MIN_ROWS = 0.75, 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")
_STATS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS)])
_SYMBOL, _UPPER, _EXCLAIM, _NEWLINE = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_EXCLAIM[33] = True
_NEWLINE[10] = True
WINDOW = 8


def statistics(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    data, limits = raw(column)
    n = len(column)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[limits[1:]] - total[limits[:-1]]

    starts, ends, owner = words(data, limits)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[starts] += 1
    np.subtract.at(in_word, ends, 1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    # windows of one text that are found twice or more; the text is part of the key
    h, first = windows(span_hashes(data, starts, ends), owner, WINDOW)
    h = mix(h ^ (owner[first].astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    cover[first[again]] += 1
    cover[first[again] + WINDOW] -= 1
    repeated = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)
    # lines lie between limits and newlines; those with a word are compared by hash
    breaks = np.flatnonzero(_NEWLINE[data])
    line_starts = np.unique(np.concatenate((limits[:-1], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)]
    line_owner = np.searchsorted(limits, line_starts, "right") - 1
    line_ends = np.minimum(next_break, limits[line_owner + 1])
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(in_word, out=total[1:])
    some = total[line_ends] > total[line_starts]
    line_starts, line_ends, line_owner = line_starts[some], line_ends[some], line_owner[some]
    k = mix(span_hashes(data, line_starts, line_ends) ^ (line_owner.astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(k, kind="stable")
    later = order[1:][k[order][1:] == k[order][:-1]]
    return [
        np.bincount(owner, minlength=n), per_text(in_word & ((data & 0xC0) != 0x80)), per_text(_SYMBOL[data]), np.bincount(line_owner[later], minlength=n),
        repeated, np.bincount(line_owner, minlength=n), per_text(_UPPER[data]), per_text(_EXCLAIM[data]),
    ]


def _statistics(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            yield batch_of(_STATS, part.column("doc_id"), *statistics(part.column("text")))


def ratio(top: str, below: str) -> Column:
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


#: What rules may test; each is a Spark expression over COUNTS.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_length": lambda: ratio("word_chars", "n_words"),
    "symbol_share": lambda: ratio("n_symbols", "word_chars"),
    "dup_line_share": lambda: ratio("n_dup_lines", "n_lines"),
    "repeat_share": lambda: ratio("n_repeat_words", "n_words"),
    "upper_share": lambda: ratio("n_upper", "word_chars"),
    "exclaim_share": lambda: ratio("n_exclaim", "n_words"),
}


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return FEATURES[self.feature]() > self.cut if self.above else FEATURES[self.feature]() <= self.cut

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


def _covers(rule: list[Term], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Term]:
    """Adds the threshold of most information gain until no good row is covered or no threshold gains."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < MAX_TERMS and (~bad[inside]).any():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best = (1e-9, None)
        for f in FEATURES:
            v, b = x[f][inside], bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, 65)))
            order = np.argsort(v, kind="stable")
            hit = np.concatenate(([0], np.cumsum(b[order])))
            below = np.searchsorted(v[order], cuts, "right")
            for above in (False, True):
                n_in = len(v) - below if above else below
                p_in = p - hit[below] if above else hit[below]
                gain = np.where(p_in > 0, p_in * (np.log2(np.maximum(p_in, 1e-9) / np.maximum(n_in, 1)) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Term(f, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _prune(rule: list[Term], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Term]:
    """The shortest beginning of the rule with the largest (p - n) / (p + n)."""

    def worth(r: list[Term]) -> float:
        c = _covers(r, x)
        return (2 * bad[c].sum() - c.sum()) / c.sum() if c.any() else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (round(worth(r), 6), -len(r)), default=[])


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray) -> list[list[Term]]:
    """Ordered rules for low quality; `part` is true in rows that prune."""
    rules: list[list[Term]] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and bad[left & ~part].any():
        rows = left & ~part
        rule = _grow({f: v[rows] for f, v in x.items()}, bad[rows])
        rows = left & part
        rule = _prune(rule, {f: v[rows] for f, v in x.items()}, bad[rows])
        covered = _covers(rule, x) if rule else np.zeros(len(bad), bool)
        test = covered & left & part
        if test.sum() < MIN_ROWS or bad[test].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[list[Term]]) -> Column:
    """Number of the first rule that holds, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        holds = F.lit(True)
        for t in rules[k - 1]:
            holds = holds & t.column()
        out = F.when(holds, F.lit(k)).otherwise(out)
    return out


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[list[Term]]:
    """Learns from at most `max_rows` labelled rows; what reaches the driver are their numbers, not their texts."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = stats.join(F.broadcast(drawn), "doc_id")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*COUNTS), *COUNTS))  # of rows that repeat an id
    rows = rows.withColumn("at", first).where("at = 1")
    got = rows.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).alias("part"), "quality", *(e().alias(f) for f, e in FEATURES.items())).toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return []
    return learn({f: got[f].to_numpy(float) for f in FEATURES}, got["quality"].to_numpy() == 0, got["part"].to_numpy() == 0)


def rated(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, COUNTS, base_failed, kept, rule.

    Words are runs without 0x20 and 0x09-0x0D. base_failed: under 20 words, or over 30 % of the words in 8-word windows
    that the text holds twice or more. kept is false where base_failed or where a learnt rule holds; `rule` is the
    number of the first. Whole texts count, however long. A null text has no words. Without labels there are no rules; a
    doc_id with several labels counts as the worst, and one with several texts is learnt from by one of them. A value just
    at a threshold is below it. Repeated rows and null ids are rated like others, other columns are ignored, and an empty
    table gives an empty one. The same tables, however dealt, learn the same rules.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = stored(texts.mapInArrow(tidy(_statistics), ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)])), "statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("rule", verdict(fit(stats, labels, max_rows))).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:], "rule")
