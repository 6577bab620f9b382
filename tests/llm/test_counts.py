"""Centroids, token counts and phrases against brute force."""

import hashlib
import re
from collections import Counter
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pathloom.llm import centroids, collocations, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n string, lang_pred string, `row` string, piece string, phrase string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "x", "x", "x", "x", "x") for i, t, lang in rows], SCHEMA)


# centroids


def lloyd(rows, k, rounds, size, scale=64):
    kept = [(i, [floor(Fraction(x) * scale) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and abs(x) < inf for x in e)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    c = [v for _, v in (order + [r for r in kept if r[0] is None])[:k]]
    for turn in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]
        if turn < rounds:
            for j in range(len(c)):
                if mine := [v for (_, v), (_, o) in zip(kept, own) if o == j]:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    inertia = Counter()
    for d, j in own if kept else ():
        inertia[j] += d
    fits = lambda n: n if n < 1 << 63 else None
    return Counter((i, j, fits(d), fits(inertia[j]) if fits(d) is not None else None, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own if kept else ()))


def vectors(spark, rows):
    return spark.createDataFrame([(i, e and [x if x is None else float(x) for x in e], "x", 1) for i, e in rows], "vec_id long, embedding array<double>, cluster string, distance int")


def got(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("scale", [1.0, 3e5, 3e6])
def test_centroids_equal_whole_rounds(spark, scale):
    g = np.random.default_rng(5)
    rows = [(i, (g.normal(size=4) * scale + 3 * scale * (i % 3)).tolist()) for i in range(300)]
    rows += [(7, [0.0, 0, 0, 0]), (7, [0.0, 0, 0, 0]), (301, None), (302, [1.0, 2, 3]), (303, [1.0, None, 3, 4]), (304, [nan, 1, 2, 3]), (305, [inf, 1, 2, 3]), (306, []), (None, [1.0, 1, 1, 1])]
    out = centroids.clustered(vectors(spark, rows), 5, 3, 4)
    want = lloyd(rows, 5, 3, 4)
    assert got(out) == want
    total = None if any(r[3] is None for r in want) else sum(r[2] * n for r, n in want.items())
    assert {r.inertia for r in out.collect()} == {total}


def test_centroids_of_huge_numbers_ties_and_few_rows(spark):
    huge = [(1, [1e30, -1e30]), (2, [1e30, -1e30]), (3, [1.0, 2.0]), (4, [-1.0, -2.0]), (5, [0.3, 1e200]), (6, [3e7, -3e7])]
    out = got(centroids.clustered(vectors(spark, huge), 3, 3, 2))
    assert {r[:3] + r[4:] for r in out} == {r[:3] + r[4:] for r in lloyd(huge, 3, 3, 2)}
    same = [(i, [1.0, 1.0]) for i in range(8)]  # all centroids equal: the first takes all
    assert {r[1] for r in got(centroids.clustered(vectors(spark, same), 3, 3, 2))} == {0}
    assert got(centroids.clustered(vectors(spark, same[:2]), 16, 3, 2)) == lloyd(same[:2], 16, 3, 2)
    assert got(centroids.clustered(vectors(spark, []), 16, 3, 2)) == Counter()


def test_distances_are_exact_in_all_three_kinds():
    g = np.random.default_rng(1)
    for top in (1 << 20, 1 << 25, 1 << 60):
        x, c = (g.integers(-top, top, (n, 64)) for n in (20, 5))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m)) for m in c] for v in x]
        assert centroids.distances(x, c).tolist() == want


# token counts


@pytest.fixture(scope="module")
def encoder():
    return token_counts.Encoder("piece_bpe_32k.model")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aboe  \n\t▁.é中\U0001f600<s>1\0")), max_size=30), max_size=5))
def test_totals_by_words_are_the_librarys(encoder, texts):
    import pyarrow as pa

    assert encoder.totals(pa.array(texts, pa.string())).tolist() == [len(encoder.processor.encode(t)) for t in texts]


def test_token_counts_equal_the_library(spark, encoder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: (len(r.text.encode()), n, n > 4096) for r, n in zip(rows, encoder.counts([r.text for r in rows]).tolist())}
    for core, overlap in ((1 << 16, 256), (300, 20)):  # whole texts and many borders
        assert {r.doc_id: tuple(r)[1:] for r in token_counts.counted(docs, core=core, overlap=overlap).collect()} == want


def test_token_counts_where_chunks_do_not_align(spark, encoder):
    g = np.random.default_rng(2)
    texts = ["a" * 5000, "ab" * 3000, " " * 4097, "\n" * 3000, "中" * 999 + "é" * 3000, "".join(g.choice(list("ab \n中e"), 6000)), "x", "", None, "<s> </s>" * 300, "hello world " * 500, "▁" * 700, "a▁ " * 900]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "two words", "en"), (3, "\n" * 3000, "en"), (3, "\n" * 3000, "en")]
    want = Counter((i, len((t or "").encode()), n := len(encoder.processor.encode(t or "")), n > 300) for i, t, _ in rows)
    for core, overlap in ((64, 8), (1000, 50)):
        out = token_counts.counted(documents(spark, rows), limit=300, core=core, overlap=overlap)
        assert Counter(tuple(r) for r in out.collect()) == want
    assert token_counts.counted(documents(spark, [])).count() == 0


def test_no_text_is_cut_without_proof(spark, encoder, monkeypatch):
    docs = documents(spark, [(1, "some words " * 50, "en")])
    monkeypatch.setattr(token_counts.Encoder, "_proofs", lambda self: (False, False))
    assert [r.n_tokens for r in token_counts.counted(docs, core=64, overlap=8).collect()] == [len(encoder.processor.encode("some words " * 50))]


# phrases


def phrases(rows, longest, least, top):
    words, found = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    found[lang, tuple(w[i : i + m])] += 1
    out = []
    for lang in words:
        own = {p: f for (x, p), f in found.items() if x == lang and len(p) > 1 and f >= least}
        rated = []
        for p, a in own.items():
            held = any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in own.items())
            score, k = min((1000 * a * words[lang] // (found[lang, p[:k]] * found[lang, p[k:]]), k) for k in range(1, len(p)))
            if not held:
                rated.append((-score, -a, " ".join(p).encode(), found[lang, p[:k]], found[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rated)[:top])]
    return sorted(out)


def test_phrases_equal_brute_force(spark, monkeypatch):
    g = np.random.default_rng(8)
    vocabulary = ["the", "of", "a", "New", "york", "city", "état", "中", "x y", "'s", "-"]
    text = lambda: "".join(g.choice(vocabulary) + g.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for _ in range(g.integers(0, 60)))
    rows = [(i, text(), [None, "und", "en", ""][i % 4]) for i in range(300)]
    rows += [(5, "New York City is big. New York City", "en")] * 7 + [(None, None, "en"), (8, "", None), (9, " \t\n.,", "fr"), (9, "word " * 20000, "de")]
    monkeypatch.setattr(collocations, "FLUSH_BYTES", 3000)  # many counts of the same phrase
    for least, top in ((5, 2000), (8, 3)):
        assert sorted(map(tuple, collocations.mined(documents(spark, rows), 5, least, top).collect())) == phrases(rows, 5, least, top)
    assert collocations.mined(documents(spark, [])).count() == 0
    assert collocations.mined(documents(spark, [(1, None, None), (2, "", "en")])).count() == 0


def test_full_bits_and_small_buckets_change_nothing(spark, monkeypatch):
    rows = [(i, "one two three four five six", "en") for i in range(6)] + [(9, "two three. one two", None)]
    monkeypatch.setattr(collocations, "_bits_of", lambda *a: b"\xff" * 1024)  # lets all phrases through
    assert sorted(map(tuple, collocations.mined(documents(spark, rows), 5, 2, 9).collect())) == phrases(rows, 5, 2, 9)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 1 << 50
    counts = spark.createDataFrame([("en", "a", 1, big + 3), ("en", "b", 1, big + 1), ("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    monkeypatch.setattr(collocations, "counted", lambda *a: (counts, spark.createDataFrame([("en", 3 * big)], "lang string, n long")))
    assert [r.score for r in collocations.mined(counts).collect()] == [1000 * big * 3 * big // ((big + 3) * (big + 1))]


def test_split_keeps_words_only():
    import pyarrow as pa

    pieces, owner = collocations.split(pa.array(["Ab  cD,\tE", None, "", " .x\r\ny z ", "q"]))
    assert (pieces.to_pylist(), owner.tolist()) == (["ab cd", "e", "x", "y z", "q"], [0, 0, 3, 3, 4])
