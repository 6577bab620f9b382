"""Each operator against a brute-force version on small tables, and on what a table may hold at worst."""

import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.llm import _components, embedding_dedup, langid, license_scan, line_dedup, minhash_dedup, mixing, packing, quality_rules, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, size string, `key` string, row string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, names that clash."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base + " indeed", "en", None), (4, "", "en", "b"), (5, None, "de", "b"), (None, base, None, "a"), (6, LONG, "en", "c"), (6, LONG, "en", "c"),
            (7, "one two", None, "c"), (8, "one two", None, "c"), (9, " \n\t ", "fr", ""), (10, "123 456", "fr", "b"), (11, "A  b   c\n\n d", "en", "a")]
    return spark.createDataFrame([(*r, 5, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def united(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 400)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    got = {r[0]: r[1] for r in _components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 401)}, **{i: 1000 for i in range(1000, 1400)}}


def test_minhash_equals_brute_force(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    base = " ".join(f"t{i}" for i in range(200)).split()
    for k in range(60):  # near copies of one text, each with its own changes: links lead through the group
        w = list(base)
        for j in range(k % 4):
            w[(37 * k + 50 * j) % 200] = f"c{k}-{j}"
        rows[100000 + k] = " ".join(w)
    sets = {i: shingle_set(t) for i, t in rows.items()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = united(ids, links)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_estimate_is_near():
    g = np.random.default_rng(1)
    a = np.sort(g.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2))
    b = np.sort(np.concatenate((a[:1500], g.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))))
    s = minhash_dedup.signatures([a, b])
    got, used = minhash_dedup.estimate(s[0], s[1], 2000, 2000)
    assert used == 256 and abs(got - 0.6) < 0.12


@pytest.mark.parametrize("union", [7, 14, 27, 54, 300])
def test_minhash_finds_near_copies_of_short_texts(union):
    """Pairs at Jaccard 0.85 or just above share a band, however few shingles they have."""
    g, differ, a, b = np.random.default_rng(union), 15 * union // 100, [], []
    for k in range(4000):
        h = g.permutation(np.unique(g.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)))
        a.append(np.sort(h[k % (differ + 1) :]))
        b.append(np.sort(np.concatenate((h[: k % (differ + 1)], h[differ:]))))
    x, y = (minhash_dedup.signatures(s) for s in (a, b))
    n = [np.array([len(v) for v in s]) for s in (a, b)]
    shared = (minhash_dedup.band_keys(x) == minhash_dedup.band_keys(y)).any(axis=1)
    assert (~(shared & minhash_dedup._passes(x, y, *n, 0.85))).sum() <= 2


def test_minhash_on_odd_tables(odd, empty):
    got = sorted(minhash_dedup.near_duplicates(odd).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    by = {r.doc_id: r for r in got}
    assert len(got) == 13 and by[2].component_id == 1 and by[3].component_id == 1 and by[None].component_id is None and by[None].kept
    assert by[4].n_shingles == 0 and by[5].kept and by[8].component_id == 7 and by[7].n_shingles == 1
    assert minhash_dedup.near_duplicates(empty).count() == 0
    left = minhash_dedup.deduplicated(odd)
    assert left.columns == odd.columns and left.where("doc_id in (2, 3, 8)").count() == 0


def test_embeddings_equal_brute_force(spark):
    g = np.random.default_rng(3)
    base = g.standard_normal((150, 24))
    near = [base[i % 40] + 0.03 * g.standard_normal(24) for i in range(120)]
    x = np.concatenate((base, near, base[:30])).astype(np.float32)
    rows = [(i, v.tolist(), i % 3 if i % 50 else None) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None] * 24, 1), (904, [], 1), (None, x[0].tolist(), 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = [r[2] for r in rows[: len(x)]]
    links = [(i, j) for i in range(len(x)) for j in range(i) if label[i] is not None and label[i] == label[j] and n[i] @ n[j] >= 0.98]
    count = Counter(i for pair in links for i in pair)
    assert len(links) > 30 and {i: got[i].n_links for i in range(len(x))} == {i: count[i] for i in range(len(x))}
    assert {i: got[i].component_id for i in range(len(x))} == united(range(len(x)), links)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 905)) and got[None].kept
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(none).count() == 0


def test_codes_estimate_without_bias():
    g = np.random.default_rng(5)
    a, b = g.standard_normal((40, 64)), g.standard_normal((40, 64))
    turn = embedding_dedup.rotations(64, 64)
    ta, tb = ((v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn for v in (a, b))
    code = np.where(ta > 0, 1, -1) / 8
    guess = code @ tb.T / (code * ta).sum(axis=1)[:, None]
    assert abs((guess - ta @ tb.T).mean()) < 0.01
    near = embedding_dedup.linked(a, a + 0.01, 0.98)
    assert near.diagonal().all() and near.sum() == 40


def test_toxicity_learns_and_takes_odd_tables(spark, odd, empty):
    g = np.random.default_rng(2)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = list(g.choice(words, 60))
        if i % 6 == 0:
            for k in range(1 + i % 5):
                w[7 * k] = f"vilestem{'abcdefghij'[int(g.integers(10))]}"
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(i, t) for i, _, t in rows if i % 2 == 0] + [(1, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.severity(d, lab).collect()}
    held = [(got[i].toxic, bool(t)) for i, _, t in rows if i % 2]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.expected_severity <= 3 and r.grade <= 3 for r in got.values())
    out = toxicity.severity(odd, lab).collect()
    assert len(out) == 13 and [r for r in out if r.doc_id == 5][0].expected_severity == 0
    assert toxicity.severity(empty, lab).count() == 0 and toxicity.severity(odd, lab.where("false")).where("toxic").count() == 0
    assert toxicity.clean(odd, lab).columns == odd.columns


def statistics(text):
    w, lines, seen, dup = WORD.findall(text or ""), (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(runs)
    cover = {k for i, r in enumerate(runs) if many[r] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_statistics_equal_brute_force(spark, docs, labels, odd, empty):
    for table in (docs, odd):
        texts = Counter((r.doc_id, *statistics(r.text)) for r in table.collect())
        got = quality_rules.rated(table, labels).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert quality_rules.rated(empty, labels).count() == 0 and quality_rules.rated(odd, labels.where("false")).count() == 13


def test_rules_are_learnt_and_pruned():
    g = np.random.default_rng(4)
    x = {f: g.random(3000) for f in quality_rules.FEATURES}
    bad = (x["symbol_share"] > 0.8) & (x["word_length"] <= 0.7)
    rules = quality_rules.learn(x, bad, np.arange(3000) % 3 == 0)
    covered = np.any([quality_rules._covers(r, x) for r in rules], axis=0)
    assert (covered == bad).mean() > 0.98 and {t.feature for t in rules[0]} == {"symbol_share", "word_length"}


def chunks(text):
    xxhash = pytest.importorskip("xxhash")
    lines, mask = text.split("\n"), (1 << 64) - 1
    h, starts = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines], []
    for i in range(len(lines)):
        r = 0
        for k in range(line_dedup.WINDOW):
            v = h[i - 1 - k] if i - 1 - k >= 0 else 0
            r ^= ((v << k) | (v >> (64 - k))) & mask if k else v
        r -= (1 << 64) * (r >> 63)
        if i == 0 or max(len(lines[i]), len(lines[i - 1])) >= line_dedup.LONG or r % line_dedup.DIVISOR == 0:
            starts.append(i)
    return [(b - a, "\n".join(lines[a:b])) for a, b in pairwise([*starts, len(lines)])]


def test_line_dedup_equals_brute_force(spark, docs, odd, empty):
    rows = {r.doc_id: r.text for r in docs.collect()}
    passage = "\n".join(f"line {k} of a passage that many have" for k in range(12))
    rows |= {5000 + k: f"begin {k}\n{passage}\nend {k}\n{'long ' * 60}" for k in range(20)}
    cut, first, count = {i: chunks(t) for i, t in rows.items()}, {}, Counter()
    for i in sorted(cut):
        for k, (n, body) in enumerate(cut[i]):
            if (n > 1 or len(body) >= line_dedup.LONG) and body.strip(" "):
                count[body] += 1
                first.setdefault(body, (i, k))
    want = {i: "\n".join(b for k, (n, b) in enumerate(c) if not (count[b] > 1 and first[b] != (i, k))) for i, c in cut.items()}
    got = line_dedup.deduplicated(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert sum(r.removed_lines for r in got if r.doc_id > 5000) > 19 * 6
    out = {r.doc_id: r for r in line_dedup.deduplicated(odd).collect()}
    assert out[5].text is None and out[5].n_lines == 0 and out[4].text == "" and out[6].text == LONG
    assert line_dedup.deduplicated(empty).count() == 0


def test_line_dedup_tells_rows_without_ids_apart(spark):
    """Of rows that share an id, or have none, only those lose a chunk that hold it again."""
    once, again = ("only here " * 30 + str(k) for k in range(2))
    shared = "shared by some " * 20
    rows = [(None, f"{shared}\n{once}a"), (None, f"{once}b\n{shared}"), (None, f"{once}c\n{again}"), (None, f"{once}d\n{again}"), (7, f"{once}e\n{once}f"), (7, f"{shared}\n{once}g"), (7, f"{once}h\n{shared}"), (None, "same " * 60), (None, "same " * 60), (None, None), (None, None)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    text = "\n".join(r.text or "" for r in got)
    assert len(got) == len(rows) and all(text.count(once + c) == 1 for c in "abcdefgh")
    assert text.count(shared) == 1 and text.count(again) == 1 and text.count("same " * 60) == 1
    assert any(r.doc_id == 7 and shared in r.text for r in got) and sum(r.text is None for r in got) == 2
    assert sum(r.removed_chunks for r in got) == sum(r.removed_lines for r in got) == 5


def test_repeated_runs_go_whole(spark, tmp_path):
    """Passages of 2 to 20 short lines, 52 words or more in each, that stand in different surroundings."""
    rows, n = [], 0
    for size in range(2, 21):
        passage = [" ".join(f"p{size}q{k}w{j}" for j in range(max(3, -(-52 // size)))) for k in range(size)]
        for copy in range(3):
            rows.append((n, "\n".join([f"begin {n}", f"own {n}", *passage, f"end {n}", ""])))
            n += 1
    rows.append((n, "\n".join(["so many words in each line here"] * 40)))  # its first run overlaps the next ones
    rows.append((n + 1, "\n".join(["\n" * 80, "short", "", "lines", f"x{n}"])))
    rows.append((n + 2, "\n".join(["\n" * 80, "short", "", "lines", f"y{n}"])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()}
    for i, text in rows[:n]:
        own = f"begin {i}\nown {i}\nend {i}\n"
        assert got[i].text == (text if i % 3 == 0 else own), (i, got[i].text)
        assert got[i].removed_lines == text.count("\n") - got[i].text.count("\n")
    assert len(got[n].text.split()) >= 50 and got[n].removed_lines > 0
    assert "x" in got[n + 1].text and "y" in got[n + 2].text


def test_shortest_runs_equal_brute_force(spark):
    g = np.random.default_rng(8)
    texts = ["\n".join(" ".join(["w"] * int(k)) for k in g.integers(0, 1 + int(g.integers(1, 70)), int(g.integers(1, 120)))) for _ in range(40)]
    from pyspark.sql import functions as F

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in d.select("text", F.transform(line_dedup.runs(F.col("text")), lambda x: x["span"]).alias("spans")).collect():
        w = [max(1, len(x.split())) for x in r.text.split("\n")]
        want = {(i, j + 1 - i) for i in range(len(w)) for j in range(i, len(w)) if sum(w[i : j + 1]) >= 50 and (sum(w[i:j]) < 50 or sum(w[i + 1 : j + 1]) < 50)}
        want = {x for x in want if any(v.strip() for v in r.text.split("\n")[x[0] : sum(x)])}
        assert want >= {x for x in want if sum(w[x[0] : sum(x)]) >= 50} and want <= {(s >> line_dedup.SPAN, s & ((1 << line_dedup.SPAN) - 1)) for s in r.spans}


def test_mixing(spark, docs, odd, empty):
    got = mixing.mixed(docs).collect()
    rows = {r.doc_id: r for r in docs.collect()}
    size, target = Counter(), {}
    for r in rows.values():
        size[r.source] += len(WORD.findall(r.text))
    names, total = sorted(size), 1.5 * sum(size.values())
    weight, free = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, set(names)
    while True:
        each = (total - sum(target.values())) / sum(weight[n] for n in free)
        over = {n for n in free if each * weight[n] > 2 * size[n]}
        if not over:
            break
        target |= {n: 2 * size[n] for n in over}
        free -= over
    target |= {n: each * weight[n] for n in free}
    taken = Counter()
    for r in got:
        s = rows[r.doc_id].source
        assert r.size == len(WORD.findall(rows[r.doc_id].text)) and r.source_size == size[s] and abs(r.target - target[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    largest = {n: max(r.size for r in got if rows[r.doc_id].source == n) for n in names}
    assert all(abs(taken[n] - target[n]) <= largest[n] for n in names)
    assert sorted(got) == sorted(mixing.mixed(docs.repartition(7)).collect())
    assert mixing.mixed(odd).count() == 13 and mixing.mixed(empty).count() == 0
    assert mixing.mixture(odd).columns == odd.columns and mixing.mixture(docs).count() == sum(r.times for r in got)


def test_packing(spark, docs, odd, empty):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for table in (docs, odd):
        want = Counter(np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in table.collect())
        got = packing.packed(table).collect()
        bins, texts = {}, {}
        for r in got:
            assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            if r.doc_id not in (6, None):
                texts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 1024
        whole = Counter(b"".join(x for _, x in sorted(v)) for v in texts.values())
        assert whole - want == Counter()
        assert sum(r.length for r in got) == sum(len(k) // 4 * n for k, n in want.items())
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in (sum(x for _, x in b) for b in bins.values()))
    assert padding < 1024 * odd.rdd.getNumPartitions() and packing.packed(empty).count() == 0


@pytest.mark.parametrize("text", ["a  b", "a   b", "a \n b", "a\n\n  b \t c", "it's  we'll 's 'S", "x  y", "  lead", "trail   ", "", "12 34éà 中文", "\n a", "<|endoftext|> x", "c\x1d d"])
def test_word_ids_are_the_tokenizer_s(text):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert packing.WordIds(public.path("byte_bpe_50k.json")).texts(pa.array([text])) == [np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_ids_of_any_unicode_are_the_tokenizer_s(docs):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    t, g = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), np.random.default_rng(9)
    some = [*"ab's 're  \n\t\r\x0b.,!<|>endoftext12", *"\u00e9\u4e2d\u0300\u00a0\u2003\u3000\u200b\x85\x1c\x1f\x00\U0001f600\u0661\ufeff", " ", " ", " ", "<|endoftext|>"]
    texts = ["".join(g.choice(some, int(n))) for n in g.integers(0, 40, 10000)]
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]  # each character within, before and after words
    g.shuffle(every)
    texts += ["a " + " ".join(every[i : i + 60]) + " b" + every[i] + " x" for i in range(0, len(every), 60)]
    texts += [r.text for r in docs.collect()]
    w, got = packing.WordIds(public.path("byte_bpe_50k.json")), []
    for i in range(0, len(texts), 5000):
        got += w.texts(pa.array(texts[i : i + 5000]))
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [ascii(x) for x, a, b in zip(texts, got, want) if a != b] == []


def test_words_met_often_are_not_encoded_anew(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    w, asked = packing.WordIds(public.path("byte_bpe_50k.json")), []
    real = w._encoded
    monkeypatch.setattr(w, "_encoded", lambda texts: asked.extend(texts) or real(texts))
    for k in range(6):
        texts = [f"x often often often rare{k}{i} {i}{k}" for i in range(30)] + ["", None]
        want = [np.array(e.ids, "<u4").tobytes() for e in w._tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert w.texts(pa.array(texts)) == want
    assert sum(" often" in a for a in asked) == 1


def test_a_worker_keeps_the_words_of_its_tasks(monkeypatch):
    import pyspark

    pytest.importorskip("public_tokenizers")
    made, real = [], packing.WordIds.__init__
    monkeypatch.setattr(packing.WordIds, "__init__", lambda self, path: made.append(path) or real(self, path))
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: cls))
    monkeypatch.setattr(pyspark.TaskContext, "partitionId", classmethod(lambda cls: 3))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words and more", None]})
    a, b = ([r for out in packing._pack("byte_bpe_50k.json", None)(iter([batch])) for r in out.to_pylist()] for _ in range(2))
    assert a == b and sorted(r["doc_id"] for r in a) == [1, 2] and len(made) <= 1


def test_cuts_hold_all_tokens():
    for n in [*range(1, 2100), 100001]:
        c = packing.cuts(n)
        assert sum(c) == n and all(x in (1024, 512, 256, 128, 64) for x in c[:-1])


def test_sharding(spark, docs, odd, empty):
    got = sharding.sharded(sharding.digest(docs)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == docs.count() and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in got)
    assert sorted(got) == sorted(sharding.sharded(sharding.digest(docs)).collect())
    assert sharding.sharded(odd, 5).count() == 13 and sharding.sharded(empty, 5).count() == 0
    assert sharding.sharded(odd, 5).columns == [*odd.columns, "shard", "slot"]


def test_op9_deals_out_whole_documents(spark, monkeypatch):
    """The operator gets the texts, and the query's digest is taken from what it returns."""
    real, seen = sharding.sharded, []

    def spy(docs, *args):
        seen.append(docs.columns)
        return real(docs, *args).withColumn("text", F.concat("text", F.lit("+")))

    monkeypatch.setattr(sharding, "sharded", spy)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op9_sharding(spark, SF).collect()
    assert seen == [docs.columns]
    texts = {r.doc_id: "" if r.text is None else r.text + "+" for r in docs.collect()}
    assert len(got) == len(texts) and all(r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_matrix_has_the_law_of_a_shuffle(spark):
    """Counts of many parts against the multivariate hypergeometric law: sums, mean, deviation and covariance."""
    n_parts, n, shards = 1500, 30, 3
    parts = spark.range(n_parts).selectExpr("cast(id as int) as _part", f"cast({n} as long) as n")
    rows = sharding.matrix(parts, shards, 5).collect()
    m = np.zeros((n_parts, shards), int)
    for r in rows:
        m[r["_part"], r["shard"]] = r["n"]
    total = n_parts * n
    assert (m.sum(axis=1) == n).all() and (m.sum(axis=0) == total // shards).all()
    var = n / 3 * (2 / 3) * (total - n) / (total - 1)
    assert all(abs(m[:, s].mean() - n / 3) < 1e-9 and abs(m[:, s].var() - var) < 0.12 * var for s in range(shards))
    assert abs(np.cov(m[:, 0], m[:, 1])[0, 1] + var / 2) < 0.12 * var
    few = [sorted(tuple(r) for r in sharding.matrix(spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "_part int, n long"), 7, s).collect()) for s in range(3)]
    assert all(sum(r[2] for r in x) == 5 and all(r[2] == 1 and r[1] < 5 for r in x) for x in few)
    assert sorted(tuple(r) for r in sharding.matrix(parts.repartition(5), shards, 5).collect()) == sorted(tuple(r) for r in rows)


def test_sharding_does_not_depend_on_partitions(spark):
    d = spark.range(400).selectExpr("if(id < 150, null, id) as doc_id", "if(id < 300, 'same', concat('t', id)) as text")
    a, b = (sorted(map(str, sharding.sharded(d.repartition(n), 5).collect())) for n in (3, 7))
    assert a == b and len(a) == 400


def test_equal_rows_are_dealt_out_evenly(spark):
    got = sharding.sharded(spark.range(200_000).selectExpr("cast(null as long) as doc_id", "'x' as text"), 6)
    counts = {r[0]: (r[1], r[2], r[3]) for r in got.groupBy("shard").agg({"slot": "count"}).join(got.groupBy("shard").agg({"slot": "max"}), "shard").join(got.select("shard", "slot").distinct().groupBy("shard").count(), "shard").collect()}
    assert len(counts) == 6 and all(n == most + 1 == distinct and 33333 <= n <= 33334 for n, most, distinct in counts.values())


def test_langid(spark, docs, odd, empty):
    got = langid.identified(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in got)
    out = {r.doc_id: r for r in langid.identified(odd).collect()}
    assert out[4].lang_pred == out[5].lang_pred == out[9].lang_pred == out[10].lang_pred == "und"
    assert langid.identified(empty).count() == 0


def test_license_scan_equals_brute_force(spark, docs, odd, empty):
    def words(t):
        return [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]

    rows = {r.doc_id: r.text for r in docs.collect()}
    mit = license_scan.TEMPLATES["mit"]
    rows |= {7000: "before it all " + mit + " and after", 7001: mit.replace("free of charge", "for a fee"), 7002: " ".join(words(mit)[:20])}
    got = {(r.doc_id, r.license) for r in license_scan.scanned(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    want = set()
    for i, t in rows.items():
        w = words(t)
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for name, text in license_scan.TEMPLATES.items():
            v = words(text)
            s = {tuple(v[k : k + 5]) for k in range(len(v) - 4)}
            if len(s & own) >= 0.8 * len(s):
                want.add((i, name))
    assert got == want and (7000, "mit") in got and (7002, "mit") not in got and len(got) > 3
    assert license_scan.scanned(odd).count() == 0 and license_scan.scanned(empty).count() == 0


def test_license_scan_finds_planted_notices(spark):
    """Notices with words changed, left out and put in, down to 0.8 of a template's shingles."""
    g, words, rows, want = np.random.default_rng(12), [f"w{i}" for i in range(500)], [], set()

    def split(t):
        return [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w]

    for k in range(1500):
        name = list(license_scan.TEMPLATES)[k % len(license_scan.TEMPLATES)]
        v = split(license_scan.TEMPLATES[name])
        own = list(v)
        for _ in range(int(g.integers(0, 4))):
            at, what = int(g.integers(len(own))), int(g.integers(3))
            own[at : at + 1] = [["changed"], [], [own[at], "added"]][what]
        text = [*g.choice(words, int(g.integers(0, 60))), *own, *g.choice(words, int(g.integers(0, 60)))]
        s = {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
        if len(s & {tuple(text[i : i + 5]) for i in range(len(text) - 4)}) >= 0.8 * len(s):
            want.add((k, name))
        rows.append((k, " ".join(text)))
    got = {(r.doc_id, r.license) for r in license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long = {n for n, t in license_scan.TEMPLATES.items() if len(split(t)) - 4 >= license_scan.LONG}
    assert len(long) >= 4 and len(want) > 400 and len(want - got) <= 0.01 * len(want)
    assert not {x for x in want - got if x[1] not in long}  # short templates are found for certain


def test_license_scan_takes_long_templates(spark):
    """Templates of thousands of words, more bands than are broadcast, and a common notice."""
    g, words = np.random.default_rng(14), [f"v{i}" for i in range(3000)]
    texts = {f"t{k}": " ".join(g.choice(words, 1500)) for k in range(4)}
    rows = [(i, "start here " + texts[f"t{i % 4}"] + " end") for i in range(12)] + [(100, " ".join(g.choice(words, 4000)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    before, license_scan.BROADCAST_BANDS = license_scan.BROADCAST_BANDS, 10
    try:
        got = {(r.doc_id, r.license, r.containment) for r in license_scan.scanned(d, texts=texts).collect()}
    finally:
        license_scan.BROADCAST_BANDS = before
    assert got == {(i, f"t{i % 4}", 1.0) for i in range(12)}


def test_repeated_and_missing_ids_with_different_texts(spark):
    """Rows that share an id, or have none, are told apart by op3, op4 and op7, each against brute force."""
    g = np.random.default_rng(15)
    a, b, c = (" ".join(g.choice([f"{p}{i}" for i in range(400)], 120)) for p in "abc")
    near = lambda t: t.replace(t.split()[60], "other", 1)
    d = spark.createDataFrame([(1, a), (1, b), (2, near(b)), (3, near(a)), (4, c), (None, a), (None, b)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash_dedup.near_duplicates(d.repartition(3)).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    left = sorted((r.doc_id or -1, r.text[0]) for r in minhash_dedup.deduplicated(d).collect())
    assert left == [(1, "a"), (1, "b"), (4, "c")]
    twice = spark.createDataFrame([(1, a), (1, a), (2, a), (None, c), (None, c)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text[0]) for r in minhash_dedup.deduplicated(twice).collect()) == [(-1, "c"), (1, "a")]
    x, y = g.standard_normal((2, 16)).astype(np.float32)
    rows = [(1, x, 0), (1, y, 0), (2, x, 0), (3, y * 2, 0), (4, x, 1), (5, x + np.float32(0.001), 0)]
    e = spark.createDataFrame([(i, v.tolist(), k) for i, v, k in rows], "vec_id long, embedding array<float>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_vectors(e.repartition(4)).collect())
    assert got == Counter([(1, 2, 1), (1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4), (5, 2, 1)])
    texts = [(None, "ten words in a row that make a whole text")] * 100 + [(7, f"and {k} other words of this id") for k in range(50)]
    m = spark.createDataFrame([(i, t, s) for (i, t), s in zip(texts, ["a"] * 100 + ["b"] * 50)], "doc_id long, text string, source string")
    for dealt in (m.repartition(3), m.repartition(7)):
        rows = mixing.mixed(dealt).collect()
        for size in {r.source_size for r in rows}:
            own = [r for r in rows if r.source_size == size]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 10 and all(r.taken <= 2 * r.size for r in own)
        out = mixing.mixture(dealt)
        assert out.columns == m.columns and out.count() == sum(r.times for r in rows)


def test_any_columns_with_names_that_clash(spark, docs):
    """Operators that give all columns back keep them, whatever their names."""
    names = ["row", "h", "g", "_key", "_own", "_copy", "key", "size", "times", "place", "copy", "component", "at", "a.b", "n_lines"]
    d = docs.limit(30).select("*", *(docs["lang"].alias(n) for n in names))
    assert minhash_dedup.deduplicated(d).columns == d.columns and minhash_dedup.deduplicated(d).count() > 20
    assert mixing.mixture(d).columns == d.columns and mixing.mixture(d).count() > 10
    assert line_dedup.deduplicated(d).columns == [*d.columns[:-1], "n_lines", "removed_lines", "removed_chunks"] and line_dedup.deduplicated(d).count() == 30
    assert sharding.sharded(d, 3).columns == [*d.columns, "shard", "slot"] and sharding.sharded(d, 3).count() == 30


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in df.select(*want.columns).collect()) == Counter(want.fetchall())


def test_verdicts_equal_the_rules(spark, docs, labels):
    """Each document's rule by plain Python over the returned counts, and how the held-back labels fare."""
    ratio = lambda a, b: a / max(b, 1)
    of = {
        "n_words": lambda r: float(r.n_words), "word_length": lambda r: ratio(r.word_chars, r.n_words), "symbol_share": lambda r: ratio(r.n_symbols, r.word_chars), "dup_line_share": lambda r: ratio(r.n_dup_lines, r.n_lines),
        "repeat_share": lambda r: ratio(r.n_repeat_words, r.n_words), "upper_share": lambda r: ratio(r.n_upper, r.word_chars), "exclaim_share": lambda r: ratio(r.n_exclaim, r.n_words),
    }
    d, lab = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learnt, held = lab.where("doc_id % 3 <> 0"), {r.doc_id: r.quality for r in lab.where("doc_id % 3 = 0").collect()}
    rules = quality_rules.fit(quality_rules.rated(d, learnt).drop("rule", "kept"), learnt)
    rows = quality_rules.rated(d, learnt).collect()
    for r in rows:
        first = next((k for k, rule in enumerate(rules, 1) if all((of[t.feature](r) > t.cut) == t.above for t in rule)), None)
        assert r.rule == first and r.kept == (not r.base_failed and first is None)
    right = [r.kept == (held[r.doc_id] == 1) for r in rows if r.doc_id in held]
    most = max(np.mean(list(held.values())), 1 - np.mean(list(held.values())))
    assert rules and np.mean(right) > most


def test_severity_equals_a_plain_sum(spark, docs, labels):
    """Scores by Python over words and their beginnings, one at a time, from the model's own weights."""
    from pathloom.llm._text import span_hashes

    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.severity(docs, labels).collect()}
    weights = dict(zip(model.features.tolist(), model.weights.tolist()))

    def number(b):
        return int(span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])

    for r in docs.limit(25).collect():
        found = re.findall(rb"[A-Za-z\x80-\xff]+", r.text.lower().encode())
        count = Counter(number(x) for x in found) + Counter(number(x[:n]) for x in found for n in toxicity.PREFIXES if len(x) > n)
        z = sum(weights[f] * min(1, 0.15 + 3.5 * (c / len(found)) ** 0.5) for f, c in count.items() if f in weights)
        p = [1 / (1 + np.exp(min(50, max(-50, t - z)))) for t in model.thresholds]
        assert abs(sum(p) - got[r.doc_id].expected_severity) < 1e-6 and got[r.doc_id].grade == sum(x >= 0.5 for x in p)


def test_language_scores_equal_kernel_ridge_regression(spark):
    """Folded weights against a kernel matrix of sets: same landmarks, same regression."""
    g = np.random.default_rng(21)
    words = {"a": [f"ka{i}ro" for i in range(40)], "b": [f"sti{i}el" for i in range(40)]}
    texts = [" ".join(g.choice(words[k], 12)) for k in "ab" * 30]
    model = langid.fit_texts(texts, list("ab" * 30))
    sets = lambda t: {n for n in langid.presence([t])[0].tolist()}
    marks = [i for i in range(60)]  # fewer texts than landmarks: all are
    kernel = lambda x, y: len(sets(x) & sets(y)) / (len(sets(x)) * len(sets(y))) ** 0.5
    k = np.array([[kernel(a, texts[j]) for j in marks] for a in texts])
    values, vectors = np.linalg.eigh(k)
    some = values > 1e-6 * values[-1]
    z = np.c_[k @ (vectors[:, some] / np.sqrt(values[some])), np.ones(60)]
    y = np.array([[c == n for n in "ab"] for c in "ab" * 30], float)
    w = np.full(60, 1 / 60)
    a = np.linalg.solve((z * w[:, None]).T @ z + langid.RIDGE * np.diag([1.0] * (z.shape[1] - 1) + [1e-9]), (z * w[:, None]).T @ y)
    assert np.abs(np.clip(z @ a, 0, 1) - model.scores(texts)).max() < 0.02
    assert (model.scores(texts).argmax(axis=1) == y.argmax(axis=1)).all()


def test_models_do_not_depend_on_partitions(spark, docs, labels):
    few = 40  # fewer than there are labels, so that a choice is made
    for n in (2, 5):
        d, lab = docs.repartition(n), labels.repartition(n)
        made = (str(quality_rules.fit(quality_rules.rated(d, lab).drop("rule"), lab, few)), toxicity.fit(d, lab, few).weights.tolist(), langid.fit(d, few).weights.sum(axis=0).tolist())
        first = made if n == 2 else first
    assert first == made


def test_common_is_exact(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SLAB", 7)
    g = np.random.default_rng(4)
    a, b = ([np.unique(g.integers(0, 60, g.integers(0, 40))) for _ in range(n)] for n in (9, 6))
    assert minhash_dedup.common(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


@pytest.mark.parametrize("n", [120, 360])
def test_pages_of_a_template_give_a_row_per_member(spark, n, monkeypatch):
    """300 common and 35 own words: all pairs pass the estimate, none links; chains of pages that do link are found."""
    page = " ".join(f"t{i}" for i in range(300))
    rows = {k: page + " " + " ".join(f"p{k}x{i}" for i in range(35)) for k in range(n)}
    for k in range(n, n + 20):  # each links to the one before, which no pivot does
        rows[k] = page + " " + " ".join(f"q{i}" for i in range(3 * (k - n), 3 * (k - n) + 35))
    written = {}
    real = minhash_dedup.stored
    monkeypatch.setattr(minhash_dedup, "stored", lambda df, name="t", rows=None: written.setdefault(name, []).append(out := real(df, name, rows)) or out)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 64)
    docs = spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {k: min(k, n) for k in rows}
    chunks, bands = -(-len(rows) // 64), minhash_dedup.REGISTERS // minhash_dedup.BAND
    assert max(df.count() for dfs in written.values() for df in dfs) <= len(rows) * (chunks + 1) * bands
    assert sum(df.count() for name in ("star", "again", "block-links") for df in written[name]) <= 6 * len(rows) * bands


def test_columns_that_hold_maps_come_back(spark):
    schema = "doc_id long, text string, lang string, source string, m map<string,int>, deep array<struct<x:map<string,int>>>"
    text = "one line of words\nanother line of words\na third line of words\nand the fourth line of words"
    rows = [(i, text if i is None or i < 3 else f"text {i}", "en", "a", {"k": i or 0}, [({"z": 1},)]) for i in (1, 2, 3, None)] + [(None, text, "en", "a", {"k": 9}, None)]
    docs = spark.createDataFrame(rows, schema)
    for out in (line_dedup.deduplicated(docs, run_words=20), minhash_dedup.deduplicated(docs), mixing.mixture(docs)):
        assert out.select(docs.columns).dtypes == docs.dtypes
        assert all(r.m is not None for r in out.collect())
    assert sorted(len(r.text) for r in line_dedup.deduplicated(docs, run_words=20).where("doc_id is null").collect())[0] < len(text)
