"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, collocations, embedding_dedup, langid, license_scan, line_dedup, minhash_dedup, mixing, packing, quality_rules, sharding, token_counts, toxicity
from ._common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"), run_words=line_dedup.RUN_WORDS).select("doc_id", "n_lines", "removed_lines", "removed_chunks", "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).drop("ids")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.digest(sharding.sharded(table(spark, sf_dir, "documents"), 24), "shard", "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def llm_quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5 what no learnt rule decides."""
    rows = quality_rules.rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def llm_mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7 what no hash decides."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_langid": op10_langid,
    "op11_centroids": op11_centroids,
    "op12_token_counts": op12_token_counts,
    "op13_collocations": op13_collocations,
    "llm_quality_statistics": llm_quality_statistics,
    "llm_mixing_targets": llm_mixing_targets,
}

_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "k(n, c) USING KEY (n) AS (SELECT id, id FROM nodes UNION SELECT e.y, min(k.c) FROM k JOIN e ON e.x = k.n JOIN recurring.k r ON r.n = e.y WHERE k.c < r.c GROUP BY e.y)"
_VECTORS = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), z AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0)"

def _lloyd_sql(rounds: int = 3, k: int = 16) -> str:
    """Whole Lloyd rounds, all distances in each."""
    floor = lambda s, c: f"(({s}) - ((({s}) % {c}) + {c}) % {c}) // {c}"
    q = "q AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
    out = [q, f"c0 AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS j, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM q ORDER BY h LIMIT {k}))"]
    for t in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        out.append(f"a{t} AS (SELECT id, vec_id, v, min(struct_pack(d := d, j := j)) AS b FROM (SELECT id, vec_id, v, j, {d} AS d FROM q CROSS JOIN c{t}) GROUP BY ALL)")
        if t < rounds:
            out.append(f"s{t} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b.j AS j, unnest(v) AS x, unnest(range(64)) AS i FROM a{t}) GROUP BY j, i)")
            out.append(f"c{t + 1} AS (SELECT j, coalesce((SELECT list({floor('s', 'n')} ORDER BY i) FROM s{t} WHERE s{t}.j = c{t}.j), c) AS c FROM c{t})")
    return f"WITH {', '.join(out)} SELECT vec_id, b.j AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.j))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON j = b.j"


def _phrases_sql(longest: int = 5, least: int = 100, top: int = 2000) -> str:
    """All phrases of all texts, counted."""
    words = "w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(" + _LOWER + ", '[.,;:!?\x0A-\x0D]')) AS p FROM documents))"
    grams = " UNION ALL ".join(f"SELECT lang, {m} AS m, array_to_string(w[i:i+{m - 1}], ' ') AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM w WHERE len(w) >= {m})" for m in range(1, longest + 1))
    return (
        f"WITH {words}, f AS (SELECT lang, m, g, count(*)::HUGEINT AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}), n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang), c AS (SELECT lang, m, g, f, string_split(g, ' ') AS w FROM f WHERE m > 1), "
        "cuts AS (SELECT lang, g, f, w, unnest(range(1, len(w))) AS k FROM c), s AS (SELECT cuts.lang, cuts.g, cuts.f AS a, k, l.f AS l, r.f AS r, n, 1000 * cuts.f * n // (l.f * r.f) AS score FROM cuts JOIN n USING (lang) JOIN f l ON l.lang = cuts.lang AND l.g = array_to_string(w[1:k], ' ') JOIN f r ON r.lang = cuts.lang AND r.g = array_to_string(w[k+1:], ' ')), "
        "b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1), longer AS (SELECT DISTINCT c.lang, array_to_string(c.w[i:i+z-1], ' ') AS g, c.f FROM c CROSS JOIN range(2, 5) t(z) CROSS JOIN range(1, 5) u(i) WHERE z < c.m AND i + z - 1 <= c.m), "
        f"kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = b.lang AND longer.g = b.g AND 100 * longer.f >= 100 * b.a)) SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM kept QUALIFY rank <= {top}"
    )


#: The results that their contracts fix whatever the method. The others rest on hashes, learnt models or token ids.
ORACLES: dict[str, str] = {
    "op3_embedding_dedup": f"WITH RECURSIVE {_VECTORS}, e AS (SELECT a.id AS x, b.id AS y FROM z a JOIN z b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98), nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}, m AS (SELECT x, count(*) AS n FROM e GROUP BY x) SELECT n AS vec_id, COALESCE((SELECT m.n FROM m WHERE m.x = k.n), 0)::BIGINT AS n_links, c AS component_id, n = c AS kept FROM k",
    "op4_minhash_dedup": f"WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS.format(_LOWER)} AS w FROM documents), s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w), u AS (SELECT id, unnest(s) AS g FROM s), shares AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2), e AS (SELECT x, y FROM shares JOIN s a ON a.id = x JOIN s b ON b.id = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)), nodes AS (SELECT id FROM s), {_REACH} SELECT n AS doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, n = c AS kept FROM k JOIN s ON s.id = n",
    "op11_centroids": _lloyd_sql(),
    "op13_collocations": _phrases_sql(),
    "llm_quality_statistics": f"WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), r AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS n FROM r), c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g CROSS JOIN range(8) t(j) WHERE n > 1 GROUP BY doc_id), l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w), k AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)) SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM k",
    "llm_mixing_targets": f"WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size FROM documents), s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source), o AS (SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS ws FROM s WINDOW before AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), l AS (SELECT max(rest / ws) FILTER (rest / ws <= 2.0 * n / w) AS level FROM o), t AS (SELECT source, n, least(2.0 * n, coalesce(level * w, 2.0 * n)) AS target FROM s CROSS JOIN l) SELECT doc_id, size, t.n AS source_size, round(target::DOUBLE, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source",
}
