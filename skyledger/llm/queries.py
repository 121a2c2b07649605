"""The registered queries of this package and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, centroids, context_tree, decontamination, fingerprints, html_extraction, language, licenses,
               near_dup, negatives, quality, sharding, toxicity)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    extracted = html_extraction.extract(pages, html_extraction.train(spark))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded again; digests of both."""
    vocabulary = bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = bpe.decode(encoded.select("doc_id", "bpe.ids", "bpe.n_tokens"), vocabulary)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, and the rule for a contaminated one."""
    found = decontamination.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      table(spark, sf_dir, "benchmark").select("item_id", "text"))
    ids = F.array_join(F.array_sort(F.col("hits.items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "hits.n_words", F.size("hits.hit_words").cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        decontamination.contaminated(F.col("hits")).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op8_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT item_id, w, least(13, len(w)) AS k
      FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bw),
dk AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
       FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
hit AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dk)
        JOIN win USING (k, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items,
       sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query
def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` dealt into 16 shards by the permuted number of the row; the law is ``rows``."""
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.assign(sized, ["doc_id", "size", "text_crc32"], shards=16, seed=20_260)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "place.shard", "place.slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def held_out(parts: int, part: int):
    """Whether a document is kept from learning, by the checksum of its id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    documents = table(spark, sf_dir, "documents")
    learned = documents.filter(F.col("doc_id").isNotNull() & ~held_out(4, 2)).select("text", "lang")
    predicted = language.predict(documents.select("doc_id", "text"), language.train(learned))
    return predicted.select("doc_id", held_out(4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"),
                            "language.score")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from labelled ones that are not held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels, ~held_out(3, 1))
    scored = quality.score(documents.select("doc_id", "text"), model, out="score")
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labelled ones that are not held out."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, ~held_out(5, 0))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "toxicity.score",
                         (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), "toxicity.evidence")


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = documents.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "digests", fingerprints.digests(F.col("text")))
    paired = fingerprints.with_next(marked, "doc_id", ["text", "digests"], "n_chars")
    kept = F.col("n_chars") - F.expr("n_chars div 3")
    edited = paired.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), kept), F.substring("next_text", F.lit(1), F.expr("n_chars div 3"))))
    found = edited.select("doc_id", "n_chars", "digests", "next_digests",
                          F.sha2("edited", 256).alias("edited_sha256"),
                          fingerprints.digests(F.col("edited")).alias("edited_digests"))
    for part in ("", "edited_", "next_"):
        found = fingerprints.with_sketch(found, f"{part}digests", f"{part}cells")
    for part in ("edited_", "next_"):
        found = fingerprints.differences(found, "digests", "cells", f"{part}digests", f"{part}cells", f"{part}apart")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.printed("cells").alias("fingerprint"),
        fingerprints.printed("edited_cells").alias("edited_fingerprint"),
        fingerprints.likeness("digests", "edited_digests", "edited_apart").alias("near_edited"),
        fingerprints.likeness("digests", "next_digests", "next_apart").alias("near_next"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document: how many parts match, the best match and all licences."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.element_at(F.array_sort(F.transform("licenses", lambda m: F.struct(
        (-m["dice"]).alias("d"), m["license"].alias("license")))), 1)
    return found.select(
        "doc_id", F.size(F.array_distinct("licenses.part")).cast("long").alias("n_parts"),
        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("licenses"),
        F.when(F.size("licenses") > 0, best["license"]).alias("best_license"),
        F.when(F.size("licenses") > 0, -best["d"]).alias("best_dice"))


def _license_oracle() -> str:
    """Every window by joins over the positions of words."""
    known = ", ".join(f"('{name}', {number}, {n}, {found})" for name, number, n, found in licenses.templates())
    return rf"""
WITH t AS (SELECT * FROM (VALUES {known}) AS v(license, template, n, grams)),
tg AS MATERIALIZED (SELECT license, template, n, len(grams) AS a, unnest(grams) AS gram FROM t),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
word AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
g AS MATERIALIZED (SELECT * FROM (SELECT doc_id, p, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY p) AS gram FROM word)
  WHERE gram IS NOT NULL),
size AS (SELECT doc_id, count(*) AS m FROM g GROUP BY 1),
h AS MATERIALIZED (SELECT doc_id, m, p, license, template, n, a, gram, greatest(m - n + 1, 0) AS latest FROM g JOIN tg USING (gram) JOIN size USING (doc_id)),
start AS (SELECT DISTINCT doc_id, license, template, p AS first FROM h WHERE p <= latest
  UNION SELECT DISTINCT doc_id, license, template, latest FROM h),
win AS MATERIALIZED (SELECT doc_id, license, template, first, any_value(least(first + n - 2, m - 1)) AS final, any_value(a) AS a, count(DISTINCT gram) AS shared
  FROM start JOIN h USING (doc_id, license, template) WHERE p BETWEEN first AND first + n - 2 GROUP BY ALL HAVING 3 * shared >= 2 * any_value(a)),
span AS (SELECT DISTINCT doc_id, first, final FROM win),
wide AS (SELECT doc_id, first, final, count(DISTINCT gram) AS b FROM span JOIN g USING (doc_id) WHERE p BETWEEN first AND final GROUP BY ALL),
hit AS MATERIALIZED (SELECT *, 2.0 * shared / (a + b) AS dice FROM win JOIN wide USING (doc_id, first, final) WHERE dice >= {licenses.DICE}),
kept AS (SELECT * FROM hit w WHERE NOT EXISTS (SELECT 1 FROM hit v WHERE v.doc_id = w.doc_id AND v.first <= w.final AND w.first <= v.final
  AND (-v.shared, -v.dice, v.first, v.license, v.template) < (-w.shared, -w.dice, w.first, w.license, w.template))),
part AS (SELECT doc_id, first, final, string_agg(word, ' ' ORDER BY p) AS part FROM (SELECT DISTINCT doc_id, first, final FROM kept) JOIN word USING (doc_id)
  WHERE p BETWEEN first AND final + 1 GROUP BY ALL),
best AS (SELECT doc_id, license, dice FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) = 1),
ids AS (SELECT doc_id, count(DISTINCT part) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM kept JOIN part USING (doc_id, first, final) GROUP BY 1)
SELECT d.doc_id, coalesce(ids.n, 0) AS n_parts, coalesce(ids.licenses, '') AS licenses, best.license AS best_license,
       best.dice AS best_dice
FROM d LEFT JOIN ids USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLES["op7_license_scan"] = _license_oracle()


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of the vectors of ``embeddings`` after three rounds."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def _centroid_oracle() -> str:
    """Every distance to every centroid, a table of centroids per round."""
    squared = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = []
    for i in range(4):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT vec_id, x, n AS cluster, d AS distance FROM (SELECT vec_id, x, n, {squared} AS d FROM v, c{i}) "
            "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, n) = 1)")
        if i < 3:
            steps.append(
                f"s{i} AS (SELECT cluster, p, sum(x[p])::BIGINT AS s, count(*) AS m FROM (SELECT cluster, x, unnest(range(1, 65)) AS p FROM a{i}) "
                "GROUP BY ALL)")
            steps.append(
                f"c{i + 1} AS MATERIALIZED (SELECT n, coalesce(any_value(u), any_value(c)) AS c FROM c{i} LEFT JOIN (SELECT cluster, "
                "list((s - ((s % m) + m) % m) // m ORDER BY p) AS u "
                f"FROM s{i} GROUP BY cluster) ON n = cluster GROUP BY n)")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, x AS c FROM
  (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),
{", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON n = cluster
"""


ORACLES["op11_centroid_clusters"] = _centroid_oracle()


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives and hard negatives of every hundredth vector of ``embeddings``, against all."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


ORACLES["op12_hard_negatives"] = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


@query
def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every text by a context tree over bytes, beside that by word counts."""
    scored = context_tree.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out(7, 2))
    return scored.select(
        "doc_id", held_out(7, 2).alias("held_out"), "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score",
        (-F.col("lm.score") / F.log10(F.lit(2.0)) / (F.col("lm.n_bytes") + 1)).alias("bits_per_byte"))
