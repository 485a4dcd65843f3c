"""The queries of this subpackage: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import crc_of_id, small_batches
from strata.oracles import CRC_SQL, CRC_TABLE


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import langid

    docs = documents(spark, sf_dir)
    held = crc_of_id() % 4 == 2
    model = langid.fit(docs, ~held)
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import jaccard

    return jaccard.components(documents(spark, sf_dir))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import licences

    return licences.scan(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import substring

    return substring.deduplicate(documents(spark, sf_dir)).drop("kept_text")


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import tiff

    return tiff.round_trip(documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import mixing

    return mixing.mix(documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import brown

    return brown.score(documents(spark, sf_dir), crc_of_id() % 5 == 1)


def op8_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import winnow

    return winnow.edited_pairs(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import packing

    return packing.pack(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import pii

    return pii.report(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import periodic

    found = periodic.periodic_runs(periodic.planted(documents(spark, sf_dir)))
    best = periodic.strongest(F.col("runs"))
    rows = found.withColumn("_best", best)
    part = [F.col("_best")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *part, milli, F.sha2(periodic.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import importance

    docs = documents(spark, sf_dir)
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import simhash

    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_language_id, op2_ngram_jaccard, op3_licence_scan, op4_substring_dedup, op5_tiff_media, op6_source_mixing, op7_brown_scoring, op8_winnowing_fingerprints, op9_best_fit_packing, op10_pii, op11_periodic_runs, op12_importance_resampling, op13_simhash_near_dedup]
    return {f.__name__: f for f in every}


WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
  shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM docs WHERE len(w) BETWEEN 1 AND 4),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
  both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT DISTINCT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
  least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON a = d.doc_id"""

SUBSTRING_SQL = f"""
WITH docs AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
  windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)),
  repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
  starts AS (SELECT doc_id, i FROM windows SEMI JOIN repeated USING (s)),
  words AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs)),
  marked AS (SELECT words.doc_id, word, p, coalesce(p - max(i) OVER (PARTITION BY words.doc_id ORDER BY p) < 35, false) AS gone FROM words LEFT JOIN starts ON starts.doc_id = words.doc_id AND i = p),
  summed AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS k FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM documents d LEFT JOIN summed s ON s.doc_id = d.doc_id"""


RUNS_SQL = f"""
WITH own AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS hx FROM documents),
  crc AS (SELECT r, doc_id, w, len(w) AS n, {CRC_SQL.format("hx")} AS h FROM own, ({CRC_TABLE})),
  cut AS (SELECT *, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM crc),
  docs AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w FROM cut),
  words AS (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM docs),
  grams AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS g FROM (SELECT r, w, unnest(range(n - 15)) AS i FROM docs WHERE n >= 24)),
  often AS (SELECT * FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
  periods AS (SELECT DISTINCT a.r, b.i - a.i AS q FROM often a JOIN often b ON a.r = b.r AND a.g = b.g AND a.i < b.i JOIN docs ON docs.r = a.r WHERE 3 * (b.i - a.i) <= n),
  same AS (SELECT p.r, q, a.i, a.i - row_number() OVER (PARTITION BY p.r, q ORDER BY a.i) AS island FROM periods p JOIN words a ON a.r = p.r JOIN words b ON b.r = p.r AND b.i = a.i + q AND b.x = a.x),
  stretches AS (SELECT r, q, min(i) AS s, count(*) + q AS n FROM same GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
  runs AS (SELECT r, s, n, min(q) AS q FROM stretches GROUP BY r, s, n),
  told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
  best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n / q DESC, s, q) = 1),
  gone AS (SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs),
  kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, b.n AS length, q AS period, 1000 * b.n // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM docs d LEFT JOIN told USING (r) LEFT JOIN best b USING (r) LEFT JOIN kept USING (r)"""

IMPORTANCE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  ones AS (SELECT r, unnest(w) AS f FROM docs),
  aims AS (SELECT unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
  keys AS (SELECT f, {CRC_SQL.format("h")} % 10000 AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM ones UNION SELECT f FROM aims)), ({CRC_TABLE})),
  source AS (SELECT b, count(*) AS s FROM ones JOIN keys USING (f) GROUP BY b),
  target AS (SELECT b, count(*) AS t FROM aims JOIN keys USING (f) GROUP BY b),
  gains AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM source) + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000.0::DOUBLE)))) AS BIGINT) AS g FROM source LEFT JOIN target USING (b)),
  weights AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM ones JOIN keys USING (f) JOIN gains USING (b) GROUP BY r),
  scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
      CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
    FROM docs LEFT JOIN weights USING (r)),
  ranked AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
  best AS (SELECT *, n_features >= 20 AS fit, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM ranked)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= (SELECT count(*) * 10 // 100 FROM ranked WHERE n_features >= 20) THEN place END AS rank FROM best"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that have an exact result; the others are tested in tests/llm."""
    return {"op2_ngram_jaccard": JACCARD_SQL, "op4_substring_dedup": SUBSTRING_SQL, "op11_periodic_runs": RUNS_SQL, "op12_importance_resampling": IMPORTANCE_SQL}
