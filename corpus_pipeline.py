"""From raw documents to packed sequences, by the operators of strata.llm.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

An empty table goes through every stage. Null texts and ids, repeated rows and ties: see
each stage. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import jaccard, langid, mixing, packing, pii
from strata.llm.common import bitmap_of_longs, crc_of_id, fresh, materialize, small_batches, split_by
from strata.llm.textvec import release


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; `lang` becomes the predicted one where it is null. Null ids and repeated rows are judged row by row; a tie of languages goes to the first by code point. Further columns pass, whatever their names."""
    small_batches(spark)
    lang, score = fresh(docs, "predicted", "score")
    model = langid.fit(docs, crc_of_id() % 4 != 2)
    kept = langid.predict(docs, model, lang_out=lang, score_out=score).where(F.col(lang) != "und")
    del model
    release()
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: that with the least id (null ids first; of rows with the same id and component the one with the least hash of text, then of the row). Rows with a null or empty text are linked with nothing and stay. Further columns pass, whatever their names."""
    small_batches(spark)
    key, text_hash, row_hash, goes, place = fresh(docs, "key", "text_hash", "row_hash", "goes", "place")
    own = F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    joined = jaccard.components(docs.select(own.alias("own"), "text"), "own")
    groups = joined.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    doubtful = materialize(groups.where("component_id <> doc_id or n > 1").select(F.col("doc_id.i").alias(key), F.col("doc_id.h").alias(text_hash), (F.col("component_id") != F.col("doc_id")).alias(goes)))
    clear, some = split_by(docs, F.xxhash64("doc_id", F.xxhash64("text")), bitmap_of_longs(doubtful.select(F.xxhash64(key, text_hash))))
    hashed = some.withColumns({f"{text_hash}_own": F.xxhash64("text"), row_hash: F.xxhash64(*docs.columns)})
    left = hashed.join(doubtful, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(f"{text_hash}_own") == F.col(text_hash)), "left").where(~F.coalesce(F.col(goes), F.lit(False)))
    # a repeated row of a document that stays: one of them, told by a hash of all its columns
    first = Window.partitionBy("doc_id", f"{text_hash}_own").orderBy(row_hash)
    one = left.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return clear.unionByName(one.select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, row by row. Null texts stay null; of overlapping spans the first counts."""
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, whole: words taken / size, rounded up. A null source is one; repeated rows count once; null and empty texts have no words and aren't taken. Further columns pass, whatever their names."""
    small_batches(spark)
    key, uses, use = fresh(docs, "key", "uses", "use")
    keyed = docs.withColumn(key, F.xxhash64(*docs.columns))
    taken, _ = mixing.mix(keyed, id_col=key)
    often = taken.where("taken > 0").groupBy(F.col("doc_id").alias(key)).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).alias(uses))
    rows = keyed.dropDuplicates([key]).join(often, key)
    return rows.withColumn(use, F.explode(F.sequence(F.lit(1).cast("long"), F.col(uses)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces and their places in sequences of 1024 tokens; null texts are empty, repeated rows are packed one by one."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("pii", redact_personal_data),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages have no SQL form; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
