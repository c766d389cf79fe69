"""A training-data pipeline of five stages over `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewide.llm import decontaminate, language_id, mixing, simhash, token_output
from sparsewide.llm.common import WORD, removed, table, written
from sparsewide.llm.queries import tokenizer_path

#: Below this share of n-grams known to the best language, a document counts as none's.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without enough n-grams of any language; rows that share a doc_id and differ in text are judged apart."""
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.predict(docs.select(_key(docs).alias("doc_id"), "text"), model)
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, _key(docs) == F.col("_kept"), "left_semi")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8): that of smallest doc_id, null last."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of `benchmark`; rows that share a doc_id and differ in text are judged apart."""
    keyed = docs.select(_key(docs).alias("doc_id"), "text")
    bad = decontaminate.overlaps(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, _key(docs) == F.col("_bad"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A source's blocks repeat only after all were taken, so a document is taken whole a number of times, but for the one at the source's last block: of that the
    words taken beyond whole times come as a row of their own, joined by single spaces. Documents without a word, or that the mix does not come to, go.
    """
    taken = mixing.taken(docs.select(_key(docs).alias("doc_id"), "text", "source")).filter("taken > 0")
    times = taken.groupBy(F.col("doc_id").alias("_key")).agg(F.max("taken").alias("_taken"), F.max("size").alias("_size"))
    rows = docs.join(times, _key(docs) == F.col("_key"))
    rows = rows.withColumn("_whole", F.expr("_taken div _size")).withColumn("_rest", F.expr("_taken % _size"))
    rows = rows.withColumn("_time", F.explode(F.expr("sequence(1, _whole + if(_rest > 0, 1, 0))")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("_rest").cast("int")), " ")
    text = F.when(F.col("_time") > F.col("_whole"), part).otherwise(F.col("text"))
    made = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards; a row per document with its place, length and checksum, read back from them."""
    return token_output.encode_documents(docs, tokenizer_path())


def _key(docs: DataFrame) -> Column:
    """What tells rows apart that share a doc_id, or have none: equal keys have equal id, source and text."""
    return F.xxhash64(docs["doc_id"], docs["source"], docs["text"])


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token-ID output", encode),
]

#: SQL can express neither the trained filter nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`; each one's rows are written and read again, and deleted once the next ones are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            if before is not None:
                removed(spark, before)
            before = docs
    return docs
