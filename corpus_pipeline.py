"""From raw documents to packed sequences, in five stages.

Each stage reads the documents that the one before it wrote and returns documents of the same columns, the last one
sequences. A row is known by doc_id, the hash of its text, language and source, so repeated ids with other texts stay
apart. Every stage reads the columns COLUMNS alone: further ones, also of names that differ only in case, are left
behind. An empty table gives an empty table, texts are whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.common import only, written
from stemma.llm.cut_text import without_spans
from stemma.llm.decontaminate import contamination
from stemma.llm.near_dup import near_duplicates
from stemma.llm.packing import pack
from stemma.llm.quality_rules import judged
from stemma.llm.suffix_dedup import removed_spans

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same(names: tuple[str, ...]) -> Column:
    """Equality of the named columns of d and v, null equal to null."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"d.{n}").eqNullSafe(F.col(f"v.{n}"))
    return out


def _kept(docs: DataFrame, verdicts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows of docs(COLUMNS) with a verdict `kept`."""
    d = docs.withColumn("text_hash", F.xxhash64("text")).alias("d")
    return d.join(verdicts.where("kept").select(*by).alias("v"), _same(by), "left_semi").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base limits and near their language's and source's core.

    Null, empty and blank texts go. A null doc_id is kept or goes by its text; null languages and sources are values of
    their own. Repeated rows fare alike.
    """
    docs = only(docs, *COLUMNS)
    return _kept(docs, judged(docs), ("doc_id", "text_hash", "lang", "source"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one of least doc_id; of rows alike in doc_id and text the one of
    least language, source and n_chars (null first).

    Null and wordless texts, and rows with a null doc_id, belong to no class and stay, each of them, whatever other rows
    the table holds.
    """
    docs = only(docs, *COLUMNS)
    kept = _kept(docs, near_duplicates(docs), ("doc_id", "text_hash"))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike("[^\\x00-\\x20]"), F.lit(False))
    if not docs.where(~alone).groupBy("doc_id").count().where("count > 1").limit(1).count():
        return kept  # no two rows to choose from
    rank = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text"), F.when(alone, F.monotonically_increasing_id())).orderBy(*[F.asc_nulls_first(c) for c in COLUMNS[2:]]))
    return kept.withColumn("_rank", rank).where(alone | (F.col("_rank") == 1)).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes or more that occur earlier; an emptied document stays, empty.

    A null text stays null, with a null n_chars. Null doc_ids come first in the order; rows alike don't cut each other.
    """
    cut = without_spans(removed_spans(only(docs, *COLUMNS), 100, carry=("lang", "source")))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated; in those kept, the words of any benchmark window are cut out.

    Null and wordless texts, and repeated rows, stay as they are judged, each by itself.
    """
    judged_rows = contamination(only(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("text", "lang", "source"))
    cut = without_spans(judged_rows.where(~F.col("contaminated")).select("doc_id", "text", "lang", "source", "spans"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids, of power-of-two lengths, none across documents.

    Null and empty texts are their end id alone; repeated rows are packed each.
    """
    return pack(only(docs, *COLUMNS), "word_bpe_49k.json", end_id=2)


STAGES = [("quality_rules", quality_rules), ("near_dup", near_dup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Robust estimates, sampled keys and tokenizers have no form in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
