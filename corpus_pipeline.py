"""A corpus cleaned in five stages: toxicity, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and is the next one's docs. All but the last
return the columns of docs. What a stage learns, it learns from its own docs, and from the labels in sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcert.llm import jaccard, langid, packing, suffixes, toxicity
from loomcert.llm.queries import held_out, to_pack
from loomcert.llm.util import read_table, stored, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out(5, 0))
    return toxicity.keep_ordinary(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_accepted(docs, langid.fit(docs, ~held_out(4, 2)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, of the least doc_id; rows are told apart by id and text, and of repeated ones one stays."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of a character that isn't kept whole go, too; n_chars, where there is one, follows the text. Texts may get empty, rows stay."""
    row, kept = unused(docs, "row"), unused(docs, "kept")
    cut = suffixes.repeated_bytes(docs, with_text=True).where("n_removed > 0").select(F.col("row").alias(row), F.col("kept").alias(kept)).dropDuplicates([row])
    rows = suffixes.with_row(docs, row).join(cut, row, "left")
    text = F.coalesce(F.col(kept), F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select([new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(stored(to_pack(docs), "to_pack"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_documents),
]

#: The classifiers, the search and the packing aren't expressible in SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
