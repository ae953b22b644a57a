"""From raw documents to packed training sequences, in five stages over the operators of ``webloom.llm``.

Each stage takes (spark, documents, folder of the tables) and returns a DataFrame; all but the last keep the columns of documents.

1. language_id: documents that the byte network cannot place in a language go (no letter at all, or no language at
   ``byte_cnn.keep_known``'s score); it is trained on the labelled documents outside the held-out fold.
2. line_dedup: multi-line chunks that stand earlier in the corpus are cut out; a document that loses everything goes.
3. ngram_jaccard: of documents linked by a Jaccard similarity of 0.8 over five-word shingles the one with the smallest id stays.
4. decontaminate: documents with a twentieth or more of their words in benchmark windows go.
5. pack: what is left is tokenised and packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import best_fit, byte_cnn, jaccard_join, line_chunks, suffix_decontaminate
from webloom.llm.queries import tokenizer_file
from webloom.llm.registry import table
from webloom.session import checkpointed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = byte_cnn.trained(docs.where(~byte_cnn.held_out()))
    return byte_cnn.keep_known(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_chunks.dedupe(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack(docs, tokenizer_file())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate), ("pack", pack)]

# trained, hashed and tokenised stages have no SQL; tests/llm checks each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
