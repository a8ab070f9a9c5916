"""The corpus pipeline: documents to token ids, in four stages.

Each stage takes what its predecessor has kept, as a table that was written and read
again, and each but the last returns the columns of ``documents``:

1. ``language``: documents whose language can't be identified go: those without a
   letter, and those of which no learned language contains enough of the n-grams: half,
   or less where the language's own texts have less (``language.Filters.bounds``).  The
   model is fitted on the stage's own input; if no row of it has a language, all
   documents with a letter stay.
2. ``near_dedup``: of each group of near copies (five-word shingles, Jaccard similarity
   of 0.8 or more) the document with the least id stays.
3. ``decontaminate``: documents with a passage of the benchmark go.
4. ``pieces``: whole texts as SentencePiece ids, with digests of ids and decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontaminate, language, near_dedup, pieces
from tidelog.llm.shared import materialise, table
from tidelog.scratch import scratch_scope


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, shingle_words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("language", identify_languages), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pieces", encode_pieces)]

#: Languages, component search and tokenisation aren't SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = [table(spark, sf_dir, "documents")]
    with scratch_scope(lambda: docs[-1:]):  # of the stages' tables the last one stays
        for name, stage in STAGES:
            docs.append(materialise(stage(spark, docs[-1], sf_dir), name))
    return docs[-1]
