"""A cleaning pipeline over ``documents``: five stages, each one corpus operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that it keeps, with the columns of ``documents``; the last
returns the kept documents' token ids.  ``run`` applies them to the table and
stores what each stage returns before the next one reads it.

Edge cases, for all stages: any column may be null and bear any name (rows are
carried as structs, so names can't clash); an empty table gives an empty result;
texts of any length are worked on whole, each by one worker.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscreen.llm import bpe, decontam, jaccard, langid, substring
from loomscreen.llm.storage import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, and so with a language that is the most probable one; the others go.

    No document is rejected for its score: texts of mixed languages, which stay,
    score less than junk with letters and texts of languages that aren't learned.
    Null, empty and letterless texts go; repeated rows are decided alike.
    """
    net = langid.learn(docs)
    kept = langid.predict(docs, net, carry=docs.columns).where(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.select("carried.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 connect: the one of the least id and text.

    Rows without a word link to nothing and stay; of repeated rows one stays; a
    null id stands back behind any other.
    """
    return jaccard.survivors(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of any repeated window of 35 words.

    A text that loses none is kept as it is, null or empty ones too; repeated
    rows count as occurrences of their own; n_chars is that of the new text.
    """
    # The texts come back from the index; only the other columns are carried along.
    rest = [c for c in docs.columns if c != "text"]
    out = substring.dedup(docs, carry=rest, verbatim=True)
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars"))
    new = {"text": F.col("kept"), "n_chars": n_chars}
    return out.select(*(new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; null and empty texts stay, repeated rows are decided alike."""
    found = decontam.text_leaks(docs.select("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("c1", "c2").distinct()
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *decontam.text_key(docs["text"]))
    return keyed.join(found, ["c1", "c2"], "left_anti").select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number, and digests of the ids and of the bytes that they decode to; a null text has none."""
    vocabulary, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.round_trip(docs, vocabulary, pattern), "ids")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express the network's predictions; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
