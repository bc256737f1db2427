"""From documents to packed training sequences, in stages over written tables.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of ``docs``. All but
the last return the columns of ``docs``; what a stage returns is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import mixing, packing, pii, simhash, toxicity
from weftgraph.llm.common import read, remove, shield, written
from weftgraph.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. It learns from the labelled rows of ``docs`` outside the held-out fold.

    Null and empty texts have the score of a sentence without words and stay in practice; repeated rows stay or go
    together; ids may be null; an empty table stays empty.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.kept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, a null id last.

    Null and empty texts are one group. Repeated rows leave one; of an id with several texts in a group the text with the
    least hash stays. An empty table stays empty.
    """
    return simhash.representatives(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind. n_chars follows the new text.

    A null text stays null (n_chars too), an empty one empty. Repeated rows stay repeated. An empty table stays empty.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and empty texts have no words and go with their neighbours in the order of ids; null sources are one source, null
    ids one id. Ties are broken by the md5 of ids, so reruns agree. An empty table stays empty.
    """
    own, names = shield(docs, "doc_id", "text", "source")
    mixed = mixing.mix(own).where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold every token of ``docs`` once.

    A null or empty text has its end token alone; repeated rows are packed as often as they occur; an empty table has no
    pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL trains the toxicity model or tokenizes; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents`` one after the other."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
