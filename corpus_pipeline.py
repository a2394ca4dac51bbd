"""From raw documents to a deduplicated, mixed and tokenised corpus.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept and returns the columns of
``documents``; the last returns token ids in the order of the mix. An empty table passes through every stage.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from comarca.llm import line_dedup, mixing, near_dups, pieces, quality_model
from comarca.llm.frames import fresh, load
from comarca.session import durable


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts are scored as empty ones."""
    weights = quality_model.train(docs, load(spark, sf_dir, "labels"))
    named = docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c == "score"})
    scored = quality_model.apply_model(named, weights).where(F.col("score") >= quality_model.CUT).drop("score")
    return scored.withColumnsRenamed({f"_{c}": c for c in docs.columns if c == "score"}).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; a document that has lost every line with a word goes, one that had none stays."""
    lines, removed = fresh(docs, "n_lines", "n_removed")
    cut = line_dedup.dedup_lines(docs, **line_dedup.WHOLE, counts=(lines, removed))
    left = ~F.col("text").rlike(r"[^\x20\x09-\x0D]") & (F.col(removed) > 0)
    cut = cut.where(F.coalesce(~left, F.lit(True)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies: five-word shingles, similarity from 0.8 on."""
    return near_dups.drop_near_duplicates(docs, shingle=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.mix_sources(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, slot, seat, n_words, n_tokens, ids, round_trip`` in the order of the mix, which ``slot, seat`` tell."""
    placed = mixing.mix_places(docs.select("doc_id", "text", "source"), names=("slot", "seat", "block"))
    encoded = pieces.encode(placed, carry=("slot", "seat"))
    return mixing.in_order(encoded, mixing.count_slots(docs), "slot", "seat")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("source mix", mix),
    ("sentencepiece", tokenise),
]
#: No SQL: the classifier is trained, see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared checkpoint folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = durable(docs)
    return docs
