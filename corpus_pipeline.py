"""From raw documents to token ids: language, lines, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of docs.

In every stage an empty table gives an empty one, equal rows get equal
verdicts, a very long text is one row, judged whole, and columns of any name
pass through; what becomes of null and empty texts is said at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import decontaminate, jaccard_join, language_id, line_spread, pieces
from contactloom.session import written

OWN = ("doc_id", "text", "lang", "source")


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column no stage knows renamed by place, and the way back.

    So no column of the table can clash with one that an operator adds.
    """
    names = docs.columns
    held = [n if n in OWN else f"_held{i}" for i, n in enumerate(names)]

    def back(done: DataFrame) -> DataFrame:
        return done.select(*held).toDF(*names)

    return docs.toDF(*held), back


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language's centroids; rejected ones, null and letterless texts go."""
    held, back = _aside(docs)
    model = language_id.fit_documents(held)
    return back(language_id.identify(held, model).filter("not rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site lines; documents that held nothing else go. ``n_chars`` follows the text."""
    held, back = _aside(docs)
    done = back(line_spread.remove_lines(held).filter("text is null or n_lines > n_removed"))
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.length("text").cast(done.schema["n_chars"].dataType))
    return done


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id; all rows of that id.

    Texts without a word, null ones too, are near to nothing and stay.
    """
    held, back = _aside(docs)
    return back(jaccard_join.keep_one(held))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; those without a word are clean."""
    held, back = _aside(docs)
    return back(decontaminate.clean(held, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, counted and digested, and the digest of the text decoded from them; a null text has the end id only."""
    import public_tokenizers

    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language id", languages),
    ("line dedup", lines),
    ("jaccard join", near_copies),
    ("decontamination", benchmark_passages),
    ("sentencepiece", encoded),
]

#: No stage before the last is free of a fitted model or of a graph search; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{i}")
    return docs
