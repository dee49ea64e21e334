"""The queries of this subpackage, one per operator over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.session import new_path

from . import collocations, decontaminate, jaccard_join, language_id, line_spread, pieces, quality_rules, secrets, sharding
from . import suffix_dedup, token_files, warc, word_runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def _(spark, sf):
    return quality_rules.judge_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op2_language_id")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = language_id.fit_documents(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op3_decontamination")
def _(spark, sf):
    found = decontaminate.find_items(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return found.drop("text")


@query("op4_sentencepiece")
def _(spark, sf):
    import public_tokenizers

    return pieces.encode_documents(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_warc", warc.ORACLE)
def _(spark, sf):
    path = new_path(spark, "warc")
    warc.save_pages(table(spark, sf, "pages"), path)
    return warc.page_payloads(spark, path)


@query("op6_sharding", sharding.ORACLE)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign_shards(sized).drop("family")


@query("op7_suffix_dedup")
def _(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


@query("op8_jaccard_join")
def _(spark, sf):
    return jaccard_join.join_documents(table(spark, sf, "documents"))


@query("op9_secrets")
def _(spark, sf):
    return secrets.find_secrets(table(spark, sf, "documents"))


@query("op10_line_spread", line_spread.ORACLE)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    done = line_spread.remove_lines(docs)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_removed", digest.alias("clean_sha256"))


@query("op11_word_runs")
def _(spark, sf):
    return word_runs.find_runs(table(spark, sf, "documents"), loop=True)


@query("op12_token_files")
def _(spark, sf):
    import public_tokenizers

    return token_files.written_ids(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_collocations", collocations.ORACLE)
def _(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))
