"""The queries of this subpackage and the DuckDB SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality, toxicity
from .common import scratch_scope, stored
from .exact_dedup import exact_groups
from .html_text import extract
from .language_id import identify, learn
from .lexical_search import search, search_sql
from .licenses import scan, scan_sql
from .mixing import mix
from .ngram_join import link
from .packing import pack_documents
from .periodic_runs import run_report
from .pii import report
from .substring_dedup import repeated_passages

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents, learnt from those that are not held out."""
    docs = _documents(spark, sf_dir)
    return identify(docs, learn(docs))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every row of documents."""
    return link(_documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of documents."""
    return mix(_documents(spark, sf_dir)).drop("copies")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack_documents(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document that has one."""
    return scan(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and the words that give it away, in every row of documents."""
    return report(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every row of documents, and whether it is kept by the rule and the model trained on labels."""
    docs = _documents(spark, sf_dir)
    return quality.judge(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of documents with the row of their group that stays."""
    return exact_groups(_documents(spark, sf_dir)).drop("keep_locator")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paragraphs of documents that other documents repeat."""
    return repeated_passages(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every row of documents."""
    return run_report(_documents(spark, sf_dir))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every row of documents is toxic, learnt from confirmed rows and unlabelled texts."""
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 of all documents for every row of benchmark."""
    with scratch_scope(spark):
        return stored(search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "best", keep=True)


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY n_cp DESC, doc_id)
"""


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_source_mixing": op3_source_mixing,
        "op4_license_scan": op4_license_scan,
        "op5_pii": op5_pii,
        "op6_quality_rules": op6_quality_rules,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_html_extraction": op8_html_extraction,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_toxicity": op12_toxicity,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scan": scan_sql(),
        "op7_exact_dedup": OP7_SQL,
        "op13_ranked_search": search_sql(),
    }
