"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import read
from . import mixing, packing, pairs, passages, profiles, provenance, secrets, validity


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand in their repository."""
    return provenance.classify_files(read(spark, sf_dir, "source_files")).where("kind is not null").select("file_id")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per repository and kind of origin."""
    return provenance.classify_files(read(spark, sf_dir, "source_files")).groupBy("repo", "kind").count()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid in the language of their extension."""
    return validity.judge_files(read(spark, sf_dir, "source_files")).where("broken").select("file_id")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of invalid files per repository and language."""
    return validity.rates(validity.judge_files(read(spark, sf_dir, "source_files")))


def _passages(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    return passages.passages(*(read(spark, sf_dir, t) for t in ("source_files", "endpoints", "documents", "lang_codes")), with_text=with_text)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages other than English in files and endpoints."""
    return passages.found(_passages(spark, sf_dir))


def p2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of files and endpoints, once per language in it."""
    return _passages(spark, sf_dir, with_text=True)


def p2_file_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each language in every file."""
    return passages.record_shares(_passages(spark, sf_dir).where("record = 'file'"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of each language per repository, over the files that have it."""
    return p2_file_shares(spark, sf_dir).groupBy("repo", "lang").agg(F.count("*").alias("files"), F.avg("share").alias("mean_share"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files, and provider settings, that hold a credential."""
    return secrets.found(read(spark, sf_dir, "source_files"), read(spark, sf_dir, "ai_configs"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files and provider settings in which credentials were replaced."""
    return secrets.redacted(read(spark, sf_dir, "source_files"), read(spark, sf_dir, "ai_configs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, handlers and types with worthwhile documentation."""
    return pairs.found(*(read(spark, sf_dir, t) for t in ("source_files", "endpoints", "type_infos")))


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the code of a function, or a type, and its documentation, that of separate declarations included."""
    return pairs.pairs(read(spark, sf_dir, "source_files"), read(spark, sf_dir, "type_infos"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one, in its container, for each kind of container."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "containers"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used against the least possible."""
    return packing.report(p7_containers(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents and their copies."""
    return mixing.mix(*(read(spark, sf_dir, t) for t in ("documents", "mix_targets", "lang_codes")))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(p8_mixture(spark, sf_dir), read(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents without the right label, and of the segments of mixed ones."""
    return profiles.found(read(spark, sf_dir, "documents"), read(spark, sf_dir, "lang_codes"))


def p9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and segment."""
    return profiles.labels(read(spark, sf_dir, "documents"), read(spark, sf_dir, "lang_codes"))


FOUND = (p1_found, p1_kinds, p2_found, p2_passages, p2_file_shares, p2_shares, p4_found, p4_redacted, p5_found, p5_rates, p6_found, p6_pairs, p7_containers, p7_report, p8_mixture, p8_shares, p9_found, p9_labels)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in FOUND}
ORACLE: dict[str, str] = {}
