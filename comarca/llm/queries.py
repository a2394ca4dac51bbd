"""Queries of this subpackage and the SQL they must agree with."""

from pyspark.sql import functions as F

from comarca.llm import (
    filter_audit, language_id, licenses, line_dedup, mixing, near_dups, neighbours, pieces, pii, quality_model, quality_rules, url_filters, whitening,
)
from comarca.llm.frames import load

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_license_scan", licenses.oracle())
def op2(spark, folder):
    return licenses.scan_licenses(load(spark, folder, "documents"))


@query("op3_quality_classifier")
def op3(spark, folder):
    documents = load(spark, folder, "documents")
    weights = quality_model.train(documents, load(spark, folder, "labels"))
    return quality_model.score_quality(documents, weights)


@query("op6_url_filter", url_filters.oracle())
def op6(spark, folder):
    return url_filters.judge_urls(load(spark, folder, "pages")).drop("url")


@query("op10_quality_rules")
def op10(spark, folder):
    return quality_rules.quality_rules(load(spark, folder, "documents"))


@query("op1_nearest_neighbours")
def op1(spark, folder):
    return neighbours.nearest(load(spark, folder, "embeddings"))


@query("op7_source_mix")
def op7(spark, folder):
    return mixing.mix_report(load(spark, folder, "documents"))


@query("op5_personal_data")
def op5(spark, folder):
    documents = load(spark, folder, "documents")
    return pii.find_pii(documents, pii.train(documents), redact=False).drop("redacted")


@query("op4_near_duplicates")
def op4(spark, folder):
    return near_dups.near_duplicates(load(spark, folder, "documents"))


@query("op8_line_dedup")
def op8(spark, folder):
    documents = load(spark, folder, "documents")
    return line_dedup.dedup_lines(documents.select("doc_id", "text"), **line_dedup.WHOLE)


@query("op9_sentencepiece")
def op9(spark, folder):
    return pieces.encode(load(spark, folder, "documents"))


@query("op12_filter_audit", filter_audit.oracle())
def op12(spark, folder):
    masks = filter_audit.fail_masks(load(spark, folder, "documents"), load(spark, folder, "labels"))
    return filter_audit.audit(masks)


@query("op11_embedding_whitening")
def op11(spark, folder):
    return whitening.whiten_report(load(spark, folder, "embeddings"))


@query("op13_language_id")
def op13(spark, folder):
    documents = load(spark, folder, "documents")
    return language_id.identify(documents, language_id.train(documents))
