"""Queries of the training-data operators and, where SQL can say the same, their SQL (see ``sql.py``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import durable, load
from . import boilerplate, bpe, components, language, mixing, names, neardup, residue, setjoin

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _links(spark, d):
    return components.component_links(load(spark, d, "cluster_component_events")).unionByName(components.story_links(load(spark, d, "story_clusters")))


@query
def p1_found(spark, d):
    return components.group_records(_links(spark, d)).filter("members > 1").select("kind", "record_id", "group_id")


@query
def p6_found(spark, d):
    clusters = load(spark, d, "story_clusters")
    sets = None
    for field in ("themes", "mention_identifiers", "distinct_mention_sources"):
        own = clusters.select(F.lit(field).alias("field"), F.struct(F.lit(field).alias("field"), "cluster_id").alias("record"), F.col(field).alias("items")).filter("cluster_id is not null")
        sets = own if sets is None else sets.union(own)
    pairs = setjoin.similar_pairs(sets, "record", "items", 0.7, kind="field")
    return pairs.select("record_a.field", F.col("record_a.cluster_id").alias("cluster_id_a"), F.col("record_b.cluster_id").alias("cluster_id_b"))


@query
def p6_story_roots(spark, d):
    tables = [load(spark, d, t).select("cluster_id", "dominant_event_types") for t in ("story_clusters", "root_clusters")]
    pairs = setjoin.similar_pairs_between(*tables, "cluster_id", "dominant_event_types", 0.5)
    return pairs.select(F.col("record_a").alias("story_id"), F.col("record_b").alias("root_id"))


@query
def p8_ids(spark, d):
    return bpe.encode_corpus(load(spark, d, "documents"))


@query
def p9_mixture(spark, d):
    return mixing.mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).sequence()


@query
def p9_shares(spark, d):
    return mixing.mixture(load(spark, d, "documents"), load(spark, d, "mix_targets")).shares()


@query
def p10_found(spark, d):
    return language.wrong_labels(load(spark, d, "documents"))


@query
def p10_languages(spark, d):
    return language.classify(load(spark, d, "documents"))


def _pages(spark, d):
    return load(spark, d, "article_html_payloads"), load(spark, d, "extracted_article_payloads")


@query
def p3_found(spark, d):
    return residue.residue_pages(*_pages(spark, d))


@query
def p5_found(spark, d):
    return boilerplate.boilerplate_paragraphs(*_pages(spark, d))


@query
def p4_found(spark, d):
    pages, extracted = _pages(spark, d)
    models = residue.learn(extracted)
    gone = durable(residue.residue_pages(pages, extracted, models))
    around = durable(boilerplate.boilerplate_paragraphs(pages, extracted, models, spare_residue=False))
    same = neardup.similar_pages(extracted, gone, around).select(F.lit("page").alias("kind"), "record_a", "record_b")
    urls = neardup.same_article_urls(load(spark, d, "gdelt_events")).select(F.lit("url"), "record_a", "record_b")
    return same.union(urls).toDF("kind", "key_a", "key_b")


@query
def p2_found(spark, d):
    return names.variant_pairs(names.entity_names(*(load(spark, d, t) for t in ("story_clusters", "root_clusters", "gdelt_events"))))
