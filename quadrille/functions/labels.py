"""Index text: labels read out of IRIs, and what a chunk is indexed under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.terms import LITERAL, RDFS, W3

SKOS = W3 + "2004/02/skos/core#"
DEFAULT_LABEL_PREDICATES = (RDFS + "label", SKOS + "prefLabel", "http://schema.org/name")


def resolve_label_predicates(extra=()) -> list[str]:
    """The default label predicates, then the caller's own, each once."""
    return list(dict.fromkeys([*DEFAULT_LABEL_PREDICATES, *extra]))


def humanize(token: Column) -> Column:
    """Camel case, underscores and hyphens as spaces; a token of nothing else stays."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(token, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " "))
    return F.when(spaced == "", token).otherwise(spaced)


def local_label(iri: Column) -> Column:
    """What follows an IRI's last # or else its last /, humanized."""
    t = F.regexp_replace(iri, r"^\s+|\s+$", "")
    tail = lambda mark: F.regexp_extract(t, rf"(?s){mark}([^{mark}]+)$", 1)
    return F.when(t == "", F.lit("unknown entity")).otherwise(humanize(F.when(tail("#") != "", tail("#")).when(tail("/") != "", tail("/")).otherwise(t)))


def predicate_phrase(iri: Column) -> Column:
    return F.lower(local_label(iri))


def labels_per_subject(quads: DataFrame, extra=()) -> DataFrame:
    """s and labels, the sorted literal labels of each subject."""
    return quads.where(F.col("p").isin(resolve_label_predicates(extra)) & (F.col("o_kind") == LITERAL)).groupBy("s").agg(F.array_sort(F.collect_set("o")).alias("labels"))


def index_text(chunks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """chunks with fts_value: subject's label, predicate's phrase, the text and the subject's labels, empties left out."""
    if labels is not None:
        chunks = chunks.join(labels.select(F.col("s").alias("subject"), "labels"), "subject", "left")
    else:
        chunks = chunks.withColumn("labels", F.array().cast("array<string>"))
    parts = F.concat(F.array(local_label(F.col("subject")), predicate_phrase(F.col("predicate")), F.col("value")), F.coalesce("labels", F.array().cast("array<string>")))
    return chunks.withColumn("fts_value", F.array_join(F.filter(parts, lambda x: F.length(x) > 0), " ")).drop("labels")
