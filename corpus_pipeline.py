"""The corpus pipeline: quality, near duplicates, decontamination, pseudonyms, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), and its result, written as Parquet and
read again, is the docs of the next. run() does the same over the documents table.
"""

from __future__ import annotations

from talus.llm import common as C
from talus.llm import decontaminate, jaccard, pieces, pii, quality


def drop_low_quality(spark, docs, sf_dir):
    """Documents that the discriminant rejects go."""
    return quality.keep(docs, C.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each class of near duplicates the document with the least id stays."""
    return jaccard.deduplicate(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, C.read(spark, sf_dir, "benchmark"))


def pseudonymize(spark, docs, sf_dir):
    """Personal data become pseudonyms in the text."""
    return pii.pseudonymize(docs)


def encode(spark, docs, sf_dir):
    """Token ids of each text."""
    return pieces.encode(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", pseudonymize),
    ("sentencepiece", encode),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = C.cut(docs)
    return docs
