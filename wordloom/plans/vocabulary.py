"""Vocabularies: the most frequent n-grams of each language with statistics within the language and across languages.

A language's counts are those of its texts one by one, summed, so the result doesn't depend on any order of texts.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.operators import ngrams as N
from wordloom.plans.corpus import Corpus
from wordloom.sources import storage as S

COLUMNS = "language string, ngram string, count bigint, frequency double, log_frequency double, rank int, global_frequency double, global_rank int"


@dataclass(frozen=True)
class Vocabulary:
    """How a vocabulary is made, and where it is kept."""

    name: str
    n_from: int = 2
    n_to: int = 4
    top: int = N.TOP
    path: str | None = None


def language_profiles(corpus: Corpus, vocabulary: Vocabulary) -> DataFrame:
    """(language, ngram, count, frequency, log_frequency, rank), the first ``top`` ranks. Tasks count in arrays, so the shuffle is as small as the languages' distinct
    n-grams of each task."""
    counts = N.range_counts(corpus.normalized(compose=False), vocabulary.n_from, vocabulary.n_to, ["language"], compose=True)
    totals = counts.groupBy("language").agg(F.sum("count").alias("total"))  # over the same exchange
    return N._stats(N.ranked(counts, "language", vocabulary.top).join(totals, "language"), "language")  # one row a language, small enough for Catalyst to broadcast by its size


def add_global_statistics(profiles: DataFrame) -> DataFrame:
    """Share of each language in an n-gram's count, over the entries that are in the profiles, and the language's place by that share."""
    same = Window.partitionBy("ngram")
    share = profiles.withColumn("global_frequency", F.col("count") / F.sum("count").over(same))
    place = F.row_number().over(same.orderBy(F.desc("global_frequency"), F.desc("language")))
    return share.withColumn("global_rank", place).select([c.split()[0] for c in COLUMNS.split(", ")])


def build(corpus: Corpus, vocabulary: Vocabulary) -> DataFrame:
    """Build a vocabulary of all the corpus' languages in one job. Where it has a path it is written there, by language, in a folder of its own beside those of earlier builds, which
    plans that read them still need; the latest counts."""
    made = add_global_statistics(language_profiles(corpus, vocabulary))
    if vocabulary.path:
        name = f"build-{time.time_ns():020d}-{uuid.uuid4().hex}"
        made.write.partitionBy("language").parquet(f"{vocabulary.path.rstrip('/')}/{name}")
        return load(made.sparkSession, vocabulary)
    return made


def build_all(corpus: Corpus) -> dict[str, DataFrame]:
    return {v.name: build(corpus, v) for v in corpus.known_vocabularies()}


def is_stored(spark: SparkSession, vocabulary: Vocabulary) -> bool:
    return bool(vocabulary.path and S.folders(spark, vocabulary.path))


def load(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """Read the latest finished build of a vocabulary; a filter on language prunes its partitions."""
    if not vocabulary.path:
        raise ValueError(f"vocabulary {vocabulary.name!r} has no path")
    found = S.folders(spark, vocabulary.path)
    if not found:
        raise ValueError(f"vocabulary {vocabulary.name!r} isn't at {vocabulary.path}")
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.read.schema(COLUMNS).parquet(f"{vocabulary.path.rstrip('/')}/{found[-1]}").select(columns)


def load_or_build(corpus: Corpus, vocabulary: Vocabulary) -> DataFrame:
    """The stored vocabulary where there is one, so that a corpus is read once, not by each detector."""
    return load(corpus.spark, vocabulary) if is_stored(corpus.spark, vocabulary) else build(corpus, vocabulary)


def get(vocabulary: DataFrame, language: str) -> DataFrame:
    return vocabulary.where(F.col("language") == language)


def top_n(vocabulary: DataFrame, language: str, n: int = N.TOP) -> DataFrame:
    """The n most frequent n-grams of a language; a language that isn't there is an error. What is looked into for that is kept, so the vocabulary is made once."""
    found = get(vocabulary, language).orderBy("rank").limit(max(n, 1)).cache()
    if found.isEmpty():
        found.unpersist()
        raise KeyError(language)
    return found.orderBy("rank").limit(n)
