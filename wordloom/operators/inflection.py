"""Pluralization of a column of words, and the same rules as SQL functions.

Rules are large CASE expressions, so a table's distinct words are inflected and joined back; an expression that must be used twice (the plural of a genitive's
owner) is a column of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import inflect

W, OWNERS = "__wl_word", "__wl_owners"
PARTS = ("noun", "verb", "adjective", "any", "article", "possessive", "genitive", "category")


def _with_owners(words: DataFrame) -> DataFrame:
    owner = words.withColumn("__wl_owner", F.expr(inflect.owner_sql(W)))
    return owner.withColumn(OWNERS, F.expr(inflect.noun_sql("__wl_owner", "modern"))).drop("__wl_owner")


def _sql(part: str, mode: str) -> tuple[str, bool]:
    """Expression over W (and OWNERS, if the second is true)."""
    inflect.check_mode(mode)
    if part == "noun":
        return inflect.noun_sql(W, mode), False
    if part == "verb":
        return inflect.verb_sql(W), False
    if part == "adjective":
        return inflect.adjective_sql(W, OWNERS), True
    if part == "any":
        return inflect.any_sql(W, OWNERS, mode), True
    if part == "article":
        return inflect.article_sql(W), False
    if part == "possessive":
        return inflect.possessive_sql(W), False
    if part == "genitive":
        return inflect.genitive_sql(OWNERS), True
    raise ValueError(f"part is one of {PARTS[:-1]}, not {part!r}")


def inflect_distinct(words: DataFrame, part: str, mode: str = "modern", word: str = "word", out: str = "plural") -> DataFrame:
    """``words`` with a column ``out``; meant for a table of distinct words."""
    sql, owners = _sql(part, mode)
    made = words.withColumn(W, F.col(word))
    made = _with_owners(made) if owners else made
    return made.withColumn(out, F.expr(sql)).drop(W, OWNERS)


def _column(df: DataFrame, part: str, mode: str, word: str, out: str) -> DataFrame:
    plurals = inflect_distinct(df.select(F.col(word).alias(word)).distinct(), part, mode, word, out)
    return df.join(plurals.withColumnRenamed(word, W), df[word].eqNullSafe(F.col(W)), "left").drop(W)


def pluralize_noun(df: DataFrame, word: str = "word", mode: str = "modern", out: str = "plural") -> DataFrame:
    return _column(df, "noun", mode, word, out)


def pluralize_verb(df: DataFrame, word: str = "word", out: str = "plural") -> DataFrame:
    return _column(df, "verb", "modern", word, out)


def pluralize_adjective(df: DataFrame, word: str = "word", out: str = "plural") -> DataFrame:
    return _column(df, "adjective", "modern", word, out)


def pluralize(df: DataFrame, word: str = "word", mode: str = "modern", out: str = "plural") -> DataFrame:
    return _column(df, "any", mode, word, out)


#: Membership predicates: (name, tables in modern mode, tables in classical mode).
CATEGORIES = {
    "uninflected": (("a2", "a3"),) * 2, "irregular": (("a1",),) * 2, "pronoun": (("a5",),) * 2, "possessive": (("a7",),) * 2, "ambiguous": (("a4",),) * 2,
    "irregular_verb": (("a8",),) * 2, "uninflected_verb": (("a9",),) * 2, "a_ae": (("a10",), ("a10", "a11")), "a_ata": (("a12",),) * 2, "en_ina": ((), ("a13",)),
    "ex_ices": (("a14",), ("a14", "a15")), "is_ides": (("a16",),) * 2, "o_os": (("a17", "a18"), ("a17",)), "o_i": (("a18",),) * 2, "on_a": (("a19",),) * 2,
    "um_a": (("a20",), ("a20", "a21")), "us_i": (("a22",),) * 2, "us_us": (("a23",),) * 2, "any_i": (("a24",),) * 2, "any_im": (("a25",),) * 2,
}


def categories_sql(w: str, mode: str = "modern", dialect: str = inflect.SPARK) -> str:
    """The names of the lexicon categories that the word belongs to, comma-joined in the order above, with the two suffix categories."""
    r = inflect.Rules(w, dialect)
    tests = [(name, r.among(*t[mode == "classical"])) for name, t in CATEGORIES.items() if t[mode == "classical"]]
    tests += [("herd", r.ends("deer", "fish", "itis", "ois", "pox", "sheep")), ("nationality", f"({r.ends('ese')} AND {r.upper_first()})")]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests) + ")"


def categories(words: DataFrame, mode: str = "modern", word: str = "word", out: str = "categories") -> DataFrame:
    inflect.check_mode(mode)
    return words.withColumn(W, F.col(word)).withColumn(out, F.expr(categories_sql(W, mode))).drop(W)


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions of one word, which Catalyst inlines: plural_noun, plural_noun_classical, plural_verb, plural_adjective, plural and
    plural_classical."""
    owners = inflect.noun_sql("o", "modern")
    own = inflect.owner_sql("w")
    through = lambda body: f"(SELECT {body} FROM (SELECT w AS w, {owners} AS p FROM (SELECT w AS w, {own} AS o)))"
    made = {
        "plural_noun": inflect.noun_sql("w"), "plural_noun_classical": inflect.noun_sql("w", "classical"), "plural_verb": inflect.verb_sql("w"),
        "plural_adjective": through(inflect.adjective_sql("w", "p")), "plural": through(inflect.any_sql("w", "p")), "plural_classical": through(inflect.any_sql("w", "p", "classical")),
    }
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(w STRING) RETURNS STRING RETURN {body}")
    return list(made)
