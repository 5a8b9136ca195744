"""Answers from evidence: topics, packets, template answers, and a check of every number that is claimed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.functions import scalar as S


def with_topic(questions: DataFrame, text: str, keywords: Sequence[tuple[str, str]]) -> DataFrame:
    """The first topic whose keyword the question holds, else null."""
    low = F.lower(F.col(text))
    topic = F.lit(None).cast("string")
    for name, word in reversed(list(keywords)):
        topic = F.when(F.contains(low, F.lit(word)), F.lit(name)).otherwise(topic)
    return questions.withColumn("topic", topic)


def packets(facts: DataFrame, topic: str, name: str, value: str) -> DataFrame:
    """(topic, facts, template): the facts of a topic in order of name, and the answer that states them and nothing else."""
    each = F.struct(F.col(name).alias("name"), F.col(value).alias("value"), S.printed(F.col(value), "%.2f").alias("said"))
    own = facts.select(F.col(topic).alias("_topic"), each.alias("_f")).groupBy("_topic").agg(F.array_sort(F.collect_list("_f")).alias("_all"))
    stated = F.transform("_all", lambda f: F.concat(f["name"], F.lit(" "), f["said"]))
    own = own.withColumn("facts", F.transform("_all", lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"))))
    return own.select(F.col("_topic").alias("topic"), "facts", F.concat(F.col("_topic"), F.lit(": "), F.array_join(stated, "; ")).alias("template"))


def grounded(questions: DataFrame, own: DataFrame, provider: Column) -> DataFrame:
    """Questions with ``answer`` and ``status``.

    provider is an expression over the question and its packet. Its answer stands if every number in it is a fact of the
    packet (GROUNDED); else the template takes its place (REPLACED). Without evidence there is no answer (REFUSED).
    """
    met = questions.join(own, "topic", "left").withColumn("_said", provider)
    loose = S.untraceable(S.numbers_in(F.col("_said")), F.transform("facts", lambda f: f["value"]), 0.005)
    status = F.when(F.col("facts").isNull(), "REFUSED").when(F.size(loose) == 0, "GROUNDED").otherwise("REPLACED")
    met = met.withColumn("status", status)
    return met.withColumn("answer", F.when(F.col("status") == "GROUNDED", F.col("_said")).when(F.col("status") == "REPLACED", F.col("template"))).drop("_said", "facts", "template")
