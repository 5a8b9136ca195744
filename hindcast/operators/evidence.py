"""Evidence for questions out of a table of texts, and a check of what drafts of answers claim from it.

An inverted index holds the words that few items hold; a question meets the items that share such words with it. A
question word brings at most ``most`` items, so the join grows with the questions and never with pairs. A question that
shares none has no evidence, and the only right answer to it is a refusal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions import scalar as S

#: What a refusal says, in lower case.
REFUSAL = "insufficient"
SOURCE = r"\[source: ([^\]]+)\]"


def words(text: Column) -> Column:
    """Distinct words in lower case, parted by white space, dots and commas; none of a null text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([^\\s\\x0b.,]+)"), F.lit(1)))


def specific_words(evidence: DataFrame, item: str, text: str, most: int = 3) -> DataFrame:
    """(word, item, weight): the words that at most ``most`` items hold; the fewer hold one, the more it weighs.

    Rows that share an item count as one item; a null item is no evidence.
    """
    own = evidence.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.explode(words(F.col(text))).alias("word")).distinct()
    rare = own.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most)
    return own.join(rare, "word").select("word", "item", (most + 1 - F.col("_n")).alias("weight"))


def retrieved(questions: DataFrame, keys: Sequence[str], text: str, index: DataFrame, top: int = 3) -> DataFrame:
    """(keys, place, item, score, shared): the ``top`` items of each question by the weight of the words they share.

    Ties go to the least item. Keys tell questions apart and are never null; questions without evidence have no row.
    """
    asked = questions.select(*keys, F.explode(words(F.col(text))).alias("word"))
    met = asked.join(index, "word").groupBy(*keys, "item").agg(F.sum("weight").alias("score"), F.array_sort(F.collect_set("word")).alias("shared"))  # no more than the question's words
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "item"))
    return met.withColumn("place", place).where(F.col("place") <= top).select(*keys, "place", "item", "score", "shared")


def packets(questions: DataFrame, keys: Sequence[str], found: DataFrame, evidence: DataFrame, item: str, text: str) -> DataFrame:
    """questions with ``packet``: place, item, score, shared words and the numbers of the item's text; empty if unsupported."""
    numbers = evidence.select(F.col(item).alias("item"), S.claimed_numbers(F.col(text)).alias("numbers")).groupBy("item").agg(F.flatten(F.collect_set("numbers")).alias("numbers"))  # rows of one item
    kind = F.struct("place", "item", "score", "shared", F.coalesce("numbers", F.array().cast("array<double>")).alias("numbers"))
    own = found.join(numbers, "item", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(kind)).alias("packet"))  # the top items
    out = questions.join(own, list(keys), "left")
    return out.withColumn("packet", F.coalesce("packet", F.array().cast(own.schema["packet"].dataType)))


def template(packet: Column) -> Column:
    """The answer that states a packet and nothing else, with its sources; a refusal of an empty one."""
    line = lambda e: F.concat(F.lit("item "), e["item"].cast("string"), F.lit(" has "), F.array_join(e["shared"], " "), F.lit(" at "), e["score"].cast("string"), F.lit(" [source: "), e["item"].cast("string"), F.lit("]"))
    return F.when(F.size(packet) == 0, F.lit("Evidence is insufficient.")).otherwise(F.array_join(F.transform(packet, line), "; "))


def verified(drafts: DataFrame, question: str, draft: str, inflation: Mapping[str, Sequence[str]], share: float = 0.02) -> DataFrame:
    """Drafts with what a check of them against their packets finds, and the answer that may be given.

    ``issues`` holds, in this order: unsupported_question_answered (no evidence and no refusal), unsupported_number (a
    number outside its source marks that is no number of the evidence, its scores, its items or the question, within
    ``share`` of it), the keys of ``inflation`` one of whose phrases is said, evidence_omitted (no shared word is named),
    source_missing (no item of the packet is cited). A draft without issues is the answer, else its codes are; a null
    draft counts as empty. ``numbers``, ``traceable`` and ``expected`` count numbers, cited items and items.
    """
    said = F.coalesce(F.col(draft), F.lit(""))
    supported, low = F.size("packet") > 0, F.lower(said)
    bare = F.regexp_replace(said, SOURCE, "")
    cited = F.regexp_extract_all(said, F.lit(SOURCE), F.lit(1))
    of_item = lambda e: F.concat(e["numbers"], S.claimed_numbers(e["item"].cast("string")), F.array(e["score"].cast("double")))
    allowed = F.concat(F.flatten(F.transform("packet", of_item)), S.claimed_numbers(F.col(question)))
    near = lambda c: F.exists("_allowed", lambda e: F.abs(c - e) <= F.greatest(F.lit(0.01), share * F.greatest(F.lit(1.0), F.abs(e))))
    shared = F.flatten(F.transform("packet", lambda e: e["shared"]))
    out = drafts.withColumn("_claims", S.claimed_numbers(bare)).withColumn("_allowed", allowed)
    out = out.withColumn("numbers", F.size("_claims")).withColumn("expected", F.size("packet"))
    out = out.withColumn("traceable", F.size(F.filter("packet", lambda e: F.array_contains(cited, e["item"].cast("string")))))
    found = [
        F.when(~supported & ~F.contains(low, F.lit(REFUSAL)), "unsupported_question_answered"),
        F.when(F.exists("_claims", lambda c: ~near(c)), "unsupported_number"),
        *[F.when(F.size(S.phrases_in(said, phrases)) > 0, code) for code, phrases in inflation.items()],
        F.when(supported & ~F.arrays_overlap(words(bare), shared), "evidence_omitted"),
        F.when(supported & (F.col("traceable") == 0), "source_missing"),
    ]
    out = out.withColumn("issues", F.array_compact(F.array(*found)))
    answer = F.when(F.size("issues") == 0, said).otherwise(F.concat(F.lit("Withheld: "), F.array_join("issues", ", ")))
    return out.withColumn("answer", answer).drop("_claims", "_allowed")


def generation_summary(checked: DataFrame, provider: str) -> DataFrame:
    """Per provider: cases, passed shares of all, supported and unsupported cases, cited share of sources, numbers, failures."""
    passed, supported = (F.size("issues") == 0).cast("double"), F.col("expected") > 0
    return checked.groupBy(provider).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(passed).alias("passed"), F.avg(F.when(supported, passed)).alias("supported_passed"),
        F.avg(F.when(~supported, passed)).alias("refused"), F.coalesce(F.try_divide(F.sum("traceable"), F.sum("expected")), F.lit(1.0)).alias("cited"),
        F.sum("numbers").alias("numbers"), F.sum(F.lit(1) - passed).cast("long").alias("failures"),
    )
