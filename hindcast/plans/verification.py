"""Queries that answer turns of conversations from a table of texts, and check what is claimed."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.operators import evidence as E

from .bindings import load, n, r

#: What no draft may say, by the code that it is withheld under.
INFLATION = {"certainty_inflation": ("certainly", "always"), "causality_inflation": (" proves ", " causes ")}
MOST, TOP = 3, 3


def asked(spark, d):
    """User turns, one row per conversation and turn."""
    c = load(spark, d, "conversations").where("role = 'user' and conv_id is not null and turn is not null")
    return c.groupBy("conv_id", "turn").agg(F.max("text").alias("question"))


def index(spark, d):
    return E.specific_words(load(spark, d, "benchmark"), "item_id", "text", MOST)


def retrieved_evidence(spark, d):
    """The benchmark items that share the most specific words with each user turn."""
    out = E.retrieved(asked(spark, d), ["conv_id", "turn"], "question", index(spark, d), TOP)
    return out.select("conv_id", "turn", n("place", "place"), F.col("item").alias("item_id"), n("score", "score"), F.array_join("shared", " ").alias("shared"))


def checked_turns(spark, d):
    """Two drafts of an answer to each user turn, checked: the turn that follows it, and the template over its evidence."""
    q = asked(spark, d)
    found = E.retrieved(q, ["conv_id", "turn"], "question", index(spark, d), TOP)
    own = E.packets(q, ["conv_id", "turn"], found, load(spark, d, "benchmark"), "item_id", "text")
    c = load(spark, d, "conversations").where("role = 'assistant'")
    following = c.groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.max("text").alias("next"))
    drafts = F.array(F.struct(F.lit("turn").alias("provider"), F.col("next").alias("draft")), F.struct(F.lit("template").alias("provider"), E.template(F.col("packet")).alias("draft")))
    both = own.join(following, ["conv_id", "turn"], "left").select("conv_id", "turn", "question", "packet", F.explode(drafts).alias("d"))
    return E.verified(both.select("conv_id", "turn", "question", "packet", "d.*"), "question", "draft", INFLATION)


def verified_answers(spark, d):
    out = checked_turns(spark, d)
    return out.select("conv_id", "turn", "provider", n("numbers", "numbers"), n("traceable", "traceable"), n("expected", "expected"), F.array_join("issues", ",").alias("issues"), F.sha2("answer", 256).alias("answer_sha256"))


def generation_summary(spark, d):
    out = E.generation_summary(checked_turns(spark, d), "provider")
    return out.select("provider", n("cases", "cases"), *[r(c, c, 6) for c in ("passed", "supported_passed", "refused", "cited")], n("numbers", "numbers"), n("failures", "failures"))


def document_claims(spark, d):
    """Documents as drafts over the benchmark items that they share specific words with: numbers that none of these holds, and the rest."""
    q = load(spark, d, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    found = E.retrieved(q, ["doc_id"], "text", index(spark, d), TOP)
    own = E.packets(q, ["doc_id"], found, load(spark, d, "benchmark"), "item_id", "text")
    out = E.verified(own.withColumn("question", F.lit(None).cast("string")), "question", "text", INFLATION)
    return out.select("doc_id", n("numbers", "numbers"), n("expected", "expected"), F.array_join("issues", ",").alias("issues"))


WORDS_SQL = lambda x: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[^\\s\\x0b.,]+'))"
NUMBERS_SQL = lambda x: f"list_transform(regexp_extract_all(coalesce({x}, ''), '(?:^|[^A-Za-z0-9_])(-?[0-9]+(?:\\.[0-9]+)?)', 1), lambda y: y::DOUBLE)"
SOURCE_SQL = "\\[source: ([^\\]]+)\\]"
SAYS = lambda phrases: " OR ".join(f"contains(lower(said), '{p}')" for p in phrases)


def found_sql(asked_sql: str, keys: str) -> str:
    """Prelude with q (keys, question) and hits, the retrieved items."""
    return f"""WITH q AS ({asked_sql}), bw AS (SELECT DISTINCT item_id AS item, unnest({WORDS_SQL('text')}) AS word FROM benchmark WHERE item_id IS NOT NULL),
      ix AS (SELECT word, item, {MOST + 1} - count(*) OVER (PARTITION BY word) AS weight FROM bw QUALIFY count(*) OVER (PARTITION BY word) <= {MOST}),
      qw AS (SELECT {keys}, unnest({WORDS_SQL('question')}) AS word FROM q), m AS (SELECT {keys}, item, sum(weight)::BIGINT AS score, list_sort(list(word)) AS shared FROM qw JOIN ix USING (word) GROUP BY ALL),
      hits AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, item) AS place FROM m QUALIFY place <= {TOP})"""


def checked_sql(asked_sql: str, keys: str, drafts_sql: str, question: str = "question") -> str:
    """Prelude that ends with c, the checked drafts; drafts_sql gives keys, provider and said over q and p."""
    codes = "".join(f", CASE WHEN {SAYS(phrases)} THEN '{code}' END" for code, phrases in INFLATION.items())
    return f"""{found_sql(asked_sql, keys)},
      p AS (SELECT {keys}, list(item::VARCHAR ORDER BY place) AS items, flatten(list(shared)) AS shared, string_agg('item ' || item || ' has ' || array_to_string(shared, ' ') || ' at ' || score || ' [source: ' || item || ']', '; ' ORDER BY place) AS template,
        list_concat(flatten(list({NUMBERS_SQL('b.text')})), list_concat(list(item::DOUBLE), list(score::DOUBLE))) AS held FROM hits JOIN benchmark b ON item = item_id GROUP BY ALL),
      dr AS ({drafts_sql}), v AS (SELECT *, {NUMBERS_SQL(f"regexp_replace(said, '{SOURCE_SQL}', '', 'g')")} AS claims, list_concat(coalesce(held, []), {NUMBERS_SQL(question)}) AS allowed,
        len(list_filter(coalesce(items, []), lambda i: list_contains(regexp_extract_all(said, '{SOURCE_SQL}', 1), i))) AS traceable, len(coalesce(items, [])) AS expected FROM dr LEFT JOIN q USING ({keys}) LEFT JOIN p USING ({keys})),
      c AS (SELECT *, array_to_string(list_filter([CASE WHEN expected = 0 AND NOT contains(lower(said), '{E.REFUSAL}') THEN 'unsupported_question_answered' END,
        CASE WHEN len(list_filter(claims, lambda x: len(list_filter(allowed, lambda e: abs(x - e) <= greatest(0.01, 0.02 * greatest(1, abs(e))))) = 0)) > 0 THEN 'unsupported_number' END{codes},
        CASE WHEN expected > 0 AND NOT list_has_any({WORDS_SQL(f"regexp_replace(said, '{SOURCE_SQL}', '', 'g')")}, shared) THEN 'evidence_omitted' END, CASE WHEN expected > 0 AND traceable = 0 THEN 'source_missing' END], lambda x: x IS NOT NULL), ',') AS issues FROM v)"""


ASKED_SQL = "SELECT conv_id, turn, max(text) AS question FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL"
TURNS_SQL = checked_sql(ASKED_SQL, "conv_id, turn", """SELECT conv_id, turn, 'turn' AS provider, coalesce(said, '') AS said FROM q LEFT JOIN (SELECT conv_id, turn - 1 AS turn, max(text) AS said FROM conversations WHERE role = 'assistant' GROUP BY ALL) USING (conv_id, turn)
        UNION ALL SELECT conv_id, turn, 'template', coalesce(template, 'Evidence is insufficient.') FROM q LEFT JOIN p USING (conv_id, turn)""")
DOCUMENTS_SQL = checked_sql("SELECT doc_id, max(text) AS question FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id", "doc_id", "SELECT doc_id, coalesce(question, '') AS said FROM q", "''")
QUERIES = {
    "retrieved_evidence": (retrieved_evidence, found_sql(ASKED_SQL, "conv_id, turn") + " SELECT conv_id, turn, place, item AS item_id, score, array_to_string(shared, ' ') AS shared FROM hits"),
    "verified_answers": (verified_answers, TURNS_SQL + " SELECT conv_id, turn, provider, len(claims) AS numbers, traceable, expected, issues, sha256(CASE WHEN issues = '' THEN said ELSE 'Withheld: ' || replace(issues, ',', ', ') END) AS answer_sha256 FROM c"),
    "generation_summary": (generation_summary, TURNS_SQL + """ SELECT provider, count(*) AS cases, round(avg((issues = '')::INT), 6) AS passed, round(avg((issues = '')::INT) FILTER (WHERE expected > 0), 6) AS supported_passed, round(avg((issues = '')::INT) FILTER (WHERE expected = 0), 6) AS refused,
        round(coalesce(sum(traceable) / nullif(sum(expected), 0), 1), 6) AS cited, sum(len(claims))::BIGINT AS numbers, count(*) FILTER (WHERE issues <> '') AS failures FROM c GROUP BY provider"""),
    "document_claims": (document_claims, DOCUMENTS_SQL + " SELECT doc_id, len(claims) AS numbers, expected, issues FROM c"),
}
