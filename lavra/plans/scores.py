"""Scores of evaluation cases: correctness, retrieval and citation of the expected item, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import abstains, contains_value, fold, item_covers
from ..operators.answers import cite, gate, grade, stored_answers
from ..operators.scans import by_rows, running_sum
from ..session import materialize, table
from .catalog import workspace_keys
from .dialogue import last_messages
from .evaluation import cases
from .kit import collector

query, QUERIES, ORACLE = collector()
#: What stands for no in a gold set, folded.
NO = ["nao", "no", "false", "0", "n"]


def gold_questions(spark: SparkSession, d: str) -> DataFrame:
    """``qid, workspace_id, topic, question, item, document, values, answerable``: gold questions whose workspace is known.

    Expected values are those between bars; a blank ``answerable`` means yes.
    """
    n = table(spark, d, "nucleo").select("row_id", "workspace", "topic", "question", "expected_item", "expected_document", "expected_values", "answerable").dropDuplicates(["row_id"])
    values = F.filter(F.transform(F.split(F.coalesce("expected_values", F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
    said = fold(F.trim(F.coalesce("answerable", F.lit(""))))
    return n.join(workspace_keys(spark, d).withColumnRenamed("key", "workspace"), "workspace").select(
        F.col("row_id").alias("qid"), "workspace_id", "topic", "question", F.nullif(F.trim("expected_item"), F.lit("")).alias("item"), F.nullif(F.trim("expected_document"), F.lit("")).alias("document"),
        values.alias("values"), (~said.isin(NO)).alias("answerable"))


def covers_item(item_number: Column, section_path: Column, text: Column, expected: Column) -> Column:
    """Whether a chunk covers an item: by its number, by a part of its section path, or by a clause in its text."""
    parts = F.transform(F.split(section_path, " [›>] "), lambda p: F.regexp_extract(p, r"^(\d+(?:\.\d+)*)", 1))
    inside = F.exists(parts, lambda n: (n == expected) | n.startswith(F.concat(expected, F.lit("."))))
    clause = F.concat(F.lit(r"(?m)(?:^|\s)"), F.replace(expected, F.lit("."), F.lit(r"\.")), F.lit(r"\.\s"))
    return item_covers(item_number, expected) | F.coalesce(inside, F.lit(False)) | F.coalesce(F.regexp_like(text, clause), F.lit(False))


def correct(answerable: Column, status: Column, abstained: Column, expected: Column, found: Column, citations: Column) -> Column:
    """No answer in the corpus: right if it abstains. Else no question back and no error; without expected values an answer; with them all of them, and a citation where it abstains."""
    refused = F.coalesce(status.isin("clarification", "error"), F.lit(False))
    return F.when(~answerable, abstained).when(refused, False).when(expected == 0, ~abstained).otherwise((found == expected) & (~abstained | (citations > 0)))


def score(questions: DataFrame, answers: DataFrame, citations: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """One row a case: ``answers`` (aid, qid, arm, mode, status, text, raw, latency, overhead, repaired, fits, removed, issues, …) against ``questions``.

    ``citations`` has aid, label, item_number, section_path, text and title of what each answer cites, ``retrieved``
    the same for its context. A hit is null without an expected item and in closed-book mode, true where the whole document was given.
    """
    j = answers.join(questions, "qid")
    found = lambda c: F.size(F.filter("values", lambda v: contains_value(F.coalesce(c, F.lit("")), v)))
    # the values of a question are few, so each is looked for in its answer
    j = j.withColumn("values_expected", F.size("values")).withColumn("values_found", found(F.col("text"))).withColumn("values_found_raw", found(F.coalesce("raw", "text")))
    j = j.withColumn("abstained", abstains(F.col("status"), F.col("text")))

    def hits(where: DataFrame, name: str) -> DataFrame:
        x = j.select("aid", "item", "document").join(where, "aid").filter("item is not null")
        in_document = F.col("document").isNull() | fold(F.coalesce("title", F.lit(""))).contains(fold(F.col("document")))
        ok = covers_item(F.col("item_number"), F.col("section_path"), F.col("chunk_text"), F.col("item")) & in_document
        return x.groupBy("aid").agg(F.max(ok).alias(name))

    c = citations.withColumnRenamed("text", "chunk_text")
    j = j.join(hits(c, "hit_cited"), "aid", "left").join(c.groupBy("aid").agg(F.count("*").alias("citations")), "aid", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))
    context = retrieved.withColumnRenamed("text", "chunk_text") if retrieved is not None else c
    j = j.join(hits(context, "hit_retrieved"), "aid", "left")
    applies = (F.coalesce("mode", F.lit("rag")) != "closed_book") & F.col("item").isNotNull()
    j = j.withColumn("retrieval_hit", F.when(applies, (F.coalesce("mode", F.lit("rag")) == "full_context") | F.coalesce("hit_retrieved", F.lit(False)))).withColumn("cited_expected", F.when(applies, F.coalesce("hit_cited", F.lit(False))))
    error = F.coalesce(F.col("status") == "error", F.lit(False))
    right = correct(F.col("answerable"), F.col("status"), F.col("abstained"), F.col("values_expected"), F.col("values_found"), F.col("citations"))
    return j.withColumn("correct", F.when(error, False).otherwise(right)).drop("hit_cited", "hit_retrieved", "values")


def measures() -> list[Column]:
    """The measures of a group of cases. Shares of correctness count errors as failures; costs and gate leave them out; null where nothing counts."""
    ok = F.coalesce(F.col("status") != "error", F.lit(True))
    share = lambda of, what: F.avg(F.when(of, what.cast("double")))
    yes, gated = F.col("answerable"), ok & F.col("grounded").isNotNull()
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4.0)
    return [
        F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.count_if(yes).alias("answerable"), F.count_if(~yes).alias("unanswerable"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"), share(yes, F.col("correct")).alias("answer_accuracy"), share(~yes, F.col("abstained")).alias("abstention_accuracy"),
        share(yes, F.col("abstained")).alias("false_abstention"), share(yes & (F.coalesce("mode", F.lit("rag")) == "rag") & F.col("retrieval_hit").isNotNull(), F.col("retrieval_hit")).alias("retrieval_hit_rate"),
        share(yes & F.col("cited_expected").isNotNull(), F.col("cited_expected")).alias("cited_expected_rate"), share(gated, F.col("grounded")).alias("grounded_rate"),
        share(gated, ~F.col("grounded") | (F.col("invalid") > 0)).alias("unreferenced_rate"), share(gated & F.col("misplaced").isNotNull(), F.col("misplaced") > 0).alias("misplaced_rate"),
        share(gated, (F.col("removed") > 0) | (F.col("unsupported") > 0)).alias("intervention_rate"), share(ok, F.coalesce("repaired", F.lit(0)) > 0).alias("repaired_rate"),
        F.avg(F.when(ok, (F.col("latency_ms") - F.coalesce("overhead", F.lit(0))).cast("double"))).alias("mean_latency"), F.avg(F.when(ok, F.coalesce("overhead", F.lit(0)).cast("double"))).alias("mean_overhead"),
        F.avg(F.when(ok, tokens.cast("double"))).alias("mean_tokens"), F.sum(F.when(ok, tokens)).alias("total_tokens"), F.avg((F.col("correct") & (F.coalesce("grounded", F.lit(False)) | F.col("abstained"))).cast("double")).alias("accuracy_with_reference"),
    ]


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The stored answers scored against the gold questions of their workspace.

    No run links an answer to a gold question here, so each answer takes the one of its workspace's questions that the hash of its id points to.
    """
    q = gold_questions(spark, d)
    asked = running_sum(q.select("workspace_id", "qid"), ["workspace_id"], ["qid"], F.lit(1), by_rows("qid"), "turn")
    many = q.groupBy("workspace_id").agg(F.count("*").alias("many"))
    texts = last_messages(spark, d).select("id", F.col("content").alias("text"))
    c = cases(spark, d).select("id", "workspace_id", "model", "status", "latency_ms", "repaired").join(texts, "id").join(many, "workspace_id")
    a = c.withColumn("turn", F.pmod(F.xxhash64("id"), "many")).join(asked, ["workspace_id", "turn"])
    answers, context = stored_answers(spark, d)
    g = gate(grade(answers, context), "warn").select("aid", "grounded", "removed", F.size("unsupported").alias("unsupported"), F.size("misplaced").alias("misplaced"))
    cited = cite(answers, context)
    a = a.select(F.col("id").alias("aid"), "qid", F.col("model").alias("arm"), F.lit("rag").alias("mode"), "status", "text", F.lit(None).cast("string").alias("raw"), "latency_ms", F.least("latency_ms", (1 + F.coalesce("repaired", F.lit(0))) * 1600).alias("overhead"), "repaired")
    a = a.join(g, "aid", "left").join(cited.select("aid", F.size("invalid").alias("invalid")), "aid", "left").withColumn("invalid", F.coalesce("invalid", F.lit(0)))
    docs = table(spark, d, "documents").select("document_id", "title")
    chunks = table(spark, d, "chunks").select("rowid", "document_id", "section_path").dropDuplicates(["rowid"]).join(docs, "document_id", "left")
    cites = context.join(chunks.select(F.col("rowid").alias("pos"), "section_path", "title"), "pos").select("aid", "label", "item_number", "section_path", "text", "title")
    # written once: questions are used on both sides of joins
    return score(materialize(spark, q, "gold"), materialize(spark, a, "answers"), materialize(spark, cites, "cites"))


@query()
def scored_cases(spark, d):
    """Every stored answer as a scored case."""
    return scored(spark, d).select("aid", "qid", "arm", "workspace_id", "topic", "status", "answerable", "values_expected", "values_found", "citations", "invalid", "abstained", "retrieval_hit", "cited_expected", "grounded", "correct")


@query()
def case_summary(spark, d):
    """The measures of every arm, over all workspaces and for each."""
    s = materialize(spark, scored(spark, d), "scored")
    return s.groupingSets([[F.col("arm")], [F.col("workspace_id"), F.col("arm")]], "arm", "workspace_id").agg(*measures())


@query()
def topic_arm_table(spark, d):
    """Cases and right ones by topic and arm; questions without a topic have a row of their own."""
    s = scored(spark, d)
    return s.groupBy(F.coalesce("topic", F.lit("(none)")).alias("topic"), F.coalesce("arm", F.lit("(none)")).alias("arm")).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


@query()
def expected_value_checks(spark, d):
    """Each expected value of the gold questions against the gold answer: whether it occurs there."""
    q = gold_questions(spark, d)
    a = table(spark, d, "nucleo").groupBy(F.col("row_id").alias("qid")).agg(F.max("expected_answer").alias("answer"))
    j = q.join(a, "qid").select("qid", "answer", F.posexplode("values").alias("p", "value"))
    return j.select("qid", (F.col("p") + 1).alias("pos"), "value", contains_value(F.coalesce("answer", F.lit("")), F.col("value")).alias("found"))
