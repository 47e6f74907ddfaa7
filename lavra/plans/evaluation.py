"""Evaluation plane: cases, summaries, comparisons. A stored answer is an assistant message of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators.scans import by_day, last_before
from ..session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def cases(spark: SparkSession, d: str) -> DataFrame:
    """One case a delivered answer: arm, workspace, flags and costs; the last delivery of an id counts."""
    m = table(spark, d, "messages").filter("id is not null").select("id", "conversation_id", "role", "model", "status", "latency_ms", "fits_in_window", "repaired", "feedback", "received_at", F.length("content").alias("chars"))
    last = m.groupBy("id").agg(F.max_by(F.struct("conversation_id", "role", "model", "status", "latency_ms", "fits_in_window", "repaired", "feedback", "chars"), "received_at").alias("x")).select("id", "x.*")
    conv = table(spark, d, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.max("workspace_id").alias("workspace_id"))
    return last.filter("lower(trim(role)) = 'assistant'").join(conv, "conversation_id").withColumn("error", F.coalesce(F.col("status") == "error", F.lit(False)))


_CASES = """k as (select id, arg_max(conversation_id, received_at) conversation_id, arg_max(role, received_at) r, arg_max_null(model, received_at) model, arg_max_null(status, received_at) status, arg_max_null(latency_ms, received_at) latency_ms,
  arg_max_null(fits_in_window, received_at) fits_in_window, arg_max_null(repaired, received_at) repaired, arg_max_null(feedback, received_at) feedback, length(arg_max(content, received_at)) chars from messages where id is not null group by id),
 v as (select id, max(workspace_id) workspace_id from conversations group by id),
 c as (select k.*, v.workspace_id, coalesce(k.status='error', false) error from k join v on v.id=k.conversation_id where lower(trim(r, ' '))='assistant')"""
_MEASURES = """count(*) as n, count(*) filter(error) as errors, avg(case when fits_in_window is not null then fits_in_window::double end) as fit_rate, avg(case when not error then coalesce(repaired,0)::double end) as repaired_rate,
  avg(case when not error then latency_ms::double end) as mean_latency, sum(case when not error then chars end) as chars"""


def measures() -> list:
    """Rates are null where nothing counts; errors stay in n but not in costs."""
    ok = ~F.col("error")
    return [
        F.count("*").alias("n"), F.count_if(F.col("error")).alias("errors"), F.avg(F.col("fits_in_window").cast("double")).alias("fit_rate"),
        F.avg(F.when(ok, F.coalesce("repaired", F.lit(0)).cast("double"))).alias("repaired_rate"), F.avg(F.when(ok, F.col("latency_ms").cast("double"))).alias("mean_latency"), F.sum(F.when(ok, F.col("chars"))).alias("chars"),
    ]


@query(f"with {_CASES} select model, {_MEASURES} from c group by model")
def arm_summary(spark, d):
    return cases(spark, d).groupBy("model").agg(*measures())


@query(f"with {_CASES} select model, workspace_id, {_MEASURES} from c group by grouping sets ((model),(workspace_id, model))")
def arm_workspace_summary(spark, d):
    c = cases(spark, d)
    return c.groupingSets([[F.col("model")], [F.col("workspace_id"), F.col("model")]], "model", "workspace_id").agg(*measures()).select("model", "workspace_id", "n", "errors", "fit_rate", "repaired_rate", "mean_latency", "chars")


@query(f"""with {_CASES} select workspace_id, coalesce(model, '(none)') as arm, count(*) as cases, count(*) filter(not error and status='answered') as answered from c group by 1, 2""")
def workspace_matrix(spark, d):
    """Cells of workspace and arm, whatever arms the answers have."""
    g = cases(spark, d).groupBy("workspace_id", F.coalesce("model", F.lit("(none)")).alias("arm"))
    return g.agg(F.count("*").alias("cases"), F.count_if(~F.col("error") & (F.col("status") == "answered")).alias("answered"))


@query(f"""with {_CASES}, m as (select workspace_id, model as arm, round(avg(latency_ms),6) mean from c where not error and model is not null and latency_ms is not null group by 1,2)
 select workspace_id, arm, mean as best, count(*) over (partition by workspace_id) as arms from m qualify count(*) over (partition by workspace_id)>=2 and row_number() over (partition by workspace_id order by mean, arm)=1""")
def best_of_arms(spark, d):
    """The fastest arm of each workspace that has two or more."""
    m = cases(spark, d).filter(~F.col("error") & F.col("model").isNotNull() & F.col("latency_ms").isNotNull()).groupBy("workspace_id", F.col("model").alias("arm")).agg(F.round(F.avg("latency_ms"), 6).alias("mean"))
    return m.groupBy("workspace_id").agg(F.min(F.struct("mean", "arm")).alias("x"), F.count("*").alias("arms")).filter("arms >= 2").select("workspace_id", "x.arm", F.col("x.mean").alias("best"), "arms")


_SHUT = "coalesce(regexp_matches(regexp_extract(regexp_extract(content, '(\\S[^\\n]*)', 1), '^([^.!?]*[.!?]?)', 1), '(?i)n[ãa]o consta nos documentos'), false)"


@query(f"""with {_CASES}, t as (select id, arg_max(content, received_at) content from messages where id is not null group by id)
 select id, (not error and not (coalesce(status in ('not_found','unsupported'), false) or {_SHUT}) and coalesce(status,'')<>'clarification') and coalesce(feedback,'')<>'down' as correct from c join t using (id)""")
def verdict_override(spark, d):
    """Whether an answer stands: no error, no abstention, no question back, and not marked wrong by a reader."""
    from ..functions.text import abstains

    m = table(spark, d, "messages").filter("id is not null").groupBy("id").agg(F.max_by("content", "received_at").alias("content"))
    c = cases(spark, d).join(m, "id")
    marked = c.filter("feedback = 'down'").select("id", F.lit(True).alias("wrong")).distinct()
    stands = ~F.col("error") & ~abstains(F.col("status"), F.col("content")) & (F.coalesce("status", F.lit("")) != "clarification")
    return c.join(marked, "id", "left").select("id", (stands & F.col("wrong").isNull()).alias("correct"))


@query("""with q as (select distinct row_id, id, workspace, topic, nivel, answerable from nucleo) select split_part(id,'-',1) as set_name, count(*) as questions, count(distinct workspace) as workspaces,
  count(*) filter(coalesce(regexp_replace(strip_accents(lower(answerable)),' ','','g') in ('nao','no','false','0','n'), false)) as unanswerable from q group by 1""")
def gold_sets(spark, d):
    from ..functions.text import fold

    q = table(spark, d, "nucleo").select("row_id", "id", "workspace", "topic", "nivel", "answerable").distinct()
    no = F.coalesce(F.regexp_replace(fold(F.col("answerable")), " ", "").isin("nao", "no", "false", "0", "n"), F.lit(False))
    return q.groupBy(F.split_part("id", F.lit("-"), F.lit(1)).alias("set_name")).agg(F.count("*").alias("questions"), F.countDistinct("workspace").alias("workspaces"), F.count_if(no).alias("unanswerable"))


@query(f"""with {_CASES} select conversation_id, id, row_number() over (partition by conversation_id order by id) as turn from c""")
def answer_turns(spark, d):
    return cases(spark, d).select("conversation_id", "id", F.row_number().over(W.partitionBy("conversation_id").orderBy("id")).alias("turn"))


@query("""with m as (select distinct id, conversation_id, role, content, created_at from messages where id is not null and conversation_id is not null and created_at is not null)
 select id, last_value(case when lower(trim(role,' '))='user' then content end ignore nulls) over (partition by conversation_id order by created_at, id rows between unbounded preceding and 1 preceding) as previous from m""")
def previous_user_turn(spark, d):
    m = table(spark, d, "messages").filter("id is not null and conversation_id is not null and created_at is not null").select("id", "conversation_id", "role", "content", "created_at").distinct()
    own = F.when(F.lower(F.trim("role")) == "user", F.col("content"))
    return last_before(m, ["conversation_id"], ["created_at", "id"], own, by_day("created_at"), "previous").select("id", "previous")
