"""Stored conversations: citations, follow-ups, scopes, costs of answers, lists, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import fold
from ..operators.scans import by_day, last_before, running_sum
from ..session import table
from .catalog import global_rank, retrievable
from .evaluation import _CASES, cases
from .kit import collector

query, QUERIES, ORACLE = collector()
_LABEL = r"\[(c_[0-9a-f]{6})\]"
#: The last delivery of each message.
_LAST = """m as (select id, arg_max(conversation_id, received_at) conversation_id, lower(trim(arg_max(role, received_at), ' ')) r, arg_max(content, received_at) content, arg_max(created_at, received_at) created_at from messages where id is not null group by id)"""
_CONV = "v as (select id, max(workspace_id) workspace_id from conversations group by id)"


def last_messages(spark, d) -> DataFrame:
    """``id, conversation_id, r, content, created_at``: the last delivery of each message with its role in lower case."""
    m = table(spark, d, "messages").filter("id is not null")
    # as the SQL does, each field is that of the last delivery in which it is not null
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("received_at"))).alias(c)
    g = m.groupBy("id").agg(last("conversation_id"), last("role"), last("content"), last("created_at"))
    return g.select("id", "conversation_id", F.lower(F.trim("role")).alias("r"), "content", "created_at")


def conversations_of(spark, d) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.max("workspace_id").alias("workspace_id"))


def citations(spark, d) -> DataFrame:
    """``id, conversation_id, ordinal, label``: the distinct labels of each answer by first appearance."""
    m = last_messages(spark, d).filter("r = 'assistant' and content is not null")
    return m.select("id", "conversation_id", F.posexplode(F.array_distinct(F.regexp_extract_all("content", F.lit(_LABEL), 1))).alias("p", "label")).select("id", "conversation_id", (F.col("p") + 1).alias("ordinal"), "label")


_CITED = f"""{_LAST}, l as (select id, conversation_id, unnest(regexp_extract_all(content, '\\[(c_[0-9a-f]{{6}})\\]', 1)) label, generate_subscripts(regexp_extract_all(content, '\\[(c_[0-9a-f]{{6}})\\]', 1),1) p from m where r='assistant' and content is not null),
 f as (select id, conversation_id, label, min(p) p from l group by all), cit as (select id, conversation_id, label, row_number() over (partition by id order by p)::int ordinal from f)"""


@query(f"""with {_CITED}, {_CONV}, c as (select workspace_id, label, min(rowid) rowid from chunks group by 1,2)
 select cit.id, ordinal, cit.label, c.rowid, coalesce(d.title,'') as title, coalesce(d.doc_type,'edital') as doc_type, c.rowid is not null as valid from cit left join v on v.id=cit.conversation_id left join c on c.workspace_id=v.workspace_id and c.label=cit.label
 left join (select distinct rowid, document_id from chunks) x on x.rowid=c.rowid left join documents d on d.document_id=x.document_id""")
def message_citations(spark, d):
    """Citations of every answer: the chunk its label names in the workspace, the document's title and type, and whether there is one."""
    c = table(spark, d, "chunks").groupBy("workspace_id", "label").agg(F.min(F.struct("rowid", "document_id")).alias("x")).select("workspace_id", "label", "x.*")
    j = citations(spark, d).join(conversations_of(spark, d), "conversation_id", "left").join(c, ["workspace_id", "label"], "left")
    j = j.join(table(spark, d, "documents").select("document_id", "title", "doc_type"), "document_id", "left")
    return j.select("id", "ordinal", "label", "rowid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("doc_type", F.lit("edital")).alias("doc_type"), F.col("rowid").isNotNull().alias("valid"))


@query(f"""with {_CITED}, k as (select distinct label from chunks) select m.id, trim(regexp_replace(regexp_replace(m.content, '[ \\t]*\\[c_[0-9a-f]{{6}}\\]', '', 'g'), '\\s+', ' ', 'g'), ' ') as plain, (select count(*) from cit where cit.id=m.id) as labels,
 (select count(*) from cit where cit.id=m.id and label in (select label from k)) as known from m where r='assistant' and content is not null""")
def uncited_text(spark, d):
    """Answers without their labels and the blanks before them, with the number of labels and of those some chunk has."""
    m = last_messages(spark, d).filter("r = 'assistant' and content is not null")
    k = table(spark, d, "chunks").select("label", F.lit(1).alias("is")).distinct()
    n = citations(spark, d).join(k, "label", "left").groupBy("id").agg(F.count("*").alias("labels"), F.count("is").alias("known"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("content", r"[ \t]*" + _LABEL, ""), r"\s+", " "))
    return m.select("id", plain.alias("plain")).join(n, "id", "left").select("id", "plain", F.coalesce("labels", F.lit(0)).alias("labels"), F.coalesce("known", F.lit(0)).alias("known"))


@query(f"""with {_CITED} select conversation_id, count(*) as citations, count(distinct label) as labels, list(label order by id, ordinal)[1] as first_label from cit where conversation_id is not null group by 1""")
def conversation_citations(spark, d):
    """Citations of each conversation: how many, of how many labels, and the first by answer and ordinal."""
    c = citations(spark, d).filter("conversation_id is not null")
    return c.groupBy("conversation_id").agg(F.count("*").alias("citations"), F.countDistinct("label").alias("labels"), F.min_by("label", F.struct("id", "ordinal")).alias("first_label"))


@query(f"""with {_CITED}, f2 as (select conversation_id, label, min_by(id, (m.created_at, id)) id from (select cit.*, m.created_at from cit join m using (id)) m where conversation_id is not null and m.created_at is not null group by 1,2)
 select conversation_id, id, count(*) as new_labels from f2 group by 1,2""")
def new_labels(spark, d):
    """How many labels each answer adds to those the conversation has cited before."""
    m = last_messages(spark, d).filter("created_at is not null").select("id", "created_at")
    c = citations(spark, d).filter("conversation_id is not null").join(m, "id")
    return c.groupBy("conversation_id", "label").agg(F.min_by("id", F.struct("created_at", "id")).alias("id")).groupBy("conversation_id", "id").agg(F.count("*").alias("new_labels"))


@query(f"""with {_CITED}, o as (select cit.conversation_id, label, ordinal, row_number() over (partition by cit.conversation_id, ordinal order by m.created_at, cit.id) turn from cit join m using (id) where cit.conversation_id is not null and m.created_at is not null),
 f2 as (select conversation_id, label, min((ordinal, turn)) k from o group by 1,2) select conversation_id, label, row_number() over (partition by conversation_id order by k) as place from f2""")
def interleaved_citations(spark, d):
    """The citations of a conversation's answers interleaved: first labels of all answers, then second ones; each label once."""
    m = last_messages(spark, d).filter("created_at is not null").select("id", "created_at")
    c = citations(spark, d).filter("conversation_id is not null").join(m, "id")
    f = c.groupBy("conversation_id", "label").agg(F.min(F.struct("ordinal", "created_at", "id")).alias("k"))
    # labels of one conversation and ordinal are one for each answer, so a place is a count of smaller keys in two steps
    f = f.select("conversation_id", "label", F.col("k.ordinal").alias("ordinal"), F.col("k.created_at").alias("t"), F.col("k.id").alias("id"))
    return running_sum(f, ["conversation_id"], ["ordinal", "t", "id"], F.lit(1), F.col("ordinal"), "place", own=True).select("conversation_id", "label", "place")


_FOLLOW = r"^(e|mas|então|entao|nesse caso|nesses casos|e se|também|tambem)\b|\b(isso|esse|essa|esses|essas|este|esta|dele|dela|deles|delas|nele|nela|mesmo|mesma|anterior)\b"


@query(f"""with {_LAST} select id, len(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w)>2))<5 or regexp_matches(lower(trim(content)), '(^|[^\\p{{L}}])(isso|esse|essa|esses|essas|este|esta|dele|dela|deles|delas|nele|nela|mesmo|mesma|anterior)($|[^\\p{{L}}])|^(e|mas|então|entao|nesse caso|nesses casos|e se|também|tambem)($|[^\\p{{L}}])') as follow_up
 from m where r='user' and content is not null""")
def follow_ups(spark, d):
    """Whether a question leans on the one before: fewer than five words of three letters, a pronoun, or an opening connective."""
    m = last_messages(spark, d).filter("r = 'user' and content is not null")
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)
    pattern = r"(^|[^\p{L}])(isso|esse|essa|esses|essas|este|esta|dele|dela|deles|delas|nele|nela|mesmo|mesma|anterior)($|[^\p{L}])|^(e|mas|então|entao|nesse caso|nesses casos|e se|também|tambem)($|[^\p{L}])"
    return m.select("id", ((F.size(words) < 5) | F.lower(F.trim("content")).rlike(pattern)).alias("follow_up"))


@query(f"""with {_LAST}, u as (select *, lag(content) over (partition by conversation_id order by created_at, id) before from m where r='user' and content is not null and conversation_id is not null and created_at is not null)
 select id, case when before is not null and len(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w)>2))<5 then before || ' ' || content else content end as condensed from u""")
def condensed_questions(spark, d):
    """Short questions with the user's question before put in front."""
    m = last_messages(spark, d).filter("r = 'user' and content is not null and conversation_id is not null and created_at is not null")
    m = last_before(m, ["conversation_id"], ["created_at", "id"], F.col("content"), by_day("created_at"), "before")
    short = F.size(F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2)) < 5
    return m.select("id", F.when(F.col("before").isNotNull() & short, F.concat("before", F.lit(" "), "content")).otherwise(F.col("content")).alias("condensed"))


_CHASE = r"n[ãa]o (consta|encontrei|foi encontrad|h[áa] informa|localizei|est[áa] previst)|sem informa[çc][ãa]o|n[ãa]o [ée] poss[íi]vel (responder|determinar)"


@query(f"""with {_LAST} select id, coalesce(regexp_matches(content, '(?i){_CHASE}'), false) as chase, length(trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ')) as chars,
 case when length(trim(regexp_replace(content, '\\s+', ' ', 'g'), ' '))>200 then left(trim(regexp_replace(content, '\\s+', ' ', 'g'), ' '),199) || '…' else trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') end as excerpt from m where r='assistant' and content is not null""")
def answer_excerpts(spark, d):
    """Whether an answer looks like it found nothing, so that another search is worth while, and its first 200 characters."""
    m = last_messages(spark, d).filter("r = 'assistant' and content is not null").withColumn("x", F.trim(F.regexp_replace("content", r"\s+", " ")))
    return m.select("id", F.col("content").rlike("(?iu)" + _CHASE).alias("chase"), F.length("x").alias("chars"), F.when(F.length("x") > 200, F.concat(F.substring("x", 1, 199), F.lit("…"))).otherwise(F.col("x")).alias("excerpt"))


@query(f"""with {_CASES}, x as (select *, ceil(coalesce(chars,0)/4.0)::bigint tokens, least(latency_ms, (1+coalesce(repaired,0))*1600) overhead from c)
 select id, tokens, overhead, greatest(0, latency_ms-overhead) as residual from x""")
def answer_costs(spark, d):
    """Estimated tokens (four characters each), overhead (1,600 ms a call, a repair being a second one), and what is left of the latency."""
    c = cases(spark, d)
    overhead = F.when(F.col("latency_ms").isNotNull(), F.least("latency_ms", (1 + F.coalesce("repaired", F.lit(0))) * 1600)).otherwise((1 + F.coalesce("repaired", F.lit(0))) * 1600)
    return c.select("id", F.ceil(F.coalesce("chars", F.lit(0)) / 4.0).alias("tokens"), overhead.alias("overhead"), F.greatest(F.lit(0), F.col("latency_ms") - overhead).alias("residual"))


@query(f"""with {_CASES} select coalesce(model,'(none)') as arm, sum(latency_ms) as latency, sum(repaired) as repairs, sum(case when status='partial' then chars end) as partial_chars from c group by 1""")
def arm_usage(spark, d):
    """Sums by arm; null where no answer has a value."""
    return cases(spark, d).groupBy(F.coalesce("model", F.lit("(none)")).alias("arm")).agg(F.sum("latency_ms").alias("latency"), F.sum("repaired").alias("repairs"), F.sum(F.when(F.col("status") == "partial", F.col("chars"))).alias("partial_chars"))


@query(f"""with {_CASES}, g as (select id, case when status is null then 'off' when coalesce(repaired,0)=1 then 'strict' when status='partial' then 'strict' else 'warn' end gate from c)
 select gate, count(*) as cases from g group by 1""")
def gate_policies(spark, d):
    """The policy of the gate an answer shows: strict where it was repaired or cut, warn where it has a status, else off."""
    gate = F.when(F.col("status").isNull(), "off").when((F.coalesce("repaired", F.lit(0)) == 1) | (F.col("status") == "partial"), "strict").otherwise("warn")
    return cases(spark, d).groupBy(gate.alias("gate")).agg(F.count("*").alias("cases"))


@query(f"""with {_CASES}, t as (select c.workspace_id, c.model, cv.mode from c left join (select id, arg_max(mode, updated_at) mode from conversations group by id) cv on cv.id=c.conversation_id)
 select coalesce(mode,'(none)') as topic, count(*) filter(model is not null) as with_arm, count(*) as n, count(distinct workspace_id) as workspaces from t group by 1""")
def topic_matrix(spark, d):
    """Cases by the mode of their conversation; a missing one has a row of its own."""
    mode = table(spark, d, "conversations").groupBy(F.col("id").alias("conversation_id")).agg(F.max_by("mode", F.when(F.col("mode").isNotNull(), F.col("updated_at"))).alias("mode"))
    t = cases(spark, d).join(mode, "conversation_id", "left")
    return t.groupBy(F.coalesce("mode", F.lit("(none)")).alias("topic")).agg(F.count("model").alias("with_arm"), F.count("*").alias("n"), F.countDistinct("workspace_id").alias("workspaces"))


@query(f"""with {_CASES}, x as (select workspace_id, model, id, row_number() over (partition by workspace_id order by id) p from c where workspace_id is not null)
 select workspace_id, list(id order by id)[:20] as first_cases, count(*) as cases from x group by 1""")
def workspace_case_lists(spark, d):
    """The first twenty cases of each workspace in order, and how many there are."""
    c = cases(spark, d).filter("workspace_id is not null").select("workspace_id", "id")
    n = c.groupBy("workspace_id").agg(F.count("*").alias("cases"))
    first = c.withColumn("p", F.row_number().over(W.partitionBy("workspace_id").orderBy("id"))).filter("p <= 20").groupBy("workspace_id").agg(F.array_sort(F.collect_list("id")).alias("first_cases"))
    return n.join(first, "workspace_id").select("workspace_id", "first_cases", "cases")


@query(f"""with {_CASES}, done as (select distinct workspace_id, model from c where not error and model is not null), arms as (select distinct model from c where model is not null), w as (select distinct workspace_id from c)
 select w.workspace_id, arms.model as arm from w cross join arms where not exists (select 1 from done where done.workspace_id=w.workspace_id and done.model=arms.model)""")
def pending_cells(spark, d):
    """Workspaces and arms that a resumed run still has to do: a small grid (workspaces x arms) without what is done."""
    c = cases(spark, d).select("workspace_id", "model", "error")
    arms = F.broadcast(c.filter("model is not null").select(F.col("model").alias("arm")).distinct())  # a handful
    done = c.filter("not error and model is not null").select("workspace_id", F.col("model").alias("arm")).distinct()
    return c.select("workspace_id").distinct().join(arms).join(done, ["workspace_id", "arm"], "left_anti")


@query(f"""with {_LAST}, x as (select id, created_at from m where r='assistant' and created_at is not null) select id, row_number() over (order by created_at desc, id desc) as place from x""")
def newest_answers(spark, d):
    """Answers from the newest on."""
    m = last_messages(spark, d).filter("r = 'assistant' and created_at is not null").select("id", "created_at")
    return global_rank(spark, m, [F.col("created_at").desc(), F.col("id").desc()], "place").select("id", "place")


@query("""with c as (select id, max(updated_at) u, max(created_at) c from conversations group by id) select id, row_number() over (order by u desc nulls last, id desc) as place, row_number() over (order by c desc nulls last, id desc) as created_place from c""")
def conversation_order(spark, d):
    """Conversations by last change and by creation, the newest first."""
    c = table(spark, d, "conversations").groupBy("id").agg(F.max("updated_at").alias("u"), F.max("created_at").alias("c"))
    a = global_rank(spark, c, [F.col("u").desc_nulls_last(), F.col("id").desc()], "place").select("id", "place")
    return a.join(global_rank(spark, c, [F.col("c").desc_nulls_last(), F.col("id").desc()], "created_place").select("id", "created_place"), "id")


@query("""with c as (select id, arg_max(scope_json, updated_at) s, arg_max(workspace_id, updated_at) w from conversations group by id), j as (select id, w, case when s is null or trim(s)='' then '{}' else s end s from c),
 n as (select workspace_id, count(*) docs from documents where status='ready' and is_current group by 1)
 select j.id, coalesce(json_array_length(json_extract(s, '$.documentIds')),0)::int as listed, case when coalesce(json_array_length(json_extract(s, '$.documentIds')),0)=0 then coalesce(n.docs,0) else 0 end as all_documents from j left join n on n.workspace_id=j.w""")
def conversation_scopes(spark, d):
    """Documents a conversation's scope lists; an empty list, an empty text and none stand for all retrievable ones of the workspace."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c)
    c = table(spark, d, "conversations").groupBy("id").agg(last("scope_json"), last("workspace_id"))
    ids = F.from_json(F.when(F.trim("scope_json") != "", F.col("scope_json")), "documentIds array<string>")["documentIds"]
    n = retrievable(table(spark, d, "documents")).groupBy("workspace_id").agg(F.count("*").alias("docs"))
    listed = F.coalesce(F.size(ids), F.lit(0))
    listed = F.when(listed < 0, 0).otherwise(listed)
    j = c.join(n, "workspace_id", "left").withColumn("listed", listed)
    return j.select("id", "listed", F.when(F.col("listed") == 0, F.coalesce("docs", F.lit(0))).otherwise(0).alias("all_documents"))


@query("""select distinct id, coalesce(json_array_length(regexp_extract(parts_json, '(?s)\\[.*\\]')),0)::int as parts, json_extract_string(regexp_extract(parts_json, '(?s)\\[.*\\]'), '$[0].type') as first_type from messages where id is not null and parts_json is not null""")
def message_parts(spark, d):
    """Parts of a message: the JSON from the first to the last bracket, read with none as a fallback."""
    m = table(spark, d, "messages").filter("id is not null and parts_json is not null").select("id", F.regexp_extract("parts_json", r"(?s)\[.*\]", 0).alias("j"))
    parts = F.from_json("j", "array<struct<type string>>".replace("type string", "type:string"))
    return m.select("id", F.when(parts.isNull(), 0).otherwise(F.size(parts)).alias("parts"), parts[0]["type"].alias("first_type")).distinct()


@query("""with m as (select id, arg_max(role, received_at) role, arg_max(feedback, received_at) f from messages where id is not null group by id) select id, case when lower(trim(role,' '))='assistant' then f end as feedback from m""")
def feedback_of_answers(spark, d):
    """Feedback counts on answers only."""
    m = table(spark, d, "messages").filter("id is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("received_at"))).alias(c)
    m = m.groupBy("id").agg(last("role"), last("feedback"))
    return m.select("id", F.when(F.lower(F.trim("role")) == "assistant", F.col("feedback")).alias("feedback"))


@query("""with c as (select id, updated_at, title, mode, model from conversations where updated_at is not null) select id, arg_max(title, updated_at) as title, arg_max(mode, updated_at) as mode, count(*) as versions from c group by id""")
def patched_conversations(spark, d):
    """Versions of a conversation laid over each other: each field is that of the last version that sets it."""
    c = table(spark, d, "conversations").filter("updated_at is not null")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("updated_at"))).alias(x)
    return c.groupBy("id").agg(last("title"), last("mode"), F.count("*").alias("versions"))


@query(f"""with {_LAST}, {_CONV} select coalesce(v.workspace_id,'(unknown)') as workspace_id, m.r as role, count(*) as messages, sum(length(content)) as chars from m left join v on v.id=m.conversation_id group by 1,2""")
def message_volume(spark, d):
    """Messages and characters by workspace and role."""
    m = last_messages(spark, d).join(conversations_of(spark, d), "conversation_id", "left")
    return m.groupBy(F.coalesce("workspace_id", F.lit("(unknown)")).alias("workspace_id"), F.col("r").alias("role")).agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("chars"))


@query("""with q as (select distinct row_id, workspace, expected_document from nucleo where trim(expected_document)<>''), k as (select key, ws from (select call_code as key, id ws, 2 o from workspaces union all select name, id, 1 from workspaces union all select id, id, 0 from workspaces) where key is not null qualify row_number() over (partition by key order by o desc, ws desc)=1)
 select q.row_id, count(d.document_id) as documents from q join k on k.key=q.workspace left join documents d on d.workspace_id=k.ws and d.title is not null and contains(regexp_replace(strip_accents(lower(d.title)), '\\p{M}', '', 'g'), regexp_replace(strip_accents(lower(q.expected_document)), '\\p{M}', '', 'g')) group by 1""")
def expected_documents(spark, d):
    """How many documents of a question's workspace have the expected title in theirs, accents and case apart.

    Distinct titles of a workspace meet its distinct expected titles, which are few.
    """
    from .catalog import workspace_keys

    q = table(spark, d, "nucleo").filter("trim(expected_document) <> ''").select("row_id", "workspace", fold(F.col("expected_document")).alias("want")).distinct().join(workspace_keys(spark, d).withColumnRenamed("key", "workspace"), "workspace")
    titles = table(spark, d, "documents").filter("title is not null").groupBy("workspace_id", fold(F.col("title")).alias("have")).agg(F.count("*").alias("n"))
    asked = q.select("workspace_id", "want").distinct()
    hits = asked.join(titles, "workspace_id").filter(F.col("have").contains(F.col("want"))).groupBy("workspace_id", "want").agg(F.sum("n").alias("n"))
    return q.join(hits, ["workspace_id", "want"], "left").select("row_id", F.coalesce("n", F.lit(0)).alias("documents"))


@query("""with q as (select distinct row_id, topic, regexp_replace(strip_accents(lower(trim(nivel))), '\\p{M}', '', 'g') nivel from nucleo) select coalesce(topic,'(none)') as topic, coalesce(nivel,'(none)') as nivel, count(*) as questions from q group by 1,2""")
def questions_by_level(spark, d):
    """Questions by topic and level, levels in one spelling."""
    q = table(spark, d, "nucleo").select("row_id", "topic", fold(F.trim("nivel")).alias("nivel")).distinct()
    return q.groupBy(F.coalesce("topic", F.lit("(none)")).alias("topic"), F.coalesce("nivel", F.lit("(none)")).alias("nivel")).agg(F.count("*").alias("questions"))


@query("""with q as (select distinct row_id, id, workspace, question from nucleo where id is not null), w as (select id ws from workspaces where id in (select min(id) from workspaces)) select q.row_id, q.id || '-' || w.ws as id, w.ws as workspace, q.question from q cross join w where q.workspace<>w.ws or q.workspace is null""")
def replicated_questions(spark, d):
    """The gold set laid out for one more workspace, the first: each question that is not its own, under a new id."""
    w = table(spark, d, "workspaces").agg(F.min("id").alias("ws"))  # one row
    q = table(spark, d, "nucleo").filter("id is not null").select("row_id", "id", "workspace", "question").distinct().join(F.broadcast(w))
    return q.filter("workspace <> ws or workspace is null").select("row_id", F.concat("id", F.lit("-"), "ws").alias("id"), F.col("ws").alias("workspace"), "question")


@query("""select document_id, workspace_id, coalesce(status='ready' and doc_type in ('edital','apoio'), false) as selectable, coalesce(status='ready' and doc_type='edital', false) as always_in from documents""")
def selectable_documents(spark, d):
    """Documents a reader may choose from: ready ones; principal texts are always in, supporting ones where they or none are chosen."""
    ready = F.col("status") == "ready"
    return table(spark, d, "documents").select("document_id", "workspace_id", F.coalesce(ready & F.col("doc_type").isin("edital", "apoio"), F.lit(False)).alias("selectable"), F.coalesce(ready & (F.col("doc_type") == "edital"), F.lit(False)).alias("always_in"))


@query(f"""with {_CASES}, p as (select id, arg_max(mode, received_at) mode, arg_max(provider, received_at) provider from messages where id is not null group by id)
 select coalesce(c.model,'(none)') as arm, coalesce(p.mode,'(none)') as mode, coalesce(p.provider,'(none)') as provider, count(*) as cases, count(distinct c.workspace_id) as workspaces from c join p using (id) group by 1,2,3""")
def answer_arms(spark, d):
    """The arms of the stored answers: model, mode and provider, with their cases and workspaces."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("received_at"))).alias(c)
    p = table(spark, d, "messages").filter("id is not null").groupBy("id").agg(last("mode"), last("provider"))
    named = lambda c: F.coalesce(c, F.lit("(none)"))
    return cases(spark, d).select("id", "model", "workspace_id").join(p, "id").groupBy(named("model").alias("arm"), named("mode").alias("mode"), named("provider").alias("provider")).agg(F.count("*").alias("cases"), F.countDistinct("workspace_id").alias("workspaces"))


@query(f"""with {_CASES} select coalesce(model,'(none)') as arm, count(*) as n, round(avg(case when not error and status is not null then (status in ('answered','partial'))::int end),6) as answered, round(avg(case when status is null then null when status='partial' then 1 else 0 end),6) as cut,
 round(avg(case when error then null else (status in ('not_found','unsupported'))::int end),6) as declined from c group by 1""")
def published_rates(spark, d):
    """Shares by arm as they are shown: errors left out, answers without a status not counted."""
    c, ok = cases(spark, d), ~F.col("error")
    rate = lambda of, what, name: F.round(F.avg(F.when(of, what.cast("double"))), 6).alias(name)
    known = F.col("status").isNotNull()
    return c.groupBy(F.coalesce("model", F.lit("(none)")).alias("arm")).agg(F.count("*").alias("n"), rate(ok & known, F.col("status").isin("answered", "partial"), "answered"), rate(known, F.col("status") == "partial", "cut"), rate(ok & known, F.col("status").isin("not_found", "unsupported"), "declined"))
