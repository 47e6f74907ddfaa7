"""Catalog plane: scopes, joins, counts, orders, updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import extract_values, fold, item_covers, truncate, words  # noqa: F401
from ..operators.scans import by_day, last_before, running_sum
from ..session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name with the SQL that checks it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def retrievable(docs: DataFrame) -> DataFrame:
    """Documents that may be searched: ready and current. Null status or flag: not."""
    return docs.filter("status = 'ready' and is_current")


def distinct_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without repeated rows; rowid is the key."""
    return table(spark, d, "chunks").dropDuplicates(["rowid"])


@query("select document_id, workspace_id, precedence from documents where status='ready' and is_current")
def scope_documents(spark, d):
    return retrievable(table(spark, d, "documents")).select("document_id", "workspace_id", "precedence")


@query("""select distinct d.workspace_id, d.document_id, c.chunk_set_id from documents d join chunks c on c.document_id=d.document_id
          where d.status='ready' and d.is_current""")
def scope_sets(spark, d):
    docs = retrievable(table(spark, d, "documents")).select("document_id", "workspace_id")
    return docs.join(table(spark, d, "chunks").select("document_id", "chunk_set_id"), "document_id").distinct().select("workspace_id", "document_id", "chunk_set_id")


@query("""select w.id, w.name, count(d.document_id) as documents from workspaces w left join documents d on d.workspace_id=w.id group by w.id, w.name""")
def workspace_counts(spark, d):
    n = table(spark, d, "documents").groupBy("workspace_id").agg(F.count("*").alias("documents"))
    w = table(spark, d, "workspaces")
    return w.join(n, w.id == n.workspace_id, "left").select("id", "name", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("""select d.document_id, (select count(distinct c.rowid) from chunks c where c.document_id=d.document_id) as chunks from documents d""")
def document_chunk_counts(spark, d):
    n = table(spark, d, "chunks").select("document_id", "rowid").distinct().groupBy("document_id").agg(F.count("*").alias("chunks"))
    return table(spark, d, "documents").select("document_id").join(n, "document_id", "left").select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""select distinct c.rowid, c.label, d.title, d.doc_type, d.version_label, d.precedence from chunks c join documents d on d.document_id=c.document_id""")
def chunk_documents(spark, d):
    docs = table(spark, d, "documents").select("document_id", "title", "doc_type", "version_label", "precedence")
    return table(spark, d, "chunks").select("rowid", "label", "document_id").distinct().join(docs, "document_id").drop("document_id")


@query("""select distinct c.rowid, coalesce(d.title,'') as title, coalesce(d.doc_type,'edital') as doc_type from chunks c left join documents d
          on d.document_id=c.document_id and d.is_current""")
def citation_titles(spark, d):
    docs = table(spark, d, "documents").filter("is_current").select("document_id", "title", "doc_type")
    c = table(spark, d, "chunks").select("rowid", "document_id").distinct().join(docs, "document_id", "left")
    return c.select("rowid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("doc_type", F.lit("edital")).alias("doc_type"))


@query("""select distinct l.rowid as leaf, p.rowid as parent, p.kind as parent_kind from chunks l join chunks p on p.document_id=l.document_id and p.chunk_set_id=l.chunk_set_id
          and p.label=l.parent_label""")
def leaf_parents(spark, d):
    c = table(spark, d, "chunks").select("rowid", "document_id", "chunk_set_id", "label", "parent_label", "kind").distinct()
    p = c.select("document_id", "chunk_set_id", F.col("label").alias("parent_label"), F.col("rowid").alias("parent"), F.col("kind").alias("parent_kind"))
    return c.select("document_id", "chunk_set_id", "parent_label", F.col("rowid").alias("leaf")).join(p, ["document_id", "chunk_set_id", "parent_label"]).select("leaf", "parent", "parent_kind").distinct()


#: The same in SQL: k(key, ws).
WORKSPACE_KEYS = """k as (select key, ws from (select call_code as key, id ws, 2 o from workspaces union all select name, id, 1 from workspaces union all select id, id, 0 from workspaces)
            where key is not null qualify row_number() over (partition by key order by o desc, ws desc)=1)"""


def workspace_keys(spark: SparkSession, d: str) -> DataFrame:
    """``key, workspace_id``: what a workspace may be called by, its id, name or call code; of equal keys the last wins."""
    keys = table(spark, d, "workspaces").select(F.col("id").alias("ws"), F.posexplode(F.array("id", "name", "call_code")).alias("o", "key")).filter("key is not null")
    return keys.groupBy("key").agg(F.max_by("ws", F.struct("o", "ws")).alias("workspace_id"))


@query("""with k as (select id, ws from (select call_code id, id ws, 2 o from workspaces union all select name, id, 1 from workspaces union all select id, id, 0 from workspaces)
            where id is not null qualify row_number() over (partition by id order by o desc, ws desc)=1)
          select distinct n.row_id, k.ws as workspace_id, k.ws is null as unknown from nucleo n left join k on k.id=n.workspace""")
def question_workspaces(spark, d):
    last = workspace_keys(spark, d)
    q = table(spark, d, "nucleo").select("row_id", "workspace").distinct()
    return q.join(last, q.workspace == last.key, "left").select("row_id", "workspace_id", F.col("workspace_id").isNull().alias("unknown"))


@query("""select document_id, item_number, rowid from (select distinct document_id, chunk_set_id, item_number, rowid, kind, order_index from chunks where item_number is not null)
          qualify row_number() over (partition by document_id, chunk_set_id, item_number order by kind='section', order_index, rowid)=1""")
def chunk_by_item(spark, d):
    c = table(spark, d, "chunks").filter("item_number is not null").select("document_id", "chunk_set_id", "item_number", "rowid", "kind", "order_index").distinct()
    first = F.min_by("rowid", F.struct(F.col("kind") == "section", "order_index", "rowid"))
    return c.groupBy("document_id", "chunk_set_id", "item_number").agg(first.alias("rowid")).select("document_id", "item_number", "rowid")


@query("""select document_id, parent_label, list(label order by order_index, rowid) as children from (select distinct document_id, parent_label, label, order_index, rowid from chunks
          where parent_label is not null) group by document_id, parent_label""")
def children_of_parents(spark, d):
    c = table(spark, d, "chunks").filter("parent_label is not null").select("document_id", "parent_label", "label", "order_index", "rowid").distinct()
    kids = F.transform(F.array_sort(F.collect_list(F.struct("order_index", "rowid", "label"))), lambda x: x["label"])
    return c.groupBy("document_id", "parent_label").agg(kids.alias("children"))


@query("""select document_id, row_number() over (order by precedence desc, created_at, document_id) as pos from documents where status='ready' and is_current""")
def document_order(spark, d):
    # positions over a sort: rows are ranged, counted by range and numbered within it, so no task sees them all
    docs = retrievable(table(spark, d, "documents")).select("document_id", "precedence", "created_at")
    return global_rank(spark, docs, [F.col("precedence").desc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("document_id")], "pos").select("document_id", "pos")


def global_rank(spark: SparkSession, df: DataFrame, order: list, name: str) -> DataFrame:
    """Numbers all rows from 1 by ``order`` without gathering them in one partition."""
    from ..session import materialize

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(spark, df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # a row a partition
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__r", local).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__off") + F.col("__r")).drop("__part", "__off", "__r")


@query("""select workspace_id, doc_kind, count(*) as documents, count(*) filter(status='ready') as ready from documents group by grouping sets ((workspace_id),(workspace_id,doc_kind),())""")
def document_rollup(spark, d):
    r = table(spark, d, "documents").rollup("workspace_id", "doc_kind").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"))
    return r


@query("""select document_id, page, sum(chars) as chars from (select distinct rowid, document_id, unnest(bboxes).page as page, ceil(coalesce(length(text),0)/len(bboxes)) as chars, bboxes from chunks
          where len(bboxes)>0) group by document_id, page""")
def page_characters(spark, d):
    c = table(spark, d, "chunks").filter("size(bboxes) > 0").select("rowid", "document_id", "text", "bboxes").distinct()
    e = c.select("rowid", "document_id", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / F.size("bboxes")).alias("chars"), "bboxes").select("*", F.explode("bboxes").alias("b"))
    e = e.select("rowid", "document_id", F.col("b.page").alias("page"), "chars", "bboxes").distinct()
    return e.groupBy("document_id", "page").agg(F.sum("chars").cast("double").alias("chars"))


@query("""select document_id, count(*) as blocks, count(*) filter(kind='table') as tables, count(*) filter(kind='section') as sections, count(*) filter(item_number is not null) as items,
          max(page_end) as pages from (select distinct on (block_id) * from blocks) group by document_id""")
def block_statistics(spark, d):
    b = table(spark, d, "blocks").dropDuplicates(["block_id"])
    return b.groupBy("document_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "section").alias("sections"),
        F.count_if(F.col("item_number").isNotNull()).alias("items"), F.max("page_end").alias("pages"))


@query("select kind, level, count(distinct rowid) as chunks from chunks group by kind, level")
def chunks_by_kind(spark, d):
    return table(spark, d, "chunks").select("kind", "level", "rowid").distinct().groupBy("kind", "level").agg(F.count("*").alias("chunks"))


@query("""select distinct rowid from chunks where contains(lower(concat_ws(' ', item_number, heading, section_path, text)), 'contrapartida')""")
def chunk_filter(spark, d):
    hay = F.lower(F.concat_ws(" ", "item_number", "heading", "section_path", "text"))
    return table(spark, d, "chunks").filter(hay.contains("contrapartida")).select("rowid").distinct()


@query("""select distinct rowid, len(list_filter(bboxes, lambda b: b.page=1)) as boxes from chunks where len(list_filter(bboxes, lambda b: b.page=1))>0""")
def page_highlights(spark, d):
    own = F.filter("bboxes", lambda b: b["page"] == 1)
    return table(spark, d, "chunks").select("rowid", F.size(own).alias("boxes")).filter("boxes > 0").distinct()


@query("""select document_id, amends_document_id, case when amends_document_id is null then 1 else 2 end as expected_precedence from documents""")
def insert_precedence(spark, d):
    return table(spark, d, "documents").select("document_id", "amends_document_id", F.when(F.col("amends_document_id").isNull(), 1).otherwise(2).alias("expected_precedence"))


@query("""select m.conversation_id as conversation_id, left(regexp_replace(arg_min(m.content, (m.created_at, m.id)), '^ +| +$', '', 'g'),80) as title from (select distinct id, conversation_id, created_at, content, role from messages) m
          where lower(trim(m.role))='user' and m.created_at is not null and m.content is not null and m.conversation_id is not null group by 1""")
def first_titles(spark, d):
    m = table(spark, d, "messages").filter("lower(trim(role)) = 'user' and created_at is not null and content is not null and conversation_id is not null")
    return m.groupBy("conversation_id").agg(F.min_by("content", F.struct("created_at", "id")).alias("c")).select("conversation_id", F.substring(F.trim("c"), 1, 80).alias("title"))


@query("""select id, workspace_id, mode, updated_at from (select distinct id, workspace_id, mode, updated_at from conversations)
          qualify row_number() over (partition by id order by updated_at desc nulls last, workspace_id, mode)=1""")
def latest_conversations(spark, d):
    c = table(spark, d, "conversations").select("id", "workspace_id", "mode", "updated_at").distinct()
    w = W.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last(), "workspace_id", "mode")
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


@query("""select distinct n.topic, n.nivel, count(distinct n.row_id) as questions from nucleo n group by n.topic, n.nivel""")
def questions_by_topic(spark, d):
    return table(spark, d, "nucleo").select("topic", "nivel", "row_id").distinct().groupBy("topic", "nivel").agg(F.count("*").alias("questions"))


@query("""select workspace_id, sha256, count(*) as copies from documents group by 1,2 having count(*)>1""")
def duplicate_uploads(spark, d):
    return table(spark, d, "documents").groupBy("workspace_id", "sha256").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("""select distinct content_hash from chunks c where embed and content_hash not in (select content_hash from chunks x join vec0 v on v.chunk_rowid=x.rowid where x.content_hash is not null)""")
def embedding_misses(spark, d):
    c = table(spark, d, "chunks")
    have = c.join(table(spark, d, "vec0").select(F.col("chunk_rowid").alias("rowid")).distinct(), "rowid").select("content_hash")
    return c.filter("embed").select("content_hash").distinct().join(have, "content_hash", "left_anti")


@query("""select event_type, count(*) as n, arg_max(event_id, (ts, event_id)) as latest from events group by event_type""")
def latest_job_events(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("""select user_id, event_id, sum(case when event_type='error' and coalesce(p,'')<>'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as attempt
          from (select *, lag(event_type) over (partition by user_id order by ts, event_id) p from events)""")
def job_attempts(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    e = last_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type"), by_day("ts"), "p")
    enters = F.when((F.col("event_type") == "error") & (F.coalesce("p", F.lit("")) != "error"), 1).otherwise(0)
    return running_sum(e, ["user_id"], ["ts", "event_id"], enters, by_day("ts"), "attempt", own=True).select("user_id", "event_id", "attempt")


@query("""select rowid, sha256(coalesce(text,'')) as hash from (select distinct rowid, text from chunks)""")
def content_hashes(spark, d):
    return table(spark, d, "chunks").select("rowid", "text").distinct().select("rowid", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@query("""select rowid, case when length(heading)>40 then rtrim(left(heading,39)) || '…' else heading end as short from (select distinct rowid, heading from chunks) where heading is not null""")
def truncated_headings(spark, d):
    return table(spark, d, "chunks").filter("heading is not null").select("rowid", "heading").distinct().select("rowid", truncate(F.col("heading"), 40).alias("short"))


@query("""with a as (select document_id, amends_document_id from documents where amends_document_id is not null)
          select document_id as source, amends_document_id as linked from a union select amends_document_id, document_id from a""")
def amendment_links(spark, d):
    a = table(spark, d, "documents").filter("amends_document_id is not null").select(F.col("document_id").alias("source"), F.col("amends_document_id").alias("linked"))
    return a.union(a.select("linked", "source")).distinct()
