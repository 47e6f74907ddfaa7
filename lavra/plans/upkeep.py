"""Upkeep of tables and jobs: deletes and replacements, vector upserts, vocabulary, job states, settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, index_tokens, words
from ..operators.scans import by_day, last_before
from ..session import materialize, table
from .catalog import retrievable, workspace_keys
from .kit import collector
from .retrieval import model_vectors
from .structure import _CURRENT, current_sets

query, QUERIES, ORACLE = collector()
_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower({0})), '\\p{{M}}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w<>'')"


def deep_merge(base: dict, patch: dict | None) -> dict:
    """``base`` with ``patch`` laid over: objects merge, lists and values replace, null leaves what is there."""
    out = dict(base)
    for k, v in (patch or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = deep_merge(out[k], v)
        elif v is not None:
            out[k] = v
    return out


def canonical_json(value) -> str:
    """JSON with sorted keys and no blanks; keys without a value are left out."""

    def drop(x):
        if isinstance(x, dict):
            return {k: drop(v) for k, v in x.items() if v is not None}
        return [drop(v) for v in x] if isinstance(x, list) else x

    return json.dumps(drop(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(config: dict) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


def needs_reindex(old: dict, new: dict, keys: tuple[str, ...] = ("parser", "removeHeaderFooter", "chunking", "embedModel")) -> bool:
    """Whether a change of settings touches what the index was built with."""
    return any(canonical_json(old.get(k)) != canonical_json(new.get(k)) for k in keys)


def arm_config(workspace: dict, arm: dict | None, run: dict | None, prompt: str | None = None) -> dict:
    """The settings of an arm: the workspace's, the arm's over them, then the run's grounding where the arm fixes none, and the prompt."""
    out = deep_merge(workspace, arm)
    if run and "grounding" in run and "grounding" not in (arm or {}):
        out["grounding"] = run["grounding"]
    if prompt is not None:
        out["prompt"] = prompt
    return out


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows whose keys ``new`` has, and the rows of ``new``: delete and insert in one."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_where(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Tables without the given documents: their chunks, blocks and vectors go, and links to them become null."""
    out = dict(tables)
    gone = documents.select("document_id").distinct()
    if "chunks" in tables:
        lost = tables["chunks"].join(gone, "document_id", "left_semi").select(F.col("rowid").alias("chunk_rowid")).distinct()
        if "vec0" in tables:
            out["vec0"] = tables["vec0"].join(lost, "chunk_rowid", "left_anti")
    for name in ("chunks", "blocks", "documents"):
        if name in tables:
            out[name] = tables[name].join(gone, "document_id", "left_anti")
    if "documents" in tables:
        link = gone.select(F.col("document_id").alias("amends_document_id"), F.lit(True).alias("__gone"))
        cols = out["documents"].columns
        j = out["documents"].join(link, "amends_document_id", "left")
        out["documents"] = j.withColumn("amends_document_id", F.when(F.col("__gone").isNull(), F.col("amends_document_id"))).select(*cols)
    return out


@query("""with gone as (select document_id from documents where status='failed'), kept as (select * from documents where document_id not in (select document_id from gone))
 select document_id, case when amends_document_id in (select document_id from gone) then null else amends_document_id end as amends_document_id, precedence from kept""")
def documents_after_delete(spark, d):
    """Documents after the failed ones are deleted: links to them become null, the precedence stays."""
    docs = table(spark, d, "documents").select("document_id", "amends_document_id", "precedence", "status")
    return delete_where({"documents": docs}, docs.filter("status = 'failed'"))["documents"].select("document_id", "amends_document_id", "precedence")


@query("""with gone as (select document_id from documents where status='failed'), c as (select * from chunks where document_id not in (select document_id from gone)), lost as (select rowid from chunks where document_id in (select document_id from gone))
 select 'chunks' as name, count(*) as left_over from c union all select 'blocks', count(*) from blocks where document_id not in (select document_id from gone) union all select 'vec0', count(*) from vec0 where chunk_rowid is null or chunk_rowid not in (select rowid from lost)""")
def rows_after_delete(spark, d):
    """Rows left in each table after the failed documents are deleted with all that hangs on them."""
    t = {n: table(spark, d, n) for n in ("documents", "chunks", "blocks", "vec0")}
    left = delete_where(t, t["documents"].filter("status = 'failed'"))
    count = lambda n: left[n].agg(F.count("*").alias("left_over")).select(F.lit(n).alias("name"), "left_over")
    return count("chunks").union(count("blocks")).union(count("vec0"))


@query("""with gone as (select id from workspaces order by id limit 1), x as (select 'documents' as name, workspace_id ws from documents union all select 'chunks', workspace_id from chunks union all select 'conversations', workspace_id from conversations)
 select name, count(*) filter(ws is null or ws not in (select id from gone)) as left_over, count(*) filter(ws in (select id from gone)) as deleted from x group by 1""")
def workspace_cascade(spark, d):
    """What the deletion of the first workspace takes from each table, and what it leaves."""
    gone = table(spark, d, "workspaces").agg(F.min("id").alias("gone"))  # one row
    part = lambda n: table(spark, d, n).select(F.lit(n).alias("name"), F.col("workspace_id").alias("ws"))
    x = part("documents").union(part("chunks")).union(part("conversations")).join(F.broadcast(gone))
    mine = F.coalesce(F.col("ws") == F.col("gone"), F.lit(False))
    return x.groupBy("name").agg(F.count_if(~mine).alias("left_over"), F.count_if(mine).alias("deleted"))


@query(f"""with {_CURRENT}, c as (select distinct rowid, document_id, chunk_set_id, label from chunks) select c.document_id, count(*) filter(cur.chunk_set_id=c.chunk_set_id) as kept, count(*) filter(cur.chunk_set_id<>c.chunk_set_id) as dropped, min_by(label, rowid) filter(cur.chunk_set_id=c.chunk_set_id) as first_label
 from c join cur using (document_id) group by 1""".replace("join cur using (document_id)", "join cur on cur.document_id=c.document_id"))
def stale_sets(spark, d):
    """Chunks of each document that its current set keeps, and those of other sets that go."""
    c = table(spark, d, "chunks").select("rowid", "document_id", "chunk_set_id", "label").distinct()
    j = c.join(current_sets(spark, d).withColumnRenamed("chunk_set_id", "current"), "document_id")
    own = F.col("current") == F.col("chunk_set_id")
    return j.groupBy("document_id").agg(F.count_if(own).alias("kept"), F.count_if(~own).alias("dropped"), F.min_by("label", F.when(own, F.col("rowid"))).alias("first_label"))


_GOOD = "chunk_rowid is not null and workspace_id is not null and model_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))=0 and len(list_filter(embedding, lambda x: x<>0))>0"


@query(f"""with t as (select *, len(embedding) n from vec0 where {_GOOD}), own as (select model_id, n from (select model_id, n, count(*) c from t group by 1,2) qualify row_number() over (partition by model_id order by c desc, n desc)=1)
 select 'chunks_vec_' || regexp_replace(lower(t.model_id), '[^a-z0-9]+', '_', 'g') as vector_table, min(t.n)::int as dims, count(distinct chunk_rowid) as vectors, (select count(*) from vec0 x where x.model_id=t.model_id) as written from t join own using (model_id, n) group by t.model_id""")
def vector_tables(spark, d):
    """One vector table a model: its length, its vectors after upserts by chunk, and the rows written to it."""
    v = model_vectors(spark, d)
    n = v.groupBy("model_id").agg(F.min(F.size("v")).alias("dims"), F.count("*").alias("vectors"))
    w = table(spark, d, "vec0").groupBy("model_id").agg(F.count("*").alias("written"))
    name = F.concat(F.lit("chunks_vec_"), F.regexp_replace(F.lower("model_id"), "[^a-z0-9]+", "_"))
    return n.join(w, "model_id").select(name.alias("vector_table"), "dims", "vectors", "written")


@query(f"""with q as (select distinct unnest({_TOKENS.format('question')}) term from nucleo where question is not null), docs as (select document_id from documents where status='ready' and is_current),
 c as (select distinct unnest({_TOKENS.format('text')}) term from chunks where text is not null and document_id in (select document_id from docs)) select q.term, c.term is not null as attested from q left join c on c.term=q.term where length(q.term)>=3""")
def attested_terms(spark, d):
    """Which words of the questions occur in chunks that may be searched: one semi-join for all terms."""
    q = table(spark, d, "nucleo").select(F.explode(F.filter(index_tokens(F.col("question")), lambda w: F.length(w) >= 3)).alias("term")).distinct()
    docs = retrievable(table(spark, d, "documents")).select("document_id")
    c = table(spark, d, "chunks").filter("text is not null").join(docs, "document_id", "left_semi").select(F.explode(index_tokens(F.col("text"))).alias("term")).distinct()
    return q.join(c.withColumn("is", F.lit(True)), "term", "left").select("term", F.col("is").isNotNull().alias("attested"))


@query(f"""with t as (select c.document_id, unnest({_TOKENS.format('heading')}) term from (select distinct document_id, heading from chunks where heading is not null) c), s as (select document_id, coalesce(status='ready' and is_current, false) ok from documents)
 select term, count(distinct t.document_id) as documents from t join s using (document_id) where not ok and length(term)>=5 and term not in (select term from t join s using (document_id) where ok) group by 1""")
def vocabulary_outside_scope(spark, d):
    """Words of headings that only documents outside the scope use."""
    t = table(spark, d, "chunks").filter("heading is not null").select("document_id", F.explode(words(fold(F.col("heading")), 5)).alias("term")).distinct()
    s = table(spark, d, "documents").select("document_id", F.coalesce((F.col("status") == "ready") & F.col("is_current"), F.lit(False)).alias("ok"))
    t = t.join(s, "document_id")
    return t.filter("not ok").join(t.filter("ok").select("term").distinct(), "term", "left_anti").groupBy("term").agg(F.countDistinct("document_id").alias("documents"))


@query("""with p as (select event_id, user_id, event_type, ts, lag(event_type) over (partition by user_id order by ts, event_id) before from events) select user_id, count(*) as submitted, count(*) filter(before is null or before<>event_type) as run from p group by 1""")
def coalesced_jobs(spark, d):
    """Jobs of each queue: submitted, and run after repeats of the one still waiting are dropped."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    e = last_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type"), by_day("ts"), "before")
    return e.groupBy("user_id").agg(F.count("*").alias("submitted"), F.count_if(F.col("before").isNull() | (F.col("before") != F.col("event_type"))).alias("run"))


@query("""with l as (select user_id, arg_max(event_type, (ts, event_id)) state, max(ts) ts from events group by 1) select user_id, state, ts from l where state not in ('purchase','error')""")
def unfinished_jobs(spark, d):
    """What has to be queued again after a crash: jobs whose last state is no end."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))
    return e.filter("state not in ('purchase', 'error')").select("user_id", "state", "ts")


@query("""with f as (select user_id, min((ts, event_id)) filter(event_type in ('purchase','error')) stop from events group by 1) select e.user_id, count(*) as sent, max(e.ts) as until, bool_or(e.event_type in ('purchase','error')) as finished from events e join f using (user_id) where f.stop is null or (e.ts, e.event_id)<=f.stop group by 1""")
def streamed_events(spark, d):
    """What a subscriber is sent of each job: all events up to the first that ends it."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    ends = F.col("event_type").isin("purchase", "error")
    f = e.groupBy("user_id").agg(F.min(F.when(ends, F.struct("ts", "event_id"))).alias("stop"))
    j = e.join(f, "user_id").filter(F.col("stop").isNull() | (F.struct("ts", "event_id") <= F.col("stop")))
    return j.groupBy("user_id").agg(F.count("*").alias("sent"), F.max("ts").alias("until"), F.bool_or(ends).alias("finished"))


#: The share of the work that is done at each stage.
STAGES = {"signup": 0.05, "view": 0.35, "click": 0.6, "purchase": 1.0, "error": 1.0}
_STAGE = "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in STAGES.items()) + " end"


@query(f"""select user_id, date_trunc('day', ts)::date as day, max({_STAGE})::double as progress, count(*) filter(event_type='error') as errors from events group by 1,2""")
def job_progress(spark, d):
    """The furthest stage a job has reached on each day, as a share of the work."""
    share = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))[F.col("event_type")]
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(share).alias("progress"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""select event_id, coalesce(try_cast(json_extract(props, '$.k') as bigint), -1) as k, json_extract_string(json_merge_patch('{"unit":"x","k":0}', coalesce(props,'{}')), '$.unit') as unit, json_extract_string(json_merge_patch('{"unit":"x","k":0}', coalesce(props,'{}')), '$.k') as k_or_default from events""")
def event_settings(spark, d):
    """Properties of events laid over defaults: read with a fallback, keys they lack from the defaults."""
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", F.coalesce(k.try_cast("bigint"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.unit"), F.lit("x")).alias("unit"), F.coalesce(k, F.lit("0")).alias("k_or_default"))


@query("""with k as (select key, ws from (select call_code as key, id ws, 2 o from workspaces union all select name, id, 1 from workspaces union all select id, id, 0 from workspaces) where key is not null qualify row_number() over (partition by key order by o desc, ws desc)=1),
 q as (select distinct row_id, workspace, trim(expected_item) item from nucleo where trim(expected_item)<>''), c as (select distinct rowid, workspace_id, item_number, section_path, text from chunks),
 j as (select q.row_id, q.item, c.* from q join k on k.key=q.workspace join c on c.workspace_id=k.ws)
 select row_id, bool_or(coalesce(item_number=item or starts_with(item_number, item||'.') or starts_with(item, item_number||'.'), false)) as by_number,
  bool_or(coalesce(len(list_filter(list_transform(regexp_split_to_array(section_path, ' [›>] '), lambda p: regexp_extract(p, '^(\\d+(?:\\.\\d+)*)', 1)), lambda n: n=item or starts_with(n, item||'.')))>0, false)) as by_path,
  bool_or(coalesce(regexp_matches(text, '(?m)(^|\\s)' || replace(item,'.','\\.') || '\\.\\s'), false)) as by_clause from j group by 1""")
def reachable_items(spark, d):
    """Whether chunks of the workspace cover a question's item: by number (itself, above or below), by section path, or by a clause in the text.

    What a chunk covers are keys, so all three are semi-joins.
    """
    up = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, r"\."))), lambda k: F.array_join(F.slice(F.split(c, r"\."), F.lit(1), k), "."))
    q = table(spark, d, "nucleo").filter("trim(expected_item) <> ''").select("row_id", "workspace", F.trim("expected_item").alias("item")).distinct().join(workspace_keys(spark, d).withColumnRenamed("key", "workspace"), "workspace").select("row_id", "workspace_id", "item")
    c = table(spark, d, "chunks").select("workspace_id", "item_number", "section_path", "text").distinct()
    below = c.filter("item_number is not null").select("workspace_id", F.explode(up(F.col("item_number"))).alias("item"))
    itself = c.filter("item_number is not null").select("workspace_id", "item_number").distinct()
    above = q.select("row_id", "workspace_id", F.explode(up(F.col("item"))).alias("item_number")).join(itself, ["workspace_id", "item_number"], "left_semi").select("row_id")
    numbers = F.filter(F.transform(F.split("section_path", " [›>] "), lambda p: F.regexp_extract(p, r"^(\d+(?:\.\d+)*)", 1)), lambda n: n != "")
    path = c.filter("section_path is not null").select("workspace_id", "section_path").distinct().select("workspace_id", F.explode(numbers).alias("n")).distinct().select("workspace_id", F.explode(up(F.col("n"))).alias("item"))
    clause = c.filter("text is not null").select("workspace_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)(?:^|(?<=\s))(\S+)\.(?=\s)"), 1)).alias("item"))
    hit = lambda keys, name: q.join(keys.distinct(), ["workspace_id", "item"], "left_semi").select("row_id").withColumn(name, F.lit(True))
    by_number = hit(below, "by_number").union(above.withColumn("by_number", F.lit(True))).distinct()
    known = q.join(c.select("workspace_id").distinct(), "workspace_id", "left_semi").select("row_id").distinct()
    out = known.join(by_number, "row_id", "left").join(hit(path, "by_path").distinct(), "row_id", "left").join(hit(clause, "by_clause").distinct(), "row_id", "left")
    return out.select("row_id", *[F.coalesce(x, F.lit(False)).alias(x) for x in ("by_number", "by_path", "by_clause")])
