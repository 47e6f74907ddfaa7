"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LABEL, abstains, claim_tokens, extract_values, fold, index_tokens, item_covers, number_variants, query_phrases, words  # noqa: F401
from ..operators.scans import by_rows, last_before, running_sum
from ..session import table
from .catalog import WORKSPACE_KEYS, workspace_keys

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_FOLD = "regexp_replace(strip_accents(lower({0})), '\\p{{M}}', '', 'g')"


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"""select distinct rowid, {_FOLD.format('heading')} as folded from chunks where heading is not null""")
def folded_headings(spark, d):
    return table(spark, d, "chunks").filter("heading is not null").select("rowid", fold(F.col("heading")).alias("folded")).distinct()


@query(f"""select token, count(*) as df, sum(n) as tf from (select rowid, token, count(*) n from (select rowid, unnest(list_filter(regexp_split_to_array({_FOLD.format("coalesce(text,'')")}, '[^\\p{{L}}\\p{{N}}]+'),
          lambda w: w<>'')) as token from (select distinct rowid, text from chunks)) group by rowid, token) group by token""")
def lexicon(spark, d):
    """Terms of all chunks, whatever their script, with document and term frequency."""
    return term_counts(table(spark, d, "chunks"))


def term_counts(chunks: DataFrame) -> DataFrame:
    c = chunks.select("rowid", "text").distinct()
    t = c.select("rowid", F.explode(index_tokens(F.col("text"))).alias("token")).groupBy("rowid", "token").agg(F.count("*").alias("n"))
    return t.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


@query("""with w as (select distinct w from (select unnest(list_filter(regexp_split_to_array(lower(question), '[^\\p{L}\\p{N}]+'), lambda x: length(x)>=2)) w from nucleo) where not regexp_matches(w,'^\\p{N}+$')),
 v as (select w, case when length(w)<3 then [w] when suffix(w,'ões') or suffix(w,'ãos') then [w, left(w,length(w)-3)||'ão'] when suffix(w,'is') and length(w)>4 then [w, left(w,length(w)-2)||'l']
  when suffix(w,'ns') then [w, left(w,length(w)-2)||'m'] when suffix(w,'res') or suffix(w,'zes') or suffix(w,'ses') then [w, left(w,length(w)-2), left(w,length(w)-1)] when suffix(w,'s') then [w, left(w,length(w)-1)]
  when suffix(w,'ão') then [w, left(w,length(w)-2)||'ões', left(w,length(w)-2)||'ãos'] when suffix(w,'l') then [w, left(w,length(w)-1)||'is'] when suffix(w,'m') then [w, left(w,length(w)-1)||'ns']
  when suffix(w,'r') or suffix(w,'z') then [w, w||'es'] else [w, w||'s'] end as x from w)
 select w as word, array_to_string(x, ' ') as variants from v""")
def word_variants(spark, d):
    w = table(spark, d, "nucleo").select(F.explode(words(F.lower("question"), 2)).alias("word")).distinct().filter(~F.col("word").rlike(r"^\p{N}+$"))
    return w.select("word", F.array_join(number_variants(F.col("word")), " ").alias("variants"))


@query("""select distinct row_id, regexp_extract_all(question, 'R\\$\\s?\\d[\\d.]*(?:,\\d+)?|\\d{1,2}/\\d{1,2}/\\d{2,4}|\\d+(?:\\.\\d+)+|\\b[A-ZÀ-Ü]{3,}\\b', 0) as found from nucleo where question is not null""")
def question_identifiers(spark, d):
    from ..functions.text import IDENTIFIER

    return table(spark, d, "nucleo").filter("question is not null").select("row_id", F.regexp_extract_all("question", F.lit(IDENTIFIER), 0).alias("found")).distinct()


@query("""with m as (select row_id, p, x from (select distinct row_id, expected_answer from nucleo where expected_answer is not null) n, (select unnest(range(1,60)) p) , lateral (select
   regexp_extract_all(n.expected_answer, 'R\\$\\s?\\d[\\d.]*(?:,\\d+)?|\\d{1,2}/\\d{1,2}/\\d{2,4}|\\d+(?:[.,]\\d+)?\\s?%|\\d+(?:\\.\\d+)+|\\d{2,}(?:,\\d+)?|\\d+ (?:dias|meses)', 0)[p] x) where x is not null)
 select row_id, count(*) as mentions from m group by row_id""")
def answer_mentions(spark, d):
    found = F.regexp_extract_all("expected_answer", F.lit(r"R\$\s?\d[\d.]*(?:,\d+)?|\d{1,2}/\d{1,2}/\d{2,4}|\d+(?:[.,]\d+)?\s?%|\d+(?:\.\d+)+|\d{2,}(?:,\d+)?|\d+ (?:dias|meses)"), 0)
    n = table(spark, d, "nucleo").filter("expected_answer is not null").select("row_id", "expected_answer").distinct()
    return n.select("row_id", F.size(found).cast("long").alias("mentions")).filter("mentions > 0")


@query()
def answer_values(spark, d):
    """Canonical values of the expected answers (checked in tests against values worked out by hand)."""
    n = table(spark, d, "nucleo").filter("expected_answer is not null").select("row_id", "expected_answer").distinct()
    return n.select("row_id", extract_values(F.col("expected_answer")).alias("found"))


@query()
def question_phrases(spark, d):
    """Phrases of the lexical query of each question."""
    return table(spark, d, "nucleo").select("row_id", "question").distinct().select("row_id", F.transform(query_phrases(F.col("question")), lambda p: F.array_join(p, " ")).alias("phrases"))


@query("""select distinct id, coalesce(regexp_matches(regexp_extract(regexp_extract(content, '(\\S[^\\n]*)', 1), '^([^.!?]*[.!?]?)', 1), '(?i)n[ãa]o consta nos documentos'), false) as abstains from messages where id is not null""")
def abstaining_messages(spark, d):
    return table(spark, d, "messages").filter("id is not null").select("id", abstains(F.lit("answered"), F.col("content")).alias("abstains")).distinct()


@query(f"""with {WORKSPACE_KEYS} select distinct n.row_id, c.rowid from nucleo n join k on k.key=n.workspace join chunks c on c.workspace_id=k.ws and c.item_number is not null
          where n.expected_item is not null and n.expected_item<>'' and (c.item_number=n.expected_item or starts_with(c.item_number, n.expected_item||'.') or starts_with(n.expected_item, c.item_number||'.'))""")
def expected_item_chunks(spark, d):
    """Chunks of the expected item of every question whose workspace is known by id, name or call code."""
    return item_chunks(spark, d, workspace_keys(spark, d).withColumnRenamed("key", "workspace"))


def item_chunks(spark: SparkSession, d: str, w: DataFrame) -> DataFrame:
    # the item's first number is equal on both sides, so it joins
    n = table(spark, d, "nucleo").filter("expected_item <> ''").select("row_id", "workspace", "expected_item").distinct()
    head = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    c = table(spark, d, "chunks").filter("item_number is not null").select("rowid", "workspace_id", "item_number").distinct().withColumn("head", head(F.col("item_number")))
    q = n.join(w, "workspace").withColumn("head", head(F.col("expected_item")))
    return q.join(c, ["workspace_id", "head"]).filter(item_covers(F.col("item_number"), F.col("expected_item"))).select("row_id", "rowid").distinct()


#: What opens a numbered block, in the order in which the rules hold.
_NUMBERING = [
    ("item", r"^(\d{1,2}(?:\.\d{1,2}){1,5})\s*\.?(?:\s+|$)"), ("section", r"^ANEXO\s+([IVXLC]+|\d{1,2})(?:$|[^A-Za-z0-9_])"), ("section", r"^CL[ÁA]USULA\s+([\p{L}\p{N}]+[ªº°]?)"),
    ("item", r"^Art(?:\.|igo)?\s*(\d{1,3})[ºo°]?(?:$|[^\d.])"), ("item", r"^§\s*(\d{1,2})[ºo°]?"), ("item", r"^(?i:Par[áa]grafo\s+([úu]nico))"), ("section", r"^(\d{1,2})(?:\.\s*|\s+)\p{Lu}"),
    ("alinea", r"^([a-z]|[ivx]{2,4})[.)]\s+"), ("alinea", r"^([IVX]{1,4}|[IVXLC]{2,6})\s*[-–—.)]\s+"), ("alinea", r"^([A-Z])[.)]\s+\S"),
]
_T = "regexp_replace(text, '^\\s+', '')"
_KIND = "case " + " ".join(f"when regexp_matches({_T}, '{p}') then '{k}'" for k, p in _NUMBERING) + " end"
_NUM = "case " + " ".join(f"when regexp_matches({_T}, '{p}') then regexp_extract({_T}, '{p}', 1)" for _, p in _NUMBERING) + " end"


@query(f"""select block_id, {_KIND} as kind, {_NUM} as number from (select distinct block_id, text from blocks where text is not null) where {_KIND} is not null""")
def numbering(spark, d):
    """Kind and number that open a block; the first rule that fits wins."""
    t = F.regexp_replace("text", r"^\s+", "")
    kind = number = F.lit(None).cast("string")
    for k, p in reversed(_NUMBERING):
        kind, number = F.when(t.rlike(p), k).otherwise(kind), F.when(t.rlike(p), F.regexp_extract(t, p, 1)).otherwise(number)
    b = table(spark, d, "blocks").filter("text is not null").select("block_id", "text").distinct()
    return b.select("block_id", kind.alias("kind"), number.alias("number")).filter("kind is not null")


@query("""with b as (select distinct document_id, block_id, block_index, page_start, text from blocks where text is not null and text<>''),
 e as (select document_id, page_start, regexp_replace(trim(text), '\\d+', '#', 'g') as key from b where length(text)<=120), p as (select document_id, max(page_start) n from b group by 1)
 select e.document_id, key, count(distinct page_start) as pages from e join p using (document_id) group by e.document_id, key, n having n>=2 and count(distinct page_start)>=greatest(2, ceil(0.6*n))""")
def repeated_lines(spark, d):
    """Blocks that recur on at least 60 % of the pages of a document (two at least), digits masked."""
    b = table(spark, d, "blocks").filter("text is not null and text <> ''").select("document_id", "block_id", "block_index", "page_start", "text").distinct()
    n = b.groupBy("document_id").agg(F.max("page_start").alias("n"))
    e = b.filter("length(text) <= 120").select("document_id", "page_start", F.regexp_replace(F.trim("text"), r"\d+", "#").alias("key"))
    k = e.groupBy("document_id", "key").agg(F.countDistinct("page_start").alias("pages"))
    return k.join(n, "document_id").filter("n >= 2 and pages >= greatest(2, ceil(0.6 * n))").select("document_id", "key", "pages")


@query("""with b as (select distinct document_id, block_id, block_index, level, length(coalesce(text,'')) n from blocks)
 select block_id, coalesce(sum(n+2) over (partition by document_id order by block_index, block_id rows between unbounded preceding and 1 preceding),0) as offset_start from b""")
def block_offsets(spark, d):
    """Where each block begins in the document's text, blocks joined by an empty line."""
    b = table(spark, d, "blocks").select("document_id", "block_id", "block_index", F.length(F.coalesce("text", F.lit(""))).alias("n")).distinct()
    return running_sum(b, ["document_id"], ["block_index", "block_id"], F.col("n") + 2, by_rows("block_index"), "offset_start").select("block_id", "offset_start")


@query("""with b as (select distinct document_id, block_id, block_index, kind, text from blocks) select block_id, last_value(case when kind='section' then text end ignore nulls)
          over (partition by document_id order by block_index, block_id rows between unbounded preceding and 1 preceding) as heading from b""")
def current_heading(spark, d):
    b = table(spark, d, "blocks").select("document_id", "block_id", "block_index", "kind", "text").distinct()
    own = F.when(F.col("kind") == "section", F.col("text"))
    return last_before(b, ["document_id"], ["block_index", "block_id"], own, by_rows("block_index"), "heading").select("block_id", "heading")
