"""Structure of documents: anchors, sections, intervals, tables, boxes, chunk sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import fold
from ..operators.scans import by_rows, last_before, running_sum
from ..session import table
from .catalog import distinct_chunks, retrievable
from .kit import collector

query, QUERIES, ORACLE = collector()
_FOLD = "regexp_replace(strip_accents(lower({0})), '\\p{{M}}', '', 'g')"


def anchor(c: Column) -> Column:
    """The anchor of a heading: folded, a paragraph sign spelt out, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold(F.regexp_replace(c, "§", "par")), r"[^a-z0-9.]+", "-"), r"^-+|-+$", "")


def blocks_of(spark, d) -> DataFrame:
    return table(spark, d, "blocks").select("document_id", "block_id", "block_index", "kind", "level", "item_number", "text", "page_start", "page_end", "section_path").distinct()


_ANCHOR = "regexp_replace(regexp_replace(" + _FOLD.format("replace(text, '§', 'par')") + ", '[^a-z0-9.]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""with b as (select distinct document_id, block_id, block_index, text from blocks where kind='section' and text is not null), a as (select *, {_ANCHOR} base from b)
 select block_id, 'sec-' || base || case when row_number() over (partition by document_id, base order by block_index, block_id)>1 then '-' || row_number() over (partition by document_id, base order by block_index, block_id) else '' end as anchor from a""")
def section_anchors(spark, d):
    """Anchors of the sections, numbered from the second of a document on that are equal."""
    b = table(spark, d, "blocks").filter("kind = 'section' and text is not null").select("document_id", "block_id", "block_index", "text").distinct().withColumn("base", anchor(F.col("text")))
    b = running_sum(b, ["document_id", "base"], ["block_index", "block_id"], F.lit(1), by_rows("block_index"), "before")
    return b.select("block_id", F.concat(F.lit("sec-"), "base", F.when(F.col("before") > 0, F.concat(F.lit("-"), F.col("before") + 1)).otherwise("")).alias("anchor"))


@query("""with b as (select distinct document_id, block_id, block_index, kind, level, length(coalesce(text,'')) n from blocks),
 o as (select *, coalesce(sum(n+2) over (partition by document_id order by block_index, block_id rows between unbounded preceding and 1 preceding),0) s, sum(n+2) over (partition by document_id) total from b)
 select a.block_id, a.s as section_start, coalesce((select min(x.s) from o x where x.document_id=a.document_id and x.kind='section' and x.level<=a.level and (x.block_index, x.block_id)>(a.block_index, a.block_id)), a.total) - 2 as section_end
 from o a where a.kind='section' and a.level between 1 and 6""")
def section_spans(spark, d):
    """Where each section begins and ends in the document's text: at the next section of its level or a higher one, else at the end."""
    b = blocks_of(spark, d).select("document_id", "block_id", "block_index", "kind", "level", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    b = running_sum(b, ["document_id"], ["block_index", "block_id"], F.col("n") + 2, by_rows("block_index"), "s")
    total = b.groupBy("document_id").agg(F.sum(F.col("n") + 2).alias("total"))
    end = F.lit(None).cast("bigint")
    for level in range(1, 7):  # the next start of a section of each level or higher
        b = last_before(b, ["document_id"], ["block_index", "block_id"], F.when((F.col("kind") == "section") & (F.col("level") <= level), F.col("s")), by_rows("block_index"), f"next{level}", after=True)
        end = F.when(F.col("level") == level, F.col(f"next{level}")).otherwise(end)
    b = b.filter("kind = 'section' and level between 1 and 6").join(total, "document_id")
    return b.select("block_id", F.col("s").alias("section_start"), (F.coalesce(end, "total") - 2).alias("section_end"))


@query("""with b as (select distinct document_id, block_id, block_index, item_number from blocks)
 select block_id, first_value(case when regexp_matches(item_number, '^\\d+(\\.\\d+)+$') then item_number end ignore nulls) over (partition by document_id order by block_index, block_id rows between 1 following and unbounded following) as next_number from b""")
def next_dotted_number(spark, d):
    """The next dotted number behind each block."""
    b = blocks_of(spark, d).select("document_id", "block_id", "block_index", "item_number").distinct()
    own = F.when(F.col("item_number").rlike(r"^\d+(\.\d+)+$"), F.col("item_number"))
    return last_before(b, ["document_id"], ["block_index", "block_id"], own, by_rows("block_index"), "next_number", after=True).select("block_id", "next_number")


@query("""with c as (select distinct on (rowid) rowid, document_id, chunk_set_id, order_index, kind, heading, item_number from chunks),
 t as (select *, last_value(case when kind='section' then heading end ignore nulls) over (partition by document_id, chunk_set_id order by order_index, rowid rows between unbounded preceding and 1 preceding) title,
   last_value(item_number ignore nulls) over (partition by document_id, chunk_set_id order by order_index, rowid rows between unbounded preceding and 1 preceding) number from c)
 select rowid, title as section_title, coalesce(item_number, number) as inherited from t where kind='table'""")
def table_context(spark, d):
    """What a table stands under: the last section title before it, and the last item number where it has none of its own."""
    c = distinct_chunks(spark, d).select("rowid", "document_id", "chunk_set_id", "order_index", "kind", "heading", "item_number")
    keys, order = ["document_id", "chunk_set_id"], ["order_index", "rowid"]
    c = last_before(c, keys, order, F.when(F.col("kind") == "section", F.col("heading")), by_rows("order_index"), "section_title")
    c = last_before(c, keys, order, F.col("item_number"), by_rows("order_index"), "number")
    return c.filter("kind = 'table'").select("rowid", "section_title", F.coalesce("item_number", "number").alias("inherited"))


@query("""with b as (select distinct document_id, block_id, block_index, page_start, trim(text) t from blocks where text is not null),
 p as (select *, lag(t) over w pt, lag(page_start) over w pp from b window w as (partition by document_id order by block_index, block_id)) select block_id from p where t=pt and page_start>pp""")
def repeated_after_break(spark, d):
    """Blocks that repeat the block before them behind a page break."""
    b = table(spark, d, "blocks").filter("text is not null").select("document_id", "block_id", "block_index", "page_start", F.trim("text").alias("t")).distinct()
    b = last_before(b, ["document_id"], ["block_index", "block_id"], F.struct("t", "page_start"), by_rows("block_index"), "p")
    return b.filter("t = p.t and page_start > p.page_start").select("block_id")


@query("""with c as (select distinct rowid, document_id, char_start, char_end from chunks where char_start is not null and char_end>char_start), n as (select document_id, n_chars from documents),
 q as (select document_id, unnest(generate_series(0, n_chars, 500)) pos from n) select q.document_id, pos, count(c.rowid) as chunks, min(c.rowid) as first_chunk from q join c on c.document_id=q.document_id and pos>=char_start and pos<char_end group by 1,2""")
def chunks_at_positions(spark, d):
    """Every 500th position of a document with the chunks that hold it: an interval join by buckets of 500 characters."""
    c = table(spark, d, "chunks").filter("char_start is not null and char_end > char_start").select("rowid", "document_id", "char_start", "char_end").distinct()
    # a position is a multiple of 500, so a chunk meets exactly those it holds
    first, last = F.ceil(F.col("char_start") / 500), F.floor((F.col("char_end") - 1) / 500)
    held = c.filter(first <= last).select("rowid", "document_id", F.explode(F.sequence(first, last)).alias("k"))
    n = table(spark, d, "documents").filter("n_chars >= 0").select("document_id", F.floor(F.col("n_chars") / 500).alias("most"))
    j = held.join(n, "document_id").filter("k >= 0 and k <= most")
    return j.groupBy("document_id", (F.col("k") * 500).alias("pos")).agg(F.count("*").alias("chunks"), F.min("rowid").alias("first_chunk"))


#: The last chunk set of a document is the current one.
_CURRENT = "cur as (select document_id, arg_max(chunk_set_id, rowid) chunk_set_id from chunks group by document_id)"


def current_sets(spark, d) -> DataFrame:
    """``document_id, chunk_set_id``: the set of each document's last written chunk."""
    return table(spark, d, "chunks").groupBy("document_id").agg(F.max_by("chunk_set_id", "rowid").alias("chunk_set_id"))


@query(f"""with {_CURRENT} select c.document_id, count(distinct c.rowid) as chunks, count(distinct c.rowid) filter(c.embed) as embedded, sum(distinct case when c.embed then 1 else 0 end) as any_embedded
 from chunks c join cur using (document_id, chunk_set_id) join documents d on d.document_id=c.document_id where d.status='ready' and d.is_current group by 1""")
def searchable_chunks(spark, d):
    """Chunks of each retrievable document's current set, and those that are embedded."""
    docs = retrievable(table(spark, d, "documents")).select("document_id")
    c = table(spark, d, "chunks").select("document_id", "chunk_set_id", "rowid", "embed").distinct()
    c = c.join(current_sets(spark, d), ["document_id", "chunk_set_id"], "left_semi").join(docs, "document_id", "left_semi")
    return c.groupBy("document_id").agg(F.countDistinct("rowid").alias("chunks"), F.countDistinct(F.when(F.col("embed"), F.col("rowid"))).alias("embedded"), F.max(F.when(F.col("embed"), 1).otherwise(0)).alias("any_embedded"))


@query(f"""with {_CURRENT} select d.document_id, d.is_current, count(distinct c.rowid) as chunks from documents d left join cur on cur.document_id=d.document_id left join chunks c on c.document_id=cur.document_id and c.chunk_set_id=cur.chunk_set_id group by 1,2""")
def current_set_counts(spark, d):
    """Chunks of the current set of every document, whatever its status; 0 where there is none."""
    c = table(spark, d, "chunks").select("document_id", "chunk_set_id", "rowid").distinct().join(current_sets(spark, d), ["document_id", "chunk_set_id"], "left_semi")
    n = c.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return table(spark, d, "documents").select("document_id", "is_current").join(n, "document_id", "left").select("document_id", "is_current", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("""with c as (select distinct on (rowid) rowid, document_id, chunk_set_id, order_index from chunks), l as (select *, 'c_' || left(sha256(document_id || ':' || chunk_set_id || ':' || order_index),6) label from c)
 select rowid, label, row_number() over (partition by document_id, chunk_set_id, label order by order_index, rowid)-1 as seed from l""")
def chunk_labels(spark, d):
    """The label of each chunk from its place, and how many chunks of its set had the label before."""
    c = distinct_chunks(spark, d).select("rowid", "document_id", "chunk_set_id", "order_index")
    place = F.concat_ws(":", "document_id", "chunk_set_id", F.col("order_index").cast("string"))
    c = c.withColumn("label", F.concat(F.lit("c_"), F.substring(F.sha2(place, 256), 1, 6)))
    return running_sum(c, ["document_id", "chunk_set_id", "label"], ["order_index", "rowid"], F.lit(1), by_rows("order_index"), "seed").select("rowid", "label", "seed")


@query("""with c as (select distinct on (rowid) rowid, bboxes from chunks), b as (select rowid, unnest(bboxes) b from c)
 select rowid, b.page as page, round(greatest(0, least(1, least(b.x0,b.x1))),4) as x0, round(greatest(0, least(1, least(b.y0,b.y1))),4) as y0, round(greatest(0, least(1, greatest(b.x0,b.x1))),4) as x1, round(greatest(0, least(1, greatest(b.y0,b.y1))),4) as y1 from b""")
def normal_boxes(spark, d):
    """Boxes within the page, left before right and top before bottom, to four places."""
    b = distinct_chunks(spark, d).select("rowid", F.explode("bboxes").alias("b"))
    side = lambda f, a, z: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f(F.col(f"b.{a}"), F.col(f"b.{z}")))), 4)
    return b.select("rowid", F.col("b.page").alias("page"), side(F.least, "x0", "x1").alias("x0"), side(F.least, "y0", "y1").alias("y0"), side(F.greatest, "x0", "x1").alias("x1"), side(F.greatest, "y0", "y1").alias("y1"))


_EDGE = "0.08"


@query(f"""with b as (select distinct document_id, block_id, page_start, text, bboxes[1].y0 y0, bboxes[1].y1 y1 from blocks where text is not null and trim(text)<>'' and len(bboxes)>0),
 e as (select *, regexp_replace(trim(text), '\\d+', '#', 'g') key from b), n as (select document_id, max(page_start) pages from e group by 1),
 k as (select document_id, key, count(distinct page_start) p from e where y1<={_EDGE}+0.1 or y0>=1-{_EDGE}-0.1 group by 1,2)
 select e.block_id from e join k using (document_id, key) join n using (document_id) where pages>=2 and p>=greatest(2, ceil(0.6*pages)) and (y1<={_EDGE}+0.1 or y0>=1-{_EDGE}-0.1)""")
def band_lines(spark, d):
    """Blocks in the upper or lower band of the page whose text, digits masked, recurs on 60 % of the pages, two at least: headers and footers to remove.

    The band is 8 % behind a margin of 10 %.
    """
    first = F.col("bboxes")[0]
    b = table(spark, d, "blocks").filter("text is not null and trim(text) <> '' and size(bboxes) > 0").select("document_id", "block_id", "page_start", F.regexp_replace(F.trim("text"), r"\d+", "#").alias("key"), first["y0"].alias("y0"), first["y1"].alias("y1")).distinct()
    n = b.groupBy("document_id").agg(F.max("page_start").alias("pages"))
    e = b.filter((F.col("y1") <= float(_EDGE) + 0.1) | (F.col("y0") >= 1 - float(_EDGE) - 0.1))
    k = e.groupBy("document_id", "key").agg(F.countDistinct("page_start").alias("p")).join(n, "document_id").filter("pages >= 2 and p >= greatest(2, ceil(0.6 * pages))")
    return e.join(k.select("document_id", "key"), ["document_id", "key"], "left_semi").select("block_id").distinct()


_CELLS = "list_transform(string_split(regexp_replace(line, '^\\s*\\|\\s*|\\s*\\|\\s*$', '', 'g'), '|'), lambda x: trim(x))"


@query(f"""with c as (select distinct on (rowid) rowid, context_prefix, text from chunks where kind='table' and text is not null), l as (select rowid, context_prefix, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)),1) i from c),
 r as (select rowid, context_prefix, i, {_CELLS} cells from l where starts_with(trim(line),'|'))
 select rowid, i::int as row_no, len(cells)::int as cells, coalesce(context_prefix,'') || ' — ' || array_to_string(list_filter(list_transform(cells, lambda x, k: 'c' || k || ': ' || x), lambda x: not regexp_matches(x, ': $')), '; ') as sentence from r""")
def table_row_sentences(spark, d):
    """Rows of pipe tables as sentences: the context, then each cell that is not blank under its column."""
    c = distinct_chunks(spark, d).filter("kind = 'table' and text is not null").select("rowid", "context_prefix", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\|\s*|\s*\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    named = F.filter(F.transform(cells, lambda x, k: F.concat(F.lit("c"), k + 1, F.lit(": "), x)), lambda x: ~x.rlike(": $"))
    return c.select("rowid", (F.col("p") + 1).alias("row_no"), F.size(cells).alias("cells"), F.concat(F.coalesce("context_prefix", F.lit("")), F.lit(" — "), F.array_join(named, "; ")).alias("sentence"))


@query(f"""with c as (select distinct on (rowid) rowid, text from chunks where kind='table' and text is not null), l as (select rowid, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)),1) i from c),
 r as (select rowid, i, {_CELLS} cells from l where starts_with(trim(line),'|')), x as (select rowid, unnest(cells) v, generate_subscripts(cells,1) col from r)
 select rowid, col::int as col, count(*) as filled, count(distinct v) as distinct_values, min(v) as least, max(v) as most from x where v<>'' group by 1,2""")
def table_columns(spark, d):
    """The grid of each pipe table by columns: filled cells, distinct ones, least and most."""
    c = distinct_chunks(spark, d).filter("kind = 'table' and text is not null").select("rowid", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\|\s*|\s*\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    x = c.select("rowid", F.posexplode(cells).alias("k", "v")).filter("v <> ''")
    return x.groupBy("rowid", (F.col("k") + 1).alias("col")).agg(F.count("*").alias("filled"), F.countDistinct("v").alias("distinct_values"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("""with c as (select distinct on (rowid) rowid, text, context_prefix from chunks where text is not null) select sha256(text) as content_hash, min_by(coalesce(context_prefix,'') || chr(10) || text, rowid) as passage, count(*) as shared from c group by 1""")
def passages(spark, d):
    """What is embedded for each distinct text: context and text; equal texts share the passage of the first chunk."""
    c = distinct_chunks(spark, d).filter("text is not null")
    return c.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min_by(F.concat(F.coalesce("context_prefix", F.lit("")), F.lit("\n"), "text"), "rowid").alias("passage"), F.count("*").alias("shared"))


@query("""with c as (select distinct on (rowid) rowid, document_id, text, context_prefix from chunks) select document_id, count(*) as chunks, sum(case when ceil((length(coalesce(text,''))+length(coalesce(context_prefix,''))+1)/4.0)>400 then 1 else 0 end)::bigint as truncated,
 max(ceil((length(coalesce(text,''))+length(coalesce(context_prefix,''))+1)/4.0))::bigint as longest from c group by 1""")
def truncation_report(spark, d):
    """Chunks whose passage is estimated (four characters a token) at more tokens than a model of 400 takes."""
    n = F.ceil((F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("context_prefix", F.lit(""))) + 1) / 4.0)
    return distinct_chunks(spark, d).select("document_id", n.alias("n")).groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("n") > 400).alias("truncated"), F.max("n").alias("longest"))


@query("""with d as (select workspace_id, count(*) docs, sum(n_chars) chars from documents where status='ready' and is_current and text is not null group by 1) select workspace_id, docs, chars::bigint as chars, chars<=12*28000 as fits from d""")
def full_document_budget(spark, d):
    """Whether all retrievable texts of a workspace fit into twelve context budgets."""
    docs = retrievable(table(spark, d, "documents")).filter("text is not null")
    return docs.groupBy("workspace_id").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).withColumn("fits", F.col("chars") <= 12 * 28000)


@query("""select distinct on (rowid) rowid, '<chunk id="' || label || '" doc="' || document_id || '"' || case when item_number is not null then ' item="' || item_number || '"' else '' end || '>' || chr(10) || coalesce(text,'') || chr(10) || '</chunk>' as tag from chunks""")
def prompt_chunks(spark, d):
    """Each chunk as it goes into a prompt."""
    item = F.when(F.col("item_number").isNotNull(), F.concat(F.lit(' item="'), "item_number", F.lit('"'))).otherwise("")
    tag = F.concat(F.lit('<chunk id="'), "label", F.lit('" doc="'), "document_id", F.lit('"'), item, F.lit(">\n"), F.coalesce("text", F.lit("")), F.lit("\n</chunk>"))
    return distinct_chunks(spark, d).select("rowid", tag.alias("tag"))


@query("""with b as (select distinct block_id, text from blocks where text is not null), u as (select block_id, length(regexp_replace(text,'[^\\p{Lu}]','','g')) up, length(regexp_replace(text,'[^\\p{L}]','','g')) al from b)
 select block_id, case when al<3 then 0.0 else round(up/al::double,6) end as upper_ratio from u""")
def upper_ratios(spark, d):
    """Share of capitals among the letters of a block; 0 below three letters."""
    b = table(spark, d, "blocks").filter("text is not null").select("block_id", "text").distinct()
    up, al = F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")), F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    return b.select("block_id", F.when(al < 3, F.lit(0.0)).otherwise(F.round(up / al, 6)).alias("upper_ratio"))


#: Prefixes that keep their hyphen at a line break.
KEPT_HYPHEN = "pré|pós|pro|não|recém|auto|anti|co|ex|vice|sub|inter|intra|semi|micro|macro|multi|sócio|técnico|médico"


def clean_text(c: Column) -> Column:
    """Ligatures spelt out, invisible characters dropped, words joined over line breaks but for prefixes with a hyphen, blanks collapsed."""
    for a, z in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), (" ", " ")):
        c = F.regexp_replace(c, a, z)
    c = F.regexp_replace(c, "[​-‍﻿]", "")
    c = F.regexp_replace(c, "­\\s*\\n\\s*|­", "")
    c = F.regexp_replace(c, rf"(?i)(^|[^\p{{L}}])({KEPT_HYPHEN})-[ \t]*\r?\n[ \t]*(\p{{Ll}})", "$1$2\u0001$3")
    c = F.regexp_replace(c, r"(\p{L})-[ \t]*\r?\n[ \t]*(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\u0001", "-"), r"[ \t\r\n]+", " "))


_CLEAN = "text"
for _a, _z in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), (" ", " ")):
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_z}')"
_CLEAN = f"regexp_replace({_CLEAN}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '\\xAD\\s*\\n\\s*|\\xAD', '', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?i)(^|[^\\p{{L}}])({KEPT_HYPHEN})-[ \\t]*\\r?\\n[ \\t]*(?-i:(\\p{{Ll}}))', '\\1\\2' || chr(1) || '\\3', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(\\p{{L}})-[ \\t]*\\r?\\n[ \\t]*(\\p{{Ll}})', '\\1\\2', 'g')"
_CLEAN = f"trim(regexp_replace(replace({_CLEAN}, chr(1), '-'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"select distinct block_id, {_CLEAN} as cleaned from blocks where text is not null")
def cleaned_blocks(spark, d):
    """Text of the blocks, cleaned of the traces of layout."""
    return table(spark, d, "blocks").filter("text is not null").select("block_id", clean_text(F.col("text")).alias("cleaned")).distinct()


@query("""with b as (select distinct document_id, block_id, block_index, level, item_number, kind from blocks), i as (select * from b where regexp_matches(item_number, '^\\d+(\\.\\d+)*$'))
 select block_id, list_transform(generate_series(1, len(string_split(item_number,'.'))), lambda k: array_to_string(string_split(item_number,'.')[1:k],'.')) as ancestors from i""")
def item_ancestors(spark, d):
    """The chain of numbers a numbered block stands under, itself last."""
    b = table(spark, d, "blocks").filter(F.col("item_number").rlike(r"^\d+(\.\d+)*$")).select("block_id", "item_number").distinct()
    parts = F.split("item_number", r"\.")
    return b.select("block_id", F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")).alias("ancestors"))


@query("""with b as (select distinct block_id, item_number, kind from blocks where item_number is not null), c as (select distinct item_number, kind from chunks where item_number is not null)
 select kind, count(*) as blocks, count(*) filter(exists (select 1 from c where c.item_number=b.item_number)) as chunked from b group by kind""")
def chunked_items(spark, d):
    """Numbered blocks by kind, and those whose number some chunk has."""
    b = table(spark, d, "blocks").filter("item_number is not null").select("block_id", "item_number", "kind").distinct()
    c = table(spark, d, "chunks").filter("item_number is not null").select("item_number", F.lit(1).alias("has")).distinct()
    return b.join(c, "item_number", "left").groupBy("kind").agg(F.count("*").alias("blocks"), F.count("has").alias("chunked"))


@query("""with b as (select distinct document_id, block_id, block_index, kind, coalesce(text,'') t from blocks)
 select document_id, string_agg(case when kind='section' then '## ' || t when kind='item' then '- ' || t else t end, chr(10) || chr(10) order by block_index, block_id) as markdown from b group by document_id""")
def canonical_markdown(spark, d):
    """The document as one text: blocks in order, joined by an empty line. A row is a document, as its text is."""
    b = blocks_of(spark, d).select("document_id", "block_id", "block_index", "kind", F.coalesce("text", F.lit("")).alias("t")).distinct()
    line = F.when(F.col("kind") == "section", F.concat(F.lit("## "), "t")).when(F.col("kind") == "item", F.concat(F.lit("- "), "t")).otherwise(F.col("t"))
    g = b.select("document_id", F.struct("block_index", "block_id", line.alias("line")).alias("x")).groupBy("document_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return g.select("document_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("markdown"))
