"""Grounding plane: citation labels, answer blocks, quotes, values and the gate.

An answer is cut into blocks and citations by Python, in Arrow batches; everything
that compares it with its context is joins and array expressions.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.text import ABSTENTION, LABEL, canonical_value, claim_tokens, contains_value, extract_values, fold, source_values
from ..session import table

#: How a label is written; brackets models write instead; how emphasis is marked.
_NAME = r"(?:c_[0-9a-f]{6}|sec-[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?)"
_LEFT, _RIGHT = "[({<【〔［⟦〖「«", "])}>】〕］⟧〗」»"
_EMPHASIS = r"(?:\*\*?|__?|`)"
_GROUP = re.compile(rf"(?P<left>(?:[{re.escape(_LEFT)}]\s*)+){_EMPHASIS}?\s*(?P<labels>{_NAME}(?:\s*(?:[,;/]|e\b|and\b)?\s*{_NAME})*)(?:\([^()\n]*\)|[^\n({re.escape(_RIGHT)}])*(?P<right>(?:\s*[{re.escape(_RIGHT)}])+)")
_LOOSE = re.compile(rf"(?<![\[\w-]){_EMPHASIS}?({_NAME}){_EMPHASIS}?(?![\]\w-])")
_STRESSED = re.compile(rf"{_EMPHASIS}((?:\[{_NAME}\]\s?)+){_EMPHASIS}")
_GLUED = re.compile(rf"(?<=[^\s(\[])(?=\[{_NAME}\])")
_ANY = re.compile(r"\[(c_[0-9a-f]{6}|sec-[^\]\s]+)\]")
#: What is left of a line of citations: nothing, or the items in brackets.
_ONLY_ITEM = re.compile(r"(?:\(\s*(?:itens|item|subitens|subitem|se[çc](?:ões|ão|oes|ao)|anexos?)\b[^()]*\)[\s.,;]*)*", re.IGNORECASE)
#: Abbreviations behind which no sentence ends.
_ABBREVIATIONS = set(
    "art arts inc incs al alin n nº no obs ex fl fls p pp pag pags pág págs cf vol ed cap par dr dra sr sra srs prof profa ltda cia etc ref tel min max aprox cnpj cpf dec res proc doc docs s a sa eng adm av".split()
)
QUOTE_CHARS, EXCERPT_CHARS = 400, 200


def normalise_labels(text: str) -> str:
    """Every citation label as ``[label]``, several apart by a blank; brackets that belong to the text around stay."""

    def one(m: re.Match) -> str:
        extra = len(re.sub(r"\s", "", m["right"])) - len(re.sub(r"\s", "", m["left"]))
        kept = re.sub(r"\s", "", m["right"])[-extra:] if extra > 0 else ""
        return " ".join(f"[{x}]" for x in re.findall(_NAME, m["labels"])) + kept

    text = _GROUP.sub(one, text)
    text = _STRESSED.sub(lambda m: m[1].rstrip(), _LOOSE.sub(r"[\1]", text))
    return _GLUED.sub(" ", text)


def _without_labels(text: str) -> str:
    return _ANY.sub(" ", text)


def _kind_of(line: str) -> str:
    x = line.strip()
    if x.startswith("|"):
        return "table"
    if re.match(r"#{1,6}\s", x):
        return "heading"
    if re.fullmatch(r"-{3,}|\*{3,}|_{3,}", x):
        return "rule"
    return "list" if re.match(r"(?:[-*+]|\d+[.)])\s|>", x) else "paragraph"


def split_blocks(text: str) -> list[dict]:
    """Blocks of an answer: kind, text, labels and ``gives``, the blocks to which a line of citations only gives its labels.

    Lines of a table or a paragraph belong together; an indented line goes on with the
    list item before it. A lead-in with labels that ends in a colon gives them to what it
    opens and what has none of its own: a table, a list, or the items below its own.
    """
    blocks: list[dict] = []
    joined = False
    for line in re.split(r"\r?\n", text):
        if not line.strip():
            joined = False
            continue
        kind, last = _kind_of(line), blocks[-1] if blocks and joined else None
        if last and (kind == last["kind"] and kind in ("table", "paragraph") or kind == "paragraph" and last["kind"] == "list" and line[:1].isspace()):
            last["text"] += "\n" + line.rstrip()
        else:
            blocks.append({"kind": kind, "text": line.rstrip()})
        joined = True
    for b in blocks:
        b["labels"], b["gives"] = list(dict.fromkeys(_ANY.findall(b["text"]))), []
        b["indent"] = len(b["text"]) - len(b["text"].lstrip())
    for i, b in enumerate(blocks):
        if b["labels"] and b["kind"] in ("list", "paragraph") and re.search(r":[\s*_]*$", _without_labels(b["text"])):
            for other in blocks[i + 1 :]:
                opened = other["kind"] == "list" and (b["kind"] == "paragraph" or other["indent"] > b["indent"])
                if not opened and not (b["kind"] == "paragraph" and other["kind"] == "table"):
                    break
                other["labels"] = other["labels"] or list(b["labels"])
                if other["kind"] == "table":
                    break
    for i, b in enumerate(blocks):
        if i and b["kind"] == "paragraph" and b["labels"] and blocks[i - 1]["kind"] not in ("heading", "rule") and _ONLY_ITEM.fullmatch(_without_labels(b["text"]).strip()):
            j = i - 1
            while blocks[i - 1]["kind"] == "list" and j > 0 and blocks[j - 1]["kind"] == "list":
                j -= 1
            b["gives"] = list(range(j, i))
            for k in b["gives"]:
                blocks[k]["labels"] = list(dict.fromkeys(blocks[k]["labels"] + b["labels"]))
    return blocks


def answer_blocks(text: str) -> list[tuple[str, str]]:
    return [(b["kind"], b["text"]) for b in split_blocks(text)]


def split_sentences(text: str) -> list[str]:
    """Sentences of a source, line by line: ended by a mark before a capital, digit, quote or bracket, not behind abbreviations, numbers and initials."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        start = 0
        for m in re.finditer(r"[.!?…]+[\"”’)\]]*(?=\s+(?P<next>\S))", line):
            after = m["next"]
            if not (after.isupper() or after.isnumeric() or after in "\"“'(["):
                continue
            word = line[start : m.start()].rsplit(None, 1)[-1:] or [""]
            bare = re.sub(r"[.º°]+$", "", re.sub(r"^[\W_]+", "", word[0].lower()))
            if m.group()[0] == "." and (bare in _ABBREVIATIONS or bare.replace(".", "") in _ABBREVIATIONS or re.fullmatch(r"\d{1,2}(?:\.\d{1,3})*|[^\W\d_]", bare)):
                continue
            out.append(line[start : m.end()].strip())
            start = m.end()
        if line[start:].strip():
            out.append(line[start:].strip())
    return out


def find_citations(text: str) -> list[dict]:
    """The first place of each label with the claim before it: since the label before or the line's start; with few words the whole line up to it."""
    out, seen, last = [], set(), 0
    for m in _ANY.finditer(text):
        line = text.rfind("\n", 0, m.start()) + 1
        claim = _without_labels(text[max(last, line) : m.start()]).strip()
        if len(re.findall(r"[^\W\d_]{4,}|\d[\d./,-]+", claim)) < 2:
            claim = _without_labels(text[line : m.start()]).strip()
        last = m.end()
        if m[1] not in seen:
            seen.add(m[1])
            out.append({"label": m[1], "claim": claim})
    return out


#: Type objects, as a worker that imports this module has no session to parse a string with.
_STRINGS = T.ArrayType(T.StringType())
_BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("labels", _STRINGS), T.StructField("gives", T.ArrayType(T.IntegerType()))]))
_CITATIONS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("claim", T.StringType())]))


@F.pandas_udf(T.StringType())
def normal_text(text: pd.Series) -> pd.Series:
    """The text with its labels in one form; null stays null."""
    return pd.Series([None if t is None else normalise_labels(t) for t in text])


@F.pandas_udf(_BLOCKS)
def blocks_of(text: pd.Series) -> pd.Series:
    """Blocks of each answer; null and blank answers have none."""
    return pd.Series([[{k: b[k] for k in ("kind", "text", "labels", "gives")} for b in split_blocks(t or "")] for t in text])


@F.pandas_udf(_CITATIONS)
def citations_of(text: pd.Series) -> pd.Series:
    return pd.Series([find_citations(t or "") for t in text])


@F.pandas_udf(_STRINGS)
def sentences_of(text: pd.Series) -> pd.Series:
    return pd.Series([split_sentences(t or "") for t in text])


def best_quote(claim: Column, sentences: Column, source: Column, skip_heading: bool = False) -> Column:
    """The sentence that shares most words with the claim, the earliest of equals; if none shares any the first, or the second where a heading opens."""
    tokens = F.array_distinct(claim_tokens(claim))
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(tokens, claim_tokens(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(scored)
    fallback = F.when(F.size(sentences) > 1, F.element_at(sentences, 2)).otherwise(F.element_at(sentences, 1)) if skip_heading else F.element_at(sentences, 1)
    quote = F.when(F.size(sentences) == 0, F.trim(source)).when(best["n"] > 0, best["s"]).otherwise(fallback)
    return F.when(F.length(quote) > QUOTE_CHARS, F.concat(F.rtrim(F.substring(quote, 1, QUOTE_CHARS - 1)), F.lit("…"))).otherwise(quote)


def first_context(context: DataFrame) -> DataFrame:
    """``aid, label, source, item_number``: of equal labels of an answer's context the first by ``pos`` counts."""
    pos = F.col("pos") if "pos" in context.columns else F.lit(0)
    item = F.col("item_number") if "item_number" in context.columns else F.lit(None).cast("string")
    one = F.struct(pos.alias("pos"), F.col("text").alias("source"), item.alias("item_number"))
    return context.groupBy("aid", "label").agg(F.min(one).alias("x")).select("aid", "label", "x.source", "x.item_number")


def cite(answers: DataFrame, context: DataFrame, sections: bool = False) -> DataFrame:
    """``aid, text, display, citations, invalid`` of each answer.

    ``answers`` has aid and text, ``context`` aid, label, text and, if given, item_number and pos (the first of
    equal labels counts). Labels that the context lacks go, with the blanks before them; the others are numbered by
    first appearance. A citation has ordinal, label, item_number and quote. Null answers have no row.
    """
    a = answers.filter("text is not null").select("aid", normal_text("text").alias("text"))
    found = a.select("aid", F.posexplode(citations_of("text")).alias("p", "c")).select("aid", "p", "c.label", "c.claim")
    j = found.join(first_context(context), ["aid", "label"], "left")
    ordinal = F.row_number().over(W.partitionBy("aid").orderBy("p"))  # labels of one answer
    valid = j.filter("source is not null").withColumn("ordinal", ordinal)
    quote = best_quote(F.col("claim"), F.col("sentences"), F.col("source"), sections)
    valid = valid.withColumn("sentences", sentences_of("source")).select("aid", F.struct("ordinal", "label", "item_number", quote.alias("quote")).alias("x"))
    good = valid.groupBy("aid").agg(F.array_sort(F.collect_list("x")).alias("citations"))
    bad = j.filter("source is null").groupBy("aid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda x: x["label"]).alias("invalid"))
    none = F.array().cast("array<struct<ordinal:int,label:string,item_number:string,quote:string>>")
    out = a.join(good, "aid", "left").join(bad, "aid", "left").withColumn("citations", F.coalesce("citations", none)).withColumn("invalid", F.coalesce("invalid", F.array().cast("array<string>")))
    gone = F.concat(F.lit(r"[ \t]*\[("), F.array_join(F.transform("invalid", lambda x: F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")), "|"), F.lit(r")\]"))
    out = out.withColumn("text", F.when(F.size("invalid") > 0, F.regexp_replace("text", gone, F.lit(""))).otherwise(F.col("text")))
    shown = F.aggregate("citations", F.col("text"), lambda t, c: F.replace(t, F.concat(F.lit("["), c["label"], F.lit("]")), F.concat(F.lit("["), c["ordinal"].cast("string"), F.lit("]"))))
    return out.select("aid", "text", shown.alias("display"), "citations", "invalid")


def factual(kind: Column, text: Column) -> Column:
    """Whether a block claims something: values, or at least four content words that are no question and no short lead-in."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, LABEL, " "), r"^\s*([-*+]|\d+[.)]|>)\s*", ""))
    values, content = F.size(extract_values(plain)) > 0, F.size(claim_tokens(plain))
    rest = ~plain.rlike(r"\?\s*$") & ~(plain.rlike(r":[\s*_]*$") & (content <= 6)) & (content >= 4)
    return ~kind.isin("heading", "rule") & (plain != "") & ~plain.rlike(ABSTENTION) & (values | rest)


def excerpt(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, LABEL, " "), r"\s+", " "))
    return F.when(F.length(plain) > EXCERPT_CHARS, F.concat(F.substring(plain, 1, EXCERPT_CHARS - 1), F.lit("…"))).otherwise(plain)


def grade(answers: DataFrame, context: DataFrame) -> DataFrame:
    """``aid, block, kind, text, factual, labels, invalid, gives, unsupported, misplaced, issue`` of each block.

    ``answers`` has aid and text, ``context`` aid, label and text (and item_number) of what the answer could cite.
    Values of a factual block must occur in the texts that the answer cites, or be the number of an item that its
    labels cite, of one above or below. Issues: ``uncited`` (no valid label), ``unsupported`` (values that no cited
    text has; those that the context has elsewhere are ``misplaced``). Null answers have no blocks.
    """
    a = answers.filter("text is not null").select("aid", normal_text("text").alias("text"))
    b = a.select("aid", F.posexplode(blocks_of("text")).alias("block", "b")).select("aid", "block", "b.*")
    b = b.select("*", (factual(F.col("kind"), F.col("text")) & (F.size("gives") == 0)).alias("factual"), extract_values(F.col("text")).alias("claimed"))
    c = first_context(context).withColumn("values", source_values(F.col("source")))
    # what the answer cites, label by label, and all its context: at most the context of one answer in a row
    known = c.groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("values", "item_number")))).alias("known"), F.array_distinct(F.flatten(F.collect_list("values"))).alias("around"))
    cited = b.select("aid", F.explode("labels").alias("label")).distinct().join(c, ["aid", "label"]).groupBy("aid").agg(F.array_distinct(F.flatten(F.collect_list("values"))).alias("cited"))
    none = F.array().cast("array<string>")
    j = b.join(known, "aid", "left").join(cited, "aid", "left").withColumn("cited", F.coalesce("cited", none)).withColumn("around", F.coalesce("around", none))
    has = lambda x: F.coalesce(F.map_contains_key("known", x), F.lit(False))
    j = j.withColumn("valid", F.filter("labels", has)).withColumn("items", F.filter(F.transform("valid", lambda x: F.element_at("known", x)["item_number"]), lambda n: n.isNotNull()))
    dotted = lambda v: v.rlike(r"^\d+(\.\d+)*$")
    related = lambda v: dotted(v) & F.exists("items", lambda n: (n == v) | n.startswith(F.concat(v, F.lit("."))) | v.startswith(F.concat(n, F.lit("."))))
    missing = F.filter(F.array_except("claimed", "cited"), lambda v: ~related(v))
    j = j.withColumn("unsupported", F.when(F.col("factual") & (F.size("valid") > 0), missing).otherwise(none))
    issue = F.when(~F.col("factual"), None).when(F.size("valid") == 0, "uncited").when(F.size("unsupported") > 0, "unsupported")
    return j.select("aid", "block", "kind", "text", "factual", F.col("valid").alias("labels"), F.array_except("labels", "valid").alias("invalid"), "gives", "unsupported", F.array_intersect("unsupported", "around").alias("misplaced"), issue.alias("issue"))


def gate(graded: DataFrame, policy: str = "strict", fallback: str = "") -> DataFrame:
    """``aid, status, text, blocks, cited, removed, unsupported, misplaced, issues, grounded`` of each answer.

    Strict drops blocks with an issue, and lines of citations all of whose blocks go; warn keeps them, off ignores
    issues. What is left is joined again: items of a list and rows of a table by line ends, other blocks by an empty
    line, a last lead-in without what it opens left out. ``fallback`` is the text of an answer of which nothing citable is left.
    """
    x = graded.select("aid", F.struct("block", "kind", "text", "factual", "labels", "gives", "unsupported", "misplaced", "issue").alias("b")).groupBy("aid").agg(F.array_sort(F.collect_list("b")).alias("b"))
    bad = F.transform(F.filter("b", lambda k: k["issue"].isNotNull()), lambda k: k["block"])
    x = x.withColumn("bad", bad if policy == "strict" else F.array().cast("array<int>"))
    gone = lambda k: F.array_contains("bad", k["block"]) | ((F.size(k["gives"]) > 0) & F.forall(k["gives"], lambda g: F.array_contains("bad", g)))
    x = x.withColumn("kept", F.filter("b", lambda k: ~gone(k)))
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("kind"))
    glue = lambda s, k: F.when(s["kind"].isNull(), "").when((s["kind"] == k["kind"]) & k["kind"].isin("list", "table"), "\n").otherwise("\n\n")
    joined = F.aggregate("kept", start, lambda s, k: F.struct(F.concat(s["text"], glue(s, k), k["text"]).alias("text"), k["kind"].alias("kind")))["text"]
    text = F.trim(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"(^|\n)[^\n]*:\s*$", ""))
    x = x.withColumn("text", text).withColumn("removed", F.size("b") - F.size("kept"))
    has = F.exists("kept", lambda k: F.size(k["labels"]) > 0)
    last = F.regexp_extract(F.col("text"), r"([^\n]*)\s*$", 1)
    status = F.when(has & (F.col("removed") > 0), "partial").when(has, "answered").when(F.col("text").rlike(ABSTENTION), "not_found").when(last.rlike(r"\?\s*$"), "clarification").otherwise("answered" if policy == "off" else "unsupported")
    every = lambda c: F.array_distinct(F.flatten(F.transform("b", lambda k: k[c])))
    issues = F.size(F.filter("b", lambda k: k["issue"].isNotNull())) if policy != "off" else F.lit(0)
    out = x.select(
        "aid", status.alias("status"), "text", F.size(F.filter("b", lambda k: k["factual"])).alias("blocks"), F.size(F.filter("b", lambda k: k["factual"] & (F.coalesce(k["issue"], F.lit("")) != "uncited"))).alias("cited"),
        "removed", every("unsupported").alias("unsupported"), every("misplaced").alias("misplaced"), issues.alias("issues"), (issues == 0).alias("grounded"),
    )
    return out.withColumn("text", F.when((F.col("status") == "unsupported") & (F.lit(policy) == "strict") & (F.lit(fallback) != ""), F.lit(fallback)).otherwise(F.col("text")))


def needs_repair(gated: DataFrame) -> Column:
    """Whether a second try is worth while: something was cut or lacks support."""
    return (gated["removed"] > 0) | (F.size(gated["unsupported"]) > 0) | (gated["status"] == "unsupported")


def improved(before: Column, after: Column) -> Column:
    """Whether a second try (structs of status, removed, cited, issues) is better than the first: fewer issues, or as few and more cited."""
    return (after["issues"] < before["issues"]) | ((after["issues"] == before["issues"]) & (after["cited"] > before["cited"]))


def repair_notes(graded: DataFrame) -> DataFrame:
    """``aid, notes``: what failed in each answer, block by block, for an instruction to write it again."""
    bad = graded.filter("issue is not null")
    said = F.when(F.col("issue") == "uncited", F.concat(F.lit("uncited: "), excerpt(F.col("text")))).otherwise(F.concat(F.lit("not in the cited texts: "), F.array_join("unsupported", ", "), F.lit(" in "), excerpt(F.col("text"))))
    g = bad.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("block", said.alias("s")))).alias("x"))
    return g.select("aid", F.array_join(F.transform("x", lambda x: x["s"]), "\n").alias("notes"))


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def stored_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored answers, and as their context the chunks of their workspace whose labels they name."""
    from ..plans.dialogue import conversations_of, last_messages

    m = last_messages(spark, d).filter("r = 'assistant' and content is not null").join(conversations_of(spark, d), "conversation_id", "left")
    answers = m.select(F.col("id").alias("aid"), F.col("content").alias("text"))
    named = m.select(F.col("id").alias("aid"), "workspace_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(c_[0-9a-f]{6})"), 1))).alias("label"))
    c = table(spark, d, "chunks").select("rowid", "workspace_id", "label", "text", "item_number").dropDuplicates(["rowid"])
    return answers, named.join(c, ["workspace_id", "label"]).select("aid", "label", "text", "item_number", F.col("rowid").alias("pos"))


def gold_answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Gold answers that cite the first chunk of their expected item, and as context the chunks of that item."""
    from ..plans.texts import expected_item_chunks

    pairs = expected_item_chunks(spark, d)
    c = table(spark, d, "chunks").select("rowid", "label", "text", "item_number").dropDuplicates(["rowid"])
    context = pairs.join(c, "rowid").select(F.col("row_id").alias("aid"), "label", "text", "item_number", F.col("rowid").alias("pos"))
    first = context.groupBy("aid").agg(F.min("label").alias("label"))
    n = table(spark, d, "nucleo").filter("expected_answer is not null").select(F.col("row_id").alias("aid"), "expected_answer").distinct()
    answers = n.join(first, "aid", "left").select("aid", F.concat_ws(" ", "expected_answer", F.when(F.col("label").isNotNull(), F.concat(F.lit("["), F.col("label"), F.lit("]")))).alias("text"))
    return answers, context


_answers = gold_answers


def grounding_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the stored answers with what each lacks."""
    return grade(*stored_answers(spark, d)).select("aid", "block", "kind", "factual", "labels", "invalid", "unsupported", "misplaced", "issue")


def grounding_gate(spark: SparkSession, d: str) -> DataFrame:
    """What the gate makes of the stored answers, and whether they are worth a second try."""
    g = gate(grade(*stored_answers(spark, d)))
    return g.select("*", needs_repair(g).alias("repair"))


def gold_gate(spark: SparkSession, d: str) -> DataFrame:
    """The gate over the gold answers, each citing its expected item."""
    return gate(grade(*gold_answers(spark, d)), "warn").select("aid", "status", "blocks", "cited", "removed", "unsupported", "misplaced", "grounded")


def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the gold answers with quotes, and the text with ordinals."""
    return cite(*gold_answers(spark, d)).select("aid", "display", "citations", "invalid")


def repair_instructions(spark: SparkSession, d: str) -> DataFrame:
    return repair_notes(grade(*gold_answers(spark, d)))


QUERIES |= {"grounding_blocks": grounding_blocks, "grounding_gate": grounding_gate, "gold_gate": gold_gate, "answer_citations": answer_citations, "repair_instructions": repair_instructions}
