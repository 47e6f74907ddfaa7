"""Ingest plane: sections, windows, glossary."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..session import table
from .chunker import MAX_CHARS, OVERLAP, windows
from .scans import by_rows, running_sum

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str = ""):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("""with b as (select distinct document_id, block_id, block_index, kind, level from blocks) select block_id, sum(case when kind='section' and level<=1 then 1 else 0 end) over (partition by document_id
          order by block_index, block_id rows between unbounded preceding and current row) as section from b""")
def section_split(spark, d):
    """The running section of each block: a new one at each heading of the first level."""
    b = table(spark, d, "blocks").select("document_id", "block_id", "block_index", "kind", "level").distinct()
    new = F.when((F.col("kind") == "section") & (F.col("level") <= 1), 1).otherwise(0)
    return running_sum(b, ["document_id"], ["block_index", "block_id"], new, by_rows("block_index"), "section", own=True).select("block_id", "section")


def window_chunks(df: DataFrame, key: str, text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``key, chunk, char_start, char_end`` of each text; null and blank texts have no chunks."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            spans = [windows(t, size, overlap) if t else [] for t in b.column(1).to_pylist()]
            n = [len(s) for s in spans]
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pa.array([i for k in n for i in range(k)], type=pa.int32()), pa.array([x for s in spans for x, _ in s], type=pa.int32()), pa.array([y for s in spans for _, y in s], type=pa.int32())],
                names=[key, "chunk", "char_start", "char_end"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, chunk int, char_start int, char_end int")


@query()
def fixed_windows(spark, d):
    """Windows over all documents (tests hold them against the rules of length, overlap and cover)."""
    return window_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("""select distinct rowid, case when coalesce(trim(section_path),'')='' then '[' || left(coalesce(title,''),80) || ']' else '[' || left(coalesce(title,''),80) || ' › ' || section_path || ']' end as prefix
          from chunks c join documents d on d.document_id=c.document_id""")
def context_prefixes(spark, d):
    c = table(spark, d, "chunks").select("rowid", "document_id", "section_path").distinct().join(table(spark, d, "documents").select("document_id", "title"), "document_id")
    title = F.substring(F.coalesce("title", F.lit("")), 1, 80)
    inner = F.when(F.coalesce(F.trim("section_path"), F.lit("")) == "", title).otherwise(F.concat(title, F.lit(" › "), F.col("section_path")))
    return c.select("rowid", F.concat(F.lit("["), inner, F.lit("]")).alias("prefix")).distinct()


@query("""with n as (select distinct document_id, chunk_set_id, split_part(item_number,'.',1)||'.'||split_part(item_number,'.',2) head, item_number, rowid from chunks where regexp_matches(item_number, '^\\d+\\.\\d+'))
 select document_id, head, count(distinct rowid) as siblings from n group by document_id, chunk_set_id, head having count(distinct rowid)>1""")
def sibling_items(spark, d):
    """Items that share their first two numbers within a document."""
    head = F.concat_ws(".", F.split_part("item_number", F.lit("."), F.lit(1)), F.split_part("item_number", F.lit("."), F.lit(2)))
    n = table(spark, d, "chunks").filter(F.col("item_number").rlike(r"^\d+\.\d+")).select("document_id", "chunk_set_id", head.alias("head"), "rowid").distinct()
    return n.groupBy("document_id", "chunk_set_id", "head").agg(F.count("*").alias("siblings")).filter("siblings > 1").drop("chunk_set_id")


#: Small words that are no content of a definition, folded ones compared as written.
_SMALL = set(
    ("a o as os um uma uns umas de da do das dos e ou que para por com sem sob sobre entre no na nos nas ao aos à às se ser será serão seja sejam este esta estes estas esse essa isso aquele aquela seu sua seus suas "
     "pelo pela pelos pelas quando onde como qual quais cujo cuja mais menos muito pouco todo toda todos todas outro outra outros outras fins âmbito termos disposto observado conforme presente respectivo respectiva demais deste desta desse dessa").split()
)
#: Words that open what a term is defined as; words of titles that identify nothing.
_OPENS = set("a o as os um uma uns umas aquele aquela todo toda como".split())
_GENERIC = set(
    ("instituicao instituicoes entidade entidades pessoa pessoas publica publicas privada privadas nacional nacionais projeto projetos proposta propostas edital chamada publico publicos sistema sistemas geral gerais "
     "outros outras tipo tipos forma formas parte partes item itens area areas dados servico servicos produto produtos").split()
)
ALIASES, GROUPS, CHECKED = 6, 3, 12
_NUMBERED = re.compile(r"(?:(?<=\s)|^)(?P<n>\d+(?:\.\d+){1,3})\s+(?=[A-ZÀ-ÖØ-Þ])")
_NAMED = re.compile(r"(?P<name>[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[\s,]+[^\W\d_]+){1,16}?)\s*\((?P<short>[A-ZÀ-ÖØ-Þ]{2,8})s?\)")
_MEANT = re.compile(r"(?:[Ee]ntende-se por|[Cc]onsidera-se)\s+(?P<term>[^\W\d_][^,.;:\n]{3,60})[,\s]+(?P<text>.{20,400}?)[.;]", re.DOTALL)


def _folded(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.category(c).startswith("M"))


def _trimmed(s: str) -> str:
    return re.sub(r"^[\s\"'“”\-–—]+|[\s\"'“”\-–—.;,:]+$", "", " ".join(s.split()))


def _is_term(t: str) -> bool:
    return 4 <= len(t) <= 80 and t[0].isalpha() and len(t.split()) <= 10 and not re.search("[.;]", t)


def numbered_definitions(text: str) -> list[tuple[str, list[str], str, str | None]]:
    """Numbered items of the form ``term: definition``; terms that share their first two numbers are each other's aliases."""
    starts = [m for m in _NUMBERED.finditer(text)]
    found = []
    for m, end in zip(starts, [*(x.start() for x in starts[1:]), len(text)]):
        term, colon, rest = text[m.end() : end].partition(":")
        if colon and 3 <= len(term) <= 90 and "\n" not in term and rest[:1].isspace() and len(rest.strip()) >= 20 and _is_term(_trimmed(term)):
            found.append((_trimmed(term), m["n"]))
    block = lambda n: n.split(".")[:2]
    return [(t, [o for o, k in found if block(k) == block(n) and o != t][:ALIASES], "definicao", n) for t, n in found]


def acronyms(text: str) -> list[tuple[str, str]]:
    """(name, acronym): the words before the brackets from the first on whose initials hold the letters in order."""
    out = []
    for m in _NAMED.finditer(text):
        words_, letters = _trimmed(m["name"]).split(), _folded(m["short"])
        for begin, word in enumerate(words_):
            if _folded(word)[:1] != letters[0]:
                continue
            rest = iter(_folded(w)[:1] for w in words_[begin + 1 :])
            if all(letter in rest for letter in letters[1:]):
                name = " ".join(words_[begin:])
                if _is_term(name) and not _folded(name).startswith(letters):
                    out.append((name, m["short"]))
                break
    return out


def meanings(text: str) -> list[tuple[str, list[str], str, str | None]]:
    """Definitions within the text: the term up to the word that opens its definition, and the content words of both."""
    out = []
    for m in _MEANT.finditer(text):
        words_ = _trimmed(m["term"]).split()
        cut = next((i for i, w in enumerate(words_) if i and _folded(w) in _OPENS), len(words_))
        term = words_[: min(cut, 5)]
        while len(term) > 1 and _folded(term[-1]) in _SMALL:
            term.pop()
        name = " ".join(term)
        own, aliases = set(_folded(name).split()), {}
        for w in re.split(r"[\W_]+", f"{m['term']} {m['text']}"):
            f = _folded(w)
            if len(f) >= 4 and f not in _SMALL and f not in own:
                aliases.setdefault(f, w)
        if _is_term(name) and aliases:
            out.append((name, list(aliases.values())[:ALIASES], "expressao", None))
    return out


def extract_glossary(text: str) -> list[dict]:
    """Entries of one text in order: numbered definitions, acronyms, definitions within the text."""
    found = numbered_definitions(text) + [(name, [short, short + "s"], "sigla", None) for name, short in acronyms(text)] + meanings(text)
    return [{"term": t, "aliases": a, "kind": k, "label": n} for t, a, k, n in found]


def merge_entries(entries: list[dict]) -> list[dict]:
    """One entry a folded term: the first one's term and label, aliases of all in order, eight at most where several merge; a kind other than an expression wins. Entries without aliases go."""
    out: dict[str, dict] = {}
    for e in entries:
        k = _folded(e["term"])
        if k not in out:
            out[k] = dict(e, aliases=list(dict.fromkeys(e["aliases"])))
            continue
        x = out[k]
        x["aliases"] = list(dict.fromkeys(x["aliases"] + e["aliases"]))[: ALIASES + 2]
        x["kind"] = e["kind"] if x["kind"] == "expressao" else x["kind"]
        x["label"] = x["label"] or e["label"]
    return [e for e in out.values() if e["aliases"]]


def _touches(folded_text: str, term: str) -> bool:
    return len(term) >= 3 and re.search(rf"(?<![^\W\d_]){re.escape(_folded(term))}(?:e?s)?(?![^\W\d_])", folded_text) is not None


def glossary_groups(question: str, entries: list[dict], attested=None, most: int = GROUPS) -> list[list[str]]:
    """The terms that a question's words bring along, entry by entry, the most specific first.

    An entry is touched by its term, by the aliases of an acronym, or by a long word of the term that few entries have;
    one from a model by its aliases, and brings its term only. ``attested`` keeps the terms that occur in the scope: of
    the first twelve entries those with any left count.
    """
    q = _folded(question)
    often = Counter(w for e in entries for w in {_folded(x) for x in re.split(r"[\W_]+", e["term"])})
    hits = []
    for e in entries:
        model = e["kind"] == "llm"
        by_term = not model and _touches(q, e["term"])
        words_ = [w for w in re.split(r"[\W_]+", e["term"]) if len(w) >= 5 and _folded(w) not in _GENERIC and often[_folded(w)] <= 3]
        triggers = e["aliases"] if model else (e["aliases"] if e["kind"] == "sigla" else []) + words_
        by = e["term"] if by_term else next((t for t in triggers if _touches(q, t)), None)
        terms = [t for t in ([e["term"]] if model else [e["term"], *e["aliases"]]) if not _touches(q, t)]
        if by and terms:
            hits.append((len(e["term"]) + 100 if by_term else len(by), terms))
    hits.sort(key=lambda h: -h[0])
    if attested is None:
        return [t for _, t in hits[:most]]
    kept = [[t for t in terms if t in attested] for _, terms in hits[:CHECKED]]
    return [t for t in kept if t][:most]


def hand_groups(question: str, groups: list[dict], most: int = GROUPS) -> list[list[str]]:
    """The sibling terms of groups (terms, triggers) that a question touches, the longest trigger first, without those it has."""
    q, hits = _folded(question), []
    for g in groups:
        touched = [len(t) for t in g.get("triggers") or g["terms"] if _touches(q, t)]
        terms = [t for t in g["terms"] if not _touches(q, t)]
        if touched and terms:
            hits.append((max(touched), terms))
    return [t for _, t in sorted(hits, key=lambda h: -h[0])[:most]]


def anchored(raw: list[dict], document: str) -> list[dict]:
    """Entries a model proposed whose term the document has and whose synonyms it has not: 40 entries, six synonyms at most."""
    doc, out = _folded(document), []
    for e in raw[:40]:
        term = e["termo"].strip() if isinstance(e.get("termo"), str) else ""
        named = [s.strip() for s in e.get("sinonimos") or [] if isinstance(s, str)] if isinstance(e.get("sinonimos"), list) else []
        aliases = [s for s in named if len(s) >= 4 and _folded(s) not in doc][:6]
        if len(term) >= 4 and _folded(term) in doc and aliases:
            out.append({"term": term, "aliases": aliases, "kind": "llm", "label": None})
    return out


def json_list(text: str) -> list:
    """The list from the first to the last bracket of a text, fences dropped; an empty one where there is none."""
    text = re.sub(r"```(?:json)?", "", text, flags=re.IGNORECASE)
    a, z = text.find("["), text.rfind("]")
    try:
        found = json.loads(text[a : z + 1]) if 0 <= a < z else []
    except ValueError:
        found = []
    return found if isinstance(found, list) else []


def variants_of(text: str, question: str, most: int) -> list[str]:
    """Rephrasings a model wrote one a line: bullets and quotes dropped, 8 to 200 characters, each once, none equal to the question."""
    plain = lambda s: " ".join(re.split(r"[\W_]+", _folded(s))).strip()
    out = {plain(question): None}
    for line in text.split("\n"):
        line = re.sub(r"^[\"“”']+|[\"“”']+$", "", re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line)).strip()
        if 8 <= len(line) <= 200:
            out.setdefault(plain(line), line)
    return [v for v in out.values() if v][:most]


def search_requests(text: str, alone: bool = True) -> list[str]:
    """Searches a model asks for in tags, three at most; ``alone`` means that more than 80 other characters make them no request."""
    tag = re.compile(r"<buscar>\s*([^<]{3,200}?)\s*</buscar>", re.IGNORECASE)
    if alone and len(tag.sub("", text).strip()) > 80:
        return []
    return list(dict.fromkeys(m.strip() for m in tag.findall(text)))[:3]


def extend_context(context: list[dict], lists: list[list[dict]], most: int = 10_000) -> list[dict]:
    """A context with the results of further searches in turn: first ones of all lists, then second ones; each label once, those that overflow skipped."""
    out, have, used = list(context), {c["label"] for c in context}, 0
    for row in zip_longest(*lists):
        for c in row:
            if c and c["label"] not in have and used + len(c["text"]) <= most:
                have.add(c["label"])
                used += len(c["text"])
                out.append(c)
    return out


def retry_after(message: str) -> int:
    """Milliseconds a provider asks to wait, with a margin and at most two minutes; 20 seconds where it does not say."""
    m = re.search(r"try again in (?:(\d+)m(?!s))?(?:(\d+(?:\.\d+)?)\s?(ms|s)\b)?", message, re.IGNORECASE)
    if not m or not (m[1] or m[2]):
        return 20_000
    return min(120_000, round(int(m[1] or 0) * 60_000 + float(m[2] or 0) * (1 if m[3] == "ms" else 1000)) + 1500)


def failure_kind(message: str) -> str:
    """Whether a failure is a day's quota, a rate limit, or another."""
    if re.search(r"per day|\(TPD\)|\(RPD\)|free_tier_requests|plan and billing|usage limit|hit your (?:session |weekly |daily )?limit", message, re.IGNORECASE):
        return "quota"
    return "rate" if re.search(r"rate.?limit|quota|tokens per minute|429", message, re.IGNORECASE) else "other"


def glossary_entries(df: DataFrame, document: str, text: str) -> DataFrame:
    """``document, p, term, aliases, kind, label`` found in each text, ``p`` in order; null texts have none."""
    kind = df.schema[document].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [extract_glossary(t or "") for t in b.column(1).to_pylist()]
            flat = [e for f in found for e in f]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            cols = [pa.array([i for f in found for i in range(len(f))], type=pa.int32()), *(pa.array([e[c] for e in flat], type=t) for c, t in (("term", pa.string()), ("aliases", pa.list_(pa.string())), ("kind", pa.string()), ("label", pa.string())))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *cols], names=[document, "p", "term", "aliases", "kind", "label"])

    return df.select(document, text).mapInArrow(run, f"`{document}` {kind}, p int, term string, aliases array<string>, kind string, label string")


def merge_glossary(entries: DataFrame, document: str, order: list[str]) -> DataFrame:
    """``merge_entries`` over a table: one entry a folded term and document, in the order given."""
    x = F.struct(*order, "term", "aliases", "kind", "label")
    g = entries.withColumn("key", fold(F.col("term"))).groupBy(document, "key").agg(F.array_sort(F.collect_list(x)).alias("x"))
    every = F.array_distinct(F.flatten(F.transform("x", lambda e: e["aliases"])))
    strong = F.filter("x", lambda e: e["kind"] != "expressao")
    out = g.select(document, F.col("x")[0]["term"].alias("term"), F.when(F.size(strong) > 0, strong[0]["kind"]).otherwise("expressao").alias("kind"),
                   F.when(F.size("x") > 1, F.slice(every, 1, ALIASES + 2)).otherwise(every).alias("aliases"), F.get(F.filter(F.transform("x", lambda e: e["label"]), lambda v: v.isNotNull()), F.lit(0)).alias("label"))
    return out.filter(F.size("aliases") > 0)


@query()
def document_glossary(spark, d):
    """Glossary of each document from its embeddable chunks."""
    c = table(spark, d, "chunks").filter("embed and text is not null").select("rowid", "document_id", "order_index", "text").dropDuplicates(["rowid"])
    keyed = c.select(F.struct("document_id", "order_index", "rowid").alias("k"), "text")
    e = glossary_entries(keyed, "k", "text").select("k.document_id", "k.order_index", "k.rowid", "p", "term", "aliases", "kind", "label")
    return merge_glossary(e, "document_id", ["order_index", "rowid", "p"])


@query()
def glossary_variants(spark, d):
    """What the glossary of its scope adds to each question: the groups of terms that its words bring along and that the scope has."""
    from ..plans.catalog import retrievable
    from ..plans.retrieval import questions_of

    docs = retrievable(table(spark, d, "documents")).select("document_id", "workspace_id")
    e = document_glossary(spark, d).join(docs, "document_id")
    # entries and questions of a workspace that share a folded word of five letters, or an acronym; what shares none is not touched
    long_ = lambda c: F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    base = lambda w: F.regexp_replace(w, "e?s$", "")
    said = e.select("workspace_id", "document_id", "term", "kind", "aliases", "label", F.explode(F.array_distinct(F.transform(F.flatten(F.array(long_(F.col("term")), F.flatten(F.transform("aliases", long_)))), base))).alias("w"))
    q = questions_of(spark, d)
    asked = q.select("qid", "workspace_id", F.explode(F.array_distinct(F.transform(long_(F.col("question")), base))).alias("w"))
    near = asked.join(said, ["workspace_id", "w"]).select("qid", F.struct("document_id", "term", "kind", "aliases", "label").alias("e")).distinct().groupBy("qid").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    rows = q.join(near, "qid")

    def run(batches):
        for b in batches:
            out = [(i, k, " ".join([t, *g])) for i, t, e in zip(*(b.column(c).to_pylist() for c in ("qid", "question", "entries"))) for k, g in enumerate(glossary_groups(t, e))]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.int64()), pa.array(cols[1], type=pa.int32()), pa.array(cols[2], type=pa.string())], names=["qid", "no", "text"])

    return rows.mapInArrow(run, "qid bigint, no int, text string")
