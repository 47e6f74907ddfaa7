"""Chunks of a document by its structure: a section is a parent, its units are packed into leaves.

A section of the first level is one group: a document of any length is cut there, so no
task holds more than a section.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.kit import collector
from ..session import table
from .scans import by_rows, running_sum

query, QUERIES, ORACLE = collector()
MAX_CHARS, OVERLAP = 1600, 150
#: A head that is repeated, a lead-in, and how much longer than a chunk an embedded parent and a table with its caption may be.
HEAD_CHARS, LEAD_CHARS, PARENT_SHARE, TABLE_SHARE = 200, 200, 1.25, 2
#: Abbreviations behind which no window ends.
_ABBREVIATIONS = set("art arts inc n nº no num sr sra dr dra prof profa ltda s.a cia obs ex etc p pp pág pag fl fls cf ref tel av al r".split())
_STOP = re.compile(r"[.!?;:…]+[\"”’)\]]*(?=\s+(?P<next>\S))")


def sentence_ends(text: str) -> list[int]:
    """Where windows may end: behind a mark before a capital, digit, quote or bracket, not behind abbreviations, numbers and initials; and the end."""
    out = []
    for m in _STOP.finditer(text):
        after = m["next"]
        if not (after.isupper() or after.isnumeric() or after in "\"“'(["):
            continue
        if m.group()[0] == ".":
            word = (text[: m.start()].rsplit(None, 1)[-1:] or [""])[0].lower() if not text[: m.start()][-1:].isspace() else ""
            bare = re.sub(r"[.º°]+$", "", re.sub(r"^[\W_]+", "", word))
            if bare in _ABBREVIATIONS or re.fullmatch(r"\d{1,2}(?:\.\d{1,3})*|[^\W\d_]", bare):
                continue
        out.append(m.end())
    return out if out and out[-1] == len(text) else [*out, len(text)]


def windows(text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows of at most ``size`` characters without blanks at their ends.

    A window ends at the last sentence or line end that leaves it half the size, else at a blank, else at the limit;
    the next begins at the first sentence within the overlap, else at a word.
    """
    ends = sorted({*sentence_ends(text), *(m.start() for m in re.finditer("\n", text))}) if len(text) > size else []
    out, start, n = [], 0, len(text)
    while start < n:
        limit = min(n, start + size)
        end = limit
        if limit < n:
            fits = [e for e in ends if start + size // 2 <= e <= limit]
            blank = text.rfind(" ", 0, limit + 1)
            end = fits[-1] if fits else min(limit, blank + 1) if blank - start >= size // 2 else limit
        a, z = start + len(text[start:end]) - len(text[start:end].lstrip()), end - (len(text[start:end]) - len(text[start:end].rstrip()))
        if z > a:
            out.append((a, z))
        if end >= n:
            break
        low = max(z - overlap, start + 1)
        new = next((e for e in ends if low <= e < z), None)
        if new is None:
            m = None if text[low - 1 : low].isspace() else re.compile(r"\s").search(text, low, z)
            new = low if text[low - 1 : low].isspace() else m.end() if m else z
        start = new if new > start else end
    return out


def _under(a: str, b: str) -> bool:
    return a != "" and b.startswith(a + " › ")


def units(blocks: list[dict]) -> list[list[dict]]:
    """A head (an item, a subsection, a table, or what nothing is open for) with the blocks right below it."""
    out: list[list[dict]] = []
    for b in blocks:
        head = out[-1][0]["kind"] if out else None
        child = head in ("item", "section") if b["kind"] == "alinea" else bool(out) and head != "table" if b["kind"] in ("paragraph", "footnote", "caption", "other") else False
        out[-1].append(b) if child else out.append([b])
    return out


def table_pieces(b: dict, size: int) -> list[dict]:
    """A pipe table whole, or groups of its rows with the header repeated."""
    lines = b["text"].split("\n")
    ruled = len(lines) > 1 and re.fullmatch(r"\|[\s|:-]+\|", lines[1].strip())
    header, rows = (lines[:2], lines[2:]) if ruled else ([], lines)
    whole = {"blocks": [b], "text": b["text"], "path": b["section_path"], "slice": False, "table": True, "first_rows": True, "start": 0, "end": len(b["text"])}
    if len(b["text"]) <= size or len(rows) <= 1:
        return [whole]
    out, group, at = [], [], sum(map(len, header)) + len(header)
    used = at
    for row in [*rows, None]:
        if row is None or group and used + len(row) + 1 > size:
            out.append(whole | {"text": "\n".join([*header, *group]), "first_rows": not out, "end": at - 1})
            group, used = [], sum(map(len, header)) + len(header)
        if row is not None:
            group.append(row)
            used += len(row) + 1
            at += len(row) + 1
    return out


def unit_pieces(unit: list[dict], size: int, overlap: int) -> list[dict]:
    """Whole blocks packed into pieces of at most ``size``; a longer block is cut into windows. Pieces behind the first repeat a numbered head."""
    head = unit[0]
    numbered = head["item_number"] and head["kind"] != "table"
    most = min(HEAD_CHARS, size // 4)
    repeat = (head["text"] if len(head["text"]) <= most else head["text"][: most - 1].rstrip() + "…") if numbered else ""
    out: list[dict] = []
    held: list[dict] = []

    def close():
        if held:
            out.append({"blocks": list(held), "text": "\n".join(x["text"] for x in held), "path": held[0]["section_path"], "slice": False, "table": False, "start": 0, "end": len(held[-1]["text"])})
            held.clear()

    for b in unit:
        if b["kind"] == "table":
            close()
            out += table_pieces(b, size)
        elif len(b["text"]) > size:
            close()
            out += [{"blocks": [b], "text": b["text"][s:e], "path": b["section_path"], "slice": True, "table": False, "start": s, "end": e} for s, e in windows(b["text"], size, min(overlap, size - 1))]
        else:
            room = size - (len(repeat) + 1 if out and repeat else 0)
            if held and sum(len(x["text"]) + 1 for x in held) + len(b["text"]) > room:
                close()
            held.append(b)
    close()
    for p in out if repeat else []:
        if not p["slice"] and not p["table"] and p["blocks"][0] is not head:
            p.update(text=f"{repeat}\n{p['text']}", blocks=[head, *p["blocks"]])
    return out


def join(pieces: list[dict]) -> dict:
    path = pieces[0]["path"]
    for p in pieces:
        path = p["path"] if _under(p["path"], path) else path
    return pieces[0] | {"blocks": [b for p in pieces for b in p["blocks"]], "text": "\n".join(p["text"] for p in pieces), "path": path, "table": any(p["table"] for p in pieces), "end": pieces[-1]["end"], "last": pieces[-1]["blocks"][-1]}


def length(pieces: list[dict]) -> int:
    return sum(len(p["text"]) for p in pieces) + len(pieces) - 1


def leads(p: dict, following: dict) -> bool:
    """A short numbered clause right before its own child."""
    child = following["blocks"][0]
    return len(p["blocks"]) == 1 and not p["slice"] and len(p["text"]) <= LEAD_CHARS and bool(p["blocks"][0]["item_number"]) and (child["ancestors"] or [None])[-1] == p["blocks"][0]["item_number"]


def merge(pieces: list[dict], size: int) -> list[dict]:
    """Neighbours joined: a caption with its table, a short item with the table before it, related short pieces within the size."""
    out: list[dict] = []
    group: list[dict] = []
    for i, p in enumerate(pieces):
        following = pieces[i + 1] if i + 1 < len(pieces) else None
        caption_of = lambda x, t: not x["slice"] and len(x["blocks"]) == 1 and x["blocks"][0]["kind"] == "caption" and t["table"] and t.get("first_rows")
        if group:
            last, path = group[-1], join(group)["path"]
            tables = any(g["table"] for g in group)
            plain = not p["slice"] and not p["table"] and p["blocks"][0]["kind"] != "section"
            beside = p["path"] == path or _under(path, p["path"])
            if following and caption_of(p, following) and not tables:
                pass
            elif len(group) == 1 and caption_of(last, p) and length([*group, p]) <= size * TABLE_SHARE:
                group.append(p)
                continue
            elif last["table"] and plain and len(p["text"]) <= LEAD_CHARS and beside and length([*group, p]) <= size * TABLE_SHARE:
                group.append(p)
                continue
            elif plain and not last["slice"] and not tables and (beside or _under(p["path"], path) and not (following and leads(p, following))):
                if length([*group, p]) <= size:
                    group.append(p)
                    continue
                if len(group) > 1 and leads(last, p) and length([last, p]) <= size:
                    out.append(join(group[:-1]))
                    group = [last, p]
                    continue
            out.append(join(group))
        group = [p]
    return [*out, join(group)] if group else out


def section_chunks(blocks: list[dict], size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """The parent of a section, if a heading opens it, and its leaves in order."""
    blocks = [dict(b, text=b["text"] or "", section_path=b["section_path"] or "", ancestors=b.get("ancestors") or []) for b in blocks if b["kind"] != "title"]
    heading = blocks[0] if blocks and blocks[0]["kind"] == "section" and (blocks[0]["level"] or 0) <= 1 else None
    leaves = merge([p for u in units(blocks[1:] if heading else blocks) for p in unit_pieces(u, size, overlap)], size)
    out = []
    if heading:
        text = "\n".join(b["text"] for b in blocks)
        out.append({"kind": "section", "parent": False, "level": heading["level"], "item_number": heading["item_number"], "path": heading["section_path"], "text": text, "first": blocks[0], "last": blocks[-1], "start": 0, "end": len(blocks[-1]["text"]),
                    "embed": len(text) <= size * PARENT_SHARE and len(leaves) != 1})
    number: dict[int, str] = {}
    for p in leaves:
        first, tables = p["blocks"][0], [b for b in p["blocks"] if b["kind"] == "table"]
        item = next((b["item_number"] for b in p["blocks"] if b["item_number"]), None)
        if tables:  # the parts of a table have the number of the first that has one
            item = number.setdefault(id(tables[0]["key"]) if "key" in tables[0] else tables[0]["block_id"], item) or item
        out.append({"kind": "table" if tables else first["kind"], "parent": heading is not None, "level": first["level"], "item_number": item, "path": p["path"], "text": p["text"], "first": first, "last": p["blocks"][-1], "start": p["start"], "end": p["end"], "embed": True})
    return [c for c in out if c["text"].strip()]


_OUT = "document_id string, section bigint, place int, kind string, has_parent boolean, level int, item_number string, section_path string, text string, char_count int, first_block bigint, last_block bigint, embed boolean"


def hierarchical(df: DataFrame, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of all documents of ``df`` (document_id, section, block_id, block_index, kind, level, item_number, text, section_path, ancestors)."""
    one = F.struct("block_index", "block_id", "kind", "level", "item_number", "text", "section_path", "ancestors")
    grouped = df.groupBy("document_id", "section").agg(F.array_sort(F.collect_list(one)).alias("blocks"))  # a section, not a document

    def run(batches):
        for b in batches:
            rows = []
            for doc, section, blocks in zip(*(b.column(c).to_pylist() for c in ("document_id", "section", "blocks"))):
                for i, c in enumerate(section_chunks(blocks, size, overlap)):
                    rows.append((doc, section, i, c["kind"], c["parent"], c["level"], c["item_number"], c["path"], c["text"], len(c["text"]), c["first"]["block_id"], c["last"]["block_id"], c["embed"]))
            cols = list(zip(*rows)) or [()] * 13
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _OUT.split(", ")])

    return grouped.mapInArrow(run, _OUT)


@query()
def hierarchical_chunks(spark: SparkSession, d: str):
    """Chunks of every document by its structure: parents of sections and their leaves."""
    b = table(spark, d, "blocks").filter("document_id is not null").select("document_id", "block_id", "block_index", "kind", "level", "item_number", "text", "section_path", "ancestors").dropDuplicates(["block_id"])
    new = F.when((F.col("kind") == "section") & (F.col("level") <= 1), 1).otherwise(0)
    b = running_sum(b, ["document_id"], ["block_index", "block_id"], new, by_rows("block_index"), "section", own=True)
    return hierarchical(b).drop("text")
