"""Layout of a parsed document, a JSON tree by reference, as blocks in reading order.

A row is a document, as its tree is one value. Tables are rebuilt from spans and merged
over pages; headings, items and letters build the outline each block stands under.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SHORT_HEADING, HEADING_CHARS = 120, 60
_REF = re.compile(r"#/(texts|tables|groups|pictures)/(\d+)")
#: What opens a numbered line, in the order in which the rules hold: kind, pattern, level (None: by its dots), how the number is written.
NUMBERING = [
    ("item", re.compile(r"(\d{1,2}(?:\.\d{1,2}){1,5})\s*\.?(?:\s+|$)"), None, "{}"), ("section", re.compile(r"ANEXO\s+([IVXLC]+|\d{1,2})(?!\w)"), 1, "ANEXO {}"), ("section", re.compile(r"CL[ÁA]USULA\s+([^\W_]+[ªº°]?)"), 1, "CLÁUSULA {}"),
    ("item", re.compile(r"Art(?:\.|igo)?\s*(\d{1,3})[ºo°]?(?![\d.])"), 2, "Art. {}"), ("item", re.compile(r"§\s*(\d{1,2})[ºo°]?"), 3, "§ {}"), ("item", re.compile(r"((?i:Par[áa]grafo\s+[úu]nico))\b"), 3, "Parágrafo único"),
    ("section", re.compile(r"(\d{1,2})(?:\.\s*|\s+)(?=[A-ZÀ-ÖØ-Þ])"), 1, "{}"), ("alinea", re.compile(r"([a-z]|[ivx]{2,4})[.)]\s+"), 0, "{}"), ("alinea", re.compile(r"([IVX]{1,4}|[IVXLC]{2,6})\s*[-–—.)]\s+"), 0, "{}"), ("alinea", re.compile(r"([A-Z])[.)]\s+(?=\S)"), 0, "{}"),
]
#: Last words of a cell that the layout has cut.
_CUT_CELL = re.compile(r"(?:^|\s)(?:a|e|de|do|da|ou|até|entre|com|para|por|em)$", re.IGNORECASE)
_DOTTED = re.compile(r"\d+(?:\.\d+)*")


def clean(text: str | None) -> str:
    return " ".join((text or "").replace("\xad", "").replace("​", "").split())


def numbering(text: str) -> tuple[str, int, str, str] | None:
    """Kind, level, number and rest of a numbered line."""
    t = text.lstrip()
    for kind, pattern, level, form in NUMBERING:
        if m := pattern.match(t):
            return kind, 1 + m[1].count(".") if level is None else level, form.format(m[1]), re.sub(r"^[\s\-–—:.)]+", "", t[m.end() :]).strip()
    return None


def upper_ratio(text: str) -> float:
    letters = [c for c in text if c.isalpha()]
    return sum(map(str.isupper, letters)) / len(letters) if len(letters) >= 3 else 0.0


def page_box(prov: dict, sizes: dict[int, tuple[float, float]]) -> dict:
    """A box as shares of the page from its upper left corner, to four places."""
    b, (w, h) = prov["bbox"], sizes.get(prov["page_no"], (1.0, 1.0))
    top, bottom = (h - b["t"], h - b["b"]) if b.get("coord_origin") == "BOTTOMLEFT" else (b["t"], b["b"])
    share = lambda x, of: round(min(1.0, max(0.0, x / of)), 4)
    return {"page": prov["page_no"], "x0": share(b["l"], w), "y0": share(min(top, bottom), h), "x1": share(b["r"], w), "y1": share(max(top, bottom), h)}


def flatten(doc: dict) -> tuple[list[dict], int]:
    """Texts and tables in reading order, captions before their tables; running lines and furniture are dropped and counted. Each item once."""
    sizes = {p["page_no"]: (p["size"]["width"], p["size"]["height"]) for p in (doc.get("pages") or {}).values()}
    out, seen, dropped = [], set(), 0
    todo = [(c["$ref"], None) for c in reversed((doc.get("body") or {}).get("children") or [])]
    while todo:
        ref, label = todo.pop()
        m = _REF.fullmatch(ref)
        store = doc.get(m[1]) or [] if m else []
        if not m or int(m[2]) >= len(store) or ref in seen:
            continue
        seen.add(ref)
        item = store[int(m[2])]
        boxes = [page_box(p, sizes) for p in item.get("prov") or []]
        captions = [(c["$ref"], "caption") for c in item.get("captions") or []]
        if m[1] == "groups":
            todo += [(c["$ref"], None) for c in reversed(item.get("children") or [])]
        elif m[1] == "pictures":
            todo += reversed(captions)
        elif m[1] == "tables":
            if any(r not in seen for r, _ in captions):  # its captions first, then the table again
                seen.discard(ref)
                todo += [(ref, label), *reversed([c for c in captions if c[0] not in seen])]
                continue
            out.append({"table": item, "ref": ref, "boxes": boxes, "captions": [r for r, _ in captions]})
        else:
            label = label or item.get("label")
            text = clean(item.get("orig") or item.get("text"))
            if label in ("page_header", "page_footer") or item.get("content_layer") == "furniture":
                dropped += 1
            elif text:
                out.append({"text": text, "label": label, "marker": item.get("marker"), "ref": ref, "boxes": boxes})
    return out, dropped


def relocate(items: list[dict]) -> list[dict]:
    """Each table that has a place goes before the first text that stands below it."""
    place = lambda x: (x["boxes"][0]["page"], x["boxes"][0]["y0"])
    tables = sorted((x for x in items if "table" in x and x["boxes"]), key=place, reverse=True)
    out = []
    for x in items:
        if "table" in x and x["boxes"]:
            continue
        while x["boxes"] and tables and place(tables[-1]) <= place(x):
            out.append(tables.pop())
        out.append(x)
    return out + tables[::-1]


def drop_running(items: list[dict], pages: int, band: float = 0.08, share: float = 0.6) -> tuple[list[dict], int]:
    """Without texts of the upper and lower band that recur, digits masked, on most pages (two at least)."""
    if pages < 2:
        return items, 0
    edge = lambda x: "text" in x and x["boxes"] and (x["boxes"][0]["y1"] <= band or x["boxes"][0]["y0"] >= 1 - band)
    key = lambda x: re.sub(r"\d+", "#", x["text"])
    on: dict[str, set[int]] = {}
    for x in items:
        if edge(x):
            on.setdefault(key(x), set()).add(x["boxes"][0]["page"])
    least = max(2, -(-pages * share // 1))
    kept = [x for x in items if not (edge(x) and len(on[key(x)]) >= least)]
    return kept, len(items) - len(kept)


@dataclass
class Grid:
    """A table: rows of cells, header rows, divider rows and caption."""

    rows: list[list[str]]
    headers: list[int] = field(default_factory=list)
    dividers: list[int] = field(default_factory=list)
    caption: str | None = None

    def header_run(self) -> list[int]:
        """The first run of headers that are no dividers; without headers the first row."""
        first = next((r for r in self.headers if r not in self.dividers), None)
        if first is None:
            return [0] if self.rows else []
        run = []
        while first in self.headers and first not in self.dividers:
            run.append(first)
            first += 1
        return run

    def names(self) -> list[str]:
        """Names of the columns: distinct header cells, joined."""
        run = self.header_run()
        return [" ".join(dict.fromkeys(v for v in (self.rows[r][c] for r in run) if v)) for c in range(len(self.rows[0]) if self.rows else 0)]

    def data(self) -> list[int]:
        run = set(self.header_run())
        return [i for i in range(len(self.rows)) if i not in run]

    def divider(self, i: int) -> bool:
        return i in self.dividers and i not in self.header_run()

    def divider_above(self, i: int) -> str | None:
        above = [r for r in self.dividers if r < i and self.divider(r)]
        return next((v for v in self.rows[above[-1]] if v), "") if above else None

    def text(self) -> str:
        return "\n".join(next((v for v in r if v), "") if i in self.dividers else " | ".join(v for v in r if v) for i, r in enumerate(self.rows))

    def markdown(self) -> str:
        if not self.rows:
            return ""
        line = lambda cells: "| " + " | ".join(re.sub(r"\s*\n\s*", " ", c.replace("|", "\\|")) for c in cells) + " |"
        names = self.names()
        out = [line(names), "| " + " | ".join("---" for _ in names) + " |"]
        for i in self.data():
            r = self.rows[i]
            out.append(line(["**" + next((v for v in r if v), "") + "**"] + [""] * (len(r) - 1)) if self.divider(i) else line(r))
        return "\n".join(out)


def grid_of(item: dict) -> Grid:
    """A table from its cells and spans: blank rows dropped, cells that the layout has cut joined, dividers and headers marked."""
    data = item.get("data") or {}
    cells = data.get("table_cells") or [c for i, r in enumerate(data.get("grid") or []) for j, c in enumerate(r) if c and c.get("start_row_offset_idx", i) == i and c.get("start_col_offset_idx", j) == j]
    height = max([data.get("num_rows") or 0, *(c["end_row_offset_idx"] for c in cells)], default=0)
    width = max([data.get("num_cols") or 0, *(c["end_col_offset_idx"] for c in cells)], default=0)
    at: list[list[dict | None]] = [[None] * width for _ in range(height)]
    for c in cells:
        for r in range(c["start_row_offset_idx"], min(height, c["end_row_offset_idx"])):
            for k in range(c["start_col_offset_idx"], min(width, c["end_col_offset_idx"])):
                at[r][k] = c
    g, above = Grid([]), None
    for row in at:
        values = [clean(c["text"]) if c else "" for c in row]
        if not any(values):
            continue
        if g.rows and above:
            held = [c is not None and c is p for c, p in zip(row, above)]
            new = [(k, v) for k, v in enumerate(values) if v and not held[k]]
            goes_on = lambda k, v: _CUT_CELL.search(g.rows[-1][k]) or v[0].islower() or v.startswith("R$")
            if any(held) and new and all(goes_on(k, v) for k, v in new):
                for k, v in new:
                    g.rows[-1][k] = f"{g.rows[-1][k]} {v}".strip()
                continue
        above = row
        filled = [c for c, v in zip(row, values) if v]
        if any(c.get("row_section") for c in filled) or width > 1 and all(c is filled[0] for c in filled) and filled[0]["end_col_offset_idx"] - filled[0]["start_col_offset_idx"] >= width:
            g.dividers.append(len(g.rows))
        elif all(c and c.get("column_header") for c in row):
            g.headers.append(len(g.rows))
        g.rows.append(values)
    return g


def merge_grids(a: Grid, b: Grid) -> None:
    """Appends the part of a table behind a page break: a repeated first row goes, a row that only goes on with cells is joined."""
    skip = 1 if b.rows and a.rows and b.rows[0] == a.rows[0] else 0
    if len(b.rows) > skip and a.rows:
        row = b.rows[skip]
        filled = [v for v in row if v]
        if filled and len(filled) < len(row) and all(v[0].islower() for v in filled):
            a.rows[-1] = [f"{x} {v}".strip() if v else x for x, v in zip(a.rows[-1], row)]
            skip += 1
    a.dividers += [i - skip + len(a.rows) for i in b.dividers if i >= skip]
    a.rows += b.rows[skip:]


class Outline:
    """What a block stands under: open sections, items and letters."""

    def __init__(self):
        self.open: list[dict] = []

    def level(self) -> int:
        return self.open[-1]["level"] if self.open else 0

    def close_for(self, kind: str, level: int, number: str | None, annex: bool, under: dict | None) -> None:
        """Closes what the new block does not stand under. Only an annex closes an annex."""
        while self.open:
            top = self.open[-1]
            if kind == "alinea":
                keep = top["kind"] != "alinea"
            elif annex:
                keep = False
            elif top["annex"]:
                keep = True
            elif under is not None:
                keep = top is under
            elif kind == "section" and level == 1 or top["kind"] == "alinea":
                keep = False
            elif number and _DOTTED.fullmatch(number) and top["scope"]:
                keep = number.startswith(top["scope"] + ".")
            else:
                keep = top["level"] < level
            if keep:
                return
            self.open.pop()

    def enter(self, kind: str, level: int, number: str | None, annex: bool, text: str, inherits: bool) -> None:
        own = number if number and _DOTTED.fullmatch(number) else None
        scope = own or (self.open[-1]["scope"] if inherits and self.open else None)
        heading = text if len(text) <= HEADING_CHARS else text[: HEADING_CHARS - 1].rstrip() + "…"
        self.open.append({"kind": kind, "level": level, "number": number, "annex": annex, "scope": scope, "heading": heading})

    def place(self) -> tuple[list[str], str]:
        return [e["number"] for e in self.open if e["number"]], " › ".join(e["heading"] for e in self.open)

    def parent_of_heading(self, following: str | None) -> dict | None:
        """The numbered entry a heading without a number stands under: the one that holds the next number, or whose next sibling it is."""
        numbered = [e for e in reversed(self.open) if e["kind"] != "alinea" and e["number"] and e["scope"]]
        if following:
            head, _, last = following.rpartition(".")
            for test in (lambda s: following.startswith(s + "."), lambda s: s.rpartition(".")[0] == head and s.rpartition(".")[2].isdigit() and int(s.rpartition(".")[2]) + 1 == int(last)):
                if hit := next((e for e in numbered if test(e["scope"])), None):
                    return hit
        return None


def classify(x: dict, found, following: str | None, outline: Outline, first: bool) -> tuple[str, int, str | None, bool, dict | None]:
    """Kind, level, number, whether it is an annex, and the entry it is a heading under."""
    label, text = x["label"], x["text"]
    if label in ("footnote", "title"):
        return label, 0 if label == "title" else outline.level(), None, False, None
    if label == "section_header":
        if found:
            kind, level, number, _ = found
            return "section", 1 if kind == "alinea" else level, number, number.startswith("ANEXO "), None
        if first and x["boxes"] and x["boxes"][0]["page"] == 1 and upper_ratio(text) >= 0.6:
            return "title", 0, None, False, None
        parent = outline.parent_of_heading(following)
        return "section", parent["level"] + 1 if parent else 1, None, False, parent
    if not found:
        marker = re.fullmatch(r"(\d{1,2}(?:\.\d{1,2})*)\.?", x["marker"] or "") if label == "list_item" else None
        if marker:
            return "item", max(2, 1 + marker[1].count(".")), marker[1], False, None
        return "caption" if label == "caption" else "paragraph", outline.level(), None, False, None
    kind, level, number, rest = found
    if kind == "section" and not number.startswith(("ANEXO ", "CLÁUSULA ")):
        if not re.match(r"\d{1,2}\.", text):
            return "paragraph", outline.level(), None, False, None
        heading = len(rest) <= SHORT_HEADING and upper_ratio(rest) >= 0.6
        return ("section", 1, number, False, None) if heading else ("item", 2, number, False, None)
    if kind == "section":
        return "section", 1, number, number.startswith("ANEXO "), None
    if kind == "alinea":
        parent = next((e for e in reversed(outline.open) if e["kind"] != "alinea"), None)
        return "alinea", (parent["level"] if parent else 1) + 1, number, False, None
    return "item", max(2, level), number, False, None


def document_blocks(doc: dict, remove_running: bool = True) -> tuple[list[dict], int]:
    """The blocks of a document in reading order, and how many running lines were removed."""
    items, dropped = flatten(doc)
    items = relocate(items)
    if remove_running:
        items, more = drop_running(items, len(doc.get("pages") or {}))
        dropped += more
    found = [numbering(x["text"]) if "text" in x else None for x in items]
    following: list[str | None] = [None] * (len(items) + 1)
    for i in range(len(items) - 1, -1, -1):
        f = found[i]
        following[i] = f[2] if f and f[0] != "alinea" and _DOTTED.fullmatch(f[2]) else following[i + 1]
    outline, out = Outline(), []
    texts = {x["ref"]: x["text"] for x in items if "text" in x}
    for i, x in enumerate(items):
        pages = [b["page"] for b in x["boxes"]] or [out[-1]["page_end"] if out else 1]
        base = {"page_start": min(pages), "page_end": max(pages), "bboxes": x["boxes"], "source_ref": x["ref"], "item_number": None}
        if "table" in x:
            g = grid_of(x["table"])
            if not g.rows:
                continue
            last = out[-1] if out else None
            g.caption = " ".join(texts[r] for r in x["captions"] if r in texts) or (last["text"] if last and last["kind"] != "table" and last["text"].endswith(":") else None)
            if last and last["kind"] == "table" and len(last["grid"].rows[0]) == len(g.rows[0]) and not g.headers and min(pages) == last["page_end"] + 1:
                merge_grids(last["grid"], g)
                last.update(page_end=max(pages), bboxes=last["bboxes"] + x["boxes"], text=last["grid"].text())
                continue
            ancestors, path = outline.place()
            out.append(base | {"kind": "table", "level": outline.level(), "text": g.text(), "ancestors": ancestors, "section_path": path, "grid": g})
            continue
        kind, level, number, annex, under = classify(x, found[i], following[i + 1], outline, not out)
        text = re.sub(r"^[•▪◦·*‣●]\s*", "", x["text"])
        text = re.sub(r"^[-–—]\s+", "", text) if x["label"] == "list_item" else text
        if not text:
            continue
        if kind in ("section", "item", "alinea"):
            outline.close_for(kind, level, number, annex, under)
        ancestors, path = ([], "") if kind == "title" else outline.place()
        out.append(base | {"kind": kind, "level": level, "text": text, "item_number": number, "ancestors": ancestors, "section_path": path, "grid": None})
        if kind in ("section", "item", "alinea"):
            outline.enter(kind, level, number, annex, text, kind == "alinea" or under is not None)
    return out, dropped


_BOX = pa.struct([("page", pa.int32()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64())])
_COLUMNS = [
    ("block_index", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("item_number", pa.string()), ("text", pa.string()), ("section_path", pa.string()), ("ancestors", pa.list_(pa.string())),
    ("page_start", pa.int32()), ("page_end", pa.int32()), ("bboxes", pa.list_(_BOX)), ("source_ref", pa.string()), ("markdown", pa.string()), ("removed", pa.int32()),
]
_DDL = "block_index int, kind string, level int, item_number string, text string, section_path string, ancestors array<string>, page_start int, page_end int, bboxes array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>, source_ref string, markdown string, removed int"


def layout_blocks(df: DataFrame, document: str, layout: str) -> DataFrame:
    """``document`` and its blocks, from the JSON text of its layout.

    Null, blank and broken JSON, and documents without text, have no blocks. ``markdown`` is that of tables, ``removed``
    the running lines that were left out of the document. Other columns are not read.
    """
    kind = df.schema[document].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, cols = [], {n: [] for n, _ in _COLUMNS}
            for i, text in enumerate(b.column(1).to_pylist()):
                try:
                    doc = json.loads(text) if text and text.strip() else None
                except ValueError:
                    doc = None
                blocks, removed = document_blocks(doc) if isinstance(doc, dict) else ([], 0)
                for k, x in enumerate(blocks):
                    keys.append(i)
                    row = x | {"block_index": k, "removed": removed, "markdown": x["grid"].markdown() if x["grid"] else None}
                    for n in cols:
                        cols[n].append(row[n])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, type=pa.int64())), *(pa.array(cols[n], type=t) for n, t in _COLUMNS)], names=[document, *cols])

    return df.select(document, layout).mapInArrow(run, f"`{document}` {kind}, {_DDL}")
