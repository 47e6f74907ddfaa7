"""Layout, chunks, glossary and what models write, on small hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from lavra.operators import chunker, ingest, layout
from lavra.plans import pipeline, upkeep


def box(page, top):
    return [{"page_no": page, "bbox": {"l": 10, "t": 100 - top, "r": 90, "b": 100 - top - 5, "coord_origin": "BOTTOMLEFT"}}]


def text(i, label, value, page=1, top=10.0, **more):
    return {"self_ref": f"#/texts/{i}", "label": label, "text": value, "prov": box(page, top), **more}


def cell(value, r, c, rows=1, cols=1, **more):
    return {"text": value, "start_row_offset_idx": r, "end_row_offset_idx": r + rows, "start_col_offset_idx": c, "end_col_offset_idx": c + cols, **more}


def layout_doc():
    texts = [
        text(0, "section_header", "EDITAL DE TESTE", 1, 12), text(1, "section_header", "1. OBJETO", 1, 20), text(2, "list_item", "1.1. Primeiro item.", 1, 30), text(3, "text", "a) uma letra;", 1, 35), text(4, "page_footer", "p. 1", 1, 97),
        text(5, "caption", "Tabela 1", 1, 40), text(6, "text", "Depois da tabela", 1, 80), text(7, "text", "Rodapé 1", 1, 97), text(8, "text", "Rodapé 2", 2, 97), text(9, "section_header", "ANEXO I - MODELO", 2, 10), text(10, "text", "2.1 Item do anexo", 2, 20),
        text(11, "section_header", "2. PRAZOS", 2, 30), text(12, "text", "3 ICTs poderão", 2, 40),
    ]
    head = [cell("Nome", 0, 0, column_header=True), cell("Valor", 0, 1, column_header=True)]
    table = {"self_ref": "#/tables/0", "label": "table", "prov": box(1, 45), "captions": [{"$ref": "#/texts/5"}], "data": {"num_rows": 4, "num_cols": 2, "table_cells": [*head, cell("Grupo", 1, 0, cols=2), cell("x | y", 2, 0, rows=2), cell("De R$ 1 a", 2, 1), cell("R$ 2", 3, 1)]}}
    refs = [0, 1, 2, 3, 4, "t", 7, 6, 8, 9, 10, 11, 12]
    body = [{"$ref": "#/groups/0"}] + [{"$ref": "#/tables/0" if r == "t" else f"#/texts/{r}"} for r in refs[2:]] + [{"$ref": "#/texts/2"}, {"$ref": "#/texts/99"}]
    return {"texts": texts, "tables": [table], "groups": [{"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}]}], "pictures": [], "body": {"children": body}, "pages": {str(p): {"page_no": p, "size": {"width": 100, "height": 100}} for p in (1, 2)}}


def test_layout_blocks(spark):
    df = spark.createDataFrame([("d", json.dumps(layout_doc()), 1), ("e", None, 1), ("f", "{broken", 1), ("g", "{}", 1)], "document_id string, layout string, text int")
    rows = layout.layout_blocks(df, "document_id", "layout").orderBy("block_index").collect()
    assert {r["document_id"] for r in rows} == {"d"} and rows[0]["removed"] == 3
    got = [(r["kind"], r["item_number"], r["level"], r["text"].split("\n")[0]) for r in rows]
    assert got == [
        ("title", None, 0, "EDITAL DE TESTE"), ("section", "1", 1, "1. OBJETO"), ("item", "1.1", 2, "1.1. Primeiro item."), ("alinea", "a", 3, "a) uma letra;"), ("caption", None, 3, "Tabela 1"), ("table", None, 3, "Nome | Valor"), ("paragraph", None, 3, "Depois da tabela"),
        ("section", "ANEXO I", 1, "ANEXO I - MODELO"), ("item", "2.1", 2, "2.1 Item do anexo"), ("section", "2", 1, "2. PRAZOS"), ("paragraph", None, 1, "3 ICTs poderão"),
    ]
    assert rows[3]["ancestors"] == ["1", "1.1"] and rows[3]["section_path"] == "1. OBJETO › 1.1. Primeiro item."
    assert rows[9]["ancestors"] == ["ANEXO I"]  # only an annex closes an annex
    assert rows[5]["markdown"].split("\n") == ["| Nome | Valor |", "| --- | --- |", "| **Grupo** |  |", "| x \\| y | De R$ 1 a R$ 2 |"]
    assert rows[0]["bboxes"][0].asDict() == {"page": 1, "x0": 0.1, "y0": 0.12, "x1": 0.9, "y1": 0.17}


def test_tables_merge_over_pages():
    a, b = layout.Grid([["h", "i"], ["a", "b"]], [0]), layout.Grid([["h", "i"], ["", "mais"], ["c", "d"]], [], [2])
    layout.merge_grids(a, b)
    assert a.rows == [["h", "i"], ["a", "b mais"], ["c", "d"]] and a.dividers == [2] and a.divider_above(3) == "c" and a.names() == ["h", "i"]


def block(i, kind, value, number=None, level=2, path="1. A", ancestors=()):
    return {"block_id": i, "block_index": i, "kind": kind, "level": level, "item_number": number, "text": value, "section_path": path, "ancestors": list(ancestors)}


def test_section_chunks():
    blocks = [block(0, "section", "1. A", "1", 1), block(1, "item", "1.1. Cláusula-mãe:", "1.1", 2), block(2, "alinea", "a) " + "x" * 60, "a", 3, ancestors=["1", "1.1"]), block(3, "alinea", "b) " + "y" * 60, "b", 3, ancestors=["1", "1.1"])]
    out = chunker.section_chunks(blocks, 120, 20)
    assert [(c["kind"], c["parent"], c["embed"]) for c in out] == [("section", False, False), ("item", True, True), ("item", True, True)]
    assert out[1]["text"] == "1.1. Cláusula-mãe:\n" + blocks[2]["text"] and out[2]["text"].startswith("1.1. Cláusula-mãe:\nb)")
    long = chunker.section_chunks([block(0, "paragraph", "Uma frase longa aqui. " * 30)], 200, 40)
    assert len(long) > 3 and all(len(c["text"]) <= 200 and not c["parent"] for c in long)
    table = "\n".join(["| a | b |", "| --- | --- |", *(f"| {i} | {'z' * 20} |" for i in range(12))])
    parts = chunker.section_chunks([block(0, "caption", "Tabela 1"), block(1, "table", table, "5.1")], 150, 0)
    assert all(p["text"].startswith("| a | b |") or p["text"].startswith("Tabela 1\n| a") for p in parts) and parts[0]["text"].startswith("Tabela 1") and {p["item_number"] for p in parts} == {"5.1"}
    assert chunker.section_chunks([]) == [] and chunker.section_chunks([block(0, "paragraph", None)]) == []


def test_windows_end_at_sentences():
    t = "O art. 5 vale. " * 20
    assert all(t[a:b].endswith("vale.") for a, b in chunker.windows(t.strip(), 100, 20)) and chunker.sentence_ends("Ver art. 5. Sim. S. Paulo") == [16, 25]


def test_glossary():
    t = "2.1.1 Instituição Executora: entidade responsável pela execução do projeto 2.1.2 Instituição Parceira: entidade que participa do projeto aprovado. As Instituições Científicas, Tecnológicas e de Inovação (ICTs) e outras. Entende-se por risco tecnológico a possibilidade de insucesso no desenvolvimento."
    e = ingest.merge_entries(ingest.extract_glossary(t))
    got = {x["term"]: (x["kind"], x["aliases"], x["label"]) for x in e}
    assert got["Instituição Executora"] == ("definicao", ["Instituição Parceira"], "2.1.1") and got["risco tecnológico"][0] == "expressao" and "insucesso" in got["risco tecnológico"][1]
    assert got["Instituições Científicas, Tecnológicas e de Inovação"] == ("sigla", ["ICT", "ICTs"], None)
    assert ingest.glossary_groups("O que é ICT?", e) == [["Instituições Científicas, Tecnológicas e de Inovação", "ICTs"]]
    assert ingest.glossary_groups("E a executora?", e)[0][0] == "Instituição Executora" and ingest.glossary_groups("Nada", e) == []
    assert ingest.glossary_groups("E a executora?", e, {"Instituição Parceira"}) == [["Instituição Parceira"]]
    assert ingest.hand_groups("o valor da bolsa", [{"terms": ["auxílio", "bolsa"]}, {"terms": ["teto"], "triggers": ["valor da bolsa"]}]) == [["teto"], ["auxílio"]]
    assert ingest.merge_entries([{"term": "Ação", "aliases": ["x"], "kind": "expressao", "label": None}, {"term": "acao", "aliases": ["y"], "kind": "sigla", "label": "1"}, {"term": "vazio", "aliases": [], "kind": "sigla", "label": None}]) == [{"term": "Ação", "aliases": ["x", "y"], "kind": "sigla", "label": "1"}]


def test_merge_glossary_table(spark):
    rows = [("d", 1, "Ação", ["x"], "expressao", None), ("d", 2, "acao", ["y", "x"], "sigla", "1"), ("d", 3, "vazio", [], "sigla", None)]
    df = spark.createDataFrame(rows, "document_id string, p int, term string, aliases array<string>, kind string, label string")
    assert [tuple(r) for r in ingest.merge_glossary(df, "document_id", ["p"]).collect()] == [("d", "Ação", "sigla", ["x", "y"], "1")]


def test_what_models_write():
    assert ingest.json_list('ok ```json\n[{"termo": "Teto"}]\n``` fim') == [{"termo": "Teto"}] and ingest.json_list("[x") == [] and ingest.json_list("") == []
    assert ingest.anchored([{"termo": "Teto de gastos", "sinonimos": ["limite máximo", "teto de gastos", 3]}, {"termo": "x"}, {"termo": "fora do texto", "sinonimos": ["abcd"]}], "o TETO DE GASTOS vale") == [{"term": "Teto de gastos", "aliases": ["limite máximo"], "kind": "llm", "label": None}]
    assert ingest.variants_of('- "Qual é o prazo final?"\n2) Qual o valor?\nqual e o PRAZO final\ncurta', "Qual o valor", 3) == ["Qual é o prazo final?"]
    assert ingest.search_requests("<buscar> prazo final </buscar><BUSCAR>valor total</BUSCAR>") == ["prazo final", "valor total"] and ingest.search_requests("x" * 90 + "<buscar>prazo</buscar>") == []
    assert ingest.retry_after("try again in 3m10.5s") == 120_000 and ingest.retry_after("try again in 255ms") == 1755 and ingest.retry_after("no") == 20_000
    assert [ingest.failure_kind(x) for x in ("429 rate limit", "tokens per day (TPD)", "boom")] == ["rate", "quota", "other"]
    one = [{"label": "a", "text": "x" * 10}]
    assert [c["label"] for c in ingest.extend_context(one, [[{"label": "b", "text": "y" * 8}, {"label": "a", "text": "z"}], [{"label": "c", "text": "y" * 8}, {"label": "d", "text": "yy"}]], 12)] == ["a", "b", "d"]


def test_settings():
    assert upkeep.deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2], "b": None}, "e": 3}) == {"a": {"b": 1, "c": [2]}, "d": 2, "e": 3}
    assert upkeep.canonical_json({"b": 1, "a": {"z": None, "é": "x"}}) == '{"a":{"é":"x"},"b":1}' and len(upkeep.config_hash({})) == 64
    assert upkeep.needs_reindex({"parser": 1, "x": 1}, {"parser": 1, "x": 2}) is False and upkeep.needs_reindex({"chunking": {"a": 1}}, {"chunking": {"a": 2}})
    assert upkeep.arm_config({"a": 1}, {"grounding": "off"}, {"grounding": "strict"}, "v4") == {"a": 1, "grounding": "off", "prompt": "v4"} and upkeep.arm_config({}, None, {"grounding": "warn"}) == {"grounding": "warn"}


def test_replace_keys(spark):
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string"), spark.createDataFrame([(1, "z")], "k long, v string")
    assert sorted(tuple(r) for r in upkeep.replace_keys(old, new, ["k"]).collect()) == [(1, "z"), (2, "c")]


@pytest.mark.parametrize("identifier, text_, want", [
    ("6.5.5", "ver (6.5.5), sim", True), ("6.5.5", "6.5.5.1", False), ("6.5.5", "16.5.5", False), ("R$ 10,00", "de R$10,00 ao", True), ("R$ 10", "R$ 10,00", False), ("CAPES", "a CAPES.", True), ("CAPES", "CAPESS", False), ("01/02/2030", "em 01/02/2030;", True),
])
def test_identifiers_are_whole_tokens(spark, identifier, text_, want):
    df = spark.createDataFrame([(identifier, text_)], "i string, t string")
    assert df.select(pipeline.identifier_pattern(F.col("i")).alias("p"), "t").select(F.expr("rlike(t, p)").alias("x")).first()["x"] is want


def row(rowid, rrf, doc="d", label=None, parent=None, kind="item", chars=100, **more):
    base = {"rowid": rowid, "rrf": rrf, "document_id": doc, "chunk_set_id": "s", "label": label or f"c{rowid}", "parent_label": parent, "kind": kind, "heading": None, "section_path": "", "item_number": None, "char_count": chars, "chars": chars, "precedence": 1, "identifier": False, "principal": False}
    return base | more


def places(out):
    return [r["rowid"] for r in sorted((r for r in out if r["place"]), key=lambda r: r["place"])]


def test_assemble():
    cfg = {**vars(pipeline.Config()), "top_k": 3, "budget": 300, "expand": False}
    rows = [row(1, 0.5), row(2, 0.4), row(3, 0.3, identifier=True), row(4, 0.2, doc="e")]
    assert places(pipeline.assemble(rows, {}, set(), 0, cfg)) == [3, 1, 2]  # the identifier moves up
    assert places(pipeline.assemble(rows, {}, {"e"}, 0, cfg)) == [3, 4, 1]  # a named document
    quota = [row(i, 1 - i / 10, doc="d" if i < 5 else "e", principal=True) for i in range(1, 7)]
    assert places(pipeline.assemble(quota, {}, set(), 2, cfg)) == [1, 2, 5]  # each principal document has one
    assert places(pipeline.assemble(rows, {}, set(), 0, cfg | {"budget": 250})) == [3, 1]
    assert places(pipeline.assemble(rows, {}, set(), 0, cfg, {4: 0.9, 1: 0.1})) == [4, 1, 3]  # a reranker's scores go first
    late = [row(1, 0.5), row(2, 0.4, precedence=2)]
    assert places(pipeline.assemble(late, {}, set(), 0, cfg)) == [2, 1]
    leaves = [row(1, 0.5, parent="p"), row(2, 0.4, parent="p"), row(3, 0.3), row(4, 0.2, parent="p"), row(5, 0.1)]
    parent = {("d", "s", "p"): row(9, 0.0, label="p", kind="section")}
    out = pipeline.assemble(leaves, parent, set(), 0, cfg | {"expand": True, "budget": 10_000})
    assert places(out) == [9, 3, 5] and {r["rowid"]: r["expanded_to"] for r in out}[1] == "p" and {r["rowid"]: r["rrf"] for r in out}[9] == pytest.approx(0.9)
    big = {("d", "s", "p"): row(9, 0.0, label="p", kind="section", chars=5000)}
    assert places(pipeline.assemble(leaves, big, set(), 0, cfg | {"expand": True, "budget": 10_000})) == [1, 2, 3]
    sections = [row(1, 0.5, kind="section", label="s1", heading="3. ALVO", item_number="3"), row(2, 0.3), row(3, 0.1, parent="s1"), row(4, 0.05, section_path="3. ALVO › x")]
    assert places(pipeline.assemble(sections, {}, set(), 0, cfg | {"section_boost": True})) == [3, 4, 1]


def test_stores(spark, tmp_path):
    from lavra.sources import files

    p = str(tmp_path / "runs")
    one = spark.createDataFrame([("r1", "q1", "a", "done"), ("r1", "q2", "a", "running"), ("r2", "q1", None, "done")], "run_id string, question string, arm string, status string")
    files.append_cases(one, p)
    assert sorted(r["status"] for r in files.read_cases(spark, p, "question string, arm string, status string, run_id string").collect()) == ["done", "error"]
    files.save_run(spark.createDataFrame([("r1", "q9", "b", "done")], one.schema), p)
    assert [(r["question"], r["run_id"]) for r in files.read_cases(spark, p, "question string, arm string, status string, run_id string").collect()] == [("q9", "r1")]
    files.delete_run(spark, p, "r1")
    assert files.read_cases(spark, p, "question string, arm string, status string, run_id string").count() == 0
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "d1.json").write_text(json.dumps(layout_doc()), encoding="utf-8")
    got = files.read_layouts(spark, str(tmp_path / "l")).collect()
    assert got[0]["document_id"] == "d1" and len(got[0]["parse_hash"]) == 64
    files.save_artefacts(spark, layout.layout_blocks(files.read_layouts(spark, str(tmp_path / "l")), "document_id", "layout"), str(tmp_path / "a"))
    again = spark.read.parquet(str(tmp_path / "a" / "sections"))
    assert {r["text"] for r in again.collect()} == {"1. OBJETO", "ANEXO I - MODELO", "2. PRAZOS"}
    report = spark.createDataFrame([("b", 10, 0.5, 20.0), ("a", 10, 0.9, 30.0), ("c", 10, 0.9, 10.0)], "name string, questions int, hit double, latency_ms double")
    md, js = files.lab_report(report)
    assert [line.split(" | ")[0] for line in md.split("\n")[2:]] == ["| c", "| a", "| b"] and [x["name"] for x in json.loads(js)["results"]] == ["c", "a", "b"]
