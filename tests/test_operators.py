import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavra.functions.text import abstains, canonical_value, extract_values, index_tokens, number_variants, query_phrases
from lavra.operators import answers, csv_rejects, ingest, packed_values
from lavra.plans import pipeline, retrieval
from lavra.sources import files


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("R$ 1.000,00", "R$1000"), ("R$ 5 milhões", "R$5000000"), ("7/4/26", "07/04/2026"), ("3 de março de 2031", "03/03/2031"), ("20,0 %", "20%"), ("12,5%", "12.5%"),
    ("9h30", "09:30"), ("8h", "08:00"), ("1.234.567", "1234567"), ("6.5.5", "6.5.5"), ("1,5 mil", "1500"), ("R$ 10,50", "R$10,50"), ("abc", None),
])
def test_canonical_value(spark, raw, want):
    assert one(spark, canonical_value(F.col("v")), v=raw) == want


def test_values_in_order_without_labels(spark):
    text = "Até 30 dias, R$ 2.000,00 [c_ab12cd] ou 20% em 01/02/2031; 3 meses; 30 dias"
    assert one(spark, extract_values(F.col("v")), v=text) == ["30", "R$2000", "20%", "01/02/2031", "3"]
    assert one(spark, extract_values(F.col("v")), v=None) is None


def test_query_phrases(spark):
    got = one(spark, query_phrases(F.col("v")), v="Qual o prazo do item 6.5.5 para FINEP e ações?")
    assert got[0] == ["6", "5", "5"] and ["finep"] in got and ["acoes"] in got and ["acao"] in got and ["qual"] not in got
    assert one(spark, query_phrases(F.col("v")), v="de que") == [["de"], ["que"], ["ques"]]
    assert one(spark, query_phrases(F.col("v")), v="") == []


def test_number_variants_and_tokens(spark):
    assert one(spark, number_variants(F.col("v")), v="editais") == ["editais", "edital"]
    assert one(spark, index_tokens(F.col("v")), v="Ação, n.º 2-B") == ["acao", "n", "º", "2", "b"]


def test_abstains(spark):
    assert one(spark, abstains(F.col("s"), F.col("t")), s="answered", t="\n Não consta nos documentos. Mas") is True
    assert one(spark, abstains(F.col("s"), F.col("t")), s="answered", t="Há. Não consta nos documentos.") is False
    assert one(spark, abstains(F.col("s"), F.col("t")), s=None, t=None) is False


def brute_bm25(questions, rows, k):
    n = len(rows)
    toks = {r: (t.split(), p.split()) for r, t, p in rows}
    avg = sum(len(t) + len(p) for t, p in toks.values()) / n
    count = lambda ts, ph: sum(ts[i : i + len(ph)] == ph for i in range(len(ts)))
    out = {}
    for q, phrases in questions.items():
        score = {}
        for ph in phrases:
            tf = {r: count(t, ph) + 0.5 * count(p, ph) for r, (t, p) in toks.items()}
            df = sum(v > 0 for v in tf.values())
            if df:
                idf = math.log((n - df + 0.5) / (df + 0.5))
                idf = idf if idf > 0 else 1e-6
                for r, v in tf.items():
                    if v:
                        length = len(toks[r][0]) + len(toks[r][1])
                        score[r] = score.get(r, 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * length / avg))
        out[q] = sorted(score, key=lambda r: (-round(score[r], 9), r))[:k]
    return out


def test_bm25_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["prazo", "valor", "6", "5", "recurso", "edital", "bolsa", "meta"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 12))), " ".join(rng.choice(vocabulary, 2))) for i in range(60)]
    chunks = spark.createDataFrame([(r, t, p, "w") for r, t, p in rows], "rowid long, text string, context_prefix string, workspace_id string")
    q = spark.createDataFrame([(1, "w", "prazo do recurso"), (2, "w", "item 6.5 da bolsa"), (3, "w", "nada")], "qid long, workspace_id string, question string")
    got = {}
    for r in retrieval.bm25(spark, q, chunks, chunks, 10).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["rowid"])
    want = brute_bm25({1: [["prazo"], ["recurso"]], 2: [["6", "5"], ["bolsa"]]}, rows, 10)
    assert got == want


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 10, 1, 334), (1, 11, 2, 421), (1, 12, 3, 312)], "qid long, rowid long, pos int, size long")
    assert [r["rowid"] for r in pipeline.fit_budget(df, 700).orderBy("place").collect()] == [10, 12]


def raw(spark, rows):
    return spark.createDataFrame([(i, f, n, x, "extra") for i, (f, n, x) in enumerate(rows, 1)], "line_id long, file_name string, line_no int, raw_line string, id string")


def test_rejects_in_order_of_reasons(spark):
    rows = [
        ("a", 1, "﻿id;question;answerable"), ("a", 2, "1;Por quê?;sim\r"), ("a", 3, '2;"x;nao'), ("a", 4, "3;x"), ("a", 5, "1;y;não"), ("a", 6, ";y;n"),
        ("a", 7, "4; ;n"), ("a", 8, "5;y;talvez"), ("a", 9, '6;"uma ""duas""; três\nquatro"; TRUE '), ("a", 10, "   "), ("a", 11, None), ("a", 12, ' "7" ;y;0'), ("b", 2, "sem cabeçalho"),
    ]
    got = {r["line_id"]: (r["reason"], r["question"]) for r in csv_rejects.load_records(spark, raw(spark, rows)).collect()}
    assert {k: v[0] for k, v in got.items()} == {2: None, 3: "quoting", 4: "columns", 5: "id", 6: "id", 7: "question", 8: "answerable", 9: None, 12: None, 13: "id"}
    assert got[9][1] == 'uma "duas"; três\nquatro' and got[2][0] is None and got[12][0] is None
    assert csv_rejects.load_records(spark, raw(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("text, want", [
    ("a | b;c\nd / e", ["a", "b", "c", "d", "e"]), ('"a;b"|"c ""x"" d"', ["a;b", 'c "x" d']), ("R$ 1.000,00, 7,5%, 01/02/2030", ["R$ 1.000,00", "7,5%", "01/02/2030"]),
    ("plano x, deve publicar", ["plano x, deve publicar"]), ('["a, b", "c"]', ["a, b", "c"]), (";; x ;", ["x"]), ("a/b", ["a/b"]), ("", []), (None, []), ("'a' ; 'b'", ["a", "b"]), ("copo d'água|b", ["copo d'água", "b"]),
])
def test_divide(text, want):
    assert packed_values.divide(text, packed_values.Model()) == want


def test_commas_divide_what_the_column_knows(spark):
    """Words that stand alone elsewhere are divided at commas; text that does not is not; bullets are delimiters."""
    rows = [(i, v) for i, v in enumerate(["alfa", "beta", "gama", "alfa|beta", "gama;alfa", "beta\nplano x"] * 4 + ["alfa, beta, gama", "plano x, que se amplia", "• alfa  •beta • plano x", "12,5%, 7,5%", "3%,4%"])]
    got = {}
    for r in packed_values.split_values(spark, spark.createDataFrame(rows, "k long, v string"), "k", "v").orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["val"])
    assert [got[k] for k in range(24, 29)] == [["alfa", "beta", "gama"], ["plano x, que se amplia"], ["alfa", "beta", "plano x"], ["12,5%", "7,5%"], ["3%", "4%"]]


@pytest.mark.parametrize("seed", range(5))
def test_expected_counts_and_best_path_against_all_divisions(seed):
    """Forward-backward and Viterbi against the sum and the best of all divisions of short fields."""
    rng = np.random.default_rng(seed)
    counts = np.zeros((2, packed_values.BUCKETS), dtype=np.float32)
    for v in ["a", "b", "a, b", "0%", "0,0%"]:
        x, y = packed_values.buckets(v)
        counts[0, x] = counts[1, y] = rng.integers(1, 50)
    model = packed_values.Model(counts)
    text = ", ".join(rng.choice(["a", "b", "7,5%", "3%", "c"], 4))
    piece = packed_values.lattices(text)[0]
    n = len(piece.contexts) + 1
    by_edge = {(i, j): c for i, j, c in model.edges(piece)}
    paths = []
    for mask in range(1 << (n - 1)):
        nodes = [0, *(k + 1 for k in range(n - 1) if mask >> k & 1), n]
        c = [by_edge.get(e, math.inf) for e in zip(nodes, nodes[1:])]
        paths.append((sum(c), nodes))
    total = -np.logaddexp.reduce([-c for c, _ in paths])
    values, signs = {}, {}
    assert math.isclose(packed_values.expected(piece, model, 1.0, values, signs), -total, rel_tol=1e-9)
    want = sum(math.exp(total - c) * (len(nodes) - 1) for c, nodes in paths)
    assert math.isclose(sum(values.values()), want, rel_tol=1e-4)
    best = min(paths)[1]
    assert packed_values.divide(text, model) == [packed_values.unwrap(piece.value(i, j)) for i, j in zip(best, best[1:])]


def test_split_values_of_an_empty_and_a_dirty_table(spark):
    df = spark.createDataFrame([(1, "a|b", 5), (1, "a|b", 6), (2, None, 5), (None, "c", 1), (3, "x" * 5000, 1)], "row_id long, v string, pos int")
    got = {(r["row_id"], r["pos"], r["val"][:3]) for r in packed_values.split_values(spark, df, "row_id", "v").collect()}
    assert got == {(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (3, 1, "xxx")}
    assert packed_values.split_values(spark, df.limit(0), "row_id", "v").count() == 0


def test_labels_and_blocks():
    assert answers.normalise_labels("fim (c_ab12cd, c_ef34ab).") == "fim [c_ab12cd] [c_ef34ab]."
    assert answers.normalise_labels("prazo[c_ab12cd]") == "prazo [c_ab12cd]"
    assert [k for k, _ in answers.answer_blocks("# T\n\n- a\n  b\n| x |\n| y |\n\np\nq\n---")] == ["heading", "list", "table", "paragraph", "rule"]


def test_gate(spark):
    a = spark.createDataFrame([
        (1, "O prazo é de 30 dias [c_ab12cd].\n\nO valor é de R$ 50,00 [c_ab12cd]."), (2, "Não consta nos documentos."), (3, None), (4, "O prazo final é de 45 dias."),
        (5, "Qual dos editais interessa?"), (6, "Os pesos são [c_ab12cd]:\n- prazo de 30 dias\n- total de 12 meses"), (7, "| prazo | 30 dias |\n\n[c_ab12cd] (item 9.5)"), (8, "Conforme o item 9, são 30 dias [c_ab12cd]."),
        (9, "São 12 meses de execução.\n\n[c_zz99zz]"),
    ], "aid long, text string")
    c = [(i, "c_ab12cd", "prazo de 30 dias", "9.1", 0) for i in range(1, 9)] + [(1, "c_ab12cd", "outro", "1", 1), (1, "c_ffffff", "R$ 50,00", None, 2)]
    c = spark.createDataFrame(c, "aid long, label string, text string, item_number string, pos int")
    g = answers.grade(a, c)
    got = {(r["aid"], r["block"]): (r["issue"], r["misplaced"]) for r in g.collect()}
    assert got[1, 0] == (None, []) and got[1, 1] == ("unsupported", ["R$50"]) and got[4, 0][0] == "uncited"
    assert got[6, 1][0] is None and got[6, 2][0] == "unsupported" and got[7, 0][0] is None and got[7, 1][0] is None and got[8, 0][0] is None
    strict = {r["aid"]: (r["status"], r["removed"], r["text"]) for r in answers.gate(g).collect()}
    assert strict[1] == ("partial", 1, "O prazo é de 30 dias [c_ab12cd].") and strict[2][0] == "not_found" and strict[4][0] == "unsupported" and strict[5][0] == "clarification"
    assert strict[6][0] == "partial" and strict[6][2].endswith("- prazo de 30 dias") and strict[7][:2] == ("answered", 0) and 3 not in strict
    warn = {r["aid"]: (r["status"], r["removed"], r["grounded"]) for r in answers.gate(g, "warn").collect()}
    assert warn[1] == ("answered", 0, False) and warn[8] == ("answered", 0, True)
    notes = {r["aid"]: r["notes"] for r in answers.repair_notes(g).collect()}
    assert notes[4] == "uncited: O prazo final é de 45 dias." and notes[1].startswith("not in the cited texts: R$50 in")


def test_citations_and_quotes(spark):
    a = spark.createDataFrame([(1, "O prazo é de 30 dias (c_ab12cd, c_000000). O valor do apoio é outro[c_ffffff] e [c_ab12cd]"), (2, None)], "aid long, text string")
    c = spark.createDataFrame([(1, "c_ab12cd", "Regras gerais do art. quinto. O prazo máximo é de 30 dias. Fim da regra."), (1, "c_ffffff", "O valor do apoio é fixo.")], "aid long, label string, text string")
    r = answers.cite(a, c).collect()
    assert len(r) == 1 and r[0]["text"] == "O prazo é de 30 dias [c_ab12cd]. O valor do apoio é outro [c_ffffff] e [c_ab12cd]" and r[0]["invalid"] == ["c_000000"]
    assert r[0]["display"] == "O prazo é de 30 dias [1]. O valor do apoio é outro [2] e [1]"
    assert [(x["ordinal"], x["label"], x["quote"]) for x in r[0]["citations"]] == [(1, "c_ab12cd", "O prazo máximo é de 30 dias."), (2, "c_ffffff", "O valor do apoio é fixo.")]


@pytest.mark.parametrize("text, value, want", [
    ("são 3 meses", "3", True), ("são 300.000", "3", False), ("R$ 1.500,00 no total", "R$ 1.500", True), ("15,0%", "5,0%", False), ("5% do total", "5,0%", True), ("as empresas brasileiras", "empresa brasileira", True),
    ("o edital", "editais", True), ("12 (doze) meses", "12 meses", True), ("7 de abril de 2026", "07/04/2026", True), ("nada", "algo", False), (None, "x", False),
])
def test_contains_value(spark, text, value, want):
    from lavra.functions.text import contains_value

    assert one(spark, contains_value(F.col("t"), F.col("v")), t=text, v=value) is want


def test_scores(spark):
    q = spark.createDataFrame([(1, "w", "t", "?", "8.1", None, ["30 dias"], True), (2, "w", "t", "?", None, None, [], False), (3, "w", None, "?", "8", "Edital X", [], True)],
                              "qid long, workspace_id string, topic string, question string, item string, document string, values array<string>, answerable boolean")
    rows = [(10, 1, "a", "answered", "São 30 dias."), (11, 2, "a", "not_found", "Não consta nos documentos."), (12, 3, "a", "error", ""), (13, 1, "b", "clarification", "30 dias?"), (14, 3, "b", "answered", "Há regra.")]
    a = spark.createDataFrame([(*r, None, 100, 0, 0, True, 0, 0, 0, 0) for r in rows], "aid long, qid long, arm string, status string, text string, raw string, latency_ms int, overhead int, repaired int, grounded boolean, removed int, unsupported int, misplaced int, invalid int").withColumn("mode", F.lit("rag"))
    c = spark.createDataFrame([(10, "c", "8.1.2", "", "x", "t"), (14, "c", None, "1. A › 8. B", "x", "O edital x de 2030")], "aid long, label string, item_number string, section_path string, text string, title string")
    from lavra.plans import scores

    s = scores.score(q, a, c)
    got = {r["aid"]: (r["correct"], r["abstained"], r["retrieval_hit"], r["cited_expected"], r["values_found"]) for r in s.collect()}
    assert got == {10: (True, False, True, True, 1), 11: (True, True, None, None, 0), 12: (False, False, False, False, 0), 13: (False, False, False, False, 1), 14: (True, False, True, True, 0)}
    m = {r["arm"]: r for r in s.groupBy("arm").agg(*scores.measures()).collect()}
    assert m["a"]["accuracy"] == pytest.approx(2 / 3) and m["a"]["errors"] == 1 and m["a"]["abstention_accuracy"] == 1.0 and m["b"]["abstention_accuracy"] is None and m["a"]["mean_latency"] == 100.0


def test_windows():
    text = ("Uma frase curta. " * 400).strip()
    spans = ingest.windows(text)
    assert all(b - a <= 1600 for a, b in spans) and all(0 <= b - c <= 150 for (_, b), (c, _) in zip(spans, spans[1:])) and spans[-1][1] == len(text)
    assert ingest.windows("") == [] and ingest.windows("  ") == [] and ingest.acronyms("Núcleo de Inovação Tecnológica (NIT) e outro (XYZ)") == [("Núcleo de Inovação Tecnológica", "NIT")]


def test_gold_csv(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text('﻿ID,question,expected_values,answerable\n1,"a, ""b""",x|y| ,não\n,,,\n2,"c\nd",,\n', encoding="utf-8")
    got = {r["id"]: (r["question"], r["expected_values"], r["answerable"]) for r in files.read_gold_csv(spark, str(p)).collect()}
    assert got == {"1": ('a, "b"', ["x", "y"], False), "2": ("c\nd", [], True)}
    p.write_text("id,question\n1,a\n1,b\n")
    with pytest.raises(ValueError):
        files.read_gold_csv(spark, str(p))


def test_vector_blobs(spark):
    df = spark.createDataFrame([([1.0, 2.5],), (None,)], "v array<float>")
    assert Counter(map(str, [r["x"] for r in df.select(files.vector_from_blob(files.vector_to_blob("v")).alias("x")).collect()])) == Counter(["[1.0, 2.5]", "None"])
