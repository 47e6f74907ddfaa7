import base64
import datetime as dt
import itertools
import os
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lavra.llm import conversations, encode, gbt, neighbours, oversized, pack, repetition, scans, sentences
from lavra.llm.bpe import PATTERN, TextEncoder, vocabulary
from lavra.session import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def coder():
    return TextEncoder(vocabulary())


@pytest.fixture(scope="session")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


# problem 8


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t's0aé日")), max_size=60), max_size=6))
def test_encoding_equals_the_public_one(texts):
    coder = test_encoding_equals_the_public_one.coder
    ids, ends = coder.encode(texts)
    for i, t in enumerate(texts):
        assert list(ids[ends[i] : ends[i + 1]]) == test_encoding_equals_the_public_one.oracle.encode_ordinary(t)
    assert list(coder.counts(texts)) == list(np.diff(ends))


@pytest.fixture(autouse=True, scope="session")
def _attach(coder, oracle):
    test_encoding_equals_the_public_one.coder, test_encoding_equals_the_public_one.oracle = coder, oracle


def test_encoding_of_special_and_long_texts(coder, oracle):
    texts = [None, "", "a" * 5000, " " * 300 + "x", "<|endoftext|>", "日本語の長い文" * 300, "\n \n\n  x"]
    ids, ends = coder.encode(texts)
    for i, t in enumerate(texts):
        assert list(ids[ends[i] : ends[i + 1]]) == oracle.encode_ordinary(t or "")


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "olá", 3), (1, "olá", 3), (None, None, 1), (2, "", 0)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode.encode_texts(df, "doc_id", "text", vocabulary()).collect())
    assert got[0] == (0, 0) and got[1] == got[2] and got[3] == (2, 0)
    assert encode.encode_texts(df.limit(0), "doc_id", "text", vocabulary()).count() == 0


# problem 9


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_item_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 400) for _ in range(30)}
    runs, n = pack.plan_histogram(counts, 64)
    used: dict[int, int] = {}
    for length, a, b, first, take in runs:
        assert used.get(length, 0) == a
        used[length] = b
        for r in range(a, b):
            used[-1 - (first + (r - a) // take)] = used.get(-1 - (first + (r - a) // take), 0) + length
    assert {k: v for k, v in used.items() if k > 0} == counts
    assert all(v <= 64 for k, v in used.items() if k < 0) and sum(k < 0 for k in used) == n


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit(seed):
    """The containers are filled as by best fit decreasing, item by item."""
    rng = random.Random(seed)
    counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(12)}
    runs, n = pack.plan_histogram(counts, 50)
    got: dict[int, list[int]] = {}
    for length, a, b, first, take in runs:
        for r in range(a, b):
            got.setdefault(first + (r - a) // take, []).append(length)
    bins: list[list[int]] = []
    for x in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
        fits = [b for b in bins if sum(b) + x <= 50]
        if fits:
            max(fits, key=sum).append(x)
        else:
            bins.append([x])
    assert sorted(map(sum, got.values())) == sorted(map(sum, bins)) and n == len(bins)  # of equal rooms either may be taken


def test_pack_ranks_a_hot_length_in_several_cells(spark):
    rows = [(i, 7 if i % 3 else 64 + i % 5) for i in range(500)]
    got = pack.pack(spark, spark.createDataFrame(rows, "k long, n int"), "k", "n", 64, cell=20).collect()
    filled = {}
    for r in got:
        filled[r["container"]] = filled.get(r["container"], 0) + r["tokens"]
    assert sum(filled.values()) == sum(n for _, n in rows) and max(filled.values()) <= 64 and len({(r["k"], r["piece"]) for r in got}) == len(got)


def test_pack(spark):
    rows = [(i, random.Random(i).choice([0, 1, 5, 5, 5, 30, 64, 65, 200])) for i in range(300)] + [(1000, None), (1001, 3)]
    got = pack.pack(spark, spark.createDataFrame(rows, "k long, n int"), "k", "n", 64).collect()
    total, filled = {}, {}
    for r in got:
        total[r["k"]] = total.get(r["k"], 0) + r["tokens"]
        filled[r["container"]] = filled.get(r["container"], 0) + r["tokens"]
    assert total == {k: n or 0 for k, n in rows} and max(filled.values()) <= 64
    assert len(filled) <= -(-sum(total.values()) // 64) * 1.15 + 1
    assert pack.pack(spark, spark.createDataFrame([], "k long, n int"), "k", "n", 64).count() == 0


# problem 10


def brute_share(text):
    dense, units = repetition.text_units(text)
    k = 20 if dense else 8
    seen, covered = set(), set()
    for i in range(len(units) - k + 1):
        g = tuple(units[i : i + k])
        covered |= set(range(i, i + k)) if g in seen else set()
        seen.add(g)
    return len(covered) / max(1, len(units))


def test_shares_against_brute_force():
    rng = random.Random(5)
    texts = [None, "", "12 34 !!", "um dois " * 40, "评审委员会决定推迟维护日志。" * 9, "कार्यालय बजट का विवरण समय पर भेजती है। " * 6]
    texts += [" ".join(rng.choice("abcdef") for _ in range(200)) for _ in range(5)] + [("A b c d e f g h i j. " + "x y z " * 3) * 3]
    parsed = repetition.Parsed(texts)
    want = [brute_share(t) for t in texts]
    assert np.allclose(parsed.shares(np.ones(len(texts), dtype=bool)), want)
    some = np.arange(len(texts)) % 2 == 0
    assert np.allclose(parsed.shares(some), np.where(some, want, 0))


def test_the_score_needs_no_share_and_keeps_its_order(spark):
    """The statistics hold no exact share; more repetition never lowers the score of the fitted model."""
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    d = repetition.fit(docs, "doc_id", "text")
    assert "share" not in repetition.FEATURES and len(d.trees.feature) > 0 and 0 < d.candidate <= 0.01
    x = repetition.document_statistics([r["text"] for r in docs.limit(300).collect()])
    for j, sign in enumerate(repetition.MONOTONE):
        if sign:
            low, high = x.copy(), x.copy()
            high[:, j] = np.minimum(1, high[:, j] + 0.3)
            assert (d.trees.score(high) >= d.trees.score(low) - 1e-12).all()
    all_ = repetition.repetition_shares(docs, "doc_id", "text").filter(F.col("share") >= 0.35).select("doc_id").distinct()
    assert {r["doc_id"] for r in all_.collect()} == {r["doc_id"] for r in repetition.repeating(docs, "doc_id", "text", d).collect()}


def test_trees_keep_the_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (rng.random(800) < 0.1)).astype(float)
    m = gbt.train(x, y, [1, -1, 0], trees=15)
    grid = np.stack([np.linspace(0, 1, 60), np.full(60, 0.4), np.full(60, 0.4)], axis=1)
    assert (np.diff(m.score(grid)) >= -1e-12).all()
    grid = np.stack([np.full(60, 0.4), np.linspace(0, 1, 60), np.full(60, 0.4)], axis=1)
    assert (np.diff(m.score(grid)) <= 1e-12).all()
    test = rng.random((500, 3))
    assert ((m.score(test) > 0.5) == (test[:, 0] > 0.5)).mean() > 0.93
    assert len(gbt.train(x, np.zeros(800), [0, 0, 0]).feature) == 0


def test_repetition_found_loses_none(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"] for r in docs if brute_share(r["text"]) >= 0.35}
    assert {r["doc_id"] for r in repetition.p10_found(spark, DATA).collect()} == want


# problem 7


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    v = np.array([centres[i % 6] + 0.4 * rng.normal(size=8) for i in range(300)], dtype=np.float32)
    rows = [(i, "m", v[i].tolist(), "x") for i in range(300)] + [(300 + i, "m", v[0].tolist(), "x") for i in range(9)]
    rows += [(1, "m", v[1].tolist(), "x"), (900, "m", None, "x"), (901, "m", [], "x"), (902, "m", [0.0] * 8, "x"), (903, "m", [float("nan")] * 8, "x"), (904, "m", [1.0], "x"), (905, None, v[3].tolist(), "x")]
    df = spark.createDataFrame(rows, "k long, m string, v array<float>, rep string")
    got = {}
    for r in neighbours.nearest(spark, df, "k", "m", "v", {"m": 8}).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    all_v = np.concatenate([v, np.repeat(v[:1], 9, axis=0)])
    u = all_v / np.linalg.norm(all_v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hit = sum(len(set(got[i]) & set(np.lexsort((np.arange(309), -s[i]))[:5])) for i in range(309)) / (5 * 309)
    assert set(got) == set(range(309)) and all(len(x) == 5 for x in got.values()) and hit >= 0.9
    assert got[305] == [0, 300, 301, 302, 303] and got[0] == [300, 301, 302, 303, 304]
    assert neighbours.nearest(spark, df.limit(0), "k", "m", "v", {"m": 8}).count() == 0


@pytest.mark.parametrize("levels", [1, 2])
def test_recall_where_few_lists_are_probed(spark, levels):
    """Queries with ids divisible by 20 against brute force, a sixth of the lists probed at most."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    v = np.concatenate([centres[rng.integers(0, 60, 5000)] + 0.7 * rng.normal(size=(5000, 16)), rng.normal(size=(1000, 16))]).astype(np.float32)
    df = spark.createDataFrame([(i, "m", x.tolist()) for i, x in enumerate(v)], "k long, m string, v array<float>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = neighbours.usable(df, "k", "m", "v", {"m": 16})
    ix = neighbours.fit(u, 60) if levels == 1 else neighbours.two_levels(rows, u, neighbours.fit(u, 8), len(u), 8)
    assert len(ix.coarse) >= 6 * ix.probes and (levels == 1) == (ix.upper is None)
    got = {}
    for r in neighbours.nearest(spark, df, "k", "m", "v", {"m": 16}, indexes={"m": ix}).filter("id % 20 = 0").collect():
        got.setdefault(r["id"], set()).add(r["other"])
    s = u[::20] @ u.T
    s[np.arange(len(s)), np.arange(len(s)) * 20] = -2
    want = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got[20 * i] & set(w)) / 5 for i, w in enumerate(want)]) >= 0.9


def test_exact_mode_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(80, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, "m", x.tolist()) for i, x in enumerate(v)], "k long, m string, v array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {(r["id"], r["rank"]): r["other"] for r in neighbours.nearest(spark, df, "k", "m", "v", {"m": 6}, exact=True).collect()}
    assert got == {(i, j + 1): int(o) for i in range(80) for j, o in enumerate(np.argsort(-s[i])[:5])}


# problem 4


def test_conversations(spark, tmp_path):
    t = dt.datetime(2031, 1, 1, 23, 50)
    at = lambda m: t + dt.timedelta(minutes=m)
    late = t + dt.timedelta(days=20)
    rows = [
        ("b", "ok", " User", "oi", at(0), at(0)), ("c", "ok", "ASSISTANT\t", "olá", at(5), late), ("a", "ok", "system", "regra", at(-1), at(0)), ("d", "ok", "user", "e?", at(30), at(31)), ("e", "ok", "assistant", "sim", at(31), at(31)),
        ("c", "ok", "ASSISTANT\t", "olá", at(5), at(6)), ("f", "noreply", "user", "oi", at(0), at(0)), ("g", "blank", "user", "oi", at(0), at(0)), ("h", "blank", "assistant", " ​", at(1), at(1)),
        ("i", "unknown", "user", "oi", at(0), at(0)), ("j", "unknown", "assistant", "oi", at(1), at(0)), ("k", None, "user", "oi", at(0), at(0)), ("l", "notime", "user", "x", None, at(0)), ("m", "notime", "assistant", "x", at(0), at(0)),
        ("n", "mid", "user", "x", at(0), at(0)), ("o", "mid", "system", "x", at(1), at(0)), ("p", "mid", "assistant", "x", at(2), at(0)), ("q", "tie", "user", "x", at(0), at(0)), ("r", "tie", "assistant", "x", at(0), at(0)), ("s", "role", "tool", "x", at(0), at(0)),
    ]
    path = str(tmp_path / "m")
    spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in rows], conversations._MESSAGE).repartition(3).write.parquet(path)
    known = spark.createDataFrame([(x, 1) for x in ("ok", "ok", "noreply", "blank", "notime", "mid", "tie", "role", None)], "id string, role int")
    stream = spark.readStream.schema(conversations._MESSAGE).parquet(path)
    got = sorted(tuple(r) for r in conversations.rebuild(spark, stream, known).collect())
    want = [("ok", 1, "a"), ("ok", 2, "b"), ("ok", 3, "c"), ("ok", 4, "d"), ("ok", 5, "e"), ("tie", 1, "q"), ("tie", 2, "r")]
    assert got == want
    # the same rows replayed in the order of arrival, in several micro-batches
    batches = conversations.replay(spark, spark.read.parquet(path))
    assert sorted(tuple(r) for r in conversations.rebuild(spark, batches, known).collect()) == want
    empty = conversations.replay(spark, spark.read.parquet(path).limit(0))
    assert conversations.rebuild(spark, empty, known).count() == 0


def test_late_rows_across_batches_and_behind_the_watermark(spark, tmp_path):
    """A row of an earlier day in a later batch joins its segment; one behind the watermark is counted, not lost unseen."""
    t = dt.datetime(2031, 1, 1)
    at = lambda d: t + dt.timedelta(days=d)
    rows = [("a", "x", "user", "oi", at(0), at(0)), ("b", "x", "assistant", "olá", at(0.1), at(20)), ("c", "y", "user", "e?", at(60), at(60)), ("d", "y", "assistant", "sim", at(60.1), at(100)), ("e", "z", "user", "e?", at(200), at(200))]
    df = spark.createDataFrame(rows, conversations._MESSAGE)
    known = spark.createDataFrame([("x",), ("y",), ("z",)], "id string")
    want = [("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c"), ("y", 2, "d")]
    stream = conversations.replay(spark, df)
    assert sorted(tuple(r) for r in conversations.rebuild(spark, stream, known).collect()) == want
    folder = tmp_path / "late"
    for i, name in enumerate(["e", "c", "a", "b"]):  # the newest first
        df.filter(F.col("id") == name).coalesce(1).write.mode("append").parquet(str(folder))
        part = max(folder.glob("part-*"), key=lambda p: p.stat().st_mtime)
        for p in folder.glob("part-*"):
            if p == part:
                os.utime(p, (1_000_000_000 + 60 * i,) * 2)
                os.rename(p, folder / f"done-{i}.parquet")
    late = spark.readStream.schema(conversations._MESSAGE).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(str(folder))
    with pytest.raises(conversations.LateRows) as e:
        conversations.rebuild(spark, late, known).count()
    assert e.value.number >= 2


# problems 1 and 6


@pytest.fixture(scope="session")
def model(spark):
    return sentences.train([r["text"] for r in table(spark, "/root/testdata/sf0.01", "chunks").select("text").distinct().collect() if r["text"]])


@pytest.mark.parametrize("text, want", [
    ("1.2. O Sr. C. T. Pelluga mora na Av. Albuzi, n.º 94, e assina. A secretaria executiva informa.", ["1.2. O Sr. C. T. Pelluga mora na Av. Albuzi, n.º 94, e assina.", "A secretaria executiva informa."]),
    ("O parecer conclui: “A unidade gestora deve publicar.” A fundação de apoio volta.", ["O parecer conclui: “A unidade gestora deve publicar.”", "A fundação de apoio volta."]),
    ("“A câmara temática vai publicar!”, informou a comissão. A proposta foi aceita.", ["“A câmara temática vai publicar!”, informou a comissão.", "A proposta foi aceita."]),
    ("a) um item;\n• outro. \n\n", ["a) um item;", "• outro."]), ("参与团队必须说明农业示范计划（见第3.67条。）并存档。申诉小组同意。", ["参与团队必须说明农业示范计划（见第3.67条。）并存档。", "申诉小组同意。"]),
    ("สำนักงานทุนวิจัย ฝ่ายติดตามผลข้อ 140 ของ", ["สำนักงานทุนวิจัย", "ฝ่ายติดตามผลข้อ 140 ของ"]), ("", []), ("  \n ", []), (None, []),
    ("O valor é de R$ 1.000,50 até 3.5.2. A secretaria executiva paga.", ["O valor é de R$ 1.000,50 até 3.5.2.", "A secretaria executiva paga."]),
])
def test_sentences(model, text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, model)] == want


def test_texts_without_marks_divide_as_their_lines_do():
    """A hidden event in an unpunctuated text: lines teach, and a line of two sentences is divided; punctuated text stays."""
    rng = random.Random(3)
    line = lambda: f"{rng.choice(['this', 'there', 'every'])} {rng.choice(['plan', 'budget', 'call'])} {rng.choice(['needs', 'has', 'wants'])} {rng.choice(['one', 'some', 'no'])} {rng.choice(['report', 'answer', 'delay'])}"
    texts = ["\n".join(line() for _ in range(30)) for _ in range(20)]
    m = sentences.train([*texts, "Uma frase. Outra frase."])
    text = "this budget has some delay there plan needs one report every call wants no answer"
    assert [text[a:b] for a, b in sentences.sentences(text, m)] == ["this budget has some delay", "there plan needs one report", "every call wants no answer"]
    assert len(sentences.sentences("this budget has some delay there plan needs one report.", m)) == 1


@pytest.mark.parametrize("text, n", [("ພາສາລາວ ປະໂຫຍກທີສອງ", 2), ("នេះជាប្រយោគ។ នេះជាប្រយោគ។", 2), ("ဒါက ဝါကျ။ ဒုတိယ", 3)])
def test_other_scripts_without_spaces(model, text, n):
    assert len(sentences.sentences(text, model)) == n


def test_gaps_without_a_mark_in_texts_with_marks():
    """Lines of several sentences that end without a mark teach how often one is missing within lines; texts whose lines all end with one stay whole."""
    rng = random.Random(5)
    line = lambda: f"{rng.choice(['This', 'There', 'Every'])} {rng.choice(['plan', 'budget', 'call'])} {rng.choice(['needs', 'has', 'wants'])} {rng.choice(['one', 'some', 'no'])} {rng.choice(['report', 'answer', 'delay'])}"
    careless = [f"{line()}. {line()}" + rng.choice(["", "."]) for _ in range(300)]
    text = "Every call wants no answer. This budget has some delay There plan needs one report."
    cut = lambda m: [text[a:b] for a, b in sentences.sentences(text, m)]
    assert cut(sentences.train(careless)) == ["Every call wants no answer.", "This budget has some delay", "There plan needs one report."]
    assert len(cut(sentences.train([t.rstrip(".") + "." for t in careless]))) == 2


def test_scripts_without_spaces_divide_between_letters_as_their_lines_do():
    """Neither blanks nor marks: each gap between two letters is scored."""
    rng = random.Random(7)
    line = lambda: rng.choice(["ປະເທດ", "ໂຄງການ", "ສະຖາບັນ"]) + rng.choice(["ຂຽນ", "ສົ່ງ", "ອ່ານ"]) + rng.choice(["ລາຍງານ", "ຈົດໝາຍ", "ບົດສະຫຼຸບ"])
    m = sentences.train(["\n".join(line() for _ in range(30)) for _ in range(20)] + ["Uma frase. Outra frase."])
    text = "ປະເທດຂຽນຈົດໝາຍໂຄງການສົ່ງລາຍງານສະຖາບັນອ່ານບົດສະຫຼຸບ"
    assert [text[a:b] for a, b in sentences.sentences(text, m)] == ["ປະເທດຂຽນຈົດໝາຍ", "ໂຄງການສົ່ງລາຍງານ", "ສະຖາບັນອ່ານບົດສະຫຼຸບ"]


def test_a_blank_between_lao_letters_is_scored():
    """Where lines have blanks within sentences, counts decide, not the blank."""
    rng = random.Random(8)
    line = lambda: rng.choice(["ປະເທດ", "ໂຄງການ", "ສະຖາບັນ"]) + " " + rng.choice(["ຂຽນ", "ສົ່ງ", "ອ່ານ"]) + " " + rng.choice(["ໜັງສື", "ຈົດໝາຍ", "ບົດສະຫຼຸບ"])
    m = sentences.train(["\n".join(line() for _ in range(30)) for _ in range(20)] + ["Uma frase. Outra frase."])
    text = "ປະເທດ ຂຽນ ຈົດໝາຍ ໂຄງການ ສົ່ງ ໜັງສື"
    assert [text[a:b] for a, b in sentences.sentences(text, m)] == ["ປະເທດ ຂຽນ ຈົດໝາຍ", "ໂຄງການ ສົ່ງ ໜັງສື"]


def test_the_word_before_tells_what_follows():
    """Same words and kind of gap: a pair that often stands without a boundary has lower odds than one that was not seen."""
    rng = random.Random(9)
    names = ["plan", "call", "fund"]
    texts = [f"The {rng.choice(names)} of {rng.choice(names)} in new york grows. The {rng.choice(names)} of york in new {rng.choice(names)} ends." for _ in range(200)]
    m = sentences.train(texts)
    # "york" follows "new" and "of", "new" never follows "of"
    assert m.odds("in new", "york", "~") - m.odds("of york", "york", "~") < 0


def test_bigrams_of_executors_equal_those_of_one_process(spark, model):
    got = sentences.fit(spark, table(spark, "/root/testdata/sf0.01", "chunks").select("text").distinct(), "text")
    assert model.pairs.any() and np.allclose(got.pairs, model.pairs, atol=1e-3) and np.allclose(got.after, model.after, equal_nan=True, atol=1e-3)


def test_all_texts_at_once_equal_one_by_one(model, spark):
    texts = [r["text"] for r in table(spark, DATA, "chunks").select("text").collect()] + [None, "", " \n "]
    assert sentences.sentences_of(texts, model) == [sentences.sentences(t, model) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.integers(0, 2), st.floats(-4, 4), st.booleans()), min_size=1, max_size=7), st.floats(-5, 0))
def test_posteriors_equal_the_sum_over_all_divisions(steps, short):
    gaps, at = [], 0
    for length, blank, o, marked in steps:
        gaps.append((at + length, at + length + blank, o, marked))
        at += length + blank
    total, with_cut = 0.0, np.zeros(len(gaps))
    for cuts in itertools.product((0, 1), repeat=len(gaps)):
        on = [i for i, c in enumerate(cuts) if c]
        x = sum(gaps[i][2] for i in on) + sum(short for i, j in zip(on, on[1:]) if gaps[i][3] == gaps[j][3] and gaps[j][0] - gaps[i][1] < sentences.SHORT)
        total += np.exp(x)
        with_cut += np.exp(x) * np.array(cuts)
    assert np.allclose(sentences.posteriors(gaps, short), with_cut / total)


def test_fit_on_executors_equals_training_in_one_process(spark, model):
    df = table(spark, "/root/testdata/sf0.01", "chunks").select("text").distinct()
    got = sentences.fit(spark, df, "text")
    assert got.kinds.keys() == model.kinds.keys() and all(abs(got.kinds[k] - model.kinds[k]) < 1e-6 for k in got.kinds)
    assert np.allclose(got.before, model.before, equal_nan=True, atol=1e-4) and got.short == model.short


def test_sentences_cover_every_visible_character(model, spark):
    for r in table(spark, DATA, "chunks").select("text").distinct().collect():
        spans = sentences.sentences(r["text"], model)
        assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
        rest = list(r["text"] or "")
        for a, b in spans:
            rest[a:b] = " " * (b - a)
        assert not "".join(rest).strip()


def test_sentences_without_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "Um. Dois.")], "rowid long, text string")
    assert sentences.split_sentences(spark, df, "rowid", "text", sentences.train([])).count() == 2
    assert sentences.split_sentences(spark, df.limit(0), "rowid", "text", sentences.train([])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=0, max_size=900), st.integers(20, 80), st.integers(0, 15))
def test_pieces_keep_the_limit_and_cover(text, limit, overlap):
    spans = sentences.sentences(text, sentences.Model())
    pieces = oversized.cut_text(text, spans, limit, overlap)
    assert all(0 < b - a <= limit for a, b in pieces)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert 0 <= b - c <= overlap and a < c and b < d


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=100, max_size=900), st.integers(20, 80), st.integers(0, 10))
def test_pieces_in_turn_keep_the_limit_and_boundaries(text, limit, overlap):
    places, strong = oversized.boundaries(text, sentences.sentences(text, sentences.Model()))
    pieces = oversized.cut_in_turn(len(text), places, strong, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b in pieces)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert 0 <= b - c <= overlap and a < c and b < d
        assert b in places or not any(max(b - limit, a + overlap) < p <= a + limit for p in places if p > a + overlap)


def test_oversized_kinds(spark):
    rows = [(1, "Frase curta de teste. " * 100), (2, "x" * 4000), (3, "curto"), (4, None), (2, "x" * 4000)]
    df = spark.createDataFrame(rows, "rowid long, text string")
    got = {(r["rowid"], r["kind"]) for r in oversized.split_oversized(spark, df, "rowid", "text", sentences.train(["Frase curta. Frase longa.\nFrase curta."])).collect()}
    assert got == {(1, "natural"), (2, "forced")}


# problem 5


def test_skeletons_join_what_is_confused():
    for a, b in [("obrig@ções", "obrigações"), ("fransferência", "transferência"), ("competerite", "competente"), ("decidiii", "decidiu"), ("5egunda", "segunda"), ("perrnissão", "permissão"), ("laborat6rio", "laboratório"), ("conveniacla", "conveniada")]:
        assert set(scans.skeletons(a)) & set(scans.skeletons(b)), (a, b)
    assert not set(scans.skeletons("edital")) & set(scans.skeletons("aviso"))


def test_repairs(spark):
    good = "o plano de inovação tecnológica e o termo de segurança alimentar pré-operacional da comissão"
    rows = [(f"d{i}", k, i * 10 + k, 1, good, 0) for i in range(20) for k in range(3)]
    scan = [
        "1 Chamada Nova 50/2031", "o plano de ino-\nvação tecno1ógica e o termo de se-\r\ngurança da comissão (H2O)\nPág. 1/3", "2 Chamada Nova 50/2031", "o termo pré-\noperacional da comis-\nPág. 2/3",
        "3 Chamada Nova 50/2031", "são de inovação\nPág. 3/3",
    ]
    rows += [("s", k, 1000 + k, k // 2 + 1, t, 0) for k, t in enumerate(scan)] + [("s", 1, 1001, 1, scan[1], 0), ("s", None, 1, 1, "x", 0), ("s", 99, 1999, None, None, 0)]
    df = spark.createDataFrame(rows, "document_id string, block_index int, block_id long, page_start int, text string, word int")
    got = {(r["block_id"], r["defect"], r["word"]) for r in scans.repairs(spark, df).collect()}
    assert {x for x in got if x[1] == "running"} == {(1000, "running", scan[0]), (1002, "running", scan[2]), (1004, "running", scan[4]), (1001, "running", "Pág. 1/3"), (1003, "running", "Pág. 2/3"), (1005, "running", "Pág. 3/3")}
    assert {x for x in got if x[1] == "split"} == {(1001, "split", "inovação"), (1001, "split", "segurança"), (1003, "split", "pré-operacional"), (1003, "split", "comissão")}
    assert {x for x in got if x[1] == "misread"} == {(1001, "misread", "tecnológica")}
    assert scans.repairs(spark, df.limit(0)).count() == 0
    text = [(r["first_block"], r["last_block"], r["text"]) for r in scans.paragraphs(spark, df).filter("document_id = 's'").orderBy("paragraph").collect()]
    assert text == [(1001, 1001, "o plano de inovação tecnológica e o termo de segurança da comissão (H2O)"), (1003, 1005, "o termo pré-operacional da comissão de inovação")] or text == [
        (1001, 1005, "o plano de inovação tecnológica e o termo de segurança da comissão (H2O) o termo pré-operacional da comissão de inovação")]
    assert scans.paragraphs(spark, df.limit(0)).count() == 0


def test_paragraphs_across_segments(spark):
    """A paragraph and a divided word go on behind the border of a segment, with running lines between."""
    rows = [("s", k, k, k // 8 + 1, f"Parágrafo {k} termina aqui.", 0) for k in range(63)]
    rows += [("s", 63, 63, 8, "Outro parágrafo que não acabou e se divi-", 0), ("s", 64, 64, 9, "de aqui, e segue.", 0), ("s", 65, 65, 9, "Um novo.", 0), ("s", 66, 66, None, " \n ", 0)]
    df = spark.createDataFrame(rows, "document_id string, block_index int, block_id long, page_start int, text string, paragraph int")
    got = [(r["paragraph"], r["first_block"], r["last_block"], r["text"]) for r in scans.paragraphs(spark, df).orderBy("paragraph").collect()]
    assert got[:63] == [(k + 1, k, k, f"Parágrafo {k} termina aqui.") for k in range(63)]
    assert got[63:] == [(64, 63, 64, "Outro parágrafo que não acabou e se divide aqui, e segue."), (65, 65, 65, "Um novo.")]


def test_chain_against_all_paths():
    """Viterbi and forward-backward against the sum over all state sequences."""
    rng = np.random.default_rng(4)
    chain = scans.initial_chain()
    seqs = [rng.integers(0, scans.SYMBOLS, n) for n in (1, 4, 6)]
    start, step, emit, total = np.zeros(3), np.zeros((3, 3)), np.zeros((3, scans.SYMBOLS)), 0.0
    for s, states in zip(seqs, scans.viterbi(seqs, chain)):
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = np.array([chain.start[x[0]] * np.prod([chain.emit[a, b] for a, b in zip(x, s)]) * np.prod([chain.step[a, b] for a, b in zip(x, x[1:])]) for x in paths])
        assert tuple(states) == paths[int(p.argmax())]
        total += np.log(p.sum())
        for x, w in zip(paths, p / p.sum()):
            start[x[0]] += w
            for a, b in zip(x, x[1:]):
                step[a, b] += w
            for a, b in zip(x, s):
                emit[a, b] += w
    got = scans.expected_counts(seqs, chain)
    assert all(np.allclose(a, b) for a, b in zip(got, (start, step, emit, total)))
