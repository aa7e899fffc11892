import functools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import furniture, leaks, lookalike, nearpairs, neighbours, pairs, split, tokenize
from docquarry.llm.queries import VOCABULARY as NAME

VOCABULARY = f"/opt/tokenizers/{NAME}"


@pytest.mark.parametrize(
    "question,answer,kind",
    [
        ("What is X1?", None, "empty"),
        ("What is X1?", " n/a", "empty"),
        ("Where is the signal?", "I don’t have that information in the provided documents.", "refusal"),
        ("What limits the clock?", "The manual does not state a maximum for ABC1, but the typical value is 12 MHz [1].", None),
        ("What limits the clock?", "WHAT LIMITS THE CLOCK", "copy"),
        ("What limits the clock of it?", "Der Takt ist auf 37 kHz begrenzt und wird nicht geteilt.", "language"),
        ("What limits the clock?", "It is 12 MHz. The rest depends on the", "truncated"),
        ("What limits the clock?", "It is 12 MHz.\n```c\nx |= 1;", "truncated"),
        ("What limits the clock?", "12 MHz", None),
        (None, "It is 12 MHz.", None),
    ],
)
def test_defect(question, answer, kind):
    assert pairs.defect(question, answer) == kind


def test_pieces_fit_and_join():
    text = "One sentence here. " * 200 + "x" * 3000 + "\nend"
    pieces, forced = split.split_text(text, 1200, 200)
    assert forced and all(e - o <= 1200 for o, _, e in pieces)
    assert "".join(text[s:e] for _, s, e in pieces) == text


def test_near_pairs_find_copies_and_edits(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (3, base.replace("w30", "other")), (4, None), (5, ""), (6, "a b"), (7, " ".join(f"z{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    assert {tuple(r) for r in nearpairs.near_pairs(df).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert nearpairs.near_pairs(df.limit(0)).collect() == []


def test_similar_vectors_skip_unusable(spark):
    v = np.random.default_rng(1).normal(size=(60, 8))
    rows = [(i, [float(x) for x in v[i]], 8) for i in range(60)] + [(100, [float(x) for x in v[0] * 3], 8), (101, None, 8), (102, [0.0] * 8, 8), (103, [float("nan")] * 8, 8), (104, [1.0], 8)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, dim int")
    got = {tuple(r) for r in neighbours.similar_vectors(df).collect()}
    assert (0, 100) in got and not any(x in (101, 102, 103, 104) for p in got for x in p)


def test_repeated_lines(spark):
    docs = spark.createDataFrame([(i, "s") for i in range(6)] + [(9, None)], "doc_id bigint, source string")
    chunks = spark.createDataFrame([(i, i, f"text {chr(97 + i)}\n Page  {i} \r\n") for i in range(6)] + [(9, 9, "Page 1"), (10, 0, None)], "chunk_id bigint, document_id bigint, text string")
    assert {tuple(r) for r in furniture.repeated_lines(chunks, docs).collect()} == {(i, 2) for i in range(6)}


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_ids_round_trip(spark):
    ranks = tokenize.load_ranks(VOCABULARY)
    back = {v: k for k, v in ranks.items()}
    texts = [None, "", "Hello  world\n", "naïve 電源 🙂 <|endoftext|>", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: b"".join(back[i] for i in r.ids).decode() for r in tokenize.encode_corpus(df, VOCABULARY).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}


def test_leaks(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a " + item[20:90].upper()), (2, "w1 w2 w3"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None)], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.find_leaks(docs, items).collect()] == [(1, 7)]


def test_same_looking(spark):
    a = "The reset value of the register café is kept until power down."
    b = a.replace("é", "é").replace(" reset", " re​set").replace("value", "vаlue")
    df = spark.createDataFrame([(1, a), (2, b), (3, a.replace("é", "e")), (4, None), (5, ""), (6, a)], "doc_id bigint, text string")
    assert {tuple(r) for r in lookalike.same_looking(df).collect()} == {(1, 2), (2, 6)}


def test_near_pairs_miss_no_pair_that_agrees_enough(spark):
    # of 6,000 pairs with about half their runs in common, those that agree in the fewest coordinates
    r, mult, rows = np.random.default_rng(3), nearpairs.multipliers(42), []
    for g in range(6000):
        shared = [f"g{g}x{i}" for i in range(42)]
        two = [" ".join(shared + [f"o{x}" for x in r.integers(0, 10**9, 19)]) for _ in range(2)]
        u, v = (nearpairs.runs(t, 3) for t in two)
        if 11 <= (nearpairs.signature(u, mult) == nearpairs.signature(v, mult)).sum() <= 13 and 2 * len(np.intersect1d(u, v)) >= len(np.union1d(u, v)):
            rows += [(2 * g + side, t) for side, t in enumerate(two)]
    assert len(rows) >= 20
    df = spark.createDataFrame(rows, "chunk_id bigint, text string")
    want = {(i, i + 1) for i, _ in rows[::2]}
    assert {tuple(x) for x in nearpairs.near_pairs(df).collect()} == want
    # lists cut into tiles lose none either
    assert {tuple(x) for x in nearpairs.near_pairs(df, list_rows=1, counters_log2=8).collect()} == want


def test_near_pairs_only_exact_copies_stay_a_star(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "other")
    # 70 texts of one set of runs, none equal, and 5 copies where 3 may come out in all pairs
    rows = [(i, base + "!" * i) for i in range(70)] + [(100, near)]
    got = {tuple(r) for r in nearpairs.near_pairs(spark.createDataFrame(rows, "chunk_id bigint, text string")).collect()}
    assert got == {(a, b) for a, _ in rows for b, _ in rows if a < b}
    rows = [(i, base) for i in range(5)] + [(5, base.upper()), (6, base + "."), (7, near)]
    got = [tuple(r) for r in nearpairs.near_pairs(spark.createDataFrame(rows, "chunk_id bigint, text string"), expand=3).collect()]
    assert sorted(got) == [(0, i) for i in range(1, 8)] + [(5, 6), (5, 7), (6, 7)]


def test_forms_count_ascii_texts_too(spark):
    english = "The area of each table has a name, a state and an order of access."
    rows = [(i, english) for i in range(60)] + [(100 + i, "Когда сторона доходит до края, она поворачивает обратно") for i in range(10)]
    got = {r.doc_id: r.form for r in lookalike.one_form(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] == english


@functools.cache
def rewriter(cyrillic):
    counts = {chr(c): 10**6 for c in range(0x400, 0x460)} if cyrillic else {}
    rules = lookalike.representatives(lookalike.build_classes(), lookalike.ascii_first(counts))
    return lookalike.Rewriter(rules, lookalike.hidden_code_points())


def test_look_alikes_never_join_ascii():
    classes, groups = lookalike.build_classes(), {}
    for s in classes.up:
        groups.setdefault(classes.root(s), []).append(s)
    for members in groups.values():
        assert sum(len(m) == 1 and m.isascii() and m.isprintable() for m in members) <= 1, members


@pytest.mark.parametrize("a,b,same", [
    ("á", "а́", True), ("Iota Ⅳ", "Iota IV", True), ("ρUΥ", "pUY", True), ("ﬁn", "fin", True), ("a\r\nb", "a\nb", True), ("a  b", "a b", True),
    ("x​y", "xy", True), ("０", "O", False), ("e", "é", False), ("A", "a", False), ("l", "I", False), ("ı", "i", False),
])
@pytest.mark.parametrize("cyrillic", [False, True])
def test_forms_do_not_hang_on_the_representative(a, b, same, cyrillic):
    rewrite = rewriter(cyrillic)
    assert (rewrite(a) == rewrite(b)) == same


def test_many_copies_stand_as_one_text(spark):
    a = "The reset value of the register is kept until power goes down."
    rows = [(i, a) for i in range(5)] + [(9, a.replace("a", "а")), (10, a.replace(" ", " ", 1))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in lookalike.same_looking(df, expand=4).collect()} == {(0, 9), (0, 10), (9, 10)}
    assert {tuple(r) for r in lookalike.text_classes(df).collect()} == {(i, 0, 0) for i in range(5)} | {(9, 0, 9), (10, 0, 10)}


def test_a_stretch_that_fits_is_never_cut():
    text = "One short one. Two short ones. Three of them here. " + "x" * 549 + " " + "y" * 550 + ". " + "More of it follows. " * 40
    pieces, forced = split.split_text(text, 1200, 200)
    assert not forced and "".join(text[s:e] for _, s, e in pieces) == text
    assert all(e - o <= 1200 for o, _, e in pieces)
    assert all(text[e - 1] == " " and text[e - 2] == "." for _, _, e in pieces[:-1])
    exact = "A. " + "z" * 1200 + "\nB."
    pieces, forced = split.split_text(exact, 1200, 200)
    assert not forced and "z" * 1200 in [exact[s:e] for _, s, e in pieces]
    assert all(exact[o:s] == exact[p[0] : p[2]][p[2] - p[0] - (s - o) :] for p, (o, s, _) in zip(pieces, pieces[1:]))


def test_leaks_in_long_items_cut_into_parts(spark):
    w = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(at, " ".join(w[at : at + 12])) for at in range(0, 289)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(w)), (8, "w1")], "item_id bigint, text string")
    got = [tuple(r) for r in leaks.find_leaks(docs, items, part_words=20, block_chars=200).collect()]
    assert sorted(got) == [(at, 7) for at in range(0, 289)]


@pytest.mark.parametrize("answer", [
    "Sorry, that is outside what I can see here.", "I have no idea about this.", "This is beyond the scope of the manual.", "Nothing on that in the sources.",
    "The files I was given never mention it.", "We could not find any details on that.", "Dazu steht in den Unterlagen nichts.", "Ich weiß es leider nicht.",
    "Je ne sais pas.", "No lo sé.", "Bu soruyu yanıtlayamıyorum.", "That is outside of what I can answer. Please ask the vendor.",
])
def test_refusals_in_any_wording(answer):
    assert pairs.defect("What limits the clock of the unit?", answer) == "refusal"


@pytest.mark.parametrize("answer", [
    'It has a 5" display and a lamp.', "PF0 is not in the provided pinout; on the large package it is pin 133.", "Use <b>this</b> bit and **that** one.", "No.", "It is never set.",
    "1. Set it\n2. Then wait", "See (a), [b] and «c».", "Do not set it while the clock is running.", "It is the 3. pin of the row",
])
def test_sound_answers(answer):
    assert pairs.defect("What limits the clock of the unit?", answer) is None


@pytest.mark.parametrize("answer,kind", [
    ("La velocità massima è limitata e non si può cambiare.", "language"), ("De klok is beperkt en kan niet worden gewijzigd.", "language"), ("クロックは制限されています。", "language"),
    ("The value is **0xAC", "truncated"), ("Set <b>it", "truncated"), ("1. Set it.\n2.", "truncated"), ("He said “wait", "truncated"),
    ("What limits the clock? What limits the clock of the unit?", "copy"), ("Of the limits what clock unit", None),
])
def test_other_defects(answer, kind):
    assert pairs.defect("What limits the clock of the unit?", answer) == kind


def test_tiles_are_the_longest_first():
    assert pairs.tiles("a b c d".split(), "b c a b c".split()) == [0, 0, 3, 3, 3]
    assert pairs.tiles("a b".split(), "a b a b".split()) == [2, 2, 0, 0]


def test_broken_pairs_over_a_table(spark):
    rows = [(1, "What is it?", None, True), (2, None, "It is 5.", False), (3, "What is it?", "what is it", None), (3, "What is it?", "what is it", None)]
    df = spark.createDataFrame(rows, "result_id long, question string, answer string, declined boolean")
    assert sorted(map(tuple, pairs.broken_pairs(df).collect())) == [(1, "empty"), (3, "copy"), (3, "copy")]
    assert pairs.broken_pairs(df.limit(0)).collect() == []


CLASHING = "id key text_key sig first copies rep n maybe post codes a b d r v nb code worst dim_ line src piece need term pid rank form_key class_id block p part".split()


def messy(spark, rows, kind):
    """The rows twice, with columns of names that the operators use themselves."""
    df = spark.createDataFrame([*rows, *rows], kind)
    for c in CLASHING:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


LONG = "A long line of words without an end, number 1; " * 4000
TEXTS = [(None, "no id"), (1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG + "x"), (6, "one two three four"), (7, "\ud7ff\u0000 odd \U0010ffff"), (8, "x" * 50000)]


def test_texts_of_every_kind(spark):
    chunks = messy(spark, [(i, i, t, "s", 1, None) for i, t in TEXTS], "chunk_id long, document_id long, text string, section string, page_start int, page_end int")
    docs = messy(spark, [(i, t, "src", None) for i, t in TEXTS], "doc_id long, text string, source string, lang string")
    pieces = split.split_passages(chunks).collect()
    assert {r.chunk_id for r in pieces} == {4, 5, 8} and all(len(r.text) <= 1200 for r in pieces)
    assert {tuple(r) for r in nearpairs.near_pairs(chunks).collect()} == {(4, 5)}
    assert {tuple(r) for r in nearpairs.exact_copies(chunks.where("chunk_id = 6")).collect()} == {(6, 6)}
    assert furniture.repeated_lines(chunks, docs).collect() == []
    assert {r.doc_id for r in lookalike.one_form(docs).collect()} == {1, 2, 3, 4, 5, 6, 7, 8} - {1}
    assert lookalike.same_looking(docs).collect() == []
    items = messy(spark, [(9, LONG), (None, LONG), (10, None), (11, "short")], "item_id long, text string")
    assert {tuple(r) for r in leaks.find_leaks(docs, items).collect()} >= {(4, 9), (5, 9)}
    asked = messy(spark, [(i, "What is it?", t) for i, t in TEXTS], "result_id long, question string, answer string")
    assert {r.result_id for r in pairs.broken_pairs(asked).collect() if r.defect == "empty"} == {1, 2, 3}
    if os.path.exists(VOCABULARY):
        assert {r.doc_id: len(r.ids) > 0 for r in tokenize.encode_corpus(docs, VOCABULARY).where("doc_id is not null").collect()} == {i: bool(t) for i, t in TEXTS if i}


def test_empty_tables(spark):
    chunks = spark.createDataFrame([], "chunk_id long, document_id long, text string, section string, page_start int, page_end int, embedding array<float>, dim int")
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    items = spark.createDataFrame([], "item_id long, text string")
    for found in (
        split.split_passages(chunks), nearpairs.near_pairs(chunks), nearpairs.exact_copies(chunks), furniture.repeated_lines(chunks, docs), neighbours.similar_vectors(chunks),
        lookalike.one_form(docs), lookalike.same_looking(docs), lookalike.text_classes(docs), leaks.find_leaks(docs, items),
    ):
        assert found.collect() == []


def test_vectors_of_every_kind(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same, 4) for i in range(40)] + [(100, same, None), (101, None, 4), (None, same, 4), (102, [], 0), (103, [float("inf"), 1.0, 1.0, 1.0], 4), (104, [1e30, 2e30, 3e30, 4e30], 4), (105, [-1.0, 0.0, 0.0, 0.0], 4)]
    df = messy(spark, rows, "chunk_id long, embedding array<float>, dim int")
    got = [tuple(r) for r in neighbours.similar_vectors(df).collect()]
    ids = {i for p in got for i in p}
    assert len(set(got)) == len(got) and all(a < b for a, b in got) and ids == {*range(40), 104}


def test_a_crowd_of_copies_keeps_its_links(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, base) for i in range(200)] + [(900, base.replace("w20", "x"))]
    got = [tuple(r) for r in nearpairs.near_pairs(spark.createDataFrame(rows, "chunk_id long, text string")).collect()]
    assert sorted(got) == [(0, i) for i in range(1, 200)] + [(0, 900)]


@pytest.mark.parametrize("lines,cut", [("same", True), ("short", True), ("two\nlines of furniture that stand together", True)])
def test_lines_with_and_without_pieces(spark, lines, cut):
    rng = np.random.default_rng(3)
    body = [" ".join("".join(chr(97 + x) for x in w) for w in rng.integers(0, 26, (20, 6))) for _ in range(40)]
    docs = spark.createDataFrame([(i, "s") for i in range(40)], "doc_id long, source string")
    chunks = spark.createDataFrame([(i, i, f"{body[i]}\n{lines if i < 8 else 'other ' + str(body[i])}\nend {body[-i]}") for i in range(40)], "chunk_id long, document_id long, text string")
    n = lines.count("\n") + 1
    assert {tuple(r) for r in furniture.repeated_lines(chunks, docs).collect()} == {(i, 2 + k) for i in range(8) for k in range(n)}


def test_pieces_do_not_depend_on_where_they_stand():
    line = "the quick brown fox jumps over the lazy dog while nobody looks at the river and its banks " * 3
    one, two = furniture.cut_texts([line]), furniture.cut_texts(["", "something before\n" + line + "\nand after", "x"])
    inside = lambda f: set(f["hash"][f["line"] >= 0].tolist())
    assert len(inside(two)) >= 3 and inside(two) <= set(one["hash"].tolist()) | inside(two) and len(set(one["hash"].tolist()) & inside(two)) >= len(inside(two)) - 1


def test_graph_search_finds_planted_neighbours(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 32))
    asked = v[:30] + 0.02 * rng.normal(size=(30, 32))
    kind = "chunk_id long, embedding array<float>, dim int"
    held = spark.createDataFrame([(i, [float(x) for x in row], 32) for i, row in enumerate(v)], kind)
    new = spark.createDataFrame([(5000 + i, [float(x) for x in row], 32) for i, row in enumerate(asked)] + [(6000, None, 32), (6001, [1.0], 1)], kind)
    got = {(r.qid, r.pid) for r in neighbours.graph_search(new, held, k=1, least=0.9).collect()}
    want = {(5000 + i, i) for i in range(30)}
    assert got <= want and len(got) >= 27
    assert neighbours.graph_search(new.limit(0), held).collect() == []
