import json
import math
import random

import pytest
from pyspark.sql import functions as F

from docquarry.functions import lines, text
from docquarry.operators import answers, catalog, chunking, evaluate, layout, passages, search
from docquarry.sources import files
from docquarry.streaming.intake import intake


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


@pytest.mark.parametrize("answer,most,want", [("a [2][1] b [2]", 4, [2, 1]), ("[0] [5] [12] [123]", 4, []), ("no", 4, []), ("[10]", 10, [10])])
def test_cited_ranks(spark, answer, most, want):
    assert one(spark, text.cited_ranks(F.col("a"), most), a=answer) == want


def test_declines_and_contents(spark):
    assert one(spark, text.is_fallback(F.col("a")), a="Sorry, I DON'T have that information.")
    assert not one(spark, text.is_fallback(F.col("a")), a="It is 5.")
    assert one(spark, text.contains_all(F.col("a"), F.array(F.array(F.lit("P A1"), F.lit("x")), F.array(F.lit("0x1")))), a="pa1 \n 0X1")
    assert not one(spark, text.contains_all(F.col("a"), F.array(F.array(F.lit("zz")))), a="pa1")


def test_match_terms(spark):
    found = one(spark, text.match_terms(F.col("q")), q="What is the clock of GPIOD_MODER, clock 5 x?")
    assert [(" ".join(t.words), t.prefix) for t in found] == [("gpiod moder", False), ("clock", True), ("gpiod", True), ("moder", True), ("5", False)]
    assert len(one(spark, text.match_terms(F.col("q")), q=" ".join(f"word{i}" for i in range(40)))) == 24
    assert one(spark, text.match_terms(F.col("q")), q="of the ?") == []


@pytest.mark.parametrize("line,want", [("Power supply .......... 12", "contents"), ("List of Tables", "front"), ("31 30 29 28 27 26 25 24", "bits"), ("r rw w r res. reset x", "bits"), ("3 V power is used", None), ("a b", None), ("", None)])
def test_noise(spark, line, want):
    assert one(spark, lines.noise(F.col("l")), l=line) == want


@pytest.mark.parametrize("line,want", [("6.12 USB supported", (2, "6.12 USB supported")), ("A.1 Electrical data", (1, "A.1 Electrical data")), ("Appendix B Names", (1, "Appendix B Names")), ("3 V power", None), ("2 Ends with it.", None)])
def test_numbered_headings(spark, line, want):
    found = one(spark, lines.numbered_heading(F.col("l")), l=line)
    assert (tuple(found) if found else None) == want


def test_md_heading_and_signature(spark):
    assert tuple(one(spark, lines.md_heading(F.col("l")), l="## Two words ##")) == (2, "Two words")
    assert one(spark, lines.md_heading(F.col("l")), l="#no") is None
    assert one(spark, lines.signature(F.col("l")), l="  UM1472 Rev 7   12/45 ") == "um# rev # #/#"
    assert one(spark, lines.dehyphenated(F.col("l")), l="a trans-\nfer and X-\nY") == "a transfer and X-\nY"


def test_shown_places(spark):
    kind = "chunk_id long, chapter string, section string, text string, page_start int, page_end int"
    df = spark.createDataFrame([(1, "A", "B", "t", 3, 4), (2, "A", "A", "A t", 3, 3), (3, "A", None, "t", None, 4), (4, None, "B", None, 5, None), (5, "", "", "t", 5, 0)], kind)
    got = df.select(passages.heading_path(F.col("chapter"), F.col("section")), passages.embedding_text(F.col("chapter"), F.col("section"), F.col("text")), passages.citation(F.lit("s"), F.col("page_start"), F.col("page_end"))).collect()
    assert [tuple(r) for r in got] == [("A > B", "A > B\nt", "s, pp. 3-4"), ("A", "A t", "s, p. 3"), ("A", "A\nt", "s"), ("B", "B\n", "s, p. 5"), ("", "t", "s, p. 5")]
    assert {r.chunk_id for r in passages.on_page(df, 4).collect()} == {1, 3}
    assert passages.on_page(df.limit(0), 4).collect() == []


def test_running_lines(spark):
    rows = [(1, i, f"Manual Rev {i}\nbody {chr(97 + i)}\nx\ny\nz\nw {chr(97 + i)}\n{i}/9") for i in range(5)] + [(2, 9, "Manual Rev 1\nPage 3")]
    df = spark.createDataFrame(rows, "document_id long, chunk_id long, text string")
    assert {tuple(r) for r in passages.running_lines(df).collect()} == {(i, n) for i in range(5) for n in (1, 3, 5, 7)} | {(9, 2)}


def plain_chunks(doc):
    """Whole documents folded without segments, written apart from the operator."""
    out, held, chapter, section, code = [], [], "", "", False

    def flush(keep):
        nonlocal held
        if held:
            t = held[0]
            for x in held[1:]:
                t = t[:-1] + x if t.endswith("-") and x[:1].islower() else t + "\n" + x
            if sum(c.isalnum() for c in t) >= 40:
                out.append((len(out), chapter, section, t.strip()))
        tail = []
        for x in reversed(held if keep else []):
            if sum(len(y) + 1 for y in tail) + len(x) > 200:
                break
            tail.insert(0, x)
        held = tail

    for raw in doc.split("\n"):
        line = " ".join(raw.split())
        code ^= line.startswith("```")
        n = sum(len(x) + 1 for x in held)
        if not line:
            if n >= 900:
                flush(False)
        elif line.startswith("#") and not code:
            level = len(line) - len(line.lstrip("#"))
            title = line.lstrip("# ")
            if n >= 300 or level == 1 and held:
                flush(False)
            chapter, section = title if level == 1 else chapter, title
            held.append(title)
        else:
            if n + len(line) > 1200 and (n >= 300 or n + len(line) > 1800):
                flush(True)
            held.append(line)
    flush(False)
    return out


def test_chunks_equal_a_fold_of_the_whole_document(spark):
    r, docs = random.Random(4), []
    for i in range(60):
        rows = [r.choice(["", "# Chap " + r.choice("abc"), "## Sec", "### Sub", "```", "word " * r.randint(1, 120) + r.choice(["", "end-"])]) for _ in range(r.randint(0, 40))]
        docs.append((i, "\n".join(rows)))
    df = spark.createDataFrame([*docs, (99, None)], "doc_id long, text string")
    got = {}
    for row in chunking.chunk_documents(df).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(row.doc_id, []).append((row.chunk_index, row.chapter, row.section, row.text))
    assert got == {i: want for i, t in docs if (want := plain_chunks(t))}


def test_long_lines_are_cut_at_sentences():
    import re

    stops = re.compile(r"(?<=[.!?;:])\s+")
    assert chunking.long_line("Aa bb. Cc dd. " + "e" * 25, 10, stops) == ["Aa bb.", "Cc dd.", "e" * 10, "e" * 10, "e" * 5]


def chunk_rows(spark, rows):
    return spark.createDataFrame([(i, ch, se, t) for i, ch, se, t in rows], "chunk_id long, chapter string, section string, text string")


def test_keyword_search_weighs_fields_phrases_and_beginnings(spark):
    filler = [(100 + i, "", "", f"other things {i}") for i in range(20)]
    chunks = chunk_rows(spark, [(1, "", "", "the clocks run"), (2, "", "clock tree", "none"), (3, "clock", "", "none"), (4, "", "", "usart sr is here"), (5, "", "", "sr usart"), (6, None, None, None), *filler])
    asked = spark.createDataFrame([("a", "clock"), ("b", "USART_SR"), ("c", "of the"), ("d", None)], "id string, question string")
    got = {}
    for r in search.keyword_topk(asked, chunks).collect():
        got.setdefault(r.qid, []).append((r.rank, r.pid))
    assert [p for _, p in sorted(got["a"])] == [2, 1, 3]
    assert sorted(got["b"])[0] == (1, 4)
    assert set(got) == {"a", "b"}
    assert search.keyword_topk(asked, chunks, k=0).collect() == []


def test_ranked_passages_boost_and_drop_equal_texts(spark):
    chunks = chunk_rows(spark, [(1, "", "USARTx_SR", "status bits one"), (2, "", "USARTx_SR", "status bits one "), (3, "", "x", "status bits of usart"), (4, "", "x", "nothing")])
    asked = spark.createDataFrame([("q", "Which status bits has USART2_SR?")], "id string, question string")
    got = search.ranked_passages(asked, chunks, k=3).collect()
    assert len({r.pid for r in got} & {1, 2}) == 1 and [r.rank for r in got] == [1, 2, 3]
    assert [r.pid for r in got if r.boosted] == [r.pid for r in got if r.pid in (1, 2)]
    alone = search.ranked_passages(asked, chunks, hybrid=False).collect()
    assert all(r.keyword_rank is None for r in alone) and len(alone) == 3


def test_cosine_topk_breaks_ties_by_id_and_skips_what_cannot_be_compared(spark):
    rows = [(i, [1.0, 0.0]) for i in range(9, 0, -1)] + [(20, [0.0, 0.0]), (21, None), (22, [math.nan, 1.0]), (23, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.cosine_topk(v.where("vec_id = 5"), v, k=3).collect()
    assert [(r.pid, r.rank, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert search.cosine_topk(v.where("vec_id = 5"), v, k=0).collect() == []


def test_fuse_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, pid long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "qid string, pid long, rank int")
    assert [(r.pid, r.score) for r in search.fuse(a, b).orderBy("rank").collect()] == [(2, round(1 / 61 + 1 / 62, 9)), (1, round(1 / 61, 9)), (3, round(1 / 62, 9))]


def test_answers_end_to_end(spark):
    shown = spark.createDataFrame([("a", 1, "s, p. 1", "[1] s, p. 1 - S", "C > S", "It is PA1. Two here. Three."), ("a", 2, "s", "[2] s", "", "More.")], "qid string, rank int, citation string, label string, path string, text string")
    asked = spark.createDataFrame([("a", "Which pin?", True, [["PA1"]]), ("b", "What?", False, []), ("c", None, True, [["x"]])], "id string, question string, answerable boolean, must_include array<array<string>>")
    context = answers.contexts(shown)
    assert context.first().context == "[1] s, p. 1 - C > S\nIt is PA1. Two here. Three.\n\n[2] s\nMore."
    sent = answers.messages(asked, context).collect()
    assert [r.qid for r in sent] == ["a"] and sent[0].messages[1].content.endswith("---\nQuestion: Which pin?\nAnswer (with [n] citations):")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.1), ("c", 0.9)], "qid string, best_score double")
    final = answers.finalize(answers.extractive_answers(asked, shown), shown, answers.gate(scores, least=0.25))
    got = {r.qid: r for r in answers.verdicts(asked, final, context).collect()}
    assert got["a"].answer == "It is PA1. Two here. [1]" and got["a"].sources == "[1] s, p. 1 - S" and got["a"].correct and got["a"].retrieval_hit
    assert got["b"].answer == answers.FALLBACK and not got["b"].llm_called and got["b"].correct and got["b"].keywords_ok is None
    assert got["c"].declined and got["c"].correct is False and got["c"].retrieval_hit is False


def test_latency_is_nearest_rank(spark):
    r = random.Random(1)
    rows = [(run, round(r.expovariate(1), r.randint(1, 4)), True) for run in "abc" for _ in range(r.randint(1, 400))] + [("a", None, True), ("a", math.nan, True), ("d", 2.5, True), ("e", 1.0, False)]
    got = {x.run_id: (x.median_s, x.p95_s) for x in evaluate.latency_stats(spark.createDataFrame(rows, "run_id string, total_s double, llm_called boolean")).collect()}
    want = {}
    for run in "abcd":
        v = sorted(x for g, x, ok in rows if g == run and ok and x is not None and not math.isnan(x))
        want[run] = (round((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, 6), v[round(0.95 * (len(v) - 1))])
    assert got == want


def test_threshold_lies_in_the_middle_of_the_best(spark):
    rows = [("a", 0.8, True), ("a", 0.7, True), ("a", 0.2, False), ("a", 0.1, False), ("b", 0.5, True), ("c", 0.3, True), ("c", 0.4, False), ("a", None, True)]
    got = {r.run_id: (r.threshold, r.n_right, r.n) for r in evaluate.suggest_threshold(spark.createDataFrame(rows, "run_id string, best_score double, answerable boolean")).collect()}
    assert got == {"a": (0.45, 4, 4), "c": (0.41, 1, 2)}


def test_summary_has_its_own_denominators(spark):
    kind = "run_id string, answerable boolean, declined boolean, correct boolean, keywords_ok boolean, retrieval_hit boolean, cited boolean"
    rows = [("a", True, False, True, True, True, True), ("a", True, True, False, False, None, False), ("a", True, False, None, None, False, None), ("b", False, True, True, None, None, False)]
    got = {r.run_id: tuple(r)[1:] for r in evaluate.eval_summary(spark.createDataFrame(rows, kind)).collect()}
    assert got["a"] == (3, "1/3 (33%)", "1/3 (33%)", "1/2 (50%)", "1/3 (33%)", "n/a", "1/2 (50%)")
    assert got["b"] == (1, "1/1 (100%)", "n/a", "n/a", "n/a", "1/1 (100%)", "n/a")


def test_replacing_and_deleting(spark):
    stored = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "document_id long, chunk_index int, text string")
    new = spark.createDataFrame([(1, 0, "z")], "document_id long, chunk_index int, text string")
    assert sorted(map(tuple, passages.replace_documents(stored, new).collect())) == [(1, 0, "z"), (2, 0, "c")]
    docs = spark.createDataFrame([(1, "s"), (2, None)], "doc_id long, source string")
    kept, chunks = passages.delete_documents(docs, stored, docs.where("source is null"))
    assert [r.doc_id for r in kept.collect()] == [1] and {r.document_id for r in chunks.collect()} == {1}
    wanted = spark.createDataFrame([("l", [9, 2, 1])], "list_id string, ids array<long>")
    rows = spark.createDataFrame([(1,), (2,)], "chunk_id long")
    assert [(r.pos, r.chunk_id) for r in passages.fetch_in_order(rows, wanted).orderBy("pos").collect()] == [(1, 2), (2, 1)]


def test_rows_from_words(spark):
    boxes = spark.createDataFrame([(1, 0, 9.0, 0.0, 10.0, "b"), (1, 0, 1.0, 1.0, 11.5, "a"), (1, 0, 1.0, 12.0, 22.0, "c"), (1, 0, 1.0, 60.0, 70.0, "d")], "doc_id long, page int, x0 double, y0 double, y1 double, word string")
    rows = layout.with_gaps(layout.rows_from_words(boxes)).orderBy("row_no").collect()
    assert [(r.text, r.gap) for r in rows] == [("a b", False), ("c", False), ("d", True)]
    assert [r.text for r in layout.without_margins(layout.rows_from_words(boxes), height=140.0).orderBy("row_no").collect()] == ["c", "d"]


def test_files_and_stream(spark, tmp_path):
    docs = tmp_path / "docs"
    (docs / "in").mkdir(parents=True)
    (docs / "_no").mkdir()
    long = "# One\n" + "some words of text here. " * 40
    (docs / "in" / "a.MD").write_text(long)
    (docs / "b.txt").write_bytes(b"plain \xff text " * 20)
    (docs / "c.csv").write_text("x")
    (docs / "_no" / "d.txt").write_text("hidden")
    found = files.discover_documents(spark, str(docs))
    assert sorted((r.source, r.kind) for r in found.collect()) == [("a.MD", "markdown"), ("b.txt", "text")]
    assert "�" in {r.source: r.text for r in files.load_texts(found).collect()}["b.txt"]
    for _ in range(2):  # a second run finds nothing new
        intake(spark, str(docs), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert sorted((r.source, r.chunk_index) for r in got.collect()) == [("a.MD", 0), ("b.txt", 0)]
    files.append_chunks(got.drop("batch"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_questions_have_defaults(spark, tmp_path):
    at = tmp_path / "q.json"
    at.write_text(json.dumps([{"question": "A?", "must_include": ["x", ["y", "z"]]}, {"id": "k", "question": "B?", "answerable": False, "note": "n"}]))
    got = [tuple(r) for r in files.read_questions(spark, str(at)).collect()]
    assert got == [("q01", "A?", True, [["x"], ["y", "z"]], ""), ("k", "B?", False, [], "n")]


def test_report_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "q", "a | b\n c", "x" * 500, True), (2, "q", None, None, None)], "result_id long, id string, question string, answer string, correct boolean")
    files.write_report(evaluate.report_rows(df), str(tmp_path / "r"))
    got = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "r")).orderBy("result_id").collect()
    assert got[0].question == "a \\| b c" and len(got[0].answer) == 400 and [r.verdict for r in got] == ["right", "open"]


def test_prefixes_and_phrases(spark):
    chunks = spark.createDataFrame([(1, "Clocks of USART_SR and usart sr"), (2, "clocking sr usart"), (3, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([("Which clock has USART_SR?",), (None,)], "question string")
    assert sorted(map(tuple, search.prefix_terms(asked, chunks).collect())) == [("clock", "clocking", 1), ("clock", "clocks", 1), ("usart", "usart", 2)]
    assert [tuple(r) for r in search.phrase_matches(asked, chunks).collect()] == [("usart sr", 1, 2)]


def test_force_updates_what_is_the_same(spark):
    kind = "source string, sha256 string, chunker_sig string, complete boolean"
    old = spark.createDataFrame([("a", "1", catalog.chunker_signature(2, 1200, 300, 200), True)], kind)
    assert [tuple(r) for r in catalog.snapshot_actions(old, old).collect()] == [("a", "skip")]
    assert [tuple(r) for r in catalog.snapshot_actions(old, old, force=True).collect()] == [("a", "update")]


def test_catalogue_and_counts(spark):
    docs = spark.createDataFrame([(1, "s", True, 5, "ab cd"), (2, None, False, None, None)], "doc_id long, source string, complete boolean, n_chars long, text string")
    chunks = spark.createDataFrame([(1, 1, "a b!", 2, 3), (2, 1, None, None, None)], "chunk_id long, document_id long, text string, page_start int, page_end int")
    assert sorted(map(tuple, catalog.document_catalog(docs, chunks).collect())) == [(1, "s", True, 2), (2, None, False, 0)]
    assert sorted(map(tuple, passages.document_profile(docs, chunks).collect())) == [(1, 5, 2, 2, 2, 3), (2, 0, 0, 0, None, None)]
    got = {r.source: (r.n_docs, r.n_complete, r.n_chunks, r.n_chars) for r in catalog.catalog_stats(docs, chunks).collect()}
    assert got == {"s": (1, 1, 2, 5), None: (1, 0, 0, 0)}
    files = spark.createDataFrame([(1, "s", "h", 1, 1), (2, "s", "h", 2, 1), (3, "s", "g", 1, 1)], "file_id long, source string, sha256 string, ingested_at int, reported_at int")
    assert {r.file_id for r in catalog.latest_files(files).collect()} == {2, 3}


def test_hash_vectors_and_buckets(spark):
    df = spark.createDataFrame([(1, "Clock clock pin"), (2, None)], "doc_id long, text string")
    got = {(r.bucket, r.value) for r in search.hash_buckets(df, "doc_id", "text").collect()}
    v = search.hash_vectors(["Clock clock pin"], 256, {})[0]
    assert {(int(i), round(float(v[i] * math.sqrt(5)))) for i in v.nonzero()[0]} == got
    asked = spark.createDataFrame([("a", "pin clock"), ("b", "zzz")], "id string, question string")
    rows = spark.createDataFrame([(7, "Clock clock pin"), (8, "pin"), (9, "")], "pid long, full string")
    top = search.hash_topk(asked, rows, q_id="id", q_text="question", id_col="pid", text_col="full", k=2).collect()
    assert [(r.pid, r.rank) for r in sorted(top, key=lambda r: (r.qid, r.rank))] == [(7, 1), (8, 2), (7, 1), (8, 2)]


def test_judged_results_and_curve(spark):
    asked = spark.createDataFrame([("a", True, [["x"]]), ("b", False, None)], "id string, answerable boolean, must_include array<array<string>>")
    rows = [(1, "a", "it is X", True, True, 0.12), (2, "a", None, True, True, None), (3, "b", "it is", False, False, 0.02), (4, "z", "x", True, True, 0.5)]
    results = spark.createDataFrame(rows, "result_id long, id string, answer string, llm_called boolean, answerable boolean, best_score double")
    assert sorted(map(tuple, evaluate.judged(results, asked).collect())) == [(1, False, True, True), (2, False, False, False), (3, True, None, True)]
    assert sorted(map(tuple, evaluate.threshold_curve(results).collect())) == [(0, 0, 1), (2, 1, 0), (10, 1, 0)]


def test_printed_headings_and_front_matter(spark):
    docs = spark.createDataFrame([(1, "2 The clock\ntree of it\nbody\n3  END\nmore")], "doc_id long, text string")
    outline = spark.createDataFrame([(1, "2 the clock tree of it"), (1, "3 End"), (2, "body"), (1, None)], "doc_id long, title string")
    assert sorted(r.line_no for r in layout.printed_headings(chunking.document_lines(docs), outline).collect()) == [1, 2, 4]
    units = chunking.units(chunking.document_lines(spark.createDataFrame([(1, "before\n# Contents\na\n## sub\nb\n# 2 Start\nc\n# Index of pins\nd")], "doc_id long, text string")))
    assert [r.text for r in layout.without_front_matter(units).orderBy("line_no").collect()] == ["before", "2 Start", "c"]
