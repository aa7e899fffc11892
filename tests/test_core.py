import pytest

from docquarry.functions import text
from docquarry.operators import catalog, search
from docquarry.plans import registry


def test_duplicate_texts_ignore_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "doc_id bigint, text string")
    assert [(r.first_id, r.copies) for r in catalog.duplicate_texts(df).collect()] == [(1, 2)]


def test_bm25_prefers_the_passage_with_the_term(spark):
    docs = spark.createDataFrame([(1, "reset value"), (2, "clock"), (3, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([("q", "the clock")], "id string, question string")
    got = search.bm25(asked, docs, q_id="id", q_text="question", id_col="doc_id", text_col="text").collect()
    assert [(r.pid, r.rank) for r in got] == [(2, 1)]


def test_names_are_the_reference_ones(spark):
    df = spark.createDataFrame([("Set USART_SR, RCC_AHB1ENR and usbk7_modr; GPIOD_MODER_2 too, not 1_A, é_B or A_Bé. USART2_SR",)], "t string")
    found = df.select(text.names(df.t)).first()[0]
    assert found == ["usart_sr", "rcc_ahb1enr", "usbk7_modr", "gpiod_moder_2", "usart2_sr"]
    variants = df.select(text.name_variants(text.names(df.t))).first()[0]
    assert set(variants) == {*found, "gpiox_moder_2", "gpio_moder_2", "usartx_sr"}


def test_register_names_all_equals_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, "usbk7_modr USART_SR"), (2, "X_1_2 usart_sr A_Bé"), (3, None)]
    spark.createDataFrame(rows, "chunk_id bigint, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    want = duckdb.sql(registry.oracle_sql()["register_names_all"].replace("FROM chunks", f"FROM '{tmp_path}/chunks.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in registry.queries()["register_names_all"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) == [("usart_sr", 2), ("usbk7_modr", 1), ("x_1_2", 1)]


def test_hybrid_passages_boost_every_candidate_with_the_name(spark):
    # 15 chunks hold the name in their section, more than the ten that identifier_rank keeps
    rows = [(i, "", "USARTx_SR status" if i >= 5 else "other", f"what holds bits part{i}") for i in range(20)] + [(20, "", "", None)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, chapter string, section string, text string")
    asked = spark.createDataFrame([("q", "What holds USART2_SR?")], "id string, question string")
    got = search.hybrid_passages(asked, chunks, k=20).collect()
    boosted = {r.pid for r in got if r.rank <= 15}
    assert boosted == set(range(5, 20))


def test_snapshots_give_all_five_actions(spark):
    kind = "source string, sha256 string, chunker_sig string, complete boolean"
    old = spark.createDataFrame([("gone", "a", "1", True), ("text", "a", "1", True), ("settings", "a", "1", True), ("part", "a", "1", False), ("same", "a", "1", True)], kind)
    new = spark.createDataFrame([("new", "a", "1", True), ("text", "b", "1", True), ("settings", "a", "2", True), ("part", "a", "1", True), ("same", "a", "1", True)], kind)
    got = dict(map(tuple, catalog.snapshot_actions(old, new).collect()))
    assert got == {"gone": "remove", "new": "add", "text": "update", "settings": "update", "part": "resume", "same": "skip"}


def test_missing_chunks_of_a_part(spark):
    docs = spark.createDataFrame([(1, "s", 3), (2, "s", 1), (3, None, 0)], "doc_id bigint, source string, n_chunks int")
    chunks = spark.createDataFrame([(1, 0), (1, 2), (2, 0)], "document_id bigint, chunk_index int")
    assert [tuple(r) for r in catalog.missing_chunks(docs, chunks).collect()] == [(1, "s", 1)]
