"""Chunkers, retrieval, store, contexts, sources and streams on small fixtures."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import chunking as K
from textloom.operators import cleaning as C
from textloom.operators import context as X
from textloom.operators import retrieval as R
from textloom.operators import store as S
from textloom.sources import files
from textloom.streaming import ingest as I

TEXTS = [None, "", " \n ", "one two. three!", "word " * 400, "x" * 1500, "# A\n\ntext\n\n```\n# no title\n```\n## B\n| a | b |\n|---|---|\n| 1 | 2 |\n# C\nend", "第一句。第二句！" * 200]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chunks_cover_and_fit(spark):
    d = docs(spark, TEXTS)
    for chunks, most in ((K.char_chunks(F.col("text")), 500), (K.sentence_chunks(F.col("text")), None), (K.chinese_chunks(F.col("text")), 562), (K.line_chunks(F.col("text")), None)):
        rows = K.numbered(d, chunks).collect()
        for r in rows:
            text = TEXTS[r.doc_id]
            assert "".join(r.chunk.split()) in "".join(text.split())
            assert most is None or len(r.chunk) <= most or len(text) <= 500
        assert {r.doc_id for r in rows} >= {3, 4, 5, 6, 7}
        for i in {r.doc_id for r in rows}:
            assert sorted(r.chunk_index for r in rows if r.doc_id == i) == list(range(sum(r.doc_id == i for r in rows)))


def test_chunkers_refuse_wide_overlaps():
    with pytest.raises(ValueError):
        K.token_windows(None, 5, 5)


def test_markdown(spark):
    e = [(r.kind, r.level, r.element) for r in K.markdown_elements(docs(spark, TEXTS)).where("doc_id = 6").orderBy("pos").collect()]
    assert e == [("title", 1, "A"), ("text", None, "text"), ("code", None, "```\n# no title\n```"), ("title", 2, "B"), ("table", None, "| a | b |\n|---|---|\n| 1 | 2 |"), ("title", 1, "C"), ("text", None, "end")]
    assert [r.header_path for r in K.heading_paths(docs(spark, TEXTS)).orderBy("pos").collect()] == ["/A/", "/A/B/", "/C/"]
    chunks = K.markdown_chunks(docs(spark, TEXTS)).where("doc_id = 6").orderBy("chunk_index").collect()
    assert [(c.header_path, c.has_code, c.has_table) for c in chunks] == [("/A/", True, False), ("/A/", True, False), ("/A/B/", False, True), ("/C/", False, False)]
    assert all(len(c.chunk) <= 3700 for c in K.markdown_chunks(docs(spark, TEXTS)).collect())
    assert K.heading_paths(docs(spark, ["# A\n### C\n## B"])).orderBy("pos").collect()[2].header_path == "/A/B/"


def test_repeated_lines(spark):
    text = "Head line\nbody one\nHead line 2\nHead line\n\n\n\nbody two\nHead line\n| a | b |"
    assert {(r.line, r.n) for r in C.repeated_lines(docs(spark, [text, None, ""])).collect()} == {("Head line", 3)}
    out = {r.doc_id: r.text for r in C.without_repeated_lines(docs(spark, [text, None, "", "  same  "])).collect()}
    assert out == {0: "body one\n\nbody two\n| a | b |", 1: None, 2: "", 3: "  same  "}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.floats(-1, 1, width=32), min_size=3, max_size=3), min_size=1, max_size=12))
def test_dense_topk_is_brute_force(spark, vectors):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "doc_id long, embedding array<double>")
    got = R.dense_topk(rows.withColumnRenamed("doc_id", "query_id"), rows, 3, "dot").collect()
    for q in range(len(vectors)):
        want = sorted(((-(round(sum(a * b for a, b in zip(vectors[q], v)), 6) + 0.0), i) for i, v in enumerate(vectors)))[:3]
        mine = [(-r.score, r.doc_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert [x[0] for x in mine] == pytest.approx([x[0] for x in want], abs=2e-6)


def test_bm25_edges(spark):
    q = spark.createDataFrame([(1, "alpha beta"), (2, ""), (3, None), (4, "nowhere")], "query_id long, query_text string")
    d = docs(spark, ["alpha", "alpha", "beta beta", None, ""])
    got = R.bm25(q, d, 10).collect()
    assert {r.query_id for r in got} == {1} and [r.doc_id for r in sorted(got, key=lambda r: r["rank"])][1:] == [0, 1]
    assert R.bm25(q, docs(spark, [None]).limit(0), 10).count() == 0


def test_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, 7, 2.0, 1), (1, 8, 1.0, 2)], "query_id long, doc_id long, score double, rank int")
    b = spark.createDataFrame([(1, 8, 5.0, 1)], "query_id long, doc_id long, score double, rank int")
    assert R.rrf([a, b], 5).collect() == R.rrf([b, a], 5).collect()
    assert {(r.doc_id, r.score) for r in R.weighted_fusion(a, b, 5).collect()} == {(7, 0.5), (8, 0.5)}


def test_store(spark):
    schema = "node_id string, ref_doc_id string, text string, loaded_at int, deleted_at int"
    old = spark.createDataFrame([("a", "d", "1", 1, None), ("b", "d", "1", 1, None), (None, "d", "x", 1, None)], schema)
    new = spark.createDataFrame([("a", "e", "2", 2, None), ("a", "e", "3", 3, None), ("c", None, "4", None, None)], schema)
    once = S.upsert(S.latest(old), new)
    assert {(r.node_id, r.text) for r in once.collect()} == {("a", "3"), ("b", "1"), ("c", "4")}
    assert {(r.node_id, r.text) for r in S.upsert(once, new).collect()} == {("a", "3"), ("b", "1"), ("c", "4")}
    assert {r.node_id for r in S.reingest(S.latest(old), spark.createDataFrame([("z", "d", "9", 9, None)], schema)).collect()} == {"z"}
    with pytest.raises(ValueError):
        S.delete(old)
    assert S.delete(old, clear=True).count() == 0


def test_context_stops_at_first_overflow(spark):
    r = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "b" * 50), (1, 3, "c")], "query_id long, rank int, text string")
    assert X.within_budget(r, 20, False).collect()[0].context == "aaaa"


def test_context_of_a_first_text_that_does_not_fit(spark):
    r = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "c"), (2, 1, "b")], "query_id long, rank int, text string")
    assert sorted(tuple(x) for x in X.within_budget(r, 20, False, keep_empty=True).collect()) == [(1, "", 0), (2, "b", 1)]
    assert [tuple(x) for x in X.within_budget(r, 20, False).collect()] == [(2, "b", 1)]


def test_conversation_windows_in_closed_form(spark):
    rows = spark.createDataFrame([("c", t) for t in range(1, 40)], "conv string, turn int")
    got = {r.turn: (r.summaries, r.kept) for r in X.windows(rows, "conv", 6, 2).collect()}
    window, done = 0, 0
    for t in range(1, 40):
        window += 1
        if window > 6:
            window, done = 2, done + 1
        assert got[t] == (done, window)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# hé", encoding="utf-8")
    (tmp_path / "in" / "sub" / "b.bin").write_bytes(b"\x00")
    (tmp_path / "in" / "sub" / "c.txt").write_text(" ")
    (tmp_path / "in" / "sub" / "d.txt").write_text("")
    got = {r.source_file.rsplit("/", 1)[1]: r.text for r in files.load_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": "# hé", "c.txt": " "}
    (tmp_path / "e.csv").write_text('query,expected_ids,reference_answer\nq1,"a, b,,",r\nq2,,\n')
    assert [(r.query, r.expected_ids) for r in files.eval_set_from_csv(spark, str(tmp_path / "e.csv")).collect()] == [("q1", ["a", "b"]), ("q2", [])]
    for name, data in (("w.json", {"items": [{"query": "q", "expected_ids": ["a"]}]}), ("l.json", [{"query": "q", "expected_ids": ["a"]}])):
        (tmp_path / name).write_text(json.dumps(data))
        assert files.eval_set_from_json(spark, str(tmp_path / name)).first().expected_ids == ["a"]
    files.write_chunks_jsonl(spark.createDataFrame([("1", "t", "s")], "id string, text string, source string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().metadata.source == "s"


def test_stream_ingest_equals_batch(spark, tmp_path):
    schema = "node_id string, ref_doc_id string, text string, loaded_at int"
    src, store = str(tmp_path / "src"), str(tmp_path / "store")
    first = spark.createDataFrame([("a", "d", "1", 1), ("b", "d", "1", 1), ("c", "e", "1", 1)], schema)
    second = spark.createDataFrame([("a", "d", "2", 2)], schema)
    for part in (first, second):
        part.write.mode("append").parquet(src)
        I.ingest(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "marks")).awaitTermination()
    got = {(r.node_id, r.text) for r in I.current(spark, store).collect()}
    assert got == {(r.node_id, r.text) for r in S.reingest(S.latest(first), second).collect()} == {("a", "2"), ("c", "1")}


def test_broken_parts_do_not_count(spark, tmp_path):
    """A part without its success mark is not read; a later document replaces its former nodes, a later node its former row; compacting changes nothing."""
    schema = "node_id string, ref_doc_id string, text string, loaded_at int"
    store, other = str(tmp_path / "store"), str(tmp_path / "other")
    for i, rows in enumerate(([("a", "d", "1", 1), ("b", None, "1", 1), ("x", "e", "1", 1)], [("a", "e", "2", 2)], [("z", "e", "3", 3), ("b", None, "2", 3), ("b", None, "3", 4)], [("n", "n", "n", 9)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{store}/part={i}")
    (tmp_path / "store" / "part=3" / "_SUCCESS").unlink()
    got = {(r.node_id, r.text) for r in I.current(spark, store).collect()}
    assert got == {("z", "3"), ("b", "3")}
    I.compact(spark, store, other)
    assert {(r.node_id, r.text) for r in I.current(spark, other).collect()} == got


def test_sessions_are_closed_by_the_watermark(spark, tmp_path):
    """Sessions long before the watermark leave the state and stay counted; later micro-batches go on counting."""
    for day in range(4):
        rows = spark.createDataFrame([(1, 1_000_000_000 + day * 200_000 + k * 5_000) for k in range(3)] + [(2, None)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    found = I.run_to_end(I.sessions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))), "sessions")
    assert {(r.user_id, r.sessions, r.events) for r in I.last_updates(found, "user_id").collect()} == {(1, 12, 12), (2, 0, 4)}


def test_sessions_do_not_depend_on_order(spark, tmp_path):
    """One user with more rows than an Arrow batch holds, in no order of time, in several files and micro-batches."""
    from textloom.plans import streams

    times = [k * 1_000 + (k // 1_000) * 5_000 for k in range(25_000)]
    late = [times[k * 7_919 % len(times)] for k in range(len(times))]
    for part in (late[:24_000], late[24_000:]):
        rows = spark.createDataFrame([(1, 1_000_000_000 + t) for t in part] + [(2, 1_000_000_000)], "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = streams.stream_sessions(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {(1, 25, 25_000), (2, 1, 2)}
    first = I.sessions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet")))
    updates = I.run_to_end(first, "sessions").where("user_id = 1").orderBy("part").collect()
    assert len(updates) == 2 and (updates[-1].sessions, updates[-1].events) == (25, 25_000)


def test_code(spark):
    from textloom.operators import code

    text = "a\n```python\nclass A:\n    def f(self):\n        return 1\n\ndef g(): pass\n```\n```\nnot python (\n```\n```sh\nls"
    blocks = code.code_blocks(docs(spark, [text, None, ""])).orderBy("pos").collect()
    assert [(b.language, b.lines) for b in blocks] == [("python", 5), (None, 1), ("sh", 1)]


def test_semantic_chunks_keep_all_sentences(spark):
    text = "one cat sat. one cat ran. one cat slept. A wholly other matter here! 另一句。"
    rows = K.semantic_chunks(docs(spark, [text, None, "", "single"])).orderBy("doc_id", "chunk_index").collect()
    assert " ".join(r.chunk for r in rows if r.doc_id == 0).split() == " ".join(["one cat sat.", "one cat ran.", "one cat slept.", "A wholly other matter here!", "另一句。"]).split()
    assert len([r for r in rows if r.doc_id == 0]) == 2 and [r.chunk for r in rows if r.doc_id == 3] == ["single"]


def test_loaders(spark, tmp_path):
    for name, body in (("a.txt", "one"), ("sub/b.md", "two"), ("sub/skip_c.md", "three"), ("d.pdf", "x"), ("tmp/e.txt", "four")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    root = str(tmp_path)
    assert {r.text for r in files.load_texts(spark, root).collect()} == {"one", "two", "three", "four"}
    assert {r.text for r in files.load_texts(spark, root, exclude=("skip_*", "tmp/*")).collect()} == {"one", "two"}
    assert files.load_file(spark, f"{root}/a.txt").first().text == "one"
    for name, error in (("none.txt", FileNotFoundError), ("d.pdf", ValueError)):
        with pytest.raises(error):
            files.load_file(spark, f"{root}/{name}")
    assert {r.text for r in files.load_files(spark, [f"{root}/a.txt", f"{root}/none.txt", f"{root}/d.pdf"]).collect()} == {"one"}
    assert files.load_files(spark, [f"{root}/none.txt"]).count() == 0


def test_table_titles(spark):
    table = "| a | b |\n|---|---|\n| 1 | 2 |"
    text = f"表 1-2 Options\n\n{table}\n\ntext\n**表 2** \n{table}\n# head\n{table}\n\n表 9 far" + "\n" * 12 + table
    rows = C.table_titles(docs(spark, [text, None, ""])).orderBy("table_no").collect()
    assert [(r.table_no, r.title) for r in rows] == [(1, "表 1-2 Options"), (2, "表 2"), (3, ""), (4, "")]
    assert rows[0].link == "[表 1-2 Options](tables/table_1_表_1-2_Options.md)"
