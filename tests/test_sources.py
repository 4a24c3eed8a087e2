import os
import time

from pyspark.sql import functions as F

from docspark.operators import quality
from docspark.sources import engines, readers, sinks
from docspark.streaming import pages


def test_markdown_round_trip_keeps_the_old_files_on_failure(spark, tmp_path):
    out = str(tmp_path / "md")
    docs = spark.createDataFrame([("a", "# A\n\ntext"), ("b", "B")], "stem string, text string")
    sinks.write_markdown(docs, out)
    assert sorted(os.listdir(out))[-2:] == ["stem=a", "stem=b"]
    broken = docs.select("stem", F.raise_error(F.lit("no")).cast("string").alias("text"))
    try:
        sinks.write_markdown(broken, out)
    except Exception:  # noqa: BLE001
        pass
    files = {r.stem: r.value.rstrip("\n") for r in spark.read.option("wholetext", True).text(out, wholetext=True).collect()}
    assert files == {"a": "# A\n\ntext", "b": "B"}
    sinks.write_markdown(docs.limit(1), out)
    assert [x for x in os.listdir(out) if x.startswith("stem=")] == ["stem=a"]
    assert os.listdir(tmp_path) == ["md"]


def test_readers(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"%PDF")
    (tmp_path / "e\u0301.pdf").write_bytes(b"%PDF")
    (tmp_path / "n.md").write_text("one\ntwo\n")
    assert sorted(r.stem for r in readers.pdf_files(spark, str(tmp_path)).collect()) == ["x", "é"]
    assert [r.text for r in readers.markdown_files(spark, str(tmp_path)).collect()] == ["one\ntwo\n"]


def test_graphic_replies(spark):
    rows = spark.createDataFrame([('```json\n{"category": "stamp", "confidence": 0.91}\n```',), ('{"category": "cat"}',), ("no json",)], "r string").select(readers.graphic_category(F.col("r")).alias("g"))
    got = rows.select("g.*", readers.discard_graphic(F.col("g.category"), F.col("g.confidence")).alias("gone")).collect()
    assert [tuple(r) for r in got] == [("stamp", 0.91, True), ("uncertain", 0.0, False), ("uncertain", 0.0, False)]


def test_render_prunes_and_keeps_errors(spark):
    files = spark.createDataFrame([("a", b"123"), ("b", b""), ("c", b"99")], "path string, content binary")

    def renderer(content, keep):
        if not content:
            raise ValueError("empty")
        for i, c in enumerate(content):
            if keep(i + 1):
                assert c != ord("9"), "a page that nobody wants was rendered"
                yield i + 1, bytes([c])

    pages = lambda *rows: spark.createDataFrame(list(rows), "path string, page_num int")
    got = lambda **options: {(r.path, r.page_num, r.error) for r in readers.render(files.where(options.pop("where", "true")), renderer, **options).collect()}
    assert got(where="path < 'c'") == {("a", 1, None), ("a", 2, None), ("a", 3, None), ("b", None, "empty")}
    assert got(wanted=pages(("a", 2), ("a", 9))) == {("a", 2, None)}
    assert got(done=pages(("a", 1), ("c", 1), ("c", 2))) == {("a", 2, None), ("a", 3, None), ("b", None, "empty")}
    assert got(wanted=pages(("a", 1), ("a", 2)), done=pages(("a", 1))) == {("a", 2, None)}
    assert {(r.path, r.pages, r.error) for r in readers.page_counts(files, lambda c: len(c) or 1 // 0).collect()} == {("a", 3, None), ("b", None, "integer division or modulo by zero"), ("c", 2, None)}


def test_lexicon_round_trip(spark, tmp_path):
    from docspark.operators import spelling

    lexicon = spelling.build_lexicon(spark.createDataFrame([("hòa bình",), ("hòa",), ("bình",), ("hoa",)], "entry string"))
    sinks.write_lexicon(lexicon, f"{tmp_path}/lexicon")
    again = spelling.load_lexicon(spark, f"{tmp_path}/lexicon")
    for a, b in zip(lexicon, again, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_engine_retries():
    calls = []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "text"

    assert engines.attempt(read, pause=0) == ("text", None)
    assert engines.attempt(lambda: (_ for _ in ()).throw(engines.ContextOverflow("big")), pause=0) == (None, "big")


def test_second_attempt_wins(spark):
    class Better(engines.FakeEngine):
        def read(self, image, instruction):
            return "fine text" if instruction or image == b"good" else "\n".join(["This is a line of prose that is long enough."] * 5)

    pages_ = spark.createDataFrame([(1, b"good"), (2, b"bad")], "p int, content binary")
    got = engines.read_twice(pages_, Better, ["p"], lambda f: f.cache())
    assert {r.p: (r.text, r.attempt) for r in got.collect()} == {1: ("fine text", 1), 2: ("fine text", 2)}


def test_stream_of_pages(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in (0, 1):
        spark.createDataFrame([(k, "text"), (k + 10, "")], "doc_id int, text string").write.mode("append").parquet(source)
        stream = quality.core_report(pages.arriving(spark, source, "doc_id int, text string"), ["doc_id"])
        pages.write(stream, out, state).awaitTermination()
        time.sleep(0.1)
    assert {(r.doc_id, r.errors) for r in spark.read.parquet(out).collect()} == {(0, ""), (1, ""), (10, "empty_page"), (11, "empty_page")}
