import pytest

from docspark.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_the_rows_of_its_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_error_rates_of_whole_texts(spark, tmp_path):
    texts = ["The cat and  the dog " * 12 + "sit.", "the Straße, ÉTÉ and\tthen\nand the end", "a", "and the"]
    spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cer = {r.item_id: r.cer for r in QUERIES["q22_cer"](spark, str(tmp_path)).collect()}
    wer = {r.item_id: r.wer for r in QUERIES["q23_wer"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        a, b = (" ".join(x.casefold().split()) for x in (t, t.replace("the", "thé").replace("and", "an d").replace(" ", "  ").upper()))
        assert cer[i] == pytest.approx(_distance(a, b) / len(a))
        assert wer[i] == pytest.approx(_distance(a.split(), b.split()) / len(a.split()))


def test_glued_words_after_the_200th_character(spark, tmp_path):
    glued = "cuavalatrong" * 4
    rows = [(0, "word " * 60 + glued + " end", "en"), (9, "word " * 60, "en"), (3, "word " * 60, "en"), (4, "word " * 60, "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda q: {r.doc_id: r.glued for r in QUERIES[q](spark, str(tmp_path)).collect()}
    assert found("q06_glued_words") == {0: True, 9: False, 3: False, 4: True}


def test_word_error_rate_of_many_distinct_words(spark):
    from pyspark.sql import functions as F

    from docspark.functions import scoring

    words = [f"w{i}" for i in range(7000)]
    other = [*words[:100], "new", *words[101:5000], *words[5001:]]
    row = spark.createDataFrame([(" ".join(words), " ".join(other))], "e string, a string").select(scoring.word_error_rate(F.col("e"), F.col("a")).alias("wer"), scoring.scores(F.col("e"), F.col("a"))["wer"].alias("same")).first()
    assert row.wer == row.same == pytest.approx(2 / 7000)


def test_marked_lines_are_found_without_a_shuffle_by_document(spark, tmp_path):
    text = "\n".join(f"line-{i}." for i in range(1, 15))
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["q27_suspicious_lines"](spark, str(tmp_path))
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.line_idx, r.reasons) for r in found.collect()) == [(1, 6, "truncated_line"), (1, 10, "truncated_line"), (1, 12, "glued_characters"), (1, 13, "truncated_line")]


def test_best_attempts_without_their_texts(spark):
    from docspark.operators import quality

    rows = spark.createDataFrame([(1, 1, "a $ b", ["unbalanced_math_delimiters"]), (1, 2, "a b", []), (2, 1, "x", [])], "d int, attempt int, text string, errors array<string>")
    best = quality.choose_best(rows, ["d"], "attempt", columns=["attempt", "errors"])
    assert sorted(map(tuple, best.collect())) == [(1, 2, []), (2, 1, [])]
