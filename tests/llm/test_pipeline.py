import base64
import random
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docspark.llm import common, mixing, quality
from docspark.llm.queries import ORACLES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("tables")), random.Random(1)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en", f"s{i % 3}", 0) for i in range(80)]
    rows += [(i, prose(rng, 20), "en", "s0", 0) for i in range(80, 90)]
    rows += [(90 + i, rows[i][1], "fr", "s1", 0) for i in range(10)]
    for i in range(100, 110):
        words = rows[i - 80][1].split()
        words[len(words) // 2] = "edited"
        rows.append((i, " ".join(words) + " " + prose(rng, 2), "en", "s2", 0))
    rows += [(110, None, None, None, None), (111, "", "en", "s0", 0), (None, prose(rng, 70), "en", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_one_by_one(spark, folder):
    docs = common.documents(spark, folder)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = common.materialise(stage(spark, docs, folder))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    whole = {i for i in (*range(80), *range(90, 110), None)}
    assert set(kept["quality_rules"]) == whole and len(kept["quality_rules"]) == len(whole)
    assert set(kept["exact_dedup"]) == whole - set(range(10))
    assert set(kept["near_dedup"]) <= set(kept["exact_dedup"]) - set(range(100, 110)) | {i for i in range(100, 110)}
    assert len(kept["near_dedup"]) == len(kept["exact_dedup"]) - 10
    assert set(kept["mixing"]) <= set(kept["near_dedup"]) and max(Counter(kept["mixing"]).values()) <= mixing.REPEATS
    assert kept["byte_bpe"] and Counter(kept["byte_bpe"]) == Counter(kept["mixing"])
    assert docs.where(~F.col("round_trip")).count() == 0


def test_run_is_the_stages_in_turn(spark, folder):
    one, two = (sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens").collect())) for _ in range(2))
    assert one == two and one


def brute_rows(rows):
    """Counter of (doc_id, n_tokens) of the whole pipeline by plain loops, and by SQL for the mix; no cutoff is certified by 50 labels."""
    grams = lambda t: Counter(zip(*(t.split()[k:] for k in range(5)), strict=False))
    again = lambda w: len({j + k for j in range(len(w) - 2) if Counter(zip(w, w[1:], w[2:], strict=False))[tuple(w[j : j + 3])] > 1 for k in range(3)})
    rows = [r for r in rows if (w := (r[1] or "").split()) and len(w) >= 50 and 100 * again(w) <= 50 * len(w)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    rows = [max(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    name = {r[0]: r[0] for r in known}
    for a in known:
        for b in known:
            x, y = grams(a[1]), grams(b[1])
            same = (x & y).total()
            if a[0] < b[0] and same >= 0.8 * (x.total() + y.total() - same):
                old, new = max(name[a[0]], name[b[0]]), min(name[a[0]], name[b[0]])
                name = {k: new if v == old else v for k, v in name.items()}
    rows = [r for r in rows if r[0] is None or name[r[0]] == r[0]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}))
    times = {int(i): int(taken // size) for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({ORACLES['op7_mixing']}) WHERE doc_id IS NOT NULL AND size > 0").fetchall()}
    with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Counter({(r[0], len(coder.encode_ordinary(r[1]))): times[r[0]] for r in rows if r[0] is not None and times.get(r[0])})


def test_run_against_brute_force(spark, folder):
    rows = [tuple(r) for r in common.documents(spark, folder).collect()]
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect() if r.doc_id is not None)
    assert got == brute_rows(rows) and got.total() > 80


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.ALPHA < 0.05
