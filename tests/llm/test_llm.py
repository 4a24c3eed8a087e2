import base64
import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from docspark.llm import byte_bpe, common, exact_dedup, html_extract, mixing, near_dedup, quality, secrets, substring_dedup, tool_calls, toxicity
from docspark.llm import queries as q

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Documents with nulls, empty and long texts, repeated rows, exact and near copies, shared passages."""
    rng = random.Random(3)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, rng.choice([3, 20, 60, 150, 300])), rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", None]), 0) for i in range(60)]
    for i in range(60, 75):
        rows.append((i, f"{prose(rng, rng.randint(0, 40))} {passage} {prose(rng, rng.randint(0, 40))}", "en", "s0", 0))
    for i in range(75, 95):
        words = rows[5 + i % 4 * 7][1].split()
        if len(words) > 100:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "de", "s3", 0))
    rows += [(95, None, None, None, None), (96, "", "en", "s1", 0), (97, " \n\t", "en", "s1", 0), (98, "x y z \x0b w", "xx", "é", 0), (99, prose(rng, 9000), "en", "s1", 0), (100, "\U0001f600 token = \"abcdef12\" " * 3, "en", "s1", 0)]
    return [*rows, rows[3], rows[3], (None, "no id at all", "en", "s0", 0), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables of a query on the fixture; documents has extra columns with clashing names."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    clash = spark.createDataFrame(rows, SCHEMA)
    for name in ("ids", "size", "kept", "score", "n_words", "digest", "spans", "found", "taken"):
        clash = clash.withColumn(name, F.lit("clash"))
    clash.write.parquet(f"{path}/documents.parquet")
    rng = random.Random(5)
    spark.createDataFrame([(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(90)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", "<p>a b c d e f g h i j</p>"), (2, None, None), (3, "u", ""), (None, "u", "<article><p>x")], "page_id bigint, url string, html string").write.parquet(f"{path}/pages.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "user", None), (1, 2, "user", None), (2, 1, "assistant", "x"), (None, 0, "user", "y"), (3, None, "user", "z"), (4, 0, None, "w")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("pages", "page_id bigint, url string, html string"), ("conversations", "conv_id bigint, turn bigint, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables_give_an_empty_result(spark, empty, name):
    assert q.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_has_the_rows_of_its_sql(spark, sf_dir, same_rows, name):
    same_rows(q.QUERIES[name](spark, sf_dir), q.ORACLES[name], sf_dir)


# 1


def test_pages_of_other_layouts():
    page = "<body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='sidebar'><p>{o}</p></div><div id=c><h2>Head &amp; tail</h2><p>One two\n three&nbsp;four five.<p>Six <b>seven</b>, <a href=x>eight</a><br>nine ten.</p><aside>{o}</aside><ul><li>item one</li><li>item two</li></ul><p>{x}</p></div><div class='comments'><p>{o}</p></div><form>{o}</form><footer>{o}</footer></body>"
    got = html_extract.main_text(page.format(o="outside words", x="last part of the text"))
    assert got == "Head & tail\nOne two three four five.\nSix seven, eight nine ten.\nitem one\nitem two\nlast part of the text"


def test_raw_text_and_broken_markup():
    assert html_extract.main_text("<article><script>if (a<b) {'</p>'}</script><p>Body text, <i>open</article>") == "Body text, open"
    assert html_extract.main_text("<article><p>x<style>p{}</style>y<!-- <p>no</p> -->z</p></article>") == "xyz"
    assert html_extract.main_text("<article><p>a &lt;b&gt; &#233; &copy; 1 < 2</p></article>") == "a <b> é © 1 < 2"
    for bad in ("", None, "<", "<a href='", "<script>", "<p", "</p></p>", "&#xFFFFFFF;"):
        html_extract.main_text(bad)
    long = "<p>" + "w " * 200_000
    assert len(html_extract.main_text(long)) == 399_999


def test_best_run_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_run(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_weights_are_signed():
    w = html_extract.weights()
    assert w["word:para"] > 0 and w["in:para"] > 0 and all(v < 0 for k, v in w.items() if k.startswith("tag:"))


@pytest.mark.parametrize("tag", ['div id="page" class="has-sidebar"', 'div class="content-with-sidebar"', 'article class="post comments-open"', 'div class="no-ads"', 'div class="share-enabled"', 'div class="layout-sidebar-right"><div id="sidebar-page"',
                                 'div class="content no-sidebar"', 'div id="wrap" class="layout-with-sidebar"', 'form id="form1"', 'div class="legal-article"', 'div class="page legal"', 'section class="widget"', 'div role="dialog"'])
def test_a_class_of_the_wrapper_bars_no_main_text(tag):
    body = "".join(f"<p>{'main words of the page ' * 6}{i}.</p>" for i in range(5))
    got = html_extract.main_text(f'<html><body><{tag}>{body}<div class="sidebar-left"><p>{"beside " * 12}</p></div></div></article></body></html>')
    assert got.count("main words") == 30 and "beside" not in got


def test_long_comments_stay_barred():
    body = "".join(f"<p>{'main words of the page ' * 6}{i}.</p>" for i in range(3))
    comments = "".join(f"<article class=reply><h4>Somebody</h4><p>{'a reader says this here ' * 9}</p></article>" for _ in range(20))
    for wrap in ("<div><h1>Head</h1>{}</div>", "<article><h1>Head</h1>{}</article>", "<div>{}</div>"):
        got = html_extract.main_text(f"<html><body>{wrap.format(body)}<div class='comments'>{comments}</div></body></html>")
        assert got.count("main words") == 18 and "reader" not in got


@pytest.mark.parametrize("broken", ["<a ", "<a '", "</a", "<p class='", '<a "x>" ', "<a b'c>", "<!-", "<div>", "<li><ul>", "<p><table>", "<div class='sidebar'>w "])
def test_broken_markup_of_a_megabyte_takes_linear_time(broken):
    def seconds(n):
        start = time.process_time()
        html_extract.main_text(broken * (n // len(broken)))
        return time.process_time() - start

    seconds(1 << 16)
    assert seconds(1 << 20) < 64 * seconds(1 << 16) + 2


def test_runs_of_whole_pages_against_brute_force(monkeypatch):
    pages = [html for html, _ in html_extract.labelled_pages()]
    pages += [f"<body><ul><li><a>{'nav ' * k}</a></li></ul><div>{'text words ' * (3 * k)}</div><h2>x</h2><p>{'more ' * k}</p><div><a>end</a></div></body>" for k in range(12)]
    fast = [html_extract.main_text(p) for p in pages]

    def slow(scores):
        runs = ((sum(scores[i:j]), -i, i - j, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))
        best = max(runs, default=(0, 0, 0, 0))
        return (-best[1], best[3]) if best[0] > 0 else (0, 0)

    monkeypatch.setattr(html_extract, "best_run", lambda scores: slow([round(s, 9) for s in scores]))
    assert [html_extract.main_text(p) for p in pages] == fast


def test_precision_and_recall_on_layouts_that_the_weights_never_saw():
    rng, found, right, wanted = random.Random(8), 0, 0, 0
    for k in range(60):
        m = lambda n: " ".join(f"m{rng.randrange(10**6)}" for _ in range(n))  # noqa: E731, B023
        o = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))  # noqa: E731, B023
        quote, figure = f"<blockquote><p>{m(20)}</p></blockquote>", f"<figure><img src=x><figcaption>{m(6)}</figcaption></figure>"
        body = f"<h1>{m(6)}</h1>" + "".join(f"<p>{m(rng.randint(15, 80))} <em>{m(2)}</em></p>" + rng.choice(["", quote, figure, f"<h3>{m(3)}</h3>", f"<ol><li>{m(8)}<li>{m(9)}</ol>"]) for _ in range(rng.randint(2, 9)))
        links = "".join(f"<a href=#>{o(1)}</a> | " for _ in range(rng.randint(3, 20)))
        wrap = ["<table><tr><td>{}</td></tr></table>", "<section class='post-body'>{}</section>", "<form action=/><div>{}</div></form>", "<div class='widget-free legal-text'>{}</div>", "<center><font>{}</font></center>", "<main class='has-banner'>{}</main>"][k % 6]
        page = f"<html><head><title>{o(4)}</title></head><body class='no-js'><div id=top>{links}</div>{wrap.format(body)}<div class='related-posts'><p>{o(20)}</p></div><div id=cookie-banner>{o(12)}</div><div>{links}</div></body></html>"
        got, want = Counter(html_extract.main_text(page).split()), Counter(re.findall(r"m\d+", page))
        found, right, wanted = found + got.total(), right + (got & want).total(), wanted + want.total()
    assert right / found > 0.97 and right / wanted > 0.97


def test_op1_nulls(spark, folder):
    got = {r.page_id: (r.text, r.n_chars) for r in q.op1_html_extract(spark, folder).collect()}
    assert got == {1: ("a b c d e f g h i j", 19), 2: ("", 0), 3: ("", 0), None: ("x", 1)}


# 2


def brute_removed(rows, width=50):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[k : k + width])] = min(first.get(tuple(w[k : k + width]), i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_op2_against_brute_force(spark, folder):
    got = [tuple(r) for r in q.op2_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    want = brute_removed([(r[0], r[1]) for r in corpus()])
    assert sorted(got, key=str) == want and sum(r[2] for r in want) > 500


def test_a_passage_in_all_documents(spark, monkeypatch):
    """One owner, one set of places, more takers than a join key serves; and documents that quote a long one in many places."""
    monkeypatch.setattr(substring_dedup, "SHARE", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 8)
    rng = random.Random(21)
    passage, long = prose(rng, 60), prose(rng, 1500).split()
    rows = [(i, f"{prose(rng, rng.randint(0, 30))} {passage} {prose(rng, rng.randint(0, 30))}") for i in range(40)]
    rows += [(0 - 1, " ".join(long))] + [(100 + i, f"{prose(rng, 10)} {' '.join(long[40 * i : 40 * i + 120])} {prose(rng, 10)}") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring_dedup.remove_repeats(table).select("doc_id", "n_words", F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"]), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, found), key=str) == brute_removed(rows)


def test_repeats_at_every_length(spark):
    rng = random.Random(9)
    base = prose(rng, 400).split()
    rows = [(0, " ".join(base))]
    for i, n in enumerate([49, 50, 51, 74, 75, 99, 100, 140], 1):
        at = rng.randrange(200)
        rows.append((i, f"{prose(rng, i)} {' '.join(base[at : at + n])} {prose(rng, 3)}"))
    rows.append((20, " ".join(base[10:60] + base[5:55] + base[10:60])))
    d = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in d.collect()), key=str)
    assert got == brute_removed(rows)


# 3


def grams(t):
    w = WORD.findall(t or "")
    return Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def test_op3_against_all_pairs(spark, folder):
    rows = {i: t for i, t, *_ in corpus() if i is not None}
    parent = {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    g = {i: grams(t) for i, t in rows.items()}
    for a in rows:
        for b in rows:
            if a < b and g[a] and g[b]:
                n = sum((g[a] & g[b]).values())
                if n >= 0.8 * (sum(g[a].values()) + sum(g[b].values()) - n):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.class_id for r in q.op3_near_dedup(spark, folder).collect()}
    assert got == {i: root(i) for i in rows} and len(set(got.values())) < len(got) - 10


def test_alignment_respects_order():
    a = list(range(100))
    assert near_dedup.ordered_similarity(a, a) == 1.0
    assert near_dedup.ordered_similarity(a, a[:95] + [500]) == pytest.approx(95 / 101)
    assert near_dedup.ordered_similarity(a, a[50:] + a[:50]) < 0.8
    assert near_dedup.ordered_similarity(a, a[::-1]) < 0.8


def test_banded_alignment_against_the_full_table():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randrange(30) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.randrange(30)
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
        full = row[-1] / (len(a) + len(b) - row[-1])
        got = near_dedup.ordered_similarity(a, b)
        assert got == pytest.approx(full) if full >= 0.8 else got < 0.8


def test_sketches_are_the_least_labelled_kmers_in_text_order():
    rng = random.Random(4)
    texts = [prose(rng, n) for n in (0, 3, 5, 7, 40, 400)] + ["a a a a a a a a a a a a"]
    h = substring_dedup._Hashes(pa.array(texts))
    offsets, kmers = near_dedup.shingles(h)
    marks = near_dedup.labelled(offsets, kmers)
    got = near_dedup.sketches(offsets, kmers)
    for i in range(len(texts)):
        m = marks[offsets[i] : offsets[i + 1]]
        assert len(set(m.tolist())) == len(m)
        for t in (0, 7, 31):
            value = (m ^ near_dedup._ODD[1, t]) * near_dedup._ODD[0, t]
            least = np.sort(np.argsort(value)[: near_dedup.PICKS])
            place = np.arange(1, len(least) + 1, dtype=np.uint64)
            mixed = near_dedup._mix(m[least] + place * near_dedup._ODD[0, 0]).sum(dtype=np.uint64)
            want = near_dedup._mix(np.array([mixed + near_dedup._TABLE[t]], np.uint64)).view(np.int64)[0] if len(m) else 0
            assert got[i, t] == want


def test_copies_of_one_text_meet_in_it(spark):
    """Copies similar to their text, not to each other, whatever its id: the hub of their buckets links them."""
    rng = random.Random(6)
    base = prose(rng, 120).split()
    rows = [(50, " ".join(base))]
    for i in [*range(25), *range(60, 85)]:
        w = list(base)
        for at in rng.sample(range(5, 115), 2):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got.values()) == {0}


def test_variants_without_their_original_are_the_classes_of_all_pairs(spark, monkeypatch):
    """Form letters with three words changed in each, the template itself not there; blocks so small that a bucket has several."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = random.Random(11)
    base = prose(rng, 200).split()
    rows = []
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(200), 3):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    offsets, kmers = near_dedup.shingles(substring_dedup._Hashes(pa.array([t for _, t in rows])))
    runs = [kmers[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(300):
        for y in range(x):
            if root(x) != root(y) and near_dedup.ordered_similarity(runs[x], runs[y]) >= near_dedup.SIMILARITY:
                parent[max(root(x), root(y))] = min(root(x), root(y))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {x: root(x) for x in range(300)}


def test_short_near_copies_are_candidates_whatever_their_hashes(spark):
    """Texts of few shingles, with words more at an end; every pair that is similar shares a key."""
    rng = random.Random(12)
    rows = []
    for i, (n, more) in enumerate([(8, 1), (9, 1), (10, 1), (12, 1), (13, 1), (12, 2), (13, 2)] * 12):
        w = prose(rng, n + more).split()
        cut = rng.randint(0, more)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[cut : cut + n]))]
    shifted = prose(rng, 14).split()
    rows += [(900, " ".join(shifted[:13])), (901, " ".join(shifted[1:])), (902, "a a a a a a a a"), (903, "a a a a a a a a a")]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}

    keys = {}
    for n in range(4, 12):
        for m in range(n, 12):
            for _ in range(60):
                whole = [rng.randrange(1 << 40) for _ in range(m)]
                gone = set(rng.sample(range(m), m - n))
                a, b = [x for j, x in enumerate(whole) if j not in gone], whole
                if n == m:
                    b = list(whole)
                    b.insert(rng.randrange(m), b.pop(rng.randrange(m)))
                if near_dedup.ordered_similarity(a, b) >= near_dedup.SIMILARITY and a != b and min(len(a), len(b)) <= 9:
                    keys[len(a), len(b)] = True
                    assert {*near_dedup.short_keys(np.array(a, np.uint64))} & {*near_dedup.short_keys(np.array(b, np.uint64))}
    assert {(4, 5), (8, 9), (8, 10), (9, 9), (9, 11)} <= set(keys)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.least for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# 4


def test_op4_base_spans_against_regex(spark, folder, docs):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in q.op4_secret_scan(spark, folder).where("doc_id is not null").collect()}
    for i, t, *_ in corpus():
        if i is not None:
            assert got[i] == base_spans(t)


def base_spans(t):
    t = t or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    s = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    kinds = Counter(k for _, _, k, _ in s)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s)).encode()).hexdigest()


def test_secrets_at_odd_places(spark):
    texts = ["secret=token: abcdefgh", "\U0001f600\U0001f600 api_key='A1b2C3d4' AKIA" + "A" * 16, "x" + "0" * 24 + "\nPASSWORD : hunter22\n" + "f" * 23, "token=\"" + "ab" * 20 + '"', "AKIA1 AKIA" + "Z" * 15, "tokentoken=abcdef", "passwd:=x", None, ""]
    rows = spark.createDataFrame([(i, t, "o") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    found = secrets.scan(rows)
    for r in found.select("doc_id", F.sha2(secrets._joined(F.col("base")), 256).alias("h")).collect():
        assert r.h == base_spans(texts[r.doc_id])[3], texts[r.doc_id]


def test_copied_examples_are_not_live(spark):
    token = "Zx9" + "aB3dE5gH7jK1" * 3
    rows = [(i, f"see {token} here", f"o{i}") for i in range(5)] + [(9, "my Qq1" + "wE2rT4yU6iO8" * 3 + " x", "o1")] + [(i, 'password = "changeme"', f"o{i}") for i in range(20, 24)]
    got = {r.doc_id: ([s.kind for s in r.spans], len(r.live)) for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[0] == ([], 0) and got[9] == (["token"], 1) and got[20] == (["assign"], 0)


def entropy(v):
    return -sum(n / len(v) * np.log2(n / len(v)) for n in Counter(v).values())


def brute_secrets(rows, owners=2, repositories=50):
    """{doc_id: (spans as in op4, n_live)} by plain loops; rows of (doc_id, text, source)."""
    finds, seen = defaultdict(list), defaultdict(lambda: (set(), set()))
    for i, t, o in rows:
        t = t or ""
        assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
        mine = [(m.start(), 0, m.end(), "assign", m[2]) for m in assign.finditer(t) if len(m[2]) >= 6]
        mine += [(m.start(), 1, m.end(), "access", m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        mine += [(m.start(), 2, m.end(), "hex", m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        mine += [(m.start(), 3, m.end(), "token", m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", t) if len(m[0]) >= 32 and all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]")) and entropy(m[0]) >= 3.5]
        for m in mine:
            seen[m[4]][0].add(o)
            seen[m[4]][1].add(i)
        finds[i] = sorted(mine)
    live = {v for v, (a, b) in seen.items() if len(a) <= owners and len(b) <= repositories}
    return {i: (",".join(f"{k}:{a}:{b}" for a, _, b, k, v in mine if k != "token" or v in live), sum(v in live for *_, v in mine)) for i, mine in finds.items()}


def test_op4_spans_and_live_finds_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    mixed = "abcdefghijABCDEFGHIJ0123456789+/_-"
    values = [make(rng.choice([24, 31, 32, 40, 64]), mixed) for _ in range(25)] + [make(rng.choice([23, 24, 40]), "0123456789abcdef") for _ in range(10)] + ["AKIA" + make(rng.choice([15, 16]), "ABC123") for _ in range(6)]
    rows = [(i, " ".join(rng.choice(["token = ", "", "api-key:", "PassWD='", "\U0001f600 "]) + rng.choice(values) + rng.choice(["", "'", " end"]) for _ in range(rng.randint(0, 4))), rng.choice(["a", "b", "c", "d", None])) for i in range(150)]
    pasted, kept, many = make(40, mixed) + "aA0", make(40, mixed) + "bB1", " ".join(f"{k:026x}" for k in range(2000))
    rows += [(1000 + i, f"x {pasted} y", "a") for i in range(51)] + [(2000 + i, f"x {kept} y", "a") for i in range(50)] + [(3000, many + " secret: " + kept, "e"), (3001, None, "e"), (3002, "", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spans, r.n_live) for r in q.op4_secret_scan(spark, str(tmp_path)).collect()}
    assert got == brute_secrets(rows)
    assert got[1000] == ("", 0) and got[2000][1] == 0 and got[3000][0].count("hex") == 2000


# 5


def test_op5_against_tiktoken(spark, folder):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in q.op5_byte_bpe(spark, folder).where("doc_id is not null").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t, *_ in corpus():
        if i is not None:
            ids = enc.encode_ordinary(t or "")
            assert got[i] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
    c = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    odd = ["\x00\x01", "▁x", "\U0001f468‍\U0001f469", "a" * 5000, " \n \t ", "<|endoftext|>", "日本語テキスト", "I'm 12345,67"]
    assert c.encode(odd) == [enc.encode_ordinary(t) for t in odd]
    assert [c.decode(x).decode() for x in c.encode(odd)] == odd


# 6


def test_linking(spark):
    calls = [(1, "a", 5, "f", '{"x": 1}', ["b"]), (1, "b", 6, "f", '{"y": 2, "x": "1"}', []), (1, "c", 7, "f", '{"x": 2}', ["d"]), (1, "d", 8, "g", "{}", ["c"]), (2, "a", 1, "f", "not json", []), (2, "a", 3, "f", '{"x": 9}', None), (None, "z", 1, "f", '{"x": 1}', [])]
    results = [(1, "a", 9, "ok"), (1, "q", 9, "lost"), (2, "a", 2, None), (1, "a", 10, "again")]
    schemas = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}}
    rows = tool_calls.link(spark.createDataFrame(calls, tool_calls.CALLS), spark.createDataFrame(results, tool_calls.RESULTS), schemas).collect()
    got = {(r.conv_id, r.call_id): r for r in rows}
    first = [r for r in rows if not r.status.startswith("extra")]
    got = {(r.conv_id, r.call_id): r for r in first}
    assert sum(r.role == "call" for r in rows) == len(calls) and sum(r.result_seq is not None for r in rows) == len(results)
    assert [got[1, k].place for k in "bacd"] == [0, 1, None, None]
    assert [got[1, k].status for k in "abcdq"] == ["linked", "no_result", "cycle", "cycle", "no_call"]
    assert (got[1, "b"].errors, got[1, "d"].errors, got[2, "a"].errors, got[2, "a"].copies) == ("$.x:type,$.y:additional", "$:unknown_tool", "$:json", 2)
    assert got[1, "a"].message == '{"call":{"after":["b"],"arguments":{"x":1},"id":"a","name":"f"},"conversation":1,"result":"ok","status":"linked"}'
    assert all(json.loads(r.message) for r in rows)


def test_op6_nulls(spark, folder):
    rows = q.op6_tool_calls(spark, folder).collect()
    got = Counter((r.conv_id, r.call_id, r.status, r.copies, r.n_results, r.errors) for r in rows)
    assert got == Counter({
        (1, "1:0", "linked", 1, 1, ""): 1, (1, "1:2", "no_result", 2, 0, "$.prompt:required"): 1, (1, "1:2", "extra_call", 0, 0, "$.prompt:required"): 1, (2, "2:0", "no_call", 0, 1, ""): 1,
        (None, None, "no_result", 1, 0, ""): 1, (3, None, "no_result", 1, 0, "$.turn:required"): 1, (4, None, "context", 0, 0, ""): 1,
    })


def test_arguments_that_canonical_json_cannot_hold():
    schemas = {"f": {"type": "object"}}
    for text in ('{"x":1e999}', '{"x":-1e999}', '{"x":NaN}', '{"x":"\\ud800"}', "[" * 100_000, '{"x":' + "9" * 5000 + "}", "", "{", None):
        errors, _ = tool_calls.check_arguments("f", text, schemas)
        assert errors in (["$:json"], ["$:type"]), text
    assert tool_calls.check_arguments("f", '{"x":"' + "y" * 300_000 + '"}', schemas)[0] == []


def brute_link(calls, results):
    """{(conv, call): (place, status, copies, n_results, content)} and the numbers of extra rows, by plain loops."""
    groups = defaultdict(lambda: ([], []))
    for c in calls:
        groups[c[0], c[1]][0].append(c[2:])
    for r in results:
        groups[r[0], r[1]][1].append(r[2:])
    out, firsts = {}, defaultdict(dict)
    for (conv, call), (cs, _) in groups.items():
        if cs:
            firsts[conv][call] = min(cs, key=lambda c: (c[0], c[1], c[2], sorted(set(c[3]))))
    place = {}
    for conv, mine in firsts.items():
        left, at = dict(mine), 0
        while ready := [(c[0], k) for k, c in left.items() if not any(a in left for a in c[3])]:
            k = min(ready)[1]
            del left[k]
            place[conv, k] = at
            at += 1
    for (conv, call), (cs, rs) in groups.items():
        p = place.get((conv, call))
        status = "no_call" if not cs else "cycle" if p is None else "linked" if rs else "no_result"
        out[conv, call] = (p, status, len(cs), len(rs), min(rs)[1] if rs else None)
    return out, sum(max(0, len(c) - 1) for c, _ in groups.values()), sum(max(0, len(r) - 1) for _, r in groups.values())


def test_link_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tool_calls, "RANKS", 3)
    rng = random.Random(4)
    calls = [(rng.randrange(12), f"c{rng.randrange(9)}", rng.randrange(20), rng.choice("fg"), '{"x":1}', [f"c{rng.randrange(12)}" for _ in range(rng.choice([0, 0, 0, 1, 2]))]) for _ in range(120)]
    calls += [(99, f"k{i}", i, "f", "{}", [f"k{i - 1}"] if i else []) for i in range(40)]
    results = [(rng.randrange(12), f"c{rng.randrange(9)}", rng.randrange(20), f"r{rng.randrange(5)}") for _ in range(90)]
    rows = tool_calls.link(spark.createDataFrame(calls, tool_calls.CALLS), spark.createDataFrame(results, tool_calls.RESULTS), {"f": {}, "g": {}}).collect()
    want, extra_calls, extra_results = brute_link(calls, results)
    got = {(r.conv_id, r.call_id): (r.place, r.status, r.copies, r.n_results, json.loads(r.message)["result"]) for r in rows if not r.status.startswith("extra")}
    assert got == want
    assert Counter(r.status for r in rows)["extra_call"] == extra_calls and Counter(r.status for r in rows)["extra_result"] == extra_results


def test_turns_that_refer_forward_are_sorted(spark, tmp_path):
    said = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": "reply", "arguments": json.dumps({"prompt": "p", "turn": 1}), "after": a} for i, a in calls]})
    turns = [(1, 0, "system", "be kind"), (1, 1, "assistant", said(("a", ["b"]), ("b", []))), (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "B"})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "A"})), (2, 0, "user", "hi"), (2, 1, "assistant", "ho"), (2, 2, "user", "more"), (2, 3, "assistant", "yes"), (2, 4, "assistant", "and")]
    clash = [(*t, "x", "y") for t in turns]
    spark.createDataFrame(clash, "conv_id bigint, turn bigint, role string, text string, said string, call_id string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = q.op6_tool_calls(spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.call_id): (r.place, r.status) for r in rows if r.status != "context"} == {(1, "a"): (1, "linked"), (1, "b"): (0, "linked"), (2, "2:0"): (0, "linked"), (2, "2:2"): (1, "linked"), (2, "2:3"): (None, "no_call")}
    assert sum((r.call_seq is not None) + (r.result_seq is not None) for r in rows) == len(turns) + 1  # turn 1 makes two calls


def test_kahn_against_brute_force():
    rng = random.Random(8)
    for _ in range(100):
        n = rng.randint(0, 7)
        ids = [str(i) for i in range(n)]
        after = [[str(rng.randrange(n)) for _ in range(rng.randint(0, 2))] for _ in range(n)]
        place = tool_calls.kahn(ids, list(range(n)), after)
        for i in range(n):
            if place[i] is not None:
                assert all(place[int(a)] is not None and place[int(a)] < place[i] for a in after[i])


# 7


def test_op7_contract(spark, folder):
    rows = q.op7_mixing(spark, folder).collect()
    assert len(rows) == len(corpus())
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    total = sum(r.size for r in rows)
    assert sum({(r.source_size, r.target): r.target for r in rows}.values()) == pytest.approx(min(1.5 * total, 2 * total))
    largest = max(r.size for r in rows)
    assert all(abs(v - k[1]) <= 2 * largest for k, v in taken.items()), taken
    assert sorted(map(str, rows)) == sorted(map(str, q.op7_mixing(spark, folder).collect()))
    del target


def test_op7_in_many_blocks_against_sql(spark, sf_dir, same_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    same_rows(q.op7_mixing(spark, sf_dir), q.ORACLES["op7_mixing"], sf_dir)


def test_no_block_of_the_queue_depends_on_the_sources(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("copies"), F.md5(F.col("id").cast("string").cast("binary")).alias("spot"), F.lit(1).cast("long").alias("load"))
    goal = mixing.targets(rows.groupBy("source").agg(F.sum("load").alias("source_size")))
    queue = mixing._queue(rows, goal, 40)
    per = queue.groupBy(F.floor(F.conv(F.substring("spot", 1, 8), 16, 10).cast("long") * 40 / F.lit(1 << 32))).count().toPandas()["count"]
    assert queue.count() == 20000 and per.max() < 2 * per.median()
    assert queue.groupBy("source").agg((F.max("served") == F.count("*")).alias("whole"), (F.count_distinct("served") == F.count("*")).alias("each")).where("not (whole and each)").count() == 0


def test_targets_against_resharing(spark):
    rng = random.Random(11)
    for _ in range(4):
        sizes = {f"s{i}": rng.randint(1, 1000) for i in range(rng.randint(1, 9))}
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
        budget, full = 1.5 * sum(sizes.values()), {}
        while True:
            rest = [s for s in sizes if s not in full]
            level = (budget - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
            over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
            if not over:
                break
            full.update({s: 2.0 * sizes[s] for s in over})
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        assert {r.source: pytest.approx(r.target) for r in got} == {s: full.get(s, level * weight[s]) for s in sizes}


def test_mixed_rows(spark, docs):
    decisions = common.materialise(mixing.mix(docs))
    want = Counter()
    for r in decisions.collect():
        want[r.doc_id] += r.taken // r["size"] if r["size"] else 1
    assert Counter(r.doc_id for r in mixing.mixed(docs, decisions).collect()) == +want


# 8


def test_op8_base_against_brute_force(spark, folder):
    got = defaultdict(list)
    for r in q.op8_quality(spark, folder).collect():
        got[r.doc_id].append(tuple(r)[1:7])
        assert not (r.base_failed and r.kept)
    for i, t, *_ in corpus():
        w = WORD.findall(t or "")
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        covered = {x for ks in at.values() if len(ks) > 1 for k in ks for x in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert want in got[i]


def test_exact_bounds():
    assert quality.upper_bound(0, 300, 0.05) == pytest.approx(1 - 0.05 ** (1 / 300))
    assert quality.binomial_cdf(2, 10, 0.3) == pytest.approx(sum([0.7**10, 10 * 0.3 * 0.7**9, 45 * 0.09 * 0.7**8]))
    assert quality.binomial_cdf(quality.upper_bound(3, 200, 0.01) > 0 and 3, 200, quality.upper_bound(3, 200, 0.01)) == pytest.approx(0.01, rel=1e-6)


def test_cutoffs_are_certified_and_need_labels():
    n = quality.GRID
    good, bad = np.zeros(n + 1), np.zeros(n + 1)
    good[n], bad[5] = 1000, 100
    assert quality.choose(good, bad, good, 0.001) == 5
    assert quality.choose(good, bad, good / 100, 0.001) is None
    noisy = good.copy()
    noisy[4] = 100
    assert quality.choose(good, bad, noisy, 0.001) is None


def test_cutoffs_keep_their_promise(spark):
    """False rejection on fresh documents stays within ALPHA, and the junk goes."""
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        junk = i % 7 == 0
        rows.append((i, " ".join(w + ("***" if junk else "") for w in prose(rng, 60).split()), "en", 0 if junk else 1))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    features, n = quality.with_features(d)
    features = common.materialise(features)
    cutoffs = quality.fit_cutoffs(features, n, d.where("doc_id < 2400").select("doc_id", "quality"))
    kept = features.where("doc_id >= 2400").select("quality", quality.verdict(cutoffs, n).alias("kept")).collect()
    assert all(r.kept for r in kept if r.quality == 1) and not any(r.kept for r in kept if r.quality == 0)


def test_false_rejection_of_all_rules_together_stays_within_alpha(spark):
    """Four rules, each of which would reject 1 % of the good documents, others for each rule."""
    high = {"n_symbols": 300, "n_exclaim": 250, "n_upper": 120, "n_dup_lines": 8}
    rows = []
    for i in range(12000):
        good, odd = i % 6 != 0, i // 6 % 100 if i % 6 else i // 6 % 4
        n = {"n_words": 100, "word_chars": 500, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_lines": 10, "n_upper": 0, "n_exclaim": 0}
        if odd < 4:
            n[list(high)[odd]] = high[list(high)[odd]]
        rows.append((i, "en", int(good), *(n[f] for f in quality.FEATURES)))
    d = common.materialise(spark.createDataFrame(rows, "doc_id bigint, lang string, quality int, " + ", ".join(f"{f} bigint" for f in quality.FEATURES)))
    names = {f: f for f in quality.FEATURES}
    cutoffs = quality.fit_cutoffs(d, names, d.select("doc_id", "quality"))
    share = {r.quality: r.lost for r in d.groupBy("quality").agg(F.avg((~quality.verdict(cutoffs, names)).cast("int")).alias("lost")).collect()}
    assert 0 < share[1] <= quality.ALPHA and share[0] >= 0.2


def brute_kept(rows, labels):
    """{doc_id: kept} by plain loops: every step of every pool's path, its rejections counted anew, tested with exact binomial sums."""
    feats = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        three = Counter(zip(words, words[1:], words[2:]))
        again = {j + k for j in range(len(words) - 2) if three[tuple(words[j : j + 3])] > 1 for k in range(3)}
        n, chars = len(words), sum(map(len, words))
        figures = {"symbols": (len(re.findall(r"[#*$%&|<>]", t)), n), "exclaim": (t.count("!"), n), "upper": (sum(c.isupper() for c in t), chars), "dup_lines": (len(lines) - len(set(lines)), len(lines)), "repeats": (len(again), n), "word_length": (chars, n)}
        feats[i] = (n < 50 or 100 * len(again) > 50 * n, lang if lang in ("de", "en", "es", "fr") else "other", {k: a / max(b, 1) for k, (a, b) in figures.items()})
    known = [(feats[i], q_, zlib.crc32(str(i).encode()) % 2 == 0) for i, q_ in labels if i in feats and not feats[i][0]]
    at = lambda stratum, good, held: [f[2] for f, q_, h in known if f[1] in stratum and (q_ > 0) == good and h == held]
    strata = ("de", "en", "es", "fr", "other")
    small = tuple(s for s in strata if 0.98 ** len(at((s,), True, True)) > 0.05 / 5)
    pools = [(s,) for s in strata if s not in small] + ([small] if small else [])
    cutoffs = {}
    for pool in pools:
        good, bad, held = at(pool, True, False), at(pool, False, False), at(pool, True, True)
        lost = lambda docs, cuts: sum(any(d[r] > c for r, c in cuts.items()) for d in docs)
        value = lambda cuts: lost(bad, cuts) / max(1, len(bad)) - 10 * lost(good, cuts) / max(1, len(good))  # noqa: E731, B023
        best = {}
        for rule in quality.RULES:
            worth = [value({rule: c}) for c in quality.grid(rule)]
            if max(worth) > 1e-12:
                best[rule] = (max(worth), worth.index(max(worth)))
        cuts, chosen, top = {}, {}, 1e-12
        for rule in sorted(best, key=lambda r: (-best[r][0], r)):
            for c in quality.grid(rule)[: best[rule][1] + 1]:
                cuts[rule] = c
                k, n = lost(held, cuts), len(held)
                if n == 0 or sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) > 0.05 / len(pools):
                    break
                if value(cuts) > top + 1e-12:
                    chosen, top = dict(cuts), value(cuts)
            else:
                continue
            break
        cutoffs |= dict.fromkeys(pool, chosen)
    return {i: not base and not any(figures[r] > c for r, c in cutoffs[s].items()) for i, (base, s, figures) in feats.items()}, cutoffs


def test_op8_kept_against_brute_force(spark, tmp_path):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(1500):
        lang = rng.choice(["en", "en", "en", "fr", "de", "xx", None])
        words = prose(rng, rng.choice([40, 60, 90])).split()
        bad = i % 6 == 0
        if bad:
            words = [w + rng.choice(["***", "!!!", "", "XYZ"]) for w in words] if i % 4 else words + ["#$%"] * 3
        rows.append((i, rng.choice(["\n", " "]).join([" ".join(words[:30]), " ".join(words[30:])]), lang, "s", 0))
        if i % 5 < 4:
            labels.append((i, int(not bad if rng.random() > 0.01 else bad)))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, cutoffs = brute_kept(rows, labels)
    assert {r.doc_id: r.kept for r in q.op8_quality(spark, str(tmp_path)).collect()} == want
    assert cutoffs["en"] and cutoffs["fr"] and cutoffs["other"] == cutoffs["fr"]


def test_small_strata_are_pooled():
    assert quality.needed(0.02, 0.01) == 228
    assert quality.pools({"en": 300, "fr": 100, "de": 60}, 0.02, 0.05) == [("en",), ("de", "es", "fr", "other")]
    assert quality.pools({s: 500 for s in (*quality.STRATA, quality.OTHER)}, 0.02, 0.05) == [("de",), ("en",), ("es",), ("fr",), ("other",)]


# 9


def test_toxicity_learns_words_and_misspellings(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(1500):
        w = prose(rng, rng.randint(20, 120)).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["wretched", "scoundrel"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    d, lab = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(d, lab)
    got = toxicity.score(d, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    truth = dict(labels)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got]) > 0.97
    other = model.score(pa.array(["abc dej fgh scoundrell abd", "abc dej fgh abcdefg abd", "", None]))
    assert other[0] > 0.5 > other[1] and other[2] == other[3] < 0.5
    again = toxicity.fit(d, lab)
    assert np.array_equal(again.value, model.value)


def brute_bag(text):
    """{bucket: weight}: each word's n-grams and itself share its weight alike, each occurrence of a word counts once."""
    words, bag = WORD.findall(text or ""), defaultdict(float)
    for w in words:
        hashes = [int(h) for h in toxicity.subwords(pa.array([w]))[1]]
        marked = f"<{w.lower()}>"
        assert len(hashes) == 1 + sum(max(0, len(marked) - n + 1) for n in toxicity.WIDTHS)
        for h in hashes:
            bag[h] += 1 / len(hashes) / len(words)
    return bag


def test_bags_and_scores_against_brute_force(spark):
    rng = random.Random(31)
    texts = [prose(rng, rng.choice([0, 1, 5, 40])) for _ in range(20)] + [None, "É é É", "same same same", "x" * 5000]
    doc, bucket, weight = toxicity._bags(pa.array(texts, pa.string()))
    got = defaultdict(dict)
    for d, b, w in zip(doc.tolist(), bucket.tolist(), weight.tolist(), strict=True):
        got[d][b] = w
    for i, t in enumerate(texts):
        want = brute_bag(t)
        assert got[i].keys() == want.keys() and all(got[i][b] == pytest.approx(want[b]) for b in want)
    model = toxicity.Model(np.random.default_rng(5).normal(0, 3, toxicity.BUCKETS), -0.5)
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "doc_id bigint, text string")
    for r in toxicity.score(table, model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(0.5 - sum(w * model.value[b] for b, w in brute_bag(r.text).items()))))


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    d = spark.createDataFrame([(i, "word " * (1 + i % 7)) for i in range(400)] + [(400, "long " * 1000), (3, "another text of an id")], "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(401)], "doc_id bigint, toxic int")
    rows, prior = toxicity.sample(d, lab, most=60, most_bytes=600)
    rows = rows.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.toxic] += len(r.text)
    assert 0 < len(rows) <= 120 and max(sizes.values()) <= 600 and min(sizes.values()) > 500 and 0.4 < prior < 0.6
    assert all(r.id != 400 and zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_held_out_labels_are_never_read(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    lab = spark.read.parquet(f"{folder}/labels.parquet")
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(d, lab), toxicity.fit(d, flipped)
    assert a.bias == b.bias and np.array_equal(a.value, b.value)
    rows = q.op9_toxicity(spark, folder).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


# 10


def test_op10_against_brute_force(spark, folder):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    got = defaultdict(list)
    for r in q.op10_exact_dedup(spark, folder).collect():
        got[r.text_sha256].append(r)
    assert len(got) == len(groups)
    for t, ids in groups.items():
        rows = got[hashlib.sha256(t.encode()).hexdigest()]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, ids))
        assert all((r.keep_id, r.group_size) == (keep, len(ids)) for r in rows)
        assert sum(r.kept for r in rows) == 1 and next(r.doc_id for r in rows if r.kept) == keep


def test_survivors_keep_all_columns(spark, docs):
    d = docs.withColumn("digest", F.lit(1)).withColumn("group_size", F.lit(2))
    got = exact_dedup.survivors(d).select(*d.columns)
    assert got.columns == d.columns and got.count() == len({t or "" for _, t, *_ in corpus()})


def test_cuckoo_filter_and_index():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    index = exact_dedup.CuckooIndex(8)
    for i, k in enumerate(keys):
        index.add(k, str(i), i, i)
    assert index.resized > 0 and index.live == 5000
    assert all((k, str(i)) in index for i, k in enumerate(keys))
    for i, k in enumerate(keys[:2500]):
        assert index.remove(k, str(i))
    assert not index.remove(keys[0], "0") and index.live == 2500
    assert all((k, str(i)) in index for i, k in enumerate(keys) if i >= 2500)
    assert not any((k, str(i)) in index for i, k in enumerate(keys[:2500]))
    # Content decides: the same digest with another text is another entry.
    assert (keys[4000], "other") not in index
    assert index.add(keys[4000], "4000", 1, 9999)[3] == 9999 and index.live == 2500


def test_a_text_in_most_rows_and_long_texts_stream_through_small_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_BYTES", 1 << 16)
    monkeypatch.setattr(exact_dedup, "LOCAL_BYTES", 1 << 12)
    hot = "the one text " * 40
    rows = [(i, hot if i % 3 else f"text {i % 700} " * 9) for i in range(3000)] + [(5000 + i, chr(97 + i % 2) * 300_000) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.memberships(table).collect()}
    assert got == {(i, max(ids), len(ids), i == max(ids)) for ids in groups.values() for i in ids}
    assert {(r.doc_id, r.text) for r in exact_dedup.survivors(table).collect()} == {(max(ids), t) for t, ids in groups.items()}


def test_texts_of_half_a_megabyte_go_through_whole(spark, tmp_path):
    rng = random.Random(41)
    words = prose(rng, 90_000).split()
    near, tail = [*words], "secret = 'a1b2c3d4' at the very end"
    near[45_000] = "changed"
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(words), "en", "s", 0), (3, " ".join(near), "en", "s", 0), (4, " ".join([*words[:100], tail]), "en", "s", 0), (5, "x" * 500_000 + " " + tail, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 5)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: {r.doc_id: r for r in q.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {i: r.class_id for i, r in run("op3_near_dedup").items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {i: r.n_assign for i, r in run("op4_secret_scan").items()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r.decoded_sha256 == sha(rows[i - 1][1]) for i, r in run("op5_byte_bpe").items())
    assert {i: r.n_words for i, r in run("op8_quality").items()} == {i: len(t.split()) for i, t, *_ in rows}
    assert all(0 <= r.score <= 1 for r in run("op9_toxicity").values())
    assert {i: (r.keep_id, r.text_sha256) for i, r in run("op10_exact_dedup").items()} == {i: (2 if i == 1 else i, sha(t)) for i, t, *_ in rows}
    removed = {i: r.n_removed for i, r in run("op2_substring_dedup").items()}
    assert removed == {1: 0, 2: 90_000, 3: 89_999, 4: 100, 5: 0}


def test_join_hot(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = common.materialise(spark.createDataFrame([(i, None if i % 10 == 0 else "hot" if i % 2 else f"k{i % 40}") for i in range(400)], "i int, k string"))
    found = spark.createDataFrame([("hot", 1), *((f"k{i}", 2) for i in range(30))], "k string, v int")
    sized = found.join(rows.groupBy("k").count(), "k", "left").fillna(0)
    for how in ("inner", "left", "left_semi"):
        want = rows.join(found, "k", how)
        for got in (common.join_hot(rows, found, ["k"], how), common.join_hot(rows, sized, ["k"], how, "count")):
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), how
