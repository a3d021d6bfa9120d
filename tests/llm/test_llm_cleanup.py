"""op11 to op13 against brute force, and their edge cases."""

import html as H
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormledger.llm import markup, pages, spelling, whitening
from stormledger.llm.queries import QUERIES

# ---- op11


def article(html):
    """The given pages name their article; what is in it, by plain substitution."""
    found = re.search("<article>(.*?)</article>", html, re.S)[1]
    return " ".join(H.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", found))).split())


def test_given_pages_by_substitution(spark):
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op11_main_text"](spark, SF).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert r["text"] == article(given[r["page_id"]]) and r["n_chars"] == len(r["text"])


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("oak river stone cloud meadow lantern walk quiet harbour seldom brave".split()) for _ in range(n)) + "."


def unlabelled(k):
    """No name tells the article from what stands around it; only the host's pages together do."""
    links = "".join(f'<li><a href="/{w}{k}">{w} {k}</a></li>' for w in ("home", "news", "shop", "about"))
    body = "".join(f"<p>{prose(1000 * k + j, 12 + j)}" for j in range(3 + k % 3))
    return (
        f"<html><head><title>T{k}</title></head><body><div id=x1><ul>{links}</ul></div>"
        "<div id=x2>We keep crumbs of your visit. Press here to agree.</div>"
        f"<div id=x3><h2>Title &amp; {k}</h2>{body}</div><div id=x4>Made with care since 1990</div>"
        "<script>if (a < b) document.write('<p>no</p>')</script></body></html>"
    ), f"Title & {k} " + " ".join(prose(1000 * k + j, 12 + j) for j in range(3 + k % 3))


def labelled(k):
    return (
        f"<body><header>Site name</header><nav><a href=/>Home</a></nav><main><h1>Head {k}</h1>"
        f"<div class='entry has-sidebar'><p>A<b>B</b>{k} &lt;x&gt;\n  y</p><aside>see also</aside><p>{prose(k, 9)}</p></div>"
        "<form><input name=q><button>Go</button></form><section class='comments-area'><article>First!</article></section></main>"
        "<div class='left-sidebar'>aside text</div><div class=cookie-notice>ok?</div><!-- <p>no</p> --><style>p{}</style><footer>c</footer>"
    ), f"Head {k} AB{k} <x> y {prose(k, 9)}"


def test_templates_find_what_is_not_named(spark):
    made = {k: (unlabelled if k < 30 else labelled)(k) for k in range(60)}
    rows = [(k, f"http://{'a' if k < 30 else 'b'}.example/{k}", h) for k, (h, _) in made.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in pages.main_texts(df).collect()}
    assert got == {k: want for k, (_, want) in made.items()}


def test_classes_by_brute_force(spark):
    made = [(f"h{k % 3 // 2}", unlabelled(k)[0] if k % 2 else labelled(k)[0]) for k in range(40)]
    n_pages = Counter(host for host, _ in made)
    counted = pages.count_tokens(spark.createDataFrame(made, "host string, html string"))
    _, found = pages.classes(counted)
    got = {(r["host"], frozenset(c["roles"])) for r in found.collect() for c in r["classes"]}
    vectors, is_tag = defaultdict(lambda: defaultdict(dict)), {}
    for n, (host, html) in enumerate(made):
        roles = []
        for t in markup.tokens(html):
            if t.kind == markup.TEXT:
                roles += [(pages._signed(pages._word_role(t.role, w)), False) for w in t.text.split()]
            elif t.kind != markup.BREAK:
                roles.append((pages._signed(t.role), True))
        is_tag.update(roles)
        for role, times in Counter(r for r, _ in roles).items():
            vectors[host][role][n] = times
    want = set()
    for host, of in vectors.items():
        alike = defaultdict(set)
        for role, vector in of.items():
            if len(vector) >= (3 if is_tag[role] else n_pages[host] / 2 if n_pages[host] >= 20 else 10**9):
                alike[tuple(sorted(vector.items()))].add(role)
        want |= {(host, frozenset(c)) for c in alike.values() if len(c) > 1 and any(is_tag[r] for r in c)}
    # Words that occur less often than their element on some page are in no class; the others' classes are the brute ones.
    assert {(h, frozenset(r for r in c if is_tag[r])) for h, c in want} == {(h, frozenset(r for r in c if is_tag[r])) for h, c in got}
    assert all(any(h == g and c <= w for g, w in want) for h, c in got)
    assert any(not is_tag[r] for _, c in got for r in c)


def test_out_of_order_classes_are_broken():
    read = pages.Template([{"roles": [1, 2, 3], "tags": [True, True, True]}, {"roles": [7, 8], "tags": [True, True]}]).read
    page = lambda *roles: [markup.Token(markup.START, r, 0, "i") for r in roles]
    assert list(read(page(1, 7, 8, 2, 7, 8, 3))) == [("class", 7, True), ("class", 7, True), ("class", 1, True)]
    assert ("class", 1, False) in list(read(page(1, 3, 2)))
    assert ("class", 7, False) in list(read(page(1, 7, 2, 8, 3)))


def test_odd_pages(spark):
    odd = [None, "", " ", "plain words", "<", "<p", "<p>open <b>bold", "</p></div>x", "<a href='x>y</a>", "<!-- never closed", "<script>never closed",
           "<article>é&nbsp;&#x65e5;&#26412; &unknown; &am</article>", "<article></article>", "<div>" * 5000 + "deep", "<p>" + "long words " * 60_000]
    rows = [(k, None if k % 2 else "no url", t, "theirs", 1.5) for k, t in enumerate(odd)]
    rows += [(3, "http://x/", "plain words", None, None), (3, "http://x/", "plain words", None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text double")
    out = pages.main_texts(df)
    assert set(out.columns) == {"page_id", "url", "host", "text", "n_chars"}
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[0] == by_id[1] == by_id[None] == by_id[12] == "" and by_id[3] == "plain words"
    assert by_id[6] == "open bold" and by_id[7] == "x" and by_id[9] == "" and by_id[11] == "é 日本 &unknown; &am"
    assert by_id[13] == "deep" and by_id[14] == ("long words " * 60_000).strip()
    assert pages.main_texts(df.limit(0)).count() == 0


# ---- op12


def check_whitening(spark, rows, k=8):
    x = np.floor(1024 * np.array([v for _, v in rows], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = whitening.whiten(df, "vec_id", "embedding", k).collect()
    table = np.array([[r["vec_id"], r["component"], r["n"], r["deviation"]] for r in got])
    place = {i: at for at, (i, _) in enumerate(rows)}
    white = np.zeros((n, k))
    for r in got:
        white[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    want = y @ vectors / np.sqrt(values)
    assert len(got) == n * k and (table[:, 2] == n).all()
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9
    assert {(a, d) for a, _, _, d in table.tolist()} == {(i, int(d)) for (i, _), d in zip(rows, ((n * x - sums) ** 2).sum(axis=1))}
    explained = {r["component"]: r["explained"] for r in got}
    assert all(abs(explained[c + 1] - values[c] / (y * y).sum() * n) < 1e-9 for c in range(k))
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_by_full_decomposition(spark):
    rng = np.random.default_rng(3)
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(spark, given)
    check_whitening(spark, [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((30, 5)) * [9, 5, 3, 2, 1])], 3)


@pytest.mark.parametrize("spectrum", [
    np.linspace(2, 1, 64), 1 / np.arange(1, 301), np.r_[1e6, np.linspace(2, 1, 150)], np.linspace(1, 0.99, 120), np.ones(90),
    np.r_[np.ones(3), np.zeros(97)], np.zeros(50), np.array([3.0, 2.0, 1.0]),
])
def test_leading_vectors_are_certified(spectrum):
    d = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    matrix = (turn * spectrum) @ turn.T
    values, vectors, trace = whitening.leading(lambda q: (matrix @ q, np.diag(matrix)), d, min(8, d))
    want = np.sort(spectrum)[::-1][:8]
    want = want[want > 1e-9]
    assert len(values) == len(want) and abs(trace - spectrum.sum()) < 1e-6
    assert np.allclose(values, want, rtol=1e-9)
    assert not len(values) or np.abs(matrix @ vectors - vectors * values).max() < 1e-11 * max(1, spectrum.max())


def test_whitening_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [1e30, 0.0])]
    good = [(10, [1.0, 0.0]), (11, [0.0, 1.0]), (None, [0.5, 0.5]), (11, [0.0, 1.0]), (12, [4.0, -2.0])]
    schema = "vec_id long, embedding array<double>, vector string, n int"
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in odd + good], schema)
    got = whitening.whiten(df, "vec_id", "embedding").collect()
    assert Counter(r["vec_id"] for r in got) == {10: 2, 11: 4, None: 2, 12: 2} and {r["n"] for r in got} == {5}
    assert whitening.whiten(df.filter("vec_id < 6"), "vec_id", "embedding").count() == 0
    assert whitening.whiten(df.limit(0), "vec_id", "embedding").count() == 0
    same = spark.createDataFrame([(k, [2.0, 3.0]) for k in range(4)], "vec_id long, embedding array<float>")
    assert whitening.whiten(same, "vec_id", "embedding").count() == 0
    wide = whitening.Fit(1 << 20, np.array([0, 0]), 1 << 45)
    exact = [sum(((1 << 20) * v) ** 2 for v in row) for row in ([1 << 9, 3], [1 << 44, 1])]
    assert wide.deviation(np.array([[1 << 9, 3], [1 << 44, 1]])) == [exact[0], None]


# ---- op13


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_groups(counts, ratio=10):
    of = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda v: (-counts[v], v)) if others else None
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = form[w], root, counts[w], len(of[w]), counts[form[w]] if form[w] else None
    return out


def grouped(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_given_words_by_brute_force(spark):
    counts = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    got = QUERIES["op13_spelling"](spark, SF)
    assert {r["word"]: r["n"] for r in got.collect()} == counts
    shuffled = random.Random(0).sample(sorted(counts), 40)
    rows = {r["word"]: r["n_near"] for r in got.collect()}
    assert all(rows[w] == sum(near(w, v) for v in counts) for w in shuffled)


@pytest.mark.parametrize(("crowd", "bucket"), [(8192, 4096), (20, 16), (3, 4)])
def test_groups_by_brute_force(spark, crowd, bucket):
    rng, counts = random.Random(1), Counter({"a" * 300: 5, "a" * 299: 60, "a" * 301: 900})
    for _ in range(400):
        counts["".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 8, 9])))] += rng.choice([1, 2, 30, 400, 5000])
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert grouped(spelling.variant_groups(df, crowd=crowd, bucket=bucket)) == brute_groups(counts)


def test_short_null_and_repeated_words(spark):
    counts = Counter({"a": 1, "b": 30, "ba": 500, "ab": 2, "bab": 3, "c\0d": 5, "cd": 1, "é": 9, "👩b": 7, "日b": 7})
    rows = [(w, n, "x") for w, n in counts.items() if w != "ba"] + [("ba", 200, "x"), ("ba", 300, "y"), (None, 3, "x"), ("", 4, "x"), ("z", None, "x")]
    df = spark.createDataFrame(rows, "word string, n long, near string")
    assert grouped(spelling.variant_groups(df)) == brute_groups(counts)
    assert spelling.variant_groups(df.limit(0)).count() == 0


def test_words_of_odd_texts(spark):
    texts = [None, "", "12 !", "abcdefg abcdefg", "x" * 60_000, "x" * 60_000, "ABCDEFGÉ abcdefgÉ"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("run", T.LongType())])
    df = spark.createDataFrame([(None if k == 3 else k, t, 1) for k, t in enumerate(texts)], schema)
    got = {r["word"]: r["n"] for r in spelling.noisy_words(df, "doc_id").collect()}
    want = Counter()
    for k, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if k == 3 else k}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
    assert spelling.noisy_words(df.filter(F.lit(False)), "doc_id").count() == 0
