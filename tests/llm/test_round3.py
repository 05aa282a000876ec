"""Divergence audit, whitening and page differencing against plain rules."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkprint.llm import divergence, extraction, whitening

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


# --- 11 divergence


def plain_audit(rows, least, top=50):
    groups, docs, counts = set(), defaultdict(set), Counter()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for w in TERM.findall(text or ""):
            w = w.translate(LOWER)
            docs[lang, w].add(k)
            counts[lang, source, w] += 1
    kept = defaultdict(list)
    for (lang, w), held in docs.items():
        if len(held) >= least:
            kept[lang].append(w)
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    out = set()
    for lang in {g[0] for g in groups}:
        words, sources = kept[lang], sorted(s for x, s in groups if x == lang)
        n = {s: sum(counts[lang, s, w] for w in words) for s in sources}
        p = {(s, w): share(counts[lang, s, w], n[s], len(words)) for s in sources for w in words}
        q = {w: share(sum(counts[lang, s, w] for s in sources), sum(n.values()), len(words)) for w in words}
        for s in sources:
            pairs = [(sum(abs(p[s, w] - p[o, w]) for w in words), o) for o in sources if o != s]
            terms = [(p[s, w] - q[w], w) for w in words if counts[lang, s, w] and p[s, w] > q[w]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, r) for r, (value, item) in enumerate(items[:limit], 1)}
    return out


@pytest.mark.parametrize("least, groups, terms", [(30, 16, 4096), (2, 3, 5), (1, 1, 1), (10_000, 2, 7)])
def test_divergence_is_the_plain_one(spark, docs, least, groups, terms):
    some = docs.filter("doc_id < 60") if terms == 1 else docs
    some = some.withColumn("text", F.substring("text", 1, 200)) if terms == 1 else some
    want = plain_audit([(r.lang, r.source, r.text) for r in some.collect()], least)
    got = [tuple(r) for r in divergence.audit(some, least, groups=groups, terms=terms).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_divergence_of_odd_rows(spark, odd, none):
    want = plain_audit([(r.lang, r.source, r.text) for r in odd.collect()], 2, 50)
    assert {tuple(r) for r in divergence.audit(odd, 2, groups=2, terms=3).collect()} == want
    assert divergence.audit(none).count() == 0
    assert divergence.audit(none).columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_stay_exact_for_huge_counts(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(300):
        total, terms = draw.randrange(1, 2 * 10**14), draw.randrange(1, 10**7)
        rows.append((draw.randrange(0, total + 1), total, terms))
    frame = spark.createDataFrame(rows, "c bigint, n bigint, v bigint")
    got = frame.select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in got)


def test_a_long_text_is_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 7)
    text = "Straße straße STRASSE don't x1y é😀É " * 50
    assert divergence._counted(text) == Counter(w.translate(LOWER).encode() for w in TERM.findall(text))


# --- 12 whitening


def vectors(spark, rows):
    made = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return made.withColumns({c: F.lit("clash") for c in ("x", "n", "vector", "component", "k")})


def check_whitening(spark, rows, components=8):
    frame = vectors(spark, rows).repartition(3)
    fine = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v in fine)
    d = max(sizes, key=lambda s: (sizes[s], s))
    fine = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in fine if len(v) == d]
    x = np.floor(np.array([v for _, v in fine]) * 1024).astype(np.int64) + 100_000
    y = x - x.mean(axis=0)
    values, basis = np.linalg.eigh(y.T @ y / len(y))
    values, basis = values[::-1], basis[:, ::-1]
    given = whitening.usable(frame)
    fit = whitening.fit(given)
    got = whitening.whiten(given, fit, components).toPandas()
    k = min(components, d)
    assert len(got) == len(fine) * k
    assert set(got.n) == {len(fine)}
    by_id = {i: sum((len(x) * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0))) for (i, _), row in zip(fine, x)}
    assert all(by_id[i] == v for i, v in zip(got.vec_id, got.deviation))
    for c in range(k):
        if values[c] <= values[0] * 1e-12:
            continue
        mine = got[got.component == c + 1].set_index("vec_id").whitened
        want = y @ basis[:, c] / math.sqrt(values[c])
        for_id = np.array([mine[i] if np.isscalar(mine[i]) else mine[i].iloc[0] for i, _ in fine])
        assert min(np.abs(for_id - want).max(), np.abs(for_id + want).max()) < 1e-6
        share = got[got.component == c + 1].explained
        assert np.allclose(share, values[c] / values.sum(), rtol=1e-6)
    return whitening.identity_error(given, fit, components), got


def test_whitening_is_the_eigen_decomposition(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(12, 12)) * np.linspace(0.1, 3, 12)[:, None]
    rows = [(i, [float(v) for v in draw.normal(size=12) @ base]) for i in range(400)]
    error, _ = check_whitening(spark, rows)
    assert error < 1e-10
    common = rows + [(1000 + i, rows[0][1]) for i in range(300)]  # one vector is most of the table
    error, _ = check_whitening(spark, common)
    assert error < 1e-10


def test_whitening_far_from_the_origin_and_badly_scaled(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(1e4 + a), float(1e4 + a + b * 0.05), float(c * 300)]) for i, (a, b, c) in enumerate(draw.normal(size=(500, 3)))]
    error, _ = check_whitening(spark, rows, 3)
    assert error < 1e-8


def test_whitening_of_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [1.0, 5.0, 3.0]), (3, [4.0, 4.0, 3.0]), (4, None), (5, [1.0, None, 3.0]),
        (6, [float("nan"), 1.0, 2.0]), (7, [float("inf"), 1.0, 2.0]), (8, [1.0]), (9, []), (10, [0.5, -2.0, 3.0]),
    ]
    error, got = check_whitening(spark, rows)
    assert error < 1e-10
    assert set(got[got.component == 3].whitened) == {0.0} and set(got[got.component == 3].explained) == {0.0}
    same = vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])
    fit = whitening.fit(whitening.usable(same))
    assert [(r.whitened, r.explained, r.deviation) for r in whitening.whiten(whitening.usable(same), fit).collect()] == [(0.0, 0.0, 0)] * 8
    for gone in ([], [(1, None)], [(1, [float("nan")])]):
        assert whitening.fit(whitening.usable(vectors(spark, gone))) is None


def test_deviations_that_do_not_fit_are_null(spark):
    rows = whitening.usable(vectors(spark, [(i, [1e9 * i, 1.0]) for i in range(50)]))
    got = whitening.whiten(rows, whitening.fit(rows)).collect()
    assert any(r.deviation is None for r in got) and all(r.deviation is None or r.deviation >= 0 for r in got)


def test_whitening_of_the_given_table(spark):
    out = whitening.op12_embedding_whitening(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.collect()
    assert len(rows) == 8 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4


# --- 13 extraction


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_alignment_is_longest(monkeypatch, bits):
    monkeypatch.setattr(extraction, "_TABLE_BITS", bits)
    draw = random.Random(bits)
    for _ in range(1500):
        k = draw.choice([2, 3, 6])
        a, b = ([draw.randrange(k) for _ in range(draw.randrange(14))] for _ in range(2))
        found = sorted(extraction.shared(a, b))
        rest = iter(b)
        assert len(found) == lcs(a, b) and all(a[i] in rest for i in found)


def text_of(page):
    found = extraction.lines(page)
    level = max((x.level for x in found if not x.junk), default=0)
    return [x.text for x in found if not x.junk and x.level == level]


def test_lines_of_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style></head><body class="has-sidebar">
    <header><p>Site</p></header><nav><ul><li><a href="/a">Home</a></ul></nav>
    <div class="cookieBanner notice">We use <b>cookies</b></div><div class=ad>Buy</div>
    <main><article><header><h1>Head &amp; tail &lt;x&gt;</h1><p>By no one</p></header><p><b>One<br>two&nbsp;three
    </b><p>An <i>inline</i><span class="ad">ad</span> word<script>var t="</article>"</script>.
    <ul><li>first<li>second</ul><form><input><p>Mail?</p></form><!-- <p>gone</p> -->
    <blockquote>Said</blockquote><table><tr><td>1<td>2</table></article><aside><p>More</p></aside></main>
    <section id="comments"><article><p>Nice post!</p></article></section><footer>&copy; us"""
    assert text_of(page) == ["Head & tail <x>", "One two three", "An inline word.", "first", "second", "Said", "1", "2"]
    assert text_of("") == [] and text_of("<p>") == [] and text_of("<scr") == []
    assert text_of("plain &eacute; text") == ["plain é text"]
    assert text_of('<div class="post-content"><p>In</p></div><p>Out</p>') == ["In"]
    assert text_of("<p title='a > b'>x</p><p title=\"open>y</p>") == ["x", "y"]


def test_lines_are_linear_in_bad_markup():
    for bad in ("<a " * 100_000, '<a "' * 50_000, "<p><b>" * 20_000, "<div>" * 50_000 + "x", "</p>" * 50_000, "<li>x" * 30_000):
        extraction.lines(bad)


PAGE = "<html><body><div><a href='/'>Home</a></div><div>Welcome to {host}</div>{body}<div>All rights reserved</div></body></html>"


def pages_of(spark, rows):
    made = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return made.withColumns({c: F.lit("clash") for c in ("text", "range", "own", "key", "host", "lines", "n_chars")})


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_shared_lines_of_neighbours_are_deleted(spark):
    """No element says what the article is: only the pair can."""
    rows = []
    for i in range(40):
        body = paragraphs(f"Story {i} begins with words of its own", f"and goes on for a while, number {i}")
        rows.append((i, f"http://h{i % 2}.org/a/{i}", PAGE.format(host=f"h{i % 2}", body=body)))
    copy = paragraphs("The same long story on two pages of the host", "told in exactly the same words once more")
    rows += [(100 + i, f"http://h3.org/x/{i}", PAGE.format(host="h3", body=copy)) for i in range(2)]
    got = {}
    for size in (1000, 7, 1):
        found = extraction.main_text(pages_of(spark, rows).repartition(4), size).collect()
        got[size] = sorted(map(str, found))
        for r in found:
            want = f"Story {r.page_id} begins with words of its own\n\nand goes on for a while, number {r.page_id}"
            if r.page_id >= 100:
                want = "The same long story on two pages of the host\n\ntold in exactly the same words once more"
            assert (r.text, r.n_chars, r.n_lines, r.n_shared) == (want, len(want), 5, 5 if r.page_id >= 100 else 3)
            assert r.partner is not None
    assert got[1000] == got[7] == got[1]


def test_extraction_of_odd_rows(spark):
    long = "<article>" + paragraphs(*[f"line {i % 50} of {i}" for i in range(30_000)]) + "</article>"
    rows = [
        (1, None, "<article><p>a</p></article>"), (2, "http://h/x", None), (3, "http://h/x", ""), (None, "http://h/x", "<article><p>b</p></article>"),
        (4, "not a url", "<p>c</p>"), (5, "http://h/x", "<article><p>b</p></article>"), (5, "http://h/x", "<article><p>b</p></article>"),
        (6, "http://h/y", long), (7, "http://h/z", long), (None, None, None),
    ]
    whole = "\n\n".join(f"line {i % 50} of {i}" for i in range(30_000))
    want = Counter([(1, "a"), (2, ""), (3, ""), (None, "b"), (4, "c"), (5, "b"), (5, "b"), (6, whole), (7, whole), (None, "")])
    for size in (1000, 2):
        found = extraction.main_text(pages_of(spark, rows), size)
        assert Counter((r.page_id, r.text) for r in found.collect()) == want
    assert extraction.main_text(pages_of(spark, rows).limit(0)).count() == 0


def test_articles_of_the_given_pages(spark):
    import html

    out = {r.page_id: r for r in extraction.op13_nearest_url_extraction(spark, SF).collect()}
    given = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(out) == len(given)
    for r in given:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert out[r.page_id].text == "\n\n".join(x for x in blocks if x) and out[r.page_id].url == r.url
