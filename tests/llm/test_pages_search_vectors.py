"""Main text, URL filter, search and embeddings."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from paraforge.llm import neighbours, search, site_tree, urls

PAGES = {
    "<html><head><title>x</title></head><body><nav>menu</nav><article><h1>T &amp; t</h1><p>a <b>b</b>\n c<br>d<p>e &lt;x&gt;</article>"
    "<footer>f</footer></body></html>": "T & t\na b c d\ne <x>",
    "<body><script>var a='</p><p>no';</script><main>yes<aside>no</aside><div class='comments'><article>no</article></div> more</main>": "yes\nmore",
    "<article><header><h1>H</h1></header><form>no</form><div id=cookie-notice>no</div><style>p{}</style><p>t&eacute;xt &am x</article>tail":
        "H\nt\u00e9xt &am x",
    "<div class=ad>no</div><p>plain <!-- no --> page</p><p hidden>no</p>": "plain page",
    "a < b and <p title=\"x>y\">c</p": "a < b and\nc",
    "<article><p>cut <a href='x": "cut",
    "": "", None: "", "<article></article>": "", "just text": "just text",
}


def test_pages(spark):
    rows = [(i, None if i == 3 else f"http://h{i}.example.com/", h) for i, h in enumerate(PAGES)] * 2
    got = site_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = dict(enumerate(PAGES.values()))
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_chars"]) == (texts[r["page_id"]], len(texts[r["page_id"]])), r["page_id"]


def test_entropy_removes_what_a_site_repeats(spark):
    page = "<body><div class='top'>Welcome to this site</div><div class='body'><p>Story {0} of the day</p><p>More on {0}</p></div></body>"
    rows = [(i, "http://a.org/", page.format(i)) for i in range(30)] + [(99, "http://b.org/", page.format(99))]
    got = {r["page_id"]: r["text"] for r in site_tree.main_texts(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Story 7 of the day\nMore on 7"
    assert got[99].startswith("Welcome")


LOST = {
    '<div style="overflow:hidden"><article>keep</article></div>': "keep", '<article data-title="the hidden cost">keep</article>': "keep",
    '<article aria-label="hidden gems">keep</article>': "keep", '<div class="content has-sidebar"><article>keep</article></div>': "keep",
    '<article class="post no-comments">keep</article>': "keep", "<form id=page><nav>menu</nav><article>a long article</article></form>": "a long article",
    '<div>the page itself, a longer text</div><article class="comment">reply</article>': "the page itself, a longer text",
    "<div id=comments><article>reply</article></div><p>the page itself</p>": "the page itself",
    '<article><p>a</p><div class="ad-slot">no</div><div hidden>no</div><ul class="social-links"><li>no</ul><p class="related">no</p><p>b, a longer one</p></article>':
        "a\nb, a longer one",
    '<div class="widget-area"><p>most of a page without an article is in here</p></div><p>rest</p>': "most of a page without an article is in here\nrest",
    "<article><p title='a' title=hidden class='x'>keep</p></article>": "keep", "<div " + "<div>" * 3000 + "deep": "deep",
    "<p>" + "long " * 60_000 + "</p>": ("long " * 60_000).strip(),
}


def test_names_and_attributes_lose_no_article():
    for page, text in LOST.items():
        assert site_tree.extract(page, frozenset()) == text, page[:80]


def test_pages_with_clashing_columns(spark):
    rows = [(i, f"http://h{i}.org/{'x' * (50_000 if i == 2 else 3)}", h, "a", 1, None) for i, h in enumerate(LOST)] + [(None, None, "<p>x</p>", "b", 2, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, low long, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in site_tree.main_texts(df).collect()}
    assert got == {**{i: (t, len(t)) for i, t in enumerate(LOST.values())}, None: ("x", 1)}
    assert urls.judge(df.withColumnRenamed("text", "score")).count() == len(rows)


def test_importance_judges_unmarked_branches(spark):
    page = ("<body><div><a>Home</a> <a>About</a></div><article><div>Sign up for our letter</div><p>Story {0} of the day is long enough</p>"
            "<section><p>More on {0}, and more</p></section><ul><li>Home<li>About</ul></article><div>Call us</div></body>")
    bare = "<body><div>Welcome</div><div class=x><p>Tale {0} of the day is long enough</p></div><div>Call us now</div></body>"
    same = "<article><div>first half of it</div><div>second half of it</div><div>third half of it</div></article>"
    rows = ([(i, "http://a.org/", page.format(i)) for i in range(20)] + [(100 + i, "http://b.org/", bare.format(i)) for i in range(20)]
            + [(200 + i, "http://c.org/", same) for i in range(9)])
    got = {r["page_id"]: r["text"] for r in site_tree.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Story 7 of the day is long enough\nMore on 7, and more"
    assert got[107] == "Tale 7 of the day is long enough"
    assert got[203] == "first half of it\nsecond half of it\nthird half of it"  # a whole article that a site repeats stays


def test_importance_matches_plain_counting(spark):
    rng = np.random.default_rng(3)
    pages = []
    for i in range(60):
        parts = "".join(f"<div class=c{rng.integers(3)}><p>t{rng.integers(5)}</p>{'<ul><li>x</ul>' * int(rng.integers(3))}</div>" for _ in range(rng.integers(1, 5)))
        pages.append((i, f"http://h{i % 3}.org/", f"<body>{parts}<div>foot</div></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r["host"], r["node"]): r for r in site_tree.importance(df.withColumn("host", urls.host_of(df.url))).collect()}
    styles, texts = {}, {}
    for i, url, page in pages:
        found, every = site_tree.blocks(page)
        first = {}
        for e in every:
            first.setdefault(e.path, tuple(e.children))
        shown = {(e.path, text) for text, inner in found for e in inner.chain()}
        for path, children in first.items():
            styles.setdefault((f"h{i % 3}.org", path), []).append(children)
        for path, text in shown:
            texts.setdefault((f"h{i % 3}.org", path), []).append(text)
    assert set(got) == set(styles)
    for key, shown in styles.items():
        m, variants = len(shown), Counter(shown)
        blocks = Counter(texts.get(key, []))
        if m < site_tree.PAGES:
            look = content = 1.0
        else:
            look = -sum(c / m * math.log(c / m) for c in variants.values()) / math.log(m)
            content = 1 - (sum(math.log(c) for c in blocks.values()) / len(blocks) / math.log(m) if blocks else 0)
        part = site_tree.GAMMA ** len(variants)
        assert got[key]["pages"] == m and abs(got[key]["importance"] - (1 - part) * look - part * content) < 1e-9


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert site_tree.main_texts(empty).count() == 0 and urls.judge(empty).count() == 0


def test_rules(spark):
    cases = [("http://a.com/x", "a.com", "/x", "com/", "allow"), ("https://m.EXAMPLE.com/en/1?q", "m.example.com", "/en/1", "example.com/en/", "block"),
             ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
             ("http://x.net/es/#a", "x.net", "/es/", "net/es/", "block"), ("x://net/fr/a", "net", "/fr/a", "net/fr/", "block"),
             ("http://com", "com", "", None, None), ("http://acom/", "acom", "/", None, None), ("http://x.net/en/", "x.net", "/en/", None, None),
             ("http://a.com?x://b.net/es/", "a.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
             ("", "", "", None, None), ("http://\u00c9X.net/es/", "\u00c9x.net", "/es/", "net/es/", "block")]
    rows = [(i, c[0]) for i, c in enumerate(cases)] + [(5, cases[5][0])]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    for r in got:
        _, host, path, rule, verdict = cases[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_language_model_tells_urls_apart(spark):
    rows = [(i, f"http://good{i % 9}.com/news/{i}") for i in range(200)] + [(1000 + i, f"http://x{i % 9}.net/es/casino{i}") for i in range(200)]
    rows += [(5000, "http://good3.org/news/77"), (5001, "http://x4.org/es/casino5")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000] == "allow" and got[5001] == "block"


def markov(strings):
    """Counts of every gram and context up to the model's order, and the log-probability of a string."""
    counts = Counter()

    def places(s):
        symbols = [b + 1 for b in s.encode()] + [0]
        for i, x in enumerate(symbols):
            before = tuple(symbols[i - j] if i >= j else None for j in range(1, urls.ORDER + 1))
            yield x, before
    for s in strings:
        for x, before in places(s):
            for m in range(urls.ORDER + 1):
                counts[before[:m], x] += 1
                counts[before[:m]] += 1

    def log_p(s):
        total = 0.0
        for x, before in places(s):
            p = 1 / 257
            for m in range(urls.ORDER + 1):
                p = (counts[before[:m], x] + urls.PRIOR * p) / (counts[before[:m]] + urls.PRIOR)
            total += math.log(p)
        return total
    return log_p


def test_ratio_matches_plain_counting(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"http://{'ab'[rng.integers(2)]}{rng.integers(30)}.{['com', 'net', 'org', 'net'][i % 4]}{['/x', '/es/', '/y', '/fr/'][i % 4]}é{rng.integers(9)}") for i in range(160)]
    rows += [rows[1], rows[2], (900, None), (901, "://"), (902, "http://z.org/" + "q" * 40_000)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    labelled = [(r["host"] + r["path"], r["verdict"]) for r in got if r["rule"]]
    yes, no = (markov([s for s, v in labelled if v == what]) for what in ("allow", "block"))
    open_rows = [r for r in got if not r["rule"]]
    assert len(got) == len(rows) and len(open_rows) > 30
    for r in open_rows:
        s = r["host"] + r["path"]
        assert abs(r["score"] - (yes(s) - no(s)) / (len(s.encode()) + 1)) < 1e-9, s[:60]
    cut = max([r["score"] for r in open_rows if r["verdict"] == "block"], default=-9), min([r["score"] for r in open_rows if r["verdict"] == "allow"], default=9)
    assert cut[0] < cut[1]


def brute_search(rows, queries, k):
    fold = {i: i + 32 for i in range(65, 91)}
    counts = [Counter(re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").translate(fold))) for _, t in rows]
    n, lengths = len(rows), [sum(c.values()) for c in counts]
    mean, df = sum(lengths) / n, Counter(w for c in counts for w in c)
    out = set()
    for q in queries:
        terms = counts[q]
        scores = []
        for (doc_id, _), c, length in zip(rows, counts, lengths):
            s = sum(f * math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2 / (c[w] + 1.2 * (.25 + .75 * length / mean))
                    for w, f in terms.items() if w in c)
            if s > 0:
                scores.append((-round(s, 5), doc_id is None, doc_id or 0, doc_id))
        out.update((rows[q][0], i + 1, s[3]) for i, s in enumerate(sorted(scores)[:k]))
    return out


@pytest.mark.parametrize("shard", [1500, 1_000_000])
def test_search_is_exact(edge_docs, edge_rows, no_docs, shard):
    from pyspark.sql import functions as F

    picked = [i for i, (d, _) in enumerate(edge_rows) if d is not None and d % 4 == 0]
    queries = edge_docs.filter(F.col("doc_id") % 4 == 0).select(F.col("doc_id").alias("id"), "text")
    got = search.top_documents(edge_docs, queries, 5, shard, 3).collect()
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in got} == brute_search(edge_rows, picked, 5)
    assert search.top_documents(no_docs, no_docs.select(F.col("doc_id").alias("id"), "text")).count() == 0


def test_single_precision_and_small_scores_drop_nothing():
    import pyarrow as pa

    index = search.ShardIndex(4.0)
    for _, data, off in search.slices(pa.array(["a b c d"] * 40)):
        index.add(data, off)
    index.finish()
    weights = np.full(4, 1e5)
    where, weights = index.places(index.terms, weights)
    common = (weights[:, None] * index.dense[index.column[where]]).sum(axis=0)
    common[0] *= 1 - 1e-6  # as a product in single precision may be off
    assert len(index.search(where, weights, common, 3)[0]) == 40
    assert len(next(index.search_batch([(index.terms, np.full(4, 1e-8))], 3))[0]) == 40


def test_blocks_below_the_threshold_are_skipped():
    """Documents of several languages: a query's cursors pass the blocks of the others by, and find the same as a full scan."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join([f"the{i % 8}"] * 9 + [f"l{i % 8}w{x}" for x in rng.zipf(1.3, 40) % 300]) for i in range(4000)]
    index = search.ShardIndex(49.0)
    for _, data, off in search.slices(pa.array(texts)):
        index.add(data, off)
    arrived = index.finish()
    again = search.ShardIndex.opened(49.0, index.packed())
    for q in range(0, 4000, 400):
        _, terms, tf, _ = search.term_counts(*[x for x in search.slices(pa.array([texts[q]]))][0][1:])
        weights = tf * 1.5
        index.query_weight[index.places(terms, weights)[0]] = index.places(terms, weights)[1]
        full = index.exact(np.arange(index.n))
        index.query_weight[:] = 0
        before = again.skipped
        docs, scores = next(again.search_batch([(terms, weights)], 10))
        best = sorted(zip(-np.round(scores, 6), docs))[:10]
        assert [round(-s, 6) for s, _ in best] == sorted(np.round(full, 6).tolist(), reverse=True)[:10]
        assert arrived[best[0][1]] == q or texts[arrived[best[0][1]]] != ""
        assert again.skipped - before > 0.5 * index.n / search.BLOCK_DOCS
        assert len(next(again.search_batch([(terms, weights)], 10, [1e9]))[0]) == 0


def brute_vectors(rows):
    good = [(i, np.array(v, dtype=np.float64)) for i, (_, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = Counter(), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, links[i], least, vec_id is not None and vec_id == least))
    return Counter(out)


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [float("nan")] + [1.0] * 7), (5, [None] + [1.0] * 7), (6, [float("inf")] * 8),
            (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1e30] * 8), (10, [1e-30] * 8), (None, [1.0, 2.0, 2.5])]
    for g in range(12):
        centre = rng.standard_normal(8)
        rows += [(100 + g * 50 + i, (centre + 0.15 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(int(rng.integers(1, 45)))]
    rows += rows[-2:]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", __import__("pyspark.sql.functions", fromlist=["x"]).lit(1))
    typed = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = neighbours.near_vectors(df.repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute_vectors(typed)
    assert neighbours.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [15, 40])
def test_tight_groups_that_link_are_one_component(spark, n):
    rng = np.random.default_rng(n)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    ends = [axes[0], 0.925 * axes[0] + math.sqrt(1 - 0.925 ** 2) * axes[1]]
    rows = [(1000 * g + i, (end + 0.0005 * rng.standard_normal(64)).tolist()) for g, end in enumerate(ends) for i in range(n)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (x[:n] @ x[:n].T).min() > 0.97 and 0.9 < (x[:n] @ x[n:].T).max() < 0.95
    got = neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, got)) == brute_vectors(rows)


def test_tables_follow_the_bits():
    for bits in (1, 5, 16, 30):
        shared = (1 - math.acos(0.9) / math.pi) ** bits
        assert (1 - shared) ** neighbours.n_tables(bits) <= 1e-3


def test_audit_sees_lost_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(32)
    rows = [(i, hot + 0.01 * rng.standard_normal(32), 0) for i in range(400)]
    for i in range(60):
        centre = rng.standard_normal(32)
        lost = i % 4 == 0
        rows += [(1000 + 2 * i + j, centre + 0.01 * rng.standard_normal(32), 1000 + 2 * i + (j if lost else 0)) for j in range(2)]
    packed = [(c, np.asarray(v, dtype="<f8").tobytes(), root) for c, v, root in rows]
    df = spark.createDataFrame(packed, "c long, vec binary, root long")
    assert neighbours._audit(df, "<f8", 1) < 0.9
    assert neighbours._audit(df.withColumn("root", __import__("pyspark.sql.functions", fromlist=["x"]).expr(
        "if(c < 1000, 0, c - c % 2)")), "<f8", 1) == 1.0

    real, salts = neighbours._audit, []

    def missed_at_first(rooted, kind, salt):
        salts.append(salt)
        return 0.5 if len(salts) < 3 else real(rooted, kind, salt)
    monkeypatch.setattr(neighbours, "_audit", missed_at_first)
    roots = {r["c"]: r["root"] for r in neighbours.linked_components(df.select("c", "vec"), "<f8").collect()}
    assert len(salts) == 3 and len(set(salts)) == 3  # passes go on, with new tables, until the audit is met
    assert roots == {c: 0 if c < 1000 else c - c % 2 for c, _, _ in packed}


def test_a_wave_scores_few_documents_in_full(monkeypatch):
    import pyarrow as pa

    from paraforge.llm import search as S
    from paraforge.llm.words import slices

    monkeypatch.setattr(S, "DENSE_SHARE", 0)
    # The first blocks have the higher bounds (a or b in a document), the others the higher scores (both, in ever longer texts).
    first = ["z " * 9 + ("a " if i % 2 else "b ") * 8 for i in range(S.FIRST_BLOCKS * S.BLOCK_DOCS)]
    texts = first + ["z " * 9 + "a a a b b b " + "z " * i for i in range(14 * S.BLOCK_DOCS)]
    index = S.ShardIndex(200.0)
    for _, data, off in slices(pa.array(texts)):
        index.add(data, off)
    index.finish()
    _, data, off = next(iter(slices(pa.array(["a b"]))))
    asked, sizes, exact = np.sort(S.term_counts(data, off)[1]), [], S.ShardIndex.exact
    monkeypatch.setattr(S.ShardIndex, "exact", lambda self, docs: sizes.append(len(docs)) or exact(self, docs))
    (docs, scores), = index.search_batch([(asked, np.ones(2))], 10)
    index.query_weight[index.places(asked, np.ones(2))[0]] = 1.0
    best = np.sort(exact(index, np.arange(index.n)))[::-1][:10]
    assert np.allclose(np.sort(scores)[::-1][:10], best) and sum(sizes) < len(first) + 100
