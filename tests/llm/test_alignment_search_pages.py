"""Tokenizer alignment, ranked search and page text against plain versions of what they compute."""

import hashlib
import html
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, lexical, pages

ROOT = "/root/testdata/sf0.001"
SYLLABLES = "the of an ing ra tion Über é 字 12 don't ... \n \t  ▁ <s> <|endoftext|>   😀".split(" ")


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


# --- alignment


def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_links(text, a, b):
    """(ids of A, ids of B, groups, linked ids) by comparing all byte ranges of the libraries' own tokens, or None."""
    if not text:
        return None
    symbols = {c: i for i, c in enumerate(alignment.byte_symbols())}
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(symbols[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
        return None
    ranges = []
    for parts in (bytes_a, bytes_b):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        ranges.append([(e - len(p), e) for p, e in zip(parts, ends, strict=True)])
    links = [(i, j) for i, (s, e) in enumerate(ranges[0]) for j, (t, f) in enumerate(ranges[1]) if s < f and t < e]
    cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    groups, start = [], 0
    for c in cuts:
        groups.append(tuple([ids[k] for k, (s, e) in enumerate(r) if start < e <= c] for ids, r in ((ids_a, ranges[0]), (ids_b, ranges[1]))))
        start = c
    return ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]


TEXTS = [None, "", " ", "a", " a", "a ", "a  b", "\nx", "x\n y", "a\x00b", "▁", "a ▁b", "<|endoftext|> <s>", "Ünïcödé ß 字 😀", "x" * 3000, *(prose(40, i) for i in range(12)), "same words here", "same words here"]


def test_alignment_against_the_libraries(spark):
    a, b = libraries()
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1), (3, "an id again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string, n_a int").repartition(3)
    links = [plain_links(t, a, b) for _, t, *_ in rows]
    count = Counter(p for x in links if x for p in set(x[3]))
    best = {}
    for (x, _), c in count.items():
        best[x] = max(best.get(x, 0), c)
    want = []
    for (i, *_), x in zip(rows, links, strict=True):
        if x is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in x[2])
        want.append((i, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(said.encode()).hexdigest()))
    got = [tuple(r) for r in alignment.aligned(docs).collect()]
    assert Counter(got) == Counter(want)


def test_pair_counts_do_not_depend_on_the_slices(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(30, i % 5).replace("▁", "")) for i in range(20)], "doc_id long, text string")
    one = sorted(alignment.pair_counts(alignment.found(docs.coalesce(1))[1]).collect())
    many = sorted(alignment.pair_counts(alignment.found(docs.repartition(7))[1]).collect())
    assert one == many and one


def test_spans_cover_the_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    a, b = libraries()
    for r in alignment.spans(docs).collect():
        x = plain_links(TEXTS[r["doc_id"]], a, b)
        if x is None:
            assert not r["a_ids"] and not r["b_ids"] and not r["cuts"]
            continue
        assert (r["a_ids"], r["b_ids"]) == (x[0], x[1])
        assert [(c["a"], c["b"]) for c in r["cuts"]] == list(zip(np.cumsum([len(g[0]) for g in x[2]]).tolist(), np.cumsum([len(g[1]) for g in x[2]]).tolist(), strict=True))
        assert r["cuts"][-1]["bytes"] == len(TEXTS[r["doc_id"]].encode()) + 1


def test_alignment_of_megabytes(spark):
    text = " ".join(prose(50, i) for i in range(6000)).replace("▁", "")
    started = time.time()
    row = alignment.aligned(spark.createDataFrame([(1, text), (2, "z" * 300_000)], "doc_id long, text string")).where("doc_id = 1").first()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] > 1_000_000
    assert time.time() - started < 120


# --- ranked search


def plain_ranking(docs, items, k):
    """The contract's arithmetic, row by row."""
    lowered = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lowered))
    counts = [Counter(of(t)) for _, t in docs]
    big_n, big_l = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 100 - 50 + (50 * c.total() * big_n) // big_l if c else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(of(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def documents(n):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["Alpha", "beta,gamma", "ÉT", "été", "42", "the", "the", "rare%d" % rng.randint(0, 60)], k=rng.randint(0, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the alpha"), (5, "alpha alpha alpha"), (n, None), (n + 1, "..."), (n + 2, "the " * 5000), (n + 3, texts[7]), (n + 4, texts[7])]


ITEMS = [(1, "Alpha beta"), (2, "THE, the été"), (3, None), (4, ""), (5, "nowhere"), (6, "rare1 rare2 rare3 42"), (7, "alpha-rare5"), (None, "gamma")]


@pytest.mark.parametrize("block, at_once, k", [(4096, 256, 50), (64, 2, 7), (128, 3, 1), (64, 1, 1000)])
def test_search_against_plain_ranking(spark, monkeypatch, block, at_once, k):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "WORDS", block >> 6)
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", at_once)
    rows = documents(500)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string").repartition(3)
    (queries,) = lexical.passes(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text")
    # blocks are patched here, so build and search run in this process
    corpus = lexical.counted(docs, queries.vocabulary)
    places = np.arange(len(rows))
    order = sorted(places, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    hits = []
    for start in range(0, len(rows), block):
        part = [rows[i] for i in order[start : start + block]]
        lengths, place, code, tf = lexical.numbered([t.encode() if t is not None else None for _, t in part], queries.vocabulary)
        batch = lexical.index_rows(0, [d for d, _ in part], code, place, lexical.impacts(tf, lengths[place], corpus)).to_pylist()
        for q, p, score in lexical.searched([(r["term"], r["words"], r["planes"]) for r in batch[1:]], corpus.weights(), queries.wanted, k):
            hits += [(queries.ids[i], part[j][0], s) for i, j, s in zip(q.tolist(), p.tolist(), score.tolist(), strict=True)]
    got = []
    for item in {h[0] for h in hits}:
        own = sorted((h for h in hits if h[0] == item), key=lambda h: (-h[2], h[1] is None, h[1] or 0))
        got += [(item, r + 1, h[1], h[2]) for r, h in enumerate(own[:k])]
    want = plain_ranking(rows, ITEMS, k)
    assert Counter(got) == Counter(want) and want


def test_ranked_frames(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lexical, "QUERIES_A_PASS", 3)  # three passes over the documents
    rows = documents(300)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string").repartition(5)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical.rank(docs, items, 9).collect()]
    assert Counter(got) == Counter(plain_ranking(rows, ITEMS, 9))
    # an index that is stored, and read in another order
    monkeypatch.setattr(lexical, "QUERIES_A_PASS", 100)
    (queries,) = lexical.passes(items, "item_id", "text")
    corpus = lexical.counted(docs, queries.vocabulary)
    lexical.build(docs, queries.vocabulary, corpus).repartition(4, "term").write.parquet(f"{tmp_path}/index")
    stored = lexical.search(spark.read.parquet(f"{tmp_path}/index"), queries, corpus, 9, stored=True)
    assert Counter(tuple(r)[1:] for r in stored.collect()) == Counter(got)


def test_bitwise_arithmetic():
    rng = np.random.default_rng(1)
    values, more = rng.integers(0, 1 << 20, 640), rng.integers(0, 1 << 20, 640)
    planes = lambda v, n: np.stack([np.packbits((v >> p & 1).astype(bool), bitorder="little").view(np.uint64) for p in range(n)])
    sums = planes(values, 24)
    lexical.added(sums, planes(more, 20), 2)
    assert (sums == planes(values + (more << 2), 24)).all()
    weights = rng.integers(0, 1 << 15, 10)
    assert (lexical.products(planes(values, 20), weights) == planes(values * np.repeat(weights, 64), 40)[: len(lexical.products(planes(values, 20), weights))]).all()


@pytest.mark.parametrize("where", ["sf0.001", "sf0.01"])
def test_search_against_sql(spark, where):
    folder = f"/root/testdata/{where}"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(f"select item_id, rank, doc_id, score from ({lexical.ORACLE})").fetchall()
    got = [tuple(r) for r in lexical.op12(spark, folder).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want) and got


# --- pages


@pytest.fixture(scope="module")
def weights():
    return pages.own_weights()


def test_pages_of_the_table(spark):
    """The table's pages have one shape, of which a plain pattern reads the article."""

    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())

    for folder in (ROOT, "/root/testdata/sf0.01"):
        rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
        got = {r["page_id"]: r for r in pages.op13(spark, folder).collect()}
        assert len(got) == len(rows)
        for r in rows:
            assert got[r["page_id"]]["text"] == plain(r["html"])
            assert got[r["page_id"]]["n_chars"] == len(plain(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def test_labelled_pages_that_were_not_learnt(weights):
    kept = pages.labelled(200, seed=99)
    assert sum(pages.extract(page, weights) == text for page, text in kept) >= 190


PAGES = [
    (None, ""), ("", ""), ("<!-- nothing -->", ""), ("just text", "just text"), ("<nav><a href=/>Menu</a></nav>", ""),
    ('<div id="cookie-notice"><p>We use cookies on this whole site, accept?</p><button>OK</button></div><header class="site-header"><h1>The News</h1><nav><a>Home</a></nav></header><main><article><h2>Big   story</h2><p>First <a href=x>a link</a>, more&nbsp;text &amp; so on.</p>'
     '<div class="ad"><p>Buy now! Best offers of the whole year.</p></div><p>Second.</p><aside class="related"><ul><li><a>One</a></li></ul></aside><p>Third.<br>after</p></article><section id="comments"><div class="comment"><p>Great article, I liked it.</p></div></section></main><footer><p>Copyright of us all</p></footer>',
     "Big story First a link, more text & so on. Second. Third. after"),
    ('<ul class="menu"><li>Home</li></ul><div class="post-content"><h1>T</h1><p>Hello<b>bold</b>world<p>Next<ul><li>a<li>b</ul><pre>code  x</pre></div><div class="reader-comments"><p>first! a long comment about the post</p></div>', "T Helloboldworld Next a b code x"),
    ("<article><p>x &lt;b&gt; &#39;q&#39; &eacute; 1 < 2</p><form class=newsletter><p>Subscribe to our list now</p></form><p>end</p></article>", "x <b> 'q' é 1 < 2 end"),
    ("<nav>menu</nav><article><p>a<!-- c --><script>if (a<b) '</p>'</script>b</p><style>p</style><p>c</p></article>", "ab c"),
    (f"<article><p>a</p><div class='comments'>{'no ' * 300}</div><p>b</p></article><div class='advert'>{'buy ' * 300}</div>", "a b"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_page_shapes(weights, page, text):
    assert pages.extract(page, weights) == text


def test_page_frames(spark, weights):
    rows = [(i, f"u{i}", p, "x", 1) for i, (p, _) in enumerate(PAGES)] + [(1, None, "<p>again", "x", 1), (None, "u", "<p>no id", "x", 1)]
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3), weights)
    want = [(i, f"u{i}", t) for i, (_, t) in enumerate(PAGES)] + [(1, None, "again"), (None, "u", "no id")]
    assert got.columns == ["page_id", "url", "text"] and Counter(map(tuple, got.collect())) == Counter(want)


def test_own_labelled_pages_are_learnt(spark, weights):
    """A class that the built-in pages do not know."""
    page = '<div class="zork"><p>{}</p></div><div><p>{}</p></div>'
    rows = [(page.format(f"noise number {i} of a kind", f"the text {i} that is meant"), f"the text {i} that is meant") for i in range(300)]
    other = page.format("more noise of that kind here", "what it says")
    assert "noise" in pages.extract(other, weights)
    assert pages.extract(other, pages.fit(spark.createDataFrame(rows, "html string, text string"))) == "what it says"


@pytest.mark.parametrize("page", ["<div>" * 50_000, "<p>x " * 50_000, "<" * 300_000, '<a href="' * 50_000, "<!-- " * 100_000, "<script>" * 50_000, "word " * 500_000, "<div>" * 20_000 + "</x>" * 20_000, "<p>" + "<font>" * 20_000 + "</p>x" * 20_000])
def test_time_grows_with_the_page(weights, page):
    started = time.time()
    pages.extract(page, weights)
    assert time.time() - started < 20


def test_region_is_the_greatest_sum():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        start, end = pages.best_region(scores)
        assert sum(scores[start:end]) == max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
