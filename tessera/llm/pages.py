"""Main text of web pages by maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive and tags negative, by name; an element whose names,
classes and ids the labelled pages show to hold boilerplate scores negative as a whole, words included. All weights come from
labelled pages: an element's by logistic regression over the words below it (features: its and its ancestors' tag names and
the words of their class, id and role), a tag's by how much denser it stands outside of main text than inside. One linear
scan finds the contiguous region with the greatest sum. Boilerplate within it is left out, and the rest is put together
block by block.

`labelled` makes labelled pages of many shapes from lists of the names that page authors give to things; a caller's own
(html, text) rows can be fitted too (`fit`; at most `pages` of them are taken, which bounds what reaches the driver).

Defined results: a null or empty page, and one without a word of main text, give the empty text; repeated pages and pages
without an id keep their rows; columns other than id, url and html are not read; an empty table gives an empty result. What
a browser does not show (scripts, styles, comments, head, templates) is no text. Unclosed elements end where their parent
ends; an end tag that closes nothing is ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, read, texts

#: Elements whose content is no markup, or is never shown; elements without content; elements that stand in a
#: line of text (all others, and br, end a block); elements that a new one of the same list ends.
RAW = "script style noscript template textarea title iframe svg math select option datalist object canvas audio video".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: A start tag of one of these ends an open p.
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What a tag costs at least and at most, and a boilerplate element that lies within main text, in words. A block of one word
#: must outweigh its own tags.
LEAST_COST, MOST_COST, GAP_COST = 0.02, 8.0, 0.5
#: Elements that an end tag does not reach out of: a stray </p> in a cell closes nothing outside of it.
WALLS = {"article", "main", "nav", "aside", "footer", "header", "section", "form", "table", "body"}

#: A quote opens a value only behind "="; what is not closed reaches to the page's end. No part is tried twice, so that the
#: time is in proportion to the page.
ATTRIBUTES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)"
PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>]){ATTRIBUTES}.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+){ATTRIBUTES}",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


@dataclass
class Run:
    """Words that stand together, or one tag."""

    tag: str  #: name of the tag, '' for words
    text: str  #: the words as they stand
    block: int  #: number of the block they stand in
    features: frozenset  #: of all elements they stand in


def features_of(name: str, parent: str, attributes: str) -> frozenset:
    """Its name, alone and below its parent's (not of elements that only set type), and the words that name it."""
    found = [] if name in INLINE and name != "a" else [f"<{name}>", f"<{parent}><{name}>"]
    for m in NAMES.finditer(attributes):
        found += [w.lower() for w in NAME_WORD.findall(m[1] or m[2] or m[3] or "")]
    return frozenset(found)


def runs(page: str) -> list[Run]:
    """The page as words and tags, each with the features of the elements it stands in."""
    out: list[Run] = []
    open_: list[tuple[str, frozenset]] = []  # element, features of it and all around it
    many: Counter[str] = Counter()  # open elements by name: no search for what is not open
    around: frozenset = frozenset()
    block, at, hidden = 0, 0, False

    def close(names: set[str], walls: set[str]) -> None:
        nonlocal around
        if not any(many[n] for n in names):
            return
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in names:
                many.subtract(o[0] for o in open_[i:])
                del open_[i:]
                break
            if open_[i][0] in walls:
                break
        around = open_[-1][1] if open_ else frozenset()

    for m in PART.finditer(page):
        if m.start() > at and not hidden:
            out.append(Run("", page[at : m.start()], block, around))
        at = m.end()
        ends, name, attributes = m[3], (m[4] or "").lower(), m[5]
        if not name:  # comments, declarations and what is never shown
            continue
        if name in ("head", "body"):
            hidden = name == "head" and not ends
        if name not in INLINE:
            block += 1
        if ends:  # an end tag is still of its element
            out.append(Run(f"/{name}", "", block, around))
            close({name}, WALLS - {name} if name not in WALLS else set())
            continue
        if name in ENDS:
            close(ENDS[name], WALLS | {"ul", "ol", "dl"} | ({"li"} if name == "p" else set()))
        if name in ENDS_P:
            close({"p"}, WALLS | {"ul", "ol", "dl", "table", "div"})
        own = features_of(name, open_[-1][0] if open_ else "", attributes)
        out.append(Run(name, "", block, around | own))
        if name not in VOID and not attributes.endswith("/"):
            around = around | own
            open_.append((name, around))
            many[name] += 1
    if at < len(page) and not hidden:
        out.append(Run("", page[at:], block, around))
    return out


@dataclass
class Weights:
    """bias and elements: log odds that words below an element are main text; tags: what a tag adds, in words (below 0)."""

    bias: float
    elements: dict[str, float]
    tags: dict[str, float]

    def of(self, features: frozenset) -> float:
        get = self.elements.get
        return self.bias + sum(get(f, 0.0) for f in features)


def marked(page: str, text: str) -> list[tuple[Run, int, bool]]:
    """The runs of a labelled page with their number of words and whether these stand next in the text; a tag lies where the
    words after it lie, and outside if none follow."""
    want, at = text.split(), 0
    out = []
    for r in runs(page):
        words = html.unescape(r.text).split() if not r.tag else []
        inside = bool(words) and want[at : at + len(words)] == words
        at += len(words) * inside
        out.append((r, len(words), inside))
    after = False
    for i in range(len(out) - 1, -1, -1):
        r, n, inside = out[i]
        after = inside if n else after
        out[i] = (r, n, after if r.tag else inside)
    return out


def regression(counts: dict[frozenset, np.ndarray], rounds: int, rate: float, decay: float) -> tuple[float, dict[str, float]]:
    """Bias and a weight for each feature, from (outside, inside) counts of runs by their set of features."""
    names = sorted({f for s in counts for f in s})
    place = {f: i for i, f in enumerate(names)}
    c = np.array(list(counts.values()))
    of, features = np.array([(i, place[f]) for i, s in enumerate(counts) for f in s], np.int64).reshape(-1, 2).T
    n, y = np.log1p(c.sum(axis=1)), c[:, 1] / c.sum(axis=1)
    w, first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):  # Adam
        sums = np.bincount(of, w[features], minlength=len(c)) + w[-1]
        gap = n * (1 / (1 + np.exp(-sums)) - y) / n.sum()
        grad = np.append(np.bincount(features, gap[of], minlength=len(names)) + decay * w[:-1], gap.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return float(w[-1]), dict(zip(names, w[:-1].tolist(), strict=True))


def learn(pages: Iterable[tuple[str, str]], rounds: int = 600, rate: float = 0.1, decay: float = 1e-5) -> Weights:
    """Weights from (html, main text)."""
    known = [marked(page, text) for page, text in pages if page and text]
    counts: dict[frozenset, np.ndarray] = {}
    for page in known:
        for r, n, inside in page:
            if n:
                counts.setdefault(r.features, np.zeros(2))[int(inside)] += 1
    out = Weights(*regression(counts, rounds, rate, decay), {})
    # the cost of a tag outside of boilerplate: how much denser it stands outside of main text than inside
    tags, words = {}, np.ones(2)
    main = {f: out.of(f) > 0 for f in {r.features for page in known for r, _, _ in page}}
    for page in known:
        for r, n, inside in page:
            if main[r.features]:
                words[int(inside)] += n
                if r.tag:
                    tags.setdefault(r.tag, np.zeros(2))[int(inside)] += 1
    density = {t: (c + 0.5) / words.sum() for t, c in tags.items()}
    out.tags = {t: -float(np.clip(np.log(d[0] / d[1]), LEAST_COST, MOST_COST)) for t, d in density.items()}
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous region with the greatest sum; the first of equals; empty if no score is above 0."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def extract(page: str | None, weights: Weights) -> str:
    """The main text: decoded, white space in a block as one space, blocks joined by one space."""
    if not page:
        return ""
    sequence = runs(page)
    scores, kept = [], []
    known: dict[frozenset, bool] = {}
    gap = False
    for r in sequence:
        main = known.get(r.features)
        if main is None:
            main = known[r.features] = weights.of(r.features) > 0
        text = html.unescape(r.text) if main and not r.tag else None
        kept.append(text)
        if not main:  # an element of boilerplate counts once, however long it is
            scores.append(0.0 if gap else -GAP_COST)
        else:
            scores.append(weights.tags.get(r.tag, -LEAST_COST) if r.tag else float(len(text.split())))
        gap = not main
    start, end = best_region(scores)
    blocks: list[str] = []
    last = None
    for r, text in zip(sequence[start:end], kept[start:end], strict=True):
        if text is None:
            continue
        if r.block == last:
            blocks[-1] += text
        else:
            blocks.append(text)
            last = r.block
    return " ".join(" ".join(b.split()) for b in blocks if b.strip())


#: Names that authors give to what is no main text, and to what is.
ASIDE_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu pagination pager skip toc tabs".split(),
    "header": "header masthead topbar siteheader logo branding banner".split(),
    "footer": "footer copyright colophon sitefooter legal bottom contentinfo".split(),
    "aside": "sidebar aside widget related recommended popular trending tags tagcloud rail complementary".split(),
    "div": "ad ads advert advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup share sharing social login paywall disclaimer".split(),
    "section": "comments comment commentlist replies reply respond disqus discussion reviews".split(),
    "form": "search searchform form login contact subscribe".split(),
}
MAIN_NAMES = "content main article post entry story body text page primary maincontent articlebody postcontent entrycontent".split()
PREFIXES = "site top page left right block js box inner the".split()
SYLLABLES = "ka lo mi ra ten sol vi dor pa ne tu ler osh ing bel".split()
BLOCKS = [
    "<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{} <a href=/x>{}</a> {}</p>", "<p><a href=/x>{}</a></p>", "<p><b>{}</b> {}</p>", "<p><b>{}<br>", "<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>", "<blockquote><p>{}</p></blockquote>",
    "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>{}</li><li>{} <a href=/x>{}</a></li></ul>", "<ol><li>{}</li><li>{}</li></ol>", "<pre>{}</pre>", "<pre><code>{}</code></pre>", "<table><tr><th>{}</th><th>{}</th></tr><tr><td>{}</td><td>{}</td></tr></table>",
    "<div>{}</div>", "<div><p>{}</p><p>{}</p></div>", "<figure><img src=x><figcaption>{}</figcaption></figure>", "<dl><dt>{}</dt><dd>{}</dd></dl>", "<section><h2>{}</h2><p>{}</p></section>", "<p>{}",
]


def labelled(n: int = 500, seed: int = 13) -> list[tuple[str, str]]:
    """n pages of many shapes with their main text."""
    rng = random.Random(seed)

    def words(least: int, most: int) -> str:
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(least, most)))

    def named(tag: str, names: list[str], inner: str) -> str:
        """An element that tells what it is by its tag, by a name, or by both."""
        name = rng.choice(names)
        if rng.random() < 0.3:
            name = rng.choice([f"{rng.choice(PREFIXES)}-{name}", f"{rng.choice(PREFIXES)}{name.title()}", f"{name}_{rng.randint(1, 9)}", f"{rng.choice(PREFIXES)} {name}"])
        if tag in ("div", "section"):
            tag = rng.choice([tag, "div"])
            return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'
        if rng.random() < 0.3:
            return f"<{tag}>{inner}</{tag}>"
        tag = "div" if rng.random() < 0.4 else tag
        return f'<{tag} {rng.choice(["class", "class", "id", "role"])}="{name}">{inner}</{tag}>'

    def boilerplate(kind: str) -> str:
        links = "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(rng.randint(3, 8)))
        listed = rng.choice([f"<ul>{links}</ul>", re.sub("</?li>", " ", links)])
        inner = {
            "nav": [listed],
            "section": [f"<h3>{words(1, 3)}</h3><div>{words(5, 40)}</div><p>{words(5, 40)}</p>", "".join(f'<div class="comment"><p>{words(5, 40)}</p></div>' for _ in range(rng.randint(1, 5))), "".join(f"<li><b>{words(1, 2)}</b><p>{words(5, 60)}</p></li>" for _ in range(rng.randint(1, 5)))],
            "form": [f"<label>{words(1, 3)}</label><input type=text><button>{words(1, 2)}</button>", f"<p>{words(3, 12)}</p><input type=text>"],
            "aside": [f"<h4>{words(1, 3)}</h4>{listed}<p>{words(3, 25)}</p>", listed, f"<p>{words(3, 40)}</p>", words(3, 30)],
        }.get(kind, [words(3, 30), f"<p>{words(3, 30)}</p>", listed, f"<div><p>{words(3, 20)} <a href=/x>{words(1, 3)}</a></p></div>", f"<h1>{words(1, 3)}</h1>" if kind == "header" else f"<p><a href=/x>{words(2, 9)}</a></p>"])
        return named(kind, ASIDE_NAMES[kind], rng.choice(inner))

    pages = []
    for _ in range(n):
        before = [boilerplate(k) for k in rng.sample(["nav", "header", "div", "form", "aside"], rng.randint(1, 4))]
        after = [boilerplate(k) for k in rng.sample(["footer", "section", "aside", "div", "nav"], rng.randint(1, 4))]
        title = words(2, 8)
        blocks, text = [rng.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>"]).format(title)], [title]
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.15:
                blocks.append(boilerplate(rng.choice(["div", "aside", "nav", "form"])))
            shape = rng.choice(BLOCKS)
            said = [words(1, 40) for _ in range(shape.count("{}"))]
            text += said
            blocks.append(shape.format(*said))
        around = rng.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="@">{}</div>', '<div id="@">{}</div>', '<section class="@">{}</section>', '<article class="@">{}</article>', "<div>{}</div>", "{}"])
        if blocks[0].startswith("<header") and "<article" not in around and "<main" not in around:
            blocks[0] = f"<h1>{title}</h1>"  # a header is the article's own only inside it
        body = "".join(before) + around.replace("@", rng.choice(MAIN_NAMES)).replace("{}", "".join(blocks)) + "".join(after)
        if rng.random() < 0.3:
            body = f'<div id="{rng.choice(["wrapper", "container", "page", "layout", "root"])}">{body}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{body}</body></html>", " ".join(text)))
    return pages


def fit(pages: DataFrame, most: int = 2000, html_col: str = "html", text_col: str = "text") -> Weights:
    """Weights from a table of labelled pages (at most `most` rows of it) beside the pages of `labelled`."""
    own = [(r[0], r[1]) for r in pages.where(F.col(html_col).isNotNull() & F.col(text_col).isNotNull()).select(html_col, text_col).limit(most).collect()]
    return learn([*labelled(), *own])


@cache
def own_weights() -> Weights:
    """Those of the pages of `labelled`."""
    return learn(labelled())


def extracted(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page. Without weights, those of the pages of `labelled`."""
    sent = pages.sparkSession.sparkContext.broadcast(weights or own_weights())

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [extract(t.decode("utf-8", "replace") if t is not None else None, own) for t in texts(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

        return step

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_texts(rows, make, "page_id long, url string, text string", "html")


def op13(spark, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
