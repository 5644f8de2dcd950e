"""HTML extraction with a site style tree.

All pages of a host are merged into one tree: nodes are the block elements by their path of labels (element, class, id
and role without digits). For each node the tree knows on how many pages it stands, how its presentation varies (the
row of its child labels) and how its content varies (its texts). Presentation importance is the entropy of the rows of
children over pages; content importance is one less the mean entropy of a text's spread over pages, so a text on every
page counts 0 and a text of its own on each counts 1. A branch's importance on a page is the mean of its parts' by
length, blended with its presentation importance. Branches of low importance are removed; what is left is the text.

Names and elements are further evidence. What names itself as navigation, a notice, an advert, a form or comments goes,
as does all outside an article or main element on pages that have one. The tree sets bounds to both:

* Inside an article a branch of low importance goes, such as an unnamed line, if it stands in half of the site's articles
  or more and most of the site's text at the article's nodes is important. Where that isn't so, articles are near-copies,
  all or a group of them, and importance can't tell their text from what stands around it. Paragraphs, headings, rows and
  items go only along with the branch that holds them, and no branch of headings alone goes, since headings and labels
  are alike in many articles.
* Where names leave less than a tenth of a host's text, one that holds nine tenths of a page's important text, with an
  article or a first heading in it, is wrong, such as a form around the whole page. Navigation, footers and asides that
  are elements are never taken for text.

The tree is made of counts: pages of a host with the same texts count once, and a host's pages need not meet in one
task. Statistics with up to `most` nodes are sent to the tasks; beyond that they are joined to each page's nodes, and
the page's few rows come back to it by its row number.

Null and empty pages have empty text. Pages without a host in their url are one site. Repeated rows are extracted each.
An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved, tune, utf8
from tessera.llm.html import NOISE_TAGS, Page, parse

MOST = 100_000
GAMMA, THRESHOLD, FEW = 0.9, 0.35, 8
#: Percent of a host's or page's text: names that leave less are doubted.
LEFT = 10
#: Elements that go only along with what holds them, inside an article.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = HEADINGS | frozenset("p hgroup pre blockquote li dt dd tr td th tbody thead tfoot caption figcaption legend summary".split())
_HOST = re.compile(r"^[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/?#:]*)")

#: By host and node: pages, presentation and content importance, mean length of an article's node, and for the root the
#: mean percent of text that names leave.
Stats = dict[tuple[str, int], tuple[int, float, float, float, float]]
UNKNOWN = (0, 1.0, 1.0, 0.0, 100.0)


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def features(page: Page) -> tuple[int, list[tuple[int, int, int]]]:
    """A hash of the page's texts, and its (node, kind, feature): 0 a node, 1 its presentation, 2 a text of it,
    3 the percent of the page's text that no name excludes, 4 the length of an article's node."""
    children: dict[int, list[str]] = {}
    for n in page.nodes[1:]:
        row = children.setdefault(page.nodes[n.parent].key, [])
        if not row or row[-1] != n.label:
            row.append(n.label)
    keys = {n.key for n in page.nodes}
    out = {(k, 0, 0) for k in keys}
    out |= {(k, 1, _hash("\n".join(children.get(k, [])))) for k in keys}
    out |= {(page.nodes[n].key, 2, _hash(t)) for n, t in page.blocks}
    plain = [t for n, t in page.blocks if not page.nodes[n].noise]
    total, left = sum(len(t) for _, t in page.blocks), sum(map(len, plain))
    if total:
        out.add((0, 3, 100 * left // total))
    lengths: dict[int, int] = {}
    for n, t in page.blocks:
        if page.nodes[n].article:
            lengths[page.nodes[n].key] = lengths.get(page.nodes[n].key, 0) + len(t)
    out |= {(k, 4, x) for k, x in lengths.items()}
    return _hash("\n".join(plain if 100 * left >= LEFT * total else [t for _, t in page.blocks])), sorted(out)


def site_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content, length, plain over pages(host, html)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("node", pa.int64()), ("kind", pa.int8()), ("feature", pa.int64())]))
        for b in batches:
            got = [features(parse(t.as_py().decode("utf-8", "replace"))) for t in b.column(1)]
            rows = [[dict(zip(("node", "kind", "feature"), x, strict=True)) for x in f] for _, f in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in got], pa.int64()), pa.array(rows, kind)], ["host", "texts", "rows"])

    seen = pages.mapInArrow(run, "host string, texts long, rows array<struct<node:long,kind:tinyint,feature:long>>")
    # of pages with the same texts the one whose rows have the smallest hash, so that the tree is the same each time
    once = seen.groupBy("host", "texts").agg(F.min_by("rows", F.struct(F.xxhash64("rows"), F.size("rows"))).alias("rows"))
    counts = once.select("host", F.explode("rows").alias("x")).groupBy("host", "x.node", "x.kind", "x.feature").agg(F.count("*").cast("double").alias("n"))
    of = lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    n, spread = F.col("n"), F.col("n") * F.log("n")
    sums = counts.groupBy("host", "node").agg(of(0, n).alias("m"), of(1, spread).alias("styles"), of(2, n).alias("texts"), of(2, spread).alias("spread"), of(4, n * F.col("feature")).alias("length"), (of(3, n * F.col("feature")) / of(3, n)).alias("plain"))
    m = F.greatest(F.col("m"), F.lit(2.0))
    return sums.select("host", "node", F.col("m").cast("long").alias("pages"), (1 - F.coalesce(F.col("styles") / F.col("m"), F.lit(0.0)) / F.log(m)).alias("presentation"), F.coalesce(1 - F.col("spread") / F.col("texts") / F.log(m), F.lit(1.0)).alias("content"), F.coalesce(F.col("length") / F.col("m"), F.lit(0.0)).alias("length"), F.coalesce("plain", F.lit(100.0)).alias("plain"))


def _noise(page: Page, held: list[float], pages: int, plain: float) -> list[bool]:
    """For each node whether it is noise by its names or those around it, where the host's tree doesn't overrule them.
    held is the important text of each node itself."""
    nodes = page.nodes
    noise = [n.noise for n in nodes]
    if pages < FEW or plain >= LEFT:
        return noise
    inside, clear, tells = held[:], held[:], [False] * len(nodes)  # clear: not under a further name
    tag = [n.label.partition(" ")[0] for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        tells[i] = tells[i] or not n.named and (tag[i] == "h1" or n.article and not nodes[n.parent].article)
        inside[n.parent] += inside[i]
        clear[n.parent] += 0 if n.named else clear[i]
        tells[n.parent] = tells[n.parent] or tells[i]
    least = inside[0] * LEFT / 100
    seen = clear[0] >= least
    for i, n in enumerate(nodes[1:], 1):
        wrong = n.named and not seen and not noise[n.parent] and inside[i] >= inside[0] - least and tells[i] and (tag[i] == "form" or tag[i] not in NOISE_TAGS)
        if wrong:
            seen = clear[i] >= least
        noise[i] = noise[n.parent] or n.named and not wrong
    return noise


def extract(page: Page, site: str, stats: Stats) -> str:
    """The text of the branches that matter."""
    nodes = page.nodes
    own = [0] * len(nodes)
    for n, t in page.blocks:
        own[n] += len(t)
    children: dict[int, list[int]] = {}
    for i, n in enumerate(nodes[1:], 1):
        children.setdefault(n.parent, []).append(i)
    importance, length, held, dull = [0.0] * len(nodes), [0] * len(nodes), [0.0] * len(nodes), [False] * len(nodes)
    sizes, texts = [(0.0, 1.0, 0)] * len(nodes), [False] * len(nodes)  # texts: more than headings
    for i in range(len(nodes) - 1, -1, -1):  # children stand behind their parents
        pages, presentation, content, usual, _ = stats.get((site, nodes[i].key), UNKNOWN)
        if pages < FEW:
            presentation = content = 1.0
        sizes[i] = (float(own[i]) if pages < FEW else usual, content, pages)
        below = children.get(i, [])
        parts = [(content, own[i])] + [(importance[c], length[c]) for c in below]
        length[i] = sum(x for _, x in parts)
        inner = sum(v * x for v, x in parts) / length[i] if length[i] else 0.0
        share = GAMMA ** len({nodes[c].key for c in below})
        importance[i] = (1 - share) * presentation + share * inner
        held[i] = content * own[i]
        dull[i] = importance[i] < THRESHOLD and all(dull[c] or not length[c] for c in below)
        texts[i] = own[i] > 0 and nodes[i].label.partition(" ")[0] not in HEADINGS or any(texts[c] for c in below)
    root = stats.get((site, nodes[0].key), UNKNOWN)
    noise = _noise(page, held, root[0], root[-1])
    has_article = any(n.article and not x for n, x in zip(nodes, noise, strict=True))
    good = _inside_articles(page, noise, sizes, [d and t for d, t in zip(dull, texts, strict=True)]) if has_article else [True] * len(nodes)
    if not has_article:
        for i, n in enumerate(nodes[1:], 1):
            good[i] = good[n.parent] and not noise[i] and importance[i] >= THRESHOLD
    kept = [t for n, t in page.blocks if good[n]]
    if not kept:
        kept = [t for n, t in page.blocks if not noise[n] and (nodes[n].article or not has_article)]
    return "\n".join(kept)


def _inside_articles(page: Page, noise: list[bool], sizes: list[tuple[float, float, int]], dull: list[bool]) -> list[bool]:
    """For each node whether its text belongs to an article: text outside of all elements does, noise doesn't. sizes are
    a node's length, its content importance and its pages; from FEW pages on they are the tree's and count once a page."""
    nodes = page.nodes
    top = [-1] * len(nodes)  # the outermost article around a node
    total, important = [0.0] * len(nodes), [0.0] * len(nodes)
    counted: set[tuple[int, int]] = set()
    for i, n in enumerate(nodes):
        if n.article and not noise[i]:
            at = top[i] = i if top[n.parent] < 0 else top[n.parent]
            size, content, pages = sizes[i]
            if pages >= FEW and (at, n.key) in counted:
                continue
            counted.add((at, n.key))
            total[at] += size
            important[at] += size * content
    good = [True] + [x >= 0 for x in top[1:]]
    for i, n in enumerate(nodes[1:], 1):
        if good[i] and top[i] != i:
            # near-copies vary as little as boilerplate: there nothing goes, and nothing that only a group of them has
            at, part = top[i], n.label.partition(" ")[0] in PARTS
            good[i] = good[n.parent] and (part or not dull[i] or 2 * important[at] < total[at] or 2 * sizes[i][2] < sizes[at][2])
    return good


def extract_text(pages: DataFrame, most: int = MOST) -> DataFrame:
    """For each row of pages(page_id, url, html): page_id, url, text, n_chars."""
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("html"))
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1))
    tree = saved(site_tree(rows.select(site.alias("host"), "html")), "tree")
    schema = "page_id long, url string, text string, n_chars long"
    if tree.count() <= most:
        found: Stats = {(r.host, r.node): (r.pages, r.presentation, r.content, r.length, r.plain) for r in tree.collect()}
        sent = spark.sparkContext.broadcast(found)
        return rows.select("page_id", "url", "html", site.alias("host"), F.lit(None).cast("array<struct<node:long,pages:long,presentation:double,content:double,length:double,plain:double>>").alias("stats")).mapInArrow(lambda b: _extracted(b, sent), schema)
    numbered = saved(rows.select("page_id", "url", "html", site.alias("host"), F.monotonically_increasing_id().alias("row")), "pages")
    nodes = numbered.select("row", "host", "html").mapInArrow(_nodes, "row long, host string, node long")
    stats = nodes.join(tree, ["host", "node"]).groupBy("row").agg(F.collect_list(F.struct("node", "pages", "presentation", "content", "length", "plain")).alias("stats"))
    return numbered.join(stats, "row", "left").select("page_id", "url", "html", "host", "stats").mapInArrow(lambda b: _extracted(b, None), schema)


def _nodes(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        out: list[list] = [[], [], []]
        for row, site, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            keys = {n.key for n in parse(t.as_py().decode("utf-8", "replace")).nodes}
            for column, x in zip(out, ([row] * len(keys), [site] * len(keys), keys), strict=True):
                column.extend(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["row", "host", "node"])


def _extracted(batches: Iterator, sent) -> Iterator:
    import pyarrow as pa

    for b in batches:
        texts = []
        for t, site, own in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            stats = sent.value if sent is not None else {(site, x["node"]): (x["pages"], x["presentation"], x["content"], x["length"], x["plain"]) for x in own or []}
            texts.append(extract(parse(t.as_py().decode("utf-8", "replace")), site, stats))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
