"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a sequence of tags and runs of words. Words score positive and tags negative, with weights counted over labelled pages: how
often such a word is main text, and how often such a tag stands outside it. One linear scan finds the contiguous region with
the highest sum; it is the main text, without elements inside it whose names stand outside the main text elsewhere.

Labelled are the pages with one ``article`` or ``main`` element of their own: its words are main text, the others aren't. :func:`learn`
counts, over all of them, in one pass with partial sums,

* for each name of an element (each whole value of class, id and role, and its tag, if that isn't a ``GENERIC`` one like ``div`` or ``li``), on
  how many pages it stands inside and outside;
* for each tag, how often it stands inside and outside;
* the same for words and tags of such pages that are in the article, and that are beside it.

So on a page with an article, what is beside it scores next to nothing, whatever its names, and is left out of a region that holds words of articles. On other
pages the names decide (with the sample's article tags renamed, all texts still come out the same): a word
scores by the worst name around it, a tag by its own counts. ``PRIOR`` pages are added to the counts of names in common use
(``PRIOR_OUT``), also as all parts of a longer name (``site-footer``, but not ``entry-header``), or, for ``ZONES``, as any part of one (``reader-comments``,
``cookie-notice-wrapper``, but not ``has-sidebar`` or ``comments-open``); what the pages show goes against them. Names that no page shows say nothing. An element is outside if its name's log-odds are below -``SURE``; ``html`` and ``body``
never are. Articles in outside elements count only if a page has no other article.

Counts of the ``kept`` most frequent names are sent to the executors; pages with other names get theirs from a table, joined by name.

Text: character references are decoded, white space inside a block is one space, blocks are joined by one newline in page
order, empty blocks are left out. Null or empty html gives an empty text; unclosed elements end with the page; a tag or comment
cut by the end of the page is dropped. A page is held whole by one worker. Rows are independent, repeated rows give repeated results. An empty
table gives an empty result, and its weights are the priors alone. Other columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import lean, materialise

PIECE = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*+(?:>|\Z)|</?[A-Za-z][^>]*+\Z""",
    re.S,
)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "textarea", "noscript", "title", "iframe")}
# fixed values: elements by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: names of elements in common use that stand outside the main text, as pseudo-counts
PRIOR_OUT = frozenset(
    """nav header footer aside form menu head button select dialog sidebar breadcrumb breadcrumbs navbar navigation toolbar topbar notice cookie cookies consent
    gdpr alert popup modal newsletter subscribe signup ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion comment comments disqus
    reply replies respond discussion social share sharing related recommended widget complementary contentinfo search pagination pager copyright legal skip""".split()
)
ARTICLE = frozenset("article main".split())
#: those of them that make any longer name outside, whatever its other parts are
ZONES = frozenset(
    """nav navigation navbar sidebar breadcrumb breadcrumbs toolbar topbar notice cookie cookies consent gdpr popup modal newsletter subscribe signup ad ads advert
    adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus social share sharing related recommended pagination pager""".split()
)
#: parts that tell of a layout or a state instead (``has-sidebar``, ``comments-open``, ``sidebar-layout``)
STATES = frozenset(
    "has no with without not is show hide hidden open closed enabled disabled wrap layout template theme content free".split()
)
#: parts of a class name or id that leave the rest its meaning
PARTS = frozenset(
    "site page main global left right top bottom primary secondary block box bar item items links list posts section slot unit".split()
)
#: what may be glued to a zone (``commentlist``)
GLUED = re.compile(rf"({'|'.join(sorted(x for x in ZONES if len(x) > 5))})(list|form|box|area|bar|block|body|thread|wrapper|container|section)")
PRIOR = 40
KEPT = 1000
SURE = 3.0
#: fixed values: tags that say nothing of what stands in them; only their class, id and role do
GENERIC = (P_ENDERS - PRIOR_OUT - ARTICLE) | INLINE | frozenset(
    "html body div center li dd dt figcaption summary caption colgroup tbody td tfoot th thead tr".split()
)
IN, OUT, PLAIN = "in", "out", ""


@dataclass(frozen=True)
class Weights:
    names: dict[str, float]  # log-odds of elements' names
    tags: dict[str, float]
    words: dict[str, float]  # of a word, by place: in an article, or beside it
    places: dict[str, float]  # of a tag, by place
    rest: DataFrame | None = None  # kind, name, inside, outside of what isn't in ``names`` and ``tags``

    def of_name(self, name: str) -> float:
        return self.names[name] if name in self.names else log_odds(name, 0, 0)

    def of_tag(self, name: str, place: str) -> float:
        return self.places[place] if place else self.tags.get(name, tag_weight(0, 0))


def tag_weight(inside: int, outside: int) -> float:
    return -(0.05 + 0.95 * (outside + 1) / (inside + outside + 2))


def log_odds(name: str, inside: int, outside: int) -> float:
    return max(-6.0, min(6.0, math.log((inside + 1) / (outside + 1 + PRIOR * common_outside(name)))))


@lru_cache(maxsize=1 << 14)
def common_outside(name: str) -> bool:
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    if any(x in ZONES or GLUED.fullmatch(x) for x in parts) and not STATES.intersection(parts):
        return True
    return any(x in PRIOR_OUT for x in parts) and all(x in PRIOR_OUT or x in PARTS or x.isdigit() for x in parts)


def weigh(counts: dict[tuple[str, str], tuple[int, int]]) -> Weights:
    """``counts``: (inside, outside) of each (kind, name); kinds: name, tag, and word and place by IN and OUT."""

    def of(kind: str) -> dict[str, tuple[int, int]]:
        return {n: c for (k, n), c in counts.items() if k == kind}

    prior = {IN: (20, 0), OUT: (0, 20)}

    def by_place(kind: str) -> dict[str, tuple[int, int]]:
        got = of(kind)
        return {x: tuple(p + q for p, q in zip(prior[x], got.get(x, (0, 0)), strict=True)) for x in prior}

    return Weights(
        {n: log_odds(n, *c) for n, c in of("name").items()},
        {n: tag_weight(*c) for n, c in of("tag").items()},
        {x: (a + 1) / (a + b + 2) for x, (a, b) in by_place("word").items()},
        {x: tag_weight(a, b) for x, (a, b) in by_place("place").items()},
    )


@dataclass
class Page:
    """``seq``: (kind, value, element) with kind ``word`` (raw text) or ``tag`` (the element's tag)."""

    seq: list[tuple[str, str, int]]
    tags: list[str]  # of each element; element 0 is the page
    names: list[tuple[str, ...]]  # of each element
    parents: list[int]

    def judge(self, w: Weights) -> tuple[list[str], list[float]]:
        """Place of each element, and the worst log-odds of names from it up to its article, or to the page."""
        own = [
            min(map(w.of_name, n), default=0.0) if t not in ("html", "body") else 0.0 for t, n in zip(self.tags, self.names, strict=True)
        ]
        article = [t in ARTICLE and own[i] >= -SURE for i, t in enumerate(self.tags)]
        worst, found = [0.0] * len(own), [False] * len(own)
        for i in range(1, len(own)):
            p = self.parents[i]
            worst[i], found[i] = min(own[i], worst[p]), found[p] or article[i]
        free = [a and worst[i] >= -SURE for i, a in enumerate(article)]
        if not any(free):  # those in outside elements then, each for itself
            free = [a and not found[self.parents[i]] for i, a in enumerate(article)]
        place = [OUT if any(free) else PLAIN] * len(own)
        worst = [0.0] * len(own)
        for i in range(1, len(own)):
            p = self.parents[i]
            place[i] = IN if free[i] else place[p]
            worst[i] = own[i] if free[i] and place[p] != IN else min(own[i], worst[p])
        return place, worst


def parse(page: str) -> Page:
    out = Page([], [""], [()], [-1])
    stack = [0]
    at, end = 0, len(page)
    while at < end:
        m = PIECE.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            out.seq.append(("word", page[at:stop], stack[-1]))
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["end"]:
            closed = stack[-1]
            for k in range(len(stack) - 1, 0, -1):
                if out.tags[stack[k]] == name:
                    closed = stack[k]
                    del stack[k:]
                    break
            out.seq.append(("tag", name, closed))
            continue
        if name in P_ENDERS:  # a paragraph ends where a block begins
            for k in range(len(stack) - 1, 0, -1):
                tag = out.tags[stack[k]]
                if tag == "p":
                    del stack[k:]
                if tag in P_ENDERS:
                    break
        names = [] if name in GENERIC or name in ARTICLE else [name]
        for x in ATTR.finditer(m["attrs"] or ""):
            names += (x[1] or x[2] or x[3] or "").lower().split()
        out.tags.append(name)
        out.names.append(tuple(dict.fromkeys(names)))
        out.parents.append(stack[-1])
        out.seq.append(("tag", name, len(out.tags) - 1))
        if name in CLOSE:
            raw = CLOSE[name].search(page, at)
            at = raw.end() if raw else end
        elif name not in VOID and not (m["attrs"].endswith("/") and name in ("svg", "path")):
            stack.append(len(out.tags) - 1)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[a, z) of the highest sum; the first and shortest of equals; (0, 0) if no sum is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for k, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += x
        if run > best + 1e-9:
            best, found = run, (start, k + 1)
    return found


def score(page: Page, place: list[str], worst: list[float], w: Weights) -> list[float]:
    """Words positive, tags negative. In an article, words of outside elements count nothing."""
    out = []
    for kind, value, i in page.seq:
        if kind == "tag":
            out.append(w.of_tag(value, place[i]))
        elif place[i] == PLAIN:
            out.append(len(value.split()) * min(1.0, 2.0 / (1.0 + math.exp(-worst[i]))))
        else:
            out.append(len(value.split()) * w.words[place[i]] * (worst[i] >= -SURE or place[i] == OUT))
    return out


def extract(html_text: str | None, w: Weights, whole: bool = False) -> str:
    """The main text; with ``whole`` the page takes the place of the best region."""
    if not html_text:
        return ""
    page = parse(html_text)
    place, worst = page.judge(w)
    a, z = (0, len(page.seq)) if whole else best_region(score(page, place, worst, w))
    blocks: list[str] = []
    run: list[str] = []
    articles = not whole and any(kind == "word" and place[i] == IN for kind, _, i in page.seq[a:z])
    for kind, value, i in page.seq[a:z]:
        if kind == "word":
            if worst[i] >= -SURE and place[i] != OUT or place[i] == OUT and not articles:
                run.append(value)
        elif value == "br":
            run.append(" ")
        elif value not in INLINE:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


BARE = weigh({})


def label_counts(html_text: str) -> Counter:
    """(kind, name, inside) counts of a labelled page; else empty. What stands in an article's outside elements, as far as their names
    are in common use, isn't main text."""
    out: Counter = Counter()
    page = parse(html_text)
    place, worst = page.judge(BARE)
    tops = [i for i in range(1, len(place)) if place[i] == IN and place[page.parents[i]] != IN]
    if len(tops) != 1:
        return out
    above, i = {0}, page.parents[tops[0]]
    while i > 0:
        above.add(i)
        i = page.parents[i]
    seen: set[int] = set()
    for kind, value, i in page.seq:
        main = place[i] == IN and worst[i] >= -SURE
        if kind == "tag":
            out["tag", value, main] += 1
            out["place", place[i], main] += 1
        elif n := len(value.split()):
            out["word", place[i], main] += n
            while i not in seen and i not in above:
                seen.add(i)
                i = page.parents[i]
    for name, main in {(x, place[i] == IN and worst[i] >= -SURE) for i in seen - set(tops) for x in page.names[i]}:
        out["name", name, main] += 1
    return out


def learn(pages: DataFrame, kept: int = KEPT) -> Weights:
    """Weights from all pages of ``pages`` (html) that label themselves. The counts of the ``kept`` most frequent names and tags reach the
    driver; those of all others are a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total.update(label_counts(page or ""))
                if len(total) > 20_000:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    def rows(total: Counter) -> pa.RecordBatch:
        k = list(total)
        kinds, names = (pa.array([x[i] for x in k], pa.string()) for i in (0, 1))
        sides = (pa.array([int(total[x]) * (x[2] == side) for x in k], pa.int64()) for side in (True, False))
        return pa.RecordBatch.from_arrays([kinds, names, *sides], names=["kind", "name", "inside", "outside"])

    counts = pages.select("html").mapInArrow(lean(run), "kind string, name string, inside long, outside long")
    counts = counts.groupBy("kind", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    counts = materialise(counts, "names")
    order = [F.col("kind").isin("name", "tag"), F.desc(F.col("inside") + F.col("outside")), "kind", "name"]
    got = counts.orderBy(*order).limit(kept + 5).collect()  # four rows aren't names or tags
    more, got = len(got) > kept + 4, got[: kept + 4]
    w = weigh({(r["kind"], r["name"]): (r["inside"], r["outside"]) for r in got})
    return replace(w, rest=counts.where(F.col("kind").isin("name", "tag"))) if more else w


SCHEMA = "page_id long, url string, text string, n_chars long"
MORE = "array<struct<kind:string,name:string,inside:bigint,outside:bigint>>"


def with_rare_names(pages: DataFrame, weights: Weights) -> DataFrame:
    """``pages`` (page_id, url, html) with more: counts of each page's names and tags that only the table has; such pages are joined by a hash of html."""
    names, tags = frozenset(weights.names), frozenset(weights.tags)

    def rare(page: str | None) -> list[str]:
        known = parse(page or "")
        found = {f"name {x}" for n in known.names for x in n if x not in names}
        return sorted(found | {f"tag {v}" for kind, v, _ in known.seq if kind == "tag" and v not in tags})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rare(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(found, pa.list_(pa.string()))],
                names=["page_id", "url", "html", "names"],
            )

    rows = pages.mapInArrow(lean(run), "page_id long, url string, html string, names array<string>").withColumn("k", F.sha2("html", 256))
    some = rows.where(F.size("names") > 0)
    rest = weights.rest.select(F.concat_ws(" ", "kind", "name").alias("key"), F.struct("kind", "name", "inside", "outside").alias("counts"))
    found = some.select("k", F.explode("names").alias("key")).distinct().join(rest, "key").groupBy("k").agg(
        F.collect_list("counts").alias("more")
    )
    plain = rows.where(F.size("names") == 0).select("page_id", "url", "html", F.lit(None).cast(MORE).alias("more"))
    return plain.unionByName(some.join(found, "k", "left").select("page_id", "url", "html", F.col("more").cast(MORE).alias("more")))


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    own = replace(weights, rest=None)

    def of_page(more: list[dict] | None) -> Weights:
        if not more:
            return own
        names = {x["name"]: log_odds(x["name"], x["inside"], x["outside"]) for x in more if x["kind"] == "name"}
        tags = {x["name"]: tag_weight(x["inside"], x["outside"]) for x in more if x["kind"] == "tag"}
        return replace(own, names=own.names | names, tags=own.tags | tags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, pages = b.column(0), b.column(1), b.column(2).to_pylist()
            more = b.column(3).to_pylist() if b.num_columns > 3 else [None] * len(pages)
            for a in range(0, len(pages), 500):
                texts = [extract(p, of_page(x)) for p, x in zip(pages[a : a + 500], more[a : a + 500], strict=True)]
                cols = [
                    ids.slice(a, len(texts)),
                    urls.slice(a, len(texts)),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return (rows if weights.rest is None else with_rare_names(rows, weights)).mapInArrow(lean(run), SCHEMA)
