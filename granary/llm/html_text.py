"""Main text of web pages: boosted trees over DOM-node features, decoded from the root down.

Every block element is a node with features of itself and its surroundings: density of its subtree,
tokens of its attributes, depth, and its siblings. Boosted trees give the probability that a node
holds main text. The decoder picks the likeliest set of nodes that is closed upwards, so no kept
node lies in a dropped one. Trees are fitted on generated pages, whose labels are known.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.boosting import Boosted
from granary.llm.common import frugal, text_of

TRAIN_PAGES = 800  # generated pages that the trees are fitted on
BATCH = 64  # pages that are parsed at once
NODES = 20_000  # nodes that are scored at once

# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title select option".split())
BLOCKS = set(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "blockquote pre form fieldset figure figcaption address details summary center button label dialog menu".split()
)
OPTION_END = re.compile(r"<(?:/?(?:option|optgroup|select|datalist)|/?(?:" + "|".join(sorted(BLOCKS)) + r"))\b", re.I)
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
KINDS = ["html", "body", "main", "article", "section", "nav", "aside", "header", "footer", "div", "p", "h1", "h2", "ul", "li", "table", "td", "blockquote", "pre", "form", "figure", "button", "label", "dialog"]
# Attribute tokens that pages use for main text and for what surrounds it.
TOKENS = (
    "article content main post entry story body text prose ad ads advert advertisement banner promo sponsor sponsored nav navigation menu sidebar side aside "
    "footer header comment comments reply replies respond discussion cookie cookies consent notice alert popup modal overlay newsletter subscribe signup "
    "share social related recommended more widget breadcrumb breadcrumbs pagination pager meta byline tags form search login copyright legal disclaimer masthead topbar toolbar links"
).split()

MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)",  # a quote that nothing closes is no quote
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
SPACES = re.compile(r"\s+")


class Page:
    """Block nodes in page order, and the runs of text between block boundaries with the node each is in."""

    def __init__(self) -> None:
        self.tag, self.parent, self.attrs, self.hidden = ["#root"], [-1], [""], [False]
        self.runs: list[tuple[int, str]] = []
        self.link_chars: list[int] = []


def parse(source: str) -> Page:
    """A tolerant parse: unclosed paragraphs and items end where HTML says, stray end tags are ignored.

    Time is in proportion to the page: of each element name, the places where it is open are known.
    """
    page, stack, held, links, in_link = Page(), [0], [], 0, 0
    open_: dict[str, list[int]] = {}
    raw_end: dict[str, re.Pattern] = {}

    def close() -> None:
        nonlocal held, links
        if held:
            text = SPACES.sub(" ", "".join(held)).strip()
            if text:
                page.runs.append((stack[-1], text))
                page.link_chars.append(links)
        held, links = [], 0

    def add(piece: str) -> None:
        nonlocal links
        held.append(html.unescape(piece))
        links += len(piece) if in_link else 0

    def last(names: set[str]) -> int:
        return max((open_[x][-1] for x in names if open_.get(x)), default=0)

    def cut(place: int) -> None:
        for node in stack[place:]:
            open_[page.tag[node]].pop()
        del stack[place:]

    at, n = 0, len(source)
    while at < n:
        m = MARKUP.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[1] is not None:
            held.append(m[1])
        slash, name, attributes = (m[2], m[3], m[4]) if m[3] is not None else (m[5], m[6], m[7])
        if name is None:
            continue
        name, ending = name.lower(), bool(slash)
        if name == "a":
            in_link = 0 if ending else 1
        elif name in RAW or name == "head":
            if not ending and name != "head" and not attributes.rstrip().endswith("/"):
                if name == "option":  # its end tag may be left out
                    end = OPTION_END.search(source, at)
                    at = end.start() if end else n
                    continue
                if name not in raw_end:
                    raw_end[name] = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I)
                end = raw_end[name].search(source, at)
                at = end.end() if end else n
        elif name in ("br", "hr"):
            held.append(" ")
            if name == "hr":
                close()
        elif name in BLOCKS:
            close()
            if ending:
                if place := last({name}):
                    cut(place)
                in_link = 0
                continue
            if name not in ("html", "body") or not open_.get(name):
                if name in SELF_CLOSING and (place := last(SELF_CLOSING[name])) > last(SCOPE[name]):
                    cut(place)
                if page.tag[stack[-1]] == "p":
                    cut(len(stack) - 1)
                page.tag.append(name)
                page.parent.append(stack[-1])
                found = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)) if attributes else ""
                page.attrs.append(found.lower())
                page.hidden.append(bool(attributes and HIDDEN.search(attributes)))
                open_.setdefault(name, []).append(len(stack))
                stack.append(len(page.tag) - 1)
    close()
    return page


WANTED = {t: i for i, t in enumerate(TOKENS)}
KIND = {t: i for i, t in enumerate(KINDS)}
NUMBERS = 21
WIDTH = NUMBERS + 3 * len(KINDS) + 2 * len(TOKENS)


def features(page: Page) -> Iterator[np.ndarray]:
    """One row per node: subtree density, siblings, depth, kinds of node, parent and inherited kinds, own and inherited tokens.

    Rows come in pieces of NODES at most, so that a page of any length takes bounded memory.
    """
    n = len(page.tag)
    own, link, runs = [0] * n, [0] * n, [0] * n
    for (node, text), linked in zip(page.runs, page.link_chars, strict=True):
        own[node] += len(text)
        link[node] += min(linked, len(text))
        runs[node] += 1
    chars, linked, nodes, pieces, stops = own[:], link[:], [1] * n, runs[:], [0] * n
    for node, text in page.runs:
        stops[node] += sum(text.count(c) for c in ".,;!?")
    kids = [0] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        nodes[p] += nodes[i]
        pieces[p] += pieces[i]
        stops[p] += stops[i]
        kids[p] += 1
    k, t = len(KINDS), len(TOKENS)
    seen, last, depth = [0] * n, [0] * n, [0] * n
    kind, above, tokens, inherited = [0] * n, [0] * n, [0] * n, [0] * n  # bits
    total = max(1, chars[0])
    before = 0
    for start in range(0, n, NODES):
        stop = min(n, start + NODES)
        out = np.zeros((stop - start, WIDTH), np.float32)
        for i in range(start, stop):
            p = max(0, page.parent[i])
            index = previous = 0
            if i:
                depth[i] = depth[p] + 1
                index, previous = seen[p], last[p]
                seen[p] += 1
                last[p] = i
                above[i], inherited[i] = above[p] | kind[p], inherited[p] | tokens[p]
            if page.tag[i] in KIND:
                kind[i] = 1 << KIND[page.tag[i]]
            if page.attrs[i]:
                tokens[i] = sum(1 << x for x in {WANTED[w] for w in re.split(r"[^a-z]+", page.attrs[i]) if w in WANTED})
            c = chars[i]
            row = out[i - start]
            row[:NUMBERS] = (
                math.log1p(c), math.log1p(own[i]), c / total, linked[i] / (c + 1), c / nodes[i], pieces[i] / nodes[i], stops[i] / (c + 1), depth[i],
                index, kids[p], index / max(1, kids[p]), kids[i], chars[p] and c / chars[p], linked[p] / (chars[p] + 1), (chars[p] - c) / max(1, kids[p] - 1),
                math.log1p(chars[previous]) if previous else 0, linked[previous] / (chars[previous] + 1) if previous else 0, i / n, before / total, page.hidden[i], math.log1p(nodes[i]),
            )
            before += own[i]
            for bits, first in ((kind[i], NUMBERS), (kind[p] if i else 0, NUMBERS + k), (above[i], NUMBERS + 2 * k), (tokens[i], NUMBERS + 3 * k), (inherited[i], NUMBERS + 3 * k + t)):
                while bits:
                    row[first + (bits & -bits).bit_length() - 1] = 1
                    bits &= bits - 1
        yield out


def decoded(parent: list[int], keep: np.ndarray) -> list[bool]:
    """The likeliest labels in which a dropped node has no kept descendant."""
    p = np.clip(keep, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    for i in range(len(parent) - 1, 0, -1):
        yes[parent[i]] += max(yes[i], no[i])
        no[parent[i]] += no[i]
    out = [True] * len(parent)
    for i in range(1, len(parent)):
        out[i] = out[parent[i]] and yes[i] > no[i]
    return out


def extract(sources: list[str], model: Boosted) -> list[list[str]]:
    """The main blocks of each page, in page order."""
    pages = [parse(s) for s in sources]
    held, size, found = [], 0, []
    for rows in (rows for p in pages for rows in features(p)):
        held.append(rows)
        size += len(rows)
        if size >= NODES:
            found.append(model.predict(np.concatenate(held)))
            held, size = [], 0
    keep = np.concatenate([*found, *([model.predict(np.concatenate(held))] if held else [])]) if pages else np.zeros(0)
    out, at = [], 0
    for page in pages:
        label = decoded(page.parent, keep[at : at + len(page.tag)])
        at += len(page.tag)
        out.append([text for node, text in page.runs if label[node]])
    return out


def generated(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page in one of many layouts, and the blocks of its main text."""
    main: set[str] = set()
    serial = iter(range(1 << 30))

    def words(lo: int, hi: int) -> str:
        n = int(rng.integers(lo, hi + 1))
        parts = ["".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(2, 10)))) for _ in range(n)]
        return f"{' '.join(parts).capitalize()} {next(serial)}{rng.choice(['.', '', '!'], p=[0.8, 0.15, 0.05])}"

    def pick(*options: str) -> str:
        return str(rng.choice(options))

    def chance(p: float) -> bool:
        return rng.random() < p

    def content(text: str) -> str:
        main.add(text)
        return text

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n))

    def attr(*names: str) -> str:
        return f' {pick("class", "id")}="{pick(*names)}"'

    def nav() -> str:
        n = int(rng.integers(2, 9))
        return pick(f"<nav><ul>{links(n)}</ul></nav>", f"<div{attr('nav', 'menu', 'navigation main-menu', 'topbar')}><ul>{links(n)}</ul></div>", f"<ul{attr('breadcrumb', 'menu', 'pagination')}>{links(n)}</ul>")

    def ad() -> str:
        return pick(f"<div{attr('ad', 'ads', 'advert', 'banner', 'promo', 'sponsored')}>{words(2, 20)}</div>", f"<aside{attr('ad', 'promo')}><p>{words(3, 25)}</p></aside>", f"<p{attr('ad', 'sponsor')}>{words(3, 20)}</p>", f"<section{attr('advertisement', 'sponsored')}><h2>{words(2, 4)}</h2><p>{words(5, 30)}</p></section>")

    def notice() -> str:
        return pick(f"<div{attr('cookie-notice', 'notice', 'alert', 'consent', 'popup')}><p>{words(5, 40)}</p><button>{words(1, 2)}</button></div>", f"<dialog><p>{words(5, 20)}</p></dialog>", f"<p{attr('notice', 'alert', 'disclaimer')}>{words(4, 20)}</p>", f'<div role="alert">{words(4, 20)}</div>')

    def form() -> str:
        return pick(f"<form><label>{words(1, 4)}</label><input><button>{words(1, 2)}</button></form>", f"<form{attr('search', 'newsletter', 'subscribe', 'login')}><p>{words(4, 20)}</p><input name='q'></form>", f"<div{attr('newsletter', 'subscribe', 'signup')}><h2>{words(2, 5)}</h2><form><label>{words(1, 3)}</label></form></div>")

    def side() -> str:
        body = pick(f"<h2>{words(1, 4)}</h2><ul>{links(5)}</ul>", f"<p>{words(5, 50)}</p>", f"<h3>{words(1, 3)}</h3><p>{words(5, 30)}</p><p>{words(5, 30)}</p>")
        return pick(f"<aside>{body}</aside>", f"<div{attr('sidebar', 'side', 'widget', 'related', 'recommended links')}>{body}</div>", f"<aside{attr('sidebar', 'related')}>{body}</aside>")

    def comments() -> str:
        n = int(rng.integers(1, 6))
        each = pick("p", "li", "div", "article")
        body = "".join(f"<{each}{attr('comment', 'reply') if chance(0.6) else ''}>{f'<p>{words(4, 60)}</p>' if each in ('div', 'article') else words(4, 60)}</{each}>" for _ in range(n))
        head = f"<h{pick('2', '3')}>{words(1, 3)}</h2>" if chance(0.3) else f"<h3>{words(1, 3)}</h3>" if chance(0.5) else ""
        return f"<{(e := pick('section', 'div', 'div', 'ul'))}{attr('comments', 'comment-list', 'discussion', 'replies', 'respond')}>{head}{body}</{e}>"

    def footer() -> str:
        body = pick(f"&copy; {words(3, 20)}", f"<p>{words(5, 30)}</p><ul>{links(3)}</ul>", f"<p>{words(5, 30)}</p>")
        return pick(f"<footer>{body}</footer>", f"<div{attr('footer', 'copyright', 'legal')}>{body}</div>")

    def header() -> str:
        return pick(f"<header><h2>{words(1, 5)}</h2>{nav()}</header>", f"<header><p>{words(2, 10)}</p></header>", f"<div{attr('header', 'masthead')}><p>{words(2, 8)}</p></div>", "")

    def extra() -> str:
        return (ad, notice, form, side, nav)[int(rng.integers(5))]()

    def paragraph() -> str:
        kind = rng.random()
        text = content(words(*((1, 4), (3, 14), (10, 45), (40, 120))[int(rng.integers(4))]))
        if kind < 0.72:
            return f"<p>{text}</p>"
        if kind < 0.84:
            return f"<p><b>{text}<br>"
        if kind < 0.88:
            return f"<p>{text}"
        if kind < 0.91:
            return f"<h2>{text}</h2>"
        if kind < 0.94:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.96:
            return f"<ul><li>{text}</li><li>{content(words(3, 20))}</li></ul>"
        return f"<div>{text}</div>" if kind < 0.98 else f"<table><tr><td>{text}</td><td>{content(words(1, 6))}</td></tr></table>"

    body = [f"<h1>{content(words(2, 14))}</h1>"] if chance(0.9) else []
    for _ in range(int(rng.choice([1, 2, 4, 8, 16, 40], p=[0.2, 0.2, 0.25, 0.2, 0.1, 0.05]))):
        body.append(paragraph())
        if chance(0.06):
            body.append(extra() if chance(0.8) else comments())
    if chance(0.15):
        body.append(pick(comments(), side(), form(), f"<div{attr('share', 'social', 'tags', 'meta')}>{words(1, 6)}</div>"))
    opening, ending = [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), (f"<div{attr('content', 'post', 'entry', 'article', 'main-content', 'story')}>", "</div>"), ("<section>", "</section>"), ("<div>", "</div>"), ("", "")][int(rng.integers(8))]
    top = [x for x in (nav() if chance(0.85) else "", header() if chance(0.4) else "", notice() if chance(0.25) else "", ad() if chance(0.5) else "", form() if chance(0.12) else "", side() if chance(0.15) else "") if x]
    low = [x for x in (comments() if chance(0.35) else "", side() if chance(0.3) else "", ad() if chance(0.2) else "", form() if chance(0.15) else "", notice() if chance(0.1) else "", footer() if chance(0.85) else "") if x]
    rng.shuffle(top)
    source = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><script>var t='</p>';</script></head><body>{''.join(top)}{opening}{''.join(body)}{ending}{''.join(low)}</body></html>"
    return (source[: int(len(source) * rng.uniform(0.6, 1))] if chance(0.08) else source), main


FITTED: dict[tuple[int, int], Boosted] = {}  # by pages and seed: fitting depends on nothing else


def train(pages: int = TRAIN_PAGES, seed: int = 20) -> Boosted:
    if (pages, seed) not in FITTED:
        FITTED[pages, seed] = fit(pages, seed)
    return FITTED[pages, seed]


def fit(pages: int, seed: int) -> Boosted:
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for _ in range(pages):
        source, main = generated(rng)
        page = parse(source)
        holds = [False] * len(page.tag)
        for node, text in page.runs:
            while node >= 0 and not holds[node] and text in main:
                holds[node] = True
                node = page.parent[node]
        rows.append(np.concatenate(list(features(page)))[1:])
        labels += holds[1:]
    return Boosted().fit(np.concatenate(rows), np.array(labels, float))


def extractor(model: Boosted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks: list[list[str]] = []
            for at in range(0, batch.num_rows, BATCH):
                blocks += extract([t.as_py().decode("utf-8", "replace") for t in batch.column(0).slice(at, BATCH)], model)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(blocks, pa.list_(pa.string()))], names=[*batch.schema.names[1:], "blocks"])

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, blocks (of main text, in page order) and text (blocks joined by two line ends).

    Null or empty html has no blocks and the empty text. White space inside a block is one space.
    Pages of any length and depth are parsed whole, in time and memory in proportion to them. A node as
    likely to be main text as not stays out. Repeated rows give repeated results; an empty table gives
    no rows; other columns are ignored whatever their names.
    """
    rows = pages.select(text_of(html_col).cast("binary").alias("the html"), F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias(url_col))
    out = rows.mapInArrow(frugal(extractor(train())), rows.drop("the html").schema.add("blocks", T.ArrayType(T.StringType())))
    return out.withColumn("text", F.array_join("blocks", "\n\n"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
