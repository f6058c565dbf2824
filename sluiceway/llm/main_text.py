"""Main text of web pages by tree scoring.

The page is parsed into a tree of blocks, links and marked inline elements (whole pages, any nesting, open
ends and stray closings allowed; a quote opens a value behind "=" only). Subtrees that are no content by element,
role, class or id are set aside: by a whole class name or id in MARKS, or by a word of one, unless the name says
what its element has or lacks ("has-sidebar"). A word alone, or a form, does not set aside a subtree that holds
most of the page's running text; paragraphs and inline elements go by the names of what is put between paragraphs
only (PUT_IN), so that a `<p class="warning">` of the article stays.

Every block of running text earns points for its length and its commas and passes them to its ancestors, the
full sum to its parent, half to the next and a falling share to the three beyond; a container's points are
discounted by the share of its characters that are link text. The best container is kept (with the article
element around it, if there is one), and those of its siblings that score well or read like its text. Within
what is kept, lists and boxes that are mostly links go.

What stands outside of any body counts as in an implied one (the root), and content ends a head left open.
Null, empty and unreadable pages give an empty text; very long pages are read whole, in time linear in their
length; repeated rows stay and give equal results; ties go to the container that opens first; an empty table
gives no rows; only the named columns are read, null ids and addresses stay null.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table

#: What a tag holds behind its name: a quoted value may hold ">", and nothing here is tried twice.
_INSIDE = r"(?:[^>=]++|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|textarea|iframe|svg|math|title|select|object|canvas|audio|video)\b{_INSIDE}>.*?(?:</\1\s*[^>]*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ASIDE = set("nav footer aside form button menu dialog head datalist fieldset frameset".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Names of classes and ids, and words of such names, that mark what is not the article.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies disqus footer "
    "footnav header hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup promo promoted promotion "
    "promotions reader-comments recommended recommendations related replies reply respond responses search share sharing shoutbox sidebar signup skip social sponsor sponsored sponsors "
    "subscribe subscription tags teaser toolbar topbar warning widget widgets".split()
)
#: Those of them that are put between an article's paragraphs as paragraphs or inline elements of their own.
PUT_IN = set("ad ads adv advert adverts advertisement advertising consent cookie cookies hidden newsletter notice notices promo promoted promotion promotions share sharing sponsor sponsored sponsors subscribe".split())
#: Names with one of these words say what an element has or lacks, not what it is.
SAYS = set("has have with without no non not is js can hide show shows enable enabled disable disabled layout page site wrap wrapper container content main".split())
#: Words of comment sections, which may hold most of a page's text.
THREADS = set("comment comments commentlist disqus reply replies respond responses shoutbox".split())
PHRASES = {"p", "li", "dd", "dt", "td", "th", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"} | INLINE
SEALED = {"html", "body", "article", "main"}
#: Elements that an opening element of the same kind, or of these, closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main"}
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
BONUS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}
GOOD = set("article body content entry main post story text blog page hentry".split())
BOXES = set("ul ol dl div table section tr td".split())


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}


def _names(a: dict[str, str]) -> list[str]:
    return f"{a.get('class', '')} {a.get('id', '')}".split()


def _set_aside(tag: str, a: dict[str, str], names: list[str], in_article: bool) -> int:
    """0: content; 1: none, unless it holds most of the page's running text; 2: none."""
    if tag == "form":
        return 1
    if tag in ASIDE or tag == "header" and not in_article:
        return 2
    if tag in SEALED or not a:
        return 0
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return 2
    if a.get("role", "").lower() in ROLES:
        return 1 if a["role"].lower() == "form" else 2
    found = 0
    for name in names:
        if tag in PHRASES and in_article:
            found = max(found, 2 * (name.lower() in PUT_IN or any(w.lower() in PUT_IN for w in _PARTS.findall(name))))
        elif name.lower() in MARKS:
            return 2
        else:
            parts = [w.lower() for w in _PARTS.findall(name)]
            if MARKS.intersection(parts) and not (SAYS.intersection(parts[:-1]) and parts[0] in SAYS):
                found = max(found, 2 if THREADS.intersection(parts) else 1)
    return found


def extract(html: str | None) -> str:
    """The main text of one page: its blocks in page order, white space as single blanks, joined by a blank."""
    if not html:
        return ""
    # Nodes in page order; a parent comes before its children.
    tags, parents, aside, block, link, inside, bonus = ["root"], [0], [0], [0], [False], [False], [0.0]
    stack, texts, broken, at = [0], [], True, 0
    opened: Counter[str] = Counter()  # elements of each kind on the stack
    def close(k: int) -> None:
        for node in stack[k:]:
            opened[tags[node]] -= 1
        del stack[k:]

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            texts.append((stack[-1], html[at : m.start()], broken))
            broken = False
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "p" or tag not in INLINE:
                broken = True
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                own = tags[stack[k]]
                if own == tag:
                    close(k)
                    break
                if tag in INLINE and own not in INLINE:
                    break
            continue
        raw = m[4]
        if tag in VOID:
            if tag in ("br", "hr"):
                broken = True
            continue
        if tags[stack[-1]] == "head":
            close(len(stack) - 1)  # what belongs there is void or was skipped as a whole
        inline = tag in INLINE
        if inline and tag != "a" and not raw:
            continue  # plain formatting does not shape the tree
        if not inline:
            broken = True
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():  # a block ends an open paragraph
                own = tags[stack[k]]
                if own == "p":
                    close(k)
                    break
                if own not in INLINE:
                    break
            ends = CLOSES.get(tag)
            if ends and any(opened[x] for x in ends):
                for k in range(len(stack) - 1, 0, -1):
                    own = tags[stack[k]]
                    if own in ends:
                        close(k)
                        break
                    if own in SCOPES:
                        break
        elif tag == "a":
            for k in range(len(stack) - 1, 0, -1) if opened["a"] else ():
                if tags[stack[k]] == "a":
                    close(k)
                    break
                if tags[stack[k]] not in INLINE:
                    break
        up = stack[-1]
        a = _attributes(raw) if raw else {}
        names = _names(a) if a else []
        n = len(tags)
        tags.append(tag)
        parents.append(up)
        aside.append(_set_aside(tag, a, names, inside[up]))
        block.append(block[up] if inline else n)
        link.append(link[up] or tag == "a")
        inside.append(inside[up] or tag in ("article", "main"))
        bonus.append(BONUS.get(tag, 0.0) + (10.0 if names and any(w.lower() in GOOD for x in names for w in _PARTS.findall(x)) else 0.0))
        if not raw.endswith("/"):
            stack.append(n)
            opened[tag] += 1
    if at < len(html):
        texts.append((stack[-1], html[at:], broken))

    clean, sizes = [], []
    prose = [0] * len(tags)
    for node, text, brk in texts:
        text = unescape(text) if "&" in text else text
        n = sum(map(len, text.split())) + text.count(" ") if text.strip() else 0
        clean.append((node, text, brk))
        sizes.append(n)
        if not link[node]:
            prose[node] += n
    gone = [x == 2 for x in aside]
    for k in range(1, len(tags)):
        gone[k] = gone[k] or gone[parents[k]]
    if 1 in aside:  # of the rest, what holds most of the running text stays
        held = [0 if g else n for g, n in zip(gone, prose, strict=True)]
        for k in range(len(tags) - 1, 0, -1):
            held[parents[k]] += held[k]
        for k in range(1, len(tags)):
            gone[k] = gone[parents[k]] or gone[k] or aside[k] == 1 and 2 * held[k] <= held[0]
    chars, linked, commas = [0] * len(tags), [0] * len(tags), [0] * len(tags)
    for (node, text, _), n in zip(clean, sizes, strict=True):
        if not n or gone[node]:
            continue
        b = block[node]
        chars[b] += n
        commas[b] += text.count(",") + text.count("，") + text.count("、")
        if link[node]:
            linked[b] += n
    points = [0.0] * len(tags)
    for b in range(len(tags)):
        if chars[b] and not gone[b]:
            earned = (1 + commas[b] + chars[b] / 100) * (1 - linked[b] / chars[b])
            node, level = b if tags[b] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote") else parents[b], 0
            while True:
                points[node] += earned / (1, 2, 6, 9, 12)[level]
                if not node or level == 4:
                    break
                node, level = parents[node], level + 1
    total, total_linked = chars[:], linked[:]
    for k in range(len(tags) - 1, 0, -1):
        total[parents[k]] += total[k]
        total_linked[parents[k]] += total_linked[k]
    density = [x / t if t else 0.0 for x, t in zip(total_linked, total, strict=True)]
    score = [(p + b) * (1 - d) if p > 0 else 0.0 for p, b, d in zip(points, bonus, density, strict=True)]
    best = max(range(len(tags)), key=lambda k: (score[k], -k))
    if not score[best]:
        return ""
    node = best
    while node:
        if tags[node] == "article" and density[node] < 0.5:
            best = node
        node = parents[node]

    keep = [False] * len(tags)
    keep[best] = True
    if best and tags[best] not in SEALED - {"article"}:
        for k in range(1, len(tags)):
            if parents[k] == parents[best] and k != best and not gone[k] and total[k]:
                good = score[k] >= max(10.0, 0.2 * score[best])
                prose = tags[k] == "p" and density[k] < 0.25 and (total[k] > 80 or commas[k] > 0)
                keep[k] = good or prose or tags[k] in ("h1", "h2") and k < best and density[k] < 0.5
    for k in range(1, len(tags)):
        if gone[k]:
            keep[k] = False
        elif not keep[k]:
            keep[k] = keep[parents[k]] and not (tags[k] in BOXES and density[k] > 0.7 and total_linked[k] > 0 and total[k] > 10)
    out = []
    for node, text, brk in clean:
        if keep[node]:
            out.append(f" {text}" if brk else text)
    return " ".join("".join(out).split())


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array([extract(x) for x in batch.column(2).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    source = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return per_batch(source, run, "page_id long, url string, text string")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_main_text": op8_main_text}
