"""Main text of web pages by tag-path ratios.

A page is a sequence of blocks, each with its path of block-level tags from the
root.  For every distinct path the length of text outside links and its punctuation
are added up; logarithms of both, per block, are smoothed over neighbouring paths in
page order and fused by their geometric mean.  A path is content if its ratio is at
least SHARE of the mean ratio of the page's text and less than half of its text is
in links; a heading has the ratio of the path that follows it.

Names only weigh: in <article> and <main>, unless a <div> inside wraps the block,
ratios count PRIOR times more, by the share of the page's text that the element has,
and MARKED times where a tag, role, class or id says that it is no article (menus,
adverts, forms, comments).  Such an element has a path of its
own, and so has each <article> and <main>.  The mean is that of the unmarked text; a
page without any has an empty text.  Scripts, styles and hidden elements show no
text and have no blocks.

Nulls, empty pages and pages without text give an empty text.  Broken markup is
read as browsers do: unclosed elements end with their parent, a paragraph ends
at the next block, scripts and styles end at their own end tag alone, and a tag
that never ends is text.  Time and memory are in proportion to the page.
Repeated rows and ids are treated one by one; paths with equal ratios are kept or
dropped together.  An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm import exchange as X

# HTML element names by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
SILENT = frozenset("script style noscript iframe noembed noframes template svg math title textarea button select head object canvas audio video".split())
OUTSIDE = frozenset("nav aside footer form menu dialog".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
# Words in class or id that mark what is no article.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr menu nav navbar navigation newsletter notice notices popup modal promo promotion related share sharing shares sidebar social sponsor sponsored subscribe toolbar widget".split())

#: How much more the ratio of a path counts in an <article> or <main> with all the text; how much where its elements are
#: marked; least share of the mean.
PRIOR, MARKED, SHARE = 1.0, 0.1, 0.35

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，！？]")


def _kind(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(whether the element shows no text, whether its name, role, class or id says that it is no article)."""
    silent, marked = name in SILENT, name in OUTSIDE or name == "header" and not in_article
    for key, value in _MARK.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        silent |= key == "hidden" or key == "aria-hidden" and value == "true"
        marked |= key == "role" and value in NO_ARTICLE_ROLES
        marked |= key in ("class", "id") and name not in ("html", "body", "article", "main") and any(w in NO_ARTICLE for w in re.split(r"[^a-z0-9]+", value))
    return silent, marked


class Tags:
    """Where the tags of a page are, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quoted = True  # until a quote never closes, then quotes mean nothing

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at at; -1 if none does."""
        if at > self.last:
            return -1
        begin = at
        while self.quoted and (m := _STOP.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            close = self.page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.quoted = False
        return self.page.find(">", begin)


class Paths:
    """Distinct paths from the root as numbers; a parent's is smaller than its children's."""

    def __init__(self):
        self.parent, self.name, self.inside, self.marked = [-1], [""], [False], [False]
        self.number: dict[tuple[int, str, bool], int] = {}

    def child(self, path: int, name: str, marked: bool) -> int:
        """An element's path; one that is marked has another than its plain siblings."""
        key = path, name, marked
        if key not in self.number:
            self.number[key] = len(self.parent)
            self.parent.append(path)
            self.name.append(name)
            self.inside.append(self.inside[path] or _article(name))
            self.marked.append(self.marked[path] or marked)
        return self.number[key]


def _article(name: str) -> bool:
    return name.split("#")[0] in ("article", "main")


# Elements that end at the next of their kind, which ones, and the elements in which they do.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",))}


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """(path, text, characters in links) of each block that may be content, in page order."""
    paths, tags = Paths(), Tags(page)
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, whether it is silent, path
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = articles = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][2] if stack else 0, text, linked))
        parts, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1][1]):
            parts.append(text)
            if opened["a"]:
                linked += len(text)

    def leave(to: int) -> None:
        while len(stack) > to:
            name = stack[-1][0]
            if name not in INLINE:
                flush()
            opened[name] -= 1
            stack.pop()

    def innermost(names: tuple[str, ...], within: tuple[str, ...] = ()) -> int:
        """The place in the stack of the innermost of names that no element of within encloses; -1 if there is none."""
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in within:
                    return -1
                if stack[i][0] in names:
                    return i
        return -1

    at = 0
    while (low := page.find("<", at)) >= 0:
        after = page[low + 1 : low + 2]
        if after in ("!", "?"):
            say(page[at:low])
            if page.startswith("<!--", low):
                high = page.find("-->", low + 4)
                at = len(page) if high < 0 else high + 3
            elif page.startswith("<![CDATA[", low):
                high = page.find("]]>", low)
                say(page[low + 9 : high if high >= 0 else len(page)])
                at = len(page) if high < 0 else high + 3
            else:
                high = page.find(">", low)
                at = len(page) if high < 0 else high + 1
            continue
        m = _NAME.match(page, low)
        high = tags.end(m.end()) if m else -1
        if high < 0:
            if m and low > tags.last:
                break  # no tag ends any more
            say(page[at : low + 1])
            at = low + 1
            continue
        say(page[at:low])
        at, name, attributes = high + 1, m[1].lower(), page[m.end() : high]
        if after == "/":
            if opened[name]:
                if name not in INLINE:
                    leave(innermost((name,)))
                else:  # an inline element doesn't end blocks
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            leave(i)
                            break
                        if stack[i][0] not in INLINE:
                            break
            continue
        if name == "br":
            say(" ")
            continue
        if name not in INLINE:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if name in ENDS_PARAGRAPH and (i := innermost(("p",))) >= 0:
            leave(i)
        elif name in SIBLINGS and (i := innermost(*SIBLINGS[name])) >= 0:
            leave(i)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        quiet, path = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        silent, marked = _kind(name, attributes, opened["article"] + opened["main"] > 0)
        if name in ("article", "main"):
            articles += 1
            path = paths.child(path, f"{name}#{articles}", marked)
        elif name not in INLINE or marked:
            path = paths.child(path, name, marked)
        stack.append((name, quiet or silent, path))
        opened[name] += 1
    say(page[at:])
    leave(0)
    flush()
    return paths, out


def ratios(found: list[tuple[int, str, int]]) -> dict[int, tuple[float, int, int]]:
    """(ratio, characters, characters in links) of each path, in page order."""
    stats: dict[int, list[int]] = {}
    for path, text, linked in found:
        x = stats.setdefault(path, [0, 0, 0, 0])
        x[0] += len(text)
        x[1] += len(_PUNCT.findall(text))
        x[2] += linked
        x[3] += 1
    length = [math.log1p((n - min(linked, n)) / times) for n, _, linked, times in stats.values()]
    points = [math.log1p(marks / times) for _, marks, _, times in stats.values()]

    def smooth(x: list[float]) -> list[float]:
        x = [0.0, *x, 0.0]
        return [math.expm1((x[i - 1] + 4 * x[i] + x[i + 1]) / 6) for i in range(1, len(x) - 1)]

    fused = [(a * (b + 1)) ** 0.5 for a, b in zip(smooth(length), smooth(points), strict=True)]
    return {p: (x, s[0], s[2]) for (p, s), x in zip(stats.items(), fused, strict=True)}


def weights(paths: Paths, rated: dict[int, tuple[float, int, int]]) -> list[float]:
    """How much the names on a path make its ratio count: more by the share of the page's text that its article has."""
    held = [0] * len(paths.name)
    for p, (_, n, linked) in rated.items():
        held[p] = 0 if paths.marked[p] else n - min(linked, n)
    for i in range(len(held) - 1, 0, -1):
        held[paths.parent[i]] += held[i]
    prior = [1.0] * len(paths.name)
    for i in range(1, len(prior)):
        if _article(paths.name[i]):
            prior[i] = 1 + PRIOR * held[i] / max(held[0], 1)
        elif paths.name[i] != "div":
            prior[i] = prior[paths.parent[i]]
    return [x * (MARKED if marked else 1.0) for x, marked in zip(prior, paths.marked)]


def chosen(paths: Paths, found: list[tuple[int, str, int]]) -> set[int]:
    """The paths that are content."""
    rated = ratios(found)
    weight = weights(paths, rated)
    ratio = {p: r * weight[p] for p, (r, _, _) in rated.items()}
    last = None
    for p in reversed(list(ratio)):
        if re.fullmatch("h[1-6]", paths.name[p]) and last is not None and not paths.marked[p] and not paths.marked[last]:
            ratio[p] = max(ratio[p], ratio[last])
        last = p
    plain = [p for p in rated if not paths.marked[p]]
    text = sum(rated[p][1] for p in plain)
    if not text:
        return set()
    mean = sum(ratio[p] * rated[p][1] for p in plain) / text
    return {p for p, (_, n, linked) in rated.items() if ratio[p] >= SHARE * mean and 2 * linked < n}


def main_text(page: str | None) -> str:
    """The blocks of the page's article, joined by an empty line."""
    paths, found = blocks(page or "")
    content = chosen(paths, found)
    return "\n\n".join(text for path, text, _ in found if path in content)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text."""
    X.tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array((main_text(x.as_py()) for x in batch.column(2)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), text], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
