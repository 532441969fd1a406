"""Operator 8, HTML extraction by a maximum-scoring subsequence of a page's words and tags.

A page is a sequence of words and tags. Words score above 0 and tags below, by how much likelier they are inside the articles of
labelled pages than outside; one scan finds the contiguous region of the highest sum. Inside it, elements that are kept for
other things than running text (adverts, forms, comments, menus) are left out.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.llm.common import load

#: Most labelled pages that the weights are learnt from, names of tags that get a weight of their own (the most frequent).
LABELLED, NAMES = 4000, 200
#: How much tags may weigh against words, as multiples of what their frequencies say; the labelled pages choose.
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)
#: Occurrences that a tag's or word's start value counts for beside the labelled ones; the most that a tag can cost (a word scores 1 at most).
BELIEF, MOST = 20, 12.0
#: Share of a page's words from which on an element is the page's wrapper, whatever it is called.
WRAPPER = 0.8
#: A context that holds so many parts takes no more from what is nested in it.
DEEP = 100
# Element names of the HTML standard by how they take part in a page's text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea select title object canvas".split())
#: Of these, ones whose tag alone goes if nothing closes them; the others take the rest of the page, as in browsers.
_LEFT_OPEN = frozenset("canvas iframe noscript object select svg template".split())
_SPACED = frozenset("br td th".split())
#: Elements that an opening tag of the same kind ends, as their end tags may be left out, and what they cannot reach across.
_SELF_CLOSING = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDARY = BLOCKS - {"p", "li", "dt", "dd", "tr"}
_CONTAINERS = frozenset("aside div footer form header menu nav ol section table ul".split())
_NOT_ITSELF = frozenset("after before has is no non not with without".split())
_UNNAMED = frozenset("html body article main".split())

# What a context's parts weigh before anything is learnt. Elements that the HTML standard keeps for other
# things than the main text, parts of class and id names that are usual for such things, parts that an article's own
# sections have too, and elements of running text.
_OUTSIDE = "annotation annotation-xml aside button dialog fieldset form input label menu nav option"
_OUTSIDE_NAMES = "ad ads adsense adslot adunit advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disclaimer disqus gdpr masthead menu modal nav navbar navigation newsletter overlay pager pagination popup promo promoted promotion replies respond sidebar signup skip sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets"
_DOUBTFUL_NAMES = "discussion notice related responses review reviews share sharing social"
_RUNNING = "blockquote figcaption h1 h2 h3 h4 h5 h6 p pre"
_OUTSIDE_ROLES = "alert alertdialog banner complementary dialog form menu menubar navigation search toolbar"
#: Names that stay what they are however many words they hold: readers may write more than the author.
_READERS = frozenset(".comment .commentlist .comments .disqus .replies .respond".split())
PRIOR = {
    "": 0.3, "header": -0.2, "a": -0.3, "@links": -2.0, "@hidden": -4.0, "@foot": -4.0,
    **dict.fromkeys(_RUNNING.split(), 1.0), **dict.fromkeys(_OUTSIDE.split(), -4.0), **{f".{x}": -4.0 for x in _OUTSIDE_NAMES.split()},
    **{f".{x}": -1.0 for x in _DOUBTFUL_NAMES.split()}, **{f"@{x}": -4.0 for x in _OUTSIDE_ROLES.split()},
}

# What tags cost before anything is learnt, in words: those of running text, those that hold it, and all others.
_LIGHT = "abbr b blockquote br cite code em figcaption figure h1 h2 h3 h4 h5 h6 i img p pre q small span strong sub sup svg u"
_HEAVY = "aside footer form header nav"
START = {"w": 0.5, "w@a": 0.1, "": -0.2, **dict.fromkeys(_LIGHT.split(), -0.05), **dict.fromkeys(_HEAVY.split(), -2.5), "article": 0.0, "main": 0.0, "html": 0.0, "body": 0.0}

_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


def _is_word(key: str) -> bool:
    return key == "w" or key.startswith("w@")


@dataclass
class Weights:
    """Scores of words by the element that they stand in ("w@a", "w": any other) and of tags by name ("": any other), and log
    odds of a context's parts."""

    score: dict[str, float] = field(default_factory=lambda: dict(START))
    odds: dict[str, float] = field(default_factory=lambda: dict(PRIOR))

    def worth(self, context: frozenset[str]) -> float:
        """Above 0 where words in this context can be the article's."""
        return self.odds.get("", 0.0) + sum(self.odds.get(x, 0.0) for x in context)

    def tag(self, name: str) -> float:
        return self.score.get(name, self.score[""])

    def word(self, element: str) -> float:
        return self.score.get("w@" + element, self.score["w"])

    def scaled(self, by: float) -> Weights:
        """With tags that weigh `by` times as much against words."""
        return Weights({k: v if _is_word(k) else v * by for k, v in self.score.items()}, self.odds)


def unescaped(text: str) -> str:
    """The text with its character references decoded; a number too long for any character is U+FFFD."""
    return html.unescape(_LONG_REFERENCE.sub("�", text)) if "&" in text else text


def tags(page: str):
    """(start, end, closing, name, attributes) of each tag, and (start, end, False, '', '') of what is no text at all
    (comments, declarations, scripts and the like with all they hold), in one pass over the page."""
    at, last, quotes, lost = 0, page.rfind(">"), True, set()
    while 0 <= (at := page.find("<", at)) < last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page[at + 1] in "!?":
            end = page.index(">", at) + 1
            yield at, end, False, "", ""
        elif m := _NAME.match(page, at + 1):
            found = _QUOTED_END.match(page, m.end()) if quotes else None
            quotes = found is not None  # a quotation mark that nothing closes: from here on a tag ends at its first '>'
            end = found.end() if found else page.index(">", m.end()) + 1
            name, rest = m[2].lower(), page[m.end() : end - 1]
            if name in RAW and not m[1] and not (name == "svg" and rest.endswith("/")):
                close = re.compile(rf"</{name}\s*>", re.I).search(page, end) if name not in lost else None
                if close is None:
                    lost.add(name)
                end = close.end() if close else end if name in _LEFT_OPEN else len(page)
                yield at, end, False, "", ""
            else:
                yield at, end, bool(m[1]), name, rest
        else:
            at += 1
            continue
        at = end


def _parts(name: str, attributes: str) -> frozenset[str]:
    """An element's parts for its words' context: its name, its role, the parts of its class and id names (those of two parts
    at most, as longer ones and such as with-sidebar say something of other things), whether it is hidden. html, body, article and main have none: what they hold is to be found without them."""
    if name in _UNNAMED:
        return frozenset()
    found = {name}
    if attributes:
        if _HIDDEN.search(attributes):
            found.add("@hidden")
        for m in _ATTRIBUTE.finditer(attributes):
            value, mark = (m[2] or m[3] or m[4] or "").lower(), "@" if m[1].lower() == "role" else "."
            for token in value.split():
                parts = [x for x in re.split(r"[^a-z]+", token) if x]
                if len(parts) <= 2 and not (len(parts) == 2 and parts[0] in _NOT_ITSELF):
                    found.update(mark + x for x in parts)
    return frozenset(found)


def page_items(page: str, odds: dict[str, float] = PRIOR) -> list[list]:
    """_items() with the wrappers of the page's text, elements that hold nearly all of its words, taken for what they are:
    their names then say nothing of the words."""
    items, opened = _items(page, frozenset())
    total = sum(x[1] for x in items if x[0] == "w")
    wrappers = frozenset(k for k, (n, parts) in enumerate(opened) if n >= WRAPPER * total and not parts & _READERS and any(odds.get(x, 0.0) < 0 for x in parts))
    return _items(page, wrappers)[0] if wrappers else items


def _items(page: str, wrappers: frozenset[int]) -> tuple[list[list], list[list]]:
    """The page as a flat list: ['w', number of words, text, context, inside article or main] and
    ['t', name, is a block, context, inside article or main] in page order, and of each element in order how many words it
    holds and its parts. The last entry is the element that a text stands in, a if it is in a link. A context holds the parts of all open elements, and
    '@links' where the innermost list, section or the like has most of its words in links, '@foot' in a footer of an article."""
    items, stack, at, inside, links, seen, opened = [], [], 0, 0, 0, 0, []
    open_at: dict[str, list[int]] = {}
    boundaries, containers = [], []
    contexts, known = [frozenset()], {}

    def text(end: int) -> None:
        nonlocal seen
        if end > at:
            part = page[at:end]
            n = len(unescaped(part).split())
            seen += n
            items.append(["w", n, part if n else " ", contexts[-1], inside > 0, "a" if links else stack[-1][0] if stack else ""])
            if containers and n:
                own = containers[-1]
                own[1] += n
                own[2] += n if links else 0
                own[3].append(len(items) - 1)

    def close(k: int) -> None:
        nonlocal inside, links
        while len(stack) > k:
            name, number = stack.pop()
            opened[number][0] = seen - opened[number][0]
            open_at[name].pop()
            contexts.pop()
            inside -= name in ("article", "main")
            links -= name == "a"
            if boundaries and boundaries[-1] == len(stack):
                boundaries.pop()
            if containers and containers[-1][0] == len(stack):
                _, n, linked, own = containers.pop()
                if 2 * linked > n:
                    for i in own:
                        items[i][3] = items[i][3] | {"@links"}

    for start, end, closing, name, attributes in tags(page):
        text(start)
        at = end
        if not name:
            continue
        if not closing:
            reach = boundaries[-1] if boundaries else -1
            if (k := max((open_at[x][-1] for x in _SELF_CLOSING.get(name, ()) if open_at.get(x)), default=-1)) > reach:
                close(k)
            items.append(["t", name, name in BLOCKS, contexts[-1], inside > 0, ""])
            if name not in VOID and not attributes.endswith("/"):
                key = (name, attributes)
                if key not in known:
                    known[key] = _parts(name, attributes)
                own, outer = known[key] if len(opened) not in wrappers else frozenset(), contexts[-1]
                if name == "footer" and inside:
                    own = own | {"@foot"}
                opened.append([seen, known[key]])
                contexts.append(outer if own <= outer or len(outer) > DEEP else outer | own)
                open_at.setdefault(name, []).append(len(stack))
                if name in _BOUNDARY:
                    boundaries.append(len(stack))
                if name in _CONTAINERS:
                    containers.append([len(stack), 0, 0, []])
                items[-1][3] = contexts[-1]
                stack.append((name, len(opened) - 1))
                inside += name in ("article", "main")
                links += name == "a"
        else:
            items.append(["t", name, name in BLOCKS, contexts[-1], inside > 0, ""])
            if open_at.get(name):
                close(open_at[name][-1])
    text(len(page))
    close(0)
    return items, opened


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous part with the highest sum, (0, 0) if no sum is above 0: one scan that keeps the best
    sum that ends here and the best of all (the first and shortest among equals)."""
    best, first, end = 0.0, 0, 0
    total, start = 0.0, 0
    for k, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, end = total, start, k + 1
    return first, end


def item_scores(items: list[list], weights: Weights, named: bool = True) -> list[float]:
    """Scores in page order. Words whose context is one of other things attract nothing; not named: as if there were no names."""
    worth: dict[frozenset, bool] = {}
    scores = []
    for kind, value, _, context, _, element in items:
        if kind == "t":
            scores.append(weights.tag(value))
        else:
            good = worth.get(context)
            if good is None:
                good = worth[context] = not named or weights.worth(context) > 0
            scores.append(value * weights.word(element) if good else 0.0)
    return scores


def article(page: str, weights: Weights) -> str:
    """The best region's blocks. The region grows to the ends of its first and last blocks, and to those of the article or main
    element that it begins or ends in, so that it does not stop at a list of links in an article; a block in it whose words have
    a context of other things (an advert, a form) is left out."""
    items = page_items(page, weights.odds)
    first, end = best_region(item_scores(items, weights))
    if first == end:
        return ""
    while first > 0 and (items[first][4] and items[first - 1][4] or not (items[first - 1][0] == "t" and items[first - 1][2])):
        first -= 1
    while end < len(items) and (items[end - 1][4] and items[end][4] or not (items[end][0] == "t" and items[end][2])):
        end += 1
    blocks, own, worth = [], [], 0.0
    for kind, value, extra, context, _, _ in items[first:end]:
        if kind == "w":
            own.append(extra)
            worth += value * np.tanh(weights.worth(context)) if value else 0.0
        elif extra:
            if worth > 0:
                blocks.append("".join(own))
            own, worth = [], 0.0
        elif value in _SPACED:
            own.append(" ")
    if worth > 0:
        blocks.append("".join(own))
    done = (" ".join(unescaped(b).split()) for b in blocks)
    return "\n".join(b for b in done if b)


def misplaced(items: list[list], weights: Weights) -> int:
    """Words that the best region takes from outside the marked element or leaves inside; neither the mark nor names are
    used, so that pages without any are weighed right, too."""
    first, end = best_region(item_scores(items, weights, named=False))
    return sum(x[1] for k, x in enumerate(items) if x[0] == "w" and x[1] and (first <= k < end) != x[4] and not (x[4] and weights.worth(x[3]) <= 0))


def learn(pages: DataFrame, html_col: str = "html", labelled: int = LABELLED) -> Weights:
    """Weights from labelled pages, those that mark their article or main element themselves; the mark is the label, and has no
    score of its own. At most `labelled` pages (lowest hashes of their html) are used; words inside that PRIOR holds to
    be something else teach nothing. A word's or tag's score is the logarithm of its share inside over its share outside, drawn to its start
    value as if that had been seen BELIEF times, words kept above 0 and tags below; tags then weigh so many times as much
    as misplaces the fewest words of the labelled pages (the most of equals). Without labelled pages all stay at their start values."""
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)\b")).select(F.col(html_col).alias("html"))
    n = marked.count()
    if not n:
        return Weights()
    share = F.xxhash64("html").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    some = marked.where(share * n < labelled)

    def count(batches):
        plain = Weights()
        for pdf in batches:
            seen: dict[tuple, int] = {}
            for page in pdf["html"]:
                for kind, value, _, context, inside, element in page_items(page):
                    if kind == "t" and value not in _UNNAMED:
                        seen[value, inside] = seen.get((value, inside), 0) + 1
                    elif kind == "w" and value and not (inside and plain.worth(context) <= 0):
                        key = ("w@" + element, inside)
                        seen[key] = seen.get(key, 0) + value
            yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=["name", "inside", "n"])

    rows = some.mapInPandas(count, "name string, inside boolean, n long").groupBy("name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("n"))
    found = weighed([(r.name, r.good, r.n) for r in rows.orderBy(F.desc("n"), "name").limit(NAMES).collect()])

    def tried(batches):
        for pdf in batches:
            errors = np.zeros(len(SCALES), np.int64)
            for page in pdf["html"]:
                items = page_items(page)
                errors += [misplaced(items, found.scaled(x)) for x in SCALES]
            yield pd.DataFrame({"k": np.arange(len(SCALES)), "n": errors})

    errors = {r.k: r.n for r in some.mapInPandas(tried, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return found.scaled(SCALES[min(errors, key=lambda k: (errors[k], -k))] if errors else 1.0)


def weighed(rows: list[tuple[str, int, int]]) -> Weights:
    """Scores from (name, occurrences inside, in all)."""
    good, bad = sum(g for _, g, _ in rows) + 1, sum(n - g for _, g, n in rows) + 1
    words = [(g, n) for name, g, n in rows if _is_word(name)]
    score = dict(START)
    for name, g, n in [*rows, ("w", sum(g for g, _ in words), sum(n for _, n in words))]:
        odds = float(np.log((g + 0.5) / good) - np.log((n - g + 0.5) / bad))
        odds = min(1.0, max(START["w@a"], odds)) if _is_word(name) else max(-MOST, min(START["p"], odds))
        score[name] = (n * odds + BELIEF * START.get(name, START["w" if _is_word(name) else ""])) / (n + BELIEF)
    return Weights(score)


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with `out`: the main text of the whole html; empty where html is null, empty or has none. Blocks are
    joined by one line break, white space inside a block is one space, character references are decoded. A column
    already named `out` is replaced; rows are independent; no shuffle. Time grows with the length of a page."""

    @F.pandas_udf("string")
    def main_text(texts: pd.Series) -> pd.Series:
        return pd.Series([article(x, weights) if isinstance(x, str) else "" for x in texts], dtype=object)

    return pages.withColumn(out, main_text(F.col(html_col)))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, learn(pages)).select("page_id", "url", "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
