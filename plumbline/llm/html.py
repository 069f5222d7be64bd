"""Operator 6, main text of HTML pages from flat text blocks.

A page is read once, as a flat run of tags and text; block-level tags end blocks.  A block's features are its word
count and link density, those of the blocks before and after it, the longest running text close by on either side, the
kind of element it stands in, and what its surroundings are called.  A decision tree keeps or drops it.

The tree is grown by Gini impurity on a small labelled table: the blocks of LABELLED_PAGES unlike pages that `sample_page` lays out by a
seeded rule (pages with and without article elements, class names or paragraphs; menus of 1 to 30 words; adverts,
notices and comments in plain containers), read by this module's own `blocks`, so that training and use see the same features.
Pages of the tables take no part in it.

Names count as follows.  An element is called something else (OTHER) by its tag or by a class, id or role all of whose
words are known, so "site-footer" is, and "copyright-history" or "has-sidebar" are not.  article and main lift what
class names around them say, but not nav, aside and footer.

Defined results: null and empty html, and pages without a kept block, give the empty text.  Broken markup is read as
far as it goes: unknown end tags are passed over, an unended script or comment reaches to the end.  Rows are
independent; repeated rows, null ids and extra columns are harmless; an empty table gives an empty table."""

from __future__ import annotations

import html as _html
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import empty_if_null, prepare

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.S)
_HINT = re.compile(r"""\b(?:class|id|role|aria-label|itemprop|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\s(hidden)\b""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page; those of RAW reach to their end tag whatever stands between, those of
#: ENDLESS to the page's end without one (fixed values of the language).
RAW = frozenset("script style textarea title iframe template svg canvas object video audio select datalist".split())
ENDLESS = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr "
    "math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder munderover semantics annotation noscript ruby rt rp".split()
)
CLOSING = frozenset("p li dt dd tr td th option".split())
KINDS = {name: kind for kind, names in enumerate(("li dt dd td th", "h3 h4 h5 h6 caption figcaption", "h1 h2", "p pre blockquote"), 1) for name in names.split()}

#: Elements and words of class, id or role that name the article or something else; words that say nothing by themselves.
MAIN = frozenset("article main".split())
MAIN_WORDS = frozenset("article articlebody post entry story content maincontent main".split())
OTHER = frozenset("nav footer aside menu dialog button header legend".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist reply replies respond disqus social share sharing "
    "related recommended recommendations newsletter subscribe subscription signup login search pagination pager copyright legal complementary contentinfo hidden teaser outbrain taboola toc tagcloud".split()
)
NEUTRAL = frozenset("site page top bottom left right box block bar list items item links link section wrap wrapper container area group row col column inner outer unit slot the id js text global primary secondary footer header".split())

#: What an article or main element may be called itself and still be the article.
NOT_OF_MAIN = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended teaser newsletter hidden".split())


class Block:
    """`kind`: 0 text in a container, 1 list item or cell, 2 lesser heading, 3 heading, 4 paragraph.  `main`: 2 in an article or main
    element, 1 in a part called so, 0 else.  `other`: 2 in a part called something else, 1 in a form, 0 else."""

    __slots__ = ("text", "words", "links", "kind", "main", "other")

    def __init__(self, text: str, words: int, links: int, kind: int, main: int, other: int):
        self.text, self.words, self.links, self.kind, self.main, self.other = text, words, links, kind, main, other


def _named(rest: str) -> tuple[bool, set[str]]:
    """Whether class, id or role name the article, and the words by which they name something else."""
    if "=" not in rest and "hidden" not in rest:
        return False, set()
    main, other = False, set()
    for m in _HINT.finditer(rest):
        for name in (m[1] or m[2] or m[3] or m[4] or "").split():
            words = {x.lower() for x in _WORD.findall(name)}
            if words & OTHER_WORDS and words <= OTHER_WORDS | NEUTRAL:
                other |= words & OTHER_WORDS
            elif words & MAIN_WORDS:
                main = True
    return main and not other, other


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order."""
    found: list[Block] = []
    open_: list[tuple] = []  # name and the state within
    counts: Counter[str] = Counter()  # open elements by name, so that stray end tags cost nothing in deep nesting
    outside = (0, 0, 0, False, False)  # kind, main, other, other by an element, silent
    state = outside
    parts: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if parts:
            words = _html.unescape("".join(parts)).split()
            if words:
                links = len(_html.unescape(" ".join(linked)).split()) if linked else 0
                found.append(Block(" ".join(words), len(words), min(links, len(words)), *state[:3]))
            parts.clear()
            linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not state[4] and (piece := page[at : m.start() if m else n]):
            parts.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in RAW and not m["end"] and not m["rest"].endswith("/>"):
            end = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n if name in ENDLESS else at
            continue
        if name in INLINE or name in RAW:
            if name == "a":
                in_link = not m["end"]
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        if m["end"]:
            in_link = False
            if counts[name]:
                closed = ""
                while closed != name:
                    closed = open_.pop()[0]
                    counts[closed] -= 1
                state = open_[-1][1] if open_ else outside
            continue
        if name in VOID or m["rest"].endswith("/>"):
            continue
        if name in CLOSING and open_ and open_[-1][0] == name:
            open_.pop()
            counts[name] -= 1
            state = open_[-1][1] if open_ else outside
        kind, main, other, firm, silent = state
        kind = KINDS.get(name, kind if kind == 1 else 0)
        good, bad = _named(m["rest"])
        if name in ("html", "body"):
            good, bad, silent = False, set(), False
        if name in MAIN:
            if not firm and not bad & NOT_OF_MAIN and (main < 2 or not other):
                main, other, bad = 2, 0, set()
        elif good and main < 1:
            main = 1
        if name in OTHER and not (name == "header" and main == 2):
            other, firm = 2, True
        elif bad:
            # what stands within the article is not lifted by an article inside it: a comment
            other, firm = 2, firm or main == 2 or bool(bad & NOT_OF_MAIN)
        elif name == "form":
            other = max(other, 1)
        state = kind, main, other, firm, silent or name == "head"
        open_.append((name, state))
        counts[name] += 1
    flush()
    return found


#: Blocks on each side among which running text is looked for, and the link density up to which text counts as such.
REACH, RUNNING_DENSITY = 3, 0.3

FEATURES = "words density words_before density_before words_after density_after text_before text_after kind place other".split()


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page, as whole numbers; densities in percent.

    `place` is 0 on pages that name no article, 1 outside it and 2 inside."""
    n = len(found)
    out = np.zeros((n, len(FEATURES)), np.int64)
    if not n:
        return out
    words = np.array([b.words for b in found])
    density = 100 * np.array([b.links for b in found]) // words
    running = np.where(density <= 100 * RUNNING_DENSITY, words, 0)
    pad = np.zeros(REACH, np.int64)
    wide = np.concatenate([pad, running, pad])
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
    out[:, 6] = np.max([wide[i : i + n] for i in range(REACH)], axis=0)
    out[:, 7] = np.max([wide[i + REACH + 1 : i + REACH + 1 + n] for i in range(REACH)], axis=0)
    level = max((b.main for b in found if b.other < 2), default=0)
    out[:, 8] = [b.kind for b in found]
    out[:, 9] = [0 if not level else 2 if b.main == level else 1 for b in found]
    out[:, 10] = [b.other for b in found]
    return out


# --- the labelled table


#: Pages of the labelled table, their seed, and the tree's depth and smallest leaf.
LABELLED_PAGES, LABELLED_SEED, DEPTH, LEAF = 1600, 2, 12, 20

KEPT = "✓"


def sample_page(r: random.Random) -> str:
    """A page laid out by rule.  Words of main text end in KEPT, which no other word does."""

    def say(n: int, links: float = 0.0, kept: bool = False) -> str:
        words = ["w" + KEPT * kept for _ in range(max(1, n))]
        return " ".join(f"<a href=x>{w}</a>" if r.random() < links else w for w in words)

    named = r.choice(["elements", "elements", "classes", "none", "none", "none"])
    plain = r.random() < 0.2  # paragraphs as containers
    p = (lambda x: f"<div>{x}</div>") if plain else (lambda x: f"<p>{x}</p>")

    def part(element: str, name: str, inner: str) -> str:
        if named == "elements":
            return f"<{element}>{inner}</{element}>"
        return f'<div class="{name}">{inner}</div>' if named == "classes" else f"<div>{inner}</div>"

    def menu() -> str:
        items = [say(r.choice([1, 1, 1, 2, 3, 4]), 1.0) for _ in range(r.randint(1, 12))]
        form = r.randrange(3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "<div>" + " ".join(items) + "</div>" if form == 1 else "".join(f"<div>{x}</div>" for x in items)

    def advert() -> str:
        inner = say(r.randint(3, 45), r.choice([0, 0, 0, 0.1, 1]))
        return f'<div class="ad">{inner}</div>' if named != "none" and r.random() < 0.7 else f"<div>{inner}</div>"

    def notice() -> str:
        inner = say(r.randint(5, 40), r.choice([0, 0, 0.1]))
        return f'<div class="cookie-notice">{inner}</div>' if named != "none" else f"<div>{inner}</div>"

    def subscribe() -> str:
        inner = p(say(r.randint(4, 18))) + "<label>" + say(1) + "</label><input name=q>"
        return f"<form>{inner}</form>"

    def comments() -> str:
        each = "".join(f'<div class="comment"><p>{say(r.randint(3, 60))}</p></div>' if named != "none" else f"<li>{say(r.randint(3, 60))}</li>" for _ in range(r.randint(1, 6)))
        head = f"<h3>{say(r.randint(1, 2))}</h3>"
        return f'<div id="comments">{head}{each}</div>' if named != "none" else f"<div>{head}<ul>{each}</ul></div>"

    def body() -> str:
        out = [f"<h1>{say(r.randint(2, 16), kept=True)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 12)):
            roll = r.random()
            if roll < 0.55:
                out.append(p(say(r.randint(15, 150), r.choice([0, 0, 0, 0.05, 0.15]), True)))
            elif roll < 0.78:
                # short paragraphs, alone or in a row as in speech
                out += [p(say(r.randint(1, 15), r.choice([0, 0, 0, 0.2]), True)) for _ in range(r.choice([1, 1, 2, 5]))]
            elif roll < 0.86:
                out.append("<{0}>{1}</{0}>".format(r.choice(["h2", "h2", "h3"]), say(r.randint(1, 9), kept=True)) + p(say(r.randint(20, 90), kept=True)))
            elif roll < 0.94:
                out.append("<ul>" + "".join(f"<li>{say(r.randint(2, 25), r.choice([0, 0, 0.2]), True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            else:
                out.append(f"<blockquote>{say(r.randint(8, 50), kept=True)}</blockquote>")
        if r.random() < 0.15:
            out.insert(r.randint(0, len(out)), advert())
        if r.random() < 0.15:  # a list of links alone is a menu wherever it stands
            out.append("<ul>" + "".join(f"<li>{say(r.randint(2, 9), 1.0)}</li>" for _ in range(r.randint(3, 7))) + "</ul>")
        return "".join(out)

    around = [part("header", "site-header", p(say(r.randint(1, 6), r.choice([0, 1])))), part("nav", "navbar", menu())]
    around += [f() for f in (advert, notice) if r.random() < 0.5]
    r.shuffle(around)
    after = [part("footer", "site-footer", say(r.randint(2, 30), r.choice([0, 0.3, 1])))]
    after += [comments()] if r.random() < 0.35 else []
    after += [part("aside", "sidebar", f"<h3>{say(r.randint(1, 3))}</h3>" + (menu() if r.random() < 0.6 else p(say(r.randint(5, 35), 0.2))))] if r.random() < 0.5 else []
    after += [f() for f in (advert, subscribe) if r.random() < 0.3]
    r.shuffle(after)
    if r.random() < 0.2:
        around, after = around + [x for x in after if x.startswith("<aside")], [x for x in after if not x.startswith("<aside")]
    # bare pages, and pages of which a part is missing
    around, after = around if r.random() < 0.8 else [], after if r.random() < 0.8 else []
    text = body()
    if named == "elements":
        text = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]).format(text)
    elif named == "classes":
        text = f'<div class="post-content">{text}</div>'
    elif r.random() < 0.5:
        text = f"<div>{text}</div>"
    page = "".join(around) + text + "".join(after)
    # some servers wrap every page in one form
    return f"<body><form action=x><input name=v>{page}</form></body>" if "<form" not in page and r.random() < 0.15 else f"<body>{page}</body>"


def labelled(pages: int = LABELLED_PAGES, seed: int = LABELLED_SEED) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of blocks, and whether they are main text."""
    r, rows, labels = random.Random(seed), [], []
    for _ in range(pages):
        found = blocks(sample_page(r))
        rows.append(features(found))
        labels += [KEPT in b.text for b in found]
    return np.concatenate(rows), np.array(labels)


# --- the tree


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> tuple:
    """A tree by Gini impurity: (feature, limit, tree up to it, tree above), or a label by majority.

    Of equal cuts the first feature's least limit counts."""
    n, ones = len(labels), int(labels.sum())
    best, at = n - (ones**2 + (n - ones) ** 2) / n, None
    if depth and 0 < ones < n:
        for f in range(rows.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            x, left = rows[order, f], np.cumsum(labels[order])
            size = np.arange(1, n + 1)
            cut = np.flatnonzero((x[:-1] != x[1:]) & (size[:-1] >= leaf) & (n - size[:-1] >= leaf))
            if not len(cut):
                continue
            a, b = size[cut], n - size[cut]
            p, q = left[cut], ones - left[cut]
            cost = a - (p**2 + (a - p) ** 2) / a + b - (q**2 + (b - q) ** 2) / b
            k = int(cost.argmin())
            if cost[k] < best - 1e-9:
                best, at = float(cost[k]), (f, int(x[cut[k]]))
    if at is None:
        return (int(2 * ones > n),)
    low = rows[:, at[0]] <= at[1]
    return (*at, grow(rows[low], labels[low], depth - 1, leaf), grow(rows[~low], labels[~low], depth - 1, leaf))


@cache
def tree() -> tuple:
    return grow(*labelled())


def decide(row, node: tuple) -> int:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node[0]


def shown(node: tuple, indent: str = "") -> str:
    """The tree as text."""
    if len(node) == 1:
        return f"{indent}{'keep' if node[0] else 'drop'}\n"
    return f"{indent}{FEATURES[node[0]]} <= {node[1]}:\n{shown(node[2], indent + '  ')}{indent}else:\n{shown(node[3], indent + '  ')}"


def extract(page: str | None, node: tuple | None = None) -> str:
    """The main text of a page: kept blocks in order, joined by an empty line."""
    node = node or tree()
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, features(found).tolist()) if decide(row, node))


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page.  No shuffle; the tree is grown once, on the driver."""
    prepare(pages.sparkSession)
    node = tree()

    def run(batches):
        for b in batches:
            texts = [extract(x, node) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[f"`{page_id}`"].cast("long").alias("page_id"), pages[f"`{url}`"].cast("string").alias("url"), empty_if_null(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
