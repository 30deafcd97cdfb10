"""Main-text extraction by two-pass block rules.

The page becomes blocks: text between block-level tags, with the share of it in links, its stop-word density and the
place it stands in. Pass one gives each block a score: link-dense blocks lose, long ones and those rich in stop words
gain, prose-length blocks without stop words lose; the place only adds to that. An article or main section adds a
little; elements and class names for menus, headers, footers, sidebars, forms, notices, adverts and comments take away,
by how plainly they say so: an element like nav, or a name like comments, outweighs any density, a layout's name or a
form does not outweigh long prose. A high score is good, a low one bad, the rest is undecided. On a page with good text
in main sections, all outside them loses.

Pass two lets undecided blocks inherit from their nearest decided neighbours: within a main section they are good unless
both sides are bad; elsewhere they are good between good ones, a nearly good block beside a good one, and a heading
before one. If no block of the page is good, the undecided blocks of the section with most unlinked text are.

A class name counts only if all its parts name boilerplate or layout: 'related-posts' does, 'share-of-market' or
'story-related-events' do not. An article or main element that is not itself bad clears what it inherits from a form or
a layout's name; where the name is the bare word ('sidebar'), it does so only on a page without other main text.
Stop words, thresholds and weights are parameters.

Defined results: null html counts as empty; an empty page, or one without good blocks, gives the empty string.
Unclosed tags are closed by the next block; a cut-off tag or comment at the end is markup and gives no text. Time is
linear in the page, however its tags nest.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .common import per_document, table

#: Function words of the languages that the pages are in.
STOP_WORDS = frozenset(
    "the of and to a in is it that for on with as was by this be are at from or an not "
    "der die das und in zu den mit von für auf ist im nicht ein eine des dem sich "
    "le la les de des du et en un une est que qui dans pour par sur au pas avec "
    "el los las y en que se del un una por con no para es lo su al como".split()
)


@dataclass(frozen=True)
class BlockRules:
    #: Characters of a short and of a long block.
    short: int = 70
    long: int = 200
    #: Shares of stop words and of linked characters.
    stop_low: float = 0.05
    stop_high: float = 0.15
    max_link: float = 0.33
    stop_words: frozenset = STOP_WORDS
    #: What adds to a block's score.
    is_long: int = 1
    some_stop_words: int = 1
    many_stop_words: int = 2
    no_stop_words: int = -2
    many_links: int = -3
    in_main: int = 1
    outside_main: int = -2
    in_form: int = -2
    in_layout: int = -3
    in_boilerplate: int = -6
    #: Scores from which a block is good, nearly good, and to which it is bad.
    good: int = 3
    near: int = 1
    bad: int = -2


_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|\Z)", re.S)
_SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
_BAD = frozenset("nav header footer aside menu dialog fieldset".split())
_MAIN = frozenset("article main".split())
#: Parts of class names, ids and roles: of what is not the article, of layout, and those that say nothing beside them.
_BOILERPLATE = frozenset("ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion cookie cookies consent notice popup modal newsletter subscribe comment comments disqus reply replies respond related recommend recommended recommendations hidden gdpr".split())
_LAYOUT = frozenset("sidebar side menu nav navbar navigation breadcrumb breadcrumbs header footer foot share sharing social widget widgets login signup toolbar skip alert copyright".split())
_NEUTRAL = frozenset("list box block area section wrap wrapper container bar link links button buttons item items post posts article articles stories top bottom left right main site page primary secondary inner outer global this us".split())
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|entry|content|main|story|body)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HEADING = re.compile(r"h[1-6]$")
_ALONE = frozenset("li dd dt td th tr option".split())
_CLOSES_P = _BLOCK - {"body", "html"}
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: What a place says: a form, a layout's name, its bare word, plain boilerplate. The second last two clear in an article.
_FORM, _NAME, _BARE, _PLAIN = 1, 2, 3, 4


@dataclass
class Block:
    text: str
    linked: int
    tag: str
    place: int  # what the elements around it say: 0, or the strongest of the above
    main: int  # number of the innermost main section, 0 for none
    lifted: bool = False  # stands in an article that cleared a wrapper with a bare name
    score: int = 0
    label: str = ""


_said: dict[tuple[str, bool], int] = {}


def _says(names: str, titled: bool) -> int:
    """What class names, id and role say; titled: in a main section, where a header holds the title."""
    if (names, titled) in _said:
        return _said[names, titled]
    out = 0
    for token in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", token) if p]
        known = [p for p in parts if p in _BOILERPLATE or p in _LAYOUT and not (titled and p == "header")]
        if known and all(p in known or p in _NEUTRAL or p.isdigit() for p in parts):
            out = max(out, _PLAIN if any(p in _BOILERPLATE for p in known) else _BARE if len(parts) == 1 else _NAME)
    if len(_said) < 65536:
        _said[names, titled] = out
    return out


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # an open element: (tag, what its place says, main section, whether it is lifted)
    open_: list[tuple[str, int, int, bool]] = []
    count: Counter = Counter()  # of open elements by name
    parts: list[tuple[str, bool]] = []
    endless: set[str] = set()  # skipped elements that nothing closes
    kinds = [0]  # of main sections by number: 3 an article element, 2 a main element, 1 by its name
    links = 0

    def close_block():
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = len(" ".join(html.unescape("".join(t for t, k in parts if k)).split()))
                tag, place, main, lifted = open_[-1] if open_ else ("", 0, 0, False)
                out.append(Block(text, linked, tag, place, main, lifted))
            parts.clear()

    def pop():
        count[open_.pop()[0]] -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if not closing and name in _SKIPPED:
            if name in _BLOCK or name in ("head", "title"):
                close_block()
            if not m[3].endswith("/") and name not in endless:
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else n if name != "head" else at
            continue
        if name == "br":
            parts.append((" ", links > 0))
        elif name == "a":
            links = 0 if closing else 1
        if name in _BLOCK:
            close_block()
            links = 0
        elif name not in _VOID:
            continue  # inline: no structure
        if name in _VOID:
            continue
        if closing:
            if count[name]:
                while open_[-1][0] != name:
                    pop()
                pop()
            continue
        if open_ and (open_[-1][0] == "p" and name in _CLOSES_P or open_[-1][0] == name and name in _ALONE):
            pop()
        place, main, lifted = open_[-1][1:] if open_ else (0, 0, False)
        attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(m[3])} if m[3].strip(" /") else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".strip()
        inside = main != 0
        if name in _MAIN or names and not main and _MAIN_NAME.search(names) and name in ("div", "section", "td"):
            main = len(kinds)
            kinds.append(3 if name == "article" else 2 if name == "main" else 1)
        if name in _MAIN and place in (_FORM, _NAME, _BARE):
            place, lifted = 0, lifted or place == _BARE
        says = _says(names, inside) if names and name not in ("body", "html", "main") else 0
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")) or name in _BAD and not (name == "header" and inside):
            says = _PLAIN
        elif name == "form":
            says = max(says, _FORM)
        elif name == "article" and says < _PLAIN:
            says = 0
        count[name] += 1
        open_.append((name, max(place, says), main, lifted))
    close_block()
    if any(b.main and not b.place and not b.lifted for b in out):
        for b in out:
            b.place = _PLAIN if b.lifted else b.place
    # a page with text in article elements has no other main sections, one with text in main elements none by name
    best = max((kinds[b.main] for b in out if not b.place), default=0)
    for b in out:
        b.main = b.main if kinds[b.main] >= best else 0
    return out


def score_block(b: Block, rules: BlockRules) -> int:
    """Pass one: what links, length, stop words and the place add up to."""
    out = rules.in_main if b.main else 0
    out += (0, rules.in_form, rules.in_layout, rules.in_layout, rules.in_boilerplate)[b.place]
    n = len(b.text)
    if b.linked / n > rules.max_link:
        return out + rules.many_links
    if n < rules.short or _HEADING.match(b.tag):
        return out
    words = b.text.lower().split()
    stop = sum(w in rules.stop_words or _EDGES.sub("", w) in rules.stop_words for w in words) / len(words)
    out += rules.many_stop_words if stop >= rules.stop_high else rules.some_stop_words if stop >= rules.stop_low else rules.no_stop_words
    return out + rules.is_long * (n >= rules.long)


def classify(found: list[Block], rules: BlockRules = BlockRules()) -> None:
    """Labels each block good or bad, in two passes."""
    for b in found:
        b.score = score_block(b, rules)
    if any(b.main and b.score >= rules.good for b in found):
        for b in found:
            b.score += 0 if b.main else rules.outside_main
    for b in found:
        b.label = "good" if b.score >= rules.good else "bad" if b.score <= rules.bad else ""
    # a block that is bad by where it stands in a main section is no neighbour of that section's text
    decided = [b.label if b.label and not (b.place and b.main) else None for b in found]
    if "good" in decided:
        for left, right, i in _neighbours(found, decided):
            b = found[i]
            if b.main:
                ok = not left == right == "bad"
            else:
                ok = left == right == "good" or b.score >= rules.near and "good" in (left, right) or bool(_HEADING.match(b.tag)) and right == "good"
            b.label = "good" if ok else "bad"
        return
    mass: dict[int, int] = defaultdict(int)
    for b in found:
        if not b.label:
            mass[b.main] += len(b.text) - b.linked
    most = max(mass, key=lambda k: (k != 0, mass[k], -k), default=None)
    for b in found:
        b.label = b.label or ("good" if b.main == most else "bad")


def _neighbours(found: list[Block], decided: list[str | None]):
    """(nearest decided label before, after, index) of each undecided block; within its main section if it has one."""
    n = len(found)
    before: list[str | None] = [None] * n
    last: dict[int, str] = {}
    for i, b in enumerate(found):
        before[i] = last.get(b.main)
        if decided[i]:
            last[b.main] = decided[i]
    after: list[str | None] = [None] * n
    last = {}
    for i in range(n - 1, -1, -1):
        after[i] = last.get(found[i].main)
        if decided[i]:
            last[found[i].main] = decided[i]
    return [(before[i], after[i], i) for i in range(n) if not found[i].label]


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    found = blocks(page or "")
    classify(found, rules)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, rules: BlockRules = BlockRules()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. A narrow pass."""

    def run(cols):
        text = [main_text(h, rules) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return per_document(pages, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
