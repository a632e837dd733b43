"""Operator 3: main text of web pages by equivalence-class template deduction.

Pages of one host come from one template.  Tokens (tags, and words in their tag
path) that occur equally often on every page of a batch of same-host pages form
an equivalence class; classes whose tokens keep one order on every page, and that
nest in one gap of a larger class, make up the template.  Containers of one name
in one parent are told apart by their rank.  What the template does not fix are
slots; the article is the container of the template whose own slot is filled with
most running text (links aside) on most pages, widened to the largest container around it
that holds no text of the site's own and no links alone beside it (or to the article
element it lies in), and the main text is what fills all slots within it, whatever
their size.  Text blocks made of template words alone are the site's own and go.
Element and class names only part off what is no article by its name, narrow the
container to an article element within it, and stand in where no template is
found (a host's only page).
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.llm.common import small_batches, table
from aerolake.runtime import broadcastable

#: Pages and bytes of a batch of same-host pages, at most about.
BATCH_PAGES, BATCH_BYTES = 256, 16 << 20
#: Share of a batch's distinct pages that hold a template token; tokens of a class; pages from which words alone, without whole blocks, are evidence.
SUPPORT, CLASS_SIZE, EVIDENCE = 0.9, 3, 8
#: A further container, outside the widened one, is of the article if its slot holds this share of the richest one's words.
ALSO = 0.4

# Fixed values of HTML and of common usage.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "video", "audio", "head", "title"}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "byline",
    "comment", "comments", "consent", "contact", "cookie", "cookies", "copyright", "disclaimer", "discussion", "disqus", "feedback", "footer", "form", "gdpr", "header",
    "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup", "promo",
    "promotion", "recommended", "register", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "teaser", "toolbar", "topbar", "warning", "widget",
}
READERS = {"comment", "comments", "disqus", "discussion", "replies", "reply", "respond", "responses"}
# Names that say one thing alone; within article and main, and of headings, no others count.
SURE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies",
    "disqus", "gdpr", "navbar", "newsletter", "pagination", "sidebar", "sponsored",
}
SURE_READERS = {"comment", "comments", "disqus"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Elements that lay out a page; the article is one of them.  Of article and main, all in one parent are one.
CONTAINERS = {"body", "div", "section", "article", "main", "header", "td", "center"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|object|svg|math|canvas|video|audio|head|title|textarea)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
    r"|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|</?[a-zA-Z][^<>]*>|<[!?][^>]*>|<[/a-zA-Z!?][^<>]*\Z|[^<]+|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class _Tag:
    """A parsed tag: name, whether it closes, its label in paths and what its names say."""

    __slots__ = ("name", "closing", "label", "named", "readers", "sure", "sure_readers", "hidden", "empty", "wide")

    def __init__(self, raw: str):
        found = re.match(r"<(/?)\s*([a-zA-Z][^\s/>]*)", raw)
        self.closing, self.name = bool(found[1]), found[2].lower()
        said = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw[found.end() :].rstrip(">"))} if not self.closing else {}
        names = re.sub(r"\d+", "", f"{said.get('class', '')} {said.get('id', '')}").strip()
        parts = {x.lower() for x in _PART.findall(names)}
        own = parts
        if self.name == "section" or self.name in HEADINGS:  # their ids are made of what they say
            own = {x.lower() for x in _PART.findall(said.get("class", ""))} | ({said.get("id", "").lower()} & {"comments", "disqus"} if self.name == "section" else set())
        role = said.get("role", "").lower() in ROLES
        self.sure, self.sure_readers = bool(own & SURE) or role, bool(own & SURE_READERS)
        self.named, self.readers = bool(parts & NAMED) or role, bool(parts & READERS)
        self.wide = self.name in CONTAINERS and bool(parts - NAMED) and not role  # may be named after what it holds beside the article
        if self.name in HEADINGS:
            self.named, self.readers = self.sure, self.sure_readers
        self.hidden = "hidden" in said or re.search(r"display\s*:\s*none", said.get("style", ""), re.I) is not None
        self.label = f"{self.name}.{names}" if names else self.name
        self.empty = self.name in VOID or raw.endswith("/>")


class _Page:
    """A page as template tokens and text: ``roles`` of tags in order, and ``texts`` between them."""

    __slots__ = ("roles", "texts", "title", "region")

    def __init__(self, source: str, tags: dict):
        self.roles: list[str] = []
        self.texts: list[list] = []  # [roles before it, path, text, kept, in article, in main, container, in a link, in a first heading]; text None parts blocks
        self.title, self.region = "", [False, False]
        stack: list[tuple] = []  # name, path, hard, soft, in article, in main, container, in a link, in a first heading
        path, hard, soft, article, main, place, link, head = "", False, (), False, False, "", False, False
        wide: list[bool] = []  # of the elements that their names part off
        ranks: Counter = Counter()
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.match(source, at)
            raw, at = m[0], m.end()
            if raw[0] != "<" or raw == "<":
                self.texts.append([len(self.roles), path, raw, (hard, soft), article, main, place, link, head])
                continue
            if raw[1] in "!?" or raw[-1] != ">":  # comments, declarations, a tag that the end cuts off
                continue
            tag = tags.get(raw)
            if tag is None:
                if len(tags) > 50_000:
                    tags.clear()
                tag = tags[raw] = _Tag(raw)
            name = tag.name
            if name == "br":  # white space within a block
                self.texts.append([len(self.roles), path, "\n", (hard, soft), article, main, place, link, head])
            elif name not in INLINE:
                self.texts.append([len(self.roles), path, None, (True, ()), article, main, place, link, head])
            if m["raw"] and not tag.closing and not tag.empty and name != "textarea":
                close = re.compile(rf"</{name}\s*>|\Z", re.I).search(source, at)
                inside, at = source[at : close.start()], close.end()
                if name == "head" and not close[0]:  # a head that never ends: go on after its start
                    at = m.end()
                elif name in ("head", "title") and not self.title and (t := re.search(r"<title[^>]*>([^<]*)", f"<title>{inside}" if name == "title" else inside, re.I)):
                    self.title = t[1].strip()
                self.roles.append(f"{path}/{tag.label}<>")
                continue
            if tag.closing:
                if any(s[0] == name for s in stack):
                    while True:
                        popped, was = stack.pop(), place
                        path, hard, soft, article, main, place, link, head = popped[1:]
                        if popped[0] == name:
                            break
                    if was != place:
                        self.roles.append(f"{was}>")
                        continue
                self.roles.append(f"{path}/{name}>")
                continue
            if tag.empty:
                self.roles.append(f"{path}/{tag.label}<>")
                continue
            while stack and (stack[-1][0] in _CLOSE.get(name, ()) or (name in _ENDS_P and any(s[0] == "p" for s in stack) and stack[-1][0] in INLINE | {"p"})):
                path, hard, soft, article, main, place, link, head = stack.pop()[1:]
            stack.append((name, path, hard, soft, article, main, place, link, head))
            path = f"{path}/{tag.label}"
            if name in CONTAINERS:
                inner = f"{place}|{tag.label}"
                if name not in ("article", "main"):
                    ranks[inner] += 1
                    inner = f"{inner}#{ranks[inner]}"
                place = inner
                self.roles.append(f"{place}<")
            else:
                self.roles.append(f"{path}<")
                link, head = link or name == "a", head or name == "h1"
            inside = article or main
            named, readers = (tag.sure, tag.sure_readers) if inside else (tag.named, tag.readers)
            if name in ("article", "main"):
                if tag.readers if article else tag.sure_readers:  # an article within one is a reader's if it may be
                    hard = True
                elif not hard:
                    soft = ()  # wrappers may be named after what stands beside the article
                    article, main = article or name == "article", main or name == "main"
                    self.region[name == "main"] = True
            elif name in CHROME or name in RAW or tag.hidden or readers or (name == "header" and not inside):
                hard = True
            elif named and name not in ("html", "body"):
                soft += (len(wide),)
                wide.append(tag.wide)
        self._settle(wide)

    def _settle(self, wide: list[bool]) -> None:
        """Decide what is kept: a name does not part off the element that holds most of the page's running text, if it may be named after a part."""
        words, total = Counter(), 0
        for entry in self.texts:
            (hard, soft), text, link = entry[3], entry[2], entry[7]
            if text and not hard and not link:
                n = len(text.split())
                total += n
                for k in soft:
                    words[k] += n
        lifted = {k for k, n in words.items() if wide[k] and 2 * n > total}
        for entry in self.texts:
            hard, soft = entry[3]
            entry[3] = not hard and all(k in lifted for k in soft)


_END = [0, "", None, False, False, False, "", False, False]


def _vectors(pages: list[_Page]) -> tuple[dict, dict]:
    """Tokens that most pages hold, by occurrence vector: tag roles, and words as (path, word)."""
    least = max(2, SUPPORT * len(pages))
    counts = [Counter(p.roles) for p in pages]
    df: Counter = Counter()
    for c in counts:
        df.update(c.keys())
    tags = defaultdict(list)
    for role, n in df.items():
        if n >= least:
            tags[tuple(c[role] for c in counts)].append(role)
    said: list[dict] = []
    by_path: dict[str, Counter] = defaultdict(Counter)
    for p in pages:
        here = defaultdict(Counter)
        for _, path, text, *_ in p.texts:
            if text:
                here[path].update(text.split())
        for path, words in here.items():
            by_path[path].update(words.keys())
        said.append(here)
    words = defaultdict(list)
    for path, seen in by_path.items():
        for word in [w for w, n in seen.items() if n >= least]:
            words[tuple(h[path][word] if path in h else 0 for h in said)].append((path, word))
    return tags, words


def _blocks(page: _Page) -> list[str]:
    """The blocks of kept text, white space made one blank."""
    out, words = [], []
    for entry in [*page.texts, _END]:
        if entry[2] is None:
            if words:
                out.append(" ".join(words))
            words = []
        elif entry[3]:
            words += entry[2].split()
    return out


def _distinct(pages: list[_Page]) -> tuple[list[_Page], Counter]:
    """One page of each content, and how many of them hold a block; pages without tags are left out.

    A page that shares half of its text with an earlier one is a copy.  Blocks that
    most of at least EVIDENCE pages hold are the site's and do not count as shared.
    """
    held = {tuple(_blocks(p)): p for p in reversed(pages) if p.roles}
    df = Counter(b for blocks in held for b in set(blocks))
    common = {b for b, n in df.items() if n >= SUPPORT * len(held)} if len(held) >= EVIDENCE else set()
    out, sizes, holders = [], [], defaultdict(list)
    for blocks, page in reversed(held.items()):
        own = set(blocks) - common
        size, shared = sum(map(len, own)), Counter()
        for block in own:
            for k in holders[block]:
                shared[k] += len(block)
        if any(2 * n >= min(size, sizes[k]) for k, n in shared.items()):
            continue
        for block in own:
            holders[block].append(len(out))
        out.append(page)
        sizes.append(size)
    return out, Counter(b for p in out for b in set(_blocks(p)))


class Template:
    """The (path, word) tokens that pages share; their blocks, if words alone are not evidence enough; the containers of the article."""

    __slots__ = ("fixed", "blocks", "article")

    def __init__(self, fixed: set[tuple[str, str]] = frozenset(), blocks: set[str] | None = None, article: tuple[str, ...] = ()):
        self.fixed, self.blocks, self.article = fixed, blocks, article

    def own(self, block: list[tuple[str, str]]) -> bool:
        """Whether a block of (path, text) is the site's."""
        words = [(path, w) for path, text in block for w in text.split()]
        return bool(self.fixed) and all(w in self.fixed for w in words) and (self.blocks is None or " ".join(w for _, w in words) in self.blocks)


def _within(place: str, container: str) -> bool:
    return place.startswith(container) and place[len(container) : len(container) + 1] in ("", "|")


def _widened(place: str, beside: Counter, pages: int) -> str:
    """The article or main element that a container lies in, else the largest around it, below the outermost, with nothing of the site's beside."""
    labels = place.split("|")
    for name in ("article", "main"):
        for k, label in enumerate(labels):
            if label.split("#")[0].split(".")[0] == name:
                return "|".join(labels[: k + 1])
    while len(labels) > 3 and 2 * beside["|".join(labels[:-1]), labels[-1]] <= pages:
        labels.pop()
    return "|".join(labels)


def _article(pages: list[_Page], root: set[str], known: Template) -> tuple[str, ...]:
    """The root class's containers whose own slots hold the running text: the one richest on most pages, others nearly as rich and others of its kind, widened."""
    total: Counter = Counter()
    best: Counter = Counter()
    home: dict[str, str] = {}
    foreign: list[set[str]] = []  # by page, the places of the site's own text and of links alone
    for page in pages:
        here: Counter = Counter()
        block: list[tuple[str, str]] = []
        at, linked, apart = "", False, set()
        for entry in [*page.texts, _END]:
            if entry[2] is not None:
                if entry[3] and not entry[7]:
                    block.append((entry[1], entry[2]))
                    at = entry[6]
                elif entry[3] and entry[2].strip():
                    linked, at = True, entry[6]
                continue
            n = sum(len(text.split()) for _, text in block)
            if n and not known.own(block):
                if at not in home:
                    up = at
                    while up and up not in root:
                        up = up.rpartition("|")[0]
                    home[at] = up
                here[home[at]] += n
            elif n or linked:
                apart.add(at)
            block, linked = [], False
        foreign.append(apart)
        if here:
            total.update(here)
            best[max(here, key=lambda k: (here[k], k))] += 1
    if not best:
        return ()
    first = max(best, key=lambda k: (best[k], total[k], k))
    if not first:
        return ()
    parent, _, label = first.rpartition("|")
    kind = label.split("#")[0]
    alike = {k for k in total if kind not in CONTAINERS - {"section"} and k.rpartition("|")[0] == parent and k.rpartition("|")[2].split("#")[0] == kind}
    chosen = {k for k in total if k and total[k] >= ALSO * total[first]} | alike
    beside: Counter = Counter()  # pages that hold something of the site's in a container, but not in that child of it
    around = {"|".join(k.split("|")[: n + 1]) for k in chosen for n in range(2, k.count("|") + 1)}
    for apart in foreign:
        for inner in around:
            outer, _, child = inner.rpartition("|")
            beside[outer, child] += any(_within(p, outer) and not _within(p, inner) for p in apart)
    return tuple(sorted({_widened(k, beside, len(pages)) for k in chosen}))


def template(pages: list[_Page]) -> Template:
    """The template that these pages share.

    Copies count once, so that copies of an article are no evidence of a template,
    and pages without tags not at all.  The root class needs CLASS_SIZE tags that occur
    once, in one order, on the pages that hold them (SUPPORT of all at least); a class
    that repeats must lie in one gap of it.  Words belong to the template that have a
    valid class's vector and one gap.  Of fewer than EVIDENCE pages, a block must be the same.
    """
    distinct, df = _distinct(pages)
    if len(distinct) < 2:
        return Template()
    least = max(2, SUPPORT * len(distinct))
    tags, words = _vectors(distinct)
    places = [{r: k for k, r in enumerate(p.roles)} for p in distinct]  # last place; the only one for the root class
    single = {r for vector, roles in tags.items() if max(vector) == 1 for r in roles}
    fullest = max(places, key=lambda pl: sum(r in pl for r in single))
    root = sorted((r for r in single if r in fullest), key=fullest.get)
    ordered = {r: k + 1 for k, r in enumerate(root) if k == 0 or all(pl[root[k - 1]] < pl[r] for pl in places if r in pl and root[k - 1] in pl)}
    if len(ordered) < CLASS_SIZE:
        return Template()
    # before[i][k]: the last root tag among the first k tags of page i, so a place's gap in the root class
    before = [list(accumulate((ordered.get(r, 0) for r in p.roles), lambda gap, r: r or gap, initial=0)) for p in distinct]
    valid = set()
    for vector, roles in tags.items():  # classes that repeat, nested in one gap of the root
        if max(vector) > 1 and len(roles) >= 2:
            own = set(roles)
            spans = [[k for k, r in enumerate(p.roles) if r in own] for p in distinct]
            lies = Counter(held[s[0]] for held, s in zip(before, spans, strict=True) if s and held[s[0]] == held[s[-1]])
            if lies and max(lies.values()) >= least:
                valid.add(vector)
    fixed = {token for vector, tokens in words.items() if max(vector) == 1 or vector in valid for token in tokens}
    gaps: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for page, held in zip(distinct, before, strict=True):
        here: dict[tuple[str, str], set[int]] = defaultdict(set)
        for at, path, text, *_ in page.texts:
            if text:
                for word in text.split():
                    if (path, word) in fixed:
                        here[path, word].add(held[at])
        for token, at in here.items():
            if len(at) == 1:
                gaps[token].update(at)
    blocks = {b for b, n in df.items() if n >= least} if len(distinct) < EVIDENCE else None
    found = Template({token for token, at in gaps.items() if max(at.values()) >= least}, blocks)
    found.article = _article(distinct, {r[:-1] for r in ordered if r[0] == "|" and r[-1] == "<"}, found)
    return found


def main_text(page: _Page, known: Template) -> str:
    """The text of the article's slots: of the template's article, or without one of article elements, else of main, else of all the body.

    Where the template's article holds article (else main) elements, their text alone;
    a first heading beside it, in a container around it, counts as its own.
    """

    def found(chosen) -> str:
        parts, block = [], []
        for entry in [*page.texts, _END]:
            if entry[2] is None:  # a block ends
                if known.own(block):
                    block = []
                parts += [html.unescape(text) for _, text in block]
                parts.append("\n")
                block = []
            elif entry[3] and chosen(entry):
                block.append((entry[1], entry[2]))
        return " ".join("".join(parts).split())

    if known.article:
        inside = {place: any(_within(place, c) for c in known.article) for place in {entry[6] for entry in page.texts}}
        around = {place: any(_within(c, place) for c in known.article) for place in inside}
        held = [entry for entry in page.texts if inside[entry[6]] and entry[2] and entry[3] and entry[2].strip()]
        part = next((k for k in (4, 5) if any(entry[k] for entry in held)), None)
        titled = any(entry[8] for entry in held if part is None or entry[part])
        if held and (text := found(lambda e: inside[e[6]] and (part is None or e[part]) or not titled and e[8] and around[e[6]])):
            return text
    for region in (4, 5, None):
        if (region is None or page.region[region - 4]) and (text := found(lambda e: region is None or e[region])):  # noqa: B023
            return text
    return ""


def extract(sources: list[str]) -> list[str]:
    """Main texts of pages of one host."""
    tags: dict = {}
    pages = [_Page(s, tags) for s in sources]
    known = template(pages)
    return [main_text(p, known) for p in pages]


def page_texts(pages: DataFrame, batch_pages: int = BATCH_PAGES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of pages (page_id, url, html, any others): page_id, url, text, n_chars.

    text is empty where there is none (null, empty or markup-only html).  A null or
    hostless url counts as the host "".  Repeated rows give repeated rows.  Each
    host's pages are dealt, by a hash, to batches of bounded number and bytes, so a
    host with most of the pages is spread; every batch deduces its template from all
    its pages.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    small_batches(spark, 1000)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    sizes = rows.groupBy("host").agg(F.ceil(F.greatest(F.count(F.lit(1)) / batch_pages, F.sum(F.octet_length("html").cast("bigint")) / batch_bytes)).cast("int").alias("batches"))
    dealt = rows.join(F.broadcast(sizes) if broadcastable(sizes, 80) else sizes, "host")
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("page_id", "url"), F.greatest("batches", F.lit(1))).cast("int"))

    def of_group(group: pa.Table) -> pa.Table:
        texts = extract(group.column("html").to_pylist())
        return pa.table({"page_id": group.column("page_id"), "url": group.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return dealt.groupBy("host", "batch").applyInArrow(of_group, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all pages."""
    return page_texts(table(spark, sf_dir, "pages"))
