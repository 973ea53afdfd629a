"""HTML main-text extraction by consensus host paths (operator 2).

1. Each page's containers are scored: characters of the running text below an element, less those of
   links and of boilerplate. The best container votes for its generalised tag-class path.
2. Spark sums the votes by host; the path with the most votes wins.
3. Pages are read again with their host's winning path: the text of every container on that path is
   the page's text. A page without such a container falls back to its own best one.

What an element is for follows from its tag (menus, forms, ...) or, as a first guess only, from words of
its class, id or role. On such *marked* elements a page votes too: content, if nearly all of its running
text is there. Of a path on which the pages of a host disagree, or whose text repeats from page to page,
the host's majority decides, and repeated text is never content; else a page's own vote holds.

The scanner is a small one: tags, comments, raw-text elements (up to their own end tag, whatever they
hold) and the end tags HTML lets one omit. Its time and memory are linear in the page, however deep its
elements are nested and wherever a tag or quote is left open. Paths are 64-bit hashes.
A page is given its host's winning path and the verdicts on its own marked paths only. Both tables are
broadcast only after they were counted and found small; else pages are joined by host, or by host and html, and
salt, so that a host with many pages doesn't fill one task.

Defined results: null html counts as empty and gives an empty text; a null or broken url has the host
''; ids may be null or repeated, each row gives one row; a tag left open at the end of a page is
dropped; ties go to the deeper container, then to the earlier one, and between paths to the greater
hash; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What may end a tag: its '>', or a quoted value first.
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold plain text: no tag or comment in them counts but their own end tag.
PLAIN = frozenset("script style textarea title iframe noscript xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mfrac mi mn mo mrow ms msqrt msub msup mtext object".split())
#: Elements whose text is never part of an article.
APART = frozenset("nav footer aside form button select option menu dialog input head template svg canvas".split())
HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd dt figcaption".split())
#: An open element is closed by the start of one of these, up to the element named after the colon.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
CLOSES = {tag: [k for k, v in CLOSED_BY.items() if tag in v] for tag in frozenset().union(*CLOSED_BY.values())}
SCOPES = frozenset("ul ol dl table select article section div body main".split())
#: Words of class, id or role that speak against an article; a page's and its host's votes may overrule them.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent copyright disclaimer footer gdpr legal masthead menu modal navbar navigation nav newsletter notice notices overlay pager pagination popup privacy promo promoted promotion related recommended search share sharing sidebar social sponsor sponsored subscribe subscription terms toolbar widget widgets alert".split()
)
#: Words of readers' comments: overruled only where there is no other text.
READERS = re.compile(r"^(comment(?!ary|aries)|disqus|respon[ds]|repl(y|ies))")

#: Running text counts this much less for each level that a container is farther up.
FARTHER = 0.8
#: Share of the page's running text that a marked element must hold to be content.
MOST = 0.8
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in PLAIN}


class Element:
    __slots__ = ("tag", "path", "apart", "mark", "parent", "block", "depth", "text", "gain", "loss", "inside")

    def __init__(self, tag: str, path: int, apart: bool, mark: int, parent: Element | None, inline: bool = False):
        self.tag, self.path, self.apart, self.mark, self.parent = tag, path, apart, mark, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if inline and parent else self
        self.text, self.gain, self.loss, self.inside = 0.0, 0.0, 0.0, False


def generalised(tag: str, attributes: str) -> tuple[str, bool, int]:
    """(path step, hidden, mark: 0 to 2): tag and classes with digits replaced; what class, id and role say."""
    classes, mark, hidden = "", 0, False
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "class":
            classes = ".".join(sorted({re.sub(r"\d+", "#", c) for c in value.split()}))
        if name in ("class", "id", "role"):
            for word in re.split(r"[^a-z]+", value):
                mark = max(mark, 2 if READERS.match(word) else 1 if word in MARKS else 0)
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
    return f"{tag}.{classes}" if classes else tag, hidden, mark


def tags(source: str):
    """(text before, closing, name, attributes) of each tag; last the text after all, with the name ''."""
    at, n, quotes = 0, len(source), True
    text: list[str] = []
    while True:
        i = source.find("<", at)
        if i < 0 or i == n - 1:
            text.append(source[at:])
            break
        kind = source[i + 1]
        closing = kind == "/"
        name = NAME.match(source, i + 1 + closing)
        if not name and kind not in "!?/":
            text.append(source[at : i + 1])  # a '<' in running text
            at = i + 1
            continue
        text.append(source[at:i])
        if not name:
            end = source.find("-->", i + 4) + 3 if source.startswith("<!--", i) else source.find(">", i) + 1
            if source.startswith("<!-->", i):
                end = i + 5
            if end < 3:
                break
            at = end
            continue
        j = name.end()
        while quotes:
            stop = STOP.search(source, j)
            if not stop or not stop[1]:
                break
            j = source.find(stop[1], stop.end()) + 1
            if not j:
                stop = None
                break
        if not quotes or not stop:  # a quote is left open: from here on the next '>' ends a tag
            quotes, j = False, source.find(">", name.end())
            if j < 0:
                break
            stop_at = j
        else:
            stop_at = stop.start()
        at = stop_at + 1
        tag, attributes = name[0].lower(), source[name.end() : stop_at]
        yield "".join(text), closing, tag, attributes
        text.clear()
        if tag in PLAIN and not closing and not attributes.rstrip().endswith("/"):
            end = END[tag].search(source, at)
            if not end:
                break
            at = end.end()
    yield "".join(text), False, "", ""


def parsed(source: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """(elements in page order, blocks of running text in page order: element, text, characters in links)."""
    top = Element("", 0, False, 0, None)
    stack, elements, blocks = [top], [top], []
    open_: dict[str, int] = {}
    parts: list[str] = []
    links = articles = 0

    def flush():
        nonlocal links
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                blocks.append((stack[-1].block, text, links))
            parts.clear()
        links = 0

    def close(down_to: int):
        nonlocal articles
        if any(e.block is e for e in stack[down_to:]):
            flush()
        for e in stack[down_to:]:
            open_[e.tag] -= 1
            articles -= e.tag in ("article", "main")
        del stack[down_to:]

    for before, closing, tag, attributes in tags(source):
        if before:
            parts.append(before)
            if open_.get("a"):
                links += len(before)
        if not tag:
            break
        if closing:
            if open_.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in VOID and tag != "hr":
            if tag != "wbr":
                parts.append(" ")
            continue
        if tag not in INLINE:
            for shut in CLOSES.get(tag, ()):
                if open_.get(shut):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == shut:
                            close(k)
                            break
                        if stack[k].tag in SCOPES and stack[k].tag != tag:
                            break
            flush()
        if tag in PLAIN or tag == "hr":
            continue
        parent = stack[-1]
        step, hidden, mark = generalised(tag, attributes)
        if tag in INLINE:
            stack.append(Element(tag, parent.path, hidden, 0, parent, inline=True))
        else:
            # A header is the page's unless it stands in an article.
            apart = hidden or tag in APART or tag == "header" and not articles
            mark = 0 if tag in ("html", "body") or mark == 1 and tag in ("article", "main") else mark
            stack.append(Element(tag, xxhash.xxh64_intdigest(step, parent.path), apart, mark, parent))
            articles += tag in ("article", "main")
        elements.append(stack[-1])
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return elements, blocks


class Page:
    """A parsed page; `content` holds the host's verdicts on marked paths, where it has any."""

    def __init__(self, source: str, content: dict[int, bool] | None = None):
        self.elements, self.blocks = parsed(source)
        self.marked: list[tuple[Element, bool, list[str]]] = []
        self.decide(content or {})

    def decide(self, content: dict[int, bool]) -> None:
        """Settle which marked elements are content; `apart` and `mark` then hold for all that is below them."""
        outer: dict[int, Element | None] = {}
        for e in self.elements:
            above = outer.get(id(e.parent)) if e.parent else None
            e.apart |= bool(e.parent and e.parent.apart)
            outer[id(e)] = above or (e if e.mark and not e.apart else None)
        texts: dict[int, list[str]] = {}
        free = 0.0
        for e, text, in_links in self.blocks:
            if e.apart:
                continue
            if own := outer[id(e)]:
                own.text += max(0, len(text) - in_links)
                texts.setdefault(id(own), []).append(text)
            else:
                free += max(0, len(text) - in_links)
        for e in self.elements:
            if e.mark and outer[id(e)] is e:
                vote = e.text > 0 and (e.text >= MOST * (e.text + free) if e.mark == 1 else free == 0)
                self.marked.append((e, vote, texts.get(id(e), [])))
                # What is marked within content is apart: the votes of its own are not asked for.
                e.mark, e.apart = 0, not content.get(signed(e.path), vote)
        for e in self.elements:
            e.apart |= bool(e.mark or e.parent and e.parent.apart)

    def best(self) -> tuple[Element, float] | None:
        """The container with the highest score."""
        for e, text, in_links in self.blocks:
            # Blocks count for the elements around them, not for the block's own element.
            above = e.parent if e.tag in HEADINGS and e.parent else e
            gain = -float(len(text)) if e.apart else len(text) - 2.0 * in_links
            if gain > 0:
                above.gain += gain
            else:
                above.loss += gain
        best = None
        for e in reversed(self.elements):
            if e.block is e and not e.apart and (e.gain or e.loss):
                key = (e.gain + e.loss, e.depth)
                if best is None or key >= best[0]:
                    best = key, e
            if e.parent:
                e.parent.gain += FARTHER * e.gain
                e.parent.loss += e.loss
        if best is None:
            return None
        (score, _), found = best
        # A part of an article or main element stands for the whole of it.
        above = found
        while above is not None:
            if above.tag in ("article", "main") and not above.apart:
                found = above
            above = above.parent
        return found, score

    def text(self, path: int | None = None) -> str:
        """Text of the containers on `path`, or of the page's best container if it has none there."""
        for chosen in (path, None):
            best = self.best() if chosen is None else None
            for e in self.elements:
                e.inside = bool(e.parent and e.parent.inside) or (e.block is e and e.path == chosen if chosen is not None else best is not None and e is best[0])
            found = [text for e, text, _ in self.blocks if e.inside and not e.apart]
            if found:
                return "\n\n".join(found)
        return ""


def extract(source: str, path: int | None = None, content: dict[int, bool] | None = None) -> str:
    return Page(source, content).text(path)


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, k1, k2, path, score, content, digest): a page's vote for its container (content null) and on its marked elements.

    k1 and k2 name the page by its html.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for host, k1, k2, html in zip(*(batch.column(i).to_pylist() for i in range(4))):
                page = Page(html or "")
                rows += [(host, k1, k2, signed(e.path), 0.0, vote, xxhash.xxh3_64_intdigest("\n".join(texts)) >> 1) for e, vote, texts in page.marked if texts]
                best = page.best()
                if best and best[1] > 0:
                    rows.append((host, k1, k2, signed(best[0].path), best[1], None, None))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["host", "k1", "k2", "path", "score", "content", "digest"])

    own = pages.select(host_of(F.col("url")).alias("host"), *common.text_key(F.col("html")), "html")
    return common.by_batches(own, run, "host string, k1 long, k2 long, path long, score double, content boolean, digest long")


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the container path with the most votes."""
    summed = votes.filter("content IS NULL").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    return summed.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def page_verdicts(votes: DataFrame) -> DataFrame:
    """(host, k1, k2, content, apart): the marked paths of a page that its host decides against the page's own vote or another's.

    A page gets its own paths only, so what pages carry grows with the pages, however many paths their host has.
    """
    marked_ = votes.filter("content IS NOT NULL")
    each = marked_.groupBy("host", "path", "digest").agg(F.count("*").alias("n"), F.sum(F.col("content").cast("int")).alias("for"))
    marked = each.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("for").alias("for"), F.count("*").alias("texts"))
    content = (2 * F.col("for") > F.col("n")) & (2 * F.col("texts") > F.col("n"))
    open_ = marked.withColumn("content", content).filter(F.col("for") != F.when(F.col("content"), F.col("n")).otherwise(0)).select("host", "path", "content")
    own = marked_.select("host", "k1", "k2", "path").distinct().join(open_, ["host", "path"])
    of = lambda flag: F.collect_set(F.when(F.col("content") == flag, F.col("path")))  # noqa: E731  (a page's own elements)
    return own.groupBy("host", "k1", "k2").agg(of(True).alias("content"), of(False).alias("apart"))


def joined_by(pages: DataFrame, found: DataFrame, keys: list[str], size, salts: int) -> DataFrame:
    """Left join that broadcasts `found` if it was counted and small, and else splits pages of one key by salt."""
    few = common.broadcast_if_small(found, size=size)
    if few is not found:
        return pages.join(few, keys, "left")
    return pages.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "salt"], "left")


def extract_pages(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    folder = common.new_folder(pages.sparkSession)
    votes = common.written(page_votes(pages), folder)
    winners, verdicts = common.cut(winning_paths(votes)), common.cut(page_verdicts(votes))
    common.deleted(pages.sparkSession, folder)
    salt = F.pmod(F.xxhash64("page_id", "html"), F.lit(salts)).cast("int").alias("salt")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), *common.text_key(F.col("html")), salt)
    found = joined_by(own, winners, ["host"], F.length("host"), salts)
    found = joined_by(found, verdicts, ["host", "k1", "k2"], F.length("host") + 8 * (2 + F.size("content") + F.size("apart")), salts)

    def run(batches):
        for batch in batches:
            texts = []
            for html, path, content, apart in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                known = dict.fromkeys(content or (), True) | dict.fromkeys(apart or (), False)
                texts.append(extract(html or "", None if path is None else path % (1 << 64), known))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.by_batches(found.select("page_id", "url", "html", "path", "content", "apart"), run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    return extract_pages(pages)
