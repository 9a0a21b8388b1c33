"""HTML extraction by removal of site templates.

Every page is parsed once into a tree of elements. The subtrees around the main content are
hashed, once with their text and once as a shape (names, classes and roles,
repeated children as one), from the leaves up. Spark counts per host on how many different pages each hash
occurs; what recurs on many pages of its host is template and its subtree is
deleted. What is left, without elements that never are text, is the main text.

The main content is the article or main element, or what holds several, or else the whole page.
Blocks inside it go where the same text recurs in ``MANY_TEXTS`` clusters of pages: pages whose main contents
as a whole are near copies (five-word shingles, a similarity of 0.75 or more, by MinHash) are one cluster,
however many they are, so copies and near copies of an article are no
template of each other. Subtrees whose name, class or role says that they are no article text (comments,
adverts, sharing) go for a recurring shape as well, but for ``UNSURE`` words by their text alone.
Names, classes and roles decide alone on hosts with fewer than ``MANY`` pages, where nothing recurs,
and, ``UNSURE`` ones aside, where no lone element is named.

Pages are stored once, as pieces of text with the hashes of what they lie in, each task's in a bucket of its
own. The recurring hashes of a task's pages come to that bucket as one row, so no text is
shuffled and no list of templates is broadcast.

Null html, or html without text, gives the empty string. Pages with a null or odd url
belong to the host of the same name as the empty string. Repeated page rows are each extracted. Very long or
deep pages, and tags that never end, take time in proportion to their length.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from carrygrid.llm.components import Filter
from carrygrid.llm.near_dup import near_duplicates
from carrygrid.llm.store import small_batches, written
from carrygrid.llm.words import give_back
from carrygrid.session import shared_folder

MANY = 3  # pages of a host that make a subtree a template
MANY_TEXTS = 5  # for blocks that only their text tells
PAGE = 0  # stands for the page itself where hashes are counted: it recurs on hosts of MANY pages

# Element names of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
NO_TEXT = RAW | {"head", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "form", "fieldset", "menu", "dialog"}
NO_ARTICLE = {"nav", "header", "footer", "aside"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li",
    "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words of classes, ids and roles that mark what is no article text.
BOILERPLATE = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "hidden", "legal", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promoted", "related",
    "recommended", "reply", "replies", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "tags", "toolbar", "topbar", "widget", "alert", "contentinfo", "complementary", "discussion", "respond",
}
# Those of them that articles use too.
UNSURE = {"alert", "copyright", "discussion", "header", "legal", "notice", "reply", "search", "share", "tags", "widget"}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "marks", "hidden", "parent", "children", "start", "end", "sums")

    def __init__(self, name: str, marks: frozenset[str], hidden: bool, parent: Node | None) -> None:
        self.name, self.marks, self.hidden, self.parent = name, marks, hidden, parent
        self.children: list[Node | str] = []


def _attributes(text: str) -> tuple[frozenset[str], bool]:
    marks: set[str] = set()
    hidden = False
    for key, a, b, c in _ATTRIBUTE.findall(text):
        key, value = key.lower(), a or b or c
        if key == "hidden":
            hidden = True
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif key != "aria-label":
            marks.update(w.lower() for w in _WORD.findall(_CAMEL.sub(" ", value)))
    return frozenset(marks), hidden


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of all tags; comments and declarations have no name. The caller may send a place to go on from."""
    at = 0
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            found = (start, end + 3 if end >= 0 else len(html), "", "", "")
        elif html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            if end < 0:
                return
            found = (start, end + 1, "", "", "")
        elif m := _NAME.match(html, start):
            rest = _REST.match(html, m.end())
            # Where quotes do not pair up, the tag ends with the first bracket.
            end = rest.end() if rest else html.find(">", m.end()) + 1
            if not end:
                return
            found = (start, end, m[1], m[2].lower(), html[m.end() : end - 1])
        else:
            at = start + 1
            continue
        at = (yield found) or found[1]


def parse(html: str) -> Node:
    """The tree of a page. Open elements are closed as browsers do: p by blocks, items by their like."""
    root = node = Node("", frozenset(), False, None)
    opened: dict[str, int] = {}  # how many elements of each name are open
    at, tags, go_on = 0, _tags(html), None
    while True:
        try:
            start, end, slash, name, attributes = tags.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            node.children.append(html[at:start])
        at = end
        if not name:
            continue
        if slash:
            up = node if opened.get(name) else None
            while up is not None and up.name != name:
                # An end tag does not reach out of a cell or a block for inline names.
                up = up.parent if not (up.name in BLOCKS and name not in BLOCKS) else None
            if up is not None and up.parent is not None:
                node = _close(node, up.parent, opened)
            continue
        if name in ENDS_P or name in SIBLINGS:
            ends = SIBLINGS.get(name, {"p"})
            stop = {"ul", "ol", "dl", "table"} if name in SIBLINGS else {"table", "td", "th"}
            up, target = node if any(opened.get(x) for x in ends) else root, node
            while up.name and up.name not in stop:
                if up.name in ends:
                    target = up.parent
                    if name not in SIBLINGS:
                        break
                up = up.parent
                if name not in SIBLINGS and up.name in BLOCKS and up.name not in ends:
                    break
            node = _close(node, target, opened)
        child = Node(name, *_attributes(attributes), node)
        node.children.append(child)
        if name in RAW:
            found = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = go_on = found.end() if found else len(html)
        elif name not in VOID and not attributes.endswith("/"):
            node = child
            opened[name] = opened.get(name, 0) + 1
    if at < len(html):
        node.children.append(html[at:])
    return root


def _close(node: Node, upto: Node, opened: dict[str, int]) -> Node:
    """Close the open elements below ``upto``, which becomes the current one."""
    while node is not upto:
        opened[node.name] -= 1
        node = node.parent
    return upto


def boilerplate(node: Node) -> bool:
    """Whether name, class, id or role say that the element is no article text."""
    if node.name in ("html", "body"):
        return False
    return node.hidden or node.name in NO_ARTICLE or not BOILERPLATE.isdisjoint(node.marks)


def surely(node: Node) -> bool:
    """Whether they say so in words that articles have no other use for."""
    if node.name in ("html", "body"):
        return False
    return node.hidden or node.name in NO_ARTICLE - {"header"} or not (BOILERPLATE - UNSURE).isdisjoint(node.marks)


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))


def main_of(root: Node) -> tuple[Node, bool]:
    """The element that holds the main content, and whether its name says so: the whole page where none is named."""
    for wanted in ("article", "main"):
        outer: list[Node] = []
        stack = [root]
        while stack:
            x = stack.pop()
            if x.name == wanted or (wanted == "main" and "main" in x.marks and x.name in BLOCKS):
                outer.append(x)
            elif x.name == "header" or not boilerplate(x):
                stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
        if len(outer) == 1:
            return outer[0], True
        if outer:
            return _around(outer[0], outer[-1]), False
    return root, False


def _around(first: Node, last: Node) -> Node:
    """The smallest element that holds both, and so all between them."""
    above, x = set(), first
    while x is not None:
        above.add(id(x))
        x = x.parent
    x = last.parent
    while id(x) not in above:
        x = x.parent
    return x


def _hash(text: str) -> int:
    """64 bits of a text, the same in every task."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_P, _WORD64 = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _sum_up(root: Node) -> None:
    """Give every node ``sums``: a hash of the runs of text below it, and their number. Each node is seen twice."""
    stack = [(root, False)]
    while stack:
        x, done = stack.pop()
        if not done:
            stack.append((x, True))
            stack.extend((c, False) for c in x.children if isinstance(c, Node))
            continue
        total, count = 0, 0
        for c in x.children:
            if isinstance(c, str):
                run = _SPACE.sub(" ", c).strip()
                own, n = (_hash(run), 1) if run else (0, 0)
            else:
                own, n = c.sums
            if n:
                total, count = (total * pow(_P, n, 1 << 64) + own) & _WORD64, count + n
        x.sums = (total, count)


def _signed(x: int) -> int:
    x &= _WORD64
    return x - (1 << 64) if x >> 63 else x


def _label(node: Node) -> str:
    return node.name + "." + ".".join(sorted(node.marks))


def _shape(node: Node, depth: int = 3) -> str:
    """Names and marks of a subtree down to some depth, repeats in a row as one."""
    inner: list[str] = []
    if depth:
        for c in node.children:
            if isinstance(c, Node):
                s = _shape(c, depth - 1)
                if not inner or inner[-1] != s:
                    inner.append(s)
    return f"{_label(node)}({','.join(inner)})"


class Page:
    """A page as pieces of text, and the subtrees that may be template.

    ``texts`` are the runs of the main content in order, None between blocks; ``owners`` has the
    innermost such subtree around each, -1 for none. Of subtree ``i``, ``hashes[i]`` is that of its text, ``shapes[i]`` that
    of its shape or None, ``plain[i]`` whether only its text tells, ``around[i]`` the subtree around it; ``always[i]`` and
    ``alone[i]`` tell whether names decide, on hosts of many and of few pages.
    """

    COLUMNS = {
        "texts": pa.list_(pa.string()), "owners": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64()), "shapes": pa.list_(pa.int64()),
        "plain": pa.list_(pa.bool_()), "around": pa.list_(pa.int32()), "always": pa.list_(pa.bool_()), "alone": pa.list_(pa.bool_()),
    }
    DDL = (
        "texts array<string>, owners array<int>, hashes array<long>, shapes array<long>, plain array<boolean>, "
        "around array<int>, always array<boolean>, alone array<boolean>"
    )

    def __init__(self, root: Node) -> None:
        self.texts: list[str | None] = []
        self.owners: list[int] = []
        self.hashes: list[int] = []
        self.shapes: list[int | None] = []
        self.plain: list[bool] = []
        self.around: list[int] = []
        self.always: list[bool] = []
        self.alone: list[bool] = []
        _sum_up(root)
        main, named = main_of(root)
        path, x = set(), main
        while x is not None:
            path.add(id(x))
            x = x.parent
        # (node or None after a block, inside the main content, subtree around, hash of the names above)
        stack: list[tuple[Node | str | None, bool, int, int]] = [(root, main is root, -1, 0)]
        while stack:
            x, inside, owner, above = stack.pop()
            if x is None or isinstance(x, str):
                if inside and (x is None or x):
                    self._text(x, owner)
                continue
            if x.name in NO_TEXT:
                continue
            label = _label(x)
            if id(x) not in path:
                marked = boilerplate(x)
                if marked or not inside or (x.name in BLOCKS and x.sums[1]):
                    owner = self._subtree(x, label, marked, inside, named, owner, above)
                if x.hidden or not inside:
                    continue
                if marked:  # one subtree as a whole
                    self._texts_of(x, owner)
                    continue
                if x.name == "br":
                    self._text(" ", owner)
                    continue
            elif x.hidden and inside:
                continue
            inside = inside or x is main
            below = _hash(f"{above}>{label}")
            if x.name in BLOCKS and inside:
                self._text(None, -1)
                stack.append((None, True, -1, 0))
            stack.extend((c, inside, owner, below) for c in reversed(x.children))

    def _text(self, text: str | None, owner: int) -> None:
        if text is not None or (self.texts and self.texts[-1] is not None):
            self.texts.append(text)
            self.owners.append(owner)

    def _texts_of(self, node: Node, owner: int) -> None:
        stack: list[Node | str | None] = [node]
        while stack:
            x = stack.pop()
            if x is None or isinstance(x, str):
                self._text(x or None, owner)
            elif x.name == "br":
                self._text(" ", owner)
            elif x.name not in NO_TEXT and not x.hidden:
                if x.name in BLOCKS:
                    self._text(None, -1)
                    stack.append(None)
                stack.extend(reversed([c for c in x.children if c]))

    def _subtree(self, x: Node, label: str, marked: bool, inside: bool, named: bool, owner: int, above: int) -> int:
        number, plain = len(self.hashes), inside and not marked
        self.hashes.append(_signed(_hash(("u" if plain else "t") + label) ^ (x.sums[0] * _P + x.sums[1])))
        told = surely(x)
        self.shapes.append(_hash(f"s{'' if marked else above}|{_shape(x)}") if not plain and (told or not inside) else None)
        self.plain.append(plain)
        self.around.append(owner)
        self.always.append(x.hidden if named else told)
        self.alone.append(marked)
        return number


def main_text(texts: list, owners: list[int], around: list[int], recurs: list[bool], named: list[bool]) -> tuple[str, int]:
    """The text that is left when recurring subtrees and what never is article text are deleted, and how many subtrees recurred.

    The lists are those of a ``Page``; ``recurs`` and ``named`` tell for each subtree whether it goes, for the one reason or the other.
    """
    dead: list[bool] = []
    for again, name, up in zip(recurs, named, around):
        dead.append(again or name or (up >= 0 and dead[up]))
    blocks: list[str] = []
    line: list[str] = []
    for text, owner in zip([*texts, None], [*owners, -1]):
        if text is not None:
            if owner < 0 or not dead[owner]:
                line.append(text)
        elif line:
            block = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
            if block:
                blocks.append(block)
            line.clear()
    return "\n".join(blocks), sum(recurs)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, content, html) in; the same without html, with the place of the row and the lists of its ``Page``, out."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            some = batch.slice(first, 200)
            pages = [Page(parse(html.as_py() or "")) for html in some.column(4)]
            n = len(pages)
            lists = [pa.array([getattr(p, name) for p in pages], kind) for name, kind in Page.COLUMNS.items()]
            yield pa.RecordBatch.from_arrays(
                [*some.columns[:4], pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int32()), *lists],
                names=["page_id", "url", "host", "content", "part", "row", *Page.COLUMNS],
            )
            at += n
        give_back()


def stored_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The parsed pages as a table with a bucket for each task, so that joining by task moves none of them."""
    kind = pages.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    named = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.xxhash64("html").alias("content"), "html")
    parsed = named.mapInArrow(_pages, f"page_id {kind}, url string, host string, content long, part int, row int, {Page.DDL}")
    name = f"parsed_pages_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "pages")
    with small_batches(spark):
        parsed.write.bucketBy(buckets, "part").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def page_clusters(spark: SparkSession, stored: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, cluster) of the wanted ``pages`` (id): near copies by their whole main contents are one cluster."""
    wanted = Filter(pages)
    columns = stored.select("part", "row", "texts")

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (batch.column(0).cast(pa.int64()).to_numpy() << 32) + batch.column(1).cast(pa.int64()).to_numpy()
            some = wanted(ids)
            texts = [" ".join(t or " " for t in x.as_py()) if keep else None for x, keep in zip(batch.column(2), some)]
            out = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts, pa.string())], names=["id", "text"])
            yield out.filter(pa.array(some))
            give_back()

    # The bitmap may let a few other pages pass, which does no harm; so no text is moved or written again.
    texts = columns.mapInArrow(contents, "id long, text string")
    return near_duplicates(spark, texts, "id").select(F.col("doc_id").alias("id"), F.col("component_id").alias("cluster"))


def _key(hash_of: Column) -> Column:
    """One number for a hash on the host of the row: the host's name is not shuffled with every hash."""
    return F.xxhash64("host", hash_of)


def templates(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """Keys (host and hash) of the subtrees that recur on ``MANY`` different pages of their host, however many pages it has.

    Copies of a page count once; where only the text tells, ``MANY_TEXTS`` clusters of near copies are needed. Counting
    goes by (key, page) first, so a large host is spread.
    """
    marked = F.filter(F.concat("hashes", "shapes"), lambda h, i: h.isNotNull() & ~F.coalesce(F.get("plain", i % F.size("plain")), F.lit(False)))
    marked = F.concat(F.array(F.lit(PAGE).cast("long")), marked)
    plain = F.filter("hashes", lambda h, i: F.get("plain", i))
    number = (F.col("part").cast("long") * F.lit(1 << 32) + F.col("row")).alias("id")

    def counted(rows: DataFrame, what: str, least: int) -> DataFrame:
        return rows.groupBy("key").agg(F.count_distinct(what).alias("n")).where(F.col("n") >= least).select("key")

    named = stored.select("content", F.explode(F.array_distinct(F.transform(marked, _key))).alias("key"))
    told = stored.select("content", number, F.explode(F.array_distinct(F.transform(plain, _key))).alias("key"))
    # Most blocks never recur; only pages that hold one that does are compared with each other.
    again = written(spark, told.select("key", "id").join(counted(told, "content", MANY_TEXTS), "key"), "recurring")
    found = counted(named, "content", MANY)
    if not again.isEmpty():
        clusters = page_clusters(spark, stored, again.select("id").distinct())
        found = found.union(counted(again.join(clusters, "id"), "cluster", MANY_TEXTS))
    return written(spark, found, "templates")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_templates (subtrees deleted as recurring) of every page."""
    stored = stored_pages(spark, pages)
    found = templates(spark, stored)
    hashes = F.array_compact(F.concat(F.array(F.lit(PAGE).cast("long")), "hashes", "shapes"))
    held = stored.select("part", "row", F.explode(F.array_distinct(F.transform(hashes, _key))).alias("key"))
    # Each page gets its own recurring keys only, so a host may have any number of them; a task gets those of its pages, by row.
    own = held.join(found, "key").groupBy("part", "row").agg(F.collect_list("key").alias("own"))
    every = stored.select("part", "row").join(own, ["part", "row"], "left").select("part", "row", F.coalesce("own", F.array().cast("array<long>")).alias("own"))
    lists = every.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "own"))), lambda x: x["own"]).alias("lists"))
    in_place = F.get("lists", F.col("row"))

    def held_here(names: Column) -> Column:
        return F.transform(names, lambda h: F.coalesce(F.array_contains(F.col("template"), _key(h)), F.lit(False)))

    joined = stored.join(lists.hint("shuffle_hash"), "part").withColumn("template", in_place)
    recurs = F.zip_with(held_here(F.col("hashes")), held_here(F.col("shapes")), lambda x, y: x | y)
    many = F.array_contains("template", _key(F.lit(PAGE).cast("long")))
    chosen = joined.select("page_id", "url", "texts", "owners", "around", recurs.alias("recurs"), F.when(many, F.col("always")).otherwise(F.col("alone")).alias("named"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                some = batch.slice(first, 500)
                found = [main_text(*x) for x in zip(*(c.to_pylist() for c in some.columns[2:]))]
                texts, removed = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(removed, pa.int32())],
                    names=["page_id", "url", "text", "n_chars", "n_templates"],
                )
            give_back()

    kind = pages.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(clean, f"page_id {kind}, url string, text string, n_chars long, n_templates int")
