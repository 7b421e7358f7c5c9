"""Main text of web pages: structure marks blocks, nearest-URL page differencing deletes the template.

A page becomes lines (one for each block), and those of elements of the kinds and class names listed below are dropped.
Every page with a host and a line is aligned by longest common subsequence (bit-parallel, in bounded memory) with the nearest
page before it and the nearest after it in the order of (host, path) on its host, and the lines that neither shares are its own.

A page without text in article or main elements returns its own lines. With such text, the check on structure follows: shared lines in an article
stay, as copies of an article on one host, and passages that many articles quote, are shared lines as well, and what stands outside goes. But where differencing has found the
template (a shared line outside) and the own lines outside hold more than twice the text of these elements, they are a teaser, and the page's own lines are its text.
Marks by name make no article or main element junk, and inside of them only names that are marks as a whole count, so that "social-impact" stays.

Equal pages that follow each other are one class, and a page that shares more than half of the text of both
together is a copy: what it shares is content as much as template, so the next page beyond it is taken. Without
a page on the host that is no copy nothing can be told apart, and all lines stay.

The order is global: pages are numbered by ranges of the key, and neighbours are found by number, so the
result does not depend on partitions. Lines are equal in a comparison when their 64-bit hashes are; only hashes and lengths are stored and
shuffled, and pages are parsed again for their text.

Defined results: null and empty pages, and pages without main text, give the empty text. A page whose url is
null or has no host is compared with none, and pages without a line teach nothing.
"""

from __future__ import annotations

import hashlib
import html
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, staged

#: Elements whose text is never main text.
JUNK = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea dialog menu head title audio video map".split())
#: Junk outside of an article; inside, it may hold the headline.
OUTER_JUNK = frozenset(["header"])
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript template iframe".split())
MAIN = frozenset(["article", "main"])
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that are tracked until their end tag.
CONTAINERS = (BLOCKS | JUNK) - frozenset(["p", "hr", "h1", "h2", "h3", "h4", "h5", "h6"])
SPACES = frozenset(["br", "td", "th", "wbr", "img"])
#: Words of class, id or role that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe subscription widget complementary search alert".split()
)
_TOKEN = regex.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|[^<]+|<""", regex.S)
_MARKED = regex.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
_HIDDEN = regex.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none""", regex.I)
_WORD = regex.compile(r"[a-z]+")
#: What follows in a name tells of something else on the page or of its subject, as in "content-with-sidebar" and "category-social".
TELLING = frozenset("has with without no not is show hide category cat tag topic".split())
#: Words that leave a name what its marks make it, as in "user-comments" and "sidebar-left".
NEUTRAL = frozenset("user list box wrap wrapper container section area block bar body button buttons form inner item items left link links outer post posts primary right secondary slot thread unit".split())
#: How far a name marks an element: by a part (counts outside of article and main only), or as a whole.
PARTLY, WHOLLY = 1, 2
#: How many times the text of article and main elements the page's own lines outside must hold for these to be a teaser.
TEASER = 2


@dataclass
class Line:
    text: str
    main: bool
    junk: bool
    shared: bool = False


def marked(attributes: str, slug: bool = False) -> int:
    """How far class, id, role or style mark an element as no part of the article: 0, PARTLY or WHOLLY.

    An id is no compound of marks but a name of its own, and of an element whose id is a slug of its text (slug), parts count nowhere.
    """
    if not attributes:
        return 0
    low = attributes.lower()
    if "hidden" in low or "display" in low:
        if _HIDDEN.search(low):
            return WHOLLY
    most = 0
    if "class" in low or "id" in low or "role" in low:
        for m in _MARKED.finditer(low):
            is_id = m.group(1) == "id"
            for name in (m.group(2) or m.group(3) or m.group(4) or "").split():
                if name in MARKS:
                    return WHOLLY
                words = _WORD.findall(name)
                words = words[: next((i for i, x in enumerate(words) if x in TELLING), len(words))]
                if not MARKS.intersection(words) or is_id and slug:
                    continue
                if not is_id and all(x in MARKS or x in NEUTRAL for x in words):
                    return WHOLLY
                most = PARTLY
    return most


def hidden(attributes: str) -> bool:
    return bool(_HIDDEN.search(attributes.lower()))


@dataclass
class _Page:
    lines: list[Line] = field(default_factory=list)
    open: list[tuple[str, int]] = field(default_factory=list)  # name, mark
    names: Counter = field(default_factory=Counter)  # of open elements
    words: list[str] = field(default_factory=list)
    junk: int = 0
    partly: int = 0
    main: int = 0
    article: int = 0
    aside: bool = False  # the open paragraph or heading is marked itself

    def cut(self) -> None:
        if self.words:
            text = " ".join(html.unescape("".join(self.words)).split())
            if text:
                self.lines.append(Line(text, self.main > 0, self.junk > 0 or self.aside or self.partly > 0 and not self.main))
            self.words = []
        self.aside = False

    def mark(self, name: str, attributes: str) -> int:
        """How far an element that opens here is marked. An article in an article, as comments are, may be marked, no other article and no main element."""
        if name in ("body", "html"):
            return 0
        if name == "main" or name == "article" and not self.article:
            return WHOLLY if hidden(attributes) else 0
        got = marked(attributes, name not in CONTAINERS)
        return 0 if got == PARTLY and self.main else got

    def push(self, name: str, mark: int) -> None:
        self.open.append((name, mark))
        self.names[name] += 1
        self.count(name, mark, 1)

    def count(self, name: str, mark: int, by: int) -> None:
        self.junk += by * (mark == WHOLLY)
        self.partly += by * (mark == PARTLY)
        self.main += by * (name in MAIN)
        self.article += by * (name == "article")

    def pop(self, name: str) -> None:
        """Closes the innermost open element of this name and all inside it; a stray end tag closes nothing."""
        if not self.names[name]:
            return
        while True:
            got, mark = self.open.pop()
            self.names[got] -= 1
            self.count(got, mark, -1)
            if got == name:
                return


def page_lines(source: str) -> list[Line]:
    """The blocks of a page that have text, in page order, white space turned into single spaces."""
    page, at, n = _Page(), 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            part = m.group()
            if part[:2] in ("<!", "<?"):
                continue
            page.words.append(part)
            continue
        name = name.lower()
        if m.group(1):
            if name in BLOCKS or name in JUNK:
                page.cut()
            if name in CONTAINERS:
                page.pop(name)
            elif name in SPACES:
                page.words.append(" ")
            continue
        if name in SPACES:
            page.words.append(" ")
        if name in RAW:
            page.cut()
            end = regex.compile(rf"</{name}[^>]*>", regex.I).search(source, at)
            at = end.end() if end else n
            continue
        if name in BLOCKS or name in JUNK:
            page.cut()
        if name in BLOCKS and name not in CONTAINERS:
            page.aside = page.mark(name, m.group(3)) > 0
        if name in CONTAINERS and not m.group(3).endswith("/"):
            mark = WHOLLY if name in JUNK or name in OUTER_JUNK and not page.main else page.mark(name, m.group(3))
            if name == "li" and page.open and page.open[-1][0] == "li":
                page.pop("li")
            page.push(name, mark)
    page.cut()
    return page.lines


def shared_lines(a: list, b: list, most_bits: int = 1 << 28) -> set[int]:
    """Places in a of a longest common subsequence with b.

    The way back needs a bit for each pair of lines. Above `most_bits` the longer half is cut where lengths from both ends
    add up to most, and the halves are aligned apart, so memory stays bounded.
    """
    out, parts = set(), [(0, a, b)]
    while parts:
        at, x, y = parts.pop()
        same = end = 0
        while same < len(x) and same < len(y) and x[same] == y[same]:
            same += 1
        while end < len(x) - same and end < len(y) - same and x[-1 - end] == y[-1 - end]:
            end += 1
        out.update(range(at, at + same), range(at + len(x) - end, at + len(x)))
        at, x, y = at + same, x[same : len(x) - end], y[same : len(y) - end]
        if not x or not y:
            continue
        if len(x) * len(y) <= most_bits or len(x) == 1:
            out.update(at + i for i in _aligned(x, y))
            continue
        half = len(x) // 2
        total = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int(total.argmax())
        parts += [(at, x[:half], y[:cut]), (at + half, x[half:], y[cut:])]
    return out


def _steps(x: list[str], y: list[str]):
    """After each line of x, a number whose zero bits stand where the longest common subsequence with y grows."""
    masks: dict[str, int] = {}
    for j, line in enumerate(y):
        masks[line] = masks.get(line, 0) | 1 << j
    full = v = (1 << len(y)) - 1
    for line in x:
        u = v & masks.get(line, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """The length of a longest common subsequence of x and each y[:j]."""
    v = (1 << len(y)) - 1
    for v in _steps(x, y):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(y) // 8), "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(x: list[str], y: list[str]) -> list[int]:
    rows, out = list(_steps(x, y)), []
    row, col = len(x), len(y)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                out.append(row)
                col -= 1
    return out


def mark_shared(lines: list[Line], other: list[Line]) -> None:
    for i in shared_lines([x.text for x in lines], [x.text for x in other]):
        lines[i].shared = True


def main_text(lines: list[Line]) -> str:
    own = [x for x in lines if not x.junk]
    chosen = [x for x in own if x.main]
    outside = [x for x in own if not x.main]
    teaser = any(x.shared for x in outside) and sum(len(x.text) for x in outside if not x.shared) > TEASER * sum(len(x.text) for x in chosen)
    if not chosen or teaser:
        chosen = [x for x in own if not x.shared]
    return "\n\n".join(x.text for x in chosen)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    parsed = parse(pages, id_col, url_col, html_col)
    hashes, sizes = F.transform("lines", lambda x: F.xxhash64(x)), F.transform("lines", lambda x: F.length(x))
    prints = parsed.where("compared").select(F.monotonically_increasing_id().alias("row"), "key", "page_id", "url", "host", "path", "body", "main", sizes.alias("sizes"), hashes.alias("lines"))
    changed = staged(differenced(staged(prints, "pages")), "changed")
    main = F.exists("main", lambda x: x)
    chosen = F.when(F.col("kept").isNotNull(), F.expr("filter(lines, (x, i) -> kept[i])")).when(main, F.expr("filter(lines, (x, i) -> main[i])")).otherwise(F.col("lines"))
    text = parsed.join(changed, "key", "left").select("page_id", "url", F.array_join(chosen, "\n\n").alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def differenced(prints: DataFrame) -> DataFrame:
    """key, kept (of each line): the pages (as in extract, stored) whose text is the lines that no neighbour shares, and is not what it would be without neighbours."""
    classes = in_url_order(prints)
    firsts = classes.groupBy("class").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    bodies = staged(firsts.join(prints.select("row", "host", "lines", "sizes"), "row").select("class", "n", "host", "lines", "sizes"), "bodies")
    sides = beside(bodies, -1).unionByName(beside(bodies, 1)).groupBy("class").agg(F.collect_list("shared").alias("sides"))
    sides = staged(bodies.select("class", "n").join(sides, "class"), "sides")
    rows = join_groups(classes, sides, ["class"], "n", prints.count()).where("sides is not null").select("row", "sides")
    judged = rows.join(prints.select("row", "key", "main", "sizes"), "row").withColumn("shared", F.expr("transform(main, (m, i) -> exists(sides, s -> s[i]))"))
    length = lambda what: F.expr(f"aggregate(filter(sizes, (x, i) -> {what}), 0L, (a, x) -> a + x)")
    teaser = length("not main[i] and not shared[i]") > TEASER * length("main[i]")
    told = F.expr("exists(transform(main, (m, i) -> not m and shared[i]), x -> x)")
    return judged.where(told & teaser | told & ~F.exists("main", lambda x: x)).select("key", F.transform("shared", lambda x: ~x).alias("kept")).dropDuplicates(["key"])


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Each page's lines that are not junk: key (equal for rows that are equal), page_id, url, host, path, lines, main (of each line), body (digest of the lines), compared (has a host and a line)."""
    url, page_id, source = F.col(url_col).cast("string"), F.col(id_col).cast("long"), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.unhex(F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), F.md5(F.coalesce(url, F.lit(""))), F.md5(source)))).alias("key"), page_id.alias("page_id"), url.alias("url"),
        F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)).alias("host"), F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
        source.alias("html"),
    )
    kept = ["key", "page_id", "url", "host", "path"]

    def run(batches):
        for b in batches:
            lines, main, body, compared = [], [], [], []
            for host, source in zip(b.column("host"), b.column("html"), strict=True):
                own = [x for x in page_lines(source.as_py()) if not x.junk]
                lines.append([x.text for x in own])
                main.append([x.main for x in own])
                body.append(hashlib.blake2b("\n".join(lines[-1]).encode(), digest_size=16).hexdigest())
                compared.append(bool(host.as_py() and own))
            arrays = [pa.array(lines, pa.list_(pa.string())), pa.array(main, pa.list_(pa.bool_())), pa.array(body, pa.string()), pa.array(compared, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *arrays], names=[*kept, "lines", "main", "body", "compared"])

    return rows.mapInArrow(run, "key binary, page_id long, url string, host string, path string, lines array<string>, main array<boolean>, body string, compared boolean")


def in_url_order(pages: DataFrame) -> DataFrame:
    """row, class: pages numbered by host and path, those that follow each other with equal lines alike.

    Classes are counted in each partition; the driver gets the first and the last page's key of each to join the counts.
    """
    keys = ["host", "path", "page_id", "url", "body", "row"]
    dealt = pages.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", "host", "body")

    def count(batches):
        part, at, before = TaskContext.get().partitionId(), -1, None
        for b in batches:
            local = []
            for page in zip(b.column("host").to_pylist(), b.column("body").to_pylist(), strict=True):
                at += page != before
                before = page
                local.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int64()), pa.array(local, pa.int64())], names=[*b.schema.names, "part", "local"])

    ordered = staged(dealt.mapInArrow(count, "row long, host string, body string, part long, local long"), "url-order")
    page = F.struct("host", "body")
    edges = ordered.groupBy("part").agg(F.min_by(page, "local").alias("first"), F.max_by(page, "local").alias("last"), F.max("local").alias("most")).orderBy("part").collect()
    starts, start, last = [], 0, None
    for e in edges:
        start -= e.first == last
        starts.append((e.part, start))
        start, last = start + e.most + 1, e.last
    of_part = ordered.sparkSession.createDataFrame(starts, "part long, start long")
    return staged(ordered.join(F.broadcast(of_part), "part").select("row", (F.col("start") + F.col("local")).alias("class")), "classes")


def beside(bodies: DataFrame, step: int) -> DataFrame:
    """class, shared (of each line): each class against the nearest one before (step -1) or after (1) it on its host that is no copy of it.

    A class whose neighbour is a copy goes on to the one that its neighbour has reached, so a run of n copies takes log n rounds.
    """
    at = staged(bodies.select("class", "host", (F.col("class") + step).alias("other"), F.lit(True).alias("open")), "beside")
    own, others = bodies.select("class", "lines", "sizes"), bodies.select(F.col("class").alias("other"), "host", F.col("lines").alias("other_lines"), F.col("sizes").alias("other_sizes"))

    def compare(batches):
        for b in batches:
            copies, out = [], []
            for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("lines", "other_lines", "sizes", "other_sizes")), strict=True):
                same = shared_lines(x, y)
                copies.append(is_copy(n, m, same))
                out.append([i in same for i in range(len(x))])
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(copies, pa.bool_()), pa.array(out, pa.list_(pa.bool_()))], names=["class", "copy", "shared"])

    found = []
    while True:
        pairs = at.where("open").select("class", "host", "other").join(others, ["other", "host"]).join(own, "class")
        tried = staged(pairs.select("class", "lines", "other_lines", "sizes", "other_sizes").mapInArrow(compare, "class long, copy boolean, shared array<boolean>"), "compared")
        found.append(tried.where("not copy").select("class", "shared"))
        again = tried.where("copy").select("class")
        if again.isEmpty():
            return reduce(DataFrame.unionByName, found)
        reached = at.select(F.col("class").alias("other"), F.col("other").alias("beyond"))
        moved = at.join(again, "class").join(reached, "other", "left").select("class", "host", F.coalesce("beyond", F.col("other") + step).alias("other"), F.lit(True).alias("open"))
        at = staged(at.join(again, "class", "left_anti").select("class", "host", "other", F.lit(False).alias("open")).unionByName(moved), "beside")


def is_copy(a: list[int], b: list[int], shared: set[int]) -> bool:
    """Whether the lines shared (places in a) hold more than half of the text of a and b (lengths of lines) together."""
    same = sum(a[i] for i in shared)
    return 2 * same > sum(a) + sum(b) - same
