"""Main text of web pages by site style trees.

The DOMs of a host are merged by element path (tag and first class of every ancestor). A node's
presentation importance is the entropy of the child sequences its pages show; a text leaf's
content importance is one minus the mean entropy of its texts over the pages. Both use the
logarithm to the number of distinct pages that have the node, so 0 means the same on every page
and 1 means different everywhere. A branch's composite importance blends its own with the mean of
the leaves below; branches below ``LOW`` are removed from each page. Marked-up roles (navigation,
header, footer, aside, form, scripts, advert and comment classes) are known beforehand, and
where a page marks its article or main part, only that part is kept; inside it a branch goes
only below ``LOW_INSIDE``. A class name or id alone does not silence a marked part inside its element
if the page marks no other, unless it names comments, adverts or links to other pages. Fewer than ``PAGES`` distinct pages prove nothing.

Equal pages count once. Null html is empty and gives an empty text; pages without a host share one.
Repeated rows get one result row each. An empty table gives no row.
"""

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargoframe.sources.scratch import settle, ship

LOW, LOW_INSIDE, PAGES, FADE = 0.2, 0.1, 4, 0.9
#: What an element is by its role, and by a class name or id only.
SURE, BY_NAME = 2, 1
#: Names of a marked part, and of one inside an element that only a name calls noise.
MARKS = {"article": ("article", "article in doubt"), "main": ("main", "main in doubt")}
DEPTH = 24  # deeper elements count as their ancestor at this depth

# Elements by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "math", "canvas",
          "audio", "video", "map"}
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "textarea", "fieldset", "label", "dialog",
         "menu", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr", "img", "br"}
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "cookie", "cookies", "consent", "gdpr",
         "notice", "notices", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer",
         "comment", "comments", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "promo",
         "promotion", "sponsor", "sponsored", "subscribe", "subscription", "newsletter", "signup", "login", "popup",
         "modal", "overlay", "widget", "toolbar", "pagination", "pager", "copyright", "skip", "alert"}
# Parts of names that say how a page is laid out, not what an element holds.
LAYOUT = {"no", "not", "non", "with", "without", "has", "have", "is", "hide", "off"}
# Names of what readers or other pages add, which no article tag inside turns into the article.
FOREIGN = {"comment", "comments", "respond", "disqus", "related", "recommended", "promo", "promotion", "sponsor",
           "sponsored", "ad", "ads", "advert", "adverts", "advertisement", "advertising"}
# Elements that may stand in a head.
OF_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
HEADING = {"header", "masthead", "topbar"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}


def _names(attributes: dict) -> set[str]:
    """Parts of the class names and the id, but for names that describe the layout (no-comments)."""
    found = set()
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split():
        parts = set(re.split(r"[^a-z0-9]+", name))
        if parts.isdisjoint(LAYOUT):
            found |= parts
    return found


class _Page(HTMLParser):
    """Text blocks of a page with their paths, and the child sequences of its elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple] = []  # tag, path, noise, part, children
        self.blocks: list[list] = []  # path, noise, part, text pieces
        self.styles: dict[str, list[str]] = {}
        self.fresh = True

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" and self.blocks and not self.fresh:
                self.blocks[-1][3].append(" ")
            elif tag == "hr":
                self.fresh = True
            return
        if tag not in OF_HEAD:
            self._end_head()
        if tag not in INLINE:
            self._close_implied(tag)
            self.fresh = True
        found = dict(attrs)
        names = _names(found)
        role = (found.get("role") or "").lower()
        parent = self.stack[-1] if self.stack else (None, "", 0, "")
        part, noise = parent[3], parent[2]
        if tag in SILENT or tag in ASIDE or role in ROLES or "hidden" in found or NOISE & names & FOREIGN or (
                not part and (tag in HEADING or HEADING & names)):
            noise = SURE
        elif NOISE & names:
            noise = max(noise, BY_NAME)
        opens = "article" if tag == "article" and part not in MARKS["article"] else \
            "main" if not part and (tag == "main" or role == "main") else ""
        if opens and not noise:
            part = opens
        elif opens and noise == BY_NAME:  # counts where the page marks no other part
            part, noise = MARKS[opens][1], 0
        path = parent[1]
        if tag not in INLINE and len(self.stack) < DEPTH:
            mark = tag + (f".{(found.get('class') or '').split()[0]}" if (found.get("class") or "").split() else "")
            self.styles.setdefault(path, []).append(mark)
            path = f"{path}>{mark}"
        self.stack.append((tag, path, noise, part))

    def _end_head(self):
        """The end tag of a head may be left out: anything of the body ends it."""
        if self.stack and self.stack[-1][0] == "head":
            self.stack.pop()

    def _close_implied(self, tag):
        if tag not in INLINE:
            # a block ends an open paragraph of the same container, with what is open inside it
            for i in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[i][0]
                if open_tag == "p" or open_tag in CLOSES.get(tag, ()):
                    del self.stack[i:]
                    break
                if open_tag not in INLINE:
                    break

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.fresh = True
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        tag, path, noise, part = self.stack[-1] if self.stack else ("", "", 0, "")
        if tag in SILENT:
            return
        if not data.strip() and (self.fresh or not self.blocks):
            return
        last = self.blocks[-1] if self.blocks else None
        if self.fresh or last is None or last[1] != noise or last[2] != part:
            self.blocks.append([path, noise, part, [data]])
            self.fresh = False
        else:
            last[3].append(data)


def parse(html: str | None) -> tuple[list[tuple], dict[str, str]]:
    """(path, noise, part, text) of the blocks in page order; child sequence by path."""
    page = _Page()
    page.feed(html or "")
    page.close()
    blocks = [(p, n, part, " ".join("".join(pieces).split())) for p, n, part, pieces in page.blocks]
    styles = {p: " ".join(dict.fromkeys(c)) for p, c in page.styles.items()}
    return [b for b in blocks if b[3]], styles


def _host(url: str | None) -> str:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.I)
    return found.group(1).lower().rpartition("@")[2] if found else ""


_LEAF = pa.struct([("path", pa.string()), ("feature", pa.int64())])


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, 200):
            batch = whole.slice(low, 200)
            packed, settled, leaves, styles, hosts, hashes = [], [], [], [], [], []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                found, style = parse(html)
                marked, inside = _inside(found)
                packed.append(zlib.compress(json.dumps([marked, inside], separators=(",", ":")).encode()))
                settled.append(all(path is None for path, _ in inside))
                seen = dict.fromkeys((path, _hash(text)) for path, _, _, text in found)
                leaves.append([{"path": path, "feature": text} for path, text in seen])
                styles.append([{"path": path, "feature": _hash(text)} for path, text in style.items()])
                hosts.append(_host(url))
                hashes.append(_hash(html or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()),
                 pa.array(packed, pa.binary()), pa.array(settled, pa.bool_()), pa.array(leaves, pa.list_(_LEAF)), pa.array(styles, pa.list_(_LEAF))],
                ["page_id", "url", "host", "page", "packed", "settled", "leaves", "styles"])


_OWN = re.compile(r">(article|main)[^>]*$|>(p|h[1-6]|pre|blockquote)$")


def _branches(path: str) -> list[str]:
    """All branches of a path, itself included."""
    steps = path.split(">")
    return [">".join(steps[:n]) for n in range(2, max(2, len(steps)) + 1)]


def _inside(blocks: list[tuple]) -> tuple[bool, list]:
    """Whether the page marks its article or main part, and (path, text) of the blocks there, else
    of all that are no noise. Without a path: the part's own elements, which stay in any case."""
    quiet = [b for b in blocks if not b[1]]
    parts = {b[2] for b in quiet}
    part = next((p for p in ("article", "main", *(MARKS[p][1] for p in MARKS)) if p in parts), "")
    return bool(part), [(None if part and _OWN.search(path) else path, text)
                        for path, _, own, text in quiet if not part or own == part]


def _stays(path: str | None, marked: bool, low: set, lower: set) -> bool:
    """Inside a marked part a branch goes by the lower limit and for itself only."""
    return path is None or (path not in lower if marked else low.isdisjoint(_branches(path)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, 200):
            batch = whole.slice(begin, 200)
            texts, removed = [], []
            for packed, low, lower in zip(*(batch.column(c).to_pylist() for c in ("packed", "low", "lower"))):
                marked, inside = json.loads(zlib.decompress(packed))
                low, lower = set(low or ()), set(lower or ())
                kept = [text for path, text in inside if _stays(path, marked, low, lower)]
                texts.append("\n".join(kept))
                removed.append(len(inside) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_removed"])


def _prefixes(path):
    """All branches of a path, itself included."""
    steps = F.split(path, ">")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(steps))), lambda n: F.array_join(F.slice(steps, 1, n), ">"))


def _spread(parsed: DataFrame, column: str) -> DataFrame:
    """Per node: ``m`` distinct pages that have it, and over its features, each on d distinct
    pages, the sums of d and of d ln d. A node is the hash of host and path."""
    seen = parsed.select("host", "page", F.explode(column).alias("f")).select(
        F.xxhash64("host", "f.path").alias("node"), F.col("f.feature").alias("feature"), "page")
    features = seen.groupBy("node", "feature").agg(F.count_distinct("page").alias("d")).groupBy("node").agg(
        F.sum("d").alias("weight"), F.sum(F.col("d") * F.log("d")).alias("logs"))
    return features.join(seen.groupBy("node").agg(F.count_distinct("page").alias("m")), "node")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by a line feed), n_chars, n_removed
    (blocks of the style tree's low branches). Blocks travel compressed beside their page; pages
    that no branch can change take part in the tree, but stay where they are."""
    ship(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = source.mapInArrow(
        _parsed, "page_id long, url string, host string, page long, packed binary, settled boolean, "
                 "leaves array<struct<path:string,feature:long>>, "
                 "styles array<struct<path:string,feature:long>>").withColumn("row", F.monotonically_increasing_id())
    parsed = settle(parsed, "blocks")
    many = F.col("m") > 1
    # content: one minus log_m d, over the texts of a leaf
    content = _spread(parsed, "leaves").withColumn(
        "worth", F.col("weight") - F.when(many, F.col("logs") / F.log("m")).otherwise(0.0))
    paths = F.array_distinct(F.col("leaves.path"))
    names = parsed.select("host", F.explode(paths).alias("path")).distinct().withColumn("node", F.xxhash64("host", "path"))
    branch = names.join(content, "node").select("host", F.explode(_prefixes(F.col("path"))).alias("path"), "weight", "worth", "m")
    branch = branch.groupBy("host", "path").agg(
        (F.sum("worth") / F.sum("weight")).alias("leaves"), F.max("m").alias("m")).withColumn(
        "node", F.xxhash64("host", "path"))
    # presentation: entropy to the base m of how the pages that have a node differ in its children
    style = _spread(parsed, "styles").select("node", F.when(
        many, (F.log("m") * F.col("weight") - F.col("logs")) / (F.col("m") * F.log("m"))).otherwise(0.0).alias("presentation"))
    importance = branch.join(style, "node", "left").withColumn(
        "importance", FADE * F.col("leaves") + (1 - FADE) * F.coalesce("presentation", "leaves"))
    low = importance.filter((F.col("m") >= PAGES) & (F.col("importance") < LOW)).select(
        "node", F.col("path").alias("low_path"), "importance")
    open_pages = parsed.filter("NOT settled")
    on_page = open_pages.select("row", "host", F.explode(F.array_distinct(F.flatten(F.transform(
        paths, _prefixes)))).alias("path")).select("row", F.xxhash64("host", "path").alias("node"))
    per_page = on_page.join(low, "node").groupBy("row").agg(
        F.collect_list("low_path").alias("low"),
        F.collect_list(F.when(F.col("importance") < LOW_INSIDE, F.col("low_path"))).alias("lower"))
    schema = "page_id long, url string, text string, n_chars long, n_removed long"
    judged = open_pages.select("row", "page_id", "url", "packed").join(per_page, "row", "left").select(
        "page_id", "url", "packed", "low", "lower").mapInArrow(_texts, schema)
    none = F.lit(None).cast("array<string>")
    return judged.unionByName(parsed.filter("settled").select(
        "page_id", "url", "packed", none.alias("low"), none.alias("lower")).mapInArrow(_texts, schema))
