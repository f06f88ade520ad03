"""HTML extraction by nearest-URL page differencing.

A page is cut into lines, one per block: all of its text but that of scripts,
styles and form controls. Pages of a host with the same set of lines are copies
and one page, that of the least path; these are sorted by URL path, each is
paired with the neighbour that shares the longer path prefix, their lines are
aligned by longest common subsequence, and shared lines are deleted.

Markup says what else a line is. Paragraphs and headings inside an ``article`` or
``main`` element are the text, and stay even if shared: passages that pages quote
alike are no template. Lines that the markup names as menus, headers, footers,
sidebars, notices, adverts, forms or comments go even if no neighbour shares
them, and if a page has an ``article`` or ``main`` with text, so do lines outside
it. All other lines are the alignment's alone to delete.

Scale: lines of pages are compared by 8-byte hashes. The light table of hashes
is range-partitioned by host, path and page, so a hot host is many partitions;
the rows at partition borders, two a partition, meet in a second step.

Nulls: a null page is empty, a null URL is the empty path of the empty host.
Ties: equal prefixes pair with the earlier page; pages that repeat in all of
page_id, url and html are one in pairing and all are returned. A page of any
length is read once, in linear time. An empty table gives an empty result.
Columns other than those named are not read, or kept where whole pages are
returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, map_batches, materialize, ship, texts_of

_RAW = {"script", "style", "title", "noscript", "template", "iframe", "textarea", "noembed", "noframes", "xmp", "select", "button"}
_SKIP = {"nav", "header", "footer", "aside", "form", "head", "menu", "dialog", "fieldset", "label", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "caption"}
_SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "alert"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|notice|popup|modal|overlay"
    r"|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comments?|disqus|respond|replies|reviews|widget|pagination|pager|toolbar|skip-link|hidden)(?:$|[\s_-])"
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies|reviews)(?:$|[\s_-])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_OUTER = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)")


def _boilerplate(name: str, attributes: str) -> str:
    """Why an element is no content: "comments", "other", or nothing."""
    if not attributes:
        return "other" if name in _SKIP else ""
    found = {}
    for key, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), value.strip("\"'").lower())
    named = f"{found.get('class', '')} {found.get('id', '')}"
    if _COMMENTS.search(named):
        return "comments"
    if name in _SKIP or found.get("role") in _ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return "other"
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return "other"
    return "other" if name not in ("body", "html", "article", "main") and _NAMES.search(named) else ""


#: What a line is: left to the alignment, text of an article, or no text whatever the alignment says.
FREE, TEXT, NONE = 0, 1, 2


def lines(html: str) -> list[tuple[str, int]]:
    """(text, what it is) of the blocks in page order."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    inside = {"article": 0, "main": 0}
    prose = False
    skip, depth, why = "", 0, ""
    seen_main = False
    unclosed: set[str] = set()
    at, end = 0, len(html)

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                main = not skip and any(inside.values())
                out.append((text, NONE if skip else TEXT if prose and main else FREE, main))
        parts = []

    def say(raw: str) -> None:
        if raw:
            parts.append(unescape(raw))

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if nxt in ("!", "?"):
            stop = html.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, lt)
        if m:
            closing, name, attributes, at = bool(m[1]), m[2].lower(), m[3], m.end()
        elif nxt.isalpha() or nxt == "/" and html[lt + 2 : lt + 3].isalpha():
            stop = html.find(">", lt)
            if stop < 0:
                break
            closing, at = nxt == "/", stop + 1
            name, attributes = re.match(r"</?([a-zA-Z][^\s/>]*)", html[lt:at])[1].lower(), ""
        else:
            say("<")
            at = lt + 1
            continue
        if not closing and name in _RAW:
            # A closing tag that isn't there is looked for once.
            stop = None if name in unclosed else re.compile(f"</{re.escape(name)}\\s*>", re.I).search(html, at)
            if stop:
                at = stop.end()
            elif name in ("button", "select"):
                unclosed.add(name)
            else:
                at = end
            continue
        if name in _VOID:
            if name == "br":
                parts.append(" ")
            elif name == "hr":
                flush()
            continue
        if skip:
            over = False
            if closing and name == skip:
                depth -= 1
                over = depth == 0
            elif not closing and name == skip and name not in _SELF_ENDING:
                depth += 1
            elif not closing and (name == skip or name in inside and not seen_main and why != "comments" and not _boilerplate(name, attributes)):
                depth = 0
            elif closing and skip in _SELF_ENDING and name not in _INLINE:
                depth = 0
            if depth <= 0 or name not in _INLINE:
                flush()
            if depth > 0:
                continue
            skip = why = ""
            if over:
                continue
        if name in _INLINE and (closing or not _boilerplate(name, attributes)):
            continue
        flush()
        if closing:
            prose = False if name in _PROSE else prose
            if inside.get(name):
                inside[name] -= 1
            continue
        if why := _boilerplate(name, attributes):
            skip, depth = name, 1
            continue
        if name in inside:
            inside[name] += 1
            seen_main = True
        prose = name in _PROSE
    flush()
    if any(main for _, _, main in out):
        return [(t, what if main else NONE) for t, what, main in out]
    return [(t, what) for t, what, _ in out]


def line_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """The places in a of one longest common subsequence with b; rows of the table are bit vectors."""
    both = set(a) & set(b)
    where = [i for i, x in enumerate(a) if x in both]
    xs, ys = [a[i] for i in where], [y for y in b if y in both]
    if not xs:
        return []
    masks: dict[int, int] = {}
    for i, x in enumerate(xs):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(xs)) - 1
    # Bit i of a row is 0 where the subsequence grows from i to i + 1 elements of xs.
    rows = [full]
    for y in ys:
        row = rows[-1]
        hit = row & masks[y]
        rows.append((row + hit | row - hit) & full)
    out, i, j = [], len(xs), len(ys)
    while i and j:
        bit = 1 << i - 1
        if rows[j] & bit:
            i -= 1
        elif not rows[j - 1] & bit:
            j -= 1
        else:
            out.append(where[i - 1])
            i, j = i - 1, j - 1
    return out[::-1]


def shared(own: list[int], kept: list[bool], other: list[int]) -> list[int]:
    """The lines to delete: shared with the neighbour, and no text of an article."""
    return [i for i in common_lines(own, other) if not kept[i]]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _OUTER.pattern, 1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(F.coalesce(url, F.lit("")), _OUTER.pattern, 2)
    return F.regexp_replace(path, r"(?:/|\.x?html?|/index\.x?html?)$", "")


def page_key(*cols: Column) -> Column:
    """The digest of a whole row; nulls differ from empty values."""
    return F.unhex(F.md5(F.concat_ws("\x00", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols))))


_LIGHT = "key binary, host string, path string, hashes array<long>, kept array<boolean>"
_PAIRED = "key binary, other array<long>, edge struct<part:int,place:int,host:string,path:string,hashes:array<bigint>,inner:array<bigint>,inner_path:string>"


def _light(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [lines(t) for t in texts_of(batch, "html")]
    arrays = [
        column(batch, "key"), column(batch, "host"), column(batch, "path"),
        pa.array([[line_hash(t) for t, _ in f] for f in found], pa.list_(pa.int64())),
        pa.array([[what == TEXT for _, what in f] for f in found], pa.list_(pa.bool_())),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["key", "host", "path", "hashes", "kept"])


def _nearer(path: str, before: tuple | None, after: tuple | None) -> list[int] | None:
    """Hashes of the neighbour with the longer common path prefix; each is (path, hashes)."""
    if before is None or after is None:
        return (before or after or (None, None))[1]
    return before[1] if len(commonprefix([path, before[0]])) >= len(commonprefix([path, after[0]])) else after[1]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The neighbours' lines of the pages of one sorted partition; its first and last page are handed on."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    types = [pa.binary(), pa.list_(pa.int64())]
    edge_type = pa.struct([
        ("part", pa.int32()), ("place", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())),
        ("inner", pa.list_(pa.int64())), ("inner_path", pa.string()),
    ])

    def near(row: dict, other: dict | None) -> tuple | None:
        return (other["path"], other["hashes"]) if other is not None and other["host"] == row["host"] else None

    def edge(row: dict, place: int, inner: dict | None) -> tuple:
        n = near(row, inner)
        own = {k: row[k] for k in ("host", "path", "hashes")}
        return row["key"], [], own | {"part": part, "place": place, "inner": n[1] if n else None, "inner_path": n[0] if n else None}

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [*types, edge_type])], ["key", "other", "edge"])

    before = row = None
    out: list[tuple] = []
    for batch in batches:
        for after in batch.to_pylist():
            if row is not None:
                if before is None:
                    out.append(edge(row, 0, after))
                else:
                    other = _nearer(row["path"], near(row, before), near(row, after))
                    if other:
                        out.append((row["key"], other, None))
            before, row = row, after
        if len(out) >= 1000:
            yield table(out)
            out = []
    if row is not None:
        out.append(edge(row, 0 if before is None else 1, before))
    if out:
        yield table(out)


def _edges(table: pa.Table) -> pa.Table:
    """The neighbours' lines of the pages at partition borders, from the page across the border and the inner neighbour."""
    rows = sorted(({"key": r["key"], **r["edge"]} for r in table.to_pylist()), key=lambda r: (r["part"], r["place"]))
    out = []
    for k, r in enumerate(rows):
        alone = not any(0 <= n < len(rows) and rows[n]["part"] == r["part"] for n in (k - 1, k + 1))

        def across(n: int) -> tuple | None:
            if 0 <= n < len(rows) and rows[n]["part"] != r["part"] and rows[n]["host"] == r["host"]:
                return rows[n]["path"], rows[n]["hashes"]
            return None

        inner = None if r["inner"] is None else (r["inner_path"], r["inner"])
        before, after = across(k - 1), across(k + 1)
        if not alone:
            before, after = (before, inner) if r["place"] == 0 else (inner, after)
        other = _nearer(r["path"], before, after)
        if other:
            out.append({"key": r["key"], "other": other})
    return pa.Table.from_pylist(out, pa.schema([("key", pa.binary()), ("other", pa.list_(pa.int64()))]))


def deletions(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """key and the numbers of the lines to delete, of pages that lose any. df must have a column ``key``."""
    light = df.select("key", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    light = materialize(map_batches(light, _light, _LIGHT).withColumn("lineset", F.xxhash64(F.array_sort(F.array_distinct("hashes")))), "page-lines").dropDuplicates(["key"])
    pages = materialize(light.groupBy("host", "lineset").agg(F.min(F.struct("path", "key", "hashes")).alias("p")).select("host", "lineset", "p.*"), "distinct-pages")
    ordered = pages.select("key", "host", "path", "hashes").repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    ship(df.sparkSession)
    found = materialize(ordered.mapInArrow(_neighbours, _PAIRED), "page-pairs")
    # Two rows a partition at most.
    edges = found.filter("edge is not null").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_edges, "key binary, other array<long>")
    paired = pages.select("host", "lineset", "key").join(found.filter("edge is null").select("key", "other").unionByName(edges), "key").drop("key")

    def drops(batch: pa.RecordBatch) -> pa.RecordBatch:
        lost = [shared(*x) for x in zip(*(column(batch, c).to_pylist() for c in ("hashes", "kept", "other")))]
        return pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(lost, pa.list_(pa.int32()))], ["key", "drop"])

    both = light.join(paired, ["host", "lineset"]).select("key", "hashes", "kept", "other")
    return materialize(map_batches(both, drops, "key binary, drop array<int>").filter("size(drop) > 0"), "line-drops")


def main_text(html: str, drop: list[int] | None) -> str:
    """The lines that stay, joined; drop: the numbers of those that the alignment deletes."""
    gone = set(drop or ())
    return " ".join(t for i, (t, what) in enumerate(lines(html)) if what != NONE and i not in gone)


def extract(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", into: str = "text", deleted: str | None = None) -> DataFrame:
    """All rows and columns of df with the main text of each page; deleted: a column for the number of lines that the alignment deletes."""
    ship(df.sparkSession)
    keyed = df.select(F.struct("*").alias("_page"), page_key(F.col(key), F.col(url), F.col(html)).alias("key"))
    drops = deletions(keyed.select("key", F.col(f"_page.{url}").alias(url), F.col(f"_page.{html}").alias(html)), html, url)

    @F.arrow_udf("string")
    def text(pages: pa.Array, drop: pa.Array) -> pa.Array:
        return pa.array([main_text(h or "", d) for h, d in zip(pages.to_pylist(), drop.to_pylist())], pa.string())

    # Spark checks the size of the written table of deletions before it broadcasts it.
    joined = keyed.join(drops, "key", "left").withColumn("_text", text(F.col("_page")[html], F.col("drop")))
    more = [F.coalesce(F.size("drop"), F.lit(0)).alias(deleted)] if deleted else []
    return joined.select(*(F.col("_page")[c].alias(c) for c in df.columns if c not in (into, deleted)), F.col("_text").alias(into), *more)


def main_texts(df: DataFrame) -> DataFrame:
    out = extract(df.select("page_id", "url", "html"), deleted="n_shared")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), F.col("n_shared").cast("long").alias("n_shared"))
