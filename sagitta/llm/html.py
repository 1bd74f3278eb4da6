"""Main text of web pages: nearest-URL page differencing, confirmed by structure.

A page's html is cut into lines, each with the structure it stands in. Pages of one host are paired with their nearest
neighbour in the order of URL paths, their lines are aligned by longest common subsequence, and shared lines are deleted:
unless they stand in the page's marked article, which copies of an article share, or the two pages share their article. Then
lines of navigation, headers, footers, asides, forms, adverts, notices and comments go, which a page may not share with any
other. Pages are dealt by ranges of host, path and id, so a hot host is split; the pages at the borders of a range go to the
neighbouring one, too.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed

#: Elements without text of the article, whatever they hold.
DROPPED = frozenset("script style noscript template head title nav aside footer form button select option textarea input label svg math iframe object embed audio video canvas map menu menuitem dialog datalist fieldset legend".split())
#: Raw text up to their end tag, in which markup is not read.
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
#: Elements that don't break a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion nav navbar navigation navlinks menu menus topbar toolbar breadcrumb breadcrumbs header masthead "
    "footer foot colophon copyright sidebar sidebars aside rail widget widgets related recommended recommendations share sharing social follow subscribe subscription newsletter signup login search searchbox form "
    "notice notices cookie cookies consent gdpr alert alerts popup modal overlay paywall disqus comment comments commentlist respond replies reply pager pagination skip skiplink hidden "
    "complementary contentinfo dialog".split()
)
#: Words beside a mark that leave it one ("share-buttons", but not "share-price").
GENERIC = frozenset(
    "box block wrapper wrap container content inner outer list item items section area bar link links button buttons btn icon icons slot unit text panel site page global main top bottom left right "
    "primary secondary post posts entry article articles story blog media field group row col column tab tabs count title heading inline large small mobile desktop x".split()
)
#: A quote counts only behind an equals sign, and only if it is closed.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?][^>]*(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""", re.S)
_INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


#: Words before a mark that make it say what else the page has.
BESIDE = frozenset("with has no without".split())
#: Marks that an article's own parts may carry.
OWN_MARKS = frozenset("header masthead title".split())


def _marked(attributes: str, inside: bool) -> bool:
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and _INVISIBLE.search(value):
            return True
        if name in ("class", "id", "role"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                marks = [w in MARKS and not (inside and w in OWN_MARKS) and before not in BESIDE for before, w in zip(["", *words], words)]
                # "with-sidebar" is what the sidebar stands beside
                if any(marks) and all(m or w in GENERIC for m, w in zip(marks, words)):
                    return True
    return False


#: What a line is by the structure that it stands in; text of a skipped inline element is no line.
SKIPPED, DROPPED_LINE, PLAIN, ARTICLE = -1, 0, 1, 2


def blocks(page: str | None) -> list[tuple[str, int]]:
    """``(line, structure)`` for each block of the page's text, in page order: ARTICLE below an ``article`` or ``main``
    element, DROPPED_LINE in navigation, adverts and the like, else PLAIN.

    In an article a ``header`` is the article's own; elsewhere it is dropped. Character references are decoded; white space
    in a block is one space. A broken page is read as far as it goes.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    at, state = 0, PLAIN
    page = page or ""

    def flush() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.append((line, state))
        text.clear()

    def close(k: int) -> None:
        nonlocal state
        del stack[k:]
        state = stack[-1][1] if stack else PLAIN

    while m := _TOKEN.search(page, at):
        if state != SKIPPED and m.start() > at:
            text.append(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name not in INLINE and state != SKIPPED:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in VOID or m[3].endswith("/") and name not in RAW and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in INLINE:
            # an open p ends where the next block begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                elif stack[k][0] not in INLINE:
                    break
        inside = state == ARTICLE or name in ("article", "main")
        now = state
        if state > DROPPED_LINE:
            gone = name in DROPPED or name == "header" and not inside or name not in ("html", "body", "article", "main") and _marked(m[3], inside)
            now = (SKIPPED if name in INLINE else DROPPED_LINE) if gone else ARTICLE if inside else PLAIN
            if now == SKIPPED:
                text.append(" ")
        stack.append((name, now))
        state = now
    if state != SKIPPED:
        text.append(page[at:])
        flush()
    return out


#: Rows of the alignment between two that are kept; those between are made again on the way back.
ROWS_KEPT = 256


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, with a row of the table as the bits of one number: a 0 where the length grows.

    Time is len(a) additions of len(b) bits; memory as many bits for each ROWS_KEPT-th row and for ROWS_KEPT rows, so
    neither knows how often a line is repeated."""
    masks: dict[int, int] = {}
    for j, y in enumerate(b):
        masks[y] = masks.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1

    def after(row: int, x: int) -> int:
        both = row & masks.get(x, 0)
        return (row + both | row - both) & full

    kept, row = [full], full
    for i, x in enumerate(a, 1):
        row = after(row, x)
        if i % ROWS_KEPT == 0:
            kept.append(row)
    length = lambda row, j: j - (row & (1 << j) - 1).bit_count()
    out, j = [], len(b)
    for block in range(len(a) // ROWS_KEPT, -1, -1):
        rows = [kept[block]]
        for x in a[block * ROWS_KEPT : (block + 1) * ROWS_KEPT]:
            rows.append(after(rows[-1], x))
        for k in range(len(rows) - 1, 0, -1):
            i = block * ROWS_KEPT + k - 1
            have = length(rows[k], j)
            if not have:
                return out[::-1]
            if length(rows[k - 1], j) == have:
                continue
            # line i is matched, with the last place at which the length still grows
            j = (~rows[k] & (1 << j) - 1).bit_length() - 1
            out.append((i, j))
    return out[::-1]


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as pairs of places. Common ends are taken first."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    # only lines that both have can be matched
    both = {x: n for n, x in enumerate({*a[lo : len(a) - hi]} & {*b[lo : len(b) - hi]})}
    x = [i for i in range(lo, len(a) - hi) if a[i] in both]
    y = [j for j in range(lo, len(b) - hi) if b[j] in both]
    inner = _aligned([both[a[i]] for i in x], [both[b[j]] for j in y])
    return [(i, i) for i in range(lo)] + [(x[i], y[j]) for i, j in inner] + [(len(a) - 1 - k, len(b) - 1 - k) for k in range(hi - 1, -1, -1)]


#: Two pages that share this part of the characters of one's plain lines have the same article: being shared tells nothing.
SAME_ARTICLE = 0.9


def shared_lines(own: list[tuple[str, int]], neighbour: list[tuple[str, int]]) -> set[int] | None:
    """Places of the lines that a page shares with its neighbour; None if they have the same article, so that nothing can be told."""
    found = common_lines([x for x, _ in own], [x for x, _ in neighbour])
    plain = sum(len(own[i][0]) for i, j in found if own[i][1] == neighbour[j][1] == PLAIN)
    fewer = min(sum(len(x) for x, k in page if k == PLAIN) for page in (own, neighbour))
    return None if plain and plain >= SAME_ARTICLE * fewer else {i for i, _ in found}


def main_text(own: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> tuple[str, int]:
    """The page's text, and how many lines went because a neighbour shares them.

    ``neighbours``: the nearest first; the next one counts only if the page and the first have the same article. Shared lines
    go unless structure says that they are the article's, which copies of it share. Of what is left, the article's lines are
    the text, or where the page has none marked, all that no structure drops."""
    shared = next((s for s in (shared_lines(own, n) for n in neighbours) if s is not None), set())
    left = [(x, k) for i, (x, k) in enumerate(own) if k == ARTICLE or i not in shared]
    most = max((k for _, k in own), default=PLAIN)
    return "\n".join(x for x, k in left if k == max(most, PLAIN)), len(own) - len(left)


def _common_start(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


_KEY = "host path page_id tie salt".split()
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages in the order of hosts and paths. ``tie`` and ``salt`` put pages of one address and id in an order; it makes no
    difference which of equal rows comes first."""
    url = F.coalesce("url", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select(
        "page_id", "url", "html", F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), F.regexp_extract(url, _PATH, 1).alias("path"),
        F.xxhash64("url", "html").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """``page_id, url, text, n_shared`` for every row of ``pages(page_id, url, html)``; n_shared: lines that differencing took.

    Each page is compared with the page before or after it in the order of host, path and id (of the same host; by the
    longer common start of the paths). A null or empty html gives an empty text. Without a url, a page belongs to the empty
    host. Repeated rows are next to each other and share their article, so each keeps it. Large pages are processed whole,
    one at a time. An empty table gives no rows; other columns play no part. The result doesn't depend on partitioning:
    each part of the order also gets the last page of the part before and the first of the part behind.
    """
    spark = pages.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(pages)
    # borders: the first and the last page of each of many ranges (a few numbers each)
    ends = rows.select(*_KEY).repartitionByRange(parts, *_KEY).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*_KEY)).alias("first"), F.max(F.struct(*_KEY)).alias("last"))
    ends = [(tuple(r["first"]), tuple(r["last"])) for r in ends.orderBy("part").collect()]
    order = lambda key: (key[0], key[1], key[2] is not None, key[2] or 0, *key[3:])
    sent = spark.sparkContext.broadcast([order(first) for first, _ in ends])
    copies = [(*last, n + 1) for n, (_, last) in enumerate(ends[:-1])] + [(*first, n) for n, (first, _) in enumerate(ends[1:])]
    border = spark.createDataFrame(copies, "host string, path string, page_id long, tie long, salt long, to int")
    same = [rows[c].eqNullSafe(border[c]) for c in _KEY]
    guests = rows.join(F.broadcast(border), [*same], "inner").select(*[rows[c] for c in rows.columns], "to")

    schema = "part int, guest boolean, page_id long, url string, host string, path string, tie long, salt long, lines array<string>, kinds binary"

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                keys = [*zip(*(part.column(c).to_pylist() for c in _KEY))]
                to = part.column("to").to_pylist()
                lines = [blocks(h) for h in part.column("html").to_pylist()]
                where = [max(0, bisect_right(sent.value, order(k)) - 1) if t is None else t for k, t in zip(keys, to)]
                # of a dropped line only a digest is compared
                text = [[x if k else "\0" + blake2b(x.encode("utf-8", "replace"), digest_size=8).hexdigest() for x, k in page] for page in lines]
                kinds = [bytes(k for _, k in page) for page in lines]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), part.column("to").is_valid(), part.column("page_id"), part.column("url"), *(part.column(c) for c in ("host", "path", "tie", "salt")), pa.array(text, pa.list_(pa.string())), pa.array(kinds, pa.binary())], ["part", "guest", "page_id", "url", "host", "path", "tie", "salt", "lines", "kinds"])

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages_of(batches):
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    x = b.slice(at, 100)
                    for part, guest, i, u, h, p, lines, kinds in zip(*(x.column(c).to_pylist() for c in ("part", "guest", "page_id", "url", "host", "path", "lines", "kinds"))):
                        yield (part, h), guest, i, u, p, [*zip(lines, kinds)]
            yield None

        def done(row, around):
            near = sorted((x for x in around if x and x[0] == row[0]), key=lambda x: -_common_start(x[4], row[4]))
            return (row[2], row[3], *main_text(row[5], [x[5] for x in near]))

        before = now = None
        out = []
        for after in pages_of(batches):
            if now and not now[1]:
                out.append(done(now, (before, after)))
                if len(out) >= 100:
                    yield _texts(out)
                    out = []
            before, now = now, after
        yield _texts(out)

    found = rows.withColumn("to", F.lit(None).cast("int")).unionByName(guests).mapInArrow(trimmed(parsed), schema)
    return found.repartition(parts, "part").sortWithinPartitions("part", *_KEY).select("part", "guest", "page_id", "url", "host", "path", "lines", "kinds").mapInArrow(trimmed(differenced), "page_id long, url string, text string, n_shared long")


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_shared"])


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLES: dict[str, str] = {}
