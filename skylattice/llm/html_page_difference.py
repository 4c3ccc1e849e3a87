"""Main text of web pages: markup rules and nearest-URL page differencing.

Pages of a host share their frame. Each page is paired with the page of its host whose URL path is nearest in path
order; the lines of both are aligned by longest common subsequence, and lines that both have are deleted. Menus,
headers, footers, sidebars, notices, adverts, forms and comments that the markup names are left out before that.

Lines inside an explicit main container (``article``, ``main``) are the article by the page's own word and are kept even
if the neighbour has them: articles quote common passages and are copied, and differencing would delete those. All other
text, on pages with and without a container, is decided by differencing.

Names and neighbours can mislead, so what would take most of a page needs evidence. A part whose class or id has a weak
name (``social``, ``notice``) goes only if the rest of the page is longer. If a page without a container shares more than half
of its text with its partner, the partner may be a near copy: then a line goes only if it is short and another page near
by has it too.

Pages are parsed where they are read, and only their lines move, compressed. They are dealt by ranges of (host, path), so
a large host spreads over tasks. Each range also gets the two pages before and the two after it as context, which makes
the pairing independent of the ranges. Tasks stream through their sorted pages and hold five of them at a time.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages of a task and ranges of a task on average (several, so that tasks get about as much each), the most ranges, and
#: places sampled for each range's bound.
PAGES_PER_TASK, RANGES_PER_TASK, MOST_RANGES, SAMPLE_PER_RANGE = 2048, 16, 16_384, 12
#: Pages of a batch that are Python objects at once.
PAGES_AT_ONCE = 64

#: Elements of the public HTML standard by what they mean here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
FRAME = frozenset("nav aside footer form head title menu dialog noscript template iframe object svg canvas button select datalist fieldset search audio video".split())
RAW = frozenset("script style textarea xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Words in the names (class, id) of parts that belong to a page's frame wherever they stand, and words before or after
#: them by which a name is that of a part beside or around the frame.
STRONG = frozenset("ad ads adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus navbar navigation newsletter pagination popup promo respond sidebar signup sponsor sponsored".split())
AROUND = frozenset("has with no without".split())
HOLDERS = frozenset("article body content layout main page".split())
#: Words that are part of a frame's name outside containers; in a container only a whole name counts, with one of some
#: endings at most, and paragraphs and headings never are frame.
_WEAK = r"(?:banner|footer|header|login|masthead|menu|modal|nav|notice|recommend\w*|related|share|sharing|social|subscribe|toolbar|widget)"
WEAK_WORDS = re.compile(rf"(?:^|[\s_-]){_WEAK}(?:$|[\s_-])")
WEAK_NAMES = re.compile(rf"(?:^|\s){_WEAK}(?:[_-](?:area|bar|block|box|buttons?|container|form|inner|links?|list|posts?|section|slot|unit|wrap|wrapper))?(?:$|\s)")
#: Lines as long as this are not deleted because of a partner that may be a near copy.
LONG = 160
NEVER_FRAME = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tbody tr td th".split())
#: Lines times lines of two pages that are aligned in one table of bits; larger pages are halved first.
TABLE_BITS = 1 << 24
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass(slots=True)
class Line:
    """A block's text, whether the markup calls it part of the frame, whether it is in a main container, and whether a weak name calls it frame."""

    text: str
    frame: bool
    main: bool
    weak: bool = False


def _strong(names: str) -> bool:
    for name in names.split():
        parts = set(re.split("[_-]+", name))
        found = parts & STRONG
        if found and not parts & AROUND and not (parts & HOLDERS and not any(x.startswith("comment") for x in found)):
            return True
    return False


def _is_frame(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is frame, and whether only a weak name says so."""
    if name in FRAME or (name == "header" and not in_main):
        return True, False
    if not attributes or name in ("html", "body") or name in MAIN:
        return False, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in FRAME_ROLES or "hidden" in attributes.lower().split() or found.get("aria-hidden") == "true":
        return True, False
    if in_main and name in NEVER_FRAME:
        return False, False
    names = [found[k].lower() for k in ("class", "id") if k in found]
    if any(map(_strong, names)):
        return True, False
    return False, any(map((WEAK_NAMES if in_main else WEAK_WORDS).search, names))


def lines_of(page: str | None) -> list[Line]:
    """The text blocks of a page in order. Unclosed and stray tags are tolerated; character references are decoded.

    A frame element within a block (a button, a hidden span) is left out of it and does not divide it.
    """
    page = page or ""
    out: list[Line] = []
    buffer: list[str] = []
    open_: list[tuple] = []  # element, and whether it begins a frame part, a part with a weak name, a main container, an inline frame part
    counts = [0, 0, 0, 0]
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append(Line(text, counts[0] > 0, counts[2] > 0, counts[1] > 0))

    def close(depth: int) -> None:
        for _, *begins in open_[depth:]:
            for k, x in enumerate(begins):
                counts[k] -= x
        del open_[depth:]

    while tag := TAG.search(page, at):
        if tag.start() > at and not counts[3]:
            buffer.append(page[at : tag.start()])
        at = tag.end()
        if not tag[2]:
            continue
        name = tag[2].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            buffer.append(" ")
        if tag[1]:
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            # an end tag closes no container around the one it is in, unless it is a container's own
            if depth is not None and (name in BLOCKS or not any(x[0] in BLOCKS for x in open_[depth:])):
                close(depth)
        elif name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", at) + 1 or len(page)
        elif name not in VOID and not tag[3].endswith("/"):
            if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and open_ and open_[-1][0] == name:
                close(len(open_) - 1)
            strong, weak = _is_frame(name, tag[3], counts[2] > 0)
            block = name in BLOCKS
            begins = (strong and block, weak and block, name in MAIN or 'role="main"' in tag[3], (strong or (weak and name == "a")) and not block)
            if any(begins) or block or (open_ and tag[3]):
                open_.append((name, *begins))
                for k, x in enumerate(begins):
                    counts[k] += x
    if not counts[3]:
        buffer.append(page[at:])
    flush()
    return out


def _last_row(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` with each beginning of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for y in b:
        both = state & where.get(y, 0)
        state = ((state + both) | (state - both)) & full
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> set[int]:
    """The table of the longest common subsequence: its rows are bits of a number."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state, rows = full, []
    for y in b:
        both = state & where.get(y, 0)
        state = ((state + both) | (state - both)) & full
        rows.append(state)
    out = set()
    row, col = len(b), len(a)
    while row and col:
        if rows[row - 1] >> (col - 1) & 1:
            col -= 1
        else:
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                col -= 1
                out.add(col)
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``.

    Common beginnings and ends are matched at once. Long lists are halved where the parts' common subsequences are
    longest together, so memory is linear in the lines, and a table is made for small parts only.
    """
    ids: dict[str, int] = {}
    left, right = ([ids.setdefault(x, len(ids)) for x in lines] for lines in (a, b))
    out: set[int] = set()
    parts = [(0, len(left), 0, len(right))]
    while parts:
        i, j, k, m = parts.pop()
        while i < j and k < m and left[i] == right[k]:
            out.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and left[j - 1] == right[m - 1]:
            out.add(j - 1)
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if m - k == 1 or (j - i) * (m - k) <= TABLE_BITS:
            out.update(i + x for x in _aligned(left[i:j], right[k:m]))
            continue
        half = (k + m) // 2
        both = _last_row(left[i:j], right[k:half]) + _last_row(left[i:j][::-1], right[half:m][::-1])[::-1]
        cut = i + int(both.argmax())
        parts += [(i, cut, k, half), (cut, j, half, m)]
    return out


def _size(lines: Iterable[Line]) -> int:
    return sum(len(x.text) for x in lines)


def without_frame(lines: list[Line]) -> list[Line]:
    """Lines that the markup does not call frame; those with a weak name stay if they are most of the text."""
    rest = [x for x in lines if not x.frame]
    plain = [x for x in rest if not x.weak]
    return plain if 2 * _size(plain) >= _size(rest) else rest


def main_text(lines: list[Line], *neighbours: list[Line] | None, careful: bool = False) -> str:
    """The main text of a page from its lines and those of pages near by, the nearest first.

    The nearest decides; on a page with a container the second decides too, as what is outside is seldom the article.
    If ``careful``, a nearest page that has more than half of the text may be a near copy: see above.
    """
    lines = without_frame(lines)
    contained = any(x.main for x in lines)
    near = [x for x in neighbours if x]
    shared: set[int] = set()
    if not all(x.main for x in lines):
        for other in near[: 1 + contained]:
            shared |= common_lines([x.text for x in lines], [x.text for x in other])
        if careful and not contained and 2 * _size(lines[i] for i in shared) > _size(lines):
            elsewhere = {x.text for other in near[1:] for x in other}
            shared = {i for i in shared if len(lines[i].text) < LONG and lines[i].text in elsewhere}
    return "\n".join(x.text for i, x in enumerate(lines) if x.main or i not in shared)


def _alike(a: str, b: str) -> int:
    """Leading path segments that two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def _nearest(page: dict, before: list[dict], after: list[dict]) -> list[list[Line]]:
    """Lines of the pages around, given from the page outwards: of the two beside it that of more leading path segments in common first, then the others.

    A copy of the page shows nothing and is no partner.
    """
    beside = [x[0] for x in (before, after) if x and x[0]["host"] == page["host"] and x[0]["lines"] != page["lines"]]
    beside.sort(key=lambda x: -_alike(x["path"], page["path"]))
    further = [x[1] for x in (before, after) if len(x) > 1 and x[1]["host"] == page["host"] and x[1]["lines"] != page["lines"]]
    return [x["lines"] for x in (*beside, *further)]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their lines, packed, in place of their html."""
    for batch in (b.slice(at, PAGES_AT_ONCE) for b in batches for at in range(0, b.num_rows, PAGES_AT_ONCE)):
        packed = [zlib.compress(pickle.dumps([(x.text, x.frame, x.main, x.weak) for x in lines_of(page.as_py())]), 1) for page in batch.column("html")]
        columns = [batch.column(c) if c != "html" else pa.array(packed, pa.binary()) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=["lines" if c == "html" else c for c in batch.schema.names])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "text"])

    held: list[dict] = []  # up to two pages before the present one, it, and up to two after it
    now, size = 0, 0
    rows: list[tuple] = []

    def decide() -> None:
        nonlocal now, size
        page = held[now]
        if not page["context"]:
            rows.append((page["page_id"], page["url"], main_text(page["lines"], *_nearest(page, held[:now][::-1], held[now + 1 :]), careful=True)))
            size += len(rows[-1][2])
        now += 1
        if now > 2:
            del held[0]
            now -= 1

    for batch in (b.slice(at, PAGES_AT_ONCE) for b in batches for at in range(0, b.num_rows, PAGES_AT_ONCE)):
        for page in batch.to_pylist():
            page["lines"] = [Line(*x) for x in pickle.loads(zlib.decompress(page["lines"]))]
            if held and page["bucket"] != held[-1]["bucket"]:
                while now < len(held):
                    decide()
                held.clear()
                now = 0
            held.append(page)
            if now + 2 < len(held):
                decide()
            if size > 8_000_000 or len(rows) >= 4096:
                yield done(rows)
                rows, size = [], 0
    while now < len(held):
        decide()
    if rows:
        yield done(rows)


def _bounds(rows: DataFrame, total: int, ranges: int) -> list[tuple]:
    """Where each range but the first begins, from a sample by hash of about ``ranges * SAMPLE_PER_RANGE`` places."""
    scale = 1 << 30
    share = min(scale, -(-scale * ranges * SAMPLE_PER_RANGE // max(1, total)))
    sample = sorted(tuple(r[0]) for r in rows.where(F.pmod(F.xxhash64("place"), F.lit(scale)) < share).select("place").distinct().collect())
    return [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []


def _bucket(bounds: list[tuple], spark: SparkSession) -> Column:
    """The range that a row's ``place`` is in; only the place goes to Python, and the bounds are looked up by bisection."""
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def find(host: pd.Series, path: pd.Series, page: pd.Series, address: pd.Series) -> pd.Series:
        limits = shared.value
        return pd.Series([bisect_right(limits, x) for x in zip(host, path, page.tolist(), address, strict=True)], dtype="int32")

    return find("place.host", "place.path", "place.id", "place.address")


def _context(rows: DataFrame) -> list[tuple]:
    """The places ``(place, range)`` of the two pages before and the two after each range, from the two outermost places of the ranges."""
    ends = rows.groupBy("bucket").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    inner = rows.select("bucket", "place").join(F.broadcast(ends), "bucket")  # a row a range
    second = inner.groupBy("bucket").agg(F.min(F.when(F.col("place") > F.col("low"), F.col("place"))).alias("low2"), F.max(F.when(F.col("place") < F.col("high"), F.col("place"))).alias("high2"))
    found = sorted(((r.bucket, sorted({tuple(x) for x in (r.low, r.low2, r.high2, r.high) if x is not None})) for r in ends.join(second, "bucket").collect()), key=lambda x: x[0])
    out = []
    for k, (bucket, _) in enumerate(found):
        before = [p for _, places in found[max(0, k - 2) : k] for p in places][-2:]
        after = [p for _, places in found[k + 1 : k + 3] for p in places][:2]
        out += [(p, bucket) for p in (*before, *after)]
    return out


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", pages_per_task: int = PAGES_PER_TASK) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    ``text`` joins the blocks of the main text by line feeds and is empty if there is none (null or empty html among
    them; an empty table gives no rows; other columns are ignored). Null urls count as one host. Host and path decide the order, then id and url; of two neighbours with as many
    leading path segments in common the earlier is the partner. A neighbour with the same lines throughout (a repeated
    row, a copy) is no partner, as it would delete everything.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[body].cast("string").alias("html"))
    address = F.coalesce("url", F.lit(""))
    rows = rows.withColumns(
        {"host": F.lower(F.regexp_extract(address, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "path": F.regexp_extract(address, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)}
    ).withColumn("place", F.struct("host", "path", F.coalesce("page_id", F.lit(0)).alias("id"), address.alias("address")))

    total = rows.count()
    tasks = max(1, min(MOST_RANGES, -(-total // pages_per_task)))
    ranges = min(MOST_RANGES, 1 if tasks == 1 else tasks * RANGES_PER_TASK)
    rows = rows.withColumn("bucket", _bucket(_bounds(rows, total, ranges), spark) if ranges > 1 else F.lit(0))
    place = "struct<host:string,path:string,id:bigint,address:string>"
    extra = _context(rows) if ranges > 1 else []
    all_rows = rows.withColumn("context", F.lit(False))
    if extra:
        # at most four pages a range
        also = spark.createDataFrame(extra, f"place {place}, target int")
        context = rows.join(F.broadcast(also), "place").dropDuplicates(["place", "target"]).withColumn("bucket", F.col("target")).withColumn("context", F.lit(True))
        all_rows = all_rows.unionByName(context.select(*all_rows.columns))
    all_rows = all_rows.select("page_id", "url", "html", "host", "path", "bucket", "context", F.col("place.id").alias("id"), F.col("place.address").alias("address"))
    columns = "page_id long, url string, lines binary, host string, path string, bucket int, context boolean, id long, address string"
    dealt = all_rows.mapInArrow(_parsed, columns).repartition(tasks, "bucket").sortWithinPartitions("bucket", "host", "path", "id", "address", "context").select("page_id", "url", "lines", "host", "path", "bucket", "context")
    return dealt.mapInArrow(_texts, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
