"""Main text of web pages by page differencing, with the markup as tie-break.

A page is read as a list of lines, one for each block of text, without the parts that markup clearly
excludes (menus, headers, footers, sidebars, adverts, forms, notices, comments). Every page is
compared with the page of the same host whose URL path is nearest: both pages' lines are aligned by
their longest common subsequence, and the shared lines come from the site unless markup tells otherwise.
Plain lines of an article are its text even if the neighbour has them, since articles repeat and are copied;
lines in a part of it whose name only hints at what it is (`ad-slot`), and all lines of a page
without an article or with more text beside it, go if they are shared. Lines beside a larger article go.
A container that only its name excludes stays nevertheless if the article lies in it, or, on a
page without one, most of the text.

Pages meet their neighbours by rank in the order of host and path. The ranks come from a range
partitioning, so one large host spreads over as many tasks as it fills. Lines meet as hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmerge.llm.rows import staged

# HTML's element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup td th time tt u var".split()
)
SILENT = frozenset(
    "script style noscript template head title nav footer aside button select textarea iframe "
    "svg canvas object dialog menu datalist audio video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in class and id names, and roles, of parts that aren't the main text.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar "
    "side menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist discussion disqus replies reply respond "
    "widget toolbar pagination pager masthead copyright legal disclaimer skip search tags "
    "contentinfo complementary alertdialog dialog form".split()
)
#: What markup says of a line: beside the article, its text, in a part of it with a hint, or nothing.
_BESIDE, _TOLD, _HINTED, _OPEN = range(4)


def _hints(names: str) -> bool:
    """Whether a word of a compound name tells of another part."""
    return not PARTS.isdisjoint(names.replace("_", "-").replace("-", " ").split())


class _Reader(HTMLParser):
    """Lines of a page with the kind of their place; unclosed and unopened tags are forgiven."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str, tuple[int, ...], bool]] = []
        # Tag, kind (loose, main, article, header, out), the containers around that a name excludes,
        # and whether one inside the article has a name that hints at it.
        self.open: list[tuple[str, str, tuple[int, ...], bool]] = []
        self.named = 0
        self.counts: Counter[str] = Counter()
        self.buffer: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section ends at the next `>`, as in browsers; the base class may raise."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _kind(self) -> str:
        return self.open[-1][1] if self.open else "loose"

    def _held(self) -> tuple[int, ...]:
        return self.open[-1][2] if self.open else ()

    def _hinted(self) -> bool:
        return bool(self.open) and self.open[-1][3]

    def _flush(self) -> None:
        if self.buffer:
            line = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if line and self._kind() not in ("out", "header"):
                self.lines.append((line, self._kind(), self._held(), self._hinted()))

    def _close(self, n: int) -> None:
        while len(self.open) > n:
            self.counts[self.open.pop()[0]] -= 1

    def _imply(self, tag: str) -> None:
        """A block ends an open paragraph, an item the item before it."""
        ended = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "option": "option"}.get(tag)
        for name, stops in (("p", None), (ended, ("ul", "ol", "dl", "table"))):
            if not name or not self.counts[name]:
                continue
            for k in range(len(self.open) - 1, -1, -1):
                other = self.open[k][0]
                if other == name:
                    self._close(k)
                    break
                if other not in INLINE and (stops is None or other in stops):
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag in ("td", "th"):
            self.buffer.append(" ")
        elif tag not in INLINE:
            self._flush()
            self._imply(tag)
        if tag in VOID:
            return
        kind, held, hinted = self._kind(), self._held(), self._hinted()
        if kind != "out" and tag not in ("html", "body"):
            given = dict(attrs)
            inside = held
            if tag in SILENT or "hidden" in given or given.get("aria-hidden") == "true":
                new = "out"
            elif tag == "header" or given.get("role") == "banner":
                new = "header" if kind == "article" else "out"
            elif kind == "header":
                new = "article" if tag in HEADINGS else "header"
            elif tag == "article" or tag == "main" or given.get("role") in ("main", "article"):
                main = tag == "main" or given.get("role") == "main"
                new = kind if main and kind == "article" else "main" if main else "article"
            else:
                new = kind
            names = " ".join(given.get(x) or "" for x in ("class", "id", "role")) if attrs else ""
            named = names and tag not in ("article", "main") and not PARTS.isdisjoint(names.lower().split())
            if new != "out" and (named or tag == "form"):
                self.named += 1
                inside = (*held, self.named)
            # What the article stands in tells nothing of it.
            hint = new in ("article", "main") and new == kind and (hinted or bool(names) and _hints(names.lower()))
            if (new != kind or inside != held or hint != hinted) and tag in INLINE:
                self._flush()
            kind, held, hinted = new, inside, hint
        self.open.append((tag, kind, held, hinted))
        self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.counts[tag]:
            return
        k = len(self.open) - 1
        while self.open[k][0] != tag:
            k -= 1
        before = self.open[k - 1][1:] if k else ("loose", (), False)
        if tag not in INLINE or before != (self._kind(), self._held(), self._hinted()):
            self._flush()
        self._close(k)

    def handle_data(self, data: str) -> None:
        if self._kind() != "out":
            self.buffer.append(data)


def _kept(lines: list[tuple[str, str, tuple[int, ...], bool]]) -> list[tuple[str, str, bool]]:
    """Lines, kinds and hints outside the containers that a name excludes, but for those that hold the text."""
    depths = [len(held) for _, kind, held, _ in lines if kind in ("article", "main")]
    if depths:
        lifted = {c for _, kind, held, _ in lines if kind in ("article", "main") and len(held) == min(depths) for c in held}
    else:
        sizes: Counter[int] = Counter()
        for line, _, held, _ in lines:
            for c in held:
                sizes[c] += len(line)
        total = sum(len(line) for line, *_ in lines)
        lifted = {c for c, size in sizes.items() if 2 * size > total}
    return [(line, kind, hinted) for line, kind, held, hinted in lines if lifted.issuperset(held)]


def _marked(html: str | None) -> list[tuple[str, str, int]]:
    """The lines of a page that markup doesn't exclude, with their kind and what markup says of them."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._flush()
    lines = _kept(reader.lines)
    sizes = Counter({"article": 0, "main": 0, "loose": 0})
    for line, kind, _ in lines:
        sizes[kind] += len(line)
    if sizes["main"] or sizes["article"] and sizes["article"] >= sizes["loose"]:
        # A teaser in the main part doesn't stand for it.
        told = ("article",) if sizes["article"] >= sizes["main"] else ("article", "main")
        marks = {True: _HINTED, False: _TOLD}
        return [(line, kind, marks[hinted] if kind in told else _BESIDE) for line, kind, hinted in lines]
    return [(line, kind, _OPEN) for line, kind, _ in lines]


def read(html: str | None) -> tuple[list[str] | None, list[str]]:
    """The lines of the page's article (None if it has none, or more text beside it) and its loose lines."""
    lines = _marked(html)
    told = [line for line, _, mark in lines if mark in (_TOLD, _HINTED)]
    if told:
        return told, [line for line, kind, mark in lines if mark == _BESIDE and kind == "loose"]
    return None, [line for line, *_ in lines]


def shared_lines(own: list, other: list) -> set[int]:
    """Places in `own` of a longest common subsequence with `other`.

    The rows of the table of lengths are bit vectors (Hyyrö), of which every so many are kept and
    the others found again on the way back: n * m / 64 steps, however often lines repeat.
    """
    head = 0
    while head < min(len(own), len(other)) and own[head] == other[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    out = {*range(head), *range(len(own) - tail, len(own))}
    # Lines that one page alone has can't be shared.
    both = set(own[head : len(own) - tail]).intersection(other[head : len(other) - tail])
    rows = [k for k in range(head, len(own) - tail) if own[k] in both]
    columns = [line for line in other[head : len(other) - tail] if line in both]
    if not rows:
        return out
    places = dict.fromkeys(both, 0)
    for k, line in enumerate(columns):
        places[line] |= 1 << k
    full = (1 << len(columns)) - 1
    step = math.isqrt(len(rows)) + 1

    def further(row: int, k: int) -> int:
        hit = row & places[own[rows[k]]]
        return (row + hit | row - hit) & full

    kept, row = [], full
    for k in range(len(rows)):
        if k % step == 0:
            kept.append(row)
        row = further(row, k)
    at = len(columns)
    for block in range(len(kept) - 1, -1, -1):
        lo = block * step
        table = [kept[block]]
        for k in range(lo, min(lo + step, len(rows))):
            table.append(further(table[-1], k))
        for k in range(len(table) - 2, -1, -1):
            # A zero bit: the length grows with this column.
            while at and table[k + 1] >> (at - 1) & 1:
                at -= 1
            if at and table[k] >> (at - 1) & 1:
                out.add(rows[lo + k])
                at -= 1
    return out


def _own(hashes: list[int], marks: list[int], other: list[int] | None) -> tuple[int, list[bool] | None]:
    """How many lines the neighbour shares, and which of the possible text stay (null: all of them)."""
    shared = shared_lines(hashes, other) if other else set()
    stays = [mark == _TOLD or k not in shared for k, mark in enumerate(marks) if mark != _BESIDE]
    # If nothing would be left, the pages are copies.
    return len(shared), None if all(stays) or not any(stays) else stays


def _keyed(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    keys = [F.xxhash64(url_column, id_column).alias("a"), F.xxhash64(html_column, url_column, id_column).alias("b")]
    return pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"), *keys
    )


def _line_rows(keyed: DataFrame) -> DataFrame:
    """a, b, host, path, bare (it has lines beside an article), lines (hashes) and marks of every page with lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 50):  # few pages at a time in memory
                part = batch.slice(lo, 50)
                found = [_marked(html) for html in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4],
                        pa.array([[line for line, *_ in lines] for lines in found], pa.list_(pa.string())),
                        pa.array([[mark for *_, mark in lines] for lines in found], pa.list_(pa.int8())),
                    ],
                    names=["a", "b", "host", "path", "lines", "marks"],
                )

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", ""), r"(?:/|\.html?)$", "")
    rows = keyed.select("a", "b", host.alias("host"), path.alias("path"), "html").mapInArrow(
        run, "a bigint, b bigint, host string, path string, lines array<string>, marks array<tinyint>"
    )
    return rows.where(F.size("lines") > 0).select(
        "a", "b", "host", "path",
        F.exists("marks", lambda m: m.isin(_BESIDE, _OPEN)).alias("bare"),
        F.transform("lines", lambda line: F.xxhash64(line)).alias("lines"), "marks",
    )


def _text_rows(keyed: DataFrame) -> DataFrame:
    """id, url, a, b, text (all possible text), and the lines of it where markup leaves some open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 50):
                part = batch.slice(lo, 50)
                texts, opens = [], []
                for html in part.column(4).to_pylist():
                    marked = _marked(html)
                    lines = [line for line, _, mark in marked if mark != _BESIDE]
                    texts.append("\n\n".join(lines))
                    opens.append(lines if any(mark in (_HINTED, _OPEN) for *_, mark in marked) else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(texts, pa.string()), pa.array(opens, pa.list_(pa.string()))],
                    names=["id", "url", "a", "b", "text", "lines"],
                )

    narrow = keyed.select("id", "url", "a", "b", "html")
    ids, urls = (narrow.schema[k].dataType.simpleString() for k in (0, 1))
    return narrow.mapInArrow(run, f"id {ids}, url {urls}, a bigint, b bigint, text string, lines array<string>")


def _neighbours(paths: DataFrame) -> DataFrame:
    """(host, bare, path, other): the lines of the host's page of nearest path, null if it is alone."""
    order = ["host", "bare", "path"]
    ordered = paths.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = staged(
        ordered.withColumn("id", F.monotonically_increasing_id()).select(
            *order, "lines",
            F.shiftright("id", 33).alias("part"),
            F.col("id").bitwiseAND((1 << 33) - 1).alias("place"),
        ),
        "paths",
    )
    counts = placed.groupBy("part").count().orderBy("part").collect()  # a row for each partition
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["part"], total))
        total += row["count"]
    if not offsets:
        return placed.select(*order, F.col("lines").alias("other"))
    table = placed.sparkSession.createDataFrame(offsets, "part bigint, first bigint")
    ranked = placed.join(F.broadcast(table), "part").select(
        *order, "lines", (F.col("first") + F.col("place")).alias("rank")
    )
    sides = ranked.select(*order, F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"), "rank")
    others = ranked.select(
        F.col("host").alias("h"), F.col("bare").alias("s"), F.col("path").alias("p"),
        F.col("lines").alias("other"), F.col("rank").alias("r"),
    )

    @F.udf("int", useArrow=True)
    def prefix(a: str, b: str) -> int:
        n = min(len(a), len(b))
        return next((k for k in range(n) if a[k] != b[k]), n)

    near = (
        sides.join(others, F.col("rank") + F.col("step") == F.col("r"))
        .where("host = h AND bare = s")
        .select(*order, "other", prefix("path", "p").alias("same"), "step")
    )
    return near.groupBy(*order).agg(
        F.max_by("other", F.struct("same", (-F.col("step")).alias("first"))).alias("other")
    )


def _differences(lines: DataFrame) -> DataFrame:
    """a, b, n_shared, stays: what differencing says of every page that shares a line with its neighbour."""
    order = ["host", "bare", "path"]
    paths = lines.groupBy(*order).agg(F.min_by("lines", F.struct("a", "b")).alias("lines"))
    difference = F.udf(_own, "n_shared bigint, stays array<boolean>", useArrow=True)
    told = lines.join(_neighbours(paths), order, "left").select(
        "a", "b", difference("lines", "marks", "other").alias("d")
    )
    # Equal keys are equal pages.
    return told.where("d.n_shared > 0").groupBy("a", "b").agg(F.first("d").alias("d")).select("a", "b", "d.*")


def main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """`id_column`, `url_column`, text (blocks joined by an empty line), n_chars (code points), n_shared.

    n_shared counts the lines that the nearest page of the host has as well. A null or empty page
    has an empty text. Pages of one host and path, whatever their query, are
    versions of one page and aren't compared with each other. A page without an article and
    without a neighbour keeps its loose lines. Pages with text beside an article, or without one, are
    compared with each other, and so are the others. Ids may be null or repeat; one row in, one row
    out; other columns aren't read. Pages are read twice, so that only hashes of lines are written.
    """
    keyed = _keyed(pages, id_column, url_column, html_column)
    found = staged(_differences(staged(_line_rows(keyed), "lines")), "differences")
    told = _text_rows(keyed).join(found, ["a", "b"], "left")
    left = F.array_join(F.filter("lines", lambda line, k: F.get("stays", k)), "\n\n")
    text = F.when(F.col("stays").isNotNull(), left).otherwise(F.col("text"))
    return told.select(
        F.col("id").alias(id_column), F.col("url").alias(url_column), text.alias("text"),
        F.char_length(text).cast("bigint").alias("n_chars"),
        F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"),
    )
