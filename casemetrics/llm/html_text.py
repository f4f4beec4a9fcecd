"""Main text of web pages: their article, and what a host repeats taken out elsewhere.

A page is read once by the standard parser. Scripts, styles, forms, menus, headers, footers,
sidebars, notices, adverts and reader comments are left out by element, role and class. If the page
marks an article (or main part), its blocks are the text.

What markup leaves open is told by the host. Token streams of its pages are grouped by their
suffixes, as deep as ``MIN_RUN`` tokens; equal suffixes have one fingerprint, so they are not sorted.
Groups that hold two different pages are repeated runs. They are dealt by host and run, so a large
host is no single task. Three kinds of stream take part:

- Pages that mark no article. The tokens that repeated runs cover are removed and the unique runs
  kept. A run repeats if another such page holds it, or a marked page beside its article.
- Blocks beside a marked article. They are left out whatever repeats, and tell about unmarked pages.
- Layout in a marked article: blocks of a div, section, list or the like, neither in the article
  directly nor in ``PROSE``, if they are less text than the rest of the article. A block goes if
  repeated runs cover it whole. A run repeats if two unlike articles hold it as layout, that is
  articles whose other text shares none of ``SLOTS`` smallest hashes, so near copies do not count. Each
  article is compared with two of the group that are unlike. Pages without a host are left alone.

Prose is not cut by runs, because articles of one host share passages and whole copies that belong
to the text.

Null or empty html gives an empty text. Rows of equal html are one page, whatever their page_id: the
copies of a page do not count as a run that its host repeats. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import ship, stored
from casemetrics.llm.text import words

MIN_RUN = 8
#: Smallest hashes that tell near copies: with half of their runs in common one in 65,536 seems unlike.
SLOTS = 16
#: Elements and class words that never hold the main text.
CHROME = frozenset(
    """head script style noscript template svg math canvas iframe object audio video nav footer aside
    form button select textarea input label dialog menu""".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
CHROME_WORDS = frozenset(
    """ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice
    alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget related
    recommended share sharing social newsletter subscribe subscription comment comments respond disqus
    footer masthead topbar pagination toolbar""".split()
)
#: Words that make of a class a state of its element, such as ``has-sidebar``.
STATES = frozenset("has no with without is not hide show".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article blockquote body br caption center dd details div dl dt fieldset figcaption figure
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead
    tr ul""".split()
)
#: Elements whose text belongs to the article that holds them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table caption tbody thead tfoot tr td th dl dt dd".split())


#: Where a block stands: in an article, in one that a class of chrome wraps, beside any, in chrome.
ARTICLE, WRAPPED, BESIDE, LEFT_OUT = range(4)
#: Kinds of token streams: of a page that marks no article, beside an article, of layout in one.
UNMARKED, OUTSIDE, LAYOUT = range(3)


def _names_chrome(name: str) -> bool:
    """Whether a class or id names chrome; what tells a state of its element names none."""
    parts = re.split(r"[^a-z]+", name)
    return parts[0] not in STATES and not CHROME_WORDS.isdisjoint(parts)


class _Reader(HTMLParser):
    """Blocks of a page, each with where it stands.

    Elements and roles of chrome are left out with all they hold. A class or id of chrome is left
    out with what it holds up to an article inside, as it may name the layout of a whole page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Blocks as where they stand, whether they are layout, text.
        self.blocks: list[tuple[int, bool, str]] = []
        self.parts: list[str] = []
        #: Open elements as tag, chrome by element, chrome by class, article.
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.chrome = 0
        #: Chrome by class since the innermost article, or the page, began; and outside of articles.
        self.named = [0]
        #: Open elements of prose and other blocks since the innermost article, or the page, began.
        self.prose, self.layout = [0], [0]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        place = self._place()
        if text and place != LEFT_OUT:
            self.blocks.append((place, self.layout[-1] > 0 and not self.prose[-1], text))

    def _place(self) -> int:
        if self.chrome or self.named[-1]:
            return LEFT_OUT
        if len(self.named) == 1:
            return BESIDE
        return WRAPPED if any(self.named) else ARTICLE

    def _is_chrome(self, tag: str, attributes: list) -> tuple[bool, bool]:
        """Whether an element is chrome by what it is, and by its class or id alone."""
        if tag in CHROME or tag == "header" and len(self.named) == 1:
            return True, False
        if tag in ("html", "body", "article", "main"):
            return False, False
        named = False
        for name, value in attributes:
            value = (value or "").lower()
            if name == "role" and value in CHROME_ROLES or name == "hidden":
                return True, False
            if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                return True, False
            if name in ("class", "id"):
                named = named or any(map(_names_chrome, value.split()))
        return False, named

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in BLOCKS or tag in CHROME:
            self.flush()
        if tag in VOID:
            return
        if tag in ("p", "li") and any(t == tag for t, *_ in self.open[-1:]):
            self._close(tag)
        chrome, named = self._is_chrome(tag, attributes)
        article = tag in ("article", "main") and not self.chrome and not (len(self.named) > 1 and self.named[-1])
        self.open.append((tag, chrome, named, article))
        self.chrome += chrome
        self.named[-1] += named
        self._count(tag, article, 1)
        if article:
            for counts in (self.named, self.prose, self.layout):
                counts.append(0)

    def _count(self, tag: str, article: bool, step: int) -> None:
        if tag in PROSE:
            self.prose[-1] += step
        elif tag in BLOCKS and not article:
            self.layout[-1] += step

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self._close(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in CHROME:
            self.flush()
        if tag not in VOID:
            self._close(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                for name, chrome, named, article in reversed(self.open[i:]):
                    if article:
                        for counts in (self.named, self.prose, self.layout):
                            counts.pop()
                    self.chrome -= chrome
                    self.named[-1] -= named
                    self._count(name, article, -1)
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.chrome and not self.named[-1]:
            self.parts.append(data)


def _page(html: str | None) -> tuple[bool, list[str], list[int], list[list[str]]]:
    """Whether the page marks its article; the blocks of the article or else of the page; for each
    the stretch of layout that it belongs to, or -1; and the stretches of blocks beside an article.

    Articles that a class of chrome wraps are its article only where no other is marked.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    places = {place for place, *_ in reader.blocks}
    marked = next((place for place in (ARTICLE, WRAPPED) if place in places), None)
    if marked is None:
        return False, [text for *_, text in reader.blocks], [-1] * len(reader.blocks), []
    blocks, stretches, beside = [], [], []
    before, stretch = None, -1
    for place, layout, text in reader.blocks:
        kind = (place, layout and place == marked)
        if place == marked:
            stretch += layout and kind != before
            blocks.append(text)
            stretches.append(stretch if layout else -1)
        elif place == BESIDE:
            if kind != before:
                beside.append([])
            beside[-1].append(text)
        before = kind
    return True, blocks, stretches, beside


def page_blocks(html: str | None) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the blocks of the article or else of the page."""
    return _page(html)[:2]


def _smallest(runs: np.ndarray) -> list[int]:
    """The smallest of each of ``SLOTS`` hashes of the runs."""
    odd = np.arange(1, 2 * SLOTS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = runs ^ (runs >> np.uint64(29))
    return [int(((mixed * m) >> np.uint64(1)).min()) for m in odd]


def _layout(blocks: list[str], stretches: list[int]) -> tuple[list[list[str]], list[int] | None]:
    """Stretches of layout of an article that runs may decide about, and the smallest hashes of the rest."""
    prose, layout = [], {}
    for block, stretch in zip(blocks, stretches, strict=True):
        (prose if stretch < 0 else layout.setdefault(stretch, [])).append(block)
    if not layout:
        return [], None
    runs, tokens = _runs(prose)
    if not len(runs) or len(tokens) <= sum(block.count(" ") + 1 for stretch in layout.values() for block in stretch):
        return [], None
    return list(layout.values()), _smallest(runs)


READ = """page_id long, url string, _key long, blocks array<string>, stretches array<int>,
    streams array<array<array<string>>>, smallest array<long>"""


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the blocks of their text and, by kind, the streams that their host is told by.

    ``stretches`` is null where runs may cut any token.
    """
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            found = []
            for html in part.column("html"):
                marked, blocks, stretches, beside = _page(html.as_py())
                if marked:
                    layout, smallest = _layout(blocks, stretches)
                    found.append((blocks, stretches, [[], beside, layout] if beside or layout else [], smallest))
                else:
                    found.append((blocks, None, [[blocks], [], []] if blocks else [], None))
            texts = pa.list_(pa.string())
            types = texts, pa.list_(pa.int32()), pa.list_(pa.list_(texts)), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("page_id", "url", "_key")]
                + [pa.array([f[i] for f in found], t) for i, t in enumerate(types)],
                names=["page_id", "url", "_key", "blocks", "stretches", "streams", "smallest"],
            )


def _runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``MIN_RUN`` words of a page's blocks in a row, and where they start."""
    raw = "\n".join(texts).encode()
    _, _, hashes, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)
    if len(hashes) < MIN_RUN:
        return np.empty(0, np.uint64), hashes
    total = np.zeros(len(hashes) - MIN_RUN + 1, np.uint64)
    for i in range(MIN_RUN):
        total += hashes[i : i + len(total)] * np.uint64(2 * i * 0x9E3779B97F4A7C15 % 2**64 + 1)
    return total, hashes


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct runs of every page and kind; the first row of layout also holds the smallest hashes."""
    for batch in batches:
        for i in range(batch.num_rows):
            smallest = batch.column("smallest")[i].as_py()
            for kind, stretches in enumerate(batch.column("streams")[i].as_py()):
                found = [_runs(stretch)[0] for stretch in stretches]
                distinct = np.unique(np.concatenate([np.empty(0, np.uint64), *found])).view(np.int64)
                n = len(distinct)
                if not n:
                    continue
                hashes = [smallest if kind == LAYOUT else None] + [None] * (n - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[i].as_py()] * n, t) for c, t in (("host", pa.string()), ("_key", pa.int64()))]
                    + [pa.array([kind] * n, pa.int32()), pa.array(distinct), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["host", "_key", "kind", "run", "smallest"],
                )


def _kept(blocks: list[str], repeated: np.ndarray) -> Iterator[tuple[str, list[str]]]:
    """Blocks of a stream, each with its words that no repeated run covers."""
    runs, hashes = _runs(blocks)
    keep = np.ones(len(hashes), bool)
    for at in np.flatnonzero(np.isin(runs, repeated)):
        keep[at : at + MIN_RUN] = False
    n = 0
    for block in blocks:
        tokens = block.split(" ")
        yield block, [t for t, k in zip(tokens, keep[n : n + len(tokens)], strict=False) if k]
        n += len(tokens)


def _unique_text(blocks: list[str], repeated: np.ndarray) -> list[str]:
    """Blocks without the words that repeated runs cover."""
    return [" ".join(left) for _, left in _kept(blocks, repeated) if left]


def _unique_layout(blocks: list[str], stretches: list[int], repeated: np.ndarray) -> list[str]:
    """Blocks of an article without those of its layout that repeated runs cover whole."""
    out = []
    for stretch, group in groupby(zip(stretches, blocks, strict=True), key=itemgetter(0)):
        own = [block for _, block in group]
        out += own if stretch < 0 else [block for block, left in _kept(own, repeated) if left]
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        columns = (batch.column(c) for c in ("blocks", "stretches", "_repeated"))
        for blocks, stretches, repeated in zip(*columns, strict=True):
            own = blocks.as_py()
            if repeated.is_valid:
                runs = np.array(repeated.as_py(), np.int64).view(np.uint64)
                own = _unique_layout(own, stretches.as_py(), runs) if stretches.is_valid else _unique_text(own, runs)
            texts.append("\n".join(own))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def _unlike(rows: DataFrame, other: str, smallest: DataFrame) -> DataFrame:
    """Rows whose article shares none of its smallest hashes with that of the page ``other``."""
    pairs = rows.select("host", "_key", other).distinct().join(smallest, ["host", "_key"])
    others = smallest.select("host", F.col("_key").alias(other), F.col("smallest").alias("_others"))
    pairs = pairs.join(others, ["host", other]).filter(~F.arrays_overlap("smallest", "_others"))
    return rows.join(pairs.select("host", "_key", other), ["host", "_key", other])


def _repeated(streams: DataFrame) -> DataFrame:
    """The runs of pages, as host, key and run, that their host repeats."""

    def ends(name: str, *kinds: int) -> list[Column]:
        key = F.when(F.col("kind").isin(*kinds), F.col("_key"))
        return [F.min(key).alias(f"{name}_x"), F.max(key).alias(f"{name}_y")]

    groups = streams.groupBy("host", "run").agg(*ends("plain", UNMARKED, OUTSIDE), *ends("layout", LAYOUT))
    met = streams.drop("smallest").join(groups.filter("plain_x <> plain_y or layout_x <> layout_y"), ["host", "run"])
    plain = met.filter(f"kind = {UNMARKED} and plain_x <> plain_y").select("host", "_key", "run")
    layout = met.filter(f"kind = {LAYOUT} and layout_x <> layout_y")
    layout = stored(layout.select("host", "_key", "run", F.col("layout_x").alias("one")))
    if layout.isEmpty():
        return plain
    smallest = stored(streams.filter("smallest is not null").select("host", "_key", "smallest").dropDuplicates(["host", "_key"]))
    far = stored(_unlike(layout, "one", smallest))
    near = layout.join(far.groupBy("host", "run").agg(F.min("_key").alias("two")), ["host", "run"])
    told = far.select(plain.columns).union(_unlike(near, "two", smallest).select(plain.columns))
    return plain.union(told)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    ship(pages.sparkSession)
    row = F.xxhash64("html")
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", row.alias("_key"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1))
    read = given.mapInArrow(_read, READ).withColumn("host", host)
    told = read.filter("size(streams) > 0 and (stretches is null or host <> '')").select("host", "_key", "streams", "smallest")
    streams = stored(told.mapInArrow(_streams, "host string, _key long, kind int, run long, smallest array<long>"))
    repeated = None
    if not streams.isEmpty():
        repeated = stored(_repeated(streams).groupBy("host", "_key").agg(F.collect_set("run").alias("_repeated")))
    if repeated is None or repeated.isEmpty():
        cut = read.withColumn("_repeated", F.lit(None).cast("array<long>"))
    else:
        cut = read.join(repeated, ["host", "_key"], "left")
    return cut.select("page_id", "url", "blocks", "stretches", "_repeated").mapInArrow(
        _cut, "page_id long, url string, text string, n_chars long"
    )
