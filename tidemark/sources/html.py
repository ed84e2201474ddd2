"""HTML pages → rows by a selector spec.

The reference walks a schedule page: blocks (one per week), two date spans per block
(month, week), item cards inside each block with name, price, category and a
restock marker.  Here that walk is driven by a small spec and runs inside
``mapInArrow`` with the standard-library ``html.parser`` (no extra dependency): each
task streams its own pages through a selector automaton and emits one row per (page, block, item).  Pages of plain
markup, which has one reading, are cut into tags without that parser.  The ordered
parts that cross pages (the month carried from the previous block and page, the
last-block-wins slot rule) are ordinary DataFrame windows afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import ustrip
from ..functions.text import RESTOCK_TEXT, after_equals
from ..operators.align import fill_forward
from ..session import cut_lineage, ship_package

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}


@dataclass(frozen=True)
class Sel:
    """``tag`` with an optional class; ``attr`` takes that attribute instead of the text."""
    tag: str
    cls: str | None = None
    attr: str | None = None


@dataclass(frozen=True)
class BlockSpec:
    block: Sel
    block_fields: dict = field(default_factory=dict)   # name -> (Sel, occurrence)
    item: Sel | None = None
    item_fields: dict = field(default_factory=dict)    # name -> Sel (first match)


# Fixed values that must equal the reference's: the schedule-page selectors.
SCHEDULE_SPEC = BlockSpec(
    block=Sel("div", "week"),
    block_fields={"month": (Sel("span", "pg-schedule__month--date"), 0),
                  "week": (Sel("span", "pg-schedule__month--date"), 1)},
    item=Sel("div", "c-card__list"),
    item_fields={"name": Sel("p", "c-card__name"), "price": Sel("span", "c-card__price--main"),
                 "category": Sel("i", "c-card__category"), "resale": Sel("span", "c-card__resale--txt")},
)


class _Tag:
    """What a spec makes of a start tag: the fields and elements that it fits."""
    __slots__ = ("name", "void", "given", "item_fields", "block_fields", "item", "block", "fits", "leaf")

    def __init__(self, spec: BlockSpec, name: str, attrs: list, void: bool):
        self.name, self.void, self.given = name, void, {k: (v or "") for k, v in attrs}
        classes = (self.given.get("class") or "").split()
        fits = lambda sel: sel is not None and sel.tag == name and (sel.cls is None or sel.cls in classes)
        self.item_fields = [(n, sel) for n, sel in spec.item_fields.items() if fits(sel)]
        self.block_fields = [(n, sel, k) for n, (sel, k) in spec.block_fields.items() if fits(sel)]
        self.item, self.block = fits(spec.item), fits(spec.block)
        self.fits = bool(self.item_fields or self.block_fields or self.item or self.block)
        self.leaf = not (void or self.item or self.block)


class _Block:
    """An open block: its number, how often each field was met, what was found, items that wait for its fields."""
    __slots__ = ("no", "met", "values", "left", "items", "waiting")

    def __init__(self, no: int, fields: int):
        self.no, self.met, self.values, self.left, self.items, self.waiting = no, {}, {}, fields, 0, []


class _Item:
    __slots__ = ("block", "no", "values")

    def __init__(self, block: _Block, no: int):
        self.block, self.no, self.values = block, no, {}


#: What ends with a tag.
_ITEM_FIELD, _BLOCK_FIELD, _ITEM, _BLOCK = range(4)


class _Extractor(HTMLParser):
    """Rows (block_no, item_no, block values, item values) of a page, as its tags go by.

    No tree is built.  Kept are the open tags, the blocks, items and fields open inside them with the text since the
    outermost of these fields, and the finished
    items of blocks whose fields haven't all been met.  An end tag closes the nearest open tag of its name with all inside
    it; one without such a tag is ignored; what is open at the end of the page is closed there.
    """

    def __init__(self, spec: BlockSpec):
        super().__init__(convert_charrefs=True)
        self.spec, self.rows, self.blocks = spec, [], 0
        # (name, what ends with it) of the open tags, outermost first
        self.tags: list[tuple[str, list | None]] = []
        self.count: dict[str, int] = {}
        self.open_blocks: list[_Block] = []
        self.open_items: list[_Item] = []
        self.texts: list[str] = []
        self.open_fields = 0

    def handle_starttag(self, tag, attrs):
        self.start(_Tag(self.spec, tag, attrs, tag in _VOID))

    def handle_startendtag(self, tag, attrs):
        self.start(_Tag(self.spec, tag, attrs, True))

    def handle_endtag(self, tag):
        if self.count.get(tag):
            while self._end_last() != tag:
                pass

    def handle_data(self, data):
        if self.open_fields:
            self.texts.append(data)

    def close(self):
        super().close()
        while self.tags:
            self._end_last()

    def start(self, tag: _Tag):
        name = tag.name
        self.count[name] = self.count.get(name, 0) + 1
        ends = None
        if tag.fits:
            ends = []
            for field, sel in tag.item_fields:
                for item in self.open_items:
                    if field not in item.values:
                        if sel.attr:
                            item.values[field] = tag.given.get(sel.attr)
                        else:
                            # met; its text follows when the tag is closed
                            item.values[field] = None
                            self._open(ends, _ITEM_FIELD, item, field)
            for block in self.open_blocks:
                for field, sel, occurrence in tag.block_fields:
                    met = block.met[field] = block.met.get(field, -1) + 1
                    if met == occurrence:
                        if sel.attr:
                            self._field(block, field, tag.given.get(sel.attr))
                        else:
                            self._open(ends, _BLOCK_FIELD, block, field)
                if tag.item:
                    item = _Item(block, block.items)
                    block.items += 1
                    self.open_items.append(item)
                    ends.append((_ITEM, item, None, 0))
            if tag.block:
                block = _Block(self.blocks, len(self.spec.block_fields))
                self.blocks += 1
                self.open_blocks.append(block)
                ends.append((_BLOCK, block, None, 0))
        self.tags.append((name, ends))
        if tag.void:
            self._end_last()

    def leaf(self, tag: _Tag, text: str):
        """A tag, text and its end, of no block or item and in one block at most."""
        for field, sel in tag.item_fields:
            for item in self.open_items:
                if field not in item.values:
                    item.values[field] = tag.given.get(sel.attr) if sel.attr else text
        for block in self.open_blocks:
            for field, sel, occurrence in tag.block_fields:
                met = block.met[field] = block.met.get(field, -1) + 1
                if met == occurrence:
                    self._field(block, field, tag.given.get(sel.attr) if sel.attr else text)

    def _open(self, ends: list, kind: int, owner, field: str):
        ends.append((kind, owner, field, len(self.texts)))
        self.open_fields += 1

    def _end_last(self) -> str:
        name, ends = self.tags.pop()
        self.count[name] -= 1
        if ends:
            for kind, owner, field, first in reversed(ends):
                if kind == _ITEM_FIELD:
                    owner.values[field] = "".join(self.texts[first:])
                elif kind == _BLOCK_FIELD:
                    self._field(owner, field, "".join(self.texts[first:]))
                elif kind == _ITEM:
                    self._item_ends(owner)
                    continue
                else:
                    self._block_ends(owner)
                    continue
                self.open_fields -= 1
                if not self.open_fields:
                    self.texts = []
        return name

    def _field(self, block: _Block, name: str, value):
        block.values[name] = value
        block.left -= 1
        if not block.left:
            self._hand_on(block)

    def _hand_on(self, block: _Block):
        self.rows += [(block.no, no, block.values, values) for no, values in block.waiting]
        block.waiting = []

    def _item_ends(self, item: _Item):
        self.open_items.remove(item)
        item.block.waiting.append((item.no, item.values))
        if not item.block.left:
            self._hand_on(item.block)

    def _block_ends(self, block: _Block):
        self.open_blocks.remove(block)
        if not block.items:
            block.waiting.append((None, {}))
        self._hand_on(block)


#: Characters of a page that are parsed before its rows so far are handed on.
_PARSED_AT_ONCE = 1 << 16


#: A tag written so that there is one way to read it; the elements whose text isn't read as markup are left out.
_PLAIN_TAG = re.compile(r'(/?)(?!(?:script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|plaintext)\b)'
                        r'([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"<>&]*")*)')
_PLAIN_ATTR = re.compile(r' ([a-z][a-z0-9-]*)="([^"]*)"')
#: Plain tags that a task remembers, and the longest of them.
_TAGS_KEPT, _LONGEST_TAG = 1 << 14, 200


_CUT = re.compile("<([^<>]*)>([^<]*)")


class _PlainTags(dict):
    """The text of a tag -> what it is: a start tag, an end tag's name, or None if it isn't plain."""

    def __init__(self, spec: BlockSpec):
        super().__init__()
        self.spec = spec

    def __missing__(self, text: str) -> _Tag | str | None:
        found = _PLAIN_TAG.fullmatch(text)
        tag = None
        if found and not (found[1] and found[3]):
            tag = found[2] if found[1] else _Tag(self.spec, found[2], _PLAIN_ATTR.findall(found[3]), found[2] in _VOID)
        if len(text) <= _LONGEST_TAG:
            if len(self) >= _TAGS_KEPT:
                self.clear()
            self[text] = tag
        return tag


def _plain_rows(html: str, page: _Extractor, tags: _PlainTags) -> list | None:
    """The rows of a page of plain tags and text only, by the extractor's own steps; None for any other page."""
    if "&" in html or "\0" in html:
        return None
    cut = _CUT.findall(html)
    known = [tags[text] for text, _ in cut]
    if None in known or len(cut) != html.count("<"):
        return None
    start, end, data, leaf, blocks = page.start, page.handle_endtag, page.handle_data, page.leaf, page.open_blocks
    ended = False
    for (_, text), tag, after in zip(cut, known, [*known[1:], None]):
        if ended:
            # the end of what was taken as a whole
            ended = False
        elif tag.__class__ is str:
            end(tag)
        elif tag.name == after and tag.leaf and len(blocks) < 2:
            if tag.fits:
                leaf(tag, text)
            ended = True
        else:
            start(tag)
        if text and page.open_fields:
            data(text)
    page.close()
    return page.rows


def page_rows(html: str | None, spec: BlockSpec, tags: _PlainTags | None = None):
    """(block_no, item_no, block values, item values) of a page, without a value where nothing was found.

    A page of plain tags and text is cut at its angle brackets; ``html.parser`` reads any other one, and long ones piece by piece.
    """
    page = _Extractor(spec)
    html = html or ""
    if len(html) <= _PARSED_AT_ONCE:
        rows = _plain_rows(html, page, _PlainTags(spec) if tags is None else tags)
        if rows is not None:
            yield from rows
            return
    for at in range(0, len(html), _PARSED_AT_ONCE):
        page.feed(html[at:at + _PARSED_AT_ONCE])
        yield from page.rows
        page.rows = []
    page.close()
    yield from page.rows


def extract_blocks(df: DataFrame, html_col: str, keys: Sequence[str], spec: BlockSpec) -> DataFrame:
    """One row per (page keys, block_no, item_no) with the spec's fields as strings; rows leave a task as they are found."""
    keys = list(keys)
    bnames = list(spec.block_fields)
    inames = list(spec.item_fields)
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys]
                       + ["block_no int", "item_no int"]
                       + [f"{n} string" for n in bnames + inames])

    ship_package(df.sparkSession)

    names = keys + ["block_no", "item_no"] + bnames + inames

    def run(batches):
        tags = _PlainTags(spec)
        for b in batches:
            def ready(out):
                pages, bnos, inos, found, inside = zip(*out) if out else [()] * 5
                own = pa.array(pages, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [b.column(k).take(own) for k in range(len(keys))] + [pa.array(x, pa.int32()) for x in (bnos, inos)]
                    + [pa.array([f.get(n) for f in found], pa.string()) for n in bnames]
                    + [pa.array([f.get(n) for f in inside], pa.string()) for n in inames], names=names)

            out = []
            for at in range(0, b.num_rows, 1000):
                for k, text in enumerate(b.column(len(keys)).slice(at, 1000).to_pylist(), at):
                    for row in page_rows(text, spec, tags):
                        out.append((k, *row))
                        if len(out) >= 4096:
                            yield ready(out)
                            out = []
            yield ready(out)

    return df.select(*keys, html_col).mapInArrow(run, schema)


def schedule_items(blocks: DataFrame, page_order: str, url_col: str = "url") -> DataFrame:
    """W5/W6 over ``extract_blocks(..., SCHEDULE_SPEC)`` output, pages in ``page_order``.

    * a block without date spans has week 0 and reuses the month last seen, in this
      page or an earlier one (the reference keeps ``month`` global);
    * slot = (week − 2) mod 5 + 1, for weeks −3 to 6;
    * a block fails its page where a date span is missing or no number, the week lies
      outside those, or an item lacks name, price or category.  Blocks after it are never
      read, so they set no month; the failing block still sets one if its month was read;
    * a page is also lost when no month was ever seen before its end, or its URL has no "=";
    * within a (page, slot) the last block wins;
    * every output row carries the page's month as it stands after its last block
      (that is what the reference writes into each slot file) and the key after "="
      in the page URL.
    """
    dated = F.col("month").isNotNull()
    month, week = ustrip("month").try_cast("int"), F.when(dated, ustrip("week").try_cast("int")).otherwise(F.lit(0))
    part_missing = F.col("item_no").isNotNull() & (F.col("name").isNull() | F.col("price").isNull() | F.col("category").isNull())
    # one shuffle by page serves all that is known inside a page; a block after the failing one counts for nothing
    w = Window.partitionBy(page_order)
    b = blocks.where(F.col(page_order).isNotNull()).withColumns({"month_i": month, "week_i": week}).withColumn(
        "fails", part_missing | (dated & F.col("month_i").isNull()) | F.coalesce(~F.col("week_i").between(-3, 6), F.lit(True)))
    b = b.withColumn("_failed", F.min(F.when(F.col("fails"), F.col("block_no"))).over(w))
    b = b.where(F.col("_failed").isNull() | (F.col("block_no") <= F.col("_failed")))
    b = b.withColumns({"_own": F.max_by("month_i", F.when(F.col("month_i").isNotNull(), F.col("block_no"))).over(w),
                       "slot": F.pmod(F.col("week_i") - 2, F.lit(5)) + 1, "ym": after_equals(url_col)})
    good = F.col("_failed").isNull() & F.col("ym").isNotNull()
    last = F.max(F.when(good, F.col("block_no"))).over(Window.partitionBy(page_order, "slot"))
    read = cut_lineage(b.select(
        page_order, "ym", "slot", "_own", "block_no", "item_no", "name", "price", "category", "resale",
        (good & (F.col("block_no") == last) & F.col("item_no").isNotNull()).alias("_kept")))
    # a page without a month of its own has that of the page before it
    own = cut_lineage(read.groupBy(page_order).agg(F.max("_own").alias("month")))
    months = fill_forward(own, [page_order], ["month"]).where(F.col("month").isNotNull())
    return read.where(F.coalesce(F.col("_kept"), F.lit(False))).join(months, page_order).select(
        page_order, "ym", "slot", "month",
        "block_no", "item_no", "name", "price", "category",
        F.coalesce(F.col("resale") == F.lit(RESTOCK_TEXT), F.lit(False)).alias("is_resell"))
