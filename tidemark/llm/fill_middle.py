"""Fill-in-the-middle transformation, with cuts found in an indexable skip list.

A text is a row of units: code points, or the pieces that a pattern cuts it into.  The list's lowest lane
links every unit to the next, and express lane j about one unit in ``FAN``**j; a link
carries how many units and how many code points it passes.  A cut after r units is reached from the top
lane by taking links while the units passed stay within r, one lane lower whenever the next
link would pass too many; the code points passed on the way are the place of the cut.
Heights come from a hash of the unit's number, so a text has one list, on every worker.

Form and cuts are drawn from sha256(seed:id), so a row always gets the same ones:
plain (the text as it is), psm (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or spm (``<S>`` suffix ``<P>``
prefix ``<M>`` middle).  Texts that are empty or hold a marker stay plain, so outputs can be undone.

Null text is empty; a null id is drawn from as an empty string; repeated ids get equal draws, and each row is
transformed by itself; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick
from .lm_score import mix

MARKERS = ("<P>", "<S>", "<M>")
FAN = 16

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("output", pa.string())])


class Heights:
    """The units of each lane among the first ones: unit 0 has a link in every lane."""

    def __init__(self):
        self.size, self.lanes = 0, []

    def upto(self, n: int) -> list[np.ndarray]:
        if n > self.size:
            self.size = max(1 << 16, 1 << (n - 1).bit_length())
            left = mix(np.arange(1, self.size + 1, dtype=np.uint64))
            at = np.arange(self.size)
            self.lanes = []
            while len(at) > 1:
                up = (left % np.uint64(FAN)) == 0
                up[0] = True
                at, left = at[up], left[up] // np.uint64(FAN)
                self.lanes.append(at)
        out = []
        for lane in self.lanes:
            lane = lane[:np.searchsorted(lane, n)]
            out.append(lane)
            if len(lane) == 1:
                break
        return out


class SkipList:
    """Lanes, lowest first: each link's units, its code points, and where its unit stands one lane lower."""

    def __init__(self, ends: np.ndarray | None, n: int, heights: Heights):
        """``ends``: code points up to the end of each of n units; None where a unit is one code point."""
        self.n = n
        lanes = heights.upto(n) if n else []
        self.express = []
        below = None
        for lane in lanes:
            places = np.append(lane, n)
            chars = places if ends is None else np.append(0, ends)[places]
            down = lane if below is None else np.searchsorted(below, lane)
            self.express.append((np.diff(places), np.diff(chars), down))
            below = lane
        self.base = np.ones(n, np.int64) if ends is None else np.diff(ends, prepend=0)

    def find(self, rank: int) -> int:
        """Code points before the cut that ``rank`` units precede."""
        if not 0 <= rank <= self.n:
            raise ValueError("no such rank")
        units = chars = at = 0
        for width, size, down in reversed(self.express):
            while at < len(width) and units + (w := int(width[at])) <= rank:
                units += w
                chars += int(size[at])
                at += 1
            if units == rank:
                return chars
            at = int(down[at])
        for size in self.base[at:at + rank - units].tolist():
            chars += size
        return chars


def draws(id_column: str, seed: str) -> list[Column]:
    """The first four 32-bit numbers of sha256(seed:id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (code points; null if plain) and the output.

    ``unit`` is a pattern that cuts the text into units from left to right, such as ``\\S+\\s*|\\s+``;
    code points that it leaves out between two matches belong to the unit before (to the first one at the beginning).
    """
    pattern = re.compile(unit) if unit is not None else None
    p, s, m = MARKERS

    def make():
        heights = Heights()

        def run(cols):
            for doc, text, h1, h2, h3, h4 in zip(*cols):
                ends = None
                if pattern is None:
                    n = len(text)
                else:
                    starts = [x.start() for x in pattern.finditer(text) if x.end() > x.start()] or ([0] if text else [])
                    n = len(starts)
                    ends = np.array(starts[1:] + [len(text)] if n else [], np.int64)
                if not n or h3 % 100 >= 100 - plain_percent or any(x in text for x in MARKERS):
                    yield doc, n, "plain", None, None, text
                    continue
                lanes = SkipList(ends, n, heights)
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = lanes.find(a), lanes.find(b)
                head, middle, tail = text[:a], text[a:b], text[b:]
                if h4 % 100 < spm_percent:
                    yield doc, n, "spm", a, b - a, f"{s}{tail}{p}{head}{m}{middle}"
                else:
                    yield doc, n, "psm", a, b - a, f"{p}{head}{s}{tail}{m}{middle}"
        return run

    rows = pick(docs, id_column, text_column)
    rows = rows.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return map_rows(rows.select("doc_id", "text", *draws("doc_id", seed)), make, _ARROW, SCHEMA, weigh=lambda r: 96 + 2 * len(r[5]))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from.

    No part holds a marker and no two markers overlap, so the parts lie between the markers.
    """
    parts = F.split(output, "|".join(map(re.escape, MARKERS)), -1)
    head, tail = (F.when(form == "psm", F.get(parts, F.lit(a))).otherwise(F.get(parts, F.lit(b))) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(head, F.get(parts, F.lit(3)), tail))
