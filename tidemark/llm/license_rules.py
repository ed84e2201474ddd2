"""Licence scans by sentence rules.

A text is cut into sentences (comment leaders go, a line end is a blank, an empty line ends a
sentence) and each is normalised: lower case, quotes and marks dropped, blanks folded.
Sentence patterns map a normalised sentence to the identifiers of the licences it names, in
order; one that lies inside another's words is part of it.  Patterns for the start of a sentence
also hold at the start of a line; an SPDX expression is taken whole, to its line's end at most.  Licence rules are ordered sequences of identifiers and name a licence when all of a
rule's sentences follow one another (at most ``MAX_GAP`` unknown sentences between two of
them).  Rules are tried from the longest, and an identifier found serves one match only.

The tables are this module's own: common notices and the defining sentences of common licences.

Defined cases: null and empty texts have no match; a long text is scanned whole; ties between
rules of one length go to the earlier rule; repeated rows are scanned each; an empty table
gives no row; null ids are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, pick

#: Unknown sentences that may stand between two sentences of a rule.
MAX_GAP = 3

#: Words up to the next licence's name.
_WITHIN = (r"(?:(?!\bgnu (?:general|lesser|library|affero) |\bapache licen|\bmozilla public|\beclipse public|"
           r"\b(?:mit|bsd|isc) licen|\bcreative commons\b).)")

#: Fixed values: (identifier, pattern over a normalised sentence; spdx: over a line in its own case).
SENTENCES = [
    ("spdx", r"(?i:\bspdx[- ]license[- ]identifier:? ?)"
             r"(?P<name>_( (OR|AND|WITH) _)+|_( (?i:or|and|with) _)+(?=[ .!?;:,/-]*$)|_)".replace("_", r"\({0,9}[A-Za-z0-9.+:-]+\){0,9}")),
    ("lgpl", r"\bgnu (lesser|library) general public licen[sc]e(,? (version|v) ?(?P<version>[\d.]+))?(_*\bversion (?P<stated>[\d.]+) of the licen[sc]e\b)?(?P<later>_*\bany later version\b)?".replace("_", _WITHIN)),
    ("agpl", r"\bgnu affero general public licen[sc]e(,? (version|v) ?(?P<version>[\d.]+))?(_*\bversion (?P<stated>[\d.]+) of the licen[sc]e\b)?(?P<later>_*\bany later version\b)?".replace("_", _WITHIN)),
    ("gpl", r"\bgnu general public licen[sc]e(,? (version|v) ?(?P<version>[\d.]+))?(_*\bversion (?P<stated>[\d.]+) of the licen[sc]e\b)?(?P<later>_*\bany later version\b)?".replace("_", _WITHIN)),
    ("gplshort", r"\b(?P<kind>[la]?)gpl[- ]?(?:v|version )?(?P<version>[123](?:\.\d)?)\b(?P<later>\+|,? or (?:any )?later\b|-or-later\b)?"),
    ("later", r"\bany later version\b"),
    ("apache", r"\bapache licen[sc]e(,? (version|v) ?(?P<version>[\d.]+))?"),
    ("mpl", r"\bmozilla public licen[sc]e(,? (version|v)[. ]?(?P<version>[\d.]+))?"),
    ("epl", r"\beclipse public licen[sc]e( ?-? ?(version|v)? ?(?P<version>[\d.]+))?"),
    ("boost", r"\bboost software licen[sc]e\b"),
    ("mit", r"\b(licensed|released|available|distributed|published) under (the )?(terms of the )?mit(/x11)?( licen[sc]e)?(?![\w/-])|^the mit licen[sc]e\b|^mit licen[sc]e$"),
    ("mitname", r"\bmit[- ]licensed\b|\bmit/x11( licen[sc]e)?\b"),
    ("bsd", r"\bunder (the )?(terms of the )?(?P<clauses>[234])?[- ]?(clause )?bsd[- ]?(style )?licen[sc]e\b"),
    ("bsdname", r"\bbsd[- ](?P<clauses>[234])[- ]clause\b( licen[sc]e\b)?"),
    ("isc", r"\bunder (the )?(terms of the )?isc licen[sc]e\b"),
    ("cc", r"\b(licensed|released|available|published|distributed) under (a |the )?(cc|creative commons)[- ](?P<kind>by(-nc)?(-sa|-nd)?|zero|0)[- ]?(?P<version>[\d.]+\d)?"),
    ("cc0", r"\bcc0(?:[- ](?P<version>[\d.]+\d))?( universal\b)?(?![\w-])"),
    ("ccname", r"\bcreative commons attribution(?P<nc>[- ]noncommercial)?(?P<sa>[- ]share ?alike)?(?P<nd>[- ]no ?deriv\w*)? ?(?P<version>[\d.]+\d)?"),
    ("unlicense", r"^this is free and unencumbered software released into the public domain\b"),
    ("wtfpl", r"\bdo what the fuck you want to public licen[sc]e\b"),
    ("public_domain", r"\b(released|placed|dedicated) (in|into|to) the public domain\b"),
    ("mit_grant", r"^permission is hereby granted,? free of charge,? to any person obtaining a copy\b"),
    ("mit_notice", r"^the above copyright notice and this permission notice shall be included\b"),
    ("as_is_mit", r"^the software is provided as is,? without warranty of any kind\b"),
    ("isc_grant", r"^permission to use,? copy,? modify,? and/?(or)? distribute this software for any purpose\b"),
    ("isc_as_is", r"^the software is provided as is and the author disclaims all warranties\b"),
    ("bsd_intro", r"^redistribution and use in source and binary forms\b"),
    ("bsd_source", r"^(\d\.? )?redistributions of source code must retain\b"),
    ("bsd_binary", r"^(\d\.? )?redistributions in binary form must reproduce\b"),
    ("bsd_ads", r"^(\d\.? )?all advertising materials mentioning features\b"),
    ("bsd_names", r"^(\d\.? )?neither the names? of\b(?:(?!\bneither the name).)*\bmay be used to endorse or promote products\b"),
    ("bsd_as_is", r"^this software is provided by the (?:(?!\bthis software is).)* as is and any express or implied warranties\b"),
    ("zlib_as_is", r"^this software is provided as-?is,? without any express or implied warranty\b"),
    ("zlib_grant", r"^permission is granted to anyone to use this software for any purpose\b"),
    ("zlib_origin", r"^(\d\.? )?the origin of this software must not be misrepresented\b"),
    ("rights", r"\ball rights reserved\b"),
]

#: Fixed values: (licence, sentence identifiers in order); ``{...}`` takes a named group of the sentence.
RULES = [
    ("MIT", ("mit_grant", "mit_notice", "as_is_mit")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("BSD-4-Clause", ("bsd_intro", "bsd_source", "bsd_binary", "bsd_ads", "bsd_names", "bsd_as_is")),
    ("BSD-3-Clause", ("bsd_intro", "bsd_source", "bsd_binary", "bsd_names", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_intro", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("Zlib", ("zlib_as_is", "zlib_grant", "zlib_origin")),
    ("GPL-{version}-or-later", ("gpl", "later")),
    ("LGPL-{version}-or-later", ("lgpl", "later")),
    ("AGPL-{version}-or-later", ("agpl", "later")),
    ("GPL-{version}{later}", ("gpl",)),
    ("LGPL-{version}{later}", ("lgpl",)),
    ("AGPL-{version}{later}", ("agpl",)),
    ("Apache-{version}", ("apache",)),
    ("MPL-{version}", ("mpl",)),
    ("EPL-{version}", ("epl",)),
    ("BSL-1.0", ("boost",)),
    ("{kind}GPL-{version}{later}", ("gplshort",)),
    ("MIT", ("mit",)),
    ("MIT", ("mitname",)),
    ("MIT", ("mit_grant",)),
    ("BSD-{clauses}-Clause", ("bsd",)),
    ("BSD-{clauses}-Clause", ("bsdname",)),
    ("ISC", ("isc",)),
    ("ISC", ("isc_grant",)),
    ("CC-{kind}-{version}", ("cc",)),
    ("CC0-{version}", ("cc0",)),
    ("CC-BY{nc}{sa}{nd}-{version}", ("ccname",)),
    ("Unlicense", ("unlicense",)),
    ("WTFPL", ("wtfpl",)),
    ("public-domain", ("public_domain",)),
    ("{name}", ("spdx",)),
    ("all-rights-reserved", ("rights",)),
]

#: Every sentence pattern needs one of these words (single ones: a line may end after any of them).
TRIGGERS = re.compile(r"licen[sc]e|public|permission|redistribution|provided|later|copyright|"
                      r"advertising|neither|misrepresented|creative|reserved|\bcc0?\b|gpl|\bmit\b|\bbsd\b")

#: A name after such words is one that does not hold.
_NEGATED = re.compile(r"\b(?:not|never|neither|nor|no longer|isnt|arent|wasnt|cannot)(?: (?:be|been|being|yet|currently|longer|covered|governed|licensed|"
                      r"released|available|distributed|published|subject|to|by|under|the|terms|of|an?|any))*+ ?\Z")
_SPDX = re.compile(SENTENCES[0][1])
#: Patterns that hold anywhere, and those for a line's start (with its end, where they ask for it).
_ANYWHERE = [(name, re.compile(p.split("|^")[0])) for name, p in SENTENCES[1:] if p[0] != "^"]
_AT_START = [(name, re.compile(re.sub(r"\$$", r"[ .!?;:,/-]*$", x)), x[-1] == "$")
             for name, p in SENTENCES[1:] for x in ("|" + p).split("|^")[1:]]
_ORDERED = sorted(RULES, key=lambda r: -len(r[1]))
#: Runs are taken whole (no two of them can share a character), so a long line of blanks costs no more than its length.
_BREAK = re.compile(r"[.!?][\"')\]]*+(?=\s|$)|\n[^\S\n]*+[/#*;%>-]*+[^\S\n]*+(?=\n)|:[^\S\n]*+\n")
_LEADER = re.compile(r"\n[^\S\n]*(?://+|#+|\*+/?|;+|%+|--|>+|/\*+)?")
_DROP = re.compile(r"[\"'“”‘’`()\[\]*]")
_DROP_IN_SPDX = re.compile(r"[\"'“”‘’`\[\]*]")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^ .!?;:,/-]|$")

_ARROW = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_known", pa.int64()),
                    ("matches", pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()),
                                                    ("end", pa.int64()), ("sentences", pa.string())])))])
_SQL = ("doc_id long, n_sentences long, n_known long, "
        "matches array<struct<license: string, start: long, end: long, sentences: string>>")


def sentences_of(text: str):
    """(start, end) of every sentence, in code points, without blanks around it."""
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.end() if m else len(text)
        body = text[at:end]
        lead = len(body) - len(body.lstrip())
        if body.strip():
            yield at + lead, at + len(body.rstrip())
        at = end


def _fold(line: str, drop: re.Pattern) -> str:
    return _SPACE.sub(" ", drop.sub("", _LEADER.sub(" ", "\n" + line))).strip()


def identify(sentence: str) -> list[tuple[str, dict[str, str]]]:
    """(identifier, named groups) of all that a sentence names, in order."""
    found, parts, lines, at = [], [], [], 0          # found: (start, -end, number, identifier, groups)
    for line in sentence.split("\n"):
        low = _fold(line.lower(), _DROP)
        if not low:
            continue
        parts.append(low)
        lines.append((at + _WORD.search(low).start(), at + len(low)))
        if "spdx" in low:
            for m in _SPDX.finditer(_fold(line, _DROP_IN_SPDX)):
                start = at + max(low.find("spdx"), 0) + m.start()
                found.append((start, -min(start + len(m[0]), at + len(low)), len(found), "spdx", {"name": _expression(m["name"])}))
        at += len(low) + 1
    text = " ".join(parts)
    if not TRIGGERS.search(text):
        return []
    if not found and "spdx" in text:                 # wrapped: the first name only, as no line end closes an expression
        found = [(m.start(), -m.end(), k, "spdx", {"name": _expression(m["name"].split(" ")[0])}) for k, m in enumerate(_SPDX.finditer(text))]
    hits = [(name, m) for name, p in _ANYWHERE for m in p.finditer(text)]
    for name, p, whole_line in _AT_START:
        hits += [(name, m) for start, end in lines if (m := p.match(text, start, end if whole_line else len(text)))]
    for name, m in hits:
        if _NEGATED.search(text, max(0, m.start() - 80), m.start()):
            continue
        found.append((m.start(), -m.end(), len(found), name, {k: v.rstrip(".") if v else "" for k, v in m.groupdict().items()}))
    out, reach = [], -1
    for _, end, _, name, groups in sorted(found, key=lambda x: x[:3]):
        if -end > reach:
            out.append((name, groups))
            reach = -end
    return out


def _expression(name: str) -> str:
    """An SPDX expression in lower case, without brackets that don't pair or that hold all of it."""
    name = name.lower().rstrip(".:")
    while True:
        depth, low, closed = 0, 0, []
        for k, c in enumerate(name):
            depth += (c == "(") - (c == ")")
            low = min(low, depth)
            if c == ")" and depth == 0:
                closed.append(k)
        if depth or low < 0:
            return name.replace("(", "").replace(")", "")
        if name[:1] != "(" or closed[0] != len(name) - 1:
            return name
        name = name[1:-1]


def _title(rule: str, groups: dict[str, str]) -> str:
    """The licence's name with the sentence's groups put in; empty groups leave no dash."""
    marks = {"later": "-or-later", "nc": "-NC", "sa": "-SA", "nd": "-ND"}
    if groups.get("stated"):
        groups = {**groups, "version": groups.get("version") or groups["stated"]}
    known = {k: marks.get(k, v.upper() if k == "kind" else v) if v else "" for k, v in groups.items()}
    return re.sub(r"-(?=-|$)", "", rule.format(**known))


def scan(text: str | None):
    """(sentences, known sentences, [(licence, start, end, identifiers)]) of one text."""
    if not text:
        return 0, 0, []
    spans = list(sentences_of(text))
    if not TRIGGERS.search(_DROP.sub("", text.lower())):
        return len(spans), 0, []
    known = [(k, a, b, *found) for k, (a, b) in enumerate(spans) for found in identify(text[a:b])]
    places: dict[str, list[int]] = {}
    for i, item in enumerate(known):
        places.setdefault(item[3], []).append(i)
    used, out = [], []                               # used: sorted places in known
    for title, wanted in _ORDERED:
        for first in places.get(wanted[0], ()):
            at = bisect_left(used, first)
            if used[at:at + 1] == [first]:
                continue
            got = [first]
            for name in wanted[1:]:
                own, at = places.get(name, ()), bisect_left(used, got[-1])
                k = bisect_right(own, got[-1])
                if k == len(own):
                    break
                i = own[k]
                if known[i][0] - known[got[-1]][0] > MAX_GAP + 1 or used[at:at + 1] and used[at] <= i:
                    break
                got.append(i)
            if len(got) == len(wanted):
                groups: dict[str, str] = {}
                for i in got:
                    insort(used, i)
                    groups = {**known[i][4], **groups}
                out.append((got[0], (_title(title, groups), known[got[0]][1], known[got[-1]][2], " ".join(wanted))))
    return len(spans), len({k for k, *_ in known}), [m for _, m in sorted(out)]


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its sentences, known licence sentences and matched licences."""
    def make():
        def run(cols):
            for doc, text in zip(*cols):
                n, known, found = scan(text)
                yield doc, n, known, [dict(zip(("license", "start", "end", "sentences"), m)) for m in found]
        return run

    rows = pick(docs, id_column, text_column).select(F.col(id_column).cast("long").alias("doc_id"), text_column)
    return map_rows(rows, make, _ARROW, _SQL, weigh=lambda r: 64 + 80 * len(r[3]))
