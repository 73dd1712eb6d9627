"""License scans: ordered signature rules behind a keyword prefilter, with overlaps resolved by priority and containment.

A text is lower-cased (A-Z), its words (runs of digits, letters and everything beyond ASCII) are joined by single
spaces, and the rules run on that, so that line breaks and punctuation do not matter. Rules are regular expressions: about two
hundred signatures of license texts, written one by one, and the names of license families in the forms and versions in
which they are given. One pass of an Aho-Corasick automaton finds
which keywords a text holds, and only the rules of those keywords run. Of overlapping detections, those of higher
priority, then longer ones, come first, and a detection inside one that is kept is dropped.

Three fixed phrases are reported wherever their words stand, whatever else is detected.

Defined cases: a null or empty text has no words, no labels, null positions and score 0; an empty table gives an empty
result; repeated rows are scanned one by one; columns besides doc_id and text are ignored; texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEXTS

#: Label and phrase that are always reported.
BASE = (("cc-by", b"cc by"), ("gpl", b"general public license"), ("reserved", b"all rights reserved"))

#: Label, names (regular expressions over words), keyword, versions.
FAMILIES = (
    ("gpl", r"gnu general public licen[cs]e|gnu gpl|gpl", "gpl|general public", "1.0 2.0 3.0"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[cs]e|gnu lgpl|lgpl", "lgpl|lesser general|library general", "2.0 2.1 3.0"),
    ("agpl", r"gnu affero general public licen[cs]e|gnu agpl|agpl", "agpl|affero", "1.0 3.0"),
    ("gfdl", r"gnu free documentation licen[cs]e|gfdl", "free documentation|gfdl", "1.1 1.2 1.3"),
    ("apache", r"apache(?: software)? licen[cs]e|apache", "apache", "1.0 1.1 2.0"),
    ("mit", r"mit licen[cs]e|expat licen[cs]e", "mit licen|expat", ""),
    ("x11", r"x11 licen[cs]e|x consortium licen[cs]e", "x11|x consortium", ""),
    ("isc", r"isc licen[cs]e", "isc licen", ""),
    ("bsd-2-clause", r"bsd 2 clause licen[cs]e|simplified bsd licen[cs]e|freebsd licen[cs]e|bsd 2 clause", "bsd", ""),
    ("bsd-3-clause", r"bsd 3 clause licen[cs]e|new bsd licen[cs]e|modified bsd licen[cs]e|bsd 3 clause", "bsd", ""),
    ("bsd-4-clause", r"bsd 4 clause licen[cs]e|original bsd licen[cs]e|bsd 4 clause", "bsd", ""),
    ("bsd", r"bsd(?: style)? licen[cs]e", "bsd", ""),
    ("mpl", r"mozilla public licen[cs]e|mpl", "mozilla|mpl", "1.0 1.1 2.0"),
    ("epl", r"eclipse public licen[cs]e|epl", "eclipse public|epl", "1.0 2.0"),
    ("cddl", r"common development and distribution licen[cs]e|cddl", "common development|cddl", "1.0 1.1"),
    ("cpl", r"common public licen[cs]e", "common public", "1.0"),
    ("ipl", r"ibm public licen[cs]e", "ibm public", "1.0"),
    ("eupl", r"european union public licen[cs]e|eupl", "european union public|eupl", "1.0 1.1 1.2"),
    ("cecill", r"cecill(?: free software licen[cs]e(?: agreement)?)?", "cecill", "1.0 1.1 2.0 2.1"),
    ("artistic", r"artistic licen[cs]e|perl artistic licen[cs]e", "artistic", "1.0 2.0"),
    ("afl", r"academic free licen[cs]e", "academic free", "1.1 1.2 2.0 2.1 3.0"),
    ("osl", r"open software licen[cs]e", "open software licen", "1.0 1.1 2.0 2.1 3.0"),
    ("ofl", r"sil open font licen[cs]e|open font licen[cs]e", "open font", "1.0 1.1"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e|odbl", "database licen|odbl", "1.0"),
    ("odc-by", r"open data commons attribution licen[cs]e|odc by", "data commons|odc by", "1.0"),
    ("pddl", r"public domain dedication and licen[cs]e|pddl", "domain dedication|pddl", "1.0"),
    ("cc0", r"creative commons zero|cc0|cc zero", "commons zero|cc0|cc zero", "1.0"),
    ("cc-by-nc-sa", r"(?:creative commons|cc)(?: by| attribution)? (?:nc|non ?commercial) (?:sa|share ?alike)", "cc by|cc attribution|cc nc|cc non|cc nd|cc no|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", r"(?:creative commons|cc)(?: by| attribution)? (?:nc|non ?commercial) (?:nd|no ?deriv(?:s|atives|ativeworks)?)", "cc by|cc attribution|cc nc|cc non|cc nd|cc no|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", r"(?:creative commons|cc)(?: by| attribution) (?:sa|share ?alike)", "cc by|cc attribution|cc nc|cc non|cc nd|cc no|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", r"(?:creative commons|cc)(?: by| attribution)? (?:nc|non ?commercial)", "cc by|cc attribution|cc nc|cc non|cc nd|cc no|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", r"(?:creative commons|cc)(?: by| attribution)? (?:nd|no ?deriv(?:s|atives|ativeworks)?)", "cc by|cc attribution|cc nc|cc non|cc nd|cc no|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", r"(?:creative commons|cc)(?: by| attribution)", "cc by|cc attribution|cc nc|cc non|cc nd|cc no|creative commons", "1.0 2.0 2.5 3.0 4.0"),
    ("zlib", r"zlib licen[cs]e|zlib libpng licen[cs]e", "zlib", ""),
    ("bsl", r"boost software licen[cs]e", "boost software", "1.0"),
    ("unlicense", r"the unlicen[cs]e|unlicen[cs]e", "unlicen", ""),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[cs]e", "wtfpl|what the fuck", "1.0 2.0"),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", "microsoft public|ms pl", ""),
    ("ms-rl", r"microsoft reciprocal licen[cs]e|ms rl", "microsoft reciprocal|ms rl", ""),
    ("psf", r"python software foundation licen[cs]e|psf licen[cs]e", "python software|psf licen", "2.0"),
    ("php", r"php licen[cs]e", "php licen", "3.0 3.01"),
    ("ruby", r"ruby licen[cs]e", "ruby licen", ""),
    ("openssl", r"openssl licen[cs]e", "openssl", ""),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", ""),
    ("zpl", r"zope public licen[cs]e|zpl", "zope|zpl", "1.1 2.0 2.1"),
    ("qpl", r"q public licen[cs]e", "q public", "1.0"),
    ("w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", "w3c", ""),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "ncsa", ""),
    ("upl", r"universal permissive licen[cs]e", "universal permissive", "1.0"),
    ("vim", r"vim licen[cs]e", "vim licen", ""),
    ("lppl", r"latex project public licen[cs]e|lppl", "latex project|lppl", "1.0 1.2 1.3"),
    ("sspl", r"server side public licen[cs]e|sspl", "server side public|sspl", "1.0"),
    ("busl", r"business source licen[cs]e", "business source", "1.1"),
    ("elastic", r"elastic licen[cs]e", "elastic licen", "2.0"),
)
#: Form of a notice around a name {n}, and its priority.
FORMS = (
    (r"spdx licen[cs]e identifier (?:{n})", 95),
    (r"(?:re)?licensed under(?: the)?(?: terms of)?(?: the)? (?:{n})", 80),
    (r"(?:released|distributed|published|available|provided|covered|governed)(?: under| by| as)(?: the)?(?: terms of)?(?: the)? (?:{n})", 75),
    (r"under(?: the)? terms of(?: the)? (?:{n})", 70),
    (r"(?:{n})", 50),
)

#: Identifiers of SPDX, fixed values: label and words. A tag may join several by and, or and with.
IDENTIFIERS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("isc", "isc"), ("0bsd", "0bsd"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"),
    ("apache-1.1", "apache 1 1"), ("apache-2.0", "apache 2 0"), ("gpl-1.0", "gpl 1 0"), ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.0", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"),
    ("agpl-1.0", "agpl 1 0"), ("agpl-3.0", "agpl 3 0"), ("gfdl-1.1", "gfdl 1 1"), ("gfdl-1.2", "gfdl 1 2"), ("gfdl-1.3", "gfdl 1 3"), ("mpl-1.0", "mpl 1 0"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"),
    ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("cddl-1.0", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("cpl-1.0", "cpl 1 0"), ("ipl-1.0", "ipl 1 0"), ("eupl-1.1", "eupl 1 1"), ("eupl-1.2", "eupl 1 2"), ("cecill-2.1", "cecill 2 1"),
    ("artistic-1.0", "artistic 1 0"), ("artistic-2.0", "artistic 2 0"), ("afl-3.0", "afl 3 0"), ("osl-3.0", "osl 3 0"), ("ofl-1.1", "ofl 1 1"), ("odbl-1.0", "odbl 1 0"), ("odc-by-1.0", "odc by 1 0"), ("pddl-1.0", "pddl 1 0"),
    ("cc0-1.0", "cc0 1 0"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-4.0", "cc by 4 0"), ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("zlib", "zlib"), ("bsl-1.0", "bsl 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("psf-2.0", "psf 2 0"), ("php-3.01", "php 3 01"), ("ruby", "ruby"), ("openssl", "openssl"), ("postgresql", "postgresql"),
    ("zpl-2.1", "zpl 2 1"), ("qpl-1.0", "qpl 1 0"), ("w3c", "w3c"), ("ncsa", "ncsa"), ("upl-1.0", "upl 1 0"), ("vim", "vim"), ("x11", "x11"), ("lppl-1.3c", "lppl 1 3c"), ("sspl-1.0", "sspl 1 0"), ("busl-1.1", "busl 1 1"), ("elastic-2.0", "elastic 2 0"),
)
#: Names that are too short to stand alone, but not after these words.
BARE = (("mit", "mit"), ("isc", "isc"), ("bsd", "bsd"), ("zlib", "zlib"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("mpl", "mpl"))
#: Words before a notice that turn it into its opposite.
DENIED = r"(?:not|never|neither|isn t|aren t|nor)(?: [a-z]+){0,2} (?:re)?(?:licen[cs]ed|released|distributed|published|available|provided|covered|governed)(?: under| by| as)(?: the)?(?: terms of)?(?: the| any)? "

@dataclass(frozen=True)
class Rule:
    label: str
    expression: re.Pattern
    keywords: tuple[str, ...]
    priority: int


@cache
def rules() -> tuple[Rule, ...]:
    """Every family in every form, without and with each version, then the texts; in order of priority."""
    made = []

    def add(label: str, expression: str, keywords: str, priority: int, engine=re) -> None:
        made.append(Rule(label, engine.compile(f"(?<= )(?:{expression})(?= )"), tuple(keywords.split("|")), priority))

    for label, words in IDENTIFIERS:  # each word of a tag's expression is a place of its own, so that one does not contain the other
        tail = "(?: only| or later)?"
        add(label, rf"(?<=spdx licen[cs]e identifier (?:[a-z0-9]+ ){{0,24}}?){words}{tail}(?<=identifier {words}{tail}|(?:and|or|with) {words}{tail})", "spdx licen", 96, regex)
    for label, name in BARE:
        add(label, rf"(?:re)?licen[cs]ed under(?: the)?(?: terms of)?(?: the)? {name}(?! (?:v|version|[0-9]))", f"under {name}|under the {name}|terms of {name}|of the {name}", 78)
    for _, names, keywords, _ in FAMILIES:  # no label: such a place only keeps others out
        add("", rf"{DENIED}(?:{names})(?:(?: version| v)? ?v?[0-9]+(?: [0-9]+)?)?(?: or(?: any)? later(?: version)?)?(?: licen[cs]e)?", keywords, 98)
    for label, name in BARE:
        add("", rf"{DENIED}{name}(?:(?: version| v)? ?v?[0-9]+(?: [0-9]+)?)?(?: licen[cs]e)?", f"under {name}|under the {name}|terms of {name}|of the {name}|any {name}", 98)

    for label, names, keywords, versions in FAMILIES:
        for form, priority in FORMS:
            short = {"gpl", "lgpl", "agpl", "mpl", "epl", "zpl", "apache"} & {label} and form == FORMS[-1][0]
            add(label, form.format(n="|".join(x for x in names.split("|") if not short or " " in x)), keywords, priority)
            for version in versions.split():
                major, minor = version.split(".")
                number = major + (f"(?: {minor})?" if minor == "0" else f" {minor}")
                add(f"{label}-{version}", form.format(n=f"(?:{names})(?:(?: version| v)? v?|v?){number}(?: or(?: \\(?at your option\\)?)?(?: any)? later(?: version)?| international| unported| only)?"), keywords, priority + 2)
    for text in TEXTS:
        add(*text)
    return tuple(sorted(made, key=lambda r: -r.priority))


@cache
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        for word in rule.keywords:
            found.setdefault(word, []).append(i)
    a = ahocorasick.Automaton()
    for word, which in found.items():
        a.add_word(word, tuple(which))
    a.make_automaton()
    return a


#: Bytes that belong to no word become spaces. Bytes from 0x80 are parts of letters beyond ASCII.
_SPACES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def detect(words: str) -> list[tuple[int, int, str, int]]:
    """Start, end (characters), label, priority of what is kept; words: joined by spaces, with one on either side."""
    which = {i for _, some in _automaton().iter(words) for i in some}
    hits: dict[int, list[tuple[int, int, str]]] = {}
    for i in which:
        rule = rules()[i]
        hits.setdefault(rule.priority, []).extend((m.start(), m.end(), rule.label) for m in rule.expression.finditer(words))
    kept: list[tuple[int, int, str, int]] = []
    starts: list[int] = []
    reach: list[int] = []  # the farthest end of what is kept and starts there or before
    for priority in sorted(hits, reverse=True):
        mine, most = [], -1
        for start, end, label in sorted(hits[priority], key=lambda h: (h[0], -h[1], h[2])):
            at = bisect_right(starts, start) - 1
            if end > most and (at < 0 or end > reach[at]):
                mine.append((start, end, label, priority))
            most = max(most, end)
        kept = sorted([*kept, *mine])
        starts = [k[0] for k in kept]
        reach = list(accumulate((k[1] for k in kept), max))
    return kept


def scan(text: str | bytes | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = data.lower().translate(_SPACES).split()
    joined = b" " + b" ".join(words) + b" "
    places: list[int] = []
    base = set()
    for label, phrase in BASE:
        at = joined.find(b" " + phrase + b" ")
        last, number = 0, 0
        while at >= 0:
            number += joined.count(b" ", last, at)
            last = at
            places.append(number)
            base.add(label)
            at = joined.find(b" " + phrase + b" ", at + 1)
    kept = detect(joined.decode("utf-8", "replace")) if words else []
    kept = [k for k in kept if k[2]]
    labels = base | {k[2] for k in kept}
    score = max((k[3] / 100 for k in kept), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max(score, 0.3 if base else 0.0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            found = list(zip(*(scan(x.as_py()) for x in b.column("text")), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(scanned, SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op8_license_scan": op8_license_scan}
ORACLE_SQL: dict[str, str] = {}
