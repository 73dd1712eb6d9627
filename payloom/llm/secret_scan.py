"""Secret scans: fixed patterns, then novelty against dictionaries as zstandard measures it.

Fixed patterns find assignments to sensitive names, access keys and long hexadecimal runs. Besides, every run of
CANDIDATE characters that follows a sensitive word closely is a candidate: it is compressed behind the code around it,
with a dictionary of identifiers and code loaded into the compressor, and its marginal cost is what it adds to the
compressed context. A candidate made of known words costs little; one whose cost nears its own length is reported as
"novel". In a longer run that is not novel as a whole, parts of WINDOW characters are measured one by one, each behind what
is before it, and those that are novel are reported, together where they meet: a key at the end of a long path is found.

Defined cases: a null text counts as empty and has no spans; an empty table gives an empty result; repeated rows are
scanned one by one; columns besides doc_id and text are ignored; texts are scanned whole, whatever their length; spans
count code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs of these two that are too short are never matches, so the length is part of the expression.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST = 6
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_-]?key|credential|private[_-]?key|auth|bearer|signature", re.ASCII | re.IGNORECASE)
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Characters after a sensitive word in which a candidate may start, and of context on either side of it.
REACH, AROUND = 48, 160
#: Marginal compressed bytes for each byte of a candidate from which it is novel. Random base64 takes about 0.75 and more.
NOVEL = 0.7
#: Longest candidate that is measured at once; longer ones are measured by their parts of this length.
PART = 512

#: Length of the parts of a longer run, and steps from one to the next: a key of WINDOW + STEP characters holds a whole part.
WINDOW, STEP = 32, 8

#: What code is made of: the compressor knows it before it sees a text.
DICTIONARY = " ".join(
    """
    password passwd passphrase secret token api_key apikey access_key private_key public_key client_secret client_id username user_name
    credential credentials authorization authentication bearer signature session cookie certificate encrypt decrypt hash digest
    abstract argument array assert async await boolean buffer bytes callback class config configuration connection connect constant
    container context controller count create database default delete description directory document element enable environment error
    example exception execute export factory false field file filter final float format function generate global handler header host
    hostname identifier implement import include index initialize input instance integer interface invalid iterator length library
    listener local location logger manager mapping message method middleware model module namespace number object operation optional
    option output override package parameter parent parse path pattern permission pipeline placeholder pointer port position prefix
    private process production property protected protocol provider proxy public query queue random read receive record reference
    register remote repository request require resource response result return route runtime sample schedule schema scope script
    select sequence server service setting setup source static status storage stream string struct suffix switch system table target
    template temporary test thread timeout timestamp transaction transform true type undefined update upload url user validate value
    variable vector version void volume warning widget window worker write xxxxxxxxxxxxxxxx your_secret_here changeme example_token
    https://www.example.com/index.html http://localhost:8080/api/v1/ const var let def self this new null None True False
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
    """.split()
).encode()


@cache
def _compressor() -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str = "") -> float:
    """Bytes that the candidate adds to its compressed surroundings, for each of its own bytes; the mean over its parts."""
    size = lambda s: len(_compressor().compress(s.encode("utf-8", "replace")))
    around = after + "\n" + before
    least = size(around)
    costs = [(size(around + candidate[i : i + PART]) - least, len(candidate[i : i + PART])) for i in range(0, len(candidate), PART)]
    return sum(c for c, _ in costs) / max(1, sum(n for _, n in costs))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    found = []
    if any(word in low for word in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def novel_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates within REACH of a sensitive word whose characters are of two kinds at least and that are novel."""
    found, done = [], 0
    for word in SENSITIVE.finditer(text):
        at = max(done, word.end())  # what is before was measured
        while m := CANDIDATE.search(text, at, word.end() + REACH + SHORTEST):
            start = m.start()
            at = done = end = CANDIDATE.match(text, start).end()  # whole, even beyond REACH
            if _is_novel(text, start, end):
                found.append(("novel", start, end))
            elif end - start > 2 * WINDOW:
                found += novel_parts(text, start, end)
    return found


def _is_novel(text: str, start: int, end: int) -> bool:
    s = text[start:end]
    return sum(bool(re.search(kind, s)) for kind in ("[a-z]", "[A-Z]", "[0-9]")) >= 2 and novelty(s, text[max(0, start - AROUND) : start], text[end : end + AROUND]) >= NOVEL


def novel_parts(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The novel parts of a run, put together where they meet. Of a part all three kinds of characters are asked for, since words are everywhere."""
    found: list[tuple[str, int, int]] = []
    for at in [*range(start, end - WINDOW, STEP), end - WINDOW]:
        s = text[at : at + WINDOW]
        if all(re.search(kind, s) for kind in ("[a-z]", "[A-Z]", "[0-9]")) and novelty(s, text[max(0, at - AROUND) : at]) >= NOVEL:
            if found and at <= found[-1][2]:
                found[-1] = "novel", found[-1][1], at + WINDOW
            else:
                found.append(("novel", at, at + WINDOW))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan(text: str | None) -> tuple:
    """n_assign, n_access, n_hex, base_sha256, spans."""
    base = base_spans(text or "")
    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel_spans(text or ""))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        for b in batches:
            found = list(zip(*(scan(x.as_py()) for x in b.column("text")), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scanned, SCHEMA)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE_SQL: dict[str, str] = {}
