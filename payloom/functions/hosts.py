"""International host names in ASCII, as UTS 46 has them without transitional processing: ß, ς and the two joiners stay themselves.

Labels are mapped (compatibility forms, case folded, what is invisible left out), checked, and those beyond ASCII are encoded in
Punycode. The Column does the same in the JVM: its mapping is that of java.net.IDN, from which the four characters it reads otherwise are
kept, and Punycode is a fold over the label's characters. What neither checks is the order of scripts written from the right.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

KEPT = "ßς‌‍"
#: What stands for them while java.net.IDN maps the rest: strokes that its Unicode does not know, and which are part of no name.
_INSTEAD = "\u31c0\u31c1\u31c2\u31c3"
#: Full stops of other scripts.
_STOPS = "[.。．｡]"
_IGNORED = "­͏​⁠⁤﻿︀-️"
_VIRAMAS = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)) == 9)
#: What a label may not hold: a mark at its beginning, what is no letter, digit or sign, and a joiner without a virama before it.
_WRONG = rf"^\p{{M}}|(?![‌‍])[\p{{C}}\p{{Z}}]|(?<![{_VIRAMAS}])[‌‍]"

# Fixed values of Punycode (RFC 3492).
_BASE, _LEAST, _MOST, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def to_ascii(host: str) -> str | None:
    """None for what is no host name."""
    try:
        labels = re.split(_STOPS, host)
        if not host.isascii() and (not all(labels) or set(host) & set(_INSTEAD)):
            return None
        return ".".join(map(_label, labels))
    except ValueError:
        return None


def _label(label: str) -> str:
    if label.isascii():
        return label.lower()
    fold = lambda c: c if c in KEPT else unicodedata.normalize("NFKC", c).casefold()
    label = re.sub(f"[{_IGNORED}]", "", label).replace("ẞ", "ß")
    label = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", "".join(map(fold, label))) if not set(label) & set(KEPT) else "".join(map(fold, label)))
    if label.isascii():
        return label
    wrong = unicodedata.category(label[0])[0] == "M" or any(c not in "‌‍" and unicodedata.category(c)[0] in "CZ" for c in label)
    wrong |= any(c in "‌‍" and (i == 0 or unicodedata.combining(label[i - 1]) != 9) for i, c in enumerate(label))
    if wrong or len(found := "xn--" + label.encode("punycode").decode()) > 63:
        raise ValueError(label)
    return found


def _mapped(host: Column) -> Column:
    """The mapped host in one piece; java.net.IDN is asked outside of lambdas, since Spark takes what is reflected for not deterministic."""
    plain = F.translate(F.replace(F.regexp_replace(F.regexp_replace(host, f"[{_IGNORED}]", ""), _STOPS, "."), F.lit("ẞ"), F.lit("ß")), KEPT, _INSTEAD)
    idn = lambda way, c: F.try_reflect(F.lit("java.net.IDN"), F.lit(way), c, F.lit(1))
    return F.translate(idn("toUnicode", idn("toASCII", plain)), _INSTEAD, KEPT)


def _digits(delta: Column, bias: Column) -> Column:
    """A number in digits whose weights follow the bias."""
    zero = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("over"))

    def step(acc: Column, k: Column) -> Column:
        t = F.greatest(F.lit(_LEAST), F.least(F.lit(_MOST), k * _BASE - bias)).cast("long")
        digit = lambda n: F.substring(F.lit(_DIGITS), n.cast("int") + 1, F.lit(1))
        last = F.struct(acc["q"].alias("q"), F.concat(acc["out"], digit(acc["q"])).alias("out"), F.lit(True).alias("over"))
        more = F.struct(F.floor((acc["q"] - t) / (_BASE - t)).cast("long").alias("q"), F.concat(acc["out"], digit(t + (acc["q"] - t) % (_BASE - t))).alias("out"), F.lit(False).alias("over"))
        return F.when(acc["over"], acc).when(acc["q"] < t, last).otherwise(more)

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), zero, step)["out"]


def _adapted(delta: Column, n: Column, first: Column) -> Column:
    start = F.floor(delta / F.when(first, _DAMP).otherwise(2))
    start = start + F.floor(start / n)
    zero = F.struct(start.cast("long").alias("d"), F.lit(0).cast("long").alias("k"))
    most = (_BASE - _LEAST) * _MOST // 2
    lower = lambda acc, _: F.when(acc["d"] > most, F.struct(F.floor(acc["d"] / (_BASE - _LEAST)).cast("long").alias("d"), (acc["k"] + _BASE).alias("k"))).otherwise(acc)
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(6)), zero, lower), lambda a: (a["k"] + F.floor((_BASE - _LEAST + 1) * a["d"] / (a["d"] + _SKEW))).cast("long"))


def punycode(label: Column) -> Column:
    """The Punycode of text with characters beyond ASCII: each of them, by code point and place, as a step from the one before."""
    chars = F.regexp_extract_all(label, F.lit(r"(?s)."), F.lit(0))
    code = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")

    def encoded(codes: Column) -> Column:
        basic = F.filter(codes, lambda c: c < _FIRST)
        others = F.array_sort(F.filter(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda s: s["c"] >= _FIRST))
        begin = F.concat(F.array_join(F.transform(basic, lambda c: F.chr(c)), ""), F.when(F.size(basic) > 0, "-").otherwise(""))
        zero = F.struct(begin.alias("out"), F.lit(_FIRST).cast("long").alias("n"), F.lit(0).cast("long").alias("at"), F.lit(_BIAS).cast("long").alias("bias"), F.size(basic).cast("long").alias("h"), F.lit(True).alias("first"))

        def step(acc: Column, s: Column) -> Column:
            place = F.size(F.filter(F.slice(codes, F.lit(1), s["i"]), lambda c: c <= s["c"])).cast("long")  # where it goes among those that are there
            delta = (s["c"] - acc["n"]) * (acc["h"] + 1) + place - acc["at"]
            return let(
                delta,
                lambda d: F.struct(
                    F.concat(acc["out"], _digits(d, acc["bias"])).alias("out"), s["c"].alias("n"), (place + 1).alias("at"), _adapted(d, acc["h"] + 1, acc["first"]).alias("bias"), (acc["h"] + 1).alias("h"), F.lit(False).alias("first")
                ),
            )

        return F.aggregate(others, zero, step)["out"]

    return let(F.transform(chars, code), encoded)


def to_ascii_col(host: Column) -> Column:
    """NULL for what is no host name."""

    def one(label: Column) -> Column:
        ascii_ = F.lower(label)
        coded = let(F.concat(F.lit("xn--"), punycode(label)), lambda p: F.when(F.length(p) <= 63, p))
        return F.when(label.rlike("^[\\x00-\\x7F]*\\z"), ascii_).when(~label.rlike(_WRONG) & (label != ""), coded)

    whole = F.when(host.rlike("^[\\x00-\\x7F]*\\z"), host).otherwise(_mapped(host))
    return let(F.transform(F.split(whole, r"\.", -1), one), lambda a: F.when(~F.exists(a, lambda x: x.isNull()), F.array_join(a, ".")))
