"""Timestamps of mixed notation, precision and zone as one instant in UTC (problem 5).

Every value becomes a mask of the same length: digits, letters and blanks each stand for their class, other marks for themselves.
Values with one mask hold their fields at the same places, so a mask is parsed once (words are told apart by a second mask, of
word classes) and its values are cut, converted and moved to UTC column by column through the zones' transition tables.

Defined results: null, blank, impossible and relative values and dates without a time of day give no row; a value without zone or
offset and without a known zone of its record gives none; values of any length are read; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.functions.buffers import code_points, string_column
from veldra.functions.zones import transitions, wall_to_utc

AT_ONCE = 4_000_000  # characters of values of one length that are looked at together
KEPT = 256  # characters of a mask whose layout is remembered

#: Names of months in English, French, German and Spanish, as prefixes without accents, of at least three letters.
MONTHS = (
    ("january", "janvier", "januar", "janner", "enero"),
    ("february", "fevrier", "februar", "febrero"),
    ("march", "mars", "marz", "maerz", "marzo", "mrz"),
    ("april", "avril", "abril", "avr"),
    ("may", "mai", "mayo"),
    ("june", "juin", "juni", "junio"),
    ("july", "juillet", "juli", "julio", "juil"),
    ("august", "aout", "agosto"),
    ("september", "septembre", "septiembre", "sept", "setiembre"),
    ("october", "octobre", "oktober", "octubre"),
    ("november", "novembre", "noviembre"),
    ("december", "decembre", "dezember", "diciembre"),
)
#: Names of weekdays in the same languages.
WEEKDAYS = "monday tuesday tues wednesday thursday thurs thur friday saturday sunday lundi mardi mercredi jeudi vendredi samedi dimanche montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag lunes martes miercoles jueves viernes sabado domingo mo di mi do fr sa so".split()
#: Hours from UTC of zone abbreviations.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "ut": 0, "z": 0, "zulu": 0, "wet": 0, "west": 1, "bst": 1, "ist": 1, "cet": 1, "cest": 2, "mez": 1, "mesz": 2, "met": 1, "mest": 2, "eet": 2, "eest": 3, "msk": 3, "msd": 4,
    "nst": -3.5, "ndt": -2.5, "ast": -4, "adt": -3, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10, "hdt": -9, "hast": -10, "hadt": -9, "jst": 9,
}
LINKS = {"at", "a", "de", "del", "um", "las", "den", "der", "le", "el", "the", "on", "of", "uhr", "h", "hrs", "hours", "st", "nd", "rd", "th", "er", "to", "t"}
_PLAIN = str.maketrans("áàâäãéèêëíìîïóòôöúùûüçñ", "aaaaaeeeeiiiioooouuuucn")


@lru_cache(65_536)
def word_kind(word: str) -> tuple[str, float]:
    """Class letter of a word and its value: M month, W weekday, P morning or afternoon, Z zone, R region, T, h, c link, X unknown."""
    plain = word.lower().translate(_PLAIN)
    if "/" in word:
        return ("R", 0) if transitions(word) is not None else ("X", 0)
    if plain in ("am", "pm"):
        return "P", plain == "pm"
    if plain == "t":
        return "T", 0
    if plain == "h":
        return "h", 0
    for number, names in enumerate(MONTHS, 1):
        if len(plain) >= 3 and any(n.startswith(plain) for n in names) or plain in names:
            same = [k for k, other in enumerate(MONTHS, 1) if any(n.startswith(plain) for n in other)]
            if len(same) == 1 or plain in names:
                return "M", number
    if plain in ABBREVIATIONS:
        return "Z", ABBREVIATIONS[plain] * 3600
    if len(plain) >= 2 and any(w.startswith(plain) for w in WEEKDAYS):
        return "W", 0
    return ("c", 0) if plain in LINKS else ("X", 0)


_TIME = r"(?P<H>99?)(?: ?[:h.] ?(?P<M>99)(?: ?: ?(?P<S>99)(?:[.,](?P<f>9+))?)?|(?P<hh> ?h)|(?=T| *P))?(?: *c+)?(?: *(?P<p>P+)\.?)?(?: *c+)?"
_ZONE = r"(?: *,? *(?:\(?(?P<z>Z+)\)?)?(?: *(?P<sign>[+\-−])(?P<oh>99?)(?: ?:?(?P<om>99))?)?(?: *\(?Z+\)?)?)?(?: *(?:\[(?P<r>[RZ]+)\]|(?P<r2>R+)))?"
_DAY = r"(?:W+\.?,? *)?(?:c+ *)?"
_JOIN = r"(?: *T *|,? +(?:c+ +)*|, *)"
#: Layouts over class masks; a = first number of a numeric date with the year last, b = the second.
LAYOUTS = [
    re.compile(x)
    for x in (
        rf" *{_DAY}(?P<Y>9999)(?P<s>[-/.])(?P<m>99?)(?P=s)(?P<d>99?)(?: *T *|,? +(?:c+ +)*)(?:{_TIME}){_ZONE} *",
        rf" *(?P<Y>9999)(?P<m>99)(?P<d>99)(?: *T *| +)(?P<H>99)(?::?(?P<M>99)(?::?(?P<S>99)(?:[.,](?P<f>9+))?)?)?{_ZONE} *",
        rf" *(?P<Y>9999)[-/](?P<m>99)[-/](?P<d>99)T(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_ZONE} *",
        rf" *{_DAY}(?P<d>99?)(?:\.|c+)?[ -]*(?:c+ +)?(?P<mon>M+)\.?,?[ -]*(?:c+ +)?(?P<Y>9999|99){_JOIN}{_TIME}{_ZONE} *",
        rf" *{_DAY}(?P<mon>M+)\.? *(?P<d>99?)(?:c+)?(?:,| |, ) *(?P<Y>9999){_JOIN}{_TIME}{_ZONE} *",
        rf" *{_DAY}(?P<a>99?)(?P<s>[-/.])(?P<b>99?)(?P=s)(?P<Y>9999|99){_JOIN}{_TIME}{_ZONE} *",
        rf" *{_DAY}(?P<mon>M+)\.? +(?P<d>99?) +{_TIME}(?: *(?P<z0>Z+))? +(?P<Y>9999) *",
        r" *(?P<epoch>9{10}|9{13})(?:\.(?P<f>9+))? *",
    )
]


@lru_cache(65_536)
def layout(mask: str) -> tuple[tuple[str, int, int], ...] | None:
    """Fields of a class mask with their places; None if the mask fixes no instant."""
    for pattern in LAYOUTS:
        if found := pattern.fullmatch(mask):
            fields = {k: found.span(k) for k, v in found.groupdict().items() if v is not None and k != "s"}
            if "H" in fields and "M" not in fields and "p" not in fields and "hh" not in fields and not ("m" in fields or "T" in mask):
                return None
            return tuple((k, *v) for k, v in fields.items())
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    return (((y - 1970).astype("datetime64[Y]").astype("datetime64[M]")) + (m - 1)).astype("datetime64[D]").astype(np.int64) + d - 1


def _number(chars: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(len(chars), np.int64)
    for i in range(a, b):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def to_utc(values, zones: np.ndarray, month_first: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Microseconds since 1970 of a string column, or the least int64 where a value fixes no instant.

    ``zones``: zone of each value's record (object array, None if unknown). ``group``: values of one group stand in sequence,
    and a wall clock without zone that a group repeats is the later one where it occurs twice.
    """
    none = np.iinfo(np.int64).min
    text = string_column(values)
    chars, at, _, _ = code_points(text)
    out = np.full(len(text), none, np.int64)
    if not len(chars):
        return out
    kind = np.minimum(chars, 127).astype(np.uint8)
    digit = (chars >= 48) & (chars <= 57)
    high = chars >= 128
    letter = ((chars | 32) >= 97) & ((chars | 32) <= 122) & (chars < 128)
    odd_blank = np.isin(chars, [9, 10, 11, 12, 13, 160, 0x202F, 0x2009, 0x3000])
    kind[digit], kind[letter | (high & ~odd_blank)], kind[odd_blank] = ord("9"), ord("A"), ord(" ")
    kind[chars == 0x2212] = ord("-")
    # repeated and outer blanks don't count
    once = np.ones(len(kind), bool)
    once[1:] = (kind[1:] != 32) | (kind[:-1] != 32)
    chars, kind, at = chars[once], kind[once], np.append(0, np.cumsum(once))[at]
    solid = np.flatnonzero(kind != 32)
    i, j = np.searchsorted(solid, at[:-1]), np.searchsorted(solid, at[1:])
    has = j > i
    first, last = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    first[has], last[has] = solid[i[has]], solid[j[has] - 1] + 1
    keep = np.flatnonzero(has)
    if not len(keep):
        return out
    lengths = last[keep] - first[keep]
    wall = np.full(len(text), none, np.int64)
    wall_zone = np.full(len(text), None, object)
    fraction = np.zeros(len(text), np.int64)
    for n in np.unique(lengths).tolist():
        every = keep[lengths == n]
        for x in range(0, len(every), max(1, AT_ONCE // n)):
            rows = every[x : x + max(1, AT_ONCE // n)]
            places = first[rows][:, None] + np.arange(n)
            shapes, which = np.unique(np.ascontiguousarray(kind[places]).view(f"S{n}").ravel(), return_inverse=True)
            order = np.argsort(which, kind="stable")
            cuts = np.append(0, np.cumsum(np.bincount(which, minlength=len(shapes))))
            for k, shape in enumerate(shapes.tolist()):
                own = rows[order[cuts[k] : cuts[k + 1]]]
                _convert(shape.decode("latin-1").ljust(n), own, chars[places[order[cuts[k] : cuts[k + 1]]]], zones, month_first, out, wall, wall_zone, fraction)
    open_ = np.flatnonzero(wall != none)
    if len(open_):
        later = np.zeros(len(open_), bool)
        if group is not None:
            order = np.lexsort((open_, wall[open_], group[open_]))
            g, w = group[open_][order], wall[open_][order]
            later[order[1:]] = (g[1:] == g[:-1]) & (w[1:] == w[:-1])
        names = wall_zone[open_]
        for name in {x for x in names if x is not None}:
            mine = np.flatnonzero(names == name)
            moved = wall_to_utc(name, wall[open_[mine]], later[mine])
            if moved is not None:
                out[open_[mine]] = moved[0] * 1_000_000 + fraction[open_[mine]]
    return out


def _convert(mask: str, rows: np.ndarray, chars: np.ndarray, zones, month_first, out, wall, wall_zone, fraction) -> None:
    """Values of one mask: instants go to ``out``, wall clocks in a named zone to ``wall``."""
    words = [m.span() for m in re.finditer(r"A(?:[A/_]*A)?", mask)]
    parts = [np.zeros(len(rows), np.int64)]
    vocab: list[list[str]] = []
    for a, b in words:
        text = np.ascontiguousarray(chars[:, a:b]).view(f"U{b - a}").ravel()
        some, which = np.unique(text, return_inverse=True)
        vocab.append(some.tolist())
        parts.append(which)
    combos, which = np.unique(np.stack(parts[1:], 1), axis=0, return_inverse=True) if words else (np.zeros((1, 0), int), parts[0])
    for c, combo in enumerate(combos.tolist()):
        full = list(mask)
        value: dict[int, object] = {}
        for (a, b), names, w in zip(words, vocab, combo):
            letter, number = word_kind(names[w])
            full[a:b] = letter * (b - a)
            value[a] = (number, names[w])
        fields = (layout if len(full) <= KEPT else layout.__wrapped__)("".join(full))
        if fields is None:
            continue
        mine = np.flatnonzero(which.ravel() == c)
        _place({k: (a, b) for k, a, b in fields}, value, rows[mine], chars[mine], zones, month_first, out, wall, wall_zone, fraction)


def _place(f: dict, value: dict, rows, chars, zones, month_first, out, wall, wall_zone, fraction) -> None:
    n = len(rows)
    get = lambda k, default=0: _number(chars, *f[k]) if k in f else np.full(n, default, np.int64)
    micros = np.zeros(n, np.int64)
    if "f" in f:
        a, b = f["f"]
        micros = _number(chars, a, min(b, a + 6)) * 10 ** max(0, 6 - (b - a))
    if "epoch" in f:
        a, b = f["epoch"]
        out[rows] = get("epoch") * (1_000_000 if b - a == 10 else 1000) + (micros if b - a == 10 else 0)
        return
    year = get("Y")
    if f["Y"][1] - f["Y"][0] == 2:
        year = year + 2000
    if "a" in f:
        us = month_first[rows]
        x, y = get("a"), get("b")
        month, day = np.where(us, x, y), np.where(us, y, x)
    else:
        month = np.full(n, int(value[f["mon"][0]][0])) if "mon" in f else get("m")
        day = get("d")
    hour, minute, second = get("H"), get("M"), get("S")
    good = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31) & (minute <= 59) & (second <= 59)
    if "p" in f:
        good &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + (12 if value[f["p"][0]][0] else 0)
    good &= hour <= 23
    safe = np.where(good, month, 1)
    days = _days(np.where(good, year, 1970), safe, np.ones(n, np.int64))
    following = _days(np.where(good, year, 1970) + safe // 12, safe % 12 + 1, np.ones(n, np.int64))
    good &= day <= following - days
    seconds = (days + day - 1) * 86_400 + hour * 3600 + minute * 60 + second
    rows, seconds, micros, good_rows = rows[good], seconds[good], micros[good], good
    region = f.get("r") or f.get("r2")
    if "sign" in f:
        a = f["sign"][0]
        # after an abbreviation the sign counts from that zone
        base = int(value[f["z"][0]][0]) if "z" in f else 0
        offset = (get("oh") * 3600 + get("om") * 60)[good_rows]
        fine = (get("oh")[good_rows] <= 18) & (get("om")[good_rows] <= 59)
        offset = np.where(chars[good_rows][:, a] == 43, offset, -offset) + base
        out[rows[fine]] = ((seconds - offset) * 1_000_000 + micros)[fine]
    elif "z" in f or "z0" in f:
        out[rows] = (seconds - int(value[f.get("z", f.get("z0"))[0]][0])) * 1_000_000 + micros
    elif region and value[region[0]][1].lower() in ABBREVIATIONS:
        out[rows] = (seconds - int(value[region[0]][0])) * 1_000_000 + micros
    else:
        wall[rows], fraction[rows] = seconds, micros
        wall_zone[rows] = value[region[0]][1] if region else zones[rows]


def normalize(df: DataFrame, kind: str, id_col: str, values_col: str, zone_col: str, month_first_col: str) -> DataFrame:
    """``(record_kind, record_id, pos, utc_micros)`` of ``values_col`` (an array of strings, read in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).min
        for batch in batches:
            lists = batch.column(1)
            lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            parent = np.repeat(np.arange(len(lists)), lengths)
            pos = np.arange(len(parent)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            zones = np.array(batch.column(2).to_pylist(), object)
            us = batch.column(3).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            micros = to_utc(lists.flatten(), zones[parent], us[parent], parent)
            has = np.flatnonzero(micros != none)
            ids = batch.column(0).take(pa.array(parent[has]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos[has], pa.int32()), pa.array(micros[has])], ["record_id", "pos", "utc_micros"])

    rows = df.select(id_col, values_col, zone_col, month_first_col).filter(F.col(values_col).isNotNull())
    out = rows.mapInArrow(run, "record_id bigint, pos int, utc_micros bigint")
    return out.select(F.lit(kind).alias("record_kind"), "record_id", "pos", "utc_micros")
