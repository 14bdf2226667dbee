"""One consistent form for visually identical text (problem 6).

Method: the text buffer of an Arrow column becomes one numpy array of code points; lookup
tables give each code point's expansion, gathered with cumulated offsets; look-alike letters
are mapped in words that hold Latin letters; marks are ordered and composed in rounds over
all clusters at once.  No string function is called per row.

The plain form: composed accents, ordinary width, no joined letters, no invisible characters,
the ordinary hyphen and blank, no blanks at the ends, and only Latin letters in a word (a
stretch between blanks) with Latin letters.  Case and other marks stay; words wholly in
Cyrillic or Greek stay.

Defined cases: null stays null; a text of blanks and invisible characters becomes empty; a
Cyrillic or Greek letter without a Latin look-alike stays as it is.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like a Latin letter, in pairs.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "н": "h", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ғ": "F", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I", "Ԁ": "D", "Һ": "H", "Ё": "Ë", "Ї": "Ï",
    # Greek
    "α": "a", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϝ": "F",
}
# Hyphens, and invisible characters that are not of the format category.
HYPHENS = "‐‑﹣－"
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"

_TOP = sys.maxunicode + 1
_HANGUL_S, _HANGUL_L, _HANGUL_V, _HANGUL_T = 0xAC00, 0x1100, 0x1161, 0x11A7


def _expansion(c: int, ch: str) -> str:
    """What a code point becomes: taken apart canonically, with width, ligatures, hyphens, blanks and unseen ones settled."""
    kind = unicodedata.category(ch)
    if ch in HYPHENS:
        return "-"
    if kind == "Zs":
        return " "
    if kind == "Cf" or ch in UNSEEN or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or (kind == "Cc" and not ch.isspace()):
        return ""
    form = unicodedata.decomposition(ch).split(" ")[0]
    if form in ("<wide>", "<narrow>") or 0xFB00 <= c <= 0xFB06 or 0x132 <= c <= 0x133 or 0x1C4 <= c <= 0x1CC or 0x1F1 <= c <= 0x1F3 or 0x13F <= c <= 0x140:
        inner = unicodedata.normalize("NFKC", ch)
        return unicodedata.normalize("NFD", inner)
    return unicodedata.normalize("NFD", ch)


class _Tables:
    """Lookup tables over all code points, made from the Unicode data of Python."""

    def __init__(self) -> None:
        expand: list[str] = []
        self.size = np.ones(_TOP, np.int32)
        self.at = np.arange(_TOP, dtype=np.int32)
        self.ccc = np.zeros(_TOP, np.uint8)
        self.latin = np.zeros(_TOP, bool)
        self.alike = np.arange(_TOP, dtype=np.uint32)
        firsts, seconds, wholes = [], [], []
        extra = _TOP
        for c in range(_TOP):
            if 0xD800 <= c < 0xE000 or 0x30000 <= c < 0xE0000 or c >= 0xE0200 or _HANGUL_S + 11172 <= c < 0xF900 or 0x3400 <= c < 0xA000:
                continue
            ch = chr(c)
            self.ccc[c] = unicodedata.combining(ch)
            to = _expansion(c, ch)
            if to != ch:
                self.size[c], self.at[c] = len(to), extra
                expand.append(to)
                extra += len(to)
            pair = unicodedata.normalize("NFD", ch)
            if len(pair) > 1 and not _HANGUL_S <= c < _HANGUL_S + 11172 and unicodedata.normalize("NFC", ch) == ch:
                canon = [chr(int(x, 16)) for x in unicodedata.decomposition(ch).split()]
                firsts.append(ord(canon[0])), seconds.append(ord(canon[1])), wholes.append(c)
            if c < 0x2000 or 0x2C60 <= c < 0x2C80 or 0xA720 <= c < 0xA800 or 0xAB30 <= c < 0xAB70:
                self.latin[c] = ch.isalpha() and unicodedata.name(ch, "").startswith("LATIN")
        # Hangul syllables by the rule of the standard: L+V, then LV+T.
        for lv in range(0, 11172, 28):
            firsts.append(_HANGUL_L + lv // 588), seconds.append(_HANGUL_V + lv % 588 // 28), wholes.append(_HANGUL_S + lv)
            for t in range(1, 28):
                firsts.append(_HANGUL_S + lv), seconds.append(_HANGUL_T + t), wholes.append(_HANGUL_S + lv + t)
        self.text = np.concatenate([np.arange(_TOP, dtype=np.uint32), np.frombuffer("".join(expand).encode("utf-32-le"), np.uint32)])
        key = np.array(firsts, np.uint64) << np.uint64(21) | np.array(seconds, np.uint64)
        order = np.argsort(key)
        self.pair, self.whole = key[order], np.array(wholes, np.uint32)[order]
        # A mark in the wide sense: of a combining class, or ever the second of a pair.
        self.joins = self.ccc > 0
        self.joins[np.array(seconds)] = True
        for a, b in LOOK_ALIKES.items():
            if len(b) == 1 and len(unicodedata.normalize("NFD", a)) == 1:
                self.alike[ord(a)] = ord(b)


@cache
def _tables() -> _Tables:
    return _Tables()


def _blank(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0x85) | (cp == 0x2028) | (cp == 0x2029)


def _decode(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values in one array, and the offset of each value (one more at the end)."""
    values = values.cast(pa.large_string()) if not pa.types.is_large_string(values.type) else values
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), starts[offsets - offsets[0]]


def _encode(cp: np.ndarray, offsets: np.ndarray, missing: pa.Array) -> pa.Array:
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].astype(np.int64).tobytes()), pa.py_buffer(data))
    return pc.if_else(missing, pa.scalar(None, pa.large_string()), out)


def _keep(cp: np.ndarray, row: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cp[kept], row[kept]


def _compose(cp: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition, a round for each place in a cluster, over all clusters at once."""
    n = len(cp)
    if n == 0 or not t.joins[cp].any():
        return cp, row
    ccc = t.ccc[cp]
    # Order: within a stretch of marks by combining class, stable.
    stretch = np.cumsum(ccc == 0)
    if (ccc[1:] < ccc[:-1])[(ccc[1:] > 0)].any():
        order = np.lexsort((np.arange(n), ccc, stretch, row))
        cp, ccc = cp[order], ccc[order]
    # Clusters: a mark belongs to what stands before it in its row.
    opens = ~t.joins[cp] | np.concatenate([[True], row[1:] != row[:-1]])
    start = np.flatnonzero(opens)
    length = np.diff(np.append(start, n))
    long = length > 1
    base, rest = start[long].copy(), length[long]
    first = start[long]
    last = np.zeros(len(base), np.int64)  # class of the last mark left standing behind the base; 256: a starter stands there
    gone = np.zeros(n, bool)
    for k in range(1, int(rest.max(initial=1))):
        live = np.flatnonzero(rest > k)
        at, b = first[live] + k, base[live]
        c = ccc[at].astype(np.int64)
        key = cp[b].astype(np.uint64) << np.uint64(21) | cp[at].astype(np.uint64)
        i = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
        free = (last[live] == 0) | ((last[live] < c) & (c > 0))
        fits = (t.pair[i] == key) & free & (ccc[b] == 0)
        cp[b[fits]] = t.whole[i[fits]]
        gone[at[fits]] = True
        stays = ~fits
        # A starter that did not join becomes the base of what follows it.
        new = stays & (c == 0)
        base[live[new]] = at[new]
        last[live[new]] = 0
        marks = stays & (c > 0)
        last[live[marks]] = c[marks]
    return _keep(cp, row, ~gone)


def plain_array(values: pa.Array) -> pa.Array:
    """The plain form of each text of an Arrow array."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    t = _tables()
    missing = pc.is_null(values)
    n = len(values)
    cp, offsets = _decode(pc.fill_null(values, ""))
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    # Expansion by table and offsets.
    size = t.size[cp]
    total = int(size.sum())
    ends = np.cumsum(size)
    place = np.arange(total, dtype=np.int64) - np.repeat(ends - size, size)
    cp, row = t.text[np.repeat(t.at[cp], size) + place], np.repeat(row, size)
    # Words with a Latin letter take look-alikes for Latin.
    if (t.alike[cp] != cp).any():
        blank = _blank(cp)
        word = np.cumsum(blank | np.concatenate([[False], row[1:] != row[:-1]])) if len(cp) else np.zeros(0, np.int64)
        has = np.bincount(word[t.latin[cp]], minlength=int(word[-1]) + 1 if len(word) else 0) > 0
        cp = np.where(has[word] & ~blank, t.alike[cp], cp).astype(np.uint32)
    cp, row = _compose(cp.copy(), row, t)
    # Blanks at the ends.
    solid = np.flatnonzero(~_blank(cp))
    lo, hi = np.full(n, len(cp), np.int64), np.full(n, -1, np.int64)
    np.minimum.at(lo, row[solid], solid)
    np.maximum.at(hi, row[solid], solid)
    here = np.arange(len(cp))
    cp, row = _keep(cp, row, (here >= lo[row]) & (here <= hi[row]))
    return _encode(cp, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), missing)


@F.pandas_udf(T.StringType())
def _plain(texts: pd.Series) -> pd.Series:
    return plain_array(pa.array(texts, pa.string(), from_pandas=True)).to_pandas()


#: A text of these characters only is its own plain form but for blanks at its ends.
_ORDINARY = r"^[\x20-\x7e]*\z"


def plain(text: Column) -> Column:
    """The plain form of a column; texts of printable ASCII do not leave the JVM."""
    odd = F.when(~text.rlike(_ORDINARY), text)
    return F.when(odd.isNull(), F.trim(text)).otherwise(_plain(odd))


def changed(df: DataFrame, row_id: str, field: str, name: str) -> DataFrame:
    """``tbl, row_id, plain`` for rows whose text differs from its plain form by more than ordinary blanks at its ends."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = plain_array(batch.column(1)).cast(pa.string())
            other = pc.not_equal(form, pc.utf8_trim(batch.column(1), " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), form], ["row_id", "plain"]).filter(other)

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(field).cast("string").alias("text")).where(~F.col("text").rlike(_ORDINARY))
    return rows.mapInArrow(classify, "row_id long, plain string").select(F.lit(name).alias("tbl"), "row_id", "plain")
