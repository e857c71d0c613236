"""Word rules: the tokenising pattern, folding of surfaces, rounding. All built-in expressions, but for
Unicode normalisation, which Spark lacks and which is asked for only where a surface isn't plain ASCII."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: letters and digits, joined inside by an apostrophe, a no-break space or a full stop before a letter.
#: Free of look-around, so that Java and RE2 agree.
WORD = "['’]?[\\p{L}\\p{N}]+(?:['’\\x{00A0}][\\p{L}\\p{N}]+|\\.\\p{L}[\\p{L}\\p{N}]*)*['’]?"

#: Characters without width that a folded surface doesn't hold.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def fold_py(s: str) -> str:
    """Invisible characters removed, NFC, U+2019 as ', trimmed, lower case; a lone I stays I."""
    for c in INVISIBLE:
        s = s.replace(c, "")
    s = unicodedata.normalize("NFC", s).replace("\u2019", "'").strip()
    return s if s == "I" else s.lower()


@F.arrow_udf(T.StringType())
def _fold_arrow(v: pa.Array) -> pa.Array:
    d = v.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    folded = pa.array([None if x is None else fold_py(x) for x in d.dictionary.to_pylist()], pa.string())
    return pc.take(folded, d.indices) if len(folded) else pa.nulls(len(v), pa.string())


def fold_ascii(c: Column) -> Column:
    return F.when(c == "I", c).otherwise(F.lower(c))


def is_plain(c: Column) -> Column:
    """ASCII alone, with a printing character at either end: folding is then lower() but for I."""
    return (F.octet_length(c) == F.length(c)) & (F.substring(c, 1, 1) > " ") & (F.substring(c, -1, 1) > " ") & (F.substring(c, -1, 1) < "\x7f")


def fold_odd(c: Column) -> Column:
    """The folded surface where folding takes more than lower case, else null."""
    return _fold_arrow(F.when(~is_plain(c), c))


def fold_surface(c: Column) -> Column:
    """The folded surface of TESTDATA. Null stays null; only surfaces that aren't plain go to Python."""
    return F.coalesce(F.when(is_plain(c), fold_ascii(c)), fold_odd(c))


def words(text: Column) -> Column:
    """The tokens of a text, as printed."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def fold_word(c: Column) -> Column:
    """Case folding of a token: I stays apart from i; a no-break space becomes a space."""
    return F.when(c == "I", c).otherwise(F.lower(F.translate(c, "\u00a0", " ")))


def is_capital(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return (first != F.lower(first)) & (first == F.upper(first))


def half_up(c: Column, places: int) -> Column:
    """Round half toward plus infinity, as floor(x * 10^k + 1/2) / 10^k."""
    k = float(10**places)
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)


def digest(df: DataFrame) -> Column:
    """A hash of a row, in which nulls count."""
    return F.xxhash64(*df.columns, *(F.col(c).isNull() for c in df.columns))
