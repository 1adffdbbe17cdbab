"""Telephone numbers: which texts hold only complete, dialable Korean numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

# The public Korean numbering plan.
_SEP = r"[ \t 　]*[-.)·‐-―−－]?[ \t 　]*"
_AREA = r"(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4])"
_SERVICE = r"(?:1[016789]|30|60|70|80|50[0-9])"
_SHORT = r"(?:1(?:0[0-9]|1[0-9]|2[0-9]|3[0-9]|8[0-9])|13[0-9]{2})"
_NATIONWIDE = r"1[568][0-9]{2}"
_COUNTRY = r"(?:\+?82" + _SEP + r"(?:\(0\))?0?|\(?0)"

_GEOGRAPHIC = _COUNTRY + _AREA + _SEP + r"[2-9][0-9]{2,3}" + _SEP + r"[0-9]{4}"
_NUMBERED_SERVICE = _COUNTRY + _SERVICE + _SEP + r"[0-9]{3,4}" + _SEP + r"[0-9]{4}"
_AREA_AND_SHORT = r"\(?0" + _AREA + _SEP + _SHORT
_CARD = _NATIONWIDE + _SEP + r"[0-9]{4}"
_ONE = f"(?:{_GEOGRAPHIC}|{_NUMBERED_SERVICE}|{_AREA_AND_SHORT}|{_CARD}|{_SHORT})"
_RANGE = r"(?:[ ]*[~∼〜～][ ]*[0-9]{1,4})?"
_EXTENSION = r"(?:[ ]*(?:내선|구내|교환|ext\.?|#)[ ]*[:.]?[ ]*[0-9]{1,5}번?)?"
_REMARK = r"(?:[ ]*(?:\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）))*"
_ITEM = _REMARK + r"[ ]*" + _ONE + _RANGE + _EXTENSION + _REMARK
_JOIN = r"(?:\s*[,/;|、，／·]\s*|\s+)"
_BLANKS = r"[\s 　]*"
DIALABLE = f"^{_BLANKS}{_ITEM}(?:{_JOIN}{_ITEM})*{_BLANKS}$"


_EDGE = r"[,/;|、，／·\s]"
_PARTS = f"(?<=^|{_EDGE}){_ONE}{_RANGE}{_EXTENSION}(?:[ ]?(?:\\([^()]*\\)|\\[[^\\[\\]]*\\]))?(?=$|{_EDGE})"
#: Longer values are taken apart number by number; one pattern over them would nest too deeply.
_LONG = 1000


def unusable_phone(value: Column) -> Column:
    """True for a non-blank text that isn't made up only of dialable numbers.

    Area or service prefix and all digits must be present; short service
    numbers, nationwide numbers, several numbers, line ranges, extensions and
    bracketed remarks are fine.  Null and blank are not unusable.
    """
    even = F.regexp_replace(value, r"\s+", " ")
    rest = F.regexp_replace(even, _PARTS, "")
    fine = F.when(F.length(even) > _LONG, F.rlike(rest, F.lit(f"^{_EDGE}*$")) & F.rlike(even, F.lit(_PARTS))).otherwise(F.rlike(even, F.lit(DIALABLE)))
    return ~is_blank(value) & ~F.coalesce(fine, F.lit(True))
