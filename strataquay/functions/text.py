"""Text scalars as Column expressions; all run inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the web platform counts it (control, no-break, ideographic, BOM).
SPACE_CLASS = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def is_blank(value: Column) -> Column:
    """Null, empty or only white space."""
    return value.isNull() | F.rlike(value, F.lit(f"^{SPACE_CLASS}*$"))


def trimmed(value: Column) -> Column:
    """White space of every kind cut from both ends; null gives empty text."""
    # the look-behind keeps long runs inside a text from being walked from each of their letters
    ends = f"^{SPACE_CLASS}+|(?<!{SPACE_CLASS}){SPACE_CLASS}+$"
    return F.regexp_replace(F.coalesce(value, F.lit("")), ends, "")


def composed_hangul(text: Column) -> Column:
    """Conjoining Hangul letters put together into syllables; other text is kept as it is.

    Only texts that hold such letters are walked, letter by letter.
    """
    letters = F.split(text, "")

    def as_text(code: Column) -> Column:
        # three UTF-8 bytes of a code point between U+0800 and U+FFFF
        first = F.shiftright(code, 12).bitwiseOR(F.lit(0xE0))
        second = F.shiftright(code, 6).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
        third = code.bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
        return F.decode(F.unhex(F.hex(first * 65536 + second * 256 + third)), "UTF-8")

    def emit(state: Column) -> Column:
        return F.when(state["held"] != "", state["held"]).when(state["last"] > 0, as_text(state["last"])).otherwise("")

    def state(done: Column, last: Column, held: Column) -> Column:
        return F.struct(done.alias("done"), last.cast("int").alias("last"), held.alias("held"))

    def step(acc: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        vowel = code.between(0x1161, 0x1175) & acc["last"].between(0x1100, 0x1112)
        final = code.between(0x11A8, 0x11C2) & acc["last"].between(0xAC00, 0xD7A3) & ((acc["last"] - 0xAC00) % 28 == 0)
        syllable = F.lit(0xAC00) + ((acc["last"] - 0x1100) * 21 + (code - 0x1161)) * 28
        return (
            F.when(vowel, state(acc["done"], syllable, F.lit("")))
            .when(final, state(acc["done"], acc["last"] + code - 0x11A7, F.lit("")))
            .otherwise(state(F.concat(acc["done"], emit(acc)), code, letter))
        )

    walked = F.aggregate(letters, state(F.lit(""), F.lit(0), F.lit("")), step, lambda acc: F.concat(acc["done"], emit(acc)))
    return F.when(F.rlike(text, F.lit(r"[\x{1161}-\x{11C2}]")), walked).otherwise(text)
