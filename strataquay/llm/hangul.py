"""Hangul letters: taking syllables apart, romanisation, and text typed on the wrong keyboard."""

from __future__ import annotations

import re

# Unicode order of Hangul letters, the public romanisation and the standard two-set keyboard.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
ROMAN_INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h".replace("-", "").split(" ")
ROMAN_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
ROMAN_FINALS = " k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split(" ")
KEYS = dict(zip("qwertyuiopasdfghjklzxcvbnmQWERTOP", "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔㅁㄴㅇㄹㅎㅗㅓㅏㅣㅋㅌㅊㅍㅠㅜㅡㅃㅉㄸㄲㅆㅒㅖ", strict=True))
JOINED_VOWELS = {"ㅗㅏ": "ㅘ", "ㅗㅐ": "ㅙ", "ㅗㅣ": "ㅚ", "ㅜㅓ": "ㅝ", "ㅜㅔ": "ㅞ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ"}

_ROMAN = re.compile(
    "(?:(?:" + "|".join(sorted(filter(None, ROMAN_INITIALS), key=len, reverse=True)) + ")?(?:"
    + "|".join(sorted(ROMAN_VOWELS, key=len, reverse=True)) + ")(?:ng|[klmnpt](?![aeiouyw]))?)+"
)


def letters(text: str) -> str:
    """Every syllable as its letters; other characters stay."""
    out = []
    for ch in text:
        code = ord(ch) - 0xAC00
        if 0 <= code < 11172:
            out += [INITIALS[code // 588], VOWELS[code // 28 % 21]]
            if code % 28:
                out.append(FINALS[code % 28])
        else:
            out.append(ch)
    return "".join(out)


def romanised(text: str) -> str:
    out = []
    for ch in text:
        code = ord(ch) - 0xAC00
        if 0 <= code < 11172:
            out += [ROMAN_INITIALS[code // 588], ROMAN_VOWELS[code // 28 % 21], ROMAN_FINALS[code % 28]]
        else:
            out.append(ch)
    return "".join(out)


def looks_romanised(word: str) -> bool:
    return _ROMAN.fullmatch(word.lower()) is not None


def retyped(word: str) -> str | None:
    """Latin keys typed for Hangul letters, as Hangul; None unless whole syllables come out."""
    typed = [KEYS.get(ch) or KEYS.get(ch.lower()) for ch in word]
    if None in typed:
        return None
    out, i, n = [], 0, len(typed)
    while i < n:
        if typed[i] not in INITIALS or i + 1 >= n or typed[i + 1] not in VOWELS:
            return None
        initial, vowel, i = typed[i], typed[i + 1], i + 2
        if i < n and vowel + typed[i] in JOINED_VOWELS:
            vowel, i = JOINED_VOWELS[vowel + typed[i]], i + 1
        final = 0
        if i < n and typed[i] in FINALS and (i + 1 >= n or typed[i + 1] not in VOWELS):
            final, i = FINALS.index(typed[i]), i + 1
        out.append(chr(0xAC00 + INITIALS.index(initial) * 588 + VOWELS.index(vowel) * 28 + final))
    return "".join(out)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours; ``most + 1`` if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]
