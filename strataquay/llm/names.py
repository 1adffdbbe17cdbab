"""Variant spellings of names of places and organisations.

A name is taken apart into its distinctive stem, the kind of place, and a
branch mark; legal forms, neighbourhoods and district brands are set aside and
the order of the parts is free.  Distinct names are sharded by where their
records stand (same building, neighbouring grid cells), each shard is put into
tries, and a Levenshtein automaton walks them to enumerate the stems within a
bounded distance.  A match must also agree in branch and in kind; where a name stands
all around, being close is no evidence, and only the same building or position links.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialize, shuffle_partitions
from .hangul import edit_distance, letters, looks_romanised, retyped, romanised
from .trie import Trie

# Fixed values, the default of a parameter: kinds of places, each with other names in use and its English name.
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "주민센터": (("행정복지센터", "동사무소", "주민자치센터"), ("resident center", "community center")),
    "어린이집": (("보육원",), ("daycare", "daycare center")),
    "어린이도서관": ((), ("children's library", "childrens library")),
    "작은도서관": (("마을도서관",), ("small library",)),
    "도서관": ((), ("library",)),
    "보건지소": (("보건분소", "보건소"), ("health branch", "health center")),
    "노인복지관": (("어르신복지관",), ("senior welfare center",)),
    "장애인복지관": ((), ("disability welfare center",)),
    "종합복지관": (("복지관",), ("welfare center",)),
    "치매안심센터": (("치매센터",), ("dementia care center",)),
    "청소년센터": (("청소년수련관", "청소년문화의집"), ("youth center",)),
    "자원순환센터": (("재활용센터",), ("recycling center",)),
    "체육센터": (("스포츠센터", "체육관"), ("sports center", "gym")),
    "박물관": (("뮤지엄", "전시관"), ("museum",)),
    "미술관": (("아트뮤지엄", "갤러리", "아트센터"), ("art museum", "gallery")),
    "공연장": (("콘서트홀", "소극장", "공연홀", "극장"), ("concert hall", "theater")),
    "전통시장": (("재래시장", "시장"), ("traditional market", "market")),
    "공영주차장": (("주차장", "공영파킹"), ("public parking", "parking lot")),
    "자전거대여소": (("자전거대여점",), ("bike rental",)),
    "마을회관": (("주민회관", "회관"), ("community hall",)),
    "근린공원": (("공원",), ("neighborhood park", "park")),
    "평생학습관": (("평생교육원", "평생학습센터", "학습관"), ("lifelong learning center",)),
    "동물병원": (("동물의료센터", "동물의원"), ("animal clinic", "animal hospital", "vet")),
    "약수터": (("샘터",), ("spring",)),
    "쉼터": (("휴게소",), ("shelter",)),
    "수영장": (("풀장",), ("swimming pool", "pool")),
    "약국": (("파머시",), ("pharmacy", "drugstore")),
    "카페": (("커피", "커피숍", "다방", "까페"), ("cafe", "coffee")),
    "공방": (("스튜디오", "공작소"), ("craft studio", "studio")),
    "서점": (("책방", "북스토어", "문고"), ("bookstore", "bookshop")),
    "병원": (("의원",), ("hospital", "clinic")),
    "학교": ((), ("school",)),
}
_FORMS = re.compile(r"\(?(?:주식회사|사단법인|재단법인|사회복지법인|협동조합|유한회사)\)?|\((?:주|사|재|복|사복|협|유)\)")
_MARKS = re.compile(r"[「」『』\[\]'\"“”‘’<>《》〈〉_·.,/|]+")
_NUMBERED = re.compile(r"(?:제\s*)?([0-9]{1,3})\s*호\s*(?:점|지점|분점)?(?![가-힣0-9])")
_LETTERED = re.compile(r"(?<![A-Za-z])([A-Za-z])\s*동(?![가-힣])")
_WORDS = re.compile(r"[가-힣]+|[A-Za-z']+|[0-9]+")


class Kinds:
    """A list of kinds, indexed by every name they go by."""

    def __init__(self, kinds: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> None:
        self.others = {kind: tuple(others) for kind, (others, _) in kinds.items()}
        self.by_name = {text: kind for kind, (others, _) in kinds.items() for text in (kind, *others)}
        self.by_english = {text: kind for kind, (_, english) in kinds.items() for text in english}
        self.names = sorted(self.by_name, key=lambda t: (-len(t), t))
        self.english = sorted(self.by_english, key=lambda t: (-len(t), t))
        self.letters = {t: letters(t) for t in self.names}
        self.syllables = {t: set(t) for t in self.names}


_KINDS = Kinds(KINDS)


@dataclass(frozen=True)
class Parsed:
    """``stem`` and ``kind`` ("" if not known, then ``rest`` is what follows the stem), ``branch``."""

    stem: str
    kind: str
    rest: str
    branch: str


def _kinds_of(text: str, kinds: Kinds) -> list[tuple[str, str]]:
    """Stems and kinds of ``text``; the kind may stand first or last and be slightly misspelt."""
    found: list[tuple[str, str]] = []
    exact = 0
    for name in kinds.names:
        if len(text) > len(name) + 1 and (text.endswith(name) or text.startswith(name)):
            exact, kind = len(name), kinds.by_name[name]
            stem = text[:-exact] if text.endswith(name) else text[exact:]
            found.append((stem, kind))
            if len(stem) >= 5 and stem.endswith(kind[:2]):
                found.append((stem[:-2], kind))
            if len(stem) < 6:
                return found  # no room for a longer kind
            break
    best: tuple[int, int, str, str] | None = None
    for name in kinds.names:
        size, spelled = len(name), kinds.letters[name]
        if size <= exact:
            break
        allowed = 1 if size < 3 else 2
        for cut in (size, size + 1, size - 1):
            if cut < 2 or len(text) < cut + 2:
                continue
            for stem, part in ((text[:-cut], text[-cut:]), (text[cut:], text[:cut])):
                # one misspelt letter or two, or one syllable dropped, doubled or swapped
                if not set(part) & kinds.syllables[name]:
                    continue
                d = edit_distance(letters(part), spelled, allowed)
                if d > allowed and size >= 3:
                    d = edit_distance(part, name, 1) + 1
                if 0 < d <= allowed and (best is None or (d, -size) < best[:2]):
                    best = (d, -size, stem, kinds.by_name[name])
    if best is not None:
        found.append((best[2], best[3]))
    return found


def _in_order(words: list[str], whole: str, stem: str) -> str:
    """The words that ``stem``, an end of the joined words ``whole``, is made of, in sorted order."""
    skip = 0 if whole.startswith(stem) else len(whole) - len(stem)
    parts, at = [], -skip
    for word in words:
        parts.append(word[max(0, -at) : max(0, len(stem) - at)])
        at += len(word)
    return "".join(sorted(parts))


def parse_name(name: str, brands: frozenset[str], kinds: Kinds = _KINDS) -> list[Parsed]:
    """The readings of a name; none for names without a letter.  Case and marks don't matter."""
    text = unicodedata.normalize("NFKC", name)
    text = _FORMS.sub(" ", _MARKS.sub(" ", text))
    branch = ""
    if found := _NUMBERED.search(text):
        branch, text = f"#{found[1]}", text[: found.start()] + " " + text[found.end() :]
    if found := _LETTERED.search(text):
        branch, text = f"{branch}@{found[1].lower()}", text[: found.start()] + " " + text[found.end() :]
    words = [w for w in _WORDS.findall(text) if w != "'"]
    if len(words) > 1:
        kept = [w for w in words if w not in brands]
        kept = [w for w in kept if not (2 <= len(w) <= 5 and w.endswith("동") and len(kept) > 1)]
        words = kept or words
    parts = [w for w in words if "가" <= w[0] <= "힣" or w.isdigit()]
    korean = "".join(parts)
    latin = [w.strip("'") for w in words if w[0].isascii() and not w.isdigit()]
    kind, stems = "", []
    if latin:
        phrase = " ".join(latin).lower()
        for english in kinds.english:
            if phrase == english or phrase.endswith(" " + english) or phrase.startswith(english + " "):
                kind = kinds.by_english[english]
                phrase = phrase.removesuffix(english) if phrase.endswith(english) else phrase.removeprefix(english)
                break
        left = phrase.replace(" ", "").replace("'", "")
        if len(left) >= 3:
            original = "".join(latin)
            turned = "".join(sorted(phrase.replace("'", "").split()))
            if looks_romanised(left):
                stems = list(dict.fromkeys((left, turned)))
            else:
                typed = retyped(original[: len(left)]) or retyped(left)
                if typed is None:
                    stems = list(dict.fromkeys((left, turned)))
                else:
                    korean = typed + korean
        elif left == "p" and not kind:
            korean += "주차장"
        if stems:
            if korean and not kind:
                exact = kinds.by_name.get(korean) or next((kinds.by_name[n] for n in kinds.names if edit_distance(letters(korean), kinds.letters[n], 1) <= 1), "")
                return [Parsed(stem, exact, "" if exact else korean, branch) for stem in stems]
            return [Parsed(stem, kind, "", branch) for stem in stems]
    if not korean:
        return []
    # the words of the stem may stand in another order: sorted, they are a further reading
    free = len(parts) > 1 and korean == "".join(parts)
    readings: list[Parsed] = []
    if kind:
        readings += [Parsed(stem, kind, "", branch) for stem in dict.fromkeys((korean, _in_order(parts, korean, korean) if free else korean))]
    elif splits := _kinds_of(korean, kinds):
        for stem, found in splits:
            readings += [Parsed(s, found, "", branch) for s in dict.fromkeys((stem, _in_order(parts, korean, stem) if free else stem))]
    else:
        for text in dict.fromkeys((korean, _in_order(parts, korean, korean) if free else korean)):
            readings += [Parsed(text[:n], "", text[n:], branch) for n in (3, 4, 5) if n <= len(text) <= n + 6] or [Parsed(text, "", "", branch)]
    more = []
    for reading in readings:
        if len(reading.stem) >= 6 and reading.stem[2] == "동":
            more.append(Parsed(reading.stem[3:], reading.kind, reading.rest, branch))
        for brand in brands:
            if reading.stem.startswith(brand) and len(reading.stem) - len(brand) >= 3:
                more.append(Parsed(reading.stem[len(brand) :], reading.kind, reading.rest, branch))
            elif reading.stem.endswith(brand) and len(reading.stem) - len(brand) >= 3:
                more.append(Parsed(reading.stem[: -len(brand)], reading.kind, reading.rest, branch))
    return readings + more


def _within(short: str, long: str) -> bool:
    """Whether the letters of ``short`` stand in ``long`` in this order."""
    rest = iter(long)
    return all(ch in rest for ch in short)


def same_kind(a: tuple[str, str], b: tuple[str, str], kinds: Kinds = _KINDS) -> int:
    """2 if the kinds agree, 1 if one is unknown but doesn't speak against the other, 0 if they differ."""
    (kind_a, rest_a), (kind_b, rest_b) = a, b
    if kind_a and kind_b:
        if kind_a == kind_b or _within(kind_a, kind_b) or _within(kind_b, kind_a):
            return 2
        return 0
    if not kind_a and not kind_b:
        return 2 if rest_a == rest_b or (rest_a and rest_b and edit_distance(letters(rest_a), letters(rest_b), 2) <= 2) else 1
    kind, rest = (kind_a, rest_b) if kind_a else (kind_b, rest_a)
    if rest and any(_within(rest, t) for t in (kind, *kinds.others[kind])):
        return 2
    return 1


_SHARD_SCHEMA = "a bigint, b bigint"
_SHARD_COLUMNS = ["_shard", "_edits", "_rep", "stem", "kind", "rest", "branch", "_chunk", "_mixed", "_latin"]


def _link_shards(frames: Iterator[pd.DataFrame], kinds: Kinds) -> Iterator[pd.DataFrame]:
    """Links between the distinct names of each shard; a partition's shards come one after the other."""
    held: list[tuple] = []
    links: list[tuple[int, int]] = []

    def close() -> None:
        if len(held) > 1:
            links.extend(_links(held, kinds))
        held.clear()

    shard = None
    for frame in frames:
        for row in frame[_SHARD_COLUMNS].itertuples(index=False, name=None):
            if row[0] != shard:
                close()
                shard = row[0]
            held.append(row[1:])
        if len(links) > 20_000:
            yield pd.DataFrame(links, columns=["a", "b"])
            links.clear()
    close()
    if links:
        yield pd.DataFrame(links, columns=["a", "b"])


def _links(names: list[tuple], kinds: Kinds = _KINDS) -> Iterator[tuple[int, int]]:
    """Links among ``edits, rep, stem, kind, rest, branch, chunk, mixed, latin`` of one shard.

    In a mixed block of two chunks only names of different chunks are compared (the others meet
    in their own block); in a Latin shard only names of which one is written in Latin letters.
    """
    by_stem: dict[str, dict[str, list[tuple]]] = {}
    for name in names:
        by_stem.setdefault(name[2], {}).setdefault(name[5], []).append(name)
    chunk = {name[2]: name[6] for name in names}
    edits, mixed, latin_only = names[0][0], names[0][7], names[0][8]
    spelled = Trie(s for s in by_stem if not s.isascii() and not latin_only)
    latin: dict[str, list[str]] = {}
    sounded = None
    if any(s.isascii() for s in by_stem):
        for stem in by_stem:
            latin.setdefault(romanised(stem), []).append(stem)
        sounded = Trie(latin)
    for stem, own in by_stem.items():
        if stem.isascii():
            near = [(s, d) for word, d in sounded.within(stem, 1 if len(stem) > 6 else 0) for s in latin[word]]
        else:
            size = len(stem)
            near = spelled.within(stem, edits if size >= 4 else min(edits, 1) if size == 3 else 0)
        for other, apart in near:
            if (len(other), other) > (len(stem), stem) and not (stem.isascii() or other.isascii()):
                continue  # met from the other side, whose stem is as long at least and so allows as many edits
            if mixed and chunk[stem] == chunk[other]:
                continue
            whole = min(len(stem), len(other)) >= 4
            for branch in own.keys() & by_stem[other].keys():
                for one in own[branch]:
                    for two in by_stem[other][branch]:
                        if one[1] == two[1]:
                            continue
                        agree = same_kind(one[3:5], two[3:5], kinds)
                        if (agree == 2 and (apart <= 1 or (one[3] and two[3]))) or (agree == 1 and apart == 0 and whole):
                            yield one[1], two[1]


def _common_around(base: DataFrame, located: Column, share: float, cell_degrees: float = 0.01) -> DataFrame:
    """``folded, _cx, _cy``: names that stand all around a cell.

    Such a name is found in ``share`` or more of the inhabited cells one to three cells away, and
    in two at least.  One place's rows never lie so far apart, so only other places count,
    and the share is the same measure for a village and a country.
    """
    stands = base.where(located).select("folded", "_cx", "_cy").distinct()
    ring = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-3, 4) for dy in range(-3, 4) if max(abs(dx), abs(dy)) > 1])

    def around(cells: DataFrame, keys: list[str], out: str) -> DataFrame:
        moved = cells.select(*keys, "_cx", "_cy", F.explode(ring).alias("_r")).select(
            *keys, (F.col("_cx") + F.col("_r.dx")).alias("_cx"), (F.col("_cy") + F.col("_r.dy")).alias("_cy")
        )
        return moved.groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias(out))

    several = stands.groupBy("folded").agg(F.count(F.lit(1)).alias("_n")).where("_n > 2").select("folded")
    repeated = stands.join(several, "folded")
    inhabited = around(stands.select("_cx", "_cy").distinct(), [], "_inhabited")
    return (
        repeated.join(around(repeated, ["folded"], "_same"), ["folded", "_cx", "_cy"]).join(inhabited, ["_cx", "_cy"])
        .where((F.col("_same") >= 2) & (F.col("_same") >= share * F.col("_inhabited"))).select("folded", "_cx", "_cy")
    )


def link_names(
    rows: DataFrame,
    *,
    id_column: str,
    name: str,
    x: str,
    y: str,
    building: str,
    brands: Sequence[str] = (),
    kinds: Mapping[str, tuple[Sequence[str], Sequence[str]]] = KINDS,
    common_share: float = 0.1,
    cell_degrees: float = 0.004,
    reach_degrees: float = 0.0014,
    hot_names: int = 1000,
) -> DataFrame:
    """``id, entity`` for every row that has a non-blank name and is linked to another one.

    Rows meet if they share ``building`` (stems up to two edits apart) or stand
    in a common grid cell (one edit; each row belongs to all cells within
    ``reach_degrees``, so any two rows closer than that meet).  Where a name stands all around
    (see ``_common_around``), its rows meet others only in their building and at their
    exact position, under any spelling.  Rows with null or NaN coordinates and no
    building link to nothing.  ``kinds`` lists kinds of places with their other names and English names;
    without it names match by their letters alone.  Spots of more than ``hot_names`` distinct names are
    cut into shards by pairs of letters, of which the allowed edits leave at least one, and
    shards that are still larger into chunks met two by two: no trie ever holds more than twice
    ``hot_names`` names, and no match is lost.
    """
    brand_set, kind_table = frozenset(brands), Kinds(kinds)
    folded = F.regexp_replace(F.lower(F.col(name)), r"[\s\p{Z}\p{P}\p{S}]+", "")
    located = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y") & (F.col("_x") != 0.0)
    base = materialize(
        rows.where(folded != "").select(
            F.col(id_column).alias("id"), F.col(name).alias("name"), folded.alias("folded"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(building).alias("_b")
        ).withColumns({"_cx": F.floor(F.col("_x") / 0.01), "_cy": F.floor(F.col("_y") / 0.01)})
    )
    common = materialize(_common_around(base, located, common_share))
    marked = base.join(common.withColumn("_common", F.lit(True)), ["folded", "_cx", "_cy"], "left")
    points = marked.where("_common").select("_x", "_y").distinct().withColumn("_point", F.lit(True))
    flagged = marked.join(points, ["_x", "_y"], "left")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                (n, p.stem, p.kind, p.rest, p.branch, romanised(p.stem))
                for n in frame["name"]
                for p in dict.fromkeys(parse_name(n, brand_set, kind_table))
                if p.stem
            ]
            yield pd.DataFrame(out, columns=["name", "stem", "kind", "rest", "branch", "roman"])

    spelled = materialize(
        base.select("name").distinct().mapInPandas(parse, "name string, stem string, kind string, rest string, branch string, roman string")
    )
    # --- where a row stands: its building and every cell within reach ----------------------
    cells = [
        F.when(located & F.col("_common").isNull(), F.xxhash64(F.lit("c"), F.floor((F.col("_x") + dx) / cell_degrees), F.floor((F.col("_y") + dy) / cell_degrees)))
        for dx in (-reach_degrees / 2, reach_degrees / 2)
        for dy in (-reach_degrees / 2, reach_degrees / 2)
    ]
    cells.append(F.when(F.col("_point"), F.xxhash64(F.lit("p"), "_x", "_y")))
    spots = F.array_union(
        F.transform(F.array_distinct(F.array_compact(F.array(*cells))), lambda c: F.struct(c.alias("_spot"), F.lit(1).alias("_edits"))),
        F.when(F.col("_b").isNotNull(), F.array(F.struct(F.xxhash64(F.lit("b"), "_b").alias("_spot"), F.lit(2).alias("_edits")))).otherwise(
            F.array().cast("array<struct<_spot:bigint,_edits:int>>")
        ),
    )
    placed = flagged.select("id", "name", F.explode(spots).alias("_s")).select("id", "name", "_s.*")
    # equal names of one spot first become one: copies never reach a trie
    merged = materialize(placed.groupBy("_spot", "_edits", "name").agg(F.min("id").alias("_low")))
    readings = merged.join(spelled.hint("merge"), "name")
    reading_key = ["_spot", "_edits", "stem", "kind", "rest", "branch", "roman"]
    distinct = materialize(readings.groupBy(*reading_key).agg(F.min("_low").alias("_rep")))
    sizes = distinct.groupBy("_spot").agg(F.count(F.lit(1)).alias("_names")).where("_names > 1")
    sized = distinct.join(sizes.hint("merge"), "_spot")
    # Two stems that match share two of their first six letters: two edits leave two of the
    # first four, moved by two places at most.  Romanised ones share three letters at an end.
    syllables = F.array_sort(F.split(F.substring("stem", 1, 6), ""))
    twos = F.flatten(
        F.transform(
            syllables,
            lambda c, i: F.transform(F.slice(syllables, i + 2, F.size(syllables)), lambda d: F.concat(c, d)),
        )
    )
    parts = F.when(F.rlike("stem", F.lit("^[ -~]")), F.array().cast("array<string>")).otherwise(F.array_append(F.array_distinct(twos), F.concat(F.lit("="), "stem")))
    parts = F.concat(
        parts,
        F.array(F.concat(F.lit("<"), F.substring("roman", 1, 3)), F.concat(F.lit(">"), F.expr("right(roman, 3)"))),
    )
    plain = sized.where(F.col("_names") <= hot_names).select(
        F.xxhash64("_spot").alias("_shard"), *_SHARD_COLUMNS[1:7], F.lit(0).alias("_chunk"), F.lit(False).alias("_mixed"), F.lit(False).alias("_latin")
    )
    cut = sized.where(F.col("_names") > hot_names).withColumn("_part", F.explode(parts))
    # a pair of letters may still be common to too many: chunks by hash, every two of which make a block
    sizes = cut.groupBy("_spot", "_part").agg(F.ceil(F.count(F.lit(1)) / hot_names).cast("int").alias("_chunks")).where("_chunks > 1")
    blocks = (
        cut.join(sizes, ["_spot", "_part"], "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
        .withColumn("_chunk", F.pmod(F.xxhash64("stem"), F.col("_chunks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .select(
            F.xxhash64("_spot", "_part", F.least("_chunk", "_other"), F.greatest("_chunk", "_other")).alias("_shard"), *_SHARD_COLUMNS[1:7], "_chunk",
            (F.col("_chunk") != F.col("_other")).alias("_mixed"), F.rlike("_part", F.lit("^[<>]")).alias("_latin"),
        )
    )
    # the number is stated, or few bytes would be taken for little work
    matched = plain.unionByName(blocks).repartition(shuffle_partitions(base.sparkSession), "_shard").sortWithinPartitions("_shard").mapInPandas(
        lambda frames: _link_shards(frames, kind_table), _SHARD_SCHEMA
    )
    # --- rows of equal names and equal readings to their representative --------------------
    same_name = placed.join(merged.hint("merge"), ["_spot", "_edits", "name"]).where("id <> _low").select(F.col("id").alias("a"), F.col("_low").alias("b"))
    same_reading = readings.join(distinct.hint("merge"), reading_key).where("_low <> _rep").select(F.col("_low").alias("a"), F.col("_rep").alias("b"))
    edges = matched.unionByName(same_name).unionByName(same_reading)
    labels = connected_components(edges)
    return labels.select(F.col("node").alias("id"), F.col("component").alias("entity"))
