"""Operators of the llm subpackage against brute force and round trips."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strataquay.llm.addresses import AddressFields, building_pairs, buildings, parse_addresses
from strataquay.llm.formatting import collapse_copies
from strataquay.llm.hangul import edit_distance, looks_romanised, retyped, romanised
from strataquay.llm.mixing import copy_steps, mix_sources
from strataquay.llm.names import KINDS, Parsed, _links, link_names, parse_name
from strataquay.llm.packing import pack_in_order, pack_items
from strataquay.llm.splitting import boundary_table, split_files, split_texts
from strataquay.llm.tokens import VOCABULARY, count, token_count
from strataquay.llm.trie import Trie
from strataquay.session import materialize

# --- copies that differ in writing -----------------------------------------------------------------

COPY_SCHEMA = "id bigint, run string, a string, n1 string, v1 string, n2 string, v2 string, x double, _k1 bigint, row string"


def brute_key(r):
    fold = lambda s: "".join(c for c in (s or "").lower() if not c.isspace() and unicodedata.category(c)[0] not in "ZPS")
    number = None if r[7] is None else "nan" if r[7] != r[7] else r[7] + 0.0
    return r[1], fold(r[2]), tuple(sorted([(fold(r[3]), fold(r[4])), (fold(r[5]), fold(r[6]))])), number


def copies(spark, rows, **more):
    frame = spark.createDataFrame(rows, COPY_SCHEMA)
    return collapse_copies(frame, id_column="id", within=["run"], content=["a", "n1", "v1", "n2", "v2", "x"], swappable=[[("n1", "v1"), ("n2", "v2")]], **more)


@pytest.mark.parametrize("hot", [10_000, 3])
def test_copies(spark, hot):
    random.seed(2)
    pick = random.choice
    rows = [
        (i, pick(["r", None]), pick(["A b", "ab", " a-B!", "ac", "", None, "가　나", "가나", "x" * 100_000]), pick(["p", "q"]), pick(["1", "2", None]), pick(["p", "q"]), pick(["1", "2", ""]), pick([0.0, -0.0, None, float("nan"), 1.5]), 1, "clash")
        for i in range(600)
    ]
    groups = {}
    for r in rows:
        groups.setdefault(brute_key(r), []).append(r[0])
    got = copies(spark, rows, hot_rows=hot)
    assert {tuple(r) for r in got.groups.collect()} == {(min(g), len(g)) for g in groups.values()}
    members = [tuple(r) for r in got.members.collect()]
    assert len(members) == len(set(members)) and set(members) == {(min(g), i) for g in groups.values() for i in g if i != min(g)}


def test_copies_empty(spark):
    got = copies(spark, [])
    assert got.groups.count() == 0 and got.members.count() == 0


# --- names ------------------------------------------------------------------------------------------

BRANDS = frozenset({"나래", "윤슬"})


def test_edit_distance_and_trie():
    random.seed(4)
    words = {"".join(random.choice("abc") for _ in range(random.randrange(6))) for _ in range(150)}
    trie = Trie(words)
    for word in sorted(words)[:60]:
        for edits in (0, 1, 2):
            assert dict(trie.within(word, edits)) == {w: edit_distance(word, w, edits) for w in words if edit_distance(word, w, edits) <= edits}
    assert edit_distance("가나다", "나가다", 2) == 1 and edit_distance("abc", "xyz", 1) == 2


def test_hangul():
    assert romanised("호달비채") == "hodalbichae" and looks_romanised("hodalbichae") and not looks_romanised("codbfakgk")
    assert retyped("codbfakgk") == "채율마하" and retyped("enqkwldhs") == "두바지온" and retyped("bbb") is None


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("주식회사 수영장(가언보온)", Parsed("가언보온", "수영장", "", "")), ("윤슬 우누내사어린이도서관", Parsed("우누내사", "어린이도서관", "", "")), ("Hodalbichae Resident Center", Parsed("hodalbichae", "주민센터", "", "")),
        ("codbfakgk수영장", Parsed("채율마하", "수영장", "", "")), ("사늘 하사마을회관(3호점)", Parsed("사늘하사", "마을회관", "", "#3")), ("노예모징커페", Parsed("노예모징", "카페", "", "")), ("라두 무서 자원순환센터 A동", Parsed("라두무서", "자원순환센터", "", "@a")),
        ("예라별우노복", Parsed("예라별우", "", "노복", "")), ("로호동수이라늘체육센터", Parsed("수이라늘", "체육센터", "", "")),
    ],
)
def test_parse_name(name, want):
    assert want in parse_name(name, BRANDS)


def test_words_of_a_stem_in_any_order():
    for one, two in (("새빛 나눔 도서관", "나눔 새빛 도서관"), ("새빛 나눔도서관", "나눔 새빛도서관"), ("도서관 새빛 나눔", "나눔 새빛 도서관"), ("새빛 나눔", "나눔 새빛"), ("sodanu hamira library", "hamira sodanu library")):
        assert set(parse_name(one, BRANDS)) & set(parse_name(two, BRANDS))


def entities(spark, rows, **more):
    frame = spark.createDataFrame(rows, "id bigint, name string, x double, y double, b bigint, stem string, _b int")
    found = {}
    for r in link_names(frame, id_column="id", name="name", x="x", y="y", building="b", brands=sorted(BRANDS), **more).collect():
        found.setdefault(r.entity, set()).add(r.id)
    return sorted(map(sorted, found.values()))


def test_stems_meet_within_the_longer_ones_budget():
    for short, long in (("하나무", "가다나무"), ("가나무", "하다나무"), ("나무", "가나무"), ("나무", "하나무"), ("하무", "가하무")):
        held = [(2, i, stem, "약국", "", "", 0, False, False) for i, stem in enumerate((short, long))]
        assert len(list(_links(held))) == 1, (short, long)


NAMES = ["소다누사근린공원", "서다누사근린공원", "소다누사·근린공원 ", "근린공원(소다누사)", "sodanusa 근린공원", "소다누사공원", "재단법인 나래 소다누사 근린 공원", "Sodanusa Neighborhood Park"]


@pytest.mark.parametrize("hot", [1000, 1])
def test_names_are_linked(spark, hot):
    rows = [(i, n, 127.0, 37.0, 7, "clash", 0) for i, n in enumerate(NAMES)]
    rows += [(100, "소다누사근린공원 2호점", 127.0, 37.0, 7, "", 0), (101, "소다누사약국", 127.0, 37.0, 7, "", 0), (102, "소다누사근린공원", 127.5, 37.0, 8, "", 0), (103, None, 127.0, 37.0, 7, "", 0), (104, " ", 127.0, 37.0, 7, "", 0),
             (105, "무보라솔약국", None, None, None, "", 0), (106, "무보라솔약국", float("nan"), 37.0, None, "", 0), (107, "가" * 50_000, 127.0, 37.0, 7, "", 0), (108, "@@", 127.0, 37.0, 7, "", 0)]
    assert entities(spark, rows, hot_names=hot) == [list(range(len(NAMES)))]


def test_near_rows_without_building_and_common_names(spark):
    rows = [(1, "미하부내주민센터", 127.0, 37.0, None, "", 0), (2, "미하주내 주민센터", 127.001, 37.0, None, "", 0), (3, "미하부내주민센터", 127.2, 37.0, None, "", 0)]
    rows += [(10 + i, "공중화장실", 127.0 + i * 0.05, 37.0, None, "", 0) for i in range(9)] + [(30, "공중 화장실", 127.0, 37.0, None, "", 0)]
    assert entities(spark, rows) == [[1, 2], [10, 30]]


def test_common_names_keep_their_variants(spark):
    # one name in every cell of a village, its variants only in one building and at one position
    rows = [(i, "공중화장실", 127.0 + (i % 5) * 0.01, 37.0 + (i // 5) * 0.01, 1000 + i, "", 0) for i in range(25)]
    rows += [(100, "공중 화장실", 127.0, 37.0, None, "", 0), (101, "공즁화장실", 127.02, 37.02, None, "", 0), (102, "공중화장싷", None, None, 1003, "", 0), (103, "공중화장실", 127.0003, 37.0, None, "", 0)]
    # a name of one place with rows in several cells is not common
    rows += [(200 + i, n, 127.0299 + 0.0002 * (i % 2), 37.0299 + 0.0002 * (i // 2), None, "", 0) for i, n in enumerate(("소다누사약국", "소다 누사약국", "서다누사약국", "소다누사 약국"))]
    assert entities(spark, rows) == [[0, 100], [3, 102], [12, 101], [200, 201, 202, 203]]


def brute_entities(rows, kinds):
    """Names of one building compared pair by pair, then joined."""
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    read = {r[0]: parse_name(r[1], BRANDS) for r in rows}
    for n, a in enumerate(rows):
        for b in rows[n + 1 :]:
            if a[4] != b[4]:
                continue
            for one in read[a[0]]:
                for two in read[b[0]]:
                    longer, shorter = max(len(one.stem), len(two.stem)), min(len(one.stem), len(two.stem))
                    most = 2 if longer >= 4 else 1 if longer == 3 else 0
                    apart = edit_distance(one.stem, two.stem, most)
                    if apart > most or one.branch != two.branch:
                        continue
                    same = one.kind == two.kind and (one.kind or one.rest == two.rest)
                    if same and (one.kind or apart <= 1) and shorter:
                        parent[root(a[0])] = root(b[0])
    found = {}
    for i in parent:
        found.setdefault(root(i), set()).add(i)
    return sorted(sorted(v) for v in found.values() if len(v) > 1)


@pytest.mark.parametrize("hot", [1000, 40, 5])
def test_names_agree_with_brute_force(spark, hot):
    """One crowded building: no link is lost by letter shards or by chunks of crowded shards."""
    random.seed(21)
    letters_of = "가나다라마바사아"
    rows = []
    for i in range(160):
        stem = [random.choice(letters_of) for _ in range(random.choice([3, 4, 5, 6]))]
        for turn in range(random.choice([1, 2])):
            if turn:
                at = random.randrange(len(stem))
                stem = random.choice([stem[:at] + stem[at + 1 :], stem[:at] + ["하"] + stem[at:], stem[:at] + ["호"] + stem[at + 1 :]])
            rows.append((len(rows), "".join(stem) + "약국", None, None, 7, "", 0))
    assert entities(spark, rows, hot_names=hot) == brute_entities(rows, KINDS)


def test_kinds_are_a_parameter(spark):
    rows = [(1, "소다누사등대", 127.0, 37.0, 7, "", 0), (2, "등대 소다누사", 127.0, 37.0, 7, "", 0), (3, "Sodanusa Lighthouse", 127.0, 37.0, 7, "", 0)]
    assert entities(spark, rows, kinds={"등대": ((), ("lighthouse",))}) == [[1, 2, 3]]
    assert entities(spark, rows[:2] + [(4, "소다누사등데", 127.0, 37.0, 7, "", 0)], kinds={}) == [[1, 4]]


def test_names_empty(spark):
    assert entities(spark, []) == []


# --- addresses --------------------------------------------------------------------------------------

DISTRICTS = ["가람구", "나래구"]


def parsed(spark, rows):
    frame = spark.createDataFrame(rows, "id bigint, new string, old string, extra string, gu string, road string, n int")
    return materialize(parse_addresses(frame, AddressFields("id", ("new", "old", "extra"), "gu"), city="한빛(?:특별시|시)?", districts=DISTRICTS))


@pytest.mark.parametrize(
    ("new", "old", "want"),
    [
        ("한빛특별시 나래구 내빛달로17길 154", None, ("나래", "내빛달로", "17/154/", None, None)), ("한빛특별시나래구내빛달로 13길 102", "", ("나래", "내빛달로", "13/102/", None, None)),
        ("나래구 내빛달로１７ gil １５４－２번 (예바동)", None, ("나래", "내빛달로", "17/154/2", "예바동", None)), (None, "한빛 나래구 예바동 35번지 1호", ("나래", None, None, "예바동", "/35/1")),
        (None, "(지번) 나래구 예바동 산 46의 2", ("나래", None, None, "예바동", "산/46/2")), ("한빛시나래구주빛해로12길1013층", None, ("나래", "주빛해로", "12/101/", None, None)),
        ("담서호로 41, 나래구, 한빛시", None, ("나래", "담서호로", "/41/", None, None)), ("", " ", (None, None, None, None, None)), ("가" * 100_000, None, (None, None, None, None, None)),
        (unicodedata.normalize("NFD", "나래구 담서호로 3길 4"), None, ("나래", "담서호로", "3/4/", None, None)),
    ],
)
def test_parse_address(spark, new, old, want):
    r = parsed(spark, [(1, new, old, None, None, "clash", 0)]).first()
    assert (r.gu, r.road, r.rno, r.dong, r.lot) == want


def test_buildings(spark):
    base = [(100 + n, f"나래구 내빛달로{n}길 {n}", f"나래구 예바동 {n}-1", None, "나래구", "", 0) for n in range(1, 9)]
    same = [
        (1, "한빛특별시 나래구 내빛달로3길 3", None, "2층", None, "", 0), (2, None, "한빛 예바동 3의 1", None, None, "", 0), (3, "내빛달루3길 3 (예바동)", "예바동 3번지 1호", None, None, "", 0),
        (4, "나래구 내달빛로3길 3", None, None, None, "", 0), (5, "내빛달로 3길 3, 나래구", None, None, None, "", 0),
    ]
    other = [(6, "나래구 내빛달로3길 3-1", None, None, None, "", 0), (7, None, "나래구 예바동 산 3-1", None, None, "", 0), (8, None, None, "내빛", None, "", 0), (9, "가람구 내빛달로3길 3", None, None, None, "", 0)]
    found = {}
    for r in buildings(parsed(spark, base + same + other)).collect():
        found.setdefault(r.building, set()).add(r.id)
    assert {1, 2, 3, 4, 5, 103} in found.values()
    assert {frozenset(v) for v in found.values() if v & {6, 7, 8, 9}} == {frozenset({6}), frozenset({7}), frozenset({9})}
    assert buildings(parsed(spark, [])).count() == 0


def test_frequent_misspellings_are_mended(spark):
    lots = [(1000 + n, None, f"나래구 예바동 {n}-1", None, "나래구", "", 0) for n in range(1, 201)]
    wrong = [(n, None, f"나래구 예비동 {n}-1", None, "나래구", "", 0) for n in range(1, 7)]
    other = [(2000 + n, None, f"나래구 예하동 {n}-1", None, "나래구", "", 0) for n in range(1, 61)]  # a name of its own: three times fewer, not far fewer
    both = [(3000, "나래구 내빛달로 3", "나래구 예바동 201-1", None, "나래구", "", 0), (3001, "나래구 담서호로 9", "나래구 예비동 201-1", None, "나래구", "", 0)]
    building = {r.id: r.building for r in buildings(parsed(spark, lots + wrong + other + both)).collect()}
    assert all(building[n] == building[1000 + n] for n in range(1, 7))
    assert all(building[2000 + n] != building[1000 + n] for n in range(1, 61))
    assert building[3000] != building[3001]


def test_building_pairs(spark):
    random.seed(6)
    rows = [(i, random.choice([1, 1, 1, 2, None]), random.choice("ab")) for i in range(120)]
    frame = spark.createDataFrame(rows, "id bigint, g bigint, t string")
    got = [tuple(r) for r in building_pairs(frame, id_column="id", group="g", text=F.col("t"), rows_per_salt=7).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] != b[2]}
    assert len(got) == len(set(got)) and set(got) == want


# --- packing ----------------------------------------------------------------------------------------


def test_pack_in_order():
    random.seed(9)
    sizes = [random.randrange(0, 11) for _ in range(500)]
    windows, closed = pack_in_order(sizes, 10, 4)
    fills = {}
    for size, window in zip(sizes, windows):
        fills[window] = fills.get(window, 0) + size
    assert max(fills.values()) <= 10 and len(fills) == len(closed) and closed.count(False) <= 4


@pytest.mark.parametrize("per_partition", [2, 500])
def test_pack_items(spark, per_partition):
    random.seed(10)
    sizes = {i: random.choice([0, 1, 5, 20, 50, 99, 100, 101, 350]) for i in range(800)}
    rows = [(i, s, "clash", 1) for i, s in sizes.items()] + [(900, None, "", 1), (901, -5, "", 1)]
    frame = spark.createDataFrame(rows, "id bigint, size bigint, container string, part int")
    got = pack_items(frame, id_column="id", size="size", capacity=100, open_windows=8, containers_per_partition=per_partition, fan_in=3).collect()
    again = pack_items(frame.repartition(7), id_column="id", size="size", capacity=100, open_windows=8, containers_per_partition=per_partition, fan_in=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    fills, parts = {}, {}
    for r in got:
        fills[r.container] = fills.get(r.container, 0) + r.size
        parts.setdefault(r.id, []).append((r.part, r.size))
    assert all(fills[r.container] == r.fill <= 100 for r in got)
    for i, s in (sizes | {900: 0, 901: 0}).items():
        sizes_of = [size for _, size in sorted(parts[i])]
        assert sum(sizes_of) == s and all(size == 100 for size in sizes_of[:-1]) and (s > 100 or len(sizes_of) == 1)
    assert len(fills) <= 1.1 * sum(sizes.values()) / 100 + 2


def test_pack_many_empty_items(spark):
    """Empty items stay where they are first laid and don't gather in the last task."""
    rows = [(i, 0) for i in range(3000)] + [(5000 + i, 7) for i in range(40)]
    for some in (rows, rows[:3000]):
        frame = spark.createDataFrame(some, "id bigint, size bigint")
        got = pack_items(frame, id_column="id", size="size", capacity=10, open_windows=3, items_per_partition=500, fan_in=2).collect()
        assert sorted(r.id for r in got) == sorted(i for i, _ in some)
        assert {r.container.split("-")[0] for r in got if r.size == 0} == {"0"}
        assert all(r.fill in (0, 7) for r in got) and (len(some) == 3000 or all(r.fill == 7 for r in got))


@pytest.mark.parametrize("per_partition", [1, 10, 10_000])
def test_one_method_at_every_size(spark, per_partition):
    """Most containers are closed while packing, whether there is one partition or many, and all are about as full."""
    random.seed(31)
    rows = [(i, random.randrange(1, 60)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id bigint, size bigint")
    got = pack_items(frame, id_column="id", size="size", capacity=100, open_windows=4, containers_per_partition=per_partition, fan_in=8).collect()
    names = {r.container for r in got}
    assert len([n for n in names if n.startswith("0-")]) > (0.4 if per_partition > 1 else -1) * len(names)
    assert sum(s for _, s in rows) / (100 * len(names)) > 0.95


def test_pack_nothing(spark):
    assert pack_items(spark.createDataFrame([], "id bigint, size bigint"), id_column="id", size="size", capacity=5).count() == 0


# --- mixing -----------------------------------------------------------------------------------------

TARGETS = [("a", 0.5, 1.0), ("b", 0.3, 3.0), ("c", 0.2, 2.0), ("none", 0.0, 1.0), (None, 0.1, 1.0)]


def mix(spark, rows, **more):
    records = spark.createDataFrame(rows, "id bigint, source string, size bigint, copies int, uniform double")
    targets = spark.createDataFrame(TARGETS, "source string, share double, cap double")
    return mix_sources(records, targets, id_column="id", source="source", size="size", share="share", cap="cap", **more)


def test_mixture(spark):
    random.seed(12)
    rows = [(i, random.choice(["a", "a", "b", "c", "x", None]), random.choice([0, None, 3, 10, 40]), 1, 0.5) for i in range(4000)]
    got = mix(spark, rows)
    shares = {r.source: r for r in got.shares.collect()}
    for source, share, cap in TARGETS[:3]:
        assert shares[source].actual_share == pytest.approx(share, abs=0.005) and shares[source].most_copies <= cap
    drawn = [tuple(r) for r in got.drawn.collect()]
    assert len({(i, c) for i, _, _, c, _ in drawn}) == len(drawn) and {s for _, s, *_ in drawn} == {"a", "b", "c"}
    assert sum(r[2] for r in drawn) == sum(r.drawn_size for r in shares.values())
    assert [r[4] for r in drawn] == sorted(r[4] for r in drawn)
    assert sorted(drawn) == sorted(map(tuple, mix(spark, rows[::-1]).drawn.collect()))
    half = mix(spark, rows, total_size=int(sum(r.drawn_size for r in shares.values()) / 2)).shares.collect()
    assert all(r.actual_share == pytest.approx(r.target_share, abs=0.01) for r in half if r.target_share)


def test_copy_steps():
    for rate in (1e-6, 0.3, 2.0, 40.0):
        for cap in (1, 2, 5):
            weights = [rate**k / math.factorial(k) for k in range(cap + 1)]
            want = [sum(weights[: k + 1]) / sum(weights) for k in range(cap)]
            assert copy_steps(rate, cap) == pytest.approx(want, rel=1e-12)
    for rate in (1e-300, 1e300, math.inf, 0.0, 1e9):
        steps = copy_steps(rate, 500)
        assert len(steps) == 500 and steps == sorted(steps) and 0 <= steps[0] and steps[-1] <= 1 and not any(map(math.isnan, steps))
    assert copy_steps(3.0, 0) == []


@pytest.mark.parametrize(("cap", "rate"), [(1.0, 0.0004), (300.0, 80.0), (40.0, 39.9)])
def test_mixture_with_rare_and_often_repeated_sources(spark, cap, rate):
    """Drawn sizes come as near the goal as single records allow, from a thousandth up to the cap."""
    random.seed(33)
    rows = [(i, "a", random.randrange(1, 20), 1, 0.5) for i in range(6000)]
    whole = sum(r[2] for r in rows)
    records = spark.createDataFrame(rows, "id bigint, source string, size bigint, copies int, uniform double")
    targets = spark.createDataFrame([("a", 1.0, cap)], "source string, share double, cap double")
    goal = int(whole * rate)
    got = mix_sources(records, targets, id_column="id", source="source", size="size", share="share", cap="cap", total_size=goal).shares.first()
    assert abs(got.drawn_size - goal) <= max(20, goal * 1e-4) and got.most_copies <= cap


def test_mixture_of_nothing(spark):
    got = mix(spark, [])
    assert got.drawn.count() == 0 and {r.actual_share for r in got.shares.collect()} == {0.0}


# --- splitting --------------------------------------------------------------------------------------

TEXTS = {
    1: "한 문장입니다. 또 한 문장입니다!\n" * 80, 2: "paragraph one is here.\r\n\r\nparagraph two, longer than one.\r\n" * 60, 3: "가나다라마바사아" * 700, 4: "", 5: None, 6: " " * 5000, 7: "\n" * 3000,
    8: "emoji 😀👩‍👩‍👧 and 'quotes' don't break; 1234567890 " * 90, 9: "short", 10: '{"a":["도담구",1.5,null],"b":"\\uac00"}' * 200, 11: unicodedata.normalize("NFD", "각난달람 ") * 400, 13: "." * 40_000 + "x" + " " * 40_000 + "y", 12: "a\r\n \t\n  b c\n" * 300,
}


LIMITS = [("fine", 60, 12), ("coarse", 300, 0), ("odd", 40, 100)]


def check_pieces(got, whole_of, size_of):
    """Pieces cover every text, keep the limit, and meet or overlap; ``whole_of(id)[a:b]`` is the text between offsets."""
    by = {}
    for r in got:
        by.setdefault((r.limit_name, r.id), []).append(r)
    for (name, i), pieces in by.items():
        most, overlap = next((m, o) for n, m, o in LIMITS if n == name)
        pieces.sort(key=lambda r: (r.start, r.end))
        assert pieces[0].start == 0 and pieces[-1].end == size_of(i)
        numbers = sorted({r.cut_no for r in pieces})
        assert numbers == list(range(len(numbers))) and [r.cut_no for r in pieces] == sorted(r.cut_no for r in pieces)
        for r, after in zip(pieces, [*pieces[1:], None]):
            assert r.piece == whole_of(i, r.start, r.end) and r.tokens == count(r.piece, VOCABULARY) <= most
            assert after is None or r.start < after.start <= r.end
            if after is not None and not overlap:
                assert after.start == r.end
    return by


@pytest.mark.parametrize(("chars", "halo", "segment"), [(16_384, 512, 256), (700, 60, 256), (700, 60, 3), (400, 40, 1)])
def test_split_texts(spark, chars, halo, segment):
    documents = spark.createDataFrame([(i, t, "clash", 1) for i, t in TEXTS.items()], "id bigint, text string, piece string, start int")
    frame = spark.createDataFrame(LIMITS, "name string, most int, overlap int")
    call = lambda **more: split_texts(documents, frame, id_column="id", text="text", name="name", max_tokens="most", overlap_tokens="overlap", range_chars=chars, halo_chars=halo, segment_ranges=segment, **more).collect()
    got = call()
    by = check_pieces(got, lambda i, a, b: TEXTS[i][a:b], lambda i: len(TEXTS[i]))
    assert set(by) == {(n, i) for n, most, _ in LIMITS for i, t in TEXTS.items() if count(t, VOCABULARY) > most}
    natural = [r for r in by["fine", 1] if re.search(r"[.!\n]\s*$", r.piece)]
    assert len(natural) == len(by["fine", 1])
    shared = [count(TEXTS[1][b.start : a.end], VOCABULARY) for a, b in zip(by["fine", 1], by["fine", 1][1:])]
    assert all(6 <= s <= 18 for s in shared)
    if segment == 256:  # short texts give the same pieces by ranges
        assert sorted(call(in_place_chars=0)) == sorted(got)


@pytest.mark.parametrize(("size", "segment"), [(1 << 20, 64), (900, 4)])
def test_split_files(spark, tmp_path, size, segment):
    contents = {f"{i}.txt": (t or "").encode() for i, t in TEXTS.items()} | {"broken.txt": ("가나 다라. ".encode() * 300)[1:-2] + b"\xff\xfe ok. " * 90}
    (tmp_path / "inner").mkdir()
    for n, (name, raw) in enumerate(contents.items()):
        (tmp_path / ("inner" if n % 2 else ".") / name).write_bytes(raw)
    frame = spark.createDataFrame(LIMITS, "name string, most int, overlap int")
    call = lambda *paths: split_files(spark, paths, frame, name="name", max_tokens="most", overlap_tokens="overlap", range_bytes=size, halo_bytes=80, segment_ranges=segment).collect()
    got = call(str(tmp_path))

    def text_of(i, a, b):
        piece = contents[i.rsplit("/", 1)[-1]][a:b].decode("utf-8", "surrogateescape")
        return re.sub("[\udc80-\udcff]", "\ufffd", piece)

    by = check_pieces(got, text_of, lambda i: len(contents[i.rsplit("/", 1)[-1]]))
    whole = {n: re.sub("[\udc80-\udcff]", "\ufffd", raw.decode("utf-8", "surrogateescape")) for n, raw in contents.items()}
    assert {(n, i.rsplit("/", 1)[-1]) for n, i in by} == {(n, i) for n, most, _ in LIMITS for i, t in whole.items() if count(t, VOCABULARY) > most}
    assert call(str(tmp_path / "4.txt")) == [] and call(str(tmp_path / "nothing*")) == []
    if size > 100_000:  # one range: the same pieces as of a table's row
        rows = spark.createDataFrame([(1, TEXTS[1])], "id bigint, text string")
        of_row = split_texts(rows, frame, id_column="id", text="text", name="name", max_tokens="most", overlap_tokens="overlap").collect()
        assert sorted((r.limit_name, r.cut_no, r.piece) for r in of_row) == sorted((r.limit_name, r.cut_no, r.piece) for r in got if r.id.endswith("/1.txt"))


def test_split_nothing(spark):
    documents = spark.createDataFrame([], "id bigint, text string")
    limits = spark.createDataFrame([("fine", 5, 1)], "name string, most int, overlap int")
    call = lambda d, l: split_texts(d, l, id_column="id", text="text", name="name", max_tokens="most", overlap_tokens="overlap").count()
    assert call(documents, limits) == 0 and call(spark.createDataFrame([(1, "a b c d e f g h")], "id bigint, text string"), limits.limit(0)) == 0


def test_boundary_table_agrees_with_the_tokenizer():
    for text in TEXTS.values():
        if text:
            ends, sizes, kinds = boundary_table(text, VOCABULARY)
            assert sizes.sum() == count(text, VOCABULARY) and ends[-1] == len(text)
            sure = [0, *[int(e) for e, k in zip(ends, kinds) if k >= 0]]
            for a, b in list(zip(sure, sure[1:]))[:40]:
                assert count(text[:a], VOCABULARY) + count(text[a:b], VOCABULARY) == count(text[:b], VOCABULARY)


def test_token_count(spark):
    rows = [(i, t) for i, t in TEXTS.items()]
    got = {r.id: r.n for r in spark.createDataFrame(rows, "id bigint, t string").select("id", token_count(F.col("t")).alias("n")).collect()}
    assert got == {i: count(t, VOCABULARY) for i, t in rows}
