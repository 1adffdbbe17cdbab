"""Scalars, telephone numbers, addresses and geometry."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strataquay.functions.geometry import flat_metres, metres_to_edge
from strataquay.functions.phone import DIALABLE, unusable_phone
from strataquay.functions.phone_rule import phone_issue
from strataquay.functions import scalars as S
from strataquay.functions.text import composed_hangul, is_blank, trimmed

GOOD = ["02-123-4567".replace("123", "234"), "02)2345-6789", "(02)234-5678", "031-234-5678", "070-1234-5678", "010-1234-5678", "1588-1234", "120", "1330", "02-120", "0212345678".replace("1", "3"),
        "02-2345-6789~12", "02-2345-6789 (내선 12)", "02-2345-6789/02-2345-6780", "02 - 2345 - 6789(안내)", "02.234.5678", "051-234-5678, 1644-0000", "0505-123-4567"]
BAD = ["2-2345-6789", "02-2345-67", "02-23-4567", "234-5678", "02-2345-67**", "없음", "-", "null", "http://a.kr", "02-2345-6789&nbsp;", "02-2345-6789%29", "O2-2345-6789", "2.35E+08", "02-2345-6789012", "233456789", "2120"]


@pytest.mark.parametrize("text", GOOD)
def test_dialable(text):
    assert re.match(DIALABLE, text)


@pytest.mark.parametrize("text", BAD)
def test_not_dialable(text):
    assert not re.match(DIALABLE, text)


def test_unusable_phone_column(spark):
    rows = [(t, False) for t in [*GOOD, None, "", " \t　"]] + [(t, True) for t in BAD] + [("1" * 100_000, True), (", ".join(["02-2345-6789"] * 20_000), False), (" " * 50_000 + "x", True), ("02-2345-6789" + " " * 50_000, False)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", unusable_phone(F.col("t")).alias("got")).where("got is null or got <> want").collect()
    assert got == []


def test_long_phone_values_are_judged_like_short_ones(spark, monkeypatch):
    from strataquay.functions import phone

    rows = [(t,) for t in [*GOOD, *BAD, " ", "02-2345-6789, 02-2345-6780 (안내)", "02-2345-6789, 2345"]]
    frame = spark.createDataFrame(rows, "t string")
    answers = []
    for long in (1000, 0):
        monkeypatch.setattr(phone, "_LONG", long)
        answers.append({r.t: r.v for r in frame.select("t", phone.unusable_phone(F.col("t")).alias("v")).collect()})
    assert {t: v for t, v in answers[0].items() if answers[1][t] != v} == {}


def test_phone_issue_grades(spark):
    cases = [
        ("", None, None), ("02-2245-8202", None, None), ("02-2258-4300,4100", None, None), ("02-2627-2503~4", None, None), ("120", None, None), ("02%29364-4686", "error", "02)364-4686"),
        ("http://x.kr", "error", None), ("null", "error", None), ("없음", "info", None), ("--", "info", None), ("2-2245-8202", "suspect", "02-2245-8202"), ("2245-8202", "suspect", None),
        ("0507-1494-2032", None, None), ("1566-6688", None, None), ("(02) 351-8673", None, None), ("063 275 9992", None, None), ("0336360601", None, None), ("02-2116-2491∼2503", None, None),
        ("02-448-3302 FAX : 02-448-6022", None, None), ("02-350-5141 (도담구시설관리공단)", None, None), ("관리부서:도담구 푸른도시과 02-2147-3380", None, None), ("02-820-9818,832-2445", None, None),
        ("070-7527-1316 010-7223-8254", None, None), ("02-120", None, None), ("-1533-2158", None, None), ("02%29%2B120", "error", "02)+120"), ("En-cry-pted", "error", None), ("a.kr가", "error", None),
        ("053\ufffd642\ufffd8078", "error", None), ("28159575", "suspect", None), ("010-7373", "suspect", None), ("1", "suspect", None), ("070-4224-192", "suspect", None), ("02-3999-219", "suspect", None),
        ("269563233", "suspect", "02-6956-3233"), (".", "info", None), ("업체미제공", "info", None), ("02-3800-948~950", "suspect", None), ("02-2256-6100-1", "suspect", None), ("558-0123, 558-0135", "suspect", None),
        ("1588-1775\n(2260-7311)", "suspect", None), ("82-2-2635-1900\r\n010-5441-2247", "suspect", None), ("0-533-4001", "suspect", None), ("02-766-7858%2B%2F%2B010", "error", "02-766-7858+/+010"), ("5031234567 02-123-4567", "suspect", "0503-123-4567"),
        ("02-224-82", "suspect", None), ("문의", "suspect", None), ("02-431-3535(3206)", None, None), ("02-12345-678", "suspect", None),
    ]
    frame = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", phone_issue(F.col("t")).alias("i"))
    got = {r.t: (r.i.severity, r.i.suggestion) if r.i else (None, None) for r in frame.collect()}
    assert got == {t: (s, g) for t, s, g in cases}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_text_scalars(spark):
    assert one(spark, trimmed(F.lit("　 a \t"))) == "a" and one(spark, trimmed(F.lit(None).cast("string"))) == ""
    assert one(spark, is_blank(F.lit(" 　\t"))) and not one(spark, is_blank(F.lit("x")))
    assert one(spark, S.normalized_name(F.lit("A-b 가　(나)!"))) == "ab가나"
    assert one(spark, S.without_spot(F.lit("정문(좌) 16동 1층"))) == "정문"
    for text, want in (("12", 12.0), (" 1.5e2 ", 150.0), ("12d", None), ("NaN", None), ("Infinity", None), ("0x10", None), ("", None), (".5", 0.5)):
        assert one(spark, S.parsed_number(F.lit(text))) == want
    assert one(spark, S.distance_text(F.lit(999.4))) == "999m" and one(spark, S.distance_text(F.lit(1234.0))) == "1.2km"
    assert one(spark, S.number_text(F.lit(127.0))) == "127"
    assert one(spark, S.run_tag(F.lit("2031-03-03T06:10"))) == "snap-2031-03-03-0610" and one(spark, S.tag_label(F.lit("snap-2031-03-03-0610"))) == "2031-03-03 06:10"
    assert one(spark, S.local_minute(F.lit("2026-01-01 15:05:59").cast("timestamp_ntz"))) == "2026-01-02T00:05"
    assert one(spark, S.decoded_url(F.lit("a%20b+c"))) == "a b c" and one(spark, S.decoded_url(F.lit("100%"))) is None and one(spark, S.decoded_url(F.lit("%FF"))) is None
    assert one(spark, S.similar_names(F.lit("가나다라마"), F.lit("가나다라바"))) and not one(spark, S.similar_names(F.lit("가나"), F.lit("가다")))
    for text in ("담서호로 19 길148 각", "", "abc", "한글A"):
        assert one(spark, composed_hangul(F.lit(unicodedata.normalize("NFD", text)))) == text
    status = [one(spark, S.coordinate_status(F.lit(x).cast("double"), F.lit(y).cast("double"))) for x, y in ((127, 37), (37, 127), (1, 1), (None, 37), (124, 33), (132, 39))]
    assert status == ["ok", "swapped", "outOfRange", "missing", "ok", "ok"]


def test_region_addresses(spark):
    cases = [
        ("", None, None), ("한빛특별시 나래구 1", True, "나래구"), ("한빛 나래구", True, "나래구"), ("한빛특별시", True, None), ("한빛나래구 1", True, "나래구"), ("한빛마을 1", None, None),
        ("나래구 2", True, "나래구"), ("나래구청 앞", None, None), ("경기도 수원", False, None), ("  한빛시　나래구 ", True, "나래구"), (None, None, None),
    ]
    area = S.parse_region_address(F.col("a"), city="한빛특별시|한빛시|한빛", districts=["가람구", "나래구"], elsewhere=["경기"], shared=["가람구"])
    got = spark.createDataFrame([(c[0],) for c in cases], "a string").select("a", area.alias("p")).collect()
    assert [(r.a, r.p.in_city, r.p.gu) for r in got] == cases
    assert one(spark, S.parse_region_address(F.lit("가람구 1"), city="한빛", districts=["가람구"], elsewhere=[], shared=["가람구"]))["ambiguous"]


def test_distances(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, flat_metres(*lit(127, 37, 127, 37.001))) == pytest.approx(111.195, abs=0.01)
    assert one(spark, metres_to_edge(*lit(127, 37.001, 126, 37, 128, 37))) == pytest.approx(111.195, abs=0.01)
    assert one(spark, metres_to_edge(*lit(127, 37, 127.001, 37, 127.001, 37))) == pytest.approx(88.8, abs=0.1)
    assert one(spark, metres_to_edge(*lit(127, 37, 127.001, 37, 127.002, 37))) == pytest.approx(88.8, abs=0.1)
