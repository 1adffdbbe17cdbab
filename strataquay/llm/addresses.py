"""Address records that denote the same building, however they are written.

Each record is split into components (district, road with number, lot with
number, named building).  A set-containment join fills missing parts: every
distinct address is indexed by its rarest token, fuller addresses probe with
all of theirs, and a match is kept if the weighted containment is high and no
component contradicts.  Misspelt road and neighbourhood names are first mended
against the names that far more places use.  Records tied through a shared road or lot
address, directly or by such a match, form one building.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composed_hangul
from ..operators.components import connected_components
from ..session import materialize

_WIDE = "０１２３４５６７８９－（），．～　 –—−"
_NARROW = "0123456789-(),.~  ---"


@dataclass(frozen=True)
class AddressFields:
    """Columns of an address record: identifier, address fields in order of preference, district hint."""

    id: str
    fields: tuple[str, ...]
    district_hint: str | None = None


def _plain(text: Column) -> Column:
    """Unified width, separators and marks."""
    out = F.translate(composed_hangul(F.coalesce(text, F.lit(""))), _WIDE, _NARROW)
    out = F.regexp_replace(F.regexp_replace(out, r"[\s\p{Z}]+", " "), r"(?i)gil", "길")
    # all repetitions are bounded, or long texts would be walked again from every letter
    out = F.regexp_replace(out, r"\(?\s*(?:지번|도로명)\s*(?:주소)?\s*[):]", " ")
    out = F.regexp_replace(out, r"[「」『』\[\]'\"“”‘’_·|/.]", " ")
    # a dash joins only digits; elsewhere it stands for a space
    out = F.regexp_replace(out, r"(?<![0-9 ])-|-(?![0-9 ])", " ")
    return F.trim(F.regexp_replace(out, r"[\s\p{Z}]+", " "))


def _nullable(text: Column) -> Column:
    return F.when(text != "", text)


def parse_addresses(rows: DataFrame, columns: AddressFields, *, city: str, districts: Sequence[str]) -> DataFrame:
    """``id`` and the components ``gu, road, rno, dong, lot, bld, hint``; parts not given are null.

    ``road`` is the road's name without its side number, ``rno`` the side, main
    and sub number (``11/163/``); ``lot`` main and sub number with a mark for
    mountain lots.  ``city`` is a pattern for the city's spellings, ``districts``
    the full district names (a small fixed list).  Null, empty or endless texts parse to nulls.
    """
    stems = sorted({d[:-1] for d in districts if d.endswith("구") and len(d) > 1}, key=lambda d: (-len(d), d))
    names = "|".join(stems) or "(?!)"
    texts = [_plain(F.col(c)) for c in columns.fields]
    rows = rows.select(
        F.col(columns.id).alias("id"),
        *[t.alias(f"_t{i}") for i, t in enumerate(texts)],
        (F.col(columns.district_hint) if columns.district_hint else F.lit(None).cast("string")).alias("hint"),
    )
    # the first letters are looked at before the names are tried one by one
    heads = f"(?=[{''.join(sorted({d[0] for d in stems}))}])" if stems else ""
    whole, bare = f"{heads}({names})구", f"(?:^|(?<=[ ,(])){heads}({names})(?=[ ,)]|$)"
    n = range(len(texts))
    # step by step, so that no pattern runs again where its result is used
    rows = rows.withColumns({f"_c{i}": F.regexp_replace(f"_t{i}", f"(?:^|(?<=[ ,(]))(?:{city})(?!대?로|길)", " ") for i in n})
    rows = rows.withColumns({f"_w{i}": F.regexp_extract(f"_c{i}", whole, 1) for i in n})
    rows = rows.withColumns({f"_b{i}": F.when(F.col(f"_w{i}") == "", F.regexp_extract(f"_c{i}", bare, 1)).otherwise("") for i in n})
    rows = rows.withColumns(
        {
            f"_r{i}": F.when(F.col(f"_w{i}") != "", F.regexp_replace(f"_c{i}", whole, " "))
            .when(F.col(f"_b{i}") != "", F.regexp_replace(f"_c{i}", bare, " "))
            .otherwise(F.col(f"_c{i}"))
            for i in n
        }
    )

    side = r"([가-힣]{1,12})\s*([0-9]{1,3})\s*길\s*([0-9]{1,7})(?:\s*-\s*([0-9]{1,6}))?(층|호)?"
    plain_road = r"([가-힣]{1,12}로)\s*([0-9]{1,4}+)(?:\s*-\s*([0-9]{1,6}))?(층|호)?(?!\s*길)"
    lot = r"([가-힣]{1,12}동)\s*(산)?\s*([0-9]{1,5})(?![0-9]*(?:층|호))(?:\s*(?:-|의)\s*([0-9]{1,4})|번지\s*([0-9]{1,4})\s*호)?"
    loose_lot = r"(?:^|[ ,])([가-힣]{2,6})\s*(산)?\s*([0-9]{1,5})(?:\s*(?:-|의)\s*([0-9]{1,4})|번지\s*([0-9]{1,4})\s*호|번지)"
    dong = r"(?:^|[ ,(])([가-힣]{2,6}동)(?=[ ,)]|$)"

    def number(main: Column, sub: Column, tail: Column) -> Column:
        """Main and sub number without a floor (one digit) or unit (three digits) glued to them."""
        cut = F.when(tail == "층", 1).when(tail == "호", 3).otherwise(0)
        kept = lambda n: F.expr("''") if n is None else n
        short_main = F.when((sub == "") & (F.length(main) > cut), F.substring(main, F.lit(1), F.length(main) - cut)).otherwise(main)
        short_sub = F.when((sub != "") & (F.length(sub) > cut), F.substring(sub, F.lit(1), F.length(sub) - cut)).otherwise(kept(sub))
        return F.concat_ws("/", short_main, short_sub)

    def marked(text: Column, pattern: str, count: int) -> Column:
        """The groups of the first match joined by bars, else the text, which has none."""
        return F.regexp_replace(text, f"(?s)^.*?{pattern}.*$", "|".join(f"${k}" for k in range(1, count + 1)))

    def groups(column: str) -> Column:
        return F.when(F.contains(column, F.lit("|")), F.split(column, r"\|"))

    def road_of(by_side: Column, by_road: Column) -> Column:
        return F.when(
            by_side.isNotNull(),
            F.struct(by_side[0].alias("road"), F.concat_ws("/", by_side[1], number(by_side[2], by_side[3], by_side[4])).alias("rno")),
        ).when(
            by_road.isNotNull(),
            F.struct(by_road[0].alias("road"), F.concat_ws("/", F.lit(""), number(by_road[1], by_road[2], by_road[3])).alias("rno")),
        )

    def lot_of(found: Column) -> Column:
        return F.when(
            found.isNotNull(),
            F.struct(found[0].alias("dong"), F.concat_ws("/", found[1], found[2], F.concat(found[3], found[4])).alias("lot")),
        )

    rest = [F.col(f"_r{i}") for i in n]
    # step by step, so that no pattern runs again where its groups are used
    rows = rows.withColumns({f"_side{i}": marked(rest[i], side, 5) for i in n} | {f"_lot{i}": marked(rest[i], lot, 5) for i in n})
    rows = rows.withColumns({f"_{kind}{i}": groups(f"_{kind}{i}") for kind in ("side", "lot") for i in n})
    rows = rows.withColumns({f"_plain{i}": F.when(F.col(f"_side{i}").isNull(), marked(rest[i], plain_road, 4)) for i in n})
    rows = rows.withColumns({f"_plain{i}": groups(f"_plain{i}") for i in n})
    roadless = [F.col(f"_side{i}").isNull() & F.col(f"_plain{i}").isNull() & F.col(f"_lot{i}").isNull() for i in n]
    rows = rows.withColumns({f"_loose{i}": F.when(roadless[i], marked(rest[i], loose_lot, 5)) for i in n})
    rows = rows.withColumns({f"_loose{i}": groups(f"_loose{i}") for i in n})
    rows = rows.withColumns(
        {
            "_road": F.coalesce(*[road_of(F.col(f"_side{i}"), F.col(f"_plain{i}")) for i in n]),
            "_lot": F.coalesce(*[lot_of(F.col(f"_{kind}{i}")) for kind in ("lot", "loose") for i in reversed(n)]),
            "_dong": F.coalesce(*[_nullable(F.regexp_extract(r, dong, 1)) for r in rest]),
        }
    )
    # a lone word and number, its ending misspelt, may be either; mending the name decides
    lone = r"(?:^|[ ,])([가-힣]{3,6})\s*([0-9]{1,4})(?:\s*-\s*([0-9]{1,4}))?(?![0-9층호])"
    spare = F.coalesce(*[F.when(F.rlike(r, F.lit(lone)), r) for r in rest])
    word, digits = F.regexp_extract(spare, lone, 1), F.concat_ws("/", F.lit(""), F.regexp_extract(spare, lone, 2), F.regexp_extract(spare, lone, 3))
    neither = F.col("_road").isNull() & F.col("_lot").isNull() & spare.isNotNull()
    rows = rows.withColumns(
        {
            "_road": F.coalesce("_road", F.when(neither, F.struct(word.alias("road"), digits.alias("rno")))),
            "_lot": F.coalesce("_lot", F.when(neither, F.struct(word.alias("dong"), digits.alias("lot")))),
        }
    )
    return rows.select(
        "id",
        F.coalesce(*[_nullable(F.col(f"_{kind}{i}")) for i in n for kind in "wb"]).alias("gu"),
        F.col("_road.road").alias("road"),
        F.col("_road.rno").alias("rno"),
        F.coalesce("_lot.dong", "_dong").alias("dong"),
        F.col("_lot.lot").alias("lot"),
        F.regexp_replace("hint", "구$", "").alias("hint"),
    )


def _one_apart(names: DataFrame) -> DataFrame:
    """``kind, name, right_name``: rare names of ``names(kind, name, places, weight)`` one letter or one swap of neighbours from a known one.

    A rare name has at most a third of the known one's places, or of its weight, and beyond three
    (chance) at most a 32nd: wrong spellings are a small share of a name at every size, and other names are not.
    """
    cuts = F.expr("transform(sequence(1, length(name)), i -> concat(substring(name, 1, i - 1), substring(name, i + 1)))")
    variants = names.select("*", F.explode(F.array_distinct(F.array_append(cuts, F.col("name")))).alias("_cut"))
    rare = variants.select("kind", "name", F.col("places").alias("_few"), F.col("weight").alias("_light"), "_cut")
    known = variants.select("kind", F.col("name").alias("right_name"), F.col("places").alias("_many"), F.col("weight").alias("_heavy"), "_cut")
    far_less = lambda few, many: F.col(many) >= F.greatest(F.lit(3), 3 * F.col(few), 32 * (F.col(few) - 3))
    swapped = (F.length("name") == F.length("right_name")) & (F.levenshtein("name", "right_name") == 2) & (
        F.array_sort(F.split("name", "")) == F.array_sort(F.split("right_name", ""))
    )
    return (
        rare.join(known.hint("merge"), ["kind", "_cut"])
        .where((F.col("name") != F.col("right_name")) & (far_less("_few", "_many") | (far_less("_light", "_heavy") & (F.col("_few") > 3))))
        .where((F.levenshtein("name", "right_name") <= 1) | swapped)
        .select("kind", "name", "right_name")
        .distinct()
    )


_COMPONENTS = ("gu", "road", "rno", "dong", "lot")


def buildings(parsed: DataFrame, *, containment: float = 0.8) -> DataFrame:
    """``id, building`` for every parsed record with a road or a lot number.

    ``parsed`` comes from :func:`parse_addresses` and should be a written
    table.  Records without any number have no row; empty input gives none.
    """
    with_number = parsed.where(F.col("rno").isNotNull() | F.col("lot").isNotNull())
    forms = materialize(
        with_number.groupBy(*_COMPONENTS)
        .agg(F.count(F.lit(1)).alias("n"), F.mode("hint", deterministic=True).alias("hint"))
        .withColumn("form", F.xxhash64(*[F.coalesce(c, F.lit("\x01")) for c in _COMPONENTS]))
    )
    # tables that grow with the addresses are joined by merging (hinted), never broadcast through the driver
    # --- mend rare spellings of road and neighbourhood names, both in one pass --------------
    def part(kind: str, number: str, other: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.col(number).alias("number"), F.col(other).alias("other"))

    lone = F.coalesce(F.col("road") == F.col("dong"), F.lit(False))
    parts = forms.select(
        "form", "gu", "n", lone.alias("_lone"), F.explode(F.array(part("road", "rno", "lot"), part("dong", "lot", "rno"))).alias("_p")
    ).select("form", "gu", "n", "_lone", "_p.*").where("name is not null and number is not null")
    # places saturate where the same numbers come again and again, rows lean to one crowded number: the weight does neither
    known = materialize(
        parts.groupBy("kind", "name", "number").agg(F.sum("n").alias("_n"), F.collect_set("gu").alias("_gus"), F.collect_set("other").alias("_others"))
    )
    names = materialize(known.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("places"), (F.count(F.lit(1)) * F.median("_n")).alias("weight")))
    mended = materialize(_one_apart(names))
    agrees = F.col("gu").isNull() | (F.size("_gus") == 0) | F.array_contains("_gus", F.col("gu"))
    # an address with both numbers isn't mended to a name whose own other numbers differ, but for a lone word, which is only one of both
    speaks = F.col("_lone") | F.col("other").isNull() | (F.size("_others") == 0) | F.array_contains("_others", F.col("other"))
    options = (
        parts.join(mended, ["kind", "name"])
        .join(known.select("kind", F.col("name").alias("right_name"), "number", "_gus", "_others").hint("merge"), ["kind", "right_name", "number"])
        .where(agrees & speaks)
        .select("form", "kind", "right_name", F.coalesce(F.array_contains("_others", F.col("other")), F.lit(False)).cast("int").alias("_fit"))
    )
    # the one spelling left, preferring those whose other number fits; none if they tie
    best = options.groupBy("form", "kind").agg(F.max("_fit").alias("_top"), F.collect_set(F.struct("_fit", "right_name")).alias("_all")).withColumn(
        "_all", F.filter("_all", lambda o: o["_fit"] == F.col("_top"))
    ).where(F.size("_all") == 1)
    chosen = best.groupBy("form").agg(*[F.max(F.when(F.col("kind") == k, F.col("_all")[0]["right_name"])).alias(f"_{k}") for k in ("road", "dong")])
    forms = materialize(
        forms.join(chosen.hint("merge"), "form", "left").withColumns({"road": F.coalesce("_road", "road"), "dong": F.coalesce("_dong", "dong")}).drop("_road", "_dong")
    )
    # --- a road or neighbourhood that lies in one district names it ------------------------
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in ("road", "dong")])
    by_gu = forms.where("gu is not null").select("gu", "n", F.explode(kinds).alias("_p")).select("gu", "n", "_p.*").where("name is not null").groupBy("kind", "name", "gu").agg(F.sum("n").alias("_n"))
    # a name's districts are a short list
    whole = by_gu.groupBy("kind", "name").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "gu")).alias("_most"))
    home = materialize(whole.where(F.col("_most._n") >= 0.9 * F.col("_all")).select("kind", "name", F.col("_most.gu").alias("_gu")))
    of = lambda kind: home.where(F.col("kind") == kind).select(F.col("name").alias(kind), F.col("_gu").alias(f"_{kind}_gu"))
    forms = materialize(
        forms.join(of("road"), "road", "left").join(of("dong"), "dong", "left")
        .withColumn("gu", F.coalesce("gu", F.when(F.col("rno").isNotNull(), F.col("_road_gu")), "_dong_gu"))
        .drop("_road_gu", "_dong_gu")
    )
    # --- set containment: index by the rarest token, probe from fuller addresses -----------
    token = lambda kind, *parts: F.when(
        F.greatest(*[F.col(p).isNull().cast("int") for p in parts]) == 0 if len(parts) > 1 else F.col(parts[0]).isNotNull(),
        F.concat_ws("|", F.lit(kind), *parts),
    )
    spelled = forms.withColumn(
        "tokens", F.array_compact(F.array(token("g", "gu"), token("d", "dong"), token("w", "road"), token("r", "road", "rno"), token("l", "dong", "lot")))
    )
    listed = spelled.select("form", F.explode("tokens").alias("token"))
    common = listed.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    weighed = materialize(
        listed.join(common.hint("merge"), "token")
        .groupBy("form")
        .agg(F.array_sort(F.collect_list(F.struct("_df", "token"))).alias("_ranked"))
        .join(spelled.drop("tokens").hint("merge"), "form")
        .withColumn("tokens", F.transform("_ranked", lambda t: t["token"]))
        .withColumn("rarest", F.get(F.filter("tokens", lambda t: F.rlike(t, F.lit("^[rl]"))), 0))
        .withColumn("weights", F.transform("_ranked", lambda t: 1.0 / F.log2(1.0 + t["_df"])))
        .drop("_ranked")
    )
    partial = weighed.where("gu is null or rno is null or lot is null")
    full = weighed.select(
        F.col("form").alias("f_form"), F.col("tokens").alias("f_tokens"), F.size("tokens").alias("f_size"),
        *[F.col(c).alias(f"f_{c}") for c in _COMPONENTS], F.explode("tokens").alias("rarest"),
    ).where(F.rlike("rarest", F.lit("^[rl]")))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.size("tokens")),
        F.lit(0.0),
        lambda s, i: s + F.when(F.array_contains("f_tokens", F.element_at("tokens", i)), F.element_at("weights", i)).otherwise(0.0),
    )
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    against = [F.col(c).isNotNull() & F.col(f"f_{c}").isNotNull() & (F.col(c) != F.col(f"f_{c}")) for c in ("gu", "lot", "rno")]
    contradicts = against[0] | against[1] | against[2]
    met = (
        partial.join(full.hint("merge"), "rarest")
        .where((F.col("f_form") != F.col("form")) & (F.col("f_size") > F.size("tokens")) & ~contradicts)
        .where(shared >= containment * total)
        .select("form", "gu", "hint", "f_form", "f_gu", "rarest")
    )
    # without a district of its own an address may fit buildings in several: its record's hint decides, or nothing
    choices = met.groupBy("form").agg((F.min("f_gu").eqNullSafe(F.max("f_gu"))).alias("_single"))
    links = met.join(choices.hint("merge"), "form").where(F.col("gu").isNotNull() | F.col("_single") | (F.col("hint") == F.col("f_gu"))).select("form", "f_form")

    # --- buildings: addresses tied by a shared road number, lot number or containment -------
    key = lambda *parts: F.xxhash64(*[F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit("\x01")) for p in parts])
    keyed = (
        weighed.where("rno is not null").select("form", key(F.lit("r"), "gu", "road", "rno").alias("_key"))
        .unionByName(weighed.where("lot is not null").select("form", key(F.lit("l"), "gu", "dong", "lot").alias("_key")))
    )
    # only keys that several addresses share tie anything: each of these to the smallest of them
    shared_keys = keyed.groupBy("_key").agg(F.min("form").alias("_low"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    edges = (
        keyed.join(shared_keys.hint("merge"), "_key").where("form <> _low").select(F.col("form").alias("a"), F.col("_low").alias("b"))
        .unionByName(links.select(F.col("form").alias("a"), F.col("f_form").alias("b")))
    )
    labels = connected_components(edges)
    original = with_number.withColumn("form", F.xxhash64(*[F.coalesce(c, F.lit("\x01")) for c in _COMPONENTS])).select("id", "form")
    return original.join(labels.hint("merge"), original.form == labels.node, "left").select("id", F.coalesce("component", "form").alias("building"))


def building_pairs(members: DataFrame, *, id_column: str, group: str, text: Column, rows_per_salt: int = 1000) -> DataFrame:
    """``id_a < id_b`` of one group whose ``text`` differs; large groups are split over salts."""
    rows = members.select(F.col(id_column).alias("_id"), F.col(group).alias("_g"), text.alias("_t"))
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        "_g", F.ceil(F.col("_n") / F.lit(rows_per_salt)).cast("int").alias("_salts")
    )
    sized = materialize(rows.join(sizes.hint("merge"), "_g"))
    left = sized.select("_g", F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int").alias("_salt"), F.col("_id").alias("a"), F.col("_t").alias("_ta"))
    right = sized.select("_g", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.col("_id").alias("b"), F.col("_t").alias("_tb"))
    return left.join(right.hint("merge"), ["_g", "_salt"]).where("a < b and _ta <> _tb").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
