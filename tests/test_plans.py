"""Rules, diffs, history, sources and the stream on small inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strataquay.operators.diffs import field_changes, finding_changes, hashed_rows, key_changes, snapshot_hashes, stored_hashes
from strataquay.plans import catalogue
from strataquay.plans import rules as R
from strataquay.plans.facts import SNAPSHOT_ROLES, build_facts, row_keys
from strataquay.plans.history import with_departments
from strataquay.plans.published import RunStore, of_runs
from strataquay.plans.rule_queries import FIELDS, SCOPE
from strataquay.sources import pages as P
from strataquay.sources import store
from strataquay.streaming.runs import stream_snapshot_changes

SQUARE = lambda x, y, n: (n, 1, [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]])
COLUMNS = [SNAPSHOT_ROLES.id, SNAPSHOT_ROLES.name, SNAPSHOT_ROLES.category, SNAPSHOT_ROLES.geometry, SNAPSHOT_ROLES.region, SNAPSHOT_ROLES.address_new, SNAPSHOT_ROLES.address_old, SNAPSHOT_ROLES.phone, SNAPSHOT_ROLES.image]


def rule_input(spark, rows):
    schema = "row_id bigint, run_tag string, cot_theme_id string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", cot_coord_x double, cot_coord_y double"
    data = []
    for n, given in enumerate(rows):
        base = {"cot_conts_id": f"id{n}", "cot_conts_name": f"place {n}", "cot_theme_sub_id": "1", "cot_coord_type": "1", "cot_gu_name": "가람구", "cot_tel_no": "", "cot_img_main_url": "", "cot_coord_x": 127.5 + n * 0.01, "cot_coord_y": 37.5} | given
        data.append((n, "r", "t", *[base.get(c) for c in COLUMNS], base["cot_coord_x"], base["cot_coord_y"]))
    frame = spark.createDataFrame(data, schema)
    regions = spark.createDataFrame([SQUARE(127.0, 37.0, "가람구"), SQUARE(128.0, 37.0, "나래구")], "gu_name string, polygon_no int, coordinates array<array<array<double>>>")
    facts = build_facts(frame, regions, SNAPSHOT_ROLES, city="한빛시|한빛", region_name="gu_name", region_part="polygon_no", rings="coordinates")
    return R.RuleInput(facts=facts, rows=frame, regions=regions, scope=SCOPE, row="row_id", content=("cot_conts_name", "cot_coord_x", "cot_tel_no"), fields=FIELDS)


def grades(frame):
    return sorted((r.conts_key, r.severity, r.suggestion) for r in frame.collect())


def test_coordinates(spark):
    i = rule_input(spark, [{"cot_coord_x": None}, {"cot_coord_x": 37.5, "cot_coord_y": 127.5}, {"cot_coord_x": 1.0}, {"cot_coord_x": float("nan")}, {}])
    assert [r[0] for r in grades(R.row_findings(i, [("", R.missing_coordinate)]))] == ["id0", "id3"]
    assert grades(R.row_findings(i, [("", R.swapped_coordinate)])) == [("id1", "error", "127.500000, 37.500000")]
    assert [r[0] for r in grades(R.row_findings(i, [("", R.out_of_range)]))] == ["id2"]


def test_regions(spark):
    rows = [
        {"cot_gu_name": "나래구", "cot_addr_full_new": "한빛시 가람구 1"},  # the address agrees with the coordinates
        {"cot_gu_name": "나래구", "cot_addr_full_new": "한빛시 나래구 1"},  # the address agrees with the name
        {"cot_gu_name": "서초", },  # no known district
        {"cot_gu_name": "나래구", "cot_coord_x": 127.9999},  # within the tolerance of the border
        {"cot_gu_name": ""},
        {"cot_coord_x": 129.5, "cot_addr_full_new": "한빛시 가람구 1"},
        {"cot_coord_x": 129.6, "cot_gu_name": "x", "cot_addr_full_new": "경기 1"},
        {"cot_coord_x": 129.00001},
        {"cot_addr_full_new": "한빛시 나래구 1"},
    ]
    i = rule_input(spark, rows)
    assert grades(R.region_against_coordinate(i)) == [("id0", "error", "가람구"), ("id1", "suspect", None), ("id2", "suspect", "가람구")]
    assert grades(R.region_blank(i)) == [("id4", "info", "가람구")]
    found = R.outside_city(i).collect()
    assert sorted((r.conts_key or "", r.severity) for r in found) == [("", "info"), ("id5", "error")]
    assert [(r.conts_key, r.field) for r in R.region_against_address(i).collect()] == [("id8", "cot_addr_full_new")]


def test_duplicates(spark):
    spot = {"cot_coord_x": 127.5}
    i = rule_input(spark, [spot | {"cot_conts_name": "큰 나무 공원 안내소"}, spot | {"cot_conts_name": "큰나무공원안내소"}, spot | {"cot_conts_name": "큰나무공원안내수"}, spot | {"cot_conts_name": "다른 곳"},
                           spot | {"cot_conts_name": "쉼터 1층"}, spot | {"cot_conts_name": "쉼터 2층"}, {"cot_conts_id": "id0"}])
    assert {r.conts_key for r in R.similar_name_at_point(i).collect()} == {"id0#1", "id1", "id2"}
    assert {r.conts_key for r in R.row_findings(i, [("", R.duplicate_id)]).collect()} == {"id0#1", "id0#2"}
    near = rule_input(spark, [{"cot_conts_name": "갑", "cot_coord_x": 127.5}, {"cot_conts_name": "갑", "cot_coord_x": 127.5002}, {"cot_conts_name": "갑", "cot_coord_x": 127.6}])
    assert {(r.conts_key, r.group_key) for r in R.near_same_name(near).collect()} == {("id0", "near:id0"), ("id1", "near:id0")}
    same = rule_input(spark, [{"cot_conts_name": "x", "cot_coord_x": 127.5, "cot_conts_id": c} for c in ("b", "a", "c")])
    assert {r.group_key for r in R.same_content(same).collect()} == {"same:a"}


def test_shared_image_is_inclusive_at_half(spark):
    i = rule_input(spark, [{"cot_img_main_url": u} for u in ("a", "a", "b", "")])
    assert [(r.value, r.conts_key) for r in R.shared_image(i).collect()] == [("a", None)]
    assert R.shared_image(rule_input(spark, [{"cot_img_main_url": "a"}] * 2)).count() == 0


def test_runner_names_fingerprints_and_replacement(spark):
    i = rule_input(spark, [{"cot_conts_name": ""}, {"cot_tel_no": "없음"}])
    replaced = spark.createDataFrame([("t", "C-11")], "cot_theme_id string, rule_id string")
    found = {(r.rule_id, r.fingerprint, r.name) for r in R.run_rules(R.COMMON_RULES, i, replaced=replaced).collect()}
    assert found == {("C-10", "C-10|t|id1||cot_tel_no", "place 1")}
    assert R.run_rules(R.COMMON_RULES, rule_input(spark, [{}]).__class__(**{**i.__dict__, "facts": i.facts.limit(0), "rows": i.rows.limit(0)})).count() == 0


def test_messages_list_five_keys(spark):
    i = rule_input(spark, [{"cot_conts_name": "x", "cot_coord_x": 127.5} for _ in range(7)])
    found = R.same_content(i).collect()
    assert len(found) == 7 and {r.message for r in found} == {"7 rows have the same content: id0, id1, id2, id3, id4 and 2 more"}
    assert {r.message for r in R.run_rules(R.COMMON_RULES, rule_input(spark, [{"cot_tel_no": "1"}])).collect()} == {"the number of digits is wrong"}


def test_runs_are_published_once(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"r{n % 2}", f"{n}") for n in range(6)], "row_id bigint, run_tag string, v string")
    rows.where("run_tag = 'r0'").coalesce(1).write.parquet(f"{tmp_path}/snapshots.parquet")
    spark.range(1).write.parquet(f"{tmp_path}/district_boundaries.parquet")
    asked = []

    def build(tags):
        asked.append(sorted(tags, key=str))
        return spark.read.parquet(f"{tmp_path}/snapshots.parquet").where(of_runs(F.col("run_tag"), tags)).withColumn("seen", F.lit(len(asked)))

    call = lambda: {(r.row_id, r.run_tag, r.seen) for r in RunStore(spark, str(tmp_path)).read("kind", build).collect()}
    first = {(n, "r0", 1) for n in (0, 2, 4)}
    assert call() == first and call() == first and asked == [["r0"]]
    rows.where("run_tag = 'r1'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/snapshots.parquet")
    assert call() == first | {(n, "r1", 2) for n in (1, 3, 5)} and asked == [["r0"], ["r1"]]
    # a late row touches its run alone; a run without a tag is one of its own
    spark.createDataFrame([(8, "r1", "late"), (9, None, "none")], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/snapshots.parquet")
    assert {n for n, *_ in call()} == {0, 1, 2, 3, 4, 5, 8, 9} and asked[2:] == [[None, "r1"]]


def test_row_keys_do_not_depend_on_order(spark):
    rows = [(n, "s", "a" if n % 3 else None) for n in range(12)]
    keys = [
        {r.n: r.key for r in row_keys(spark.createDataFrame(rows[::step], "n int, s string, i string"), scope=["s"], id_column="i", order=["n"]).collect()} for step in (1, -1)
    ]
    assert keys[0] == keys[1] and keys[0][0] == "#1"


def test_hash_and_diff(spark):
    schema = "g string, run string, key string, a string, x double"
    rows = [("g", "r0", "1", "v", 1.0), ("g", "r0", "2", None, 2.0), ("g", "r1", "1", "v", 1.0), ("g", "r1", "2", "", 2.0), ("g", "r1", "3", "v", None)]
    frame = spark.createDataFrame(rows, schema)
    hashes = lambda f: {r.run: r.content_hash for r in snapshot_hashes(f, scope=["run"], columns=["key", "a", "x"]).collect()}
    assert hashes(frame) == hashes(frame.orderBy(F.desc("key")).repartition(3)) and len(set(hashes(frame).values())) == 2
    pairs = spark.createDataFrame([("g", "r0", "r1"), ("g", "r0", "r0")], "g string, prev_run string, run string")
    hashed = lambda dates: hashed_rows(frame, keep=["g", "run", "key"], columns=["a", "x"], dates=dates)
    for dates, kind in ((["x"], "modified"), (["a"], "dates_only")):
        changes = key_changes(hashed(dates), pairs, group="g", load="run", key="key")
        assert {(r.key, r.change) for r in changes.collect()} == {("2", kind), ("3", "added")}
        fields = field_changes(frame, changes, group="g", load="run", key="key", columns=["a", "x"]).collect()
        assert [(r.key, r.column, r.before, r.after) for r in fields] == [("2", "a", None, "")]
    findings = spark.createDataFrame([("f", "error"), ("f", "info"), ("g", "info")], "fingerprint string, severity string")
    later = spark.createDataFrame([("f", "info"), ("h", "info")], "fingerprint string, severity string")
    got = {(r.fingerprint, r.change) for r in finding_changes(findings, later, keys=[]).collect()}
    assert got == {("f", "severity_changed"), ("g", "resolved"), ("h", "added")}


def page(total, rows, **head):
    return json.dumps({"header": {"resultCode": "200", "TOTAL_COUNT": total, "PAGE_SIZE": 2, **head}, "body": [{"i": n} for n in range(rows)]})


def test_page_states(spark):
    loads = {
        "ok": [(200, page("3", 2, PAGE_NO="1")), (200, page(3, 1, PAGE_NO=2))], "total": [(200, page(3, 2)), (200, page(4, 1))], "number": [(200, page(3, 2)), (200, page(3, 1, PAGE_NO=5))],
        "gap": [(200, page(2, 2)), (200, page(2, 0)), (200, page(2, 0))], "short": [(200, page(9, 2))], "refused": [(400, json.dumps({"head": {"RETCODE": "400"}}))],
        "html": [(200, "<html>")], "down": [(500, "")], "none": [(200, json.dumps({"header": {"resultCode": "100", "TOTAL_COUNT": 0}, "body": []}))],
    }
    rows = [(name, n, status, body) for name, some in loads.items() for n, (status, body) in enumerate(some, 1)]
    frame = P.read_envelopes(spark.createDataFrame(rows, "load string, page_no int, http_status int, body string"))
    got = {r.load: r.state for r in P.page_states(frame, keys=["load"], page_size=2).collect()}
    assert got == {"ok": "ok", "total": "incomplete", "number": "incomplete", "gap": "incomplete", "short": "incomplete", "refused": "unavailable", "html": "error", "down": "error", "none": "ok"}


def test_retries_and_reader(spark, tmp_path):
    waits, answers = [], iter([(500, ""), OSError("secret"), (200, "x")])

    def get(params):
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert P.retrying(get, sleep=waits.append)({}) == (200, "x") and waits == [1.0, 4.0]
    with pytest.raises(RuntimeError) as problem:
        P.retrying(lambda p: (503, "key=abc"), retries=1, sleep=waits.append)({"key": "abc"})
    assert "abc" not in str(problem.value)
    for number, body in enumerate((page(3, 2), page(3, 1)), 1):
        (tmp_path / f"t-{number}.json").write_text(body)
    spark.dataSource.register(P.PagedThemes)
    read = spark.read.format("paged_themes").option("folder", str(tmp_path)).option("themes", "t,absent").option("wait", "0").load()
    assert sorted((r.theme, r.attempt, r.page_no, r.http_status) for r in read.collect()) == [("absent", 1, 1, 404), ("t", 1, 1, 200), ("t", 1, 2, 200)]
    (tmp_path / "t-2.json").write_text(page(3, 0))
    assert {(r.attempt, r.page_no) for r in read.collect() if r.theme == "t"} == {(2, 1), (2, 2)}  # incomplete: asked once more
    assert P.query_text({"a": "x y", "b": "가&"}) == "a=x%20y&b=%EA%B0%80%26"


def test_theme_and_department_lists():
    pages = {("1", "1"): page(3, 2, PAGE_COUNT=2), ("1", "2"): page(3, 1, PAGE_COUNT=2), ("2", "1"): page(None, 0), ("4", "1"): json.dumps({"head": {}, "body": [{"i": 9}]})}
    asked = []

    def get(params):
        asked.append((params["type"], params["page"]))
        return 200, pages[asked[-1]]

    assert [e["i"] for e in P.fetch_theme_list(get, types=("1", "2", "4"), page_size=2)] == [0, 1, 0, 9] and asked == list(pages)
    for answer in ((503, ""), (200, "{}"), (200, "[]"), (400, json.dumps({"header": {"resultMsg": "no key"}}))):
        with pytest.raises(RuntimeError) as problem:
            P.fetch_theme_list(lambda params: answer, types=("1",))  # noqa: B023
        assert "size" not in str(problem.value)
    key = "0123456789abcdef" * 2
    posted = []
    got = P.fetch_departments(lambda path: f"var k = '{key}';", lambda path, form: posted.append((path, form)) or '{"body": [{"a": 1}]}', script="s", form="f")
    assert got == [{"a": 1}] and posted == [("f", {"key": key})]
    for script, body in (("none", '{"body": []}'), (f'"{key}"', "<html>"), (f'"{key}"', '{"body": 1}'), (f'"{key}"', "[]")):
        with pytest.raises(RuntimeError):
            P.fetch_departments(lambda path: script, lambda path, form: body, script="s", form="f")  # noqa: B023


def test_departments_of_the_catalogue(spark):
    catalogue_of = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "cot_theme_id string, department string")
    fresh = spark.createDataFrame([("a", "new"), ("b", None)], "cot_theme_id string, department string")
    show = lambda f: sorted(tuple(r) for r in f.collect())
    assert show(with_departments(catalogue_of, fresh, catalogue_of)) == [("a", "new", False), ("b", "unknown", False), ("c", "unknown", False)]
    assert show(with_departments(catalogue_of, None, catalogue_of)) == [("a", "x", True), ("b", "y", True), ("c", "unknown", False)]


def test_two_column_sets_are_united(spark):
    """A column that one state lacks is null there and shows as a change."""
    before = spark.createDataFrame([("g", "r0", "1", "v", "old")], "g string, run string, key string, a string, gone string")
    after = spark.createDataFrame([("g", "r1", "1", "v", "new")], "g string, run string, key string, a string, came string")
    keyed = before.unionByName(after, allowMissingColumns=True)
    pairs = spark.createDataFrame([("g", "r0", "r1")], "g string, prev_run string, run string")
    columns = ["a", "gone", "came"]
    changes = key_changes(hashed_rows(keyed, keep=["g", "run", "key"], columns=columns), pairs, group="g", load="run", key="key")
    assert sorted((r.column, r.before, r.after) for r in field_changes(keyed, changes, group="g", load="run", key="key", columns=columns).collect()) == [("came", None, "new"), ("gone", "old", None)]


def test_stored_hash(spark):
    rows = [("s", "b", "x", 2), ("s", "a", None, 1), ("s", "a", 'q"/가', 3), ("t", None, "z", None), (None, "k", "", 0)]
    frame = spark.createDataFrame(rows, "run string, id string, t string, n bigint")
    want = {}
    for scope in ("s", "t", None):
        lines = sorted(((r[1] or ""), json.dumps([r[1], r[3], r[2]], ensure_ascii=False, separators=(",", ":"))) for r in rows if r[0] == scope)
        text = '{"columns":["id","n","t"],"rows":[' + ",".join(line for _, line in lines) + "]}"
        want[scope] = (len(lines), hashlib.sha256(text.encode()).hexdigest())
    got = lambda f: {r.run: (r.rows, r.stored_hash) for r in stored_hashes(f, scope=["run"], columns=["t", "id", "n"], id_column="id").collect()}
    assert got(frame) == got(frame.orderBy(F.desc("t")).repartition(3)) == want and got(frame.limit(0)) == {}


def test_catalogue_helpers(spark):
    listed = spark.createDataFrame([(1, "a", " A ", "1", "4"), (2, "a", "later", "1", "4"), (3, "", "x", "1", "4"), (4, "b", "B", "0", "4")], "n int, THM_THEME_ID string, THM_THEME_NAME string, THM_THEME_STAT string, THM_THEME_TYPE string")
    assert [tuple(r) for r in P.public_themes(listed, order="n").collect()] == [("a", "A", "4")]
    items = spark.createDataFrame([(1, "a", "1", "x", "y"), (2, "a", "1", " p ", ""), (3, "b", None, "", None)], "n int, THM_THEME_ID string, THM_MNG_TYPE_01 string, THM_MNG_TYPE_02 string, THM_MNG_TYPE_03 string")
    assert {(r.id, r.label) for r in P.department_labels(items, order="n").collect()} == {("a", "p"), ("b", None)}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2.5, None), ("2", None, 'q"x')], "i string, x double, t string")
    store.write_shards(rows.coalesce(1), f"{tmp_path}/shards", rows_per_shard=1)
    lines = sorted(json.loads(r.value)[0] for r in spark.read.text(f"{tmp_path}/shards").collect())
    assert lines == ["1", "2"] and len(list((tmp_path / "shards").glob("part-*"))) == 2
    snap = tmp_path / "snap"
    snap.mkdir()
    (snap / "meta.json").write_text('{"columns": ["a", "b"]}')
    (snap / "rows-000.ndjson").write_text('["x", null]\n\n["y", 2]\n')
    read = store.read_ndjson_snapshot(spark, str(snap))
    assert sorted(tuple(r) for r in store.as_text(read).collect()) == [("x", None), ("y", "2")]
    assert {r.k for r in read.where("b is not null").select(F.schema_of_variant("b").alias("k")).collect()} == {"BIGINT"} and store.shard_name(7) == "rows-007.ndjson"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "good.json").write_text('{"a": 3}')
    (tmp_path / "docs" / "bad.json").write_text('{"a": ')
    assert sorted(((r.a, r.broken) for r in store.read_documents(spark, f"{tmp_path}/docs", "a int").collect()), key=str) == [(3, False), (None, True)]
    assert store.read_ndjson_snapshot(spark, f"{tmp_path}/none") is None
    assert store.read_documents(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
                                                              {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]] * 2}}]}))
    assert sorted((r.region, r.part, len(r.rings[0])) for r in store.read_boundaries(spark, f"{tmp_path}/b.json").collect()) == [("m", 0, 4), ("m", 1, 4), ("p", 0, 4)]
    run = spark.createDataFrame([("r1",)], "run_id string")
    store.publish_run({"rows": rows}, run, f"{tmp_path}/pub", "r1")
    assert store.read_as_of(spark, f"{tmp_path}/pub", "rows", "r1").count() == 2 and store.read_as_of(spark, f"{tmp_path}/pub", "rows", "r2") is None
    for value in ("old", "new"):
        store.write_themes(spark.createDataFrame([("a" if value == "old" else "b", value)], "theme string, v string"), f"{tmp_path}/themes", partition="theme")
    assert spark.read.parquet(f"{tmp_path}/themes").count() == 2


def test_stream_of_runs(spark, tmp_path):
    schema = "k string, v string"
    for n, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        frame = spark.createDataFrame(rows, schema)
        stream_snapshot_changes(spark, f"{tmp_path}/in", frame.schema, f"{tmp_path}/out", key="k", content=["v"]).awaitTermination()
        got = {(r.key, r.change) for r in spark.read.parquet(f"{tmp_path}/out/changes/batch={n}").collect()}
        assert got == (set() if n == 0 else {("a", "modified"), ("b", "removed"), ("c", "added")})


def test_queries_have_sql():
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert sql.keys() <= queries.keys()
    assert queries.keys() == sql.keys()
