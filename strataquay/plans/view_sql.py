"""History and dashboard queries in SQL."""

from __future__ import annotations

from .rule_sql import FINDINGS, trimmed

_TEXTS = (
    "cot_addr_full_new cot_addr_full_old cot_conts_id cot_conts_lan_type cot_conts_name cot_conts_stat cot_coord_data cot_coord_type cot_coord_x cot_coord_y "
    "cot_dong_name cot_extra_data_01 cot_extra_name cot_gu_name cot_img_main_url cot_kw cot_line_color cot_line_pattern cot_line_weight cot_master_no "
    "cot_mbr_max_x cot_mbr_max_y cot_mbr_min_x cot_mbr_min_y cot_name_01 cot_name_03 cot_nation_base_area cot_nation_point_number cot_reg_date cot_san_name "
    "cot_slave_no cot_tel_no cot_theme_id cot_theme_sub_id cot_update_date cot_value_01 cot_value_03 thm_coord_type thm_theme_name thm_theme_type"
).split()
_NUMBERS = {"cot_coord_x", "cot_coord_y", "cot_mbr_max_x", "cot_mbr_max_y", "cot_mbr_min_x", "cot_mbr_min_y"}
COLUMNS = sorted(_TEXTS)


def _text(c: str) -> str:
    if c in _NUMBERS:
        return f"coalesce(CASE WHEN isnan({c}) THEN 'NaN' WHEN abs({c}) < 1e5 THEN printf('%.9f', {c} + 0.0) ELSE printf('%.4f', {c} + 0.0) END, chr(0))"
    return f"coalesce({c}, chr(0))"


_OK = """ok_loads AS (
  SELECT cot_theme_id, run_tag, run_no, lag(run_tag) OVER (PARTITION BY cot_theme_id ORDER BY run_no) AS prev_run_tag
  FROM (SELECT DISTINCT cot_theme_id, run_tag FROM theme_loads WHERE load_status = 'ok') JOIN snapshot_runs USING (run_tag)),
pairs AS (SELECT cot_theme_id, prev_run_tag, run_tag FROM ok_loads WHERE prev_run_tag IS NOT NULL)"""
_HASH = f"""WITH {_OK}, hashed AS (SELECT run_tag, cot_theme_id, sha256(concat_ws(chr(31), {', '.join(map(_text, COLUMNS))})) AS h FROM snapshots JOIN ok_loads USING (run_tag, cot_theme_id)),
parts AS (SELECT run_tag, cot_theme_id, left(h, 3) AS bucket, sha256(string_agg(h, ',' ORDER BY h)) AS part, count(*) AS n FROM hashed GROUP BY ALL)
SELECT run_tag, cot_theme_id, sum(n)::BIGINT AS rows, sha256('{','.join(COLUMNS)};' || string_agg(bucket || ':' || part, ',' ORDER BY bucket)) AS content_hash FROM parts GROUP BY ALL"""
_KEYED = f"""{_OK},
r_keyed AS (
  SELECT s.run_tag, s.cot_theme_id, row_id, coalesce(cot_conts_id, '') || CASE WHEN count(*) OVER w > 1 THEN '#' || row_number() OVER (w ORDER BY row_id) ELSE '' END AS key,
    cot_conts_name, {', '.join(f'{_text(c)} AS v_{c}' for c in COLUMNS)}
  FROM snapshots s JOIN ok_loads USING (run_tag, cot_theme_id) WINDOW w AS (PARTITION BY s.run_tag, s.cot_theme_id, coalesce(cot_conts_id, ''))),
after_rows AS (SELECT p.prev_run_tag, k.* FROM r_keyed k JOIN pairs p USING (cot_theme_id, run_tag)),
before_rows AS (SELECT p.prev_run_tag, p.run_tag AS next_run_tag, k.* FROM r_keyed k JOIN pairs p ON p.cot_theme_id = k.cot_theme_id AND p.prev_run_tag = k.run_tag)"""
_SAME = " AND ".join(f"a.v_{c} = b.v_{c}" for c in COLUMNS)
_KEPT = " AND ".join(f"a.v_{c} = b.v_{c}" for c in COLUMNS if c != "cot_update_date")
_CHANGES = f"""{_KEYED},
changes AS (
  SELECT coalesce(a.cot_theme_id, b.cot_theme_id) AS cot_theme_id, coalesce(a.prev_run_tag, b.prev_run_tag) AS prev_run_tag, coalesce(a.run_tag, b.next_run_tag) AS run_tag,
    coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' WHEN {_KEPT} THEN 'dates_only' ELSE 'modified' END AS change
  FROM after_rows a FULL JOIN before_rows b ON a.cot_theme_id = b.cot_theme_id AND a.prev_run_tag = b.prev_run_tag AND a.run_tag = b.next_run_tag AND a.key = b.key
  WHERE a.key IS NULL OR b.key IS NULL OR NOT ({_SAME})),
change_counts AS (
  SELECT p.cot_theme_id, p.prev_run_tag, p.run_tag, {', '.join(f"count(*) FILTER (change = '{c}') AS {c}" for c in ('added', 'removed', 'modified', 'dates_only'))}
  FROM pairs p LEFT JOIN changes USING (cot_theme_id, prev_run_tag, run_tag) GROUP BY ALL)"""
_FIELDS = "\nUNION ALL ".join(
    f"SELECT cot_theme_id, prev_run_tag, run_tag, key, '{c}' AS \"column\", nullif(b.v_{c}, chr(0)) AS before, nullif(a.v_{c}, chr(0)) AS after FROM met_{{}} WHERE a.v_{c} <> b.v_{c}".replace(" FROM met_{}", " FROM met")
    for c in COLUMNS
)
_FIELD_CHANGES = f"""{_CHANGES},
met AS (SELECT a.cot_theme_id, a.prev_run_tag, a.run_tag, a.key, a, b FROM after_rows a JOIN before_rows b
  ON a.cot_theme_id = b.cot_theme_id AND a.prev_run_tag = b.prev_run_tag AND a.run_tag = b.next_run_tag AND a.key = b.key),
fields AS ({_FIELDS})"""
_GOOD = f"""{FINDINGS}, {_CHANGES},
good_findings AS (SELECT n.* FROM named n JOIN ok_loads USING (cot_theme_id, run_tag)),
gravest AS (
  SELECT cot_theme_id, run_tag, fingerprint, CASE min(CASE severity WHEN 'error' THEN 0 WHEN 'suspect' THEN 1 ELSE 2 END) WHEN 0 THEN 'error' WHEN 1 THEN 'suspect' ELSE 'info' END AS severity,
    min(rule_id) AS rule_id FROM good_findings GROUP BY ALL),
f_after AS (SELECT p.prev_run_tag, g.* FROM gravest g JOIN pairs p USING (cot_theme_id, run_tag)),
f_before AS (SELECT p.prev_run_tag AS was, p.run_tag AS next_run_tag, g.* FROM gravest g JOIN pairs p ON p.cot_theme_id = g.cot_theme_id AND p.prev_run_tag = g.run_tag),
finding_diff AS (
  SELECT coalesce(a.cot_theme_id, b.cot_theme_id) AS cot_theme_id, coalesce(a.prev_run_tag, b.was) AS prev_run_tag, coalesce(a.run_tag, b.next_run_tag) AS run_tag,
    coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'added' WHEN a.fingerprint IS NULL THEN 'resolved'
      WHEN a.severity <> b.severity THEN 'severity_changed' ELSE 'unchanged' END AS change, b.severity AS severity_before, a.severity AS severity_after
  FROM f_after a FULL JOIN f_before b ON a.cot_theme_id = b.cot_theme_id AND a.prev_run_tag = b.was AND a.run_tag = b.next_run_tag AND a.fingerprint = b.fingerprint),
finding_counts AS (
  SELECT o.cot_theme_id, o.run_tag, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ('error', 'suspect', 'info'))}
  FROM ok_loads o LEFT JOIN good_findings USING (cot_theme_id, run_tag) GROUP BY ALL),
sizes AS (SELECT cot_theme_id, run_tag, count(*) AS row_count FROM snapshots GROUP BY ALL),
versions AS (
  SELECT cot_theme_id, row_number() OVER (PARTITION BY cot_theme_id ORDER BY run_no) AS version, row_number() OVER (PARTITION BY cot_theme_id ORDER BY run_no DESC) AS newest_first, run_tag, coalesce(row_count, 0) AS row_count, error, suspect, info, added::DOUBLE AS added, removed::DOUBLE AS removed, modified::DOUBLE AS modified
  FROM ok_loads LEFT JOIN sizes USING (cot_theme_id, run_tag) LEFT JOIN finding_counts USING (cot_theme_id, run_tag)
  LEFT JOIN (SELECT * EXCLUDE prev_run_tag FROM change_counts) USING (cot_theme_id, run_tag) WHERE prev_run_tag IS NULL OR added + removed + modified > 0),
moves AS (
  SELECT cot_theme_id, prev_run_tag, run_tag, count(*) FILTER (change = 'added') AS findings_added, count(*) FILTER (change = 'resolved') AS findings_resolved,
    count(*) FILTER (change = 'severity_changed') AS findings_severity_changed FROM finding_diff GROUP BY ALL),
catalogue AS (
  SELECT t.cot_theme_id, row_number() OVER (ORDER BY t.cot_theme_id) AS place, t.thm_theme_name AS name, t.thm_theme_type AS type, coalesce(s.status, 'missing') AS status, coalesce(department_label, 'unknown') AS department,
    coalesce(z.row_count, CASE WHEN g.run_no IS NOT NULL THEN 0 END)::DOUBLE AS row_count, error::DOUBLE AS error, suspect::DOUBLE AS suspect, info::DOUBLE AS info, strftime(r.started_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_success_at,
    coalesce(s.status, 'missing') = 'ok' AND g.prev_run_tag IS NOT NULL AS compared,
    {', '.join(f"CASE WHEN coalesce(s.status, 'missing') = 'ok' AND g.prev_run_tag IS NOT NULL THEN coalesce({m}, 0) END::DOUBLE AS {m}" for m in ('added', 'removed', 'modified', 'dates_only', 'findings_added', 'findings_resolved', 'findings_severity_changed'))}
  FROM themes t
  LEFT JOIN (SELECT cot_theme_id, max(load_status) AS status FROM theme_loads WHERE run_tag = (SELECT max_by(run_tag, run_no) FROM snapshot_runs) GROUP BY ALL) s USING (cot_theme_id)
  LEFT JOIN (SELECT * FROM ok_loads QUALIFY row_number() OVER (PARTITION BY cot_theme_id ORDER BY run_no DESC) = 1) g USING (cot_theme_id)
  LEFT JOIN sizes z ON z.cot_theme_id = g.cot_theme_id AND z.run_tag = g.run_tag LEFT JOIN finding_counts c ON c.cot_theme_id = g.cot_theme_id AND c.run_tag = g.run_tag
  LEFT JOIN snapshot_runs r ON r.run_tag = g.run_tag LEFT JOIN change_counts cc ON cc.cot_theme_id = g.cot_theme_id AND cc.run_tag = g.run_tag
  LEFT JOIN moves m ON m.cot_theme_id = g.cot_theme_id AND m.run_tag = g.run_tag)"""
_HEALTH = "CASE WHEN status <> 'ok' OR error IS NULL THEN 'unchecked' WHEN error > 0 THEN 'error' WHEN suspect > 0 THEN 'suspect' WHEN info > 0 THEN 'info' ELSE 'clean' END"
_STATUS = """status_counts AS (
  SELECT r.run_tag, r.run_no, count(*) AS themes, count(*) FILTER (coalesce(load_status, 'missing') = 'ok') AS ok, count(*) FILTER (load_status = 'unavailable') AS unavailable,
    count(*) FILTER (load_status = 'incomplete') AS incomplete, count(*) FILTER (load_status = 'error') AS error, count(*) FILTER (coalesce(load_status, 'missing') = 'missing') AS missing
  FROM snapshot_runs r CROSS JOIN themes t LEFT JOIN theme_loads l ON l.run_tag = r.run_tag AND l.cot_theme_id = t.cot_theme_id GROUP BY ALL)"""
_LABELS = """CASE WHEN "column" LIKE 'cot_value_%' THEN 'detail ' || right("column", 2)::INT WHEN "column" LIKE 'cot_name_%' THEN 'title of detail ' || right("column", 2)::INT ELSE CASE "column"
  WHEN 'cot_addr_full_new' THEN 'road address' WHEN 'cot_addr_full_old' THEN 'lot address' WHEN 'cot_conts_id' THEN 'id' WHEN 'cot_conts_lan_type' THEN 'language' WHEN 'cot_conts_name' THEN 'name'
  WHEN 'cot_conts_stat' THEN 'state' WHEN 'cot_coord_data' THEN 'shape' WHEN 'cot_coord_type' THEN 'kind of shape' WHEN 'cot_coord_x' THEN 'longitude' WHEN 'cot_coord_y' THEN 'latitude'
  WHEN 'cot_dong_name' THEN 'neighbourhood' WHEN 'cot_extra_data_01' THEN 'further data' WHEN 'cot_extra_name' THEN 'further address' WHEN 'cot_gu_name' THEN 'district' WHEN 'cot_img_main_url' THEN 'image'
  WHEN 'cot_kw' THEN 'key words' WHEN 'cot_line_color' THEN 'line colour' WHEN 'cot_line_pattern' THEN 'line pattern' WHEN 'cot_line_weight' THEN 'line weight' WHEN 'cot_master_no' THEN 'main lot'
  WHEN 'cot_mbr_max_x' THEN 'eastern edge' WHEN 'cot_mbr_max_y' THEN 'northern edge' WHEN 'cot_mbr_min_x' THEN 'western edge' WHEN 'cot_mbr_min_y' THEN 'southern edge' WHEN 'cot_nation_base_area' THEN 'base area'
  WHEN 'cot_nation_point_number' THEN 'point number' WHEN 'cot_reg_date' THEN 'registered' WHEN 'cot_san_name' THEN 'mountain lot' WHEN 'cot_slave_no' THEN 'sub lot' WHEN 'cot_tel_no' THEN 'telephone'
  WHEN 'cot_theme_id' THEN 'theme' WHEN 'cot_theme_sub_id' THEN 'category' WHEN 'cot_update_date' THEN 'updated' WHEN 'thm_coord_type' THEN 'theme shape' WHEN 'thm_theme_name' THEN 'theme name'
  WHEN 'thm_theme_type' THEN 'theme type' ELSE "column" END END"""
_KO = "coalesce(error, -1) DESC, coalesce(suspect, -1) DESC, CASE WHEN regexp_matches(name, '^[가-힣]') THEN 0 ELSE 1 END, name, cot_theme_id"
_ROLLUP = f"""SELECT *, row_number() OVER (ORDER BY department = 'unknown', error DESC, suspect DESC, department) AS place FROM (
      SELECT department, count(*) AS themes, count(*) FILTER (status = 'ok') AS checked, {', '.join(f'coalesce(sum({m}), 0)::BIGINT AS {m}' for m in ('error', 'suspect', 'info', 'findings_added', 'findings_resolved'))} FROM catalogue GROUP BY department)"""
_grouped = lambda c: f"format('{{:,}}', ({c})::BIGINT)"
_EFFECT = """jumps AS (
      SELECT p.* FROM pairs p JOIN snapshot_runs a ON a.run_tag = p.run_tag JOIN snapshot_runs b ON b.run_tag = p.prev_run_tag WHERE a.ruleset_version <> b.ruleset_version),
    effects AS (
      SELECT j.cot_theme_id, j.prev_run_tag, j.run_tag, fingerprint, CASE WHEN o.ruleset_version < n.ruleset_version THEN 'added' ELSE 'resolved' END AS change, severity FROM jumps j
      JOIN gravest g ON g.cot_theme_id = j.cot_theme_id AND g.run_tag = j.prev_run_tag JOIN snapshot_runs o ON o.run_tag = j.prev_run_tag JOIN snapshot_runs n ON n.run_tag = j.run_tag
      JOIN (VALUES ('C-09', 2), ('C-12', 2)) AS v(rule_id, since) ON v.rule_id = g.rule_id
      WHERE (o.ruleset_version >= since) <> (n.ruleset_version >= since))"""
_TOTALS = """totals AS (SELECT run_tag, count(*) AS themes_read, coalesce(sum(row_count), 0)::BIGINT AS rows, coalesce(sum(error), 0)::BIGINT AS error,
      coalesce(sum(suspect), 0)::BIGINT AS suspect, coalesce(sum(info), 0)::BIGINT AS info, CASE WHEN count(prev_run_tag) > 0 THEN count(*) FILTER (added + removed + modified > 0) END::DOUBLE AS themes_changed,
      sum(added)::DOUBLE AS added, sum(removed)::DOUBLE AS removed, sum(modified)::DOUBLE AS modified, sum(dates_only)::DOUBLE AS dates_only
      FROM ok_loads LEFT JOIN sizes USING (cot_theme_id, run_tag) LEFT JOIN finding_counts USING (cot_theme_id, run_tag)
      LEFT JOIN (SELECT * EXCLUDE prev_run_tag FROM change_counts) USING (cot_theme_id, run_tag) GROUP BY run_tag)"""


def _compact(c: str) -> str:
    return rf"regexp_replace(lower(coalesce({c}, '')), '[\s\x{{00A0}}\x{{FEFF}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')"


def _shown(c: str) -> str:
    return rf"CASE WHEN regexp_matches(v_{c}, '^-?[0-9]+\.[0-9]+$') THEN regexp_replace(v_{c}, '\.?0+$', '') ELSE v_{c} END" if c in _NUMBERS else f"v_{c}"


_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
_SORT = "coalesce(rule_id, ''), coalesce(conts_key, ''), coalesce(group_key, ''), coalesce(field, ''), coalesce(value, '')"
QUERIES: dict[str, str] = {
    "snapshot_hash": _HASH,
    "snapshot_added": f"WITH {_CHANGES} SELECT cot_theme_id, prev_run_tag, run_tag, key FROM changes WHERE change = 'added'",
    "snapshot_removed": f"WITH {_CHANGES} SELECT cot_theme_id, prev_run_tag, run_tag, key FROM changes WHERE change = 'removed'",
    "snapshot_modified": f"WITH {_FIELD_CHANGES} SELECT * FROM fields",
    "timestamp_only": f"WITH {_CHANGES} SELECT cot_theme_id, prev_run_tag, run_tag, key FROM changes WHERE change = 'dates_only'",
    "diff_counts": f"WITH {_CHANGES} SELECT * FROM change_counts",
    "finding_diff": f"WITH RECURSIVE {_GOOD} SELECT * FROM finding_diff WHERE change IN ('added', 'resolved')",
    "severity_changed": f"WITH RECURSIVE {_GOOD} SELECT * FROM finding_diff WHERE change = 'severity_changed'",
    "unchanged_count": f"""WITH RECURSIVE {_GOOD} SELECT cot_theme_id, prev_run_tag, run_tag,
      count(*) FILTER (severity_after IS NOT NULL) - count(*) FILTER (change = 'added') - count(*) FILTER (change = 'severity_changed') AS unchanged FROM finding_diff GROUP BY ALL""",
    "rules_effect_split": f"""WITH RECURSIVE {_GOOD}, {_EFFECT},
      unfit AS (SELECT j.cot_theme_id, j.prev_run_tag, j.run_tag, v.rule_id FROM jumps j JOIN snapshot_runs n ON n.run_tag = j.run_tag, (VALUES ('C-09', 2), ('C-12', 2)) AS v(rule_id, since) WHERE ruleset_version < since)
      SELECT d.*, 'data' AS cause FROM finding_diff d JOIN jumps USING (cot_theme_id, prev_run_tag, run_tag) WHERE change <> 'unchanged'
        AND NOT EXISTS (SELECT 1 FROM unfit u WHERE u.cot_theme_id = d.cot_theme_id AND u.run_tag = d.run_tag AND u.prev_run_tag = d.prev_run_tag AND d.fingerprint LIKE u.rule_id || '|%')
      UNION ALL SELECT cot_theme_id, prev_run_tag, run_tag, fingerprint, change, CASE change WHEN 'resolved' THEN severity END, CASE change WHEN 'added' THEN severity END, 'rules' FROM effects""",
    "version_log": f"WITH RECURSIVE {_GOOD} SELECT * FROM versions",
    "last_version": f"WITH RECURSIVE {_GOOD} SELECT cot_theme_id, max(version) AS versions, max_by(run_tag, version) AS run_tag, max_by(row_count, version) AS row_count FROM versions GROUP BY ALL",
    "catalog_merge": f"WITH RECURSIVE {_GOOD} SELECT * FROM catalogue",
    "status_counts": f"WITH {_STATUS} SELECT * EXCLUDE run_no FROM status_counts",
    "run_totals": f"WITH RECURSIVE {_GOOD}, {_EFFECT}, {_TOTALS} SELECT t.*, e.n::DOUBLE AS rules_effect FROM totals t LEFT JOIN (SELECT run_tag, count(*) AS n FROM effects GROUP BY ALL) e USING (run_tag)",
    "run_log": f"""WITH RECURSIVE {_GOOD}, {_TOTALS}, {_STATUS} SELECT t.run_tag, t.run_tag || ': ' || {_grouped('themes_read')} || ' of ' || {_grouped('themes')} || ' themes, ' || {_grouped('rows')} || ' rows, '
      || {_grouped('t.error')} || ' error, ' || {_grouped('suspect')} || ' suspect, ' || {_grouped('info')} || ' info, '
      || CASE WHEN themes_changed IS NULL THEN 'nothing compared' ELSE {_grouped('themes_changed')} || ' themes changed' END AS line FROM totals t JOIN status_counts USING (run_tag)""",
    "home_totals": f"""WITH RECURSIVE {_GOOD} SELECT count(*) AS themes, count(*) FILTER (status = 'ok') AS readable, sum(row_count)::BIGINT AS rows, sum(error)::BIGINT AS error, sum(suspect)::BIGINT AS suspect,
      sum(info)::BIGINT AS info, count(*) FILTER (added + removed + modified > 0) AS changed FROM catalogue""",
    "top_departments": f"WITH RECURSIVE {_GOOD}, listed AS ({_ROLLUP}) SELECT department, place, error, round(100 * error / (SELECT greatest(1, max(error)) FROM listed), 6) AS bar FROM listed ORDER BY place LIMIT 10",
    "version_pairs": f"WITH RECURSIVE {_GOOD} SELECT a.cot_theme_id, a.run_tag AS older, b.run_tag AS newer FROM versions a JOIN versions b ON b.cot_theme_id = a.cot_theme_id AND b.version > a.version",
    "stored_hash": f"""WITH {_OK}, texts AS (SELECT run_tag, cot_theme_id, coalesce(cot_conts_id, '') AS id, to_json([{', '.join(c for c in COLUMNS if c not in _NUMBERS)}])::VARCHAR AS line FROM snapshots JOIN ok_loads USING (run_tag, cot_theme_id))
      SELECT run_tag, cot_theme_id, count(*) AS rows, sha256('{{"columns":[{','.join(f'"{c}"' for c in COLUMNS if c not in _NUMBERS)}],"rows":[' || string_agg(line, ',' ORDER BY id, line) || ']}}') AS stored_hash FROM texts GROUP BY ALL""",
    "guards": f"""WITH {_STATUS}, p AS (SELECT *, themes - missing AS public, lag(themes - missing) OVER (ORDER BY run_no)::DOUBLE AS public_before FROM status_counts)
      SELECT run_tag, public, public_before, round((error + incomplete) / nullif(public, 0), 9) AS failed_share, CASE WHEN public = 0 THEN 'no themes'
        WHEN public_before IS NOT NULL AND public < public_before * 0.8 THEN 'too few themes' WHEN (error + incomplete) / nullif(public, 0) > 0.3 THEN 'too many failures' END AS stop FROM p""",
    "theme_health": f"WITH RECURSIVE {_GOOD} SELECT health, count(cot_theme_id) AS themes FROM (SELECT unnest(['error', 'suspect', 'info', 'clean', 'unchecked']) AS health) LEFT JOIN (SELECT *, {_HEALTH} AS health FROM catalogue) USING (health) GROUP BY ALL",
    "themes_with_severity": f"WITH RECURSIVE {_GOOD} SELECT {', '.join(f'count(*) FILTER ({s} > 0) AS {s}' for s in ('error', 'suspect', 'info'))} FROM catalogue WHERE status = 'ok' AND error IS NOT NULL",
    "changed_themes": f"""WITH RECURSIVE {_GOOD} SELECT cot_theme_id, name, CASE WHEN added + removed + modified > 0 OR findings_added + findings_resolved + findings_severity_changed > 0 THEN 'changed' ELSE 'dates_only' END AS kind,
      added + removed + modified AS row_changes, findings_added + findings_resolved + findings_severity_changed AS finding_changes, dates_only,
      'added ' || {_grouped('added')} || ', removed ' || {_grouped('removed')} || ', modified ' || {_grouped('modified')} || CASE WHEN dates_only > 0 THEN ', dates only ' || {_grouped('dates_only')} ELSE '' END AS row_text,
      'new ' || {_grouped('findings_added')} || ', resolved ' || {_grouped('findings_resolved')} || ', regraded ' || {_grouped('findings_severity_changed')} AS finding_text,
      row_number() OVER (PARTITION BY CASE WHEN added + removed + modified > 0 OR findings_added + findings_resolved + findings_severity_changed > 0 THEN 'changed' ELSE 'dates_only' END
        ORDER BY added + removed + modified DESC NULLS FIRST, findings_added + findings_resolved + findings_severity_changed DESC NULLS FIRST, name, cot_theme_id) AS place FROM catalogue
      WHERE compared AND (added + removed + modified > 0 OR findings_added + findings_resolved + findings_severity_changed > 0 OR dates_only > 0)""",
    "department_rollup": f"WITH RECURSIVE {_GOOD} {_ROLLUP}",
    "department_page": f"""WITH RECURSIVE {_GOOD} SELECT department, cot_theme_id, name, error, suspect,
      row_number() OVER (PARTITION BY department ORDER BY {_KO}) AS place FROM catalogue""",
    "theme_search": f"WITH RECURSIVE {_GOOD} SELECT cot_theme_id, name, department, row_number() OVER (ORDER BY {_KO}) AS place FROM catalogue WHERE contains({_compact('name')}, '행정지원') OR contains({_compact('department')}, '행정지원') OR contains({_compact('name')}, '쉼터') ORDER BY place LIMIT 30",
    "new_findings": f"WITH RECURSIVE {_GOOD} SELECT cot_theme_id, run_tag, rule_id, severity, conts_key, fingerprint FROM good_findings SEMI JOIN (SELECT * FROM finding_diff WHERE change = 'added') USING (cot_theme_id, run_tag, fingerprint)",
    "finding_filter": f"""WITH RECURSIVE {_GOOD} SELECT cot_theme_id, run_tag, rule_id, conts_key, group_key, name FROM good_findings WHERE rule_id IN ('C-08', 'C-10') AND severity = 'suspect'
      AND (contains({_compact('name')}, '동물') OR contains({_compact('conts_key')}, '동물') OR contains({_compact('value')}, '동물'))""",
    "paged_findings": f"""WITH RECURSIVE {_GOOD} SELECT cot_theme_id, run_tag, fingerprint, severity, (floor((row_number() OVER (PARTITION BY cot_theme_id, run_tag
      ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'suspect' THEN 1 ELSE 2 END, {_SORT}) - 1) / 100) + 1)::BIGINT AS page, ceil(count(*) OVER (PARTITION BY cot_theme_id, run_tag) / 100)::BIGINT AS pages FROM good_findings""",
    "compare_versions": f"""WITH {_FIELD_CHANGES}, row_names AS (SELECT cot_theme_id, run_tag, key, nullif(trim(cot_conts_name, ' '), '') AS name FROM r_keyed)
      SELECT f.cot_theme_id, f.prev_run_tag, f.run_tag, f.key, {_LABELS} AS label, coalesce(a.name, b.name) AS name, before, after FROM fields f
      LEFT JOIN row_names a ON a.cot_theme_id = f.cot_theme_id AND a.run_tag = f.run_tag AND a.key = f.key
      LEFT JOIN row_names b ON b.cot_theme_id = f.cot_theme_id AND b.run_tag = f.prev_run_tag AND b.key = f.key""",
    "row_detail": f"""WITH RECURSIVE {_GOOD}, hit AS (SELECT DISTINCT cot_theme_id, run_tag, conts_key AS key FROM good_findings WHERE severity = 'error' AND conts_key IS NOT NULL),
      shown AS (SELECT k.* FROM r_keyed k SEMI JOIN hit USING (cot_theme_id, run_tag, key))
      SELECT *, {_LABELS} AS label FROM ({' UNION ALL '.join(f"SELECT cot_theme_id, run_tag, key, '{c}' AS column, {_shown(c)} AS value FROM shown".replace(' AS column', ' AS "column"') for c in COLUMNS)}) WHERE value <> chr(0) AND trim(value, ' ') <> ''""",
    "mode_title": """SELECT cot_theme_id, "column", title AS label FROM (SELECT cot_theme_id, "column", title, count(*) AS n FROM (
        SELECT cot_theme_id, 'cot_value_01' AS "column", cot_name_01 AS title FROM snapshots UNION ALL SELECT cot_theme_id, 'cot_value_03', cot_name_03 FROM snapshots) WHERE trim(title, ' ') <> '' GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY cot_theme_id, "column" ORDER BY n DESC, title) = 1""",
    "public_filter": """SELECT cot_theme_id, row_id, trim(s.thm_theme_name, ' ') AS name FROM snapshots s JOIN themes t USING (cot_theme_id) WHERE thm_theme_stat = '1' AND trim(cot_theme_id, ' ') <> ''
      QUALIFY row_number() OVER (PARTITION BY cot_theme_id ORDER BY row_id) = 1""",
    "run_stamps": """SELECT event_id, m AS minute, 'snap-' || left(m, 10) || '-' || m[12:13] || m[15:16] AS tag, left(m, 10) || ' ' || m[12:16] AS label,
        CASE WHEN a < 1 THEN 'just now' WHEN a < 60 THEN a || ' min ago' WHEN a < 1440 THEN (a // 60) || ' h ago' ELSE (a // 1440) || ' d ago' END AS age
      FROM (SELECT event_id, strftime(ts::TIMESTAMP + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M') AS m, floor((1767225600000000 - epoch_us(ts)) / 60000000)::BIGINT AS a FROM events)""",
    "json_scalars": "SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k FROM events",
    "format_texts": """SELECT o_orderkey, format('{:,}', floor(o_totalprice)::BIGINT) AS price,
        CASE WHEN o_totalprice / 7 < 1000 THEN floor(o_totalprice / 7 + 0.5)::BIGINT || 'm' ELSE printf('%.1f', o_totalprice / 7 / 1000) || 'km' END AS distance,
        CASE WHEN floor(o_totalprice)::BIGINT % 2 = 0 THEN (floor(o_totalprice)::BIGINT // 2)::VARCHAR ELSE (floor(o_totalprice)::BIGINT // 2) || '.5' END AS half FROM orders""",
    "url_scalars": "SELECT row_id, string_split(cot_img_main_url, '/')[-1] AS segment, cot_conts_name AS name FROM snapshots",
    "number_scalars": f"""SELECT row_id, {trimmed('cot_slave_no')} AS slave, CASE WHEN regexp_matches({trimmed('cot_slave_no')}, {_NUMBER}) THEN try_cast({trimmed('cot_slave_no')} AS DOUBLE) END AS number,
        CASE WHEN regexp_matches({trimmed('cot_theme_sub_id')}, {_NUMBER}) THEN try_cast({trimmed('cot_theme_sub_id')} AS DOUBLE) END AS code FROM snapshots""",
}
