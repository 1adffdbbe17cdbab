"""Paged JSON sources: envelopes, strict page checks, retries, and a batch reader."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A getter of one page: parameters to (status, body text).
Getter = Callable[[dict[str, str]], tuple[int, str]]
PAGE_SIZE = 1000


def query_text(params: dict[str, str]) -> str:
    """``name=value`` pairs, percent-encoded (a blank is ``%20``)."""
    return "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in params.items())


def retrying(get: Getter, *, retries: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Getter:
    """S3: repeat on server and network errors with waits of 1, 4, 16 ... units; other answers pass.

    Errors never carry the address or the parameters, which may hold a key.
    """

    def wrapped(params: dict[str, str]) -> tuple[int, str]:
        for turn in range(retries + 1):
            try:
                status, body = get(params)
                if status < 500:
                    return status, body
                problem = f"the server answered {status}"
            except OSError as error:
                problem = f"the request failed ({type(error).__name__})"
            if turn < retries:
                sleep(first_wait * 4**turn)
        raise RuntimeError(problem)

    return wrapped


#: The kinds of themes that a list is asked for.
THEME_TYPES = ("1", "2", "4", "5")


def fetch_theme_list(get: Getter, *, types: tuple[str, ...] = THEME_TYPES, page_size: int = PAGE_SIZE) -> list[dict]:
    """The entries of all pages of every kind of theme, in order.

    A kind ends with an empty page or the last page the header counts.  An answer other than 200 or one
    without a list raises; the message has the server's words and never the parameters.
    """
    found: list[dict] = []
    for kind in types:
        page, last = 1, None
        while last is None or page <= last:
            status, body = get({"type": kind, "page": str(page), "size": str(page_size)})
            try:
                said = json.loads(body)
            except ValueError:
                said = {}
            head = (said.get("header") or said.get("head") or {}) if isinstance(said, dict) else {}
            items = said.get("body") if isinstance(said, dict) else None
            if status != 200 or not isinstance(items, list):
                raise RuntimeError(f"the list of themes could not be read: {head.get('resultMsg') or head.get('RETMSG') or status}")
            if not items:
                break
            found += items
            count, total, size = (int(head.get(n) or 0) for n in ("PAGE_COUNT", "TOTAL_COUNT", "PAGE_SIZE"))
            last = count or (max(1, -(-total // size)) if total and size else page if len(items) < page_size else None)
            page += 1
    return found


def fetch_departments(read: Callable[[str], str], post: Callable[[str, dict[str, str]], str], *, script: str, form: str) -> list[dict]:
    """The entries of the department list, whose form wants the key that ``script`` holds.

    The key is the script's text of 32 hexadecimal digits in quotes.  A missing key or an answer without a list raises.
    """
    key = re.search("[\"']([0-9a-f]{32})[\"']", read(script))
    if key is None:
        raise RuntimeError("the department list's key was not found")
    try:
        items = json.loads(post(form, {"key": key[1]})).get("body")
    except (ValueError, AttributeError):
        items = None
    if not isinstance(items, list):
        raise RuntimeError("the department list could not be read")
    return items


# --- S9: envelopes as columns -------------------------------------------------------------------


def _header(body: Column, *names: str) -> Column:
    """The first of ``names`` in ``header``, or in ``head`` where there is no header object."""
    has_header = F.get_json_object(body, "$.header").isNotNull()
    got = lambda part: F.coalesce(*[F.get_json_object(body, f"$.{part}.{n}") for n in names])
    return F.when(has_header, got("header")).otherwise(got("head"))


def _count(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit("^[0-9]{1,18}$")), text.cast("bigint"))


def read_envelopes(pages: DataFrame, *, body: str = "body") -> DataFrame:
    """``pages`` with ``code, total, page_count, said_page, rows``; broken JSON gives nulls."""
    text = F.when(F.get_json_object(body, "$").isNotNull(), F.col(body))
    total, size = _count(_header(text, "TOTAL_COUNT")), _count(_header(text, "PAGE_SIZE"))
    said = _count(_header(text, "PAGE_COUNT"))
    derived = F.when(total.isNotNull() & (size > 0), F.greatest(F.lit(1), F.ceil(F.try_divide(total, size))))
    return pages.withColumns(
        {
            "code": F.coalesce(_header(text, "resultCode", "RETCODE"), F.lit("")),
            "total": total,
            "page_count": F.coalesce(said, derived),
            "said_page": _count(_header(text, "PAGE_NO")),
            "rows": F.json_array_length(F.get_json_object(text, "$.body")),
        }
    )


def page_states(pages: DataFrame, *, keys: list[str], page_size: int = PAGE_SIZE) -> DataFrame:
    """The state of every theme's load from its pages.

    ``pages`` has ``keys, page_no, http_status, code, total, page_count, said_page, rows``.
    Refused (400 with code 400) is ``unavailable``; other bad answers are ``error``; ``incomplete`` is a load whose
    totals or page counts disagree, whose pages are misnumbered, that has an empty page
    before its last, a full page without any count, or fewer or more rows than announced.
    No pages give no row.
    """
    ok_code = F.col("code").isin("", "0", "200") | ((F.col("code") == "100") & (F.coalesce("total", F.lit(0)) == 0) & (F.coalesce("rows", F.lit(0)) == 0) & (F.col("page_no") == 1))
    bad = (F.col("http_status") != 200) | ~ok_code | F.col("rows").isNull()
    refused = (F.col("http_status") == 400) & (F.col("code") == "400")
    last = F.max("page_no").over(_by(keys))
    agg = (
        pages.withColumns({"_bad": bad, "_refused": refused, "_last": last})
        .groupBy(*keys)
        .agg(
            F.max("_refused").alias("refused"), F.max("_bad").alias("bad"), F.sum(F.coalesce("rows", F.lit(0))).alias("rows"), F.max("total").alias("total"),
            F.countDistinct("total").alias("totals"), F.countDistinct("page_count").alias("counts"),
            F.max(F.coalesce(F.col("said_page") != F.col("page_no"), F.lit(False))).alias("misnumbered"),
            F.max((F.col("rows") == 0) & (F.col("page_no") < F.col("_last"))).alias("gap"),
            F.max((F.col("rows") >= page_size) & F.col("total").isNull() & F.col("page_count").isNull()).alias("unbounded"),
        )
    )
    wrong = (F.col("totals") > 1) | (F.col("counts") > 1) | F.col("misnumbered") | F.col("gap") | F.col("unbounded") | (F.col("total").isNotNull() & (F.col("total") != F.col("rows")))
    state = F.when(F.col("refused"), "unavailable").when(F.col("bad"), "error").when(wrong, "incomplete").otherwise("ok")
    return agg.select(*keys, "rows", state.alias("state"))


def _by(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def public_themes(listed: DataFrame, *, order: str) -> DataFrame:
    """Public themes with an id, the first of each id in ``order``, names trimmed."""
    public = listed.where((F.trim(F.coalesce("THM_THEME_ID", F.lit(""))) != "") & (F.col("THM_THEME_STAT") == "1"))
    first = public.groupBy("THM_THEME_ID").agg(F.min_by(F.struct(F.trim("THM_THEME_NAME").alias("name"), F.col("THM_THEME_TYPE").alias("type")), order).alias("_t"))
    return first.select(F.col("THM_THEME_ID").alias("id"), "_t.name", "_t.type")


def department_labels(items: DataFrame, *, order: str) -> DataFrame:
    """The last entry of each theme with its three codes and a readable label (null if nothing is known)."""
    codes = [F.trim(F.coalesce(F.col(f"THM_MNG_TYPE_0{n}"), F.lit(""))) for n in (1, 2, 3)]
    last = items.where(F.coalesce(F.trim("THM_THEME_ID"), F.lit("")) != "").groupBy("THM_THEME_ID").agg(F.max_by(F.struct(*[c.alias(f"c{n}") for n, c in enumerate(codes, 1)]), order).alias("_c"))
    label = F.nullif(F.concat_ws(" ", F.nullif("_c.c2", F.lit("")), F.nullif("_c.c3", F.lit(""))), F.lit(""))
    return last.select(F.col("THM_THEME_ID").alias("id"), F.array("_c.c1", "_c.c2", "_c.c3").alias("codes"), label.alias("label"))


# --- S1, S2 as a batch reader: one task a theme, pages in order within it -------------------------


def fetch_pages(get: Getter, theme: str) -> tuple[list[tuple[int, int, str]], bool]:
    """Pages (number, status, body) of one theme in order, and whether they are all the rows announced.

    A refused or broken page ends the theme and is no reason to ask again.
    """
    found: list[tuple[int, int, str]] = []
    totals, rows, page, last = set(), 0, 1, 1
    while page <= last:
        status, body = get({"theme": theme, "page": str(page)})
        found.append((page, status, body))
        try:
            said = json.loads(body) if status == 200 else None
            head = said.get("header") or said.get("head") or {}
            total, size = int(head.get("TOTAL_COUNT") or 0), int(head.get("PAGE_SIZE") or PAGE_SIZE)
            last = int(head.get("PAGE_COUNT") or 0) or max(1, -(-total // max(1, size)))
            items = said.get("body")
        except (ValueError, AttributeError):
            return found, True
        if "TOTAL_COUNT" in head:
            totals.add(total)
        if not items:
            break
        rows += len(items)
        page += 1
    return found, len(totals) < 2 and (not totals or rows in totals)


class _Theme(InputPartition):
    def __init__(self, theme: str) -> None:
        self.theme = theme


class PagedThemes(DataSource):
    """``format("paged_themes")``: option ``themes`` (comma list) and ``folder`` of ``<theme>-<page>.json`` files,
    or a subclass whose ``getter`` fetches pages.  Gives ``theme, attempt, page_no, http_status, body``.

    A theme whose pages don't add up to the announced rows, or whose pages disagree on them, is fetched once more (I6);
    only its last attempt is given."""

    @classmethod
    def name(cls) -> str:
        return "paged_themes"

    def schema(self) -> str:
        return "theme string, attempt int, page_no int, http_status int, body string"

    def getter(self) -> Getter:
        folder = self.options["folder"]

        def get(params: dict[str, str]) -> tuple[int, str]:
            try:
                with open(f"{folder}/{params['theme']}-{params['page']}.json", encoding="utf-8") as file:
                    return 200, file.read()
            except FileNotFoundError:
                return 404, ""

        return get

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        source, get = self, retrying(self.getter(), first_wait=float(self.options.get("wait", "1")))

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [_Theme(t) for t in source.options.get("themes", "").split(",") if t]

            def read(self, partition: _Theme) -> Iterator[tuple]:
                for attempt in (1, 2):
                    pages, complete = fetch_pages(get, partition.theme)
                    if complete or attempt == 2:
                        yield from ((partition.theme, attempt, *page) for page in pages)
                        return

        return Reader()
