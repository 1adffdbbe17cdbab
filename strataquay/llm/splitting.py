"""Oversized texts cut into overlapping pieces at natural boundaries.

A text longer than one range is taken apart into ranges with a halo.  Workers find
the tokens and natural boundaries of each range by itself; the ranges' boundary
tables are stitched in order, prefix sums of their token lengths place the cuts,
and the pieces are put together by offset.  Files are read by byte ranges only, for
the tables and again for the pieces; no task ever loads a whole file.
A table's text of one range has its whole boundary table at hand and is cut where it
is read, without any shuffle, into the same pieces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .tokens import VOCABULARY, encoder

#: Kinds of boundary; ``TORN`` is the end of a range inside a word, beyond which tokens may fall otherwise.
TORN, INSIDE, WORD, SENTENCE, LINE, PARAGRAPH = -2, -1, 0, 1, 2, 3
# look-behinds and possessive repetitions: every run is walked once
_BREAKS = regex.compile(r"(?<!\s)[^\S\r\n\u2028\u2029]*+(?:\r\n|\r|\n|\u2028|\u2029)\s*+")
_NEWLINE = regex.compile(r"\r\n|\r|\n|\u2028")
_SENTENCE = regex.compile(r"(?<![.!?…。！？])(?:[.!?…。！？]++[\"'”’」』)\]]*+(?=\s|$)|[。！？]++[」』”’]*+)")
#: Words of more tokens than this may be cut inside; shorter ones are units.
_LONG_WORD = 12
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, as the tokenizer's pattern tells them apart."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x32000):  # no letters, digits or blanks are assigned beyond
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = _LETTER
        elif kind == "N":
            table[code] = _DIGIT
        elif kind == "Z":
            table[code] = _SPACE
    table[[9, 10, 11, 12, 13, 0x85]] = _SPACE
    return table


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> np.ndarray:
    coder = encoder(path)
    return np.array([len(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)], np.int64)


def _meeting_point(text: str, at: int, halo: int) -> int:
    """The first place from ``at`` on, within the halo, where white space follows something else.

    Tokens of the text on either side don't depend on each other there.  Both
    neighbours of a range boundary see the same letters and agree on the place; where
    there is none, it is ``at`` itself.
    """
    if at <= 0:
        return 0
    if at >= len(text):
        return len(text)
    for i in range(at, min(at + halo, len(text))):
        if text[i].isspace() and not text[i - 1].isspace():
            return i
    return at


def boundary_table(text: str, path: str, tokens: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit ends, tokens of each unit, and the kind of boundary after it, for one stretch of text."""
    tokens = np.array(encoder(path).encode_ordinary(text) if tokens is None else tokens, np.int64)
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    raw = np.frombuffer(text.encode(), np.uint8)
    leads = (raw & 0xC0) != 0x80
    letters_before = np.r_[0, np.cumsum(leads)]
    ends = np.cumsum(_token_bytes(path)[tokens])
    whole = np.r_[leads, True][ends]  # the token ends together with a letter
    at = letters_before[ends]
    size = len(text)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = _classes()[codes]
    # where the pattern parts words: tokens on either side don't depend on each other
    parted = np.ones(size + 1, bool)
    before, after = classes[:-1], classes[1:]
    both = (before == _SPACE) & (after == _SPACE)
    last_of_run = np.r_[classes[2:] != _SPACE, False] if size > 1 else np.zeros(0, bool)
    parted[1:size] = np.where(both, last_of_run, np.where(before == _SPACE, codes[:-1] != 32, (after == _SPACE) | ((before != after) & (codes[:-1] != 39))))
    marks = np.where(parted, WORD, INSIDE).astype(np.int8)
    for found in _SENTENCE.finditer(text):
        if parted[found.end()]:
            marks[found.end()] = SENTENCE
    for found in _BREAKS.finditer(text):
        kind = PARAGRAPH if len(_NEWLINE.findall(found[0])) > 1 else LINE
        # the next word may begin with the last blank of the run
        for place in (found.end() - 1, found.end()):
            if place > found.start() and parted[place]:
                marks[place] = max(marks[place], kind)
    word = np.r_[0, np.cumsum(parted[at])[:-1]]  # running number of each token's word
    kept = whole & (parted[at] | (np.bincount(word)[word] > _LONG_WORD))
    kept[-1] = True
    places = np.flatnonzero(kept)
    return at[places], np.diff(np.r_[-1, places]), marks[at[places]]


class Cutter:
    """Places the cuts of one text while its boundary tables come in, in order.

    Only the units since the last cut are held.  A piece ends at the last
    paragraph, else line, sentence or word end in its second half, else at its last
    unit; the next one begins at the unit that shares most nearly ``overlap`` tokens,
    a word's beginning if one is near.  Cuts are start, end, tokens and whether the piece begins and
    ends between words and no range tore one inside, so that its tokens are sure.
    """

    def __init__(self, most: int, overlap: int, start: int = 0) -> None:
        self.most, self.overlap, self.start, self.clean = most, overlap, start, True
        self.ends, self.upto, self.kinds, self.gone = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), 0

    def lead(self, ends: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> None:
        """Units before a segment: its first piece begins among them, to share ``overlap`` tokens with the piece before."""
        if len(ends):
            self.ends, self.upto, self.kinds = ends, np.cumsum(sizes), kinds
            self._begin(len(ends) - 1)

    def feed(self, ends: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
        last = self.upto[-1] if len(self.upto) else self.gone
        self.ends, self.upto, self.kinds = np.r_[self.ends, ends], np.r_[self.upto, last + np.cumsum(sizes)], np.r_[self.kinds, kinds]
        while len(self.upto) and self.upto[-1] - self.gone > self.most:
            fits = max(1, int(np.searchsorted(self.upto, self.gone + self.most, "right")))
            second_half = max(0, min(int(np.searchsorted(self.upto, self.gone + self.most / 2, "left")), fits - 1))
            cut = fits - 1
            for kind in (PARAGRAPH, LINE, SENTENCE, WORD):
                places = np.flatnonzero(self.kinds[second_half:fits] >= kind)
                if len(places):
                    cut = second_half + int(places[-1])
                    break
            yield self._piece(cut)
            self._begin(cut)

    def finish(self) -> Iterator[tuple[int, int, int, bool]]:
        if len(self.upto):
            yield self._piece(len(self.upto) - 1)

    def _piece(self, cut: int) -> tuple[int, int, int, bool]:
        sure = self.clean and self.kinds[cut] >= WORD and not (self.kinds[:cut] == TORN).any()
        return self.start, int(self.ends[cut]), int(self.upto[cut] - self.gone), bool(sure)

    def _begin(self, cut: int) -> None:
        # tokens shared if the next piece begins after unit i: upto[cut] - upto[i]
        first = cut
        if self.overlap and cut:
            miss = np.abs(self.upto[cut] - self.upto[:cut] - self.overlap)
            nearest = int(np.argmin(np.where(self.kinds[:cut] >= WORD, miss, miss + self.overlap // 4)))
            if miss[nearest] < self.overlap:
                first = nearest
        self.start, self.clean, self.gone = int(self.ends[first]), bool(self.kinds[first] >= WORD), int(self.upto[first])
        self.ends, self.upto, self.kinds = self.ends[first + 1 :], self.upto[first + 1 :], self.kinds[first + 1 :]


def _segment_edge(sizes: np.ndarray, kinds: np.ndarray) -> int:
    """Units of a segment's last range that belong to it: up to the last natural boundary of the best kind in its second half."""
    upto = np.cumsum(sizes)
    half = int(np.searchsorted(upto, upto[-1] / 2, "left"))
    for kind in (PARAGRAPH, LINE, SENTENCE, WORD):
        places = np.flatnonzero(kinds[half:] >= kind)
        if len(places):
            return half + int(places[-1]) + 1
    return len(sizes)


def _fit(text: str, most: int, path: str) -> Iterator[tuple[str, int, int]]:
    """``text`` if it has at most ``most`` tokens, else parts that do: text, offset and tokens.

    Needed only where a piece begins or ends within a word, whose tokens may then fall otherwise.
    """
    encode, at = encoder(path).encode_ordinary, 0
    while at < len(text):
        size, end = len(encode(text[at:])), len(text)
        while size > most:
            end = at + max(1, min(end - at - 1, (end - at) * most // size))
            size = len(encode(text[at:end]))
        yield text[at:end], at, size
        at = end


Rules = Sequence[tuple[str, int, int]]
_NAMES = ["limit_name", "id", "cut_no", "start", "end", "tokens", "piece"]
_TABLE = "tokens bigint, steps binary, sizes binary, kinds binary"


def _rules_of(limits: DataFrame, name: str, max_tokens: str, overlap_tokens: str) -> list[tuple[str, int, int]]:
    """Name, most tokens and overlap of every limit; the table has a row a setting."""
    rows = limits.select(name, max_tokens, overlap_tokens).collect()
    return [(r[0], int(r[1]), min(int(r[2] or 0), max(0, (int(r[1]) - 1) // 2))) for r in rows if r[1] and r[1] > 0]


def _packed(ends: np.ndarray, sizes: np.ndarray, kinds: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    return int(sizes.sum()), np.diff(np.r_[0, ends]).astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), kinds.tobytes()


def _unpacked(start: int, steps: bytes, sizes: bytes, kinds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(steps, "<u4").astype(np.int64)) + start, np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(kinds, np.int8)


def _stitched(measured: DataFrame, rules: Rules, segment_ranges: int, id_type: str) -> DataFrame:
    """``limit_name, id, cut_no, start, end, size, most`` from ``id, range_no, start`` and the ranges' tables.

    Sums of the ranges' tokens tell which texts are above a limit.  A text's ranges stream through a task in order, which
    holds the units since the last cut; very long texts are planned in segments of
    ``segment_ranges`` ranges, in parallel, whose edges are natural boundaries, and the
    prefix sums of the segments' cuts number them.
    """
    spark = measured.sparkSession
    smallest = min((most for _, most, _ in rules), default=0)
    totals = measured.groupBy("id").agg(F.sum("tokens").alias("_all"), F.max("range_no").alias("_last")).where(F.col("_all") > smallest)
    own = F.floor(F.col("range_no") / segment_ranges).cast("int")
    # a segment's last range also leads into the next one
    leads = (F.pmod(F.col("range_no") + 1, F.lit(segment_ranges)) == 0) & (F.col("range_no") < F.col("_last"))
    tables = (
        measured.select("id", "range_no", "start", "steps", "sizes", "kinds").join(totals, "id")
        .withColumn("_segment", F.explode(F.when(leads, F.array(own, own + 1)).otherwise(F.array(own))))
    )

    def stitch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cutters, out = None, [], []
        number: dict[str, int] = {}
        follows: dict[str, int] = {}  # where the next segment's first piece begins: it holds whatever begins later here

        def emit(cuts: Iterator[tuple], rule: tuple, doc: object, segment: int) -> None:
            for a, b, size, sure in cuts:
                if a >= follows.get(rule[0], b):
                    continue
                number[rule[0]] = number.get(rule[0], -1) + 1
                out.append((rule[0], doc, segment, number[rule[0]], a, b, size if sure else -1, rule[1]))

        for frame in frames:
            rows = frame[["id", "_segment", "_all", "_last", "range_no", "start", "steps", "sizes", "kinds"]]
            for doc, segment, whole, last, range_no, start, *packed in rows.itertuples(index=False, name=None):
                table = _unpacked(start, *packed)
                lead = range_no < segment * segment_ranges
                if (doc, segment) != key:
                    for rule, cutter in cutters:
                        emit(cutter.finish(), rule, *key)
                    key, number, follows = (doc, segment), {}, {}
                    cutters = [(rule, Cutter(rule[1], rule[2])) for rule in rules if whole > rule[1]]
                edge = _segment_edge(table[1], table[2]) if lead or ((range_no + 1) % segment_ranges == 0 and range_no < last) else None
                for rule, cutter in cutters:
                    if lead:
                        cutter.lead(*[part[:edge] for part in table])
                        emit(cutter.feed(*[part[edge:] for part in table]), rule, doc, segment)
                        continue
                    own = [part[:edge] for part in table]
                    if edge is not None:
                        follower = Cutter(rule[1], rule[2])
                        follower.lead(*own)
                        follows[rule[0]] = follower.start
                    emit(cutter.feed(*own), rule, doc, segment)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        for rule, cutter in cutters:
            emit(cutter.finish(), rule, *key)
        yield pd.DataFrame(out, columns=columns)

    columns = ["limit_name", "id", "_segment", "_place", "start", "end", "size", "most"]
    cuts = (
        tables.repartition(shuffle_partitions(spark), "id", "_segment").sortWithinPartitions("id", "_segment", "range_no")
        .mapInPandas(stitch, f"limit_name string, id {id_type}, _segment int, _place int, start bigint, end bigint, size int, most int")
    )
    cuts = materialize(cuts)
    # a text of one segment has its numbers already; only the others' segments are counted
    counts = cuts.groupBy("limit_name", "id", "_segment").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("limit_name", "id").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", before).where("_before > 0").drop("_n")
    return cuts.join(offsets, ["limit_name", "id", "_segment"], "left").select(
        "limit_name", "id", (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int").alias("cut_no"), "start", "end", "size", "most"
    )


def split_texts(
    documents: DataFrame,
    limits: DataFrame,
    *,
    id_column: str,
    text: str,
    name: str,
    max_tokens: str,
    overlap_tokens: str,
    range_chars: int = 16_384,
    halo_chars: int = 512,
    segment_ranges: int = 256,
    in_place_chars: int | None = None,
    path: str = VOCABULARY,
) -> DataFrame:
    """``limit_name, id, cut_no, start, end, tokens, piece`` of every text above a limit.

    ``limits`` has one row a limit and is a small table.  ``start`` and ``end``
    are offsets in code points; ``cut_no`` counts the pieces from 0 and repeats only where a
    piece that begins within a long word had to be cut once more: these parts adjoin and share no tokens.  The pieces of a text cover it from 0 to its end,
    each has at most ``max_tokens``, and neighbours share about
    ``overlap_tokens`` (to the nearest token boundary that is also a letter's;
    an overlap of half the limit or more is cut to just under it).  Texts within the limit, null and
    empty texts have no rows.  Ids must be unique.

    Texts of at most ``in_place_chars`` letters (default and most: one range) are cut where they are read, into
    the pieces that the ranges would give: a text of one range has one boundary table either way.
    Giant files are read by :func:`split_files`; a table's text is one value, which its reader holds anyway.
    """
    spark = documents.sparkSession
    rules = _rules_of(limits, name, max_tokens, overlap_tokens)
    smallest = min((most for _, most, _ in rules), default=None)
    in_place = range_chars if in_place_chars is None else min(in_place_chars, range_chars)
    chosen = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    # a letter has at most four bytes and a token at least one: shorter texts can't be above any limit
    chosen = chosen.where(F.lit(False) if smallest is None else F.octet_length("text") > smallest)
    schema = "limit_name string, id bigint, cut_no int, start bigint, end bigint, tokens int, piece string"

    def cut_short(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            encode = encoder(path).encode_ordinary
            for doc, whole in frame[["id", "text"]].itertuples(index=False, name=None):
                tokens = encode(whole)
                if len(tokens) <= smallest:
                    continue
                table = boundary_table(whole, path, tokens)
                for limit, most, overlap in rules:
                    if len(tokens) <= most:
                        continue
                    cutter = Cutter(most, overlap)
                    for number, (a, b, size, sure) in enumerate([*cutter.feed(*table), *cutter.finish()]):
                        parts = [(whole[a:b], 0, size)] if sure else _fit(whole[a:b], most, path)
                        out += [(limit, doc, number, a + at, a + at + len(cut), tokens, cut) for cut, at, tokens in parts]
            yield pd.DataFrame(out, columns=_NAMES)

    short = chosen.where(F.char_length("text") <= in_place).mapInPandas(cut_short, schema)
    chosen = chosen.where(F.char_length("text") > in_place)

    def into_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            held = 0
            for doc, whole in frame[["id", "text"]].itertuples(index=False, name=None):
                for number, start in enumerate(range(0, len(whole), range_chars)):
                    lead = max(0, start - 1)
                    out.append((doc, number, start, start - lead, start + range_chars < len(whole), whole[lead : start + range_chars + halo_chars + 1]))
                    held += range_chars
                    if held > 8_000_000:
                        yield pd.DataFrame(out, columns=["id", "range_no", "start", "lead", "more", "stretch"])
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=["id", "range_no", "start", "lead", "more", "stretch"])

    ranges = chosen.mapInPandas(into_ranges, "id bigint, range_no int, start bigint, lead int, more boolean, stretch string")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, number, start, lead, more, stretch in frame[["id", "range_no", "start", "lead", "more", "stretch"]].itertuples(index=False, name=None):
                begin = _meeting_point(stretch, lead, halo_chars) if start else 0
                end = _meeting_point(stretch, lead + range_chars, halo_chars) if more else len(stretch)
                own = stretch[begin:end]
                if not own:
                    continue
                ends, sizes, kinds = boundary_table(own, path)
                if end < len(stretch) and not (stretch[end].isspace() and not stretch[end - 1].isspace()):
                    kinds[-1] = TORN
                at = start - lead + begin
                out.append((doc, number, at, at + len(own), *_packed(ends, sizes, kinds), own))
            yield pd.DataFrame(out, columns=["id", "range_no", "start", "end", "tokens", "steps", "sizes", "kinds", "own"])

    measured = materialize(
        ranges.repartition(shuffle_partitions(spark), "id", "range_no").mapInPandas(
            measure, f"id bigint, range_no int, start bigint, end bigint, {_TABLE}, own string"
        )
    )
    cuts = _stitched(measured, rules, segment_ranges, "bigint")
    # --- put the pieces together by offset from the ranges they touch ----------------------
    # own parts begin up to a halo behind their range's nominal start
    touched = cuts.withColumn(
        "range_no",
        F.explode(
            F.sequence(
                F.greatest(F.floor((F.col("start") - halo_chars) / range_chars), F.lit(0)).cast("int"), F.floor((F.col("end") - 1) / range_chars).cast("int")
            )
        ),
    )
    texts = measured.select("id", "range_no", F.col("start").alias("_at"), F.col("end").alias("_to"), "own")
    slices = touched.join(texts, ["id", "range_no"]).where((F.col("_at") < F.col("end")) & (F.col("_to") > F.col("start")))
    part = F.substring(
        "own",
        (F.greatest(F.col("start") - F.col("_at"), F.lit(0)) + 1).cast("int"),
        (F.least("end", "_to") - F.greatest("start", "_at")).cast("int"),
    )
    joined = slices.groupBy("limit_name", "id", "cut_no", "start", "size", "most").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", part.alias("part")))), lambda s: s["part"]), "").alias("piece")
    )

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for limit, doc, number, start, size, most, piece in frame[["limit_name", "id", "cut_no", "start", "size", "most", "piece"]].itertuples(index=False, name=None):
                if size >= 0:
                    out.append((limit, doc, number, start, start + len(piece), size, piece))
                    continue
                for cut, at, size in _fit(piece, most, path):
                    out.append((limit, doc, number, start + at, start + at + len(cut), size, cut))
            yield pd.DataFrame(out, columns=_NAMES)

    return short.unionByName(joined.mapInPandas(finish, schema))


# --- files, read by byte ranges only -----------------------------------------------------------------


def _letter_start(raw: bytes, at: int) -> int:
    """The first byte from ``at`` on that begins a letter."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _decoded(raw: bytes) -> tuple[str, np.ndarray]:
    """The text of ``raw``, each broken byte as one mark, and the offset in bytes of every letter and of the end."""
    text = raw.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    broken = (codes >= 0xDC80) & (codes <= 0xDCFF)
    widths = np.where(broken, 1, 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000))
    if broken.any():
        text = re.sub("[\udc80-\udcff]", "\ufffd", text)
    return text, np.r_[0, np.cumsum(widths)]


def _byte_meeting_point(raw: bytes, at: int, halo: int) -> int:
    """As ``_meeting_point``, in bytes: at a white space after something else, or at the first letter from ``at`` on."""
    first = _letter_start(raw, at)
    before = max(0, first - 1)
    while before > 0 and raw[before] & 0xC0 == 0x80:
        before -= 1
    text, places = _decoded(raw[before : first + halo + 4])
    for i in range(1, len(text)):
        if before + places[i] > at + halo:
            break
        if text[i].isspace() and not text[i - 1].isspace():
            return before + int(places[i])
    return first


def list_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Path and length of every file that ``paths`` (files, folders or patterns) name: names and lengths only."""
    found: dict[str, int] = {}
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        todo = list(system.globStatus(hadoop) or [])
        while todo:
            status = todo.pop()
            if status.isDirectory():
                todo += list(system.listStatus(status.getPath()))
            else:
                found[status.getPath().toString()] = status.getLen()
    return sorted(found.items())


def _opened(path: str):
    """A random-access file on any storage pyarrow reaches."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def split_files(
    spark: SparkSession,
    paths: Sequence[str],
    limits: DataFrame,
    *,
    name: str,
    max_tokens: str,
    overlap_tokens: str,
    range_bytes: int = 1 << 20,
    halo_bytes: int = 2048,
    segment_ranges: int = 64,
    path: str = VOCABULARY,
) -> DataFrame:
    """``limit_name, id, cut_no, start, end, tokens, piece`` of every text file above a limit; ``id`` is the file's path.

    As :func:`split_texts`, for files of any size: the driver sees names and lengths, a
    worker reads one range of bytes with its halo and keeps the range's boundary table, and
    the pieces are read again by their offsets (``start`` and ``end``, in bytes).
    Text is UTF-8; each broken byte stands as U+FFFD.  Files within the limit and empty files have no rows.
    """
    rules = _rules_of(limits, name, max_tokens, overlap_tokens)
    smallest = min((most for _, most, _ in rules), default=None)
    files = [(f, n) for f, n in list_files(spark, paths) if smallest is not None and n > smallest]
    listed = spark.createDataFrame(files, "id string, length bigint")
    ranges = listed.select("id", "length", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("length") / range_bytes) - 1).cast("int"))).alias("range_no"))
    slots = max(shuffle_partitions(spark), min(100_000, -(-sum(n for _, n in files) // (32 * range_bytes)) or 1))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, length, number in frame[["id", "length", "range_no"]].itertuples(index=False, name=None):
                start = number * range_bytes
                low, high = max(0, start - 4), min(length, start + range_bytes + halo_bytes + 8)
                with _opened(file) as opened:
                    raw = opened.read_at(high - low, low)
                begin = _byte_meeting_point(raw, start - low, halo_bytes) if start else 0
                more = start + range_bytes < length
                end = _byte_meeting_point(raw, start + range_bytes - low, halo_bytes) if more else len(raw)
                if end <= begin:
                    continue
                own, places = _decoded(raw[begin:end])
                ends, sizes, kinds = boundary_table(own, path)
                rest = _decoded(raw[end : end + 4])[0]
                if more and not (rest[:1].isspace() and not own[-1].isspace()):
                    kinds[-1] = TORN
                yield pd.DataFrame([(file, number, low + begin, *_packed(places[ends], sizes, kinds))], columns=["id", "range_no", "start", "tokens", "steps", "sizes", "kinds"])

    measured = materialize(ranges.repartition(slots, "id", "range_no").mapInPandas(measure, f"id string, range_no int, start bigint, {_TABLE}"))
    cuts = _stitched(measured, rules, segment_ranges, "string")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, opened = None, None
        for frame in frames:
            out = []
            for limit, file, number, start, end, size, most in frame[["limit_name", "id", "cut_no", "start", "end", "size", "most"]].itertuples(index=False, name=None):
                if file != current:
                    if opened is not None:
                        opened.close()
                    current, opened = file, _opened(file)
                piece, places = _decoded(opened.read_at(end - start, start))
                if size >= 0:
                    out.append((limit, file, number, start, end, size, piece))
                    continue
                for cut, at, size in _fit(piece, most, path):
                    out.append((limit, file, number, start + int(places[at]), start + int(places[at + len(cut)]), size, cut))
            yield pd.DataFrame(out, columns=_NAMES)
        if opened is not None:
            opened.close()

    spread = cuts.repartition(slots, "id", F.floor(F.col("start") / (16 * range_bytes))).sortWithinPartitions("id", "start")
    return spread.mapInPandas(read, "limit_name string, id string, cut_no int, start bigint, end bigint, tokens int, piece string")
