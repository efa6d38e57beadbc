"""Problem 1: splitting oversized texts at natural boundaries by structure-tree packing."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2_000
OVERLAP = 200

#: Levels of the structure tree, outermost first; each pattern matches where a child of that level begins.
_HEADINGS = [re.compile(rf"^(?:#{{{k}}}(?=[ \t])|<h{k}(?=[ \t>]))", re.M) for k in range(1, 7)]
_BLOCK = re.compile(r"\n[ \t\r]*\n\s*(?=\S)")
_TOP_LINE = re.compile(r"^(?=\S)", re.M)
_LINE = re.compile(r"^", re.M)
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]\s*")
_WORD = re.compile(r"\s+")
_LEVELS = [*_HEADINGS, _BLOCK, _TOP_LINE, _LINE, _SENTENCE, _WORD]
_AT_START = {*_HEADINGS, _TOP_LINE, _LINE}
_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[ \t]*$|\Z)", re.M | re.S)
_WHOLE_FENCE_LEVELS = len(_HEADINGS) + 1  # fenced code stays whole for headings and blocks
_IS_HEADING = re.compile(r"[ \t]*(?:#{1,6}[ \t]|<h[1-6][ \t>])")


def _children(text: str, start: int, end: int, level: int, fences: list[tuple[int, int]]) -> tuple[list[int], int]:
    """Cut points of the first level from ``level`` on that divides the span, and the level after it."""
    while level < len(_LEVELS):
        pattern = _LEVELS[level]
        if pattern in _AT_START:
            cuts = [m.start() for m in pattern.finditer(text, start, end) if start < m.start() < end]
        else:
            cuts = [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]
        if fences and level < _WHOLE_FENCE_LEVELS:
            cuts = [c for c in cuts if not any(a < c < b for a, b in fences)]
        level += 1
        if cuts:
            return cuts, level
    return [], level


def _safe_cut(text: str, start: int, cut: int) -> int:
    """A cut that does not part a base character from its combining marks or joiners, unless there is none in the whole span."""
    least = start + 1
    at = cut
    while at > least and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at if at > least else cut


def _overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the repeated tail of the piece ``[start, end)`` begins: at a line, sentence or word in its first quarter."""
    low = max(start, end - overlap)
    if low == start:
        return low
    high = low + overlap // 4
    for pattern in (_LINE, _SENTENCE, _WORD):
        for m in pattern.finditer(text, low - 1, high):
            at = m.start() if pattern is _LINE else m.end()
            if low <= at <= high and at < end:
                return at
    return _safe_cut(text, low, low + 1) if low + 1 < end else low


def _pack(text: str, start: int, end: int, level: int, most: int, fences: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """Parts ``(start, end, heading)`` of a node, each at most ``most`` long: the node itself if it fits, else the parts of its children, siblings merged."""
    if end - start <= most:
        line = text.rfind("\n", start, start + len(text[start:end].rstrip()))
        return [(start, end, bool(_IS_HEADING.match(text, max(start, line + 1))) and line < start)]
    cuts, below = _children(text, start, end, level, fences)
    if not cuts:  # a word
        at, parts = start, []
        while end - at > most:
            cut = _safe_cut(text, at, at + most)
            parts.append((at, cut, False))
            at = cut
        return [*parts, (at, end, False)]
    edges = [start, *cuts, end]
    return _merged([p for a, b in zip(edges, edges[1:]) for p in _pack(text, a, b, below, most, fences)], most)


def _merged(parts: list[tuple[int, int, bool]], most: int) -> list[tuple[int, int, bool]]:
    """Neighbours joined from left to right while they fit, which gives the fewest parts; headings at the end of a part move to what they head if that leaves both within the limit."""
    out: list[list[tuple[int, int, bool]]] = []
    for part in parts:
        if out and part[1] - out[-1][0][0] <= most:
            out[-1].append(part)
            continue
        moved: list[tuple[int, int, bool]] = []
        while out and len(out[-1]) > 1 and out[-1][-1][2] and part[1] - out[-1][-1][0] <= most:
            moved.insert(0, out[-1].pop())
        out.append([*moved, part])
    return [(g[0][0], g[-1][1], len(g) == 1 and g[0][2]) for g in out]


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces as ``(start, new, end)`` code-point offsets: ``[start, new)`` repeats the piece before, ``[new, end)`` is new.

    The text is a tree: headings by level, blocks, list items and table rows, lines, sentences, words. From the leaves up, sibling subtrees are merged as long as they fit
    into a piece; only nodes that do not fit are opened. A heading moves on to the piece of what it heads. A word above the limit is cut between characters. The new
    parts joined give the text. Null and empty texts have no pieces, a text within the limit is one piece.
    """
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    fences = [m.span() for m in _FENCE.finditer(text)] if "```" in text or "~~~" in text else []
    done = _pack(text, 0, len(text), 0, limit - overlap, fences)
    return [(_overlap_start(text, done[k - 1][0], a, overlap) if k and overlap else a, a, b) for k, (a, b, _) in enumerate(done)]


def split_documents(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text above ``limit``: ``(key, text_key, piece_no, n_pieces, start, new_from, end, piece)``.

    ``piece`` has at most ``limit`` characters (code points) and is ``text[start:end]``; its first ``new_from - start`` characters repeat the end
    of the piece before. ``text_key`` (xxhash64 of the text) tells readings of one key apart. Null, empty and short texts give no
    row; a null key is kept; repeated rows give repeated pieces (drop duplicates of ``(key, text_key, piece_no)`` where
    that matters); other columns are not read. Whole texts stay in one task, one at a time; nothing is shuffled.
    """
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            keys, marks, texts = batch.columns
            at, columns = [], ([], [], [], [], [], [])
            number, total, starts, news, ends, pieces = columns
            weight = 0
            for k in range(batch.num_rows):
                value = texts[k].as_py()
                spans = split_text(value, limit, overlap)
                for n, (a, new, b) in enumerate(spans, 1):
                    at.append(k)
                    number.append(n)
                    total.append(len(spans))
                    starts.append(a)
                    news.append(new)
                    ends.append(b)
                    pieces.append(value[a:b])
                weight += len(value)
                if weight > 4_000_000 or k == batch.num_rows - 1:
                    if at:
                        take = pa.array(at, pa.int32())
                        ints = [pa.array(c, pa.int32()) for c in columns[:-1]]
                        yield pa.RecordBatch.from_arrays([keys.take(take), marks.take(take), *ints, pa.array(pieces, pa.string())], schema.fieldNames())
                    weight = 0
                    for c in (at, *columns):
                        c.clear()

    ints = [T.StructField(n, T.IntegerType()) for n in ("piece_no", "n_pieces", "start", "new_from", "end")]
    schema = T.StructType([T.StructField(key, kind), T.StructField("text_key", T.LongType()), *ints, T.StructField("piece", T.StringType())])
    value = df[text].cast("string")
    long = df.filter(F.char_length(value) > limit).select(df[key].alias("key"), F.xxhash64(value).alias("text_key"), value.alias("text"))
    return long.mapInArrow(run, schema)
