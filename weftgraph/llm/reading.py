"""Problem 10: reading level of each document.

For each grade an interpolated bigram model is trained on all graded documents. Sentences of graded
texts are mixed, so the models are refined: each sentence is weighted over the grades by what the models say of it, and the models are trained again. The distribution
of a document's surprisals, over all its words, is summed up by mean and spread under every model, by quantiles of the surprisal under the best model and of its
difference between the easiest and the hardest model, and by the grade expected of its sentences. A ridge regression on held-out texts puts this distribution on one line,
and isotonic regression maps the line to the readers' grades. Every document is scored over its whole text.

Counts of bigrams are summed by the cluster, in whole steps of 1 / ``STEP``, so that their order is of no matter; regression needs sums, and monotone blocks of key ranges are pooled again
into those of the whole. Models are tables in the shared folder, which tasks read into files of their own and map, so that no process holds them.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import discard, materialize

GRADES = 5
MIN_COUNT = 3
BIGRAM, UNIGRAM = 0.6, 0.95
ROUNDS = 3
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
RIDGE = 3.0
STEP = 1 << 24
WHOLE = 2  # number of the model of all graded texts; 0 and 1 are those without one half
_TOKEN = regex.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+|[.!?]+(?=\s|$)|\n")
_OUT, _NUMBER = 0, 1


class Words(dict):
    """Word to id; what isn't known is 0, sentence ends are -1."""

    def __missing__(self, word: str) -> int:
        if word[0] in ".!?\n":
            return -1
        return _NUMBER if word[0].isdigit() else _OUT


def read(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all texts, the number of each word's sentence, and each sentence's text."""
    ids, lengths = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if text:
            found = list(map(words.__getitem__, _TOKEN.findall(text.lower())))
            ids += found
            lengths[k] = len(found)
    flat = np.array(ids, np.int32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = flat < 0
    new_text = np.r_[True, owner[1:] != owner[:-1]] if len(flat) else np.zeros(0, bool)
    starts = new_text | np.r_[False, ends[:-1]] if len(flat) else np.zeros(0, bool)
    sentence = np.cumsum(starts) - 1
    keep = ~ends
    flat, sentence, owner = flat[keep], sentence[keep], owner[keep]
    _, sentence = np.unique(sentence, return_inverse=True)
    first = np.r_[True, sentence[1:] != sentence[:-1]] if len(flat) else np.zeros(0, bool)
    return flat, sentence, owner[first] if len(flat) else owner


def pairs_of(ids: np.ndarray, sentence: np.ndarray, size: int) -> np.ndarray:
    """Bigram codes; the word before a sentence's first is number ``size``."""
    before = np.r_[size, ids[:-1]].astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    if len(ids):
        before[np.r_[True, sentence[1:] != sentence[:-1]]] = size
    return before * size + ids


def tally(ids: np.ndarray, sentence: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigram codes in order and their weights of each grade; ``weight`` is (sentences, GRADES)."""
    w = weight[sentence]
    seen, at = np.unique(pairs_of(ids, sentence, size), return_inverse=True)
    return seen, np.stack([np.bincount(at, w[:, g], len(seen)) for g in range(GRADES)], axis=1)


def sums(parts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of every word and of every context, from the bigrams' in parts ``(seen, two)``."""
    one, after = np.zeros((size, GRADES)), np.zeros((size + 1, GRADES))
    for seen, two in parts:
        for g in range(GRADES):
            one[:, g] += np.bincount(seen % size, two[:, g], size)
            after[:, g] += np.bincount(seen // size, two[:, g], size + 1)
    return one, after


def smoothed(parts, one: np.ndarray, after: np.ndarray, size: int, n_words: int, space) -> dict:
    """Interpolated bigram models of all grades over ``n_words`` words; ``space(dtype, *shape)`` gives the arrays of the bigrams, as many as ``parts`` hold."""
    single = UNIGRAM * one / np.maximum(one.sum(0), 1e-9) + (1 - UNIGRAM) / n_words
    trust = BIGRAM * after / (after + 1.0)  # the less a context was seen under a grade, the more its unigrams count
    seen, both, at = space(np.int64), space(np.float32, GRADES), 0
    for codes, two in parts:
        context, word = codes // size, codes % size
        seen[at : at + len(codes)] = codes
        both[at : at + len(codes)] = -np.log2(trust[context] * two / np.maximum(after[context], 1e-9) + (1 - trust[context]) * single[word])
        at += len(codes)
    return {"size": size, "seen": seen, "both": both, "single": -np.log2(single).astype(np.float32), "back": -np.log2(1 - trust).astype(np.float32)}


def fit(ids: np.ndarray, sentence: np.ndarray, weight: np.ndarray, size: int) -> dict:
    """Models of words in memory."""
    part = tally(ids, sentence, weight, size)
    return smoothed([part], *sums([part], size), size, size, lambda kind, *more: np.zeros((len(part[0]), *more), kind))


def surprisal(model: dict, ids: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Bits of every word under every grade's model."""
    size, seen = model["size"], model["seen"]
    codes = pairs_of(ids, sentence, size)
    at = np.minimum(np.searchsorted(seen, codes), len(seen) - 1)
    out = model["both"][at]
    miss = seen[at] != codes
    out[miss] = model["single"][ids[miss]] + model["back"][codes[miss] // size]
    return out


def known_ids(model: dict, ids: np.ndarray) -> np.ndarray:
    """Words that the model does not know are 0."""
    return np.where(model["known"][ids], ids, _OUT) if "known" in model else ids


def sentence_bits(model: dict, ids: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Total bits (sentences, GRADES), words and unknown words of every sentence."""
    starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    bits = np.add.reduceat(surprisal(model, ids, sentence), starts, axis=0)
    words = np.diff(np.r_[starts, len(ids)])
    return bits, words, np.add.reduceat((ids == _OUT).astype(np.int64), starts)


def posterior(bits: np.ndarray) -> np.ndarray:
    p = np.exp2(np.maximum(-bits + bits.min(axis=1, keepdims=True), -60.0))
    return p / p.sum(axis=1, keepdims=True)


def _quantiles(values: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Quantiles of the values of each owner (numbered, with ``n`` values each)."""
    ordered = values[np.lexsort((values, owner))]
    starts = np.cumsum(n) - n
    some = n > 0
    out = np.zeros((len(n), len(QUANTILES)))
    for k, q in enumerate(QUANTILES):
        out[some, k] = ordered[starts[some] + np.floor(q * (n[some] - 1)).astype(np.int64)]
    return out


def text_features(model: dict, words: Words, texts: list[str | None]) -> np.ndarray:
    """A row for each text: expected grade of its words, bits a word under the best model of each sentence, share of known words, then the distribution of its surprisals."""
    out = np.full((len(texts), 3 + 2 * GRADES + 2 * len(QUANTILES)), np.nan)
    ids, sentence, owner = read(texts, words)
    if not len(ids):
        return out
    ids = known_ids(model, ids)
    each = surprisal(model, ids, sentence)
    starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
    bits, count = np.add.reduceat(each, starts, axis=0), np.diff(np.r_[starts, len(ids)])
    unknown = np.add.reduceat((ids == _OUT).astype(np.int64), starts)
    grade = posterior(bits) @ np.arange(1, GRADES + 1)
    n = np.bincount(owner, count, len(texts)).astype(np.int64)
    some = n > 0
    mean = lambda who, value: np.bincount(who, value, len(texts))[some] / n[some]
    for k, value in enumerate((grade * count, bits.min(axis=1), count - unknown)):
        out[some, k] = mean(owner, value)
    word_owner = np.repeat(owner, count)
    for g in range(GRADES):
        out[some, 3 + g] = mean(word_owner, each[:, g])
        out[some, 3 + GRADES + g] = np.sqrt(np.maximum(mean(word_owner, each[:, g].astype(np.float64) ** 2) - out[some, 3 + g] ** 2, 0))
    at = 3 + 2 * GRADES
    best = each[np.arange(len(ids)), np.repeat(bits.argmin(axis=1), count)]
    for values in (best, each[:, 0] - each[:, -1]):
        out[some, at : at + len(QUANTILES)] = _quantiles(values, word_owner, n)[some]
        at += len(QUANTILES)
    # means count by how they differ between the models: their common level is a matter of vocabulary
    out[some, 3 : 3 + GRADES] -= out[some, 3 : 3 + GRADES].mean(axis=1, keepdims=True)
    return out


def moments(features: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Sums of 1, of the grades, of the distributions, of their products with the grades and with each other; those of parts add up."""
    x = np.delete(features, (1, 2), axis=1)
    return np.r_[len(x), grades.sum(), x.sum(axis=0), x.T @ grades, (x.T @ x).ravel()]


def fit_line(sums_of: np.ndarray) -> dict:
    """Ridge regression of the grades on the standardised distribution, from its moments; with few texts the expected grade alone."""
    width = 1 + 2 * GRADES + 2 * len(QUANTILES)
    n, total, x, xy, xx = np.split(sums_of, np.cumsum([1, 1, width, width]))
    n, middle, base = n[0], x / n[0], total[0] / n[0]
    xx = xx.reshape(width, width) / n - np.outer(middle, middle)
    spread = np.maximum(np.sqrt(np.maximum(np.diag(xx), 0)), 1e-6)
    weight = np.zeros(width)
    if n < 10 * width:
        weight[0] = spread[0]
        return {"middle": middle, "spread": spread, "weight": weight, "base": float(middle[0])}
    weight = np.linalg.solve(n * xx / np.outer(spread, spread) + RIDGE * np.eye(width), (xy - n * middle * base) / spread)
    return {"middle": middle, "spread": spread, "weight": weight, "base": float(base)}


def on_line(line: dict, features: np.ndarray) -> np.ndarray:
    return line["base"] + ((np.delete(features, (1, 2), axis=1) - line["middle"]) / line["spread"]) @ line["weight"]


def pool(blocks: list[list[float]], more) -> list[list[float]]:
    """Adds ``more`` blocks (value, weight, first x, last x), which follow in x, and pools what decreases."""
    for block in more:
        blocks.append(list(block))
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v, w, _, last = blocks.pop()
            u = blocks[-1]
            u[0], u[1], u[3] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, last
    return blocks


def knots_of(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([t for b in blocks for t in b[2:]]), np.array([b[0] for b in blocks for _ in (0, 1)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing least-squares fit (pool adjacent violators): knots for linear interpolation."""
    order = np.argsort(x, kind="stable")
    return knots_of(pool([], ((float(b), 1.0, float(a), float(a)) for a, b in zip(x[order], y[order]))))


def _files(folder: str) -> list:
    fs, path = pafs.FileSystem.from_uri(folder)
    return [(fs, f) for f in sorted(i.path for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.path.endswith(".parquet"))]


def _batches(files: list):
    for fs, path in files:
        with fs.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches()


_loaded: dict = {}


def _vocabulary(folder: str) -> tuple[Words, np.ndarray]:
    """Words with their numbers, in order, and which of them each model knows; once a worker."""
    if _loaded.get("folder") != folder:
        parts = list(_batches(_files(folder)))
        rows = pa.Table.from_batches(parts).sort_by("word") if parts else pa.table({"word": [], "known": []})
        known = np.array([list(map(bool, k)) for k in zip(*rows["known"].to_pylist())] or [[]] * 3, bool)
        _loaded.clear()
        _loaded.update(folder=folder, words=Words({w: k for k, w in enumerate(rows["word"].to_pylist(), 2)}), known=np.concatenate([np.ones((3, 2), bool), known], axis=1))
    return _loaded["words"], _loaded["known"]


def _model(words: str, counts: str, number: int) -> dict | None:
    """Model of the counted bigrams, mapped from a file without a name; once a worker. None where nothing was counted."""
    _, known = _vocabulary(words)
    if (counts, number) not in _loaded:
        for key in [k for k in _loaded if isinstance(k, tuple) and k[0] != counts]:
            del _loaded[key]
        files, n = _files(f"{counts}/m={number}"), 0
        for fs, path in files:
            with fs.open_input_file(path) as source:
                n += pq.ParquetFile(source).metadata.num_rows

        class Parts:
            def __iter__(self):
                return ((np.asarray(b["code"]), np.stack([np.asarray(b[f"w{g}"]) for g in range(GRADES)], axis=1) / STEP) for b in _batches(files))

        def space(kind, *more):
            return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n, *more))

        size = known.shape[1]
        _loaded[counts, number] = smoothed(Parts(), *sums(Parts(), size), size, int(known[number].sum()), space) | {"known": known[number]} if n else None
    return _loaded[counts, number]


def _slices(batches, rows: int = 500):
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def train_model(documents: DataFrame, graded: DataFrame) -> dict | None:
    """Model from all graded documents: folders of its words and bigrams, line, mapping and bounds; None if there are no graded texts. The mapping is fitted on texts the models have not seen (two halves)."""
    votes = graded.filter("doc_id IS NOT NULL AND grade BETWEEN 1 AND 5").groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter("trim(text) <> ''").join(votes, "doc_id")
    texts = materialize(texts.select("text", "grade", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")), "graded")
    sizes = {r.half: r["count"] for r in texts.groupBy("half").count().collect()}
    if not sizes:
        return None
    trained_on = [sizes.get(1, 0), sizes.get(0, 0), sum(sizes.values())]

    def words_of(batches):
        for part in _slices(batches):
            counts: dict[tuple, int] = {}
            for t, half in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                for w in _TOKEN.findall(t.lower()):
                    if w[0] not in ".!?\n" and not w[0].isdigit():
                        counts[w, half] = counts.get((w, half), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "half", "n"])

    each = [F.coalesce(F.sum(F.when(F.col("half") != m, F.col("n"))), F.lit(0)) >= (MIN_COUNT if trained_on[m] > 50 else 2) for m in range(3)]
    words = texts.mapInArrow(words_of, "word string, half int, n bigint").groupBy("word").agg(F.array(*each).alias("known"))
    words = materialize(words.filter("exists(known, k -> k)"), "words")._weft_path
    names = [f"w{g}" for g in range(GRADES)]

    def count(before: str | None):
        def run(batches):
            vocabulary, known = _vocabulary(words)
            size = known.shape[1]
            for part in _slices(batches, 2_000):
                grades, half = np.asarray(part.column(1), float), np.asarray(part.column(2))
                all_ids, sentence, owner = read(part.column(0).to_pylist(), vocabulary)
                near = np.exp(-np.abs(np.arange(1, GRADES + 1)[None, :] - grades[:, None]) * 2.0)
                prior = (near / near.sum(1, keepdims=True))[owner]
                for m in range(3):
                    mine = half[owner] != m
                    some = mine[sentence]
                    if not some.any():
                        continue
                    ids, at = np.where(known[m][all_ids[some]], all_ids[some], _OUT), np.unique(sentence[some], return_inverse=True)[1]
                    weight = prior[mine]
                    if before:
                        weight = posterior(sentence_bits(_model(words, before, m), ids, at)[0] - np.log2(weight))
                    seen, two = tally(ids, at, np.rint(weight * STEP), size)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), m, np.int32)), pa.array(seen), *(pa.array(two[:, g].astype(np.int64)) for g in range(GRADES))], ["m", "code", *names])

        rows = texts.mapInArrow(run, "m int, code bigint, " + ", ".join(f"{w} bigint" for w in names))
        rows = rows.groupBy("m", "code").agg(*(F.sum(w).alias(w) for w in names))
        return materialize(rows.repartitionByRange("m", "code").sortWithinPartitions("m", "code"), "bigrams", ["m"])

    counts = count(None)
    for _ in range(ROUNDS):
        before, counts = counts, count(counts._weft_path)
        discard(before)
    counts = counts._weft_path

    def held_out(batches):
        vocabulary, _ = _vocabulary(words)
        for part in _slices(batches):
            half = np.asarray(part.column(2))
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                if len(at):
                    f = text_features(_model(words, counts, h) or _model(words, counts, WHOLE), vocabulary, part.column(0).take(pa.array(at)).to_pylist())
                    ok = ~np.isnan(f[:, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(list(f[ok]), pa.list_(pa.float64())), part.column(1).take(pa.array(at[ok]))], ["f", "grade"])

    held = materialize(texts.mapInArrow(held_out, "f array<double>, grade double"), "held")
    matrix = lambda part: np.array(part.column(0).to_pylist(), float).reshape(part.num_rows, -1)

    def moments_of(batches):
        total = sum((moments(matrix(part), np.asarray(part.column(1))) for part in batches if part.num_rows), 0.0)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    found = held.mapInArrow(moments_of, "sums array<double>").collect()  # one row a task
    if not found:
        return None
    line = fit_line(np.sum([r.sums for r in found], axis=0))

    def levels(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array(on_line(line, matrix(part)) if part.num_rows else [], pa.float64()), part.column(1)], ["x", "y"])

    def blocks_of(batches):
        blocks: list[list[float]] = []
        for part in batches:
            pool(blocks, ((y, 1.0, x, x) for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array([b[k] for b in blocks], pa.float64()) for k in range(4)], ["value", "weight", "first", "last"])

    ordered = held.mapInArrow(levels, "x double, y double").repartitionByRange("x").sortWithinPartitions("x", "y")
    blocks = ordered.mapInArrow(blocks_of, "value double, weight double, first double, last double").collect()  # steps of a monotone curve
    # bounds need no more than four decimals, which bounds the values that are counted
    most, least = held.agg(F.expr("percentile(round(f[1], 4), 0.99)"), F.expr("percentile(round(f[2], 4), 0.01)")).first()
    discard(held)
    discard(texts)
    return {"words": words, "counts": counts, "line": line, "knots": knots_of(pool([], sorted(map(tuple, blocks), key=lambda b: b[2:]))), "most_bits": most + 1.5, "least_known": least - 0.1}


def reading_levels(documents: DataFrame, graded: DataFrame) -> DataFrame:
    """``(doc_id, level DOUBLE, grade INT, prose BOOLEAN)`` of every row.

    level is on the graders' 1 to 5 scale, null for null texts and texts without words; ``prose`` is whether the text reads like the English prose that was graded: enough known words and
    not too surprising to the best model. Grades null or outside 1 to 5 are not used; several grades of a document are averaged. Without
    usable grades every level is null. Columns other than doc_id and text are not read; repeated rows give repeated rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    state = train_model(documents, graded)
    schema = f"doc_id {kind}, level double, grade int, prose boolean"
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    if state is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("level"), F.lit(None).cast("int").alias("grade"), F.lit(False).alias("prose"))

    def run(batches):
        (words, _), model = _vocabulary(state["words"]), _model(state["words"], state["counts"], WHOLE)
        for part in _slices(batches):
            f = text_features(model, words, part.column(1).to_pylist())
            level = np.interp(on_line(state["line"], f), *state["knots"])
            prose = (f[:, 1] <= state["most_bits"]) & (f[:, 2] >= state["least_known"])
            none = np.isnan(f[:, 0])
            grade = np.where(none, 0, np.clip(np.rint(level), 1, GRADES)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(level, mask=none), pa.array(grade, mask=none), pa.array(prose & ~none)], ["doc_id", "level", "grade", "prose"])

    return rows.mapInArrow(run, schema)
