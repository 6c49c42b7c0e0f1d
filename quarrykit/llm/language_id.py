"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")
ORDERS, BUCKETS = 3, 1 << 15
#: The classifier is fitted on about so many labelled documents at most, chosen by a hash of doc_id.
MOST_LABELLED = 50_000
#: Code points that are worked on at once, about (fewer where there are very many languages), and rows whose texts
#: are in memory for it.
CHUNK, SLICE = 1 << 18, 256


def has_letter(text: str | None) -> bool:
    """Signs such as ² are words to a pattern but no letters."""
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def letters(text: str) -> np.ndarray:
    """The code points of the lower-cased letters, words apart by one space."""
    return np.frombuffer(OTHER.sub(" ", f" {text} ".lower()).encode("utf-32-le", "surrogatepass"), np.uint32)


#: In place of the grams that would run from one text into the next; its counts and weights are 0.
NONE = ORDERS * BUCKETS


def grams(points: np.ndarray, left: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the hashed gram that begins at each place, NONE where fewer points are ``left``."""
    for n in range(1, ORDERS + 1):
        size = len(points) - n + 1
        if size <= 0:
            continue
        h = points[:size] * np.uint32(0x9E3779B1)
        for i in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[i : i + size] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(16)
        yield np.where(left[:size] >= n, (h & np.uint32(BUCKETS - 1)).astype(np.intp) + (n - 1) * BUCKETS, NONE)


def batched(texts: Iterator[str | None], chunk: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, list[int]]]:
    """Texts with a letter, joined to arrays of about ``chunk`` code points: (their numbers, points, how many are left
    of the text from each on, where each text begins). A longer text comes in several parts, each with the points
    that its last grams reach into."""
    numbers, parts, tails, size = [], [], [], 0

    def out():
        points = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(len(points))
        for start, own, tail in zip(starts, sizes, tails, strict=True):
            if tail:  # what the next part begins with
                left[start + own - tail : start + own] = 0
        return list(numbers), points, left, starts

    for number, text in enumerate(texts):
        if not has_letter(text):
            continue
        points = letters(text)
        for at in range(0, len(points), chunk):
            part = points[at : at + chunk + ORDERS - 1]
            numbers.append(number)
            parts.append(part)
            tails.append(max(0, len(part) - chunk))
            size += len(part)
            if size >= chunk:
                yield out()
                numbers, parts, tails, size = [], [], [], 0
    if numbers:
        yield out()


class Model:
    """langs, and log-probabilities of each gram in each of them."""

    def __init__(self, langs: list[str], documents: np.ndarray, counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        self.prior = np.log(documents / documents.sum()) if len(langs) else documents
        table = counts.reshape(len(langs), ORDERS, BUCKETS) + smooth
        table = np.log(table / table.sum(axis=2, keepdims=True)).reshape(len(langs), ORDERS * BUCKETS)
        self.table = np.vstack([table.T.astype(np.float32), np.zeros((1, len(langs)), np.float32)])

    def parts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        return self.langs, self.prior, self.table


def predict(parts: tuple[list[str], np.ndarray, np.ndarray], texts: list[str | None]) -> tuple[list[str], list[float]]:
    """For each text the likeliest language and its posterior probability; ('und', 0) for null or without letters.
    Of languages equally likely the first by name.

    A batch of texts is one sparse matrix of gram counts, by rows: its product with the table of log-probabilities
    is a gather of the grams' rows and a sum over each text's."""
    langs, prior, table = parts
    out, sure = ["und"] * len(texts), [0.0] * len(texts)
    if not langs:
        return out, sure
    scores: dict[int, np.ndarray] = {}
    for numbers, points, left, starts in batched(texts, max(1, min(CHUNK, 16 * CHUNK // len(langs)))):
        total = np.zeros((len(numbers), len(langs)))
        for h in grams(points, left):
            weights = table[h]
            # a text is longer than any gram, but the last one may begin no gram of this order
            total[starts < len(h)] += np.add.reduceat(weights, starts[starts < len(h)], axis=0, dtype=np.float64)
        for number, row in zip(numbers, total, strict=True):
            scores[number] = scores.get(number, prior) + row
    for number, score in scores.items():
        best = int(score.argmax())
        out[number], sure[number] = langs[best], float(1 / np.exp(score - score[best]).sum())
    return out, sure


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits on labelled documents outside the held-out quarter: on all, or on about ``most`` of them, chosen by a hash
    of the doc_id, if there are more; never on none where any has a letter. Counts are summed on the executors; the
    driver gets one number for each language and bucket. Rows without doc_id, lang or text teach nothing; repeated
    rows count as often as they stand; texts of any length count whole."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).select("doc_id", "lang", "text")
    n = known.count()
    whole = 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, counted = batch.column("lang").to_pylist(), set()
            for numbers, points, left, starts in batched((t.as_py() for t in batch.column("text")), CHUNK):
                names = sorted({langs[i] for i in numbers})
                place = {x: i for i, x in enumerate(names)}
                sums = np.zeros((len(names), NONE + 1), np.int64)
                owner = np.repeat([place[langs[i]] for i in numbers], np.diff(np.r_[starts, len(points)]))
                for h in grams(points, left):
                    sums += np.bincount(owner[: len(h)] * (NONE + 1) + h, minlength=sums.size).reshape(sums.shape)
                for x, own in zip(names, sums, strict=True):
                    own[NONE] = 0
                    total[x] = total.get(x, 0) + own
                for i in set(numbers) - counted:
                    total[langs[i]][NONE] += 1  # documents
                counted.update(numbers)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])

    def summed(rows: DataFrame) -> pa.Table:
        return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()

    chosen = known.where(F.xxhash64("doc_id").bitwiseAND(F.lit(whole - 1)) < max(1, most * whole // n)) if n > most else known
    found = summed(chosen)
    if n > most and not found.num_rows:  # rows of one doc_id, or nearly, that the hash leaves out
        found = summed(known.limit(most))
    langs = sorted(set(found["lang"].to_pylist()))
    row = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), NONE + 1))
    if langs:
        counts[[row[x] for x in found["lang"].to_pylist()], np.asarray(found["bucket"])] = np.asarray(found["n"])
    return Model(langs, counts[:, -1], counts[:, :-1])


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document. Null texts and texts without a letter are 'und'
    with score 0, as are all if nothing was learned; ties go to the first language by name. Texts of any length are
    scored whole. A row without doc_id is not held out and teaches nothing. Repeated rows get a row each; other columns
    are ignored, whatever their names; an empty table gives no rows."""
    held = documents.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            lang, score = predict(held.value, [t.as_py() for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a language of at least that score, with all their columns, whatever their names. Null texts
    and texts without a letter go; repeated rows stay or go alike; if nothing was learned, none stays; an empty table
    gives no rows."""
    held = documents.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SLICE):
            judged = zip(*predict(held.value, [t.as_py() for t in batch.column("text")]), strict=True)
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in judged], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
