"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, runs of other characters than letters and digits one space. An
item of m characters that occurs in a text with at most e edits is cut into e+1 pieces; one of them occurs
unchanged. An automaton finds all pieces of all items in one pass over a text, and Myers' bit-parallel
distance verifies the item around every hit. Most chance hits never get that far: an edit spoils at most GRAM
of the item's character grams, so all others must occur in the text around the hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, sliced

OTHER = re.compile(r"[\W_]+")
GRAM = 4
#: Edits for each character of an item that still count as the item.
RATE = 0.08
#: Normalised characters of the shortest item that is searched for: shorter ones are ordinary words of clean texts.
LEAST = 20
#: Characters of item text that one automaton holds; more items are searched in further passes.
BLOCK = 4_000_000


def normalise(text: str | None) -> str:
    """' words ', or '' if there are none."""
    words = OTHER.sub(" ", text.lower()).strip() if text else ""
    return f" {words} " if words else ""


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of pattern in text, the leftmost end of them; None over most.

    Columns of the edit matrix are bit vectors as long as the pattern, with a free start in the text."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        if score < best[0]:
            best = (score, j + 1)
            if not score:
                break
    return best if best[0] <= most else None


class Matcher:
    """All items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        import ahocorasick

        self.items, at = [], {}
        for key, text in items:
            text = normalise(text)
            if len(text) - 2 < least:
                continue
            most = int(rate * (len(text) - 2))
            grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]
            self.items.append((key, text, most, grams, len(grams) - GRAM * most))
            cuts = [len(text) * i // (most + 1) for i in range(most + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at.setdefault(text[a:b], []).append((len(self.items) - 1, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, tuple(places))
        if at:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item that the text holds, end in the normalised text."""
        text = normalise(text)
        if not text or not len(self.automaton):
            return []
        starts: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for item, b in places:
                starts.setdefault(item, set()).add(end + 1 - b)
        out = []
        for item, found in starts.items():
            key, pattern, most, grams, needed = self.items[item]
            best, spans = None, []
            for s in sorted(found):
                if s >= 0 and text.startswith(pattern, s):
                    best = (0, s + len(pattern))
                    break
                a, b = max(0, s - most), s + len(pattern) + most
                if spans and a <= spans[-1][1] - len(pattern):
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            if best is None:
                for a, b in spans:
                    window = text[a:b]
                    near = {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}
                    if sum(g in near for g in grams) < needed:
                        continue
                    hit = myers(pattern, window, most if best is None else best[0] - 1)
                    if hit:
                        best = (hit[0], a + hit[1])
            if best:
                out.append((key, *best))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of bounded size: one block is all that the driver and a task hold."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK)
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield [tuple(r) for r in part.collect()]


def matchers(documents: DataFrame, benchmark: DataFrame, rate: float, least: int) -> Iterator:
    """For each block of items a function that gives its matcher. The items are broadcast (a block's size is
    bounded), and a worker builds their automaton once for all of its tasks."""
    for items in item_blocks(benchmark):
        held, key = documents.sparkSession.sparkContext.broadcast(items), ("matcher", uuid.uuid4().hex)
        yield lambda held=held, key=key: kept_by_worker(key, lambda: Matcher(held.value, rate, least))


def contamination(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, distance, end) of every document that holds a benchmark item with at most ``rate``
    edits a character; of several places the one of least distance, of equal ones the first.

    Null and wordless texts and items match nothing, and neither do items of fewer than ``least`` normalised
    characters; an item stands as often as its row does; repeated documents, and those without doc_id, match each.
    Texts of any length are searched whole, in one pass. Other columns are ignored, whatever their names. Empty
    tables give no rows."""
    out = None
    for matcher in matchers(documents, benchmark, rate, least):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            own = matcher()
            for batch in batches:
                rows = [(key, *m) for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in own.matches(text.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "end"])

        found = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, distance int, end long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("end")).where("false")
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The documents that hold no benchmark item, as ``contamination`` finds them, with all their columns, whatever
    their names.

    Null and wordless texts stay; repeated rows stay or go alike; empty tables give no rows or leave all."""
    for matcher in matchers(documents, benchmark, rate, least):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            own = matcher()
            for batch in sliced(batches):
                yield batch.filter(pa.array([not own.matches(text.as_py()) for text in batch.column("text")], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
