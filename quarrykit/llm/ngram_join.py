"""N-gram Jaccard join by PartEnum signatures.

A text's set holds the hashes of its distinct word shingles. Two sets r, s with Jaccard at least J differ
in at most (1-J)/(1+J) * (|r|+|s|) elements, so, when the domain of hashes is cut into n partitions, they
agree in all but that many partitions. Each size band has its own n:

* small bands enumerate every subset of n-k partitions (k: the most elements that may differ), and one
  subset agrees in full;
* larger bands have more than k+1 partitions, the signatures are the single partitions, and a set must
  share at least ``need`` of them with others, or it has no partner (so passages that many texts share
  don't make candidates).

Bands hold sizes of a ratio of 1.5; a set also signs for the band of size/J, so each pair that can be
similar meets in a band. Empty partitions don't sign, and ``need`` counts them out; the few sets for which
that leaves nothing sign their empty partitions too.

Pairs of sets that share enough signatures form candidate clusters. A signature that many sets share links
them as a star, so no more links than members are made of it. Each cluster is verified exactly against all its
members with an inverted index in memory, in blocks of bounded size; a large cluster becomes pairs of
blocks. Only links that the exact test confirms are kept, as stars.
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean, connected_components, filesystem, fresh_path, id_filter, mark, materialize, maybe_in, partitions, release, sliced, with_hashes

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], U)
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


#: What is left of eight bytes when a word ends after so many of them.
KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _segment_words(data: np.ndarray) -> np.ndarray:
    """Every eight bytes of a word are mixed with their place in it, and the word's hash is mixed from their sum:
    no polynomial in the bytes, which words of much repetition could make collide."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    if not len(start):
        return np.zeros(0, U)
    eights = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    size = end - start
    chunks = (size + 7) >> 3
    first = np.cumsum(chunks) - chunks
    owner = np.repeat(np.arange(len(start)), chunks)
    nth = np.arange(len(owner)) - first[owner]
    value = eights[start[owner] + 8 * nth] & KEPT[np.minimum(size[owner] - 8 * nth, 8)]
    parts = mix(mix(value) + (nth + 1).astype(U) * U(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(parts, first) + size.astype(U) * U(0xA0761D6478BD642F))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of an A-Z lower-cased text: what stands between the bytes 9-13 and 32."""
    text = text.lower()
    if len(text) <= SEGMENT:
        return _segment_words(np.frombuffer(text, np.uint8))
    parts, at = [], 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        to = at + SEGMENT
        while to < len(data) and not SPACE[data[to]]:
            to += 1
        parts.append(_segment_words(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of fewer words, the whole sequence as one; else empty."""
    words = word_hashes(text) if text else np.zeros(0, U)
    if not len(words):
        return words
    n = min(k, len(words))
    total = np.full(len(words) - n + 1, U(n))
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * STEP[i]
    return np.unique(mix(total))


class PartEnum:
    """Signatures for Jaccard similarity of at least num/den. Needs num/den > 1/2."""

    RATIO, SLACK, CLASSIC = 1.5, 1.2, 25

    def __init__(self, num: int = 80, den: int = 100):
        self.num, self.den = num, den
        self.plans: dict[int, list[tuple]] = {}
        self.bands = []
        low = 1
        while low < 1 << 40:
            high = max(low, int(low * self.RATIO))
            self.bands.append((low, high))
            low = high + 1
        self.lows = np.array([b[0] for b in self.bands])

    def differ(self, a: int, b: int) -> int:
        """The most elements in which similar sets of these sizes differ."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def plan(self, n: int) -> list[tuple]:
        """For a set of n elements, for each of its bands: (band, partitions, whether subsets sign, the
        subsets or how many partitions sign, how many signatures a partner shares at least)."""
        if n in self.plans:
            return self.plans[n]
        out = self.plans[n] = []
        largest = n * self.den // self.num
        for b in sorted({self.band(n), self.band(largest)}):
            low, high = self.bands[b]
            k = self.differ(high, high)
            if k == 0:
                continue  # only equal sets: the digest finds them
            if high <= self.CLASSIC:
                parts = k + 3
                out.append((b, parts, True, list(itertools.combinations(range(parts), 3)), 1))
                continue
            parts = self.signing(high, high)
            mine = self.signing(n, high)
            sizes = np.arange(max(low, -(-n * self.num // self.den)), min(high, largest) + 1)
            if not len(sizes):
                continue
            theirs = self.signing(sizes, high)
            need = int((np.minimum(mine, theirs) - (self.den - self.num) * (sizes + n) // (self.den + self.num)).min())
            out.append((b, parts, False, min(mine, parts), need))
        return out

    def signing(self, n, high: int):
        most = (self.den - self.num) * (n + np.minimum(high, n * self.den // self.num)) // (self.den + self.num)
        made = np.ceil(self.SLACK * (most + 1)).astype(np.int64) + 1
        return made if np.ndim(made) else int(made)

    def signatures(self, elements: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Signatures, whose lowest bit is the band's parity; how many must be shared, by parity."""
        out, needs = [], {}
        if not len(elements):
            return np.zeros(0, U), needs
        place, value = mix(elements ^ U(0x5851F42D4C957F2D)) >> U(32), mix(elements + U(0x14057B7EF767814F))
        for b, parts, classic, how, need in self.plan(len(elements)):
            at = ((place * U(parts)) >> U(32)).astype(np.int64)
            total = np.zeros(parts, U)
            np.add.at(total, at, value)
            seed = U((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            own = mix(total + np.arange(1, parts + 1).astype(U) * U(0xD1342543DE82EF95) + seed)
            if classic:
                index = np.array(how)
                sig = mix(own[index[:, 0]] * STEP[0] + own[index[:, 1]] * STEP[1] + own[index[:, 2]] * STEP[2])
                needs[b & 1] = 1
            else:
                full = np.bincount(at, minlength=parts)[:how] > 0
                left = need - int((~full).sum())
                sig = own[:how] if left < 1 else own[:how][full]
                needs[b & 1] = max(1, left)
            out.append((sig & ~U(1)) | U(b & 1))
        return np.concatenate(out) if out else np.zeros(0, U), needs


def digest(elements: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers."""
    if not len(elements):
        return 0
    both = np.array([elements.sum(dtype=U), np.bitwise_xor.reduce(mix(elements))], U) * STEP[:2] + U(len(elements))
    return int(mix(both).sum(dtype=U).view(np.int64))


def _texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts' bytes; each is copied only when it is asked for."""
    return batch.column("text").cast(pa.binary())


#: About so many bytes of text are worked on between two results.
FLUSH = 8 << 20


#: Of a signature that more sets of one batch of texts share, one set goes to meet those of other batches.
LOCAL = 32


def _combined(keys: list[int], sigs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each set, the signatures that go to meet others, and those that are known to be shared. A signature of
    more than LOCAL sets here is known for all of them; only the one of smallest key goes on, so a signature that
    very many sets share makes no large group anywhere."""
    size = np.array([len(x) for x in sigs])
    if not size.sum():
        return sigs, [x[:0] for x in sigs]
    every, owner = np.concatenate(sigs), np.repeat(np.arange(len(sigs)), size)
    order = np.lexsort((np.array(keys)[owner], every))
    first = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
    count = np.diff(np.r_[first, len(order)])
    known, goes = np.zeros(len(every), bool), np.ones(len(every), bool)
    large = np.repeat(count > LOCAL, count)
    known[order[large]] = True
    goes[order[large]] = False
    goes[order[first[count > LOCAL]]] = True
    cut = np.cumsum(size)[:-1]
    return [x[m] for x, m in zip(sigs, np.split(goes, cut), strict=True)], [x[m] for x, m in zip(sigs, np.split(known, cut), strict=True)]


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    offsets = np.cumsum([0, *(0 if x is None else len(x) for x in arrays)]).astype(np.int32)
    some = [x for x in arrays if x is not None and len(x)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some).view(np.int64) if some else np.zeros(0, np.int64), pa.int64()))


SKETCH = "doc_id long, n_shingles long, digest long, need0 int, need1 int, sigs array<long>, known array<long>"


def _sketches(k: int, scheme: PartEnum):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, dict[int, int]] = {}
        for batch in batches:
            ids, texts = batch.column("doc_id"), _texts(batch)
            at = 0
            while at < len(texts):
                begin, size, rows, sigs = at, 0, [], []
                while at < len(texts) and size < FLUSH:
                    text = texts[at].as_py()
                    size += len(text or b"")
                    elements = shingle_set(text, k)
                    key = digest(elements)
                    at += 1
                    if not len(elements):
                        sig, needs = np.zeros(0, U), {}
                    elif key in seen:  # copies sign once
                        sig, needs = np.zeros(0, U), seen[key]
                    else:
                        sig, needs = scheme.signatures(elements)
                        if len(seen) < 200_000:
                            seen[key] = needs
                    rows.append((len(elements), key, needs.get(0), needs.get(1)))
                    sigs.append(sig)
                n, key, even, odd = zip(*rows, strict=True)
                goes, known = _combined(list(key), sigs)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, at - begin), pa.array(n, pa.int64()), pa.array(key, pa.int64()), pa.array(even, pa.int32()), pa.array(odd, pa.int32()), _lists(goes), _lists(known)],
                    ["doc_id", "n_shingles", "digest", "need0", "need1", "sigs", "known"],
                )

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, digest) that are sorted by sig, those whose sig different digests have. Only one row of a
    group is held from batch to batch, however large the group."""
    held = None  # sig, digest, whether the group is known to be shared and the row is out
    for batch in batches:
        sig, own = (np.asarray(batch.column(c)) for c in ("sig", "digest"))
        if not len(sig):
            continue
        out = held is not None and held[2]
        if held is not None:
            sig, own = np.r_[np.int64(held[0]), sig], np.r_[np.int64(held[1]), own]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        shared = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        shared[0] |= out
        keep = np.repeat(shared, np.diff(np.r_[first, len(sig)]))
        if out:
            keep[0] = False
        held = (sig[-1], own[-1], bool(shared[-1]))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(own[keep])], ["sig", "digest"])


def _elements(k: int, held):
    """(doc_id, digest, elements) of the rows that may be wanted: those whose id passes the filter, and those
    without id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            wanted = maybe_in(batch, held.value) | np.asarray(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            rows = batch.filter(pa.array(wanted))
            ids, texts, at = rows.column("doc_id"), _texts(rows), 0
            while at < len(texts):
                begin, size, out = at, 0, []
                while at < len(texts) and size < FLUSH:
                    text = texts[at].as_py()
                    size += len(text or b"")
                    elements = shingle_set(text, k)
                    out.append((digest(elements), elements.tobytes()))
                    at += 1
                key, data = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(begin, at - begin), pa.array(key, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "digest", "elements"])

    return run


def links_of(sets: list[np.ndarray], weights: list[int], sides: list[int], across: bool, num: int, den: int) -> tuple[list[int], list[int]]:
    """For each set a root (an index) and the weight of all sets it is linked with. across: only pairs of
    different sides are compared (the other pairs belong to other units)."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    last = np.r_[first[1:], len(values)]
    shared = last - first > 1
    group = np.repeat(np.arange(len(first)), last - first)
    keep = shared[group]
    back = np.argsort(owner[keep], kind="stable")
    groups = group[keep][back]
    cut = np.searchsorted(owner[keep][back], np.arange(n + 1))
    root, total = list(range(n)), [0] * n
    weight, side = np.array(weights), np.array(sides)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        mine = groups[cut[i] : cut[i + 1]]
        if not len(mine):
            continue
        common = np.bincount(np.concatenate([owner[first[g] : last[g]] for g in mine]), minlength=n)
        linked = den * common >= num * (size[i] + size - common)
        linked[i] = False
        if across:
            linked &= side != side[i]
        for j in np.flatnonzero(linked):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
        total[i] = int(weight[linked].sum())
    return [find(i) for i in range(n)], total


def _judged(rows: dict[int, tuple], across: bool, num: int, den: int) -> tuple[list, list, list]:
    """digest, root and links of those sets that have links. rows: (elements, copies, side) by digest."""
    keys = list(rows)
    roots, totals = links_of(*([r[i] for r in rows.values()] for i in range(3)), across, num, den)
    some = [i for i, total in enumerate(totals) if total]
    return [keys[i] for i in some], [keys[roots[i]] for i in some], [totals[i] for i in some]


def _packed(rows: dict[int, tuple]) -> bytes:
    sizes = [len(r[0]) for r in rows.values()]
    head = np.array([len(rows), *rows, *(r[1] for r in rows.values()), *sizes], np.int64)
    return b"".join([head.tobytes(), *(r[0].tobytes() for r in rows.values())])


def _unpacked(data: bytes, side: int) -> dict[int, tuple]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    keys, copies, sizes = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
    sets = np.split(np.frombuffer(data, U, -1, 8 + 24 * n), np.cumsum(sizes)[:-1])
    return {int(key): (own, int(c), side) for key, own, c in zip(keys, sets, copies, strict=True)}


WITHIN = "digest long, root long, links long, cluster long, block int, file string, start long, size long"


def _within(num: int, den: int, folder: str):
    """Of rows sorted by cluster and block: the links inside each block, and where the blocks lie that are to be compared
    with others. Those are written, all of a task to one file, so that each set is sent and kept once, however many blocks
    its cluster has."""
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (x.split() for x in WITHIN.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, at = f"{folder}/{uuid.uuid4().hex}", None, 0
        unit, rows = None, {}

        def judged() -> pa.RecordBatch:
            nonlocal file, at
            cluster, block, blocks = unit
            out = [[*x, None] for x in _judged(rows, False, num, den)]
            n = len(out[0])
            place = [None] * 5
            if blocks > 1:
                if file is None:
                    fs, path = filesystem(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    file = fs.open_output_stream(path)
                data = _packed(rows)
                file.write(data)
                place = [cluster, block, name, at, len(data)]
                at += len(data)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out + [[None] * (n - 1) + [x] for x in place], schema, strict=True)], schema=schema)

        try:
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("cluster", "block", "blocks", "digest", "copies")]
                for data, cluster, block, blocks, key, copies in zip(batch.column("elements"), *cols, strict=True):
                    if (cluster, block, blocks) != unit:
                        if rows:
                            yield judged()
                        unit, rows = (cluster, block, blocks), {}
                    rows[key] = (np.frombuffer(data.as_py(), U), copies, 0)
            if rows:
                yield judged()
        finally:
            if file is not None:
                file.close()

    return run


def _across(num: int, den: int):
    """The links between the sets of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                rows = {}
                for side in (0, 1):
                    fs, path = filesystem(unit[f"file{side}"])
                    with fs.open_input_file(path) as f:
                        rows |= _unpacked(f.read_at(unit[f"size{side}"], unit[f"start{side}"]), side)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _judged(rows, True, num, den)], ["digest", "root", "links"])

    return run


#: Of signatures that at most so many sets share, the pairs of sets are counted; larger groups are linked as stars.
SMALL_GROUP = 32
#: A cluster is cut into blocks of FINE elements as long as that makes at most MANY of them, so that tasks
#: share its work; larger clusters have larger blocks, of BLOCK elements at most: two fit in memory.
FINE, MANY, BLOCK = 50_000, 8, 1_000_000
#: Signatures meet in so many turns, each of its share of them: only that share is shuffled at once.
TURNS = 2


def grouped(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """ngram_jaccard_join with the set's digest and the group's (root) besides: groups of which no document has a
    doc_id are told apart by it."""
    spark = documents.sparkSession
    docs, scheme = documents.select("doc_id", "text"), PartEnum(num, den)
    width = partitions(spark)
    sketches = materialize(docs.mapInArrow(_sketches(k, scheme), SKETCH), "sketches")
    each = materialize(sketches.select("doc_id", "n_shingles", "digest", "need0", "need1"), "sets")
    turns = []
    for turn in range(TURNS):
        signed, known = (sketches.select("digest", F.explode(c).alias("sig")).where(f"pmod(shiftright(sig, 1), {TURNS}) = {turn}") for c in ("sigs", "known"))
        met = signed.repartition(width, "sig").sortWithinPartitions("sig").mapInArrow(_met, "sig long, digest long")
        turns.append(materialize(met.unionByName(known).distinct(), "signatures"))
        release(spark)
    release(spark, sketches)
    shared = functools.reduce(DataFrame.unionByName, turns)
    classes = materialize(
        each.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.max("need0").alias("need0"), F.max("need1").alias("need1")),
        "classes",
    )
    counted = shared.groupBy("digest", F.expr("sig & 1").alias("odd")).agg(F.count("*").alias("shared"))
    enough = counted.join(classes, "digest").withColumn("need", F.when(F.col("odd") == 1, F.col("need1")).otherwise(F.col("need0"))).where("shared >= need").select("digest", "odd", "need")
    sharing = materialize(shared.withColumn("odd", F.expr("sig & 1")).join(enough, ["digest", "odd"]), "sharing")
    # sums by signature, and a join that Spark may split where very many sets share one
    groups = sharing.groupBy("sig").agg(F.min("digest").alias("low"), F.count("*").alias("size")).where("size > 1")
    kept = materialize(sharing.join(groups, "sig").select("sig", "odd", "digest", "need", "low", "size"), "candidates")
    release(spark, sharing, *turns)
    # a similar pair shares need signatures: all in small groups, whose pairs are counted, or one in a large group
    few = kept.where(f"size <= {SMALL_GROUP}").groupBy("sig", "odd").agg(F.sort_array(F.collect_list(F.struct("digest", "need"))).alias("own"))
    pairs = few.select("odd", F.explode(F.expr("flatten(transform(own, (x, i) -> transform(slice(own, i + 2, size(own)), y -> struct(x.digest AS a, y.digest AS b, greatest(x.need, y.need) AS need))))")).alias("p"))
    pairs = pairs.groupBy("odd", "p.a", "p.b").agg(F.count("*").alias("shared"), F.max("p.need").alias("need")).where("shared >= need").select("a", "b")
    stars = kept.where(f"size > {SMALL_GROUP} and digest <> low").select(F.col("digest").alias("a"), F.col("low").alias("b"))
    clusters = connected_components(pairs.unionByName(stars))
    inside = clusters.withColumnsRenamed({"id": "digest", "root": "cluster"}).join(classes, "digest")
    blocks = inside.groupBy("cluster").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.least(F.ceil(F.sum("n") / FINE), F.lit(MANY))).cast("int").alias("blocks"))
    inside = materialize(inside.join(blocks, "cluster").select("digest", "cluster", "rep", "copies", "blocks", F.expr("cast(pmod(xxhash64(digest), blocks) as int)").alias("block")), "clusters")
    release(spark, kept)

    # texts outside all clusters are left out before they are hashed a second time; each set is made once, sent to its
    # block once, and read from the block's file by the units that compare two blocks
    held = spark.sparkContext.broadcast(id_filter(inside.select("rep").where("rep is not null")))
    made = with_hashes(docs, "doc_id").mapInArrow(_elements(k, held), "doc_id long, digest long, elements binary").withColumnsRenamed({"digest": "own"})
    named = made.where("doc_id is not null").join(inside.where("rep is not null").hint("merge"), F.expr("doc_id = rep and own = digest")).drop("own", "doc_id")
    nameless = made.where("doc_id is null").drop("doc_id").join(inside.where("rep is null"), F.expr("own = digest")).drop("own").dropDuplicates(["digest"])
    folder = fresh_path(spark, "blocks")
    sets = named.unionByName(nameless).select("cluster", "block", "blocks", "digest", "copies", "elements")
    within = materialize(sets.repartition(width, "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(_within(num, den, folder), WITHIN), "within")
    release(spark)
    placed = within.where("file is not null").select("cluster", "block", "file", "start", "size")
    one, two = (placed.withColumnsRenamed({c: f"{c}{side}" for c in ("block", "file", "start", "size")}) for side in (0, 1))
    units = one.join(two, "cluster").where("block0 < block1")
    across = materialize(units.repartition(width, "cluster", "block0", "block1").mapInArrow(_across(num, den), "digest long, root long, links long"), "across")
    release(spark, folder)
    judged = within.where("digest is not null").select("digest", "root", "links").unionByName(across)
    roots = connected_components(judged.select(F.col("digest").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"id": "digest"})
    linked = judged.groupBy("digest").agg(F.sum("links").alias("links"))
    named = classes.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    final = named.join(least, "root").join(linked, "digest", "left").where("not (component <=> rep) or root <> digest or copies > 1 or links > 0")
    final = final.select("digest", "root", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    full = each.join(final, "digest", "left")
    return full.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        "digest",
        F.coalesce("root", "digest").alias("root"),
    )


def ngram_jaccard_join(documents: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that the document reaches by links), n_links.

    documents: doc_id, text; other columns are ignored, whatever their names. Null and blank texts have an empty
    set and no link. Equal texts, repeated rows and texts with equal sets are linked. A row without doc_id keeps
    its row and links like any other; its component is null if no document that it reaches has a doc_id. Texts
    are hashed in segments, so very long ones need memory for their set of shingles alone. An empty table gives
    no rows."""
    return grouped(documents, **how).drop("digest", "root")


def keep_one(documents: DataFrame, k: int = 5, **how) -> DataFrame:
    """The documents with all their columns; of each group of near-duplicates one row: that with the smallest
    doc_id (rows without one come last), of rows with equal doc_ids that with the smallest digest of its set, of
    equal ones that with the smallest text. So repeated rows and copies without doc_id go too, and of two rows with
    one doc_id and different texts each is judged by its own text. Null and blank texts have no copies: all stay.
    Columns may have any names; an empty table gives no rows.

    Two Bloom filters spare most rows a shuffle: one of the doc_ids of rows that go or repeat, and one of those that pass
    the first though a row of theirs stays. Rows that the first doesn't pass stay where they are, rows that only the
    first passes go, and the few that both pass, and those without doc_id, are hashed again and judged exactly."""
    began = mark()
    rows = materialize(grouped(documents, k=k, **how).select("doc_id", "digest", "root", "n_shingles"), "rows")
    clean(documents.sparkSession, began, keep_last=True)
    classes = materialize(rows.where("n_shingles > 0").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("copies")), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")).alias("best")
    judged = classes.join(classes.groupBy("root").agg(best, F.count("*").alias("members")), "root").where("members > 1 or copies > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    judged = materialize(judged.where(~stays | (F.col("copies") > 1)).select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__of"), stays.alias("__stays")), "copies")
    columns, spark = documents.columns, documents.sparkSession
    concerned = spark.sparkContext.broadcast(id_filter(judged.select("__doc_id").where("__doc_id is not null")))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(batch, concerned.value))).select(["doc_id"])

    going = judged.where("not __stays").select(F.col("__doc_id").alias("doc_id"), F.col("__of").alias("digest"))
    left = rows.where("doc_id is not null").select("doc_id", "digest").join(going, ["doc_id", "digest"], "left_anti").select("doc_id")
    unsure = materialize(with_hashes(left, "doc_id").mapInArrow(passing, "doc_id long").distinct(), "unsure")
    doubtful = spark.sparkContext.broadcast(id_filter(unsure))
    digested = T.StructType([*documents.schema, T.StructField("__digest", T.LongType())])

    def run(asked: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 64):
                hit = maybe_in(batch, concerned.value)
                nameless = np.asarray(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                wanted = nameless | (hit & maybe_in(batch, doubtful.value)) if asked else ~(nameless | hit)
                rows = batch.filter(pa.array(wanted)).select(columns)
                if rows.num_rows and asked:
                    own = pa.array([digest(shingle_set(text.as_py(), k)) for text in _texts(rows)], pa.int64())
                    rows = pa.RecordBatch.from_arrays([*rows.columns, own], [*columns, "__digest"])
                if rows.num_rows:
                    yield rows

        return each

    hashed = with_hashes(documents, "doc_id")
    asked = hashed.mapInArrow(run(True), digested).join(judged, F.expr("doc_id <=> __doc_id and __digest = __of"), "left").where("__stays is null or __stays")
    whole = F.struct(*columns)
    one = asked.where("__stays").groupBy("doc_id", "__digest").agg(F.min_by(whole, F.struct("text")).alias("__row")).select("__row.*")
    return hashed.mapInArrow(run(False), documents.schema).unionByName(asked.where("__stays is null").select(*columns)).unionByName(one.select(*columns))
