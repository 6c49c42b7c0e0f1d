"""Operators over documents against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrykit.llm import common, decontamination, fingerprints, language_id, ngram_join, packing, tokens
from quarrykit.llm.common import connected_components, without
from quarrykit.llm.queries import END_OF_TEXT, vocabulary

DOCS = "doc_id long, text string"


def table(df):
    return [r.asDict() for r in df.collect()]


# -- n-gram Jaccard join


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for a, (i, s) in enumerate(sets):
        known = [sets[b][0] for b in range(len(sets)) if s and find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), min(known) if known else i, links[a]))
    return sorted(out, key=str)


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in table(df)), key=str)


def test_join_finds_every_link(frame, odd_documents):
    assert joined(ngram_join.ngram_jaccard_join(frame(DOCS, odd_documents))) == brute_components(odd_documents)


def test_join_in_blocks(frame, odd_documents, monkeypatch):
    """Clusters that are cut into many blocks, and signature groups that are all linked as stars."""
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    monkeypatch.setattr(ngram_join, "FINE", 60)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 1)
    assert joined(ngram_join.ngram_jaccard_join(frame(DOCS, odd_documents))) == brute_components(odd_documents)


def shuffled(spark):
    """Bytes that this application has written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))


def test_sets_are_sent_once_however_many_blocks(spark, frame, monkeypatch):
    """What is shuffled doesn't grow with the number of blocks that a large cluster has."""
    rng = random.Random(21)
    text = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    rows = [(i, " ".join(w if rng.random() > 0.001 else f"n{rng.random()}" for w in text)) for i in range(48)]
    took = []
    for most in (1, 16):
        monkeypatch.setattr(ngram_join, "FINE", 4_000)
        monkeypatch.setattr(ngram_join, "MANY", most)
        began = shuffled(spark)
        assert joined(ngram_join.ngram_jaccard_join(frame(DOCS, rows))) == brute_components(rows)
        took.append(shuffled(spark) - began)
    assert took[1] < took[0] + 48 * 1500 * 8


def test_join_leaves_little_behind(spark, frame, odd_documents):
    """Signatures, sets and blocks, which are as large as the texts, are gone before the result is read."""
    for operator in (ngram_join.ngram_jaccard_join, ngram_join.keep_one):
        since = common.mark()
        operator(frame(DOCS, odd_documents)).collect()
        left = {at.rpartition("/")[2].partition("-")[0] for at in common._written[since:]}
        there = {x.partition("-")[0] for x in os.listdir(common.shared_dir(spark).removeprefix("file:")) if any(x in at for at in common._written[since:])}
        assert there == left and not left & {"sketches", "signatures", "sharing", "candidates", "blocks"}


def test_join_of_nothing(frame):
    assert table(ngram_join.ngram_jaccard_join(frame(DOCS, []))) == []
    assert joined(ngram_join.ngram_jaccard_join(frame(DOCS, [(7, None)]))) == [(7, 0, 7, 0)]


def test_keep_one(frame, odd_documents):
    """One row of each group, by brute force; repeated rows and copies without doc_id go too."""
    rows = [*odd_documents, (None, "a b c d e"), (None, "no one has this"), (None, "no one has this"), (600, odd_documents[16][1]), (600, "another text with the same doc_id")]
    kept = ngram_join.keep_one(frame(DOCS, rows))
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    groups = {}
    for a, (i, own) in enumerate(sets):
        groups.setdefault(find(a) if own else ("blank", a), []).append(i)
    want = Counter(min((i is None, i or 0) for i in g) for g in groups.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    assert "component_id" in kept.columns and ngram_join.keep_one(frame(DOCS, [])).collect() == []


def thue_morse(n, swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_words_of_much_repetition_differ(frame):
    """A polynomial modulo 2^64 takes a Thue-Morse word for its complement, whatever its base."""
    rows = [(i, thue_morse(2048, i % 2) + "x" * (i // 2)) for i in range(8)]
    assert joined(ngram_join.ngram_jaccard_join(frame(DOCS, rows))) == [(i, 1, i, 0) for i in range(8)]


def test_signatures_that_many_share_meet_by_one(monkeypatch, frame):
    """A family of near copies in every batch: only one of each batch goes on, and no link is lost."""
    monkeypatch.setattr(ngram_join, "LOCAL", 3)
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 4)
    rng = random.Random(12)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"n{rng.random()}" for w in text)) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(20)]
    rows += [(None, rows[0][1] + " more"), (None, rows[70][1])]
    assert joined(ngram_join.ngram_jaccard_join(frame(DOCS, rows))) == brute_components(rows)


def test_links_through_rows_without_doc_id(frame):
    """Two documents that only a nameless one links."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w[:180])), (None, " ".join(w[10:195])), (2, " ".join(w[30:200] + ["x"] * 3))]
    assert joined(ngram_join.ngram_jaccard_join(frame(DOCS, rows))) == brute_components(rows)
    assert {r[2] for r in brute_components(rows)} == {1}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.data())
def test_similar_sets_share_enough_signatures(n, data):
    """The guarantee that the join rests on, for pairs at the threshold."""
    rng = random.Random(data.draw(st.integers(0, 10**9)))
    pool = [np.uint64(rng.getrandbits(64)) for _ in range(n + 200)]
    size = data.draw(st.integers(max(1, -(-n * 80 // 100)), n * 100 // 80))
    common = -(-80 * (n + size) // 180)
    if common > min(n, size):
        return
    a = np.unique(np.array(pool[:n], np.uint64))
    b = np.unique(np.array(pool[:common] + pool[n : n + size - common], np.uint64))
    if len(a) != n or len(b) != size or set(a) == set(b):
        return
    scheme = ngram_join.PartEnum()
    (x, needs_x), (y, needs_y) = scheme.signatures(a), scheme.signatures(b)
    shared = set(x) & set(y)
    assert any(
        len([s for s in shared if int(s) & 1 == odd]) >= max(needs_x[odd], needs_y[odd]) for odd in (0, 1) if odd in needs_x and odd in needs_y
    )


@given(st.binary(max_size=300))
def test_words_are_hashed_alone(data):
    assert len(ngram_join.word_hashes(data)) == len(data.split())
    assert [int(x) for x in ngram_join.word_hashes(data)] == [int(ngram_join.word_hashes(w)[0]) for w in data.split()]


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 100])
def test_met(batch):
    import pyarrow as pa

    rng = random.Random(batch)
    rows = sorted((rng.randrange(12), rng.randrange(3)) for _ in range(60)) + [(50, 1)] * 5 + [(60, k % 2) for k in range(9)]
    batches = [pa.RecordBatch.from_pydict({"sig": pa.array([r[0] for r in rows[i : i + batch]], pa.int64()), "digest": pa.array([r[1] for r in rows[i : i + batch]], pa.int64())}) for i in range(0, len(rows), batch)]
    got = {(s, d) for b in ngram_join._met(iter(batches)) for s, d in zip(b["sig"].to_pylist(), b["digest"].to_pylist(), strict=True)}
    assert got == {(s, d) for s, d in rows if len({e for t, e in rows if t == s}) > 1}


def test_words_across_segments(monkeypatch):
    text = b" ".join(b"w%d" % i for i in range(2000)) + b" " + b"z" * 500
    whole = ngram_join.word_hashes(text)
    monkeypatch.setattr(ngram_join, "SEGMENT", 64)
    assert (ngram_join.word_hashes(text) == whole).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_without(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("other", df_lit())
    gone = spark.range(0, 1000, 3).withColumnRenamed("id", "x")
    assert sorted(r.k for r in without(df, "k", gone).collect()) == [i for i in range(1000) if i % 3]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("x")


# -- decontamination


def edit_distance_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


@settings(deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120), st.integers(0, 12))
def test_myers(pattern, text, most):
    best, end = edit_distance_within(pattern, text)
    assert decontamination.myers(pattern, text, most) == ((best, end) if best <= most else None)


def test_contamination(frame, spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(i, prose(30)) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (3, None), (30, "Tiny one"), (31, "An item of 20 chars."), (32, "yes"), (33, "An item of twenty ch")]
    rows = [(None, items[0][1]), (1, None), (2, ""), (3, prose(300)), (4, "a tiny one."), (5, "mytiny ones"), (7, "say yes: an item of 20 chars"), (8, "an item of twenty ch"), (6, items[1][1]), (6, items[1][1])]
    for k in range(60):
        text = list(items[k % 12][1])
        for _ in range(rng.randrange(0, 30)):
            at = rng.randrange(len(text))
            what = rng.randrange(3)
            text[at : at + (what != 1)] = [rng.choice("xyz")] if what != 2 else []
        rows.append((100 + k, f"{prose(50)}\n{''.join(text).upper()}, {prose(40)}"))
    want = []
    for i, text in rows:
        for j, item in items:
            a, b = decontamination.normalise(item), decontamination.normalise(text)
            if len(a) - 2 >= decontamination.LEAST and b:
                best, _ = edit_distance_within(a, b)
                if best <= int(decontamination.RATE * (len(a) - 2)):
                    want.append((i, j, best))
    benchmark = frame("item_id long, text string", items)
    documents = frame(DOCS, rows)
    got = [(r.doc_id, r.item_id, r.distance) for r in decontamination.contamination(documents, benchmark).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20 and (8, 33, 0) in want
    clean = decontamination.decontaminate(documents, benchmark)
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in rows if i not in {w[0] for w in want}) and clean.columns == documents.columns


def test_items_in_very_long_texts_and_parts_of_items(frame):
    """Recall of items with 5 % of their characters edited, at any place of a long text; a quarter of an item is none."""
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(i, prose(30)) for i in range(10)]
    rows = []
    for i, item in items:
        text = list(item)
        for at in rng.sample(range(len(text)), len(text) // 20):
            text[at] = "x"
        rows += [(i, f"{prose(20_000)} {''.join(text)} {prose(20_000)}"), (100 + i, f"{prose(50)} {item[: len(item) // 4]} {prose(50)}")]
    got = decontamination.contamination(frame(DOCS, rows), frame("item_id long, text string", items)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i, _ in items]


def test_contamination_in_blocks_and_of_nothing(frame, monkeypatch):
    items = [(i, f"item number {i} has words of its own {i * 7919}") for i in range(40)]
    rows = [(i, f"before {t} after") for i, t in items[::3]]
    monkeypatch.setattr(decontamination, "BLOCK", 100)
    got = decontamination.contamination(frame(DOCS, rows), frame("item_id long, text string", items)).where("distance = 0")
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i, _ in items[::3]]
    for d, b in ((rows, []), ([], items), ([], [])):
        assert decontamination.contamination(frame(DOCS, d), frame("item_id long, text string", b)).collect() == []


# -- fingerprints


def brute_winnow(text, k=8, w=8):
    """(hash, position) of the chosen k-grams, by a hash that rolls along the text and by looking at every window."""
    flat = [c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r\x85\xa0" else c for c in text or ""]
    own = {c: xxhash.xxh64_intdigest(c.encode(), seed=42) for c in set(flat)}
    if not flat:
        return []
    whole, h = (1 << 64) - 1, 0
    for c in flat[:k]:
        h = (h << 1 ^ own[c]) & whole
    rolled = [h >> 32 & (1 << 31) - 1]
    for i in range(k, len(flat)):
        h = (h << 1 ^ own[flat[i - k]] << k ^ own[flat[i]]) & whole
        rolled.append(h >> 32 & (1 << 31) - 1)
    windows = [range(s, min(s + w, len(rolled))) for s in range(max(1, len(rolled) - w + 1))]
    return [(rolled[i], i) for i in sorted({min(v, key=lambda j: (rolled[j], -j)) for v in windows})]


def parsed(fingerprint):
    return [(int(h, 16), int(i)) for h, _, i in (x.partition("@") for x in fingerprint.split())]


def test_winnowing(spark):
    rng = random.Random(3)
    texts = ["", " ", "ab", "Exactly8", "fifteen chars!!", "x" * 50, "One  two\tTHREE four, five six", "\U00020000" * 3 + "abc\U00020001defghi" * 3, "İÄß" * 9, None]
    texts += ["".join(rng.choices("ab", k=rng.randrange(100))) for _ in range(40)]
    for k, w in ((8, 8), (4, 2), (2, 16), (1, 1)):
        df = spark.createDataFrame(list(enumerate(texts)), DOCS)
        got = fingerprints.winnow(df, "text", "f", k, w).select("doc_id", fingerprints.render("f").alias("f")).collect()
        assert {r.doc_id: parsed(r.f) for r in got} == {i: brute_winnow(t, k, w) for i, t in enumerate(texts)}


def brute_edited(rows):
    """(doc_id, n_chars, sha, fingerprint, edited fingerprint, near_edited, near_next) of rows in their order."""
    def near(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, then = brute_winnow(text), brute_winnow(edited), brute_winnow(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, round(near(own, other), 9), round(near(own, then), 9)))
    return out


def told(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, parsed(r.fingerprint), parsed(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()]


def in_order(spark, rows):
    """Rows by doc_id, null first, and of one doc_id by the operator's hash of the text."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t or "") for i, t in rows], DOCS)
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 11), "text").collect()]


@pytest.mark.parametrize("bucket", [64 << 20, 500])
def test_edited_fingerprints(spark, frame, odd_documents, monkeypatch, bucket):
    """Every text of every length, in few buckets and in many."""
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    rng = random.Random(2)
    rows = [r for r in odd_documents if len(r[1] or "") < 5000]
    rows += [(1000 + i, "".join(rng.choices("abc d", k=i))) for i in range(90)] + [(2000 + i, "".join(rng.choices("ab", k=rng.randrange(300)))) for i in range(60)]
    rows += [(None, f"nameless {i} " * (i % 9)) for i in range(40)] + [(77, f"one id {i} " * (i % 9)) for i in range(60)]
    got = told(fingerprints.edited_fingerprints(frame(DOCS, rows)))
    assert sorted(got, key=str) == sorted(brute_edited(in_order(spark, rows)), key=str)
    by = {r[0]: r for r in got}
    assert by[500][3] == by[501][3] != [] and by[500][6] == 1.0


def test_rows_of_one_id_are_dealt_out(spark, monkeypatch):
    """A doc_id, or none, that holds most rows: no bucket holds more than its share."""
    monkeypatch.setattr(fingerprints, "BUCKET", 1000)
    for doc_id in (None, 5, 1 << 62):
        rows = [(doc_id, f"text {i} " * 3) for i in range(2000)] + [(i, f"own {i}") for i in range(700)]
        dealt, _ = fingerprints.with_next(spark.createDataFrame(rows, DOCS), lambda df: df)
        sizes = [r["count"] for r in dealt.groupBy("__bucket").count().collect()]
        assert max(sizes) <= 0.2 * len(rows) and sum(sizes) == len(rows) + len(sizes)


def test_very_long_texts_are_fingerprinted_whole(frame, odd_documents):
    long = [r for r in odd_documents if r[0] in (400, 401)]
    got = told(fingerprints.edited_fingerprints(frame(DOCS, long)))
    assert sorted(got) == sorted(brute_edited(sorted(long)))


def test_short_and_unspaced_texts_keep_a_likeness(frame):
    """Half of each text is kept: it is seen in few words, and in text without spaces of any script."""
    rng = random.Random(11)
    letters = {"latin": "abcdefghijklmnop", "khmer": [chr(0x1780 + i) for i in range(30)], "han": [chr(0x20000 + i) for i in range(900)]}
    rows = [(i, "".join(rng.choices(letters[kind], k=60))) for i, kind in enumerate([*letters] * 4)]
    rows += [(100 + i, " ".join("".join(rng.choices(letters["latin"], k=7)) for _ in range(6))) for i in range(9)]
    assert all(r.near_edited > 0 for r in fingerprints.edited_fingerprints(frame(DOCS, rows)).collect())


def test_edited_fingerprints_of_little(frame):
    assert fingerprints.edited_fingerprints(frame(DOCS, [])).collect() == []
    one = fingerprints.edited_fingerprints(frame(DOCS, [(5, "abcd")])).first()
    assert (one.n_chars, one.edited_sha256) == (4, hashlib.sha256(b"abab").hexdigest())
    assert {r.n_chars for r in fingerprints.edited_fingerprints(frame(DOCS, [(None, "ab"), (None, None)])).collect()} == {2, 0}


def test_fingerprints_stay_in_the_jvm(spark, sf):
    plan = fingerprints.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_slice_outside_interpreted_passes(spark, sf):
    """What stands inside zip_with is interpreted element by element: slices are taken before it."""
    plan = fingerprints.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    passes = [line for line in plan.splitlines() if "zip_with(" in line]
    assert passes and not [line for line in passes if "slice(" in line.partition("zip_with(")[2]]


# -- tokens and packing


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_the_vocabulary_files(text):
    from tokenizers import Tokenizer

    global _own
    if "_own" not in globals():
        _own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        _own.encode_special_tokens = True
    assert tokens.text_ids(*vocabulary().values(), text).tolist() == _own.encode(text, add_special_tokens=False).ids


def test_token_counts(frame, odd_documents, reference_ids):
    rows = [*odd_documents, (600, "<|endoftext|> is text")]
    got = tokens.token_counts(frame(DOCS, rows), end=END_OF_TEXT, **vocabulary()).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, len(reference_ids(t))) for i, t in rows), key=str)
    assert tokens.token_counts(frame(DOCS, []), end=END_OF_TEXT, **vocabulary()).collect() == []


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_separator_scan(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = [], []
    for f, tail in enumerate((True, False, True)):
        ids = [rng.choice([9, 9, 9, 5, 6]) for _ in range(60)] + ([] if tail else [5]) if f < 2 else [9]
        path = f"file://{tmp_path}/{f}.u16"
        np.array(ids, "<u2").tofile(path.removeprefix("file://"))
        files.append((path,))
        start, n = 0, 0
        for i, x in enumerate([*ids, *([9] if ids[-1] != 9 else [])]):
            if x == 9:
                want.append((path, n, start, i - start))
                start, n = i + 1, n + 1
    (tmp_path / "empty.u16").write_bytes(b"")
    files.append((f"file://{tmp_path}/empty.u16",))
    got = tokens.separator_scan(spark, spark.createDataFrame(files, "file string"), 9, block)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def check_packing(rows, got, ids_of, capacity):
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*ids_of(t), 0])
    pieces, bins = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, texts in ids.items():
        made = Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i])
        want = Counter()
        for own in texts:
            at, first = 0, len(own) % capacity or capacity
            for k, to in enumerate(range(first, len(own) + 1, capacity)):
                want[k, at, to - at, zlib.crc32(np.array(own[at:to], "<u4").tobytes())] += 1
                at = to
        assert made == want
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(n for b in bins.values() for _, n in b)


def test_packing(frame, odd_documents, reference_ids):
    got = packing.pack_documents(frame(DOCS, odd_documents), **vocabulary()).collect()
    bins, total = check_packing(odd_documents, got, reference_ids, 2048)
    assert bins <= -(-total // 2048) + 2
    assert packing.pack_documents(frame(DOCS, []), **vocabulary()).collect() == []


def test_packing_in_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 300)
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, length long").withColumn("piece", df_lit())
    got = packing.pack(df.select("doc_id", "length"), 2048).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted((r.doc_id, r.length) for r in got) == rows
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.01 * -(-sum(n for _, n in rows) // 2048)


@pytest.mark.parametrize(("low", "high"), [(1500, 1500), (900, 2047), (1, 2048)])
def test_no_shard_packs_more_than_its_share(spark, monkeypatch, low, high):
    """Pieces that leave most bins open: the last level is dealt to shards like the first."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "SHARD", 200)
    real, at = packing.materialize, []
    monkeypatch.setattr(packing, "materialize", lambda df, name="table": (at.append(real(df, name)), at[-1])[1])
    rng = random.Random(low)
    rows = [(i, rng.randint(low, high)) for i in range(4000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), 2048)
    bins = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("to")).collect()
    assert all(b.n == b.to <= 2048 for b in bins) and got.count() == 4000
    for t in at[1:]:
        assert t.groupBy("shard").count().agg(F.max("count")).first()[0] <= 300
    if low == high:
        assert len(bins) == 4000 and len(at) == 2  # nothing fits anywhere: one level
    elif low == 1:
        assert len(bins) <= 1.05 * -(-sum(n for _, n in rows) // 2048)


def test_ids_of_a_whole_table(spark, sf, reference_ids):
    for (text,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert tokens.text_ids(*vocabulary().values(), text).tolist() == reference_ids(text)


def test_wide_ids_are_refused():
    assert tokens.as_uint16(np.array([0, 65535], np.uint32)).tolist() == [0, 65535]
    with pytest.raises(ValueError, match="65536"):
        tokens.as_uint16(np.array([1, 65536], np.uint32))


@settings(deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_sum_of_squares_is_least(lengths):
    """Every choice against all choices."""
    where, offset, left = packing.sum_of_squares(np.array(lengths, np.int64), 30)
    gaps, fill = [], {}
    for size, b, at in zip(lengths, where.tolist(), offset.tolist(), strict=True):
        def cost(after):
            return sum(n * n for g, n in Counter(after).items() if 0 < g < 30)

        options = {g: cost([*gaps[:i], g - size, *gaps[i + 1 :]]) for i, g in enumerate(gaps) if g >= size}
        new = cost([*gaps, 30 - size])
        assert fill.get(b, 0) == at
        if b == len(gaps):
            assert all(new < c for c in options.values())
            gaps.append(30 - size)
        else:
            assert options[gaps[b]] == min(options.values()) <= new
            gaps[b] -= size
        fill[b] = at + size
    assert gaps == left.tolist()


# -- language ID


def sample(rng, lang, n):
    parts = {"en": ["the", "tion", "ing", "and", "er"], "de": ["sch", "ung", "ein", "der", "ä"], "fr": ["eau", "é", "ou", "le", "tion"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id(frame):
    rng = random.Random(4)
    rows = [(i, sample(rng, lang := rng.choice(["en", "de", "fr"]), rng.randrange(8, 60)), lang) for i in range(600)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 !! ½²", "de"), (1003, "the and", None), (None, "eau", None), (1004, "ein " * 400_000, None), (1, rows[1][1], rows[1][2])]
    documents = frame("doc_id long, text string, lang string", rows + odd)
    model = language_id.train(documents)
    got = language_id.identify(documents, model).collect()
    assert len(got) == len(rows + odd) and sorted(model.langs) == ["de", "en", "fr"]
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [i for i, _, _ in rows if by[i].held_out]
    assert len(held) > 100 and sum(by[i].lang_pred == rows[i][2] for i in held) >= 0.97 * len(held)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "en", "de"]
    kept = language_id.keep_identified(documents, model)
    assert {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect()) and kept.columns == documents.columns


def brute_grams(text):
    """(order, gram) of a text as the contract of the classifier has them."""
    flat = re.sub(r"[\W\d_]+", " ", f" {text} ".lower())
    return [flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1)]


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 18])
def test_language_scores_are_naive_bayes(monkeypatch, chunk):
    """A batch's scores against sums over each text's grams, in one part and in many."""
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    rng = random.Random(6)
    counts = np.array([[rng.randrange(50) for _ in range(3 * language_id.BUCKETS)] for _ in range(2)], float)
    model = language_id.Model(["a", "b"], np.array([3.0, 5.0]), counts)
    texts = ["Some text, é 12 words", None, "x", "", "12", "ab", "q" * 40, "Ünï 𐐀 end"]

    def bucket(gram):
        own = np.array([ord(c) for c in gram], np.uint32)
        *_, h = language_id.grams(own, np.arange(len(own), 0, -1))
        return int(h[0])

    langs, sure = language_id.predict(model.parts(), texts)
    for text, lang, p in zip(texts, langs, sure, strict=True):
        if not text or text == "12":
            assert (lang, p) == ("und", 0.0)
            continue
        score = np.log(np.array([3, 5]) / 8)
        for gram in brute_grams(text):
            x = bucket(gram)
            n = len(gram) - 1
            assert x // language_id.BUCKETS == n
            block = counts[:, n * language_id.BUCKETS : (n + 1) * language_id.BUCKETS] + 0.5
            score += np.log(block[:, x % language_id.BUCKETS] / block.sum(axis=1))
        want = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert lang == "ab"[int(score.argmax())] and abs(p - want.max()) < 1e-3


def test_language_without_labels(frame):
    documents = frame("doc_id long, text string, lang string", [(1, "words", None), (2, None, None)])
    assert {r.lang_pred for r in language_id.identify(documents, language_id.train(documents)).collect()} == {"und"}
    empty = frame("doc_id long, text string, lang string", [])
    assert language_id.identify(empty, language_id.train(empty)).collect() == []


def test_training_sample_is_bounded(frame):
    rng = random.Random(7)
    documents = frame("doc_id long, text string, lang string", [(i, sample(rng, "en", 5), "en") for i in range(2000)])
    model = language_id.train(documents, most=100)
    assert model.langs == ["en"]
    for doc_id in range(1, 9):  # one doc_id for all rows: its hash takes all or none
        documents = frame("doc_id long, text string, lang string", [(doc_id, "the and", "en")] * 300)
        assert language_id.train(documents, most=2).langs == ([] if zlib.crc32(str(doc_id).encode()) % 4 == 2 else ["en"])


def test_training_counts_whole_texts(frame):
    """Counts by brute force, of a text in many parts too."""
    text = "ab ba " * 60_000
    documents = frame("doc_id long, text string, lang string", [(1, text, "en"), (3, "ab", "en"), (4, "zz", "de")])
    model = language_id.train(documents)
    prior = dict(zip(model.langs, np.exp(model.prior), strict=True))
    kept = [i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert abs(prior["en"] - len({1, 3} & set(kept)) / len(kept)) < 1e-9
