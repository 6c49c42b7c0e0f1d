"""The registered queries and the pipeline, as the driver calls them."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarrykit.llm.decontamination import normalise
from quarrykit.llm.queries import ORACLES, QUERIES

ROWS = {"op1_warc": "pages", "op3_url_filter": "pages", "op4_ngram_jaccard_join": "documents", "op5_winnowing": "documents", "op6_token_counts": "documents", "op7_html_extraction": "pages", "op10_language_id": "documents"}
COLUMNS = {
    "op1_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op3_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op4_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_winnowing": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op7_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op10_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_tables(name, spark, sf):
    got = entry.queries()[name](spark, sf)
    assert COLUMNS.get(name, {}).items() <= dict(got.dtypes).items()
    if name in ROWS:
        key = "page_id" if ROWS[name] == "pages" else "doc_id"
        want = Counter(r[0] for r in spark.read.parquet(f"{sf}/{ROWS[name]}.parquet").select(key).collect())
        assert Counter(r[0] for r in got.select(key).collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_languages_held_out(spark, sf):
    told = entry.queries()["op10_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(told) > 30 and sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)


def test_stages(spark, sf):
    """Each stage on all that the one before kept, against what it should keep."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, items = docs.columns, [normalise(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "packing"]
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
        if name == "language_id":
            assert kept[1] == {i: t for i, t in kept[0].items() if any(c.isalpha() for c in t)}
        elif name == "ngram_join":
            assert 0 < len(kept[2]) < len(kept[1]) and len(set(kept[2].values())) == len(kept[2])
        else:
            leaks = {i for i, t in kept[2].items() if any(x in normalise(t) for x in items)}
            assert leaks and set(kept[2]) - set(kept[3]) == leaks
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == set(kept[3])
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows, items):
    """(doc_id, text) that the first three stages keep, by looking at every pair of rows and every item."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for a, (i, t) in enumerate(rows):
        groups.setdefault(find(a), []).append((i is None, i or 0, t))
    items = [normalise(x) for x in items if len(normalise(x)) > 21]
    first = [min(g) for g in groups.values()]
    return Counter((None if nameless else i, t) for nameless, i, t in first if not any(x in normalise(t) for x in items))


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, blank and very long texts, ties, repeated rows and columns of clashing names, against brute
    force; and no rows at all."""
    import random

    from conftest import CLASHING

    rng = random.Random(21)
    kinds = {"en": ["the", "tion", "ing", "and", "er"], "de": ["sch", "ung", "ein", "der", "ä"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))

    items = [prose("en", 25), None, "", "yes", prose("de", 30)]
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        rows.append((i, prose(lang, rng.randrange(30, 90)), lang, rng.choice(["web", None])))
    rows += [(100 + i, rows[i][1] + " " + rows[i + 1][1].split()[0], rows[i][2], None) for i in range(10)]  # near copies
    rows += [(200, f"{prose('en', 20)} {items[0]} {prose('en', 20)}", "en", "web"), (201, items[4].upper(), "de", None)]
    rows += [(300, None, "en", "web"), (301, "", None, None), (302, "12 34 ...", "de", None), (None, prose("en", 40), "en", None), (None, rows[3][1], None, None)]
    rows += [(303, prose("de", 30_000), "de", "web"), (304, prose("en", 12) + " yes", None, None), rows[5], rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [c for c in CLASHING if c not in ("text", "doc_id")]
    full = schema + "".join(f", `{c}` string" for c in extra if c not in ("lang", "source", "n_chars"))
    wide = [(*r, len(r[1] or ""), *("x" for _ in extra)) for r in rows]
    for name, some in (("rows", wide), ("none", [])):
        spark.createDataFrame(some, full).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/rows/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/rows")
        assert docs.columns == columns
    want = brute_kept([r[:2] for r in rows], items)
    kept = Counter((r.doc_id, r.text) for r in docs.collect())
    # of copies without doc_id, or of one, which text stays is told by a digest: count those by id
    assert Counter(i for i, _ in kept.elements()) == Counter(i for i, _ in want.elements())
    assert {k: v for k, v in kept.items() if k[0] not in (None, 5)} == {k: v for k, v in want.items() if k[0] not in (None, 5)}
    packed = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    assert {r.doc_id for r in packed} == {i for i, _ in want} and sum(r.start == 0 for r in packed) == sum(want.values())
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
