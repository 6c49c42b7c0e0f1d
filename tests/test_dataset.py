"""Datasets end to end: sources, log, joins, views, indexes, exports."""

import json
import tarfile

import pyarrow as pa
import pytest

import quarrykit as qk
from quarrykit.commands import answer, execute
from quarrykit.operators.ops import KINDS
from quarrykit.plans.sqltext import SqlError


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("sources")

    def people(name, ids):
        lines = ["Index,Customer Id,First Name,Country,Email,Subscription Date"]
        for i in ids:
            lines.append(f'{i},c{i:03},"Name, {i}",{["Chile", "Peru", "Fiji"][i % 3]},p{i}@example.org,2021-0{1 + i % 9}-11')
        (at / name).write_text("\n".join(lines))  # no line end at the end

    people("people-1.csv", range(1, 101))
    people("people-2.csv", range(101, 151))
    (at / "regions.csv").write_text("Country,Region\nChile,South\nPeru,South\nOman,East")
    (at / "regions-2.csv").write_text("Country,Region\nFiji,Ocean")
    rows = [{"name": "Ann", "session": "2013", "score": 24, "done": True}, {"name": "Bo", "session": "2012", "score": 29, "done": False}]
    (at / "objects.json").write_text("\n".join(map(json.dumps, rows)))
    return at


def people(spark, files, folder=""):
    return qk.create(str(folder), spark=spark).attach(f"{files}/people-1.csv")


def test_all_operation_types():
    assert len([k for k in KINDS if k]) == 18


def test_empty(spark):
    made = qk.create(spark=spark)
    assert made.num_rows == 0 and made.schema.is_empty() and made.version == "empty"


def test_csv_types_and_quotes(spark, files):
    made = people(spark, files)
    assert [str(f) for f in made.schema] == ["Index: Int64", "Customer Id: Utf8", "First Name: Utf8", "Country: Utf8", "Email: Utf8", "Subscription Date: Date32"]
    assert made.select("SELECT \"First Name\" WHERE Index = $1", [7]).to_dict() == {"First Name": ["Name, 7"]}
    with pytest.raises(ValueError, match="not found"):
        made.schema.field("absent")


def test_blocks_are_united(spark, files):
    made = people(spark, files)
    assert made.num_rows == 100
    assert made.attach(f"{files}/people-2.csv").num_rows == 150


def test_json_keeps_its_order(spark, files):
    made = qk.create(spark=spark).attach(f"{files}/objects.json")
    assert made.schema.names == ["name", "session", "score", "done"]
    assert made.to_dict()["score"] == [24, 29]


@pytest.mark.parametrize("url", ["absent.csv", "x.unknown", "function://nothing", "../up.csv"])
def test_bad_sources_fail_at_attach(spark, files, url):
    made = qk.create(str(files), spark=spark)
    with pytest.raises((ValueError, FileNotFoundError)):
        made.attach(url)
    # nothing is left of the failed change
    assert made.status().is_empty() and made.operations() == []
    assert made.attach(f"{files}/people-1.csv").num_rows == 100


def test_joins(spark, files):
    def joined(how):
        return people(spark, files).join("regions", f"{files}/regions.csv", "$base.Country = regions.Country", how)

    assert {h: joined(h).num_rows for h in ("inner", "left", "right", "full", "nonsense")} == {"inner": 67, "left": 100, "right": 68, "full": 101, "nonsense": 67}
    made = joined("inner")
    assert made.schema.names.count("Country") == 2
    assert made.attach_to_join("regions", f"{files}/regions-2.csv").num_rows == 100
    with pytest.raises(ValueError, match="Unknown join"):
        made.attach_to_join("other", f"{files}/regions.csv")


def test_joins_come_before_filters(spark, files):
    made = people(spark, files).filter("Region = 'South'").join("r", f"{files}/regions.csv", "base.Country = r.Country", "left")
    assert made.num_rows == 67


def test_select_forks_and_is_lazy(spark, files):
    made = people(spark, files)
    few = made.select("* LIMIT 10")
    assert (few.num_rows, made.num_rows) == (10, 100)
    wrong = made.select("SELECT * FROM nothing_like_it")  # analysed when its rows are asked for
    with pytest.raises(Exception, match="nothing_like_it"):
        wrong.num_rows


def test_forks_share_nothing(spark, files):
    made = people(spark, files)
    fork = made.select("*")
    fork.attach(f"{files}/people-2.csv")
    assert (made.num_rows, fork.num_rows) == (100, 150)


def test_columns(spark, files):
    made = people(spark, files).rename_column("Index", "n").rename_column("n", "number").remove_column("Email").remove_column("absent")
    assert made.schema.names == ["number", "Customer Id", "First Name", "Country", "Subscription Date"]
    with pytest.raises(ValueError, match="not found"):
        made.rename_column("Email", "mail")
    for name in made.schema.names:
        made.remove_column(name)
    assert made.schema.is_empty()


def test_names_are_case_sensitive_and_free(spark, files):
    made = people(spark, files).rename_column("Email", "名前").rename_column("Country", "user.first-name@2024")
    assert made.select("\"名前\" WHERE \"user.first-name@2024\" = 'Peru'").num_rows == 34
    with pytest.raises(Exception):
        made.select("index").num_rows


def test_parameters(spark, files):
    made = people(spark, files)
    assert made.filter("Country = $1 AND Index <= $2", ["Chile", 10]).num_rows == 3
    with pytest.raises(TypeError):
        made.filter("Index = $1", [object()])


def test_log(spark, files, tmp_path):
    made = people(spark, files, tmp_path)
    assert str(made.status()).startswith("1 change(s), 2 operation(s)")
    first = made.version
    made.set_name("people").set_description("of the world").commit("first")
    assert made.version != first and made.status().is_empty()
    made.filter("Index < 11").filter("Index < 6")
    assert made.num_rows == 5 and made.undo().num_rows == 10 and made.reset().num_rows == 100
    with pytest.raises(ValueError, match="No uncommitted changes"):
        made.undo()
    made.filter("Index < 4").commit("second")
    opened = qk.open(str(tmp_path), spark=spark)
    assert (opened.num_rows, opened.name, opened.description, opened.version) == (3, "people", "of the world", made.version)
    assert [c.message for c in opened.history()] == ["first", "second"]
    names = sorted(p.name for p in (tmp_path / "_log").iterdir() if p.name.endswith(".yaml"))
    assert names[0] == "00000000000000000.yaml" and [n[:5] for n in names[1:]] == ["00001", "00002"]


def test_two_writers(spark, files, tmp_path):
    people(spark, files, tmp_path).commit("first")
    a, b = (qk.open(str(tmp_path), spark=spark).extend() for _ in "ab")
    a.filter("Index < 9").commit("a")
    with pytest.raises(Exception):
        b.filter("Index < 8").commit("b")
    assert qk.open(str(tmp_path), spark=spark).num_rows == 8


def test_extend(spark, files, tmp_path):
    first, second = tmp_path / "a", tmp_path / "b"
    people(spark, files, first).commit("all")
    opened = qk.open(str(first), spark=spark)
    opened.extend(str(second)).filter("Index < 5").commit("few")
    assert qk.open(str(second), spark=spark).num_rows == 4 and qk.open(str(first), spark=spark).num_rows == 100
    assert qk.open(str(second), spark=spark).id == opened.id
    with pytest.raises(FileNotFoundError):
        qk.open(str(tmp_path / "none"), spark=spark)


def test_cycles_are_found(spark, tmp_path):
    for a, b in (("x", "y"), ("y", "x")):
        (tmp_path / a / "_log").mkdir(parents=True)
        (tmp_path / a / "_log" / "00000000000000000.yaml").write_text(f"from: {tmp_path / b}\n")
    with pytest.raises(ValueError, match="extends itself"):
        qk.open(str(tmp_path / "x"), spark=spark)


def test_views(spark, files, tmp_path):
    made = people(spark, files, tmp_path).commit("all")
    made.create_view("chile", made.select("* WHERE Country = 'Chile'"))
    made.filter("Index < 50").create_view("few", made)  # its own pending changes move to the view
    assert [c.description for c in made.status().changes] == ["Create view chile", "Create view few"]
    with pytest.raises(ValueError, match="already exists"):
        made.create_view("chile", made.select("*"))
    made.commit("views")
    opened = qk.open(str(tmp_path), spark=spark)
    assert opened.num_rows == 100 and set(opened.views().values()) == {"chile", "few"}
    view = opened.view("chile")
    assert view.num_rows == 33 and opened.view("few").num_rows == 49 and view.is_view and not hasattr(view, "attach")
    with pytest.raises(ValueError, match="not allowed on a view"):
        view.extend().attach(f"{files}/people-2.csv")
    with pytest.raises(ValueError, match="Available views: chile, few"):
        opened.view("other")
    made = opened.extend().rename_view("few", "some").drop_view("chile").filter("Index < 41").commit("changes")
    opened = qk.open(str(tmp_path), spark=spark)
    assert list(opened.views().values()) == ["some"] and opened.view("some").num_rows == 40
    with pytest.raises(ValueError, match="not found"):
        made.drop_view("chile")


@pytest.mark.parametrize(
    ("where", "params"),
    [("Email = 'p7@example.org'", []), ("'p120@example.org' = Email", []), ("Email IN ($1, 'p149@example.org', 'none')", ["p3@example.org"]), ("Email = 'none'", []), ("Email > 'p98' AND Email <= 'p99@example.org'", []), ("Email = 'p7@example.org' OR Index = 3", []), ("NOT Email = 'p7@example.org'", []), ("upper(Email) = 'P7@EXAMPLE.ORG'", [])],
)
def test_indexes_never_change_results(spark, files, tmp_path, where, params):
    made = people(spark, files, tmp_path).attach(f"{files}/people-2.csv")
    plain = sorted(made.select(f"Index WHERE {where}", params).to_dict()["Index"])
    made.index("Email")
    assert sorted(made.select(f"Index WHERE {where}", params).to_dict()["Index"]) == plain
    made.rename_column("Email", "mail")
    assert sorted(made.filter(where.replace("Email", "mail"), params).to_dict()["Index"]) == plain


def test_index_prunes_files(spark, files, tmp_path):
    made = people(spark, files, tmp_path).attach(f"{files}/people-2.csv").index("Email")
    one = made.select("Index WHERE Email = 'p120@example.org'")
    assert len(one.dataframe.inputFiles()) == 1 and one.to_dict() == {"Index": [120]}
    made.rebuild_index("Email")
    assert len(made.select("Index WHERE Email = 'p120@example.org'").dataframe.inputFiles()) == 1
    made.drop_index("Email")
    with pytest.raises(ValueError, match="No index found"):
        made.drop_index("Email")
    assert len(made.select("Index WHERE Email = 'p120@example.org'").dataframe.inputFiles()) == 2


def test_index_errors(spark, files, tmp_path):
    made = people(spark, files, tmp_path)
    with pytest.raises(ValueError, match="not found"):
        made.index("absent")
    with pytest.raises(ValueError, match="computed"):
        made.select("Index + 1 AS next").index("next")
    made.index("Email")
    with pytest.raises(ValueError, match="already indexed"):
        made.index("Email")


def test_functions(spark, tmp_path):
    def pages(page, schema):
        return pa.RecordBatch.from_pydict({"id": [page, page + 10], "name": ["a", None]}, schema=schema) if page < 3 else None

    made = qk.create(str(tmp_path), spark=spark).define_function("users", {"id": "Int64", "name": "Utf8"}, pages).attach("function://users")
    assert made.num_rows == 6 and made.to_dict()["id"] == [0, 10, 1, 11, 2, 12]
    made.commit("rows")
    assert qk.open(str(tmp_path), spark=spark, functions={"users": pages}).num_rows == 6
    with pytest.raises(ValueError, match="implementation not set"):
        qk.open(str(tmp_path), spark=spark).num_rows
    with pytest.raises(ValueError, match="Unknown function"):
        qk.create(spark=spark).attach("function://other")
    fixed = qk.StaticPages([pa.RecordBatch.from_pydict({"id": [1]}), pa.RecordBatch.from_pydict({"id": [2]})])
    assert qk.create(spark=spark).define_function("s", {"id": "Int32"}, fixed).attach("function://s").to_dict() == {"id": [1, 2]}


def test_exports(spark, files, tmp_path):
    made = people(spark, files, tmp_path).select("Index, Country WHERE Index < 4 ORDER BY Index")
    assert made.to_pandas()["Index"].tolist() == [1, 2, 3]
    assert made.to_numpy()["Index"].tolist() == [1, 2, 3]
    assert sum(b.num_rows for b in made.as_pyarrow()) == 3
    stream = made.as_pyarrow_stream()
    assert stream.schema.names == ["Index", "Country"] and sum(b.num_rows for b in stream) == 3 and stream.next_batch() is None
    assert [b.num_rows for b in qk.stream_batches(people(spark, files), 40)] == [40, 40, 20]
    assert "physical_plan" in made.explain()


def test_tar(spark, files, tmp_path):
    made = people(spark, files, tmp_path / "d")
    with pytest.raises(ValueError, match="uncommitted"):
        made.export_tar(f"{tmp_path}/x.tar")
    made.filter("Index < 9").commit("first").export_tar(f"{tmp_path}/x.tar")
    with tarfile.open(tmp_path / "x.tar") as t:
        assert all(m.mode == 0o644 for m in t.getmembers())
    opened = qk.open(f"{tmp_path}/x.tar", spark=spark)
    assert opened.num_rows == 8
    opened.extend().filter("Index < 3").commit("in place")
    assert qk.open(f"{tmp_path}/x.tar", spark=spark).num_rows == 2


def test_commands(spark, files, tmp_path):
    made = qk.create(str(tmp_path), spark=spark)
    execute(made, f"attach '{files}/people-1.csv'")
    execute(made, f"LEFT JOIN '{files}/regions.csv' AS r ON base.Country = r.Country -- a note\n")
    execute(made, f"ATTACH '{files}/regions-2.csv' TO JOIN 'r'")
    execute(made, "FILTER WHERE Region = 'Ocean'")
    assert answer(made, "COUNT") == "33"
    assert execute(made, "SELECT count(*) AS n FROM bundle").to_dict() == {"n": [33]}
    execute(made, "UNDO")
    assert made.num_rows == 100
    execute(made, "INDEX Email")
    execute(made, "CREATE VIEW v AS SELECT * WHERE Index < 5")
    execute(made, "RENAME VIEW v TO w")
    execute(made, r"COMMIT 'it\'s done'")
    assert made.history()[-1].message == "it's done" and qk.open(str(tmp_path), spark=spark).view("w").num_rows == 4
    assert "COMMIT" in answer(made, "HELP") and "Index: Int64" in answer(made, "SCHEMA") and "+--" in answer(made, "SHOW LIMIT 2")
    for bad in ("", "NONSENSE x", "RESET; UNDO"):
        with pytest.raises(SqlError):
            execute(made, bad)


def test_memory_and_config(spark, files):
    url = qk.random_memory_url()
    people(spark, files, url).set_config("endpoint", "http://localhost:9", "s3://lake/").commit("x")
    assert qk.open(url, spark=spark).num_rows == 100
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.bucket.lake.endpoint") == "http://localhost:9"


def test_progress_is_told(spark, files):
    told = []
    qk.set_progress_callback(lambda *x: told.append(x[0]))
    try:
        people(spark, files)
    finally:
        qk.set_progress_callback(None)
    assert told[0] == "start" and told[-1] == "finish" and "update" in told


def test_context_tables(spark, files):
    made = people(spark, files)
    key = made.operations()[0].id
    assert made.ctx().sql(f"SELECT count(*) AS n FROM packs.__pack_{key}").first().n == 100
    assert made.ctx().sql("SELECT count(*) AS n FROM public.bundle WHERE Index < $1", [3]).first().n == 2


# -- what a crash leaves, text sources, what an index takes out of a scan


def test_a_crash_blocks_no_commit(spark, files, tmp_path, monkeypatch):
    """Before the rename nothing is in the way; after it, the commit is there for all."""
    from quarrykit.sources.files import Files

    at = str(tmp_path / "d")
    made = qk.create(at, spark=spark).attach(f"{files}/people-1.csv")
    made.filter("Index < 50").commit("first")
    take, create = Files.take, Files.create

    def broken(*_):
        raise OSError("the machine went away")

    monkeypatch.setattr(Files, "take", broken)
    with pytest.raises(OSError):
        qk.open(at, spark=spark).extend().filter("Index < 20").commit("lost")
    monkeypatch.setattr(Files, "take", take)
    assert [c.message for c in qk.open(at, spark=spark).history()] == ["first"]
    monkeypatch.setattr(Files, "create", lambda self, url, data: broken() if url.endswith(".yaml") and "00002" in url else create(self, url, data))
    with pytest.raises(OSError):
        qk.open(at, spark=spark).extend().filter("Index < 10").commit("second")
    monkeypatch.setattr(Files, "create", create)
    found = qk.open(at, spark=spark)
    assert [c.message for c in found.history()] == ["first", "second"] and found.num_rows == 9
    found.extend().filter("Index < 5").commit("third")
    assert qk.open(at, spark=spark).num_rows == 4


def test_of_two_writers_the_second_fails(spark, files, tmp_path):
    at = str(tmp_path / "d")
    qk.create(at, spark=spark).attach(f"{files}/people-1.csv").commit("first")
    a, b = (qk.open(at, spark=spark).extend() for _ in range(2))
    a.filter("Index < 9").commit("mine")
    with pytest.raises(FileExistsError):
        b.filter("Index < 8").commit("too late")
    assert qk.open(at, spark=spark).num_rows == 8


def test_quoted_line_ends(spark, tmp_path):
    at = tmp_path / "a.csv"
    at.write_text('a,b\n1,"x\ny"\n2,z\n3,"says ""hi"""\n')
    made = qk.create(str(tmp_path / "d"), spark=spark).attach(str(at))
    assert [tuple(r) for r in made.dataframe.collect()] == [(1, "x\ny"), (2, "z"), (3, 'says "hi"')]
    made.commit("kept")
    assert qk.open(str(tmp_path / "d"), spark=spark).num_rows == 3


def scanned(made):
    """(files that a dataset's rows are read from, rows that the scans put out)."""
    df = made.dataframe
    return len(df.inputFiles()), df.count()


def indexed(spark, tmp_path, clustered):
    rows = spark.range(4000).selectExpr("id AS k", "id % 50 AS g", "concat('name ', id) AS name")
    rows.repartitionByRange(10, "k").write.parquet(str(tmp_path / "k.parquet"))
    one = tmp_path / "one.parquet"
    rows.coalesce(1).write.parquet(str(one))
    made = qk.create(str(tmp_path / "d"), spark=spark).attach(str(tmp_path / "k.parquet")).attach(str(one))
    return made.index("k", clustered)


def test_an_index_takes_files_out(spark, tmp_path):
    made = indexed(spark, tmp_path, False)
    assert scanned(made) == (11, 8000)
    for where, files, rows in (("k = 5", 2, 2), ("k IN (5, 3999)", 3, 4), ("k BETWEEN 0 AND 10", 2, 22), ("k >= 3990", 2, 20), ("k = -1", 0, 0)):
        assert scanned(made.select(f"SELECT * WHERE {where}")) == (files, rows), where


def test_a_clustered_index_skips_inside_files(spark, tmp_path):
    made = indexed(spark, tmp_path, True)
    found = made.select("SELECT * WHERE k BETWEEN 100 AND 110")
    assert scanned(found)[1] == 22 and all("-rows/" in f for f in found.dataframe.inputFiles())
    made.commit("indexed")
    again = qk.open(str(tmp_path / "d"), spark=spark)
    assert scanned(again.select("SELECT * WHERE k = 7"))[1] == 2
    # the copy is sorted, so that a file's statistics tell its rows apart
    import glob

    import pyarrow.parquet as pq

    copies = glob.glob(f"{tmp_path}/d/idx_*-rows/*/*.parquet")
    spans = [(r.column(0).statistics.min, r.column(0).statistics.max) for f in copies for r in [pq.ParquetFile(f).metadata.row_group(i) for i in range(pq.ParquetFile(f).metadata.num_row_groups)]]
    assert sum(b - a + 1 for a, b in spans) == 8000


def test_an_index_that_cannot_be_read_is_not_used(spark, tmp_path):
    import glob
    import shutil

    made = indexed(spark, tmp_path, False)
    for path in glob.glob(f"{tmp_path}/d/idx_*"):
        shutil.rmtree(path)
    assert scanned(made.select("SELECT * WHERE k = 6")) == (11, 2)


def test_batches_keep_names_and_types(spark):
    import decimal

    from quarrykit.streaming.batches import RecordBatchStream

    df = spark.sql("SELECT id AS a, id AS a, CAST(id AS decimal(20,3)) AS d, TIMESTAMP '2020-01-01 00:00:00' AS t, array(id, null) AS l FROM range(0, 20, 1, 3)")
    stream = RecordBatchStream(df)
    batches = stream.collect_all()
    assert [b.schema for b in batches] == [stream.schema] * len(batches) and sum(b.num_rows for b in batches) == 20
    assert batches[0].column(2)[0].as_py() == decimal.Decimal("0.000") and batches[0].schema.names == ["a", "a", "d", "t", "l"]


def test_storage_schemes():
    from quarrykit.sources import files

    assert files.real("s3://bucket/x") == "s3a://bucket/x" and files.real("gs://b/x") == "gs://b/x"
    files.use_account("")
    with pytest.raises(ValueError, match="account_name"):
        files.real("az://box/x")
    files.use_account("me")
    assert files.real("azure://box/x/y") == "abfss://box@me.dfs.core.windows.net/x/y"
    files.use_account("")


def test_the_prompt_completes():
    from quarrykit import commands

    class Held:
        dataframe = type("D", (), {"columns": ["amount", "name"]})()

        def views(self):
            return {"1": "all_rows"}

    assert commands.completions(Held(), "a") == ["AND", "AS", "ATTACH", "all_rows", "amount"] or "amount" in commands.completions(Held(), "a")
    assert commands.answer(Held(), "CLEAR").startswith("\033")
