import pytest

from quarrykit.plans.sqltext import SqlError, bind, check_parameters, complete, translate, union_by_name


def test_parameters_are_bound_by_number():
    names = [f"${i}" for i in range(1, 12)]
    text, values = bind(f"a IN ({', '.join(names)}) AND b = '$1'", list(range(11)))
    assert ":p11" in text and "'$1'" in text and values["p11"] == 10 and values["p1"] == 0
    with pytest.raises(SqlError):
        bind("a = $2", [1])


def test_parameter_types():
    assert check_parameters([True, 1, 1.5, "x", None]) == [True, 1, 1.5, "x", None]
    with pytest.raises(TypeError):
        check_parameters([[1]])


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("* where x > 1", "SELECT * FROM bundle where x > 1"),
        ("a, b", "SELECT a, b FROM bundle"),
        ("select\na from t", "select\na from t"),
        ("SELECT 1 AS one", "SELECT 1 AS one"),
        ("WITH t AS (SELECT 1) SELECT * FROM t", "WITH t AS (SELECT 1) SELECT * FROM t"),
        ("select count(*) as n where a = 'from'", "select count(*) as n FROM bundle where a = 'from'"),
    ],
)
def test_completion(given, want):
    assert complete(given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("SELECT 'strpos(a, b)' FROM t", "SELECT 'strpos(a, b)' FROM t"),
        ("SELECT strpos(a, 'x') FROM t", "SELECT locate('x', a) FROM t"),
        ("SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a NULLS LAST"),
        ("SELECT a FROM t ORDER BY a DESC, b NULLS FIRST LIMIT 1", "SELECT a FROM t ORDER BY a DESC NULLS FIRST, b NULLS FIRST LIMIT 1"),
        ("SELECT rank() OVER (ORDER BY a) FROM t", "SELECT rank() OVER (ORDER BY a NULLS LAST) FROM t"),
        ("SELECT * EXCLUDE (a) FROM t", "SELECT * EXCEPT (a) FROM t"),
        ("SELECT [1, 2], x[1] FROM t", "SELECT array(1, 2), x[1] FROM t"),
        ("SELECT * FROM packs.__pack_a", "SELECT * FROM __pack_a"),
    ],
)
def test_spellings(given, want):
    assert " ".join(translate(given).split()) == want


def test_groups_frames_are_refused():
    for sql in ("SELECT sum(a) OVER (ORDER BY b GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t JOIN u USING (b)", "SELECT sum(a) OVER (GROUPS CURRENT ROW) FROM t"):
        with pytest.raises(SqlError, match="GROUPS"):
            translate(sql)


def test_union_by_name_parts():
    assert union_by_name("SELECT a FROM t UNION ALL BY NAME SELECT b FROM u") == [("SELECT a FROM t", True), ("SELECT b FROM u", True)]
    assert union_by_name("SELECT a FROM t UNION SELECT b FROM u") is None
