import pytest
from pyspark.sql import types as T

from quarrykit.functions.types import SIMPLE, arrow_name, from_arrow_name, from_manifest, to_manifest


@pytest.mark.parametrize(
    ("name", "want"),
    [
        *SIMPLE.items(),
        ("Timestamp(Nanosecond, None)", T.TimestampNTZType()),
        ('Timestamp(Microsecond, Some("UTC"))', T.TimestampType()),
        ("Decimal128(10, 2)", T.DecimalType(10, 2)),
        ("List(Int64)", T.ArrayType(T.LongType())),
        ("FixedSizeList(Float32, 3)", T.ArrayType(T.FloatType())),
        ("Struct(a: Int32, b: List(Utf8))", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(T.StringType()))])),
        ("Duration(Second)", T.DayTimeIntervalType()),
        ("Interval(YearMonth)", T.YearMonthIntervalType()),
    ],
)
def test_names(name, want):
    assert from_arrow_name(name) == want


def test_what_does_not_fit():
    for name in ("Decimal256(60, 2)", "Union(a)", "Nothing"):
        with pytest.raises(ValueError):
            from_arrow_name(name)


def test_round_trip():
    schema = T.StructType([T.StructField(f"c{i}", k, i % 2 == 0, {"note": "x"}) for i, k in enumerate(set(SIMPLE.values()))])
    assert from_manifest(to_manifest(schema)) == schema
    for f in schema:
        assert from_arrow_name(arrow_name(f.dataType)) == f.dataType
