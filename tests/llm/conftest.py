import random

import pytest
from pyspark.sql import types as T

#: What operators have columns of their own for.
CLASHING = ["digest", "sigs", "sig", "need", "rep", "copies", "cluster", "block", "shared", "chosen", "next", "edited", "bucket", "b", "g", "n", "a", "id", "root", "p", "w", "m", "piece", "length", "shard", "open", "sequence_id", "offset", "held_out", "lang_pred", "score", "component_id", "file", "ordinal", "start", "host", "path", "rule", "part", "first", "own_id", "kind", "item_id", "distance", "end"]


@pytest.fixture(scope="session")
def frame(spark):
    """A table from rows, with columns that no operator knows behind them."""

    def make(schema: str, rows: list[tuple]):
        kinds = T._parse_datatype_string(schema)
        extra = [c for c in CLASHING if c not in kinds.names]
        full = T.StructType([*kinds, *(T.StructField(c, T.StringType()) for c in extra)])
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], full).repartition(3)

    return make


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_documents():
    """Nulls, blanks, ties, copies, near copies, repeated rows and a long text: (doc_id, text)."""
    rng = random.Random(5)
    rows = [(None, None), (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "a b c d e"), (6, "A  b\tc\nd e"), (7, "!!! 12 ..."), (8, "日本語の文章です"), (9, "x" * 3000)]
    for base in range(6):
        text = words(rng, 60 * (base + 1))
        for copy in range(5):
            own = list(text)
            for _ in range(copy * (base % 3)):
                own[rng.randrange(len(own))] = f"n{rng.random()}"
            rows.append((100 + 10 * base + copy, " ".join(own)))
    for i in range(20):
        rows.append((200 + i, " ".join(words(rng, rng.randrange(1, 30)))))
    line = words(rng, 30)
    for i in range(15):
        rows.append((300 + i, " ".join(words(rng, 20, 10**6) + line + words(rng, 40, 10**6))))
    long = " ".join(words(rng, 60_000, 10**6))
    rows += [(400, long), (401, long + " more"), (5, "a b c d e"), (110, rows[16][1])]
    rows += [(500, rows[20][1]), (501, rows[20][1])]
    return rows
