"""Document fingerprints by winnowing, in DataFrame functions only.

The k-grams are of characters: code points, A-Z in lower case and white space as spaces, none left out, so that a
place in the text is a place among the k-grams. A k-gram's hash rolls: each character's 64-bit hash enters by xor, all
move on by one bit, and the one k places back leaves. SQL functions carry no state along an array, so the hashes of 2k
characters come from those of k, which gives the same values. Of each window of w consecutive k-grams the one with the smallest hash is chosen, the rightmost of equal ones.
Any w + k - 1 characters that two texts share in the same order make them share a chosen hash, and no match shorter
than k is seen. Positions (of the k-gram's first character) are kept.

One number holds hash and position: 31 bits of the hash, then the position's complement in 32 bits, so that the smaller
number is the smaller hash and, of equal hashes, the position further right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, materialize, partitions

#: Bits of a position: a text of Spark has fewer characters.
PLACE = 32
LAST, HASH = (1 << PLACE) - 1, ((1 << 31) - 1) << PLACE
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# White space.
SPACES = "\t\n\x0b\x0c\r\x85\xa0"


def _doubled(df: DataFrame, array: str, size: int, step) -> tuple[DataFrame, str]:
    """What ``step(width)`` makes of each ``size`` consecutive elements, from halves a and b of ``width`` each. Near the
    end, where b lies beyond it, that is what it makes of a and null: to be cut off. size is a power of 2.

    Spark interprets all that stands inside zip_with, slices too. Named twice, the later elements stay a column of a
    projection of their own, which is compiled."""
    width, at = 1, array
    while width < size:
        later, to = f"{array}_later", f"{array}{2 * width}"
        df = df.withColumn(later, F.expr(f"slice(`{at}`, {width + 1}, greatest(size(`{at}`) - {width}, 0))"))
        df = df.withColumn(to, F.expr(f"if(size(`{later}`) < 0, `{later}`, zip_with(`{at}`, `{later}`, (a, b) -> {step(width)}))"))
        width, at = 2 * width, to
    return df, at


def winnow(df: DataFrame, text: str, out: str, k: int = 8, w: int = 8) -> DataFrame:
    """Adds ``out``: the chosen k-grams of a text, as array<long> of hash and position, ascending by position.

    k and w are powers of 2. Null and empty texts have none; a text of fewer than k characters is one k-gram; of
    fewer than w k-grams, one window. Texts of any length and script are read whole."""
    columns, chars = df.columns, f"__{out}_chars"
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + SPACES, LOWER + " " * len(SPACES))
    empty = F.array().cast("array<bigint>")
    df = df.select(*columns, F.when(flat == "", empty).otherwise(F.transform(F.split(flat, ""), lambda c: F.xxhash64(c))).alias(chars))
    df, hashed = _doubled(df, chars, k, lambda width: f"shiftleft(a, {width}) ^ b")
    grams = f"__{out}_grams"
    df = df.withColumn(grams, F.expr(f"transform(`{hashed}`, (h, i) -> (h & {HASH}L) | ({LAST}L - i))"))
    df, least = _doubled(df, grams, w, lambda width: "least(a, b)")
    n = F.size(chars)
    short = F.expr(f"array((aggregate(`{chars}`, 0L, (h, c) -> shiftleft(h, 1) ^ c) & {HASH}L) | {LAST}L)")
    windows = F.array_distinct(F.slice(F.col(least), F.lit(1), n - (k + w - 2)))
    chosen = F.when(n == 0, empty).when(n < k, short).when(n < k + w - 1, F.array(F.array_min(grams))).otherwise(windows)
    return df.select(*columns, chosen.alias(out))


def render(fingerprint: str, start: str | None = None) -> Column:
    """The fingerprint as text: hash@position of each chosen k-gram, positions counted from start (a column of longs)."""
    at = f"{LAST}L - (v & {LAST}L)" + (f" + {start}" if start else "")
    return F.expr(f"lower(array_join(transform({fingerprint}, v -> concat(hex(shiftright(v, {PLACE})), '@', {at})), ' '))")


def before(fingerprint: str, end: str, less: int = 0) -> str:
    """The chosen k-grams that begin at end - less (end: a column of longs) or before."""
    return f"filter({fingerprint}, v -> (v & {LAST}L) + {end} >= {LAST + less}L)"


def hashes(fingerprint: str) -> str:
    return f"transform({fingerprint}, v -> shiftright(v, {PLACE}))"


def likeness(a: str, b: str, both: Column) -> Column:
    """Jaccard similarity of two arrays of hashes, given both's different ones together; 1 if both are empty."""
    total = F.size(both)
    common = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - total
    return F.when(total == 0, F.lit(1.0)).otherwise(common.cast("double") / total)


#: A bucket of consecutive rows holds about so many bytes of text, and there are at most about so many buckets.
BUCKET, BUCKETS = 64 << 20, 1 << 20


def with_next(df: DataFrame, prepare) -> tuple[DataFrame, Window]:
    """df: doc_id, text. Deals the rows to buckets of consecutive rows (by doc_id, null first; of one doc_id by a hash
    of the text), each with a copy of the first row of the next bucket behind it (``__ghost``; of the first
    bucket's behind the last), and returns them with a window in which lead() gives each row's successor.
    ``prepare`` adds columns after the deal.

    Percentiles of doc_id are the buckets' first bounds; between two of them buckets are of even width, so many that
    each holds about BUCKET bytes whatever the size of the table. A doc_id, or none, that holds several percentiles
    is dealt by the hash. The driver gets the percentiles; buckets' first rows stay in a table, of at most
    about BUCKETS rows, that is broadcast."""
    wanted = min(1024, 4 * partitions(df.sparkSession))
    df = df.withColumn("__tie", F.shiftrightunsigned(F.xxhash64("text"), 11))
    stats = df.agg(
        F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 20 * wanted).alias("cut"),
        F.count("*").alias("n"),
        F.count("doc_id").alias("known"),
        F.min("doc_id").alias("low"),
        F.max("doc_id").alias("high"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
    ).first()
    cut = list(stats.cut or [])
    fine = -(-stats.bytes // max(BUCKET, stats.bytes // BUCKETS) // wanted) if stats.bytes > BUCKET * wanted else 1
    hot = {c for c in cut if cut.count(c) > 1} if len(cut) < 3000 else set()
    bounds = sorted({*cut, *(c + 1 for c in hot if c < (1 << 63) - 1)} - {stats.low})
    lows = [stats.low or 0, *bounds]
    spans = [max(b - a, 1) for a, b in zip(lows, [*bounds, (stats.high or 0) + 1], strict=True)]
    parts = [max(1, cut.count(low)) * fine if low in hot else fine for low in lows]
    nameless = max(1, -(-(stats.n - stats.known) * wanted * fine // max(1, stats.n)))
    starts = [nameless]
    for n in parts:
        starts.append(starts[-1] + n)
    slot = bucket_of(F.col("doc_id"), bounds)
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("__slot"))
    tie = F.col("__tie") / F.lit(float(1 << 53))
    share = F.when(at([low in hot for low in lows]), tie).otherwise((F.col("doc_id").cast("double") - at([float(x) for x in lows])) / at([float(x) for x in spans]))
    inside = lambda share, n: F.greatest(F.least(F.floor(share * n), n - 1), F.lit(0)).cast("long")
    bucket = F.when(F.col("doc_id").isNull(), inside(tie, F.lit(nameless))).otherwise(at(starts[:-1]) + inside(share, at(parts)))
    numbered = df.withColumn("__slot", slot).withColumn("__bucket", bucket.cast("long")).drop("__slot")
    first = numbered.groupBy("__bucket").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("__tie").alias("tie"))).alias("low"))
    first = materialize(first.select(F.col("__bucket").alias("b"), "low.id", "low.tie"), "firsts")
    whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each bucket
    first = first.select("*", F.coalesce(F.lag("b").over(Window.orderBy("b")), F.max("b").over(whole)).alias("before"))
    met = numbered.join(F.broadcast(first), F.expr("__bucket = b and coalesce(doc_id, 0) = id and __tie = tie"), "left")
    own, ghost = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.col("before").alias("b"), F.lit(1).alias("g"))
    spots = F.when(F.col("before").isNotNull(), F.array(own, ghost)).otherwise(F.array(own))
    dealt = met.select("doc_id", "text", "__tie", F.explode(spots).alias("__at")).select("doc_id", "text", "__tie", F.col("__at.b").alias("__bucket"), F.col("__at.g").alias("__ghost"))
    order = ["__ghost", "doc_id", "__tie", "text"]
    dealt = prepare(dealt.repartition(partitions(df.sparkSession), "__bucket").sortWithinPartitions("__bucket", *order))
    return dealt, Window.partitionBy("__bucket").orderBy(*order)


def edited_fingerprints(documents: DataFrame, k: int = 8, w: int = 8) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last floor(n/2) code points replaced by the
    first as many (or all) of the next document's, by ascending doc_id; the first follows the last.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are
    empty. Rows without doc_id come first; rows with equal doc_ids are ordered by a hash of the text. Texts of any
    length are read whole. Other columns are ignored, whatever their names. An empty table gives no rows.

    A choice depends on the windows around it alone, so the edited text's choices are those of the two texts, but for
    those near the cut and near the end, which are made anew from a few characters there; where either part is
    that short, all are made anew. Choices ascend by position, so those that stay are slices, and the kept part's text is
    the first part of the own fingerprint's."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, window = with_next(docs, lambda df: winnow(df, "text", "chosen", k, w))
    follow = lambda c, name: F.lead(c).over(window).alias(name)
    rows = rows.select("doc_id", "text", "chosen", "__ghost", follow("text", "next"), follow("chosen", "next_chosen")).where("__ghost = 0")
    n, whole = F.length("text").cast("long"), lambda value: F.expr(f"int({value})")
    rows = rows.select("doc_id", n.alias("n_chars"), "text", "next", "chosen", "next_chosen", F.expr("length(text) - length(text) div 2").alias("p"))
    rows = rows.withColumn("q", F.least(F.col("n_chars") - F.col("p"), F.length("next").cast("long")))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), whole("p")), F.substring("next", F.lit(1), whole("q")))).drop("text", "next")
    anew, near = (F.least("p", "q") < k + 2 * w), k + 2 * w - 3
    rows = rows.withColumns(
        {
            "anew": anew,
            "middle": F.when(anew, F.col("edited")).otherwise(F.substring("edited", whole(f"p - {near - 1}"), F.lit(near + 2 * w + k - 3))),
            "tail": F.when(~anew, F.substring("edited", whole(f"p + q - {near - 1}"), F.lit(near))),
        }
    )
    rows = winnow(winnow(rows, "middle", "in_middle", k, w), "tail", "in_tail", k, w)
    # the edited text's choices: kept of the own, middle, those of the next after the first skipped up to taken, tail
    rows = rows.selectExpr(
        "doc_id",
        "n_chars",
        "edited",
        "chosen",
        "next_chosen",
        "p",
        f"if(anew, 0L, p - {near}) AS middle_at",
        f"p + q - {near} AS tail_at",
        f"if(anew, 0, size({before('chosen', 'p', k + w - 1)})) AS kept",
        f"if(anew, 0, size(filter(slice(next_chosen, 1, {w}), v -> (v & {LAST}L) > {LAST - w + 1}L))) AS skipped",
        f"if(anew, 0, size({before('next_chosen', 'q', k + w - 1)})) AS taken",
        f"if(anew, in_middle, filter(in_middle, v -> {LAST}L - (v & {LAST}L) BETWEEN {near - k - w + 2} AND {near + w - 2})) AS middle",
        f"filter(in_tail, v -> {LAST}L - (v & {LAST}L) BETWEEN {near - k - w + 2} AND {near - k}) AS tail",
    )
    rows = rows.selectExpr("*", "slice(next_chosen, skipped + 1, greatest(taken - skipped, 0)) AS moved")
    rows = rows.select(
        "*", render("chosen").alias("fingerprint"), *(F.expr(hashes(c)).alias(f"__{c}") for c in ("chosen", "next_chosen", "middle", "tail"))
    )
    rows = rows.selectExpr("*", "concat(__middle, slice(__next_chosen, skipped + 1, greatest(taken - skipped, 0)), __tail) AS __others")
    rows = rows.selectExpr("*", "concat(slice(__chosen, 1, kept), __others) AS __edited")
    parts = (
        F.when(F.col("kept") > 0, F.expr("substring_index(fingerprint, ' ', kept)")),
        *(F.when(F.size(c) > 0, render(c, start)) for c, start in (("middle", "middle_at"), ("moved", "p"), ("tail", "tail_at"))),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        F.concat_ws(" ", *parts).alias("edited_fingerprint"),
        likeness("__chosen", "__edited", F.array_union("__chosen", "__others")).alias("near_edited"),
        likeness("__chosen", "__next_chosen", F.array_union("__chosen", "__next_chosen")).alias("near_next"),
    )
