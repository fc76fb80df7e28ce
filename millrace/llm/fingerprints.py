"""Homomorphic multiset fingerprints of documents, in SQL functions only.

A paragraph (a line) hashes to a wide vector; a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo a power of two.  So the
order of paragraphs doesn't matter, equal multisets have equal fingerprints,
and paragraphs go in or out by adding or subtracting their vectors
(`insert`, `delete`) without the rest of the text.

The vector has a dense part, 8 lanes of 32 bits that every paragraph changes:
it decides equality.  The other part is sparse, lanes of 14 bits of which each
clause of a paragraph changes one: 64 lanes for all clauses, 32 for one in 8 of
them, 32 for one in 64, chosen by hash.  Two fingerprints are alike as far
as their lanes in use agree (`likeness`), on the finest of the three levels
that isn't full.

The text form of a fingerprint is the hexadecimal digits of its lanes.

Defined results: null text is an empty one, whose fingerprint is all zeros;
an empty table gives no rows; repeated rows and doc_ids stay separate, ordered
by the text's hash, then by text; a null doc_id comes first; the only row's next document is itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DENSE = 8
#: Sparse levels: lanes, and one clause in how many.
LEVELS = ((64, 1), (32, 8), (32, 64))
#: A level is full when more than this share of its lanes is in use.
FULL = 0.75

_WORD, _LANE = 0xFFFFFFFF, 0x3FFF
#: Sparse lanes lie four to a number, 16 bits apart, so that a sum never carries into the next.
_LANES_EACH = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraphs(text: Column) -> Column:
    """The non-empty lines of a text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "")


def clauses(lines: Column) -> Column:
    """The clauses of lines: they end at a mark before spaces; a line without any has words."""

    def parts(line: Column) -> Column:
        cut = F.split(line, r"(?<=[^\p{L}\p{N}\s]) +")
        return _let(cut, lambda c: F.when(F.size(c) > 1, c).otherwise(F.split(line, " ")))

    return F.filter(F.flatten(F.transform(lines, parts)), lambda s: s != "")


def _dense(lines: Column) -> Column:
    # two lanes come from each of four differently seeded hashes
    def hashed(line: Column) -> Column:
        four = [F.xxhash64(line, F.lit(f"dense {k}")) for k in range(DENSE // 2)]
        return F.array(*[h.bitwiseAND(F.lit(_WORD)) for h in four], *[F.shiftrightunsigned(h, 32) for h in four])

    zero = F.array_repeat(F.lit(0).cast("long"), DENSE)
    return F.aggregate(
        F.transform(lines, hashed), zero, lambda acc, x: F.zip_with(acc, x, lambda a, b: (a + b).bitwiseAND(F.lit(_WORD)))
    )


def _spot(lanes: int, bit: int) -> Callable[[Column], Column]:
    """Of a clause's hash: its number among the lanes', and what to add under which mask."""

    def spot(h: Column) -> Column:
        lane = F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(lanes - 1))
        value = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(_LANE))
        own = lane.bitwiseAND(F.lit(_LANES_EACH - 1))
        places = [F.lit(1 << 16 * k).cast("long") for k in range(_LANES_EACH)]
        unit = F.element_at(F.array(*places), (own + 1).cast("int"))
        return F.struct(
            F.shiftright(lane, 2).cast("int").alias("number"), (value * unit).alias("add"), (F.lit(_LANE) * unit).alias("mask")
        )

    return spot


def _sparse(drawn: Column, level: int) -> Column:
    n, share = LEVELS[level]
    chosen = drawn if share == 1 else F.filter(drawn, lambda h: h.bitwiseAND(F.lit(share - 1)) == 0)
    zero = F.array_repeat(F.lit(0).cast("long"), n // _LANES_EACH)

    def put(acc: Column, x: Column) -> Column:
        def lane(v: Column, i: Column) -> Column:
            inside = (v.bitwiseAND(x["mask"]) + x["add"]).bitwiseAND(x["mask"])
            return F.when(i == x["number"], v.bitwiseAND(F.bitwise_not(x["mask"])).bitwiseOR(inside)).otherwise(v)

        return F.transform(acc, lane)

    return F.aggregate(F.transform(chosen, _spot(n, 8 + 6 * level)), zero, put)


def lanes(text: Column) -> Column:
    """The fingerprint as an array of numbers: dense lanes, then the sparse levels, four lanes a number."""

    def of_lines(lines: Column) -> Column:
        drawn = F.transform(clauses(lines), lambda s: F.xxhash64(s, F.lit("sparse")))
        return _let(drawn, lambda d: F.concat(_dense(lines), *[_sparse(d, k) for k in range(len(LEVELS))]))

    return _let(paragraphs(text), of_lines)


def text_form(numbers: Column) -> Column:
    """Lanes as hexadecimal digits: 8 for a dense lane, 16 for four sparse ones."""
    digits = F.transform(numbers, lambda v, i: F.lpad(F.hex(v), F.when(i < DENSE, 8).otherwise(16), F.lit("0")))
    return F.lower(F.array_join(digits, ""))


def number_form(text: Column) -> Column:
    """The inverse of `text_form`."""
    n = DENSE + sum(k for k, _ in LEVELS) // _LANES_EACH

    def lane(i: Column) -> Column:
        at = F.when(i < DENSE, i * 8 + 1).otherwise(DENSE * 8 + (i - DENSE) * 16 + 1)
        return F.conv(F.substring(text, at, F.when(i < DENSE, 8).otherwise(16)), 16, 10).cast("long")

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lane)


_ALL_LANES = sum(_LANE << 16 * k for k in range(_LANES_EACH))


def _modulo(i: Column) -> Column:
    return F.when(i < DENSE, F.lit(_WORD)).otherwise(F.lit(_ALL_LANES)).cast("long")


def insert(fingerprint: Column, text: Column) -> Column:
    """Lanes of a document after the paragraphs of `text` have come in."""
    added = F.zip_with(fingerprint, lanes(text), lambda a, b: a + b)
    return F.transform(added, lambda v, i: v.bitwiseAND(_modulo(i)))


def delete(fingerprint: Column, text: Column) -> Column:
    """Lanes of a document after the paragraphs of `text` have gone out."""
    # a bit above each lane is lent before the difference, so that lanes don't borrow from each other
    lent = F.transform(fingerprint, lambda v, i: v + _modulo(i) + F.when(i < DENSE, 1).otherwise(F.lit(sum(1 << 16 * k for k in range(_LANES_EACH)))).cast("long"))
    taken = F.zip_with(lent, lanes(text), lambda a, b: a - b)
    return F.transform(taken, lambda v, i: v.bitwiseAND(_modulo(i)))


def likeness(one: Column, other: Column) -> Column:
    """How alike two fingerprints (arrays of numbers) are, 0 to 1; 1 for equal ones."""
    estimate, at = None, DENSE + 1
    levels = []

    def counted(acc: Column, p: Column) -> Column:
        used, same = acc["used"], acc["same"]
        for k in range(_LANES_EACH):
            mask = F.lit(_LANE << 16 * k)
            a, b = p["a"].bitwiseAND(mask), p["b"].bitwiseAND(mask)
            some = (a != 0) | (b != 0)
            used = used + some.cast("int")
            same = same + (some & (a == b)).cast("int")
        return F.struct(used.alias("used"), same.alias("same"))

    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("same"))
    for n, _ in LEVELS:
        size = n // _LANES_EACH
        pairs = F.zip_with(F.slice(one, at, size), F.slice(other, at, size), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        levels.append((n, F.aggregate(pairs, zero, counted)))
        at += size
    # from the coarsest level to the finest that isn't full
    for n, level in reversed(levels):
        share = _let(level, lambda x: F.when(x["used"] > 0, x["same"] / x["used"]).otherwise(F.lit(0.0)))
        estimate = share if estimate is None else F.when(level["used"] <= FULL * n, share).otherwise(estimate)
    return F.when(one == other, F.lit(1.0)).otherwise(estimate)


def _ranges(rows: DataFrame, range_chars: int) -> tuple[Column, Column]:
    """(range, part) of each row by its key `_k` and hash `_h`: in order, and about as many as there is text.

    Ranges lie between approximate quantiles of the key, at least 512 of them.
    A key on which several quantiles fall has parts of its own by the hash.
    """
    # 1 in 10,000 quantiles is the sketch's own error
    total = rows.agg(F.sum(F.col("_chars")).alias("chars")).first().chars or 0
    many = min(max(512, total // range_chars), 100_000)
    points = [i / many for i in range(1, many)]
    cuts = rows.agg(F.percentile_approx("_k", points, 20 * many).alias("cuts")).first().cuts or []
    times = Counter(cuts)
    bounds = sorted(times)
    if not bounds:
        return F.lit(0), F.lit(0)
    # two steps, so that a row is compared with about twice the root of the number of bounds
    wide = int(len(bounds) ** 0.5) + 1
    chunks = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    first = F.lit([c[0] for c in chunks]).cast("array<long>")
    second = F.from_json(F.lit(str(chunks)), "array<array<bigint>>")
    outer = F.size(F.filter(first, lambda c: c <= F.col("_k")))
    inner = F.size(F.filter(F.element_at(second, outer), lambda c: c <= F.col("_k")))
    at = F.when(outer == 0, 0).otherwise((outer - 1) * wide + inner)
    hot = {k: n for k, n in times.items() if n > 1}
    if not hot:
        return at, F.lit(0)
    share = F.map_from_arrays(F.lit(list(hot)).cast("array<long>"), F.lit(list(hot.values())).cast("array<int>"))[F.col("_k")]
    # the key that begins the range comes first, in parts by its hash; the others of the range after them
    part = F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * share).cast("int")
    return at, F.coalesce(F.least(part, share - 1), F.lit(1 << 30))


def with_next(docs: DataFrame, key: str, text: str, more: Callable[[DataFrame], DataFrame], carried: list[str], range_chars: int = 16_000_000) -> DataFrame:
    """Adds `next_<column>` of the row that follows by key (then the text's hash, then the text); the first follows the last.

    Rows are dealt into ranges, in number as there is text.  Into each range
    also goes a copy of the first row of the range that follows, so one window
    in each range sees every row's successor, and one shuffle is all.  First
    rows are found by key and hash; `more` adds columns after that.
    """
    spark = docs.sparkSession
    least = F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("long"))
    rows = docs.withColumn("_k", least).withColumn("_h", F.xxhash64(text)).withColumn("_chars", F.length(text))
    at, part = _ranges(rows, range_chars)
    rows = rows.drop("_chars").withColumn("_b", at.cast("int")).withColumn("_p", part.cast("int"))
    # a row a range on the driver: where it begins
    firsts = rows.groupBy("_b", "_p").agg(F.min(F.struct("_k", "_h")).alias("m")).select("_b", "_p", "m._k", "m._h").collect()
    firsts = sorted((r["_b"], r["_p"], r["_k"], r["_h"]) for r in firsts)
    before = [(k, h, *firsts[i - 1][:2]) for i, (_, _, k, h) in enumerate(firsts)]  # the first range precedes nothing but the last
    owners = F.broadcast(spark.createDataFrame(before, "_k long, _h long, _to int, _to_p int"))
    heads = rows.drop("_b", "_p").join(owners, ["_k", "_h"]).groupBy("_to", "_to_p", "_k", "_h")
    heads = heads.agg(F.min(F.struct(*docs.columns)).alias("row")).select(
        "row.*", "_k", "_h", F.col("_to").alias("_b"), F.col("_to_p").alias("_p"), F.lit(1).alias("_copy")
    )
    both = more(rows.withColumn("_copy", F.lit(0)).unionByName(heads))
    along = Window.partitionBy("_b", "_p").orderBy("_copy", "_k", "_h", F.asc_nulls_first(text))
    out = both.select("*", *[F.lead(c).over(along).alias(f"next_{c}") for c in carried])
    return out.where("_copy = 0").drop("_k", "_h", "_b", "_p", "_copy")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    chained = with_next(base, "doc_id", "text", lambda rows: rows.withColumn("own", lanes(F.col("text"))), ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    cut = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    edited = chained.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", cut.alias("edited"))
    done = edited.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next_own",
        lanes(F.col("edited")).alias("after"),
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256", text_form(F.col("own")).alias("fingerprint"),
        text_form(F.col("after")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("after")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
