"""Document fingerprints: a homomorphic multiset hash of paragraphs, in SQL expressions only.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed to a
wide vector, and the vectors are summed modulo 2**62.  So the fingerprint does not
depend on the order of the paragraphs, and paragraphs can be inserted (`added`) or
deleted (`removed`) without the rest of the text.  A paragraph's vector has three
parts: how many pieces it has (runs of WORDS words; a word is cut after 48
characters); of its pieces the sum of 126 entries of 0 or 1, three to a number,
half of them from each of two independent hashes; and SUMS numbers of 62 bits, each
from a hash of the whole paragraph with a seed of its own.

The likeness of two fingerprints is the cosine of their entries, read as -1 and 1:
the pieces' hashes are independent, so its expectation is the cosine of the two
multisets of pieces.  It is 1 for equal fingerprints, and not below 0.  An entry has
21 bits, of which a carry into the next is possible from 2**21 pieces on: texts of
more than a million pieces (some 25 MB) keep exact equality, insertion and deletion,
all of them modulo 2**62, but their likeness to different texts means nothing.

Null and empty texts have no pieces: the zero fingerprint, like 1 to itself and
0 to any other.  A null id counts as the smallest; rows of one id follow each
other by text.  Ids are numbers of 64
bits or their decimal text; other text ends the job with an error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.shared import partitions

WORDS = 4
_PIECE = rf"[^\\n ]{{1,48}}(?: +[^\\n ]{{1,48}}){{0,{WORDS - 1}}} *\\n?|[ \\n]+"
_PARAGRAPH = r"[^\\n]+\\n?|\\n"
_TOP, _MASK, _LANES, SUMS = (1 << 62) - 1, 1 | 1 << 21 | 1 << 42, 21, 4


def fingerprint(text: str) -> str:
    """SQL for the fingerprint (array of 1 + 42 + SUMS longs) of the column or expression `text`."""
    sums = f"transform(sequence(0, {_LANES - 1}), j -> aggregate(u, 0L, (a, h) -> (a & {_TOP}L) + (shiftrightunsigned(h, j) & {_MASK}L)) & {_TOP}L)"
    pieces = f"regexp_extract_all(coalesce({text}, ''), '{_PIECE}', 0)"
    entries = f"flatten(transform(array(transform(v, p -> xxhash64(p)), transform(v, p -> xxhash64(1, p))), u -> {sums}))"
    whole = f"transform(array({', '.join(f'{k}' for k in range(2, 2 + SUMS))}), k -> aggregate(q, 0L, (a, p) -> (a + (xxhash64(k, p) & {_TOP}L)) & {_TOP}L))"
    paragraphs = f"transform(array(regexp_extract_all(coalesce({text}, ''), '{_PARAGRAPH}', 0)), q -> {whole})[0]"
    return f"concat(transform(array({pieces}), v -> concat(array(cast(size(v) as bigint)), {entries}))[0], {paragraphs})"


def added(a: str, b: str) -> str:
    """SQL for the fingerprint of both texts' pieces together."""
    return f"zip_with({a}, {b}, (x, y) -> (x + y) & {_TOP}L)"


def removed(a: str, b: str) -> str:
    """SQL for the fingerprint of a without the pieces of b."""
    return f"zip_with({a}, {b}, (x, y) -> (x - y) & {_TOP}L)"


def printed(a: str) -> str:
    return f"array_join(transform({a}, x -> lpad(hex(x), 16, '0')), '')"


def _entries(a: str) -> str:
    """2 * sum - pieces of each entry, read as the number next to 0 that is equal modulo 2**20."""
    value = "cast(pmod(2 * (shiftrightunsigned(x, k) & 1048575L) - f[0] + 524288L, 1048576L) - 524288L as double)"
    return f"transform(array({a}), f -> flatten(transform(slice(f, 2, {2 * _LANES}), x -> transform(array(0, 21, 42), k -> {value}))))[0]"


def likenesses(a: str, others: dict[str, str]) -> str:
    """SQL for a struct of the likeness of fingerprint a to each of the others."""
    def dot(x: str, y: str) -> str:
        return f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, p) -> s + p)"

    bound = ", ".join(f"{_entries(b)} as {name}" for name, b in others.items())
    cos = ", ".join(f"named_struct('v', {dot('s.own', f's.{name}')}, 'm', sqrt({dot('s.own', 's.own')} * {dot(f's.{name}', f's.{name}')})) as {name}" for name in others)
    value = ", ".join(f"case when {a} = {b} then 1D when {a}[0] = 0 or {b}[0] = 0 or c.{name}.m = 0 then 0D else greatest(0D, least(1D, c.{name}.v / c.{name}.m)) end as {name}" for name, b in others.items())
    return f"transform(transform(array(struct({_entries(a)} as own, {bound})), s -> struct({cos})), c -> struct({value}))[0]"


def _blocks(keys: DataFrame, blocks: int) -> tuple[list[int], float, float]:
    """Ids that end the blocks (each the largest of its block), and the grid's origin and step."""
    row = keys.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks + 1)], 20 * blocks).alias("at"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if row["hi"] is None:
        return [], 0.0, 1.0
    ends = sorted({*row["at"], row["hi"]})
    step = (float(row["hi"]) - float(row["lo"])) / (4 * len(ends))
    return ends, float(row["lo"]), step if step > 0 else 1.0


def with_next(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, text, fp, next_text, next_fp): next is the following document by descending id; after the last comes the first.

    Texts are dealt to blocks of neighbouring ids once.  The largest id of a block also goes to the block above it,
    where it follows the last document; the largest of all goes to the lowest block.
    """
    spark = docs.sparkSession
    given = docs.select(docs[id].cast("long").alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).withColumn("key", F.expr("coalesce(id, -9223372036854775808L)"))
    ends, lo, step = _blocks(given.select("key"), 4 * partitions(spark))
    cells = 4 * max(1, len(ends)) + 1
    grid: list[list[int]] = [[] for _ in range(cells)]
    for e in ends:
        grid[min(cells - 1, math.floor((float(e) - lo) / step))].append(e)
    rows, before = [], 0
    for c, inside in enumerate(grid):
        rows.append((c, before, inside))
        before += len(inside)
    table = F.broadcast(spark.createDataFrame(rows, "cell long, before int, inside array<bigint>"))  # four rows for each block
    cell = F.least(F.lit(cells - 1).cast("long"), F.floor((F.col("key").cast("double") - F.lit(lo)) / F.lit(step)))
    own = given.withColumn("cell", cell).join(table, "cell").withColumn("block", F.expr("before + size(filter(inside, e -> e < key))"))
    also = F.when(F.expr("array_contains(inside, key)"), F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("ghost")), F.struct(F.pmod(F.col("block") + 1, F.lit(max(1, len(ends)))).alias("block"), F.lit(1).alias("ghost"))))
    sent = own.withColumn("to", F.coalesce(also, F.array(F.struct(F.col("block").alias("block"), F.lit(0).alias("ghost")))))
    sent = sent.select("id", "key", "text", F.expr(fingerprint("text")).alias("fp"), "to").select("id", "key", "text", "fp", F.inline("to"))
    order = Window.partitionBy("block").orderBy("ghost", F.desc("key"), "text")
    follow = sent.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
    return follow.where("ghost = 0").select("id", "text", "fp", "next_text", "next_fp")


def edited(text: str, following: str) -> str:
    """SQL for text with its last half replaced by as many first characters (or all) of the following text."""
    return f"concat(left({text}, cast(char_length({text}) - char_length({text}) div 2 as int)), left({following}, cast(char_length({text}) div 2 as int)))"
