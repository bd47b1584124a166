"""Op 6: near-duplicate lines by an exact set-similarity join, with DataFrame and SQL functions only.

A line is the set of its lower-case words (separated by blanks, tabs and the like). A line of at least MIN_WORDS different
words is removed if an earlier line (by doc_id, then place; of any document) has a Jaccard similarity of at least 0.8 with
it. Earlier lines count whether they are removed themselves or not, so what is removed doesn't depend on the order of the
work. Shorter lines stay, repeated ones too: MIN_WORDS says from which size on a line is a passage and not a label.

* Texts are cut into words once; a table of sets (31-bit tokens of the words' hashes, one for each different word) follows.
  Two words of a line with the same token stay two entries, so overlaps of tokens are never less than those of words.
* Tokens are ordered by rarity: counts of 2 ** BUCKET_BITS buckets over all lines, as classes on a logarithmic scale. Any
  such order is right, and finds the same lines; the counts make it a good one.
* Lines with equal sets are put together first; all but the earliest go, and only one of each enters the join.
* Of more than PIVOTS lines that agree in two of their lowest, or highest, tokens, each is compared with some only (the earliest
  and those with most copies). Most of a large group of near copies goes here, in linear time; what is gone needs no other earlier line.
* Prefix filter for the rest, against all earlier lines: lines as similar as this share one of their n - ceil(0.8 n) + 1
  rarest tokens, and two of one more. So a rare token is a key alone, and a crowded one (of a bucket with more than CROWD
  words) only together with another token after it: if the rarest common token is crowded, the next one is as well. Lines of
  more than LONG words, whose pairs would be many, have crowded tokens as keys alone, among lines as long only.
* The join on the keys applies the length and the positional filter, and a bound from parity maps of 64 bits (128 for two lines
  of more than WIDE words): every word that only one of two lines has turns one bit, so the maps' differing bits are at most
  the words not shared.
* What remains is verified on the lines' words themselves.

Null and empty texts have no line that could go. Rows with the same id but different texts are documents of their own,
ordered by a hash of the text; wholly equal rows are one document here and lose the same lines. A null id comes last. A
column n_removed of the input is replaced; other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.llm.common import drop_written, fresh, release, written

MIN_WORDS = 5
#: Buckets of tokens whose words are counted (2 ** BUCKET_BITS numbers come to the driver, whatever the input).
BUCKET_BITS, TOKEN_BITS = 18, 31
#: All lines are counted. With a number here, tables of more lines than twice that have an even share of their sets (by hash) counted.
COUNTED: int | None = None
#: A bucket with more words than this, and than four times the median bucket, is crowded. Pairs of tokens cost some six more
#: keys a token, which take as long as comparing some thousand lines.
CROWD = 1500
LONG = 200
#: Lines of more words have a second map of the words whose tokens have bit 6; what it leaves of the first is that of the others.
WIDE = 64
#: Lines that those with the same lowest or highest tokens are compared with first.
PIVOTS = 8
#: A side of at most so many rows (and array entries) is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS, BROADCAST_ENTRIES = 400_000, 2_000_000

_D, _V = "coalesce(doc_id, 9223372036854775807L)", "cast(hash(text) as bigint)"
_BLANKS = "\t\x0b\x0c\r"


def _lines(docs: DataFrame) -> DataFrame:
    """d, vl (hash of the text and place of the line: the order of a document's lines), words: the line in lower case."""
    other = functools.reduce(Column.__or__, [F.contains("text", F.lit(b)) for b in _BLANKS])
    text = F.when(other, F.translate("text", _BLANKS, " " * len(_BLANKS))).otherwise(F.col("text"))
    # the hash before the lines, not anew for each of them
    keyed = docs.where("text is not null").select(F.expr(_D).alias("d"), F.expr(_V).alias("v"), text.alias("text"))
    split = keyed.select("d", "v", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    return split.selectExpr("d", "(v * 4294967296L) + line as vl", "lower(words) as words")


def _sets(docs: DataFrame) -> DataFrame:
    """d, vl, s and s2 (hashes of the set), n and t (a token for each different word) of every line."""
    hashed = _lines(docs).selectExpr("d", "vl", "sort_array(array_remove(array_distinct(transform(split(words, ' '), w -> xxhash64(w))), xxhash64(''))) as h")
    return hashed.selectExpr("d", "vl", "xxhash64(h) as s", "hash(h) as s2", "size(h) as n", f"transform(h, x -> cast(x & {(1 << TOKEN_BITS) - 1}L as int)) as t")


def _classes(sets: DataFrame) -> tuple[str, int]:
    """SQL of an array with the rarity class of each bucket of tokens, rarest first; the first class that is crowded."""
    size = 1 << BUCKET_BITS
    share = max(1, sets.count() // COUNTED) if COUNTED else 1
    counted = sets.where(F.pmod("s", F.lit(share)) == 0) if share > 1 else sets
    found = counted.select(F.explode("t").alias("x")).groupBy(F.shiftright("x", TOKEN_BITS - BUCKET_BITS).alias("b")).count()
    # 512 rows of one text each: as a row for each bucket they take much of the driver's memory
    rows = found.groupBy(F.shiftright("b", BUCKET_BITS - 9).alias("k")).agg(F.concat_ws(" ", F.collect_list(F.concat_ws(":", "b", "count"))).alias("counts")).collect()
    count = [0] * size
    for r in rows:
        for x in r["counts"].split():
            b, n = x.split(":")
            count[int(b)] = share * int(n)
    median = sorted(count)[size // 2]

    def of(n: int) -> int:
        return round(4 * math.log2(1 + n))

    return f"cast(split('{','.join(str(of(n)) for n in count)}', ',') as array<bigint>)", of(max(CROWD, 4 * median)) + 1


# ceil(0.8 n): what a line must share at 0.8. A pair must share 4 / 9 of a.n + b.n; as these numbers are whole, and the maps'
# differing bits are odd if a.n + b.n is, the conditions need no division
_OWN_NEED = "((4 * {n} + 4) div 5)"
_EARLIER = "(b.d < a.d or (b.d = a.d and b.vl < a.vl))"
_SIZES = "5 * {a} >= 4 * {b} and 5 * {b} >= 4 * {a}"
_FAR = "if(a.w is null or b.w is null, bit_count(a.m ^ b.m), bit_count(a.m ^ a.w ^ b.m ^ b.w) + bit_count(a.w ^ b.w))"
_MAPS = f"9 * {_FAR} <= {{a}} + {{b}}"
_PAIR = ("a.d as d", "a.vl as vl", "b.d as d2", "b.vl as vl2")


def _own(sets: DataFrame, classes: str) -> DataFrame:
    """The earliest line of each set: s, s2, d, vl, n, c (lines), m and w (parity maps), ends (hashes of the two lowest tokens, the two after, and likewise from above), p: the rarest tokens, class first."""
    earliest = sets.selectExpr("s", "s2", "n", "struct(d, vl, t) as f").groupBy("s", "s2", "n").agg(F.min("f").alias("f"), F.count("*").alias("c")).select("s", "s2", "n", "c", "f.*")
    # by its schema a file's column may hold null; without that, Spark sorts plain numbers
    order = f"sort_array(transform(t, x -> coalesce(shiftleft({classes}[shiftright(x, {TOKEN_BITS - BUCKET_BITS})], {TOKEN_BITS}) | x, 0L)))"
    return earliest.selectExpr(
        *("s", "s2", "d", "vl", "n", "c"),
        "aggregate(t, 0L, (a, x) -> a ^ shiftleft(1L, x)) as m",
        f"if(n > {WIDE}, aggregate(t, 0L, (a, x) -> if((x & 64) = 0, a, a ^ shiftleft(1L, x))), null) as w",
        "array(xxhash64(slice(t, 1, 2)), xxhash64(slice(t, 3, 2), 1), xxhash64(slice(t, -2, 2), 2), xxhash64(slice(t, -4, 2), 3)) as ends",
        f"slice({order}, 1, n - {_OWN_NEED.format(n='n')} + 2) as p",
    )


def _copies(sets: DataFrame, own: DataFrame) -> DataFrame:
    """d, vl of all lines but the earliest of each set."""
    many = own.where("c > 1").selectExpr("s", "s2", "n", "d as d2", "vl as vl2")
    lines = sets.select("d", "vl", "s", "s2", "n")
    return lines.join(_small(many, many.count()), ["s", "s2", "n"]).where("d <> d2 or vl <> vl2").select("d", "vl")


def _near_first(own: DataFrame) -> DataFrame:
    """Pairs of a line and some of those with the same lowest, or highest, tokens: PIVOTS earliest and PIVOTS with most copies."""
    # a key of no more lines than that makes as few pairs in the join that follows
    shared = written(own.select(F.explode("ends").alias("k")).groupBy("k").count().where(F.col("count") > PIVOTS).select("k"))
    both = own.select(F.explode("ends").alias("k"), "c", "d", "vl", "n", "m", "w")
    both = written(both.join(_small(shared, shared.count()), "k"))
    by = Window.partitionBy("k")
    # limits of numbered rows apply before the shuffle as well, so a large group sends few rows of each task
    early = both.withColumn("r", F.row_number().over(by.orderBy("d", "vl"))).where(F.col("r") <= PIVOTS)
    copied = both.where("c > 1").withColumn("r", F.row_number().over(by.orderBy(F.desc("c"), "d", "vl"))).where(F.col("r") <= PIVOTS)
    pivots = written(early.union(copied).drop("c", "r").distinct())
    n = {"a": "a.n", "b": "b.n"}
    on = f"a.k = b.k and {_EARLIER} and {_SIZES.format(**n)} and {_MAPS.format(**n)}"
    pairs = written(both.alias("a").join(pivots.alias("b"), F.expr(on)).selectExpr(*_PAIR).distinct())
    drop_written(shared, both, pivots)
    return pairs


def _keys(known: DataFrame, crowded: int, long: int = LONG) -> DataFrame:
    """k, d, vl, at (length, most common words if the key's are the first, and whether an earlier line is wanted), m, w: a row for each key."""
    least = crowded << TOKEN_BITS
    one = known.select("d", "vl", "n", "m", "w", "late", "p", F.posexplode("p").alias("i", "x"))
    inside = f"i < n - {_OWN_NEED.format(n='n')} + 1"
    pairs = f"if(n <= {long}, slice(p, i + 2, size(p)), cast(array() as array<bigint>))"
    alone = f"if(5 * n >= 4 * {long} and {inside}, array(-1L), cast(array() as array<bigint>))"
    others = f"if(x < {least}L, if({inside}, array(0L), cast(array() as array<bigint>)), concat({pairs}, {alone}))"
    two = one.select("d", "vl", "n", "m", "w", "late", "i", "x", F.posexplode(F.expr(others)).alias("skipped", "y"))
    most = "n - i - if(y > 0, skipped, 0)"  # of the words before the key's, and between a pair of them, none is common
    return two.selectExpr("xxhash64(x, y) as k", "d", "vl", f"cast(n as bigint) * 4294967296L + ({most}) * 2L + late as at", "m", "w")


def _candidates(keys: DataFrame) -> DataFrame:
    """Pairs of a line that is still wanted and an earlier one that pass order, length, position (see _keys) and parity map."""
    an, bn, at, bt = (x.format(s) for x in ("shiftright({0}.at, 32)", "shiftright({0}.at & 4294967295L, 1)") for s in "ab")
    wanted = "(a.at & 1L) + b.at > b.at"  # over both sides, so that both read one and the same exchange
    sizes, maps = _SIZES.format(a=an, b=bn), _MAPS.format(a=an, b=bn)
    most = f"9 * {at} >= 4 * ({an} + {bn}) and 9 * {bt} >= 4 * ({an} + {bn})"
    on = f"a.k = b.k and {_EARLIER} and {wanted} and {maps} and {sizes} and {most}"
    return keys.alias("a").join(keys.alias("b"), F.expr(on)).selectExpr(*_PAIR).distinct()


def _small(side: DataFrame, rows: int, entries: int = 0) -> DataFrame:
    """The side of a join, to be broadcast if its counted size is within the bounds."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS and entries <= BROADCAST_ENTRIES else side


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """d, vl of the later lines of those pairs that are similar indeed, by their words."""
    wanted = written(pairs.select("d", "vl").union(pairs.select("d2", "vl2")).distinct())
    ids = wanted.select("d").distinct()
    n = ids.count()
    if not n:
        drop_written(wanted)
        return pairs.select("d", "vl").where("false")
    some = docs.select("doc_id", "text").withColumn("d", F.expr(_D)).join(_small(ids, n), "d", "left_semi").drop("d")
    lines = _lines(some).join(_small(wanted, wanted.count()), ["d", "vl"], "left_semi").dropDuplicates(["d", "vl"])
    sets = written(lines.selectExpr("d", "vl", "array_remove(array_distinct(split(words, ' ')), '') as t"))
    one = pairs.join(sets, ["d", "vl"])
    other = sets.selectExpr("d as d2", "vl as vl2", "t as t2")
    both = one.join(other, ["d2", "vl2"]).selectExpr("d", "vl", "size(array_intersect(t, t2)) as c", "size(t) + size(t2) as n")
    found = written(both.where("9 * c >= 4 * n").select("d", "vl").distinct())
    drop_written(sets, wanted)
    release(docs.sparkSession)
    return found


def removed_lines(docs: DataFrame, crowd: int = CROWD, long: int = LONG) -> DataFrame:
    """d, vl of every line that goes (see _lines); the table is written in the shared folder."""
    spark = docs.sparkSession
    sets = written(_sets(docs)).where(F.col("n") >= MIN_WORDS)
    classes, crowded = _classes(sets)
    if crowd != CROWD:
        crowded = round(4 * math.log2(1 + crowd)) + 1
    own = written(_own(sets, classes))
    copies = written(_copies(sets, own))
    drop_written(sets)
    release(spark)
    pairs = _near_first(own)
    gone = _verified(pairs, docs)
    drop_written(pairs)
    release(spark)
    late = own.select("d", "vl", "n", "m", "w", "p").join(_small(gone, gone.count()).withColumn("g", F.lit(1)), ["d", "vl"], "left")
    known = late.selectExpr("d", "vl", "n", "m", "w", "cast(g is null as int) as late", "p")
    pairs = written(_candidates(_keys(known, crowded, long)))
    drop_written(own)
    release(spark)
    more = _verified(pairs, docs)
    out = written(functools.reduce(DataFrame.union, [copies, gone, more]).distinct())
    drop_written(copies, pairs, gone, more)
    release(spark)
    return out


def dedup_lines(docs: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """docs with the text of what stays, n_chars anew where docs has it, and n_removed; other columns as they are."""
    removed = removed_lines(docs) if removed is None else removed
    docs = docs.drop("n_removed")
    d, v, bits = (fresh(docs, x) for x in ("d", "v", "bits"))
    # a bit for each line that goes, in words of 64 lines
    words = removed.selectExpr("d", "shiftright(vl, 32) as v", "cast(vl & 4294967295L as int) as line").groupBy("d", "v", F.shiftright("line", 6).alias("b")).agg(F.bit_or(F.expr("shiftleft(1L, line)")).alias("bits"))
    of = words.groupBy("d", "v").agg(F.map_from_entries(F.collect_list(F.struct("b", "bits"))).alias("of"), F.max("b").alias("top"))
    gone = written(of.selectExpr("d", "v", "transform(sequence(0, top), b -> coalesce(try_element_at(of, b), 0L)) as bits"))
    rows, entries = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("bits")), F.lit(0))).first()
    keyed = docs.withColumns({d: F.expr(_D), v: F.expr(_V)})
    joined = keyed.join(_small(gone.toDF(d, v, bits), rows, entries), [d, v], "left")
    stays = f"filter(split(text, '\\n'), (x, i) -> (coalesce(get(`{bits}`, shiftright(i, 6)), 0L) & shiftleft(1L, i)) = 0L)"
    counted = f"coalesce(aggregate(`{bits}`, 0, (a, x) -> a + cast(bit_count(x) as int)), 0)"
    out = joined.withColumns({"n_removed": F.expr(counted), "text": F.expr(f"if(`{bits}` is null, text, array_join({stays}, '\\n'))")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns], "n_removed")
