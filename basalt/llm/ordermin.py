"""Document fingerprints by Order MinHash, in DataFrame functions alone (operator 5).

Symbols are runs of non-blank characters, cut after ``SYMBOL`` of them; k-mers
are runs of ``k`` symbols.  Each k-mer is numbered among its equals in the
text, and the numbered k-mers are hashed.  A signature is made of the two least
of them by an order of its own, taken as they stand in the text: it changes
when k-mers are lost and when they change places.  Likeness is the share of
signatures that agree among those that either text has.

The ``BINS`` orders come from one family of hashes: in the order of bin b those
k-mers come first whose hash falls into b, the least hash first, then those
whose second hash does, and so on, for as many hashes as the text's length calls
for (one for a long text); then all others, by a hash of their own with b.  So
every bin of a text of two or more k-mers has two, and texts of any lengths are
compared by the same orders but for the few bins that come to those others.

Everything is arrays of 64-bit integers, a hash's upper bits with a position in
the lower, so that sorting numbers sorts by hash and then by place.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, shuffle_partitions

BINS = 64
SYMBOL = 16
#: A short text's hashes: so many are wanted, 7 a bin.  Texts of as many k-mers need but one each.
WANTED = 448
#: Place of a k-mer, the lower half of a number; an array has fewer elements.
_LOW = (1 << 32) - 1
#: Lower bits of a short text's numbers: above the place, 32 bits of hash, 10 of its number, 6 of the bin.
_SHORT = (1 << 16) - 1
_EMPTY = "----"
#: Ranges that the rows are cut into at most: their bounds are part of the plan.
RANGES = 100_000


def _signatures(df: DataFrame, text: str, out: str, k: int) -> DataFrame:
    """Adds the array ``out`` of a text column's signatures, one four-digit string per bin.

    Each step is a column of its own that the next step names more than once,
    so that no step is computed again for every element.
    """
    words, kmers, equal, numbered, levels, placed, firsts = (f"__{out}_{n}" for n in ("words", "kmers", "equal", "numbered", "levels", "placed", "firsts"))
    w, h, a, b, c, many = F.col(words), F.col(kmers), F.col(equal), F.col(numbered), F.col(placed), F.col(levels)
    upper = lambda x: x.bitwiseAND(F.lit(~_LOW))
    lower = lambda x: x.bitwiseAND(F.lit(_LOW))
    bin_of = lambda x: F.shiftright(x, 64 - BINS.bit_length() + 1)
    # one row has one kind of number: a long text's or a short one's
    place = lambda x: x.bitwiseAND(F.when(many > 1, F.lit(_SHORT)).otherwise(F.lit(_LOW))).cast("int")

    df = df.withColumn(words, F.regexp_extract_all(F.col(text), F.lit(f"[^\\x20\\x09-\\x0D]{{1,{SYMBOL}}}"), F.lit(0)))
    # one k-mer per start; fewer symbols than k make one k-mer of all
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(kmers, F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))
    df = df.withColumn(equal, F.sort_array(F.transform(h, lambda x, i: upper(x).bitwiseOR(i.cast("long")))))

    def earlier(x: Column, j: Column) -> Column:
        """How many of the k-mer's equals stand before it: they lie side by side, so halving steps find the first."""
        same = lambda d: (j >= d) & (upper(F.get(a, j - d)) == upper(x))
        steps = F.lit([1 << p for p in range(30, -1, -1)])
        return F.when(same(F.lit(1)), F.aggregate(steps, F.lit(0), lambda n, s: F.when(same(n + s), n + s).otherwise(n))).otherwise(F.lit(0))

    df = df.withColumn(numbered, F.transform(a, lambda x, j: upper(F.xxhash64(upper(x), earlier(x, j))).bitwiseOR(lower(x))))
    # one k-mer alone has no other to stand beside
    df = df.withColumn(levels, F.when(F.size(b) < 2, F.lit(1)).otherwise(F.ceil(F.lit(WANTED) / (F.size(b) - 1)).cast("int")))

    def again(level: Column, x: Column) -> Column:
        """A short text's number: bin, level, hash and place, by the hash of this level."""
        hash_ = F.when(level == 0, upper(x)).otherwise(F.xxhash64(upper(x), level))
        rest = F.shiftrightunsigned(hash_, 10).bitwiseAND(F.lit(((1 << 48) - 1) & ~_SHORT))
        return hash_.bitwiseAND(F.lit(-1 << 58)).bitwiseOR(F.shiftleft(level.cast("long"), 48)).bitwiseOR(rest).bitwiseOR(lower(x))

    repeated = F.flatten(F.transform(F.sequence(F.lit(0), many - 1), lambda n: F.transform(b, lambda x: again(n, x))))
    df = df.withColumn(placed, F.sort_array(F.when(many > 1, repeated).otherwise(b)))

    def others(n: Column) -> Column:
        """The k-mers in the order in which they come to bin ``n`` after those of its own hashes; few bins ask."""
        return F.sort_array(F.transform(b, lambda v: upper(F.xxhash64(upper(v), n, F.lit("other"))).bitwiseOR(lower(v))))

    at = lambda i: F.get(h, i)
    short = lambda pair: F.lpad(F.lower(F.hex(pair.bitwiseAND(F.lit(0xFFFF)))), 4, "0")
    ordered = lambda i, o: F.xxhash64(at(F.least(i, o)), at(F.greatest(i, o)))
    place_of = lambda v: lower(v).cast("int")

    def signature(x: Column, j: Column) -> Column:
        # the next of the bin that is another k-mer; a short text may have one k-mer there more than once
        in_bin = lambda y: bin_of(y) == bin_of(x)
        following = lambda d: F.get(c, j + d)
        near = [F.when(in_bin(following(d)) & (place(following(d)) != place(x)), place(following(d))) for d in range(1, 7)]
        far = F.when(in_bin(following(6)), place(F.get(F.filter(F.slice(c, j + 8, F.size(c)), lambda y: in_bin(y) & (place(y) != place(x))), F.lit(0))))
        added = F.when(F.size(b) > 1, place_of(F.get(F.filter(others(bin_of(x).cast("int")), lambda v: place_of(v) != place(x)), F.lit(0))))
        other = F.coalesce(*near, far, added)
        pair = F.when(other.isNull(), F.xxhash64(at(place(x)))).otherwise(ordered(place(x), other))
        first = (j < 1) | (bin_of(F.get(c, j - 1)) != bin_of(x))
        return F.when(first, F.struct(bin_of(x).cast("int").alias("bin"), short(pair).alias("sig")))

    df = df.withColumn(firsts, F.map_from_entries(F.filter(F.transform(c, signature), lambda s: s.isNotNull())))
    bins = F.lit(list(range(-BINS // 2, BINS // 2)))
    filled = F.col(firsts)

    def added(n: Column) -> Column:
        two = F.transform(F.slice(others(n), 1, 2), place_of)
        return short(F.aggregate(F.array(two), F.lit(0).cast("long"), lambda _, t: ordered(F.get(t, F.lit(0)), F.get(t, F.lit(1)))))

    missing = lambda n: F.when(F.size(b) > 1, added(n)).otherwise(F.lit(_EMPTY))
    df = df.withColumn(out, F.transform(bins, lambda n: F.when(F.map_contains_key(filled, n), F.element_at(filled, n)).otherwise(missing(n))))
    return df.drop(words, kmers, equal, numbered, levels, placed, firsts)


def likeness(one: Column, other: Column) -> Column:
    """Share of the bins filled by either text in which both have one signature; 1 if no bin is filled."""
    agree = F.aggregate(F.zip_with(one, other, lambda x, y: ((x == y) & (x != _EMPTY)).cast("int")), F.lit(0), lambda n, x: n + x)
    either = F.aggregate(F.zip_with(one, other, lambda x, y: ((x != _EMPTY) | (y != _EMPTY)).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(either == 0, F.lit(1.0)).otherwise(agree.cast("double") / either)


def fingerprint(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint", k: int = 3) -> DataFrame:
    """Adds ``out``, the fingerprint string of a text column; a null text has that of an empty one."""
    filled = docs.withColumn("__omh_text", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    signed = _signatures(filled, "__omh_text", "__omh_sigs", k)
    return signed.withColumn(out, F.array_join("__omh_sigs", "")).drop("__omh_text", "__omh_sigs")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents stand in descending order of their integer id, equal ids by the
    text's hash, null ids last; the next of the last is the first.  Rows are cut
    into ranges at quantiles of the id that the driver holds (a few numbers per
    shuffle partition), and an id that fills several ranges is cut further by
    the text's hash; the first row of each range stands at the end of the range
    before as well, so a window over one range finds every row's next, and the
    texts are shuffled once.  One row per input row, repeats included; a null
    text is empty; texts with the same symbols in the same order have the same
    fingerprint, and those without symbols an empty one, all alike; an empty
    table gives none; other columns are not read.  Ids that are no integers
    count as null, and keep their value.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").try_cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    source = only(docs, id_col, text_col)
    ranges = min(4 * shuffle_partitions(source), RANGES)
    found = only(docs, id_col).select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], min(100 * ranges, 1_000_000)).alias("cuts")).first()["cuts"] or []
    cuts, many = [], Counter(found)
    for value in sorted(many, reverse=True):
        times = many[value]
        # before the first row with a hot id, then by even steps of the hash; the cut of another id stands after it
        cuts += [(value, (i << 64) // times - (1 << 63)) for i in range(times)] if times > 1 else [(value, (1 << 63) - 1)]
    tie = F.xxhash64(text)
    # the number of cuts before the row, by halving steps
    steps = F.lit([1 << p for p in range(max(len(cuts), 1).bit_length() - 1, -1, -1)])
    # one text is one literal, which the optimizer folds into an array
    keys, ties = (F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<long>") if cuts else F.array().cast("array<long>") for i in (0, 1))
    before = lambda i: F.coalesce((F.get(keys, i) > F.col("key")) | ((F.get(keys, i) == F.col("key")) & (F.get(ties, i) <= F.col("tie"))), F.lit(False))
    part = F.aggregate(steps, F.lit(0), lambda n, s: F.when(before(n + s - 1), n + s).otherwise(n))
    placed = source.select(F.col(f"`{id_col}`").alias("doc_id"), key.alias("key"), text.alias("text"), tie.alias("tie")).withColumn("part", part)
    first = placed.groupBy("part").agg(F.max(F.struct("key", F.bitwise_not("tie").alias("back"))).alias("head"))
    heads = first.select("part", "head.key", F.bitwise_not("head.back").alias("tie")).orderBy("part").collect()
    ahead = spark.createDataFrame([(row["key"], row["tie"], heads[i - 1]["part"]) for i, row in enumerate(heads)], "key long, tie long, target int")

    rows = placed.join(F.broadcast(ahead), ["key", "tie"], "left")  # one short row per range
    own = F.struct(F.col("part"), F.lit(0).alias("extra"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("target").alias("part"), F.lit(1).alias("extra"))))))
    rows = rows.select("doc_id", "key", "text", "at.part", "at.extra", "tie")
    rows = _signatures(rows, "text", "sigs", k)

    order = Window.partitionBy("part").orderBy("extra", F.col("key").desc(), "tie")
    rows = rows.withColumn("following", F.lead(F.struct("text", "sigs")).over(order)).where("extra = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("following.text"), F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "sigs", F.col("following.sigs").alias("next_sigs"), "edited", F.sha2("edited", 256).alias("edited_sha256"))
    rows = _signatures(rows, "edited", "edited_sigs", k)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("sigs", "").alias("fingerprint"), F.array_join("edited_sigs", "").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
