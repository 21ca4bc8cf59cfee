"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

The shingles of a text (five consecutive words, lower case) are hashed once. The high bits of a
hash name one of ``BINS`` bins and the least hash of every bin is kept. Empty bins are filled by
optimal densification: a bin goes through a random sequence of its own over all bins and copies the
first filled one. The first ``PROBES`` places of that sequence are hashes of (bin, try); after them
comes the filled bin of least rank under a hash of (bin, other bin), so the search always ends.
Of each bin the ``BITS`` low bits of a hash of (value, bin) are stored, packed into 64-bit words.

Two unrelated bins agree with a chance of 2**-BITS; ``likeness`` corrects for it:
(agreement - 2**-BITS) / (1 - 2**-BITS), cut to 0 and 1.

Null texts count as empty. Texts without a word have no fingerprint (an empty list, written as '');
two of them are alike (1), one and any other are not (0). Texts of fewer than five words are one shingle.
Equal texts have equal fingerprints. Rows with null or repeated ids and repeated rows are rows of
their own. Columns other than doc_id and text are not read, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS_LOG, BITS, PROBES, SHINGLE = 8, 4, 12, 5
BINS = 1 << BINS_LOG
#: Bins to a 64-bit word.
LANES = 64 // BITS
#: A table is cut along doc_id into this many ranges per shuffle partition.
RANGES = 4


def _bin(value: Column) -> Column:
    """The bin of a hash; bins ascend with the signed value."""
    return (F.shiftright(value, 64 - BINS_LOG) + BINS // 2).cast("int")


def _with(df: DataFrame, source: str, name: str) -> DataFrame:
    """Adds the packed fingerprint of text column ``source`` as ``name`` (array of bigint).

    Every step is a column of its own: lambdas below read it by index, and an inlined expression
    would run again for each element.
    """
    words, hashes, least, bins, full = (f"{name}__{s}" for s in ("words", "hashes", "least", "bins", "full"))

    def at(i: Column) -> Column:
        return F.get(words, i)

    shingles = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE),
                           lambda i: F.xxhash64(*[at(i + j) for j in range(SHINGLE)]))
    df = df.withColumn(words, F.filter(F.split(F.lower(source), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    df = df.withColumn(hashes, F.when(F.size(words) >= SHINGLE, shingles)
                       .when(F.size(words) > 0, F.array(F.xxhash64(words)))
                       .otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(hashes, F.sort_array(hashes)).drop(words)
    df = df.withColumn(least, F.filter(hashes, lambda v, i: (i == 0) | (_bin(v) != _bin(F.get(hashes, i - 1))))).drop(hashes)

    def gap(low: Column, high: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("bigint"), high - low - 1)

    runs = F.transform(least, lambda v, i: F.concat(
        F.array(v), gap(_bin(v), F.coalesce(_bin(F.get(least, i + 1)), F.lit(BINS)))))
    df = df.withColumn(bins, F.concat(gap(F.lit(-1), F.coalesce(_bin(F.get(least, F.lit(0))), F.lit(0))), F.flatten(runs)))

    def donor(i: Column) -> Column:
        tries = [F.get(bins, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        last = F.array_min(F.transform(least, lambda v: F.struct(
            F.xxhash64(i, _bin(v), F.lit("last")).alias("rank"), v.alias("value"))))["value"]
        return F.coalesce(*tries, last)

    df = df.withColumn(full, F.transform(bins, lambda v, i: F.xxhash64(F.coalesce(v, donor(i)), i)
                                         .bitwiseAND(F.lit((1 << BITS) - 1)))).drop(bins, least)
    lanes = F.sequence(F.lit(0), F.lit(LANES - 1))
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lambda w: F.aggregate(
        lanes, F.lit(0).cast("bigint"), lambda acc, j: F.shiftleft(acc, BITS).bitwiseOR(F.get(full, w * LANES + j))))
    return df.withColumn(name, F.when(F.size(full) > 0, packed).otherwise(F.array().cast("array<bigint>"))).drop(full)


def with_fingerprint(df: DataFrame, source: str = "text", name: str = "fingerprint") -> DataFrame:
    """The frame with the packed fingerprint of a text column."""
    held = f"{name}__source"
    return _with(df.withColumn(held, F.coalesce(F.col(source).cast("string"), F.lit(""))), held, name).drop(held)


def as_text(packed: Column) -> Column:
    """A fingerprint in hexadecimal, one digit for each four bits; '' for none."""
    return F.array_join(F.transform(packed, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles of two packed fingerprints."""
    ones = sum(1 << (BITS * j) for j in range(LANES))
    ones = F.lit(ones - (1 << 64) if ones >= 1 << 63 else ones)

    def differing(x: Column, y: Column) -> Column:
        diff = x.bitwiseXOR(y)
        any_bit = diff
        for j in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(diff, j))
        return F.bit_count(any_bit.bitwiseAND(ones))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0 ** -BITS
    raw = (F.lit(1.0) - off / F.lit(float(BINS)) - chance) / (1 - chance)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
            .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))


def _range(bounds: list[int], ranges: int) -> Column:
    """Number of the bounds at or below doc_id, by halving; rows without an id come in ``ranges`` of
    their own before the others, spread by their text's hash."""
    levels = max(1, len(bounds)).bit_length()
    table = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = (acc["low"] < acc["high"]) & (F.get(table, middle) <= F.col("doc_id"))
        return F.struct(F.when(right, middle + 1).otherwise(acc["low"]).alias("low"),
                        F.when(right, acc["high"]).otherwise(F.least(middle, acc["high"])).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step, lambda acc: acc["low"])
    spread = F.floor((F.col("tie") / F.lit(float(1 << 64)) + 0.5) * ranges).cast("int")
    return F.when(F.col("doc_id").isNull(), F.least(spread, F.lit(ranges - 1)) - ranges).otherwise(found)


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, text and ``columns`` of every row, and the same of the next row in descending order
    of doc_id as ``next_*``; the first row follows the last. Rows without an id come last, equal
    ids in the order of the hash of their text.

    No window spans the table: it is cut into ranges of doc_id, and the first row of each range is
    also sent to the range before, as the row that follows its last one.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    bounds = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], F.lit(100 * ranges))).first()[0]
    docs = docs.withColumn("range", _range(sorted(set(bounds or [])), ranges))
    key = F.struct("doc_id", "tie")
    # one row per range: at most 2 * ranges
    tops = docs.groupBy("range").agg(F.max(key).alias("top"))
    below = Window.orderBy("range")
    lead = F.lead("range").over(below)
    tops = tops.select("range", "top", F.coalesce(lead, F.min("range").over(
        below.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("above"),
        (lead.isNull()).alias("wraps"))
    marked = docs.join(F.broadcast(tops), "range", "left")
    is_top = key.eqNullSafe(F.col("top"))
    first = F.struct(F.col("range"), F.lit(0).alias("turn"))
    ghost = F.struct(F.col("above").alias("range"), F.when(F.col("wraps"), 2).otherwise(1).alias("turn"))
    sent = marked.withColumn("place", F.explode(F.when(is_top, F.array(first, ghost)).otherwise(F.array(first))))
    sent = sent.select("doc_id", "text", "tie", *columns, F.col("place.range").alias("range"), F.col("place.turn").alias("turn"))
    along = Window.partitionBy("range").orderBy("turn", F.desc_nulls_last("doc_id"), F.desc("tie"))
    following = F.lead(F.struct(F.col("doc_id").alias("next_doc_id"), F.col("text").alias("next_text"),
                                *[F.col(c).alias(f"next_{c}") for c in columns])).over(along)
    return sent.withColumn("following", following).filter("turn = 0").select("doc_id", "text", *columns, "following.*")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's text in descending order of doc_id. Returns doc_id, n_chars,
    edited_text, fingerprint and edited_fingerprint (packed), near_edited, near_next.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(_with(rows, "text", "fingerprint"), ["fingerprint"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited_text", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = _with(rows.drop("text", "next_text"), "edited_text", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
