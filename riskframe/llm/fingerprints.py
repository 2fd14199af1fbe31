"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

A text's shingles of five words are hashed once. The top eight bits of a hash choose one of 256
bins and a bin keeps its smallest hash. An empty bin copies the first filled bin along a fixed
random path of its own through all bins (optimal densification). Of each bin four low bits are
stored, so a fingerprint is 16 packed longs; the share of equal bins, corrected for chance
agreement of four bits, estimates the Jaccard similarity.

Only DataFrame functions are used; a fingerprint is computed inside its row, without a shuffle.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from riskframe.llm.common import discard, stored, whole_text

WORDS = 5
BINS = 256
BITS = 4
PER_LONG = 64 // BITS
LONGS = BINS * BITS // 64
_SPACE = "\t\n\x0b\x0c\r "


def _paths() -> tuple[list[int], list[int]]:
    """Start and odd step of each bin's path; an odd step visits all bins."""
    draw = random.Random(20240613)
    return [draw.randrange(BINS) for _ in range(BINS)], [draw.randrange(BINS) | 1 for _ in range(BINS)]


def _long(value: int) -> Column:
    """A 64-bit pattern as a signed literal."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: array of 16 longs, empty for a text without words.

    Words are lower-cased runs between ASCII white space; fewer than five words are one shingle.
    Each step is a column of its own because the next one looks into it at many places.
    """
    trimmed = F.btrim(F.lower(text), F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x09-\\x0d\\x20]+"))
    keep = [F.col(f"`{c}`") for c in df.columns]
    step = df.select(*keep, words.alias("_words"))
    step = step.select(*keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_w"))
    shingle = lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WORDS)])
    hashes = (F.when(F.size("_w") == 0, F.array().cast("array<bigint>"))
              .when(F.size("_w") < WORDS, F.array(F.xxhash64("_w")))
              .otherwise(F.transform(F.sequence(F.lit(0), F.size("_w") - WORDS), shingle)))
    step = step.select(*keep, F.sort_array(hashes).alias("_h"))
    # signed order keeps a bin's hashes together; its smallest comes first
    bin_of = lambda x: F.shiftright(x, 64 - 8).cast("int") + BINS // 2
    step = step.select(*keep, F.filter("_h", lambda x, i: (i == 0) | (
        bin_of(x) != bin_of(F.get("_h", i - 1)))).alias("_m"))
    gap = lambda x, j: bin_of(x) - F.when(j == 0, F.lit(0)).otherwise(
        bin_of(F.get("_m", j - 1)) + 1)
    none = F.lit(None).cast("long")
    slots = F.concat(
        F.flatten(F.transform("_m", lambda x, j: F.concat(F.array_repeat(none, gap(x, j)), F.array(x)))),
        F.array_repeat(none, F.lit(BINS - 1) - bin_of(F.get("_m", F.size("_m") - 1))))
    step = step.select(*keep, F.when(F.size("_m") > 0, slots).alias("_s"))
    starts, steps = _paths()
    paths = ",".join(f"named_struct('at', {a}, 'by', {b}, 'bin', {i})"
                     for i, (a, b) in enumerate(zip(starts, steps)))
    tries = ",".join(f"_s[(path.at + {n} * path.by) & {BINS - 1}]" for n in range(BINS))
    # coalesce stops at the first filled bin; hashing with the bin's number makes chance agreements of
    # bins that copy one value independent, as the correction assumes
    filled = F.expr(f"zip_with(_s, array({paths}), (own, path) -> "
                    f"xxhash64(coalesce(own, {tries}), path.bin) & {(1 << BITS) - 1})")
    step = step.select(*keep, filled.alias("_f"))
    packed = F.array(*[F.aggregate(
        F.slice("_f", j * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"),
        lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)) for j in range(LONGS)])
    return step.select(*keep, F.when(F.col("_f").isNull(), F.array().cast("array<bigint>"))
                       .otherwise(packed).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints; 1 for two empty ones, 0 for one."""
    fold = _long(int("1" * PER_LONG, 16))
    unequal = F.lit(0)
    for j in range(LONGS):
        x = F.get(a, F.lit(j)).bitwiseXOR(F.get(b, F.lit(j)))
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal = unequal + F.bit_count(x.bitwiseAND(fold))
    chance = 1 / (1 << BITS)
    share = (F.lit(BINS) - unequal) / float(BINS)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance))))


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def next_in_order(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``next``: ``value`` of the row with the next smaller ``key``; the largest for the last row.

    ``key`` is distinct and not null. Rows are cut into ranges, the neighbour is found inside each,
    and one line per range links it to the following one.
    """
    ranges = stored(rows.repartitionByRange(F.col(key).desc()).withColumn("_range", F.spark_partition_id()),
                    "ranges")
    first = ranges.groupBy("_range").agg(F.max(F.struct(key, value)).alias("_first"))
    order = W.partitionBy(F.lit(0)).orderBy("_range")  # as many lines as ranges
    following = first.select("_range", F.coalesce(
        F.lead("_first").over(order), F.first("_first").over(
            order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))[value].alias("_following"))
    inside = F.lead(value).over(W.partitionBy("_range").orderBy(F.col(key).desc()))
    out = stored(ranges.withColumn("_next", inside).join(F.broadcast(following), "_range")
                 .withColumn("next", F.coalesce("_next", "_following")).drop("_range", "_next", "_following"),
                 "next")
    discard(ranges)
    return out


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses.

    The edited text replaces the last third of the code points by the first as many of the next
    document in descending doc_id. Null texts count as empty. Rows without doc_id are left out. Rows
    that repeat a doc_id count once, as the text of the smallest hash. A single document is its own
    next one; an empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", whole_text().alias("text"))
    rows = rows.withColumn("dh", F.xxhash64("text"))
    marked = with_fingerprint(rows, F.col("text"), "fp").select(
        "doc_id", F.struct("dh", F.length("text").cast("long").alias("n"), "fp", "doc_id").alias("own"))
    chain = next_in_order(marked.groupBy("doc_id").agg(F.min("own").alias("own")), "doc_id", "own")
    # both joins use one shuffle of the texts: the replacing text is cut where the next document lies
    # and then sent, with what is known of the document it ends, to that document
    wanted = chain.select(
        F.col("doc_id").alias("for_id"), F.col("own.dh").alias("for_dh"), F.col("own.n").alias("n_chars"),
        F.col("own.fp").alias("fp"), likeness(F.col("own.fp"), F.col("next.fp")).alias("near_next"),
        F.col("next.doc_id").alias("doc_id"), F.col("next.dh").alias("dh"))
    third = F.expr("n_chars div 3").cast("int")
    tails = rows.join(wanted, ["doc_id", "dh"]).select(
        F.col("for_id").alias("doc_id"), F.col("for_dh").alias("dh"), "n_chars", "fp", "near_next",
        F.substring("text", F.lit(1), third).alias("tail"))
    texts = rows.join(tails, ["doc_id", "dh"]).dropDuplicates(["doc_id", "dh"])
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third)
    edited = texts.select("doc_id", "n_chars", "fp", "near_next", F.concat(head, "tail").alias("edited"))
    edited = with_fingerprint(edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)),
                              F.col("edited"), "edited_fp").drop("edited")
    return edited.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), "near_next")
