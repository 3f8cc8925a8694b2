"""Document fingerprints: canonical exact digest, with DataFrame functions only.

A text is brought to a canonical form (compatibility composition, full case
folding, composition again, white space runs as one space, trimmed) and hashed by two xxhash64 of different
seeds.  Inside equal digests the canonical texts are compared byte by byte: they
are grouped by digest and text, and where one digest holds several texts the
fingerprint gets the text's place among them as a suffix.

Null texts count as empty.  Texts whose canonical forms are equal share a
fingerprint, whatever their doc_id; repeated rows give repeated results.  The
order of rows that share a doc_id is that of their digests.  Very long texts are
handled whole, empty tables give empty results, and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a bucket of neighbouring ids, which is sorted in one task.
BUCKET_ROWS = 2048
#: Quantiles that are fetched to place the buckets; inside a quantile ids are cut evenly.
QUANTILES = 256
SECOND_SEED = 0x5BD1E995


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    # Full case folding: lower(upper(x)) would not do, as the optimizer makes lower(x) of it.
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.btrim(F.regexp_replace(compose(folded), r"[\s\u0085\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """128 bits of a canonical form as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(SECOND_SEED), form)), 16, "0")))


def bucket_of(docs: DataFrame) -> Column:
    """Numbers of id ranges, ascending with doc_id; a null id is before all others.

    The limits are approximate quantiles, at most ``QUANTILES`` numbers however
    large the table is.  Ranges between them are cut evenly so that a bucket
    holds about ``BUCKET_ROWS`` rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    low, high, rows = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    if not rows:
        return F.lit(0).cast("long")
    cells = max(1, min(QUANTILES, -(-rows // BUCKET_ROWS)))
    inner = ids.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], 10 * QUANTILES)).first()[0] if cells > 1 else []
    limits = sorted({low, *inner})
    widths = [max(1, b - a) for a, b in zip(limits, [*limits[1:], high + 1])]
    parts = -(-rows // (len(limits) * BUCKET_ROWS))
    x = F.col("doc_id").cast("long")
    at = F.greatest(F.size(F.filter(F.array(*map(F.lit, limits)), lambda b: b <= x)) - 1, F.lit(0))
    place = F.floor((x - F.get(F.array(*map(F.lit, limits)), at)) * parts / F.get(F.array(*map(F.lit, widths)), at))
    return F.when(x.isNull(), -1).otherwise(at.cast("long") * parts + F.least(place, F.lit(parts - 1)))


def _following(placed: DataFrame) -> DataFrame:
    """Adds ``next``: the text of the next row by descending doc_id, after the last the first's."""
    order = W.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "d")
    inside = placed.select("*", F.lead("text").over(order).alias("ahead"), F.row_number().over(order).alias("place"))
    heads = inside.where("place = 1").select("bucket", F.col("text").alias("head"))
    # One row a bucket, without texts: the bucket that each bucket is followed by.
    buckets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    chain = W.orderBy(F.desc("bucket"))
    chained = buckets.select("bucket", "rows", F.lead("bucket").over(chain).alias("below"), F.max("bucket").over(W.partitionBy()).alias("top"))
    links = chained.select(F.col("bucket").alias("of"), "rows", F.coalesce("below", "top").alias("bucket"))
    tails = links.join(heads, "bucket").select(F.col("of").alias("bucket"), F.col("rows").cast("int").alias("last"), "head")
    # Joined by bucket alone, by which the texts are already placed: they are not shuffled again.
    return inside.join(tails, "bucket", "left").withColumn("next", F.coalesce("ahead", F.when(F.col("place") == F.col("last"), F.col("head")))).drop("ahead", "head", "place", "last")


def collisions(placed: DataFrame) -> DataFrame:
    """(d, witness, suffix) of the digests that several canonical texts share: normally no row.

    Only rows whose digest occurs twice or more send their text; equal texts are
    folded before the shuffle.
    """
    plain = placed.select("bucket", "doc_id", "d")
    twice = plain.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    # A bucket has a bounded number of rows, so its digests do too; joined by bucket, by which the texts are already placed.
    rows = plain.join(twice, "d", "left_semi").groupBy("bucket").agg(F.collect_set("d").alias("twice"))
    same = placed.join(rows, "bucket").where("array_contains(twice, d)").select("d", canonical(F.col("text")).alias("form"))
    distinct = same.groupBy("d", "form").agg(F.count(F.lit(1)).alias("n"))
    witness = distinct.select("d", F.sha2("form", 256).alias("witness"))
    several = witness.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d")
    place = F.row_number().over(W.partitionBy("d").orderBy("witness"))
    return witness.join(several, "d").select("d", "witness", F.concat(F.lit("-"), place.cast("string")).alias("suffix"))


def fingerprints(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, d, next) of every row of ``docs``, d being the digest and next the following row's text; the collisions."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = base.select("doc_id", "text", bucket_of(base).alias("bucket")).repartition(n, "bucket").select("*", digest(canonical(F.col("text"))).alias("d"))
    return _following(placed), collisions(placed)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text has the last half of the code points replaced by the first
    as many of the next row's.  Likeness of exact digests is 1 if the canonical
    texts are equal, byte by byte, and else 0.
    """
    rows, shared = fingerprints(docs)
    n = F.length("text").cast("long")
    half = F.floor(n / 2)
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next", F.lit(1), half.cast("int")))
    made = rows.select("doc_id", "text", "d", "next", n.alias("n_chars"), edited.alias("edited"))
    made = made.select("*", digest(canonical(F.col("edited"))).alias("edited_d"), digest(canonical(F.col("next"))).alias("next_d"))
    alike = lambda key, other: F.when(F.col("d") == F.col(key), F.when(canonical(F.col("text")) == canonical(F.col(other)), 1.0).otherwise(0.0)).otherwise(0.0)
    small = made.select("doc_id", "n_chars", "d", "edited_d", F.sha2("edited", 256).alias("edited_sha256"), alike("edited_d", "edited").alias("near_edited"), alike("next_d", "next").alias("near_next"), F.sha2(canonical(F.col("text")), 256).alias("witness"))
    out = small.join(shared, ["d", "witness"], "left")
    fingerprint = F.concat("d", F.coalesce("suffix", F.lit("")))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint.alias("fingerprint"), F.when(F.col("near_edited") == 1.0, fingerprint).otherwise(F.col("edited_d")).alias("edited_fingerprint"), "near_edited", "near_next")

