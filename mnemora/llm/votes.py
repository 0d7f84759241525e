"""Document fingerprints by weighted SimHash, with DataFrame functions only.

Terms are pairs of neighbouring words (a text of one word has that word). Each occurrence of a
term votes with its hash: bit by bit for 1 or for 0, weighted by the term's length, at most
``HEAVIEST``. A bit of the fingerprint is 1 when the votes for it hold over half of all weight. Two
counters of 32 bits share one long, so 32 sums hold all 64 bits; votes are combined before the
shuffle. A counter would overflow beyond ``2**32 / HEAVIEST`` terms, more than a string holds.

``within_radius`` finds all fingerprints near given ones with permuted block tables: of six blocks
at least three agree when at most three bits differ, so every choice of three blocks is one table,
and equal keys are candidates.

Null and empty texts have fingerprint 0. Rows with a null doc_id are ordered last. Rows that repeat
a doc_id are ordered by a hash of their text, and rows repeated as a whole count as one neighbour.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .frames import LAST_ID, durable, prepared, text_key, texts

HEAVIEST = 16
#: Rows of a range when texts are placed by doc_id; beyond so many ranges they grow.
RANGE_ROWS = 512
MOST_RANGES = 65_536
RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)
_LANES = 0x0000000100000001


def words(text: str = "text") -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def terms(found: str = "words") -> Column:
    """The terms of a column of words in order; an empty array when there is no word."""
    n = F.size(found)
    after = F.slice(found, F.lit(2), F.greatest(n - 1, F.lit(0)))
    pairs = F.zip_with(found, after, lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(1)))


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` for each row of distinct ``keys``; texts without words are left out."""
    split = rows.select(*keys, words(text).alias("words"))
    hashed = split.select(*keys, F.explode(terms()).alias("t")).select(
        *keys, F.xxhash64("t").alias("h"), F.least(F.char_length("t"), F.lit(HEAVIEST)).cast("long").alias("w")
    )
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"v{k}") for k in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("w").alias("all"), *lanes)
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"v{k}", 32)
        for bit, votes in ((k, low), (k + 32, high)):
            value = 1 << bit if bit < 63 else -(1 << 63)
            fp = fp.bitwiseOR(F.when(votes * 2 > F.col("all"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return summed.select(*keys, fp.alias("fp"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, at, key, range, place, text, next_at, next_key, next_text`` of every row.

    The next document is that with the next smaller doc_id, after the smallest the largest. Rows are
    placed by ranges of ``at`` whose bounds are approximate quantiles of the ids. A range also gets,
    as a guest, the first row of the next range below it, so each row finds its neighbour in its own
    range and whole texts move once.
    """
    rows = texts(docs).withColumn("key", text_key()).withColumn("at", F.coalesce("doc_id", F.lit(LAST_ID)))
    n = rows.count()
    count = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds = []
    if count > 1:
        shares = [k / count for k in range(1, count)]
        bounds = sorted(set(rows.agg(F.percentile_approx("at", shares, 100 * count)).first()[0]))
    # Never null, and known not to be: else filters for nulls would make two shuffles of one.
    rows = rows.withColumn("range", F.coalesce(_position(F.col("at"), bounds), F.lit(0)))
    # One row per range.
    tops = durable(rows.groupBy("range").agg(F.max(F.struct("at", "key")).alias("top")))
    below = F.lead("top").over(W.orderBy(F.col("range").desc()))
    highest = F.first("top").over(W.orderBy(F.col("range").desc()))
    wanted = tops.select(F.col("range").alias("to"), F.coalesce(below, highest).alias("top")).select(
        "to", F.col("top.at").alias("at"), F.col("top.key").alias("key")
    )
    guests = rows.join(F.broadcast(durable(wanted)), ["at", "key"]).select(
        "doc_id", "text", "key", "at", F.coalesce("to", F.lit(0)).alias("range"), F.lit(1).alias("guest")
    )
    placed = rows.select("doc_id", "text", "key", "at", "range", F.lit(0).alias("guest")).unionByName(guests)
    order = W.partitionBy("range").orderBy("guest", F.col("at").desc(), F.col("key").desc())
    found = placed.repartition("range").select(
        "*", F.row_number().over(order).alias("place"),
        *[F.lead(c).over(order).alias(f"next_{c}") for c in ("at", "key", "text")],
    )
    return found.where("guest = 0").drop("guest")


def _position(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``: a binary search."""
    if not bounds:
        return F.lit(0)
    sorted_bounds = F.lit(bounds).cast("array<bigint>")
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda pos, step: F.when(
        (pos + step <= len(bounds)) & (F.coalesce(F.get(sorted_bounds, pos + step - 1), F.lit(LAST_ID)) <= value), pos + step
    ).otherwise(pos))


def edited(text: str = "text", other: str = "next_text") -> Column:
    """The last third of a text replaced by as much of the beginning of another."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - third), F.substring(F.col(other), F.lit(1), third))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def within_radius(queries: DataFrame, all_prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``query, fp, distance`` for all pairs of distinct ``fp`` values within ``radius`` bits."""
    if radius > len(BLOCKS) // 2:
        raise ValueError("the tables hold fingerprints that differ in at most three blocks")
    asked = _tables(queries.select("fp").distinct(), radius).withColumnRenamed("fp", "query")
    stored = _tables(all_prints.select("fp").distinct(), radius)
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    return asked.join(stored, ["k", "part"]).withColumn("distance", near).where(F.col("distance") <= radius).select("query", "fp", "distance").distinct()


def _tables(prints: DataFrame, radius: int) -> DataFrame:
    rows = []
    for k, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius)):
        mask = sum(((1 << BLOCKS[b]) - 1) << sum(BLOCKS[:b]) for b in chosen)
        rows.append(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("part")))
    return prints.select("fp", F.explode(F.array(*rows)).alias("s")).select("fp", "s.k", "s.part")


def document_fingerprints(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp, n_within`` of every row.

    ``n_within``: for documents whose id is divisible by ``every``, the number of distinct
    fingerprints of the table within ``radius`` of theirs, their own included; else null.
    """
    prepared(docs.sparkSession)
    both = with_next(docs)
    # Both sides below use the same columns of ``both`` (so doc_id is a key too): one shuffle serves them.
    ids = ["range", "place", "doc_id"]
    facts = both.select(
        *ids, "at", "key", "next_at", "next_key", F.char_length("text").alias("n_chars"), F.sha2(edited(), 256).alias("edited_sha256"),
    )
    sides = F.explode(F.array(
        F.struct(F.lit(False).alias("edit"), F.col("text").alias("t")), F.struct(F.lit(True).alias("edit"), edited().alias("t")),
    ))
    prints = fingerprints(both.select(*ids, sides.alias("s")).select(*ids, "s.edit", "s.t"), [*ids, "edit"], "t")
    pairs = prints.groupBy("range", "place").agg(
        F.max(F.when(~F.col("edit"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("edit"), F.col("fp"))).alias("edited_fp")
    )
    none = F.lit(0).cast("long")
    own = durable(facts.join(pairs, ["range", "place"], "left").withColumn("fp", F.coalesce("fp", none)).withColumn("edited_fp", F.coalesce("edited_fp", none)))
    by_row = own.groupBy(F.col("at").alias("next_at"), F.col("key").alias("next_key")).agg(F.max("fp").alias("next_fp"))
    asked = own.where(F.col("doc_id") % every == 0)
    near = within_radius(asked, own, radius).groupBy(F.col("query").alias("fp")).agg(F.count(F.lit(1)).alias("n"))
    found = own.join(by_row, ["next_at", "next_key"], "left").join(near, "fp", "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp",
        F.when(F.col("doc_id") % every == 0, F.col("n")).alias("n_within"),
    )
