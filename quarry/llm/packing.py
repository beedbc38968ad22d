"""Packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialize, n_words, text_of

#: Rows whose ranks are counted within one task.
RANK_ROWS = 500_000
#: A table of placements with more rows than this is joined without a broadcast hint.
BROADCAST_ROWS = 200_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``[(packs, [(length, how many of it in each pack), ...]), ...]``.

    Lengths are placed longest first, each item into the emptiest open pack that has room
    for it, else into a new pack. Items of one length are placed together by moving counts
    of packs from pattern to pattern, so the work depends on the number of lengths and
    patterns and not on the number of items.
    """
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [[packs, pattern], ...]
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        if length > capacity:
            raise ValueError(f"length {length} is over the capacity {capacity}")
        rooms = sorted((r for r, v in open_.items() if v and r >= length), reverse=True)
        while left and rooms:
            room = rooms.pop(0)
            after = room - length
            while left and open_[room]:
                group = open_[room].pop()
                packs, pattern = group
                used = min(packs, left)
                left -= used
                if used < packs:
                    open_[room].append([packs - used, pattern])
                if pattern and pattern[-1][0] == length:
                    grown = pattern[:-1] + ((length, pattern[-1][1] + 1),)
                else:
                    grown = pattern + ((length, 1),)
                open_[after].append([used, grown])
            if left and after >= length and after not in rooms:
                rooms.append(after)
                rooms.sort(reverse=True)
        if left:
            each = capacity // length
            full, rest = divmod(left, each)
            if full:
                open_[capacity - each * length].append([full, ((length, each),)])
            if rest:
                open_[capacity - rest * length].append([1, ((length, rest),)])
    return [(packs, list(pattern)) for room in sorted(open_) for packs, pattern in open_[room]]


def placements(patterns) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, run, first pack, slot, offset): item
    ``r`` of a length lies in pack ``first pack + (r - first rank) // run``."""
    rows, base, used = [], 0, defaultdict(int)
    for packs, pattern in patterns:
        slot = offset = 0
        for length, run in pattern:
            low = used[length]
            used[length] = high = low + packs * run
            rows.append((length, low, high, run, base, slot, offset))
            slot += run
            offset += run * length
        base += packs
    return rows


def in_blocks(rows, histogram: dict[int, int]) -> list[tuple[int, tuple[int, ...]]]:
    """(ranks in a block, (length, block, first rank, ...)): each placement under every block of its
    length's ranks that it reaches into. A length has as many blocks as placements, so a rank
    meets few of them and the table is at most twice as long."""
    of: dict[int, int] = defaultdict(int)
    for r in rows:
        of[r[0]] += 1
    out = []
    for length, low, high, *rest in rows:
        size = -(-histogram[length] // of[length])
        out += [(size, (length, block, low, high, *rest)) for block in range(low // size, (high - 1) // size + 1)]
    return out


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Places every document into packs of ``capacity`` tokens.

    A document of more than ``capacity`` tokens is cut into pieces of that length and a
    rest. Ranks within a length follow a hash of (id, piece); they decide which document
    takes which place of a pattern. Returns ``doc_id, piece, piece_start, piece_tokens,
    pack_id, slot, pack_offset`` in tokens, a row for each piece of each input row.

    tokens: the length of a row, words of its text unless given. Null and empty texts have
    no tokens: one row of 0 tokens whose pack_id, slot and pack_offset are null. Repeated
    rows are packed each on its own, null ids too. Ties in length are broken by the rank. An
    empty table gives no rows; other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    length = F.coalesce(n_words(text_of(text_col)) if tokens is None else tokens, F.lit(0)).cast("long")
    lengths = docs.select(col(id_col).alias("doc_id"), F.greatest(length, F.lit(0)).alias("n"))
    pieces = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity).cast("int") - 1, F.lit(0)))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    pieces = materialize(pieces.select("doc_id", "piece", start.alias("piece_start"), F.least(F.col("n") - start, F.lit(capacity).cast("long")).cast("int").alias("piece_tokens")), "pieces")

    buckets = max(1, -(-pieces.count() // RANK_ROWS))
    full = pieces.where("piece_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.lit(17)), F.lit(buckets)))
    counts = materialize(full.groupBy("piece_tokens", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("piece_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    rows = in_blocks(placements(shortest_pack_first(histogram, capacity)), histogram)
    places = spark.createDataFrame([r for _, r in rows], "piece_tokens int, block long, low long, high long, run int, base long, first_slot int, first_offset int")
    if len(rows) <= BROADCAST_ROWS:
        places = F.broadcast(places)
    sizes = F.broadcast(spark.createDataFrame(sorted({(r[0], size) for size, r in rows}), "piece_tokens int, block_size long"))  # at most `capacity` rows

    before = Window.partitionBy("piece_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("piece_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("piece_tokens", "bucket").orderBy("doc_id", "piece")
    ranked = full.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["piece_tokens", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    nth = F.col("rank") - F.col("low")
    ranked = ranked.join(sizes, "piece_tokens").withColumn("block", F.floor(F.col("rank") / F.col("block_size")))
    placed = ranked.join(places, ["piece_tokens", "block"]).where("rank >= low and rank < high").select(
        "doc_id", "piece", "piece_start", "piece_tokens",
        (F.col("base") + F.floor(nth / F.col("run"))).cast("long").alias("pack_id"),
        (F.col("first_slot") + nth % F.col("run")).cast("int").alias("slot"),
        (F.col("first_offset") + (nth % F.col("run")) * F.col("piece_tokens")).cast("int").alias("pack_offset"),
    )
    nothing = pieces.where("piece_tokens <= 0").select("doc_id", "piece", "piece_start", "piece_tokens", F.lit(None).cast("long").alias("pack_id"), F.lit(None).cast("int").alias("slot"), F.lit(None).cast("int").alias("pack_offset"))
    return placed.unionByName(nothing)
