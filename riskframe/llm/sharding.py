"""Shards of equal row counts that keep linked documents together: balanced label propagation.

Documents of one link group (equal texts, for the query) are neighbours of each other. Every round
counts each group's documents by shard, joins the counts back to the documents, and moves documents
towards the shard that holds most of their neighbours, as far as its quota lasts. Small groups that
lie in one shard make room for them: together they cut no edge wherever they are, so they go to the shards
that the arriving documents leave. Documents without neighbours fill the gaps at the end, so that shard
counts differ by one row at most; what does not fit goes by group.

Groups with a thousandth of all rows or more are at most 1000, so their counts are broadcast and
their documents never meet in one task; the other groups are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import HOT_SHARE, bits_for, discard, join_skewed, numbered, stored, whole_text

SHARDS = 16
ROUNDS = 16
#: A group takes no more rows into a shard of which it has this part.
FILLED = 0.9
ROWS_PER_SLICE = 200_000


def _unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _quota(share: dict[tuple[int, int], float], shards: int) -> Column:
    """Share of the wishes from one shard to another that is granted, as a flat table."""
    return F.array(*[F.lit(float(share.get((s, t), 0.0))) for s in range(shards) for t in range(shards)])


def _is_small(capacity: int) -> Column:
    return F.col("n") * 8 < capacity


def _by_group(capacity: int) -> Column:
    """Order that has the rows of large groups first, spread, and then small groups one after the other."""
    doc, positive = F.xxhash64("gid", "doc_id", "text_crc32"), F.lit((1 << 63) - 1)
    group = F.shiftleft(F.shiftright(F.xxhash64("gid"), 24), 24).bitwiseAND(positive)
    return F.when(_is_small(capacity), group.bitwiseOR(F.shiftrightunsigned(doc, 40))).otherwise(
        doc.bitwiseOR(F.lit(-(1 << 63))))


def _propagate(linked: DataFrame, hot: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """Rounds of moves among linked documents; a shard takes about ``capacity`` of them at most."""
    state = stored(linked.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")),
                   "shards")
    total = state.count()
    closed: set[int] = set()  # shards that have hardly a settled group left to make room for a large one
    for turn in range(rounds):
        held = {r["shard"]: r["n"] for r in
                state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = {s: max(0, capacity - held.get(s, 0)) for s in range(shards)}
        neighbours = state.groupBy("gid").agg(F.first("n").alias("n"), F.array(
            *[F.sum((F.col("shard") == s).cast("long")) for s in range(shards)]).alias("held"))
        # the shard with most neighbours, passing over those that the group fills by itself; of equal counts,
        # small groups take a shard that is not overfull, then a hash decides, so that groups spread evenly
        open_to = F.array(*[F.lit(2.0 if held.get(s, 0) <= capacity else 0.0) for s in range(shards)])

        def appeal(shard: Column) -> Column:
            return F.when(_is_small(capacity), F.get(open_to, shard)).otherwise(0.0) + _unit("gid", shard)

        best = F.greatest(*[F.struct(
            F.when((F.col("held")[s] < FILLED * capacity) & (_is_small(capacity) | F.lit(s not in closed)),
                   F.col("held")[s]).otherwise(F.lit(-1)).alias("n"),
            appeal(F.lit(s)).alias("u"), F.lit(s).alias("s")) for s in range(shards)])
        votes = neighbours.select("gid", "held", best.alias("best"))
        wish = (join_skewed(state, votes, hot, "gid")
                .withColumn("want", F.when(
                    (F.col("best.s") != F.col("shard"))
                    & (F.struct(F.col("best.n"), F.col("best.u"))
                       > F.struct(F.get("held", F.col("shard")), appeal(F.col("shard")))), F.col("best.s")))
                .withColumn("settled", _is_small(capacity) & (F.get("held", F.col("shard")) == F.col("n")))
                .drop("held", "best"))
        wish = stored(wish, "wishes")
        free = {r["shard"]: r["n"] for r in wish.where("settled").groupBy("shard")
                .agg(F.count(F.lit(1)).alias("n")).collect()}
        asked = {(r["shard"], r["want"]): r["n"] for r in wish.where("want is not null")
                 .groupBy("shard", "want").agg(F.count(F.lit(1)).alias("n")).collect()}
        # two shards exchange as many rows as both ask for; free room takes more
        swapped = {(s, t): min(n, asked.get((t, s), 0)) for (s, t), n in asked.items()}
        over = {t: sum(n - swapped[x, y] for (x, y), n in asked.items() if y == t) for t in range(shards)}
        share = {(s, t): min(1.0, (swapped[s, t] + room[t] * (n - swapped[s, t]) / max(1, over[t])) / n)
                 for (s, t), n in asked.items()}
        # settled groups of a shard give way to what is still not granted
        unmet = {(s, t): n * (1 - share[s, t]) for (s, t), n in asked.items()}
        given, shut = {}, set()
        for t in range(shards):
            # and an overfull one sends some of them where room is left
            relief = min(max(0, held.get(t, 0) - capacity), free.get(t, 0))
            due = sum(unmet.get((s, t), 0) for s in range(shards))
            if (free.get(t, 0) - relief) * 20 <= capacity:
                shut.add(t)
            for s in range(shards):
                rows = unmet.get((s, t), 0) * min(1, (free.get(t, 0) - relief) / max(1, due))
                given[t, s] = (rows + relief * room[s] / max(1, sum(room.values()))) / max(1, free.get(t, 0))
                if rows:
                    share[s, t] += rows / asked[s, t]
        ends = [sum(given[t, s] for s in range(last + 1)) for t in range(shards) for last in range(shards)]
        # groups move whole while they are small against a shard; documents of large groups one by one
        whole = _unit("gid", F.lit(turn))
        draw = F.when(_is_small(capacity), whole).otherwise(_unit("doc_id", F.lit(turn)))
        moves = F.col("want").isNotNull() & (
            draw < F.get(_quota(share, shards), F.col("shard") * shards + F.col("want")))
        mine = F.slice(F.array(*[F.lit(float(e)) for e in ends]), F.col("shard") * shards + 1, shards)
        passed = F.size(F.filter(mine, lambda e: e <= whole))
        gives_way = F.col("settled") & (passed < shards)
        moved = stored(wish.withColumn("shard", F.when(moves, F.col("want")).when(gives_way, passed).otherwise(
            F.col("shard"))).drop("want", "settled"), "shards")
        discard(state)
        discard(wish)
        state = moved
        if shut == closed and sum(n * share[pair] for pair, n in asked.items()) * 1000 < total:
            break
        closed = shut
    return state


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; the law is ``rows``.

    ``size`` is the text's UTF-8 bytes plus 1, null texts count as empty. Links join rows of equal
    text. Repeated rows and rows without doc_id are placed like any other; an empty table gives an
    empty result. Other columns, whatever their names, are ignored.
    """
    text = whole_text()
    base = stored(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("gid")),
        "documents")
    total = base.count()
    groups = stored(base.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    hot = groups.where(F.col("n") * HOT_SHARE >= total)
    linked = join_skewed(base, groups, hot, "gid")
    single = join_skewed(base, groups, hot, "gid", "left_anti")

    capacity = -(-total // shards)
    state = _propagate(linked, hot, shards, capacity, rounds)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = [s for s in range(shards) if held.get(s, 0) > quota[s]]
    bits = bits_for(total // shards, ROWS_PER_SLICE)
    columns = ["doc_id", "size", "text_crc32", "shard"]
    order = ["doc_id", "size", "text_crc32", "gid", "n"]

    ranked = numbered(state.where(F.col("shard").isin(over)), ["shard"], _by_group(capacity), bits, "rank")
    fits = F.col("rank") < F.get(F.array(*[F.lit(q) for q in quota]), F.col("shard"))
    ranked = stored(ranked.withColumn("fits", fits), "ranked")
    stay = (state.where(~F.col("shard").isin(over)).select(columns)
            .unionByName(ranked.where("fits").select(columns)))
    # rows without a place, numbered over all shards, fill the gaps from the first shard on
    loose = (single.withColumn("n", F.lit(1).cast("long")).select(order)
             .unionByName(ranked.where("not fits").select(order)).withColumn("all", F.lit(0)))
    loose = numbered(loose, ["all"], _by_group(capacity), bits_for(total, ROWS_PER_SLICE), "rank")
    shard, end = F.lit(None).cast("int"), 0
    ends = []
    for s in range(shards):
        end += quota[s] - min(held.get(s, 0), quota[s])
        ends.append(end)
    for s in reversed(range(shards)):
        shard = F.when(F.col("rank") < ends[s], F.lit(s)).otherwise(shard)
    placed = stay.unionByName(loose.withColumn("shard", shard).select(columns))
    slots = numbered(stored(placed, "placed"), ["shard"], F.xxhash64("doc_id", "text_crc32"), bits, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
