"""Sharding by balanced label propagation, under the law of rows: shard counts are at most one apart.

Documents with equal texts are linked. Labels begin as a hash of the document. In each round a group's members ask for the shard
where most of their neighbours are and there is room; a group larger than the room of one shard asks for as many as it needs,
and each of its members for one of those. A shard takes a fraction of what asks, so that its quota of linked documents holds;
members in a shard that their group has settled stay. At the end the counts are made even: documents without links
move first, then the ends of groups. All rounds are joins and aggregations over (document, group) rows; the driver sees the
sizes of the shards alone.

Defined results: null text: size 16, the checksum of no bytes, linked with nothing (nor are empty texts with null ones).
Null doc_id: a row like any other. Repeated rows: rows of one group. Fewer rows than shards: some shards are empty.
Other columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import ranked, settle


def _table(spark, values: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(values, schema))  # one row for each shard


def propagate(members: DataFrame, shards: int, capacity: float, rounds: int = 4) -> DataFrame:
    """id, gid, shard: labels of linked members (id, gid, shard) after so many rounds, about ``capacity`` in a shard."""
    spark = members.sparkSession
    for turn in range(rounds):
        held = members.groupBy("gid", "shard").agg(F.count("*").alias("n"))
        held = settle(held)
        sizes = dict(held.groupBy("shard").agg(F.sum("n")).collect())
        room = {s: max(0.0, capacity - sizes.get(s, 0)) for s in range(shards)}
        if sum(room.values()) < 1:
            break
        widest = max(room.values())
        # A group's settled shards: the largest holdings that together have room for all of it.
        rooms = _table(spark, [(s, float(r)) for s, r in room.items()], "shard int, room double")
        total = Window.partitionBy("gid")
        ranks = total.orderBy(F.desc("n"), F.xxhash64("gid", "shard"))
        goals = held.join(rooms, "shard").withColumn("all", F.sum("n").over(total)).withColumn("r", F.row_number().over(ranks))
        goals = goals.where(F.col("r") <= F.ceil(F.col("all") / F.greatest(F.lit(widest), F.lit(1.0))))
        goals = goals.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("r", "shard"))).alias("goals"))  # at most one a shard
        pick = F.pmod(F.xxhash64("id", F.lit(turn)), F.size("goals").cast("long")).cast("int")
        ask = members.join(goals, "gid").withColumn("goal", F.when(F.exists("goals", lambda g: g["shard"] == F.col("shard")), F.col("shard")).otherwise(F.get("goals", pick)["shard"]))
        ask = settle(ask.select("id", "gid", "shard", "goal"))
        demand = dict(ask.where("goal <> shard").groupBy("goal").agg(F.count("*")).collect())
        if not demand:
            break
        # Quotas count what leaves as well: room now, and what others take away from here.
        leave = dict(ask.where("goal <> shard").groupBy("shard").agg(F.count("*")).collect())
        share = {s: min(1.0, (room[s] + 0.5 * leave.get(s, 0)) / d) for s, d in demand.items()}
        shares = _table(spark, [(s, float(x)) for s, x in share.items()], "goal int, share double")
        luck = F.pmod(F.xxhash64("gid", "id", F.lit(turn + 100)), F.lit(1 << 30)) / float(1 << 30)
        move = (F.col("goal") != F.col("shard")) & (luck < F.coalesce("share", F.lit(0.0)))
        members = ask.join(shares, "goal", "left").select("id", "gid", F.when(move, F.col("goal")).otherwise(F.col("shard")).alias("shard"))
        members = settle(members)
    return members


def assign(docs: DataFrame, shards: int = 40, rounds: int = 4, id: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size, a row for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    digest = F.sha2(text, 256)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(digest).alias("gid"), F.xxhash64(F.reverse(digest), F.lit(7)).alias("gid2"), digest.isNull().alias("alone"),
    )
    # A row's own number, so that rows repeated with one doc_id move apart; settled, so that it never changes.
    rows = settle(rows.withColumn("id", F.monotonically_increasing_id()))
    groups = rows.where("not alone").groupBy("gid", "gid2").agg(F.count("*").alias("n")).where("n > 1").withColumn("group", F.xxhash64("gid", "gid2"))
    rows = rows.join(groups, ["gid", "gid2"], "left").withColumn("n", F.when(~F.col("alone"), F.col("n")))
    rows = settle(rows.select("id", "doc_id", "size", "text_crc32", "group", F.coalesce("n", F.lit(1)).alias("group_size"), F.pmod(F.xxhash64("doc_id", "id"), F.lit(shards)).cast("int").alias("shard")))
    total = rows.count()
    linked = rows.where("group is not null").select("id", F.col("group").alias("gid"), "shard")
    linked = propagate(settle(linked), shards, total / shards, rounds)
    free = rows.where("group is null").select("id", F.lit(None).cast("long").alias("gid"), "shard")
    # Free documents last: what stands beyond a shard's target leaves it, and groups' ends before whole groups.
    placed = linked.select("id", "gid", "shard").union(free)
    target = [total // shards + (s < total % shards) for s in range(shards)]
    order = [F.col("gid").isNull(), F.col("gid"), F.col("id")]
    first = linked.groupBy("shard").agg(F.count("*").alias("linked"))
    linked_n = {s: n for s, n in first.collect()}
    a = ranked(placed.where("gid is not null"), ["shard"], order, "rank")
    b = ranked(placed.where("gid is null"), ["shard"], order, "rank")
    ahead = _table(spark, [(s, linked_n.get(s, 0), target[s]) for s in range(shards)], "shard int, ahead long, target long")
    b = b.join(ahead, "shard").withColumn("rank", F.col("rank") + F.col("ahead")).select("id", "gid", "shard", "rank", "target")
    a = a.join(ahead, "shard").select("id", "gid", "shard", "rank", "target")
    both = settle(a.union(b))
    stays = both.where("rank < target").select("id", "shard", F.col("rank").alias("slot"))
    have = dict(both.where("rank < target").groupBy("shard").agg(F.count("*")).collect())
    gaps, at = [], 0
    for s in range(shards):
        if (n := target[s] - have.get(s, 0)) > 0:
            gaps.append((s, at, at + n, have.get(s, 0)))
            at += n
    moved = ranked(both.where("rank >= target").select("id", "gid", F.lit(0).alias("one")), ["one"], [F.col("gid"), F.col("id")], "k")
    if gaps:
        spots = _table(spark, gaps, "to int, low long, high long, base long")
        moved = moved.join(spots, (F.col("k") >= F.col("low")) & (F.col("k") < F.col("high"))).select("id", F.col("to").alias("shard"), (F.col("k") - F.col("low") + F.col("base")).alias("slot"))
    else:
        moved = moved.select("id", F.lit(0).alias("shard"), F.col("k").alias("slot"))
    out = rows.drop("shard").join(stays.union(moved), "id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_size")
