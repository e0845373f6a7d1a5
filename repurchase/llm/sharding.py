"""Sharding by balanced label propagation.

Documents are nodes, and documents of one link group (equal texts) are neighbours of each other. A label is a
shard. Each round counts the members of every group per shard, which stands for all edges of the group at once;
members elsewhere ask to move to the shards with most neighbours that still have room; requests are admitted by
gain until the quota of the shard is used up, round by round until none moves. Groups larger than a shard fill several
ones. Groups that would fit into a shard but are still cut then move as a whole, like single documents of their size; with
documents without neighbours, and members that shards above their quota give back, they are dealt out by falling size
so that all shards end with nearly equal bytes.

Defined results: a null text counts 16 bytes, has checksum 0 and no neighbours; rows with a null or repeated doc_id
are rows of their own; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repurchase.llm.storage import spread, stored, with_start

OVERHEAD_BYTES = 16
# Rounds at most; propagation ends when a round moves nothing.
ROUNDS = 8
# Groups of up to this share of a shard are kept whole.
WHOLE = 1 / 8
# Levels of priority within which requests are admitted as a whole, or by the same fraction.
LEVELS = 512


def prepare(documents: DataFrame) -> DataFrame:
    """row, doc_id, size, text_crc32, link (key of the group or null)."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return stored(
        documents.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.octet_length(body) + OVERHEAD_BYTES).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5("text").alias("link"),
        )
    )


def unit(*keys: str | Column) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def loads(state: DataFrame, shards: int) -> list[int]:
    """Bytes per shard: as many numbers as there are shards."""
    found = {r[0]: int(r[1]) for r in state.groupBy("shard").agg(F.sum("size")).collect()}
    return [found.get(j, 0) for j in range(shards)]


def of_shard(values: list, shard: str | Column) -> Column:
    """The value that a list with one entry per shard holds for a shard."""
    column = F.col(shard) if isinstance(shard, str) else shard
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), column + 1)


def propagate(linked: DataFrame, shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id, size, link -> the same rows with a shard."""
    state = stored(linked.withColumn("shard", spread("row", F.lit(1), buckets=shards)))
    for turn in range(rounds):
        room = [max(0.0, quota - x) for x in loads(state, shards)]
        votes = state.groupBy("link", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        # What a group may put into a shard: what it has there and the room; shards by number of neighbours.
        fits = F.col("bytes") + of_shard(room, "shard")
        likes = Window.partitionBy("link").orderBy(F.col("n").desc(), F.xxhash64("link", "shard"))
        earlier = likes.rowsBetween(Window.unboundedPreceding, -1)
        wanted = (
            votes.withColumn("before", F.coalesce(F.sum(fits).over(earlier), F.lit(0.0)))
            .withColumn("all", F.sum("bytes").over(Window.partitionBy("link")))
            .withColumn("goal", F.greatest(F.least(fits, F.col("all") - F.col("before")), F.lit(0.0)))
            .withColumn("more", F.greatest(F.col("goal") - F.col("bytes"), F.lit(0.0)))
        )
        # One row per group: which shards give members away, and the shares of those that receive.
        groups = wanted.groupBy("link").agg(
            F.map_from_entries(F.collect_list(F.struct("shard", F.struct("n", "bytes", "goal")))).alias("held"),
            F.array_sort(F.collect_list(F.when(F.col("more") > 0, F.struct(F.col("shard"), "more", "n")))).alias("to"),
            F.sum("more").alias("asked"),
        )
        sums = F.aggregate(
            "to",
            F.struct(F.lit(0.0).alias("end"), F.array().cast("array<struct<end:double,shard:int,n:bigint>>").alias("list")),
            lambda a, x: F.struct(
                (a["end"] + x["more"]).alias("end"),
                F.concat(a["list"], F.array(F.struct((a["end"] + x["more"]).alias("end"), x["shard"].alias("shard"), x["n"].alias("n")))).alias("list"),
            ),
        )["list"]
        # Stored, so that the join has an exchange of its own on both sides and a hot group can be split.
        groups = stored(groups.where("asked > 0").withColumn("to", sums))
        own = F.element_at("held", F.col("shard"))
        leaves = (own["bytes"] > own["goal"]) & (F.col("pick") >= own["goal"] / own["bytes"])
        place = F.element_at(F.filter("to", lambda x: x["end"] >= F.col("point")), 1)
        asking = (
            state.join(groups, "link")
            .withColumn("pick", unit("row", F.lit(f"pick{turn}")))
            .where(leaves)
            .withColumn("point", unit("row", F.lit(f"point{turn}")) * F.col("asked"))
            .withColumn("place", place)
            .select(
                "row", "size", F.col("place.shard").alias("to"),
                # Requests with more neighbours to gain come first.
                F.least(F.floor(F.log2(F.greatest(F.col("place.n") - own["n"], F.lit(0)) + 1)), F.lit(31)).alias("gain"),
            )
            .where("to is not null")
            .withColumn("level", -F.col("gain") * LEVELS + spread("row", F.lit(f"level{turn}"), buckets=LEVELS))
        )
        asking = stored(asking)
        by_level = asking.groupBy("to", "level").agg(F.sum("size").alias("bytes"))
        first = Window.partitionBy("to").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        admitted = by_level.select(
            "to", "level",
            ((of_shard(room, "to") - F.coalesce(F.sum("bytes").over(first), F.lit(0))) / F.col("bytes")).alias("share"),
        ).where("share > 0")
        moves = stored(
            asking.join(admitted, ["to", "level"])
            .where(unit("row", F.lit(f"admit{turn}")) < F.col("share"))
            .select("row", F.col("to").alias("new"))
        )
        if moves.isEmpty():
            break
        state = stored(
            state.join(moves, "row", "left").withColumn("shard", F.coalesce("new", "shard").cast("int")).drop("new")
        )
    return state


def level_out(free: DataFrame, used: list[int], quota: float, shards: int, buckets: int, classes: int = 10) -> DataFrame:
    """Deal documents out to the room that is left: large ones first, each later size class evens out the former.

    Within a class, documents follow each other in a hashed order along the room of the shards.
    """
    octave = F.floor(F.log2(F.col("size")))
    top = free.agg(F.max(octave)).first()[0]
    if top is None:
        return free.withColumn("shard", F.lit(0))
    free = free.withColumn("class", F.least(F.lit(int(top)) - octave, F.lit(classes - 1)).cast("int")).withColumn(
        "bucket", spread("row", F.lit(5), buckets=buckets)
    )
    placed = stored(with_start(free, ["class"], "bucket", ["row"], "size", "start"))
    totals = {r[0]: int(r[1]) for r in placed.groupBy("class").agg(F.sum("size")).collect()}
    parts = []
    for k in sorted(totals):
        rooms = [max(0.0, quota - x) for x in used]
        if sum(rooms) <= 0:
            rooms = [1.0] * shards
        scale = totals[k] / sum(rooms)
        ends, at = [], 0.0
        for r in rooms:
            at += r * scale
            ends.append(at)
        middle = F.col("start") + F.col("size") / 2
        bounds = F.array(*[F.lit(float(e)) for e in ends[:-1]])
        part = stored(
            placed.where(F.col("class") == k).withColumn("shard", F.size(F.filter(bounds, lambda e: e <= middle)))
        )
        used = [a + b for a, b in zip(used, loads(part, shards))]
        parts.append(part)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def shard_documents(documents: DataFrame, shards: int = 40, rounds: int = ROUNDS, buckets: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = prepare(documents)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    quota = total / shards
    # Stored, as the groups of propagate().
    linked_keys = stored(rows.where("link is not null").groupBy("link").count().where("count > 1").select("link"))
    linked = rows.join(linked_keys, "link", "left_semi")
    alone = rows.join(linked_keys, "link", "left_anti")
    state = propagate(linked.select("row", "size", "link"), shards, quota, rounds)
    held = loads(state, shards)
    keep = of_shard([min(1.0, quota / x) if x else 1.0 for x in held], "shard")
    groups = stored(
        state.groupBy("link").agg(
            F.sum("size").alias("bytes"), F.min("row").alias("first"), (F.min("shard") != F.max("shard")).alias("cut")
        )
    )
    state = state.join(groups, "link")
    whole = F.col("bytes") <= quota * WHOLE
    # Small groups stay or go as one.
    drawn = F.when(whole, unit("link", F.lit("stay"))).otherwise(unit("row", F.lit("stay")))
    state = stored(state.withColumn("whole", whole).withColumn("stays", ~(whole & F.col("cut")) & (drawn < keep)))
    kept = state.where("stays").select("row", "shard", "size")
    used = loads(kept, shards)
    units = state.where("not stays and whole and row = first").select("row", "link", F.col("bytes").alias("size"))
    placed = stored(level_out(stored(units.select("row", "size")), used, quota, shards, buckets))
    used = [a + b for a, b in zip(used, loads(placed, shards))]
    shard_of_link = stored(units.select("row", "link").join(placed.select("row", "shard"), "row").select("link", "shard"))
    moved = state.where("not stays and whole").select("row", "link").join(shard_of_link, "link")
    free = alone.select("row", "size").unionByName(state.where("not stays and not whole").select("row", "size"))
    filled = level_out(stored(free), used, quota, shards, buckets)
    shard_of = kept.select("row", "shard").unionByName(moved.select("row", F.col("shard").cast("int").alias("shard")))
    shard_of = shard_of.unionByName(filled.select("row", F.col("shard").cast("int").alias("shard")))
    out = stored(
        rows.join(shard_of, "row")
        .withColumn("bucket", spread("row", F.lit(9), buckets=buckets))
        .withColumn("one", F.lit(1).cast("long"))
    )
    slots = with_start(out, ["shard"], "bucket", ["row"], "one", "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
