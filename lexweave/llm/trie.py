"""The prefix trie of conversations, built level by level.

A conversation is a sequence of turns (role, text); a node is a distinct sequence of
first turns. Its id is its depth and the smallest conversation that begins with it.

Down: at each depth the live conversations are grouped by (parent node, next turn);
the smallest id of a group is its node. A conversation is live while it shares its
node with a different one: equal conversations are one class from the start, with
their number, and a class alone at its node is a chain to its end, which is written
out at once. So there are as many levels as turns that two different conversations
share, not as the longest has. Up: from the deepest level, children are summed by
parent and joined to the level above.

Keys that many rows have (a first turn that a third of the conversations share) are
counted with partial aggregation, and their node comes to their rows by a broadcast:
a key is hot if it has over a HOT_SHARE-th of the rows, so fewer than HOT_SHARE keys
are. The others meet in a shuffle. A conversation of very many turns is dealt in
blocks of BLOCK turns; turns get their positions from a range sort and counts of
the partitions before. Conversations that end at a node are hashed in order of their
ids as a stream of pieces, since SHA-256 can't be joined from parts; nothing is
gathered.

Turns are compared by SHA-256 of role and text; conversations of equal length by two
64-bit sums of hashes of their turns (a chance of collision of some n * n / 2**129).

Defined cases: null role or text is empty; turns go by turn number, null first, then
by role, then by the SHA-256 of the text; repeated rows are turns each; rows without
conv_id take no part; an empty table gives an empty result; further columns are left
out of the plan and can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, small_batches

BLOCK = 1 << 16
#: Ids that are joined into one piece of text.
PIECE_BITS = 13
HOT_LEAST, HOT_SHARE = 2_000, 1_000
NOTHING = hashlib.sha256(b"").hexdigest()


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in the order of ``keys``, with ``seq``: it grows along them, without gaps within a partition."""
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id())


def positions(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns(conv_id, at, key, bytes), at from 1, and members(conv_id, turns)."""
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    slim = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    # equal rows may be dealt over partitions, hence the last key
    order = ("conv_id", "turn", "role", "digest", "row")
    sorted_ = _numbered(slim.withColumn("row", F.monotonically_increasing_id()), *order)
    placed = cut(sorted_.select("conv_id", "seq", F.unhex(F.sha2(F.concat("digest", "role"), 256)).alias("key"), "bytes"))
    chunk = F.shiftright("seq", 33)
    runs = placed.groupBy("conv_id", chunk.alias("chunk")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv_id", "chunk", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    turns = placed.withColumn("chunk", chunk).join(starts, ["conv_id", "chunk"]).select("conv_id", (F.col("seq") + F.col("shift")).alias("at"), "key", "bytes")
    return turns, runs.groupBy("conv_id").agg(F.sum("n").alias("turns"))


def shared_openings(turns: DataFrame, members: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation c begins with the first h turns of conversation c - c % every and
    goes on with its own after its first h; h is crc32 of the id modulo ``most``."""
    base = members.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    info = members.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(base, "base", "left")
    info = cut(info.select("conv_id", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken")))
    shift = F.col("taken") - F.col("h")
    # h and taken lie next to the id in blocks of its turns, so that a long conversation is not one key
    own = turns.withColumn("block", F.expr(f"at div {BLOCK}"))
    blocks = members.join(info, "conv_id").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"turns div {BLOCK}"))).alias("block"))
    own = own.join(blocks, ["conv_id", "block"]).filter("at > h").select("conv_id", (F.col("at") + shift).alias("at"), "key", "bytes")
    heads = turns.filter((F.col("at") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(info.select("conv_id", "base", "h"), "base").filter("at <= h").select("conv_id", "at", "key", "bytes")
    return cut(own.union(heads)), info.select("conv_id")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each class's pieces, which come in order."""
    at, digest = None, None
    for batch in batches:
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if rep != at:
                if digest:
                    yield pa.record_batch([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], ["rep", "stream"])
                at, digest = rep, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
    if digest:
        yield pa.record_batch([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], ["rep", "stream"])


def classes_of(turns: DataFrame, members: DataFrame) -> DataFrame:
    """rep, n, len, ends: conversations of equal turns, by the smallest of them; ends is the hash of their ids."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "at", "key"))
    marks = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), mark(1).alias("x"), mark(2).alias("y"))
    kind = ["len", "x", "y"]
    keyed = members.join(marks, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in kind])
    sorted_ = _numbered(keyed, *kind, "conv_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = cut(sorted_.groupBy(*kind, F.shiftright("seq", PIECE_BITS).alias("piece")).agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"), listed.alias("ids")))
    classes = pieces.groupBy(*kind).agg(F.min("first").alias("rep"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces"), F.min(F.when(F.length("ids") < BLOCK, F.sha2("ids", 256))).alias("single"))
    several = classes.filter("pieces > 1 or single is null").select(*kind, "rep")
    ordered = pieces.join(several, kind).repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids")
    with small_batches(turns.sparkSession):
        streamed = cut(ordered.mapInArrow(_hash_pieces, "rep long, stream string"))
    return cut(classes.join(streamed, "rep", "left").select("rep", "n", "len", F.coalesce("stream", "single").alias("ends")))


def _meet(rows: DataFrame, one: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with what ``one`` has for their keys; ``classes`` in ``one`` tells how many rows a key has."""
    edge = max(HOT_LEAST, total // HOT_SHARE)
    if total <= edge:
        return rows.join(one, keys)
    hot = F.broadcast(one.filter(F.col("classes") > edge))  # fewer than HOT_SHARE rows
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(one.filter(F.col("classes") <= edge), keys))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.
    ``members`` (conv_id) may name conversations without turns."""
    classes = classes_of(turns, members)
    whole = classes.agg(F.min("rep").alias("root"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.sum(F.when(F.col("len") > 0, 1).otherwise(0)).alias("live"), F.max(F.when(F.col("len") == 0, F.col("ends"))).alias("ends")).first()
    if whole["root"] is None:
        return _out(classes.withColumns({c: F.col("n") for c in ("depth", "parent", "n_convs", "kids", "leaves", "saved")}).withColumnRenamed("rep", "node"))
    blocks = classes.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"len div {BLOCK}"))).alias("block"))
    mine = turns.withColumn("block", F.expr(f"at div {BLOCK}")).withColumnRenamed("conv_id", "rep").join(blocks, ["rep", "block"])
    # by position, so that a level reads its own part of the files
    mine = cut(mine.repartitionByRange("at", "rep").sortWithinPartitions("at", "rep"))

    spark = turns.sparkSession
    # one folder for all levels of each direction, so that all of them are one scan
    down, up = new_path(spark), new_path(spark)

    def every_level(path: str, one: DataFrame) -> DataFrame:
        return spark.read.schema(f"{', '.join(' '.join(x) for x in one.dtypes)}, depth long").parquet(path)

    # down
    live, alive, levels = classes.filter("len > 0").select("rep", F.lit(whole["root"]).cast("long").alias("parent"), "n", "len"), whole["live"], []
    while alive:
        depth = len(levels) + 1
        step = live.join(mine.filter(F.col("at") == depth).select("rep", "key", "bytes"), "rep")
        if alive > HOT_LEAST:  # read three times below
            step = cut(step)
        nodes = step.groupBy("parent", "key").agg(
            F.min("rep").alias("node"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("classes"), F.max(F.when(F.col("len") == depth, F.col("rep"))).alias("ended")
        )
        levels.append(cut(_meet(step, nodes, ["parent", "key"], alive).select("rep", "parent", "node", "n_convs", "classes", "ended", "bytes", "n", "len"), f"{down}/depth={depth}"))
        live = levels[-1].filter((F.col("classes") > 1) & (F.col("len") > depth)).select("rep", F.col("node").alias("parent"), "n", "len")
        alive = live.count()

    # what is alone from some depth on
    chain_rows = None
    if levels:
        chains = every_level(down, levels[0]).filter("classes = 1").select("rep", "parent", "n", "len", F.col("depth").alias("begin"))
        chains = cut(chains.join(classes.select("rep", "ends"), "rep"))
        spread = chains.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {BLOCK}"), F.expr(f"len div {BLOCK}"))))
        chain_rows = mine.join(spread, ["rep", "block"]).filter("at >= begin")
        several = chain_rows.filter("n > 1")
        below = Window.partitionBy("rep", "block").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
        later = Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        sums = several.groupBy("rep", "block").agg(F.sum("bytes").alias("bytes"))
        after = sums.select("rep", "block", F.coalesce(F.sum("bytes").over(later), F.lit(0)).alias("after"))
        several = several.withColumn("here", F.sum("bytes").over(below)).join(after, ["rep", "block"]).withColumn("saved", (F.col("n") - 1) * (F.col("here") + F.col("after")))
        chain_rows = several.drop("here", "after").unionByName(chain_rows.filter("n = 1").withColumn("saved", F.lit(0).cast("long")))
        chain_rows = cut(chain_rows.select(
            F.col("rep").alias("node"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("begin"), F.col("parent")).otherwise(F.col("rep")).alias("parent"), F.col("n").alias("n_convs"),
            F.when(F.col("at") < F.col("len"), 1).otherwise(0).alias("kids"), F.lit(1).alias("leaves"), "saved", F.when(F.col("at") == F.col("len"), F.col("ends")).alias("ends"), (F.col("at") == F.col("begin")).alias("head"),
        ))

    # up
    trunks, sums = [], None
    for depth in range(len(levels), 0, -1):
        own = levels[depth - 1].filter("classes > 1 and rep = node").withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
        own = own.join(sums, own["node"] == sums["above"], "left") if sums is not None else own.withColumns({c: F.lit(None).cast("long") for c in ("kids", "leaves", "saved")})
        trunks.append(cut(own.select("node", "parent", "n_convs", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved"), "ended"), f"{up}/depth={depth}"))
        heads = chain_rows.filter(F.col("head") & (F.col("depth") == depth)).select("parent", F.lit(1).alias("leaves"), "saved")
        sums = trunks[-1].select("parent", "leaves", "saved").unionByName(heads).groupBy(F.col("parent").alias("above")).agg(F.count(F.lit(1)).alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    top = classes.sparkSession.createDataFrame([(whole["root"], 0, None, whole["n"], whole["ends"])], "node long, depth long, parent long, n_convs long, ends string")
    top = top.join(sums, top["node"] == sums["above"], "left") if sums is not None else top.withColumns({c: F.lit(None).cast("long") for c in ("kids", "leaves", "saved")})
    result = _out(top.withColumns({"kids": F.coalesce("kids", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))}))
    if chain_rows is not None:
        result = result.unionByName(_out(chain_rows))
    if not trunks:
        return result
    shared = every_level(up, trunks[0])
    # nodes at which nothing ends have no key
    ends = classes.select(F.col("rep").alias("ended"), "ends")
    return result.unionByName(_out(shared.filter("ended is not null").join(ends, "ended"))).unionByName(_out(shared.filter("ended is null").withColumn("ends", F.lit(None).cast("string"))))


def _out(rows: DataFrame) -> DataFrame:
    long: list[Column] = [F.col(c).cast("long").alias(name) for c, name in (
        ("node", "conv_id"), ("depth", "depth"), ("parent", "parent_conv_id"), ("n_convs", "n_convs"), ("kids", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    return rows.select(*long, F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))
