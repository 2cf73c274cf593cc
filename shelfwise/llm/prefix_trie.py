"""A z-fast trie over conversations, kept as tables.

A sequence of turns is known by fingerprints of its prefixes: 128 bits for each
depth, the XOR of a hash of (depth, turn) for the turns so far (with 10^12
prefixes the chance of any collision is about 10^-15). The compacted trie has a
node where sequences part or end; its edge covers the depths (parent, depth]
and holds their fingerprints. A node's handle is the prefix whose length is the
two-fattest number of its edge, the one divisible by the highest power of two.

Tables are joined on three keys of a node: the fingerprint of its handle, that
of the first prefix of its edge, and its own. ``locate`` finds where sequences
leave the trie by fat binary search: a join with the handles halves each one's
interval, so longest-sequence bits of rounds serve all sequences at once.
``insert`` takes a batch: edges that sequences leave midway are cut there, and
what lies beyond is built from the batch alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written

# (h, l): the fingerprint of a prefix; c: the code points of its turns. A node has its parent's as (th, tl, tc).
PATH = "array<struct<h:bigint,l:bigint,c:bigint>>"
NODE = f"parent int, depth int, th bigint, tl bigint, tc bigint, edge {PATH}"
# Conversations take their first turns from the one at the start of their block of ids.
BLOCK, MOST_SHARED = 100, 5
# Ids that one piece of an end's list can hold.
PIECE_IDS = 1 << 16


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the highest power of two."""
    top = F.floor(F.log2(low.bitwiseXOR(high).cast("double"))).cast("int")
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1), top))


def _at(path: str, depth: Column, part: str) -> Column:
    """A part of a prefix's fingerprint; the root's is 0."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.get(F.col(path), depth - 1)[part])


class ZFastTrie:
    """The compacted trie of the sequences inserted so far."""

    def __init__(self, spark: SparkSession):
        self.nodes, self.empty = spark.createDataFrame([], NODE), True

    def locate(self, strings: DataFrame) -> DataFrame:
        """``strings`` (first, length, path) with columns low, exit and matched.

        ``low`` is the depth of the last node whose whole prefix a sequence
        shares, ``exit`` the edge (or null) below it that shares more, and
        ``matched`` the depth up to which the trie has the sequence.
        """
        if self.empty:
            none = F.lit(0)
            return strings.select("first", "length", "path", none.alias("low"), F.lit(None).cast(PATH).alias("exit"), none.alias("matched"))
        longest = strings.agg(F.max("length")).first()[0] or 0
        handle = two_fattest(F.col("parent"), F.col("depth"))
        print_ = F.element_at("edge", -1)
        handles = self.nodes.select(
            F.col("depth").alias("nd"), F.col("parent").alias("np"), print_["h"].alias("nh"), print_["l"].alias("nl"), handle.alias("f"),
            F.get("edge", handle - F.col("parent") - 1)["h"].alias("fh"), F.get("edge", handle - F.col("parent") - 1)["l"].alias("fl"))
        rows = strings.withColumn("low", F.lit(0)).withColumn("high", F.col("length"))
        for _ in range(longest.bit_length()):
            f = F.when(F.col("low") < F.col("high"), two_fattest(F.col("low"), F.col("high")))
            rows = rows.withColumn("f", f).withColumn("fh", _at("path", f, "h")).withColumn("fl", _at("path", f, "l"))
            rows = rows.join(handles, ["f", "fh", "fl"], "left")
            depth = F.col("nd")
            whole = (depth <= F.col("length")) & (_at("path", depth, "h") == F.col("nh")) & (_at("path", depth, "l") == F.col("nl"))
            # A node whose handle fits but not its whole prefix is where the sequence leaves.
            low = F.when(depth.isNull(), F.col("low")).when(whole, depth).otherwise(F.col("np"))
            high = F.when(F.col("f").isNull() | whole, F.col("high")).when(depth.isNull(), F.col("f") - 1).otherwise(F.col("np"))
            rows = rows.select("first", "length", "path", low.alias("low"), high.alias("high"))
        after = F.when(F.col("low") < F.col("length"), F.col("low") + 1)
        edges = self.nodes.select((F.col("parent") + 1).alias("f"), F.get("edge", F.lit(0))["h"].alias("fh"),
                                  F.get("edge", F.lit(0))["l"].alias("fl"), F.col("edge").alias("exit"))
        rows = (rows.drop("high").withColumn("f", after).withColumn("fh", _at("path", after, "h")).withColumn("fl", _at("path", after, "l"))
                .join(edges, ["f", "fh", "fl"], "left"))
        rest = F.slice("path", F.col("low") + 1, F.size("exit"))
        same = F.filter(F.zip_with(rest, "exit", lambda a, b: (a["h"] == b["h"]) & (a["l"] == b["l"])), lambda x: x)
        return rows.select("first", "length", "path", "low", "exit",
                           (F.col("low") + F.when(F.col("exit").isNull(), 0).otherwise(F.size(same))).alias("matched"))

    def insert(self, strings: DataFrame) -> ZFastTrie:
        """Adds different sequences (first, length, path); ``first`` is any number that names one."""
        placed = written(self.locate(strings), "trie-placed")
        self.nodes, self.empty = written(self._cut(placed).unionByName(self._beyond(placed)), "trie-nodes"), False
        return self

    def _cut(self, placed: DataFrame) -> DataFrame:
        """The nodes so far, with edges cut where sequences leave or end midway."""
        midway = placed.where((F.col("low") < F.col("matched")) & (F.col("matched") < F.col("low") + F.size("exit")))
        cuts = (midway.select((F.col("low") + 1).alias("f"), F.get("exit", F.lit(0))["h"].alias("fh"), F.get("exit", F.lit(0))["l"].alias("fl"), "matched")
                .groupBy("f", "fh", "fl").agg(F.collect_set("matched").alias("cuts")))
        nodes = (self.nodes.withColumn("f", F.col("parent") + 1).withColumn("fh", F.get("edge", F.lit(0))["h"])
                 .withColumn("fl", F.get("edge", F.lit(0))["l"]).join(cuts, ["f", "fh", "fl"], "left"))
        ends = F.array_sort(F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("depth")))
        starts = F.concat(F.array("parent"), F.slice(ends, 1, F.size(ends) - 1))
        nodes = nodes.select("edge", "th", "tl", "tc", F.col("parent").alias("old"), F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("x"))
        return _nodes(nodes.select("edge", "old", "th", "tl", "tc", F.col("x.a").alias("parent"), F.col("x.b").alias("depth")))

    def _beyond(self, placed: DataFrame) -> DataFrame:
        """New nodes, below where the batch's sequences leave the trie."""
        new = placed.where(F.col("matched") < F.col("length"))
        depths = F.sequence(F.col("matched") + 1, F.col("length"))
        rows = new.select("first", F.explode(F.transform(depths, lambda d: F.struct(
            d.alias("d"), F.get("path", d - 1)["h"].alias("h"), F.get("path", d - 1)["l"].alias("l"),
            F.get("path", d).alias("next")))).alias("x")).select("first", "x.*")
        met = rows.groupBy("d", "h", "l").agg(
            F.min("first").alias("owner"), F.min("next").alias("one"), F.max("next").alias("other"), F.bool_or(F.col("next").isNull()).alias("ends"))
        met = met.where(F.col("ends") | (F.col("one") != F.col("other"))).select("d", "h", "l", "owner")
        ways = (rows.join(met, ["d", "h", "l"]).groupBy("first").agg(F.array_sort(F.collect_list(F.struct("d", "owner"))).alias("ends")))
        starts = F.concat(F.array("matched"), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda x: x["d"]))
        ways = (new.select("first", "path", "matched").join(ways, "first")
                .select("first", "path", F.explode(F.arrays_zip(starts.alias("a"), F.col("ends").alias("b"))).alias("x"))
                .where("x.b.owner = first"))
        root = [F.lit(0).cast("long").alias(x) for x in ("th", "tl", "tc")]
        return _nodes(ways.select(F.col("path").alias("edge"), F.lit(0).alias("old"), *root,
                                  F.col("x.a").alias("parent"), F.col("x.b.d").alias("depth")))


def _nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the depths (parent, depth], from edges that start at ``old`` under a prefix (th, tl, tc)."""
    before = F.get("edge", F.col("parent") - F.col("old") - 1)
    own = F.col("parent") == F.col("old")
    top = [F.when(own, F.col(f"t{x}")).otherwise(before[x]).alias(f"t{x}") for x in ("h", "l", "c")]
    return rows.select("parent", "depth", *top,
                       F.slice("edge", F.col("parent") - F.col("old") + 1, F.col("depth") - F.col("parent")).alias("edge"))


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, d, digest, c) of the rebuilt conversations, and (conv_id, 0, null, 0) for each of them.

    Turns stand by ``turn`` (null first), equal ones by role and the MD5 of the
    text. Conversation c begins with the first h turns of conversation
    c - c % 100 as it stands (all if it has fewer, none if there is no such) and
    goes on with its own turns after its first h, with h = crc32(c) % 6. A null
    role or text is empty; rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("text"), F.char_length(text).cast("long").alias("c"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("conv_id", "c", F.row_number().over(order).alias("pos"),
                       F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"))
    rows = written(rows, "trie-turns")
    heads = (rows.where((F.col("pos") <= MOST_SHARED) & (F.col("conv_id") % BLOCK == 0))
             .groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "c"))).alias("head")))
    shared = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).cast("int")
    convs = rows.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "base", "left")
    convs = written(convs.select("conv_id", shared.alias("h"), F.slice(F.coalesce("head", F.array()), 1, shared).alias("head")), "trie-convs")
    first = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.pos").alias("d"), "x.digest", "x.c")
    own = (rows.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos > h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("d"), "digest", "c"))
    roots = convs.select("conv_id", F.lit(0).alias("d"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("c"))
    return first.unionByName(own).unionByName(roots)


def sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different sequences (first, length, path, members, h, l), and (conv_id, length, h, l) of all conversations.

    ``turns`` has (conv_id, d, digest, c), as ``rebuilt_turns`` gives it. Only
    fingerprints are shuffled from here on; one conversation's (24 bytes a turn)
    make one row.
    """
    so_far = Window.partitionBy("conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    hashes = [F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), "d", "digest")).otherwise(0) for seed in (1, 2)]
    prints = turns.select("conv_id", "d", F.sum("c").over(so_far).alias("c"), F.bit_xor(hashes[0]).over(so_far).alias("h"),
                          F.bit_xor(hashes[1]).over(so_far).alias("l"))
    prints = written(prints, "trie-prints")
    convs = prints.groupBy("conv_id").agg(F.max(F.struct("d", "h", "l")).alias("x")).select("conv_id", F.col("x.d").alias("length"), "x.h", "x.l")
    convs = written(convs, "trie-ends")
    strings = convs.groupBy("length", "h", "l").agg(F.min("conv_id").alias("first"), F.count("*").alias("members"))
    paths = (prints.join(strings.select(F.col("first").alias("conv_id")), "conv_id", "left_semi").where("d > 0")
             .groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("d", "h", "l", "c"))).alias("p"))
             .select("first", F.transform("p", lambda x: F.struct(x["h"].alias("h"), x["l"].alias("l"), x["c"].alias("c"))).alias("path")))
    strings = strings.join(paths, "first", "left").withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    return written(strings, "trie-strings"), convs


def ends_digest(convs: DataFrame) -> DataFrame:
    """(length, h, l, ends): the SHA-256 of the comma-joined ids of the conversations that end at a node, ascending.

    Ids meet in pieces of a range of ``PIECE_IDS`` ids, which are hashed one after the other.
    """
    piece = F.floor(F.col("conv_id") / F.lit(PIECE_IDS).cast("decimal(20,0)")).cast("long")
    pieces = convs.groupBy("length", "h", "l", piece.alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, None, []
        for batch in batches:
            for length, h, l, ids in zip(*(batch.column(c).to_pylist() for c in ("length", "h", "l", "ids"))):
                if (length, h, l) == at:
                    sha.update(b",")
                else:
                    out += [(*at, sha.hexdigest())] if at else []
                    at, sha = (length, h, l), hashlib.sha256()
                sha.update(ids.encode())
            yield _rows(out)
            out = []
        yield _rows([(*at, sha.hexdigest())] if at else [])

    return (pieces.repartition("length", "h", "l").sortWithinPartitions("length", "h", "l", "piece")
            .mapInArrow(run, "length int, h long, l long, ends string"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["length", "h", "l", "ends"])


def build(strings: DataFrame, shares: tuple[int, ...] = (1, 8)) -> ZFastTrie:
    """The trie of all ``strings``, inserted in batches that end at ``shares`` of the last share: 1/8 and 7/8 of them."""
    trie, low = ZFastTrie(strings.sparkSession), 0
    part = F.pmod(F.xxhash64("first"), F.lit(shares[-1]))
    for high in shares:
        batch = strings.where((part >= low) & (part < high)).select("first", "length", "path")
        trie.insert(batch)
        low = high
    return trie


def expanded(trie: ZFastTrie, strings: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each prefix: the trie's edges, expanded depth by depth, with the numbers of their nodes."""
    key = ["d", "h", "l"]
    nodes = trie.nodes.withColumn("d", F.col("depth")).withColumn("h", F.element_at("edge", -1)["h"]).withColumn("l", F.element_at("edge", -1)["l"])
    kids = written(trie.nodes.groupBy(F.col("parent").alias("d"), F.col("th").alias("h"), F.col("tl").alias("l")).agg(F.count("*").alias("n_children")), "trie-kids")
    total = F.coalesce(F.try_element_at("path", F.lit(-1))["c"], F.lit(0).cast("long"))
    ends = strings.select(F.col("length").alias("d"), "h", "l", "first", "members", "path", total.alias("total"))
    ends = ends.join(kids, key, "left").withColumn("leaf", F.col("n_children").isNull().cast("long"))
    ends = written(ends.select("d", "h", "l", "first", "members", "path", "total", "leaf"), "trie-sequences")
    # after: a sequence's code points below a depth.
    way = ends.select("first", "members", "leaf", "total", F.posexplode("path").alias("pos", "x"))
    way = way.select("first", "members", "leaf", (F.col("pos") + 1).alias("d"), "x.h", "x.l", (F.col("total") - F.col("x.c")).alias("after"))
    way = written(way.join(nodes.select(key), key), "trie-ways")
    numbers = way.groupBy(key).agg(F.min("first").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
                                   F.sum(F.col("members") * F.col("after")).alias("spent"))
    numbers = written(numbers, "trie-numbers")
    # Each prefix's text counts once, for the least conversation that has it: a sequence's from some depth down.
    lists = (way.join(numbers.select(*key, "conv_id"), key).groupBy("first")
             .agg(F.array_sort(F.collect_list(F.struct("d", "h", "l", "conv_id", "after"))).alias("way")))
    shared = F.filter("way", lambda x: x["conv_id"] != F.col("first"))
    lists = ends.select("first", "total", "members", "leaf").join(lists, "first", "left").withColumn(
        "own", F.coalesce(F.try_element_at(shared, F.lit(-1))["after"], F.col("total")))
    lists = written(lists, "trie-lists")
    top = lists.agg(F.min("first").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
                    (F.sum(F.col("members") * F.col("total")) - F.sum("own")).alias("saved_tokens"))
    least = top.first()["conv_id"]
    steps = lists.select("first", "own", F.posexplode("way").alias("i", "x"), "way")
    steps = steps.select("x.d", "x.h", "x.l", F.least("own", "x.after").alias("once"),
                         F.when(F.col("x.conv_id") == F.col("first"), F.when(F.col("i") > 0, F.get("way", F.col("i") - 1)["conv_id"])).alias("above"))
    once = steps.groupBy(key).agg(F.sum("once").alias("once"), F.max("above").alias("above"))
    stops = written(ends_digest(convs).withColumnRenamed("length", "d"), "trie-stops")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = nodes.select(*key, "parent", "tc", "edge").join(numbers, key).join(once, key).join(kids, key, "left").join(stops, key, "left")
    # The code points above each depth of the edge.
    above = F.concat(F.array("tc"), F.transform(F.slice("edge", 1, F.size("edge") - 1), lambda x: x["c"]))
    rows = rows.select(*key, "parent", "conv_id", "n_convs", "n_leaves", "spent", "once", "above", "n_children", "ends",
                       F.element_at("edge", -1)["c"].alias("whole"), F.posexplode(above).alias("i", "c"))
    rows = rows.withColumn("last", F.col("d") == F.col("parent") + 1 + F.col("i"))
    # What lies on the edge at this depth and below, each text n_convs - 1 times, and what lies below the edge.
    on_edge = F.col("whole") - F.col("c")
    rows = rows.select(
        "conv_id", (F.col("parent") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("conv_id")).otherwise(F.coalesce("above", F.lit(least).cast("long"))).alias("parent_conv_id"), "n_convs",
        F.when(~F.col("last"), F.lit(1).cast("long")).otherwise(F.coalesce("n_children", F.lit(0).cast("long"))).alias("n_children"), "n_leaves",
        ((F.col("n_convs") - 1) * on_edge + F.col("spent") - F.col("once")).alias("saved_tokens"),
        F.when(F.col("last"), F.coalesce("ends", none)).otherwise(none).alias("ends_sha256"))
    below = kids.where("d = 0").agg(F.max("n_children")).first()[0] or 0
    turnless = stops.where("d = 0").agg(F.max("ends")).first()[0]
    root = top.where("conv_id IS NOT NULL").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.lit(below).cast("long").alias("n_children"), "n_leaves", "saved_tokens", (F.lit(turnless) if turnless else none).alias("ends_sha256"))
    return rows.unionByName(root)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """A row for each prefix of the rebuilt conversations of ``turns`` (conv_id, turn, role, text); none if there is no conversation."""
    strings, convs = sequences(rebuilt_turns(turns))
    return expanded(build(strings), strings, convs)


def conversation_trie_sql() -> str:
    """DuckDB SQL of ``conversation_trie``: prefixes as lists of digests, checksums byte by byte."""
    return f"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, pos, length(text) AS c, md5(length(role) || ':' || role || md5(text)) AS digest FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % {BLOCK} AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {MOST_SHARED + 1} AS h
  FROM (SELECT DISTINCT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM own), crc_table),
rebuilt AS (
  SELECT v.conv_id, 0 AS side, o.pos, o.c, o.digest FROM convs v JOIN own o ON o.conv_id = v.base AND o.pos <= v.h
  UNION ALL SELECT v.conv_id, 1, o.pos, o.c, o.digest FROM convs v JOIN own o ON o.conv_id = v.conv_id AND o.pos > v.h),
seqs AS (
  SELECT v.conv_id, coalesce(list(r.digest ORDER BY side, pos) FILTER (WHERE r.digest IS NOT NULL), []) AS p,
         coalesce(list(r.c ORDER BY side, pos) FILTER (WHERE r.digest IS NOT NULL), []) AS cs
  FROM convs v LEFT JOIN rebuilt r ON v.conv_id = r.conv_id GROUP BY v.conv_id),
prefixes AS (
  SELECT conv_id, d, array_to_string(p[1:d], ',') AS k, array_to_string(p[1:d - 1], ',') AS up, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS c, d = len(p) AS ends
  FROM (SELECT *, unnest(range(len(p) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, up),
full_nodes AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.k = k.k),
below AS (
  SELECT a.d, a.k, sum((n.n_convs - 1) * n.c) AS saved, count(*) FILTER (WHERE n.n_children = 0) AS leaves
  FROM (SELECT DISTINCT x.d AS d, x.k AS k, y.d AS nd, y.k AS nk FROM prefixes x JOIN prefixes y ON x.conv_id = y.conv_id AND x.d <= y.d) a
  JOIN full_nodes n ON n.d = a.nd AND n.k = a.nk GROUP BY a.d, a.k)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below b ON n.d = b.d AND n.k = b.k LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.k = n.up
"""
