"""The prefix trie of conversations, measured along its Euler tour.

Nodes. A node is a distinct sequence of first turns. Its key is its depth with sums of hashes of (place, turn), so keys of all
prefixes are running sums, and a parent's key is its child's less one turn. After one aggregation by key a node is known by
(smallest member, depth): the nodes with one smallest member form one downward path, as a conversation has one prefix a depth.

Tour. Every node has an enter arc and an exit arc. A node's first child is the one on its own path, then come the tops of other
paths. Siblings are linked inside buckets, then bucket to bucket, so a node with any number of children is no task's work.
Prefix sums along the tour, at a node's exit less those before its enter, are its subtree's leaves and savings.

List ranking. Arcs that follow each other on one path, inside a block of depths, form a run that a window sums. The list of runs
is ranked by jumping: every run doubles its reach each round until it meets a ruler (one run in ``RULERS``, by hash) or the end;
the list of rulers, a thirty-second as long, is ranked the same way, down to ``FEW`` runs, which one task walks. Rounds are
about log2(RULERS ln n) a level, and each is written, so a lost executor costs a reread.

At scale: texts are hashed and measured in the scan and never shuffled. Places come from ranges with offsets and sums from
blocks of places, so a conversation of any length lies in many tasks; counts of hot prefixes are summed before the shuffle. The
conversations that end at a node are joined in blocks of 65,536 ids, and the blocks stream through the hash in order: a hash of
one string is one task's work, but it holds a block at a time.

Defined results: rows with a null conversation id belong to no conversation and are left out; null turns come first, null roles
and texts are empty; rows of one turn stand in the order of their hash; repeated rows are turns like others; an empty table has
no node; extra columns are not looked at. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import reliable, text_of
from weirflow.operators.numbering import numbered, running

#: Lanes of 32 bits of a node's key.
LANES = 4
#: Depths of a path whose arcs are summed by one window.
BLOCK = 1024
#: One run in so many is a ruler; lists up to FEW runs are walked by one task; bits of the ids of a block of members.
RULERS, FEW, ID_BITS = 32, 10_000, 16

KEY = ["depth", *[f"s{i}" for i in range(LANES)]]


def turns_of(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), hash and chars of every turn."""
    r, t = text_of(role), text_of(text)
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("hash"), F.length(t).cast("long").alias("chars"))
    return numbered(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("hash").asc()], "place").select("conv_id", "place", "hash", "chars")


def rebuilt(turns: DataFrame, most: int = 6, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation's first h turns gave way to those of the first of its group of ids; h is the
    id's checksum modulo ``most``. A conversation without a turn stays one."""
    turns = reliable(turns)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.where((F.col("conv_id") == first) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("place", "hash", "chars"))).alias("head"))
    own = turns.groupBy("conv_id").agg(F.max("place").alias("own"))
    planned = own.withColumns({"h": h, "first": first}).join(heads, "first", "left")
    planned = reliable(planned.select("conv_id", "own", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,hash:string,chars:bigint>>")), F.lit(1), F.col("h")).alias("head")))
    taken = planned.select("conv_id", F.inline("head"))
    rest = turns.join(planned.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where(F.col("place") > F.col("h"))
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("place"), "hash", "chars")
    return taken.unionByName(rest), planned.select("conv_id", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"))


def nodes_of(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): every distinct prefix with its smallest member, members and last turn's length; every conversation's last node."""
    lane = lambda i: F.conv(F.substring(F.col("mixed"), 1 + 8 * i, 8), 16, 10).cast("long")
    mixed = turns.withColumn("mixed", F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), F.col("hash"))))
    mixed = mixed.select("conv_id", "place", "chars", *[lane(i).alias(f"u{i}") for i in range(LANES)])
    prefixes = reliable(running(mixed, "conv_id", "place", {f"s{i}": f"u{i}" for i in range(LANES)}).withColumnRenamed("place", "depth"))
    inner = prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), *[F.min(F.col(f"s{i}") - F.col(f"u{i}")).alias(f"p{i}") for i in range(LANES)])
    none = F.lit(None).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), *[none.alias(f"p{i}") for i in range(LANES)])
    ended = prefixes.join(conversations.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("conv_id", *KEY)
    turnless = conversations.where("length = 0").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in KEY])
    return inner.unionByName(root), ended.unionByName(turnless)


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the smallest member of their parent."""
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"s{i}").alias(f"p{i}") for i in range(LANES)], F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, ["depth", *[f"p{i}" for i in range(LANES)]], "left").drop(*[f"p{i}" for i in range(LANES)])


def ends_sha256(ends: DataFrame) -> DataFrame:
    """Of each node, by its key, the digest of the ids that end there: joined in blocks of ids, which stream through the hash."""
    blocks = ends.groupBy(*KEY, F.shiftright("conv_id", ID_BITS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    in_order = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if key != now:
                    out += [(*now, state.hexdigest())] if now else []
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out, strict=True))), [*KEY, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], [*KEY, "ends_sha256"])

    return in_order.mapInArrow(digest, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string")


def siblings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, next): of each node the first child that is the top of another path, and of each child but the last its next
    sibling. Tops are linked inside buckets of a parent's children, then from bucket to bucket; a bucket and the buckets of a
    parent have about the square root of all tops each, at most."""
    tops = reliable(nodes.where("parent_conv_id <> conv_id").select("conv_id", "depth", "parent_conv_id"))
    buckets = max(16, int(tops.count() ** 0.5))
    tops = tops.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)))
    parent = ["parent_conv_id", "depth"]
    inside = F.lead("conv_id").over(Window.partitionBy(*parent, "bucket").orderBy("conv_id"))
    firsts = tops.groupBy(*parent, "bucket").agg(F.min("conv_id").alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.partitionBy(*parent).orderBy("bucket"))).drop("first")
    linked = tops.withColumn("inside", inside).join(after, [*parent, "bucket"])
    first = firsts.groupBy(*parent).agg(F.min_by("first", "bucket").alias("first"))
    nxt = linked.select("conv_id", "depth", F.coalesce("inside", "after").alias("next")).where("next IS NOT NULL")
    on_path = first.select(F.col("parent_conv_id").alias("conv_id"), "depth", F.col("first").alias("next"))
    return first.select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "first"), nxt.unionByName(on_path)


def arcs_of(nodes: DataFrame) -> DataFrame:
    """Enter (side 0) and exit (side 1) arcs of all nodes, each with its next arc and what it weighs."""
    first, nxt = siblings(nodes)
    bottom = nodes.groupBy("conv_id").agg(F.max("depth").alias("bottom"))
    rows = nodes.join(first, ["conv_id", "depth"], "left").join(nxt, ["conv_id", "depth"], "left").join(bottom, "conv_id")
    arc = lambda conv, depth, side: F.struct(conv.alias("conv_id"), depth.alias("depth"), F.lit(side).alias("side"))
    conv, depth = F.col("conv_id"), F.col("depth")
    into = F.when(depth < F.col("bottom"), arc(conv, depth + 1, 0)).when(F.col("first").isNotNull(), arc(F.col("first"), depth + 1, 0)).otherwise(arc(conv, depth, 1))
    out = F.when(F.col("next").isNotNull(), arc(F.col("next"), depth, 0)).when(depth > 0, arc(F.col("parent_conv_id"), depth - 1, 1))
    zero = F.lit(0).cast("long")
    leaf = F.when((depth < F.col("bottom")) | F.col("first").isNotNull(), zero).otherwise(F.lit(1).cast("long"))
    saved = (F.col("n_convs") - 1) * F.col("chars")
    both = F.array(F.struct(F.lit(0).alias("side"), into.alias("next"), leaf.alias("leaves"), saved.alias("saved")), F.struct(F.lit(1).alias("side"), out.alias("next"), zero.alias("leaves"), zero.alias("saved")))
    return rows.select("conv_id", "depth", F.inline(both))


SUMS = ("steps", "leaves", "saved")


def runs_of(arcs: DataFrame) -> DataFrame:
    """``arcs`` with the id of their run and the sums inside the run up to and with them."""
    along = F.when(F.col("side") == 0, F.col("depth")).otherwise(-F.col("depth"))
    rows = arcs.withColumns({"along": along, "block": F.floor(F.col("depth") / BLOCK), "steps": F.lit(1).cast("long")})
    w = Window.partitionBy("conv_id", "side", "block").orderBy("along")
    here = F.struct("conv_id", "depth", "side")
    head = ~F.coalesce(F.lag("next").over(w) == here, F.lit(False))
    rows = rows.withColumns({"head": head, **{f"{s}_upto": F.sum(s).over(w) for s in SUMS}})
    at_head = lambda value: F.last(F.when(F.col("head"), value), True).over(w)
    name = lambda a, b, c: F.concat_ws(":", a, b, c)
    rows = rows.withColumns({"run": name(F.col("conv_id"), F.col("side"), at_head(F.col("depth"))), **{f"{s}_in": F.col(f"{s}_upto") - at_head(F.col(f"{s}_upto") - F.col(s)) for s in SUMS}})
    return rows.select("conv_id", "depth", "side", "run", "along", name(F.col("next.conv_id"), F.col("next.side"), F.col("next.depth")).alias("next"), F.col("next").isNull().alias("ends"), "leaves", "saved", *[f"{s}_in" for s in SUMS])


def is_ruler(name: str, level: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit(level)), F.lit(RULERS)) == 0


def walked(links: DataFrame) -> DataFrame:
    """Sums to the end of a list of few elements, by one task."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        before = {None if pd.isna(to) else to: (name, sums) for name, to, *sums in part[["id", "next", *SUMS]].itertuples(index=False)}
        now, total, out = None, [0] * len(SUMS), []
        while now in before:
            now, sums = before[now]
            total = [a + b for a, b in zip(total, sums, strict=True)]
            out.append((now, *total))
        return pd.DataFrame(out, columns=["id", *SUMS])

    return links.groupBy(F.lit("all")).applyInPandas(walk, "id string, " + ", ".join(f"{s} long" for s in SUMS))


def list_ranked(links: DataFrame, *, few: int = FEW, level: int = 0) -> DataFrame:
    """(id, sums): of each element of the list (id, next: null at the end, sums) the sums from it to the end, its own included."""
    state = reliable(links)
    if state.count() <= few:
        return walked(state)
    stops = F.col("next").isNull() | is_ruler("next", level)
    while not state.where(~stops).isEmpty():
        reach = state.select(F.col("id").alias("_id"), F.col("next").alias("_next"), *[F.col(s).alias(f"_{s}") for s in SUMS]).where(~is_ruler("_id", level))
        jumped = state.where(~stops).join(reach, F.col("next") == F.col("_id"))
        jumped = jumped.select("id", F.col("_next").alias("next"), *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in SUMS])
        state = reliable(state.where(stops).unionByName(jumped))
    far = list_ranked(state.where(is_ruler("id", level)), few=few, level=level + 1)
    far = far.select(F.col("id").alias("_id"), *[F.col(s).alias(f"_{s}") for s in SUMS])
    ranked = state.join(far, F.col("next") == F.col("_id"), "left")
    return reliable(ranked.select("id", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in SUMS]))


def toured(nodes: DataFrame, *, few: int = FEW) -> DataFrame:
    """conv_id, depth, position (of the enter arc, from 1), n_leaves and saved_tokens of every node, from the tour's prefix sums."""
    arcs = reliable(runs_of(arcs_of(nodes)))
    last = F.max_by(F.struct(F.when(~F.col("ends"), F.col("next")).alias("next"), *[F.col(f"{s}_in").alias(s) for s in SUMS]), "along")
    ranked = list_ranked(arcs.groupBy(F.col("run").alias("id")).agg(last.alias("l")).select("id", "l.*"), few=few)
    total = ranked.agg(*[F.max(s).alias(s) for s in SUMS]).first()  # the list's head has them all
    before = ranked.select(F.col("id").alias("run"), *[(F.lit(total[s]) - F.col(s)).cast("long").alias(f"{s}_before") for s in SUMS])
    at = arcs.join(before, "run")
    upto = lambda s: F.col(f"{s}_before") + F.col(f"{s}_in")
    inside = lambda s: F.sum(F.when(F.col("side") == 1, upto(s)).otherwise(F.col(s) - upto(s)))
    return at.groupBy("conv_id", "depth").agg(F.max(F.when(F.col("side") == 0, upto("steps"))).alias("position"), inside("leaves").alias("n_leaves"), inside("saved").alias("saved_tokens"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, *, few: int = FEW) -> DataFrame:
    """Every node of the trie of conversations (turns: conv_id, place, hash, chars; conversations: conv_id, length)."""
    nodes, ends = nodes_of(turns, conversations)
    nodes = reliable(with_parents(reliable(nodes)))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(ends_sha256(ends), KEY, "left").join(children, ["conv_id", "depth"], "left").join(toured(nodes, few=few), ["conv_id", "depth"])
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "position")


#: Plain form: every node meets each of its prefixes.
SQL = """WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (SELECT conv_id, coalesce(text, '') AS text, place, mark FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place FROM (SELECT *, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark FROM conversations WHERE conv_id IS NOT NULL))),
plan AS (SELECT conv_id, conv_id - conv_id % 100 AS first, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
seqs AS (SELECT p.conv_id, list({'m': o.mark, 'c': length(o.text)} ORDER BY o.conv_id = p.conv_id AND o.place > p.h, o.place) FILTER (WHERE o.place IS NOT NULL) AS s FROM plan p LEFT JOIN own o ON (o.conv_id = p.first AND o.place <= p.h) OR (o.conv_id = p.conv_id AND o.place > p.h) GROUP BY p.conv_id),
pre AS (SELECT conv_id, d, array_to_string(list_transform(s[1:d], lambda x: x.m), '') AS k, coalesce(len(s), 0) = d AS ending, CASE WHEN d = 0 THEN 0 ELSE s[d].c END AS chars FROM seqs, LATERAL (SELECT unnest(range(0, coalesce(len(s), 0) + 1)) AS d)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends_sha256 FROM pre GROUP BY k, d),
kids AS (SELECT left(k, 32 * (d - 1)::INTEGER) AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
flat AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (k, d)),
below AS (SELECT left(k, 32 * a::INTEGER) AS k, a AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM flat, LATERAL (SELECT unnest(range(0, d + 1)) AS a) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256 FROM flat f JOIN below USING (k, d) LEFT JOIN node p ON p.k = left(f.k, 32 * (f.d - 1)::INTEGER) AND p.d = f.d - 1"""
