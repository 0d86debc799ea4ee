"""The trie of conversations that begin with turns of another one, by fingerprints that compose."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.llm import bytetext
from marisma.llm.scratch import drop, keep
from marisma.session import ship

#: Moduli of the first, second, ... try; the last one serves all further ones.
PRIMES = (2**127 - 1,)
#: Turns of a conversation that meet its own row in one task; nodes of a chain that are summed in one window; bytes of a piece of a list.
BLOCK = 1 << 16
CHAIN = 4096
PIECE = 1 << 16
IDENTITY = (1).to_bytes(16, "little") + bytes(16)
NODE = ["depth", "k1", "k2"]


# fingerprints: a turn is an affine map modulo a prime, turns one after another the product of their maps. The value at 0 is the fingerprint.


def _then(x: tuple[int, int], y: tuple[int, int], prime: int) -> tuple[int, int]:
    """The map x, followed by y."""
    return x[0] * y[0] % prime, (x[1] * y[0] + y[1]) % prime


def _undo(x: tuple[int, int], prime: int) -> tuple[int, int]:
    a = pow(x[0], -1, prime)
    return a, -x[1] * a % prime


def _turn(role: str, text: str, seed: bytes, prime: int) -> tuple[int, int]:
    raw = role.encode()
    h = hashlib.blake2b(len(raw).to_bytes(8, "little") + raw + text.encode(), digest_size=32, key=seed).digest()
    return int.from_bytes(h[:16], "little") % prime or 1, int.from_bytes(h[16:], "little") % prime


def _bytes(x: tuple[int, int]) -> bytes:
    return x[0].to_bytes(16, "little") + x[1].to_bytes(16, "little")


def _map(raw: bytes | None) -> tuple[int, int]:
    return (1, 0) if raw is None else (int.from_bytes(raw[:16], "little"), int.from_bytes(raw[16:], "little"))


def _keys(maps: list[tuple[int, int]]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(b.to_bytes(16, "little") for _, b in maps), "<i8").reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))]


# turns in order: place in their conversation and products of all turns so far


_SCANNED = "conv_id bigint, part int, local bigint, role string, text string, chars bigint, before binary, after binary"


def _scan(seed: bytes, prime: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, local, product = TaskContext.get().partitionId(), None, 0, (1, 0)
        for batch in batches:
            at, before, after, chars = [], [], [], []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv:
                    conv, local, product = c, 0, (1, 0)
                at.append(local)
                before.append(_bytes(product))
                product = _then(product, _turn(role, text, seed, prime), prime)
                after.append(_bytes(product))
                chars.append(len(text))
                local += 1
            cells = [batch.column(0), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), batch.column(1), batch.column(2), pa.array(chars, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["conv_id", "part", "local", "role", "text", "chars", "before", "after"])

    return run


def _carried(scanned: DataFrame, prime: int) -> list[tuple[int, int, int, bytes]]:
    """For each part that begins within a conversation: part, conv_id, turns before it, their product. One row a part is looked at."""
    order = F.struct("conv_id", "local")
    edges = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), F.max_by(F.struct("conv_id", "local", "after"), order).alias("last")).orderBy("part").collect()
    out, conv, count, product = [], None, 0, (1, 0)
    for e in edges:
        goes_on = e["first"] == conv
        if goes_on:
            out.append((e["part"], conv, count, _bytes(product)))
        whole = goes_on and e["last"]["conv_id"] == conv
        own = _map(e["last"]["after"])
        product, count = (_then(product, own, prime), count + e["last"]["local"] + 1) if whole else (own, e["last"]["local"] + 1)
        conv = e["last"]["conv_id"]
    return out


def _follow(prime: int):
    """Columns start, before, after: the last two as they are after start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("start").to_pylist()
            out = [batch.column(c) for c in ("conv_id", "pos", "chars")]
            for c in ("before", "after"):
                out.append(pa.array([x if s is None else _bytes(_then(_map(s), _map(x), prime)) for s, x in zip(start, batch.column(c).to_pylist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["conv_id", "pos", "chars", "before", "after"])

    return run


def _moved(prime: int):
    """From a conversation's own products to those of the rebuilt one: its head's product and the inverse of what it leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = [_bytes(_then(_map(h), _undo(_map(s), prime), prime)) for h, s in zip(batch.column("head_product").to_pylist(), batch.column("own_product").to_pylist(), strict=True)]
            names = ["conv_id", "n", "base", "head", "kept"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(moves, pa.binary())], [*names, "move"])

    return run


_ENTRY = "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, ref_conv bigint, ref_pos bigint, chars bigint, n bigint, ends bigint"


def _entries(prime: int):
    """Nodes that conversations pass: keys of the sequence with the last turn and without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            move = [_map(x) for x in batch.column("move").to_pylist()]
            after, before = ([_then(m, _map(x), prime) for m, x in zip(move, batch.column(c).to_pylist(), strict=True)] for c in ("after", "before"))
            rest = ["conv_id", "ref_conv", "ref_pos", "chars", "n", "ends"]
            yield pa.RecordBatch.from_arrays([batch.column("depth"), *_keys(after), *_keys(before), *[batch.column(c) for c in rest]], [*NODE, "p1", "p2", *rest])

    return run


# sums and lists


def running(rows: DataFrame, key: str, at: str, values: list[str], most: int) -> DataFrame:
    """before_<v> for each v of values: its sum over rows of the same key with a smaller `at`, which is 0 to `most` and unique in a key.

    A window holds CHAIN rows at most; sums of whole windows are added up in the same way.
    """
    block = F.floor(F.col(at) / CHAIN)
    window = Window.partitionBy(key, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_block", block)
    out = rows.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(window), F.lit(0)) for v in values})
    if most >= CHAIN:
        totals = rows.groupBy(key, F.col("_block").alias("_at")).agg(*[F.sum(v).alias(v) for v in values])
        above = running(totals, key, "_at", values, most // CHAIN).select(F.col(key).alias("_key"), F.col("_at").alias("_above"), *[F.col(f"before_{v}").alias(f"_{v}") for v in values])
        out = out.join(above, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_above")), "left")
        out = out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}).drop("_key", "_above", *[f"_{v}" for v in values])
    return out.drop("_block")


def _pieces(most: int):
    """Sorted (node, conv_id): comma-joined ids in pieces of about `most` digits, each with its first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0
        for batch in batches:
            done = []
            for *key, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (key != node or size > most):
                    done.append((*node, first, ",".join(held)))
                    held, size = [], 0
                if not held:
                    node, first = key, c
                held.append(str(c))
                size += len(held[-1])
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string() if i == 4 else pa.int64()) for i in range(5)], [*NODE, "first", "piece"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, first, ",".join(held))], [*NODE, "first", "piece"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for *key, piece in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string() if i == 3 else pa.int64()) for i in range(4)], [*NODE, "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], [*NODE, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 (lower-case hexadecimal) of each node's conv_ids in ascending order, as decimals joined by commas.

    Ids go to ranges, so that a node of many is made into pieces by many tasks; the digest, which can't be composed, reads a node's pieces in order
    and holds one at a time.
    """
    order = [*NODE, "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(PIECE), "depth bigint, k1 bigint, k2 bigint, first bigint, piece string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "piece").mapInArrow(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


# the trie


@dataclass
class Trie:
    """nodes: depth, k1, k2 (a node's key), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ref_conv, ref_pos (a stored turn that is the node's last).
    ends: depth, k1, k2, conv_id: where each rebuilt conversation ends. turns: conv_id, pos, role, text: the stored turns."""

    nodes: DataFrame
    ends: DataFrame
    turns: DataFrame


def prefix_trie(turns: DataFrame, base: Column, head: Column) -> Trie:
    """The trie of rebuilt conversations: the first `head` turns of conversation `base` (as many as it has), then the own turns after the first `head`.

    turns has conv_id (taken as long), turn, role, text; other columns are not read. base and head are expressions of conv_id; heads are short.
    A node is a distinct sequence of first turns (role, text), the root that of none; members of a node are the rebuilt conversations that
    start with it. conv_id is its smallest member, n_leaves counts childless nodes of its subtree, itself included, saved_tokens sums over
    its subtree (members - 1) times the code points of the last text.

    Rebuilt texts are never made. Turns are sorted once, over ranges, so that a conversation of any length is several tasks'; each
    task multiplies the maps of the turns it reads, and one row for each task joins them. What a rebuilt conversation is up to one of its own turns
    is head product x inverse of the left-out product x own product. A group of equal fingerprints is a node only if
    all its members have one parent and, where they refer to different stored turns, equal roles and texts there; if any group is not,
    all is done again with other maps. Subtree sums need no walk: a node counts to its smallest member, all nodes of
    a member count to every node it passes, and what lies above on the own chain of the smallest member is taken off.

    Defined cases: turns go by turn, null first, then by role and text; a null role or text is empty; rows without a conv_id belong to no
    conversation and are left out; repeated rows are repeated turns; a null base or head or a negative head takes nothing and leaves nothing out; a conversation without a turn left is a member of the root alone; an empty table has no nodes.
    """
    ship(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = keep(rows, "trie-rows")  # numbers of rows must be the same when a task is repeated
    attempt = 0
    while True:
        trie = _build(rows, base, head, attempt.to_bytes(8, "little"), PRIMES[min(attempt, len(PRIMES) - 1)])
        if trie is not None:
            return trie
        attempt += 1


def _build(rows: DataFrame, base: Column, head: Column, seed: bytes, prime: int) -> Trie | None:
    spark = rows.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    scanned = keep(placed.mapInArrow(bytetext.tidy(_scan(seed, prime)), _SCANNED), "trie-scanned")
    starts = F.broadcast(spark.createDataFrame(_carried(scanned, prime), "part int, conv_id bigint, offset bigint, start binary"))
    stored = scanned.join(starts, ["part", "conv_id"], "left").withColumn("pos", F.col("local") + F.coalesce("offset", F.lit(0)))
    texts = stored.select("conv_id", "pos", "role", "text")
    products = stored.select("conv_id", "pos", "chars", "before", "after", "start").mapInArrow(bytetext.tidy(_follow(prime)), "conv_id bigint, pos bigint, chars bigint, before binary, after binary")
    products = keep(products, "trie-products")

    # recipes: one row a conversation
    convs = keep(products.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": base.cast("long"), "head": head.cast("long")}), "trie-convs")
    convs = convs.withColumns({"base": F.coalesce("base", "conv_id"), "head": F.when(F.col("base").isNull() | F.col("head").isNull() | (F.col("head") < 0), 0).otherwise(F.col("head")).cast("long")})
    at = products.select(F.col("conv_id").alias("of"), (F.col("pos") + 1).alias("length"), F.col("after").alias("product"))
    heads = convs.select("base", "head").distinct().join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select("base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("kept"))
    heads = heads.join(at, (F.col("base") == F.col("of")) & (F.col("kept") == F.col("length")), "left").select("base", "head", "kept", F.col("product").alias("head_product"))
    own = convs.join(at, (F.col("conv_id") == F.col("of")) & (F.least("head", "n") == F.col("length")), "left").select("conv_id", "n", "base", "head", F.col("product").alias("own_product"))
    recipes = own.join(heads, ["base", "head"]).mapInArrow(bytetext.tidy(_moved(prime)), "conv_id bigint, n bigint, base bigint, head bigint, kept bigint, move binary")
    recipes = keep(recipes, "trie-recipes")

    # nodes passed by own turns, by heads (of all conversations with one base together), and the root
    def in_blocks(table: DataFrame) -> DataFrame:
        return table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))

    passed = products.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(in_blocks(recipes), ["conv_id", "block"]).where(F.col("pos") >= F.col("head"))
    passed = passed.select((F.col("kept") + F.col("pos") - F.col("head") + 1).alias("depth"), "move", "before", "after", "conv_id", F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "chars", F.lit(1).cast("long").alias("n"), (F.col("pos") == F.col("n") - 1).cast("long").alias("ends"))
    entries = keep(passed.mapInArrow(bytetext.tidy(_entries(prime)), _ENTRY), "trie-entries")
    short = F.col("n") <= F.col("head")  # ends within its head
    by_head = recipes.groupBy("base", "kept").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short"))
    along = by_head.where("kept > 0").withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("kept"))))
    along = along.groupBy("base", "depth").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum(F.when(F.col("depth") == F.col("kept"), F.col("short")).otherwise(0)).alias("ends"))
    along = along.join(products.withColumnRenamed("conv_id", "of"), (F.col("base") == F.col("of")) & (F.col("depth") == F.col("pos") + 1))
    along = along.select("depth", F.lit(IDENTITY).alias("move"), "before", "after", "conv_id", F.col("base").alias("ref_conv"), F.col("pos").alias("ref_pos"), "chars", "n", "ends")
    along = keep(along.mapInArrow(bytetext.tidy(_entries(prime)), _ENTRY), "trie-heads")
    zero = F.lit(0).cast("long")
    root = by_head.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum(F.when(F.col("kept") == 0, F.col("short")).otherwise(0)).alias("ends")).where("n > 0")
    root = root.select(*[zero.alias(c) for c in (*NODE, "p1", "p2")], "conv_id", *[F.lit(None).cast("long").alias(c) for c in ("ref_conv", "ref_pos")], zero.alias("chars"), "n", "ends")
    ranges = [f(c).alias(f"{c}_{name}") for c in ("p1", "p2", "ref_conv", "ref_pos") for f, name in ((F.min, "low"), (F.max, "high"))]
    nodes = entries.union(along).union(root).groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), *ranges)
    nodes = keep(nodes.withColumns({"leaf": (F.col("n") == F.col("ends")).cast("long"), "saved": (F.col("n") - 1) * F.col("chars"), "one": F.lit(1).cast("long")}), "trie-nodes")

    # equal fingerprints, equal turns?
    unlike = lambda c: F.col(f"{c}_low") != F.col(f"{c}_high")
    several = nodes.where(unlike("ref_conv") | unlike("ref_pos")).select(*NODE)
    referred = entries.union(along).join(several, NODE, "left_semi").select(*NODE, F.col("ref_conv").alias("conv_id"), F.col("ref_pos").alias("pos")).distinct()
    said = F.struct("role", "text")
    differ = referred.join(texts, ["conv_id", "pos"]).groupBy(*NODE).agg(F.min(said).alias("low"), F.max(said).alias("high")).where("low <> high")
    if not nodes.where(unlike("p1") | unlike("p2")).isEmpty() or not differ.isEmpty():
        for table in (scanned, products, convs, recipes, entries, along, nodes):
            drop(table)
        return None

    # subtree sums
    weight = keep(nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "trie-weights")
    weighed = recipes.join(weight, "conv_id", "left").select("conv_id", "n", "base", "kept", F.coalesce("leaf", zero).alias("leaf"), F.coalesce("saved", zero).alias("saved"))
    weighed = keep(weighed, "trie-weighed")
    below = entries.withColumn("block", F.floor(F.col("ref_pos") / BLOCK)).join(in_blocks(weighed).select("conv_id", "block", "leaf", "saved"), ["conv_id", "block"]).select(*NODE, "leaf", "saved")
    over = weighed.where("kept > 0").groupBy("base", "kept").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("kept"))))
    over = over.groupBy("base", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    over = over.join(along.select(F.col("ref_conv").alias("base"), *NODE), ["base", "depth"]).select(*NODE, "leaf", "saved")
    whole = weighed.agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).where("leaf is not null").select(*[zero.alias(c) for c in NODE], "leaf", "saved")
    subtree = below.union(over).union(whole).groupBy(*NODE).agg(F.sum("leaf").alias("all_leaves"), F.sum("saved").alias("all_saved"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    chained = running(nodes.select(*NODE, "conv_id", "n", "p1_low", "p2_low", "ref_conv_low", "ref_pos_low", "leaf", "saved", "one"), "conv_id", "depth", ["leaf", "saved", "one"], deepest)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1_low").alias("k1"), F.col("p2_low").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    told = chained.join(subtree, NODE).join(children, NODE, "left").select(
        *NODE, "conv_id", "p1_low", "p2_low", (F.col("before_one") == 0).alias("top"), F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
        (F.col("all_leaves") - F.col("before_leaf")).alias("n_leaves"), (F.col("all_saved") - F.col("before_saved")).alias("saved_tokens"), F.col("ref_conv_low").alias("ref_conv"), F.col("ref_pos_low").alias("ref_pos"),
    )
    told = keep(told, "trie-told")
    # below the top of a chain the parent is of the same chain
    parents = nodes.select(*[F.col(c).alias(f"of_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    above = (F.col("depth") - 1 == F.col("of_depth")) & (F.col("p1_low") == F.col("of_k1")) & (F.col("p2_low") == F.col("of_k2"))
    columns = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ref_conv", "ref_pos"]
    nodes = told.where("not top").withColumn("parent_conv_id", F.col("conv_id")).select(*columns).union(told.where("top").join(parents, above, "left").select(*columns))

    within = recipes.where(short & (F.col("kept") > 0)).join(along.select(F.col("ref_conv").alias("base"), F.col("depth").alias("kept"), "k1", "k2"), ["base", "kept"]).select(F.col("kept").alias("depth"), "k1", "k2", "conv_id")
    none = recipes.where(short & (F.col("kept") == 0)).select(*[zero.alias(c) for c in NODE], "conv_id")
    ends = entries.where("ends = 1").select(*NODE, "conv_id").union(within).union(none)
    return Trie(nodes, ends, texts)
