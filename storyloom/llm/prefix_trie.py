"""The trie of conversation prefixes, with sums over subtrees by centroid decomposition.

1. Turns are put in order by ranges, so that a conversation of any length is spread over
   tasks; each task numbers its turns and sums up their hashes as a polynomial, and what
   crosses from task to task (two rows of each) is added. So each prefix has a hash of 128 bits.
2. Prefixes of all rebuilt conversations are grouped by depth and hash: the nodes. A node's parent
   is the prefix without its last turn.
3. Nodes with the same members are one stretch without branches, known by the smallest member and
   the number of members; the rollup is done on stretches.
4. The forest of stretches is split into components by the number of members: those of up to
   :data:`WIDTH`, of up to its square, and so on. In each, what hangs below a stretch has at most WIDTH
   ends. A component is halved at its centroid again and again; a centroid's total, of what is
   below it in its component, is added to all on the path from it to the component's top. Components of few
   members go first, and their totals count for the stretch they hang on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, table, written

#: Members of a component's top, at most, for one of its least stretch.
WIDTH = 4096
#: Conversations that share their first turns, and what decides how many they share.
FAMILY, MOST_SHARED = 20, 3
#: Depths of a stretch that are summed up in one window.
DEPTHS = 4096
#: Ids joined into one piece before it is hashed.
PIECE = 16384
#: Odd, so that its powers never vanish; the base of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WHOLE = 1 << 64
INVERSE = tuple(pow(b, -1, WHOLE) for b in BASES)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ORDERED = "pid int, conv_id long, k long, a long, b long, ta long, tb long, words long, is_end boolean"
RANKED = "conv_id long, k long, a long, b long, ta long, tb long, words long"
PREFIX = "conv_id long, depth long, ha long, hb long, pa long, pb long, words long, is_end boolean"
KEY = ["depth", "ha", "hb"]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """Powers of ``base`` modulo 2**64."""
    return np.power(np.uint64(base), exponents.astype(np.uint64))


def columns_of(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """Columns of longs as unsigned 64-bit numbers."""
    return [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]


def frame(schema: str, *arrays: np.ndarray) -> pa.RecordBatch:
    """A record batch of numpy arrays under the names of ``schema``; unsigned numbers become longs."""
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if a.dtype == np.uint64 else a) for a in arrays], names)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """Turns with their place in their conversation and the sums of hashes up to them, counted within their task.

    Rows with ``is_end`` are no turns: they say how far a task's first and its last conversation came.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    words = F.size(F.regexp_extract_all("text", F.lit(f"([^{ASCII_SPACE}]+)"))).cast("long")
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), words.alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        first, last = None, None  # (conv_id, turns, sum a, sum b)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            start = np.repeat(starts, np.diff(np.append(starts, n)))
            goes_on = last is not None and last[0] == conv[0]
            k = np.arange(n) - start + 1
            if goes_on:
                k[start == 0] += last[1]
            elif last is not None and first is None:
                first = last
            sums = []
            for lane, (base, x) in enumerate(zip(BASES, columns_of(batch, "a", "b"), strict=True)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power(base, k), dtype=np.uint64)])
                own = total[1:] - total[start]
                if goes_on:
                    own[start == 0] += np.uint64(last[2 + lane])
                sums.append(own)
            tails = np.append(starts[1:], n) - 1
            if first is None and len(starts) > 1:
                t = tails[0]
                first = (int(conv[t]), int(k[t]), int(sums[0][t]), int(sums[1][t]))
            last = (int(conv[-1]), int(k[-1]), int(sums[0][-1]), int(sums[1][-1]))
            a, b = columns_of(batch, "a", "b")
            yield frame(ORDERED, np.full(n, pid, np.int32), conv, k, a, b, *sums, batch.column("words").to_numpy(), np.zeros(n, bool))
        for c, k_, sa, sb in [x for x in (first, last) if x]:
            yield frame(ORDERED, np.array([pid], np.int32), np.array([c]), np.array([k_]), *np.zeros((2, 1), np.int64), np.array([sa], np.uint64), np.array([sb], np.uint64), np.zeros(1, np.int64), np.ones(1, bool))

    return written(rows.mapInArrow(run, ORDERED), "turns")


def ranked_turns(ordered: DataFrame) -> DataFrame:
    """Turns with their place and sums in the whole conversation."""
    before: dict[tuple[int, int], tuple[int, int, int]] = {}
    of = None
    # Two rows for each task that put turns in order, whatever it holds.
    for r in sorted(ordered.filter("is_end").collect(), key=lambda r: (r["conv_id"], r["pid"])):
        if r["conv_id"] != of:
            of, k, sums = r["conv_id"], 0, [0, 0]
        if k:
            before[r["pid"], of] = (k, *sums)
        sums = [(s + pow(base, k, WHOLE) * t) % WHOLE for base, s, t in zip(BASES, sums, (r["ta"], r["tb"]), strict=True)]
        k += r["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, conv, k = (batch.column(n).to_numpy() for n in ("pid", "conv_id", "k"))
            sums = [x.copy() for x in columns_of(batch, "ta", "tb")]
            k = k.copy()
            for p in np.unique(pid):
                for (q, c), (turns, *so_far) in before.items() if len(before) < 8 else [x for x in before.items() if x[0][0] == p]:
                    at = np.flatnonzero((pid == q) & (conv == c)) if q == p else ()
                    if len(at):
                        k[at] += turns
                        for base, own, s in zip(BASES, sums, so_far, strict=True):
                            own[at] = np.uint64(s) + np.uint64(pow(base, turns, WHOLE)) * own[at]
            yield frame(RANKED, conv, k, *columns_of(batch, "a", "b"), *sums, batch.column("words").to_numpy())

    return ordered.filter("NOT is_end").mapInArrow(run, RANKED)


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def prefixes(conversations: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and each of its prefixes: depth, hash, the parent's hash, words of the last turn, whether it is the whole."""
    turns = ranked_turns(ordered_turns(conversations))
    numbers = range(1, MOST_SHARED + 1)
    firsts = {f"{c}{i}": F.max(F.when(F.col("k") == i, F.col(c))) for c in ("ta", "tb", "words") for i in numbers}
    own = written(turns.groupBy("conv_id").agg(F.count("*").alias("n"), *(f.alias(c) for c, f in firsts.items())), "conversations")
    base = own.select(F.col("conv_id").alias("base"), *(F.col(c).alias(f"base_{c}") for c in ("n", *firsts)))
    convs = own.withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    convs = convs.withColumn("s", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))
    zero = F.lit(0).cast("long")

    def at(columns: list[Column], place: Column) -> Column:
        return F.element_at(F.array(zero, *columns), place + 1)

    heads = [F.struct(zero.alias("depth"), zero.alias("ha"), zero.alias("hb"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("words"))]
    for i in numbers:
        parent = [F.col(f"base_{t}{i - 1}") if i > 1 else zero for t in ("ta", "tb")]
        heads.append(F.struct(F.lit(i).cast("long").alias("depth"), F.col(f"base_ta{i}").alias("ha"), F.col(f"base_tb{i}").alias("hb"), parent[0].alias("pa"), parent[1].alias("pb"), F.col(f"base_words{i}").alias("words")))
    heads_ = convs.select("conv_id", "n", "h", "s", F.explode(F.slice(F.array(*heads), F.lit(1), F.col("s") + 1)).alias("x")).select("conv_id", "x.*", ((F.col("x.depth") == F.col("s")) & (F.col("n") <= F.col("h"))).alias("is_end"))

    start = [at([F.col(f"base_{t}{i}") for i in numbers], F.col("s")).alias(f"p{t}") for t in ("ta", "tb")]
    cut = [at([F.col(f"{t}{i}") for i in numbers], F.col("h")).alias(f"c{t}") for t in ("ta", "tb")]
    rest = turns.filter(F.col("k") > shared_turns(F.col("conv_id"))).join(convs.select("conv_id", "n", "h", "s", *start, *cut), "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, k, n, h, s = (batch.column(c).to_numpy() for c in ("conv_id", "k", "n", "h", "s"))
            hashes, parents = [], []
            for base, inverse, x, t, p, c in zip(BASES, INVERSE, columns_of(batch, "a", "b"), columns_of(batch, "ta", "tb"), columns_of(batch, "pta", "ptb"), columns_of(batch, "cta", "ctb"), strict=True):
                back = power(inverse, h - s)  # the turns stand h - s places earlier than in their own conversation
                whole = p + back * (t - c)
                hashes.append(whole)
                parents.append(whole - back * power(base, k) * x)
            yield frame(PREFIX, conv, k - h + s, *hashes, *parents, batch.column("words").to_numpy(), k == n)

    return heads_.unionByName(rest.mapInArrow(run, PREFIX))


def hashes_of_ends(rows: DataFrame) -> DataFrame:
    """For each node (depth, ha, hb) at which conversations end, the SHA-256 of their ids in ascending order, joined by commas.

    Ids are joined in pieces where they stand in order, and only the pieces of a node come together, one after another.
    """
    order = [*KEY, "conv_id"]
    ends = rows.filter("is_end").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    key_schema = "depth long, ha long, hb long"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                part = batch.slice(a, PIECE)
                keys = np.stack([part.column(c).to_numpy() for c in KEY])
                starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
                ids = part.column("conv_id").to_pylist()
                pieces = [",".join(map(str, ids[x:y])) for x, y in zip(starts, [*starts[1:], len(ids)], strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in keys), pa.array([ids[x] for x in starts], pa.int64()), pa.array(pieces)], [*KEY, "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sha = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in KEY)
                if key == of:
                    sha.update(b",")
                else:
                    if of is not None:
                        out.append((*of, sha.hexdigest()))
                    of, sha = key, hashlib.sha256()
                sha.update(row["piece"].encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], r, strict=True)) for r in out], DIGEST)
        if of is not None:
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], (*of, sha.hexdigest()), strict=True))], DIGEST)

    pieces = ends.mapInArrow(join, f"{key_schema}, first long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key_schema}, ends_sha256 string")


DIGEST = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])


def centroid_sums(parent: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """For each node of a forest the sums of ``values`` over its subtree, itself included; ``parent`` is -1 at tops."""
    children: list[list[int]] = [[] for _ in parent]
    tops = []
    for v, p in enumerate(parent):
        (tops if p < 0 else children[p]).append(v)
    sums = [[0] * len(values[0]) for _ in parent]
    size, gone = [0] * len(parent), [False] * len(parent)

    def inside(top: int) -> list[int]:
        """What is below ``top`` and not cut off, parents first."""
        found = [top]
        for v in found:
            found.extend(c for c in children[v] if not gone[c])
        return found

    while tops:
        top = tops.pop()
        component = inside(top)
        for v in component:
            size[v] = 1
        for v in reversed(component[1:]):
            size[parent[v]] += size[v]
        centroid = top
        while half := [c for c in children[centroid] if not gone[c] and 2 * size[c] > len(component)]:
            centroid = half[0]
        total = [sum(x) for x in zip(*(values[v] for v in inside(centroid)), strict=True)]
        v = centroid
        while True:
            sums[v] = [x + y for x, y in zip(sums[v], total, strict=True)]
            if v == top:
                break
            v = parent[v]
        gone[centroid] = True
        tops.extend(c for c in children[centroid] if not gone[c])
        if centroid != top:
            tops.append(top)
    return sums


STRETCH = "conv_id long, n_convs long, comp_id long, comp_n long, up_id long, up_n long, leaves long, saved long"


def summed_components(stretches: DataFrame) -> DataFrame:
    """``stretches`` (STRETCH) with leaves and saved summed over what is below each in its component (comp_id, comp_n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def done(rows: list[dict]) -> pa.RecordBatch:
            place = {(r["conv_id"], r["n_convs"]): k for k, r in enumerate(rows)}
            parent = [-1 if (r["conv_id"], r["n_convs"]) == (r["comp_id"], r["comp_n"]) else place[r["up_id"], r["up_n"]] for r in rows]
            for r, (leaves, saved) in zip(rows, centroid_sums(parent, [(r["leaves"], r["saved"]) for r in rows]), strict=True):
                r |= {"leaves": leaves, "saved": saved}
            return pa.RecordBatch.from_pylist(rows, STRETCHES)

        for batch in batches:
            held += batch.to_pylist()
            if held:
                last = held[-1]["comp_id"], held[-1]["comp_n"]
                cut = next((k for k in range(len(held) - 1, -1, -1) if (held[k]["comp_id"], held[k]["comp_n"]) != last), -1) + 1
                if cut:
                    yield done(held[:cut])
                    held = held[cut:]
        if held:
            yield done(held)

    names = [c.split()[0] for c in STRETCH.split(", ")]
    return stretches.select(*names).repartition("comp_id", "comp_n").sortWithinPartitions("comp_id", "comp_n").mapInArrow(run, STRETCH)


STRETCHES = pa.schema([(c.split()[0], pa.int64()) for c in STRETCH.split(", ")])


def in_components(stretches: DataFrame, width: int) -> DataFrame:
    """``stretches`` with comp_id and comp_n, the highest one above each of the same level, by doubling pointers."""
    level = F.floor(F.log(F.col("n_convs").cast("double")) / F.lit(math.log(width)) + F.lit(1e-9))
    rows = stretches.withColumn("level", level.cast("int"))
    up = rows.select(F.col("conv_id").alias("up_id"), F.col("n_convs").alias("up_n"), F.col("level").alias("up_level"))
    rows = rows.join(up, ["up_id", "up_n"], "left")
    same = F.col("up_level") == F.col("level")
    rows = written(rows.withColumn("comp_id", F.when(same, F.col("up_id")).otherwise(F.col("conv_id"))).withColumn("comp_n", F.when(same, F.col("up_n")).otherwise(F.col("n_convs"))), "components")
    while True:
        next_ = rows.select(F.col("conv_id").alias("comp_id"), F.col("n_convs").alias("comp_n"), F.col("comp_id").alias("next_id"), F.col("comp_n").alias("next_n"))
        moved = written(rows.join(next_, ["comp_id", "comp_n"]), "components")
        others = moved.filter((F.col("next_id") != F.col("comp_id")) | (F.col("next_n") != F.col("comp_n"))).limit(1).count()
        rows = moved.drop("comp_id", "comp_n").withColumnsRenamed({"next_id": "comp_id", "next_n": "comp_n"})
        if not others:
            return rows


def summed_stretches(stretches: DataFrame, width: int = WIDTH) -> DataFrame:
    """conv_id, n_convs, leaves and saved of each stretch, summed over its subtree.

    ``stretches`` has conv_id, n_convs, up_id, up_n (the stretch above, null at the top), leaves and saved (their own).
    """
    rows = in_components(stretches, width)
    most = rows.agg(F.max("level")).first()[0]
    found: list[DataFrame] = []
    below: list[DataFrame] = []
    for level in range(0, (most if most is not None else -1) + 1):
        part = rows.filter(F.col("level") == level)
        if below:
            more = reduce(DataFrame.unionByName, below).groupBy("conv_id", "n_convs").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
            part = part.join(more, ["conv_id", "n_convs"], "left")
            part = part.withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        done = written(summed_components(part), "sums")
        found.append(done)
        tops = done.filter((F.col("conv_id") == F.col("comp_id")) & (F.col("n_convs") == F.col("comp_n")) & F.col("up_id").isNotNull())
        below.append(tops.select(F.col("up_id").alias("conv_id"), F.col("up_n").alias("n_convs"), F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")))
    return reduce(DataFrame.unionByName, found).select("conv_id", "n_convs", "leaves", "saved") if found else rows.select("conv_id", "n_convs", "leaves", "saved")


def prefix_trie(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text; other columns are passed over, and rows without a conv_id take no part. Turns are in
    ascending order, null first, equal ones by role and text; repeated rows are turns of their own. Null role or text is empty; a very long text
    is one turn like any other. Without conversations there is no node, not even the root.
    """
    rows = written(prefixes(conversations), "prefixes")
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    nodes = written(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ha"), F.col("pb").alias("hb")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("up_id"), F.col("n_convs").alias("up_n"))
    nodes = nodes.join(children, KEY, "left").join(hashes_of_ends(rows), KEY, "left").join(above, ["depth", "pa", "pb"], "left")
    nodes = nodes.select("conv_id", "depth", "up_id", "up_n", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    nodes = written(nodes, "nodes")

    # Below a node of one member is one leaf and nothing saved: such nodes count for the stretch they hang on.
    many = nodes.filter("n_convs > 1")
    alone = nodes.filter("n_convs = 1 AND up_n > 1").groupBy(F.col("up_id").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("alone"))
    stretches = many.groupBy("conv_id", "n_convs").agg(F.min_by("up_id", "depth").alias("up_id"), F.min_by("up_n", "depth").alias("up_n"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"), F.sum("own").alias("saved"))
    stretches = stretches.join(alone, ["conv_id", "n_convs"], "left").withColumn("leaves", (F.col("leaf") + F.coalesce("alone", F.lit(0))).cast("long"))
    # An upper end is null at the root, whose stretch is a top.
    sums = summed_stretches(written(stretches.select("conv_id", "n_convs", "up_id", "up_n", "leaves", "saved"), "stretches"), width)

    # Within a stretch: what is above a node, by blocks of depths.
    key, block = ["conv_id", "n_convs"], F.floor(F.col("depth") / DEPTHS)
    many = many.withColumn("block", block)
    blocks = many.groupBy(*key, "block").agg(F.sum("own").alias("in_block"))
    earlier = blocks.withColumn("earlier", F.sum("in_block").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).filter("earlier IS NOT NULL").select(*key, "block", "earlier")
    above_here = F.sum("own").over(Window.partitionBy(*key, "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    many = many.withColumn("above", above_here).join(earlier, [*key, "block"], "left").join(sums, key)
    many = many.withColumn("saved_tokens", F.col("saved") - F.coalesce("above", F.lit(0)) - F.coalesce("earlier", F.lit(0)))
    single = nodes.filter("n_convs = 1").withColumn("leaves", F.lit(1).cast("long")).withColumn("saved_tokens", F.lit(0).cast("long"))
    out = ["conv_id", "depth", F.col("up_id").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens", "ends_sha256"]
    return many.select(*out).unionByName(single.select(*out))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations' prefixes."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  -- crc32, bit by bit, over the characters of the id.
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v // 2, (v % 2) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.k <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h
), d AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, md5(concat(length(role), ':', role, text)) AS own,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
), p AS (
  SELECT conv_id, depth, words, md5(string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM d
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c
), q AS (
  SELECT *, lag(key) OVER w AS parent, lead(key) OVER w IS NULL AS is_end FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
), n AS (
  SELECT depth, key, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM q GROUP BY depth, key
), k AS (
  SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2
), m AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, key)
), s AS (
  SELECT q.depth, q.key, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((m.n_convs - 1) * m.words) AS saved_tokens
  FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY 1, 2
)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, key) LEFT JOIN m u ON u.depth = m.depth - 1 AND u.key = m.parent
"""
