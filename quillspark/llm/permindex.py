"""Nearest vectors by a permutation index.

A vector is represented by the order of its nearest pivots. Vectors that are alike see the pivots in like order, so
they meet in the inverted files of their first pivots; the footrule distance of the orders ranks them, and the exact
cosine of the few left decides.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shared import bounded_sample, materialize

#: Pivots are a sample of the vectors, ``PIVOTS_PER_ROOT`` times the square root of their number within these bounds:
#: then the number of pivot pairs, hence of posting lists, grows as the number of vectors.
PIVOTS_PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 2.0, 64, 16_384
PREFIX = 8  # pivots of an order that are kept
LEAST_POSTED = 5  # of these, each pair names a posting list the vector is put in; more with more pivots, see ``posted``
MOST_HOT = 100_000  # names of long lists that go to every task
HOT_LIST = 8_192  # longer posting lists are cut into blocks, and each pair of blocks is one unit of work


def posted(pivots: int) -> int:
    """Pivots of an order whose pairs name posting lists: with many pivots orders differ sooner, so more of each order
    are posted."""
    return min(PREFIX, max(LEAST_POSTED, math.ceil(math.log2(max(pivots, 2)) / 2)))


def usual_width(df: DataFrame, vec_col: str) -> tuple[int, int]:
    """``(width, rows)``: the most frequent length of the vectors (the larger one of equally frequent ones), counted over
    the whole table, and how many rows have it. ``(0, 0)`` without any."""
    sizes = df.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("width")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    return (top["width"], top["count"]) if top else (0, 0)


def unusable_vectors(df: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """``(id_col, reason)`` of the rows that no search can use: ``null``, ``empty``, ``length`` (not the usual one),
    ``value`` (a null, infinite or undefined number) or ``zero``."""
    width, _ = usual_width(df, vec_col)
    v = F.col(vec_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    reason = (
        F.when(v.isNull(), "null").when(F.size(v) == 0, "empty").when(F.size(v) != width, "length")
        .when(F.exists(v, odd), "value").when(F.forall(v, lambda x: x == 0), "zero")
    )
    return df.select(id_col, reason.alias("reason")).where(F.col("reason").isNotNull())


def unit_rows(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable (not null, ``width`` long, finite, not all zero) and their unit vectors as float32. A row
    that is not usable costs no other row of its batch anything."""
    size = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == width) if width > 0 else np.empty(0, np.int64)
    if not len(at):
        return np.empty(0, np.int64), np.empty((0, width), np.float32)
    flat = (col if len(at) == len(col) else col.take(pa.array(at))).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)  # a null number is NaN
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.abs(x).max(1)
        ok = np.isfinite(largest) & (largest > 0)
        x = x[ok] / largest[ok][:, None]  # so that no square overflows
        return at[ok], (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def packed_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in a byte a number, scaled to their largest one, and how far each is from what the bytes give back.
    The cosine of two packed vectors differs from the true one by at most the sum of their two distances, whatever the
    number of dimensions."""
    top = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30)
    packed = np.rint(x * (127 / top)).astype(np.int8)
    return packed, np.sqrt(((x - unpacked(packed)) ** 2).sum(1)).astype(np.float32) + np.float32(1e-6)


def unpacked(packed: np.ndarray) -> np.ndarray:
    x = packed.astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None]


def order_prefix(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Indices of the ``length`` nearest pivots of each row, the nearest first; ties by index."""
    length = min(length, len(pivots))
    out = np.empty((len(x), length), np.uint16)
    for lo in range(0, len(x), 2048):
        s = x[lo : lo + 2048] @ pivots.T
        top = np.argpartition(-s, length - 1, axis=1)[:, :length] if length < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        top = np.sort(top, axis=1)
        rank = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[lo : lo + 2048] = np.take_along_axis(top, rank, 1)
    return out


def choose_pivots(df: DataFrame, id_col: str, vec_col: str, count: int, width: int, apart: float = 0.8) -> np.ndarray:
    """Up to ``count`` vectors of a bounded sample picked by the hash of their id, no two with a cosine of ``apart`` or
    more: a dense group gives one pivot, so that its members see the other pivots in like order instead of ranking one
    another."""
    rows = bounded_sample(df.where(F.size(vec_col) == width).select(id_col, vec_col), id_col, 2 * count).orderBy(id_col).select(vec_col).toArrow()
    _, x = unit_rows(rows.column(0).combine_chunks(), width)
    if not len(x):
        return np.empty((0, width), np.float32)
    x = np.unique(x, axis=0)[np.argsort(np.unique(x, axis=0, return_index=True)[1])]
    kept = np.empty((0, x.shape[1] if len(x) else 0), np.float32)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        part = part[~((part @ kept.T >= apart).any(1))] if len(kept) else part
        near = part @ part.T >= apart
        own: list[int] = []
        for i in range(len(part)):
            if not near[i, own].any():
                own.append(i)
        kept = np.concatenate((kept, part[own]))
        if len(kept) >= count:
            break
    return kept[:count]


def index_vectors(df: DataFrame, id_col: str, vec_col: str, pivots: np.ndarray) -> DataFrame:
    """``(id, same, prefix, packed, slack, lists)`` of every usable vector: ``same`` is a digest of the unit vector,
    ``prefix`` the order of its nearest pivots, ``packed`` the vector in bytes for the inner ranking and
    ``slack`` what that may be off, ``lists`` the names of its posting lists, one for each pair of its first pivots."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_rows(b.column(1), shared.value.shape[1])
            if not len(x):
                continue
            prefix = order_prefix(x, shared.value, PREFIX)
            first = prefix[:, : posted(len(shared.value))].astype(np.int64)
            pairs = list(itertools.combinations(range(first.shape[1]), 2)) or [(0, 0)]
            lists = np.stack([np.minimum(first[:, i], first[:, j]) * 65536 + np.maximum(first[:, i], first[:, j]) for i, j in pairs], 1)
            packed, slack = packed_rows(x)
            rounded = np.round(x, 6) + np.float32(0)  # multiples of a vector are one vector, whatever the last bits
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(at)),
                    pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rounded], pa.binary()),
                    pa.array([r.tobytes() for r in prefix], pa.binary()),
                    pa.array([r.tobytes() for r in packed], pa.binary()),
                    pa.array(slack),
                    pa.array(list(lists), pa.list_(pa.int64())),
                ],
                names=["id", "same", "prefix", "packed", "slack", "lists"],
            )

    return df.select(id_col, vec_col).mapInArrow(run, f"id {kind}, same binary, prefix binary, packed binary, slack float, lists array<bigint>")


def footrule(a: np.ndarray, b: np.ndarray) -> int:
    """Footrule distance of two orders of equal length L; a pivot that an order lacks counts as at place L. The sum of
    |place - place| is L(L+1) - 2 sum over common pivots of min(L - place)."""
    length = len(a)
    place = {int(p): k for k, p in enumerate(b)}
    common = sum(min(length - k, length - place[int(p)]) for k, p in enumerate(a) if int(p) in place)
    return length * (length + 1) - 2 * common


def depth_code(prefix: np.ndarray, slots: int = 24) -> np.ndarray:
    """A coding of orders by counts whose inner product is the common part of the footrule distance: for each depth t,
    which pivots are among the first t. Pivots share ``slots`` places, so the product is at times too large and never
    too small: a bound on the distance keeps all it would keep if computed pivot by pivot."""
    n, length = prefix.shape
    out = np.zeros((n, length, slots), np.float32)
    place = (prefix.astype(np.int64) * 40503 >> 4) % slots
    rows = np.arange(n)
    for i in range(length):
        for t in range(i, length):
            out[rows, t, place[:, i]] += 1
    return out.reshape(n, -1)


def _near(code: np.ndarray, x: np.ndarray, slack: np.ndarray, split: int | None, need: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list, or between its two blocks if ``split`` says where the second begins, that are near
    by footrule and whose cosine can reach ``least`` after all that packing may have taken from it."""

    def close(rows: slice, cols: slice) -> np.ndarray:
        return (code[rows] @ code[cols].T >= need) & (x[rows] @ x[cols].T + slack[rows, None] + slack[None, cols] >= least)

    if split is None and len(x) <= 512:
        return np.nonzero(np.triu(close(slice(None), slice(None)), 1))
    left, right = [], []
    end, first = (len(x), 0) if split is None else (split, split)
    for lo in range(0, end, 512):
        hi = min(lo + 512, end)
        begin = lo if split is None else first
        i, j = np.nonzero(close(slice(lo, hi), slice(begin, None)))
        i, j = i + lo, j + begin
        left.append(i[i < j])
        right.append(j[i < j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def candidate_pairs(reps: DataFrame, least: float, most_footrule: int) -> DataFrame:
    """``(a, b)`` of the vectors that share a posting list and are near by footrule, then by byte-coded cosine.

    A list longer than ``HOT_LIST`` is cut into blocks by the hash of the id and each pair of blocks becomes a unit of
    its own, so no task holds a list whole and no pair of it is lost."""
    spark = reps.sparkSession
    kind = reps.schema["id"].dataType.simpleString()
    postings = reps.select(F.explode("lists").alias("list"), "id", "prefix", "packed", "slack")
    hot = reps.select(F.explode("lists").alias("list")).groupBy("list").count().where(F.col("count") > HOT_LIST)
    hot = hot.select(F.col("list").alias("_hot"), F.ceil(F.col("count") / F.lit(HOT_LIST)).cast("int").alias("_blocks"))
    hot = materialize(hot, "hot-lists")
    found = hot.count()
    if found:  # a few names of long lists: broadcast if their number is checked to be small, else joined as they are
        hot = F.broadcast(hot) if found <= MOST_HOT else hot
        with_blocks = postings.join(hot, postings["list"] == hot["_hot"], "left").withColumn("n", F.coalesce("_blocks", F.lit(1)))
    else:
        with_blocks = postings.withColumn("n", F.lit(1))
    with_blocks = with_blocks.withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    units = with_blocks.select("id", "prefix", "packed", "slack", "list", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    units = units.select(F.struct("list", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).alias("unit"), "own", "id", "prefix", "packed", "slack")
    units = units.repartition("unit").sortWithinPartitions("unit", "own")
    units = units.select(F.col("unit.list").alias("list"), F.col("unit.x").alias("x"), F.col("unit.y").alias("y"), "own", "id", "prefix", "packed", "slack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in itertools.chain(batches, [None]):
            now = kept if b is None else pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            if now is None or not len(now):
                continue
            key = np.stack([now.column(c).to_numpy() for c in ("list", "x", "y")], 1)
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(now)]))
            # the last unit may go on in the next batch
            stop = len(edges) - 1 if b is None else len(edges) - 2
            kept = None if b is None else now.slice(edges[stop])
            if not stop:
                continue
            done = now.slice(0, edges[stop])
            prefix = np.frombuffer(b"".join(done.column("prefix").to_pylist()), np.uint16).reshape(len(done), -1)
            x = unpacked(np.frombuffer(b"".join(done.column("packed").to_pylist()), np.int8).reshape(len(done), -1))
            slack = done.column("slack").to_numpy()
            code = depth_code(prefix)
            length = prefix.shape[1]
            need = (length * (length + 1) - most_footrule) / 2
            own = done.column("own").to_numpy()
            left, right = [], []
            for lo, hi in zip(edges[:stop].tolist(), edges[1 : stop + 1].tolist()):
                if hi - lo < 2:
                    continue
                split = int(np.searchsorted(own[lo:hi], key[lo, 2])) if key[lo, 1] != key[lo, 2] else None
                i, j = _near(code[lo:hi], x[lo:hi], slack[lo:hi], split, need, least)
                if len(i):
                    left.append(i + lo)
                    right.append(j + lo)
            if left:
                ids = done.column("id").combine_chunks()
                i, j = ids.take(pa.array(np.concatenate(left))), ids.take(pa.array(np.concatenate(right)))
                yield pa.RecordBatch.from_arrays([pc.min_element_wise(i, j), pc.max_element_wise(i, j)], names=["a", "b"])

    return units.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def cosine(a: str, b: str):
    """Cosine of two array columns as a JVM expression."""

    def dot(x, y):
        return F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similar_classes(df: DataFrame, threshold: float = 0.95, id_col: str = "chunk_id", vec_col: str = "embedding", most_footrule: int = 48) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``members(id, rep)`` puts each usable vector in the class of its exact copies (the
    smallest id stands for it), ``links(a, b, similarity)`` are the pairs of class representatives with a cosine of
    ``threshold`` or more, the smaller id first.

    Vectors that are null, all zero, not finite, or not of the usual length are in no class. Copies cost one posting,
    so a group that holds a third of all rows stays one row in the index. Every vector is indexed; recall of the links
    is measured in the tests. Empty tables give empty results.
    """
    width, n = usual_width(df, vec_col)
    pivots = choose_pivots(df, id_col, vec_col, int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PIVOTS_PER_ROOT * math.sqrt(n)))), width)
    kind = df.schema[id_col].dataType.simpleString()
    if not len(pivots):
        empty = df.sparkSession.createDataFrame([], f"id {kind}, rep {kind}")
        return empty, df.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    index = materialize(index_vectors(df, id_col, vec_col, pivots), "vectors")
    heads = index.groupBy("same").agg(F.min("id").alias("rep"))
    members = materialize(index.select("id", "same").join(heads, "same").select("id", "rep").distinct(), "members")
    reps = materialize(index.join(members.where("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"]).drop("same"), "representatives")
    pairs = materialize(candidate_pairs(reps, threshold, most_footrule), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    vectors = materialize(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).join(wanted, "id", "left_semi").dropDuplicates(["id"]), "candidates")
    va = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"))
    vb = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    links = pairs.join(va, "a").join(vb, "b").select("a", "b", cosine("va", "vb").alias("similarity")).where(F.col("similarity") >= threshold)
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """The links of ``similar_classes`` between all members, copies of one vector included: ``(id_a, id_b)``, the
    smaller id first. For data in which a vector has few partners; else keep classes and links apart."""
    a, b = f"{id_col}_a", f"{id_col}_b"
    left = members.select(F.col("id").alias("ia"), F.col("rep").alias("a"))
    right = members.select(F.col("id").alias("ib"), F.col("rep").alias("b"))
    across = links.join(left, "a").join(right, "b").select("ia", "ib")
    several = members.groupBy("rep").count().where("count > 1").select("rep")
    copies = members.join(several, "rep", "left_semi")
    within = copies.select(F.col("id").alias("ia"), "rep").join(copies.select(F.col("id").alias("ib"), "rep"), "rep").where("ia < ib").select("ia", "ib")
    return across.unionByName(within).select(F.least("ia", "ib").alias(a), F.greatest("ia", "ib").alias(b)).distinct()


#: Pivots of the index for ``nearest`` and the places of an order kept; each vector is put in the inverted files of its
#: first ``FILED`` pivots, and a query reads those of its first ``READ`` ones.
NEAREST_PIVOTS, NEAREST_PREFIX, FILED, READ = 256, 16, 3, 8
#: Rows of one inverted file, and queries, that are one unit of work.
FILE_BLOCK, QUERY_BLOCK = 16_384, 1_024
#: Share of a file's rows, those nearest by footrule, that are ranked again by cosine; at least so many times k.
RANKED_SHARE, RANKED_K = 0.5, 8


def _best_of_file(ranks: np.ndarray, sims: np.ndarray, slack: np.ndarray, k: int, share: float) -> np.ndarray:
    """Of one query the positions in a file that may be among its ``k`` nearest: of the rows nearest by footrule (ties
    included), those whose cosine can be that of the k-th best after all that packing may have changed."""
    most = max(RANKED_K * k, math.ceil(share * len(ranks)))
    near = np.flatnonzero(ranks >= -np.partition(-ranks, most - 1)[most - 1]) if most < len(ranks) else np.arange(len(ranks))
    s, e = sims[near], slack[near]
    if len(near) > k:
        near = near[s + e >= -np.partition(-(s - e), k - 1)[k - 1]]
    return near


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "chunk_id", vec_col: str = "embedding", share: float = RANKED_SHARE, pivots: int = NEAREST_PIVOTS, filed: int = FILED, read: int = READ) -> DataFrame:
    """``(id_col, neighbour, similarity, rank)``: the ``k`` vectors of ``df`` most similar to each vector of
    ``queries``, itself left out.

    Every vector is posted in the inverted files of its first ``filed`` pivots; a query reads the files of its first
    ``read`` pivots. In each file the ``share`` of the rows with the smallest footrule distance is ranked again by the
    cosine of the packed vectors, and what may be among the k best is kept; the exact cosine of these decides. Files over
    ``FILE_BLOCK`` rows and queries over ``QUERY_BLOCK`` are cut into blocks by the hash of their ids, each pair of blocks a
    unit of work of bounded size, so neither many rows in one file nor many queries are held at once or passed over
    again. Results don't depend on partitions or batches.

    Ties go to the smaller id. Vectors that are not usable (``unusable_vectors``) are neither queries nor results; repeated
    rows count once; empty tables give no rows.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    width, _ = usual_width(df, vec_col)
    pv = choose_pivots(df, id_col, vec_col, pivots, width)
    if not len(pv):
        return spark.createDataFrame([], f"{id_col} {kind}, neighbour {kind}, similarity double, rank int")
    shared = spark.sparkContext.broadcast(pv)
    length = min(NEAREST_PREFIX, len(pv))

    def orders(lists: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x = unit_rows(b.column(1), width)
                if not len(x):
                    continue
                prefix = order_prefix(x, shared.value, length)
                packed, slack = packed_rows(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in prefix], pa.binary()), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(slack),
                        pa.array(list(prefix[:, :lists].astype(np.int32)), pa.list_(pa.int32())),
                    ],
                    names=["id", "prefix", "packed", "slack", "lists"],
                )

        return run

    index = f"id {kind}, prefix binary, packed binary, slack float, lists array<int>"
    own = materialize(df.select(id_col, vec_col).mapInArrow(orders(filed), index).dropDuplicates(["id"]), "orders")
    asked = materialize(queries.select(id_col, vec_col).mapInArrow(orders(read), index).dropDuplicates(["id"]), "questions")
    # how many blocks each file and its queries need: one row a pivot
    count = lambda t, name: t.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias(name))
    sizes = materialize(count(own, "rows").join(count(asked, "questions"), "list").select("list", F.ceil(F.col("rows") / FILE_BLOCK).cast("int").alias("nr"), F.ceil(F.col("questions") / QUERY_BLOCK).cast("int").alias("nq")), "files")
    sizes = F.broadcast(sizes)  # at most ``pivots`` rows
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    narrow = ["id", "prefix", "packed", "slack"]
    files = own.select(*narrow, F.explode("lists").alias("list")).join(sizes, "list")
    files = files.select("list", block("nr").alias("r"), every("nq").alias("q"), F.lit(1).alias("side"), *narrow)
    reads = asked.select(*narrow, F.explode("lists").alias("list")).join(sizes, "list")
    reads = reads.select("list", every("nr").alias("r"), block("nq").alias("q"), F.lit(0).alias("side"), *narrow)
    units = files.unionByName(reads).repartition("list", "r", "q").sortWithinPartitions("list", "r", "q", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(t: pa.Table) -> pa.RecordBatch | None:
            split = int(np.searchsorted(t.column("side").to_numpy(), 1))
            if not 0 < split < len(t):
                return None
            order = np.frombuffer(b"".join(t.column("prefix").to_pylist()), np.uint16).reshape(len(t), -1)
            x = unpacked(np.frombuffer(b"".join(t.column("packed").to_pylist()), np.int8).reshape(len(t), -1))
            slack = t.column("slack").to_numpy()
            ids = t.column("id").combine_chunks()
            keys = ids.to_numpy(zero_copy_only=False)
            # of each place in the orders the weight of its pivot: the common part of two orders is the sum over their
            # common pivots of the smaller weight, and the footrule distance falls as it grows
            weight = np.zeros((len(t) - split, len(shared.value)), np.int8)
            np.put_along_axis(weight, order[split:].astype(np.int64), np.arange(length, 0, -1, dtype=np.int8)[None].repeat(len(weight), 0), 1)
            weight = np.ascontiguousarray(weight.T)
            place = np.arange(length, 0, -1, dtype=np.int8)[:, None]
            left, right = [], []
            for lo in range(0, split, 64):
                sims = x[lo : min(lo + 64, split)] @ x[split:].T
                for q in range(len(sims)):
                    common = np.minimum(weight[order[lo + q]], place).sum(0, dtype=np.int16)
                    common[keys[split:] == keys[lo + q]] = -1
                    near = _best_of_file(common, sims[q], slack[split:] + slack[lo + q], k + 1, share)
                    left.append(np.full(len(near), lo + q))
                    right.append(near + split)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(left))), ids.take(pa.array(np.concatenate(right)))], names=["query", "neighbour"])

        kept = None
        for b in itertools.chain(batches, [None]):
            now = kept if b is None else pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            if now is None or not len(now):
                continue
            key = np.stack([now.column(c).to_numpy() for c in ("list", "r", "q")], 1)
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(now)])).tolist()
            stop = len(edges) - 1 if b is None else len(edges) - 2  # the last unit may go on in the next batch
            for lo, hi in zip(edges[:stop], edges[1 : stop + 1]):
                if (out := unit(now.slice(lo, hi - lo))) is not None:
                    yield out
            kept = None if b is None else now.slice(edges[stop])

    pairs = materialize(units.mapInArrow(search, f"query {kind}, neighbour {kind}").where("query != neighbour").distinct(), "near")
    rows = df.select(F.col(id_col).alias("neighbour"), F.col(vec_col).alias("v"))
    wanted = rows.join(pairs.select("neighbour").distinct(), "neighbour", "left_semi").dropDuplicates(["neighbour"])
    asked_v = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("w")).dropDuplicates(["query"])
    exact = pairs.join(wanted, "neighbour").join(asked_v, "query").select("query", "neighbour", cosine("v", "w").alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("query", id_col)
