"""MinHash near-duplicates by an inverted join of signature coordinates.

A document's set holds its distinct shingles of four words; with fewer words the whole
sequence is the one element, and without words the set is empty and linked with nothing.
Two documents link when their sets' Jaccard similarity reaches 4/5.

1. Each set gets a signature of ``COORDINATES`` minima of independent hashes.  Equal sets are
   one set from here on, known by a 64-bit hash.
2. Every signature posts its set under each (coordinate, value) pair.  How many sets a pair
   holds is learnt by ``exchange``, where a pair that a third of all sets share is sent once a
   group of sets; pairs are ranked rare to frequent.
3. *Prefix*: two signatures with ``MATCHES`` equal coordinates share one of the rarest
   ``COORDINATES - MATCHES + 1`` of their rank, so only these go into inverted lists, and of
   them only those that more than one set holds.
4. Lists are merged from both ends of a pair without pairing all their members: each of a few
   rounds compares a list's members with one pivot and gives linked sets one label; then the
   pairs that are left between labels are compared.  A pair is met in any number of lists, but
   counted once.
5. *Skip*: the long lists behind the prefix are never scanned.  The collisions of a pair that
   the short lists brought up are counted by looking its coordinates up in both signatures,
   and pairs below ``MATCHES`` go.
6. What is left is confirmed on the full sets of shingles, so no link is false.

Sets that stand in any list also learn how many of their shingles no other such set holds, and
how far they are from the first pivot that they were compared with.  A link needs an overlap of
4/9 of both sizes, that is a difference of at most 1/9 of them.  So a set that was edited too
much for any partner leaves the lists, and a pair is compared only if what either can share
reaches the overlap and what is known of both differences from one pivot leaves a difference
small enough.  The pivots of the first round are the least edited sets.  In a large group of
near copies this spares nearly all pairs that aren't linked, and none that is.

A link at similarity s is missed with the chance that fewer than ``MATCHES`` of
``COORDINATES`` minima agree: for 36 of 64 that is 4e-6 at s = 0.80 and 8e-9 at 0.85.

Cases: null and empty texts have size 0 and are their own component; texts of any length are
hashed whole, in the memory of a few times their size; repeated rows are one component; a null
id is never a component's name unless it stands alone, and then it is kept; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from . import textkit as tk
from .common import discard, materialize, partitions
from .components import components
from .jaccard import HOLDERS, one_list_of_each, release, shingles

SHINGLE = 4
COORDINATES = 64
#: Equal coordinates from which a pair is confirmed on its full sets.
MATCHES = 36
PREFIX = COORDINATES - MATCHES + 1
#: Rounds of comparisons with one member a list, before all that is left.
STAR_ROUNDS = 3

_rng = np.random.default_rng(20)
_SALT = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)
_ODD = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, COORDINATES) minima, as the upper 32 bits of a hash, of the runs of values."""
    out = np.empty((len(starts), COORDINATES), "<u4")
    for k in range(COORDINATES if len(starts) else 0):
        h = (values ^ _SALT[k]) * _ODD[k]
        h ^= h >> np.uint64(32)
        h *= _ODD[k]
        out[:, k] = np.minimum.reduceat(h, starts) >> np.uint64(32)
    return out


SETS = "doc_id long, row long, n int, sid long, signature binary"


def _sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document of a chunk: how many elements, the hash of its set; and (documents with
    elements, where their elements begin)."""
    doc, value = shingles(data, offsets, size)
    n = np.bincount(doc, minlength=len(offsets) - 1)
    some = np.flatnonzero(n)
    starts = np.append(0, np.cumsum(n[some]))[:-1].astype(np.int64)
    sid = np.zeros(len(n), np.int64)
    if len(some):
        sums = np.add.reduceat(tk.mix(value), starts)
        sid[some] = tk.mix(sums + n[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return n, sid, value, starts


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in tk.chunks(batch, "text"):
                n, sid, value, starts = _sets(data, offsets, size)
                made = iter(signatures(value, starts))
                sig = [next(made).tobytes() if k else None for k in n.tolist()]
                known = pa.array(sid, mask=n == 0)
                ids, row = (batch.column(c).slice(lo, hi - lo).cast(pa.int64()) for c in ("doc_id", "row"))
                yield pa.RecordBatch.from_arrays([ids, row, pa.array(n.astype(np.int32)), known, pa.array(sig, pa.binary())], ["doc_id", "row", "n", "sid", "signature"])

    return run


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tk.chunks(batch, "text"):
                n, sid, value, starts = _sets(data, offsets, size)
                tokens = pa.ListArray.from_arrays(pa.array(np.append(starts, len(value)).astype(np.int32)), pa.array(value.view(np.int64)))
                sig = signatures(value, starts).view("<i4")
                places = pa.array(np.arange(0, sig.size + 1, COORDINATES, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(sid[n > 0]), pa.ListArray.from_arrays(places, pa.array(sig.ravel())), tokens], ["sid", "signature", "tokens"])

    return run


def _coordinates(table: pa.Table) -> np.ndarray:
    """(sets, COORDINATES) keys: one for each coordinate and value, none for two of them."""
    raw, _ = tk.text_buffers(tk.as_array(table.column("text")))
    sig = np.frombuffer(raw.tobytes(), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
    return tk.mix(sig * np.uint64(COORDINATES) + np.arange(COORDINATES, dtype=np.uint64))


def _ask(table: pa.Table) -> exchange.Asked:
    unique, count = np.unique(_coordinates(table), return_counts=True)
    return exchange.Asked(unique, count.astype("<u4"))


POSTINGS = "key long, sid long, n int, pos int"


def _post(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The rarest PREFIX coordinates of each set, without those that no other set holds."""
    key = _coordinates(table)
    level = exchange.in_order(answers, HOLDERS)
    code = level[np.searchsorted(np.unique(key), key)] if key.size else np.zeros(key.shape, np.uint8)
    order = np.argsort(key, axis=1)
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(code, order, 1), axis=1, kind="stable"), 1)[:, :PREFIX]
    row, pos = np.nonzero(np.take_along_axis(code, order, 1))
    keys = key[row, order[row, pos]].view(np.int64)
    take = pa.array(row)
    return pa.table({"key": pa.array(keys), "sid": tk.as_array(table.column("doc_id")).take(take), "n": tk.as_array(table.column("n")).take(take), "pos": pa.array(pos.astype(np.int32))})


#: Two sets to compare, their labels, and the pivot among them with its rank among pivots.
PAIR = ("u", "v", "ru", "rv", "pivot", "rank")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with enough collisions, with ``x``, the elements in which their full sets
    differ, and ``linked``.  Each set is fetched once, with its signature."""
    side = lambda key, s, t: sets.select(F.col("sid").alias(key), F.col("signature").alias(s), F.col("tokens").alias(t))
    both = pairs.join(side("u", "s", "tu"), "u").join(side("v", "t", "tv"), "v")
    collisions = F.aggregate(F.zip_with("s", "t", lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    x = F.size("tu") + F.size("tv") - 2 * F.size(F.array_intersect("tu", "tv"))
    likely = both.where(collisions >= MATCHES).select(*PAIR, x.alias("x"), (F.size("tu") + F.size("tv")).alias("sizes"))
    return materialize(likely.select(*PAIR, "x", (9 * F.col("x") <= F.col("sizes")).alias("linked")), "compared")


def _fit():
    """Whether u and v can link, by their sizes and what no other set shares with them.

    What both share has none of the elements that one holds alone.  And with x the elements in
    which a set differs from a pivot, u and v differ in x_u + x_v less twice those that x_u and
    x_v have in common, which again are none that one of them holds alone.
    """
    sizes = F.col("n_u") + F.col("n_v")
    near = 9 * F.least(F.col("n_u") - F.col("own_u"), F.col("n_v") - F.col("own_v")) >= 4 * sizes
    common = lambda c: F.greatest(F.col(f"x_{c}") - F.col(f"own_{c}"), F.lit(0))
    apart = (F.col("p_u") == F.col("p_v")) & (9 * (F.col("x_u") + F.col("x_v") - 2 * F.least(common("u"), common("v"))) > sizes)
    return near & ~F.coalesce(apart, F.lit(False))


def _own(sets: DataFrame) -> DataFrame:
    """(sid, own): how many elements of each of the sets no other of them holds."""
    holders = sets.select("sid", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"), F.min("sid").alias("sid"))
    return holders.where("c = 1").groupBy("sid").agg(F.count("*").cast("int").alias("own"))


#: What a posting says of its set; p and x: a pivot, and in how many elements they differ.
MEMBER = ("sid", "n", "own", "p", "x", "root")


def _pairs(left: DataFrame, step: int) -> DataFrame:
    """(u, v, ru, rv, pivot, rank) to compare in this round: with one pivot of each list, or in the last
    round all that is left between the labels of a list."""
    side = lambda c: left.select("key", *(F.col(x).alias(f"{x}_{c}") for x in left.columns if x != "key"))
    if step == STAR_ROUNDS:
        # a pair meets in the first of its lists only
        left = left.withColumn("met", F.collect_list("key").over(Window.partitionBy("sid").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)))
        met = side("u").join(side("v"), "key").where((F.col("sid_u") < F.col("sid_v")) & (F.col("root_u") != F.col("root_v")) & _fit() & ~F.arrays_overlap("met_u", "met_v"))
    else:
        members, order = left, F.struct(F.col("own") / F.col("n"), F.col("sid"))
        if step:
            # a member of the most frequent label, another one for each sixteenth of the lists
            most = left.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).getField("root").alias("most"))
            members = left.join(most, "key").where("root = most")
            order = F.xxhash64("sid", F.lit(step), F.pmod("key", F.lit(16)))
        pivot = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), *MEMBER)).alias("p"))
        met = side("v").join(pivot.select("key", *(F.col(f"p.{x}").alias(f"{x}_u") for x in MEMBER)), "key")
    met = met.where((F.col("root_u") != F.col("root_v")) & _fit())
    ahead = F.col("sid_u") < F.col("sid_v")
    return met.select(F.least("sid_u", "sid_v").alias("u"), F.greatest("sid_u", "sid_v").alias("v"), F.when(ahead, F.col("root_u")).otherwise(F.col("root_v")).alias("ru"), F.when(ahead, F.col("root_v")).otherwise(F.col("root_u")).alias("rv"), F.col("sid_u").alias("pivot"), (F.col("own_u") / F.col("n_u")).alias("rank")).dropDuplicates(["u", "v"])


def _differences(compared: DataFrame) -> DataFrame:
    """(sid, p, x): the first in rank of the pivots that each set was compared with, so that the
    sets of a group have the same one; pivots were compared with themselves."""
    sid = F.when(F.col("u") == F.col("pivot"), F.col("v")).otherwise(F.col("u"))
    rows = compared.select(sid.alias("sid"), "rank", F.col("pivot").alias("p"), "x").union(compared.select(F.col("pivot").alias("sid"), "rank", F.col("pivot").alias("p"), F.lit(0).alias("x")))
    return rows.groupBy("sid").agg(F.min(F.struct("rank", "p", "x")).alias("b")).select("sid", "b.p", "b.x")


def _linked(able: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the sets that have links; able: (key, sid, n, own).

    ``root`` of a posting is a label that only connected sets share.  Rounds only save
    comparisons: whatever no round has compared and no label joins is compared in the last.
    """
    spark = able.sparkSession
    left = able.withColumns({"p": F.lit(None).cast("long"), "x": F.lit(None).cast("int"), "root": F.col("sid")})
    before, asked, links = None, [], []
    for step in range(STAR_ROUNDS + 1):
        apart = left.groupBy("key").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("key")
        now = materialize(left.join(apart, "key"), "left")
        discard(before)
        before = now
        if now.isEmpty():
            break
        pairs = _pairs(now, step)
        if asked:
            known = reduce(DataFrame.union, (earlier.select("u", "v") for earlier in asked))
            pairs = pairs.join(known, ["u", "v"], "left_anti")
        asked.append(materialize(pairs, "pairs"))
        links.append(_compared(asked[-1], sets))
        found = links[-1].where("linked")
        both = found.select(F.col("ru").alias("root"), F.col("rv").alias("new")).union(found.select(F.col("rv").alias("root"), F.col("ru").alias("new")))
        lower = both.where("new < root").groupBy("root").agg(F.min("new").alias("new"))
        sizes = now.groupBy("root").agg(F.count("*").alias("rows"))
        left = spread(now, "sid", lower.join(sizes, "root"), "root", "new").withColumn("root", F.coalesce("new", "root")).drop("new")
        if not step:
            left = left.drop("p", "x").join(_differences(links[0]), "sid", "left")
        left = left.select("key", *MEMBER)
        release(sets)
    every = spark.createDataFrame([], "u long, v long")
    for found in links:
        every = every.union(found.where("linked").select("u", "v"))
    roots = materialize(components(every), "roots")
    for used in (before, *asked, *links):
        discard(used)
    return roots


def spread(rows: DataFrame, by: str, values: DataFrame, key: str, value: str) -> DataFrame:
    """rows left-joined with ``value`` of values(key, value, rows), one row a key.

    ``values.rows`` counts a key's rows.  A key with more than a task's even share is dealt
    to as many tasks as it has shares, by ``by``; there are fewer such keys than tasks, so
    their table is broadcast whatever the input's size.
    """
    tasks = partitions(rows.sparkSession)
    share = max(1, rows.count() // tasks)
    salts = F.ceil(F.col("rows") / F.lit(share)).cast("int")
    hot = F.broadcast(values.where(F.col("rows") > share).select(key, salts.alias("salts")))
    many = values.select(key, value, F.explode(F.sequence(F.lit(0), F.when(F.col("rows") > share, salts).otherwise(F.lit(1)) - 1)).alias("salt"))
    some = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return some.join(many, [key, "salt"], "left").drop("salt")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    info = materialize(rows.mapInArrow(_sign(size), SETS), "signed")
    known = info.where("sid is not null")
    signed = materialize(known.groupBy("sid").agg(F.first("n").alias("n"), F.first("signature").alias("signature")), "signatures")
    dealt = exchange.Exchange(signed.select(F.col("sid").alias("doc_id"), F.col("signature").alias("text"), "n"), ("n",))
    posted = materialize(dealt.finish(dealt.ask(_ask, HOLDERS), _post, POSTINGS), "all-postings")
    postings = materialize(one_list_of_each(posted), "postings")
    discard(posted)
    release(docs)
    # the full sets of what stands in any list, from one row of each
    wanted = known.join(postings.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("row").alias("row"))
    texts = rows.join(wanted.select("row"), "row", "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_whole(size), "sid long, signature array<int>, tokens array<long>").dropDuplicates(["sid"]), "whole-sets")
    edited = postings.select("key", "sid", "n").join(_own(sets), "sid", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    able = materialize(edited.where("5 * own <= n").select("key", "sid", "n", "own"), "able")
    roots = _linked(able, sets)
    for used in (signed, postings, sets, able):
        discard(used)
    # one row a set, so that the rows of copies are counted before they meet
    ids = known.groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    ids = ids.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    names = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    several = spread(ids, "sid", names.join(ids.groupBy("root").agg(F.count("*").alias("rows")), "root"), "root", "component_id").select("sid", "component_id", "rows")
    several = materialize(several, "names")
    out = spread(info, "row", several, "sid", "component_id")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
