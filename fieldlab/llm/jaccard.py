"""N-gram Jaccard join by a size-aware heavy-light split.

A document's set holds its distinct shingles of five words; with fewer words the whole
sequence is the one element, and without words the set is empty and linked with nothing.
Two documents link when their sets' Jaccard similarity reaches 3/4.

1. The groups of ``exchange`` learn how many documents hold each shingle.  Those that only
   one document holds can't be shared; the others are ranked rare to frequent.
2. Equal sets are one set from here on, known by a 64-bit hash.
3. *Light* sets, up to a size boundary, enumerate the subsets of exactly the overlap that a
   partner of each possible size must reach: equal subsets mean a link.  *Heavy* sets put
   the rarest ``n - ceil(3 n / 4) + 1`` shingles of their rank into inverted lists, which
   every linked pair shares, and so do light sets that may have heavy partners.  The
   boundary is where enumerating stops being cheaper than scanning, by measured counts.
4. Lists with the same members are scanned once, and without pairing their members: each
   of a few rounds compares a list's members with one pivot and gives linked sets one
   label.  A list whose members all share a label is done.  Then the pairs that are left
   between labels are compared, if what follows their first shared element can reach the
   overlap.  So a group of many near copies costs a few comparisons each, and no link
   between different components is missed.

All comparisons are exact over 64-bit shingle hashes.

Cases: null and empty texts have size 0 and are their own component; repeated rows are one
component; a null id is never a component's name unless it stands alone; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from . import textkit as tk
from .components import components
from .common import discard, free_name, materialize

SHINGLE = 5
#: Sizes above this are always heavy: the subsets of larger sets are too many.
LIGHT_LIMIT = 12
#: Rounds of comparisons with one member a list, before all that is left.
STAR_ROUNDS = 3

INFO = "doc_id long, n int, sid long, work double, singles int, tokens array<long>"


def need(a: int, b: int) -> int:
    """The overlap from which sets of a and b elements link: ceil(3 (a + b) / 7)."""
    return -(-3 * (a + b) // 7)


def prefix(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def partners(n: int) -> range:
    """The sizes that a set of n elements can link with."""
    return range(-(-3 * n // 4), 4 * n // 3 + 1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash), sorted and distinct."""
    starts, ends, begins = tk.words(data, offsets)
    h = tk.word_hashes(tk.LOWER[data], starts, ends)
    ok = tk.within(begins, size, len(h))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))
    docs, hashes = [doc[: len(ok)][ok]], [tk.gram_hashes(h, size)[ok]]
    for d in np.flatnonzero((np.diff(begins) > 0) & (np.diff(begins) < size)).tolist():
        own = h[begins[d] : begins[d + 1]]
        docs.append(np.array([d]))
        hashes.append(tk.gram_hashes(own, len(own)) ^ np.uint64(len(own)))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _group(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tk.text_buffers(tk.as_array(table.column("text")))
    docs, values = [], []
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + tk.CHUNK_BYTES, side="right")) - 1))
        d, v = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], size)
        docs.append(d + lo)
        values.append(v)
        lo = hi
    return np.concatenate(docs), np.concatenate(values)


def _counts(size: int):
    def extract(table: pa.Table) -> exchange.Asked:
        unique, count = np.unique(_group(table, size)[1], return_counts=True)
        return exchange.Asked(unique, count.astype("<u4"))

    return extract


def _level(total: np.ndarray) -> np.ndarray:
    """0 for shingles of one document, else 1 + 4 log2 of the documents, as a byte."""
    return np.where(total > 1, np.minimum(1 + 4 * np.log2(np.maximum(total, 1).astype(np.float64)), 255), 0).astype(np.uint8)


#: How many documents hold a shingle; more than 2**32 - 1 count as so many.
HOLDERS = exchange.Question("<u4", "u1", lambda values, starts: np.minimum(np.add.reduceat(values.astype(np.uint64), starts), 0xFFFFFFFF).astype("<u4"), _level)


def _describe(size: int):
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        level = exchange.in_order(answers, HOLDERS)
        doc, value = _group(table, size)
        code = level[np.searchsorted(np.unique(value), value)] if len(value) else level
        n_docs = table.num_rows
        cut = np.searchsorted(doc, np.arange(n_docs + 1))
        n = np.diff(cut)
        sid = np.zeros(n_docs, np.int64)
        some = np.flatnonzero(n)
        if len(some):
            sums = np.add.reduceat(tk.mix(value), cut[some])
            sid[some] = tk.mix(sums + n[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        order = np.lexsort((value, code, doc))
        value, code = value[order].view(np.int64), code[order]
        singles = np.bincount(doc, code == 0, n_docs).astype(np.int64)
        seen: set[int] = set()
        tokens, work = [], np.zeros(n_docs)
        for d in range(n_docs):
            first = prefix(int(n[d]))
            if n[d] == 0 or singles[d] >= first or int(sid[d]) in seen:
                tokens.append(None)
                continue
            seen.add(int(sid[d]))
            a, b = cut[d] + singles[d], cut[d + 1]
            tokens.append(value[a:b])
            work[d] = np.exp2((code[a : cut[d] + first].astype(float) - 1) / 4).sum()
        ids = table.column("doc_id")
        ids = pa.array(ids.to_pylist(), pa.int64())
        known = pa.array([None if k == 0 else s for k, s in zip(n.tolist(), sid.tolist(), strict=True)], pa.int64())
        return pa.table({"doc_id": ids, "n": pa.array(n.astype(np.int32)), "sid": known, "work": pa.array(work), "singles": pa.array(singles.astype(np.int32)), "tokens": pa.array(tokens, pa.list_(pa.int64()))} | {c: table.column(c) for c in table.column_names if c == "row"})

    return finish


def subsets(n: int, boundary: int) -> int:
    """How many keys a light set of n elements makes."""
    return sum(math.comb(n, need(n, m)) for m in partners(n) if m <= boundary)


def boundary_of(sets: DataFrame) -> int:
    """The size up to which enumerating all subsets costs less than scanning lists, by the
    sets' sizes and the documents in their lists."""
    rows = {r.n: (r.sets, r.work) for r in sets.where(F.col("n") <= LIGHT_LIMIT).groupBy("n").agg(F.count("*").alias("sets"), F.sum("work").alias("work")).collect()}
    cost = []
    for b in range(LIGHT_LIMIT + 1):
        light = sum(k * subsets(n, b) for n, (k, _) in rows.items() if n <= b)
        also = sum(w for n, (_, w) in rows.items() if n > b or 4 * n >= 3 * (b + 1))
        cost.append((light + also, b))
    return min(cost)[1]


def _keys(boundary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "sid", "n", "pos"]
        for batch in batches:
            n = batch.column("n").to_numpy()
            singles = batch.column("singles").to_numpy()
            sid = batch.column("sid").to_numpy()
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(), np.append(0, np.cumsum(tokens.value_lengths().to_numpy()))
            keys, owners, places = [], [], []
            for k in range(batch.num_rows):
                size, own = int(n[k]), flat[at[k] : at[k + 1]]
                if size > boundary or 4 * size >= 3 * (boundary + 1):
                    part = own[: prefix(size) - int(singles[k])]
                    keys.append(part)
                    owners.append(np.full(len(part), k))
                    places.append(np.arange(len(part)) + int(singles[k]))
                if size <= boundary:
                    ranked = np.sort(own).view(np.uint64)
                    for m in partners(size):
                        c = need(size, m)
                        if m > boundary or c > len(ranked):
                            continue
                        sets = np.array(list(itertools.combinations(range(len(ranked)), c)))
                        salt = np.uint64(min(size, m) * 64 + max(size, m))
                        made = tk.mix(tk.mix(ranked)[sets].sum(axis=1, dtype=np.uint64) ^ tk.mix(np.array([salt]))[0]).view(np.int64)
                        keys.append(made)
                        owners.append(np.full(len(made), k))
                        places.append(np.zeros(len(made), np.int64))
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sid[owner]), pa.array(n[owner].astype(np.int32)), pa.array(place.astype(np.int32))], names)

    return run


def _reach(nu: str, pu: str, nv: str, pv: str):
    """Whether sets of nu and nv elements can link if the elements at pu and pv of their
    ranks are the first that they share: what follows must reach the overlap."""
    left = F.least(F.col(nu) - F.col(pu), F.col(nv) - F.col(pv))
    return 7 * left >= 3 * (F.col(nu) + F.col(nv))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of pairs (u, v, ...) that link."""
    one = sets.select(F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    two = sets.select(F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    both = pairs.join(one, "u").join(two, "v").withColumn("shared", F.size(F.array_intersect("tu", "tv")))
    return both.where("100 * shared >= 75 * (nu + nv - shared)").drop("nu", "tu", "nv", "tv", "shared")


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def one_list_of_each(postings: DataFrame) -> DataFrame:
    """postings without lists of a single member, and with one list of each set of members.

    Of lists with the same members the one ranked first stays: a pair's first shared element
    is the first of its lists, so it is never lost.  Member sets are told apart by count and
    two sums of hashes.
    """
    lists = postings.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("sid", F.lit(1)).cast("decimal(38,0)")).alias("t"), F.min(F.struct("sid", "pos")).alias("first"))
    chosen = lists.where("c > 1").groupBy("c", "s", "t").agg(F.min(F.struct(F.col("first.pos"), F.col("key"))).alias("best"))
    return postings.join(chosen.select(F.col("best.key").alias("key")), "key")


def link_sets(sets: DataFrame, postings: DataFrame) -> DataFrame:
    """(node, root) of the sets that have links.

    ``root`` of a posting is a label that only connected sets share.  The first round
    compares each list's members with its least, the next ones with a member of the list's
    most frequent label, another one for each sixteenth of the lists; each round then lowers
    labels along the links found.  What is left between labels is compared in the last
    round, so rounds only save comparisons and never lose a link.
    """
    whole = materialize(postings, "all-postings")
    postings = before = materialize(one_list_of_each(whole).withColumn("root", F.col("sid")), "postings")
    discard(whole)
    links: list[DataFrame] = []
    pairs_kept: list[DataFrame] = []
    done: DataFrame | None = None
    for step in range(STAR_ROUNDS + 1):
        labels = postings.groupBy("key").agg((F.min("root") != F.max("root")).alias("apart"))
        left = materialize(postings.join(labels.where("apart").select("key"), "key"), "left")
        discard(before)
        before = left
        if left.isEmpty():
            break
        if step == STAR_ROUNDS:
            names = ("key", "sid", "n", "pos", "root")
            one = left.select("key", *(F.col(c).alias(f"{c}_u") for c in names[1:]))
            two = left.select("key", *(F.col(c).alias(f"{c}_v") for c in names[1:]))
            pairs = one.join(two, "key").where((F.col("sid_u") < F.col("sid_v")) & (F.col("root_u") != F.col("root_v")) & _reach("n_u", "pos_u", "n_v", "pos_v"))
        else:
            members = left
            if step:
                most = left.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).getField("root").alias("most"))
                members = left.join(most, "key")
            order = F.col("sid") if not step else F.xxhash64("sid", F.lit(step), F.pmod("key", F.lit(16)))
            chosen = members if not step else members.where("root = most")
            pivot = chosen.groupBy("key").agg(F.min(F.struct(order.alias("o"), "sid", "n", "pos", "root")).alias("p"))
            pairs = left.join(pivot, "key").select(F.col("p.sid").alias("sid_u"), F.col("p.n").alias("n_u"), F.col("p.pos").alias("pos_u"), F.col("p.root").alias("root_u"), F.col("sid").alias("sid_v"), F.col("n").alias("n_v"), F.col("pos").alias("pos_v"), F.col("root").alias("root_v"))
            fit = (4 * F.col("n_u") >= 3 * F.col("n_v")) & (4 * F.col("n_v") >= 3 * F.col("n_u"))
            pairs = pairs.where((F.col("root_u") != F.col("root_v")) & (fit if step else _reach("n_u", "pos_u", "n_v", "pos_v")))
        pairs = pairs.select(F.least("sid_u", "sid_v").alias("u"), F.greatest("sid_u", "sid_v").alias("v"), F.when(F.col("sid_u") < F.col("sid_v"), F.col("root_u")).otherwise(F.col("root_v")).alias("ru"), F.when(F.col("sid_u") < F.col("sid_v"), F.col("root_v")).otherwise(F.col("root_u")).alias("rv")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs = materialize(pairs, "pairs")
        pairs_kept.append(pairs)
        done = pairs.select("u", "v") if done is None else done.union(pairs.select("u", "v"))
        found = materialize(_linked(pairs, sets), "links")
        links.append(found)
        if step == STAR_ROUNDS:
            break
        both = found.select(F.col("ru").alias("old"), F.col("rv").alias("new")).union(found.select(F.col("rv").alias("old"), F.col("ru").alias("new")))
        lower = both.where("new < old").groupBy("old").agg(F.min("new").alias("new"))
        postings = salted(left, "sid", lower.withColumnRenamed("old", "root"), "root").select("key", "sid", "n", "pos", F.coalesce("new", "root").alias("root"))
        release(sets)
    if not links:
        return sets.sparkSession.createDataFrame([], "node long, root long")
    every = links[0].select("u", "v")
    for more in links[1:]:
        every = every.union(more.select("u", "v"))
    roots = materialize(components(every), "roots")
    for used in (before, *pairs_kept, *links):
        discard(used)
    return roots


#: Tasks that the rows of one label are spread over when something is joined to them.
SALTS = 8


def salted(rows: DataFrame, by: str, values: DataFrame, key: str) -> DataFrame:
    """rows left-joined with values, of which each key has one; a key's rows are spread by
    ``by`` over ``SALTS`` tasks."""
    names = [*rows.columns, *(c for c in values.columns if c != key)]
    many = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    some = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return some.join(many, [key, "salt"], "left").select(*names)


def labelled(docs: DataFrame, size: int, keyed: bool = False) -> DataFrame:
    """(doc_id, n, root) for every row of docs; sets that are linked have one root, and rows
    without words none.  ``keyed`` docs have a long ``row`` that stays with each row."""
    dealt = exchange.Exchange(docs, ("row",) * keyed)
    info = dealt.finish(dealt.ask(_counts(size), HOLDERS), _describe(size), INFO + ", row long" * keyed)
    info = materialize(info, "sets")
    release(docs)
    sets = materialize(info.where("tokens is not null").select("sid", "n", "work", "singles", "tokens").dropDuplicates(["sid"]), "distinct-sets")
    release(docs)
    postings = sets.select("sid", "n", "singles", "tokens").mapInArrow(_keys(boundary_of(sets)), "key long, sid long, n int, pos int")
    roots = link_sets(sets, postings)
    rows = info.select("doc_id", "n", "sid", *("row",) * keyed).join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    return rows.drop("sid")


def join(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    rows = labelled(docs, size)
    names = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    return salted(rows, "doc_id", names.where("rows > 1").drop("rows"), "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, of which each component keeps one row of
    its smallest id; rows without id stay.  Rows are known by id and text, so an id may
    stand for several texts; rows alike in both are one."""
    name = free_name(docs.columns, "row")
    key = F.xxhash64("doc_id", "text")
    rows = labelled(docs.select("doc_id", "text", key.alias("row")), size, keyed=True).where("doc_id is not null")
    rows = rows.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("root").alias("root"), F.count("*").alias("rows"))
    best = F.min(F.struct("doc_id", "row", "rows")).alias("best")
    keep = rows.groupBy("root", F.when(F.col("root").isNull(), F.col("row")).alias("alone")).agg(best)
    keep = materialize(keep.select(F.col("best.row").alias(name), F.col("best.rows").alias("rows")), "kept")
    known = docs.where("doc_id is not null").withColumn(name, key)
    once = known.join(keep.where("rows = 1").select(name), name, "left_semi").select(*docs.columns)
    more = known.join(keep.where("rows > 1").select(name), name, "left_semi").dropDuplicates([name]).select(*docs.columns)
    return once.union(more).union(docs.where("doc_id is null"))
