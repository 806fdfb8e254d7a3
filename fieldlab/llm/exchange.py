"""Asking, for every hash of a corpus, what the other documents have.

Documents are dealt to *groups* of a few MB by a hash of the whole row, so no source, key or
group of copies can crowd one.  A group sends the distinct hashes of its documents to
*buckets* of the hash space, one packed blob a bucket; a bucket answers each group with one
blob.  A hash that a third of all rows hold is sent once by each group, so buckets stay
even; the rows that Spark shuffles are blobs, not hashes.

Beyond ``RELAY_BUCKETS`` buckets a blob from one group to one bucket would hold few hashes,
and blobs would grow as groups times buckets.  Then relays stand in between: a group sends
to a few *ranges* of the hash space, a relay merges one range of a batch of groups, asks the
range's buckets and hands the answers back.  With about as many ranges as buckets a range,
and as many groups a batch, rows grow as groups times the square root of the buckets.

All passes over the documents read one shuffle of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, partitions

#: Bytes of text in a group, and hashes in a bucket, on average.
GROUP_BYTES, BUCKET_HASHES = 2 << 20, 3 << 19
RELAY_BUCKETS = 2048


def group_count(total_bytes: int) -> int:
    return max(1, -(-total_bytes // GROUP_BYTES))


def bucket_count(total_bytes: int, least: int) -> int:
    """Buckets for about one hash in 6 bytes of text."""
    return max(least, -(-total_bytes // (6 * BUCKET_HASHES)))


def group_of(groups: int):
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups).cast("long"))


def sort_table(table: pa.Table) -> pa.Table:
    """Rows of a group in one order, however they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class Asked(NamedTuple):
    """What a group asks about: hashes in ascending order, a value for each, and for
    questions that 64 bits don't tell apart well enough a second, independent hash."""

    hashes: np.ndarray
    values: np.ndarray
    check: np.ndarray | None = None


def split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes: bucket numbers present, and where each begins and ends."""
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return none, none, none
    owner = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(owner, prepend=owner[:1] + np.uint64(1)))
    return owner[cut].astype(np.int64), cut, np.append(cut[1:], len(hashes))


def pack(values: np.ndarray) -> bytes:
    """Values by byte planes, compressed: planes of small numbers take next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind: str) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(hashes: np.ndarray) -> bytes:
    """Sorted hashes as their differences."""
    return pack(np.diff(hashes, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, "<u8"), dtype=np.uint64)


SENT = "bucket long, g long, keys binary, checks binary, data binary"
ANSWER = "g long, bucket long, data binary"
#: The type of second hashes: with the first, 96 bits.
CHECK = "<u4"

Extract = Callable[[pa.Table], Asked]


class Question(NamedTuple):
    """How values of equal hashes are put together.

    sent, answered: dtypes of values and answers; combine(values, run starts): one value for
    each run of equal hashes, associative; final(combined): the answers.
    """

    sent: str
    answered: str
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    final: Callable[[np.ndarray], np.ndarray]
    checked: bool = False
    #: reply(hashes, values, answers): what goes back for one group's blob, if not the answers.
    reply: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None


def _blobs(g: int, asked: Asked, buckets: int) -> pa.Table:
    owner, lo, hi = split(asked.hashes, buckets)
    spans = list(zip(lo.tolist(), hi.tolist(), strict=True))
    checks = [None if asked.check is None else pack(asked.check[a:b]) for a, b in spans]
    return pa.table({"bucket": pa.array(owner, pa.int64()), "g": pa.array([g] * len(owner), pa.int64()), "keys": pa.array([pack_keys(asked.hashes[a:b]) for a, b in spans], pa.binary()), "checks": pa.array(checks, pa.binary()), "data": pa.array([pack(asked.values[a:b]) for a, b in spans], pa.binary())})


class Received:
    """The hashes of several blobs, sorted, in runs of equal ones."""

    def __init__(self, table: pa.Table, q: Question):
        keys = [unpack_keys(k) for k in table.column("keys").to_pylist()]
        self.cut = np.append(0, np.cumsum([len(k) for k in keys]))
        self.key = np.concatenate(keys)
        self.values = np.concatenate([unpack(v, q.sent) for v in table.column("data").to_pylist()])
        check = np.concatenate([unpack(v, CHECK) for v in table.column("checks").to_pylist()]) if q.checked else None
        self.order = np.argsort(self.key, kind="stable") if check is None else np.lexsort((check, self.key))
        ranked = self.key[self.order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        if check is not None:
            check = check[self.order]
            fresh[1:] |= check[1:] != check[:-1]
        self.starts = np.flatnonzero(fresh)
        self.run_of = np.cumsum(fresh) - 1
        merged = q.combine(self.values[self.order], self.starts) if len(ranked) else self.values
        self.merged = Asked(ranked[self.starts], merged, None if check is None else check[self.starts])

    def answers(self, table: pa.Table, per_run: np.ndarray, q: Question, reply: bool = True) -> pa.Table:
        """One row for each blob, with an answer for each of its hashes."""
        back = np.empty(len(self.key), q.answered)
        back[self.order] = per_run[self.run_of]
        data = []
        for a, b in zip(self.cut[:-1].tolist(), self.cut[1:].tolist(), strict=True):
            if q.reply is None or not reply:
                data.append(pack(back[a:b]))
            else:
                hashes, answers = q.reply(self.key[a:b], self.values[a:b], back[a:b])
                data.append(len(hashes).to_bytes(8, "little") + (pack_keys(hashes) + pack(answers) if len(hashes) else b""))
        return pa.table({"g": table.column("g").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int64()), "data": pa.array(data, pa.binary())})


def _answer(q: Question, reply: bool):
    def run(table: pa.Table) -> pa.Table:
        got = Received(table, q)
        out = got.answers(table, q.final(got.merged.values), q, reply)
        del got
        pa.default_memory_pool().release_unused()
        return out

    return run


def _merge(q: Question, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        return _blobs(table.column("relay")[0].as_py(), Received(table, q).merged, buckets)

    return run


def _hand_back(q: Question):
    def run(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        return Received(blobs, q).answers(blobs, in_order(answers, q), q)

    return run


def in_order(answers: pa.Table, q: Question) -> np.ndarray:
    """Answers in the order of the hashes asked."""
    parts = [unpack(v, q.answered) for v in answers.sort_by("bucket").column("data").to_pylist()]
    pa.default_memory_pool().release_unused()
    return np.concatenate(parts) if parts else np.zeros(0, q.answered)


def replies(answers: pa.Table, q: Question) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, answers) that ``reply`` sent, ascending."""
    hashes, found = [np.zeros(0, np.uint64)], [np.zeros(0, q.answered)]
    for raw in answers.sort_by("bucket").column("data").to_pylist():
        if n := int.from_bytes(raw[:8], "little"):
            import zstandard

            reader = zstandard.ZstdDecompressor().decompressobj()
            keys = reader.decompress(raw[8:])
            hashes.append(np.cumsum(np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64))
            found.append(unpack(reader.unused_data, q.answered))
    return np.concatenate(hashes), np.concatenate(found)


class Exchange:
    """Documents dealt to groups, and as many questions about them as wanted."""

    def __init__(self, docs: DataFrame, also: tuple[str, ...] = ()):
        """``also`` names columns of docs besides doc_id and text that groups need."""
        total = bytes_of(docs, "text")
        self.groups = group_count(total)
        self.buckets = bucket_count(total, 1 if total < GROUP_BYTES else partitions(docs.sparkSession))
        self.ranges = math.isqrt(self.buckets) if self.buckets > RELAY_BUCKETS else 0
        if self.ranges:
            self.buckets = self.ranges * -(-self.buckets // self.ranges)
        self.dealt = docs.select("doc_id", "text", *also, group_of(self.groups).alias("g")).repartition("g")

    def ask(self, extract: Callable[..., Asked], q: Question, known: DataFrame | None = None) -> DataFrame:
        """Answers (g, bucket, data) to what ``extract(group)`` asks; with ``known`` answers to
        an earlier question it is ``extract(group, answers)``."""
        to = self.ranges or self.buckets

        def send(table: pa.Table) -> pa.Table:
            return _blobs(table.column("g")[0].as_py(), extract(sort_table(table)), to)

        def send_again(table: pa.Table, answers: pa.Table) -> pa.Table:
            return _blobs(table.column("g")[0].as_py(), extract(sort_table(table), answers), to)

        if known is None:
            blobs = self.dealt.groupBy("g").applyInArrow(send, SENT)
        else:
            blobs = self.dealt.groupBy("g").cogroup(known.groupBy("g")).applyInArrow(send_again, SENT)
        if not self.ranges:
            return blobs.groupBy("bucket").applyInArrow(_answer(q, True), ANSWER)
        batches = max(1, self.groups // self.ranges)
        first = blobs.withColumn("relay", F.col("bucket") * F.lit(batches).cast("long") + F.pmod("g", F.lit(batches).cast("long"))).repartition("relay")
        merged = first.groupBy("relay").applyInArrow(_merge(q, self.buckets), SENT)
        got = merged.groupBy("bucket").applyInArrow(_answer(q, False), ANSWER)
        return first.groupBy("relay").cogroup(got.groupBy("g")).applyInArrow(_hand_back(q), ANSWER)

    def finish(self, answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """Rows of ``run(group, answers)`` for every group."""
        return self.dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(lambda table, found: run(sort_table(table), found), schema)
