"""Repeated passages by a depth-limited radix sort of suffixes, most significant digit first.

Every window of THRESHOLD bytes is ordered by three digits. The first is its least gram: of the GRAM-byte strings in the
window the one of least hash, the leftmost of equals. Neighbouring windows share it, so a run of them is one entry, some
38 bytes of text a run. The second is the run's whole context, the bytes from the first window's start to the last one's
end: where it equals an earlier run's, all its windows repeat. Only runs that share their gram but not their context go on
to the last digit, the window itself, which ends the sort at the threshold: equal windows are exactly the repeated ones.

Passes leave behind what they have decided: a gram that occurs once is done after the first digit. Digits are 64-bit
hashes that only meet within the digit before, so two windows are taken as equal by a gram's and their own hash together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hot_keys, join_hot, materialize, release

THRESHOLD, GRAM = 100, 16
#: Grams in a window, and the most windows that share one.
SPAN = THRESHOLD - GRAM + 1
#: Windows are found in stretches of this many, so that a long text takes no more memory than a short one.
STRETCH = 1 << 18
#: Rows for each text come to it by broadcast up to this many texts and this many entries in all (8 bytes each), else by a shuffle.
BROADCAST_TEXTS, BROADCAST_ENTRIES = 500_000, 8_000_000
#: A gram is hot if it has more than a quarter of an average partition's runs, and at least HOT_RUNS; there are at most LISTED for each partition.
HOT_RUNS, LISTED = 1_000, 8

_U = np.uint64
_LOW = _U((1 << 24) - 1)
NO_ID = (1 << 63) - 1


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two numbers in this order."""
    x = a * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x += b
    x *= _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    return x


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 bytes and the 4 bytes from every place of a text as numbers."""
    two = raw[:-1].astype(np.uint64) | (raw[1:].astype(np.uint64) << _U(8))
    four = two[:-2] | (two[2:] << _U(16))
    return four[:-4] | (four[4:] << _U(32)), four


def _window_hash(grams: np.ndarray, four: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the 100 bytes from each place: six grams and four bytes."""
    h = grams[at]
    for k in range(1, THRESHOLD // GRAM):
        h = _mixed(h, grams[at + k * GRAM])
    return _mixed(h, four[at + THRESHOLD - 4])


def least_grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram hash and the 4 bytes at each place, and for each window's start the place of its least gram."""
    eight, four = _words(raw)
    grams = _mixed(eight[:-8], eight[8:])
    least, width = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), 1
    while width * 2 <= SPAN:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    return grams, four, (least & _LOW).astype(np.int64)


def runs_of(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows that share their least gram: gram, context, first window's start and number of windows, a stretch at a time."""
    for begin in range(0, len(raw) - THRESHOLD + 1, STRETCH):
        grams, four, place = least_grams(raw[begin : begin + STRETCH + THRESHOLD - 1])
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], len(place)) - 1
        at = place[first]
        shape = ((at - first) * STRETCH + (last - first)).astype(np.uint64)
        context = _mixed(_mixed(_window_hash(grams, four, first), _window_hash(grams, four, last)), shape)
        yield grams[at].view(np.int64), context.view(np.int64), first + begin, last - first + 1


def windows_of(start: np.ndarray, n: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some runs, given their bytes: the run's number, the window's start in its text, its gram and its hash."""
    grams, four, place = least_grams(np.frombuffer(b"".join(bodies), dtype=np.uint8))
    size = n + THRESHOLD - 1
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[row] + within
    return row, start[row] + within, grams[place[at]].view(np.int64), _window_hash(grams, four, at).view(np.int64)


def _raw(texts: pa.Array) -> Iterator[np.ndarray]:
    for text in texts:
        body = text.as_buffer() if text.is_valid else None
        yield np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)


def _seen(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether an equal pair stands earlier in the arrays."""
    order = np.lexsort((second, first))
    again = np.zeros(len(first), dtype=bool)
    again[order[1:]] = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    return again


ENTRIES = pa.schema([("gram", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("again", pa.bool_()), ("deal", pa.int64())])


def entries(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """One row for each run of windows of each text; a run that repeats within its text is marked, and adjacent ones are one row.

    ``deal`` is what the row is dealt by: its gram, but for hot grams and decided runs something that spreads.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, uid, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch.column(2)), strict=True):
                if len(raw) < THRESHOLD:
                    continue
                gram, context, start, n = (np.concatenate(x) for x in zip(*runs_of(raw), strict=True))
                again = _seen(gram, context)
                if again.any():  # decided runs that adjoin are one row
                    head = ~again | ~np.concatenate([[False], again[:-1]])
                    n = np.add.reduceat(n, np.flatnonzero(head))
                    gram, context, start, again = gram[head], context[head], start[head], again[head]
                found.append((gram, context, np.full(len(gram), doc), np.full(len(gram), uid), start, n, again))
            if found:
                gram, context, doc, uid, start, n, again = (np.concatenate(x) for x in zip(*found, strict=True))
                spread = _mixed((gram ^ uid).view(np.uint64), start.astype(np.uint64)).view(np.int64)
                deal = np.where(again | np.isin(gram, hot), spread, gram)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((gram, context, doc, uid, start, n, again, deal), ENTRIES.types, strict=True)], schema=ENTRIES)

    return docs.select("doc", "uid", "text").mapInArrow(cut, "gram long, context long, doc long, uid long, start int, n int, again boolean, deal long")


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Grams with more runs than a quarter of an average partition's, counted with the losses of a bounded list for each partition.

    A gram so frequent is frequent in some partition, and stays in that one's list. They are at most LISTED for each partition.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = 1 / (LISTED * parts)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, held, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0, 0

        def settle() -> None:
            nonlocal keys, counts, waiting, held
            both, where = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, np.ones(held)]), minlength=len(both)).astype(np.int64)
            keep = counts > share * seen / 2
            keys, counts, waiting, held = both[keep], counts[keep], [], 0

        for batch in batches:
            for raw in _raw(batch.column(0)):
                if len(raw) >= THRESHOLD:
                    own = np.concatenate([np.unique(r[0]) for r in runs_of(raw)])
                    waiting.append(own)
                    held, seen = held + len(own), seen + len(own)
                    if held > 1 << 20:
                        settle()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, 0)), pa.array(np.append(counts, 0)), pa.array(np.append(np.zeros(len(keys), np.int64), seen))], names=["gram", "n", "seen"])

    found = materialize(docs.select("text").mapInArrow(frequent, "gram long, n long, seen long"))
    total = found.agg(F.sum("seen")).first()[0] or 0
    out = [r["gram"] for r in found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > max(HOT_RUNS // 2, share * total)).select("gram").collect()]
    release(found)
    return np.array(sorted(out), dtype=np.int64)


REPEAT, OPEN, HOT = 1, 2, 3
RUN = pa.schema([("doc", pa.int64()), ("uid", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])
RUN_COLUMNS = "doc long, uid long, start int, n int"
#: Rows that a task sorts at once: runs, and runs with all their windows.
AT_ONCE, WINDOWED_AT_ONCE = 1 << 16, 1 << 12


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_once: int) -> Iterator[pa.Table]:
    """Tables of some ``at_once`` rows of a stream sorted by ``key``, none of which ends within a group."""
    held, rows, most = [], 0, at_once
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table[key].to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield table.slice(0, end)
            held, rows = table.slice(end).to_batches(), rows - end
            most = at_once + 2 * rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def settled(runs: DataFrame) -> DataFrame:
    """The second digit: runs whose context is known from an earlier document repeat; those that only share their gram stay open.

    Runs of hot grams are passed on. What is unique is left behind.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "deal", AT_ONCE):
            deal, gram, context, doc, again = (table[c].to_numpy() for c in ("deal", "gram", "context", "doc", "again"))
            order = np.lexsort((doc, context, deal))
            d, c = deal[order], context[order]
            new_deal = np.concatenate([[True], d[1:] != d[:-1]])
            new_context = new_deal | np.concatenate([[True], c[1:] != c[:-1]])
            group = np.cumsum(new_deal) - 1
            mixed = np.bincount(group, weights=new_context)[group] > 1
            earlier = doc[order] > doc[order][np.flatnonzero(new_context)][np.cumsum(new_context) - 1]
            state = np.zeros(len(deal), dtype=np.int8)
            state[order] = np.where(earlier, REPEAT, np.where(mixed, OPEN, 0))
            state = np.where(again, REPEAT, np.where(deal != gram, HOT, state)).astype(np.int8)
            kept = np.flatnonzero(state)
            if len(kept):
                out = table.select(["doc", "uid", "start", "n", "gram", "context"]).take(pa.array(kept)).append_column("state", pa.array(state[kept]))
                yield from out.combine_chunks().to_batches()

    dealt = runs.repartition("deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(settle, RUN_COLUMNS + ", gram long, context long, state byte")


def listed(runs: DataFrame) -> DataFrame:
    """Runs of each text in order, each as start * 2^32 + n: doc, uid, at."""
    return runs.groupBy("doc", "uid").agg(F.array_sort(F.collect_set(F.shiftleft(F.col("start").cast("long"), 32) + F.col("n"))).alias("at"))


def beside_texts(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with the list that each of its texts has in ``lists`` (doc, uid, at): these are counted, and come by broadcast or by a shuffle."""
    size = lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    side = F.broadcast(lists) if size[0] <= BROADCAST_TEXTS and size[1] <= BROADCAST_ENTRIES else lists
    return docs.join(side, ["doc", "uid"], how)


def _listed_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Listed runs of the texts, about a thousand at a time: doc, uid, start, n and bytes."""
    held, bodies = [], []
    for batch in batches:
        for doc, uid, at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), _raw(batch.column(3)), strict=True):
            packed = at.values.to_numpy()
            for part in (packed[k : k + 1000] for k in range(0, len(packed), 1000)):
                start, n = part >> 32, part & 0xFFFFFFFF
                held.append((np.full(len(part), doc), np.full(len(part), uid), start, n))
                bodies += [raw[x : x + y + THRESHOLD - 1].tobytes() for x, y in zip(start.tolist(), n.tolist(), strict=True)]
                if len(bodies) >= 1000:
                    yield *(np.concatenate(x) for x in zip(*held, strict=True)), bodies
                    held, bodies = [], []
    if bodies:
        yield *(np.concatenate(x) for x in zip(*held, strict=True)), bodies


def open_windows(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The last digit for open runs: dealt by gram with their bytes, their windows are compared. Returns those that repeat, as runs."""
    lists = materialize(listed(runs))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, uid, start, n, bodies in _listed_bodies(batches):
            grams, _, place = least_grams(np.frombuffer(b"".join(bodies), dtype=np.uint8))
            gram = grams[place[np.cumsum(n + THRESHOLD - 1) - (n + THRESHOLD - 1)]].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram), *[pa.array(x, t) for x, t in zip((doc, uid, start, n), RUN.types, strict=True)], pa.array(bodies, pa.binary())], names=["gram", *RUN.names, "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "gram", WINDOWED_AT_ONCE):
            doc, uid, start, n = (table[c].to_numpy() for c in RUN.names)
            row, at, gram, h = windows_of(start.astype(np.int64), n.astype(np.int64), table["body"].to_pylist())
            d, u = doc[row], uid[row]
            order = np.lexsort((at, u, d, h, gram))
            g, h, d, u, a = gram[order], h[order], d[order], u[order], at[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
            later = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
            later[1:] |= ~new[1:] & (d[1:] == d[:-1]) & (u[1:] == u[:-1]) & (a[1:] > a[:-1])  # a repeated row brings its windows twice
            repeated = np.zeros(len(row), dtype=bool)
            repeated[order] = later
            yield _as_runs(row[repeated], at[repeated], doc, uid)

    sent = beside_texts(docs, lists, "inner").select("doc", "uid", "at", "text").mapInArrow(read, "gram long, " + RUN_COLUMNS + ", body binary")
    out = materialize(sent.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, RUN_COLUMNS))
    release(lists)
    return out


def _as_runs(row: np.ndarray, at: np.ndarray, doc: np.ndarray, uid: np.ndarray) -> pa.RecordBatch:
    """Windows in order of run and place, as runs of neighbours."""
    head = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])[: len(row)]
    first = np.flatnonzero(head)
    n = np.diff(np.append(first, len(row)))
    return pa.RecordBatch.from_arrays([pa.array(doc[row[first]]), pa.array(uid[row[first]]), pa.array(at[first].astype(np.int32)), pa.array(n.astype(np.int32))], schema=RUN)


def hot_windows(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Both lower digits for runs of hot grams, by sums that are taken before rows move. Returns those that repeat, as runs."""
    keys = ["gram", "context"]
    first = materialize(runs.groupBy(*keys).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")))
    known = join_hot(runs, first.select(*keys, "first"), keys, hot_keys(first.select(*keys, "rows"), "rows", runs.count()))
    told = materialize(known.select(*RUN.names, (F.col("first") < F.col("doc")).alias("repeat")))
    lists = materialize(listed(told.where("not repeat")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, uid, start, n, bodies in _listed_bodies(batches):
            row, at, gram, h = windows_of(start, n, bodies)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(h), pa.array(doc[row]), pa.array(uid[row]), pa.array(at, pa.int32())], names=["gram", "window", "doc", "uid", "start"])

    keys = ["gram", "window"]
    each = beside_texts(docs, lists, "inner").select("doc", "uid", "at", "text").mapInArrow(read, "gram long, window long, doc long, uid long, start int")
    # equal windows of one text are few: runs of one context have been settled
    own = materialize(each.groupBy(*keys, "doc", "uid").agg(F.array_sort(F.collect_set("start")).alias("starts")))
    first = materialize(own.groupBy(*keys).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 or first is null"))
    many = join_hot(own, first.select(*keys, "first"), keys, hot_keys(first.select(*keys, "rows"), "rows", own.count()))
    one = F.lit(1).alias("n")
    later = many.where("first < doc").select("doc", "uid", F.explode("starts").alias("start"), one)
    again = own.where(F.size("starts") > 1).select("doc", "uid", F.explode(F.slice("starts", 2, (1 << 31) - 2)).alias("start"), one)
    out = materialize(told.where("repeat").select(*RUN.names).unionByName(later).unionByName(again))
    release(told, lists, own, first)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Maximal byte ranges of each text that are covered by repeated windows: doc, uid, at (start * 2^32 + end, in order).

    ``docs`` has doc, uid and text. The result reads a scratch table.
    """
    runs = materialize(settled(entries(docs, hot_grams(docs))))
    found = [runs.where(F.col("state") == REPEAT).select(*RUN.names), open_windows(docs, runs.where(F.col("state") == OPEN))]
    hot = runs.where(F.col("state") == HOT)
    if hot.limit(1).count():
        found.append(hot_windows(docs, hot))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for at in batch.column(2):
                packed = at.values.to_numpy()
                start = packed >> 32
                end = np.maximum.accumulate(start + (packed & 0xFFFFFFFF) + THRESHOLD - 1)
                head = np.concatenate([[True], start[1:] > end[:-1]])
                first = np.flatnonzero(head)
                spans.append(((start[first] << 32) | end[np.append(first[1:], len(start)) - 1]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int64()))], names=["doc", "uid", "at"])

    out = materialize(listed(every).mapInArrow(merge, "doc long, uid long, at array<long>"))
    release(runs, *found[1:])
    return out


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte that a THRESHOLD-byte string covers which also starts earlier, in a smaller id or earlier in its text.

    Texts are UTF-8 bytes; null ones are empty. Null ids count as the largest. Rows of one id are not earlier than each
    other, so repeated rows have one result and different texts under one id do not cut each other. A text of fewer than
    THRESHOLD bytes keeps all. Returns one row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept
    (the remaining bytes), kept_sha256. Ids are whole numbers; an empty table gives an empty result, and other columns are not
    read. The result reads a scratch table of the spans.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("uid"), text.alias("text"))
    both = beside_texts(named, repeated_spans(named.drop("doc_id")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, raw in zip(batch.column(1), _raw(batch.column(2)), strict=True):
                spans = [(v >> 32, v & 0xFFFFFFFF) for v in at.as_py()] if at.is_valid else []
                edges = [0, *[e for span in spans for e in span], len(raw)]
                kept = b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), len(spans), kept, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = named.schema["doc_id"].dataType.simpleString()
    return both.select("doc_id", "at", "text").mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
