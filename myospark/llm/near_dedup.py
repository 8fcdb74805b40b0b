"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets confirm.

1. One pass over the texts gives each document its number of shingles, a digest of its shingle set, its MinHash bands and
   its odd sketch: every MinHash sample toggles one bit, so equal samples of two documents cancel and the population
   count of the XOR tells how many differ. Documents with one set go on as one representative.
2. A bucket is what shares a band. Its smallest member is its hub; each other member makes a pair with the hub, never
   with all members. Pairs whose sketches are far apart go, at a distance that a similar pair exceeds less than once in
   a million; the rest is confirmed on full shingle sets.
3. Links contract to components. A bucket whose members but for the hub now are one component is settled: more links there
   cannot change the result. In the others, members outside the bucket's largest component walk along its members of other
   components that are near by sketch, nearest first, a few steps a round: these pairs are confirmed as before, components
   contract, and the next round reads only buckets where one still walks. A member with no step left is done; when all
   are, no pair of a bucket is left open. So a large group of copies costs a few pairs a member, not one for each two.

Hot buckets and hubs never meet in one task: joins on them broadcast the few hot keys (``join_hot``) and shuffle the rest;
rows to confirm are dealt by hub and salt, with one copy of the hub's text for each SALT_ROWS of them; the members of an
open bucket meet in blocks of BLOCK_ROWS by BLOCK_ROWS, and a block tells a member its next steps only. A task streams
over what it is dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, bounded_batches, hot_keys, join_hot, materialize, release
from .components import connected_components
from .textkernels import mix64, shingle_sets

WIDTH, SIMILARITY = 5, (75, 100)
BANDS, ROWS, SKETCH_BITS = 44, 5, 1024
SAMPLES, WORDS = BANDS * ROWS, SKETCH_BITS // 64
SALT_ROWS, BLOCK_ROWS = 256, 1_024
#: Steps that a member takes in the first round, and how many times more in each further one.
STEPS, MORE_STEPS = 4, 16
#: Ids of candidates are broadcast up to this number (8 bytes each), to spare the texts a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(4_211)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SEAT = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, (BANDS, 1), dtype=np.uint64)
_FOLD = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def expected_bits(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> float:
    """Mean population count of the XOR of two odd sketches: 2 toggles for each sample that differs."""
    return bits / 2 * (1 - (1 - 2 / bits) ** (2 * samples * (1 - similarity)))


def most_bits(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, deviations: float = 5.0) -> int:
    """The XOR count that a pair of this similarity exceeds less than once in a million (5 deviations of the samples and of the folding)."""
    mean, step = expected_bits(similarity, samples, bits), 2 * np.sqrt(samples * similarity * (1 - similarity)) * (1 - 2 * expected_bits(similarity, samples, bits) / bits)
    fold = np.sqrt(bits) / 2 * np.sqrt(max(1e-9, 1 - (1 - 2 * mean / bits) ** 2))
    return int(np.ceil(mean + deviations * np.hypot(step, fold)))


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each of SAMPLES hash functions over the set, 512 shingles at a time."""
    low = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(h), 512):
        np.minimum(low, ((h[a : a + 512, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return low


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, digest, bands, sketch words)."""
    import hashlib

    for batch in batches:
        sizes, digests, sigs, parities = [], [], [], []
        for s in shingle_sets(batch.column(1), WIDTH):
            sizes.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sigs.append(minhash(s))
            parities.append(np.packbits((np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)))
        if not sizes:
            continue
        sig = np.array(sigs, dtype=np.uint32)
        with np.errstate(over="ignore"):
            bands = mix64((sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=2, dtype=np.uint64) + _BAND.T)
            seats = mix64(sig.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + _SEAT) >> np.uint64(64 - (SKETCH_BITS - 1).bit_length())
        n = len(sizes)
        toggles = np.bincount((seats + (np.arange(n, dtype=np.uint64) * np.uint64(SKETCH_BITS))[:, None]).ravel().astype(np.int64), minlength=n * SKETCH_BITS)
        sketch = np.packbits((toggles & 1).astype(np.uint8)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64))),
                pa.ListArray.from_arrays(np.arange(0, (n + 1) * WORDS, WORDS, dtype=np.int32), pa.array(sketch)),
                pa.ListArray.from_arrays(np.arange(0, (n + 1) * WORDS, WORDS, dtype=np.int32), pa.array(np.concatenate(parities).view(np.int64))),
            ],
            names=["doc_id", "n_shingles", "digest", "bands", "sketch", "parity"],
        )


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, id, text) sorted by hub, salt and id, the hub's own row first, to the pairs that are similar."""
    at, hub_set = None, None
    num, den = SIMILARITY
    for batch in batches:
        hubs, salts, roles, ids = (batch.column(k).to_pylist() for k in range(4))
        a, b = [], []
        for hub, salt, role, doc, s in zip(hubs, salts, roles, ids, shingle_sets(batch.column(4), WIDTH), strict=True):
            if role == 0:
                at, hub_set = (hub, salt), s
                continue
            if at != (hub, salt):
                raise RuntimeError("a hub's text is missing from its group")
            both = len(np.intersect1d(hub_set, s, assume_unique=True)) if min(len(s), len(hub_set)) * den >= num * max(len(s), len(hub_set)) else 0
            if both and den * both >= num * (len(s) + len(hub_set) - both):
                a.append(hub)
                b.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _apart(x: str, y: str):
    """Population count of the XOR of two bitmaps."""
    return reduce(lambda s, k: s + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])), range(1, WORDS), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _near(x: str, y: str):
    """Whether two sketches (structs of sketch, parity and n_shingles) may belong to a similar pair.

    Sets of similarity num/den differ in at most (den - num) / (den + num) of the sum of their sizes, and bitmaps in no more.
    """
    num, den = SIMILARITY
    sizes = F.col(f"{x}.n_shingles") + F.col(f"{y}.n_shingles")
    return (_apart(f"{x}.parity", f"{y}.parity") * (den + num) <= sizes * (den - num)) & (_apart(f"{x}.sketch", f"{y}.sketch") <= most_bits(num / den))


def _hot_hubs(pairs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """How many pairs each hub has, and the hot ones."""
    of_hub = materialize(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")))
    return of_hub, hot_keys(of_hub, "n", _total(of_hub))


def _total(sizes: DataFrame) -> int:
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _confirmed(texts: DataFrame, pairs: DataFrame, of_hub: DataFrame, hot: DataFrame | None) -> DataFrame:
    """The pairs (hub, id) whose full sets are similar, as edges a, b; a hub's pairs are dealt over salts."""
    salts = of_hub.select("hub", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    members = join_hot(pairs, salts, ["hub"], hot).select("hub", F.pmod(F.xxhash64("id", F.lit(5)), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "id")
    rows = members.join(texts, "id").select("hub", "salt", "role", "id", "text")
    own = salts.join(texts, salts["hub"] == texts["id"]).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "id", "text")
    dealt = rows.unionByName(own).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "id")
    return dealt.mapInArrow(confirm, "a long, b long")


def next_steps(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of blocks (band, key, bx, by, walks, id, comp, d, y, sketch, parity, n_shingles), a block's rows together, to (id, d, y).

    For each row that walks: at most ``most`` of the others in other components that may be similar, by distance of their
    sketches and by id, from beyond the step (d, y) on. A task holds one block.
    """
    num, den = SIMILARITY
    limit = most_bits(num / den)

    def met(block: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        walks, ids, comps, far, last, n = (block.column(c).to_numpy() for c in ("walks", "id", "comp", "d", "y", "n_shingles"))
        sketch, parity = (pc.list_flatten(block.column(c)).to_numpy().view(np.uint64).reshape(-1, WORDS) for c in ("sketch", "parity"))
        others = np.flatnonzero(~walks)
        other_ids, other_sketch = ids[others], sketch[others]
        for k in np.flatnonzero(walks):
            d = np.bitwise_count(other_sketch ^ sketch[k]).sum(axis=1, dtype=np.int64)
            at = np.flatnonzero((d <= limit) & (comps[others] != comps[k]) & ((d > far[k]) | ((d == far[k]) & (other_ids > last[k]))))
            at = at[np.bitwise_count(parity[others[at]] ^ parity[k]).sum(axis=1, dtype=np.int64) * (den + num) <= (n[others[at]] + n[k]) * (den - num)]
            at = at[np.lexsort((other_ids[at], d[at]))[:most]]
            if len(at):
                yield np.repeat(ids[k], len(at)), d[at], other_ids[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["id", "d", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(4)])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                own = tuple(keys[:, a].tolist())
                if own != now and held:
                    found += met(pa.Table.from_batches(held))
                    held = []
                now = own
                held.append(batch.slice(a, b - a))
            if found:
                yield told()
                found = []
        if held:
            found += met(pa.Table.from_batches(held))
        if found:
            yield told()

    return run


def _open(members: DataFrame, state: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """The members of the buckets where one still walks: band, key, ref, id, comp, s, walks, d, y and the number of blocks on either side.

    A bucket's ``ref`` stands for one of its components, the one with most members at first, and for what that grows to.
    Members outside it walk, so those of a bucket that is one component but for a few cost it no blocks of their own.
    ``members`` has band, key and id at first, when all may walk, and then is this function's result; ``state`` has id,
    component and the step (d, y) of those that have steps left. Sketches are joined at first only, and kept.
    """
    first = sketches is not None
    kept = [F.lit(None).cast("long").alias("ref")] if first else ["ref", "s"]
    step = [F.lit(-1).cast("long").alias("d"), F.lit(0).cast("long").alias("y")] if first else ["d", "y"]
    seats = members if first else members.select("band", "key", "id", *kept)
    placed = materialize(seats.join(state, "id", "left").select("band", "key", "id", *kept, F.coalesce("component", "id").alias("comp"), *step))
    own = F.coalesce(F.max(F.col("id") == F.col("ref")), F.lit(False)).alias("own")
    of_comp = placed.groupBy("band", "key", "comp").agg(own, F.count(F.lit(1)).alias("n"), F.min("id").alias("ref"), F.count("d").alias("walking"))
    buckets = of_comp.groupBy("band", "key").agg(
        F.max(F.struct("own", "n", "ref", "comp", "walking")).alias("top"), F.sum("n").alias("n"), F.sum("walking").alias("walking")
    ).select("band", "key", "top.ref", F.col("top.comp").alias("ref_comp"), "n", (F.col("walking") - F.col("top.walking")).alias("outside"))
    blocks = [F.ceil(F.col(n) / BLOCK_ROWS).cast("int").alias(to) for n, to in (("outside", "walk_blocks"), ("n", "blocks"))]
    buckets = materialize(buckets.where("outside > 0").select("band", "key", "ref", "ref_comp", "n", *blocks))
    hot = hot_keys(buckets.select("band", "key", "n"), "n", _total(buckets))
    walks = (F.col("comp") != F.col("ref_comp")) & F.col("d").isNotNull()
    known = join_hot(placed.drop("ref"), buckets.drop("n"), ["band", "key"], hot).withColumn("walks", walks).drop("ref_comp")
    open_ = materialize(known.join(sketches, "id") if first else known)
    release(placed, buckets)
    return open_


def _steps(open_: DataFrame, most: int) -> DataFrame:
    """(id, d, y): the next steps, ``most`` at most, of each member that walks.

    It meets all members of other components; the two sides are cut into blocks of their own, and each block of one meets
    each of the other in a group.
    """
    seat = lambda n: F.pmod(F.xxhash64("id", F.lit(9)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    figures = ["s.sketch", "s.parity", "s.n_shingles"]
    walking = open_.where("walks").select("band", "key", seat("walk_blocks").alias("bx"), every("blocks").alias("by"), F.lit(True).alias("walks"), "id", "comp", "d", "y", *figures)
    still = [F.lit(0).cast("long").alias(c) for c in ("d", "y")]
    others = open_.select("band", "key", every("walk_blocks").alias("bx"), seat("blocks").alias("by"), F.lit(False).alias("walks"), "id", "comp", *still, *figures)
    block = ["band", "key", "bx", "by"]
    dealt = walking.unionByName(others).repartition(*block).sortWithinPartitions(*block)
    found = dealt.mapInArrow(next_steps(most), "id long, d long, y long").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "y"))
    return materialize(found.withColumn("place", place).where(F.col("place") <= most).drop("place"))


def _settle(texts: DataFrame, seats: DataFrame, sketches: DataFrame, tried: DataFrame, comps: DataFrame) -> DataFrame:
    """Components once no bucket has an open pair: rounds of steps, confirmation and contraction.

    A member's steps are in one order in all rounds. One that it has passed was confirmed or rejected, and two members of
    one component stay so; hence a member that had fewer steps than it was allowed has none left. A bucket's ref component
    only grows, so a member that does not walk at first never has to, and a round reads the buckets that walkers of the
    last one have left open. Hubs have met all of their buckets. ``tried`` are the pairs (hub, id) confirmed or rejected
    before; ``seats`` are released.
    """
    state, most = comps, STEPS
    open_ = _open(seats.where("id <> hub").select("band", "key", "id"), state, sketches)
    release(seats)
    while True:
        steps = _steps(open_, most)
        fresh = materialize(steps.select(F.least("id", "y").alias("hub"), F.greatest("id", "y").alias("id")).distinct().join(tried, ["hub", "id"], "left_anti"))
        of_hub, hot = _hot_hubs(fresh)
        links = materialize(_confirmed(texts, fresh, of_hub, hot))
        known = comps.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        after = connected_components(known.unionByName(links)) if links.limit(1).count() else comps
        last = F.max(F.struct("d", "y")).alias("last")
        ahead = materialize(steps.groupBy("id").agg(F.count(F.lit(1)).alias("n"), last).where(F.col("n") == most).select("id", "last.d", "last.y"))
        release(steps, of_hub, links, *([] if after is comps else [comps]))
        comps = after
        if ahead.limit(1).count() == 0:
            release(ahead, fresh, tried, open_)
            return comps
        both, state, before = materialize(tried.unionByName(fresh)), materialize(comps.join(ahead, "id", "full")), open_
        open_ = _open(before, state)
        release(tried, fresh, ahead, state, before)
        tried, most = both, most * MORE_STEPS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

    Words are runs of anything but space and tab to carriage return, after lower-casing A-Z. Returns one row per input
    row: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id is the component's own).
    Null and empty texts, or texts without words, have 0 shingles and are linked with nothing. Rows that repeat an id and
    text share one component; ids are expected to name one text each. A row with a null
    id links nothing and stays, with a null component_id, unless its set belongs to a document with an id.
    An empty table gives an empty result; other columns are not read. The integer id is cast to bigint.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    feats = materialize(slim.mapInArrow(features, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, parity array<long>"))
    full = feats.where("digest is not null")
    reps = materialize(
        full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("bands", F.struct("sketch", "parity", "n_shingles").alias("s")), "doc_id").alias("f")).select("digest", "rep", "n", "f.bands", "f.s")
    )
    seats = _shared(reps.where("rep is not null").select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "key")))
    sketches = reps.where("rep is not null").groupBy(F.col("rep").alias("id")).agg(F.first("s").alias("s"))
    involved = materialize(seats.select(F.col("id").alias("doc_id")).distinct())
    few = F.broadcast(involved) if involved.count() <= BROADCAST_IDS else involved
    texts = materialize(slim.join(few, "doc_id", "left_semi").withColumnRenamed("doc_id", "id"))
    release(involved)

    found = materialize(seats.where("id <> hub").select("hub", "id").distinct())
    of_hub, hot = _hot_hubs(found)
    hub_sketches = sketches.select(F.col("id").alias("hub"), F.col("s").alias("hs"))
    pairs = materialize(join_hot(found, hub_sketches, ["hub"], hot).join(sketches, "id").where(_near("hs", "s")).select("hub", "id"))
    release(found, of_hub)
    of_hub, hot = _hot_hubs(pairs)
    comps = connected_components(_confirmed(texts, pairs, of_hub, hot))
    release(of_hub)

    again = _settle(texts, seats, sketches, pairs, comps)
    release(texts)

    copies = reps.select("digest", "n")
    hot = hot_keys(copies, "n", _total(copies))
    of_rep = reps.select("digest", "rep").join(again.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    rows = feats.select("doc_id", "n_shingles", "digest")
    out = join_hot(rows.where("digest is not null"), of_rep, ["digest"], hot).unionByName(rows.where("digest is null").withColumn("component", F.col("doc_id")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _shared(seats: DataFrame) -> DataFrame:
    """The members of each bucket that has two or more, with its hub, the smallest id."""
    hubs = seats.groupBy("band", "key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("hub <> last")
    hubs = materialize(hubs.select("band", "key", "hub", "n"))
    hot = hot_keys(hubs.select("band", "key", "n"), "n", _total(hubs))
    out = materialize(join_hot(seats, hubs.drop("n"), ["band", "key"], hot))
    release(hubs)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: that with the smallest id. Rows with a null id stay.

    Texts stay where they are as long as the ids that go are at most BROADCAST_IDS; beyond, both sides are shuffled by id.
    """
    gone = materialize(near_duplicates(docs, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias(P + "id")).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(few, F.col(id_col).cast("bigint") == F.col(P + "id"), "left_anti")
