import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from myospark.llm.components import connected_components
from myospark.llm.exact_dedup import drop_copies, exact_groups
from myospark.llm.near_dedup import confirm, drop_near_duplicates, expected_bits, features, most_bits, near_duplicates
from myospark.llm.textkernels import shingle_sets

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    out, word = [], ""
    for ch in (text or "").translate(FOLD):
        if ch in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out + [word] if word else out


def brute_sets(texts):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(ids[a]), root(ids[b])))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_groups(make, keep, fan_in):
    texts = ["Abc", "aBC", None, "", "ÄBC", "äbc", "x" * 200_000, "abc", "abc ", "ÄbC"]
    docs = make(texts)
    got = {r["doc_id"]: r for r in exact_groups(docs, keep=keep, fan_in=fan_in).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(FOLD)].append(i)
    assert len(got) == len(texts)
    for t, ids in groups.items():
        best = min(ids) if keep == "min" else max(ids)
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest())


def test_exact_edges(make, spark):
    empty = make([])
    assert exact_groups(empty).count() == 0 and drop_copies(empty).count() == 0
    docs = make(["a", "a", "a", "b", "b"], ids=[5, 5, None, None, None])
    rows = exact_groups(docs, keep="max").collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in rows) == [(0, 0, 2, True), (0, 0, 2, True), (0, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True)]
    left = drop_copies(make(["a", "A", "b"]), keep="max")
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2]
    with pytest.raises(ValueError):
        exact_groups(docs, keep="any")


def test_one_hot_group(make):
    rows = exact_groups(make(["same"] * 300 + [f"t{i}" for i in range(50)])).collect()
    assert sum(r["kept"] for r in rows) == 51 and max(r["group_size"] for r in rows) == 300


def test_shingle_sets():
    texts = ["a b c d e f", "A  B\tc\nd\x0be  f ", "a b", "b a", None, "", " \n ", "\u00a0 a b c d e", "é è ê ë ē", "a b c d e f"]
    ours, theirs = list(shingle_sets(pa.array(texts))), brute_sets(texts)
    assert [len(s) for s in ours] == [len(s) for s in theirs]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(ours[i], ours[j])) == len(theirs[i] & theirs[j])


def near_texts(seed=1):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(8, 260))] for _ in range(12)]
    out = []
    for b in base:
        for edits in (0, 1, 2, 4, 8, 12):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            out.append(" ".join(w))
    return out + [None, "", " \t ", "one two", "One TWO", "two one", "alone", " ".join(f"q{i}" for i in range(30_000))]


def test_near_against_brute_force(make):
    texts = near_texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(make(texts)).collect()}
    sets = brute_sets(texts)
    comps = brute_components(list(range(len(texts))), sets)
    assert got == {i: (len(sets[i]), comps[i], comps[i] == i) for i in range(len(texts))}
    assert len(set(comps.values())) < len(texts)


def test_near_chain_beyond_the_hub(make):
    """Each text is similar to the next only, so most links do not touch a bucket's smallest member."""
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w[k * 8 : k * 8 + 120]) for k in range(20)] * 2
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), brute_sets(texts))
    assert set(got.values()) == {0}


def test_near_edges(make):
    assert near_duplicates(make([])).count() == 0
    got = near_duplicates(make(["a b c d e f"] * 3 + ["x y"], ids=[7, None, 7, None])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 7, False), (7, 7, True), (7, 7, True)]
    left = drop_near_duplicates(make(["a b c d e f", "A b c d e f", "", ""]))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 2, 3] and "hub" in left.columns


def test_against_table(spark, sf):
    from myospark.llm.queries import op5_near_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sets = brute_sets([r["text"] for r in docs])
    want = brute_components([r["doc_id"] for r in docs], sets)
    assert {r["doc_id"]: r["component_id"] for r in op5_near_dedup(spark, sf).collect()} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a in parent and b in parent:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_sketch_estimates():
    """Sketch distances follow the expected count, and no similar pair is beyond the bound."""
    rng = random.Random(5)
    for share in (0.75, 0.85, 0.95):
        seen = []
        for _ in range(12):
            n = 900
            both = int(2 * n * share / (1 + share))
            a = [f"c{rng.random()}" for _ in range(both)]
            x = a + [f"x{rng.random()}" for _ in range(n - both)]
            y = a + [f"y{rng.random()}" for _ in range(n - both)]
            from myospark.llm import near_dedup

            sets = [np.unique(np.array([hash(w) & (2**64 - 1) for w in s], dtype=np.uint64)) for s in (x, y)]
            bits = []
            for s in sets:
                sig = near_dedup.minhash(near_dedup.mix64(s)).astype(np.uint64)
                seat = near_dedup.mix64(sig * np.uint64(0xD1342543DE82EF95) + near_dedup._SEAT) >> np.uint64(54)
                bits.append(np.bincount(seat.astype(np.int64), minlength=1024) & 1)
            seen.append(int((bits[0] ^ bits[1]).sum()))
        assert abs(np.mean(seen) - expected_bits(share)) < 12
        assert max(seen) <= most_bits(share)


def test_features_and_confirm_empty():
    empty = pa.RecordBatch.from_pydict({"d": pa.array([], pa.int64()), "t": pa.array([], pa.string())})
    assert list(features(iter([empty]))) == []
    assert list(confirm(iter([]))) == []


def test_recall_against_all_rows(spark, sf):
    """Every document whose id is divisible by 20 against all rows of the 0.1 tables: no link may be lost."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    found = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = brute_sets([t for _, t in rows])
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for shingle in s:
            holders[shingle].append(k)
    links = kept = 0
    for k, (doc, _) in enumerate(rows):
        assert found[doc]["n_shingles"] == len(sets[k])
        if doc % 20:
            continue
        shared = defaultdict(int)
        for shingle in sets[k]:
            for other in holders[shingle]:
                shared[other] += 1
        for other, both in shared.items():
            if other != k and 100 * both >= 75 * (len(sets[k]) + len(sets[other]) - both):
                links += 1
                kept += found[doc]["component_id"] == found[rows[other][0]]["component_id"]
    assert links > 50 and kept == links


@pytest.mark.parametrize("keep", ["min", "max"])
def test_runs_of_many_partitions_merge(make, keep):
    """Thirteen runs in rounds of two; one group holds a third of all rows, and some of its ids are null or repeated."""
    rng = random.Random(3)
    texts = [rng.choice(["HOT copy", "hot COPY", None, "", f"t{rng.randrange(40)}", f"T{rng.randrange(40)}"]) for _ in range(400)]
    ids = [None if i % 29 == 0 else i // 2 if i % 5 == 0 else i for i in range(400)]
    got = exact_groups(make(texts, ids=ids).repartition(13), keep=keep, fan_in=2).collect()
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[hashlib.sha256((t or "").translate(FOLD).encode()).hexdigest()].append(i)
    best = min if keep == "min" else max
    want = []
    for sha, own in groups.items():
        stays = best([i for i in own if i is not None], default=None)
        want += [(i, stays, len(own), i == stays, sha) for i in own]
    assert sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got))) == sorted(map(str, want))
    left = drop_copies(make(texts, ids=ids).repartition(13), keep=keep, fan_in=2).collect()
    assert len(left) == sum(w[3] for w in want)


def test_equal_ids_with_other_texts_stay(make, monkeypatch):
    from myospark.llm import exact_dedup

    docs = make(["a", "A", "b", "c"], ids=[1, 2, 1, None])
    for most in (250_000, 0):  # both ways of the join
        monkeypatch.setattr(exact_dedup, "BROADCAST_GONE", most)
        assert sorted(r["text"] for r in drop_copies(docs, keep="max").collect()) == ["A", "b", "c"]


def test_a_large_group_costs_few_pairs_a_member(make, monkeypatch):
    """Hubs that are similar to none of a group, whose members are to each other: what is confirmed does not grow with the square of their number."""
    from myospark.llm import near_dedup

    seen, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda texts, pairs, *more: seen.append(pairs.count()) or confirmed(texts, pairs, *more))
    rng = random.Random(11)
    base = [f"w{i}" for i in range(2_000)]
    texts = []
    for i in range(130):
        words = list(base)
        for at in rng.sample(range(2_000), 34 if i < 14 else 26):
            words[at] = f"z{i}-{at}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), brute_sets(texts))
    assert sum(seen[1:]) < 15 * len(texts), seen


@pytest.mark.parametrize("steps", [(1, 2), (4, 16)])
def test_steps_of_any_number_find_all_links(make, monkeypatch, steps):
    """Blocks of a few members, and members that meet many in vain before the one that they belong to."""
    from myospark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "STEPS", steps[0])
    monkeypatch.setattr(near_dedup, "MORE_STEPS", steps[1])
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([3, 4, 5, 6])):
            words[at] = f"z{i}-{at}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(texts)).collect()}
    comps = brute_components(list(range(len(texts))), brute_sets(texts))
    assert got == comps and len(set(comps.values())) > 3


def test_sketches_are_joined_once_and_rounds_read_open_buckets(make, monkeypatch):
    """A large group that a few others keep open for several rounds: its members meet sketches once, and later rounds read only where one walks."""
    from myospark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "STEPS", 1)
    monkeypatch.setattr(near_dedup, "MORE_STEPS", 2)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([3, 4, 5, 6])):
            words[at] = f"z{i}-{at}"
        texts.append(" ".join(words))
    rounds, joined, open_ = [], [], near_dedup._open

    def count(members, comps, sketches=None):
        out = open_(members, comps, sketches)
        rounds.append(out.count())
        joined.extend([] if sketches is None else rounds[-1:])
        return out

    monkeypatch.setattr(near_dedup, "_open", count)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), brute_sets(texts))
    assert len(rounds) > 2 and rounds[-1] < rounds[0], rounds
    assert sum(joined) <= near_dedup.BANDS * len(texts) and len(joined) == 1, (rounds, joined)


def test_members_of_the_largest_component_do_not_walk(make, monkeypatch):
    """Buckets of one large component and a few others, whatever their hub: walkers and rows dealt grow with the others."""
    from myospark.llm import near_dedup

    shapes, steps = [], near_dedup._steps

    def count(members, *more):
        shapes.append((members.select("id").distinct().count(), members.where("walks").select("id").distinct().count() if "walks" in members.columns else members.where("out").select("id").distinct().count()))
        return steps(members, *more)

    monkeypatch.setattr(near_dedup, "_steps", count)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), 6 if i < 6 else 2):
            words[at] = f"z{i}-{at}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(texts)).collect()}
    assert got == brute_components(list(range(len(texts))), brute_sets(texts))
    assert shapes and shapes[0][1] <= 6, shapes
