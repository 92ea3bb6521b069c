"""Nearest vectors, near copies, overlap and spread against plain versions, with nulls, ties and hot keys."""

import itertools
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from tidemark.functions.shingles import shingles, window_hashes, word_hashes
from tidemark.operators import near_copies, nearest, overlap, spread


def vectors(seed, n, size=8, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = centres[rng.integers(0, groups, n)] + 0.2 * rng.normal(size=(n, size))
    return [(i, [float(v) for v in row.astype(np.float32)]) for i, row in enumerate(x)]


def plain_nearest(rows, queries, k, size=8):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in queries:
        if q is None or x is None or len(x) != size:
            continue
        scored = sorted((-round(float(np.array(x) @ v), 6), i) for i, v in ok if i != q)
        out += [(q, i, -s, p) for p, (s, i) in enumerate(scored[:k], 1)]
    return sorted((q, p, i) for q, i, _, p in out)


@pytest.mark.parametrize(("block_rows", "block_queries"), [(4096, 512), (7, 3)])
def test_nearest_is_exact(spark, block_rows, block_queries):
    rows = vectors(1, 120)
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # a third are one vector
    rows += [(None, rows[1][1]), (2000, None), (2001, [1.0] * 7), (2002, [float("nan")] * 8), (2003, [1.0] * 7 + [None]), (2004, [float("inf")] * 8), (2005, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, cell string").repartition(3)
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0 and r[0] < 2000]
    queries = df.where("vec_id % 10 = 0 and vec_id < 2000")
    got = nearest.nearest(df, queries, 5, size=8, block_rows=block_rows, block_queries=block_queries)
    assert sorted((r.query_id, r.place, r.neighbour_id) for r in got.collect()) == plain_nearest(rows, asked, 5)
    assert nearest.nearest(df.limit(0), queries, size=8).count() == 0 and nearest.nearest(df, queries.limit(0), size=8).count() == 0


def test_index_finds_most_and_holds_all_rows(spark):
    df = spark.createDataFrame(vectors(2, 3000, groups=40), "vec_id bigint, embedding array<float>").repartition(4)
    index = nearest.fit_index(df, size=8, sample=1000)
    assert index.probes < len(index.centres) / 2
    queries = df.where("vec_id % 50 = 0")
    found = nearest.nearest(df, queries, index=index, size=8, block_rows=50, block_queries=9)
    assert nearest.recall_of(found, nearest.nearest(df, queries, size=8)) >= 0.9
    every = nearest.nearest(df, queries, index=nearest.Index(index.centres, len(index.centres)), size=8)
    assert nearest.recall_of(every, nearest.nearest(df, queries, size=8)) == 1
    assert nearest.nearest(df, queries, index=nearest.fit_index(df.limit(0), size=8), size=8).count() == 300


def test_index_recall_on_the_given_vectors(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    queries = df.where("vec_id % 50 = 0")
    assert nearest.recall_of(nearest.nearest(df, queries, index=nearest.fit_index(df)), nearest.nearest(df, queries)) >= 0.9


def test_window_hashes_do_not_depend_on_place():
    words = "a b c d a b c e a b c".split()
    h = window_hashes(word_hashes(words), 3)
    assert h[0] == h[4] == h[8] and len(set(h.tolist())) == 7 and len(window_hashes(word_hashes([]), 3)) == 0
    assert len(shingles([], 5)) == 0 and len(shingles(["a"], 5)) == 1


def copies(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 20, 80, 150]))
        for _ in range(rng.choice([1, 4])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t).title() if rng.random() < 0.3 else " ".join(t))
    base = rng.choices(words, k=120)
    for i in range(40):  # a large group that drifts, so that its ends are no links
        base[3 * i % 120] = rng.choice(words)
        texts.append(" ".join(base))
    return [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(700, texts[0])] * 3 + [(701, ""), (702, None), (703, "\n"), (None, texts[2]), (None, "alone here"), (704, "a b"), (705, "A  B")]


def plain_classes(rows, width, similarity):
    def of(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [(i, of(t)) for i, t in rows]
    reps = {}
    for i, s in sets:
        if i is not None and (reps.get(s) is None or i < reps[s]):
            reps[s] = i
    of_id = defaultdict(list)
    for s, i in reps.items():
        of_id[i].append(s)
    root = {i: i for i in of_id}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in itertools.combinations([(i, s) for s, i in reps.items()], 2):
        if x and y and len(x & y) >= similarity * len(x | y) - 1e-9:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return sorted(((i, reps.get(s), find(reps[s]) if s in reps else None) for i, s in sets), key=repr)


@pytest.mark.parametrize(("seed", "similarity"), [(1, 0.8), (2, 0.8), (3, 0.9)])
def test_near_copies(spark, seed, similarity):
    rows = copies(seed)
    df = spark.createDataFrame([(i, t, 5, "b") for i, t in rows], "doc_id bigint, text string, band int, same string").repartition(3)
    got = sorted((tuple(r) for r in near_copies.near_copies(df, similarity=similarity).collect()), key=repr)
    assert got == plain_classes(rows, 5, similarity)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_members_outside_the_least_ids_component_still_meet(spark):
    """Three texts in one band: the two that are alike are not alike to the one of least id."""
    import tidemark.operators.near_copies as module

    a = [f"x{i}" for i in range(60)]
    b, c = [f"y{i}" for i in range(60)], [f"y{i}" for i in range(59)] + ["z"]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id bigint, text string")
    every = module.signature
    module.signature = lambda s, bands, rows: np.zeros(1, np.int64)
    try:
        assert sorted(tuple(r) for r in module.near_copies(df).collect()) == [(1, 1, 1), (2, 2, 2), (3, 3, 2)]
    finally:
        module.signature = every


def test_signatures_are_cheap_and_meet_as_often_as_they_should():
    """Bands agree as by independent hashes, also for few shingles, and cost far less than a whole mix of bits a hash."""
    from tidemark.functions.shingles import mixed
    from tidemark.operators.near_copies import BANDS, ROWS, signature

    rng = np.random.default_rng(3)
    for both, single in ((4, 1), (80, 20), (100, 100)):
        agree = []
        for _ in range(300):
            x = mixed(rng.integers(0, 2**63, both + single).astype(np.uint64))
            a, b = x[: both + single // 2], np.concatenate([x[:both], x[both + single // 2 :]])
            agree.append(int((signature(np.sort(a), BANDS, ROWS) == signature(np.sort(b), BANDS, ROWS)).sum()))
        p = (both / (both + single)) ** ROWS
        assert abs(np.mean(agree) - BANDS * p) < 5 * np.sqrt(BANDS * p * (1 - p) / len(agree))
        assert 0.7 < np.var(agree) / (BANDS * p * (1 - p)) < 1.4
    shingle = np.sort(mixed(rng.integers(0, 2**63, 20_000).astype(np.uint64)))

    def seconds(work):
        took = []
        for _ in range(3):
            start = time.thread_time()
            work()
            took.append(time.thread_time() - start)
        return min(took)

    assert seconds(lambda: signature(shingle, BANDS, ROWS)) < seconds(lambda: [mixed(shingle) for _ in range(BANDS * ROWS)]) / 2


def test_words_of_near_copies_end_at_six_characters_only():
    from tidemark.functions.shingles import WORD
    from tidemark.operators.near_copies import set_of

    text = "A b\tc\nd\x0be\x0cf\rg \x1ch\x1d i\x85j\xa0k \u2003l \u3000 \u00dcber \U0001f600 m\x00n  \x1f o"
    for width in (1, 2, 5, 50):
        assert set_of(text, width).tolist() == shingles(WORD.findall(text.lower()), width).tolist()


def test_members_of_a_large_group_that_are_not_alike_make_no_pairs(spark):
    """Bitmaps drop nearly all pairs of a family at a similarity around 0.6, and none at 0.8 or more, however full they are."""
    from tidemark.functions.shingles import mixed
    from tidemark.operators.near_copies import bitmap, crossing

    rng = np.random.default_rng(5)

    def fresh(n):
        return mixed(rng.integers(0, 2**63, n).astype(np.uint64))

    sets = []
    for size, members in ((5, 30), (400, 60), (900, 30), (9000, 12)):
        base = fresh(size)
        for k in range(members):
            drop = (0.25 if k % 3 else 0.05) if size > 5 else 0.2
            sets.append(np.unique(np.concatenate([base[rng.random(size) >= drop], fresh(int(size * drop))])))
    sets = [s for s in sets if len(s)]
    whole = spark.createDataFrame([(i, s.view(np.int64).tolist(), bitmap(s).tolist()) for i, s in enumerate(sets)], "id bigint, shingle_set array<bigint>, bits array<bigint>")
    placed = spark.createDataFrame([(i, 7, i, 0) for i in range(len(sets))], "id bigint, band bigint, root bigint, pivot_root bigint")
    got = {(min(r), max(r)) for r in crossing(placed, whole, 0.8).collect()}
    met = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))]
    shared = {p: len(np.intersect1d(sets[p[0]], sets[p[1]], assume_unique=True)) for p in met}
    alike = {p for p in met if shared[p] >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - shared[p]) - 1e-9}
    assert len(alike) > 100 and alike <= got
    short = [p for p in met if 100 < len(sets[p[0]]) < 2000]
    assert len(short) > 2000 and sum(p in got for p in short) < len(short) / 4


def test_bands_are_shuffled_twice_only(spark):
    """Once to find those that several texts share, once for the join; bands are no longer made distinct before."""
    import tidemark.operators.near_copies as module

    plans, keep = [], module.written
    module.written = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df)
    try:
        near = " ".join(f"w{i}" for i in range(40))
        rows = [(1, near), (1, near + " x"), (2, near + " y"), (3, "other words here that nobody has"), (3, near + " z")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sorted(tuple(r) for r in module.near_copies(df).collect())
    finally:
        module.written = keep
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (3, 3, 1)]
    (bands,) = [p for p in plans if "pivot" in p and "explode" in p]
    assert bands.count("Aggregate") == 1


@pytest.mark.parametrize("most", [1 << 20, 5])
def test_shared_shingles(spark, most):
    """With a filter, and without one where the small side has too many windows for it."""
    rng = random.Random(most)
    words = [f"w{i}" for i in range(30)]
    small = [(i, " ".join(rng.choices(words, k=rng.choice([2, 4, 9])))) for i in range(20)] + [(21, None), (None, "w1 w2 w3 w4")]
    large = [(i, " ".join(rng.choices(words, k=60)) + "\n" + (rng.choice(small[:20])[1] if i % 3 else "")) for i in range(80)] + [(200, None), (201, ""), (3, "w1 w2 w3 w4 w5"), (None, "w1 w2 w3 w4")]

    def windows(text):
        w = (text or "").split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}

    mine, theirs = defaultdict(set), defaultdict(set)
    for side, rows in ((mine, large), (theirs, small)):
        for i, t in rows:
            side[i] |= windows(t)
    expected = sorted(((i, j, len(x & y)) for i, x in mine.items() for j, y in theirs.items() if x & y), key=repr)
    df = spark.createDataFrame([(i, t, "s") for i, t in large], "doc_id bigint, text string, shingle string").repartition(3)
    items = spark.createDataFrame(small, "item_id bigint, text string")
    assert sorted((tuple(r) for r in overlap.shared_shingles(df, items, 4, most).collect()), key=repr) == expected
    assert overlap.shared_shingles(df, items.limit(0), 4).count() == 0 and overlap.shared_shingles(df.limit(0), items, 4).count() == 0


def test_bloom_filter_passes_all_and_few_others(spark):
    inside = spark.createDataFrame([(f"a{i} b{i} c",) for i in range(500)], "shingle string")
    data, bits = overlap.bloom(inside, 500)
    packed = np.unpackbits(np.frombuffer(data, np.uint8))

    def passes(text):
        return packed[overlap.places(window_hashes(word_hashes(text.split()), 3), bits, overlap.PROBES)].all()

    assert all(passes(f"a{i} b{i} c") for i in range(500)) and sum(passes(f"x{i} y c") for i in range(2000)) < 20


def test_held_by_at_least(spark):
    rng = random.Random(2)
    pairs = [(rng.choice("abcdefg"), rng.randrange(6)) for _ in range(40)] + [("hot", i) for i in range(300)] + [(None, 1), (None, 2), ("n", None), ("n", 1), ("two", 1), ("two", 2), ("two", 2)]
    holders = defaultdict(set)
    for k, m in pairs:
        if k is not None and m is not None:
            holders[k].add(m)
    df = spark.createDataFrame(pairs, "line string, doc_id bigint").repartition(5)
    got = {r.line: list(r.members) for r in spread.held_by_at_least(df, "line", "doc_id", 3).collect()}
    assert got == {k: sorted(m)[:3] for k, m in holders.items() if len(m) >= 3}
    plan = spread.held_by_at_least(df, "line", "doc_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert spread.held_by_at_least(df.limit(0), "line", "doc_id", 3).count() == 0
