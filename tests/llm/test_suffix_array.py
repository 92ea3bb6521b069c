"""The sparse suffix array against brute force: long common prefixes, hot passages, few words, cut classes."""

import random

import pytest

from tidemark.llm import suffix_dedup


def tuples(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "漢字"]
    long = rng.choices(words, k=400)
    hot = " ".join(rng.choices(words, k=44))
    rows = []
    for i in range(14):  # the same 400 words, cut and joined to others at many places
        a, b = sorted((rng.randrange(400), rng.randrange(400)))
        rows.append((i, " ".join(rng.choices(words, k=rng.randrange(30)) + long[a:b] + rng.choices(words, k=rng.randrange(30)))))
    for i in range(40):  # 44 words in many surroundings: no passage of 50, unless surroundings agree as well
        left, right = rng.choice(["p q r s", "t u v w", ""]), rng.choice(["a b c d e f", "g h i j k l", f"x{i}"])
        rows.append((100 + i, f"{left} {hot}\n{right}"))
    once = " ".join(long[:120])
    return rows + [(500, once + " z " + once), (501, "same " * 300), (502, None), (503, ""), (None, rows[3][1]), (None, None), (3, rows[3][1]), (504, " ".join(long[:49]))]


@pytest.mark.parametrize(("seed", "passage", "k", "among", "together", "chunk"), [(1, 50, 3, 16, 20_000, 8 << 20), (2, 50, 3, 16, 1, 3000), (3, 50, 3, 16, 3, 500), (4, 12, 2, 5, 2, 900), (5, 5, 1, 5, 20_000, 700)])
def test_passages(spark, monkeypatch, seed, passage, k, among, together, chunk):
    monkeypatch.setattr(suffix_dedup.exchange, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup.exchange.chunked, "__defaults__", (chunk,))
    rows = rows_of(seed)
    df = spark.createDataFrame([(i, t, "l", 1, True) for i, t in rows], "doc_id bigint, text string, lead string, entry int, again boolean").repartition(3)
    got = tuples(suffix_dedup.shared_passages(df, passage, k, among, together), "doc_id", "start", "end")
    assert got == sorted(suffix_dedup.brute_force(rows, passage), key=repr) and len(got) > 10


def test_words_decide_and_not_the_hash(spark, monkeypatch):
    """With a hash that takes all suffixes for alike, the same passages are found."""
    rows = rows_of(7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    whole = suffix_dedup.rolling.windows

    def weak(codes, width):
        return whole(codes, width) if width < 10 else whole(codes, width) & suffix_dedup.np.uint64(1)

    monkeypatch.setattr(suffix_dedup.rolling, "windows", weak)
    assert tuples(suffix_dedup.shared_passages(df), "doc_id", "start", "end") == sorted(suffix_dedup.brute_force(rows), key=repr)


def test_masks_of_neighbours():
    """The neighbour that agrees furthest to the right is not the one that agrees to the left."""
    a, b, c = ("r1 r2 r3", "l1 l2"), ("r1 r2 x", "m1 m2"), ("r1 y z", "l1 l2")
    assert suffix_dedup.matches([a, b, c], 3) == [0b100, 0, 0b100]
    assert suffix_dedup.matches([a, b, ("r1 r2 y", "k l2")], 3) == [0b10, 0, 0b10]
    assert suffix_dedup.matches([("", ""), ("", "")], 0) == [1, 1]


def test_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert suffix_dedup.shared_passages(df).count() == 0 and suffix_dedup.shared_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("among", [1, 2, 5, 16])
def test_minimisers_are_the_last_least_grams(among):
    rng = random.Random(among)
    for n in (0, 1, among, 60, 300):
        codes = suffix_dedup.np.array([rng.randrange(3) for _ in range(n)], suffix_dedup.np.uint64)
        grams = suffix_dedup.rolling.windows(codes, 3).tolist()
        expected = [max(range(i, i + among), key=lambda j: (-grams[j], j)) for i in range(len(grams) - among + 1)]
        assert suffix_dedup.minimisers(codes, 3, among).tolist() == expected
