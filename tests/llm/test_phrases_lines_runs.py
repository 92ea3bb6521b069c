"""Phrases, common lines and periodic runs against brute force, on nulls, empty, long, tied and repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations, line_dedup, periodic_runs
from tidemark.llm.queries import op13_periodic_runs

WIDE = "doc_id bigint, text string, lang string, chunk int, kept string, n bigint, line_key string, starts string, phrase string, rank int"


def frame(spark, rows, parts=3):
    """(doc_id, text, lang) with columns that carry the names operators use inside and give out."""
    return spark.createDataFrame([(*r, 7, "kept", -1, "key", "s", "p", 0) for r in rows], WIDE).repartition(parts)


def worded(seed, n_docs=60):
    rng = random.Random(seed)
    words = ["der", "Die", "das", "New", "york", "é", "a-b", "x", "İ", "🙂"]
    set_phrases = ["new YORK city", "new york city council", "a b c d e f"]
    rows = []
    for i in range(n_docs):
        some = [rng.choice(words) if rng.random() < 0.7 else rng.choice(set_phrases) for _ in range(rng.choice([0, 1, 5, 40]))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  ", ", "]) for w in some), rng.choice(["en", "en", "de", None])))
    return rows + [(None, "new york city", "en"), (900, None, "en"), (901, "", None), (3, rows[3][1], rows[3][2]), (902, "...", "fr"), (903, "word " * 400, "fr")]


@pytest.mark.parametrize(("least", "chunk", "bucket"), [(2, 1 << 20, 1 << 20), (3, 60, 7), (5, 300, 64)])
def test_collocations(spark, least, chunk, bucket):
    rows = worded(least)
    got = collocations.collocations(frame(spark, rows), least, top=25, chunk_chars=chunk, bucket_pairs=bucket).collect()
    assert sorted(map(tuple, got)) == sorted(collocations.brute_force([(lang, t) for _, t, lang in rows], least, top=25)) and got


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, worded(1)).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


@pytest.mark.parametrize("parts", [1, 64, 1 << 20])
def test_dense_and_sparse_tiles_agree(parts):
    rng = np.random.default_rng(5)
    x, y = rng.zipf(1.3, 400_000) % 3000, rng.zipf(1.3, 400_000) % 3000
    seq = np.stack([x, y, np.full(len(x), -1)], axis=1).ravel()
    keys = collocations.keys_of_pairs(seq)[1]
    found, sums = collocations.summed(keys, None, parts)
    assert dict(zip(zip(*(k.tolist() for k in collocations.pair_of(found)), strict=True), sums.tolist(), strict=True)) == Counter(zip(x.tolist(), y.tolist(), strict=True))
    again, twice = collocations.summed(np.r_[found, found], np.r_[sums, sums], parts)
    assert (again == found).all() and (twice == 2 * sums).all()


def test_scores_are_exact_past_64_bits(spark):
    a, n, left, right = 10**12 + 7, 3 * 10**13 + 11, 2 * 10**12 + 3, 10**13 + 9
    one = spark.createDataFrame([(a, n, [left], [right])], "a bigint, n bigint, firsts array<bigint>, rests array<bigint>")
    assert one.selectExpr(f"{collocations.CUT}.score").first()[0] == 1000 * a * n // (left * right)


def test_very_long_texts_are_cut_between_pieces():
    text = "ab cd. " * 50 + "x" * 40
    parts = list(collocations.slices(text, 30))
    assert "".join(parts) == text and all(p.rstrip(" x").endswith(".") or p is parts[-1] for p in parts)


def lined(seed):
    rng = random.Random(seed)
    common = ["É Common Line Number %d that many documents have, of forty signs" % i for i in range(12)] + ["  tOo short, but common  "]
    rows = []
    for i in range(150):
        lines = [rng.choice(common) if rng.random() < 0.25 else f"own line {rng.random()} of document {i} that is long enough" for _ in range(rng.choice([1, 3, 12]))]
        rows.append((i, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 and x.isascii() else x) + rng.choice(["", "\r", "  "]) for x in lines), "en"))
    hot = [(1000 + i, f"The line of a third of all rows, which is hot and long.\n{i}", "en") for i in range(80)]
    nulls = [(None, "A line that only rows without an id have, of some length", "en")] * 6 + [(None, hot[0][1], None), (2000, None, "en"), (2001, "", "en"), (2002, "\n\n", "en")]
    return rows + hot + nulls + [rows[5], rows[5], (2003, common[0] * 3000, "en")]


@pytest.mark.parametrize(("bits", "hashes", "chunk"), [(1 << 24, 1 << 20, 8 << 20), (1 << 16, 40, 900), (16, 40, 900)])
def test_line_dedup(spark, monkeypatch, bits, hashes, chunk):
    """Also with filters so small that they suspect nearly all lines."""
    monkeypatch.setattr(line_dedup.exchange, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(line_dedup.exchange.chunked, "__defaults__", (chunk,))
    rows = lined(bits)
    got = line_dedup.drop_common_lines(frame(spark, rows), segment_bits=bits, segment_hashes=hashes).collect()
    flat = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=repr)
    assert flat == sorted(line_dedup.brute_force([r[:2] for r in rows]), key=repr) and any(r[2] for r in flat)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_common_lines(frame(spark, lined(1)).limit(0)).count() == 0


def test_twice_seen_has_all_repeats_and_few_others():
    rng = np.random.default_rng(1)
    both = line_dedup.TwiceSeen(1 << 18)
    lists = [np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64)) for _ in range(5)]
    lists.append(np.unique(np.r_[lists[0][:50], lists[3][:50]]))
    for h in lists:
        both.add(h, h == lists[1][7])
    suspects = np.concatenate([h[both.suspects(h)] for h in lists[:5]])
    assert set(np.r_[lists[0][:50], lists[3][:50], lists[1][7]].tolist()) <= set(suspects.tolist()) and len(suspects) < 300


def periodic(seed, docs=40):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 5)):
            block = [f"w{rng.randrange(rng.choice([2, 3, 60]))}" for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 40]))]
            words += block * rng.choice([1, 3, 4, 5, 6]) + block[: rng.randrange(len(block))]
            if rng.random() < 0.15:
                words = words * 4
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "  "]).join(words[:700]), "en"))
    return rows + [(None, "a b " * 9, "en"), (5, None, "en"), (6, "", "en"), (7, "one", "en"), rows[0], (8, "x " * 3000, "en"), (None, None, None)]


@pytest.mark.parametrize(("seed", "together"), [(1, 1 << 20), (2, 1), (3, 4000)])
def test_periodic_runs(spark, monkeypatch, tmp_path, seed, together):
    monkeypatch.setattr(periodic_runs, "TOGETHER", together)
    monkeypatch.setattr(periodic_runs.groups_of, "__defaults__", (together,))
    rows = periodic(seed)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    brute = sorted(((b[0], b[1], *b[2:]) for b in (periodic_runs.brute_force(i, t) for i, t, _ in rows)), key=repr)
    assert got == brute and sum(r[1] for r in got) > 20


def test_hashes_that_agree_do_not_decide(monkeypatch):
    """With a hash of few values pairs are tried again under other ones, and results stay whole."""
    rng = random.Random(4)
    block = [f"w{rng.randrange(40)}" for _ in range(20)]
    words = [f"w{rng.randrange(40)}" for _ in range(200)] + block * 5
    plain = periodic_runs.runs_of_texts([1], [words])
    whole = periodic_runs.rolling.windows
    monkeypatch.setattr(periodic_runs.rolling, "windows", lambda codes, width: whole(codes, width) & np.uint64(0xFFF))
    assert plain == periodic_runs.runs_of_texts([1], [words]) and any(q == 20 for *_, q in plain[0])


def test_no_runs_of_nothing(spark):
    df = frame(spark, periodic(1))
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    assert periodic_runs.periodic_runs(df).columns == ["doc_id", "starts", "lengths", "periods", "collapsed"]
