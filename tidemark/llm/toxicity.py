"""Toxic texts, told by which of two zstandard dictionaries shortens their words more."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep, packed, per_batch, texts

#: Bounds of the labelled sample that the driver learns from, parameters of ``learn``: documents of
#: either kind, and bytes of the whole texts of either kind.
MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 2000, 5000, 16 << 20
LEVEL = 12
#: Words in the ordinary part of both dictionaries, and in the toxic part of one.
ORDINARY_WORDS, TOXIC_WORDS = 6000, 600
#: Characters of a window; a longer word has several, and counts by the one that gains most.
WINDOW = 64
FOLDS = 5
MARKS = " .,;:!?\"'()"


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def dictionary_text(words: list[str]) -> bytes:
    """Words as a dictionary's content, the first of them last, where matches cost least.

    Windows and dictionaries are in UTF-32: a match then saves four bytes a character, which
    outweighs the few bytes that zstandard needs to note a match, also for a short word.
    """
    return (" " + " ".join(reversed(words)) + " ").encode("utf-32-le")


def compressor(content: bytes) -> Callable[[bytes], bytes]:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    how = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **how).compress


def gain_of(ordinary: bytes, toxic: bytes) -> Callable[[str], int]:
    """By how many bytes the toxic dictionary shortens a word's window more than the ordinary
    one. The toxic one ends in toxic words and holds the whole ordinary one before them, so
    that ordinary words come out alike."""
    plain, both = compressor(ordinary), compressor(ordinary + toxic)

    def gain(word: str) -> int:
        windows = [f" {part} ".encode("utf-32-le") for part in parts_of(word)]
        return max(len(plain(w)) - len(both(w)) for w in windows)

    return gain


def parts_of(word: str) -> list[str]:
    """``word``, or where it is longer than a window its windows, each half over the one before."""
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def words_of(text: str) -> list[str]:
    return text.lower().split()


class Gains(dict):
    """Gains by word as it stands in a text, worked out once for each bare word."""

    def __init__(self, gain: Callable[[str], int], most: int = 250_000):
        super().__init__()
        self.gain, self.bare, self.most = gain, {}, most

    def __missing__(self, word: str) -> int:
        bare = word.strip(MARKS)
        if len(word) > WINDOW:  # not held, so that long words do not fill the memory
            return self.gain(bare)
        if bare not in self.bare:
            self.bare[bare] = self.gain(bare)
        g = self[word] = self.bare[bare]
        return g

    def of(self, text: str) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
            self.bare.clear()
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the gain from which on a window counts as toxic, and the weights that
    turn a text's windows into a score."""

    ordinary: bytes
    toxic: bytes
    least: int
    weights: tuple[float, ...]

    def score(self, gains: np.ndarray) -> float:
        z = float(np.dot(self.weights, features(gains, self.least)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(gains: np.ndarray, least: int) -> np.ndarray:
    n = int((gains >= least).sum())
    return np.array([1.0, math.log1p(n), math.log1p(100 * n / max(1, len(gains))), min(int(gains.max(initial=0)), 16) / 16])


def different(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The texts that are not mostly made of passages of earlier ones, so that no copied text
    passes for a habit of many. A hash picks an eighth of the passages to compare by."""
    seen, out = set(), []
    for text, label in rows:
        words = text.split()
        grams = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        some = {g for g in grams if g % 8 == 0} or grams
        if 2 * len(some - seen) > len(some):
            out.append((text, label))
        seen |= some
    return out


def telling(counts: Counter, others: Counter, n: int, m: int) -> list[str]:
    """Words of one kind of text that are all but absent from the other, the surest first."""
    sure = {}
    for w, c in counts.items():
        o = others.get(w, 0)
        if c >= 3 and o <= 0.02 * c:
            z = (c / n - o / m) / math.sqrt((c + o + 1) / (n + m) * (1 / n + 1 / m))
            if z > 3:
                sure[w] = z
    return sorted(sure, key=lambda w: (-sure[w], w))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights by Newton's method with a small penalty, each class weighing the same."""
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: list[tuple[str, int]]) -> Model:
    """A model from whole labelled texts: dictionaries from some of them, thresholds and
    weights from the others."""
    rows = different(rows)
    calibrate = [r for i, r in enumerate(rows) if i % 4 == 3]
    learn = [r for i, r in enumerate(rows) if i % 4 != 3]
    counts = {0: Counter(), 1: Counter()}
    number = Counter(label for _, label in learn)
    for text, label in learn:
        counts[label].update({w.strip(MARKS) for w in words_of(text)} - {""})
    if not number[0] or not number[1]:
        # nothing tells the kinds apart, so no text is rejected
        return Model(b"", b"", 1, (min(-0.1, math.log((number[1] + 1) / (number[0] + 1))), 0.0, 0.0, 0.0))
    toxic_words = telling(counts[1], counts[0], number[1], number[0])[:TOXIC_WORDS]
    known = set(toxic_words)
    common = [w for w, _ in sorted(counts[0].items(), key=lambda x: (-x[1], x[0])) if w not in known]
    ordinary, toxic = common[:ORDINARY_WORDS], dictionary_text(toxic_words)
    # ordinary words that the toxic part happens to shorten go into the ordinary part of both
    gain = gain_of(dictionary_text(ordinary), toxic)
    ordinary = [w for w in common[:30_000] if gain(w) >= 3][:4000] + ordinary
    base = dictionary_text(ordinary)
    gains = Gains(gain_of(base, toxic))
    found = [(gains.of(text), label) for text, label in calibrate]
    y = np.array([label for _, label in found])
    if not len(y) or y.min() == y.max():
        return Model(base, toxic, 4, (-2.0, 2.0, 0.0, 0.0))

    def fit(least: int) -> tuple[float, int, np.ndarray]:
        x = np.array([features(g, least) for g, _ in found])
        w = logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.log(p[y == 1])) - np.mean(np.log(1 - p[y == 0]))
        return loss, least, w

    _, least, w = min((fit(t) for t in range(2, 11)), key=lambda f: f[:2])
    x = np.array([features(g, least) for g, _ in found])
    # the two kinds weighed alike above; the last step sets the share of toxic texts right, by
    # the shift that errs least on the calibration rows at a score of one half
    z = x @ w
    cuts = np.unique(np.r_[z - 1e-9, z.max() + 1e-9])
    errors = [((z >= c) & (y == 0)).sum() + ((z < c) & (y == 1)).sum() for c in cuts]
    best = cuts[np.flatnonzero(np.array(errors) == min(errors))]
    w[0] -= float(np.clip(best[len(best) // 2], -8, 8))
    return Model(base, toxic, least, tuple(map(float, w)))


def within_bytes(sizes: list[tuple[int, int, int]], most_bytes: int) -> list[int]:
    """The ids of those of (id, label, bytes) that fit into ``most_bytes`` for each label, by hash of
    the id. A row that does not fit is passed over and costs only itself, and none may take more than
    a 64th of the room while shorter ones are left."""
    room, taken = {label: most_bytes for _, label, _ in sizes}, []
    for doc, label, n in sorted(sizes, key=lambda r: (64 * r[2] > most_bytes, xxhash.xxh64_intdigest(str(r[0])))):
        if n <= room[label]:
            room[label] -= n
            taken.append(doc)
    return sorted(taken, key=lambda doc: xxhash.xxh64_intdigest(str(doc)))


def learn(
    df: DataFrame,
    labels: DataFrame,
    most_toxic: int = MOST_TOXIC,
    most_ordinary: int = MOST_ORDINARY,
    most_bytes: int = MOST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model from rows of ``df`` that ``labels`` (doc_id, toxic) marks and that are not held
    out: of toxic ones ``most_toxic``, of others ``most_ordinary``, and of either kind as many as have
    ``most_bytes`` together, those of lowest hash first.

    Of rows that share an id the one of least text is learnt from. The driver reads the lengths
    of the picked texts, which are a table in the shared folder, and then only those texts that
    fit into the bound of bytes; see ``within_bytes``. An id that ``labels`` marks both ways is left out.
    Where no text of one kind is left, the model rejects nothing."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    some = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, most_toxic), (0, most_ordinary))]
    picked = some[0].unionByName(some[1])
    found = texts(df, id_col, text_col).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = keep(found, "labelled")
    sizes = found.select("doc_id", "toxic", F.octet_length("text").alias("bytes")).collect()
    taken = {doc: k for k, doc in enumerate(within_bytes([(r["doc_id"], r["toxic"], r["bytes"]) for r in sizes], most_bytes))}
    chosen = df.sparkSession.createDataFrame([(doc,) for doc in taken], "doc_id bigint")
    rows = {taken[r["doc_id"]]: (r["text"], r["toxic"]) for r in found.join(F.broadcast(chosen), "doc_id").collect()}
    return train([rows[k] for k in range(len(taken))])


def scorer(model: Model) -> Callable[[str], float]:
    gains = Gains(gain_of(model.ordinary, model.toxic))
    return lambda text: model.score(gains.of(text))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``df``, from the text alone.

    Nulls: a null text counts as empty, and an empty text gets the score of one without toxic
    windows; a null id is not held out. Texts are scored whole. Equal texts get equal scores.
    An empty table gives no rows. Other columns of ``df`` are not read. Without labels of both
    kinds every text gets the same score.
    """
    shared = packed(df.sparkSession, model)  # as large as the dictionaries
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make():
        of = scorer(pickle.loads(shared.value))

        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch["doc_id"], "score": [of(t) for t in batch["text"].to_pylist()]}

        return work

    out = texts(df, id_col, text_col).mapInArrow(per_batch(make, schema), "doc_id bigint, score double")
    return out.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text scores one half or more; columns stay as they are."""
    shared = packed(df.sparkSession, model)
    place, schema = df.columns.index(text_col), df.schema

    def run(batches):
        of = scorer(pickle.loads(shared.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array([of(t or "") < 0.5 for t in part.column(place).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, schema)
