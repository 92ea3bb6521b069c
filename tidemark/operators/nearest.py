"""Nearest vectors by dot product: all rows in blocks, or the cells of an inverted-file index."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grouping import top_per_group

#: Rows the index is fitted on at most, cells it has at most, and of the sample's rows those that
#: serve as queries when the number of probes is chosen.
SAMPLE, MOST_CELLS, TRIED = 16_384, 1_024, 512
#: Rows and queries that are compared in one go.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 512
DECIMALS = 6
MOST_TASKS = 1 << 16


@dataclass(frozen=True)
class Index:
    """Cells by their centres, and in how many cells a query is looked up."""

    centres: np.ndarray
    probes: int

    def nearest_cells(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells of largest dot product for each vector, the best first."""
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def usable(df: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(id, vec) of the rows that have an id and a vector of ``size`` finite numbers."""
    vec = F.col(vec_col).cast("array<double>")
    whole = (F.size(vec) == size) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & whole)


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def k_means(x: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of unit length, started from rows spread over the sample; rows go to the largest dot product."""
    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    centres = unit(x[np.linspace(0, len(x) - 1, cells).astype(int)])
    for _ in range(rounds):
        cell = np.concatenate([np.argmax(part @ centres.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres = np.where(np.bincount(cell, minlength=cells)[:, None] > 0, unit(sums), centres)
    return centres


def fit_index(
    df: DataFrame, k: int = 5, recall: float = 0.95, sample: int = SAMPLE, most_cells: int = MOST_CELLS, rounds: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", size: int = 64
) -> Index:
    """An index for ``df``, fitted on at most ``sample`` rows: those whose ids hash lowest. The number of cells is
    the root of the number of rows, up to ``most_cells``.

    The number of probes is the least with which the ``k`` nearest of ``TRIED`` rows of the
    sample, among the sample, are found with the ``recall`` asked for. All rows of ``df`` are
    indexed when it is searched; the sample only places the cells.
    """
    rows = usable(df, id_col, vec_col, size)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    if not some:
        return Index(np.zeros((1, size)), 1)
    x = np.array([r["vec"] for r in some])
    cells = max(1, min(most_cells, len(x) // 8, round(math.sqrt(rows.count()))))
    index = Index(k_means(x, cells, rounds), cells)
    tried = x[:TRIED]
    scores = tried @ x.T
    scores[np.arange(len(tried)), np.arange(len(tried))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    if not near.size:
        return index
    cell = np.argmax(x @ index.centres.T, axis=1)
    place = np.argsort(index.nearest_cells(tried, cells), axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return Index(index.centres, int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1)


def best_in_block(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` rows of highest rounded score, ties to the smaller id, itself left out."""
    scores = np.round(q @ r.T, DECIMALS)
    scores[q_ids[:, None] == r_ids[None, :]] = -np.inf
    if r.shape[0] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        at, row = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        at, row = np.nonzero(scores > -np.inf)
    found = scores[at, row]
    order = np.lexsort((r_ids[row], -found, at))
    at, row, found = at[order], row[order], found[order]
    starts = np.searchsorted(at, at)
    some = np.arange(len(at)) - starts < k
    return q_ids[at[some]], r_ids[row[some]], found[some]


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    index: Index | None = None,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    size: int = 64,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, neighbour_id, score, place): for each row of ``queries`` the ``k`` rows of ``df``
    with the largest dot product, rounded to ``DECIMALS`` places, ties to the smaller id. A row is
    no neighbour of its own id.

    With an ``index``, only rows in a query's nearest cells are compared; without, all are, exactly.
    The rows of a cell are dealt into blocks of some ``block_rows`` and its queries into blocks of
    some ``block_queries``, so no task grows with a cell, however many rows fall into it, and each
    pair of blocks gives ``k`` rows a query. The driver sees one count a cell.

    Rows and queries without an id or with a vector that is null, of another ``size`` or not of
    finite numbers are left out. Repeated ids are rows of their own. Empty tables give no rows.
    """
    cells = 1 if index is None else len(index.centres)
    probes = 1 if index is None else index.probes

    def placed(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch["vec"], size)
                where = np.zeros((len(x), 1), np.int32) if index is None else index.nearest_cells(x, n)
                at = np.repeat(np.arange(len(x)), where.shape[1])
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at)), batch["vec"].take(pa.array(at)), pa.array(where.ravel())], names=["id", "vec", "cell"])

        return run

    schema = "id bigint, vec array<double>, cell int"
    rows = usable(df, id_col, vec_col, size).mapInArrow(placed(1), schema)
    asked = usable(queries, id_col, vec_col, size).mapInArrow(placed(probes), schema)
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"), F.lit(0).alias("side")).unionByName(asked.groupBy("cell").agg(F.count("*").alias("n"), F.lit(1).alias("side"))).collect()
    blocks = [[1] * cells, [1] * cells]
    for c in counts:
        blocks[c["side"]][c["cell"]] = math.ceil(c["n"] / (block_rows, block_queries)[c["side"]])
    spread = df.sparkSession.createDataFrame(list(zip(range(cells), *blocks, strict=True)), "cell int, row_blocks int, query_blocks int")
    groups = sum(a * b for a, b in zip(*blocks, strict=True))

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        side = side.join(F.broadcast(spread), "cell")  # one row a cell
        own = F.pmod(F.xxhash64("id", "vec"), F.col(f"{mine}s")).cast("int").alias(mine)
        return side.select("id", "vec", "cell", own, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)).repartition(min(groups, MOST_TASKS), "cell", "row_block", "query_block")

    out = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("score", pa.float64())])

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        if not q.num_rows or not r.num_rows:
            return out.empty_table()
        q_ids, r_ids = q["id"].to_numpy(), r["id"].to_numpy()
        x, y = matrix(q["vec"].combine_chunks(), size), matrix(r["vec"].combine_chunks(), size)
        parts = [best_in_block(q_ids[i : i + block_queries], x[i : i + block_queries], r_ids, y, k) for i in range(0, len(x), block_queries)]
        return pa.table([pa.array(np.concatenate(p)) for p in zip(*parts, strict=True)], schema=out)

    by = ["cell", "row_block", "query_block"]
    left, right = dealt(asked, "query_block", "row_block").groupBy(*by), dealt(rows, "row_block", "query_block").groupBy(*by)
    found = left.cogroup(right).applyInArrow(compare, "query_id bigint, neighbour_id bigint, score double")
    best = top_per_group(found, ["query_id"], [F.desc("score"), F.asc("neighbour_id")], k)
    return best.select("query_id", "neighbour_id", "score", F.col("place").cast("bigint").alias("place"))


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours that were found."""
    both = exact.join(found, ["query_id", "neighbour_id"], "left_semi").count()
    return both / max(1, exact.count())
