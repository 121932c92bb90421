"""Nearest neighbours by randomly rotated one-bit codes with error bounds.

A vector, less the mean of its block, is split into its length and its direction; the direction is turned by a random
rotation and only the signs are kept, packed eight to a byte, with two scalars: the length, and the inner product of
the direction with its own code. For a query turned the same way, the inner product with the code divided by that
scalar s estimates the inner product of the directions without bias, and its error stays within
sqrt(1 - s^2) / s * min(1, ``BOUND`` / sqrt(d - 1)) but for a probability that falls exponentially with the square of
``BOUND``. So every query has a lower and an upper bound of each distance; a vector whose lower bound lies above the
k-th smallest upper bound, or the k-th smallest distance known so far, is out, the rest is reranked by its distance.

Scale: vectors are dealt to blocks by a hash; every query visits every block and brings back its k nearest there, of
which the k nearest in all are kept. A task holds one block of at most ``BLOCK_BYTES`` and streams the queries. Equal
vectors beyond the first k + 1 by id can be nobody's k nearest and are left out of a block, so a vector that occurs
very often costs a query no more than one that is rare. Results do not depend on how vectors are dealt, but for
the chance above.

Rows: vectors that are null, empty, zero or hold a null or non-finite component take no part. Only vectors of equal length
are compared. A query is not its own neighbour; other rows with its id are. Of neighbours at the same distance the
smaller id is nearer, null ids last; rows with a null id are candidates, but no queries. Repeated query rows are answered
each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from govspark.llm.streams import runs
from govspark.session import fresh_path

NEAREST, EVERY = 10, 100
#: Width of the error bound in standard deviations, and the seed of the rotation.
BOUND, SEED = 4.0, 20_240_601
#: Vectors of a block in bytes at most, the fewest worth a block of their own, queries that are answered together, and
#: bounds that are computed at a time.
BLOCK_BYTES, SMALL, TOGETHER, BOUNDS = 64 << 20, 2048, 256, 1 << 20


@lru_cache(maxsize=2)
def rotation(size: int) -> np.ndarray:
    """Random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of the rows of ``vectors`` (double)."""

    def __init__(self, vectors: np.ndarray):
        self.centre = vectors.mean(axis=0)
        self.size = -(-vectors.shape[1] // 8) * 8  # filled up with zeros to whole bytes
        turned = self._turn(vectors)
        self.length = np.linalg.norm(turned, axis=1)
        some = self.length > 0
        self.packed = np.packbits(turned > 0, axis=1)
        #: Inner product of each direction with its code, and the bound of the error made with it.
        self.agreement = np.ones(len(vectors))
        self.agreement[some] = np.abs(turned[some]).sum(axis=1) / self.length[some] / np.sqrt(self.size)
        aside = np.sqrt(np.maximum(0.0, 1 - self.agreement**2)) / self.agreement
        self.error = aside * min(1.0, BOUND / np.sqrt(self.size - 1)) + 1e-5  # and what single precision may lose

    def _turn(self, vectors: np.ndarray) -> np.ndarray:
        moved = np.zeros((len(vectors), self.size))
        moved[:, : vectors.shape[1]] = vectors - self.centre
        return moved @ rotation(self.size)

    def bounds(self, queries: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of every query to the coded vectors ``rows``."""
        turned = self._turn(queries)
        length = np.linalg.norm(turned, axis=1)[:, None]
        direction = np.divide(turned, length, out=np.zeros_like(turned), where=length > 0).astype(np.float32)
        signs = np.unpackbits(self.packed[rows], axis=1).astype(np.float32) * 2 - 1
        estimate = (direction @ signs.T) / np.sqrt(self.size) / self.agreement[rows]
        squares, cross = length**2 + self.length[rows] ** 2, 2 * length * self.length[rows]
        low = squares * (1 - 1e-12) - cross * np.minimum(1.0, estimate + self.error[rows])
        high = squares * (1 + 1e-12) - cross * np.maximum(-1.0, estimate - self.error[rows])
        return low, high


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row in double precision, components added in order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        step = a[:, k] - b[:, k]
        total += step * step
    return np.sqrt(total)


class Block:
    """Vectors of one block, ordered by id (nulls last); of equal ones the first ``nearest`` + 1 are kept."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, named: np.ndarray, vectors: np.ndarray, nearest: int):
        order = np.lexsort((rows, ids, ~named))
        plain = np.ascontiguousarray(vectors[order] + 0.0)  # no negative zeros
        group = np.unique(plain.view(f"V{plain.itemsize * plain.shape[1]}").ravel(), return_inverse=True)[1]
        sizes = np.bincount(group)
        rank = np.empty(len(group), dtype=np.int64)
        rank[np.argsort(group, kind="stable")] = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = order[rank <= nearest]
        self.rows, self.ids, self.named, self.vectors = rows[keep], ids[keep], named[keep], vectors[keep]
        self.nearest = nearest
        self.codes = Codes(self.vectors)

    def search(self, rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, distance) of the nearest vectors of every query, in order."""
        query, vector, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        known = np.full(len(queries), np.inf)  # squared distance of the last of the nearest so far
        step = max(self.nearest + 1, BOUNDS // len(queries))
        for at in range(0, len(self.rows), step):
            low, high = self.codes.bounds(queries, slice(at, at + step))
            if high.shape[1] > self.nearest:  # one more than wanted, as the query itself may be among them
                known = np.minimum(known, np.partition(high, self.nearest, axis=1)[:, self.nearest])
            new_query, new_vector = np.nonzero(low <= known[:, None])
            new_vector += at
            other = self.rows[new_vector] != rows[new_query]
            new_query, new_vector = new_query[other], new_vector[other]
            found = [distances(queries[new_query[i : i + 65536]], self.vectors[new_vector[i : i + 65536]])
                     for i in range(0, len(new_query), 65536)]
            query, vector = np.append(query, new_query), np.append(vector, new_vector)
            exact = np.concatenate([exact, *found])
            order = np.lexsort((vector, exact, query))
            query, vector, exact = query[order], vector[order], exact[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            last = rank == self.nearest - 1
            known[query[last]] = np.minimum(known[query[last]], exact[last] ** 2 * (1 + 1e-9))
            query, vector, exact = (x[rank < self.nearest] for x in (query, vector, exact))
        return query, vector, exact


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _search(batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """The nearest of each query within each block: vectors come first (visit 0), then queries."""
    held: list[tuple] = []
    block, open_key = None, None
    for (size, number, visit), piece in runs(batches, "size", "block", "visit"):
        if (size, number) != open_key:
            held, block, open_key = [], None, (size, number)
        rows, vectors = piece.column("row").to_numpy(), _matrix(piece.column("vector"))
        ids, named = piece.column("id").fill_null(0).to_numpy(), piece.column("id").is_valid().to_numpy(zero_copy_only=False)
        if visit == 0:
            held.append((rows, ids, named, vectors))
            continue
        if block is None:
            if not held:
                continue
            block, held = Block(*(np.concatenate(x) for x in zip(*held)), nearest), []
        for at in range(0, len(rows), TOGETHER):
            query, vector, score = block.search(rows[at : at + TOGETHER], vectors[at : at + TOGETHER])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[query + at]), pa.array(ids[query + at]), pa.array(block.rows[vector]),
                 pa.array(block.ids[vector], mask=~block.named[vector]), pa.array(score)],
                names=["query_row", "query_id", "row", "vec_id", "score"],
            )


def nearest_neighbours(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id", nearest: int = NEAREST,
                       every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``nearest`` rows of every row whose id ``every`` divides, by Euclidean
    distance over all other rows."""
    spark = rows.sparkSession
    kind = rows.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    values = F.col("vector")
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    path = fresh_path(spark, "vectors")
    (
        rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("vector"))
        .where(~odd & F.exists(values, lambda x: x != 0))
        .select(F.monotonically_increasing_id().alias("row"), "id", "vector", F.size("vector").alias("size"))
        .write.parquet(path)
    )
    stored = spark.read.parquet(path)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = F.count("*")
    blocks = F.greatest(F.ceil(many * F.col("size") * 8 / BLOCK_BYTES), F.least(F.lit(tasks), F.ceil(many / SMALL)))
    sized = stored.join(stored.groupBy("size").agg(blocks.cast("int").alias("blocks")), "size")
    homes = sized.select("size", F.pmod(F.xxhash64("row"), "blocks").cast("int").alias("block"), F.lit(0).alias("visit"), "row", "id", "vector")
    visits = sized.where(F.col("id") % every == 0).select(
        "size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("visit"), "row", "id", "vector")
    found = (
        homes.unionByName(visits).repartition("size", "block").sortWithinPartitions("size", "block", "visit")
        .mapInArrow(partial(_search, nearest=nearest), "query_row long, query_id long, row long, vec_id long, score double")
    )
    order = Window.partitionBy("query_row").orderBy("score", F.asc_nulls_last("vec_id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
