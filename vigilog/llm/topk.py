"""Exact top-k inner products over norm-sorted blocks.

Vectors are scaled to whole numbers, sorted by descending length and packed
into blocks; a stated set of query vectors is packed the same way. The second
moments of all vectors, summed on Spark, give a rotation (the right singular
vectors) that moves most of every vector into its first coordinates. A block of
queries meets the blocks of candidates and prunes in three steps, each of which
is an upper bound on the inner product by Cauchy-Schwarz: length times length,
for whole blocks and then for single vectors, and a partial sum over the first
rotated coordinates plus the lengths of the rests. Only pairs that could still
reach the query's threshold are multiplied, exactly. Thresholds start from the
block of longest vectors and rise while a block is worked through.

Each meeting of blocks yields at most k rows per query that reach the threshold
of that query, which is never above its true k-th score; the best k over all
blocks follow by a window.

Vectors that are null, or hold null or non-finite components, and rows with a
null id take no part. Shorter vectors count as padded with zeros. Repeated rows
take part each on its own; of query rows with one id the smallest vector asks, and
a query leaves out all rows with its own id. Ties go
to the smaller id. Scores beyond 64 bits are held to the largest 64-bit number. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import saved, small_batches

#: The scale of components, rows per query, the divisor of query ids.
SCALE = 1024
K = 10
EVERY = 100
#: Vectors in a block of candidates and of queries; groups of candidate blocks that meet every query block.
BLOCK, QUERIES = 1024, 1024
STRIPES = 96
#: Candidates between two rises of the thresholds.
STEP = 256
#: Up to this product of lengths all sums of whole numbers are exact in doubles.
_EXACT = float(2 ** 52)

_BLOCKS = "longest double, ids binary, data binary, dims int"


def _scaled(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return np.floor(out * SCALE)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    value = F.col(f"`{embedding}`")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(value.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & fine)
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), value.cast("array<double>").alias("v"))


def rotation(rows: DataFrame) -> np.ndarray:
    """Directions of the vectors by falling weight, from second moments that are summed on Spark."""
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _scaled(batch["v"], dims)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "m": total.ravel()})

    if not dims:
        return np.zeros((0, 0))
    total = np.zeros((dims, dims))
    for r in rows.select("v").mapInPandas(moments, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect():
        total[r["i"], r["j"]] = r["m"]
    weights, directions = np.linalg.eigh((total + total.T) / 2)
    return directions[:, np.argsort(-weights)]


def _packed(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Blocks of at most `size` vectors of near lengths, longest first within a block."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []

        def block(own: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
            own, x = own[order], x[order]
            longest = float(np.linalg.norm(x[0])) if dims else 0.0
            return pd.DataFrame([(longest, own.astype("<i8").tobytes(), x.astype("<f8").tobytes(), dims)], columns=["longest", "ids", "data", "dims"])

        for batch in batches:
            ids.append(batch["vec_id"].to_numpy())
            data.append(_scaled(batch["v"], dims))
            if sum(map(len, ids)) >= size:
                own, x = np.concatenate(ids), np.concatenate(data)
                while len(own) >= size:
                    yield block(own[:size], x[:size])
                    own, x = own[size:], x[size:]
                ids, data = [own], [x]
        if sum(map(len, ids)):
            yield block(np.concatenate(ids), np.concatenate(data))

    # The id splits runs of equal lengths, which may be a large share of all rows.
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dealt = rows.withColumn("length", -length).repartitionByRange("length", "vec_id").sortWithinPartitions("length", "vec_id")
    return dealt.select("vec_id", "v").mapInPandas(pack, _BLOCKS)


def _arrays(ids: bytes, data: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, "<i8")
    return own, np.frombuffer(data, "<f8").reshape(len(own), dims)


def _products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (x @ q).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
    return np.array([max(-2 ** 63, min(2 ** 63 - 1, w)) for w in whole], np.int64)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, c_ids: np.ndarray, c: np.ndarray, turn: np.ndarray,
                  k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score): up to k of a block for each query, all that reach its floor and are among the block's best."""
    dims = q.shape[1]
    lead = max(1, dims // 4) if dims else 0
    qr, cr = q @ turn, c @ turn
    q_len, c_len = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    q_rest, c_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    # Rounding of the bounds, many times over; exact scores do not depend on it.
    slack = 1.0 + 1e-9 * q_len * (c_len.max() if len(c_len) else 0.0)
    floors = floors.copy()
    found: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    for begin in range(0, len(c_ids), STEP):
        part = slice(begin, begin + STEP)
        live = np.flatnonzero(q_len * c_len[begin] + slack >= floors)
        if not len(live):
            break
        bound = qr[live, :lead] @ cr[part, :lead].T + np.outer(q_rest[live], c_rest[part])
        short = np.minimum(bound, np.outer(q_len[live], c_len[part])) + slack[live, None]
        hits = (short >= floors[live, None]) & (c_ids[None, part] != q_ids[live, None])
        for row in np.flatnonzero(hits.any(axis=1)):
            at = live[row]
            cols = begin + np.flatnonzero(hits[row])
            exact = q_len[at] * c_len[cols].max() < _EXACT
            scores = _products(c[cols], q[at], exact)
            mine = found[at] + list(zip((-scores).tolist() if exact else [-int(s) for s in scores], c_ids[cols].tolist()))
            mine.sort()
            found[at] = mine[:k]
            if len(found[at]) == k:
                floors[at] = max(floors[at], float(-found[at][-1][0]) if exact else np.nextafter(float(-found[at][-1][0]), -np.inf))
    return [(int(q_ids[r]), i, -s) for r, mine in enumerate(found) for s, i in mine]


def top_k(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: for each vector whose id `every` divides, the k others with the largest inner products."""
    small_batches(vectors.sparkSession)
    rows = _usable(vectors, vec_id, embedding)
    turn = rotation(rows)
    dims = len(turn)
    out = "query_id long, vec_id long, score long"
    blocks = saved(_packed(rows, dims, BLOCK), "vector-blocks")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = saved(_packed(queries, dims, QUERIES), "query-blocks")
    first = blocks.orderBy(F.col("longest").desc(), "ids").limit(1)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, q = _arrays(r.q_ids, r.q_data, dims)
                c_ids, c = _arrays(r.ids, r.data, dims)
                floors = np.frombuffer(r.floors, "<f8") if r.floors is not None else np.full(len(q_ids), -np.inf)
                got = best_of_block(q_ids, q, floors, c_ids, c, turn, k)
                if r.floors is None:
                    # The k-th score of a query, or no floor if the block has fewer.
                    scores: dict[int, list[int]] = {}
                    for i, _, s in got:
                        scores.setdefault(i, []).append(s)
                    low = np.full(len(q_ids), -np.inf)
                    for i, s in scores.items():
                        if len(s) >= k and abs(s[-1]) < _EXACT:
                            low[q_ids == i] = min(s)
                    yield pd.DataFrame([(r.q_ids, r.q_data, r.q_longest, low.astype("<f8").tobytes(), float(low.min(initial=np.inf)))],
                                       columns=["q_ids", "q_data", "q_longest", "floors", "least"])
                elif got:
                    yield pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

    asked = asked.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("longest").alias("q_longest"))
    # One block of candidates goes to each block of queries: its size is bounded by BLOCK.
    start = asked.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one").withColumn("floors", F.lit(None).cast("binary"))
    columns = ["q_ids", "q_data", "q_longest", "ids", "data", "floors"]
    seeded = saved(start.select(*columns).mapInPandas(meet, "q_ids binary, q_data binary, q_longest double, floors binary, least double"), "query-floors")
    # Every block of queries goes to every stripe of blocks of candidates; no row of either is paired outside them. Both sides
    # are shuffled: copies for all stripes are far larger than the file they are made from, by which a broadcast would be chosen.
    spread = seeded.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))))
    striped = blocks.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(STRIPES)).cast("int"))
    pairs = striped.join(spread.hint("merge"), "stripe").where(F.col("longest") * F.col("q_longest") * (1 + 1e-9) + 1 >= F.col("least"))
    best = pairs.select(*columns).mapInPandas(meet, out)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
