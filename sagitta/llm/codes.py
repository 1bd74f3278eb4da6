"""Vector codes: each vector's parts as indexes into codebooks that weighted Lloyd rounds improve, all in whole numbers.

Equal integer parts of a position are one row with a weight, so a round reads distinct parts only and sends at most one sum for
each codebook entry and task. Codes and errors are then joined back to the vectors by their parts. Parts that very many vectors
share (a bounded number, by their share of all rows) are looked up by broadcast, so no task gets all of a part's vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, table, trimmed, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0


def _floor_div(total: Column, count: Column) -> Column:
    return F.call_function("div", total - F.pmod(total, count), count)


def integer_vectors(vectors: DataFrame, scale: float, parts: int, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """``row, id, label, v array<long>`` of the rows that take part, written, and how many components a part has.

    Vectors shorter than the longest, or than a multiple of ``parts``, are filled up with zeros. Components are held within what
    lets every sum of squares fit 64 bits: 2**27, so inputs to 32,768, for 64 components at a scale of 4,096.
    """
    v = F.col(vector_col).cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).where(F.col("v").isNotNull() & fit)
    longest = rows.agg(F.max(F.size("v"))).collect()[0][0] or 0
    wide = max(1, -(-longest // parts))
    most = 2.0 ** ((62 - int(np.ceil(np.log2(max(2, wide * parts))))) // 2 - 1)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x * scale))))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(wide * parts) - F.size("v")))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", filled.alias("v"))), wide


def distinct_parts(rows: DataFrame, wide: int, parts: int) -> DataFrame:
    """``part struct<pos, x array<long>>, weight``: each position's distinct parts and how many vectors have them."""
    return _exploded(rows, wide, parts).groupBy("part").agg(F.count(F.lit(1)).alias("weight"))


def _exploded(rows: DataFrame, wide: int, parts: int) -> DataFrame:
    cut = F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("v", p * wide + 1, wide).alias("x")) for p in range(parts)])
    return rows.select("row", F.explode(cut).alias("part"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ``x`` the index of the nearest row of ``book`` (ties: the lower one) and the squared distance, exact."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        d = ((x[a : a + 4096, None] - book[None]) ** 2).sum(2)
        code[a : a + 4096] = d.argmin(1)
        error[a : a + 4096] = d.min(1)
    return code, error


def _batch(b: pa.RecordBatch, wide: int) -> tuple[np.ndarray, np.ndarray]:
    part = b.column(b.schema.get_field_index("part"))
    return np.asarray(part.field("pos")), np.asarray(part.field("x").flatten(), np.int64).reshape(-1, wide)


def improved(weighted: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of its parts' mean, unused ones as they were. What comes to the driver is
    one row for each component of an entry."""
    parts, entries, wide = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, wide), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            pos, x = _batch(b, wide)
            weight = np.asarray(b.column(b.schema.get_field_index("weight")), np.int64)
            for p in range(parts):
                at = pos == p
                if at.any():
                    code, _ = nearest(x[at], books[p])
                    np.add.at(total[p], code, x[at] * weight[at, None])
                    np.add.at(count[p], code, weight[at])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(total[p, e].tolist(), pa.list_(pa.int64())), pa.array(count[p, e])], names=["pos", "code", "total", "n"])

    sums = weighted.mapInArrow(trimmed(summed), "pos long, code long, total array<long>, n long")
    each = sums.select("pos", "code", "n", F.posexplode("total").alias("k", "t")).groupBy("pos", "code", "k").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    out = books.copy()
    for pos, code, k, mean in each.select("pos", "code", "k", _floor_div(F.col("t"), F.col("n"))).collect():
        out[pos, code, k] = mean
    return out


def assigned(weighted: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, weight, code, error`` of each distinct part."""
    wide = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, x = _batch(b, wide)
            code, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            for p in np.unique(pos):
                code[pos == p], error[pos == p] = nearest(x[pos == p], books[p])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("part")), b.column(b.schema.get_field_index("weight")), pa.array(code), pa.array(error)], names=["part", "weight", "code", "error"])

    return weighted.mapInArrow(trimmed(run), "part struct<pos: int, x: array<long>>, weight long, code long, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, code, error, label_error`` of every row that takes part, and the codebooks (position, entry, component).

    Components become floor(scale * x) and vectors ``parts`` parts. Each position's codebook starts as that part of the first
    ``entries`` vectors (at most 256) by id, then vector, rows without id last; fewer vectors give fewer entries. A part takes the
    nearest entry, of equally near ones the first. ``code``: two hex digits for each part; ``error``: squared distances, summed;
    ``label_error``: errors summed over all rows with the same label, nulls together (null if 64 bits can't hold it).

    Rows whose vector is null or holds null or non-finite components take no part; shorter vectors, empty ones too, are filled up
    with zeros. Repeated rows and ids each keep their row. No rows give no rows and empty codebooks. Other columns play no part.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    rows, wide = integer_vectors(vectors, scale, parts, id_col, vector_col, label_col)
    first = np.array([r[0] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()], np.int64)
    books = first.reshape(len(first), parts, wide).transpose(1, 0, 2)
    if not len(first):
        return rows.select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    weighted = written(distinct_parts(rows, wide, parts))
    for _ in range(rounds):
        books = improved(weighted, books)
    total = rows.count()
    found = lookup_join(_exploded(rows, wide, parts), written(assigned(weighted, books)), "part", "weight", total * parts)
    shown = F.lpad(F.lower(F.hex("code")), 2, "0")
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("part.pos").alias("pos"), shown.alias("code")))).alias("codes"), F.sum("error").alias("error"))
    ids = rows.select("row", F.col("id").alias("vec_id"), F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).alias("label"))
    each = written(ids.join(by_row, "row").select("vec_id", "label", F.array_join(F.transform("codes", lambda c: c["code"]), "").alias("code"), "error"))
    labels = each.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return lookup_join(each, labels, "label", "n", total).select("vec_id", "code", "error", "label_error"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``, with the digest of the final codebooks."""
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.withColumn("codebooks_sha256", F.lit(digest))


def _oracle() -> str:
    """Rounds written out; distances and means of integer lists."""
    distance = "list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda book: f"SELECT p.*, arg_min(e.e, {{'d': {distance}, 'e': e.e}}) AS code, min({distance}) AS d FROM part p JOIN {book} e USING (pos) GROUP BY ALL"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"""near{r} AS MATERIALIZED ({near(f'book{r}')}),
mean{r} AS (SELECT pos, code, list(m ORDER BY k) AS x FROM (SELECT pos, code, k, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT pos, code, unnest(x) AS c, unnest(range(len(x))) AS k FROM near{r}) GROUP BY pos, code, k) GROUP BY pos, code),
book{r + 1} AS MATERIALIZED (SELECT b.pos, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN mean{r} m ON m.pos = b.pos AND m.code = b.e)""")
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({int(SCALE)} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT vec_id, pos, v[pos * len(v) // {PARTS} + 1:(pos + 1) * len(v) // {PARTS}] AS x FROM v, range({PARTS}) t(pos)),
book0 AS (SELECT pos, e, x FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{', '.join(steps)},
last_ AS ({near(f'book{ROUNDS}')}),
row_ AS (SELECT vec_id, string_agg(printf('%02x', code), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM last_ GROUP BY vec_id),
said AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM row_ JOIN v USING (vec_id), said
"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
ORACLES = {"op11_vector_codes": _oracle()}
