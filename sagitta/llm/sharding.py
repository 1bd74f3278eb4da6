"""Histogram sort: near-equal shards by bytes, without a sort of all rows and with one exchange.

The sort key is 64 bits: the upper half of a hash of the text, then half a hash of the id, so that equal texts stand
together and any group of copies can still be divided; below it, SALT bits tell rows of equal text and id apart. Rounds of
probes count the exact bytes and rows below candidate key boundaries (a radix trie over the keys: only cells that hold a
wanted splitter, or too many rows for one task, are probed more finely) until all splitters meet the tolerance. Then rows
are dealt once, by cell.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

#: Key bits that the first round probes, those that each later round adds, and those below the key.
FIRST_BITS, MORE_BITS, SALT = 10, 6, 18
#: Rows of a cell that stand in no other's way; tables of more than 256 million rows get more cells, not larger ones.
MOST_IN_CELL = 1_000_000


def sort_key(text: Column, id_col: Column) -> Column:
    """Equal texts share the upper 32 bits; the lower 32 tell copies apart."""
    return F.shiftleft(F.shiftright(F.xxhash64(text), 32), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(id_col), 32))


def _cell(bits: int) -> list[Column]:
    """The first ``bits`` of key and salt, as a part of each."""
    if bits <= 64:
        return [F.shiftright("key", 64 - bits), F.lit(0)]
    return [F.col("key"), F.shiftright("salt", 64 + SALT - bits)]


def probe(keyed: DataFrame, shards: int, tolerance: float, rows_per_cell: int) -> list[tuple[int, int, int, int, int]]:
    """Cells ``(bits, key prefix, salt prefix, bytes, rows)`` in key order that cover all keys, fine enough for every splitter."""

    def counts(df: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
        p, q = _cell(bits)
        return [(bits, *r) for r in df.groupBy(p.alias("p"), q.alias("q")).agg(F.sum("size"), F.count(F.lit(1))).collect()]

    cells = counts(keyed, FIRST_BITS)
    while True:
        cells.sort(key=lambda c: (c[1] << max(0, 64 - c[0]), c[2] << min(SALT, 64 + SALT - c[0])))
        total, below, fine = sum(c[3] for c in cells), 0, defaultdict(list)
        wanted = [total * i / shards for i in range(1, shards)]
        coarse = []
        for c in cells:
            inside = any(below < w < below + c[3] for w in wanted)
            below += c[3]
            if c[0] < 64 + SALT and c[4] > 1 and (inside and c[3] > tolerance * total / shards or c[4] > rows_per_cell):
                fine[c[0]].append(c)
            else:
                coarse.append(c)
        if not fine:
            return cells
        cells = coarse
        for bits, found in fine.items():
            p, q = _cell(bits)
            part = keyed.sparkSession.createDataFrame([c[1:3] for c in found], "p long, q int")
            cells += counts(keyed.join(F.broadcast(part), (p == F.col("p")) & (q == F.col("q")), "left_semi"), bits + MORE_BITS)


def histogram_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, tolerance: float = 0.001, rows_per_cell: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """``row, size, shard, slot`` for every row of ``docs``; row: a struct of its columns (of those in ``keep``, if given), so
    that no name clashes.

    Size: UTF-8 bytes of the text plus 1 (null text: 1). Shards are ranges of the sort key whose bytes differ from an
    equal share by ``tolerance`` of it or by one cell that can't be divided, whichever is more. Slots count from 0 in key
    order. Rows of equal text and id are told apart by where they are stored, so a group of them is divided as any other;
    which of them comes first makes no difference. Texts of any length count whole. An empty table gives no rows.
    Rows are written once to the shared folder, so that probes and exchange see the same. Probe counts grow with
    ``shards`` and with rows / ``rows_per_cell`` (default: an even 1/1024 of the rows,
    times 4, MOST_IN_CELL at most, since a cell is put in order by one task).
    """
    spark, text = docs.sparkSession, F.col(text_col)
    size = F.coalesce(F.octet_length(text.cast("binary")), F.lit(0)).cast("long") + 1
    row = F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns])
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << SALT)).cast("int")
    rows = written(docs.select(row.alias("row"), size.alias("size"), sort_key(text, F.col(id_col)).alias("key"), salt.alias("salt")))
    keyed = rows.select("key", "salt", "size")
    n = keyed.count()
    cells = probe(keyed, shards, tolerance, rows_per_cell or max(1, min(MOST_IN_CELL, 4 * n // (1 << FIRST_BITS))))
    total, below, shard, slot, dealt = sum(c[3] for c in cells), 0, 0, 0, defaultdict(list)
    for number, (bits, p, q, size, count) in enumerate(cells):
        # a cell goes to the shard in whose share its middle lies
        to = max(shard, min(shards - 1, int((below + size / 2) * shards // max(1, total))))
        slot, shard = (slot if to == shard else 0), to
        dealt[bits].append((p, q, number, shard, slot))
        below, slot = below + size, slot + count
    found, where = rows, []
    for bits, part in sorted(dealt.items(), reverse=True):
        p, q = _cell(bits)
        of = spark.createDataFrame(part, f"p{bits} long, q{bits} int, cell{bits} int, shard{bits} int, slot{bits} long")
        found = found.join(F.broadcast(of), (p == F.col(f"p{bits}")) & (q == F.col(f"q{bits}")), "left")
        where.append(F.when(F.col(f"cell{bits}").isNotNull(), F.struct(F.col(f"cell{bits}").alias("cell"), F.col(f"shard{bits}").alias("shard"), F.col(f"slot{bits}").alias("first"))))
    to = F.coalesce(*where) if where else F.struct(*[F.lit(0).cast(t).alias(c) for c, t in (("cell", "int"), ("shard", "int"), ("first", "long"))])
    order = Window.partitionBy("cell", "shard", "first").orderBy("key", "salt")
    return found.select("row", "size", "key", "salt", to.alias("to")).select("row", "size", "key", "salt", "to.*").select("row", "size", "shard", (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("slot"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 8 shards, by law ``bytes``; equal texts stand together in key order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return histogram_shards(docs.withColumn("text_crc32", crc), keep=["doc_id", "text_crc32"]).select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_histogram_sort": op3_histogram_sort}
ORACLES: dict[str, str] = {}
