import csv
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sagitta.operators.catalogue import EXPORT_COLUMNS, Catalogue
from sagitta.sources import sinks


@pytest.fixture(scope="module")
def small(spark):
    """A quiver without class, an open class, null counts and types, an orbit that isn't stored, ties."""
    quivers = spark.createDataFrame(
        [("Q.a", 2, [[0, 1], [-1, 0]], 1, True, True, True, False, True, 2, "finite", (1, "1", []), "M.1"), ("Q.b", 2, [[0, 2], [-2, 0]], 2, True, True, True, True, True, None, "tame", (1, "1", []), "M.2"),
         ("Q.c", 3, [[0, 0, 0], [0, 0, 0], [0, 0, 0]], 0, True, False, True, False, None, 1, None, (6, "S_3", []), None), ("Q.d", 2, [[0, 0], [0, 0]], 0, True, False, True, False, True, 1, "finite", (2, "Z/2", []), "M.3")],
        "quiver_id string, n_vertices int, canonical_matrix array<array<int>>, max_edge int, is_acyclic boolean, is_connected boolean, is_bipartite boolean, is_abundant boolean, is_planar boolean, labeling_count int, representation_type string, symmetry_group struct<order int, name string, generators array<array<int>>>, mc_id string")
    classes = spark.createDataFrame(
        [("M.1", 2, [[0, -1], [1, 0]], False, 2, 1, 1, "Q.a", "A2", "A2", True, False, False, 0, True, True, True, True), ("M.2", 2, [[0, -2], [2, 0]], True, 5, 1, 1, "Q.b", None, None, False, True, False, 3, None, None, None, None),
         ("M.3", 2, [[0, 0], [0, 0]], False, 1, 1, 1, "Q.d", "A1 + A1", None, True, False, False, 0, True, True, True, True)],
        "mc_id string, n_vertices int, canonical_rep array<array<int>>, is_open boolean, labeled_size int, distinct_quiver_count int, merged_orbit_count int, canonical_qid string, dynkin_type string, label string, is_finite_confirmed boolean, is_infinite_confirmed boolean, is_infinite_expected boolean, size_of_explored_frontier int, is_mutation_acyclic boolean, is_banff boolean, is_louise boolean, is_p_prime boolean")
    labeled = spark.createDataFrame([("M.1", "Q.a", [[0, 1], [-1, 0]]), ("M.1", "Q.a", [[0, -1], [1, 0]]), ("M.3", "Q.d", [[0, 0], [0, 0]])], "mc_id string, quiver_id string, matrix array<array<int>>")
    return Catalogue(quivers, classes, labeled)


def ids(rows, name="quiver_id"):
    return [r[name] for r in rows.collect()]


def test_listing(small):
    assert ids(small.list_quivers()) == ["Q.a", "Q.b", "Q.d", "Q.c"]
    assert ids(small.list_quivers(sort="class_size")) == ["Q.d", "Q.a", "Q.b", "Q.c"]  # nulls last
    assert ids(small.list_quivers(sort="class_size", direction="desc")) == ["Q.c", "Q.b", "Q.a", "Q.d"]  # nulls first
    assert ids(small.list_quivers(sort="nonsense", direction="DESC", offset=1, limit=2)) == ["Q.b", "Q.d"]
    rows = {r["quiver_id"]: r for r in small.list_quivers().collect()}
    assert rows["Q.c"]["is_open"] is False and rows["Q.c"]["class_size"] is None and rows["Q.b"]["class_size"] is None and rows["Q.a"]["class_size"] == 2
    with pytest.raises(ValueError):
        small.list_quivers(scope="Distinct")
    with pytest.raises(ValueError):
        small.list_quivers(offset=-1)


def test_filters(small):
    of = lambda **f: sorted(ids(small.filtered(**f), "quiver_id"))
    assert of(is_open=False) == ["Q.a", "Q.d"]  # not the one without a class
    assert of(is_open=True, is_mutation_finite=True) == []
    assert of(is_simply_laced=True) == ["Q.a", "Q.c", "Q.d"] and of(is_simply_laced=False) == ["Q.b"]
    assert of(orbit_min=3) == ["Q.b"] and of(orbit_max=2, rank=2) == ["Q.a", "Q.d"]
    assert of(representation_type="finite", dynkin_type="A2") == ["Q.a"]


def test_labelings_and_totals(small):
    assert ids(small.list_quivers(scope="labelings")) == ["Q.a", "Q.a", "Q.b", "Q.d", "Q.c"]
    assert small.totals().collect()[0][:] == (4, 4, 4) and small.totals("labelings", rank=2).collect()[0][:] == (3, 3, 3)
    assert small.totals(rank=9).collect()[0][:] == (0, 0, 0)


@pytest.mark.parametrize(("sort", "direction"), [("num_vertices", "asc"), ("class_size", "asc"), ("class_size", "desc"), ("max_edge", "desc"), ("quiver_id", "asc")])
def test_pages_of_labelings(small, sort, direction):
    place = lambda rows: [(r["quiver_id"], r["exchange_matrix"]) for r in rows.collect()]
    whole = place(small.list_quivers(scope="labelings", sort=sort, direction=direction, limit=None))
    assert len(whole) == 5
    for offset, limit in ((0, 2), (1, 1), (2, 9), (5, 3), (0, 0)):
        assert place(small.list_quivers(scope="labelings", sort=sort, direction=direction, offset=offset, limit=limit)) == whole[offset : offset + limit]


def test_details(small):
    assert small.quiver("Q.zzz").count() == 0 and small.class_("M.zzz").count() == 0
    assert small.quiver("Q.c").collect()[0]["tags"] == []
    row = small.class_("M.1").collect()[0]
    assert row["class_size"] == 2 and [d["quiver_id"] for d in row["distinct_quivers"]] == ["Q.a"] and row["distinct_quivers"][0]["is_canonical"]


def test_export(small, tmp_path):
    rows = small.export()
    assert rows.columns == EXPORT_COLUMNS
    n = sinks.write_csv_file(rows, str(tmp_path / "x.csv"))
    data = (tmp_path / "x.csv").read_bytes()
    # byte for byte what Python's writer makes of the rows
    buffer = io.StringIO()
    writer = csv.writer(buffer)
    writer.writerows([rows.columns, *map(list, sinks.cells(rows).collect())])
    assert data == b"\xef\xbb\xbf" + buffer.getvalue().encode() and n == len(data)
    assert data.startswith(b"\xef\xbb\xbfquiver_id,") and data.count(b"\r\n") == 5
    assert b'Q.a,2,"[[0,1],[-1,0]]",finite,1,TRUE,TRUE,TRUE,FALSE,TRUE,1,1,M.1,A2,FALSE,2,' in data and b"Q.c,3," in data
    assert sinks.write_xlsx(rows, str(tmp_path / "x.xlsx")) == 4
    book = zipfile.ZipFile(tmp_path / "x.xlsx")
    sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert 'topLeftCell="A2"' in sheet and sheet.count("<row ") == 5 and 'name="quivers"' in book.read("xl/workbook.xml").decode()
    sinks.write_csv(rows, str(tmp_path / "many"))
    assert any(b'"[[0,1],[-1,0]]"' in p.read_bytes() for p in (tmp_path / "many").glob("*.csv"))


def test_csv_of_odd_cells(spark, tmp_path):
    rows = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(['a,b', 'say "x"', "two\r\nlines", "", None, "é日", " plain ", '"'] * 50)], "`a,b` int, t string, ok boolean").repartition(7).orderBy("`a,b`")
    sinks.write_csv_file(rows, str(tmp_path / "odd.csv"))
    buffer = io.StringIO()
    csv.writer(buffer).writerows([rows.columns, *([str(i), t or "", str(ok).upper()] for i, t, ok in rows.collect())])
    assert (tmp_path / "odd.csv").read_bytes() == b"\xef\xbb\xbf" + buffer.getvalue().encode()
    sinks.write_csv_file(rows.limit(0), str(tmp_path / "odd.csv"))
    assert (tmp_path / "odd.csv").read_bytes() == b'\xef\xbb\xbf"a,b",t,ok\r\n'


def test_download(small, spark, tmp_path):
    log = str(tmp_path / "log")
    path = small.download(str(tmp_path), log, scope="Labelings", fmt="CSV", email="", rank=2)
    assert re.search(r"catalogue-labelings-\d{8}-\d{6}\.csv$", path) and open(path, "rb").read().count(b"\r\n") == 5
    small.download(str(tmp_path), log, fmt="xlsx")
    rows = {r["fmt"]: r for r in spark.read.parquet(log).collect()}
    assert (rows["csv"]["row_count"], rows["csv"]["filters"], rows["csv"]["email"], rows["xlsx"]["row_count"]) == (4, '{"rank":"2","scope":"labelings"}', None, 4)
    for bad in ({"scope": "all"}, {"fmt": "json"}):
        with pytest.raises(ValueError):
            small.download(str(tmp_path), log, **bad)
    (tmp_path / "file").write_text("x")
    with pytest.warns(UserWarning, match="not logged"):
        small.download(str(tmp_path), str(tmp_path / "file" / "log"), rank=2)


def test_backfills(small, spark):
    assert {r[0]: r[1] for r in small.backfilled_labeling_counts().select("quiver_id", "labeling_count").collect()} == {"Q.a": 2, "Q.b": 1, "Q.c": 1, "Q.d": 1}
    changes = small.mutation_acyclic_changes(spark.createDataFrame([("M.1", True), ("M.2", False), ("M.3", None)], "mc_id string, resolved boolean"))
    assert sorted((r[0], r[1], r[2]) for r in changes.collect()) == [("M.2", None, False), ("M.3", True, None)]


def test_upsert(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    assert sorted(map(tuple, sinks.upsert(frame([(1, "a"), (2, "b")]), frame([(2, "c"), (3, "d")]), "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_log(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.log_download(spark, path, "csv", 3, {"rank": 2, "is_open": None, "scope": "distinct"}, email="", name="x")
    sinks.log_download(spark, path, "xlsx", 0)
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["fmt"])
    assert rows[0]["filters"] == '{"rank":"2","scope":"distinct"}' and rows[0]["email"] is None and rows[0]["name"] == "x" and rows[1]["filters"] is None and rows[1]["created_at"] is not None
    ip = spark.range(1).select(sinks.client_ip(F.lit(" 1.2.3.4 , 5.6.7.8"), F.lit("p")), sinks.client_ip(F.lit(""), F.lit("p")), sinks.client_ip(F.lit(None).cast("string"), F.lit("p"))).collect()[0]
    assert ip[:] == ("1.2.3.4", "p", "p")
    assert sinks.file_name("labelings", "csv").startswith("catalogue-labelings-")


def test_a_catalogue_of_five_vertices(spark):
    """What a path of five vertices and its parts reach, with generators, listings and pages of labelings."""
    from itertools import permutations

    from sagitta.operators.generate import generation_of

    path = [[(j == i + 1) - (j == i - 1) for j in range(5)] for i in range(5)]
    matrices = spark.createDataFrame([([r[:n] for r in path[:n]],) for n in range(1, 6)], "matrix array<array<int>>")
    c = Catalogue.of(spark, generation_of(spark, matrices, max_vertices=5))
    assert {r["n_vertices"]: r["labeled_size"] for r in c.classes.collect()} == {1: 1, 2: 2, 3: 14, 4: 144, 5: 1_980}
    for r in c.quivers.where("n_vertices = 5").collect():
        m, group = r["canonical_matrix"], r["symmetry_group"]
        own = [p for p in permutations(range(5)) if [[m[i][j] for j in p] for i in p] == m]
        assert group["order"] == len(own) and (len(own) > 1) == bool(group["generators"]) and all(tuple(g) in own for g in group["generators"])
    assert c.classes.where("is_banff and is_louise and is_p_prime and is_mutation_acyclic").count() == 5
    assert c.totals(rank=5).collect()[0]["labeled_total"] == 1_980 and c.list_quivers(scope="labelings", rank=5, offset=1_970, limit=50).count() == 10
