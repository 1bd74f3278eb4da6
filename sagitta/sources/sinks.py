"""Sinks: upsert, CSV and XLSX exports, the download log."""

from __future__ import annotations

import zipfile
from datetime import UTC, datetime
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import work_dir

#: Fixed values of the formats: byte order mark and line end of CSV, file names, the workbook's sheet.
BOM, LINE_END = b"\xef\xbb\xbf", "\r\n"
SHEET = "quivers"
FORMATS, SCOPES = ("csv", "xlsx"), ("distinct", "labelings")
LOG_SCHEMA = "created_at timestamp, fmt string, row_count long, filters string, email string, name string, ip string, user_agent string, referer string"


def upsert(old: DataFrame, new: DataFrame, key: str, latest: Column | None = None, unique: bool = True) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it has no key of. Nothing else is deleted.

    Of ``new`` rows with one key the one with the greatest ``latest`` stays, else the greatest by its columns as text; with ``unique`` off all do,
    each once. A null key is no key: such rows stay as they are."""
    columns = old.columns
    named = new.select(*columns, (latest if latest is not None else F.lit(0)).alias("_latest"))
    if unique:
        text = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns if dict(new.dtypes)[c] != "variant"])
        kept = named.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_latest", text)).alias("row")).select("row.*")
        named = kept.unionByName(named.where(F.col(key).isNull()).select(*columns))
    else:
        named = named.select(*columns).distinct()
    return old.join(new.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*columns).unionByName(named.select(*columns))


def cell(c: Column, kind: str) -> Column:
    """Text of a cell: null is empty, booleans are TRUE and FALSE."""
    text = F.upper(c.cast("string")) if kind == "boolean" else c.cast("string")
    return F.coalesce(text, F.lit(""))


def cells(rows: DataFrame) -> DataFrame:
    return rows.select(*[cell(F.col(c), kind).alias(c) for c, kind in rows.dtypes])


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with header, CRLF and quotes where needed; written by all executors, without a byte order mark."""
    cells(rows).write.option("header", True).option("lineSep", LINE_END).option("escape", '"').option("emptyValue", "").csv(path)


def csv_lines(rows: DataFrame) -> DataFrame:
    """``line``: each row as a line of CSV, cells in quotes where they need them."""
    doubled = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    quoted = [F.when(F.col(f"`{c}`").rlike('[,"\r\n]'), doubled(F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")) for c in rows.columns]
    return cells(rows).select(F.concat_ws(",", *quoted).alias("line"))


def write_csv_file(rows: DataFrame, path: str) -> int:
    """One CSV file with header and byte order mark; returns its bytes.

    All executors write lines, in the order of ``rows``, and the parts are put behind the header by the file system: copied as
    streams, each to where the lengths of those before it say. No row passes through Python on the driver."""
    spark = rows.sparkSession
    parts = work_dir(spark)
    csv_lines(rows).write.option("lineSep", LINE_END).text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    files = target.getFileSystem(conf)
    found = folder.getFileSystem(conf).listStatus(folder)
    sources = sorted((x.getPath().getName(), x.getLen(), x.getPath()) for x in found if x.getPath().getName().startswith("part-") and x.getLen())
    head = csv_lines(spark.createDataFrame([tuple(rows.columns)], ", ".join(f"`{c}` string" for c in rows.columns))).collect()[0][0]
    out = files.create(target, True)
    out.write(bytearray(BOM + (head + LINE_END).encode()))
    begins = out.getPos()
    for _, size, source in sources:
        data = source.getFileSystem(conf).open(source)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, conf, False)
        data.close()
        begins += size
        if out.getPos() != begins:
            raise OSError(f"{source} has not been copied whole")
    out.close()
    return begins


def _column(i: int) -> str:
    name = ""
    while i >= 0:
        name, i = chr(65 + i % 26) + name, i // 26 - 1
    return name


def _xml_cell(value, place: str, style: int) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{place}" s="{style}"><v>{value}</v></c>'
    text = {True: "TRUE", False: "FALSE"}.get(value, value) if isinstance(value, bool) else value
    return f'<c r="{place}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(text))}</t></is></c>'


def write_xlsx(rows: DataFrame, path: str) -> int:
    """One workbook: bold header, frozen below it; rows are streamed through the driver. Returns their number."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
    }
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, head + text)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            put = lambda x: sheet.write(x.encode())
            put(f'{head}<worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>')
            put('<row r="1">' + "".join(_xml_cell(c, f"{_column(i)}1", 1) for i, c in enumerate(rows.columns)) + "</row>")
            for n, row in enumerate(rows.toLocalIterator(), 1):
                put(f'<row r="{n + 1}">' + "".join(_xml_cell(v, f"{_column(i)}{n + 1}", 0) for i, v in enumerate(row)) + "</row>")
            put("</sheetData></worksheet>")
    return n


def file_name(scope: str, fmt: str, now: datetime | None = None, prefix: str = "catalogue") -> str:
    return f"{prefix}-{'labelings' if scope == 'labelings' else 'quivers'}-{(now or datetime.now(UTC)).strftime('%Y%m%d-%H%M%S')}.{fmt}"


def checked(scope: str, fmt: str) -> tuple[str, str]:
    """Scope and format of a download in lower case; ValueError for others than there are."""
    scope, fmt = scope.lower(), fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if scope not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    return scope, fmt


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, else the peer's; an empty header is none."""
    return F.when(F.length(forwarded) > 0, F.trim(F.split(forwarded, ",")[0])).otherwise(peer)


def logged_filters(filters: Column) -> Column:
    """A map of filters without those that aren't set, as JSON."""
    return F.to_json(F.map_filter(filters, lambda _, v: v.isNotNull()))


def log_rows(events: DataFrame) -> DataFrame:
    """Events ``fmt, row_count, filters map<string, string>, email, name, ip, user_agent, referer`` as rows of the log: empty filters, e-mails and names are null."""
    return events.select(
        F.current_timestamp().alias("created_at"), "fmt", F.col("row_count").cast("long").alias("row_count"), F.when(F.size("filters") > 0, logged_filters(F.col("filters"))).alias("filters"),
        F.nullif("email", F.lit("")).alias("email"), F.nullif("name", F.lit("")).alias("name"), "ip", "user_agent", "referer",
    )


def log_download(spark: SparkSession, path: str, fmt: str, row_count: int, filters: dict | None = None, email: str | None = None, name: str | None = None, ip: str | None = None, user_agent: str | None = None, referer: str | None = None) -> None:
    """Appends one row to the log."""
    kept = {k: str(v) for k, v in (filters or {}).items() if v is not None}
    schema = "fmt string, row_count long, filters map<string, string>, email string, name string, ip string, user_agent string, referer string"
    log_rows(spark.createDataFrame([(fmt, row_count, kept, email, name, ip, user_agent, referer)], schema)).write.mode("append").parquet(path)
