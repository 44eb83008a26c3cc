"""Reading exported CSV files as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from spendlens import fixed_values as fx
from spendlens.session import stored

FILE, ORDINAL = "source_file", "row_order"


def _raw(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Undecoded lines with their file and place: the start of their split and a number that rises through it."""
    reader = spark.read.option("recursiveFileLookup", True)
    if encoding:
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    return reader.text(path).select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), "value")


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """``source_file`` and ``encoding`` of every file that has a line: UTF-8, UTF-16LE, UTF-16BE or ISO-8859-1.

    A byte-order mark decides; without one, a zero among the first two bytes tells UTF-16 and its
    order; of the others, files whose lines are all valid are UTF-8, and the rest ISO-8859-1, which
    any bytes satisfy. One scan whose aggregates are numbers, so nothing is sorted.
    """
    start = F.conv(F.rpad(F.hex(F.substring(F.col("value").cast("binary"), 1, 3)), 6, "2"), 16, 10).cast("long")
    votes = _raw(spark, path).groupBy(FILE).agg(
        F.min_by(start, F.when(F.col("split") == 0, F.col("row"))).alias("start"),
        F.min_by(start, F.when((F.col("split") == 0) & (F.octet_length("value") > 0), F.col("row"))).alias("begin"),
        F.min(F.is_valid_utf8("value").cast("int")).alias("valid"))
    mark = F.lpad(F.hex("start"), 6, "0")
    # after an empty first line the second byte of its end stands before the next
    blank_little = (mark == "222222") & F.lpad(F.hex("begin"), 6, "0").startswith("00")
    return votes.select(FILE, F.when(mark == "EFBBBF", "UTF-8").when(mark.startswith("FFFE"), "UTF-16LE").when(mark.startswith("FEFF"), "UTF-16BE")
                        .when(mark.startswith("00"), "UTF-16BE").when((mark.substr(3, 2) == "00") | blank_little, "UTF-16LE")
                        .when(F.col("valid") == 1, "UTF-8").otherwise("ISO-8859-1").alias("encoding"))


def _decoded(lines: DataFrame, encoding: str) -> DataFrame:
    """Lines as text; a byte left over at the end of a UTF-16 file does not count."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return lines
    held = F.col("value").cast("binary")
    if encoding.upper().startswith("UTF-16"):
        held = F.expr("substring(CAST(value AS BINARY), 1, octet_length(value) - octet_length(value) % 2)")
    return lines.withColumn("value", F.decode(held, encoding))


def _lines(spark: SparkSession, path: str, encoding: str | None) -> DataFrame:
    """Every line that is not blank, decoded, with its file, place and the encoding of its file.

    Without ``encoding`` each file has its own. UTF-16 files are read again by their own line ends,
    since their characters may hold the byte of a line end; the driver sees the names of those only.
    """
    if encoding:
        whole = _decoded(_raw(spark, path, encoding), encoding).withColumn("encoding", F.lit(encoding))
    else:
        found = stored(file_encodings(spark, path))
        plain = _raw(spark, path).join(found.where(~F.col("encoding").startswith("UTF-16")), FILE)
        latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
        whole = plain.withColumn("value", F.when(F.col("encoding") == "ISO-8859-1", latin).otherwise(F.col("value")))
        wide: dict[str, list[str]] = {}
        for r in found.where(F.col("encoding").startswith("UTF-16")).collect():
            wide.setdefault(r["encoding"], []).append(r[FILE])
        for name, files in sorted(wide.items()):
            theirs = _raw(spark, path, name).where(F.col(FILE).isin(files))
            whole = whole.unionByName(_decoded(theirs, name).withColumn("encoding", F.lit(name)))
    return whole.withColumn("line", F.regexp_replace("value", "^\ufeff|\r$", "")).drop("value").where(F.trim("line") != "")


def _fields(line: Column, width: int) -> Column:
    """The first ``width`` cells of a line."""
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(width)])
    return F.from_csv(line, schema.toDDL(), {"mode": "PERMISSIVE"})


def _listed(fields: Column, width: int) -> Column:
    return F.array(*[fields.getField(f"c{i}") for i in range(width)])


def _headers(lines: DataFrame) -> tuple[DataFrame, int]:
    """Per file the place of its header and ``names``, its columns (``keys`` in lower case), and the width of the widest header.

    Blank and repeated names are numbered; names that differ in case only count as repeated.
    """
    first = lines.groupBy(FILE, "split").agg(F.min("row").alias("row")).groupBy(FILE).agg(F.min(F.struct("split", "row")).alias("head"))
    heads = lines.join(first, FILE).where(F.struct("split", "row") == F.col("head")).select(FILE, "head", F.col("line").alias("header"))
    bare = F.regexp_replace("header", '"([^"]|"")*"', "")
    heads = stored(heads.withColumn("width", F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1))
    width = heads.agg(F.max("width")).first()[0] or 0
    if not width:
        none = F.array().cast("array<string>")
        return heads.withColumn("names", none).withColumn("keys", none), 0
    heads = heads.withColumn("fields", _fields(F.col("header"), width))
    cells = F.slice(_listed(F.col("fields"), width), 1, F.col("width"))
    named = F.transform(cells, lambda x, i: F.when(F.trim(x) != "", F.trim(x)).otherwise(F.concat(F.lit("_c"), i)))
    heads = heads.withColumn("given", named)
    seen = lambda x, i: F.exists(F.slice("given", 1, i), lambda y: F.lower(y) == F.lower(x))
    heads = heads.withColumn("names", F.transform("given", lambda x, i: F.when(seen(x, i), F.concat(x, i)).otherwise(x))).drop("given", "fields")
    return heads.withColumn("keys", F.transform("names", lambda n: F.lower(n))), width


def _by_header(spark: SparkSession, path: str, encoding: str | None, comments: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of all files with ``names``, ``keys`` and ``cells``, each by its own header, and the headers themselves.

    The header is the first line that is not blank. With ``comments``, lines before it that start
    with ``#`` are passed over; after it they are data. All files are parsed by one projection,
    whatever headers they have.
    """
    lines = _lines(spark, path, encoding)
    heads, width = _headers(lines.where(~F.ltrim("line").startswith("#")) if comments else lines)
    place = F.struct("split", "row")
    body = lines.join(heads.select(FILE, "head", "names", "keys"), FILE).where(place > F.col("head"))
    cells = _listed(F.col("fields"), width) if width else F.array().cast("array<string>")
    parsed = body.withColumn("fields", _fields(F.col("line"), max(width, 1)))
    return parsed.select(FILE, place.alias(ORDINAL), "encoding", "names", "keys", cells.alias("cells")), heads


def _cell(name: str) -> Column:
    """The cell under a column's name, of any case; null where the file has no such column."""
    at = F.array_position("keys", name.lower())
    return F.when(at > 0, F.get("cells", (at - 1).cast("int")))


def _all_columns(heads: DataFrame) -> list[str]:
    """Names of all files' columns, each once, in order of the headers; this alone reaches the driver."""
    each = heads.select("header", F.posexplode("names").alias("at", "name"))
    rows = each.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("header", "at", "name")).alias("first")).orderBy("first").collect()
    return [r["first"]["name"] for r in rows]


def read_ads_csv(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = False) -> DataFrame:
    """Campaign exports with every column as text; blank lines are skipped, each file has its own header.

    Without ``encoding`` every file is read by its own (``file_encodings``). Cells that span lines
    need ``multi_line``, and then all files must share one header and encoding.
    """
    if not multi_line:
        rows, heads = _by_header(spark, path, encoding, comments=False)
        return rows.select(*[_cell(c).alias(c) for c in _all_columns(heads)], FILE, ORDINAL)
    reader = spark.read.option("header", True).option("enforceSchema", False).option("encoding", encoding or "UTF-8")
    return reader.option("multiLine", True).csv(path).select(
        "*", F.col("_metadata.file_path").alias(FILE),
        F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias(ORDINAL))


def read_web_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Web-analytics exports: ``#`` lines before the header skipped, a closing total row removed."""
    rows, heads = _by_header(spark, path, encoding, comments=True)
    return drop_closing_total(rows.select(*[_cell(c).alias(c) for c in _all_columns(heads)], FILE, ORDINAL))


def drop_closing_total(rows: DataFrame, file: str = FILE, ordinal: str = ORDINAL) -> DataFrame:
    """Remove a file's last row when one of its cells speaks of a total."""
    cells = [F.coalesce(F.lower(F.col(f"`{c}`")).contains("total"), F.lit(False)) for c in rows.columns if c not in (file, ordinal)]
    speaks = cells[0]
    for cell in cells[1:]:
        speaks = speaks | cell
    last = rows.groupBy(file).agg(F.max(ordinal).alias("last_row"))
    return rows.join(last, file).where(~((F.col(ordinal) == F.col("last_row")) & speaks)).drop("last_row")


def read_bulk(spark: SparkSession, path: str, client_col: str | None = None, encoding: str | None = None) -> DataFrame:
    """Exports with many clients; every file has its own column that names the client, kept as ``client``.

    That column is ``client_col`` where a file has it, else the first of the known names it has.
    Rows whose client is blank or a null word do not count; files without such a column keep their
    rows, with a null ``client``. If no file has one, rows come without ``client``.
    """
    rows, heads = _by_header(spark, path, encoding, comments=False)
    known = [F.array_position("names", client_col)] if client_col else []
    known += [F.array_position("keys", h) for h in fx.CLIENT_HEADERS]
    at = F.coalesce(*[F.when(k > 0, k.cast("int")) for k in known])
    # a column goes if it names the client in every file that has it
    used = heads.select(at.alias("client_at"), F.posexplode("names").alias("at", "name")).groupBy(F.lower("name").alias("key")).agg(
        F.min(F.coalesce(F.col("at") + 1 == F.col("client_at"), F.lit(False))).alias("always"),
        F.max(F.coalesce(F.col("at") + 1 == F.col("client_at"), F.lit(False))).alias("ever")).where("ever").collect()
    columns = _all_columns(heads)
    if not used:
        return rows.select(*[_cell(c).alias(c) for c in columns], FILE, ORDINAL)
    gone = {r["key"] for r in used if r["always"]} | {"client"}
    client = F.trim(F.get("cells", at - 1))
    named = rows.withColumn("client", client).where(at.isNull() | (F.col("client").isNotNull() & ~F.lower("client").isin("nan", "none", "")))
    return named.select(*[_cell(c).alias(c) for c in columns if c.lower() not in gone], FILE, ORDINAL, "client")


def read_client_files(spark: SparkSession, folder: str, encoding: str | None = None) -> DataFrame:
    """A folder with one export per client; the file name is the client."""
    rows = read_ads_csv(spark, folder, encoding)
    stem = F.regexp_extract(F.url_decode(FILE), r"([^/]+)\.[cC][sS][vV]$", 1)
    return rows.withColumn("client", F.trim(stem))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """First rows of an export with missing cells as empty text."""
    shown = [c for c in df.columns if c not in (FILE, ORDINAL)]
    return df.select(*shown).limit(rows).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in shown])


def read_signals(spark: SparkSession, path: str, signals: list[str]) -> DataFrame:
    """Per file (``path``) the text fragments among ``signals`` that any of its lines holds, as one text.

    Whole files are searched, line by line and split by split; only distinct fragments travel.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    low = lines.select(F.col("_metadata.file_path").alias("path"), F.lower("value").alias("line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").contains(s), F.lit(s)) for s in signals]))
    found = low.select("path", F.explode_outer(hits).alias("signal")).distinct()
    seen = found.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("signal")), "\n").alias("text"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("path"))
    return files.join(seen, "path", "left").select("path", F.coalesce("text", F.lit("")).alias("text"))
