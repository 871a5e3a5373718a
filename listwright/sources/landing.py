"""Scans of submitted files: every cell a string, every record numbered over the submission and within its file."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.fixed import OPTIONAL_FIELDS, REQUIRED_FIELDS, UNLISTED_FIELDS
from listwright.session import stage


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """Adds ``record_no``, unique in the submission, and ``line_no``, the position in the file; both count from ``first``.

    Files count in the order of their paths. A block of a file is read by one task from start to end, so its rows have
    consecutive task ids; the landed copy fixes them before the first id of each block is looked up.
    """
    landed = stage(rows.withColumns({"file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}), "landed")
    blocks = landed.groupBy("file", "_block").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n"))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("file", "_block", "_start", ahead(Window.orderBy("file", "_block")).alias("_before"), ahead(Window.partitionBy("file").orderBy("_block")).alias("_inside"))
    place = F.col("_at") - F.col("_start") + first
    out = landed.join(offsets, ["file", "_block"]).withColumns({"record_no": place + F.col("_before"), "line_no": place + F.col("_inside")})
    return out.drop("_block", "_at", "_start", "_before", "_inside")


#: A quoted cell's content, a whole cell, and lines that end inside a quoted cell: begun outside of one, and inside.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:[\x00-\x20]*+"{_QUOTED}"[^,]*+|(?![\x00-\x20]*+")[^,]*+)'
_OPENS = rf'(?:{_CELL},)*+[\x00-\x20]*+"{_QUOTED}\z'
_FROM_OUTSIDE, _FROM_INSIDE = rf"^{_OPENS}", rf'^{_QUOTED}(?:\z|"[^,]*+,{_OPENS})'
_CSV = {"escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}


def _entered(rows: DataFrame, key: list[str], order: list[str], entry: Column) -> DataFrame:
    """Adds ``state``, whether a quoted cell is open (1) or not (0) ahead of each row, and ``flips``.

    A row sets the state (``sets``: 0 or 1) or, where that is null, flips it ``odd`` times. So the state is what the last
    setting row left, flipped as often as the rows since then did; ``entry`` where no row has set it.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("flips", F.sum("odd").over(w))
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "flips")), True).over(ahead)
    rows = rows.withColumns({"_last": last, "_flips": F.coalesce(F.sum("odd").over(ahead), F.lit(0))})
    since = F.coalesce(F.col("_last.sets") + F.col("_flips") - F.col("_last.flips"), entry + F.col("_flips"))
    return rows.withColumn("state", since % 2).drop("_last", "_flips")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, index, record: the records of CSV files whose quoted cells may hold line breaks; a file is split among tasks.

    A line is a function from "a quoted cell is open" to the same behind it. The lines of a split are composed, the splits of
    a file are composed in order, and with the state each split is entered in, its lines are told into first and further
    lines of a record. Only records of several lines, and the last one of a split, are put together over a shuffle.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r\z", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    outside, inside = (F.col("line").rlike(p).cast("int") for p in (_FROM_OUTSIDE, _FROM_INSIDE))
    sets, odd = F.when(outside == inside, outside), (outside > inside).cast("int")
    moves = _entered(lines.select("file", "block", "at", sets.alias("sets"), odd.alias("odd")), ["file", "block"], ["at"], F.lit(0))
    splits = moves.groupBy("file", "block").agg(F.max_by(F.struct("sets", "flips"), F.when(F.col("sets").isNotNull(), F.col("at"))).alias("last"), F.sum("odd").alias("flips"))
    splits = splits.select("file", "block", ((F.col("last.sets") + F.col("flips") - F.col("last.flips")) % 2).alias("sets"), (F.col("flips") % 2).alias("odd"))
    splits = _entered(splits, ["file"], ["block"], F.lit(0)).select("file", "block", F.col("state").alias("entry"))

    told = _entered(lines.withColumns({"sets": sets, "odd": odd}).join(stage(splits, "csv-splits"), ["file", "block"]), ["file", "block"], ["at"], F.col("entry"))
    told = told.where((F.col("state") == 1) | F.col("line").rlike(r"[^\x00-\x20\x{FEFF}]")).withColumn("first", 1 - F.col("state"))
    w = Window.partitionBy("file", "block").orderBy("at")
    told = told.withColumns({"rank": F.sum("first").over(w), "alone": (F.col("first") == 1) & F.coalesce(F.lead("first").over(w) == 1, F.lit(False))})
    told = stage(told.select("file", "block", "at", "line", "rank", "alone"), "csv-lines")

    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = told.groupBy("file", "block").agg(F.max("rank").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    placed = told.join(before, ["file", "block"]).withColumn("index", F.col("before") + F.col("rank") - 1)
    several = placed.where(~F.col("alone")).groupBy("file", "index").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line")))["line"].alias("lines"))
    joined = several.select("file", "index", F.array_join("lines", "\n").alias("record"))
    return placed.where("alone").select("file", "index", F.col("line").alias("record")).unionByName(joined)


def _csv_split(spark: SparkSession, path: str) -> DataFrame:
    records = stage(csv_records(spark, path), "csv-records")
    heads = {}
    for row in records.where("index = 0").select("record").distinct().toLocalIterator():
        cells = next(csv.reader([row["record"].lstrip("\ufeff")], skipinitialspace=True))
        names = tuple(c.strip().lower() or f"_c{i}" for i, c in enumerate(cells))
        heads.setdefault(names, row["record"])
        if len(heads) > 1:
            raise ValueError(f"files of one submission have different headers: {list(heads.values())}")
    names = [n if list(head).count(n) == 1 else f"{n}{i}" for head in heads for i, n in enumerate(head)]
    cells = [f"_cell{i}" for i in range(len(names))] or ["_cell0"]
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = records.groupBy("file").agg(F.max("index").alias("n")).select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before"))
    parsed = F.from_csv("record", ", ".join(f"{c} string" for c in cells), _CSV)
    rows = records.where("index > 0").join(files, "file").select(parsed.alias("r"), "file", (F.col("index") + 1 + F.col("_before")).alias("record_no"), (F.col("index") + 1).alias("line_no"))
    return rows.select(*(F.col(f"r.{c}").alias(n) for c, n in zip(cells, names)), "file", "record_no", "line_no")


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """CSV submission: header names lower-cased and trimmed, cells trimmed, ragged rows kept.

    Files are split among tasks, also where quoted cells hold line breaks; ``line_breaks=False`` saves the pass that looks for these.
    Lines end with LF or CR LF. Files of one submission must share their header; a different one is an error, not a shift. A quote
    that is never closed makes the rest of its file one record.
    """
    if line_breaks:
        return _csv_split(spark, path)
    rows = spark.read.options(**_CSV).option("header", True).option("enforceSchema", False).csv(path)
    names = {c: c.strip().lower() for c in rows.columns}
    return numbered(rows.withColumnsRenamed(names), first=2)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


_FIELDS = REQUIRED_FIELDS + OPTIONAL_FIELDS + UNLISTED_FIELDS


_RECORD = ", ".join(f"`{s}` string" for s in dict.fromkeys(s for f in _FIELDS for s in (f, _camel(f))))
_NOT_A_LIST = 'JSON payload must be an array of records, or an object with a "records" or "products" array.'


_LISTS = ("features", "variants", "sizes", "colors", "image_urls", "complaints", "positives", "opportunities")


def _list_cell(c: Column) -> Column:
    """A JSON array as a pipe list; entries that are objects with a theme become ``theme:count``. Other cells stay."""
    entries = F.from_json(c, "array<string>")

    def item(x: Column) -> Column:
        r = F.from_json(x, "theme string, mentionCount string, mention_count string")
        return F.when(x.startswith("{"), F.concat_ws(":", r["theme"], F.coalesce(r["mention_count"], r["mentionCount"]))).otherwise(x)

    joined = F.array_join(F.transform(entries, item), "|")
    return F.when(c.startswith("[") & entries.isNotNull(), F.when(joined != "", joined)).otherwise(c)


def research_entries(files: DataFrame) -> DataFrame:
    """One row per entry of JSON submissions (``value``: a file's text), each field a string."""
    body = F.col("value")
    enveloped = F.from_json(body, "records array<string>, products array<string>")
    bare = F.from_json(body, "array<string>")
    entries = F.when(F.ltrim(body).startswith("["), bare).otherwise(F.coalesce(enveloped["records"], enveloped["products"]))
    checked = F.coalesce(entries, F.raise_error(F.lit(_NOT_A_LIST)))
    listed = files.select(F.posexplode(checked).alias("_pos", "entry"), "_metadata").withColumn("r", F.from_json("entry", _RECORD))
    spelled = lambda f: F.coalesce(F.col(f"r.{f}"), F.col(f"r.{_camel(f)}")) if _camel(f) != f else F.col(f"r.{f}")
    cell = lambda f: _list_cell(spelled(f)) if f in _LISTS else spelled(f)
    return listed.select(*[cell(f).alias(f) for f in _FIELDS], "_metadata")


def read_research_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON submission: a bare array, or an object with ``records`` or ``products``; snake or camel case.

    Entries that are no objects become empty records; a payload without a list is an error. Lists may be pipe lists or arrays. A file
    is one submission and is read by one task.
    """
    return numbered(research_entries(spark.read.option("wholetext", True).text(path).select("value", "_metadata")), first=1)
