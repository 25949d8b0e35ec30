"""Scans and sinks: column choice by pattern, file inventories, property files, entry ranges and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.numeric import precision
from corvane.operators.order import numbered, tiles


def chosen_columns(columns: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """Columns that an include pattern names (all if there is none) and no exclude pattern does. A pattern that begins
    with ^ is a regular expression for a name's start, any other is a name."""

    def fits(name: str, patterns: list[str]) -> bool:
        return any(re.match(p, name) if p.startswith("^") else p == name for p in patterns)

    return [c for c in columns if (not include or fits(c, include)) and not fits(c, exclude or [])]


def scan(spark: SparkSession, paths: list[str], columns: list[str] | None = None, where: str | None = None, aliases: dict[str, str] | None = None, kind: str = "parquet") -> DataFrame:
    """Files of one schema as one table, with computed columns, a filter and a choice of columns, all of which Spark
    pushes into the scan where it can."""
    df = spark.read.format(kind).load(paths)
    for name, expression in (aliases or {}).items():
        df = df.withColumn(name, F.expr(expression))
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def inventory(df: DataFrame) -> DataFrame:
    """Rows of each input file."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))


def file_list(lines: DataFrame, column: str = "value", prefix: str = "") -> DataFrame:
    """(path, entries) of text lines 'path entries'; empty lines and # comments are left out."""
    text = F.trim(F.regexp_replace(F.col(column), "#.*$", ""))
    parts = F.split(text, r"\s+")
    return lines.where(text != "").select(F.concat(F.lit(prefix), F.get(parts, F.lit(0))).alias("path"), F.get(parts, F.lit(1)).try_cast("long").alias("entries"))


def matching(paths: DataFrame, directory: str, file: str, column: str = "path") -> DataFrame:
    """Paths whose folder and file name match patterns in full."""
    folder, name = F.regexp_extract(F.col(column), "^(.*?)/?[^/]*$", 1), F.regexp_extract(F.col(column), "([^/]*)$", 1)
    return paths.where(folder.rlike(f"^(?:{directory})$") & name.rlike(f"^(?:{file})$"))


def entry_range(df: DataFrame, order: list[str], start: int, end: int = -1) -> DataFrame:
    """Rows start to end (not included; -1: all) in a stable order."""
    placed = numbered(df, [F.col(c) for c in order], "__n")
    return placed.where((F.col("__n") >= start) & (F.col("__n") < end if end >= 0 else F.lit(True))).drop("__n")


def job_split(df: DataFrame, order: list[str], jobs: int) -> DataFrame:
    """Job number of each row: equal runs of rows in order, with none left over."""
    return tiles(df, [F.col(c) for c in order], jobs, "job")


def properties(text: str) -> dict[str, dict[str, str]]:
    """Items of a property file: 'name: key=value key=\"v w\"' lines with # comments and \\ continuations. A name or key
    that comes twice is an error."""
    found: dict[str, dict[str, str]] = {}
    for line in re.sub(r"\\\s*\n", " ", text).splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        name, sep, rest = line.partition(":")
        if not sep or name.strip() in found:
            raise ValueError(f"bad or repeated item: {line!r}")
        own: dict[str, str] = {}
        for key, quoted, plain in re.findall(r'(\w+)\s*=\s*(?:"([^"]*)"|(\S+))', rest):
            if key in own:
                raise ValueError(f"repeated key {key!r} of {name.strip()!r}")
            own[key] = quoted or plain
        found[name.strip()] = own
    return found


def snapshot(df: DataFrame, path: str, columns: list[str] | None = None, by: list[str] | None = None, compression: str = "zstd", rows_per_file: int = 0, kind: str = "parquet") -> None:
    """Write chosen columns, in folders by some of them if asked, replacing what is there."""
    out = (df.select(*columns) if columns else df).write.mode("overwrite").format(kind).option("compression", compression)
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    (out.partitionBy(*by) if by else out).save(path)


def exactly_one(wanted: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """wanted with the one row of table that has its key; none, or several, is an error when the rows are read."""
    counts = table.groupBy(*key).agg(F.count("*").alias("__c"))
    checked = wanted.join(counts, key, "left").withColumn("__c", F.coalesce("__c", F.lit(0)))
    wrong = F.concat(F.lit("rows of "), F.concat_ws(", ", *key), F.lit(": "), F.col("__c").cast("string"))
    good = F.when(F.col("__c") == 1, F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))
    return checked.where(good).drop("__c").join(table, key)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def group_scan(rows: DataFrame, files: DataFrame, file: str, order: list[Column], first: tuple[int, int], last: tuple[int, int], group_id: int, kind: Column, kinds: list) -> DataFrame:
    """Rows of the files of a group (file, position, dataset_id) from one (position, entry) up to another, both included,
    tagged with dataset_id, dataset_group_id and kind; rows of other kinds are skipped. Entries count from 0 within each
    file, in order."""
    placed = numbered(rows, order, "entry", [file]).join(F.broadcast(files), file)
    at = F.struct(F.col("position").cast("long").alias("p"), F.col("entry").cast("long").alias("e"))
    point = lambda pair: F.struct(F.lit(pair[0]).cast("long").alias("p"), F.lit(pair[1]).cast("long").alias("e"))
    inside = placed.where((at >= point(first)) & (at <= point(last))).withColumns({"kind": kind, "dataset_group_id": F.lit(group_id)})
    return inside.where(F.col("kind").isin(kinds))


def flat_tables(df: DataFrame, key: list[str], bits: dict[str, int | None]) -> dict[str, DataFrame]:
    """A table for each array of structs that bits names: one row for each object, with the key and its place, fractions
    rounded to that many bits of precision (None: as they are)."""
    found = {}
    for name, precise in bits.items():
        flat = df.select(*key, F.posexplode(name).alias("place", "o")).select(*key, "place", "o.*")
        found[name] = flat.select(*key, "place", *[precision(F.col(c), precise).alias(c) if precise is not None and t in ("float", "double") else F.col(c) for c, t in flat.dtypes if c not in (*key, "place")])
    return found


def size_batches(files: list[tuple[str, int]], target: int) -> list[list[str]]:
    """Paths in runs whose sizes just reach a target, the last perhaps less. The list is a folder's metadata."""
    runs, total = [[]], 0
    for path, size in files:
        if total >= target:
            runs.append([])
            total = 0
        runs[-1].append(path)
        total += size
    return [r for r in runs if r]


def merged_files(spark: SparkSession, files: list[tuple[str, int]], target: int, path: str, kind: str = "parquet") -> int:
    """Write the files' rows in batches whose sizes just reach a target, each batch as one file in a folder of its own, named by its
    number; the number of batches. One job reads all files, deals their rows by batch, and writes."""
    batches = size_batches(files, target)
    local = lambda p: F.regexp_replace(p, "^file:/+", "/")
    places = spark.createDataFrame([(p, k) for k, own in enumerate(batches) for p in own], "path string, batch int").withColumn("path", local(F.col("path")))
    rows = spark.read.format(kind).load([p for own in batches for p in own])
    own = rows.withColumn("__path", local(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))))
    dealt = own.join(F.broadcast(places), F.col("__path") == F.col("path")).drop("__path", "path").repartition(len(batches), "batch")
    dealt.write.mode("overwrite").format(kind).partitionBy("batch").save(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(len(batches)):
        system.rename(spark._jvm.org.apache.hadoop.fs.Path(folder, f"batch={k}"), spark._jvm.org.apache.hadoop.fs.Path(folder, str(k)))
    return len(batches)


def settings(text: str) -> dict:
    """A YAML configuration, with its anchors and merged keys."""
    import yaml

    return yaml.safe_load(text)


def float_list(values: Column) -> Column:
    """JSON text of an array of numbers with four decimals of their mantissas."""
    return F.concat(F.lit("[ "), F.array_join(F.transform(values, lambda x: F.format_string("%.4e", x)), ", "), F.lit(" ]"))


def discovered(spark: SparkSession, root: str, pattern: str = ".*", exclude: str | None = None, exclude_folders: str | None = None) -> DataFrame:
    """(path, size) of the files anywhere under a folder whose whole path fits a pattern, without those whose name or one
    of whose folders fits another. The listing is the file system's own."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = base.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(base, True)
    rows = []
    while listing.hasNext():
        f = listing.next()
        path = f.getPath().toString()
        folders = ["/".join(path.split("/")[:k]) for k in range(1, path.count("/") + 1)]
        if re.fullmatch(pattern, path) and not (exclude and re.fullmatch(exclude, path.rsplit("/", 1)[-1])) and not (exclude_folders and any(re.fullmatch(exclude_folders, x) for x in folders)):
            rows.append((path, f.getLen()))
    return spark.createDataFrame(sorted(rows), "path string, size bigint")


def sizes(files: DataFrame, before: DataFrame) -> DataFrame:
    """files (path, size) with the size that an earlier inventory has for a path, and whether it had one."""
    old = before.select("path", F.col("size").alias("__s"))
    return files.join(old, "path", "left").select("path", F.coalesce("__s", "size").alias("size"), F.col("__s").isNotNull().alias("known"))


def first_entries(df: DataFrame, by: list[Column], n: int, second: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first n rows in order, and the rows of a second table that belong to them."""
    own = df.orderBy(*by).limit(n)
    return own, second.join(own.select(*key).distinct(), key, "left_semi")


def report(df: DataFrame, digits: int = 4) -> DataFrame:
    """A line of comma-separated values for each row, fractions with so many digits."""
    shown = [F.format_string(f"%.{digits - 1}e", F.col(c)) if t in ("float", "double") else F.col(c).cast("string") for c, t in df.dtypes]
    return df.select(F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in shown]).alias("line"))


def try_scan(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The table at a path, or None where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.format(kind).load(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None
