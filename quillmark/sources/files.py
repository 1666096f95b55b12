"""Scans and sinks: text trees, fragment trees with manifests, strict JSON, CSV, Parquet caches, passports."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterable
from itertools import islice

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTIONS = T.StructType([T.StructField("work_id", T.StringType()), T.StructField("author", T.StringType()), T.StructField("true_label", T.IntegerType(), False), T.StructField("pred_label", T.IntegerType())])


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt to all of them: a file's row groups can't be split, so one file may be one
    task. Tables of many files stay as they are, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows._jdf.inputFiles()) < cores else rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below the one that driver and executors share; a local one only in a session of one JVM."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="quillmark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4()}"


def store(uri: str):
    """File system and path of a folder's name."""
    return (fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)) if re.match("/|file:", uri) else fs.FileSystem.from_uri(uri)


def write_tree(rows: DataFrame, root: str) -> None:
    """rows(path, text) as one UTF-8 file each below `root`, in whatever store the folder is. Writing a file again gives the same."""
    def run(batches):
        own, top = store(root)
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                own.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with own.open_output_stream(f"{top}/{path}", compression=None) as f:
                    f.write(text.encode())
            yield b[["path"]]

    rows.select("path", "text").mapInPandas(run, "path string").agg(F.count(F.lit(1))).collect()


def raw_corpus(spark: SparkSession, root: str) -> DataFrame:
    """author, work_id, text of root/<author>/<work>.txt; fails a row that is empty or no valid UTF-8. Tasks list and read the files."""
    parts = F.split("path", "/")
    files = tree_files(spark, root).where((F.size(parts) == 2) & ~F.col("path").rlike("^[._]")).repartition(tasks(spark), F.xxhash64("path"))
    text = F.decode("content", "UTF-8")
    valid = F.encode(text, "UTF-8") == F.col("content")
    checked = F.when(~valid, F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))).when(F.trim(text) == "", F.raise_error(F.concat(F.lit("empty: "), "path"))).otherwise(text)
    return read_texts(files, root, raw=True).select(parts[0].alias("author"), F.regexp_replace("path", r"\.txt$", "").alias("work_id"), checked.alias("text"))


def listed(own, path: str, deep: bool):
    """Name below `path` of what is there, and if it is a folder; of a local store one entry at a time, so a folder of any length."""
    if isinstance(own, fs.LocalFileSystem):
        for x in os.scandir(path):
            if not x.is_dir() or not deep:
                yield x.name, x.is_dir()
            else:
                yield from ((f"{x.name}/{name}", folder) for name, folder in listed(own, x.path, True))
    else:
        for x in own.get_file_info(fs.FileSelector(path, recursive=deep)):
            yield x.path.removeprefix(f"{path}/"), x.type == fs.FileType.Directory


def tree_files(spark: SparkSession, root: str, suffix: str = ".txt", only: str | None = None) -> DataFrame:
    """path, below `root`, of all its files of that ending, or those of the folder `only`, which must be there. The driver lists only the topmost folder, tasks list what is below: neither
    statuses nor splits of the files are ever on the driver."""
    import pyarrow as pa

    width = tasks(spark)

    def below(deep: bool):
        def run(batches):
            own, top = store(root)
            for b in batches:
                for path, folder in zip(b["path"].to_pylist(), b["folder"].to_pylist(), strict=True):
                    found = ((f"{path}/{name}", below) for name, below in listed(own, f"{top}/{path}", deep)) if folder else iter([(path, False)])
                    while part := list(islice(found, 10_000)):
                        part = [x for x in part if (x[1] and not deep) or (x[0].endswith(suffix) and x[0].rpartition("/")[2][0] not in "._")]
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.bool_())], ["path", "folder"])

        return run

    own, top = store(root)
    if only is None:
        first = list(listed(own, top, False))
    elif own.get_file_info(f"{top}/{only}").type == fs.FileType.Directory:
        first = [(only, True)]
    else:
        raise FileNotFoundError(f"{root}/{only}")
    rows = spark.createDataFrame(first, "path string, folder boolean")
    for deep in (False, True):
        rows = rows.repartition(width, F.xxhash64("path")).mapInArrow(below(deep), "path string, folder boolean")
    return rows.where("not folder").select("path")


def tasks(spark: SparkSession) -> int:
    """Into how many tasks small tables that lead to much work are dealt."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def read_texts(rows: DataFrame, root: str, path: str = "path", raw: bool = False) -> DataFrame:
    """The rows with text (if raw, content: the bytes), the file's that `path` names below `root` (null for none); some MB in memory at
    a time."""
    import pyarrow as pa

    column, kind, as_kind = ("content", "binary", pa.binary()) if raw else ("text", "string", pa.string())
    names, kinds = rows.columns, ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)

    def run(batches):
        own, top = store(root)
        for b in batches:
            start, texts, size = 0, [], 0
            where = b.column(names.index(path)).to_pylist()
            for k, p in enumerate(where):
                if p is not None:
                    with own.open_input_stream(f"{top}/{p}", compression=None) as f:
                        texts.append(f.read() if raw else f.read().decode("utf-8", "replace"))
                    size += len(texts[-1])
                else:
                    texts.append(None)
                if size > 1 << 22 or k + 1 == len(where):
                    yield pa.RecordBatch.from_arrays([*b.slice(start, len(texts)).columns, pa.array(texts, as_kind)], [*names, column])
                    start, texts, size = k + 1, [], 0

    return rows.mapInArrow(run, f"{kinds}, {column} {kind}")


def fragments(spark: SparkSession, root: str, exclude: Iterable[str] = (), unknown: str = "unknown", least_authors: int = 2, least_chunks: int = 10) -> DataFrame:
    """author, label, work_id, ordinal, text of root/<author>/<work>/<chunk>.txt in order of name, without excluded and unknown authors.
    Fails on an empty chunk, too few authors or too few chunks. Counts, labels and order come from the names, so a text is read once."""
    p = F.split("path", "/")
    rows = tree_files(spark, root).where(F.size(p) == 3).select("path", p[0].alias("author"), F.concat_ws("/", p[0], p[1]).alias("work_id"), p[2].alias("name"))
    rows = rows.where(~F.col("author").isin([*exclude, unknown])).persist()
    n = rows.agg(F.count_distinct("author").alias("_a"), F.count(F.lit(1)).alias("_c"))
    ok = (F.col("_a") >= least_authors) & (F.col("_c") >= least_chunks)
    labels = rows.select("author").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("author")) - 1)
    placed = rows.repartition(tasks(spark), "work_id").withColumn("ordinal", F.row_number().over(Window.partitionBy("work_id").orderBy("name")) - 1).join(F.broadcast(labels), "author").crossJoin(F.broadcast(n))
    named = placed.select("author", "label", "work_id", "ordinal", F.when(ok, F.col("path")).otherwise(F.raise_error(F.lit("too few authors or chunks"))).alias("path"))
    text = F.trim("text")
    return read_texts(named, root).select("author", "label", "work_id", "ordinal", F.when(text == "", F.raise_error(F.concat(F.lit("empty chunk: "), "work_id"))).otherwise(text).alias("text"))


def unknown_fragments(spark: SparkSession, root: str, unknown: str = "unknown") -> DataFrame:
    """name, text of all files below root/<unknown>. Tasks list and read them, however many lie in one folder."""
    files = tree_files(spark, root, only=unknown).repartition(tasks(spark), F.xxhash64("path"))
    return read_texts(files, root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.trim("text").alias("text"))


MANIFEST = "work_id string, author string, span_ordinal int, text_sha256 string, path string"


def manifest_fragments(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks in manifest order, each with the stated digest: chunks(path, text), manifest as in MANIFEST. Fails on a missing chunk or a
    digest that differs; chunks that the manifest does not name fail too."""
    return agreeing(manifest.join(chunks, "path", "full_outer"))


def agreeing(j: DataFrame) -> DataFrame:
    """author, work_id, ordinal, text of joined rows of a manifest and its chunks; fails where they differ."""
    ok = F.col("text_sha256").isNotNull() & F.col("text").isNotNull() & (F.sha2("text", 256) == F.col("text_sha256"))
    return j.select("author", "work_id", F.col("span_ordinal").alias("ordinal"), F.when(ok, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("chunk and manifest differ: "), F.col("path")))).alias("text"))


def load(spark: SparkSession, root: str, weighting: str, **options) -> DataFrame:
    """The loader that a weighting needs."""
    if weighting == "work_balanced":
        manifest = spark.read.schema(MANIFEST).json(f"{root}/manifest.json")
        # names meet, then each file is read once: no text is shuffled
        files = tree_files(spark, root).select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("path"), F.col("path").alias("_file"))
        met = manifest.join(files, "path", "full_outer").repartition(tasks(spark), F.xxhash64("path"))
        return agreeing(read_texts(met, root, "_file").withColumn("text", F.trim("text")))
    return fragments(spark, root, **options)


def predictions_csv(spark: SparkSession, path: str, schema: T.StructType = PREDICTIONS) -> DataFrame:
    """CSV with a header and a fixed schema; malformed rows fail."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def strict_json(text: str) -> object:
    """JSON without duplicate keys, NaN or infinities."""

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("duplicate key")
        return out

    def constant(name: str) -> None:
        raise ValueError(f"not JSON: {name}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One document a line, of the schema or an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def top_authors(rows: DataFrame, authors: int, per_author: int, author: str = "author", order: str = "work_id") -> DataFrame:
    """The authors with most rows (a tie by name), and a fixed number of rows of each that has them."""
    n = rows.groupBy(author).count().where(F.col("count") >= per_author).orderBy(F.desc("count"), author).limit(authors)
    nth = F.row_number().over(Window.partitionBy(author).orderBy(order))
    return rows.join(n.select(author), author, "left_semi").withColumn("_n", nth).where(F.col("_n") <= per_author).drop("_n")


def cached(rows: DataFrame, cache: DataFrame | None, build, key: str = "text_sha256") -> tuple[DataFrame, DataFrame]:
    """rows with the cache's columns, and what the cache lacks (to append): known keys are looked up, others built. A cache row never
    changes, so building again must give the same."""
    if cache is None:
        new = build(rows.dropDuplicates([key]))
        return rows.select(*(c for c in rows.columns)).join(new.drop(*(c for c in rows.columns if c != key)), key), new
    missing = build(rows.join(cache.select(key), key, "left_anti").dropDuplicates([key]))
    full = cache.unionByName(missing.select(*cache.columns))
    return rows.join(full.drop(*(c for c in rows.columns if c != key)), key), missing.select(*cache.columns)


def write_snapshot(rows: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Writes a generation that must not exist yet, and returns its manifest: work_id, output_sha256."""
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path).select("work_id", F.sha2(text, 256).alias("output_sha256"))


def bijection(left: DataFrame, right: DataFrame, key: str = "work_id") -> DataFrame:
    """key, side of works that only one side has; empty if they are the same works."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return a.unionByName(right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def csv_sink(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_column(rows: DataFrame) -> DataFrame:
    """Each row as JSON text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def markdown(rows: DataFrame, title: str, body: dict[str, str]) -> DataFrame:
    """Each row as a small Markdown page: a title column and named columns."""
    lines = [F.concat(F.lit("# "), F.col(title).cast("string"))] + [F.concat(F.lit(f"- **{name}**: "), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c, name in body.items()]
    return rows.select(F.col(title), F.concat_ws("\n", *lines).alias("page"))


def publish_model(tables: dict[str, DataFrame], root: str) -> str:
    """Writes model tables and returns a token: the digest of their order-free contents."""
    parts = []
    for name in sorted(tables):
        tables[name].write.mode("errorifexists").parquet(f"{root}/{name}")
        own = tables[name].sparkSession.read.parquet(f"{root}/{name}")
        n, x = own.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*sorted(own.columns)))).first()
        parts.append([name, n, x])
    return canonical_hash(parts)


def load_model(spark: SparkSession, root: str, names: Iterable[str], token: str) -> dict[str, DataFrame]:
    """The tables, if their contents still make the token."""
    tables, parts = {n: spark.read.parquet(f"{root}/{n}") for n in sorted(names)}, []
    for name, own in tables.items():
        n, x = own.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*sorted(own.columns)))).first()
        parts.append([name, n, x])
    if canonical_hash(parts) != token:
        raise ValueError("model tables differ from their token")
    return tables


def demo_corpus(spark: SparkSession, works: int = 3, words: int = 1400, seed: int = 42) -> DataFrame:
    """author, work_id, text: two invented authors, one of long periodic sentences, one of fragments; every row drawn by its own hash."""
    periodic = ["when the", "long evening", "which had", "slowly gathered", "over the valley", "finally", "came to rest", "and because", "nobody spoke", "the lamps", "were lit"]
    fragment = ["Rain.", "No one.", "A door, shut.", "Steps.", "Then silence.", "He ran.", "Why?", "Cold hands.", "Not yet."]
    base = spark.range(2 * works).select((F.col("id") % 2).alias("a"), F.floor(F.col("id") / 2).alias("w"))

    def drawn(bank: list[str], n: int):
        pick = lambda i: F.element_at(F.array(*map(F.lit, bank)), (F.pmod(F.xxhash64("a", "w", i, F.lit(seed)), F.lit(len(bank))) + 1).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when((i % 9 == 0) & (F.col("a") == 0), F.concat(pick(i), F.lit("."))).otherwise(pick(i))), " ")

    text = F.when(F.col("a") == 0, drawn(periodic, words // 2)).otherwise(drawn(fragment, words // 2))
    author = F.when(F.col("a") == 0, "periodic").otherwise("fragmented")
    return base.select(author.alias("author"), F.concat_ws("/", author, F.concat(F.lit("work"), F.col("w"))).alias("work_id"), text.alias("text"))


def plain_html(rows: DataFrame, html: str = "html", unit: str = "page_id") -> DataFrame:
    """unit, text of the body's visible text, block elements apart by line feeds; scripts, styles and navigation left out. Arrow batches
    through the standard library's parser."""
    kind = dict(rows.dtypes)[unit]

    def run(batches):
        from html.parser import HTMLParser

        import pandas as pd

        class Body(HTMLParser):
            hidden = frozenset({"script", "style", "nav", "head", "noscript", "template"})
            block = frozenset({"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre", "table", "ul", "ol"})

            def __init__(self) -> None:
                super().__init__(convert_charrefs=True)
                self.out, self.depth = [], 0

            def handle_starttag(self, tag, attrs):
                self.depth += tag in self.hidden
                if tag in self.block:
                    self.out.append("\n")

            def handle_endtag(self, tag):
                if tag in self.hidden and self.depth:
                    self.depth -= 1
                if tag in self.block:
                    self.out.append("\n")

            def handle_data(self, data):
                if not self.depth:
                    self.out.append(data)

        def plain(page):
            b = Body()
            b.feed(page or "")
            b.close()
            return "\n".join(x for x in (" ".join(y.split()) for y in "".join(b.out).split("\n")) if x)

        for b in batches:
            yield pd.DataFrame({unit: b[unit], "text": [plain(h) for h in b[html]]})

    return rows.select(unit, html).mapInPandas(run, f"{unit} {kind}, text string")


def assemble(parts: DataFrame, unit: str = "work_id") -> DataFrame:
    """unit, text of parts (unit, ordinal, text) in order, by line feeds."""
    return parts.groupBy(unit).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n").alias("text"))
