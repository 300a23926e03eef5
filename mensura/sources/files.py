"""Readers and sinks: CSV dialects, JSON lines, binary files, manifests, HTML links and packages."""

from __future__ import annotations

import html
import json
import os
import shutil
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.functions.scalar import basename, c, parent, slashes, suffix
from mensura.staging import numbered

IMAGE_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, infer: bool = False) -> DataFrame:
    """CSV with header; BOM, CRLF and doubled quotes are accepted. Without a schema all columns are
    text or, with infer, what all their values fit (a pass of its own over the files); with a schema,
    values that don't fit fail."""
    r = spark.read.option("header", True).option("escape", '"').option("quote", '"').option("multiLine", True).option("mode", "FAILFAST")
    return r.schema(schema).option("enforceSchema", False).csv(path) if schema else r.option("inferSchema", infer).csv(path)


def evolve(frames: list[DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Union by name of runs whose columns grew, with defaults for what older runs lack."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumns({k: F.coalesce(c(k) if k in out.columns else F.lit(None), F.lit(v)) for k, v in defaults.items()})


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False) -> None:
    """The named columns only; text for arrays. An empty frame still writes its header."""
    flat = df.select(*[F.concat_ws(";", x) if isinstance(df.schema[x].dataType, T.ArrayType) else F.col(x) for x in columns]).toDF(*columns)
    (flat.coalesce(1) if single else flat).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, NaN as null."""
    fixed = df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})
    fixed.write.mode("errorifexists").json(path)


def read_jsonl(spark: SparkSession, path, schema) -> DataFrame:
    """JSON lines; blank lines hold nothing."""
    text = spark.read.text(path).filter(F.trim("value") != "")
    return text.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_document(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r")).select("r.*")


def json_document(df: DataFrame) -> DataFrame:
    """One row of text from a one-row summary."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_by_split(df: DataFrame, path: str, split: str = "split", kind: str = "parquet", single: bool = False) -> None:
    """A folder for each split, as Parquet or as CSV with header; with single each holds one file."""
    out = df.repartition(split) if single else df
    out.write.mode("errorifexists").partitionBy(split).option("header", True).option("escape", '"').format(kind).save(path)


def scan_images(spark: SparkSession, root, prefix: str = "img") -> DataFrame:
    """Files with an image suffix in all folders, ordered by folder and name in lower case, with an
    id by position, length and SHA-256. The order is over paths only; contents are hashed apart."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.filter(suffix("path").isin(*IMAGE_SUFFIXES))
    keys = files.select("path", F.lower(parent("path")).alias("_p"), F.lower(basename("path")).alias("_b"))
    ids = numbered(keys, ["_p", "_b", "path"], "_n").select("path", F.format_string(f"{prefix}_%04d", "_n").alias("id"))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content").join(ids, "path")


def manifest(spark: SparkSession, root) -> DataFrame:
    """relative path, size, sha256 of all files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace(slashes("path"), "^file:/*", "/"), f"^{base}/", "")
    return files.select(relative.alias("relative_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lock_lines(df: DataFrame) -> DataFrame:
    """``sha256  path`` lines in path order."""
    return df.orderBy("relative_path").select(F.concat_ws("  ", "sha256", "relative_path").alias("value"))


def read_lock(spark: SparkSession, path) -> DataFrame:
    got = F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s\s?(.+?)\r?$", 1), F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s\s?(.+?)\r?$", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(F.lower(got[0]).alias("sha256"), slashes(got[1]).alias("relative_path"))


def lock_differences(locked: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are missing, new or changed."""
    both = locked.select("relative_path", F.col("sha256").alias("was")).join(found.select("relative_path", F.col("sha256").alias("now")), "relative_path", "full")
    what = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") != F.col("now"), "changed")
    return both.withColumn("what", what).filter("what IS NOT NULL").select("relative_path", "what")


def split_hashes(df: DataFrame, split: str, id_: str, sha: str) -> DataFrame:
    """Hashes of each split in id order."""
    pairs = F.sort_array(F.collect_list(F.struct(id_, sha)))
    return df.groupBy(split).agg(F.transform(pairs, lambda x: x[sha]).alias("hashes"))


def html_links(pages: DataFrame, id_: str, html: str, attribute: str = "src", tag: str = "") -> DataFrame:
    """(id, link) of each quoted attribute, of one tag only if given."""
    pattern = (rf"<{tag}\b[^>]*?\b" if tag else "") + rf'{attribute}="([^"]*)"'
    return pages.select(id_, F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("link"))


def missing_files(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links that no file answers."""
    return links.withColumn("link", slashes("link")).join(files.select(F.col("relative_path").alias("link")), "link", "left_anti")


def quarantine(df: DataFrame, column: str, parsed) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, rows that don't with their text): the side table of read errors."""
    both = df.withColumn("_parsed", parsed)
    bad = both.filter(F.col("_parsed").isNull() & F.col(column).isNotNull()).drop("_parsed").withColumn("error", F.concat(F.lit("cannot parse "), F.col(column)))
    return both.filter(F.col("_parsed").isNotNull() | F.col(column).isNull()).withColumn(column, F.col("_parsed")).drop("_parsed"), bad


def blank_template(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """The keys with all other fields empty, for a reviewer."""
    return df.select(*key, *[F.lit("").alias(f) for f in fields if f not in key])


def package(folders: list[str], target: str) -> list[str]:
    """A zip of whole local folders, names in order (driver side, for review packages)."""
    names = sorted((os.path.join(d, f), os.path.relpath(os.path.join(d, f), os.path.dirname(os.path.abspath(root)))) for root in folders for d, _, files in os.walk(os.path.abspath(root)) for f in files)
    with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as z:
        for path, name in names:
            z.write(path, slashes_text(name))
    return [slashes_text(n) for _, n in names]


def copy_tree(source: str, target: str) -> None:
    shutil.copytree(source, target)


def slashes_text(path: str) -> str:
    return path.replace("\\", "/")


def load_config(path: str) -> dict:
    """A JSON configuration; relative paths in *_path and *_dir keys stand against its folder."""
    with open(path, encoding="utf-8-sig") as f:
        found = json.load(f)
    base = os.path.dirname(os.path.abspath(path))
    return {k: os.path.normpath(os.path.join(base, slashes_text(v))) if isinstance(v, str) and k.endswith(("_path", "_dir")) else v for k, v in found.items()}


# The page keeps decisions in the browser under its title and gives them back as CSV.
_SCRIPT = """
const store = 'review:' + document.title, fields = [...document.querySelectorAll('[data-id]')];
const known = JSON.parse(localStorage.getItem(store) || '{}');
for (const f of fields) {
  const key = f.dataset.id + '/' + f.name;
  if (key in known) f.value = known[key];
  f.addEventListener('change', () => { known[key] = f.value; localStorage.setItem(store, JSON.stringify(known)); });
}
function exported() {
  const cell = x => '"' + String(x).replaceAll('"', '""') + '"', rows = new Map();
  for (const f of fields) rows.set(f.dataset.id, {...rows.get(f.dataset.id), [f.name]: f.value});
  const lines = ['id,decision,note', ...[...rows].map(([id, r]) => [id, r.decision, r.note].map(cell).join(','))];
  const link = document.createElement('a');
  link.href = URL.createObjectURL(new Blob(['\\ufeff' + lines.join('\\r\\n')], {type: 'text/csv'}));
  link.download = document.title + '.csv';
  link.click();
}
"""


def review_page(df: DataFrame, id_: str, fields: list[str], title: str, choices: tuple[str, ...] = ("", "accept", "reject", "unsure")) -> DataFrame:
    """One row of HTML with a card for each row, escaped, each with a decision and a note, which the
    browser stores and exports as CSV; for work lists of a bounded size."""
    escape = lambda x: F.replace(F.replace(F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    rows = [F.concat(F.lit(f"<dt>{html.escape(f)}</dt><dd>"), escape(c(f)), F.lit("</dd>")) for f in fields]
    options = "".join(f"<option>{html.escape(o)}</option>" for o in choices)
    form = F.concat(F.lit('<select name="decision" data-id="'), escape(c(id_)), F.lit(f'">{options}</select><input name="note" data-id="'), escape(c(id_)), F.lit('">'))
    card = F.concat(F.lit('<section id="'), escape(c(id_)), F.lit('"><dl>'), *rows, F.lit("</dl>"), form, F.lit("</section>"))
    cards = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(id_, card.alias("card")))), lambda x: x["card"]), "\n")
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><button onclick='exported()'>CSV</button>\n"
    return df.agg(F.concat(F.lit(head), cards, F.lit(f"\n<script>{_SCRIPT}</script></body></html>")).alias("value"))


def contact_sheets(df: DataFrame, order: list[str], columns: int, rows: int) -> DataFrame:
    """The place of each image on numbered sheets: adds sheet, row and column (from 0) in the order,
    which must tell rows apart."""
    each = columns * rows
    at = numbered(df, order, "_n").withColumn("_n", F.col("_n") - 1)
    inside = F.col("_n") % each
    return at.withColumns({"sheet": F.floor(F.col("_n") / each), "row": F.floor(inside / columns), "column": inside % columns}).drop("_n")
