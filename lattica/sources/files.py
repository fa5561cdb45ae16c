"""Files as tables: crawling, hashing, text, images, JSON lines, and the extraction cache."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import chunking

# Fixed values.
SUPPORTED = ["txt", "md", "pdf", "jpg", "jpeg", "png", "webp"]
TEXT, IMAGES = ["txt", "md"], ["jpg", "jpeg", "png", "webp"]
EXCLUDED = ["node_modules", "__pycache__", "venv", ".venv", ".cache", ".git"]
IMAGE_CAPTION = "(이미지 첨부됨 — 본 텍스트 블록 다음 user content 에 image_url 로 포함)"
IMAGE_PAGE, IMAGE_PAGE_CAPTION = "(이미지 페이지)", "(이 페이지의 이미지 %d 장이 본 텍스트 블록 다음 user content 에 image_url 로 포함됨)"
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp"}


def ignore_regex(pattern: str) -> str:
    """A regular expression over relative paths for one line of an ignore file, without its mark of negation."""
    p = pattern.strip().lstrip("!").rstrip("/")
    anchored = "/" in p.lstrip("/") or p.startswith("/")
    parts = re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|\\.|[^*?\[\\]", p.lstrip("/"))
    glob = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    body = "".join(glob.get(x) or (x.replace("[!", "[^") if len(x) > 2 and x[0] == "[" else x if x[0] == "\\" else re.escape(x)) for x in parts)
    return ("^" if anchored else "(^|/)") + body + "(/|$)"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the lines of an ignore file leave a path out: the last line that matches decides, one with ! takes it in."""
    out = F.lit(False)
    for line in patterns:
        if line.strip() and not line.startswith("#"):
            out = F.when(path.rlike(ignore_regex(line)), F.lit(not line.strip().startswith("!"))).otherwise(out)
    return out


def crawl(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """path (relative), ext, content, length, kind (supported or unsupported) of the files below root.

    Hidden and excluded folders and ignored paths are left out; contents are read only if they are asked for. Spark
    lists the whole tree, as its sources do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    path = F.substring_index(F.col("path"), base + "/", -1)
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    rows = files.select(path.alias("path"), ext.alias("ext"), "content", "length")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = rows.filter(~F.exists(folders, lambda d: d.isin(EXCLUDED) | d.startswith("."))).filter(~ignored(F.col("path"), list(ignore)))
    return rows.withColumn("kind", F.when(F.col("ext").isin(SUPPORTED), "supported").otherwise("unsupported"))


def crawl_summary(files: DataFrame) -> DataFrame:
    """One row: collected, pending (none is, at present) and unsupported files of a crawl."""
    return files.agg(F.count_if(F.col("kind") == "supported").alias("collected"), F.lit(0).cast("bigint").alias("pending"), F.count_if(F.col("kind") == "unsupported").alias("unsupported"))


def file_hash(content="content"):
    return F.sha2(F.col(content), 256)


def corpus_hash(files: DataFrame) -> str:
    """One hash of all files by path: of each path, a zero byte, its bytes and a byte 255, one after another.

    A hash of a sequence has to read it in order: files pass through the driver one at a time.
    """
    h = hashlib.sha256()
    for r in files.select("path", "content").orderBy("path").toLocalIterator():
        h.update(r["path"].encode() + b"\x00" + bytes(r["content"]) + b"\xff")
    return h.hexdigest()


def texts(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(TEXT)).select("path", F.decode("content", "UTF-8").alias("text"))


def images(files: DataFrame) -> DataFrame:
    """path, mime, base64 of images; empty files are left out."""
    mime = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return files.filter(F.col("ext").isin(IMAGES) & (F.col("length") > 0)).select("path", mime[F.col("ext")].alias("mime"), F.base64("content").alias("base64"))


def mime_by_magic(content="content"):
    """MIME type by the first bytes."""
    return _magic(F.col(content))


def _magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.rlike("^52494646.{8}57454250"), "image/webp").when(head.startswith("255044462D"), "application/pdf")


def _pypdf(content: bytes) -> Iterator[tuple[str, list[bytes]]]:
    """(text, images) of each page by pypdf; of a page that can't be read both are empty."""
    from pypdf import PdfReader

    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            yield page.extract_text() or "", [i.data for i in page.images]
        except Exception:  # noqa: BLE001
            yield "", []


PAGE = "path string, page int, text string, images array<binary>, error string"


def pdf_pages(files: DataFrame, reader: Callable[[bytes], Iterator[tuple[str, list[bytes]]]] = _pypdf) -> DataFrame:
    """path, page, text, images, error of the pages of PDF files, by pypdf or a reader of one's own.

    A file that can't be read is one row with its error and no page; the others are read all the same.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    rows += [(path, k, text, images, None) for k, (text, images) in enumerate(reader(bytes(content)))]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["path", "page", "text", "images", "error"]).astype({"page": "Int32"})

    return files.filter("ext = 'pdf'").select("path", "content").mapInPandas(run, PAGE)


def page_images(images: str = "images") -> Column:
    """Images of a page as (mime, base64); those whose first bytes tell no type are left out."""
    each = F.transform(F.coalesce(F.col(images), F.array().cast("array<binary>")), lambda b: F.struct(_magic(b).alias("mime"), F.base64(b).alias("base64")))
    return F.filter(each, lambda i: i["mime"].isNotNull())


def pdf_units(pages: DataFrame, how: Callable[..., list[str]] = chunking.chunk_text, **options) -> DataFrame:
    """path, chunk_index, page, text, images: what an extractor is given of each file, one row a call.

    A page with text is cut into chunks, and its images go with the first of them; one with images only is a unit with
    a null text; a blank one is left out. chunk_index runs through the file. pages: path, page, text, images (mime,
    base64).
    """
    rows = pages.filter("page is not null").withColumn("said", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+$", ""))
    key = F.concat_ws("\x00", "path", F.col("page").cast("string"))
    pieces = chunking.chunks(rows.filter("said <> ''").select(key.alias("doc_id"), "text"), how, **options)
    cut = pieces.select(F.substring_index("doc_id", "\x00", 1).alias("path"), F.substring_index("doc_id", "\x00", -1).cast("int").alias("page"), F.col("chunk_index").alias("piece"), "text")
    shown = rows.select("path", "page", "images")
    told = cut.join(shown, ["path", "page"]).withColumn("images", F.when(F.col("piece") == 0, F.col("images")).otherwise(F.array().cast(rows.schema["images"].dataType)))
    seen = rows.filter("said = '' and size(images) > 0").select("path", "page", F.lit(0).alias("piece"), F.lit(None).cast("string").alias("text"), "images")
    order = Window.partitionBy("path").orderBy("page", "piece")
    return told.unionByName(seen).withColumn("chunk_index", F.row_number().over(order) - 1).select("path", "chunk_index", "page", "text", "images")


def text_units(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """path, text: what a retrieval baseline chunks: text files whole, the pages with text of a PDF joined by blank lines."""
    out = texts(files)
    if pages is not None:
        told = pages.filter(F.coalesce("text", F.lit("")).rlike(r"(?U)\S"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
        out = out.unionByName(told.groupBy("path").agg(joined.alias("text")))
    return out


def serialized(files: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """path, block of every file of a corpus, to be joined by blank lines in the order of paths; an unknown type is an error.

    A PDF is the pages with text under page marks and a caption for each page of images; an image is a caption.
    """
    known = F.col("ext").isin(SUPPORTED)
    checked = files.withColumn("ext", F.when(known, F.col("ext")).otherwise(F.raise_error(F.concat(F.lit("unknown file type: "), "path"))))
    head = F.concat(F.lit("=== FILE: "), "path", F.lit(" ==="))
    said = checked.filter(F.col("ext").isin(TEXT)).select("path", F.concat(head, F.lit("\n"), F.decode("content", "UTF-8")).alias("block"))
    seen = checked.filter(F.col("ext").isin(IMAGES)).select("path", F.concat(F.lit("=== IMAGE: "), "path", F.lit(f" ===\n{IMAGE_CAPTION}")).alias("block"))
    rest = checked.filter(~F.col("ext").isin(SUPPORTED)).select("path", F.lit("").alias("block"))
    out = said.unionByName(seen).unionByName(rest)
    if pages is not None:
        n = F.size(F.coalesce("images", F.array().cast("array<binary>")))
        trimmed = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
        total = F.count("*").over(Window.partitionBy("path"))
        mark = F.concat(F.lit("--- PAGE "), (F.col("page") + 1).cast("string"), F.lit("/"), total.cast("string"))
        image = F.concat(mark, F.lit(f" {IMAGE_PAGE} ---\n"), F.format_string(IMAGE_PAGE_CAPTION, n))
        shown = pages.filter("page is not null").select("path", "page", F.when(trimmed != "", F.concat(mark, F.lit(" ---\n"), trimmed)).when(n > 0, image).alias("shown"))
        joined = F.array_join(F.concat(F.array(F.concat(F.lit("=== FILE: "), "path", F.lit(" ==="))), F.transform(F.array_sort(F.collect_list(F.struct("page", "shown"))), lambda p: p["shown"])), "\n\n")
        out = out.unionByName(shown.filter("shown is not null").groupBy("path").agg(joined.alias("block")))
    return out


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.from_json("value", schema).alias("r")).select("r.*")


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def cache_key(chunk, context, prompt, model, version):
    return F.sha2(F.concat_ws("\x1f", chunk, context, prompt, model, version).cast("binary"), 256)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of wanted (key, ...) that the extraction cache does not hold."""
    return wanted.join(cache.select("key").distinct(), "key", "left_anti")


def extract_cached(units: DataFrame, path: str, call: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, result of each unit (key, image, ...): from the cache under path, else by call, which gives key and result.

    Results of units without images are added to the cache; those with images are never kept. A unit that occurs twice
    is extracted once. Two runs at once may both add a key; the first result by value is read then.
    """
    spark = units.sparkSession
    schema = "key string, result string"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    plain, shown = units.filter("not image").dropDuplicates(["key"]), units.filter("image").dropDuplicates(["key"])
    cache = spark.read.schema(schema).parquet(path)
    call(cache_misses(plain, cache)).select("key", F.col("result").cast("string").alias("result")).write.mode("append").parquet(path)
    held = spark.read.schema(schema).parquet(path).groupBy("key").agg(F.min("result").alias("result"))
    return held.join(plain.select("key"), "key", "left_semi").unionByName(call(shown).select("key", "result"))


def responses(spark: SparkSession, root: str, strategy: str) -> DataFrame:
    """body of the stored answers of a strategy: the lines of strategy.jsonl, else the files of folder strategy, by path.

    Neither is no answer. Blank lines are skipped.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines, folder = f"{root}/{strategy}.jsonl", f"{root}/{strategy}"
    if fs.exists(jvm.org.apache.hadoop.fs.Path(lines)):
        return spark.read.text(lines).filter("trim(value) <> ''").select(F.col("value").alias("body"))
    if fs.exists(jvm.org.apache.hadoop.fs.Path(folder)):
        return spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select("value", F.input_file_name().alias("at")).orderBy("at").select(F.col("value").alias("body"))
    return spark.createDataFrame([], "body string")


QUESTION = "id string, question string, domain_pattern string, hops_required int, options array<struct<id:string,text:string,is_correct:boolean,failure_mode_tested:string>>, reference_reasoning string, expected_sources array<string>, tags array<string>"


def question_set(spark: SparkSession, text: str) -> tuple[str, DataFrame]:
    """The dataset's id and its questions, from YAML; the file is small and read on the driver."""
    import yaml

    said = yaml.safe_load(text)
    names = [f.split()[0] for f in QUESTION.split(", ")]
    option = lambda o: tuple(o.get(k) for k in ("id", "text", "is_correct", "failure_mode_tested"))
    rows = [tuple([option(o) for o in q.get("options") or []] if n == "options" else (q.get(n) or []) if n in ("expected_sources", "tags") else q.get(n) for n in names) for q in said["questions"]]
    return said["dataset_id"], spark.createDataFrame(rows, QUESTION)


def price_table(spark: SparkSession, text: str) -> DataFrame:
    """model, input, output (dollars per million tokens) from YAML; a missing price is 0."""
    import yaml

    said = yaml.safe_load(text) or {}
    return spark.createDataFrame([(m, float(p.get("input", 0)), float(p.get("output", 0))) for m, p in said.items()], "model string, input double, output double")
