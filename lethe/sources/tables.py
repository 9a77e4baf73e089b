"""Page sources: text tables, conversations, raw web pages and folders of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.functions.catalog import PAGE_CAP, UPLOAD_CAP
from lethe.sources.shared import stored


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out to all of them first. A file of one row group
    is one task's work, however long its texts; a table of many files is read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    few = len(df._jdf.inputFiles()) < cores  # Spark's own listing of the files: their names do not come to Python
    return df.repartition(cores) if few else df


def document_pages(docs: DataFrame) -> DataFrame:
    """One page for each document: doc_id, page_num, text."""
    return docs.select("doc_id", F.lit(0).alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """A conversation is a document and its turns are the pages."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))


def html_pages(pages: DataFrame) -> DataFrame:
    """Web pages without scripts, styles, tags and the commonest entities; runs of white space are one space."""
    x = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(c))
    return pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page_num"), F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " ")).alias("text"))


def _depth(spark: SparkSession, folder: str) -> int:
    """Number of names in a folder's full path, its file system included."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return len(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/").split("/"))


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, length, content of a folder's files, at any depth or directly in it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    if not recursive:  # Spark's own flat lookup takes folders named k=v for partitions; by metadata, other files are not opened
        found = found.filter(F.size(F.split("_metadata.file_path", "/")) == _depth(spark, folder) + 1)
    return found.select("path", "length", "content")


def datasets(spark: SparkSession, folder: str, pattern: str = "*.parquet", recursive: bool = True) -> DataFrame:
    """path, length of a folder's files, where a folder whose name matches is one dataset as a file is: its length is
    the sum over the part files at any depth below it, and these are not listed apart."""
    depth = _depth(spark, folder)
    matches = rf"\A(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()})\z"  # as pathGlobFilter has it
    names = F.split("path", "/")
    first = F.array_position(F.transform(F.slice(names, depth + 1, F.size(names)), lambda x: x.rlike(matches)), True).cast("int")
    found = files(spark, folder, "*").select("path", "length", first.alias("first")).filter("first > 0" if recursive else "first = 1")
    return found.groupBy(F.array_join(F.slice(names, 1, F.col("first") + depth), "/").alias("path")).agg(F.sum("length").alias("length"))


def first_files(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy("path").limit(n)


def uploads(found: DataFrame, cap: int = UPLOAD_CAP) -> tuple[DataFrame, DataFrame]:
    """Files that are taken, and those refused for their kind or size."""
    ok = F.lower("path").endswith(".pdf") & (F.col("length") <= cap)
    return found.filter(ok), found.filter(~ok).withColumn("reason", F.when(F.col("length") > cap, "too large").otherwise("not a PDF"))


def parsed_documents(found: DataFrame, parser: Callable[[bytes], list[str]] | None, cap: int = PAGE_CAP) -> DataFrame:
    """path, pages, error of binary documents (path, content) by a parser that the caller provides; without one, a clear
    error. A document of more than `cap` pages, or that the parser refuses, has no pages but an error, so one such does not
    end a run over many; texts are stripped."""
    if parser is None:
        raise RuntimeError("no parser for binary documents is installed; pass one")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    texts = parser(bytes(content))
                    error = f"a document has {len(texts)} pages; at most {cap} are read" if len(texts) > cap else None
                except Exception as e:  # noqa: BLE001  the other documents are read
                    texts, error = [], f"a document was not read: {type(e).__name__}"
                rows.append((path, [] if error else [t.strip() for t in texts], error))
            yield pd.DataFrame(rows, columns=["path", "pages", "error"])

    return found.select("path", "content").mapInPandas(run, "path string, pages array<string>, error string")


def text_pages(parsed: DataFrame) -> DataFrame:
    """doc_id (the path), page_num, text of parsed documents."""
    return parsed.select(F.col("path").alias("doc_id"), F.posexplode("pages").alias("page_num", "text"))


def extracted_once(pages: DataFrame) -> DataFrame:
    """Pages stored in the shared folder, so that several models read what was extracted once."""
    return stored(pages, "pages")


def parsed_pages(found: DataFrame, parser: Callable[[bytes], list[str]] | None, cap: int = PAGE_CAP) -> DataFrame:
    """Pages of binary documents by a parser that the caller provides; without one, a clear error.

    A document of more than `cap` pages is an error before any page is made.
    """
    if parser is None:
        raise RuntimeError("no parser for binary documents is installed; pass one")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                texts = parser(content)
                if len(texts) > cap:
                    raise ValueError(f"a document has {len(texts)} pages; at most {cap} are read")
                rows += [(path, i, t.strip()) for i, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "text"])

    return found.select("path", "content").mapInPandas(run, "doc_id string, page_num int, text string")


def page_counts(pages: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return n.withColumn("over_cap", F.col("pages") > cap)


def words(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, index, text: the visible words in order."""
    parts = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    return pages.select("doc_id", "page_num", F.posexplode(parts).alias("index", "text"))
