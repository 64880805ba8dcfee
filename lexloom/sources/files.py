"""Readers of files: opinions and drafts, their metadata, libraries, journals.

Files are read by Spark's own readers, whole, so that any store that Spark reads will do; guards and limits are columns of the
result and not exceptions, but where a caller asks for the one file that a path names.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions import citations as C
from lexloom.functions import text as T
from lexloom.functions import urls as U
from lexloom.functions.markup import opinion_text
from lexloom.operators.citations import header_of

# What may be analysed, how large it may be, how long an opinion must be, and how many sources and entries a scan may see.
EXTENSIONS = ("html", "htm", "md", "txt")
MOST_BYTES, LEAST_CHARS, MOST_SOURCES, MOST_ENTRIES = 8 * 1024 * 1024, 200, 1000, 20_000
SKIPPED_FOLDERS = (".git", ".pi", "node_modules", "dist", "build")


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """path, length, content (bytes), text of all files below a path; folders that hold no sources are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    own = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    hidden = F.col("path").rlike(rf"/(?:{'|'.join(map(_quoted, SKIPPED_FOLDERS))})/")
    return files.where(own.isin(*extensions) & ~hidden).select("path", "length", "content", F.decode("content", "UTF-8").alias("text"))


def _quoted(name: str) -> str:
    return name.replace(".", r"\.")


def capped(files: DataFrame, limit: int = MOST_SOURCES) -> DataFrame:
    """The first files by path, with truncated: whether there are more. The limit is the feature: a scan's size."""
    first = files.orderBy("path").limit(limit + 1)
    n = first.agg((F.count("*") > limit).alias("truncated"))
    return first.orderBy("path").limit(limit).crossJoin(F.broadcast(n))  # one row


def is_local(path: Column) -> Column:
    """Whether a path is one of files, not a URL."""
    return ~path.rlike("(?i)^[a-z][a-z0-9+.-]*://")


def readable(path: Column, root: str) -> Column:
    """A relative path below a root, or an absolute one inside it; null for URLs and what leads out."""
    base = root.rstrip("/") + "/"
    absolute = F.when(path.startswith(base), U.inside(F.substring(path, len(base) + 1, 1 << 16), root))
    return F.when(is_local(path), F.coalesce(U.inside(path, root), absolute))


def one_file(spark: SparkSession, root: str, path: str, label: str = "source_path") -> DataFrame:
    """The file that a path below a root names; an error if it is a URL, leads out of the root, or isn't a file."""
    if "://" in path:
        raise ValueError(f"{label} must be a local path")
    import posixpath

    base = root.rstrip("/")
    whole = posixpath.normpath(posixpath.join(base, path))
    if not whole.startswith(base + "/"):
        raise ValueError(f"{label} must lie inside {root}")
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(whole)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isFile():
        raise FileNotFoundError(f"{label} must name a file: {path}")
    return read_files(spark, whole)


def one_folder(spark: SparkSession, root: str, path: str, label: str = "source_root") -> DataFrame:
    """The files below a folder inside a root; an error if the path is a URL, leads out of the root or to it, or is no folder."""
    if "://" in path:
        raise ValueError(f"{label} must be a local path")
    import posixpath

    base = root.rstrip("/")
    whole = posixpath.normpath(posixpath.join(base, path))
    if not whole.startswith(base + "/"):
        raise ValueError(f"{label} must lie below {root}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(whole)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where) or not system.getFileStatus(where).isDirectory():
        raise NotADirectoryError(f"{label} must name a folder: {path}")
    return read_files(spark, whole)


# Metadata ---------------------------------------------------------------------------------------------------------

FRONT = r"(?s)^\x{feff}?---\r?\n(.*?)\r?\n---(?:\r?\n|$)"


def front_matter(c: Column) -> Column:
    """struct(yaml, body) of a Markdown text: what stands between dashes at its front, null if nothing does, and the trimmed rest."""
    has = c.rlike(FRONT)
    return F.struct(F.when(has, F.regexp_extract(c, FRONT, 1)).alias("yaml"), F.when(has, F.trim(F.regexp_replace(F.regexp_replace(c, FRONT, ""), r"^\s+|\s+$", ""))).otherwise(c).alias("body"))


@F.pandas_udf(StringType())
def yaml_to_json(s: pd.Series) -> pd.Series:
    """A YAML mapping as JSON; null for what is none or doesn't parse. Dates stay as they are written."""
    import yaml

    class Plain(yaml.SafeLoader):
        yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

    def one(v: str | None) -> str | None:
        try:
            out = None if v is None else yaml.load(v, Plain)  # noqa: S506
        except yaml.YAMLError:
            return None
        return json.dumps(out, ensure_ascii=False, default=str) if isinstance(out, dict) else None

    return s.map(one)


def metadata_json(c: Column) -> Column:
    """The metadata of a Markdown text as a JSON object: its front matter, else its first fenced block of JSON; null if it has neither."""
    fenced = F.nullif(F.regexp_extract(c, r"(?is)```json\s*(.*?)\s*```", 1), F.lit(""))
    return F.coalesce(yaml_to_json(front_matter(c)["yaml"]), F.when(F.try_parse_json(fenced).isNotNull() & F.trim(fenced).startswith("{"), fenced))


def _at(c: Column, path: str) -> Column:
    return F.nullif(F.trim(F.get_json_object(c, path)), F.lit(""))


def metadata_provider(c: Column) -> Column:
    return F.lower(_at(c, "$.source.provider"))


def metadata_case_key(c: Column) -> Column:
    return _at(c, "$.case.canonicalKey")


def metadata_fields(c: Column) -> Column:
    """struct(title, citations, norm_citations, court, year, docket, case_key, provider) of a metadata object."""
    listed = lambda path: T.nonblank_strings(F.coalesce(F.from_json(F.get_json_object(c, path), "array<string>"), F.array().cast("array<string>")))
    cites = listed("$.case.citations")
    strict = F.filter(F.transform(cites, C.strict_citation_key), lambda x: x.isNotNull())
    year = F.nullif(F.regexp_extract(_at(c, "$.case.dateFiled"), r"(?<![A-Za-z0-9_])(\d{4})(?![A-Za-z0-9_])", 1), F.lit(""))
    return F.struct(
        F.coalesce(_at(c, "$.case.title"), _at(c, "$.source.title")).alias("title"), cites.alias("citations"), F.array_distinct(F.concat(listed("$.case.normalizedCitations"), strict)).alias("norm_citations"),
        _at(c, "$.case.court").alias("court"), F.coalesce(_at(c, "$.case.year"), year).alias("year"), _at(c, "$.case.docketNumber").alias("docket"), metadata_case_key(c).alias("case_key"),
        F.coalesce(_at(c, "$.source.provider"), _at(c, "$.provider")).alias("provider"),
    )


def sidecar_path(path: Column) -> Column:
    """The Markdown file beside a page of HTML, null for other files."""
    return F.when(path.rlike(r"(?i)\.html?$"), F.regexp_replace(path, r"(?i)\.html?$", ".md"))


def is_summary(path: Column, metadata: Column | None = None) -> Column:
    """Whether a file is a summary, by its name or its metadata."""
    told = F.coalesce(F.get_json_object(metadata, "$.artifact_type") == "case_summary", F.lit(False)) if metadata is not None else F.lit(False)
    return path.rlike(r"(?i)\.Summary(?:\.\d+)?\.md$") | told


def is_sidecar(text: Column, metadata: Column) -> Column:
    """Whether a Markdown text is a saved page's metadata and not an opinion."""
    return F.coalesce(_at(metadata, "$.source.savedPath").isNotNull(), F.lit(False)) | (text.rlike("(?i)## Machine-readable metadata") & text.rlike("(?i)```json"))


# Opinions and drafts ----------------------------------------------------------------------------------------------


def _is_html(path: Column) -> Column:
    return path.rlike(r"(?i)\.html?$")


def load_opinions(files: DataFrame, path: str = "path") -> DataFrame:
    """path, metadata_path, metadata, provider, case_key, text, blocks (array), raw_sha256, text_sha256, tokens, error of opinions.

    files: read_files(). Metadata comes from the Markdown beside a page, or from a Markdown opinion's own front. error says why
    a file can't be used: size, sidecar, summary, short, or null.
    """
    own = F.when(F.col(path).rlike(r"(?i)\.md$"), metadata_json(F.col("text")))
    sides = files.where(F.col(path).rlike(r"(?i)\.md$")).select(F.col(path).alias("_side"), F.col("text").alias("_side_text"))
    rows = files.withColumn("_side", sidecar_path(F.col(path))).join(sides, "_side", "left")
    rows = rows.withColumn("metadata", F.coalesce(own, metadata_json(F.col("_side_text")))).withColumn("provider", F.coalesce(metadata_provider(F.col("metadata")), F.lit(None).cast("string")))
    by = F.col("provider")
    html = F.coalesce(*(F.when(by == p, opinion_text(F.col("text"), p, "analysis")) for p in ("scholar", "courtlistener", "justia")), opinion_text(F.col("text"), None, "analysis"))
    plain = F.when(_is_html(F.col(path)), html).otherwise(F.when(F.col(path).rlike(r"(?i)\.md$"), front_matter(F.col("text"))["body"]).otherwise(F.col("text")))
    rows = rows.withColumn("blocks", T.paragraphs(plain)).withColumn("normalized", F.array_join("blocks", "\n\n"))
    error = (
        F.when(F.col("length") > MOST_BYTES, "size")
        .when(F.col(path).rlike(r"(?i)\.md$") & F.coalesce(is_sidecar(F.col("text"), F.col("metadata")), F.lit(False)), "sidecar")
        .when(is_summary(F.col(path), F.col("metadata")), "summary")
        .when((F.length("normalized") < LEAST_CHARS) | (F.size("blocks") < 1), "short")
    )
    return rows.select(
        path, F.when(F.col("_side_text").isNotNull(), F.col("_side")).alias("metadata_path"), "metadata", "provider", metadata_case_key(F.col("metadata")).alias("case_key"), F.col("normalized").alias("text"), "blocks",
        F.sha2("content", 256).alias("raw_sha256"), F.sha2("normalized", 256).alias("text_sha256"), T.input_tokens(F.col("normalized")).alias("tokens"), error.alias("error"),
    )


def load_drafts(files: DataFrame, path: str = "path") -> DataFrame:
    """path, text, blocks (array), raw_sha256, text_sha256, error of drafts: pages of HTML by the draft's rules, other files as they are."""
    plain = F.when(_is_html(F.col(path)), T.html_to_text(F.col("text"), "draft")).otherwise(F.col("text"))
    rows = files.withColumn("blocks", T.paragraphs(plain, "draft")).withColumn("normalized", F.array_join("blocks", "\n\n"))
    error = F.when(F.col("length") > MOST_BYTES, "size").when(F.size("blocks") < 1, "empty")
    return rows.select(path, F.col("normalized").alias("text"), "blocks", F.sha2("content", 256).alias("raw_sha256"), F.sha2("normalized", 256).alias("text_sha256"), error.alias("error"))


def _header(c: Column) -> Column:
    """struct(title, citations) of an opinion's first blocks."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_of(x or "") for x in s], columns=["title", "citations"], dtype=object)

    return F.pandas_udf(run, "title string, citations array<string>")(c)


def identity(metadata: Column, blocks: Column) -> Column:
    """struct of metadata_fields(): from the metadata if it names a citation or title, else from the first four blocks."""
    told = metadata_fields(metadata)
    head = _header(F.array_join(F.slice(blocks, 1, 4), " "))
    cites = F.filter(F.transform(head["citations"], T.collapse), lambda x: C.strict_citation_key(x).isNotNull())
    none = F.lit(None).cast("string")
    read = F.struct(head["title"].alias("title"), cites.alias("citations"), F.transform(cites, C.strict_citation_key).alias("norm_citations"), *(none.alias(f) for f in ("court", "year", "docket", "case_key", "provider")))
    return F.when((F.size(told["norm_citations"]) > 0) | told["title"].isNotNull(), told).otherwise(read)


def descriptors(opinions: DataFrame, explicit: bool = False, path: str = "path") -> DataFrame:
    """path, metadata_path, explicit and the identity's fields of usable sources. Scanned pages count only with an identity from metadata."""
    usable = opinions.where("error IS NULL")
    rows = usable.withColumn("_id", identity(F.col("metadata"), F.col("blocks")))
    if not explicit:
        told = metadata_fields(F.col("metadata"))
        rows = rows.where(~_is_html(F.col(path)) | told["title"].isNotNull() | (F.size(told["norm_citations"]) > 0))
    return rows.select(path, "metadata_path", F.lit(explicit).alias("explicit"), "_id.*")


def authority_index(explicit: DataFrame, scanned: DataFrame, path: str = "path", limit: int = MOST_SOURCES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sources, by_citation, by_name, coverage) of descriptors. An explicit source replaces a scanned one of the same path.

    by_citation (citation, authority_id) and by_name (name, authority_id) are what verification.resolve() takes; ids are paths. The
    limit is the feature: at most so many sources, explicit ones first; coverage tells whether there were more.
    """
    rest = scanned.join(explicit.select(path), path, "left_anti")
    both = explicit.unionByName(rest)
    first = both.orderBy(F.desc("explicit"), path).limit(limit)
    key = lambda c: C.name_key(c)
    by_citation = first.select(F.explode("norm_citations").alias("citation"), F.col(path).alias("authority_id")).distinct()
    by_name = first.select(key(F.col("title")).alias("name"), F.col(path).alias("authority_id")).where("name <> ''").distinct()
    coverage = both.agg(F.least(F.count("*"), F.lit(limit)).alias("indexed_sources"), (F.count("*") > limit).alias("truncated"), F.count_if("explicit").alias("explicit_sources"))
    return first, by_citation, by_name, coverage


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, values: all values of every key that isn't null, in order."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def source_record(descriptor: DataFrame, opinions: DataFrame, path: str = "path") -> DataFrame:
    """What is told of a source in a report: path, title, case_key, provider, hashes, tokens. Each opinion is read once, however many name it."""
    wanted = opinions.join(descriptor.select(path).distinct(), path, "left_semi").select(path, "raw_sha256", "text_sha256", "tokens")
    return descriptor.join(wanted, path).select(path, "metadata_path", "title", "case_key", "provider", "raw_sha256", "text_sha256", "tokens")


def display_name(title: Column, case_key: Column, path: Column) -> Column:
    return F.coalesce(title, case_key, F.element_at(F.split(path, "/"), -1))


# Libraries and JSON -----------------------------------------------------------------------------------------------

RECORD = "struct<downloadedAt:string,case:struct<canonicalKey:string,title:string,citations:array<string>,court:string,dateFiled:string,year:string,publicationStatus:string,sources:array<struct<provider:string,providerId:string>>>,source:struct<savedPath:string,provider:string,sourceUrl:string,htmlSha256:string,textSha256:string,markdownPath:string>>"


def library_records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, warnings) of a library's Markdown and case.json files: metadata_path and record, newest first; metadata must lie beside the opinion that it names."""
    named = files.where(F.col("path").rlike(r"(?i)\.md$|/case\.json$"))
    plain = F.col("path").rlike(r"/case\.json$")
    rows = named.select(F.col("path").alias("metadata_path"), plain.alias("_plain"), F.from_json(F.when(plain, F.col("text")).otherwise(metadata_json(F.col("text"))), RECORD).alias("record"))
    usable = rows.where("record.case.canonicalKey IS NOT NULL AND record.case.sources IS NOT NULL AND record.source.savedPath IS NOT NULL")
    base = lambda c: F.regexp_replace(c, "^file:/+", "/")
    paired = F.col("_plain") | (base(F.col("metadata_path")) == base(U.metadata_path(F.col("record.source.savedPath"))))
    warnings = usable.where(~paired).select("metadata_path", F.lit("metadata isn't beside the opinion that it names").alias("warning"))
    entries = usable.where(paired).select("metadata_path", "record").orderBy(F.desc_nulls_last("record.downloadedAt"))
    return entries, warnings


def key_records(files: DataFrame, case_key: str) -> DataFrame:
    """path, metadata of the Markdown files whose metadata is of one case."""
    rows = files.where(F.col("path").rlike(r"(?i)\.md$")).select("path", metadata_json(F.col("text")).alias("metadata"))
    return rows.where(metadata_case_key(F.col("metadata")) == case_key)


def find_saved(entries: DataFrame, integrity: DataFrame, case_key: str, provider: str | None = None) -> DataFrame:
    """The newest valid saved opinion of a case. integrity: metadata_path, status."""
    mine = entries.where(F.col("record.case.canonicalKey") == case_key)
    if provider:
        mine = mine.where(F.col("record.source.provider") == provider)
    return mine.join(integrity.where("status = 'valid'"), "metadata_path").orderBy(F.desc_nulls_last("record.downloadedAt")).limit(1)


def saved_seed(entries: DataFrame, integrity: DataFrame, case_key: str) -> DataFrame:
    """What all valid saved versions of a case, oldest first, know of it together: the first value of each field, and all its sources."""
    mine = entries.where(F.col("record.case.canonicalKey") == case_key).join(integrity.where("status = 'valid'").select("metadata_path"), "metadata_path", "left_semi")
    at = F.struct(F.col("record.downloadedAt").alias("t"), F.col("metadata_path").alias("p"))
    case = F.col("record.case")
    shown = [F.min_by(case[c], F.when(case[c].isNotNull(), at)).alias(c) for c in ("title", "court", "dateFiled", "year", "publicationStatus")]
    return mine.groupBy(case["canonicalKey"].alias("case_key")).agg(*shown, F.array_distinct(F.flatten(F.collect_list(case["citations"]))).alias("citations"), F.array_distinct(F.flatten(F.collect_list(case["sources"]))).alias("sources"), F.count("*").alias("versions"))


def json_files(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole files of JSON, one row each; an error where one isn't JSON."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def json_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of a file's JSON array; none if there is no such file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return json_files(spark, path, schema)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """path, content of journals, for journal.committed_lines()."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def resume_manifest(spark: SparkSession, path: str, name: str = "cited-by-manifest.json") -> str:
    """The manifest that a path names, a folder's own or the file itself; an error if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(where) and system.getFileStatus(where).isDirectory():
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, name)
    if not system.exists(where):
        raise FileNotFoundError(f"no manifest at {where.toString()}")
    return where.toString()


# Providers --------------------------------------------------------------------------------------------------------


def provider_pages(pages: DataFrame, parameters: DataFrame) -> DataFrame:
    """What a provider answers, from a table of captured pages (provider, fingerprint, page, html, ...): pages are joined to requests
    (provider, fingerprint, page), and a request without one is failed. No network is used."""
    out = parameters.join(pages, ["provider", "fingerprint", "page"], "left")
    return out.withColumn("status", F.when(F.col("html").isNull(), "failed").otherwise("completed"))


def first_pages(answers: DataFrame) -> DataFrame:
    """provider, status, results of a search over several providers; what failed with one doesn't stop the others, and failed is true if all did."""
    by = answers.groupBy("provider").agg(F.when(F.every(F.col("status") == "failed"), "failed").otherwise("completed").alias("status"), F.sum(F.coalesce("results", F.lit(0))).alias("results"))
    every = by.agg(F.every(F.col("status") == "failed").alias("all_failed"))
    return by.crossJoin(F.broadcast(every))  # one row


def located(pages: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """case_key, page, position of the first card that is the opinion looked for (case_key, provider, native_id) within the first pages."""
    hits = pages.where(F.col("page") <= most).join(wanted, ["case_key", "provider", "native_id"])
    return hits.groupBy("case_key").agg(F.min(F.struct("page", "position")).alias("at")).select("case_key", "at.page", "at.position")


def first_success(attempts: DataFrame, key: str = "case_key") -> DataFrame:
    """key, saved_path, provider of the first attempt, in order, that succeeded, and all attempts up to it."""
    listed = F.array_sort(F.collect_list(F.struct("attempt_no", "provider", "saved_path", "error")))
    rows = attempts.groupBy(key).agg(listed.alias("_a"))
    good = F.get(F.filter("_a", lambda a: a["error"].isNull()), F.lit(0))
    tried = F.filter("_a", lambda a: good.isNull() | (a["attempt_no"] <= good["attempt_no"]))
    return rows.select(key, good["saved_path"].alias("saved_path"), good["provider"].alias("provider"), tried.alias("attempts"))


def exact_link(candidates: DataFrame, link: str) -> DataFrame:
    """The one candidate that a chosen link names, and no other."""
    return candidates.where((F.col("url") == link) & U.is_safe_source(F.col("provider"), F.col("url")))
