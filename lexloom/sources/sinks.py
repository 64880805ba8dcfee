"""Writers of texts to files, one file a row, on executors: nothing is overwritten unless it is asked for.

Rows are (path, content). Paths are taken one after the other within a partition, and no path may be in two partitions, so rows
are dealt out by path. A file is written beside its place and moved there, so that a lost executor leaves no half of one; a
task that runs again finds what it wrote before and takes it as its own if it has the same bytes.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VERSIONS, CAPTURES = 1000, 20
WRITTEN = "requested string, path string, outcome string"


def _put(path: str, data: bytes, replace: bool = False) -> bool:
    """Writes a file in one step; False if it is there already."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        if replace:
            os.replace(beside, path)
            return True
        os.link(beside, path)
        return True
    except FileExistsError:
        return False
    finally:
        if os.path.exists(beside):
            os.unlink(beside)


def _same(path: str, data: bytes) -> bool:
    try:
        with open(path, "rb") as f:
            return f.read() == data
    except OSError:
        return False


def replaced(path: str, data: bytes) -> tuple[str, str]:
    _put(path, data, replace=True)
    return path, "written"


def kept(path: str, data: bytes) -> tuple[str, str]:
    """No-clobber: what is there stays."""
    if _put(path, data):
        return path, "written"
    return path, "reused" if _same(path, data) else "exists"


def versioned(path: str, data: bytes) -> tuple[str, str]:
    """The first free one of name.md, name.2.md, ..."""
    stem, extension = os.path.splitext(path)
    for n in range(1, VERSIONS + 1):
        place = path if n == 1 else f"{stem}.{n}{extension}"
        if _put(place, data):
            return place, "written"
        if _same(place, data):
            return place, "reused"
    return path, "full"


def captured(path: str, data: bytes) -> tuple[str, str]:
    """Content-addressed: the same bytes are reused, others get a name with their hash."""
    stem, extension = os.path.splitext(path)
    digest = hashlib.sha256(data).hexdigest()[:12]
    for n in range(CAPTURES):
        place = path if n == 0 else f"{stem}--{digest}{extension}" if n == 1 else f"{stem}--{digest}-{uuid.uuid4().hex[:8]}{extension}"
        if _same(place, data):
            return place, "reused"
        if _put(place, data):
            return place, "written"
    return path, "full"


def appended(path: str, data: bytes) -> tuple[str, str]:
    """One line more of a journal. What a crash left behind its last newline is put aside first, in a file of its own."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "ab+") as f:
        f.seek(0)
        held = f.read()
        end = held.rfind(b"\n") + 1
        if end < len(held):
            _put(os.path.join(os.path.dirname(path), f"torn-append-{hashlib.sha256(held[end:]).hexdigest()[:12]}.txt"), held[end:])
            f.truncate(end)
        if held[:end].endswith(b"\n" + data + b"\n") or held[:end] == data + b"\n":  # a task that runs again
            return path, "reused"
        f.write(data + b"\n")
        f.flush()
        os.fsync(f.fileno())
    return path, "written"


def manifest(run: Column, totals: Column, at: Column) -> Column:
    """A run's manifest as JSON, with its totals and the time of its last change; write it with replaced()."""
    return pretty_json(F.struct(run.alias("run"), totals.alias("totals"), at.alias("updated_at")))


def write(rows: DataFrame, how: Callable[[str, bytes], tuple[str, str]] = kept, path: str = "path", content: str = "content") -> DataFrame:
    """requested, path, outcome of every row, written when the result is used: written, reused, exists or full.

    Files lie in a folder that driver and executors share. how: one of the functions above.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *how(p.removeprefix("file://"), c if isinstance(c, bytes) else (c or "").encode())) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame(out, columns=["requested", "path", "outcome"])

    return rows.select(F.col(path).alias("path"), F.col(content).alias("content")).repartition("path").sortWithinPartitions("path").mapInPandas(run, WRITTEN)


def output_path(path: Column, root: str) -> Column:
    """Where an output may be written: below a root, as Markdown or JSON; null elsewhere."""
    from lexloom.functions.urls import inside

    return F.when(path.rlike(r"(?i)\.(?:md|json)$"), inside(path, root))


def summary_path(source: Column) -> Column:
    """Where the summary of an opinion goes if no path is named."""
    return F.concat(F.regexp_replace(source, r"\.[^./]*$", ""), F.lit(".Summary.md"))


def by_extension(path: Column, as_json: Column, as_markdown: Column) -> Column:
    return F.when(path.rlike(r"(?i)\.json$"), F.concat(as_json, F.lit("\n"))).otherwise(as_markdown)


def pretty_json(c: Column) -> Column:
    """A struct or map as indented JSON."""
    return F.to_json(c, {"pretty": "true", "ignoreNullFields": "false"})


@F.pandas_udf(StringType())
def yaml_of(s: pd.Series) -> pd.Series:
    """A JSON object as YAML, keys in their order."""
    import json

    import yaml

    return s.map(lambda v: None if v is None else yaml.safe_dump(json.loads(v), sort_keys=False, allow_unicode=True, width=1 << 30))


def with_front_matter(metadata: Column, body: Column) -> Column:
    """A Markdown text with its metadata (JSON) as YAML at its front."""
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.concat(F.lit("---\n"), yaml_of(metadata), F.lit("---\n\n"), trimmed, F.lit("\n"))


def sidecar(heading: Column, metadata: Column) -> Column:
    """The Markdown file that goes beside a saved page: a heading and its metadata as fenced JSON."""
    return F.concat(F.lit("# "), heading, F.lit("\n\n## Machine-readable metadata\n\n```json\n"), metadata, F.lit("\n```\n"))


def rendered_artifact(inputs: Column, template: Column, output: Column) -> Column:
    """The manifest row of a rendered document: the hashes of what went in and came out."""
    digest = lambda c: F.sha2(c, 256)
    return F.struct(digest(inputs).alias("input_sha256"), F.when(template.isNotNull(), digest(template)).alias("template_sha256"), digest(output).alias("output_sha256"))


def document_errors(payload: Column) -> Column:
    """Error names of a document's sections: struct(title, sections: array of struct(heading, paragraphs))."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    s = payload["sections"]
    rules = ((payload.isNull(), "object"), (blank(payload["title"]), "title"), (s.isNull(), "sections"), (F.exists(s, lambda x: blank(x["heading"])), "heading"), (F.exists(s, lambda x: x["paragraphs"].isNull() | F.exists(x["paragraphs"], lambda p: p.isNull())), "paragraphs"))
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in rules)), lambda e: e.isNotNull())


#: The parts that every document of the Office format has.
DOCUMENT_PARTS = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")


def _docx(title: str, sections: list) -> bytes:
    """A minimal document: a title, headings and paragraphs."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def paragraph(text: str, style: str | None = None) -> str:
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{look}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = [paragraph(title, "Title")]
    for s in sections:
        body += [paragraph(s["heading"], "Heading1"), *map(paragraph, s["paragraphs"])]
    space = "http://schemas.openxmlformats.org"
    files = {
        DOCUMENT_PARTS[0]: f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        DOCUMENT_PARTS[1]: f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="rId1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        DOCUMENT_PARTS[2]: f'<w:document xmlns:w="{space}/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>',
    }
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + content)
    return sink.getvalue()


def document(title: Column, sections: Column) -> Column:
    """The bytes of an Office document from its sections (array of struct(heading, paragraphs))."""

    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([_docx(a, b) for a, b in zip(t, s, strict=True)])

    return F.pandas_udf(run, "binary")(title, sections)


@F.pandas_udf(ArrayType(StringType()))
def missing_parts(s: pd.Series) -> pd.Series:
    """The parts that a document lacks; all of them if it isn't one."""
    import io
    import zipfile

    def one(data: bytes | None) -> list[str]:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                names = set(z.namelist())
        except zipfile.BadZipFile:
            names = set()
        return [p for p in DOCUMENT_PARTS if p not in names]

    return s.map(one)


def filled_template(template: Column, values: Column) -> Column:
    """A text template with {{name}} replaced by the values of a map; names without one become empty."""
    names = F.regexp_extract_all(template, F.lit(r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"), F.lit(1))
    between = F.split(template, r"\{\{\s*[A-Za-z0-9_]+\s*\}\}")
    put = F.concat(F.transform(names, lambda n: F.coalesce(F.try_element_at(values, n), F.lit(""))), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, b)), "")
