"""Sources of papers and texts: folders, PDF text, Atom feeds, paper APIs' JSON, HTML full texts; sinks of artifacts."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import CHUNK_BYTES, is_references_heading, packed, paragraphs

EXTENSIONS = ("txt", "md", "markdown", "text", "pdf")
MOST_PDF_BYTES, PDF_SECONDS = 20 * 1024 * 1024, 60


def local_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder: paper_id, title, kind, length and content; the folder may be in any store."""
    return local_papers(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), folder)


def local_papers(files: DataFrame, folder: str) -> DataFrame:
    """Of binary files under a folder, a table or a stream, those that are texts, as papers."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    spark = files.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    relative = F.element_at(F.split("path", base, 2), -1)
    return files.withColumn("kind", kind).filter(F.col("kind").isin(*EXTENSIONS)).select(F.concat(F.lit("local:"), relative).alias("paper_id"), name.alias("title"), "kind", "length", "content")


def file_texts(files: DataFrame) -> DataFrame:
    """(paper_id, text, failure) of files: PDF by pdftotext in each task, the rest as UTF-8; a file that fails is kept with its failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *text_of(k, bytes(c))) for p, k, c in zip(batch["paper_id"], batch["kind"], batch["content"], strict=True)], columns=["paper_id", "text", "failure"])

    return files.select("paper_id", "kind", "content").mapInPandas(run, "paper_id string, text string, failure string")


def text_of(kind: str, content: bytes) -> tuple[str | None, str | None]:
    if kind != "pdf":
        return content.decode("utf-8", "replace"), None
    if len(content) > MOST_PDF_BYTES:
        return None, "too large"
    try:
        done = subprocess.run(["pdftotext", "-layout", "-", "-"], input=content, capture_output=True, timeout=PDF_SECONDS, check=True)
    except (OSError, subprocess.SubprocessError) as e:
        return None, type(e).__name__
    return done.stdout.decode("utf-8", "replace"), None


def plain_chunks(texts: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """(paper_id, section, chunk_index, content) of texts: by page, up to the references, paragraphs packed to `most` bytes."""
    pages = F.transform(F.split("text", "\f"), lambda p, i: F.struct((i + 1).alias("page"), paragraphs(p).alias("parts")))
    flat = F.flatten(F.transform(pages, lambda p: F.transform(p["parts"], lambda t: F.struct(p["page"].alias("page"), t.alias("text"), is_references_heading(t).alias("stop")))))
    upto = F.aggregate(flat, F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop")), lambda s, x: F.when(s["stop"] | x["stop"], F.struct(s["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(F.struct((s["n"] + 1).alias("n"), F.lit(False).alias("stop"))))["n"]
    kept = texts.withColumn("_flat", flat).withColumn("_flat", F.slice("_flat", F.lit(1), upto)).withColumn("_pages", F.array_distinct(F.transform("_flat", lambda x: x["page"])))
    chunks = F.flatten(F.transform("_pages", lambda p: F.transform(packed(F.transform(F.filter("_flat", lambda x: x["page"] == p), lambda x: x["text"]), most), lambda c: F.struct(F.concat(F.lit("PDF page "), p.cast("string")).alias("section"), c.alias("content")))))
    return kept.select("paper_id", F.posexplode(chunks).alias("chunk_index", "c")).select("paper_id", "c.section", "chunk_index", "c.content")


class Sections(HTMLParser):
    """Paragraphs of an HTML text under their sections, in document order; nested sections count as their own too.

    section, paragraph, headings and title are written `tag.class` or `tag`.
    """

    def __init__(self, section: str, paragraph: str, headings: tuple[str, ...], title: str):
        super().__init__(convert_charrefs=True)
        self.section, self.paragraph, self.headings, self.title_is = section, paragraph, headings, title
        self.stack: list[tuple[str, int | None, bool]] = []
        self.sections: list[dict] = []
        self.loose: list[str] = []
        self.title: str | None = None
        self.text: list[str] | None = None
        self.heading: tuple[int, str, list[str]] | None = None
        self.naming: tuple[str, list[str]] | None = None
        self.hidden = False

    VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))

    def is_one(self, wanted: str, tag: str, classes: list[str]) -> bool:
        name, _, cls = wanted.partition(".")
        return tag == name and (not cls or cls in classes)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.VOID:
            if self.text is not None:
                self.text.append(" ")
            return
        found = dict(attrs)
        classes = (found.get("class") or "").split()
        section = None
        if self.is_one(self.section, tag, classes):
            section = len(self.sections)
            self.sections.append({"id": found.get("id") or "", "heading": None, "parts": []})
        begins = self.text is None and self.is_one(self.paragraph, tag, classes)
        if begins:
            self.text = []
        open_sections = [s for _, s, _ in self.stack if s is not None]
        if self.heading is None and open_sections and self.sections[open_sections[-1]]["heading"] is None and any(self.is_one(h, tag, classes) for h in self.headings):
            self.heading = open_sections[-1], tag, []
        if self.title is None and self.naming is None and self.is_one(self.title_is, tag, classes):
            self.naming = tag, []
        self.hidden = tag in ("script", "style")
        self.stack.append((tag, section, begins))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            if self.naming is not None:
                self.naming[1].append(data)
            if self.heading is not None:
                self.heading[2].append(data)
            elif self.text is not None:
                self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _, _ in self.stack]:
            return
        while self.stack:
            name, _, begins = self.stack.pop()
            if begins:
                self.end_paragraph()
            if name == tag:
                break
        self.hidden = False
        if self.heading is not None and tag == self.heading[1]:
            self.sections[self.heading[0]]["heading"] = " ".join("".join(self.heading[2]).split())
            self.heading = None
        if self.naming is not None and tag == self.naming[0]:
            self.title, self.naming = " ".join("".join(self.naming[1]).split()), None

    def end_paragraph(self) -> None:
        text = " ".join("".join(self.text or []).split())
        self.text = None
        if text:
            inside = [s for _, s, _ in self.stack if s is not None]
            for s in inside:
                self.sections[s]["parts"].append(text)
            if not inside:
                self.loose.append(text)

    def close(self) -> None:
        super().close()
        if self.text is not None:
            self.end_paragraph()


#: Bytes of HTML that a task parses before it sends what came of them.
HTML_BYTES = 1 << 20


def some_rows(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most HTML_BYTES of a text column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HTML_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: What headings and titles are in papers as HTML: fixed values.
HEADINGS, TITLE = ("h2.ltx_title_section", "h3.ltx_title_subsection", "h1.ltx_title_document"), "h1.ltx_title_document"


def html_paragraphs(pages: DataFrame, section: str = "section.ltx_section", paragraph: str = "div.ltx_para", headings: tuple[str, ...] = HEADINGS, title: str = TITLE, id_column: str = "paper_id", html_column: str = "html") -> DataFrame:
    """(id, section_ord, section, parts) of HTML texts: the paragraphs of each section, or, without sections, each one alone under the title."""
    kind = pages.schema[id_column].dataType.simpleString()

    ids = to_arrow_schema(pages.select(id_column).schema).field(0).type
    schema = pa.schema([(id_column, ids), ("section_ord", pa.int32()), ("section", pa.string()), ("parts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in some_rows(whole, 1):
                out: list[list] = [[], [], [], []]
                for key, html in zip(piece.column(0), piece.column(1), strict=True):
                    parser = Sections(section, paragraph, headings, title)
                    parser.feed(html.as_py() or "")
                    parser.close()
                    rows = [(s["heading"] or s["id"], s["parts"]) for s in parser.sections if s["parts"]]
                    if not parser.sections:
                        label = "document" if parser.title is None else parser.title
                        rows = [(label, [p]) for p in parser.loose]
                    for i, (heading, parts) in enumerate(rows):
                        for o, x in zip(out, (key.as_py(), i, heading, parts), strict=True):
                            o.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    return pages.select(id_column, html_column).mapInArrow(run, f"{id_column} {kind}, section_ord int, section string, parts array<string>")


def html_chunks(pages: DataFrame, most: int = CHUNK_BYTES, **where) -> DataFrame:
    """(id, section, chunk_index, content) of HTML texts, numbered through the document."""
    key = where.get("id_column", "paper_id")
    each = html_paragraphs(pages, **where).withColumn("chunks", packed(F.col("parts"), most))
    ordered = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_ord", "section", "chunks"))).alias("s"))
    flat = F.flatten(F.transform("s", lambda s: F.transform(s["chunks"], lambda c: F.struct(s["section"].alias("section"), c.alias("content")))))
    return ordered.select(key, F.posexplode(flat).alias("chunk_index", "c")).select(key, "c.section", "chunk_index", "c.content")


ATOM = "{http://www.w3.org/2005/Atom}"


def atom_entries(feeds: DataFrame) -> DataFrame:
    """(feed_id, ord, paper_id, title, summary, published, authors) of Atom feeds (feed_id, xml); entries without an id are left out, a feed that is not XML has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, xml in zip(batch["feed_id"], batch["xml"], strict=True):
                try:
                    entries = ElementTree.fromstring(xml or "").findall(f"{ATOM}entry")
                except ElementTree.ParseError:
                    entries = []
                for i, e in enumerate(entries):
                    texts = {t: [" ".join((x.text or "").split()) for x in e.findall(f"{ATOM}{t}")] for t in ("id", "title", "summary", "published")}
                    name = texts["id"][0].rpartition("/abs/")[2] if texts["id"] else ""
                    if name:
                        out.append((key, i, name, (texts["title"] or [""])[0], (texts["summary"] or [""])[-1], (texts["published"] or [""])[0], [" ".join((a.text or "").split()) for a in e.findall(f"{ATOM}author/{ATOM}name")]))
            yield pd.DataFrame(out, columns=["feed_id", "ord", "paper_id", "title", "summary", "published", "authors"])

    return feeds.select("feed_id", "xml").mapInPandas(run, "feed_id string, ord int, paper_id string, title string, summary string, published string, authors array<string>")


PAPER_JSON = "struct<paperId:string,title:string,abstract:string,year:int,venue:string,citationCount:int,influentialCitationCount:int,externalIds:struct<ArXiv:string,DOI:string>,authors:array<struct<name:string>>,openAccessPdf:struct<url:string>>"


def api_papers(payloads: DataFrame) -> DataFrame:
    """Paper rows out of cached JSON payloads (cache_key, payload): one paper, or a `data` list of papers."""
    one = F.from_json("payload", PAPER_JSON)
    many = F.from_json("payload", f"struct<data:array<{PAPER_JSON}>>")["data"]
    each = payloads.select("cache_key", F.posexplode(F.coalesce(many, F.array(one))).alias("ord", "p")).filter("p.paperId is not null")
    arxiv = F.col("p.externalIds.ArXiv")
    return each.select(
        "cache_key", "ord", F.when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), arxiv)).otherwise(F.concat(F.lit("s2:"), "p.paperId")).alias("paper_id"), F.col("p.paperId").alias("s2_paper_id"), arxiv.alias("arxiv_id"),
        F.col("p.externalIds.DOI").alias("doi"), "p.title", "p.abstract", "p.year", "p.venue", F.col("p.citationCount").alias("citation_count"), F.col("p.influentialCitationCount").alias("influential_count"),
        F.transform("p.authors", lambda a: a["name"]).alias("authors"), F.col("p.openAccessPdf.url").alias("open_access_pdf_url"),
    )


def full_text(body: Column, abstract: Column, status: Column) -> Column:
    """A fetched body; the abstract where there was none (404); other failures fail the query."""
    return F.when(status == 404, abstract).when(status.between(200, 299), body).otherwise(F.raise_error(F.format_string("fetch failed: %d", status)))


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimensions: int, text: str = "embed_text", size: int = 128) -> DataFrame:
    """rows with the vectors of their texts by an injected service, in requests of at most `size`; a wrong count or length fails."""
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = []
            for i in range(0, len(batch), size):
                part = batch[text].iloc[i : i + size].tolist()
                got = embed(part)
                if len(got) != len(part) or any(len(v) != dimensions for v in got):
                    raise ValueError("the embedding service gave other vectors than asked for")
                vectors += got
            yield batch.assign(embedding=vectors)

    return rows.mapInPandas(run, schema)


def stamped(artifact: DataFrame, model: str, prompt_version: str, code_version: str, generated_at: str) -> DataFrame:
    """artifact with what made it; the clock is the caller's."""
    return artifact.withColumns({"model": F.lit(model), "prompt_version": F.lit(prompt_version), "code_version": F.lit(code_version), "generated_at": F.lit(generated_at)})


def nested(claims: DataFrame, sources: DataFrame, quotes: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, artifact): each run's claims with their sources and quotes, in order, as JSON."""

    def listed(df: DataFrame, order: str, *columns: str) -> DataFrame:
        return df.groupBy(run, "claim_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns))).alias("items"))

    s = listed(sources, "source_ord", "source_id").withColumnRenamed("items", "sources")
    q = listed(quotes, "quote_ord", "source_id", "quote", "status").withColumnRenamed("items", "quotes")
    whole = claims.join(s, [run, "claim_ord"], "left").join(q, [run, "claim_ord"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("claim_ord", "text", "agreement_level", "sources", "quotes")))
    return whole.groupBy(run).agg(F.to_json(F.struct(ordered.alias("claims"))).alias("artifact"))
