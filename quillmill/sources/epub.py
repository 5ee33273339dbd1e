"""ePub containers as a source (S02, S03, S08-S10): zip archives read from binary files, one per row."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.sources import xhtml

_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/", "n": "http://www.daisy.org/z3986/2005/ncx/"}


class Book:
    """The parts of one archive that matter here."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        box = ET.fromstring(self.zip.read("META-INF/container.xml"))
        self.opf_path = box.find(".//c:rootfile", _NS).get("full-path")
        self.opf = ET.fromstring(self.zip.read(self.opf_path))
        self.base = posixpath.dirname(self.opf_path)
        self.items = {i.get("id"): i for i in self.opf.findall(".//o:manifest/o:item", _NS)}

    def _at(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(self.base, href))

    def metadata(self) -> dict:
        one = lambda tag: next((e.text.strip() for e in self.opf.findall(f".//d:{tag}", _NS) if e.text and e.text.strip()), None)
        many = lambda tag: [e.text.strip() for e in self.opf.findall(f".//d:{tag}", _NS) if e.text and e.text.strip()]
        return {"title": one("title"), "language": one("language"), "authors": many("creator"), "publisher": one("publisher"), "date": one("date"), "description": one("description")}

    def cover(self) -> bytes | None:
        """By the cover-image property, then the cover meta entry, then a manifest id that says so."""
        found = next((i for i in self.items.values() if "cover-image" in (i.get("properties") or "").split()), None)
        if found is None:
            meta = next((m.get("content") for m in self.opf.findall(".//o:meta", _NS) if m.get("name") == "cover"), None)
            found = self.items.get(meta)
        if found is None:
            found = next((i for k, i in self.items.items() if "cover" in k.lower() and (i.get("media-type") or "").startswith("image/")), None)
        return self.zip.read(self._at(found.get("href"))) if found is not None else None

    def toc(self) -> dict[str, str]:
        """href without anchor -> first title of the navigation."""
        out: dict[str, str] = {}
        for item in self.items.values():
            if item.get("media-type") == "application/x-dtbncx+xml":
                for p in ET.fromstring(self.zip.read(self._at(item.get("href")))).iter(f"{{{_NS['n']}}}navPoint"):
                    label, target = p.find("n:navLabel/n:text", _NS), p.find("n:content", _NS)
                    if label is not None and label.text and target is not None:
                        out.setdefault(target.get("src").split("#")[0], label.text.strip())
        return out

    def chapters(self) -> Iterator[tuple[int, str, str | None, str]]:
        """(spine_idx, href, title, markup): titles from the document, else from the navigation."""
        toc = self.toc()
        k = 0
        for ref in self.opf.findall(".//o:spine/o:itemref", _NS):
            item = self.items.get(ref.get("idref"))
            if item is None or "html" not in (item.get("media-type") or ""):
                continue
            markup = self.zip.read(self._at(item.get("href"))).decode("utf-8", "replace")
            yield k, item.get("href"), xhtml.chapter_title(xhtml.parse(markup)) or toc.get(item.get("href")), markup
            k += 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every archive below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")


def chapters(files: DataFrame) -> DataFrame:
    """(path, spine_idx, href, title, xhtml, error): a broken archive gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(path, *c, None) for c in Book(content).chapters()]
                except Exception as e:  # the archive is data: its faults are a result
                    rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}"[:240])]
                yield pd.DataFrame(rows, columns=["path", "spine_idx", "href", "title", "xhtml", "error"]).astype({"spine_idx": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, spine_idx int, href string, title string, xhtml string, error string")


def metadata(files: DataFrame) -> DataFrame:
    """Title, language, authors and the size of the cover of each archive; faults give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    b = Book(content)
                    m, cover = b.metadata(), b.cover()
                    rows.append((path, m["title"], m["language"], m["authors"], m["publisher"], m["date"], m["description"], len(cover) if cover else None))
                except Exception:
                    rows.append((path, None, None, [], None, None, None, None))
            yield pd.DataFrame(rows, columns=["path", "title", "language", "authors", "publisher", "date", "description", "cover_bytes"]).astype({"cover_bytes": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, title string, language string, authors array<string>, publisher string, date string, description string, cover_bytes long")


def segments(files: DataFrame, target_lang: str | None = None) -> DataFrame:
    """Segments of all chapters of all archives."""
    c = chapters(files).where("error IS NULL").withColumn("doc", F.concat_ws("#", "path", "spine_idx"))
    return xhtml.segment_pages(c, "doc", "xhtml", target_lang)
