"""ePub files out of segments (S17): markup is rebuilt per chapter, chapters are bound into volumes.

A volume holds at most VOLUME_CHAPTERS chapters of a project, so that a book of any size is written by many
tasks and none holds more than one volume. Zip entries carry a fixed time: equal input gives equal bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillmill.sources import skeleton, xhtml

VOLUME_CHAPTERS = 200
_STEP = re.compile(r"^(\w+)(?:\[(\d+)\])?$")


def host_tag(path: str | None) -> str:
    """The tag of a host by the last step of its path; p where there is none."""
    m = _STEP.match((path or "").rsplit("/", 1)[-1])
    return m.group(1) if m and m.group(1) in xhtml.BLOCKS else "p"


def host_markup(path: str | None, text: str, tokens: list[dict]) -> str:
    """One host; text whose marks do not fit its skeleton is written plain, without its marks."""
    try:
        inner = xhtml.rebuild(text, tokens)
    except xhtml.BrokenMarks:
        inner = xhtml.rebuild(xhtml.MARK.sub("", text), [])
    tag = host_tag(path)
    return f"<{tag}>{inner}</{tag}>"


def hosts_of(segments: DataFrame) -> DataFrame:
    """Markup of each host: its parts in order, targets where there are any, sources elsewhere."""
    s = segments.select("chapter_id", "idx", "id", "host_path", F.coalesce("target_text", "source_text").alias("text"), skeleton.decode(F.col("inline_skeleton"))["tokens"].alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            markup = [host_markup(p, t or "", [dict(x) for x in k]) for p, t, k in zip(pdf["host_path"], pdf["text"], pdf["tokens"])]
            yield pd.DataFrame({"chapter_id": pdf["chapter_id"], "idx": pdf["idx"], "id": pdf["id"], "markup": markup})

    return s.mapInPandas(run, "chapter_id string, idx int, id string, markup string")


def bind(title: str, lang: str, chapters: list[tuple[str, str | None, str]]) -> bytes:
    """An archive of (href, title, body) chapters."""
    out = io.BytesIO()
    stamp = (2000, 1, 1, 0, 0, 0)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, text: str, how: int = zipfile.ZIP_DEFLATED) -> None:
            info = zipfile.ZipInfo(name, stamp)
            info.compress_type = how
            z.writestr(info, text)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{k}" href="{escape(h)}" media-type="application/xhtml+xml"/>' for k, (h, _, _) in enumerate(chapters))
        spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
        put("book.opf", f'<package version="2.0" xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title><dc:language>{escape(lang)}</dc:language></metadata>'
                        f'<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>')
        points = "".join(f'<navPoint id="n{k}"><navLabel><text>{escape(t or f"{k + 1}")}</text></navLabel><content src="{escape(h)}"/></navPoint>' for k, (h, t, _) in enumerate(chapters))
        put("toc.ncx", f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{points}</navMap></ncx>')
        for h, t, body in chapters:
            head = f"<title>{escape(t)}</title>" if t else ""
            put(h, f'<html xmlns="http://www.w3.org/1999/xhtml" lang="{escape(lang)}" xml:lang="{escape(lang)}"><head>{head}</head><body>{body}</body></html>')
    return out.getvalue()


def volumes(projects: DataFrame, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, volume, path, content): the archives of all projects."""
    body = hosts_of(segments).groupBy("chapter_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id", "markup"))), lambda x: x["markup"]), "").alias("body"))
    from quillmill.operators.reads import chapter_range

    c = chapter_range(chapters, "*").select(F.col("id").alias("chapter_id"), "project_id", "spine_idx", "href", "title", F.floor((F.col("position") - 1) / VOLUME_CHAPTERS).cast("int").alias("volume"))
    rows = c.join(body, "chapter_id", "left").join(projects.select(F.col("id").alias("project_id"), "name", "target_lang"), "project_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["spine_idx", "href"])
        text = lambda x: None if x is None or x != x else x
        parts = [(h, text(t), text(b) or "") for h, t, b in zip(pdf["href"], pdf["title"], pdf["body"])]
        first = pdf.iloc[0]
        data = bind(first["name"], first["target_lang"], parts)
        return pd.DataFrame({"project_id": [first["project_id"]], "volume": [first["volume"]], "path": [f"{first['project_id']}-{first['volume']}.epub"], "content": [data]})

    return rows.groupBy("project_id", "volume").applyInPandas(run, "project_id string, volume int, path string, content binary")
