"""Readers of documents in archives and markup: DOCX, EPUB, HTML, Markdown and text, each file one row.

Files come through the binaryFile source, so the listing, splitting and retries are Spark's. A file that cannot be read
is a row with an error instead of a failure. Archives are checked before they are unpacked: number of members, size of
each and of all, paths that leave the archive, encryption.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS, MEMBER_BYTES, TOTAL_BYTES = 10_000, 128 << 20, 1 << 30  # limits of an archive
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modified, size, content, digest of each file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("digest"))


def archive_error(data: bytes) -> str | None:
    """What is wrong with an archive, or None."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > MEMBERS:
                return "too many members"
            if any(i.flag_bits & 1 for i in infos) or _locked(z):
                return "encrypted"
            if any(i.file_size > MEMBER_BYTES for i in infos) or sum(i.file_size for i in infos) > TOTAL_BYTES:
                return "too large"
            for i in infos:
                name = i.filename.replace("\\", "/")
                if name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"):
                    return "unsafe path"
    except (zipfile.BadZipFile, OSError, ValueError):
        return "not an archive"
    return None


def _locked(z: zipfile.ZipFile) -> bool:
    """Whether an EPUB's list of encrypted members names any but fonts."""
    if "META-INF/encryption.xml" not in z.namelist():
        return False
    try:
        named = [e.get("URI", "") for e in ElementTree.fromstring(z.read("META-INF/encryption.xml")).iter() if e.tag.rsplit("}", 1)[-1] == "CipherReference"]
    except ElementTree.ParseError:
        return True
    return any(not n.lower().endswith((".otf", ".ttf", ".woff", ".woff2")) for n in named)


class _Markdown(HTMLParser):
    """Markdown of HTML: headings, paragraphs, lists, quotes, code, tables, links, images, emphasis."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.href: list[str | None] = []
        self.pre = 0
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.rows = 0

    def put(self, s: str) -> None:
        (self.cell if self.cell is not None else self.out).append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head", "nav", "template"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "section", "figure"):
            self.put("\n\n")
        elif tag == "br":
            self.put("\n")
        elif tag in ("ul", "ol"):
            self.put("\n\n" if not self.lists else "")
            self.lists.append([tag, 0])
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] == "ol" else "-"
            self.put("\n" + "  " * depth + mark + " ")
        elif tag == "blockquote":
            self.put("\n\n> ")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a":
            self.href.append(a.get("href"))
            if a.get("href"):
                self.put("[")
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "table":
            self.put("\n\n")
            self.rows = 0
        elif tag == "tr":
            self.row = []
        elif tag in ("td", "th"):
            self.cell = []
        elif tag == "hr":
            self.put("\n\n---\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "nav", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "article", "section", "blockquote", "table"):
            self.put("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.put("\n\n" if not self.lists else "")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "a" and self.href and (href := self.href.pop()):
            self.put(f"]({href})")
        elif tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.cell).split()).replace("|", "\\|")
            self.cell = None
            if self.row is not None:
                self.row.append(text)
        elif tag == "tr" and self.row is not None:
            row, self.row = self.row, None
            self.put("| " + " | ".join(row) + " |\n")
            if not self.rows:
                self.put("|" + "---|" * len(row) + "\n")
            self.rows += 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))

    def text(self) -> str:
        out, code = [], False
        for x in "".join(self.out).split("\n"):
            code ^= x.startswith("```")
            out.append(x.rstrip() if code or x.lstrip().startswith(("-", "1")) else x.strip())
        return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def html_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    p.close()
    return p.text()


def docx_markdown(data: bytes) -> str:
    """Paragraphs, headings, lists and tables of a DOCX file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def inline(p: ElementTree.Element) -> str:
        out = []
        for r in p.iter(f"{_W}r"):
            t = "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in r)
            props = r.find(f"{_W}rPr")
            if t.strip() and props is not None:
                if props.find(f"{_W}b") is not None:
                    t = f"**{t}**"
                if props.find(f"{_W}i") is not None:
                    t = f"*{t}*"
            out.append(t)
        return "".join(out)

    blocks = []
    for x in body if body is not None else []:
        if x.tag == f"{_W}p":
            text = inline(x)
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if not text.strip():
                continue
            if m := re.match(r"[Hh]eading\s*(\d)", name):
                text = "#" * min(int(m.group(1)), 6) + " " + text
            elif name == "Title":
                text = "# " + text
            elif x.find(f"{_W}pPr/{_W}numPr") is not None:
                text = "- " + text
            blocks.append(text)
        elif x.tag == f"{_W}tbl":
            rows = [[" ".join(inline(p) for p in c.iter(f"{_W}p")).replace("|", "\\|") for c in r.iter(f"{_W}tc")] for r in x.iter(f"{_W}tr")]
            if rows:
                blocks.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return "\n\n".join(blocks)


def epub_parts(data: bytes) -> tuple[list[tuple], list[str]]:
    """(spine order, path, Markdown) of an EPUB's chapters, and what its package lacks."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    faults = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        base, package = _package(z)
        items = {e.get("id"): posixpath.normpath(posixpath.join(base, e.get("href", ""))) for e in package.iter() if local(e) == "item"}
        faults += [f"missing file {p}" for p in items.values() if p not in names]
        chapters = []
        for n, e in enumerate(e for e in package.iter() if local(e) == "itemref"):
            path = items.get(e.get("idref"))
            if path is None:
                faults.append(f"spine names unknown item {e.get('idref')}")
            elif path in names:
                chapters.append((n, path, html_markdown(z.read(path).decode("utf-8", "replace"))))
    return chapters, faults


def _package(z: zipfile.ZipFile) -> tuple[str, ElementTree.Element]:
    """The folder and the root of an EPUB's package."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    root = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in root.iter() if local(e) == "rootfile")
    return posixpath.dirname(opf), ElementTree.fromstring(z.read(opf))


def epub_metadata(data: bytes) -> dict[str, list[str]]:
    """The values of each Dublin Core field of an EPUB, in order; blank ones are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        _, package = _package(z)
    out: dict[str, list[str]] = {}
    for e in package.iter():
        if e.tag.startswith("{http://purl.org/dc/elements/1.1/}") and (text := " ".join("".join(e.itertext()).split())):
            out.setdefault(e.tag.rsplit("}", 1)[-1], []).append(text)
    return out


def epub_navigation(data: bytes) -> list[tuple[int, str, str, str]]:
    """(depth, label, member, fragment) of an EPUB's table of contents: of its navigation document, else of its NCX; empty where it has neither."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    flat = lambda e: " ".join("".join(e.itertext()).split())

    def link(base: str, target: str) -> tuple[str, str]:
        path, _, fragment = target.partition("#")
        return posixpath.normpath(posixpath.join(base, path)) if path else "", fragment

    out: list[tuple[int, str, str, str]] = []

    def listed(node: ElementTree.Element, depth: int, base: str) -> None:
        for item in node:
            if local(item) == "ol":
                listed(item, depth, base)
            elif local(item) == "li":
                for e in item:
                    if local(e) in ("a", "span"):
                        out.append((depth, flat(e), *link(base, e.get("href", ""))))
                    elif local(e) == "ol":
                        listed(e, depth + 1, base)

    def points(node: ElementTree.Element, depth: int, base: str) -> None:
        for p in node:
            if local(p) == "navPoint":
                label = next((flat(x) for x in p if local(x) == "navLabel"), "")
                target = next((x.get("src", "") for x in p if local(x) == "content"), "")
                out.append((depth, label, *link(base, target)))
                points(p, depth + 1, base)

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        folder, package = _package(z)
        items = [e for e in package.iter() if local(e) == "item"]
        for nav in (e for e in items if "nav" in (e.get("properties") or "").split()):
            member = posixpath.normpath(posixpath.join(folder, nav.get("href", "")))
            doc = ElementTree.fromstring(z.read(member))
            found = [e for e in doc.iter() if local(e) == "nav"]
            kinds = [next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "type"), "") for e in found]
            for e, kind in zip(found, kinds):
                if kind == "toc" or ("toc" not in kinds and e is found[0]):
                    listed(e, 0, posixpath.dirname(member))
        if not out:
            spine = next((e for e in package.iter() if local(e) == "spine"), None)
            named = spine.get("toc") if spine is not None else None
            for ncx in (e for e in items if e.get("id") == named or e.get("media-type") == "application/x-dtbncx+xml"):
                member = posixpath.normpath(posixpath.join(folder, ncx.get("href", "")))
                for m in (e for e in ElementTree.fromstring(z.read(member)).iter() if local(e) == "navMap"):
                    points(m, 0, posixpath.dirname(member))
                break
    return out


def books(archives: DataFrame) -> DataFrame:
    """path, kind, place, depth, label, value: metadata (kind meta) and contents entries (kind nav) of each EPUB.

    archives: path, content. Archives that cannot be read, and parts that they lack, give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in b.itertuples(index=False):
                raw = bytes(data)
                if archive_error(raw) is not None:
                    continue
                try:
                    rows += [(p, "meta", i, 0, name, v) for name, values in sorted(epub_metadata(raw).items()) for i, v in enumerate(values)]
                    rows += [(p, "nav", i, depth, label, f"{member}#{fragment}" if fragment else member) for i, (depth, label, member, fragment) in enumerate(epub_navigation(raw))]
                except (KeyError, StopIteration, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "kind", "place", "depth", "label", "value"])

    rows = archives.where("path is not null and content is not null").select("path", "content")
    return rows.mapInPandas(run, "path string, kind string, place int, depth int, label string, value string")


def to_markdown(path: str, data: bytes) -> str:
    """A file's Markdown, by its extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("docx", "epub") and (fault := archive_error(data)):
        raise ValueError(fault)
    if kind == "docx":
        return docx_markdown(data)
    if kind == "epub":
        return "\n\n".join(t for _, _, t in epub_parts(data)[0])
    text = data.decode("utf-8-sig")
    return html_markdown(text) if kind in ("html", "htm", "xhtml") else text


def read_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, digest, markdown, error of each file: exactly one of markdown and error is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, digest, data in b.itertuples(index=False):
                try:
                    rows.append((p, digest, to_markdown(p, bytes(data)), None))
                except Exception as e:  # noqa: BLE001 - a bad file is a row
                    rows.append((p, digest, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "digest", "markdown", "error"])

    return files(spark, path, pattern).select("path", "digest", "content").mapInPandas(run, "path string, digest string, markdown string, error string")


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """path, chapter_no, member, markdown of each chapter of each EPUB below a folder; unreadable ones give nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in b.itertuples(index=False):
                if archive_error(bytes(data)) is None:
                    try:
                        rows += [(p, *c) for c in epub_parts(bytes(data))[0]]
                    except (KeyError, StopIteration, ElementTree.ParseError):
                        continue
            yield pd.DataFrame(rows, columns=["path", "chapter_no", "member", "markdown"])

    return files(spark, path, "*.epub").select("path", "content").mapInPandas(run, "path string, chapter_no int, member string, markdown string")


def local_images(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, target, present: the local images that a text names, and whether the file table (path) has them."""
    found = F.regexp_extract_all(text, F.lit(r"!\[[^\]\n]*\]\(<?([^)>\n]+)>?\)"), F.lit(1))
    refs = df.select(key, F.explode(found).alias("target")).where(~F.regexp_like("target", F.lit("^[a-z]+:"))).distinct()
    return refs.join(known.select(F.col("path").alias("target")).distinct().withColumn("present", F.lit(True)), "target", "left").select(key, "target", F.coalesce("present", F.lit(False)).alias("present"))
