"""HTML pages to document rows: title, breadcrumb, Markdown text, links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import content_hash
from weftgraph.session import materialize

#: Content roots in order of preference: (tag, attribute, value); a class matches as one of the words.
ROOTS = (("div", "id", "main-content"), ("div", "class", "wiki-content"))
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "table", "tr", "blockquote", "pre", "ul", "ol", "header", "footer", "main", "dl", "dt", "dd", "figure"}
PARSED = "struct<heading: string, title: string, breadcrumb: array<string>, markdown: string, hrefs: array<struct<url: string, text: string>>>"


class _Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else ("" if c.tag in ("script", "style") else c.text()) for c in self.children)

    def find(self, test):
        stack = [self]
        while stack:
            node = stack.pop()
            if test(node):
                return node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
        return None

    def all(self, tag: str):
        stack = [self]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                yield node
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        if tag == "li":  # items close each other
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in ("ul", "ol"):
                    break
                if self.open[k].tag == "li":
                    del self.open[k:]
                    break
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _markdown(node: _Node, depth: int = 0) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        tag = c.tag
        if tag in ("script", "style"):
            continue
        if tag == "pre":
            out.append("\n\n```\n" + c.text().strip("\n") + "\n```\n\n")
            continue
        if tag in ("ul", "ol"):
            items = [x for x in c.children if not isinstance(x, str) and x.tag == "li"]
            lines = []
            for n, item in enumerate(items, 1):
                mark = f"{n}. " if tag == "ol" else "- "
                body = re.sub(r"\n{2,}", "\n", _markdown(item, depth + 1)).strip()
                lines.append("  " * depth + mark + body)
            out.append(("\n" if depth else "\n\n") + "\n".join(lines) + ("\n" if depth else "\n\n"))
            continue
        inner = _markdown(c, depth)
        if re.fullmatch(r"h[1-6]", tag):
            out.append("\n\n" + "#" * int(tag[1]) + " " + inner.strip() + "\n\n")
        elif tag == "br":
            out.append("\n")
        elif tag == "hr":
            out.append("\n\n---\n\n")
        elif tag in ("b", "strong") and inner.strip():
            out.append(f"**{inner.strip()}**")
        elif tag in ("i", "em") and inner.strip():
            out.append(f"*{inner.strip()}*")
        elif tag == "code":
            out.append(f"`{inner}`")
        elif tag == "a" and c.attrs.get("href") and inner.strip():
            out.append(f"[{inner.strip()}]({c.attrs['href']})")
        elif tag in ("td", "th"):
            out.append(inner.strip() + " | ")
        elif tag in BLOCKS:
            out.append(f"\n\n{inner.strip()}\n\n")
        else:
            out.append(inner)
    return "".join(out)


def parse_html(page: str | None, roots=ROOTS) -> tuple:
    """(heading, title, breadcrumb, markdown, [(url, text)]) of one page; null or broken pages give empty parts."""
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    root = tree.root
    h1 = root.find(lambda n: n.tag == "h1" and n.attrs.get("id") == "title-heading")
    span = h1.find(lambda n: n.tag == "span" and n.attrs.get("id") == "title-text") if h1 else None
    title = root.find(lambda n: n.tag == "title")
    crumbs = root.find(lambda n: n.tag == "ol" and n.attrs.get("id") == "breadcrumbs")
    content = None
    for tag, attr, value in roots:
        content = root.find(lambda n, t=tag, a=attr, v=value: n.tag == t and (v is None or v in n.attrs.get(a, "").split()))
        if content:
            break
    hrefs = [(a.attrs["href"], a.text().strip()) for a in content.all("a") if a.attrs.get("href")] if content else []
    markdown = _markdown(content) if content else ""
    return ((span or h1).text().strip() if h1 else None, title.text().strip() if title else None, [a.text().strip() for a in crumbs.all("a")] if crumbs else [], markdown, hrefs)


_FENCE = re.compile(r"\s*(```+|~~~+)")
_HEADING = re.compile(r"(#{1,6})[ \t]+(.*)")
_ITEM = re.compile(r"([ \t]*)(?:[-*+]|(\d+)[.)])[ \t]+(.*)")
_RULE = re.compile(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*")


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def page_body(text: str | None) -> str:
    """The HTML of a Markdown text: headings, lists, tables and fences become elements, all else escaped paragraphs."""
    out, held, lists = [], [], []  # lists: open ones as [indent, tag, last number]
    lines = (text or "").split("\n")

    def flush():
        if held:
            out.append("<p>" + "<br>".join(held) + "</p>")
            held.clear()

    def close(indent: int = -1):
        while lists and lists[-1][0] > indent:
            out.append(f"</li></{lists.pop()[1]}>")

    at = 0
    while at < len(lines):
        line = lines[at].rstrip("\r")
        at += 1
        if m := _FENCE.match(line):
            flush()
            close()
            code = []
            while at < len(lines) and not lines[at].strip().startswith(m[1]):
                code.append(lines[at])
                at += 1
            at += 1
            note = line[m.end() :].strip()  # the language, or whatever stands behind the mark
            out.append((f"<p>{_escape(note)}</p>" if note else "") + "<pre><code>" + _escape("\n".join(code)) + "</code></pre>")
        elif m := _HEADING.fullmatch(line):
            flush()
            close()
            out.append(f"<h{len(m[1])}>{_escape(m[2])}</h{len(m[1])}>")
        elif line.lstrip().startswith("|"):
            flush()
            close()
            rows = [line]
            while at < len(lines) and lines[at].lstrip().startswith("|"):
                rows.append(lines[at])
                at += 1
            cells = [[_escape(c.strip()) for c in r.strip().removeprefix("|").removesuffix("|").split("|")] for n, r in enumerate(rows) if n != 1 or not _RULE.fullmatch(r)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table>")
        elif (m := _ITEM.fullmatch(line)) and (m[2] is None or int(m[2][:9]) == 1 or any(x[0] == len(m[1]) and x[2] + 1 == int(m[2][:9]) for x in lists)):
            flush()
            indent, tag = len(m[1].expandtabs(4)), "ol" if m[2] else "ul"
            close(indent)
            if lists and lists[-1][0] == indent and lists[-1][1] != tag:
                close(indent - 1)
            if lists and lists[-1][0] == indent:
                out.append("</li>")
                lists[-1][2] = int(m[2][:9]) if m[2] else 0
            else:
                out.append(f"<{tag}>")
                lists.append([indent, tag, int(m[2][:9]) if m[2] else 0])
            out.append("<li>" + _escape(m[3]))
        elif not line.strip():
            flush()
        elif lists and line[0] in " \t":
            out.append("<br>" + _escape(line.strip()))
        else:
            close()
            held.append(_escape(line))
    flush()
    close()
    return "".join(out)


def document_id(file: Column) -> Column:
    """The number before .html, else the file's stem."""
    number = F.regexp_extract(file, r"_(\d+)\.html$", 1)
    return F.coalesce(F.when(number != "", number), F.regexp_replace(file, r"\.[^.]*$", ""))


def page_title(heading: Column, title: Column) -> Column:
    """Heading, else title, else a fixed text; what stands before the first colon goes if anything is left."""
    filled = F.coalesce(F.when(heading != "", heading), F.when(title != "", title), F.lit("Untitled Document"))
    rest = F.trim(F.substring(filled, F.instr(filled, ":") + 1, F.length(filled)))
    return F.when((F.instr(filled, ":") > 0) & (rest != ""), rest).otherwise(F.trim(filled))


def clean_markdown(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def link_type(url: Column) -> Column:
    """external, internal, or null for what is dropped (empty, anchors, anything else)."""
    kept = (url != "") & ~url.startswith("#")
    return F.when(kept & (url.startswith("http://") | url.startswith("https://")), "external").when(kept & url.endswith(".html"), "internal")


def parse_pages(pages: DataFrame, file: str, page: str, keep: list[str] = (), roots=ROOTS) -> DataFrame:
    """Document rows of HTML pages: one Arrow pass over the page column, everything else built in.

    A null page gives an empty document. Rows are neither merged nor dropped.
    """
    def each(values: pd.Series) -> pd.DataFrame:
        rows = [parse_html(v, roots) for v in values]
        frame = pd.DataFrame(rows, columns=["heading", "title", "breadcrumb", "markdown", "hrefs"])
        frame["hrefs"] = [[{"url": u, "text": t} for u, t in h] for h in frame["hrefs"]]
        return frame

    parsed = pages.select(*keep, F.col(file).alias("source_file"), F.pandas_udf(each, PARSED)(F.col(page)).alias("p"))
    links = F.filter(F.transform("p.hrefs", lambda h: F.struct(h["url"].alias("url"), h["text"].alias("text"), link_type(h["url"]).alias("link_type"))), lambda x: x["link_type"].isNotNull())
    text = clean_markdown(F.col("p.markdown"))
    return parsed.select(*keep, document_id(F.element_at(F.split("source_file", "/"), -1)).alias("doc_id"), page_title(F.col("p.heading"), F.col("p.title")).alias("title"), text.alias("text"), F.col("p.breadcrumb").alias("breadcrumb"), links.alias("links"), content_hash(text).alias("content_hash"), "source_file")


def link_rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode("links").alias("l")).select("doc_id", "l.url", "l.text", "l.link_type")


def _read(files: DataFrame, roots) -> DataFrame:
    """Document rows with parsed_at and ``problem``: a file that is no UTF-8 is an empty document with a problem, and stops nothing."""
    page = F.expr("if(is_valid_utf8(cast(content as string)), cast(content as string), null)")
    pages = files.select("path", page.alias("page"), F.current_timestamp().alias("parsed_at")).withColumn("problem", F.when(F.col("page").isNull(), "not UTF-8"))
    return parse_pages(pages, "path", "page", ["parsed_at", "problem"], roots)


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.html", roots=ROOTS) -> DataFrame:
    """Pages of a folder (not of its subfolders), with ``problem``; a missing folder raises as Spark does."""
    return _read(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder), roots)


def read_files(spark: SparkSession, paths: list[str], roots=ROOTS) -> DataFrame:
    """The pages of a list of files, with ``problem``; a file that is missing raises as Spark does."""
    return _read(spark.read.format("binaryFile").load(paths), roots)


def markdown_files(documents: DataFrame) -> DataFrame:
    """(doc_id, body): the Markdown export of each document, with its header."""
    field = lambda label, value: F.concat(F.lit(f"**{label}:** "), F.coalesce(value, F.lit("")))
    head = F.concat(field("Document ID", F.col("doc_id")), F.lit("  \n"), field("Source", F.col("source_file")), F.lit("  \n"), field("Breadcrumb", F.array_join("breadcrumb", " → ")), F.lit("  \n"), field("Content Hash", F.col("content_hash")))
    return documents.select("doc_id", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), head, F.lit("\n\n---\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("body"))


def write_markdown(documents: DataFrame, folder: str) -> DataFrame:
    """One file ``<doc_id>.md`` a document under ``folder`` (shared by all executors), written by the tasks that hold them: (file). Characters a file name can't have become _."""
    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            names = [re.sub(r"[^\w.-]", "_", d) + ".md" for d in batch.column(0).to_pylist()]
            for name, body in zip(names, batch.column(1).to_pylist()):
                with fs.open_output_stream(f"{base}/{name}") as out:  # a task that runs again writes the same file again
                    out.write(body.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return materialize(markdown_files(documents.filter("doc_id IS NOT NULL")).mapInArrow(run, "file string"), "files")


def index_records(documents: DataFrame) -> DataFrame:
    """(doc_id, record): JSON of doc_id, text and metadata; the document's own metadata stand beside title, links and the like, and win where a name is the same."""
    time = F.date_format("parsed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if "parsed_at" in documents.columns else F.lit(None).cast("string")
    links = F.col("links") if "links" in documents.columns else F.lit(None).cast("array<struct<url:string,text:string,link_type:string>>")
    own = {"title": F.to_json(F.array("title")), "breadcrumb": F.to_json(F.array("breadcrumb")), "links": F.to_json(F.array(links)), "content_hash": F.to_json(F.array("content_hash")), "source_file": F.to_json(F.array("source_file")), "parsed_at": F.to_json(F.array(time))}
    more = F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")) if "metadata" in documents.columns else F.expr("cast(map() as map<string,string>)")
    inner = lambda v: F.substring(v, 2, F.length(v) - 2)  # noqa: E731  [x] to x
    own = {k: inner(v) for k, v in own.items()}
    fixed = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in own.items())), lambda e: ~F.map_contains_key(more, e["k"]))
    extra = F.transform(F.map_entries(more), lambda e: F.struct(e["key"].alias("k"), inner(F.to_json(F.array(e["value"]))).alias("v")))
    pairs = F.transform(F.concat(fixed, extra), lambda e: F.concat(inner(F.to_json(F.array(e["k"]))), F.lit(":"), e["v"]))
    head = F.to_json(F.struct("doc_id", "text"))
    return documents.select("doc_id", F.concat(F.substring(head, 1, F.length(head) - 1), F.when(F.length(head) > 2, ",").otherwise(""), F.lit('"metadata":{'), F.array_join(pairs, ","), F.lit("}}")).alias("record"))


def corpus_summary(documents: DataFrame) -> DataFrame:
    """One row: documents, links, characters."""
    return documents.agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.size("links"), F.lit(0))).alias("n_links"), F.sum(F.char_length("text")).alias("n_chars"))
