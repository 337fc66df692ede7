"""Documents, transcripts, pages and other evidence into chunks, facts and proposals."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.prob import clamp
from graphloom.functions.text import name_key
from graphloom.snapshot import Graph

# Chunks ---------------------------------------------------------------------------


def text_chunks(docs: DataFrame, separator: str = "\n\n") -> DataFrame:
    """chunk_id, doc_id, span, text: a text's parts between separators, trimmed, empty ones left out."""
    parts = F.filter(F.transform(F.split("text", re.escape(separator) if separator != "\n\n" else "\n\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    rows = docs.select("doc_id", F.posexplode(parts).alias("n", "text"))
    return rows.select(F.concat_ws("_", "doc_id", "n").alias("chunk_id"), "doc_id", F.concat(F.lit("para_"), "n").alias("span"), "text")


def markdown_chunks(docs: DataFrame) -> DataFrame:
    """A chunk for each section under a '#' heading, with the heading's text; what comes before the first has none."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("head", F.col("t").rlike("^#+ "))
    own = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("section", F.sum(F.col("head").cast("int")).over(own))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line", "t")))), lambda x: x["t"]), "\n")
    title = F.max(F.when(F.col("head"), F.trim(F.regexp_replace("t", "^#+ +", ""))))
    out = lines.groupBy("doc_id", "section").agg(body.alias("text"), title.alias("title"))
    out = out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    return out.select(F.concat_ws("_", "doc_id", "section").alias("chunk_id"), "doc_id", F.concat(F.lit("section_"), "section").alias("span"), "title", "text")


def import_chunks(graph: Graph, chunks: DataFrame, document_base: int, chunk_base: int) -> Graph:
    """graph with a Document for each doc_id, a DocChunk for each new chunk_id, and links of confidence 0.98."""
    chunks = chunks.dropDuplicates(["chunk_id"])
    known = graph.attrs.where("key = 'chunk_id'").select(F.col("value").alias("chunk_id"))
    new = chunks.join(known, "chunk_id", "left_anti").withColumn("cid", F.lit(chunk_base) + F.pmod(F.xxhash64("chunk_id"), F.lit(10**9))).withColumn("did", F.lit(document_base) + F.col("doc_id"))
    docs = new.select("did", F.col("doc_id").cast("string").alias("name")).distinct().join(graph.entities.select(F.col("id").alias("did")), "did", "left_anti")
    entities = docs.select(F.col("did").alias("id"), F.lit("Document").alias("type"), "name").unionByName(new.select(F.col("cid").alias("id"), F.lit("DocChunk").alias("type"), F.col("chunk_id").alias("name")))
    attr = lambda c: new.select(F.col("cid").alias("id"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
    attrs = reduce(DataFrame.unionByName, [attr("chunk_id"), attr("text"), attr("span")])
    edge = lambda rel, a, b: new.select(F.xxhash64(F.lit(rel), a, b).alias("edge_id"), F.lit(rel).alias("rel"), F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(0.98).cast("float").alias("confidence"))
    return graph.add(entities=entities, attrs=attrs, edges=edge("chunkOf", "cid", "did").unionByName(edge("hasChunk", "did", "cid")))


# Conversations --------------------------------------------------------------------------


def chat_turns(docs: DataFrame) -> DataFrame:
    """doc_id, turn, speaker, time, text of 'Speaker (HH:MM): message' lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    rx = r"^\s*([^()\n]+?)\s*\((\d{1,2}:\d{2})\):\s*(.+?)\s*$"
    found = lines.where(F.col("t").rlike(rx)).select("doc_id", "line", F.regexp_extract("t", rx, 1).alias("speaker"), F.regexp_extract("t", rx, 2).alias("time"), F.regexp_extract("t", rx, 3).alias("text"))
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1).alias("turn"), "speaker", "time", "text")


def meeting_turns(docs: DataFrame) -> DataFrame:
    """doc_id, turn, speaker, text: a label in capitals and a colon opens a turn, which further lines go on with."""
    rx = r"^([A-Z][A-Z .'-]*):\s*(.*)$"
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).withColumn("opens", F.col("t").rlike(rx))
    lines = lines.withColumn("turn", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))).where("turn > 0")
    said = F.trim(F.when(F.col("opens"), F.regexp_extract("t", rx, 2)).otherwise(F.col("t")))
    out = lines.groupBy("doc_id", "turn").agg(F.max(F.when(F.col("opens"), F.regexp_extract("t", rx, 1))).alias("speaker"), F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line", said.alias("s")))), lambda x: x["s"]), lambda s: s != ""), " ").alias("text"))
    return out.select("doc_id", (F.col("turn") - 1).alias("turn"), "speaker", "text")


def conversation_chunks(turns: DataFrame) -> DataFrame:
    """chunk_id, conv_id, speaker, text of the turns that are no questions."""
    return turns.where(~F.col("text").endswith("?")).select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "conv_id", F.col("role").alias("speaker"), "text")


TECHNICAL = ("speed", "feed", "tool", "cutting", "temperature", "material", "steel", "titanium", "coolant", "hardness", "pressure", "service", "schema", "query")


def technical_turns(turns: DataFrame, terms: tuple[str, ...] = TECHNICAL) -> DataFrame:
    """turns with the technical terms that they contain, where there are any."""
    found = F.filter(F.array(*map(F.lit, terms)), lambda k: F.contains(F.lower("text"), k))
    return turns.withColumn("terms", found).where(F.size("terms") > 0)


# Pages ----------------------------------------------------------------------------------


def html_text(html: Column) -> Column:
    """A page's text: scripts, styles and tags out, the common entities read, white space narrowed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</(p|div|li|tr|h[1-6])>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, n, href of every link, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""))).alias("n", "href"))


def absolute(base: Column, href: Column) -> Column:
    """A link as a URL: with a scheme, with a host, from the root, or beside the page; fragments and others are null."""
    root = F.regexp_extract(base, r"^(\w+://[^/?#]+)", 1)
    beside = F.concat(root, F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"^\w+://[^/?#]+", ""), r"[?#].*$", ""), r"[^/]*$", ""))
    return F.when(href.rlike("(?i)^https?://"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), href)).when(href.startswith("/"), F.concat(root, href)).when(href.rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None)).otherwise(F.concat(F.when(beside == root, F.concat(root, F.lit("/"))).otherwise(beside), href))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def wiki_sections(pages: DataFrame) -> DataFrame:
    """page_id, n, level, title, text, tables, code_blocks of the sections of HTML under h1 to h6."""
    marked = F.regexp_replace("html", r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", "\u0001$1$2\u0002")
    parts = pages.select("page_id", F.posexplode(F.split(marked, "\u0001")).alias("n", "part")).where("n > 0")
    body = F.regexp_extract("part", "(?s)\u0002(.*)$", 1)
    return parts.select("page_id", "n", F.substring("part", 1, 1).cast("int").alias("level"), html_text(F.regexp_extract("part", "(?s)^.(.*?)\u0002", 1)).alias("title"), html_text(body).alias("text"), F.size(F.regexp_extract_all(body, F.lit(r"(?is)(<table)"))).alias("tables"), F.regexp_extract_all(body, F.lit(r"(?is)<(?:pre|code)[^>]*>(.*?)</(?:pre|code)>")).alias("code_blocks"))


# Facts from text ---------------------------------------------------------------------------
PATTERNS = (
    ("speed", r"(?i)(cutting speed|spindle speed)\s+(?:of|is|should be)\s+(\d+(?:\.\d+)?)\s*(sfm|rpm|m/min)", 0.8),
    ("recommendation", r"(?i)(use|avoid|prefer)\s+(\w+(?: \w+)?)\s+for\s+(\w+)", 0.7),
    ("property", r"(?i)(\w+)\s+has\s+(?:a |an )?(\w+)\s+of\s+(\d+(?:\.\d+)?)", 0.75),
)


def extract_facts(chunks: DataFrame, patterns=PATTERNS, source: str = "source") -> DataFrame:
    """chunk_id, kind, statement, fields, confidence of what patterns find; confidence by the chunk's looks.

    A technical source, an expert, numbers and length raise it or lower it; hedging lowers it.
    """
    out = []
    for kind, rx, base in patterns:
        groups = re.compile(rx.replace("(?i)", "")).groups
        whole = F.regexp_extract_all("text", F.lit(rx), 0)
        fields = F.arrays_zip(whole.alias("statement"), *(F.regexp_extract_all("text", F.lit(rx), i).alias(f"f{i}") for i in range(1, groups + 1)))
        rows = chunks.select("chunk_id", "text", source, F.explode(fields).alias("m"))
        out.append(rows.select("chunk_id", F.lit(kind).alias("kind"), F.col("m.statement").alias("statement"), F.array(*(F.col(f"m.f{i}") for i in range(1, groups + 1))).alias("fields"), F.lit(base).alias("base"), "text", F.col(source).alias("src")))
    f = reduce(DataFrame.unionByName, out)
    factor = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(1.0)
    c = F.col("base") * factor(F.lower("src").rlike("manual|handbook|spec"), 1.1) * factor(F.lower("src").rlike("expert|engineer"), 1.15) * factor(F.octet_length("statement") < 30, 0.9) * factor(F.size(F.regexp_extract_all("statement", F.lit(r"(\d+)"))) >= 2, 1.1) * factor(F.lower("text").rlike(r"\b(maybe|might|perhaps|possibly|probably)\b"), 0.85)
    return f.select("chunk_id", "kind", "statement", "fields", clamp(c).alias("confidence"))


# Proposals -----------------------------------------------------------------------------------


def import_proposals(graph: Graph, entities: DataFrame, relations: DataFrame, base: int) -> Graph:
    """graph with proposed entities (external_id, type, name, confidence) and relations (rel, source, target, confidence).

    An entity is resolved by external id, then by type and name in any case; others, and
    endpoints that nobody proposes, become new ones (stubs of type Entity).
    """
    stubs = relations.select(F.col("source").alias("external_id")).unionByName(relations.select(F.col("target").alias("external_id"))).distinct().join(entities.select("external_id"), "external_id", "left_anti").select("external_id", F.lit("Entity").alias("type"), F.col("external_id").alias("name"))
    wanted = entities.select("external_id", "type", "name").dropDuplicates(["external_id"]).unionByName(stubs)
    by_id = graph.attrs.where("key = 'external_id'").groupBy(F.col("value").alias("external_id")).agg(F.min("id").alias("by_id"))
    by_name = graph.entities.groupBy(F.lower("name").alias("low"), "type").agg(F.min("id").alias("by_name"))
    w = wanted.withColumn("low", F.lower("name")).join(by_id, "external_id", "left").join(by_name, ["low", "type"], "left")
    w = w.withColumn("id", F.coalesce("by_id", "by_name", F.lit(base) + F.pmod(F.xxhash64("external_id"), F.lit(10**9)))).withColumn("new", F.col("by_id").isNull() & F.col("by_name").isNull())
    new = w.where("new").select("id", "type", "name").distinct()
    attrs = new.select("id", F.lit("name").alias("key"), F.col("name").alias("value")).unionByName(w.select("id", F.lit("external_id").alias("key"), F.col("external_id").alias("value")))
    at = w.select("external_id", "id")
    e = relations.join(at.toDF("source", "src"), "source").join(at.toDF("target", "dst"), "target").select(F.xxhash64("rel", "src", "dst").alias("edge_id"), "rel", "src", "dst", F.col("confidence").cast("float").alias("confidence"))
    return graph.add(entities=new, attrs=attrs, edges=e)


def import_embeddings(graph: Graph, rows: DataFrame, dimensions: int) -> DataFrame:
    """id, vector at length one of (type, name, vector) or (chunk_id, vector); rows that nothing answers to are dropped."""
    from graphloom.operators.retrieve import normalized

    if not rows.where(F.size("vector") != dimensions).isEmpty():
        raise ValueError(f"vectors have {dimensions} numbers")
    if "chunk_id" in rows.columns:
        keys = graph.attrs.where("key = 'chunk_id'").select(F.col("value").alias("chunk_id"), "id")
        j = rows.join(keys, "chunk_id")
    else:
        j = rows.join(graph.entities.groupBy("type", "name").agg(F.min("id").alias("id")), ["type", "name"])
    return j.select("id", normalized(F.col("vector")).alias("vector"))


def facts_to_tuples(facts: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """kind, fields (map) of extracted facts (kind, fields array), by the names that each kind's fields have."""
    out = F.lit(None).cast("map<string,string>")
    for kind, names in fields.items():
        out = F.when(F.col("kind") == kind, F.map_from_arrays(F.array(*map(F.lit, names)), F.slice("fields", 1, len(names)))).otherwise(out)
    return facts.select("kind", out.alias("fields"))


def draft_schema(entities: DataFrame, relations: DataFrame, constraints: bool = False) -> DataFrame:
    """rel, source_type, target_type (Entity where several), and, if asked for, which keys and dependencies the rows bear out."""
    kind = entities.select("external_id", "type")
    r = relations.join(kind.toDF("source", "st"), "source", "left").join(kind.toDF("target", "tt"), "target", "left")
    one = lambda c: F.when(F.countDistinct(c) == 1, F.max(c)).otherwise(F.lit("Entity"))
    out = r.groupBy("rel").agg(one("st").alias("source_type"), one("tt").alias("target_type"))
    if constraints:
        fan = lambda a, b, n: r.groupBy("rel", a).agg(F.countDistinct(b).alias("k")).groupBy("rel").agg((F.max("k") == 1).alias(n))
        out = out.join(fan("source", "target", "functional"), "rel").join(fan("target", "source", "inverse_functional"), "rel")
        pairs = r.groupBy("rel", "source", "target").agg(F.count("*").alias("k")).groupBy("rel").agg((F.max("k") == 1).alias("key"))
        out = out.join(pairs, "rel")
    return out


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """df with a column `unique_name`: the name's key, and from its second owner on a number."""
    k = df.withColumn("__k", name_key(F.col(name)))
    n = F.row_number().over(Window.partitionBy("__k").orderBy(order))
    return k.withColumn("unique_name", F.when(n == 1, F.col("__k")).otherwise(F.concat_ws("_", "__k", n.cast("string")))).drop("__k")


# Triples, DDL, JSON and other formats ------------------------------------------------------------
_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*(<[^>]*>)?\s*\.\s*$'


def ntriples(lines: DataFrame) -> DataFrame:
    """subject, predicate, object, is_literal, graph of N-Triples or N-Quads lines (value)."""
    ok = lines.where(F.col("value").rlike(_TRIPLE) & ~F.trim("value").startswith("#"))
    part = lambda i: F.regexp_extract("value", _TRIPLE, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    o = part(3)
    literal = o.startswith('"')
    return ok.select(bare(part(1)).alias("subject"), part(2).alias("predicate"), F.when(literal, F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(bare(o)).alias("object"), literal.alias("is_literal"), F.nullif(bare(part(4)), F.lit("")).alias("graph"))


def turtle(spark: SparkSession, text: str) -> DataFrame:
    """The same of small Turtle or TriG text: prefixes, 'a', lists by ';' and ',', and named graphs."""
    prefixes = dict(re.findall(r"@?prefix\s+([\w-]*):\s*<([^>]*)>", text, re.I))
    body = re.sub(r"(?mi)^\s*@?(prefix|base)\b.*$", "", re.sub(r"(?m)(^|\s)#.*$", "", text))
    tokens = re.findall(r'<[^>]*>|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|[\w-]*:[\w./-]*[\w/-]|[{};,.]|\ba\b|[-\d.]+\d|_:\w+', body)
    full = lambda t: "http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if t == "a" else t[1:-1] if t[0] == "<" else re.match(r'"((?:[^"\\]|\\.)*)"', t)[1] if t[0] == '"' else prefixes[t.split(":")[0]] + t.split(":", 1)[1] if ":" in t and t.split(":")[0] in prefixes else t
    rows, graph, s, p, held = [], None, None, None, []
    for i, t in enumerate(tokens):
        if t == "{":
            graph, s, p = full(held.pop()) if held else None, None, None
            s = None
        elif t == "}":
            graph, s, p, held = None, None, None, []
        elif t == ".":
            s, p, held = None, None, []
        elif t == ";":
            p = None
        elif t == ",":
            continue
        elif s is None:
            if i + 1 < len(tokens) and tokens[i + 1] == "{":
                held = [t]
            else:
                s = full(t)
        elif p is None:
            p = full(t)
        else:
            rows.append((s, p, full(t), t[0] == '"', graph))
    return spark.createDataFrame(rows, "subject string, predicate string, object string, is_literal boolean, graph string")


def triples_to_proposals(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (by rdf:type; label or the last part of the IRI as name) and relations of triples."""
    rdf_type, label = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://www.w3.org/2000/01/rdf-schema#label"
    last = lambda c: F.regexp_extract(c, r"([^/#]+)[/#]?$", 1)
    kinds = triples.where(F.col("predicate") == rdf_type).groupBy("subject").agg(F.min("object").alias("t"))
    labels = triples.where(F.col("predicate") == label).groupBy("subject").agg(F.min("object").alias("l"))
    entities = triples.select("subject").distinct().join(kinds, "subject", "left").join(labels, "subject", "left").select(F.col("subject").alias("external_id"), F.coalesce(last("t"), F.lit("Entity")).alias("type"), F.coalesce("l", last("subject")).alias("name"), F.lit(0.9).alias("confidence"))
    relations = triples.where((~F.col("is_literal")) & (F.col("predicate") != rdf_type)).select(last("predicate").alias("rel"), F.col("subject").alias("source"), F.col("object").alias("target"), F.lit(0.9).alias("confidence"), "graph")
    return entities, relations


def parse_ddl(sql: str) -> dict:
    """Tables with their columns, keys and references, of CREATE TABLE statements."""
    out: dict = {}
    for name, body in re.findall(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)[\"`]?\s*\((.*?)\)\s*(?:;|$)", sql):
        t = out.setdefault(name, {"columns": [], "primary_key": [], "unique": [], "foreign_keys": []})
        for item in re.split(r",(?![^()]*\))", body):
            item = item.strip()
            cols = lambda s: [c.strip(' "`') for c in s.split(",")]
            if m := re.match(r"(?is)(?:constraint\s+\w+\s+)?primary\s+key\s*\(([^)]*)\)", item):
                t["primary_key"] = cols(m[1])
            elif m := re.match(r"(?is)(?:constraint\s+\w+\s+)?unique\s*\(([^)]*)\)", item):
                t["unique"].append(cols(m[1]))
            elif m := re.match(r"(?is)(?:constraint\s+\w+\s+)?foreign\s+key\s*\(([^)]*)\)\s*references\s+[\"`]?([\w.]+)[\"`]?\s*\(([^)]*)\)", item):
                t["foreign_keys"].append((cols(m[1]), m[2], cols(m[3])))
            elif m := re.match(r"(?is)[\"`]?(\w+)[\"`]?\s+(\w+(?:\([^)]*\))?)(.*)$", item):
                t["columns"].append((m[1], m[2].lower(), "not null" not in m[3].lower() and "primary key" not in m[3].lower()))
                if "primary key" in m[3].lower():
                    t["primary_key"] = [m[1]]
                if re.search(r"(?i)\bunique\b", m[3]):
                    t["unique"].append([m[1]])
                if r := re.search(r"(?i)references\s+[\"`]?([\w.]+)[\"`]?\s*\(([^)]*)\)", m[3]):
                    t["foreign_keys"].append(([m[1]], r[1], cols(r[2])))
    return out


def json_schema_of(value, root: str = "Root") -> dict[str, dict[str, str]]:
    """Types and their fields of a JSON value; an array is judged by its first element."""
    out: dict[str, dict[str, str]] = {}

    def kind(v, name: str) -> str:
        if isinstance(v, bool):
            return "Bool"
        if isinstance(v, (int, float)):
            return "Number"
        if isinstance(v, str):
            return "Text"
        if v is None:
            return "Null"
        if isinstance(v, list):
            return f"List[{kind(v[0], name) if v else 'Unknown'}]"
        own = name[:1].upper() + name[1:]
        out.setdefault(own, {}).update({k: kind(x, k) for k, x in v.items()})
        return own

    kind(json.loads(value) if isinstance(value, str) else value, root)
    return out


def bibtex(text: str) -> list[dict[str, str]]:
    """Entries of a bibliography: kind, key and fields."""
    out = []
    for kind, key, body in re.findall(r"(?s)@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\s*\}", text):
        fields = {k.lower(): (a or b).strip() for k, a, b in re.findall(r'(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|"([^"]*)")', body)}
        out.append({"kind": kind.lower(), "key": key, **fields})
    return out


def reading_list(text: str) -> list[dict[str, str]]:
    """Lines '- Title by Author (Year): note'."""
    rx = re.compile(r"^\s*[-*\d.]+\s+\"?(.+?)\"?\s+by\s+(.+?)(?:\s+\((\d{4})\))?(?::\s*(.*))?$")
    return [dict(zip(("title", "author", "year", "note"), m.groups(""))) for line in text.splitlines() if (m := rx.match(line))]


def descriptor_rows(descriptor: dict) -> tuple[list[tuple], list[tuple]]:
    """Entities (kind, name) and edges (rel, source, target) of a protobuf descriptor set in JSON."""
    entities, edges = [], []
    for f in descriptor.get("file", []):
        package = f.get("package", "")
        q = lambda n: f"{package}.{n}" if package else n  # noqa: B023, E731
        entities.append(("File", f["name"]))
        for m in f.get("messageType", []):
            entities.append(("Message", q(m["name"])))
            edges.append(("declares", f["name"], q(m["name"])))
            for x in m.get("field", []):
                entities.append(("Field", f"{q(m['name'])}.{x['name']}"))
                edges.append(("hasField", q(m["name"]), f"{q(m['name'])}.{x['name']}"))
                if x.get("typeName"):
                    edges.append(("fieldType", f"{q(m['name'])}.{x['name']}", x["typeName"].lstrip(".")))
        for s in f.get("service", []):
            entities.append(("Service", q(s["name"])))
            edges.append(("declares", f["name"], q(s["name"])))
            for r in s.get("method", []):
                name = f"{q(s['name'])}.{r['name']}"
                entities.append(("Rpc", name))
                edges += [("hasRpc", q(s["name"]), name), ("takes", name, r["inputType"].lstrip(".")), ("returns", name, r["outputType"].lstrip("."))]
    return entities, edges


def index_repository(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, symbol, line) that source files (path, text) define, and (path, imported)."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    define = r"^\s*(?:pub\s+|export\s+|async\s+|public\s+|static\s+)*(?:def|class|fn|func|function|struct|enum|trait|interface|type)\s+([A-Za-z_]\w*)"
    use = r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+)|use\s+([\w:]+)|#include\s+[<\"]([^>\"]+))"
    symbols = lines.where(F.col("t").rlike(define)).select("path", F.regexp_extract("t", define, 1).alias("symbol"), "line")
    imports = lines.where(F.col("t").rlike(use)).select("path", F.concat(*(F.regexp_extract("t", use, i) for i in range(1, 5))).alias("imported")).distinct()
    return symbols, imports


def synthetic_graph(spark: SparkSession, n: int, edges_per_entity: int, labels: int, seed: int = 1) -> Graph:
    """A random graph: Nodes node_i, labels rel_j, confidence 0.9; the same for the same numbers."""
    entities = spark.range(n).select("id", F.lit("Node").alias("type"), F.concat(F.lit("node_"), "id").alias("name"))
    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(edges_per_entity - 1))).alias("k"))
    e = e.select((F.col("src") * edges_per_entity + F.col("k")).alias("edge_id"), F.concat(F.lit("rel_"), F.pmod(F.xxhash64("src", "k", F.lit(seed)), F.lit(labels))).alias("rel"), "src", F.pmod(F.xxhash64("k", "src", F.lit(seed + 1)), F.lit(n)).alias("dst"), F.lit(0.9).cast("float").alias("confidence"))
    return Graph.of(spark, entities=entities, edges=e)


def export_text(graph: Graph, path: str) -> None:
    """The whole graph as lines 'table<TAB>json'; floats keep their bits, as numbers that read back alike."""
    from graphloom.snapshot import TABLES

    out = None
    for name in TABLES:
        t = getattr(graph, name)
        if name == "edges":
            t = t.withColumn("confidence", F.hex(F.col("confidence").cast("double").cast("string").cast("binary")))
        part = t.select(F.concat(F.lit(name + "\t"), F.to_json(F.struct("*"))).alias("value"))
        out = part if out is None else out.unionByName(part)
    out.write.mode("overwrite").text(path)


def import_text(spark: SparkSession, path: str) -> Graph:
    from graphloom.snapshot import TABLES

    lines = spark.read.text(path)
    tables = {}
    for name, schema in TABLES.items():
        own = schema.replace("confidence float", "confidence string")
        t = lines.where(F.col("value").startswith(name + "\t")).select(F.from_json(F.expr(f"substring(value, {len(name) + 2})"), own).alias("x")).select("x.*")
        tables[name] = t if name != "edges" else t.withColumn("confidence", F.unhex("confidence").cast("string").cast("double").cast("float"))
    return Graph.of(spark, **tables)
