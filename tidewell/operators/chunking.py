"""From files to chunks, symbols and edges.

All rules run on the array of a file's lines inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import WHITE, stripped


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def size_chunks(files: DataFrame, most: int = 500) -> DataFrame:
    """K1: lines packed in order into chunks of at most so many characters; a longer line is a chunk."""
    empty = F.expr("struct(cast(array() as array<struct<start_line:int,end_line:int,content:string>>) as done, 0 as start_line, 0 as end_line, cast(null as string) as held)")

    def close(a: Column) -> Column:
        chunk = F.struct(a["start_line"].alias("start_line"), a["end_line"].alias("end_line"), a["held"].alias("content"))
        return F.when(a["held"].isNotNull(), F.concat(a["done"], F.array(chunk))).otherwise(a["done"])

    def step(a: Column, x: Column) -> Column:
        fits = a["held"].isNotNull() & (F.length(a["held"]) + 1 + F.length(x["line"]) <= most)
        return F.struct(
            F.when(fits, a["done"]).otherwise(close(a)).alias("done"), F.when(fits, a["start_line"]).otherwise(x["no"]).alias("start_line"),
            x["no"].alias("end_line"), F.when(fits, F.concat(a["held"], F.lit("\n"), x["line"])).otherwise(x["line"]).alias("held"),
        )

    numbered = F.transform(lines_of(F.col("content")), lambda x, i: F.struct((i + 1).alias("no"), x.alias("line")))
    chunks = F.aggregate(numbered, empty, step, close)
    return files.select("path", F.posexplode(chunks).alias("chunk", "c")).select("path", "chunk", "c.start_line", "c.end_line", "c.content")


def sections(files: DataFrame, is_start: Column, least: int = 0) -> DataFrame:
    """K2-K6: chunks that begin at the lines for which is_start(line) holds, and at the first line.

    is_start is a function of the line's column. Lines are 1-based; chunks whose trimmed text has
    fewer characters than least are dropped.
    """
    text = F.col("content")
    lines = lines_of(text)
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | is_start(x), i + 1).otherwise(0)), lambda n: n > 0)
    cut = files.select("path", lines.alias("l"), starts.alias("s")).select("path", "l", "s", F.posexplode("s").alias("chunk", "start_line"))
    end = F.coalesce(F.get("s", F.col("chunk") + 1) - 1, F.size("l"))
    out = cut.select("path", "chunk", "start_line", end.alias("end_line"), F.array_join(F.slice("l", F.col("start_line"), end - F.col("start_line") + 1), "\n").alias("content"))
    return out.where(F.length(F.trim("content")) >= least)


def markdown(files: DataFrame, least: int = 10) -> DataFrame:
    """K2: sections by headings with text, trimmed, with the heading; a file without a section of ``least`` characters is one chunk as it is."""
    cut = sections(files, lambda x: F.rlike(x, F.lit(r"^#{1,6}\s+.+")), 0).withColumn("content", stripped(F.col("content")))
    first = F.substring_index("content", "\n", 1)
    cut = cut.withColumn("heading", stripped(F.regexp_extract(first, r"^#{1,6}\s+(.+)", 1))).where(F.length("content") >= least)
    none = files.join(cut.select("path").distinct(), "path", "left_anti")
    whole = none.select("path", F.lit(0).alias("chunk"), F.lit(1).alias("start_line"), F.size(lines_of(F.col("content"))).alias("end_line"), "content", F.lit("").alias("heading"))
    return cut.unionByName(whole)


def rst(files: DataFrame, least: int = 10) -> DataFrame:
    """K3: a title is a line over an underline of at least three equal marks; a section begins at its title."""
    marked = files.withColumn("content", F.regexp_replace("content", r"(?m)^(\S[^\n]*)\n([=\-~^\"#*+]{3,})$", "\u0001$1\n$2"))
    out = sections(marked, lambda x: F.startswith(x, F.lit("\u0001")), 0).withColumn("content", F.translate("content", "\u0001", ""))
    return out.where(F.length(F.trim("content")) >= least)


def yaml_blocks(files: DataFrame) -> DataFrame:
    """K5: a block for each top-level key."""
    return sections(files, lambda x: F.rlike(x, F.lit(r"^[A-Za-z_][\w.-]*\s*:")), 1).withColumn("key", F.regexp_extract("content", r"^([A-Za-z_][\w.-]*)\s*:", 1))


def env_blocks(files: DataFrame) -> DataFrame:
    """K5: blocks between blank lines."""
    block = F.posexplode(F.split("content", r"\n\s*\n"))
    return files.select("path", block.alias("chunk", "content")).where("trim(content) <> ''")


def json_keys(files: DataFrame) -> DataFrame:
    """K4: a chunk for each top-level key of a JSON object, with its value as JSON."""
    return files.select("path", F.explode(F.from_json("content", "map<string,string>")).alias("key", "content"))


def contract_blocks(files: DataFrame, words: str = "message|service|enum|type|interface|input|query|mutation") -> DataFrame:
    """K6: blocks of interface files by their opening words, with kind and name."""
    out = sections(files, lambda x: F.rlike(x, F.lit(rf"^\s*(?:{words})\s+\w+")), 1)
    return out.withColumn("kind", F.regexp_extract("content", rf"^\s*({words})\s+(\w+)", 1)).withColumn("name", F.regexp_extract("content", rf"^\s*({words})\s+(\w+)", 2)).where("kind <> ''")


def openapi_paths(files: DataFrame) -> DataFrame:
    """K6: (path, route, methods, content) of each route below ``paths:`` of an OpenAPI file in YAML."""
    below = F.regexp_extract("content", r"(?ms)^paths:[ \t]*\n(.*?)(?=^\S|\z)", 1)
    blocks = F.regexp_extract_all(below, F.lit(r"(?ms)^  /.*?(?=^  /|\z)"), F.lit(0))
    methods = F.regexp_extract_all("block", F.lit(r"(?m)^    (get|put|post|delete|options|head|patch|trace):"), F.lit(1))
    return files.select("path", F.explode(blocks).alias("block")).select("path", F.regexp_extract("block", r"^  (/[^\s:]*)", 1).alias("route"), methods.alias("methods"), F.rtrim("block").alias("content"))


#: What a line begins with, after its indent, where a chunk of code may begin.
BOUNDARIES = (
    # TypeScript, JavaScript
    r"^(?:export\s+)?(?:async\s+)?function\s+\w+",
    r"^(?:export\s+)?(?:default\s+)?class\s+\w+",
    r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\(",
    r"^(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:function|\()",
    r"^(?:export\s+)?interface\s+\w+",
    r"^(?:export\s+)?type\s+\w+\s*=",
    r"^(?:export\s+)?enum\s+\w+",
    # Python
    r"^(?:async\s+)?def\s+\w+",
    r"^class\s+\w+",
    # Go
    r"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?\w+",
    r"^type\s+\w+\s+struct",
    # Rust
    r"^(?:pub\s+)?(?:async\s+)?fn\s+\w+",
    r"^(?:pub\s+)?struct\s+\w+",
    r"^(?:pub\s+)?enum\s+\w+",
    r"^impl\s+",
    # Java, C#
    r"^(?:public|private|protected)\s+(?:static\s+)?(?:class|interface|enum)\s+\w+",
    r"^(?:public|private|protected)\s+(?:static\s+)?(?:async\s+)?\w+\s+\w+\s*\(",
)
#: What a chunk of code declares; the name is the group.
DECLARES = (
    r"(?:export\s+)?(?:async\s+)?function\s+(\w+)",
    r"(?:export\s+)?(?:default\s+)?class\s+(\w+)",
    r"(?:export\s+)?interface\s+(\w+)",
    r"(?:export\s+)?type\s+(\w+)\s*=",
    r"(?:export\s+)?enum\s+(\w+)",
    r"(?:async\s+)?def\s+(\w+)",
    r"(?m)^func\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)",
    r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
    r"(?:pub\s+)?struct\s+(\w+)",
    r"(?:pub\s+)?enum\s+(\w+)",
)
#: What a file of code imports; the name is the group.
NEEDS = (
    r"import\s+.*?from\s+['\"]([^'\"]+)['\"]",
    r"import\s+['\"]([^'\"]+)['\"]",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"from\s+(\S+)\s+import",
)


def all_named(text: Column, patterns: tuple[str, ...], least: int = 1) -> Column:
    """Distinct names of at least so many characters that the patterns find, pattern by pattern, in order."""
    return F.array_distinct(F.filter(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])), lambda x: F.length(x) >= least))


def code(files: DataFrame, gap: int = 5, most: int = 500, least: int = 10) -> DataFrame:
    """K7: chunks that begin at boundary lines at least gap lines after the last beginning, with the names each declares and, in the first, the file's imports.

    Chunks under ``least`` characters are dropped. A file without a boundary beyond its first line is cut into runs of lines of at most ``most`` characters, line ends
    included; a longer line is a run.
    """
    l = F.col("l")  # noqa: E741
    starts = F.filter(F.transform(l, lambda x, i: F.when(F.rlike(F.ltrim(x, F.lit(WHITE)), F.lit("|".join(BOUNDARIES))), i)), lambda i: i.isNotNull())
    far = lambda acc, i: F.when(i - F.element_at(acc, -1) >= gap, F.concat(acc, F.array(i))).otherwise(acc)
    cut = files.select("path", "content", F.split("content", "\n", -1).alias("l")).withColumn("b", F.aggregate(starts, F.array(F.lit(0)), far))

    def line(a: Column, x: Column) -> Column:
        full = (a["size"] + F.length(x["line"]) > most) & (x["i"] > F.element_at(a["b"], -1))
        return F.struct(F.when(full, F.concat(a["b"], F.array(x["i"]))).otherwise(a["b"]).alias("b"), (F.when(full, 0).otherwise(a["size"]) + F.length(x["line"]) + 1).alias("size"))

    numbered = F.transform(l, lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    runs = F.aggregate(numbered, F.struct(F.array(F.lit(0)).alias("b"), F.lit(0).alias("size")), line, lambda a: a["b"])
    cut = cut.withColumn("declared", F.size("b") >= 2).withColumn("b", F.when(F.col("declared"), F.col("b")).otherwise(runs))
    part = lambda b, i: F.array_join(F.slice(l, b + 1, F.coalesce(F.get("b", i + 1), F.size(l)) - b), "\n")
    spans = F.transform("b", lambda b, i: F.struct((b + 1).alias("start_line"), F.coalesce(F.get("b", i + 1), F.size(l)).alias("end_line"), part(b, i).alias("content")))
    kept_ = F.filter(spans, lambda c: ~F.col("declared") | (F.length(stripped(c["content"])) >= least))
    each = cut.select("path", F.col("content").alias("whole"), F.posexplode(kept_).alias("chunk", "c")).select("path", "chunk", "c.*", "whole")
    imports = F.when(F.col("start_line") == 1, all_named(F.col("whole"), NEEDS))
    return each.select("path", "chunk", "start_line", "end_line", "content", all_named(F.col("content"), DECLARES, 2).alias("symbols"), imports.alias("imports"))


def kind_of(path: Column) -> Column:
    """Contract, config, docs or code, by the path."""
    has = lambda p: F.rlike(F.lower(path), F.lit(p))
    return F.when(has(r"\.(proto|graphql|gql)$|openapi|swagger"), "contract").when(has(r"\.(ya?ml|json|toml|ini|env)$|(^|/)\.env"), "config").when(has(r"\.(md|mdx|rst|txt)$"), "docs").otherwise("code")


def kept(chunks: DataFrame, least: int = 10, most: int = 40_000) -> DataFrame:
    """K12."""
    return chunks.where((F.length(F.trim("content")) >= least) & (F.length("content") <= most))


#: How files name what they import or extend; the name is the group.
IMPORTS = (r"import\s+[^'\"\n]*?from\s+['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", r"(?m)^\s*from\s+([\w.]+)\s+import", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;?\s*$", r"(?m)^\s*import\s+(?:\w+\s+)?\"([^\"\n]+)\"\s*$")
EXTENDS = (r"class\s+\w+(?:<[^>]*>)?\s+extends\s+(\w+)", r"class\s+\w+\((\w+)\)\s*:")


def code_edges(files: DataFrame) -> DataFrame:
    """K9: (path, target, edge_type) of imports and inheritance, distinct, as far as regexes see them."""
    found = lambda ps, t: F.transform(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in ps])), lambda x: F.struct(x.alias("target"), F.lit(t).alias("edge_type")))
    return files.select("path", F.inline(F.concat(found(IMPORTS, "imports"), found(EXTENDS, "extends")))).distinct()


def symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name) of declared functions and classes."""
    found = lambda p, k: F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("name")))
    return files.select("path", F.inline(F.concat(found(r"(?m)^\s*(?:export\s+)?(?:async\s+)?(?:pub\s+)?(?:async\s+)?(?:function|def|func|fn)\s+(\w+)", "function"), found(r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\b|\()", "function"), found(r"(?m)^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", "class")))).distinct()


#: Languages whose comments begin with #; all others' begin with //.
HASH_COMMENTS = ("markdown", "rst", "yaml", "json", "env")


def anchor_header(path: Column, language: Column, kind: Column, layer: Column | None = None, service: Column | None = None, symbols: Column | None = None, imports: Column | None = None, most: int = 5) -> Column:
    """Comment lines in front of a chunk: its file and kind, its layer and service, and the first names that it declares and imports; what is null or empty is left out."""
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    mark = F.when(language.isin(*HASH_COMMENTS), "#").otherwise("//")
    some = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    listed = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(xs, 1, most), ", ")))
    where = F.nullif(F.concat_ws(" | ", some("Layer", none if layer is None else layer), some("Service", none if service is None else service)), F.lit(""))
    lines = [F.concat(F.lit("File: "), path, F.lit(" ["), kind, F.lit("]")), where, listed("Defines", empty if symbols is None else symbols), listed("Imports", empty if imports is None else imports)]
    return F.concat_ws("\n", *[F.concat(mark, F.lit(" "), x) for x in lines])


def conversation_rows(turns: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """A row for each session with its turns as text."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.concat_ws(": ", role, text).alias("line"))))
    return turns.groupBy(session).agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("content"))
