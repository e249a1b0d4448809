"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOPWORDS = (
    "the a an is was are were do did does what where when how who which my i me to of in for on with at by from "
    "that this it and or but not have has had be been about any all so if then than into up"
).split()
MONTHS = "january february march april may june july august september october november december".split()


def keywords(text: Column) -> Column:
    """Lower-case words of three and more letters, digits or underscores, without stopwords."""
    return F.filter(F.split(F.lower(text), r"[^A-Za-z0-9_]+"), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def long_words(text: Column) -> Column:
    """Words between white space, over two characters, lower case."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) > 2)


def normalised(text: Column) -> Column:
    """I4: plain apostrophes, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "’ʼ‘`", "''''")), r"\s+", " "))


def snippet(text: Column, n: int = 160) -> Column:
    """White space squeezed, n characters at most, an ellipsis where it was cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def preview(text: Column) -> Column:
    """The first line that isn't blank, trimmed."""
    return F.trim(F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0)))


def fingerprint(text: Column, files: Column) -> Column:
    """md5 of the text's lower-case beginning and the sorted files."""
    return F.md5(F.concat(F.substring(F.trim(F.lower(text)), 1, 100), F.lit("|"), F.array_join(F.array_sort(files), ",")))


def token_estimate(text: Column) -> Column:
    """A quarter of the squeezed text's characters, rounded up."""
    return F.ceil(F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) / 4)


def path_matches(a: Column, b: Column) -> Column:
    """I16: equal paths, or one a suffix of the other from a slash on."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def temporal(query: Column) -> Column:
    """Struct of op, order, date_from, date_to; the first rule that matches wins, in this order."""
    q = F.lower(query)
    month = rf"\b({'|'.join(MONTHS)})\s+(\d{{4}})\b"
    number = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, f"{i + 1:02d}")])
    find = lambda p, g: F.nullif(F.regexp_extract(q, p, g), F.lit(""))

    def made(op: str, order: str | None = None, low: Column | None = None, high: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(op).alias("op"), F.lit(order).cast("string").alias("order"), (none if low is None else low).alias("date_from"), (none if high is None else high).alias("date_to"))

    year, day = find(r"\bin (\d{4})\b", 1), find(r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    first = F.concat(find(month, 2), F.lit("-"), F.try_element_at(number, find(month, 1)), F.lit("-01"))
    before, after = find(r"\bbefore\s+(\d{4}-\d{2})\b", 1), find(r"\bafter\s+(\d{4}-\d{2})\b", 1)
    start = lambda c: F.concat(c, F.lit("T00:00:00.000Z"))
    end = lambda c: F.concat(c, F.lit("T23:59:59.999Z"))
    return (
        F.when(F.rlike(q, F.lit(r"\bfirst\b")), made("first", "asc"))
        .when(F.rlike(q, F.lit(r"\blast\b|\bmost recent\b|\blatest\b")), made("last", "desc"))
        .when(F.rlike(q, F.lit(r"\bcurrent\b|\bnow\b|\bcurrently\b")), made("current", "desc"))
        .when(year.isNotNull(), made("between", None, start(F.concat(year, F.lit("-01-01"))), end(F.concat(year, F.lit("-12-31")))))
        .when(first.isNotNull(), made("between", None, start(first), end(F.date_format(F.last_day(F.try_to_date(first)), "yyyy-MM-dd"))))
        .when(before.isNotNull(), made("before", None, start(F.concat(before, F.lit("-01")))))
        .when(after.isNotNull(), made("after", None, start(F.concat(after, F.lit("-01")))))
        .when(day.isNotNull(), made("between", None, start(day), end(day)))
        .otherwise(made("none"))
    )


def glob_regex(pattern: str) -> str:
    """A path pattern as a regex that is searched for anywhere in a path: ** is anything, * anything inside a part, a dot itself; the rest is regex."""
    return "".join({"**": ".*", "*": "[^/]*", ".": r"\."}.get(part, part) for part in re.split(r"(\*\*|\*|\.)", pattern))


def plain_path(path: Column) -> Column:
    """A path with slashes only."""
    return F.translate(path, "\\", "/")


#: White space that text is stripped of: Unicode's spaces, tabs, line ends and the byte order mark.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def stripped(text: Column) -> Column:
    """A text without white space at its ends, line ends included (trim() takes spaces only)."""
    return F.btrim(text, F.lit(WHITE))


#: Phrases that ask to save a statement, anywhere in it.
SAVE_PHRASES = (
    "remember this",
    "remember that",
    "note for the future",
    "keep in mind",
    "запам'ятай",
    "запамятай",
    "збережи в пам'ять",
    "збережи це",
    "на майбутнє врахуй",
)
#: How a correction begins.
CORRECTION_PREFIXES = (
    "no,",
    "no -",
    "that's wrong",
    "that is wrong",
    "wrong,",
    "actually,",
    "incorrect",
    "ні,",
    "ні.",
    "не так",
    "неправильно",
    "невірно",
    "насправді",
)


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def saves(text: Column) -> Column:
    """Whether a statement asks to be remembered; apostrophes of any kind, or none, are one."""
    plain = normalised(text)
    bare = F.replace(plain, F.lit("'"), F.lit(""))
    return any_of([F.contains(plain, F.lit(p)) | F.contains(bare, F.lit(p.replace("'", ""))) for p in SAVE_PHRASES])


def corrects(text: Column) -> Column:
    """Whether a statement begins as a correction."""
    plain = normalised(text)
    return any_of([F.startswith(plain, F.lit(p)) for p in CORRECTION_PREFIXES])


#: Layers by words of a lower-case path; the first that fits counts.
LAYERS = (
    ("api", r"\broutes?\b|\bcontrollers?\b"),
    ("service", r"\bservices?\b"),
    ("util", r"\butils?\b|\bhelpers?\b|\blib\b"),
    ("model", r"\bmodels?\b|\bentit"),
    ("middleware", r"\bmiddleware\b"),
    ("test", r"\b__tests__\b|\btest\b|\bspec\b"),
    ("parser", r"\bparsers?\b"),
    ("types", r"\btypes?\b|\binterfaces?\b"),
    ("config", r"\bconfig\b"),
)
#: Parts of the names of services.
SERVICE_WORDS = "Service|Store|Parser|Builder|Handler|Controller|Manager"


def layer_of(path: Column) -> Column:
    """The layer of a path, else other."""
    low = F.translate(F.lower(path), "\\", "/")
    out = F.lit("other")
    for name, words in reversed(LAYERS):
        out = F.when(F.rlike(low, F.lit(words)), name).otherwise(out)
    return out


def service_of(symbols: Column) -> Column:
    """The first symbol that is named like a service, else the first like a class, else null."""
    like = lambda p: F.get(F.filter(symbols, lambda x: F.rlike(x, F.lit(p))), F.lit(0))
    return F.coalesce(like(f"(?i){SERVICE_WORDS}"), like("^[A-Z][a-zA-Z]+$"))


#: Languages by file extension; files named Dockerfile have one of their own.
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "vue": "vue", "py": "python", "go": "go", "rs": "rust", "java": "java", "sql": "sql", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml"}


def language_of(path: Column) -> Column:
    """Dockerfile by the name, else the language of a path's extension, else unknown; a name that begins with its only dot has no extension."""
    known = F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v)])
    name = F.substring_index(path, "/", -1)
    by_end = F.try_element_at(known, F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1)))
    return F.when((name == "Dockerfile") | F.startswith(name, F.lit("Dockerfile.")), "dockerfile").otherwise(F.coalesce(by_end, F.lit("unknown")))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: in a fence, or from the first to the last brace; null if none parses."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(fenced), F.try_parse_json(braced))


def decision_section(text: Column) -> Column:
    """What stands below a Decision heading, up to the next heading."""
    return F.trim(F.regexp_extract(text, r"(?si)#+\s*decision\s*\n(.*?)(?=\n#|\z)", 1))


#: How a text names files, and code the things it declares.
FILE_NAME = r"(?:[\w/@.-]+/)?[\w.-]+\.(ts|js|tsx|jsx|py|go|rs|vue|json|yaml|yml|md)"
ANCHOR_FILE = r"(?:[\w@/.-]+/)?[\w.-]+\.(ts|js|tsx|jsx|py|go|rs|vue|json|yaml|yml)"
DECLARED = r"(?:function|const|let|var|class|interface|type|enum|def|func)\s+(\w+)"
PASCAL = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"


def entities(text: Column, functions: int = 30, concepts: int = 15) -> dict[str, Column]:
    """Files, declared and imported names, and concepts (decorators, names in Pascal case) that a text mentions, distinct and in order."""
    found = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    names = F.flatten(F.transform(found(r"import\s+\{([^}]+)\}"), lambda x: F.transform(F.split(x, ","), lambda y: F.get(F.split(F.trim(y), r"\s+as\s+"), F.lit(0)))))
    long = lambda xs: F.filter(xs, lambda x: F.length(x) > 1)
    marks = F.filter(found(r"@(\w+)"), lambda x: (F.length(x) > 2) & (F.substring(x, 1, 1) == F.upper(F.substring(x, 1, 1))))
    return {
        "files": F.array_distinct(found(FILE_NAME, 0)),
        "functions": F.slice(F.array_distinct(F.concat(long(found(DECLARED)), long(names))), 1, functions),
        "concepts": F.slice(F.array_distinct(F.concat(marks, found(PASCAL))), 1, concepts),
    }


def anchors(text: Column, files: Column, most: int = 20, symbols: int = 5) -> Column:
    """I8: what a memory points at: (type, path, name) of its files, of files and of the first symbols in its text."""
    own = F.filter(files, lambda f: F.contains(f, F.lit("/")) | F.contains(f, F.lit(".")))
    named = F.array_distinct(F.regexp_extract_all(text, F.lit(ANCHOR_FILE), F.lit(0)))
    as_file = lambda xs: F.transform(xs, lambda f: F.struct(F.lit("file").alias("type"), f.alias("path"), F.lit(None).cast("string").alias("name")))
    as_symbol = F.transform(F.slice(F.regexp_extract_all(text, F.lit(PASCAL), F.lit(1)), 1, symbols), lambda s: F.struct(F.lit("symbol").alias("type"), F.lit("").alias("path"), s.alias("name")))
    return F.slice(F.concat(as_file(own), as_file(F.filter(named, lambda f: ~F.array_contains(own, f))), as_symbol), 1, most)


def fact_type(text: Column, tool: Column | None = None) -> Column:
    """A fact's kind by the tool that gave it and by what its text holds, the first rule that fits."""
    low, tool = F.lower(text), F.lit("") if tool is None else F.coalesce(tool, F.lit(""))
    has = lambda *ws: any_of([F.contains(low, F.lit(w)) for w in ws])
    return (
        F.when((tool == "get_patterns") | has("pattern"), "pattern")
        .when((tool == "get_adrs") | has("decision"), "pattern")
        .when(has("import", "require", "dependency"), "dependency")
        .when(has("error", "bug", "issue", "todo"), "issue")
        .otherwise("finding")
    )


def observed_facts(text: Column, tool: Column) -> Column:
    """Facts of a tool's answer: (content, file, type, confidence), distinct by content and in order.

    A file is named on a line of its own as ``[n] path (score: x)``; what follows up to the next such
    bracket, or 500 characters of it, is its fact, cut to 300. Imports are facts by themselves.
    """
    line = r"\[\d+\]\s+([\w./-]+\.\w+)\s*\(score:\s*([\d.]+)\)"
    part = lambda g: F.regexp_extract_all(text, F.lit(line), F.lit(g))
    after = F.slice(F.split(text, line, -1), 2, F.size(part(1)))
    last = lambda i: i == F.size(part(1)) - 1
    upto = lambda x: F.regexp_extract(x, r"(?s)^(.*?)(?=\n\[|\z)", 1)
    block = lambda x, i: F.substring(F.regexp_replace(F.when(~last(i) | F.contains(x, F.lit("\n[")), upto(x)).otherwise(F.substring(x, 1, 500)), r"^\s+|\s+$", ""), 1, 300)
    rows = F.transform(F.arrays_zip(part(1).alias("file"), part(2).alias("score"), after.alias("after")), lambda x, i: F.struct(x["file"].alias("file"), F.least(x["score"].try_cast("double"), F.lit(1.0)).alias("confidence"), block(x["after"], i).alias("block")))
    seen = F.transform(F.filter(rows, lambda x: x["block"] != ""), lambda x: F.struct(F.concat(x["file"], F.lit(": "), x["block"]).alias("content"), x["file"].alias("file"), fact_type(x["block"], tool).alias("type"), x["confidence"].alias("confidence")))
    imports = r"import\s+.*from\s+['\"]([^'\"]+)['\"]"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(imports), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(imports), F.lit(1)).alias("file"))
    needs = F.transform(pairs, lambda x: F.struct(F.concat(F.lit("Dependency: "), x["whole"]).alias("content"), x["file"].alias("file"), F.lit("dependency").alias("type"), F.lit(0.8).alias("confidence")))
    every = F.concat(seen, needs)
    contents = F.transform(every, lambda x: x["content"])
    return F.filter(every, lambda x, i: F.array_position(contents, x["content"]) == i + 1)


def fnv1a32(text: Column) -> Column:
    """FNV-1a over a text's UTF-8 bytes, 32 bits, as a long."""
    raw = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda i: F.conv(F.substring(F.hex(text), 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND((1 << 32) - 1)
    return F.when(F.octet_length(text) == 0, F.lit(2166136261)).otherwise(F.aggregate(raw, F.lit(2166136261).cast("long"), step))


def with_entries(map_: Column, patch: Column) -> Column:
    """A map with the entries of another, which win."""
    return F.map_concat(F.map_filter(map_, lambda k, v: ~F.map_contains_key(patch, k)), patch)
