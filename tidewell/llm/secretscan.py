"""Operator 1, secret scans: a trigram inverted index decides which texts each rule's regex reads.

From every rule's regex a Boolean query over (lower-case) trigrams is derived: a match needs all
trigrams of one of its clauses. Documents are indexed by the rules' trigrams alone; the postings
(trigram, doc_id) are intersected for each clause; and the regex verifies the candidates. Rules
without mandatory trigrams scan every text. All of it is DataFrame functions.

Defined results: null text is the empty text, without spans. Rows that share an id share their
candidates, and each is verified by itself; rows without an id are candidates of every rule.
Offsets are code points, end exclusive. Matches of a kind are leftmost and do not overlap;
matches of different kinds may. Very long texts are searched whole; an empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.names import unused
from tidewell.session import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of regex whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones need not be matched to be dropped
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + EXTRA
#: Trigrams of a clause that are indexed; fewer only make more candidates.
CLAUSE = 4
#: Candidate rows up to which they are broadcast (16 bytes a row); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


# --- from a regex to a Boolean query of trigrams -------------------------------------------------


Ways = list[list[str | None]]
#: What an escaped letter stands for; classes (\\w, \\d, …) and anchors are read as "anything".
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "v": "\v"}


class _Reader:
    """The ways through a regex: each a list of lower-case literal characters, with None where anything may stand, in or between.

    It reads literals, escapes, classes, groups, alternatives and quantifiers; of other groups (lookarounds, back references)
    it says so, as a clause must hold for every match.
    """

    def __init__(self, regex: str, most: int = 32):
        self.regex, self.at, self.most = regex, 0, most

    def peek(self) -> str:
        return self.regex[self.at : self.at + 1]

    def take(self, n: int = 1) -> str:
        self.at += n
        return self.regex[self.at - n : self.at]

    def joined(self, ways: Ways, step: Ways) -> Ways:
        return [a + b for a, b in product(ways, step if len(ways) * len(step) <= self.most else [[None]])]

    def alternatives(self) -> Ways:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = out + self.sequence()
        return out

    def sequence(self) -> Ways:
        ways: Ways = [[]]
        while self.peek() and self.peek() not in "|)":
            ways = self.joined(ways, self.repeated(self.atom()))
        return ways

    def repeated(self, once: Ways) -> Ways:
        """What a quantifier, if there is one, makes of an atom."""
        least, most = 1, 1
        c = self.peek()
        if c in ("?", "*", "+"):
            self.take()
            least, most = (0, 1) if c == "?" else (0, None) if c == "*" else (1, None)
        elif c == "{" and (close := self.regex.find("}", self.at)) > 0 and self.regex[self.at + 1 : close].replace(",", "").isdigit():
            low, _, high = self.take(close + 1 - self.at)[1:-1].partition(",")
            least, most = int(low or 0), int(high) if high else None if _ else int(low)
        else:
            return once
        if self.peek() in ("?", "+"):  # lazy or possessive
            self.take()
        if (least, most) == (0, 1):
            return [[], *once] if len(once) <= 3 else [[None]]
        return once if (least, most) == (1, 1) else [w + [None] for w in once] if least else [[None]]

    def atom(self) -> Ways:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.one_of()
        if c == "\\":
            return [[x] if (x := self.escaped()) else [None]]
        return [[None]] if c == "." else [[]] if c in "^$" else [[c.lower()]]

    def escaped(self) -> str | None:
        """The character behind a backslash; None for a class or an anchor."""
        c = self.take()
        if c in "xu":
            return chr(int(self.take(2 if c == "x" else 4), 16)).lower()
        return _ESCAPES.get(c) if c.isalnum() else c

    def group(self) -> Ways:
        if self.peek() == "?":
            head = self.regex[self.at : self.regex.find(":", self.at) + 1]
            if not head or any(c in head for c in "=!<>P#("):
                raise ValueError(f"{self.regex}: no trigrams can be derived from a group (?{self.regex[self.at + 1]}")
            self.take(len(head))
        inner = self.alternatives()
        self.take()
        return inner

    def one_of(self) -> Ways:
        """A class of up to six single characters is that many ways; any other stands for anything."""
        found: list[str | None] = [None] if self.peek() == "^" else []
        self.take(len(found))
        while self.peek() and (self.peek() != "]" or not found):
            c = self.take()
            found.append(self.escaped() if c == "\\" else c.lower())
            if self.peek() == "-" and self.regex[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take(2)
                found.append(None)
        self.take()
        return [[None]] if None in found or len(found) > 6 else [[c] for c in found]


def trigram_query(regex: str) -> list[list[str]] | None:
    """Clauses of trigrams: a match holds all of one clause. None: a match may hold none."""
    clauses = set()
    for way in _Reader(regex).alternatives():
        grams = [way[i] + way[i + 1] + way[i + 2] for i in range(len(way) - 2) if None not in way[i : i + 3]]
        grams = [g for g in dict.fromkeys(grams) if g.isascii()]
        if not grams:
            return None
        step = max(1, len(grams) // CLAUSE)
        clauses.add(tuple(grams[::step][:CLAUSE]))
    return [list(c) for c in sorted(clauses)]


# --- the index ------------------------------------------------------------------------------------


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id) for the trigrams that any rule's query names."""
    grams = sorted({g for r in rules for c in trigram_query(r.regex) or [] for g in c})
    if not grams:
        return docs.select(F.lit("").alias("trigram"), F.col("doc_id").cast("long")).limit(0)
    lowered = docs.select(F.col("doc_id").cast("long"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.where("doc_id is not null").select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the bits of the rules of which a clause's postings all hold it."""
    spark = index.sparkSession
    rows = [(g, k, n, len(clause)) for k, r in enumerate(rules) for n, clause in enumerate(trigram_query(r.regex) or []) for g in clause]
    clauses = spark.createDataFrame(rows, "trigram string, rule int, clause int, need int")  # as many as the rules' trigrams
    whole = index.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "rule", "clause", "need").agg(F.count("*").alias("n"))
    return whole.where("n >= need").groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("bits"))


# --- verification ----------------------------------------------------------------------------------


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in a text: structs of start, order, end.

    split() and regexp_extract_all() walk over the same matches, so the lengths of what lies
    between and of the matches themselves add up to the offsets.
    """
    regex = F.lit(rule.regex)
    columns = [F.split(text, rule.regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit")]
    if rule.group:
        columns.append(F.regexp_extract_all(text, regex, F.lit(rule.group)).alias("value"))
    empty = F.expr("cast(array() as array<struct<start:int,order:int,end:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"))
        long = F.coalesce(F.length(x["value" if rule.group else "hit"]), F.lit(-1)) >= rule.least
        return F.struct(end.alias("at"), F.when(long, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    found = F.aggregate(F.arrays_zip(*columns), start, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, regex), found).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text and found (all spans: start, order of the rule, end; sorted) for every row of docs."""
    return scan_kept(docs.select("doc_id", "text"), "found", rules, broadcast_rows)


def scan_kept(docs: DataFrame, into: str, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """All columns of docs and the spans in the new column ``into``."""
    id_, bits, text = (unused(docs, c) for c in ("id", "bits", "text"))
    hits = written(candidates(postings(docs, rules), rules), "secret-candidates").withColumnsRenamed({"doc_id": id_, "bits": bits})
    hits = F.broadcast(hits) if hits.count() <= broadcast_rows else hits
    joined = docs.join(hits, docs["doc_id"].cast("long") == F.col(id_), "left").withColumn(text, F.coalesce(docs["text"].cast("string"), F.lit("")))
    empty = F.expr("cast(array() as array<struct<start:int,order:int,end:int>>)")
    each = []
    for k, rule in enumerate(rules):
        found = spans(F.col(text), rule, k)
        if trigram_query(rule.regex) is not None:
            listed = F.col("doc_id").isNull() | (F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(1 << k) != 0)
            found = F.when(listed, found).otherwise(empty)
        each.append(found)
    return joined.withColumn(into, F.sort_array(F.concat(*each))).select(*docs.columns, into)


def joined_spans(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by mark; n_chars follows the new text.

    Rows without spans, null texts among them, stay as they are. Other columns may have any names.
    """
    spans_ = unused(docs, "found")
    found = scan_kept(docs, spans_, rules)

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans_, start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    has = F.size(spans_) > 0
    out = found.withColumn("text", F.when(has, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
