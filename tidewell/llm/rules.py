"""Operator 7, quality rules: divergence of a text's histograms from language references.

Three histograms of each document, of character classes, of its language's common words and of those
words together, are compared by Jensen-Shannon distance with the mean shares of all sound documents of that
language. Its ``COMMON`` common words are those that most of its documents hold; words are runs of letters
here, without case. How far words may be is taken from the corpus too: short texts scatter more, so sound documents of about
one length (a power of two of words) give limits (the upper quartile plus a fence of spans of the
quartiles). A short text's single words scatter as far as distances go, the common words together don't; so these
have a distance of their own, which counts where they are fewer than in the language. A text with none of
its language's common words is always beyond the limits. Very short texts, whose histograms are noise, pass.
A document weighs in the references as much as any other, whatever its length, and all sums and limits are of
whole numbers, so verdicts repeat. All of it is DataFrame functions; the texts are read twice, for the words and for the counts, and
the counts are stored.

Defined results: null text has no words and fails the base rules, like any text under 50 words.
A language without ``REFERENCE_WORDS`` words in sound texts gives no reference; what has no
reference, or no language, is kept if it passes the base rules. Rows that repeat, or share an id, are judged each. Very long
texts are read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import stored, written

SPACE = r"[\x20\x09-\x0D]+"
#: Common words of a language: those that most of its documents hold.
COMMON = 20
#: What lies between words as histograms see them: runs of letters.
BETWEEN = r"[^\p{L}]+"
CLASSES = ("lower", "upper", "digit", "punct", "space", "other")
#: Words and characters under which a histogram is not compared.
LEAST_WORDS, LEAST_CHARS = 50, 200
REFERENCE_WORDS = 1000
#: Largest distance (0 to 1) of a kept text's classes from its reference; of its words, see word_limits(): fences of single words and of all together.
MOST_CLASSES, FENCE, FAR_FENCE = 0.26, 1.5, 3.0
#: Distance of all common words together up to which a text is like its language, however little others of its length scatter.
LEAST_SHARE = 0.15
#: Parts of 1 in which shares and distances are counted.
SHARES, TICKS = 1_000_000, 10_000
#: Sound documents of a length under which the limit of the next shorter length holds; of the shortest, that of the first with as many.
LEAST_BAND = 50
#: Bits of a window's place beside its hash, in texts of under 2**20 words and in others.
PLACE_BITS = (20, 30)
#: Languages up to which their references are broadcast (about 1 kB each).
BROADCAST_LANGS = 10_000


def side(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join whose rows were counted: broadcast if few, else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_LANGS else df


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def folded_words(text: Column) -> Column:
    """The runs of letters of a text, in lower case."""
    return F.array_remove(F.split(F.lower(text), BETWEEN, -1), "")


def common_words(docs: DataFrame) -> DataFrame:
    """lang, words (the COMMON of each language that most of its rows hold) and their hashes."""
    words = docs.where("lang is not null").select(F.col("lang").cast("string"), F.explode(F.array_distinct(folded_words(text_of(docs)))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON)
    words = top.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("words"))  # COMMON a language
    return words.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))


def counts(docs: DataFrame, *keep: str, more: bool = False) -> DataFrame:
    """Counts of every text: doc_id, keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, classes (an array by CLASSES).

    With more: n_distinct (words), n_again (words equal to the one before) and n_short (words of up to three characters).
    With a column ``hashes`` among keep: n_folded, the number of the text's words or folded words, whichever is greater, and common, how often the word of each of these hashes is among them, in its place.
    """
    base = docs.select(F.col("doc_id").cast("long"), *keep, text_of(docs).alias("t"))
    cut = base.select("doc_id", *keep, "t", F.array_remove(F.split("t", SPACE, -1), "").alias("w"), F.split("t", "\n", -1).alias("lines"))
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    cut = cut.withColumn("n", F.size("w")).withColumn("hw", hashed).withColumn("s", F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")))
    lines = F.filter("lines", lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    windows = F.expr("if(n >= 3, transform(slice(hw, 1, n - 2), (x, i) -> xxhash64(x, get(hw, i + 1), get(hw, i + 2))), null)")
    upper, digit, punct, beyond = (F.regexp_count("t", F.lit(p)) for p in ("[A-Z]", "[0-9]", r"[!-/:-@\[-`{-~]", r"[^\x00-\x7F]"))
    extra = []
    if "hashes" in keep:
        extra.append(F.when(F.col("hashes").isNotNull(), F.transform(folded_words(F.col("t")), lambda x: F.xxhash64(x))).alias("hf"))
    if more:
        extra += [F.size(F.array_distinct(F.split(F.lower(F.array_join("w", " ")), " ", -1))).alias("n_distinct"), F.expr("size(filter(hw, (x, i) -> x = get(hw, i - 1)))").alias("n_again"), F.size(F.filter("w", lambda x: F.length(x) <= 3)).alias("n_short")]
    step = cut.select(
        "doc_id", *keep, "n", "w", "hw", (F.length("s") - F.greatest(2 * F.col("n"), F.lit(2))).alias("word_chars"), F.length("t").alias("n_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).alias("n_symbols"), lines.alias("full"), windows.alias("h"),
        upper.alias("upper"), digit.alias("digit"), punct.alias("punct"), beyond.alias("other"), *extra,
    )
    # Windows found again: part of their hashes, packed with their places into sorted numbers, are neighbours.
    again = F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False))
    step = step.withColumn("bits", F.when(F.col("n") < (1 << 20), PLACE_BITS[0]).otherwise(PLACE_BITS[1]))
    step = step.withColumn("p", F.when(again, F.expr("sort_array(transform(h, (x, i) -> shiftleft(x, bits) | cast(i as bigint)))")))
    step = step.withColumn("c", F.expr("filter(p, (x, i) -> coalesce(shiftright(x, bits) = shiftright(get(p, i - 1), bits), false) or coalesce(shiftright(x, bits) = shiftright(get(p, i + 1), bits), false))"))
    place = "cast({0} & (shiftleft(1L, bits) - 1) as int)"
    own, after = place.format("x"), place.format("get(c, i + 1)")
    equal = " and ".join(f"get(w, {own} + {k}) = get(w, {after} + {k})" for k in range(3))
    # different windows beside each other share only part of their hashes: then the words themselves are sorted
    step = step.withColumn("mixed", F.expr(f"exists(transform(c, (x, i) -> coalesce(shiftright(x, bits) = shiftright(get(c, i + 1), bits) and not ({equal}), false)), x -> x)"))
    by_words = f"sort_array(transform(c, x -> struct(get(w, {own}) as a, get(w, {own} + 1) as b, get(w, {own} + 2) as c, {own} as at)))"
    alike = lambda j: f"coalesce(x.a = get(v, {j}).a and x.b = get(v, {j}).b and x.c = get(v, {j}).c, false)"
    step = step.withColumn("v", F.expr(f"if(mixed, {by_words}, null)"))
    step = step.withColumn("r", F.expr(f"if(mixed, sort_array(transform(filter(v, (x, i) -> {alike('i - 1')} or {alike('i + 1')}), x -> x.at)), sort_array(transform(c, x -> {own})))"))
    covered = F.expr("aggregate(transform(r, (x, i) -> if(i = 0, 3, least(3, x - get(r, i - 1)))), 0L, (a, x) -> a + x)")
    space = F.col("n_chars") - F.col("word_chars")
    low = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("punct") - F.col("other")
    whole = lambda c, name: c.cast("long").alias(name)
    found = [whole(F.col(c), c) for c in ("n_distinct", "n_again", "n_short") if more]
    if "hashes" in keep:  # written out, as removing from an array of numbers is compiled
        each = [F.when(F.size("hashes") > i, F.size("hf") - F.size(F.array_remove("hf", F.get("hashes", F.lit(i))))) for i in range(COMMON)]
        found += [F.greatest(F.size("hf"), F.col("n")).cast("long").alias("n_folded"), F.when(F.col("hashes").isNotNull(), F.array_compact(F.array(*each)).cast("array<long>")).alias("common")]
    return step.select(
        "doc_id", *[k for k in keep if k != "hashes"], whole(F.col("n"), "n_words"), whole(F.col("word_chars"), "word_chars"), whole(F.col("n_symbols"), "n_symbols"),
        whole(F.size("full") - F.size(F.array_distinct("full")), "n_dup_lines"), whole(F.coalesce(covered, F.lit(0)), "n_repeat_words"), whole(F.col("n_chars"), "n_chars"),
        F.array(low, "upper", "digit", "punct", space, "other").cast("array<long>").alias("classes"), *found,
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def together() -> Column:
    """How many words are common ones of their language."""
    return F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)


def word_histogram() -> Column:
    """Counts of all other words, and of the language's common ones; a language has COMMON at most."""
    return F.concat(F.array(F.col("n_folded") - together()), "common")


def references(counted: DataFrame) -> DataFrame:
    """lang, by_class and by_word: mean shares over the sound documents of each language with common words, each document counting once."""
    sound = counted.where(F.col("common").isNotNull() & ~base_failed() & (F.col("n_chars") >= LEAST_CHARS))
    parts = lambda of, all_: F.expr(f"transform({of}, x -> x * {SHARES} div {all_})")
    sound = sound.withColumn("by", word_histogram()).select("lang", "n_words", parts("classes", "n_chars").alias("classes"), parts("by", "greatest(n_folded, 1)").alias("by"))
    bins = [f"sum(get(classes, {i}))" for i in range(len(CLASSES))], [f"sum(get(by, {i}))" for i in range(COMMON + 1)]
    sums = sound.groupBy("lang").agg(F.sum("n_words").alias("n"), *[F.expr(f"array_compact(array({', '.join(b)}))").alias(k) for k, b in zip("cw", bins, strict=True)])
    share = lambda of: F.expr(f"transform({of}, x -> x / greatest(1, aggregate({of}, 0L, (a, y) -> a + y)))")
    return sums.where(F.col("n") >= REFERENCE_WORDS).select("lang", share("c").alias("by_class"), share("w").alias("by_word"))


def distance(histogram: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts from shares: the root of the divergence in bits, 0 to 1."""

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    parts = F.zip_with(F.transform(histogram, lambda x: x / total), reference, lambda p, q: (half(p, q) + half(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def band() -> Column:
    """A text's length as a power of two of words."""
    return F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def word_limits(judged: DataFrame, most_classes: float) -> dict[str, dict[int, float]]:
    """Largest distances of kept texts by band(), from those of sound documents: of single words, and of all together.

    Distances are counted in TICKS; a band has TICKS rows at most, and two rows a band are gathered.
    """
    sound = judged.where(~F.col("base_failed") & (F.col("class_distance") <= most_classes))
    kinds = [F.struct(F.lit(k).alias("kind"), F.floor(F.col(k) * TICKS).alias("tick")) for k in ("word_distance", "share_distance")]
    counted = sound.select(band().alias("band"), F.inline(F.array(*kinds))).where("tick is not null").groupBy("band", "kind", "tick").agg(F.count("*").alias("n"))
    of = Window.partitionBy("band", "kind")
    placed = counted.withColumns({"upto": F.sum("n").over(of.orderBy("tick")), "all": F.sum("n").over(of)})
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("tick")))
    rows = placed.groupBy("kind", "band").agg(F.max("all").alias("n"), quartile(1).alias("low"), quartile(3).alias("high")).collect()
    out: dict[str, dict[int, float]] = {}
    for kind, fence, least in (("word_distance", FENCE, 0.0), ("share_distance", FAR_FENCE, LEAST_SHARE)):
        limits, limit = {}, None
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["band"]):
            if r["n"] >= LEAST_BAND:
                limit = max(least, (r["high"] + 1 + fence * (r["high"] - r["low"])) / TICKS)
            if limit is not None:
                limits[r["band"] if limits else 0] = limit  # shorter lengths too: of them there are few
        out[kind] = limits
    return out


def quality_rules(docs: DataFrame, most_classes: float = MOST_CLASSES, most_words: float | None = None) -> DataFrame:
    """The counts, base_failed, the distances (null if guarded) and kept of every row of docs; most_words in place of word_limits() of single words."""
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    words, n = stored(common_words(docs), "quality-common")
    counted = written(counts(docs.join(side(words.drop("words"), n["rows"]), "lang", "left"), "lang", "hashes"), "quality-counts")
    refs, n = stored(references(counted), "quality-references")
    enough = (F.col("n_words") >= LEAST_WORDS) & (F.col("n_chars") >= LEAST_CHARS) & F.col("by_class").isNotNull()
    chars, words = F.greatest("n_chars", F.lit(1)), F.greatest("n_folded", F.lit(1))
    usual = 1 - F.get("by_word", F.lit(0))
    judged = counted.join(side(refs, n["rows"]), "lang", "left").withColumn("base_failed", base_failed())
    shares = distance(F.array(F.col("n_folded") - together(), together()), words, F.array(1 - usual, usual))
    judged = judged.withColumns({
        "class_distance": F.when(enough, distance(F.col("classes"), chars, F.col("by_class"))),
        "word_distance": F.when(enough, distance(word_histogram(), words, F.col("by_word"))),
        "share_distance": F.when(enough, F.when(together() < usual * words, shares).otherwise(0.0)),
        "bare": F.coalesce(enough & (together() == 0), F.lit(False)),
    })
    figures = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "share_distance"]
    judged = written(judged.select(*figures, "bare"), "quality-judged")
    limits = word_limits(judged, most_classes)
    divergent = F.coalesce(F.col("class_distance") > most_classes, F.lit(False)) | F.col("bare")
    for kind, by_band in limits.items():
        most = F.lit(most_words if kind == "word_distance" else None).cast("double")
        for k in sorted(by_band) if kind != "word_distance" or most_words is None else ():  # bands are powers of two, some dozens at most
            most = F.when(band() >= k, F.lit(by_band[k])).otherwise(most)
        divergent = divergent | F.coalesce(F.col(kind) > most, F.lit(False))
    return judged.select(*figures[:7], (~F.col("base_failed") & ~divergent).alias("kept"), *figures[7:])
