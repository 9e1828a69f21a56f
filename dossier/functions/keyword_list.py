"""The keyword-list contract: salvage what is a list, refuse what is prose, and say why. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import catalog as C
from .text import collapse, is_empty, let, sealed, strip

#: Bullet or number before an item, and answers that stand for nothing.
PREFIX = r"^\s*(?:[-*•·]|\(?\d+[.)])\s*"
PLACEHOLDER = r"(?i)^(\*+|none|n/?a|no_?\w*_found|not (found|applicable|mentioned)|extraction_failed|section_not_found)$"
#: Longest clause in words; words beyond which an item is dropped; most that may be dropped; least that must be in the source.
CLAUSE_WORDS, HARD_WORDS, MAX_DROPPED, MIN_GROUNDED = 12, 20, 0.5, 0.5


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def unquoted(c: Column) -> Column:
    """Without one layer of quotes around the whole."""
    bare = strip(c)
    inner = strip(bare.substr(F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))))
    pairs = [('"', '"'), ("'", "'"), ("“", "”")]
    quoted = F.lit(False)
    for a, b in pairs:
        quoted = quoted | (bare.startswith(a) & bare.endswith(b))
    return F.when((F.length(bare) >= 2) & quoted, inner).otherwise(bare)


def unfenced(c: Column) -> Column:
    """Without the fence lines of a code block."""
    bare = strip(c)
    lines = F.filter(F.split(bare, "\n"), lambda x: ~F.startswith(strip(x), F.lit("```")))
    return F.when(bare.startswith("```"), strip(F.array_join(lines, "\n"))).otherwise(bare)


def unlabelled(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)^\s*{C.LEADING_LABEL}\s*[:\-]\s*", "")


def prose_reason(c: Column) -> Column:
    """Why a text is no list, or null. The first rule that applies is the reason."""
    out = F.when(F.lit(False), F.lit(""))
    lowered = F.lower(c)
    for marker in C.PROSE_MARKERS:
        quote = '"' if "'" in marker else "'"
        out = out.when(F.contains(lowered, F.lit(marker)), F.lit(f"contains conversational phrase {quote}{marker}{quote}"))
    lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    bulleted = F.filter(lines, lambda x: x.rlike(PREFIX))
    longest = F.array_max(F.transform(bulleted, lambda x: word_count(F.regexp_replace(x, PREFIX, ""))))
    return (
        out.when(F.contains(strip(c), F.lit("\n\n")), F.lit("contains multiple paragraphs"))
        .when((F.size(lines) > 1) & (F.size(bulleted) >= 2) & (longest > CLAUSE_WORDS), F.lit("bulleted list of long clauses"))
        .when(c.rlike(r"[.!?]\s+[A-Z]"), F.lit("contains sentence breaks"))
        .when(~F.contains(c, F.lit(",")) & (word_count(c) > CLAUSE_WORDS), F.lit("single long phrase with no commas"))
    )


def clean_item(item: Column) -> Column:
    bare = strip(F.regexp_replace(strip(F.regexp_replace(item, PREFIX, "")), r'^["“”]+|["“”]+$', ""))
    without_dot = lambda one: F.when(one.endswith(".") & ~one.rlike(r"\b\w\.\w\.$"), strip(F.regexp_replace(one, r"\.$", ""))).otherwise(one)
    return let(collapse(F.regexp_replace(bare, r"(?i)^and\s+", "")), without_dot)


def distinct_items(items: Column) -> Column:
    """The first of items that are equal but for case, in order: sorted by key and place, the first of each key, back in order of place."""
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("place"), x.alias("item"))))
    firsts = lambda all_: F.filter(all_, lambda s, i: (i == 0) | (s["key"] != F.get(all_, F.greatest(i - 1, F.lit(0)))["key"]))
    return F.transform(F.array_sort(F.transform(let(placed, firsts), lambda s: F.struct(s["place"].alias("place"), s["item"].alias("item")))), lambda s: s["item"])


def loose(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " ")


def grounded_fraction(items: Column, source: Column) -> Column:
    """Share of items that the source has: as they are, or by six letters of their first longest word."""

    def stem(words):
        long = F.filter(words, lambda w: F.length(w) >= 5)
        chosen = F.when(F.size(long) > 0, long).otherwise(words)
        return let(chosen, lambda ws: F.substring(F.element_at(F.filter(ws, lambda w: F.length(w) == F.array_max(F.transform(ws, lambda v: F.length(v)))), 1), 1, 6))

    def hit(plain, hay):
        short = stem(F.filter(F.split(plain, " +"), lambda w: w != ""))
        found = F.when(F.contains(hay, plain), F.lit(1)).otherwise(let(short, lambda st: ((F.length(st) >= 4) & F.contains(hay, st)).cast("int")))
        return F.coalesce(F.when(plain == "", F.lit(0)).otherwise(found), F.lit(0))

    count = lambda hay: F.aggregate(F.transform(items, lambda x: let(strip(loose(x)), lambda plain: hit(plain, hay))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(items) == 0, F.lit(1.0)).otherwise(let(loose(source), count) / F.size(items))


def normalize(df: DataFrame, raw: str, source: str | None = None, value: str = "value", reason: str = "reason") -> DataFrame:
    """df with the canonical list (or null) and `ok` or the reason for refusal. Work columns start with `__`."""
    sentinel = lambda c: c.isin(*C.SENTINELS)
    out = df.withColumn("__raw", strip(F.coalesce(F.col(raw), F.lit(""))))
    out = out.withColumn("__text", unquoted(unlabelled(unquoted(unfenced(F.col("__raw"))))))
    out = out.withColumn("__prose", prose_reason(F.col("__text")))
    cleaned = F.filter(F.transform(F.split("__text", r"[,\n;]+"), clean_item), lambda x: x != "")
    out = out.withColumn("__all", F.when(F.col("__prose").isNull(), cleaned))
    out = out.withColumn("__items", distinct_items(F.filter("__all", lambda x: word_count(x) <= HARD_WORDS)))
    out = out.withColumn("__dropped", F.size(F.filter("__all", lambda x: word_count(x) > HARD_WORDS)))
    total = F.col("__dropped") + F.size("__items")
    why = (
        F.when(F.col("__raw") == "", F.lit("empty response"))
        .when(sentinel(F.col("__raw")) | sentinel(F.col("__text")), F.lit("ok"))
        .when(F.col("__prose").isNotNull(), F.col("__prose"))
        .when(F.size("__items") == 0, F.lit("no list items found"))
        .when(F.col("__dropped") > total * MAX_DROPPED, F.concat(F.col("__dropped").cast("string"), F.lit(" of "), total.cast("string"), F.lit(" items were over-long")))
    )
    if source:
        out = out.withColumn("__grounded", F.when(F.coalesce(F.col(source), F.lit("")) != "", grounded_fraction(F.col("__items"), F.col(source))))
        why = why.when(F.col("__grounded") < MIN_GROUNDED, F.concat(F.lit("only "), F.bround(F.col("__grounded") * 100, 0).cast("int").cast("string"), F.lit("% of "), F.size("__items").cast("string"), F.lit(" terms appear in the source text (likely invented or copied from the prompt)")))
    out = out.withColumn("__why", why.otherwise(F.lit("ok")))
    result = F.when(F.col("__why") != "ok", F.lit(None)).when(sentinel(F.col("__raw")), F.col("__raw")).when(sentinel(F.col("__text")), F.col("__text")).otherwise(F.array_join("__items", ", "))
    return sealed(out, {value: result, reason: F.col("__why")})


def answer_items(raw: Column, drug: Column | None = None) -> Column:
    """Items of a raw answer: preamble, bullets, quotes and connecting words off; placeholders, over-long items and the drug itself dropped."""
    text = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"(?i)^(here (is|are)[^:]*:|the (list|answer)[^:]*:)", "")

    def clean(it):
        bare = strip(F.regexp_replace(strip(F.regexp_replace(it, r"^[\s\-•*\d.)]+", "")), r"^[.\"'`]+|[.\"'`]+$", ""))
        named = F.replace(strip(F.regexp_replace(bare, r"(?i)^(and|or|including|such as)\s+", "")), F.lit("_"), F.lit(" "))
        return let(named, lambda one: F.when(F.contains(one, F.lit(" ")), one).otherwise(F.regexp_replace(one, r"(?<=[a-z])(?=[A-Z])", " ")))

    def wanted(it):
        good = (it != "") & ~it.rlike(PLACEHOLDER) & (F.length(it) <= 120)
        return good if drug is None else good & (F.lower(it) != F.lower(F.coalesce(drug, F.lit(""))))

    return distinct_items(F.filter(F.transform(F.split(text, "[\n;,]"), clean), wanted))


def merged_answer(items: Column, section: Column) -> Column:
    """One value out of the items of all chunks, in chunk order."""
    flat = distinct_items(F.flatten(items))
    return F.when(F.coalesce(strip(section), F.lit("")) == "", F.lit("SECTION_NOT_FOUND")).when(F.size(flat) > 0, F.array_join(flat, ", ")).otherwise(F.lit("NONE_FOUND"))


def item_set(c: Column, none_found_is_empty: bool = True) -> Column:
    """The set that a comma list stands for; empty where it holds a placeholder."""
    items = F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: collapse(F.lower(strip(x)))), lambda x: x != ""))
    nothing = is_empty(c)
    if none_found_is_empty:
        nothing = nothing | F.coalesce(strip(c) == "NONE_FOUND", F.lit(False))
    return F.when(nothing, F.array().cast("array<string>")).otherwise(items)


def token_set(c: Column) -> Column:
    """Distinct words of four letters or more; empty for placeholders."""
    return F.when(is_empty(c), F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0)))


def stems(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0), lambda w: F.substring(w, 1, 6))


def close_in(item: Column, text_stems: Column, least: float = 0.75) -> Column:
    """At least three quarters of an item's word beginnings are among the text's."""
    own = stems(item)
    return (F.size(own) > 0) & (F.size(F.filter(own, lambda w: F.array_contains(text_stems, w))) >= least * F.size(own))


