"""Corpus profiling: flags of a document's front pages, and their summary. Native expressions over the page array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, spaced
from ..sources.shared import running_sums

FRONT_PAGES, LEAST_CHARS, LEADER_LINES = 12, 50, 5
#: Headings that are looked for, with their spellings, and the dates' pattern.
HEADINGS = {"indications": ("INDICATIONS AND CLINICAL USE", "INDICATIONS"), "contraindications": ("CONTRAINDICATIONS",), "adverse": ("ADVERSE REACTIONS", "ADVERSE EVENTS"), "interactions": ("DRUG INTERACTIONS",)}
YEAR = r"(?i)(?:date\s+of\s+(?:revision|preparation|initial\s+a\w+)|revised|last\s+revised)[^\n]{0,60}?\b(19[89]\d|20[0-3]\d)\b"
FRENCH = r"(?i)MONOGRAPHIE\s+DE\s+PRODUIT|RENSEIGNEMENTS\s+POUR|CONTRE-INDICATIONS"
LEADERS = r"(?m)(?:\.\s?){5,}\s*\d{1,3}\s*$"


def sampled(pages: Column) -> Column:
    """First, middle and last page, each once."""
    n = F.size(pages)
    places = F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), F.greatest(n - 1, F.lit(0))))
    return F.filter(F.transform(places, lambda i: F.get(pages, i)), lambda p: p.isNotNull())


def analyse(df: DataFrame, pages: str = "pages", outline: str | None = None) -> DataFrame:
    """df with the profile of each document. The page array may have empty texts here, as its size counts all pages."""
    col = F.col(pages)
    text = lambda ps: F.array_join(F.transform(ps, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    out = df.withColumn("__front", text(F.slice(col, 1, FRONT_PAGES))).withColumn("__flat", collapse(F.col("__front")))
    some = sampled(col)
    chars = F.aggregate(F.transform(some, lambda p: F.length(F.coalesce(p["text"], F.lit("")))), F.lit(0), lambda a, x: a + x)
    front, flat = F.col("__front"), F.col("__flat")
    has = lambda c, title: c.rlike("(?i)" + spaced(title))
    years = F.transform(F.regexp_extract_all(flat, F.lit(YEAR), 1), lambda y: y.try_cast("int"))
    columns: dict[str, Column] = {
        "pages": F.size(col),
        "has_bookmarks": (F.size(outline) > 0) if outline else F.lit(None).cast("boolean"),
        "chars_per_sampled_page": F.round(F.try_divide(chars.cast("double"), F.size(some).cast("double")), 1),
        "has_toc_heading": has(front, "TABLE OF CONTENTS") | has(front, "TABLE DES MATI"),
        "toc_leader_lines": F.regexp_count(front, F.lit(LEADERS)),
        "part_i": flat.rlike(r"(?i)PART\s*I\b"),
        "part_ii": flat.rlike(r"(?i)PART\s*II\b"),
        "part_iii": flat.rlike(r"(?i)PART\s*III\b"),
        "consumer_information": has(front, "CONSUMER INFORMATION"),
        "patient_medication_information": has(front, "PATIENT MEDICATION INFORMATION"),
        "numbered_sections": front.rlike(r"(?m)^\s*1\.?\s+" + spaced("INDICATIONS")),
        "french": flat.rlike(FRENCH),
        "revision_year": F.array_max(years),
    }
    for name, spellings in HEADINGS.items():
        any_plain = F.lit(False)
        for s in spellings:
            any_plain = any_plain | F.contains(F.upper(front), F.lit(s))
        found = F.flatten(F.array(*[F.regexp_extract_all(front, F.lit("(?i)" + spaced(s)), 0) for s in spellings]))
        columns[f"{name}_plain"] = any_plain
        columns[f"{name}_spaced"] = F.size(found) > 0
        columns[f"{name}_spellings"] = F.size(F.array_distinct(found))
    out = out.select(*df.columns, *[c.alias(f"p_{n}") for n, c in columns.items()])
    return out.withColumn("p_has_text_layer", F.col("p_chars_per_sampled_page") >= LEAST_CHARS).withColumn("p_has_toc", F.col("p_has_toc_heading") | (F.col("p_toc_leader_lines") >= LEADER_LINES))


def order_statistics(df: DataFrame, column: str, ranks: dict[str, Column], *keys: str) -> DataFrame:
    """For each group its number of values n (nulls don't count) and the values at some ranks, each an expression over n (from 0, in ascending order).

    Exact selection in bounded memory: equal values are counted with map-side aggregation, the counts are summed up by ranges of
    (group, value), and a rank's value is the one whose interval of ranks has it. One group may have all rows.
    """
    value = F.col(f"`{column}`")
    counted = df.where(value.isNotNull()).groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__c"))
    upto = running_sums(counted, list(keys), ["__v"], "__c", "__upto")
    sizes = upto.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.sum("__c").alias("n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    placed = upto.join(sizes if keys else F.broadcast(sizes), same)
    found = [F.max(F.when((r >= F.col("__upto") - F.col("__c")) & (r < F.col("__upto")), F.col("__v"))).alias(name) for name, r in ranks.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *found)


def quantiles(df: DataFrame, column: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Quantiles by linear interpolation between the two values around rank share x (n - 1)."""
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    ranks = {f"__low_{name}": F.floor(p) for name, p in place.items()} | {f"__high_{name}": F.ceil(p) for name, p in place.items()}
    out = order_statistics(df, column, ranks, *keys)

    def between(name: str) -> Column:
        low, high = (F.col(f"__{side}_{name}").cast("double") for side in ("low", "high"))
        return low + (high - low) * (place[name] - F.floor(place[name]))

    return out.select(*keys, *[between(name).alias(name) for name in shares])


def quartiles(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Least, quartiles by linear interpolation, and greatest."""
    kind = df.schema[column].dataType
    out = quantiles(df, column, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, *keys)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("min", "max")})


def upper_median(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """The middle value, the higher one of two."""
    return order_statistics(df, column, {"upper_median": F.floor(F.col("n") / 2)}, *keys).drop("n")


def distinct_counts(df: DataFrame, counted: dict[str, list[str]], *keys: str) -> DataFrame:
    """For each name, how many distinct combinations of its columns there are; nulls in all of them don't count."""
    return df.groupBy(*keys).agg(*[F.count_distinct(*[F.col(f"`{c}`") for c in columns]).alias(name) for name, columns in counted.items()])


def summarise(profile: DataFrame, *keys: str) -> DataFrame:
    """Counts of flags and their percentages of the documents that have text."""
    flags = ["has_toc", "part_i", "part_ii", "part_iii", "consumer_information", "patient_medication_information", "numbered_sections", "french"]
    readable = F.count_if("p_has_text_layer")
    counts = [F.count("*").alias("documents"), readable.alias("with_text")]
    for f in flags:
        n = F.count_if(F.col("p_has_text_layer") & F.col(f"p_{f}"))
        counts += [n.alias(f"n_{f}"), F.round(100 * n / F.greatest(readable, F.lit(1)), 1).alias(f"pct_{f}")]
    for h in HEADINGS:
        counts += [F.count_if(F.col(f"p_{h}_plain")).alias(f"{h}_plain"), F.count_if(F.col(f"p_{h}_spaced") & ~F.col(f"p_{h}_plain")).alias(f"{h}_tolerant"), F.count_if(~F.col(f"p_{h}_spaced")).alias(f"{h}_missing")]
    every = F.lit(True)
    for h in HEADINGS:
        every = every & F.col(f"p_{h}_spaced")
    return profile.groupBy(*keys).agg(*counts, F.count_if(every).alias("all_sections"))
