"""Section location in paged documents: one parameterised locator of native expressions instead of a module for each section.

Input rows have `pages`, an array of (page_num, text) without empty pages. First match means: the pattern list's order first, then the
leftmost match. A start page without a header line loses its text unless keep_headerless is set.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import flexible, sealed

PAGES = "array<struct<page_num:int,text:string>>"

# --- Fixed values: section titles in the order in which they are tried. ------------------
INDICATIONS = ("INDICATIONS AND CLINICAL USE", "INDICATIONS", "INDICATIONS OF USE", "INDICATIONS AND USAGE", "THERAPEUTIC INDICATIONS")
CONTRAINDICATIONS = ("CONTRAINDICATIONS", "CONTRAINDICATIONS AND PRECAUTIONS", "ABSOLUTE CONTRAINDICATIONS", "RELATIVE CONTRAINDICATIONS")
INTERACTIONS = ("DRUG INTERACTIONS", "DRUG INTERACTION", "DRUG-DRUG INTERACTIONS", "INTERACTIONS WITH DRUGS", "INTERACTIONS")
KINETICS = ("PHARMACOKINETICS",)
DYNAMICS = ("MECHANISM OF ACTION", "PHARMACODYNAMICS", "ACTION AND CLINICAL PHARMACOLOGY", "CLINICAL PHARMACOLOGY")
KINETICS_ENDS = ("Special Populations and Conditions", "Special Populations", "Congestive Heart Failure", "Heart Failure")
AFTER_INTERACTIONS = (
    "CLINICAL PHARMACOLOGY", "CLINICAL PHARMACOKINETICS", "PHARMACOLOGY", "PHARMACOKINETICS", "PHARMACODYNAMICS", "ACTION AND CLINICAL PHARMACOLOGY", "MECHANISM OF ACTION",
    "DOSAGE AND ADMINISTRATION", "DOSAGE & ADMINISTRATION", "DOSAGE", "DOSING AND ADMINISTRATION", "DOSING", "ADMINISTRATION", "ADVERSE REACTIONS", "CONTRAINDICATIONS",
    "WARNINGS AND PRECAUTIONS", "WARNINGS", "PRECAUTIONS", "CLINICAL STUDIES", "CLINICAL TRIALS", "STORAGE AND STABILITY", "OVERDOSAGE", "HOW SUPPLIED",
    "DOSAGE FORMS AND STRENGTHS", "SUPPLIED", "PRESENTATION", "PACKAGING",
)
DOSAGE = (r"DOSAGE\s+AND\s+ADMINISTRATION", r"DOSAGE\s+AND\s+ADMINISTR\s*ATION", r"DOSAGE\s+AND\s+ADMINISTRAT\s*ION", r"DOSAGE\s+AND\s+ADMIN\s*ISTRATION", r"DOSAGE\s+&?\s*ADMINISTRATION", r"DOSAGE\s+ADMINISTRATION")
# --- End of fixed values. ---------------------------------------------------------------------------------------------


def _flex(titles) -> tuple[str, ...]:
    return tuple(flexible(t) for t in titles)


@dataclass(frozen=True)
class Locator:
    """How one section is found. Titles are patterns; shapes are 1-4: number and leaders, number and page, leaders, page."""

    titles: tuple[str, ...]
    toc_pages: int = 8
    shapes: tuple[int, ...] = (1, 2, 3)
    page_first: str | None = None
    both_words: tuple[str, str] | None = None
    body: str = "top5"
    body_titles: tuple[str, ...] | None = None
    default_start: int | None = None
    next_number: bool = True
    next_toc: tuple[str, ...] = ()
    next_toc_pages: int = 10
    next_after_start: bool = True
    next_body: tuple[str, ...] = ()
    next_where: str = "top3"
    next_other: tuple[str, ...] = ()
    span: int = 5
    capped: bool = True
    most_pages: int | None = None
    headers: tuple[str, ...] = ()
    marker: str | None = None
    chars: int | None = None
    missing: str = "EXTRACTION_FAILED"
    extra: dict = field(default_factory=dict)


# --- Fixed values: which titles, words and shapes tell each section's start and end. ------------------------------------
SECTIONS = {
    "indications": Locator(_flex(INDICATIONS), next_body=_flex(("CONTRAINDICATIONS", "CONTRAINDICATIONS AND PRECAUTIONS", "WARNINGS AND PRECAUTIONS", "DOSAGE AND ADMINISTRATION")), headers=_flex(INDICATIONS[:3]), chars=6000),
    "contraindications": Locator(_flex(CONTRAINDICATIONS), next_body=_flex(("SERIOUS WARNINGS AND PRECAUTIONS BOX", "WARNINGS AND PRECAUTIONS", "WARNINGS", "PRECAUTIONS", "DOSAGE AND ADMINISTRATION")), span=4, headers=_flex(CONTRAINDICATIONS[:2]), chars=6000),
    "adverse": Locator((r"ADVERSE\s+REACTIONS?",), 3, (1, 2, 3, 4), body="none", default_start=9, next_number=False, next_toc=(r"DRUG\s+INTERACTIONS?",), next_toc_pages=3, next_after_start=False, capped=False, headers=(r"ADVERSE\s+REACTIONS?",), marker="", chars=6000, missing="CONTENT_EXTRACTION_FAILED"),
    "interactions": Locator(_flex(INTERACTIONS), 5, (1, 2, 3, 4), page_first="|".join(_flex(INTERACTIONS)), both_words=(r"D\s*R\s*U\s*G", r"I\s*N\s*T\s*E\s*R\s*A\s*C\s*T\s*I\s*O\s*N\s*S?"), body="anywhere", next_toc=_flex(AFTER_INTERACTIONS), next_body=_flex(AFTER_INTERACTIONS), next_where="numbered", span=9, capped=False, most_pages=10, headers=_flex(("DRUG INTERACTIONS",)), marker="", chars=6000),
    "dosage": Locator(DOSAGE, 3, (1, 2, 3, 4), page_first=r"DOSAGE\s+AND\s+ADMINISTRATION|DOSAGE\s+ADMINISTRATION", both_words=("DOSAGE", "ADMINISTR"), body="anywhere", next_number=False, next_toc=("OVERDOSAGE",), next_toc_pages=5, next_after_start=False, next_body=("OVERDOSAGE",), next_where="anywhere", next_other=("ACTION AND CLINICAL PHARMACOLOGY", "STORAGE AND STABILITY", "DOSAGE FORMS"), capped=False, headers=(r"DOSAGE\s+AND\s+ADMINISTRATION",), marker=""),
    "kinetics": Locator(_flex(KINETICS), body="lines", next_body=_flex(KINETICS_ENDS), next_where="lines", span=10, most_pages=10, headers=_flex(("PHARMACOKINETICS", "CLINICAL PHARMACOLOGY"))),
    "dynamics": Locator(_flex(DYNAMICS), body="lines", next_body=_flex(("PHARMACOKINETICS", *KINETICS_ENDS)), next_where="lines", span=3, most_pages=10, headers=_flex(DYNAMICS)),
}
# --- End of fixed values. ---------------------------------------------------------------------------------------------

def _any_of(titles) -> str:
    return "(?i)" + "|".join(dict.fromkeys(f"(?:{t})" for t in titles))


#: Any title with which a section of SECTIONS starts.
_STARTS = _any_of(t for s in SECTIONS.values() for t in s.titles)


def toc(pages: Column, n: int) -> Column:
    """The first n pages that have text, with their numbers."""
    one = lambda p: F.concat(F.lit("\n--- PAGE "), p["page_num"].cast("string"), F.lit(" ---\n"), p["text"], F.lit("\n"))
    return F.array_join(F.transform(F.slice(pages, 1, n), one), "")


ENTRIES = "array<struct<text:string,number:string,page:int,last:boolean,leaders:boolean,blank:boolean,before:string,at:int,ends_on:int>>"
#: Pages that the longest contents buffer has.
CONTENTS_PAGES = 10


def entries_of(pages: Column, titles: str = _STARTS, numbered: bool = True, most: int = CONTENTS_PAGES) -> Column:
    """The contents buffer of the first pages, parsed once for all sections: an entry for each stretch without digits that has one of the titles or, if asked for, is numbered.

    A contents pattern is a title, then no digit up to a page number, and maybe a section number right before it. So a title, its leaders and
    its page are always one stretch between two numbers and the number that ends it. Entries have the stretch's text and the section number before it
    (`7`, `7.1`), the page that ends it (null in the `last` stretch), whether leaders or a blank stand before the page, the digits before the stretch, its place, and the
    page on which the number that ends it stands, as a place in `pages`. A page's heading counts as part of the buffer, so its number can end a stretch.
    """

    def of_page(p: Column, k: Column) -> Column:
        following = F.get(pages, k + 1)
        text = F.concat(F.lit(" ---\n"), p["text"], F.lit("\n"), F.when(following.isNotNull() & (k + 1 < most), "\n--- PAGE ").otherwise(""))
        parts = F.struct(F.split(text, r"\d+", -1).alias("s"), F.concat(F.array(p["page_num"].cast("string")), F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), F.when(following.isNotNull() & (k + 1 < most), F.array(following["page_num"].cast("string"))).otherwise(F.array().cast("array<string>"))).alias("d"))

        def entry(x: Column, i: Column, own: Column) -> Column:
            digits, rest = own["d"], own["s"]
            ends, after = F.get(digits, i + 1), F.get(rest, i + 1)
            decimal = (i > 1) & (F.get(rest, i - 1) == ".")
            number = F.when(x.rlike(r"^\.\s"), F.concat(F.get(digits, i), F.lit("."))).when(decimal, F.concat(F.get(digits, i - 1), F.lit("."), F.get(digits, i))).otherwise(F.get(digits, i))
            marker = i == F.size(rest) - 1
            return F.struct(
                x.alias("text"), number.alias("number"), ends.try_cast("int").alias("page"), ends.isNull().alias("last"), x.rlike(r"\.\.\s*\z").alias("leaders"),
                (x.rlike(r"\s\z") & (after.isNull() | (after == "") | after.rlike(r"^\s"))).alias("blank"), F.get(digits, i).alias("before"), i.alias("at"), (k + F.when(marker, 1).otherwise(0)).cast("int").alias("ends_on"),
            )

        titled = lambda x: x.rlike(titles)
        wanted = (lambda x: titled(x) | (x.rlike(r"^\.?\s+[A-Za-z][A-Za-z\s]") & x.rlike(r"\.\.\s*\z"))) if numbered else titled
        made = F.transform(F.array(parts), lambda own: F.transform(own["s"], lambda x, i: F.when(wanted(x), entry(x, i, own))))
        return F.filter(F.flatten(made), lambda e: e.isNotNull())

    return F.flatten(F.transform(F.slice(pages, 1, most), of_page)).cast(ENTRIES)


def with_entries(df: DataFrame, pages: str = "pages", name: str = "contents") -> DataFrame:
    """df with its parsed contents, for several calls of locate."""
    return sealed(df, {name: entries_of(F.col(pages))})


def _within(entries: Column, n: int) -> Column:
    """Entries whose page number stands on the first n pages; the stretch at the buffer's end has none, and is there too."""
    return F.filter(entries, lambda e: e["ends_on"] < n)


def _entry_hits(entries: Column, title: str, shape: int) -> Column:
    """Entries of a title by shape: 1 number and leaders, 2 number and page, 3 leaders, 4 page."""
    leads = rf"^\.?\s+(?:{title})" if shape in (1, 2) else title
    tail = "leaders" if shape in (1, 3) else "blank"
    return F.filter(entries, lambda e: ~e["last"] & e[tail] & e["text"].rlike(f"(?i){leads}"))


def _hit(entries: Column, title: str, shape: int) -> Column:
    """(page, number) of the first entry, or null."""
    first = F.get(_entry_hits(entries, title, shape), F.lit(0))
    number = first["number"] if shape in (1, 2) else F.lit(None).cast("string")
    return F.when(first.isNotNull(), F.struct(first["page"].alias("page"), number.alias("number")))


def _numbered(entries: Column) -> Column:
    """(num, i, page) of numbered entries in capitals with leaders, in order. A page number that ends an entry isn't the next one's section number, nor the first part of it."""
    some = F.filter(entries, lambda e: ~e["last"] & e["leaders"] & e["text"].rlike(r"^\.?\s+[A-Za-z][A-Za-z\s]"))
    behind = lambda a, e, n: F.coalesce((a["ends_on"] == e["ends_on"]) & (a["at"] == e["at"] - n), F.lit(False))
    latest = lambda kept: F.get(kept, F.size(kept) - 1)
    own = lambda kept, e: e.withField("number", F.when(behind(latest(kept), e, 2), e["before"]).otherwise(e["number"]))
    kept = F.aggregate(some, F.array().cast(ENTRIES), lambda kept, e: F.when(behind(latest(kept), e, 1), kept).otherwise(F.concat(kept, F.array(own(kept, e)))))
    return F.transform(kept, lambda e, i: F.struct(number_value(e["number"]).alias("num"), i.alias("i"), e["page"].alias("page")))


def _first_page(pages: Column, holds) -> Column:
    return F.get(F.filter(pages, holds), F.lit(0))["page_num"]


def _heading(titles, where: str):
    """Whether a page's text has one of the titles where it must be."""
    any_title = "|".join(f"(?:{t})" for t in titles)
    if where == "anywhere":
        return lambda p: p["text"].rlike(f"(?i)(?:{any_title})")
    if where == "lines":
        return lambda p: p["text"].rlike(rf"(?im)^\s*(?:{any_title})\s*$")
    top = int(where[3:])
    return lambda p: F.exists(F.slice(F.split(p["text"], "\n"), 1, top), lambda line: line.rlike(rf"(?i)^\s*(?:{any_title})\s*$"))


def _beside(text: Column, words: tuple[str, str]) -> Column:
    """Page number at the end of the first line that has both words, or alone on the line after it."""
    lines = F.split(text, "\n")
    here = lambda line, i: F.when(line.rlike(f"(?i){words[0]}") & line.rlike(f"(?i){words[1]}"), F.coalesce(F.nullif(F.regexp_extract(line, r"(\d+)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(F.get(lines, i + 1), r"^\s*(\d+)\s*$", 1), F.lit(""))))
    page = F.get(F.filter(F.transform(lines, here), lambda x: x.isNotNull()), F.lit(0)).try_cast("int")
    return F.when(page.isNotNull(), F.struct(page.alias("page"), F.lit(None).cast("string").alias("number")))


def start_of(pages: Column, entries: Column, text: Column, spec: Locator) -> Column:
    """(page, number) of the section's start; entries and text are those of its contents buffer."""
    plain = lambda page: F.when(page.isNotNull(), F.struct(page.cast("int").alias("page"), F.lit(None).cast("string").alias("number")))
    tries = [_hit(entries, t, s) for t in spec.titles for s in spec.shapes]
    if spec.page_first:
        ahead = F.get(F.filter(entries, lambda e: e["text"].rlike(rf"(?i)^\s+\.{{2,}}\s+(?:{spec.page_first})")), F.lit(0))
        tries.append(plain(ahead["before"].try_cast("int")))
    tries = [F.when(F.size(entries) > 0, F.coalesce(*tries))]
    if spec.both_words:
        tries.append(_beside(text, spec.both_words))
    if spec.body != "none":
        tries.append(plain(_first_page(pages, _heading(spec.body_titles or spec.titles, spec.body))))
    if spec.default_start:
        tries.append(plain(F.lit(spec.default_start)))
    return F.coalesce(*tries)


def number_value(c: Column) -> Column:
    """Section numbers compare as numbers, so 7.10 is 7.1."""
    return c.try_cast("double")


#: A heading's number; longer ones that begin a line, such as an account's, are prose.
SECTION_NUMBER = r"\d{1,2}(?:\.\d{0,2})?"


def end_of(pages: Column, start: Column, number: Column, entries: Column, near: Column, spec: Locator) -> Column:
    """Page on which the section ends; entries and near are those for numbered and for named entries."""
    tries = []
    if spec.next_number:
        later = F.filter(_numbered(entries), lambda e: (e["num"] > number_value(number)) & (e["page"] > start))
        tries.append(F.when(number.isNotNull(), F.array_min(later)["page"]))
    if spec.next_toc:
        numbers = F.flatten(F.array(*[F.transform(_entry_hits(near, t, s), lambda e: e["page"]) for t in spec.next_toc for s in (1, 2, 3, 4)]))
        numbers = F.filter(numbers, lambda x: x > start) if spec.next_after_start else numbers
        tries.append(F.when(F.size(near) > 0, F.get(numbers, F.lit(0))))
    behind = F.filter(pages, lambda p: p["page_num"] > start)
    if spec.next_where == "numbered":
        own = _heading(spec.next_body, "lines")

        def ends(p):
            first = F.nullif(F.regexp_extract(p["text"], rf"(?im)^\s*({SECTION_NUMBER})\s+[A-Z][A-Z\s]+", 1), F.lit(""))
            return (first.isNotNull() & (number.isNull() | (number_value(first) > number_value(number)))) | own(p)

        tries.append(_first_page(behind, lambda p: F.coalesce(ends(p), F.lit(False))))
    elif spec.next_body:
        tries.append(_first_page(behind, _heading(spec.next_body, spec.next_where)))
    if spec.next_other:
        tries.append(_first_page(behind, _heading(spec.next_other, "anywhere")))
    last = start + spec.span
    tries.append(F.least(last, F.size(pages)) if spec.capped else last)
    end = F.coalesce(*tries)
    return F.least(end, start + spec.most_pages - 1) if spec.most_pages else end


def slice_of(pages: Column, start: Column, end: Column, headers, marker: str | None, keep_headerless: bool = False) -> Column:
    """Text of the pages from start to end; the first one from its first header line on."""
    header = f"(?i){'|'.join(f'(?:{h})' for h in headers)}"

    def body(p):
        lines = F.split(p["text"], "\n")
        flags = F.transform(lines, lambda line: line.rlike(header))
        at = F.array_position(flags, F.lit(True)).cast("int")
        trimmed = F.when(at > 0, F.array_join(F.slice(lines, at, F.size(lines)), "\n"))
        if keep_headerless:
            trimmed = F.coalesce(trimmed, p["text"])
        text = F.when(p["page_num"] == start, trimmed).otherwise(p["text"])
        if marker is None:
            return text
        label = F.concat(F.lit("\n--- PAGE "), p["page_num"].cast("string"), F.lit(f" ({marker}) ---\n" if marker else " ---\n"))
        return F.concat(label, text)

    parts = F.filter(F.transform(F.filter(pages, lambda p: (p["page_num"] >= start) & (p["page_num"] <= end)), body), lambda t: t.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def locate(df: DataFrame, section: str, pages: str = "pages", keep_headerless: bool = False, contents: str | None = None) -> DataFrame:
    """Several sections share a column that with_entries made (contents). df with `<section>_start`, `_number`, `_end`, `_text` and `_status`: ok, NO_TEXT_FOUND, SECTION_NOT_FOUND or what failed."""
    spec = SECTIONS[section]
    name = lambda x: f"{section}_{x}"
    col = F.col(pages)
    out = df if contents else with_entries(df, pages, "__contents_")
    every = F.col(contents or "__contents_")
    out = out.withColumn("__toc", toc(col, spec.toc_pages) if spec.both_words else F.lit(None).cast("string"))
    out = out.withColumn("__start", start_of(col, _within(every, spec.toc_pages), F.col("__toc"), spec))
    out = out.withColumn(name("start"), F.col("__start.page")).withColumn(name("number"), F.col("__start.number"))
    # What ends a section is looked for only where it starts.
    near = entries_of(col, _any_of(spec.next_toc), False, spec.next_toc_pages) if spec.next_toc else every
    out = out.withColumn("__near", F.when(F.col(name("start")).isNotNull(), near))
    end = end_of(col, F.col(name("start")), F.col(name("number")), every, F.col("__near"), spec)
    out = out.withColumn(name("end"), F.when(F.col(name("start")).isNotNull(), end))
    text = slice_of(col, F.col(name("start")), F.col(name("end")), spec.headers, spec.marker, keep_headerless)
    out = out.withColumn(name("text"), F.substring(text, 1, spec.chars) if spec.chars else text)
    empty = F.coalesce(F.size(col), F.lit(0)) <= 0
    status = F.when(empty, "NO_TEXT_FOUND").when(F.col(name("start")).isNull(), "SECTION_NOT_FOUND").when(F.col(name("text")).isNull(), spec.missing).otherwise("ok")
    return sealed(out, {**{name(x): F.col(name(x)) for x in ("start", "number", "end", "text")}, name("status"): status})


@dataclass(frozen=True)
class Population:
    """A subsection on a population: contents entries (the last match of a list wins), page headers, stop headers."""

    direct: tuple[str, ...]
    special: tuple[str, ...]
    within: str
    headers: tuple[str, ...]
    stops: tuple[str, ...]
    late_stops: tuple[str, ...]
    marker: str


# --- Fixed values: patterns of the population subsections. --------------------------------------------------------------
_SPECIAL = (r"Special\s+Populations[^\d]*\.{2,}\s*(\d+)", r"7\.1\s+Special\s+Populations[^\d]*\.{2,}\s*(\d+)")
POPULATIONS = {
    "pregnancy": Population(
        (r"Pregnant\s*Women[^\d]*\.{2,}\s*(\d+)", r"Pregnancy[^\d]*\.{2,}\s*(\d+)", r"7\.\d+\.?\d*\s+Pregnant\s+Women[^\d]*\.{2,}\s*(\d+)"),
        _SPECIAL, r"Pregnant\s+Women|Pregnancy",
        (r"7\.1\.1\s+Pregnant\s+Women", r"Pregnant\s+Women", r"Pregnancy\s+-\s+", r"Use in Pregnancy", r"Pregnancy and Lactation"),
        ("Breast-feeding", "Nursing", "Pediatrics", "Geriatrics", "7.1.2", "7.1.3"), ("7.2", "8 ADVERSE REACTIONS"), "Pregnancy Section",
    ),
    "breastfeeding": Population(
        (r"Breast[- ]feeding[^\d]*\.{2,}\s*(\d+)", r"Nursing\s+Women[^\d]*\.{2,}\s*(\d+)", r"Lactation[^\d]*\.{2,}\s*(\d+)", r"7\.\d+\.?\d*\s+Breast[- ]feeding[^\d]*\.{2,}\s*(\d+)", r"Breastfeeding\s+-\s+Risk\s+Summary[^\d]*\.{2,}\s*(\d+)"),
        _SPECIAL, r"Breast[- ]feeding|Nursing|Lactation",
        (r"7\.1\.2\s+Breast[- ]feeding\s+Women", r"7\.1\.2\s+Nursing\s+Women", r"7\.1\.2\s+Lactation", r"Breast[- ]feeding\s+Women", r"Nursing\s+Women", r"Lactation\s+-\s+", r"Use in Breastfeeding", r"Pregnancy and Lactation", r"Breastfeeding\s+-\s+Risk\s+Summary"),
        ("Pregnancy", "Pregnant", "Pediatrics", "Geriatrics", "7.1.1", "7.1.3"), ("7.2", "8 ADVERSE REACTIONS"), "Breastfeeding Section",
    ),
}
# --- End of fixed values. ---------------------------------------------------------------------------------------------


def _stops(headers) -> str:
    """Pattern of stop headers. Those that are section numbers stand at the start of a line and by themselves, as digits within prose, or in an address, are none."""
    return "(?im)" + "|".join(rf"^\s*{re.escape(h)}(?!\.?\w)" if re.fullmatch(r"[\d.]+", h) else h for h in headers)


def locate_population(df: DataFrame, which: str, pages: str = "pages") -> DataFrame:
    """df with `<which>_start`, `_end` and `_text`. In the contents the last match wins; stop headers end the subsection, else two pages on."""
    spec, col = POPULATIONS[which], F.col(pages)
    text = toc(col, 5)
    last = lambda patterns: F.element_at(F.filter(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), 1) for p in patterns])), lambda x: x != ""), -1).try_cast("int")
    some = lambda patterns: F.when(F.exists(F.array(*[text.rlike("(?i)" + p) for p in patterns]), lambda x: x), last(patterns))
    out = df.withColumn("__direct", some(spec.direct)).withColumn("__special", some(spec.special))
    inside = _first_page(F.filter(col, lambda p: p["page_num"] >= F.col("__special")), lambda p: p["text"].rlike("(?i)" + spec.within))
    out = out.withColumn("__inside", F.when(F.col("__special").isNotNull(), inside))
    out = out.withColumn("__scan", _first_page(col, lambda p: p["text"].rlike("(?i)" + "|".join(spec.headers))))
    out = out.withColumn(f"{which}_start", F.coalesce("__direct", "__inside", "__scan"))
    start = F.col(f"{which}_start")
    behind = F.filter(col, lambda p: p["page_num"] > start)
    few, all_ = _stops(spec.stops), _stops((*spec.stops, *spec.late_stops))
    stop = F.when(F.col("__direct").isNull() & F.col("__inside").isNotNull(), _first_page(behind, lambda p: p["text"].rlike(few))).otherwise(_first_page(behind, lambda p: p["text"].rlike(all_)))
    out = out.withColumn(f"{which}_end", F.when(start.isNotNull(), F.coalesce(stop, start + 2)))
    return out.withColumn(f"{which}_text", slice_of(col, start, F.col(f"{which}_end"), (spec.within,), spec.marker)).drop("__direct", "__special", "__inside", "__scan")


def fixed_pages(pages: Column, numbers: tuple[int, ...]) -> Column:
    """Text of physical pages, joined by newlines and stripped; pages that don't exist are skipped."""
    return F.trim(F.array_join(F.transform(F.filter(pages, lambda p: p["page_num"].isin(*numbers)), lambda p: p["text"]), "\n"))
