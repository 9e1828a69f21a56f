"""Sections, subsections, field texts and located pages of all documents, into which headings, contents and outlines are woven by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locate as L
from ..operators import passages as P
from ..operators import profile as R
from ..operators import sections as X
from .list_queries import _strip, _t
from .woven import outlined, outlined_sql, with_contents, with_contents_sql

_FOUND = ("indications", "contraindications", "warnings", "adverse")
_PATTERNS = ("renal", "WARN", "PART II")

#: Located sections: what is shown, section, pages; start and end (moved by the shift unless negative, which means fixed), whether the start page has a header of the section.
_LOCATED = [
    ("numbered", "indications", ["1.1 INDICATIONS...........{2}\n2 CONTRAINDICATIONS.....{3}", "INDICATIONS\nx", "CONTRAINDICATIONS\ny"], 2, 3, True),
    ("blank", "contraindications", ["1.1 CONTRAINDICATIONS {2} \n3 WARNINGS {3} ", "CONTRAINDICATIONS\nx", "WARNINGS AND PRECAUTIONS\ny"], 2, 3, True),
    ("by name", "adverse", ["ADVERSE REACTIONS....{2}\nDRUG INTERACTIONS...{3}", "ADVERSE REACTIONS\nx", "DRUG INTERACTIONS"], 2, 3, True),
    ("next page's number", "interactions", ["contents\n{2} .... DRUG INTERACTIONS", "DRUG INTERACTIONS\nx", "9 OTHER MATTERS\ny", "z"], -2, 3, False),
    ("beside", "dosage", ["x DOSAGE and ADMINISTR notes {2}", "DOSAGE AND ADMINISTRATION\nx", "OVERDOSAGE\ny"], 2, 3, True),
    ("body lines", "kinetics", ["a", "PHARMACO KINETICS\nx", "Special Populations\nb", "c"], 2, 3, True),
    ("next body", "dynamics", ["a", "MECHANISM OF ACTION\nx", "PHARMACOKINETICS\ny"], 2, 3, True),
    ("seven ten", "indications", ["7.1 INDICATIONS....{2}\n7.10 WARNINGS....{3}\n7.2 DOSAGE....{4}", "INDICATIONS", "x", "y", "z"], 2, 4, True),
    ("span", "contraindications", ["cover", "CONTRA INDICATIONS\nx", "b", "c", "d", "e", "f"], 2, 6, True),
    ("no header", "indications", ["1 INDICATIONS.....{2}\n2 WARNINGS.....{3}", "no header here", "WARNINGS\nx"], 2, 3, False),
]
#: Documents of one page, with fixed starts and ends: a page number before its title, a default, nothing.
_ONE_PAGE = [("page first", "interactions", ["contents\n{2} .... DRUG INTERACTIONS"], 2, 11), ("default", "adverse", ["nothing"], 9, 14), ("nothing", "indications", ["nothing"], None, None), ("no pages", "indications", [], None, None)]
#: Population subsections: the last entry of the contents wins, special populations are searched from their page on, headers are the last resort.
_POPULATIONS = [
    ("last wins", "pregnancy", ["Pregnant Women.....{2}\nPregnancy.....{3}", "x", "Pregnancy\nbe careful", "Nursing"], 3, 4, True),
    ("special", "breastfeeding", ["Special Populations.....{2}", "x", "Nursing women\nfeed with care", "Geriatrics\nold"], 3, 4, True),
    ("header", "pregnancy", ["a", "7.1.1 Pregnant Women\nnone known", "b"], 2, 4, True),
    ("nothing", "breastfeeding", ["a", "b"], None, None, False),
]
#: Profiles: with contents and four numbered headings; broken and plain ones; the other parts; nothing.
_PROFILES = [
    ["PRODUCT MONOGRAPH\nTABLE OF CONTENTS\nPART I\n1 INDICATIONS............3\n2 CONTRAINDICATIONS......4\n7.1 ADVERSE REACTIONS.....5\n9 DRUG INTERACTIONS......6"],
    ["INDI CATIONS 2\nCONTRAINDICATIONS 3", "CONSUMER INFORMATION"],
    ["MONOGRAPHIE DE PRODUIT", "PART II", "PART III", "PATIENT MEDICATION INFORMATION"],
    ["cover"],
]


def find_sections(spark, sf_dir):
    """Every section of all documents, by outline or by headings."""
    found = outlined(spark, sf_dir).select("doc_id", X.sections(F.col("pages"), F.col("outline")).alias("found"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"found.{f}").alias("x")) for f in X.HEADINGS])
    return found.select("doc_id", F.inline(rows)).select("doc_id", "field", "x.how", "x.text").where("text is not null")


def find_subsections(spark, sf_dir):
    """Subsections by outline, of any depth; the patient part isn't searched."""
    found = outlined(spark, sf_dir).select("doc_id", X.subsections(F.col("pages"), F.col("outline"), _PATTERNS).alias("found"))
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col("found")[n].alias("text")) for n, p in enumerate(_PATTERNS)])
    return found.select("doc_id", F.inline(rows))


def field_texts(spark, sf_dir):
    """What is asked about for some fields of all documents: sections, tidied."""
    return P.field_texts(outlined(spark, sf_dir)).select("doc_id", "contraindications", "adverse", "serious")


def pharmacology_passage(spark, sf_dir):
    """The characters from the heading on special populations on, which stands before a document's second half; odd documents have none."""
    half = F.expr("cast(length(text) / 2 as int)")
    heading = F.when(F.col("doc_id") % 2 == 0, "\nSpecial  Populations and\nConditions\n").otherwise("\n")
    full = F.concat(F.expr("substring(text, 1, cast(length(text) / 2 as int))"), heading, F.col("text").substr(half + 1, F.length("text")))
    return _t(spark, sf_dir, "documents").select("doc_id", P.pharmacology(full).alias("passage"))


def _located(spark, sf_dir, templates, one_page=False):
    docs, out = with_contents(spark, sf_dir, [t[2] for t in templates], one_page), None
    for section in dict.fromkeys(t[1] for t in templates):
        mine = docs.where(F.col("k").isin([k for k, t in enumerate(templates) if t[1] == section]))
        c = lambda x: F.col(f"{section}_{x}")
        part = L.locate(mine, section).select("doc_id", F.lit(section).alias("section"), c("start").alias("start"), c("end").alias("stop"), c("status").alias("status"), F.coalesce(F.md5(c("text")), F.lit("none")).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def locate_families(spark, sf_dir):
    """Start, end, status and text of sections by each family of patterns, in all documents."""
    return _located(spark, sf_dir, _LOCATED)


def toc_locate_first_match(spark, sf_dir):
    """Sections of documents of one page."""
    return _located(spark, sf_dir, _ONE_PAGE, True)


def locate_populations(spark, sf_dir):
    """Start, end and text of population subsections, in all documents."""
    docs, out = with_contents(spark, sf_dir, [t[2] for t in _POPULATIONS]), None
    for name in dict.fromkeys(t[1] for t in _POPULATIONS):
        mine = docs.where(F.col("k").isin([k for k, t in enumerate(_POPULATIONS) if t[1] == name]))
        part = L.locate_population(mine, name)
        part = part.select("doc_id", F.lit(name).alias("section"), F.col(f"{name}_start").alias("start"), F.col(f"{name}_end").alias("stop"), F.coalesce(F.md5(f"{name}_text"), F.lit("none")).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


def profile_summary(spark, sf_dir):
    """Summary of the profiles of all documents."""
    return R.summarise(R.analyse(with_contents(spark, sf_dir, _PROFILES)))


def fixed_page_text(spark, sf_dir):
    """Pages 2 and 4 of the outlined documents, and a page that none has."""
    return outlined(spark, sf_dir).select("doc_id", F.md5(L.fixed_pages(F.col("pages"), (2, 4, 99))).alias("digest"))


QUERIES = {f.__name__: f for f in (find_sections, find_subsections, field_texts, pharmacology_passage, locate_families, toc_locate_first_match, locate_populations, profile_summary, fixed_page_text)}

# --- DuckDB forms -----------------------------------------------------------------------------------------------------

#: Sections as they lie between the headings; by headings only where the 400 characters from a heading on don't look like contents.
_SECTIONS = f"""{outlined_sql()},
b AS (SELECT doc_id, doc_id % 3 <> 1 AS o, p1 || chr(10) || p2 || chr(10) || p3 || chr(10) || p4 || chr(10) || p5 || chr(10) || p6 AS t, length(p1) + 4 AS ind, length(p1) + length(p2) + 29 AS con, length(p1) + length(p2) + length(p3) + 6 AS war, p1, p2, p3, p4, p5 FROM w),
h AS (SELECT *, length(p1) + length(p2) + length(p3) + length(p4) + 7 AS adv, length(p1) + length(p2) + length(p3) + length(p4) + length(p5) + 6 AS two, war - 1 + instr(substr(t, war), chr(10) || '8 PRECAUTIONS') + 3 AS pre FROM b),
e AS (SELECT doc_id, o, t, unnest(['indications', 'contraindications', 'warnings', 'warnings', 'adverse']) AS field, unnest([1, 1, 1, 2, 1]) AS turn, unnest([ind, con, war, pre, adv]) AS fro, unnest([con, war, adv, adv, two]) AS til,
 unnest([con - 2, war - 2, adv - 2, adv - 2, two]) AS line FROM h),
s AS (SELECT doc_id, field, turn, CASE WHEN o THEN 'bookmarks' ELSE 'text search' END AS how, {_strip("CASE WHEN o THEN substr(t, fro, til - fro) ELSE substr(t, fro, line - fro) END")} AS text FROM e
 WHERE (o AND turn = 1) OR (NOT o AND len(regexp_extract_all(substr(t, fro, 400), '[A-Za-z]{{4,}}')) >= 15 AND NOT regexp_matches(substr(t, fro, 400), '\\.{{4,}}|(\\.\\s){{4,}}'))),
f AS (SELECT doc_id, field, arg_min(how, turn) AS how, arg_min(text, turn) AS text FROM s GROUP BY doc_id, field)"""


def _tidy_sql(c: str) -> str:
    lines = f"list_sort(list_transform(list_filter(string_split({c}, chr(10)), lambda x: {_strip('x')} <> ''), lambda x: length({_strip('x')})))"
    joined = f"regexp_replace(regexp_replace(regexp_replace({c}, '[ \\t]*\\n[ \\t]*(\\n[ \\t]*)*', ' ', 'g'), '(\\w) - (\\w)', '\\1-\\2', 'g'), '[ \\t]{{2,}}', ' ', 'g')"
    return f"CASE WHEN {lines}[len({lines}) // 2 + 1] < 20 THEN {joined} ELSE {c} END"


def _located_sql(templates, marker: dict[str, str | None], chars: dict[str, int | None], statuses: bool) -> str:
    """Pages from start to end, the first one only if it has a header; all numbers but fixed ones are moved by the shift."""
    values = [(t[1], t[3], t[4], t[5] if len(t) > 5 else False, marker[t[1]], chars[t[1]]) for t in templates]
    one_page = len(templates[0]) == 5
    at = lambda c: c if one_page else f"CASE WHEN {c} < 0 THEN -{c} ELSE {c} + s END"
    label = "CASE WHEN marker IS NULL THEN '' WHEN marker = '' THEN chr(10) || '--- PAGE ' || n || ' ---' || chr(10) ELSE chr(10) || '--- PAGE ' || n || ' (' || marker || ') ---' || chr(10) END"
    status = ", CASE WHEN len(p) = 0 THEN 'NO_TEXT_FOUND' WHEN start IS NULL THEN 'SECTION_NOT_FOUND' WHEN text IS NULL THEN CASE WHEN section = 'adverse' THEN 'CONTENT_EXTRACTION_FAILED' ELSE 'EXTRACTION_FAILED' END ELSE 'ok' END AS status" if statuses else ""
    return f"""WITH {with_contents_sql([t[2] for t in templates], "section, a, b, header, marker, chars", values, one_page)},
r AS (SELECT doc_id, section, p, header, marker, chars, ({at('a')})::INT AS start, ({at('b')})::INT AS stop FROM w), x AS (SELECT *, list_filter(range(start, least(stop, len(p)) + 1), lambda n: n > start OR header) AS ns FROM r),
y AS (SELECT *, CASE WHEN len(ns) > 0 THEN substr(array_to_string(list_transform(ns, lambda n: {label} || p[n]), chr(10)), 1, coalesce(chars, 1000000000)) END AS text FROM x)
SELECT doc_id, section, start, stop{status}, coalesce(md5(text), 'none') AS digest FROM y"""


_MARKERS = {s: L.SECTIONS[s].marker for s in L.SECTIONS} | {p: L.POPULATIONS[p].marker for p in L.POPULATIONS}
_CHARS = {s: L.SECTIONS[s].chars for s in L.SECTIONS} | dict.fromkeys(L.POPULATIONS)
_FLAGS = ("has_toc", "part_i", "part_ii", "part_iii", "consumer_information", "patient_medication_information", "numbered_sections", "french")
#: Flags of each template, and for each heading whether it stands there plainly (2), broken (1) or not (0).
_EXPECTED = [(1, 1, 0, 0, 0, 0, 1, 0, 2, 2, 2, 2), (0, 0, 0, 0, 1, 0, 0, 0, 2, 2, 0, 0), (0, 0, 1, 1, 0, 1, 0, 1, 0, 0, 0, 0), (0,) * 12]


def _summary_sql() -> str:
    heads = ("indications", "contraindications", "adverse", "interactions")
    counts = ["count(*) AS documents", "count(*) FILTER (WHERE ok) AS with_text"]
    for f in _FLAGS:
        counts += [f"count(*) FILTER (WHERE ok AND {f} = 1) AS n_{f}", f"round(100 * count(*) FILTER (WHERE ok AND {f} = 1) / greatest(count(*) FILTER (WHERE ok), 1), 1) AS pct_{f}"]
    for h in heads:
        counts += [f"count(*) FILTER (WHERE {h} = 2) AS {h}_plain", f"count(*) FILTER (WHERE {h} = 1) AS {h}_tolerant", f"count(*) FILTER (WHERE {h} = 0) AS {h}_missing"]
    every = " AND ".join(f"{h} > 0" for h in heads)
    return f"""WITH {with_contents_sql(_PROFILES, ', '.join((*_FLAGS, *heads)), _EXPECTED)}, c AS (SELECT *, list_distinct([0, len(p) // 2, len(p) - 1]) AS ix FROM w),
d AS (SELECT *, round(list_sum(list_transform(ix, lambda i: length(p[i + 1]))) / len(ix), 1) >= 50 AS ok FROM c) SELECT {', '.join(counts)}, count(*) FILTER (WHERE {every}) AS all_sections FROM d"""


ORACLE_SQL = {
    "find_sections": f"WITH {_SECTIONS} SELECT doc_id, field, how, text FROM f",
    "find_subsections": f"""WITH {outlined_sql()}, h AS (SELECT doc_id, doc_id % 3 <> 1 AS o, p4, instr(p4, chr(10) || '8 PRECAUTIONS') AS pre, instr(p4, chr(10) || '8.1 Renal impairment') AS ren FROM w)
SELECT doc_id, 'renal' AS pattern, CASE WHEN o THEN {_strip("substr(p4, ren + 5) || chr(10) || '9 '")} END AS text FROM h UNION ALL SELECT doc_id, 'WARN', CASE WHEN o THEN {_strip("substr(p4, 3, pre + 2 - 3)")} END FROM h UNION ALL SELECT doc_id, 'PART II', NULL FROM h""",
    "field_texts": f"""WITH {_SECTIONS}, g AS (SELECT doc_id, coalesce(any_value(text) FILTER (WHERE field = 'contraindications'), '') AS c, coalesce(any_value(text) FILTER (WHERE field = 'adverse'), '') AS a, coalesce(any_value(text) FILTER (WHERE field = 'warnings'), '') AS s FROM (SELECT doc_id FROM w) LEFT JOIN f USING (doc_id) GROUP BY doc_id)
SELECT doc_id, {_tidy_sql('c')} AS contraindications, {_tidy_sql('a')} AS adverse, {_tidy_sql('s')} AS serious FROM g""",
    "pharmacology_passage": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND text IS NOT NULL THEN substr('Special  Populations and' || chr(10) || 'Conditions' || chr(10) || substr(text, length(text) // 2 + 1), 1, 6000) ELSE '' END AS passage FROM documents",
    "locate_families": _located_sql(_LOCATED, _MARKERS, _CHARS, True),
    "toc_locate_first_match": _located_sql(_ONE_PAGE, _MARKERS, _CHARS, True),
    "locate_populations": _located_sql(_POPULATIONS, _MARKERS, _CHARS, False),
    "profile_summary": _summary_sql(),
    "fixed_page_text": f"WITH {outlined_sql()} SELECT doc_id, md5(trim(p2 || chr(10) || p4)) AS digest FROM w",
}
