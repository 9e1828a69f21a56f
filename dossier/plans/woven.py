"""Documents with headings, tables of contents and outlines woven into their text by rule, so that what must be found in them follows from the rule in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import locate as L
from .list_queries import _q, _t

#: Longer than what is looked at before a place; without brackets and pointing words.
FILL = "what follows was taken over from earlier papers without any change and stands here only to keep all headings well apart from prose lines and lists"


def share(lines: Column, n, k) -> Column:
    """The k-th of n parts of equal numbers of lines."""
    return F.array_join(F.filter(lines, lambda _, i: F.floor(i * n / F.size(lines)) == k), "\n")


def share_sql(n: str, k: str) -> str:
    return f"array_to_string(list_filter(ls, lambda x, i: (i - 1) * ({n}) // len(ls) = ({k})), chr(10))"


# --- outlined documents ---------------------------------------------------------------------------------------------

#: Pages: words, and in braces the parts of a document's lines; {f} is FILL.
_PAGES = [
    "PRODUCT MONOGRAPH\nPART I\n{0}\n{f}",
    "3 INDICATIONS\n{1}\n{f}",
    "see 4 CONTRAINDICATIONS\n4 CONTRAINDICATIONS\n{2}\n{f}",
    "7 WARNINGS\n{3}\n{f}\n8 PRECAUTIONS\n{f}\n8.1 Renal impairment\n{4}\n{f}",
    "9 ADVERSE REACTIONS\n{5}\n{f}",
    "PART II: SCIENTIFIC INFORMATION\nINDICATIONS none",
]
_OUTLINE = [(0, "PART I", 1), (1, "3 Indications", 2), (1, "4 Contraindications", 3), (1, "7 Warnings", 4), (1, "8 Precautions", 4), (2, "8.1 Renal impairment", 4), (1, "9 Adverse Reactions", 5), (0, "PART II: SCIENTIFIC INFORMATION", 6), (1, "Indications", 6)]


def _filled(template: str, part) -> Column:
    pieces = []
    for n, piece in enumerate(template.replace("{f}", FILL).replace("}", "{").split("{")):
        pieces.append(part(int(piece)) if n % 2 else F.lit(piece))
    return F.concat(*pieces)


def outlined(spark, sf_dir) -> DataFrame:
    """doc_id, pages, outline. Ids divisible by 3 have an outline; those with a remainder of 2 have one whose entry for contraindications is a page late; the rest have none."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    pages = F.array(*[F.struct(F.lit(n).alias("page_num"), _filled(t, lambda k: share(lines, 6, k)).alias("text")) for n, t in enumerate(_PAGES, 1)])
    entry = lambda d, t, p: F.struct(F.lit(d).alias("depth"), F.lit(t).alias("title"), (F.lit(p) + (F.when(F.col("doc_id") % 3 == 2, 1).otherwise(0) if t.startswith("4") else F.lit(0))).cast("int").alias("page"))
    outline = F.when(F.col("doc_id") % 3 != 1, F.array(*[entry(*e) for e in _OUTLINE]))
    return _t(spark, sf_dir, "documents").select("doc_id", pages.alias("pages"), outline.alias("outline"))


def outlined_sql() -> str:
    """CTE w: doc_id, the pages p1 to p6 and the parts of the text."""
    part = lambda k: f"'||{share_sql('6', str(k))}||'"
    pages = []
    for n, t in enumerate(_PAGES, 1):
        text = _q(t).replace("{f}", FILL)
        for k in range(6):
            text = text.replace(f"{{{k}}}", part(k))
        pages.append(f"({text}) AS p{n}")
    return f"l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), w AS (SELECT doc_id, {', '.join(pages)} FROM l)"


# --- documents with contents -------------------------------------------------------------------------------------------


def shift() -> Column:
    """How many pages of prose stand between the contents and the rest."""
    return (4 + F.col("doc_id") % 3).cast("int")


def with_contents(spark, sf_dir, templates: list[list[str]], one_page: bool = False) -> DataFrame:
    """doc_id, k, pages: documents in the templates' pages in turn (k = doc_id modulo their number). {n} in a template is page n of it, moved by shift().

    The first page is the template's own; then come shift() pages of prose; the template's others end in prose. A template without pages gives none.
    With `one_page` there is no shift, and a template of one page is preceded by the whole text.
    """
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(templates)], "k long, t array<string>")
    docs = _t(spark, sf_dir, "documents").withColumn("k", F.pmod("doc_id", F.lit(len(templates)))).join(F.broadcast(rows), "k")
    lines, s, t = F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0) if one_page else shift(), F.col("t")
    parts = s + F.size(t) - 1

    def page(j: Column) -> Column:
        own = F.get(t, F.when(j == 0, 0).otherwise(j - s))
        part = share(lines, parts, j - 1)
        return F.when(j == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), own) if one_page else own).when(j <= s, part).otherwise(F.concat(own, F.lit("\n"), part))

    def numbered(text: Column) -> Column:
        for n in range(2, 8):
            text = F.replace(text, F.lit(f"{{{n}}}"), (s + n).cast("string"))
        return text

    made = F.transform(F.sequence(F.lit(0), parts), lambda j: F.struct((j + 1).cast("int").alias("page_num"), numbered(page(j)).alias("text")))
    return docs.select("doc_id", "k", F.when(F.size(t) > 0, made).otherwise(F.array().cast(L.PAGES)).alias("pages"))


def with_contents_sql(templates: list[list[str]], columns: str = "", values: list[tuple] = (), one_page: bool = False) -> str:
    """CTE w: doc_id, k, s (the shift) and p, the list of pages; further columns of the templates as given."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else _q(v)
    rows = ", ".join("(" + ", ".join([str(k), f"[{', '.join(map(_q, t))}]::VARCHAR[]", *(map(one, values[k]) if values else ())]) + ")" for k, t in enumerate(templates))
    names = f"k, t{', ' + columns if columns else ''}"
    text = f"CASE WHEN j = 0 THEN {"array_to_string(ls, chr(10)) || chr(10) || " if one_page else ""}t[1] WHEN j <= s THEN {share_sql('s + len(t) - 1', 'j - 1')} ELSE t[j - s + 1] || chr(10) || {share_sql('s + len(t) - 1', 'j - 1')} END"
    for n in range(2, 8):
        text = f"replace({text}, '{{{n}}}', (s + {n})::VARCHAR)"
    return f"""m AS (SELECT * FROM (VALUES {rows}) x({names})), l AS (SELECT doc_id, {0 if one_page else "4 + doc_id % 3"} AS s, m.*, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents JOIN m ON k = doc_id % {len(templates)}),
w AS (SELECT *, CASE WHEN len(t) > 0 THEN list_transform(range(s + len(t)), lambda j: {text}) ELSE [] END AS p FROM l)"""
