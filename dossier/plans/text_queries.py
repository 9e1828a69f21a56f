"""Location, passages, chunks, profiling and source queries with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keyword_list as K
from ..functions.text import spaced, strip
from ..operators import locate as L
from ..operators import passages as P
from ..operators import profile as R
from ..sources import records
from ..sources.shared import shared_folder
from .list_queries import _answer_items_sql, _in, _strip, _t

#: Keywords of the passages query; letters that have no case forms beyond ASCII.
_KEYWORDS = "tion|heit|que"


def _paged(spark, sf_dir) -> DataFrame:
    """Documents in pages of ten lines."""
    lines = F.split("text", "\n")
    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(10))
    page = lambda s, i: F.struct((i + 1).cast("int").alias("page_num"), F.array_join(F.slice(lines, s + 1, 10), "\n").alias("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", "lang", F.transform(starts, page).alias("pages"))


def locate_all_sections(spark, sf_dir):
    """Every section located in every paged document; counts of statuses."""
    docs = L.with_entries(_paged(spark, sf_dir))
    for s in L.SECTIONS:
        docs = L.locate(docs, s, contents="contents").drop(f"{s}_text")
    statuses = F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"{s}_status").alias("status")) for s in L.SECTIONS])
    return docs.select(F.explode(statuses).alias("x")).groupBy("x.section", "x.status").agg(F.count("*").alias("n"))


def toc_buffer(spark, sf_dir):
    """The buffer of the first three pages."""
    return _paged(spark, sf_dir).select("doc_id", F.md5(L.toc(F.col("pages"), 3)).alias("toc"), F.size("pages").alias("n_pages"))


def keyword_passages(spark, sf_dir):
    """Passages around three common syllables."""
    text = P.keyword_passages(F.col("text"), _KEYWORDS, 20, 2000)
    return _t(spark, sf_dir, "documents").select("doc_id", text.alias("passages"))


def chunk_documents(spark, sf_dir):
    """Pieces of all documents; a short one gives one."""
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(P.chunks(F.col("text"))).alias("chunk", "piece")).select("doc_id", "chunk", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


def chunk_merge_dedup(spark, sf_dir):
    """Items of all pieces, merged in order."""
    docs = _t(spark, sf_dir, "documents")
    parts = docs.select("doc_id", F.posexplode(P.chunks(F.col("text"))).alias("chunk", "piece"))
    items = parts.select("doc_id", "chunk", K.answer_items(F.col("piece")).alias("items"), F.when(strip(F.col("piece")) != "", F.lit("x")).alias("section"))
    merged = items.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "items"))), lambda x: x["items"]).alias("all"), F.max("section").alias("section"))
    return merged.select("doc_id", K.merged_answer(F.col("all"), F.col("section")).alias("value"))


def tidy_lines(spark, sf_dir):
    """Texts with a break after almost every word, repaired; others as they are."""
    broken = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(P.tidy(broken)).alias("digest"))


def corpus_profile(spark, sf_dir):
    """Profile flags of the paged documents, by language."""
    p = R.analyse(_paged(spark, sf_dir))
    return p.groupBy("lang").agg(F.count("*").alias("n"), F.sum("p_pages").alias("pages"), F.count_if("p_has_text_layer").alias("with_text"), F.count_if("p_has_toc").alias("with_toc"), F.count_if("p_part_i").alias("part_i"), F.count_if("p_french").alias("french"), F.round(F.sum("p_chars_per_sampled_page"), 1).alias("chars"), F.sum("p_indications_spellings").alias("spellings"))


def corpus_quartiles(spark, sf_dir):
    return R.quartiles(_t(spark, sf_dir, "documents"), "n_chars", "lang")


def upper_median_pages(spark, sf_dir):
    return R.upper_median(_t(spark, sf_dir, "documents"), "n_chars", "source")


def jsonl_resume_read(spark, sf_dir):
    """All documents as a record file in which some lines are blank, broken or cut: what a resumed run reads."""
    d = _t(spark, sf_dir, "documents")
    brand = F.when(F.col("doc_id") % 5 == 0, "ERROR: x").otherwise(F.col("text"))
    line = F.to_json(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("Source Path"), brand.alias("Brand Name")))
    damaged = F.when(F.col("doc_id") % 11 == 0, "{broken").when(F.col("doc_id") % 13 == 0, line.substr(F.lit(1), F.length(line) - 7)).when(F.col("doc_id") % 17 == 0, "").otherwise(line)
    path = shared_folder(spark, "records.jsonl")
    d.select(damaged.alias("value")).write.text(path)
    read = records.read_records(spark, path, ["Source Path", "Brand Name"])
    return records.split_bad(read)[0].select(F.col("Source Path").alias("key"), F.md5("Brand Name").alias("brand"))


def label_html_pages(spark, sf_dir):
    """Control characters scrubbed from pages; provenance by url."""
    from ..functions.text import scrub_controls

    return scrub_controls(_t(spark, sf_dir, "pages")).select("page_id", F.md5("html").alias("digest"), F.length("url").alias("chars"))


QUERIES = {f.__name__: f for f in (locate_all_sections, toc_buffer, keyword_passages, chunk_documents, chunk_merge_dedup, tidy_lines, corpus_profile, corpus_quartiles, upper_median_pages, jsonl_resume_read, label_html_pages)}

_PAGED = "l AS (SELECT doc_id, lang, string_split(text, chr(10)) AS s FROM documents), pg AS (SELECT doc_id, lang, list_transform(range(0, len(s), 10), lambda i: array_to_string(s[i + 1:i + 10], chr(10))) AS p FROM l)"
#: Recursion over the pieces of a text: r has doc_id, chunk, text, and where the piece starts and ends.
_PIECES = """d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, text, n, 0 AS chunk, 0 AS st, CASE WHEN n <= 8000 THEN n ELSE 6000 END AS hard FROM d),
r AS (SELECT doc_id, text, n, chunk, st, CASE WHEN hard < n AND instr(reverse(substr(text, st + 3001, 3000)), chr(10)) > 0 THEN st + 6000 - instr(reverse(substr(text, st + 3001, 3000)), chr(10)) ELSE hard END AS en FROM s
UNION ALL SELECT doc_id, text, n, chunk + 1, ns, CASE WHEN ns + 6000 < n AND instr(reverse(substr(text, ns + 3001, 3000)), chr(10)) > 0 THEN ns + 6000 - instr(reverse(substr(text, ns + 3001, 3000)), chr(10)) ELSE least(ns + 6000, n) END FROM (SELECT *, greatest(en - 300, st + 1) AS ns FROM r WHERE en < n))"""
_BROKEN = "CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', chr(10)) ELSE text END"
ORACLE_SQL = {
    "toc_buffer": f"WITH {_PAGED} SELECT doc_id, md5(array_to_string(list_transform(p[1:3], lambda x, i: chr(10) || '--- PAGE ' || i || ' ---' || chr(10) || x || chr(10)), '')) AS toc, len(p)::INT AS n_pages FROM pg",
    "chunk_documents": f"WITH RECURSIVE {_PIECES} SELECT doc_id, chunk::INT AS chunk, (en - st)::INT AS chars, md5(substr(text, st + 1, en - st)) AS digest FROM r",
    "chunk_merge_dedup": f"""WITH RECURSIVE {_PIECES}, p AS (SELECT doc_id, chunk, substr(text, st + 1, en - st) AS piece FROM r), {_answer_items_sql("p", "doc_id, chunk", "piece")},
u AS (SELECT doc_id, chunk, unnest(range(len(c))) AS i, unnest(c) AS x FROM items), f AS (SELECT doc_id, lower(x) AS k, min((chunk, i, x)) AS m FROM u GROUP BY ALL),
j AS (SELECT doc_id, string_agg(m[3], ', ' ORDER BY m[1], m[2]) AS value FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN {_strip("d.text")} = '' THEN 'SECTION_NOT_FOUND' ELSE coalesce(j.value, 'NONE_FOUND') END AS value FROM d LEFT JOIN j USING (doc_id)""",
    "keyword_passages": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, t, string_split_regex(t, '(?i){_KEYWORDS}') AS gaps, regexp_extract_all(t, '(?i){_KEYWORDS}') AS hits FROM d),
u AS (SELECT doc_id, t, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM p),
w AS (SELECT doc_id, t, i, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop, length(hit) AS m FROM u),
e AS (SELECT doc_id, t, i, greatest(stop - m - 20, 0) AS low, least(stop + 20, length(t)) AS high FROM w),
b AS (SELECT *, CASE WHEN low > lag(high) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM e), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM b),
s AS (SELECT doc_id, island, min(low) AS low, max(high) AS high, any_value(t) AS t FROM g GROUP BY doc_id, island), j AS (SELECT doc_id, string_agg(substr(t, low + 1, high - low), chr(10) || '...' || chr(10) ORDER BY low) AS v FROM (SELECT doc_id, island, low::BIGINT AS low, high::BIGINT AS high, t FROM s) GROUP BY doc_id)
SELECT doc_id, coalesce(substr(v, 1, 2000), '') AS passages FROM d LEFT JOIN j USING (doc_id)""",
    # The documents are invented prose without any heading, so the default start of one section, page 9, is all that is ever found; a start page without its heading is dropped, so text comes from page 10 on.
    "locate_all_sections": f"SELECT section, CASE WHEN text IS NULL THEN 'NO_TEXT_FOUND' WHEN section = 'adverse' THEN CASE WHEN (len(string_split(text, chr(10))) + 9) // 10 >= 10 THEN 'ok' ELSE 'CONTENT_EXTRACTION_FAILED' END ELSE 'SECTION_NOT_FOUND' END AS status, count(*) AS n FROM documents, (SELECT unnest([{_in(L.SECTIONS)}]) AS section) GROUP BY ALL",
    "tidy_lines": f"WITH d AS (SELECT doc_id, {_BROKEN} AS t FROM documents), m AS (SELECT *, list_sort(list_transform(list_filter(string_split(t, chr(10)), lambda x: {_strip('x')} <> ''), lambda x: length({_strip('x')}))) AS ls FROM d) SELECT doc_id, md5(CASE WHEN ls[len(ls) // 2 + 1] < 20 THEN regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]*\\n[ \\t]*(\\n[ \\t]*)*', ' ', 'g'), '(\\w) - (\\w)', '\\1-\\2', 'g'), '[ \\t]{{2,}}', ' ', 'g') ELSE t END) AS digest FROM m".replace("{{", "{").replace("}}", "}"),
    "corpus_profile": f"""WITH {_PAGED}, f AS (SELECT lang, p, array_to_string(p[1:12], chr(10)) AS front, list_distinct([0, len(p) // 2, len(p) - 1]) AS ix FROM pg),
c AS (SELECT *, round(list_sum(list_transform(ix, lambda i: length(p[i + 1]))) / len(ix), 1) AS chars, regexp_replace(front, '\\s+', ' ', 'g') AS flat FROM f)
SELECT lang, count(*) AS n, sum(len(p))::BIGINT AS pages, count(*) FILTER (WHERE chars >= 50) AS with_text, count(*) FILTER (WHERE regexp_matches(front, '(?i){spaced('TABLE OF CONTENTS')}|{spaced('TABLE DES MATI')}') OR len(regexp_extract_all(front, '{R.LEADERS}')) >= 5) AS with_toc, count(*) FILTER (WHERE regexp_matches(flat, '(?i)PART\\s*I\\b')) AS part_i, count(*) FILTER (WHERE regexp_matches(flat, '(?i)MONOGRAPHIE\\s+DE\\s+PRODUIT|RENSEIGNEMENTS\\s+POUR|CONTRE-INDICATIONS')) AS french, round(sum(chars), 1) AS chars, sum(len(list_distinct(list_concat(regexp_extract_all(front, '(?i){spaced('INDICATIONS AND CLINICAL USE')}'), regexp_extract_all(front, '(?i){spaced('INDICATIONS')}')))))::BIGINT AS spellings FROM c GROUP BY lang""",
    "corpus_quartiles": "SELECT lang, min(n_chars) AS min, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS max FROM documents GROUP BY lang",
    "upper_median_pages": "SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY source",
    "jsonl_resume_read": "SELECT doc_id || '.pdf' AS key, md5(CASE WHEN doc_id % 5 = 0 THEN 'ERROR: x' ELSE text END) AS brand FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0",
    "label_html_pages": "SELECT page_id, md5(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS digest, length(url)::INT AS chars FROM pages",
}
