"""Queries on the keyword-list contract and scalar clean-up, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import ids, text
from ..functions import keyword_list as K
from ..sources import answers


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- DuckDB fragments ------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _in(values) -> str:
    return ", ".join(map(_q, values))


_PREFIX = r"^\s*(?:[-*•·]|\(?\d+[.)])\s*"


def _unquoted(c: str) -> str:
    b = _strip(c)
    return f"""CASE WHEN length({b}) >= 2 AND (({b} LIKE '"%' AND {b} LIKE '%"') OR ({b} LIKE '''%' AND {b} LIKE '%''') OR ({b} LIKE '“%' AND {b} LIKE '%”')) THEN {_strip(f"substr({b}, 2, length({b}) - 2)")} ELSE {b} END"""


def _words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '\\S+'))"


def _clean(c: str) -> str:
    a = _strip(f"regexp_replace({c}, {_q(_PREFIX)}, '')")
    b = _strip(f"""regexp_replace({a}, '^["“”]+|["“”]+$', '', 'g')""")
    return f"regexp_replace(regexp_replace({b}, '(?i)^and\\s+', ''), '\\s+', ' ', 'g')"


def _normalize_sql(source: str, keys: str, grounding: bool = False) -> str:
    """CTEs of the list contract over `source` (keys, raw[, src])."""
    markers = " ".join(f"WHEN contains(lower(t), {_q(m)}) THEN {_q('contains conversational phrase ' + (chr(34) if chr(39) in m else chr(39)) + m + (chr(34) if chr(39) in m else chr(39)))}" for m in C.PROSE_MARKERS)
    extra = ", src" if grounding else ""
    ground = ""
    if grounding:
        loose = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g')"
        ground = f"""
g0 AS (SELECT {keys}, {loose("src")} AS hay, src, unnest(items) AS item FROM n3 WHERE coalesce(src, '') <> ''),
g1 AS (SELECT *, {_strip(loose("item"))} AS plain FROM g0),
g2 AS (SELECT *, CASE WHEN len(list_filter(string_split_regex(plain, ' +'), lambda w: length(w) >= 5)) > 0 THEN list_filter(string_split_regex(plain, ' +'), lambda w: length(w) >= 5) ELSE list_filter(string_split_regex(plain, ' +'), lambda w: w <> '') END AS ws FROM g1),
g3 AS (SELECT *, substr(list_filter(ws, lambda w: length(w) = list_max(list_transform(ws, lambda v: length(v))))[1], 1, 6) AS stem FROM g2),
gr AS (SELECT {keys}, avg(CASE WHEN plain = '' THEN 0 WHEN contains(hay, plain) THEN 1 WHEN length(stem) >= 4 AND contains(hay, stem) THEN 1 ELSE 0 END) AS grounded FROM g3 GROUP BY ALL),"""
    joined = f"n3 LEFT JOIN gr USING ({keys})" if grounding else "n3"
    ground_case = f"WHEN grounded < {K.MIN_GROUNDED} THEN 'only ' || round_even(grounded * 100, 0)::INT || '% of ' || len(items) || ' terms appear in the source text (likely invented or copied from the prompt)'" if grounding else ""
    return f"""
n0 AS (SELECT {keys}{extra}, {_strip("coalesce(raw, '')")} AS r FROM {source}),
n1a AS (SELECT *, CASE WHEN r LIKE '```%' THEN {_strip(f"list_aggregate(list_filter(string_split(r, chr(10)), lambda x: NOT starts_with({_strip('x')}, '```')), 'string_agg', chr(10))")} ELSE r END AS f FROM n0),
n1b AS (SELECT *, {_unquoted("f")} AS u FROM n1a),
n1c AS (SELECT *, regexp_replace(u, {_q('(?i)^' + chr(92) + 's*' + C.LEADING_LABEL + chr(92) + 's*[:' + chr(92) + '-]' + chr(92) + 's*')}, '') AS l FROM n1b),
n1 AS (SELECT *, {_unquoted("l")} AS t, list_filter(string_split({_unquoted("l")}, chr(10)), lambda x: {_strip("x")} <> '') AS lines FROM n1c),
n2 AS (SELECT *, CASE {markers}
    WHEN contains({_strip("t")}, chr(10) || chr(10)) THEN 'contains multiple paragraphs'
    WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: regexp_matches(x, {_q(_PREFIX)}))) >= 2
      AND list_max(list_transform(list_filter(lines, lambda x: regexp_matches(x, {_q(_PREFIX)})), lambda x: {_words(f"regexp_replace(x, {_q(_PREFIX)}, '')")})) > {K.CLAUSE_WORDS} THEN 'bulleted list of long clauses'
    WHEN regexp_matches(t, '[.!?]\\s+[A-Z]') THEN 'contains sentence breaks'
    WHEN NOT contains(t, ',') AND {_words("t")} > {K.CLAUSE_WORDS} THEN 'single long phrase with no commas' END AS prose FROM n1),
n2a AS (SELECT *, CASE WHEN prose IS NULL THEN list_transform(string_split_regex(t, '[,\\n;]+'), lambda x: {_clean("x")}) END AS c0 FROM n2),
n2b AS (SELECT *, list_filter(list_transform(c0, lambda x: CASE WHEN x LIKE '%.' AND NOT regexp_matches(x, '\\b\\w\\.\\w\\.$') THEN {_strip("substr(x, 1, length(x) - 1)")} ELSE x END), lambda x: x <> '') AS c1 FROM n2a),
n2c AS (SELECT *, list_filter(c1, lambda x: {_words("x")} <= {K.HARD_WORDS}) AS c2 FROM n2b),
n2d AS (SELECT *, list_transform(c2, lambda x: lower(x)) AS ks FROM n2c),
n3 AS (SELECT *, list_filter(c2, lambda x, i: list_position(ks, lower(x)) = i) AS items, len(c1) - len(c2) AS dropped FROM n2d),{ground}
n4 AS (SELECT *, CASE WHEN r = '' THEN 'empty response' WHEN r IN ({_in(C.SENTINELS)}) OR t IN ({_in(C.SENTINELS)}) THEN 'ok' WHEN prose IS NOT NULL THEN prose
    WHEN len(items) = 0 THEN 'no list items found' WHEN dropped > (dropped + len(items)) * {K.MAX_DROPPED} THEN dropped || ' of ' || (dropped + len(items)) || ' items were over-long' {ground_case} ELSE 'ok' END AS reason FROM {joined}),
n5 AS (SELECT {keys}, reason, CASE WHEN reason <> 'ok' THEN NULL WHEN r IN ({_in(C.SENTINELS)}) THEN r WHEN t IN ({_in(C.SENTINELS)}) THEN t ELSE array_to_string(items, ', ') END AS value FROM n4)"""


# --- Queries ---------------------------------------------------------------------------------------------------------


def normalize_list_documents(spark, sf_dir):
    """Every document's text as a raw answer."""
    return K.normalize(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "value", "reason")


def validated_answers(spark, sf_dir):
    """Every document is a request that may be asked three times; attempt n answers with the lines n, n + 3, n + 6 ... of its text. Each attempt is written once."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit("list").alias("field"), F.lit(0).alias("chunk"), F.split("text", "\n").alias("lines"))
    every_third = lambda first: F.array_join(F.filter("lines", lambda x, i: i % 3 == first), "\n")
    attempts = None
    for n in (1, 2, 3):
        mine = every_third(n - 1)
        finish = F.when(F.col("key") % 4 == 0, "length").otherwise("stop")
        part = d.select("key", "field", "chunk", F.lit(n).alias("attempt"), mine.alias("text"), finish.alias("finish_reason"))
        attempts = part if attempts is None else attempts.unionByName(part)
    out = answers.validated(d.select("key", "field", "chunk"), answers.RecordedAnswers(attempts))
    return out.select(F.col("key").alias("doc_id"), "value", "reason", "attempt")


def normalize_list_lines(spark, sf_dir):
    """Every line of every document as a raw answer, reasons counted by language."""
    lines = _t(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    out = K.normalize(lines, "line")
    return out.groupBy("lang", "reason").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("value"), F.lit(0))).alias("chars"))


def _turns(spark, sf_dir):
    by = W.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lag("text").over(by).alias("src"))


def normalize_list_conversations(spark, sf_dir):
    """Each turn as an answer, grounded in the turn before."""
    return K.normalize(_turns(spark, sf_dir), "text", "src").select("conv_id", "turn", "value", "reason")


def grounded_fraction_turns(spark, sf_dir):
    """How much of each turn's words the turn before has."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: w != ""))
    turns = _turns(spark, sf_dir).where("src is not null")
    return turns.select("conv_id", "turn", F.round(K.grounded_fraction(words, F.col("src")), 6).alias("grounded"))


def prose_reason_counts(spark, sf_dir):
    reason = F.coalesce(K.prose_reason(F.col("text")), F.lit("list"))
    return _t(spark, sf_dir, "documents").groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


def clean_items(spark, sf_dir):
    """Items of each document's text, as of an unchecked answer."""
    items = K.answer_items(F.col("text"), F.col("source"))
    docs = _t(spark, sf_dir, "documents").select("doc_id", items.alias("items"))
    return docs.select("doc_id", F.size("items").alias("n_items"), F.array_join("items", "|").alias("items"))



def word_bag_key(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", ids.word_bag(F.col("p_name")).alias("bag"))


def id_normalisation(spark, sf_dir):
    name = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" 10mg.PDF")).otherwise(F.lit(" 5mg.pdf_3.PDF")))
    other = F.concat(F.col("s_name"), F.lit(".pdf-2.pdf"))
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"), ids.match_id(name).alias("match_id"), ids.product_key(name).alias("product"), ids.release_id(name).alias("release_id"), ids.record_id(name).alias("record_id"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind"), ids.match_id(other).alias("match_id"), ids.product_key(other).alias("product"), ids.release_id(other).alias("release_id"), ids.record_id(other).alias("record_id"))
    return a.unionByName(b)


def provenance_split(spark, sf_dir):
    key = F.regexp_replace("url", "^[a-z]+://", "")
    folder, above = ids.provenance(key)
    return _t(spark, sf_dir, "pages").select("page_id", folder.alias("folder"), above.alias("above"))


def sentinel_is_empty(spark, sf_dir):
    """Emptiness of documents and of every sentinel."""
    docs = _t(spark, sf_dir, "documents").select(F.col("text").alias("v"))
    fixed = spark.createDataFrame([(s,) for s in (*C.SENTINELS, "ERROR: timeout", "  ", "No information given", "dizziness", "NONE_FOUND", None)], "v string")
    return docs.unionByName(fixed).groupBy(text.is_empty(F.col("v")).alias("empty")).agg(F.count("*").alias("n"))


def option_first_contained(spark, sf_dir):
    options = ("URGENT", "HIGH", "MEDIUM", "LOW")
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.option_first(F.col("o_orderpriority"), options, F.col("o_orderpriority")).alias("option"))


def option_earliest(spark, sf_dir):
    options = ("THE", "AND", "DE", "LA", "DER", "QUE")
    return _t(spark, sf_dir, "documents").select("doc_id", text.option_earliest(F.col("text"), options, "NO INFORMATION").alias("option"))


def metadata_positional_parse(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.metadata(F.col("text")).alias("m")).select("doc_id", "m.*")


def strength_tokens(spark, sf_dir):
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mg "), F.format_string("%.2f", "p_retailprice"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.strengths(name)), "|").alias("strengths"), F.array_join(F.array_sort(text.name_words(F.col("p_name"))), "|").alias("words"))


_ENZYME_TEXTS = ("Metabolised by CYP3A4 and cyp 2d6.", "CYP3A4/5 is involved", "cytochrome P450 2C9; isoenzyme 1A2", "no enzyme is named", "P450 2e1 and CYP2C19")


def enzyme_extract(spark, sf_dir):
    fixed = spark.createDataFrame(list(enumerate(_ENZYME_TEXTS, -len(_ENZYME_TEXTS))), "doc_id long, text string")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text").unionByName(fixed)
    return docs.select("doc_id", text.enzymes(F.col("text")).alias("enzymes"))


def cleanups(spark, sf_dir):
    """All scalar clean-ups over the texts of documents."""
    whole = F.col("text")
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", text.paragraph(whole).alias("paragraph"), text.warnings_list(whole).alias("warnings"), text.interactions_list(whole).alias("interactions"), text.adverse_list(whole).alias("adverse"), text.item_count(whole).alias("n_items"), text.elimination(whole).alias("elimination"), text.head(whole, 60).alias("head"))


def _interactions_sql(c: str) -> str:
    for pattern, new, opt in (("^[\"'']|[\"'']$", "", "g"), (r"^\s*[-•*]\s*", "", ""), (r"^\d+\.\s*", "", ""), (r"(?i)\s+and\s+", ", ", "g"), (r"\s*,\s*", ", ", "g"), (r",\s*$", "", "")):
        c = f"regexp_replace({c}, '{pattern}', '{new}', '{opt}')"
    return c


_WARN = f"regexp_replace(regexp_replace(regexp_replace({_strip('line')}, '\\s+', ' ', 'g'), ',\\s*', ', ', 'g'), ',\\s*$', '')"
_PARA = _strip("regexp_replace(regexp_replace(regexp_replace(line, '^\\s*[-•*]\\s*', ''), '\\s+', ' ', 'g'), '^[\"'']|[\"'']$', '', 'g')")
_LAG = "SELECT conv_id, turn, text AS raw, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS src FROM conversations"
_META = ("brand_name", "company", "initial_authorization", "revision_date", "ingredients", "dosage")
_LOOSE = "regexp_replace(lower(src), '[^a-z0-9 ]+', ' ', 'g')"



def _answer_items_sql(table: str, keys: str, column: str) -> str:
    """`items`: keys, and the cleaned items of a raw answer as c, equal ones not yet merged."""
    ends = f"""regexp_replace({_strip("regexp_replace(x, '^[" + chr(92) + "s" + chr(92) + "-•*" + chr(92) + "d.)]+', '')")}, '^[."''`]+|[."''`]+$', '', 'g')"""
    return f"""a AS (SELECT {keys}, regexp_replace({_strip(f"coalesce({column}, '')")}, '(?i)^(here (is|are)[^:]*:|the (list|answer)[^:]*:)', '') AS t FROM {table}),
b AS (SELECT {keys}, list_transform(string_split_regex(t, '[\\n;,]'), lambda x: {_strip(ends)}) AS c FROM a),
c1 AS (SELECT {keys}, list_transform(c, lambda x: replace({_strip("regexp_replace(x, '(?i)^(and|or|including|such as)" + chr(92) + "s+', '')")}, '_', ' ')) AS c FROM b),
c2 AS (SELECT {keys}, list_transform(c, lambda x: CASE WHEN contains(x, ' ') THEN x ELSE regexp_replace(x, '([a-z])([A-Z])', '\\1 \\2', 'g') END) AS c FROM c1),
items AS (SELECT {keys}, list_filter(c, lambda x: x <> '' AND NOT regexp_matches(x, {_q(K.PLACEHOLDER)}) AND length(x) <= 120) AS c FROM c2)"""


QUERIES = {
    f.__name__: f
    for f in (normalize_list_documents, validated_answers, normalize_list_lines, normalize_list_conversations, grounded_fraction_turns, prose_reason_counts, clean_items, word_bag_key, id_normalisation, provenance_split, sentinel_is_empty, option_first_contained, option_earliest, metadata_positional_parse, strength_tokens, enzyme_extract, cleanups)
}

ORACLE_SQL = {
    "normalize_list_documents": f"WITH src AS (SELECT doc_id, text AS raw FROM documents), {_normalize_sql('src', 'doc_id')} SELECT doc_id, value, reason FROM n5",
    "validated_answers": f"""WITH a AS (SELECT doc_id, unnest([1, 2, 3]) AS attempt, text FROM documents),
b AS (SELECT doc_id, attempt, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: (i - 1) % 3 = attempt - 1), chr(10)) AS t FROM a),
src AS (SELECT doc_id, attempt, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(t, ',[^,]*$', '') ELSE t END AS raw FROM b), {_normalize_sql('src', 'doc_id, attempt')},
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY reason <> 'ok', CASE WHEN reason = 'ok' THEN attempt ELSE -attempt END) AS k FROM n5)
SELECT doc_id, CASE WHEN reason = 'ok' THEN value ELSE 'EXTRACTION_FAILED' END AS value, reason, attempt FROM f WHERE k = 1""",
    "normalize_list_lines": f"WITH src AS (SELECT lang, row_number() OVER () AS k, raw FROM (SELECT lang, unnest(string_split(text, chr(10))) AS raw FROM documents)), {_normalize_sql('src', 'lang, k')} SELECT lang, reason, count(*) AS n, sum(coalesce(length(value), 0))::BIGINT AS chars FROM n5 GROUP BY ALL",
    "normalize_list_conversations": f"WITH src AS ({_LAG}), {_normalize_sql('src', 'conv_id, turn', True)} SELECT conv_id, turn, value, reason FROM n5",
    "grounded_fraction_turns": f"""WITH s AS ({_LAG}), w AS (SELECT conv_id, turn, {_LOOSE} AS hay, unnest(list_distinct(list_filter(string_split(lower(raw), ' '), lambda w: w <> ''))) AS item FROM s WHERE src IS NOT NULL),
p AS (SELECT *, {_strip("regexp_replace(item, '[^a-z0-9 ]+', ' ', 'g')")} AS plain FROM w),
q AS (SELECT *, list_filter(string_split_regex(plain, ' +'), lambda x: x <> '') AS ws FROM p),
q2 AS (SELECT *, CASE WHEN len(list_filter(ws, lambda x: length(x) >= 5)) > 0 THEN list_filter(ws, lambda x: length(x) >= 5) ELSE ws END AS ch FROM q),
q3 AS (SELECT *, substr(list_filter(ch, lambda x: length(x) = list_max(list_transform(ch, lambda y: length(y))))[1], 1, 6) AS stem FROM q2)
SELECT conv_id, turn, round(avg(CASE WHEN plain = '' THEN 0 WHEN contains(hay, plain) THEN 1 WHEN length(stem) >= 4 AND contains(hay, stem) THEN 1 ELSE 0 END), 6) AS grounded FROM q3 GROUP BY ALL""",
    "prose_reason_counts": f"WITH src AS (SELECT doc_id, source, text AS t, list_filter(string_split(text, chr(10)), lambda x: {_strip('x')} <> '') AS lines FROM documents), p AS (SELECT source, CASE " + " ".join(f"WHEN contains(lower(t), {_q(m)}) THEN {_q('contains conversational phrase ' + (chr(34) if chr(39) in m else chr(39)) + m + (chr(34) if chr(39) in m else chr(39)))}" for m in C.PROSE_MARKERS) + f""" WHEN contains({_strip('t')}, chr(10) || chr(10)) THEN 'contains multiple paragraphs'
 WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: regexp_matches(x, {_q(_PREFIX)}))) >= 2 AND list_max(list_transform(list_filter(lines, lambda x: regexp_matches(x, {_q(_PREFIX)})), lambda x: {_words(f"regexp_replace(x, {_q(_PREFIX)}, '')")})) > 12 THEN 'bulleted list of long clauses'
 WHEN regexp_matches(t, '[.!?]\\s+[A-Z]') THEN 'contains sentence breaks' WHEN NOT contains(t, ',') AND {_words('t')} > 12 THEN 'single long phrase with no commas' ELSE 'list' END AS reason FROM src) SELECT source, reason, count(*) AS n FROM p GROUP BY ALL""",
    "clean_items": f"""WITH {_answer_items_sql("documents", "doc_id, source", "text")},
c3 AS (SELECT doc_id, list_filter(c, lambda x: lower(x) <> lower(source)) AS c FROM items),
c4 AS (SELECT doc_id, c, list_transform(c, lambda x: lower(x)) AS k FROM c3)
SELECT doc_id, len(list_filter(c, lambda x, i: list_position(k, lower(x)) = i)) AS n_items, array_to_string(list_filter(c, lambda x, i: list_position(k, lower(x)) = i), '|') AS items FROM c4""",
    "word_bag_key": "SELECT p_partkey, array_to_string(list_sort(list_filter(regexp_extract_all(lower(p_name), '[a-z]{4,}'), lambda w: w <> 'and')), ' ') AS bag FROM part",
    "id_normalisation": "WITH u AS (SELECT c_custkey AS key, 'customer' AS kind, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' 10mg.PDF' ELSE ' 5mg.pdf_3.PDF' END AS f FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_name || '.pdf-2.pdf' FROM supplier) SELECT key, kind, regexp_replace(trim(lower(regexp_replace(trim(f), '(?i)\\.pdf$', ''))), '\\s+', ' ', 'g') AS match_id, regexp_replace(regexp_replace(lower(regexp_replace(f, '(?i)\\.pdf$', '')), '[\\s\\-_]+\\d.*$', ''), '[^a-z0-9]', '', 'g') AS product, CASE WHEN kind = 'supplier' THEN lower(left(f, length(f) - 10)) || '-2' WHEN key % 2 = 0 THEN lower(left(f, length(f) - 4)) ELSE lower(left(f, length(f) - 10)) || '_3' END AS release_id, replace(f, '.pdf', '') AS record_id FROM u",
    "provenance_split": "WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages) SELECT page_id, CASE WHEN len(s) >= 2 THEN s[-2] ELSE '' END AS folder, CASE WHEN len(s) >= 3 THEN s[-3] ELSE '' END AS above FROM p",
    "sentinel_is_empty": f"WITH v AS (SELECT text AS v FROM documents UNION ALL SELECT unnest([{_in([*C.SENTINELS, 'ERROR: timeout', '  ', 'No information given', 'dizziness', 'NONE_FOUND'])}, NULL])) SELECT v IS NULL OR trim(v) = '' OR " + " OR ".join(f"starts_with(lower({_strip('v')}), {_q(p)})" for p in C.EMPTY_PREFIXES) + " AS empty, count(*) AS n FROM v GROUP BY ALL",
    "option_first_contained": "SELECT o_orderkey, CASE WHEN contains(upper(o_orderpriority), 'URGENT') THEN 'URGENT' WHEN contains(upper(o_orderpriority), 'HIGH') THEN 'HIGH' WHEN contains(upper(o_orderpriority), 'MEDIUM') THEN 'MEDIUM' WHEN contains(upper(o_orderpriority), 'LOW') THEN 'LOW' ELSE o_orderpriority END AS option FROM orders",
    "option_earliest": "WITH u AS (SELECT doc_id, upper(text) AS t FROM documents), o AS (SELECT doc_id, t, unnest(['THE', 'AND', 'DE', 'LA', 'DER', 'QUE']) AS o FROM u), h AS (SELECT doc_id, o, instr(t, o) AS p FROM o WHERE instr(t, o) > 0) SELECT u.doc_id, coalesce((SELECT h.o FROM h WHERE h.doc_id = u.doc_id ORDER BY h.p, h.o LIMIT 1), 'NO INFORMATION') AS option FROM u",
    "metadata_positional_parse": f"WITH d AS (SELECT doc_id, {_strip('text')} AS t, string_split({_strip('text')}, chr(10)) AS s FROM documents) SELECT doc_id, " + ", ".join(f"CASE WHEN t = '' THEN 'NO_TEXT_FOUND' ELSE coalesce({_strip(f's[{i + 1}]')}, 'N/A') END AS {n}" for i, n in enumerate(_META)) + " FROM d",
    "strength_tokens": "WITH p AS (SELECT p_partkey, p_name, p_name || ' ' || p_size || 'mg ' || printf('%.2f', p_retailprice) AS n FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(n, '\\d+(?:\\.\\d+)?'), lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(regexp_replace(x, '0+$', ''), '\\.$', '') ELSE x END))), '|') AS strengths, "
    f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(p_name), 'é', 'e'), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_in(C.COMPANY_STOP_WORDS)})))), '|') AS words FROM p",
    "enzyme_extract": "WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT unnest(range(-%d, 0)), unnest([%s])), m AS (SELECT doc_id, list_concat(list_transform(list_concat(regexp_extract_all(text, '(?i)CYP\\s*(\\d+[A-Z]\\d*)', 1), regexp_extract_all(text, '(?i)cytochrome\\s+P450\\s+(\\d+[A-Z]\\d*)', 1), regexp_extract_all(text, '(?i)P450\\s+(\\d+[A-Z]\\d*)', 1), regexp_extract_all(text, '(?i)isoenzyme\\s+(\\d+[A-Z]\\d*)', 1), regexp_extract_all(text, '(?i)CYP\\s*(\\d+[A-Z])', 1), regexp_extract_all(text, '(?i)cytochrome\\s+P450\\s+(\\d+[A-Z])', 1)), lambda x: 'CYP' || upper(x)), list_transform(flatten(list_transform(regexp_extract_all(text, '(?i)CYP\\s*([\\dA-Z]+[/\\\\][\\dA-Z]+)', 1), lambda x: string_split_regex(x, '[/\\\\]'))), lambda x: 'CYP' || x)) AS e FROM d) SELECT doc_id, CASE WHEN len(e) > 0 THEN array_to_string(list_sort(list_distinct(e)), ', ') ELSE 'no' END AS enzymes FROM m"
    % (len(_ENZYME_TEXTS), _in(_ENZYME_TEXTS)),
    "cleanups": f"WITH d AS (SELECT doc_id, text AS line FROM documents) SELECT doc_id, CASE WHEN {_PARA} = '' THEN 'SUMMARY_GENERATION_FAILED' ELSE {_PARA} END AS paragraph, CASE WHEN line = '' THEN 'EXTRACTION_FAILED' WHEN {_WARN} IN ('********', '') THEN '******' ELSE {_WARN} END AS warnings, CASE WHEN line = '' THEN 'EXTRACTION_FAILED' ELSE {_interactions_sql('line')} END AS interactions, regexp_replace(regexp_replace(line, '\\s+', ' ', 'g'), ',\\s*', ', ', 'g') AS adverse, CASE WHEN line IN ({_in(C.SENTINELS)}) THEN 0 ELSE len(string_split(line, ',')) END AS n_items, CASE WHEN line = '' THEN 'Urine elimination: EXTRACTION_FAILED' || chr(10) || 'Faeces elimination: EXTRACTION_FAILED' WHEN contains(line, 'Urine elimination:') AND contains(line, 'Faeces elimination:') THEN {_strip('line')} ELSE 'Urine elimination: ERROR' || chr(10) || 'Faeces elimination: ERROR' END AS elimination, substr(line, 1, 60) AS head FROM d",
}
