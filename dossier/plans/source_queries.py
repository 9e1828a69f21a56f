"""Queries on files, records, exports, lookups and prompts, made of the given tables, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import ids, text
from ..functions import keyword_list as K
from ..sources import answers, files, lookups, paged, records
from ..sources.shared import shared_folder
from .eval_queries import _empty_sql
from .list_queries import _in, _q, _strip, _t
from .woven import outlined

_FIELDS = [f for f in C.RECORD_FIELDS if f.kind != "key"][:3]
_ALIASES = list(C.NAME_ALIASES)
_OPTIONS = C.PREGNANCY_OPTIONS


def record_rewrite(spark, sf_dir):
    """Customers appended in two goes, then rewritten with other brands; read again in the documented order."""
    c = _t(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(".pdf")).alias("Source Path"), F.col("c_mktsegment").alias("Brand Name"), F.col("c_custkey").cast("string").alias("ID"), F.lit("x").alias("not a field"))
    path = shared_folder(spark, "records")
    for rest in (0, 1):
        records.append_records(c.where(F.col("ID").cast("long") % 2 == rest), path)
    order = ["ID", "Brand Name", "absent", "Source Path"]
    first = records.split_bad(records.read_records(spark, path, order))[0]
    records.rewrite_records(first.withColumn("Brand Name", F.lower("Brand Name")), f"{path}-b")
    records.rewrite_records(records.split_bad(records.read_records(spark, f"{path}-b", order))[0].where("cast(ID as long) % 5 <> 0"), f"{path}-b")
    again = records.ordered(records.split_bad(records.read_records(spark, f"{path}-b", order))[0], order)
    return again.select(F.col("ID").alias("id"), F.col("Brand Name").alias("brand"), F.col("Source Path").alias("key"), F.col("absent").isNull().alias("absent"))


def field_tables(spark, sf_dir):
    """A table for each field of records made of documents, read again."""
    d = _t(spark, sf_dir, "documents")
    columns = {_FIELDS[0].record: F.col("text"), _FIELDS[1].record: F.col("lang"), _FIELDS[2].record: F.upper("source")}
    paths = records.write_field_tables(d.select(F.col("doc_id").cast("string").alias("ID"), *[v.alias(c) for c, v in columns.items()]), shared_folder(spark, "fields"))
    out = None
    for path in paths:
        part = records.read_csv(spark, path, "ID string, value string").select(F.lit(path.rsplit("/", 1)[-1]).alias("field"), F.col("ID").alias("id"), F.md5("value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def csv_round_trip(spark, sf_dir):
    """Documents with line breaks, quotes and outer blanks through CSV."""
    d = _t(spark, sf_dir, "documents").select(F.format_string("%08d", F.col("doc_id")).alias("id"), F.concat(F.lit('  "'), F.col("text"), F.lit('",\\ ')).alias("text"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("lang"))
    path = shared_folder(spark, "csv")
    records.write_csv(d, path)
    return records.read_csv(spark, path, "id string, text string, lang string").select("id", F.md5("text").alias("text"), "lang")


def json_document(spark, sf_dir):
    """The benchmark as one JSON document."""
    path = shared_folder(spark, "document.json")
    records.write_json(_t(spark, sf_dir, "benchmark").withColumn("none", F.lit(None).cast("string")), path)
    return records.read_json(spark, path, "item_id long, text string, none string").select("item_id", "text", F.col("none").isNull().alias("none"))


def _files(spark, sf_dir) -> str:
    """Every web page as a file of three pages with two outline entries, in three folders; suffixes in both cases."""
    p = _t(spark, sf_dir, "pages")
    name = F.concat(F.lit("folder "), (F.col("page_id") % 3).cast("string"), F.lit("/p-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 0, ".TXT").otherwise(".txt"))
    content = F.concat(F.lit("# first\n"), "html", F.lit("\f## Part  two\n"), "url", F.lit("\fend"))
    root = shared_folder(spark, "corpus")
    files.write_files(p.select(name.alias("name"), content.alias("content")), root, "name", "content")
    return root


def discovered_files(spark, sf_dir):
    """Files of a folder and of those below it, and only those of one folder with the suffix as it is written."""
    root = _files(spark, sf_dir)
    every = files.discover(spark, root, "txt").select("key", "filename", "length", F.lit("all").alias("listing"))
    few = files.discover(spark, f"{root}/folder 1", "txt", recursive=False, ignore_case=False).select("key", "filename", "length", F.lit("one folder").alias("listing"))
    return every.unionByName(few)


def decoded_files(spark, sf_dir):
    """Chosen pages, a range of pages and the first outline entry with a title, out of decoded files."""
    docs = files.decode(files.read_files(spark, _files(spark, sf_dir), "txt"), files.TextDecoder())
    entry = F.get(F.filter("outline", lambda e: e["title"].startswith("Part")), F.lit(0))
    return docs.select("key", "sha256", F.md5(files.page_text(F.col("pages"), (0, 2, 9))).alias("chosen"), F.md5(files.page_range(F.col("pages"), 2, 3)).alias("range"), entry["page"].alias("page"), entry["depth"].alias("depth"), entry["title"].alias("title"), F.col("error").isNull().alias("whole"))


def paged_file_source(spark, sf_dir):
    """Pages 2 and 3 of every file, through the data source; files of broken bytes are told apart."""
    p = _t(spark, sf_dir, "pages")
    text = F.concat("url", F.lit("\f"), "html", F.lit("\f"), F.when(F.col("page_id") % 3 == 0, " ").otherwise("third"), F.lit("\ffourth"))
    content = F.when(F.col("page_id") % 7 == 0, F.unhex(F.lit("61FF0C62FF"))).otherwise(F.encode(text, "UTF-8"))
    root = shared_folder(spark, "paged")
    files.write_files(p.select(F.concat((F.col("page_id") % 4).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".Txt")).alias("name"), content.alias("content")), root, "name", "content")
    rows = paged.read_pages(spark, root, "txt", "strict text", 2, 3, partition_bytes=100_000)
    return rows.select("key", "page_num", F.md5("text").alias("digest"), F.col("error").isNotNull().alias("broken"))


def first_outline_hits(spark, sf_dir):
    """For each document and target the first outline entry that matches."""
    return files.first_entries(outlined(spark, sf_dir), "doc_id", {"warn": "warn|precaut", "part two": r"^part\s+ii", "none": "overdose"})


def memoised_lookup(spark, sf_dir):
    """Sources looked up once each; those that are known are not fetched again."""
    d = _t(spark, sf_dir, "documents").select("source")
    known = d.where("source like '%1'").distinct().select("source", F.lit("known").alias("value"), F.lit(None).cast("string").alias("error"))

    def fetch(key: str) -> str:
        if key.endswith("7"):
            raise ValueError("no such source")
        return key.upper()

    return lookups.lookup(d, "source", known, fetch, attempts=2, backoff=0, pace=0)


def prompts(spark, sf_dir):
    """The prompt of one field for every document, the text being the section."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "text", F.upper("source").alias("drug"))
    return answers.requested(d, "chunk_adverse", "text", "drug").select("doc_id", "field", F.md5("prompt").alias("prompt"), "system")


def status_options(spark, sf_dir):
    """Every document as an answer that may name an option; the misspelt one counts as written, or as meant."""
    named = F.element_at(F.array(*[F.lit(o.lower()) for o in _OPTIONS], F.lit("contraindicated"), F.lit("")), (F.col("doc_id") % (len(_OPTIONS) + 2) + 1).cast("int"))
    said = F.concat("text", F.lit(" "), named)
    return _t(spark, sf_dir, "documents").select("doc_id", text.status_option(said, _OPTIONS).alias("written"), text.status_option(said, _OPTIONS, True).alias("meant"))


def names_in_text(spark, sf_dir):
    """Whether a text names a part and its maker."""
    brand, company = F.col("p_name"), F.concat("p_brand", F.lit(" Laboratoires Inc."))
    said = F.concat(F.lit("Monograph of "), F.when(F.col("p_partkey") % 3 > 0, F.upper(F.replace("p_name", F.lit(" "), F.lit(" - ")))).otherwise(F.col("p_type")), F.lit(" by "), F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).otherwise(F.lit("nobody")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.names_found(brand, company, said).alias("found"))


def released_texts(spark, sf_dir):
    """Special blanks and hyphens and a misspelt word of every document, made plain."""
    odd = F.concat(F.translate("text", " ", " "), F.lit(" non‑stop Contrandicated contrandicateds"))
    return text.release_clean(_t(spark, sf_dir, "documents").select("doc_id", odd.alias("text"))).select("doc_id", F.md5("text").alias("text"))


def aliased_names(spark, sf_dir):
    """Names with other spellings, and those of parts."""
    pick = F.element_at(F.array(*map(F.lit, _ALIASES)), (F.col("p_partkey") % len(_ALIASES) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", ids.aliased(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper(pick), F.lit(" "))).otherwise(F.col("p_name"))).alias("name"))


def item_sets(spark, sf_dir):
    """The set that each whole document stands for as a comma list, in two readings of the placeholder."""
    said = F.when(F.col("doc_id") % 6 == 0, F.lit(" NONE_FOUND ")).otherwise(F.col("text"))
    digest = lambda a: F.md5(F.array_join(F.array_sort(a), "|"))
    empty, kept = K.item_set(said), K.item_set(said, False)
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(empty).alias("n"), digest(empty).alias("items"), F.size(kept).alias("n_kept"))


def merged_outputs(spark, sf_dir):
    """Two runs' outputs with different columns as one table."""
    d = _t(spark, sf_dir, "documents")
    a = d.where("doc_id % 2 = 0").select("doc_id", "lang")
    b = d.where("doc_id % 2 = 1").select("source", "doc_id")
    return a.unionByName(b, allowMissingColumns=True)


QUERIES = {
    f.__name__: f
    for f in (
        record_rewrite, field_tables, csv_round_trip, json_document, discovered_files, decoded_files, paged_file_source, first_outline_hits, memoised_lookup, prompts, status_options, names_in_text, released_texts, aliased_names, item_sets, merged_outputs,
    )
}

_CONTENT = "'# first' || chr(10) || html || chr(12) || '## Part  two' || chr(10) || url || chr(12) || 'end'"
_FILE = "'p-' || page_id || CASE WHEN page_id % 4 = 0 THEN '.TXT' ELSE '.txt' END"


def _prompt_sql() -> str:
    call = answers.CALLS["chunk_adverse"]
    return "replace(replace(" + _q(call.template) + ", '{drug}', upper(source)), '{text}', text)"


def _status_sql(said: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(upper({said}), {_q(o.upper())}) THEN {_q(o)}" for o in _OPTIONS) + " ELSE 'NO INFORMATION' END"


ORACLE_SQL = {
    "record_rewrite": "SELECT c_custkey::VARCHAR AS id, lower(c_mktsegment) AS brand, c_name || '.pdf' AS key, true AS absent FROM customer WHERE c_custkey % 5 <> 0",
    "field_tables": f"SELECT {_q(_FIELDS[0].name)} AS field, doc_id::VARCHAR AS id, md5(text) AS value FROM documents UNION ALL SELECT {_q(_FIELDS[1].name)}, doc_id::VARCHAR, md5(lang) FROM documents UNION ALL SELECT {_q(_FIELDS[2].name)}, doc_id::VARCHAR, md5(upper(source)) FROM documents",
    "csv_round_trip": "SELECT lpad(doc_id::VARCHAR, 8, '0') AS id, md5('  \"' || text || '\",\\ ') AS text, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM documents",
    "json_document": "SELECT item_id, text, true AS none FROM benchmark",
    "discovered_files": f"WITH f AS (SELECT page_id, {_FILE} AS filename, strlen({_CONTENT}) AS length FROM pages) SELECT 'folder ' || page_id % 3 || '/' || filename AS key, filename, length, 'all' AS listing FROM f UNION ALL SELECT filename, filename, length, 'one folder' FROM f WHERE page_id % 3 = 1 AND page_id % 4 <> 0",
    "decoded_files": f"SELECT 'folder ' || page_id % 3 || '/' || {_FILE} AS key, sha256({_CONTENT}) AS sha256, md5('# first' || chr(10) || html || chr(10) || 'end') AS chosen, md5('--- PAGE 2 ---' || chr(10) || '## Part  two' || chr(10) || url || chr(10) || '--- PAGE 3 ---' || chr(10) || 'end') AS range, 2 AS page, 1 AS depth, 'Part two' AS title, true AS whole FROM pages",
    "paged_file_source": """WITH p AS (SELECT page_id, page_id % 4 || '/' || page_id || '.Txt' AS key, html FROM pages)
SELECT key, 2 AS page_num, md5(html) AS digest, false AS broken FROM p WHERE page_id % 7 <> 0 AND trim(html) <> '' UNION ALL SELECT key, 3, md5('third'), false FROM p WHERE page_id % 7 <> 0 AND page_id % 3 <> 0 UNION ALL SELECT key, NULL, NULL, true FROM p WHERE page_id % 7 = 0""",
    "first_outline_hits": "SELECT doc_id, 'warn' AS target, '7 Warnings' AS title, 4 AS page FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, 'part two', 'PART II: SCIENTIFIC INFORMATION', 6 FROM documents WHERE doc_id % 3 <> 1",
    "memoised_lookup": "SELECT DISTINCT source, CASE WHEN source LIKE '%1' THEN 'known' WHEN source NOT LIKE '%7' THEN upper(source) END AS value, CASE WHEN source LIKE '%7' THEN 'ValueError: no such source' END AS error FROM documents WHERE source IS NOT NULL",
    "prompts": f"SELECT doc_id, 'chunk_adverse' AS field, md5({_prompt_sql()}) AS prompt, {_q(answers.CALLS['chunk_adverse'].system)} AS system FROM documents",
    "status_options": f"""WITH s AS (SELECT doc_id, text || ' ' || [{', '.join(_q(o.lower()) for o in _OPTIONS)}, 'contraindicated', ''][doc_id % {len(_OPTIONS) + 2} + 1] AS said FROM documents)
SELECT doc_id, {_status_sql('said')} AS written, {_status_sql("replace(upper(said), 'CONTRAINDICATED', 'CONTRANDICATED')")} AS meant FROM s""",
    "names_in_text": f"""WITH s AS (SELECT p_partkey, lower(p_name) AS brand, regexp_extract_all(lower(p_brand || ' Laboratoires Inc.'), '[a-zé]{{3,}}') AS ws, regexp_replace(lower('Monograph of ' || CASE WHEN p_partkey % 3 > 0 THEN upper(replace(p_name, ' ', ' - ')) ELSE p_type END || ' by ' || CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE 'nobody' END), '[\\s\\-‐‑]+', ' ', 'g') AS page FROM part),
w AS (SELECT *, list_filter(ws, lambda w: w NOT IN ({_in(C.COMPANY_STOP_WORDS)})) AS own FROM s)
SELECT p_partkey, contains(page, trim(regexp_replace(brand, '[\\s\\-‐‑]+', ' ', 'g'))) AND (len(own) = 0 OR len(list_filter(own, lambda w: contains(page, w))) > 0) AS found FROM w""",
    "released_texts": "SELECT doc_id, md5(replace(replace(replace(text, chr(8239), ' '), chr(8209), '-'), chr(160), ' ') || ' non-stop contraindicated contrandicateds') AS text FROM documents",
    "aliased_names": "WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [" + ", ".join(_q(a) for a in _ALIASES) + f"][p_partkey % {len(_ALIASES)} + 1] ELSE lower(trim(p_name)) END AS n FROM part) SELECT p_partkey, CASE n " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in C.NAME_ALIASES.items()) + " ELSE n END AS name FROM a",
    "item_sets": f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN ' NONE_FOUND ' ELSE text END AS t FROM documents), i AS (SELECT doc_id, t, list_distinct(list_filter(list_transform(string_split(t, ','), lambda x: regexp_replace(lower({_strip('x')}), '\\s+', ' ', 'g')), lambda x: x <> '')) AS items FROM s),
k AS (SELECT doc_id, CASE WHEN {_empty_sql('t')} OR {_strip('t')} = 'NONE_FOUND' THEN [] ELSE items END AS a, CASE WHEN {_empty_sql('t')} THEN [] ELSE items END AS b FROM i)
SELECT doc_id, len(a)::INT AS n, md5(array_to_string(list_sort(a), '|')) AS items, len(b)::INT AS n_kept FROM k""",
    "merged_outputs": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents",
}
