"""Evaluation, matching, curation and sampling queries with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import keyword_list as K
from ..functions import text
from ..operators import matching as M
from ..operators import profile as R
from ..operators import resampling as B
from ..operators import scoring as S
from ..operators import similarity as V
from ..sources import records
from .list_queries import _in, _q, _strip, _t

SEED = 20261005
#: As many as the reference draws.
RESAMPLES = 10_000
_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z]{{4,}}'))"


def _adjacent(spark, sf_dir):
    """Word sets of each document and the next one by id, as gold and prediction."""
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", K.token_set(F.col("text")).alias("gold"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("gold").alias("predicted"))
    return S.overlap_counts(d.join(nxt, "doc_id"), "gold", "predicted")


def _empty_sql(c: str) -> str:
    return f"({c} IS NULL OR {_strip(c)} = '' OR " + " OR ".join(f"starts_with(lower({_strip(c)}), {_q(p)})" for p in C.EMPTY_PREFIXES) + ")"


_ADJ = f"""d AS (SELECT doc_id, lang, CASE WHEN {_empty_sql("l")} THEN [] ELSE {_TOK.format("l")} END AS g FROM (SELECT doc_id, lang, text AS l FROM documents)),
a AS (SELECT d.doc_id, d.lang, d.g, e.g AS p, len(list_intersect(d.g, e.g)) AS tp FROM d JOIN d e ON e.doc_id = d.doc_id + 1),
c AS (SELECT doc_id, lang, tp, len(p) - tp AS fp, len(g) - tp AS fn FROM a)"""
_PRF = """round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
round(CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN CASE WHEN tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END END, 6) AS f1"""


def set_prf_per_doc(spark, sf_dir):
    return S.prf(_adjacent(spark, sf_dir).where("tp + fp + fn > 0")).select("doc_id", "tp", "fp", "fn", "precision", "recall", "f1")


def set_prf_micro(spark, sf_dir):
    return S.micro(_adjacent(spark, sf_dir), "lang")


def macro_row(spark, sf_dir):
    rows = S.prf(_adjacent(spark, sf_dir).where("tp + fp + fn > 0")).select(F.col("doc_id").cast("string").alias("id"), "precision", "recall", "f1")
    return S.with_average(rows, "id")


def _numbered(spark, sf_dir):
    """Documents with the item of their number modulo the benchmark's size; items are numbered from 0."""
    size = _t(spark, sf_dir, "benchmark").agg(F.count("*").alias("n_items"))
    return _t(spark, sf_dir, "documents").crossJoin(F.broadcast(size)).withColumn("item_id", F.expr("try_mod(doc_id, n_items)"))


def jaccard_tokens(spark, sf_dir):
    """Each benchmark item against the documents of the same number modulo the benchmark's size."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", K.token_set(F.col("text")).alias("b"))
    d = _numbered(spark, sf_dir).select("doc_id", "item_id", K.token_set(F.col("text")).alias("d"))
    return d.join(b, "item_id").select("doc_id", "item_id", F.round(S.jaccard(F.col("d"), F.col("b")), 6).alias("jaccard"))


def jaccard_mean(spark, sf_dir):
    """Mean overlap of documents and benchmark items by language, over those that have words."""
    b = _t(spark, sf_dir, "benchmark").select("item_id", K.token_set(F.col("text")).alias("b"))
    d = _numbered(spark, sf_dir).select("lang", "item_id", K.token_set(F.col("text")).alias("d"))
    return S.mean_jaccard(d.join(b, "item_id").select("lang", S.jaccard(F.col("d"), F.col("b")).alias("overlap")), "overlap", "lang")


def accuracy_wilson(spark, sf_dir):
    """Agreement of two raters by source, with Wilson intervals."""
    labels = _t(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1 - F.col("toxic")).alias("correct"))
    rows = labels.join(_t(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    g = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("accuracy"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def category_accuracy(spark, sf_dir):
    """Priorities of consecutive orders as gold and predicted category; gold LOW counts as empty."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    gold = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("no information")).otherwise(F.col("o_orderpriority"))
    a = o.select("o_orderkey", gold.alias("gold")).join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.upper("o_orderpriority").alias("predicted")), "o_orderkey")
    ok = S.category_correct(F.col("gold"), F.col("predicted"))
    return a.select("gold", ok.alias("ok")).groupBy("gold").agg(F.count("ok").alias("scored"), F.count_if("ok").alias("correct"))


def date_accuracy(spark, sf_dir):
    """Order date against ship date as text, by order status."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("gold"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.date_format("l_shipdate", "yyyy-MM").alias("predicted"))
    j = o.join(lines, "o_orderkey").groupBy("o_orderstatus")
    return j.agg(F.count("*").alias("n"), F.count_if(S.date_correct(F.col("gold"), F.col("predicted"))).alias("correct"))


def error_kind_pivot(spark, sf_dir):
    """Words of benchmark items as gold, documents as predictions: kinds of error by language."""
    given = F.split("text", "\n")[0]
    d = _numbered(spark, sf_dir).select("lang", "item_id", given.alias("given"), F.array_distinct(K.stems(given)).alias("gs"), F.array_distinct(K.stems(F.col("text"))).alias("ts"))
    b = _t(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split("text", r"[\s.,]+")).alias("words"))
    rows = d.join(b, "item_id").select("lang", "given", "gs", "ts", F.explode(F.filter("words", lambda w: F.length(w) >= 4)).alias("word"))
    kind = S.error_kind(F.contains(F.col("given"), F.col("word")), F.lit(True), F.col("word"), F.col("gs"), F.col("ts"))
    kinds = ["correct", "missed, in the given text", "missed, not in the given text", "missed, not found in the text"]
    wide = rows.withColumn("kind", kind).groupBy("lang").pivot("kind", kinds)
    return wide.count().na.fill(0).toDF("lang", "correct", "missed_given", "missed_full", "missed_none")


def coverage_group(spark, sf_dir):
    """Sums, median and maximum with a share, by source; the pivot of means by language."""
    d = _t(spark, sf_dir, "documents")
    g = d.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("docs"), F.median("n_chars").alias("median"), F.max("n_chars").alias("longest"))
    p = d.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.avg("n_chars"), 4))
    total = d.agg(F.sum("n_chars").alias("total"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.round(100 * F.col("chars") / F.col("total"), 1)).join(p, "source").select("source", "chars", "docs", "median", "longest", "share", "de", "en", "es", "fr")


def crosstab_verdict(spark, sf_dir):
    """Verdicts on pages by a label of the document of the same number."""
    p = _t(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("size"))
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    j = p.join(labels, "page_id", "left")
    verdict = M.link_verdict(F.when(F.col("page_id") % 7 != 0, F.col("url")), F.col("page_id") % 5 == 0, F.col("page_id") % 3 == 0, F.col("size") / 10000)
    kept = M.verified(verdict, F.col("size") / 10000, F.col("quality") == 1)
    g = j.select(verdict.alias("verdict"), kept.alias("kept")).groupBy("verdict").pivot("kept", [True, False]).count().na.fill(0)
    return g.toDF("verdict", "kept", "dropped")


def word_bag_groups(spark, sf_dir):
    """Names that are one by their word bag: counts of equal keys."""
    from ..functions import ids

    return _t(spark, sf_dir, "part").groupBy(ids.word_bag(F.col("p_name")).alias("bag")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).where("n > 1")


def resume_anti_join(spark, sf_dir):
    """Events without a record, the first 100 by id; records that failed count as done."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    done = e.where("event_id % 2 = 0").select(F.col("event_id").alias("Source Path"), F.when(F.col("event_id") % 4 == 0, F.lit("ERROR: x")).otherwise(F.col("event_type")).alias("Brand Name"))
    return records.pending(e, done, key="event_id", limit=100)


def retry_failed(spark, sf_dir):
    """Done keys whose record failed are queued again."""
    e = _t(spark, sf_dir, "events").withColumn("brand", F.when(F.col("event_type") == "error", F.lit("ERROR: x")).when(F.col("event_id") % 11 == 0, F.lit("ERROR")).otherwise(F.col("event_type")))
    done = e.select(F.col("event_id").alias("Source Path"), F.col("brand").alias("Brand Name"))
    return records.pending(e.select("event_id", "brand"), done, key="event_id", retry=True)


def prioritised_match(spark, sf_dir):
    """Customers matched with suppliers by exact balance, then number, then nation."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("k1"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("k2"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("k3"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string").alias("k1"), F.col("s_suppkey").alias("k2"), F.col("s_nationkey").alias("k3"))
    return M.prioritised(c, s, "c_custkey", "s_suppkey", [("k1", "k1"), ("k2", "k2"), ("k3", "k3")])


def unmatched_report(spark, sf_dir):
    """Customers without an urgent order."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return M.unmatched(c, o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


def left_lookup_publish(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("ok"))
    return M.publish(o, c, "key", "name", "ok")


def theta_prefix_anti(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("product"))
    out = p.where("p_partkey % 10 = 0").withColumn("product", F.substring("product", 1, 6))
    return M.prefix_anti(p.where("p_partkey % 10 <> 0"), out, "p_brand", "product")


def assert_single_resolution(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return M.resolve_single(n, _t(spark, sf_dir, "region"), "r_regionkey")


def _halves(spark, sf_dir):
    """All vectors of even and of odd id."""
    e = _t(spark, sf_dir, "embeddings")
    return e.where("vec_id % 2 = 0").select("label", F.col("vec_id").alias("i"), F.col("embedding").alias("a")), e.where("vec_id % 2 = 1").select("label", F.col("vec_id").alias("j"), F.col("embedding").alias("b"))


def pair_similarity(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return V.similar_pairs(a, b, "label", "i", "j", "a", "b", 0.1).withColumn("sim", F.round("sim", 6))


def greedy_match_tp(spark, sf_dir):
    """Greedy matches within each label at three thresholds."""
    a, b = _halves(spark, sf_dir)
    taken = M.greedy_counts(a, b, "label", "i", "j", "a", "b", 0.1)
    levels = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "threshold double")
    return taken.join(F.broadcast(levels), F.col("sim") >= F.col("threshold")).groupBy("label", "threshold").agg(F.sum("n").cast("int").alias("tp"))


def critical_items(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return V.nearest(a, b, "label", "i", "a", "b", 0.25).withColumn("sim", F.round("sim", 6))


def critical_recall(spark, sf_dir):
    """Of the critical items of each label, those whose nearest warning reaches the higher threshold."""
    a, b = _halves(spark, sf_dir)
    items = V.nearest(a, b, "label", "i", "a", "b", 0.25).select("label", F.lit(1).alias("critical"), (F.col("sim") >= 0.3).cast("int").alias("hit"))
    return S.critical_recall(items, "hit", "critical", "label")


def link_agreement(spark, sf_dir):
    """Parts as records whose links found a product: whether company, brand and strength agree."""
    key = F.col("p_partkey")
    p = _t(spark, sf_dir, "part")
    name = F.concat(F.lower("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"), F.when(key % 6 == 0, F.lit("-2")).otherwise(F.lit("")))
    links = p.select(key.alias("din"), name.alias("id"), F.col("p_name").alias("brand"), F.concat("p_brand", F.lit(" Pharma Inc.")).alias("company"))
    products = p.where("p_partkey % 11 <> 0").select(
        key.alias("din"), (key + 1000000).alias("drug_code"), F.when(key % 4 == 0, F.col("p_type")).otherwise(F.upper("p_name")).alias("found_brand"),
        F.when(key % 5 == 0, F.lit("Other Limited")).otherwise(F.concat("p_brand", F.lit(" LTD"))).alias("found_company"),
    )
    amount = F.when(key % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise((F.col("p_size") + key % 2).cast("string"))
    found = M.with_product(links, products, p.select((key + 1000000).alias("drug_code"), amount.alias("strength")), "din", "drug_code")
    return M.agreement(found, "id", "brand", "company", "found_brand", "found_company", "found_strengths").select("din", "company_ok", "brand_ok", "strength_ok", "all_ok")


def targeted_removal(spark, sf_dir):
    """Suppliers with two known copies, without these."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    copies = s.where("s_suppkey in (3, 7)").withColumn("s_name", F.lit("copy"))
    return M.remove_duplicates(s.unionByName(copies), "s_suppkey", [3, 7], F.col("s_name") == "copy")


def reshape_columns(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return records.reshape(n, drop=("n_regionkey", "absent"), rename={"n_name": "name"}, insert={1: ("key", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")))})


def distinct_counts(spark, sf_dir):
    """Languages, and pairs of language and source."""
    return R.distinct_counts(_t(spark, sf_dir, "documents"), {"languages": ["lang"], "sites": ["lang", "source"]})


def dedup_keep_last(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return M.keep_last(e, ["user_id", "event_type"], ["event_id"])


def interval_merge(spark, sf_dir):
    """Sessions: events of a user whose ten-minute spans overlap."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    e = _t(spark, sf_dir, "events").select("user_id", s.alias("s"), (s + 36000).alias("e"))
    return M.merge_intervals(e, ["user_id"], "s", "e")


def stratified_draw(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", F.lower("p_name").alias("product"))
    return M.stratified_draw(p, "p_brand", "p_partkey", "product", SEED)


def eligibility_counts(spark, sf_dir):
    """The first reason that excludes a part, counted."""
    reason = F.when(F.col("p_partkey") % 13 == 0, "development").when(F.col("p_brand").endswith("1"), "same product").when(F.col("p_size") < 5, "unreadable").otherwise("eligible")
    return _t(spark, sf_dir, "part").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def paired_diff_counts(spark, sf_dir):
    """Quantities of the first and second line of each order, by ship year."""
    li = _t(spark, sf_dir, "lineitem")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("a"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_quantity").alias("b"))
    return S.paired_counts(a.join(b, "l_orderkey"), "a", "b", "year")


def signed_rank_w(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    a = li.where("l_linenumber = 1").select("l_orderkey", (F.col("l_suppkey") % 10).alias("g"), F.col("l_quantity").alias("a"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_quantity").alias("b"))
    ranks = S.signed_rank(a.join(b, "l_orderkey").withColumn("d", F.col("b") - F.col("a")), "d", "g")
    return ranks.select("g", "n", F.round("w", 6).alias("w"), F.round("z", 6).alias("z"), F.round("p", 5).alias("p"))


def signed_rank_exact(spark, sf_dir):
    """Prices of the first and second line of each order by supplier and ship year: groups small enough for the exact p, others beside them."""
    li = _t(spark, sf_dir, "lineitem")
    a = li.where("l_linenumber = 1").select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("a"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_extendedprice").alias("b"))
    d = a.join(b, "l_orderkey").select("l_suppkey", "year", F.round((F.col("b") - F.col("a")) * 100).cast("long").alias("d"))
    return S.signed_rank(d, "d", "l_suppkey", "year").select("l_suppkey", "year", "n", F.round("w", 6).alias("w"), F.round("z", 6).alias("z"), F.round("p", 5).alias("p"))


def _confusion(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("tp"), (F.col("toxic") == 1).cast("int").alias("fp"))


def bootstrap_ci(spark, sf_dir):
    """Precision over resamples of all labelled documents, drawn by a hash of (seed, resample, draw)."""
    value = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    return B.percentile_interval(B.bootstrap(_confusion(spark, sf_dir), ["tp", "fp"], value, RESAMPLES, SEED))


def bootstrap_paired_diff(spark, sf_dir):
    """The difference of two systems' recalls over the same resamples; an empty denominator counts as one."""
    rows = _confusion(spark, sf_dir).withColumn("other", (F.col("doc_id") % 3 == 0).cast("int")).withColumn("one", F.lit(1))
    value = (F.col("other") - F.col("tp")) / F.greatest(F.col("one"), F.lit(1)).cast("double")
    return B.percentile_interval(B.bootstrap(rows, ["tp", "other", "one"], value, RESAMPLES, SEED))


def union_append_average(spark, sf_dir):
    g = _t(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 7).cast("string").alias("id")).agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))
    return S.with_average(g, "id")


def field_success(spark, sf_dir):
    """Success counts over records made of documents, as published and strict."""
    d = _t(spark, sf_dir, "documents")
    r = d.select(F.when(F.col("doc_id") % 5 == 0, "SECTION_NOT_FOUND").when(F.col("doc_id") % 7 == 0, "ERROR: x").when(F.col("doc_id") % 11 != 0, F.col("source")).alias("indications"), F.when(F.col("doc_id") % 6 == 0, "EXTRACTION_FAILED").otherwise(F.col("lang")).alias("contraindications"))
    fields = {"indications": C.MISSING, "contraindications": C.MISSING}
    return S.field_success(r, fields).withColumn("mode", F.lit("published")).unionByName(S.field_success(r, fields, True).withColumn("mode", F.lit("strict")))


def threshold_sweep(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return V.threshold_counts(a, b, "label", "a", "b", [0.1, 0.2, 0.3])


def id_set_operations(spark, sf_dir):
    """Ids in both, in one, in either of two halves of the labels."""
    a, b = _t(spark, sf_dir, "labels").select("doc_id"), _t(spark, sf_dir, "documents").select("doc_id").where("doc_id % 3 = 0")
    named = [("both", a.intersect(b)), ("only_labels", a.exceptAll(b)), ("either", a.union(b).distinct())]
    out = None
    for name, rows in named:
        part = rows.agg(F.count("*").alias("n"), F.sum("doc_id").alias("total")).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        set_prf_per_doc, set_prf_micro, macro_row, jaccard_tokens, jaccard_mean, critical_recall, link_agreement, targeted_removal, reshape_columns, distinct_counts, accuracy_wilson, category_accuracy, date_accuracy, error_kind_pivot, coverage_group, crosstab_verdict, word_bag_groups,
        resume_anti_join, retry_failed, prioritised_match, unmatched_report, left_lookup_publish, theta_prefix_anti, assert_single_resolution, pair_similarity, greedy_match_tp, critical_items,
        dedup_keep_last, interval_merge, stratified_draw, eligibility_counts, paired_diff_counts, signed_rank_w, signed_rank_exact, bootstrap_ci, bootstrap_paired_diff, union_append_average, field_success, threshold_sweep, id_set_operations,
    )
}

_WILSON = "k / n AS p, n, k, 1.959964 AS z"
_HALVES = "a AS (SELECT label, vec_id AS i, embedding AS a FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT label, vec_id AS j, embedding AS b FROM embeddings WHERE vec_id % 2 = 1), p AS (SELECT label, i, j, round(list_sum(list_transform(range(1, 65), lambda k: a[k]::DOUBLE * b[k]::DOUBLE)), 9) AS sim FROM a JOIN b USING (label))"
_DRAW = f"((p_partkey * 48271 + {SEED}) % 2147483647 * 16807) % 2147483647"
_PAIR = "a AS (SELECT l_orderkey, l_suppkey, l_shipdate, l_quantity AS a FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_orderkey, l_quantity AS b FROM lineitem WHERE l_linenumber = 2), j AS (SELECT * FROM a JOIN b USING (l_orderkey))"


def _name_words(c: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower({c}), 'é', 'e'), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_in(C.COMPANY_STOP_WORDS)}))"


def _plain(c: str) -> str:
    return f"CASE WHEN contains({c}, '.') THEN regexp_replace(regexp_replace({c}, '0+$', ''), '\\.+$', '') ELSE {c} END"


def _scrambled(source: str, column: str) -> str:
    """`source` with a column of 32-bit numbers scrambled as in resampling.mixed."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x735A2D97)):
        source = f"(SELECT * REPLACE ((xor({column}, {column} >> {shift}) * {factor}) % 4294967296 AS {column}) FROM {source})"
    return f"(SELECT * REPLACE (xor({column}, {column} >> 15) AS {column}) FROM {source})"


def _lane(lane: int) -> str:
    """Keys of two words for each resample."""
    start = (SEED + lane * 0x9E3779B9) % (1 << 32)
    one = _scrambled(f"(SELECT b, {start}::BIGINT AS s{lane} FROM range({RESAMPLES}) t(b))", f"s{lane}")
    key = _scrambled(f"(SELECT b, xor(b, s{lane}) AS k{lane} FROM {one})", f"k{lane}")
    return f"SELECT b, k{lane}, f{lane} FROM " + _scrambled(f"(SELECT b, k{lane}, xor(k{lane}, {0x9E3779B9}) AS f{lane} FROM {key})", f"f{lane}")


def _boot(columns: str, counts: str, sums: str, value: str) -> str:
    draws = "(SELECT b, n, xor(i, k0) AS y0, xor(i, k1) AS y1, f0, f1 FROM keys, n, LATERAL (SELECT unnest(range(n)) AS i))"
    for lane in (0, 1):
        draws = _scrambled(f"(SELECT * REPLACE (xor(y{lane}, f{lane}) AS y{lane}) FROM {_scrambled(draws, f'y{lane}')})", f"y{lane}")
    return f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY {counts}) - 1 AS k FROM (SELECT {columns} FROM labels)), n AS (SELECT count(*) AS n FROM l),
keys AS (SELECT * FROM ({_lane(0)}) JOIN ({_lane(1)}) USING (b)), d AS (SELECT b, (y0 * n + ((y1 * n) >> 32)) >> 32 AS k FROM {draws}),
s AS (SELECT b, {sums} FROM d JOIN l USING (k) GROUP BY b), v AS (SELECT {value} AS value FROM s)
SELECT count(*) AS b, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi FROM v"""


#: Two-sided normal tail as in scoring.upper_tail, and the null distribution of the signed ranks: each rank is one more convolution.
_TAIL = "least(2 * exp(-z * z / 2) / 2.5066282746310002 * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))), 1)".format(t="(1 / (1 + 0.2316419 * z))")
_NULL_RANKS = f"""c AS (SELECT 0 AS m, [1]::BIGINT[] AS ways UNION ALL SELECT m + 1, list_transform(range(0, ((m + 1) * (m + 2) // 2 + 1)::BIGINT), lambda w: coalesce(ways[w + 1], 0) + CASE WHEN w > m THEN coalesce(ways[w - m], 0) ELSE 0 END) FROM c WHERE m < {S.EXACT_PAIRS})"""


def _signed_rank_sql(pairs: str, keys: str) -> str:
    """pairs: a query that gives the keys and d."""
    return f"""WITH RECURSIVE {_PAIR}, {_NULL_RANKS}, e AS ({pairs}), t AS (SELECT {keys}, abs(d) AS s, count(*) AS t, count(*) FILTER (WHERE d > 0) AS up FROM e GROUP BY ALL),
r AS (SELECT *, coalesce(sum(CASE WHEN s > 0 THEN t END) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM t),
q AS (SELECT {keys}, coalesce(sum(t) FILTER (WHERE s > 0), 0)::BIGINT AS n, coalesce(sum(up * rk) FILTER (WHERE s > 0), 0) AS plus, coalesce(sum((t - up) * rk) FILTER (WHERE s > 0), 0) AS minus, coalesce(sum(t * t * t - t) FILTER (WHERE s > 0), 0) AS tied, count(*) FILTER (WHERE s = 0) AS zeros FROM r GROUP BY ALL),
z AS (SELECT *, least(plus, minus)::DOUBLE AS w, abs(least(plus, minus) - n * (n + 1.0) / 4) / nullif(sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tied / 48), 0) AS z FROM q)
SELECT {keys}, n, round(w, 6) AS w, round(z, 6) AS z, round(CASE WHEN n = 0 THEN 1.0 WHEN n <= {S.EXACT_PAIRS} AND tied + zeros = 0 THEN least(1.0, 2 * list_sum(ways[1:(w + 1)::BIGINT]) / power(2, n)) ELSE {_TAIL} END, 5) AS p FROM z LEFT JOIN c ON m = n"""


ORACLE_SQL = {
    "set_prf_per_doc": f"WITH {_ADJ} SELECT doc_id, tp, fp, fn, {_PRF} FROM c WHERE tp + fp + fn > 0",
    "set_prf_micro": f"WITH {_ADJ}, s AS (SELECT lang, count(*) AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c WHERE tp + fp + fn > 0 GROUP BY lang) SELECT lang, n, tp, fp, fn, {_PRF.replace("THEN 0.0 ELSE", "THEN NULL ELSE")} FROM s",
    "macro_row": f"WITH {_ADJ}, r AS (SELECT doc_id::VARCHAR AS id, {_PRF} FROM c WHERE tp + fp + fn > 0) SELECT * FROM r UNION ALL SELECT 'AVERAGE', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM r",
    "jaccard_tokens": f"WITH b AS (SELECT item_id, CASE WHEN {_empty_sql('text')} THEN [] ELSE {_TOK.format('text')} END AS b FROM benchmark), d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, CASE WHEN {_empty_sql('text')} THEN [] ELSE {_TOK.format('text')} END AS d FROM documents) SELECT doc_id, item_id, round(len(list_intersect(d, b)) / nullif(len(list_distinct(list_concat(d, b))), 0), 6) AS jaccard FROM d JOIN b USING (item_id)",
    "accuracy_wilson": f"WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1 - toxic) AS k FROM labels JOIN documents USING (doc_id) GROUP BY source), w AS (SELECT source, {_WILSON} FROM g) SELECT source, n, k, round(p, 6) AS accuracy, round(greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0), 6) AS lo, round(least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1), 6) AS hi FROM w",
    "category_accuracy": "WITH j AS (SELECT CASE WHEN a.o_orderpriority = '5-LOW' THEN 'no information' ELSE a.o_orderpriority END AS gold, upper(b.o_orderpriority) AS p FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1) SELECT gold, count(*) FILTER (WHERE gold <> 'no information') AS scored, count(*) FILTER (WHERE gold <> 'no information' AND lower(gold) = lower(p)) AS correct FROM j GROUP BY gold",
    "date_accuracy": "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE strftime(o_orderdate, '%Y-%m') = strftime(l_shipdate, '%Y-%m')) AS correct FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus",
    "error_kind_pivot": """WITH r AS (SELECT doc_id, lang, unnest(list_distinct(string_split_regex(b.text, '[\\s.,]+'))) AS word, string_split(d.text, chr(10))[1] AS given, d.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
s AS (SELECT *, list_transform(regexp_extract_all(lower(word), '[a-z]{4,}'), lambda w: substr(w, 1, 6)) AS ws, list_transform(regexp_extract_all(lower(given), '[a-z]{4,}'), lambda w: substr(w, 1, 6)) AS gs, list_transform(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: substr(w, 1, 6)) AS ts FROM r WHERE length(word) >= 4),
k AS (SELECT lang, CASE WHEN contains(given, word) THEN 1 WHEN len(ws) > 0 AND len(list_filter(ws, lambda w: list_contains(gs, w))) >= 0.75 * len(ws) THEN 2 WHEN len(ws) > 0 AND len(list_filter(ws, lambda w: list_contains(ts, w))) >= 0.75 * len(ws) THEN 3 ELSE 4 END AS kind FROM s)
SELECT lang, count(*) FILTER (WHERE kind = 1) AS correct, count(*) FILTER (WHERE kind = 2) AS missed_given, count(*) FILTER (WHERE kind = 3) AS missed_full, count(*) FILTER (WHERE kind = 4) AS missed_none FROM k GROUP BY lang""",
    "coverage_group": "WITH g AS (SELECT source, sum(n_chars)::BIGINT AS chars, count(*) AS docs, median(n_chars) AS median, max(n_chars) AS longest, " + ", ".join(f"round(avg(n_chars) FILTER (WHERE lang = '{x}'), 4) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source) SELECT *, round(100 * chars / sum(chars) OVER (), 1) AS share FROM g",
    "crosstab_verdict": "WITH j AS (SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN url END AS url, length(html) / 10000 AS sim, quality FROM pages LEFT JOIN labels ON doc_id = page_id), v AS (SELECT *, CASE WHEN url IS NULL THEN 'no link' WHEN page_id % 5 = 0 THEN 'download failed' WHEN page_id % 3 = 0 THEN 'same file' WHEN sim >= 0.6 THEN 'same monograph' ELSE 'different' END AS verdict FROM j), k AS (SELECT verdict, verdict = 'same file' OR (verdict = 'same monograph' AND sim >= 0.8) OR (verdict <> 'no link' AND coalesce(quality = 1, false)) AS k FROM v) SELECT verdict, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS dropped FROM k GROUP BY verdict",
    "word_bag_groups": "SELECT array_to_string(list_sort(list_filter(regexp_extract_all(lower(p_name), '[a-z]{4,}'), lambda w: w <> 'and')), ' ') AS bag, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1",
    "resume_anti_join": "SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 <> 0 ORDER BY event_id LIMIT 100",
    "retry_failed": "WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'ERROR: x' WHEN event_id % 11 = 0 THEN 'ERROR' ELSE event_type END AS brand FROM events) SELECT * FROM e WHERE starts_with(brand, 'ERROR')",
    "prioritised_match": "WITH k AS (SELECT c_custkey, s_suppkey, 0 AS priority FROM customer JOIN supplier ON c_acctbal = s_acctbal UNION ALL SELECT c_custkey, s_suppkey, 1 FROM customer JOIN supplier ON c_custkey % 3 = 0 AND c_custkey = s_suppkey UNION ALL SELECT c_custkey, s_suppkey, 2 FROM customer JOIN supplier ON c_custkey % 2 = 0 AND c_nationkey = s_nationkey), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY priority, s_suppkey) AS rn FROM k) SELECT c_custkey, s_suppkey, priority FROM r WHERE rn = 1",
    "unmatched_report": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "left_lookup_publish": "SELECT o_orderkey, o_custkey AS key, CASE WHEN c_acctbal > 0 THEN c_name END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "theta_prefix_anti": "WITH p AS (SELECT p_partkey, p_brand, lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS product FROM part), x AS (SELECT p_brand, substr(product, 1, 6) AS q FROM p WHERE p_partkey % 10 = 0) SELECT * FROM p WHERE p_partkey % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM x WHERE x.p_brand = p.p_brand AND (starts_with(product, q) OR starts_with(q, product)))",
    "assert_single_resolution": "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "pair_similarity": f"WITH {_HALVES} SELECT label, i, j, round(sim, 6) AS sim FROM p WHERE sim >= 0.1",
    "critical_items": f"WITH {_HALVES} SELECT label, i, round(max(sim), 6) AS sim FROM p GROUP BY label, i HAVING max(sim) >= 0.25",
    "threshold_sweep": f"WITH {_HALVES} SELECT t AS threshold, count(*) FILTER (WHERE sim >= t) AS pairs FROM p, (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS t) GROUP BY t",
    "greedy_match_tp": f"""WITH RECURSIVE {_HALVES}, t AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS threshold), o AS (SELECT label, threshold, i, j, row_number() OVER (PARTITION BY label, threshold ORDER BY sim DESC, i DESC, j DESC) AS rn FROM p, t WHERE sim >= threshold),
g AS (SELECT label, threshold, 1 AS rn, [i] AS us, [j] AS vs FROM o WHERE rn = 1 UNION ALL SELECT g.label, g.threshold, o.rn, CASE WHEN list_contains(us, i) OR list_contains(vs, j) THEN us ELSE list_append(us, i) END, CASE WHEN list_contains(us, i) OR list_contains(vs, j) THEN vs ELSE list_append(vs, j) END FROM g JOIN o ON o.label = g.label AND o.threshold = g.threshold AND o.rn = g.rn + 1)
SELECT label, threshold, max(len(us)) AS tp FROM g GROUP BY label, threshold""",
    "jaccard_mean": f"WITH b AS (SELECT item_id, CASE WHEN {_empty_sql('text')} THEN [] ELSE {_TOK.format('text')} END AS b FROM benchmark), d AS (SELECT lang, doc_id % (SELECT count(*) FROM benchmark) AS item_id, CASE WHEN {_empty_sql('text')} THEN [] ELSE {_TOK.format('text')} END AS d FROM documents), j AS (SELECT lang, len(list_intersect(d, b)) / nullif(len(list_distinct(list_concat(d, b))), 0) AS j FROM d JOIN b USING (item_id)) SELECT lang, count(j) AS n, round(avg(j), 6) AS jaccard FROM j GROUP BY lang",
    "critical_recall": f"WITH {_HALVES}, c AS (SELECT label, i, max(sim) AS sim FROM p GROUP BY label, i HAVING max(sim) >= 0.25) SELECT label, count(*) AS n, count(*) FILTER (WHERE sim >= 0.3) AS hits, round(count(*) FILTER (WHERE sim >= 0.3) / count(*), 6) AS critical_recall FROM c GROUP BY label",
    "link_agreement": f"""WITH l AS (SELECT p_partkey AS din, lower(p_name) || ' ' || p_size || 'mg' || CASE WHEN p_partkey % 6 = 0 THEN '-2' ELSE '' END AS id, p_name AS brand, p_brand || ' Pharma Inc.' AS company,
 CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE upper(p_name) END ELSE '' END AS fb, CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Other Limited' ELSE p_brand || ' LTD' END ELSE '' END AS fc,
 CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_size || '.0' ELSE (p_size + p_partkey % 2)::VARCHAR END AS fs FROM part),
w AS (SELECT din, {_name_words('id')} AS wi, {_name_words('brand')} AS wb, {_name_words('company')} AS wc, {_name_words('fb')} AS wfb, {_name_words('fc')} AS wfc,
 list_transform(regexp_extract_all(regexp_replace(id, '[-_ ]2$', ''), '\\d+(?:\\.\\d+)?'), lambda x: {_plain('x')}) AS s, {_plain('fs')} AS fs FROM l),
k AS (SELECT din, list_has_any(wc, wfc) AS company_ok, list_has_any(wb, wfb) OR list_has_any(wi, wfb) AS brand_ok, len(s) = 0 OR coalesce(list_contains(s, fs), false) AS strength_ok FROM w)
SELECT *, company_ok AND brand_ok AND strength_ok AS all_ok FROM k""",
    "targeted_removal": "SELECT s_suppkey, s_name FROM supplier",
    "reshape_columns": "SELECT n_nationkey, 'N' || n_nationkey AS \"key\", n_name AS name FROM nation",
    "distinct_counts": "SELECT count(DISTINCT lang) AS languages, count(DISTINCT (lang, source)) AS sites FROM documents",
    "dedup_keep_last": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
    "interval_merge": "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 36000 AS e FROM events), r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r) SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, island",
    "stratified_draw": f"""WITH p AS (SELECT p_brand, p_partkey, lower(p_name) AS product, {_DRAW} AS r FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY r, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS members FROM p), o AS (SELECT * FROM f WHERE rn = 1), l AS (SELECT p_brand AS b, product AS q FROM o ORDER BY members DESC, p_brand LIMIT 1),
x AS (SELECT p_brand, p_partkey, product FROM p, l WHERE p_brand = b AND NOT (starts_with(product, q) OR starts_with(q, product)) ORDER BY r, p_partkey LIMIT 1), u AS (SELECT p_brand, p_partkey, product, 0 AS extra FROM o UNION ALL SELECT *, 1 FROM x)
SELECT p_brand, p_partkey, product, row_number() OVER (ORDER BY extra, p_brand) AS n FROM u""",
    "eligibility_counts": "SELECT CASE WHEN p_partkey % 13 = 0 THEN 'development' WHEN p_brand LIKE '%1' THEN 'same product' WHEN p_size < 5 THEN 'unreadable' ELSE 'eligible' END AS reason, count(*) AS n FROM part GROUP BY 1",
    "paired_diff_counts": f"WITH {_PAIR} SELECT year(l_shipdate) AS year, count(*) AS n, count(*) FILTER (WHERE b > a) AS improved, count(*) FILTER (WHERE b < a) AS worse, round(avg(b - a), 6) AS mean_diff FROM j GROUP BY 1",
    "signed_rank_w": _signed_rank_sql("SELECT l_suppkey % 10 AS g, b - a AS d FROM j", "g"),
    "signed_rank_exact": _signed_rank_sql("SELECT a.l_suppkey, year(a.l_shipdate) AS year, round((b.l_extendedprice - a.l_extendedprice) * 100)::BIGINT AS d FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2", "l_suppkey, year"),
    "bootstrap_ci": _boot("(quality = 1 AND toxic = 0)::INT AS tp, (toxic = 1)::INT AS fp", "tp, fp", "sum(tp) AS tp, sum(fp) AS fp", "tp / nullif(tp + fp, 0)"),
    "bootstrap_paired_diff": _boot("(quality = 1 AND toxic = 0)::INT AS tp, (doc_id % 3 = 0)::INT AS other", "tp, other", "sum(tp) AS tp, sum(other) AS other, count(*) AS one", "(other - tp) / greatest(one, 1)"),
    "union_append_average": "WITH g AS (SELECT (doc_id % 7)::VARCHAR AS id, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels GROUP BY 1) SELECT * FROM g UNION ALL SELECT 'AVERAGE', round(avg(quality), 6), round(avg(toxic), 6) FROM g",
    "field_success": f"WITH r AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'SECTION_NOT_FOUND' WHEN doc_id % 7 = 0 THEN 'ERROR: x' WHEN doc_id % 11 <> 0 THEN source END AS i, CASE WHEN doc_id % 6 = 0 THEN 'EXTRACTION_FAILED' ELSE lang END AS c FROM documents) SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(i, '') NOT IN ({_in(C.MISSING)})) AS indications, count(*) FILTER (WHERE coalesce(c, '') NOT IN ({_in(C.MISSING)})) AS contraindications, 'published' AS mode FROM r UNION ALL SELECT count(*), count(*) FILTER (WHERE NOT {_empty_sql('i')}), count(*) FILTER (WHERE NOT {_empty_sql('c')}), 'strict' FROM r",
    "id_set_operations": "WITH d AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) SELECT 'both' AS part, count(*) AS n, sum(doc_id)::BIGINT AS total FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM d) UNION ALL SELECT 'only_labels', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM d) UNION ALL SELECT 'either', count(*), sum(doc_id)::BIGINT FROM (SELECT doc_id FROM labels UNION SELECT doc_id FROM d)",
}
