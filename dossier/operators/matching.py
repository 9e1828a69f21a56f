"""Entity matching and one-to-one similarity matching."""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import name_words, plain_strength, strengths
from ..sources.shared import numbered, running, written
from . import similarity as V

#: Rows that a task holds while it looks for the best ones.
HELD = 1 << 17
#: Pairs that a greedy pass may leave to be settled block by block.
LEFT_OVER = 1_000_000


def prioritised(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[tuple[str, str]]) -> DataFrame:
    """(left_id, right_id, priority): for each left row the right row that the first key of the list finds, the first in order where several do.

    Each key is its own equi-join on reduced rows, so any of them may be shuffled, broadcast or split by skew on its own.
    """
    found = None
    for n, (a, b) in enumerate(keys):
        few = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias("__key")).agg(F.min(right_id).alias(right_id))
        part = left.where(F.col(a).isNotNull()).select(F.col(left_id), F.col(a).alias("__key")).join(few, "__key").select(left_id, right_id, F.lit(n).alias("priority"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(left_id).agg(F.min(F.struct("priority", right_id)).alias("m"))
    return best.select(left_id, f"m.{right_id}", "m.priority")


def unmatched(left: DataFrame, matches: DataFrame, left_id: str) -> DataFrame:
    return left.join(matches, left_id, "left_anti")


def _passed(pairs: pd.DataFrame, left_item: str, right_item: str) -> pd.DataFrame:
    """The greedy pass itself over the pairs of one block."""
    ordered, lefts, rights, keep = pairs.sort_values(["sim", left_item, right_item], ascending=False), set(), set(), []
    for n, (i, j) in enumerate(zip(ordered[left_item], ordered[right_item])):
        if i not in lefts and j not in rights:
            lefts.add(i)
            rights.add(j)
            keep.append(n)
    return ordered.iloc[keep]


def _best_so_far(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows without some that are not the last of their keys in the order. A task holds at most HELD rows and a batch, whatever it reads.

    An aggregate of structs sorts all rows of a task; what is left here is at most a few rows for each key and task.
    """

    def last(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        frame = pa.Table.from_batches(held).to_pandas(integer_object_nulls=True).sort_values(order).drop_duplicates(keys, keep="last")
        return pa.RecordBatch.from_pandas(frame, schema=held[0].schema, preserve_index=False)

    def work(batches):
        held, n = [], 0
        for batch in batches:
            held.append(last([batch]))
            n += held[-1].num_rows
            if n > HELD:
                held = [last(held)]
                n = held[0].num_rows
                if n > HELD // 2:
                    yield held[0]
                    held, n = [], 0
        if held:
            yield last(held)

    return rows.mapInArrow(work, rows.schema)


def greedy_pairs(pairs: DataFrame, blocks: list[str], left_item: str, right_item: str) -> DataFrame:
    """The pairs of each block that a pass in descending (sim, left, right) takes, each item at most once.

    A pair that is the best one of both its items is taken by that pass whatever comes before it, as nothing before it touches them. So each
    round takes all such pairs at once and drops what they touch. The order is total, hence the result is the pass's own. On pairs in random order
    few rounds are needed (their number grows with the logarithm of the pairs), as each one settles a share of what is left. Pairs that wait for
    each other in a long chain are settled a link a round; so as soon as no more than LEFT_OVER pairs are left over all blocks, the pass is run over
    these, a block a task. Rounds are written in the shared folder.
    """
    left = written(pairs.select(*blocks, "sim", left_item, right_item), "pairs")
    taken = None
    while left.limit(LEFT_OVER + 1).count() > LEFT_OVER:
        rank = F.struct("sim", left_item, right_item)
        best = lambda item: _best_so_far(left, [*blocks, item], ["sim", left_item, right_item]).groupBy(*blocks, item).agg(F.max(rank).alias("best"))  # noqa: B023, E731
        of_left, of_right = best(left_item), best(right_item)
        both = of_left.select(*blocks, "best").intersect(of_right.select(*blocks, "best"))
        round_ = written(both.select(*blocks, "best.*"), "taken")
        taken = round_ if taken is None else taken.unionByName(round_)
        rest = left.join(round_.select(*blocks, left_item), [*blocks, left_item], "left_anti").join(round_.select(*blocks, right_item), [*blocks, right_item], "left_anti")
        left = written(rest.select(left.columns), "pairs")
    last = left.groupBy(*blocks).applyInPandas(lambda p: _passed(p, left_item, right_item), left.schema)
    return last if taken is None else taken.unionByName(last)


def greedy_one_to_one(pairs: DataFrame, blocks: list[str], left_item: str, right_item: str) -> DataFrame:
    """(blocks, tp): how many pairs the greedy pass takes; blocks without pairs have no row."""
    return greedy_pairs(pairs, blocks, left_item, right_item).groupBy(*blocks).agg(F.count("*").cast("int").alias("tp"))


def _tied(run: list[tuple], left: dict, right: dict, left_ids: dict, right_ids: dict) -> list[int]:
    """How many pairs each pair of kinds in the run gets, where all pairs of these kinds' items have one similarity: they are taken in descending
    (left, right). left and right say how many items of a kind are free; these are its least ones, and the ids are in descending order."""
    free = lambda kinds, ids, k: ids[k][len(ids[k]) - kinds[k] :] if k in ids else [k]
    lefts, rights = {k: free(left, left_ids, k) for k, _ in run}, {k: free(right, right_ids, k) for _, k in run}
    place = {i: -n for n, i in enumerate(sorted({i for ids in lefts.values() for i in ids}))}
    partners, counts, gone = {}, [0] * len(run), dict.fromkeys(rights, 0)
    for n, (a, b) in enumerate(run):
        partners.setdefault(a, []).append((b, n))
    waiting = [(place[ids[0]], a, 0) for a, ids in lefts.items()]
    heapq.heapify(waiting)
    while waiting:
        _, a, n = heapq.heappop(waiting)
        open_ = [(rights[b][gone[b]], b, at) for b, at in partners[a] if gone[b] < len(rights[b])]
        if open_:
            _, b, at = max(open_)
            counts[at] += 1
            gone[b] += 1
            if n + 1 < len(lefts[a]):
                heapq.heappush(waiting, (place[lefts[a][n + 1]], a, n + 1))
    return counts


def _taken_kinds(pairs: pd.DataFrame, ids: pd.DataFrame) -> pd.DataFrame:
    """The greedy pass over the pairs of kinds of one block: how many pairs of their items it takes, as n."""
    pairs = pairs.sort_values("sim", ascending=False)
    left, right = dict(zip(pairs["left"], pairs["n_left"])), dict(zip(pairs["right"], pairs["n_right"]))
    of = [{k: sorted(g, reverse=True) for k, g in ids[ids["side"] == side].groupby("kind")["item"]} for side in (0, 1)]
    sims, kinds, taken = pairs["sim"].tolist(), list(zip(pairs["left"], pairs["right"])), []
    begin = 0
    while begin < len(sims):
        end = begin + 1
        while end < len(sims) and sims[end] == sims[begin]:
            end += 1
        run = [(a, b) for a, b in kinds[begin:end] if left[a] and right[b]]
        if len({a for a, _ in run}) == len(run) == len({b for _, b in run}):
            counts = [min(left[a], right[b]) for a, b in run]
        else:
            counts = _tied(run, left, right, *of)
        for (a, b), n in zip(run, counts):
            if n:
                left[a] -= n
                right[b] -= n
                taken.append((sims[begin], a, b, n))
        begin = end
    out = pd.DataFrame(taken, columns=["sim", "left", "right", "n"])
    out.insert(0, "block", pairs["block"].iloc[:1].repeat(len(out)).to_numpy())
    return out


def _kinds(rows: DataFrame, block: str, item: str, vec: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(block, kind, vec, free), a row for each different vector of a block, named by its greatest item, and (block, item, kind), the items."""
    rows = rows.select(F.col(block).alias("block"), F.col(item).alias("item"), F.col(vec).cast("array<double>").alias("vec")).where("block is not null and item is not null and vec is not null")
    kinds = written(rows.distinct().groupBy("block", "vec").agg(F.max("item").alias("kind"), F.count("*").alias("free")), name)
    # Only kinds of several items need a list of them: one item is its own kind.
    several = rows.join(kinds.where("free > 1"), ["block", "vec"]).select("block", "item", "kind").distinct()
    return kinds, written(several.unionByName(kinds.where("free = 1").select("block", F.col("kind").alias("item"), "kind")), name + "_items")


def greedy_counts(left: DataFrame, right: DataFrame, block: str, left_item: str, right_item: str, left_vec: str, right_vec: str, threshold: float) -> DataFrame:
    """(block, sim, n): how many pairs a pass in descending (sim, left, right) takes at each similarity from the threshold on, each item at most once.

    A pass at a higher threshold takes the first of these, so one pass serves all. Its pairs are not listed: each round takes the most similar pairs
    of each block that are left, down to a cut which about LEFT_OVER pairs of all blocks reach, and runs the pass over these, a block a task. The items it
    takes are in no later round, so of the pairs below the cut only the few between free items remain. Similarities are computed anew in each
    round, by tiles. Equal vectors of a block are one kind: its pairs with another kind are one row, and its items go in descending order.

    Where more pairs than LEFT_OVER are about equally similar, they are listed, item by item, for greedy_pairs. Blocks where an item has several vectors go there whole.
    """
    (kinds, items), (r_kinds, r_items) = _kinds(left, block, left_item, left_vec, "left"), _kinds(right, block, right_item, right_vec, "right")
    doubled = [i.groupBy("block", "item").count().where("count > 1").select("block") for i in (items, r_items)]
    unclear = written(doubled[0].unionByName(doubled[1]).distinct(), "unclear")
    taken = []
    if not unclear.isEmpty():
        a, b = (df.withColumnRenamed(block, "block").join(unclear, "block", "left_semi") for df in (left, right))
        pairs = V.similar_pairs(a, b, "block", left_item, right_item, left_vec, right_vec, threshold)
        taken.append(greedy_pairs(pairs, ["block"], left_item, right_item).select("block", "sim", F.lit(1).cast("long").alias("n")))
        kinds, r_kinds = kinds.join(unclear, "block", "left_anti"), r_kinds.join(unclear, "block", "left_anti")
    while True:
        sizes = kinds.groupBy("block").agg(F.count("*").alias("x")).join(r_kinds.groupBy("block").agg(F.count("*").alias("y")), "block")
        all_ = sizes.agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("pairs"), F.sum(F.col("x") + F.col("y")).alias("kinds")).first()
        if not all_.pairs:
            break
        a, b = V.tiles(kinds, "block", "kind", "vec", V.WIDE), V.tiles(r_kinds, "block", "kind", "vec", V.WIDE)
        if all_.pairs <= LEFT_OVER:
            cuts = sizes.select("block", F.lit(float(threshold)).alias("cut"))
        else:
            most = sizes.select("block", F.greatest(F.lit(1), F.floor(F.lit(LEFT_OVER) * (F.col("x") + F.col("y")) / F.lit(all_.kinds))).cast("long").alias("most"))
            cuts = written(V.cuts(a.join(most, "block"), b, threshold), "cuts")
        listed = V.pairs_above(a.join(cuts, "block"), b, "block", "left", "right")
        free = lambda df, side: df.select("block", F.col("kind").alias(side), F.col("free").alias(f"n_{side}"))
        listed = written(listed.join(free(kinds, "left"), ["block", "left"]).join(free(r_kinds, "right"), ["block", "right"]), "pairs")
        run = _matched(listed, kinds, r_kinds, items, r_items)
        taken.append(run.select("block", "sim", "n"))
        if all_.pairs <= LEFT_OVER:
            break
        below = cuts.where(F.col("cut") > threshold).select("block")
        kinds, r_kinds = (_still_free(df, run, side, below) for df, side in ((kinds, "left"), (r_kinds, "right")))
    out = taken[0] if taken else kinds.select("block", F.lit(0.0).alias("sim"), F.lit(0).cast("long").alias("n")).limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.groupBy("block", "sim").agg(F.sum("n").alias("n")).withColumnRenamed("block", block)


def _still_free(kinds: DataFrame, run: DataFrame, side: str, blocks: DataFrame) -> DataFrame:
    gone = run.groupBy("block", F.col(side).alias("kind")).agg(F.sum("n").alias("gone"))
    left = kinds.join(blocks, "block", "left_semi").join(gone, ["block", "kind"], "left")
    return written(left.withColumn("free", F.col("free") - F.coalesce("gone", F.lit(0))).drop("gone").where("free > 0"), side)


def _matched(listed: DataFrame, kinds: DataFrame, r_kinds: DataFrame, items: DataFrame, r_items: DataFrame) -> DataFrame:
    """(block, sim, left, right, n): how many pairs of their items the pass takes of each listed pair of kinds."""
    types = {f.name: f.dataType.simpleString() for f in listed.schema.fields}
    if listed.count() <= LEFT_OVER:
        # Among kinds that share a similarity, which item goes first decides.
        shared = listed.join(listed.groupBy("block", "sim").count().where("count > 1"), ["block", "sim"], "left_semi")
        wanted = lambda ids, side, n: ids.join(shared.select("block", F.col(side).alias("kind")).distinct(), ["block", "kind"]).select("block", F.lit(n).alias("side"), "kind", "item")
        ids = wanted(items, "left", 0).unionByName(wanted(r_items, "right", 1))
        schema = f"block {types['block']}, sim double, left {types['left']}, right {types['right']}, n long"
        return written(listed.groupBy("block").cogroup(ids.groupBy("block")).applyInPandas(_taken_kinds, schema), "taken")
    order = W.partitionBy("block", "kind").orderBy("item")
    free = lambda ids, df, side: ids.withColumn("__n", F.row_number().over(order)).join(df.select("block", "kind", "free"), ["block", "kind"]).where("__n <= free").select("block", F.col("kind").alias(side), F.col("item").alias(f"{side}_item"))
    lefts, rights = free(items, kinds, "left"), free(r_items, r_kinds, "right")
    pairs = listed.join(lefts, ["block", "left"]).join(rights, ["block", "right"])
    found = greedy_pairs(pairs, ["block"], "left_item", "right_item")
    back = found.join(lefts, ["block", "left_item"]).join(rights, ["block", "right_item"])
    return written(back.groupBy("block", "sim", "left", "right").agg(F.count("*").alias("n")), "taken")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by aggregation rather than a sort of the whole key."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*")


def prefix_anti(candidates: DataFrame, excluded: DataFrame, generic: str, product: str) -> DataFrame:
    """Candidates without any excluded row of the same generic of which either product is a prefix of the other.

    Prefixes are looked up: a product is cut at each length that the other side's products of its generic have, and all joins are by equal
    keys. A generic may have all rows; its lengths are as many as a product has characters. Rows with nulls stay.
    """
    names = lambda df: df.select(F.col(generic).alias("__g"), F.col(product).alias("__p")).where("__g is not null and __p is not null").distinct()
    ours, theirs = names(candidates), names(excluded)

    def cuts(rows: DataFrame, others: DataFrame) -> DataFrame:
        lengths = others.groupBy("__g").agg(F.collect_set(F.length("__p")).alias("__lengths"))
        fitting = F.explode(F.filter("__lengths", lambda n: n <= F.length("__p")))
        return rows.join(lengths, "__g").select("__g", "__p", fitting.alias("__n")).withColumn("__cut", F.substring("__p", F.lit(1), F.col("__n")))

    longer = cuts(ours, theirs).join(theirs.withColumnRenamed("__p", "__cut"), ["__g", "__cut"], "left_semi").select("__g", "__p")
    shorter = ours.join(cuts(theirs, ours).select("__g", F.col("__cut").alias("__p")), ["__g", "__p"], "left_semi")
    hit = longer.unionByName(shorter).distinct()
    return candidates.join(hit, (F.col(generic) == F.col("__g")) & (F.col(product) == F.col("__p")), "left_anti")


def resolve_single(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right on a key that must find exactly one row each; anything else is an error."""
    counted = right.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*[c for c in right.columns if c != key])).alias("__r"))
    joined = left.join(counted, key, "left")
    checked = joined.withColumn("__ok", F.when(F.coalesce(F.col("__n"), F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{key} does not resolve to one row: "), F.col(key).cast("string"))).cast("boolean")))
    return checked.where("__ok").select(*left.columns, "__r.*")


def publish(df: DataFrame, lookup: DataFrame, key: str, column: str, verdict: str) -> DataFrame:
    """df with the looked-up column where the verdict holds, null otherwise."""
    found = lookup.select(key, column, verdict)
    return df.join(found, key, "left").withColumn(column, F.when(F.coalesce(F.col(verdict), F.lit(False)), F.col(column))).drop(verdict)


def link_verdict(url: Column, failed: Column, same_file: Column, similarity: Column, least: float = 0.6) -> Column:
    return F.when(url.isNull(), "no link").when(failed, "download failed").when(same_file, "same file").when(similarity >= least, "same monograph").otherwise("different")


def verified(verdict: Column, similarity: Column, names: Column, least: float = 0.8) -> Column:
    sure = (verdict == "same file") | ((verdict == "same monograph") & (F.coalesce(similarity, F.lit(0.0)) >= least))
    return sure | ((verdict != "no link") & F.coalesce(names, F.lit(False)))


def agreement(df: DataFrame, record_id: str, brand: str, company: str, found_brand: str, found_company: str, found_strengths: str) -> DataFrame:
    """df with company_ok, brand_ok, strength_ok and all_ok: whether a record and the product that its link found share words and strengths.

    The brand may agree with the record's or with its id. Strengths are those that the id names; an id that names none agrees with any, and
    a trailing 2 marks a second copy. found_strengths is an array of strings. Null names have no words.
    """
    words = lambda c: name_words(F.coalesce(F.col(c), F.lit("")))
    named = strengths(F.regexp_replace(F.col(record_id), "[-_ ]2$", ""))
    known = F.coalesce(F.transform(found_strengths, plain_strength), F.array().cast("array<string>"))
    company_ok = F.arrays_overlap(words(company), words(found_company))
    brand_ok = F.arrays_overlap(words(brand), words(found_brand)) | F.arrays_overlap(words(record_id), words(found_brand))
    strength_ok = (F.size(named) == 0) | F.arrays_overlap(named, known)
    return df.withColumns({"company_ok": company_ok, "brand_ok": brand_ok, "strength_ok": strength_ok, "all_ok": company_ok & brand_ok & strength_ok})


def with_product(links: DataFrame, products: DataFrame, ingredients: DataFrame, number: str, code: str) -> DataFrame:
    """links with the looked-up product of their identification number, if any, and the distinct strengths of its ingredients as found_strengths."""
    amounts = ingredients.groupBy(code).agg(F.collect_set(F.coalesce("strength", F.lit(""))).alias("found_strengths"))
    return links.join(products, number, "left").join(amounts, code, "left")


def remove_duplicates(df: DataFrame, key: str, expected: list, unwanted: Column) -> DataFrame:
    """df without the unwanted rows of keys that occur more than once. That these are exactly the expected keys is checked as the rows are read:
    any other set of them is an error, because what to drop was decided for these."""
    twice = df.groupBy(key).agg(F.count("*").alias("__n"))
    seen = twice.where("__n > 1").agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("__seen"))
    wanted = F.array_sort(F.array(*[F.lit(str(e)) for e in expected]).cast("array<string>"))
    message = F.concat(F.lit("keys that occur more than once: "), F.array_join("__seen", ", "))
    checked = seen.select(F.when(F.col("__seen") == wanted, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")).alias("__right"))
    dropped = F.col(key).cast("string").isin([str(e) for e in expected]) & F.coalesce(unwanted, F.lit(False))
    return df.crossJoin(F.broadcast(checked)).where(F.col("__right") & ~dropped).drop("__right")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Islands of overlapping or touching intervals. The farthest end so far and the islands' numbers are carried from range to range, so one key may have all rows."""
    reached = running(df.select(*keys, start, end), keys, [start, end], end, "__reach", F.max, before=True)
    goes_on = F.coalesce(F.col(start) <= F.col("__reach"), F.lit(False)).cast("int")
    # Among equal intervals the one that begins an island comes first.
    marked = reached.withColumn("__on", goes_on).withColumn("__new", 1 - F.col("__on"))
    islands = running(marked, keys, [start, end, "__on"], "__new", "__island", F.sum)
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def portable_rank(key: Column, seed: int) -> Column:
    """Seeded order of integer keys that any engine can repeat."""
    return ((key * 48271 + F.lit(seed % 2147483647)) % 2147483647 * 16807) % 2147483647


def stratified_draw(df: DataFrame, stratum: str, key: str, product: str, seed: int) -> DataFrame:
    """One row of each stratum by seeded order, and one more of the largest stratum (the first by name among equals) that is not the same product; numbered by stratum."""
    order = F.struct(portable_rank(F.col(key), seed).alias("r"), F.col(key).alias("k"), F.col(product).alias("p"))
    first = df.groupBy(stratum).agg(F.min(order).alias("m"), F.count("*").alias("members")).select(stratum, "members", F.col("m.k").alias(key), F.col("m.p").alias(product))
    largest = first.agg(F.min(F.struct((-F.col("members")).alias("m"), F.col(stratum).alias("s"), F.col(product).alias("p"))).alias("l")).select("l.s", "l.p")
    others = df.join(F.broadcast(largest), F.col(stratum) == F.col("s")).where(~(F.col(product).startswith(F.col("p")) | F.col("p").startswith(F.col(product))))
    extra = others.groupBy(stratum).agg(F.min(order).alias("m")).select(stratum, F.col("m.k").alias(key), F.col("m.p").alias(product))
    picks = first.select(stratum, key, product, F.lit(0).alias("extra")).unionByName(extra.withColumn("extra", F.lit(1)))
    return numbered(picks, ["extra", stratum], "n").drop("extra")
