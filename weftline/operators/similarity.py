"""Exact word-shingle similarity: nearest reference texts, near-duplicate classes, clusters and holdouts that respect them.

Nothing is estimated. A pair of similar sets shares one of its rarest shingles, so joining only these (prefix filter) with a
filter on sizes finds every pair; the pairs found are then measured on the whole sets (``shingled``). Exact copies join through
one representative each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import masked_words, shingles, word_list
from weftline.operators import shingled as H
from weftline.operators.components import contract
from weftline.operators.scale import BROADCAST_ROWS, global_running_sum, salted_join, sized_join
from weftline.session import cut

#: Words of a shingle and least Jaccard similarity of near-duplicates.
WORDS, SIMILAR = 5, 0.8
#: A similarity below that of any two texts that share a shingle.
LOWEST = 1e-9


def shingle_set(text: Column, n: int = WORDS) -> Column:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    return F.array_sort(F.array_distinct(F.transform(shingles(word_list(text), n), lambda s: F.xxhash64(s))))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Exact Jaccard similarity of two sets; ``empty`` where both have no element."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def nearest(texts: DataFrame, references: DataFrame, key: str, ref_key: str, text: str = "text", ref_text: str = "text", least: float = 0.0, masked: bool = False, n: int = WORDS) -> DataFrame:
    """(key, ref_key, shared, jaccard, contained): for each text the reference of greatest Jaccard similarity above 0.

    Ties go to the smallest ref_key. contained is the share of the reference's shingles; ``masked`` takes identifiers as equal.
    The references' shingles form an index with one row for each, which is broadcast if it is small by measure; a text's shingles
    then meet it where the text is read and only counts are shuffled. A larger index is joined in salted parts. Null and short texts
    have no shingles and no row.
    """
    words = (lambda c: masked_words(F.col(c))) if masked else (lambda c: word_list(F.col(c)))
    hashed = lambda c: F.array_distinct(F.transform(shingles(words(c), n), lambda s: F.xxhash64(s)))
    right = references.select(F.col(ref_key).alias("_r"), hashed(ref_text).alias("_s")).withColumn("_n2", F.size("_s"))
    index = cut(right.select("_r", "_n2", F.explode("_s").alias("_g")).groupBy("_g").agg(F.collect_list(F.struct("_r", "_n2")).alias("_refs")))
    postings = index.agg(F.coalesce(F.sum(F.size("_refs")), F.lit(0))).first()[0]
    left = texts.select(key, hashed(text).alias("_s")).select(key, F.size("_s").alias("_n1"), F.explode("_s").alias("_g"))
    met = sized_join(left, index, ["_g"], "inner", F.xxhash64(key), postings <= BROADCAST_ROWS).select(key, "_n1", F.explode("_refs").alias("_x"))
    shared = met.groupBy(key, F.col("_x._r").alias(ref_key), "_n1", F.col("_x._n2").alias("_n2")).agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("jaccard", F.col("shared") / (F.col("_n1") + F.col("_n2") - F.col("shared"))).withColumn("contained", F.col("shared") / F.col("_n2")).where(F.col("jaccard") >= least)
    best = scored.groupBy(key).agg(F.min_by(F.struct(ref_key, "shared", "jaccard", "contained"), F.struct(-F.col("jaccard"), F.col(ref_key))).alias("b"))
    return best.select(key, "b.*")


def gate(texts: DataFrame, references: DataFrame, key: str, ref_key: str, text: str, ref_text: str, limit: float, masked: bool = False) -> DataFrame:
    """(checked, with_neighbour, closest, over, passed): how similar any text is to any reference, and whether all stay below ``limit``.

    All pairs from a little below the limit on are found and measured. If there is none, the search goes on further down, at the
    closest of the pairs measured on the way, until the closest of all is known; pairs further apart than that are never listed.
    """
    docs = texts.select(F.concat(F.lit("t"), F.coalesce(F.col(key).cast("string"), F.lit("\0"))).alias("id"), H.plain(F.col(text)).alias("t"))
    refs = references.select(F.concat(F.lit("r"), F.coalesce(F.col(ref_key).cast("string"), F.lit("\0"))).alias("id"), H.plain(F.col(ref_text)).alias("t"))
    hot = H.frequent_of(refs, WORDS, masked)
    checked, near = texts.count(), H.with_shared(docs, refs, hot, WORDS, masked)
    closest, over, least = 0.0, None, max(LOWEST, 0.9 * min(limit, 1.0))
    while near:
        own = H.prefixes(docs, hot, least, WORDS, masked)
        firsts = own.unionByName(H.prefixes(refs, hot, least, WORDS, masked, 1, H.bit_map(own.select("g"))))
        found = cut(H.measured(docs.unionByName(refs), cut(H.candidates(firsts, least, True)), WORDS, masked))
        closest = found.agg(F.coalesce(F.max("jaccard"), F.lit(0.0))).first()[0]
        over = found.where(F.col("jaccard") >= limit).select("a").distinct().count() if over is None else over
        if closest >= least or least == LOWEST:
            break
        least = max(LOWEST, closest, least / 2)
    over = over or 0
    return texts.sparkSession.createDataFrame([(checked, near, float(closest), over, over == 0)], "checked bigint, with_neighbour bigint, closest double, over bigint, passed boolean")


def near_duplicate_classes(texts: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """(key, class_id, links): every text with its class of near-duplicates and the number of texts it is linked to.

    Texts with equal shingle sets (or, below WORDS words, equal words) form a group whose smallest key stands for it in
    the join; links counts the members of all groups that are similar to the text's own, itself left out. class_id is the
    smallest key of the class. Null texts count as empty; null keys are left out.
    """
    docs = texts.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), H.plain(F.col(text)).alias("t"))
    sets, hot = H.digests(docs, WORDS)
    groups = cut(sets.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    copies = cut(sets.join(groups.where("copies > 1").select("same", "rep"), "same").where("id <> rep").select("id").distinct())
    single = sized_join(docs, copies, ["id"], "left_anti")
    met = cut(H.candidates(H.prefixes(single, hot, least, WORDS, False), least, False))
    pairs = cut(H.measured(single, met, WORDS, False).where(F.col("jaccard") >= least - 1e-9).select("a", "b"))
    text_key = lambda c: F.col(c).cast("string")
    forest = contract(pairs.select(text_key("a").alias("u"), text_key("b").alias("v")))
    size = groups.select("rep", "copies")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(size.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("more"))
    rooted = groups.select("same", "rep", "copies").withColumn("vertex", text_key("rep")).join(forest, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    least_key = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    told = rooted.join(least_key, "root").join(linked, "rep", "left").select("same", "class_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return salted_join(sets, told, ["same"], "inner", F.xxhash64("id")).select(F.col("id").alias(key), "class_id", "links")


def take_fitting(items: DataFrame, budget: DataFrame, part: str, key: str, size: str, order: Column) -> DataFrame:
    """(key, part, size) of the items that one takes going through ``order`` in each part, skipping those that no longer fit.

    ``budget`` has part and left. Each round takes the items before the first that overshoots, all parts at once, and drops those
    that are larger than what is left; what remains comes behind that item, so a next round goes on there.
    """
    open_ = items.select(key, part, size, order.alias("_o")).join(budget.select(part, F.col("left").alias("_left")), part)
    taken: DataFrame | None = None
    while True:
        open_ = cut(open_.where(F.col(size) <= F.col("_left")))
        if open_.isEmpty():
            return open_.select(key, part, size) if taken is None else taken
        run = cut(global_running_sum(open_, [F.col("_o"), F.col(key)], size, "_sum", [part]))
        got = run.where(F.col("_sum") <= F.col("_left")).select(key, part, size)
        taken = got if taken is None else taken.unionByName(got)
        used = got.groupBy(part).agg(F.sum(size).alias("_used"))
        open_ = run.where(F.col("_sum") > F.col("_left")).drop("_sum").join(used, part, "left").withColumn("_left", F.col("_left") - F.coalesce("_used", F.lit(0))).drop("_used")


def holdout(classes: DataFrame, strata: DataFrame, key: str = "doc_id", stratum: str = "component", per_mille: int = 100, seed: str = "holdout") -> DataFrame:
    """(key, stratum, held): whole classes go to the holdout in hash order while they fit their stratum's quota.

    A class belongs to the stratum of its smallest member. The holdout has that share of all rows, rounded half up; quotas are
    proportional, their rounding made up by largest remainder. A class that overshoots is skipped, later ones that fit
    are taken; what the strata leave unused is filled with the smallest classes left over, of any stratum.
    """
    rows = cut(classes.join(strata.select(key, F.coalesce(F.col(stratum), F.lit("")).alias(stratum)), key))
    sized = cut(rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(stratum, key).alias(stratum)))
    whole = sized.groupBy(stratum).agg(F.sum("n").alias("_n"))  # one row for each label
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = int(total * per_mille / 1000 + 0.5)
    exact = F.col("_n") * F.lit(wanted) / F.lit(max(1, total))
    spare = F.lit(wanted) - F.sum(F.floor(exact)).over(Window.partitionBy())
    by_rest = F.row_number().over(Window.orderBy((exact - F.floor(exact)).desc(), stratum))
    quotas = whole.select(stratum, (F.floor(exact) + (by_rest <= spare).cast("int")).alias("left"))
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("class_id").cast("string")), 256)
    taken = cut(take_fitting(sized, quotas, stratum, "class_id", "n", order))
    left = wanted - (taken.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rest = sized.join(taken.select("class_id"), "class_id", "left_anti").withColumn("_all", F.lit(1))
    filled = take_fitting(rest, rest.sparkSession.createDataFrame([(1, left)], "_all int, left bigint"), "_all", "class_id", "n", F.col("n"))
    held = taken.select("class_id").unionByName(filled.select("class_id")).withColumn("held", F.lit(True))
    marked = sized.join(held, "class_id", "left").select("class_id", stratum, F.coalesce("held", F.lit(False)).alias("held"))
    return salted_join(rows.select(key, "class_id"), marked, ["class_id"], "inner", F.xxhash64(key)).select(key, stratum, "held")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty texts. Not the matching-blocks ratio."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over both lengths: the longest common block, then on either side of it again.

    1 for two empty texts, null if a side is null. Spark has no expression for blocks; costs grow with the product of lengths, so
    put a filter on lengths before it.
    """
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else SequenceMatcher(None, s, t, autojunk=False).ratio() for s, t in zip(x, y)], dtype="float64")

    return ratio(a, b)
