"""Pain points: what customers of one product group complain of in the same words, and nobody else says.

Phrases of two to four words are counted per product group in two ways, complaints and
other rows, and a phrase stays where its log-odds stand out against all other rows,
the group's rows that are no complaints, and the complaints of other groups.  The
phrases that stay are merged greedily, strongest first, by the overlap of their rows.
What stands out in half of the groups is no matter of one group; it is mined once more
over the whole shop (scope ``shop``).

The greedy pass is a fixpoint of aggregates and not a loop over rows.  A phrase's
decision needs the overlap of its rows with those that each seed has gathered from
stronger phrases.  With every phrase's seed assumed, one aggregation over the
combinations of phrases that rows hold gives all overlaps of all groups; the decisions
that follow are assumed next.  A decision depends on stronger phrases only, so after k
rounds the k strongest of each group are settled, and a round that changes nothing is
the greedy result.  No task holds the rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PAIN
from ..functions import normalize, phrases
from ..functions.stats import log_odds_z
from ..functions.text import fold
from ..sources.files import kept
from .metrics import negative

WHO = ["scope", "group_key"]
_WORD_END = r"[^\p{L}\p{N}]+"
_STOP = phrases.EDGE + phrases.DULL


def _group() -> list[Column]:
    return [F.coalesce("group_key", F.lit("")).alias("group_key"), F.coalesce(negative(), F.lit(False)).alias("negative")]


def facts(items: DataFrame, key: str = "feedback_id") -> DataFrame:
    """What phrases are counted by, for each row of weight: group, complaint or not, customer, day, label.

    A row without a group is in the group ``''``; without a customer and an author it is
    a customer of its own; without a time it has no day and is undated.
    """
    blank = F.coalesce(F.col("category"), F.lit("Other")) == "Other"
    return items.where("weight > 0").select(
        key,
        *_group(),
        F.coalesce(F.col("customer_id").cast("string"), F.col("author"), F.col(key).cast("string")).alias("customer"),
        "product_name", "ts", "weight", "tier",
        F.to_date("ts").alias("day"),
        blank.alias("blank"),
        F.when(~blank, F.col("category")).alias("category"),
        F.when(~blank, F.coalesce("cause", F.lit(""))).alias("cause"),
    )


def phrases_of(items: DataFrame, key: str = "feedback_id", text: str = "text", normalised: bool = True) -> DataFrame:
    """``(key, phrase)`` of the rows of weight, of the normalised text, unaccented phrases under their accented spelling."""
    rows = items.where("weight > 0").select(key, F.col(text).alias("text"))
    if normalised:
        rows = kept(normalize.normalized(rows, "text").select(key, F.col("normalized").alias("text")), "plain-texts")  # read several times, dear to compute
    return phrases.spelled_rows(phrases.phrase_rows(rows, key, "text"), key)


def phrases_said(items: DataFrame, key: str = "feedback_id", text: str = "text", normalised: bool = True, c=PAIN) -> DataFrame:
    """``(key, group_key, negative, first, phrases)`` of the rows of weight: the phrases of the normalised text, as in ``phrases.said``.

    A phrase that stands out is in ``c.customers`` complaints, so classes that fewer hold may be left out.
    """
    rows = items.where("weight > 0").select(key, *_group(), F.col(text).alias("text"))
    if normalised:
        rows = normalize.normalized(rows, "text").drop("text").withColumnRenamed("normalized", "text")
        rows = kept(rows, "plain-texts")  # read several times, dear to compute
    return phrases.said(phrases.each_key_once(rows, key, "text"), "text", F.col("negative"), c.customers)


def phrase_counts(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(phrase, group_key, df, y)``, unaccented phrases under their accented spelling, and the spellings ``(phrase, spelled)``."""
    bad = F.col("negative")
    raw = phrases.counted(said, "group_key", n=F.count_if("first"), df=F.count("*"), y=F.count_if(bad), df_both=F.count_if("both"), y_both=F.count_if(bad & F.col("both")))
    raw = kept(phrases.with_spelled(raw), "phrase-counts")
    # a row with both spellings counts once
    whole = lambda x: F.col(x) - F.when(F.col("phrase") == F.col("spelled"), F.col(f"{x}_both")).otherwise(0)
    put = F.when(F.col("phrase") == F.col("plain"), F.coalesce("spelled", "phrase")).otherwise(F.col("phrase"))
    counts = raw.select(put.alias("phrase"), "group_key", whole("df").alias("df"), whole("y").alias("y")).repartition("phrase")
    known = raw.where("phrase = plain and spelled is not null").select("phrase", "spelled").distinct()
    return counts.groupBy("phrase", "group_key").agg(F.sum("df").alias("df"), F.sum("y").alias("y")), known


def phrase_tests(counts: DataFrame, rows: DataFrame, c=PAIN) -> DataFrame:
    """``(scope, group_key, phrase, y, n1, spread, z, z_same, z_other, lift)`` of the phrases that stand out.

    ``counts`` are those of ``phrase_counts``, ``rows`` those of ``facts``.  y of n1
    complaints hold the phrase, complaints of ``spread`` groups (of those with enough
    complaints) hold it.  A background of fewer than ``c.background`` rows is not tested.
    Phrases of a product's name only are left out.
    """
    groups = kept(rows.groupBy("group_key").agg(F.count("*").alias("n"), F.count_if("negative").alias("n1")), "groups")  # a file, so Spark knows its size
    whole = groups.agg(F.sum("n"), F.sum("n1"), F.count_if(F.col("n1") >= c.negatives)).first()
    n_all, n_neg, big = whole[0] or 0, whole[1] or 0, whole[2]
    common = -(-big * c.spread // 1) if big >= c.groups else float("inf")
    in_big = F.when((F.col("n1") >= c.negatives) & (F.col("y") > 0), 1).otherwise(0)
    over = Window.partitionBy("phrase")
    known = counts.join(groups, "group_key").withColumns({"spread": F.sum(in_big).over(over), "df_all": F.sum("df").over(over), "y_all": F.sum("y").over(over)})
    known = kept(known.where(F.col("y_all") >= c.customers), "phrase-groups")  # in fewer complaints none stands out

    y, n1 = F.col("y"), F.col("n1")

    def against(y0: Column, n0: Column) -> Column:
        return F.when(n0 >= c.background, log_odds_z(y, n1, y0, n0))

    def lift(y0: Column, n0: Column) -> Column:
        return (y / n1) / ((y0 + 0.5) / (n0 + 0.5))

    rest, rest_n = F.col("df_all") - y, F.lit(n_all) - n1
    same, same_n = F.col("df") - y, F.col("n") - n1
    stands_out = (F.col("z") >= c.z) & (F.col("lift") >= c.lift)
    for side in ("z_same", "z_other"):
        stands_out = stands_out & (F.coalesce(side, F.lit(c.side_z)) >= c.side_z)
    columns = [*WHO, "phrase", "y", "n1", "spread", "z", "z_same", "z_other", "lift"]
    each = known.where((n1 >= c.negatives) & (y >= c.customers) & (F.col("spread") < common)).withColumns(
        {"scope": F.lit("group"), "z": against(rest, rest_n), "lift": lift(rest, rest_n), "z_same": against(same, same_n), "z_other": against(F.col("y_all") - y, F.lit(n_neg) - n1)}
    )
    each = _not_names(each.where(stands_out), rows).select(columns)
    shop = known.groupBy("phrase").agg(F.sum("df").alias("df"), F.sum("y").alias("y"), F.max("spread").alias("spread")).withColumns({"n": F.lit(n_all), "n1": F.lit(n_neg)})
    shop = shop.where((n1 >= c.negatives) & (y >= c.customers) & (F.col("spread") >= common)).withColumns(
        {"scope": F.lit("shop"), "group_key": F.lit("shop"), "z": against(same, same_n), "lift": lift(same, same_n), "z_same": F.lit(None).cast("double"), "z_other": F.lit(None).cast("double")}
    )
    return each.union(shop.where(stands_out).select(columns))


def _not_names(tests: DataFrame, rows: DataFrame) -> DataFrame:
    """``tests`` without the phrases whose words are all of the names of the group's products, or stop words."""
    bare = F.regexp_replace(F.lower("product_name"), r"\[[^\]]*\]|\([^)]*\)", " ")
    named = rows.select("group_key", F.explode(F.array_union(F.split(bare, _WORD_END), F.split(F.lower("group_key"), _WORD_END))).alias("w"))
    named = named.select("group_key", fold(F.col("w")).alias("w")).distinct().withColumn("named", F.lit(True))
    words = tests.select("group_key", "phrase", F.explode(F.split(fold(F.col("phrase")), " ")).alias("w")).join(named, ["group_key", "w"], "left")
    own = words.groupBy("group_key", "phrase").agg(F.bool_and(F.coalesce("named", F.lit(False)) | F.col("w").isin(*_STOP)).alias("only")).where("only")
    return tests.join(own, ["group_key", "phrase"], "left_anti")


def holders(tests: DataFrame, said: DataFrame, known: DataFrame, key: str = "feedback_id") -> DataFrame:
    """``(scope, group_key, phrase, key)``: the complaints that hold each phrase of ``tests``, in either spelling."""
    named = tests.select(*WHO, "phrase")
    plain = named.join(known.select(F.col("spelled").alias("phrase"), F.col("phrase").alias("raw")), "phrase").select(*WHO, "phrase", "raw")
    wanted = kept(named.withColumn("raw", F.col("phrase")).union(plain), "phrases-wanted")  # a file, so Spark knows its size
    held = said.where("negative").select(key, "group_key", F.explode("phrases.phrase").alias("raw"))
    own = held.join(wanted.where("scope = 'group'"), ["group_key", "raw"])
    shop = held.drop("group_key").join(wanted.where("scope = 'shop'"), "raw")
    return own.select(*WHO, "phrase", key).union(shop.select(*WHO, "phrase", key)).distinct()


def ranked(tests: DataFrame, held: DataFrame, rows: DataFrame, key: str = "feedback_id", c=PAIN) -> DataFrame:
    """``tests`` with ``rank`` in its set, strongest first (ties: more words, then the phrase), of phrases said by enough customers on enough days.

    An undated row counts as a day of its own.
    """
    wide = held.join(rows.select(key, "customer", "day"), key).groupBy(*WHO, "phrase")
    wide = wide.agg(F.count_distinct("customer").alias("_c"), (F.count_distinct("day") + F.count_if(F.col("day").isNull())).alias("_d"))
    wide = wide.where((F.col("_c") >= c.customers) & (F.col("_d") >= c.days)).select(*WHO, "phrase")
    order = Window.partitionBy(*WHO).orderBy(F.desc("z"), F.desc("words"), "phrase")
    return tests.join(wide, [*WHO, "phrase"]).withColumn("words", F.size(F.split("phrase", " "))).withColumn("rank", F.row_number().over(order))


def merged(candidates: DataFrame, held: DataFrame, key: str = "feedback_id", c=PAIN) -> DataFrame:
    """``(scope, group_key, rank, seed)``: the rank of the phrase with which each phrase goes (itself: a seed), null beyond ``2 * c.shown`` seeds.

    By rank, a phrase goes with the first seed whose rows so far it overlaps: by half of
    both, by ``c.subset`` of the smaller, by half of it if they share a word that is no
    stop word, or by any row if one phrase holds the other.
    """
    named = candidates.select(*WHO, "rank", "phrase", "y")
    combos = held.join(named, [*WHO, "phrase"]).groupBy(*WHO, key).agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    combos = kept(combos.groupBy(*WHO, "ranks").agg(F.count("*").alias("rows")), "phrase-sets")
    most = 2 * c.shown
    now = kept(named.select(*WHO, "rank", F.when(F.col("rank") <= most, F.col("rank")).alias("seed")), "seeds")
    seed_words = named.select(*WHO, F.col("rank").alias("seed"), F.col("phrase").alias("seed_phrase"))
    while True:
        after = kept(_decided(combos, now, named, seed_words, most, c), "seeds")
        before = now.withColumnRenamed("seed", "_before")
        if not after.join(before, [*WHO, "rank"]).where("not (seed <=> _before)").take(1):
            return after
        now = after


def _decided(combos: DataFrame, now: DataFrame, named: DataFrame, seed_words: DataFrame, most: int, c) -> DataFrame:
    """One round: every phrase's decision where all seeds are as in ``now``."""
    of = now.groupBy(*WHO).agg(F.sort_array(F.collect_list(F.struct("rank", "seed"))).alias("_of")).select(*WHO, F.col("_of.seed").alias("of"))
    ranks = F.col("ranks")
    seed_at = lambda r: F.get(F.col("of"), r - 1)
    met = combos.join(of, WHO).withColumn("seeds", F.array_distinct(F.array_compact(F.transform(ranks, seed_at))))
    first = F.transform("seeds", lambda s: F.struct(s.alias("seed"), F.array_min(F.filter(ranks, lambda r: seed_at(r) == s)).alias("first")))

    def steps(f: Column) -> Column:  # a row joins the seed's rows at its first phrase; its later phrases overlap them
        later = F.transform(F.filter(ranks, lambda r: r > f["first"]), lambda r: F.struct(f["seed"].alias("seed"), r.alias("rank"), F.lit(0).alias("joins"), F.lit(1).alias("meets")))
        return F.concat(F.array(F.struct(f["seed"].alias("seed"), f["first"].alias("rank"), F.lit(1).alias("joins"), F.lit(0).alias("meets"))), later)

    flat = met.withColumn("firsts", first).select(*WHO, "rows", F.explode(F.flatten(F.transform("firsts", steps))).alias("s")).select(*WHO, "rows", "s.*")
    flat = flat.groupBy(*WHO, "seed", "rank").agg(F.sum(F.col("rows") * F.col("joins")).alias("joins"), F.sum(F.col("rows") * F.col("meets")).alias("both"))
    so_far = Window.partitionBy(*WHO, "seed").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("gathered", F.sum("joins").over(so_far)).where("both > 0 and rank > seed")
    pair = flat.join(named, [*WHO, "rank"]).join(seed_words, [*WHO, "seed"])
    a, b = (F.concat(F.lit(" "), F.col(x), F.lit(" ")) for x in ("phrase", "seed_phrase"))
    holds = F.contains(a, b) | F.contains(b, a)
    words = lambda x: F.split(fold(F.col(x)), " ")
    touch = F.arrays_overlap(F.filter(words("phrase"), lambda w: ~w.isin(*_STOP)), words("seed_phrase"))
    of_smaller = F.col("both") / F.least("y", "gathered")
    jaccard = F.col("both") / (F.col("y") + F.col("gathered") - F.col("both"))
    goes = holds | (jaccard >= c.overlap) | (touch & (of_smaller >= c.touching)) | (of_smaller >= c.subset)
    found = pair.where(goes).groupBy(*WHO, "rank").agg(F.min("seed").alias("found"))
    alone = F.count_if(F.col("found").isNull()).over(Window.partitionBy(*WHO).orderBy("rank"))
    decided = named.join(found, [*WHO, "rank"], "left").withColumn("alone", alone)
    return decided.select(*WHO, "rank", F.coalesce("found", F.when(F.col("alone") <= most, F.col("rank"))).alias("seed"))


def pain_points(items: DataFrame, now: str, key: str = "feedback_id", text: str = "text", normalised: bool = True, c=PAIN) -> tuple[DataFrame, DataFrame]:
    """``(points, members)``: the pain points of each product group and of the shop, and the complaints in each.

    ``items`` has a unique key, the text, ``group_key, product_name, sentiment, weight,
    tier, category, cause, customer_id, author`` and ``ts``, null where it is not known.
    Rows without weight or text say nothing; groups of fewer than ``c.negatives``
    complaints have no points.  A point needs one cause for a share of its rows
    (``c.group_cause``, ``c.shop_cause``), unless half of its rows and of the group's
    complaints have no label.  A set shows its ``c.shown`` strongest, by weight.
    phrase is the longest of those with 70 % of the rows of the widest.  Causes of equal
    count: the smaller name.  No complaints, or an empty table: no rows.
    """
    rows = facts(items, key)
    said = kept(phrases_said(items, key, text, normalised, c), "phrases-said")
    counts, known = phrase_counts(said)
    tests = kept(phrase_tests(counts, rows, c), "phrase-tests")
    held = kept(holders(tests, said, known, key), "phrase-rows")
    candidates = kept(ranked(tests, held, rows, key, c), "phrase-ranks")
    seeds = merged(candidates, held, key, c).where("seed is not null")
    said = candidates.join(seeds, [*WHO, "rank"])
    point = [*WHO, "seed"]
    members = kept(held.join(said.select(*point, "phrase"), [*WHO, "phrase"]).select(*point, key).distinct(), "pain-rows")

    wide = said.withColumn("_most", F.max("y").over(Window.partitionBy(*point)))
    longest = F.when(F.col("y") >= c.label_cover * F.col("_most"), F.struct("words", "y", -F.col("rank")))
    labels = wide.groupBy(*point).agg(F.max_by("phrase", longest).alias("phrase"), F.sort_array(F.collect_set("phrase")).alias("phrases"))
    strongest = said.where("rank = seed").select(*point, F.col("phrase").alias("seed_phrase"), "z", "z_same", "z_other", "lift", "spread", "n1")
    full = members.join(rows.drop("group_key"), key)
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts")) / 86400
    span = c.trend_days
    summary = full.groupBy(*point).agg(
        F.count("*").alias("count"), F.count_distinct("customer").alias("customers"), F.count_distinct("day").alias("days"),
        F.round(F.sum(F.col("weight").cast("decimal(20,8)")), 4).cast("double").alias("weight"), F.count_if(F.col("tier").isin("P1", "P2")).alias("verified"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count_if("blank").alias("blanks"),
        F.count_if((age >= 0) & (age < span)).alias("recent"), F.count_if((age >= span) & (age < 2 * span)).alias("previous"),
    )
    causes = full.where("category is not null").groupBy(*point, "category", "cause").agg(F.count("*").alias("n"))
    causes = causes.groupBy(*point).agg(F.min_by(F.struct("category", "cause", "n"), F.struct(-F.col("n"), "category", "cause")).alias("top"))
    blank = rows.where("negative").groupBy("group_key").agg(F.avg(F.col("blank").cast("int")).alias("group_blank"))
    joined = summary.join(labels, point).join(strongest, point).join(causes, point, "left").join(blank, "group_key", "left")
    share, unlabelled = F.coalesce(F.col("top.n") / F.col("count"), F.lit(0.0)), F.col("blanks") / F.col("count")
    unread = (F.col("scope") == "group") & (unlabelled >= 0.5) & (F.col("group_blank") >= 0.5)
    clear = unread | (share >= F.when(F.col("scope") == "shop", c.shop_cause).otherwise(c.group_cause))
    shown = joined.where(clear).withColumn("_at", F.row_number().over(Window.partitionBy(*WHO).orderBy("seed"))).where(F.col("_at") <= c.shown)
    place = F.row_number().over(Window.partitionBy(*WHO).orderBy(F.desc("weight"), F.desc("count"), "seed"))
    pain_key = F.concat_ws("::", "group_key", "seed_phrase")
    points = kept(shown.select(
        *WHO, place.alias("place"), pain_key.alias("pain_key"), "phrase", F.array_remove(F.col("phrases"), F.col("phrase")).alias("variants"), "count", "customers", "days", "weight", "verified", "first_seen", "last_seen", "recent", "previous",
        F.col("top.category").alias("category"), F.nullif(F.col("top.cause"), F.lit("")).alias("cause"), share.alias("cause_share"), unlabelled.alias("unlabelled_share"), (F.col("count") / F.col("n1")).alias("share_of_negatives"), "z", "z_same", "z_other", "lift", "spread", "seed",
    ), "pain-points")
    attached = members.join(points.select(*point, "pain_key"), point).select(*WHO, "pain_key", key)
    return points.drop("seed"), attached


def group_status(items: DataFrame, members: DataFrame, key: str = "feedback_id", c=PAIN) -> DataFrame:
    """``(group_key, feedbacks, negatives, status, uncovered)`` of each product group: ``too_few`` complaints, points (``ok``) or ``none``; the complaints in no point."""
    groups = facts(items, key).groupBy("group_key").agg(F.count("*").alias("feedbacks"), F.count_if("negative").alias("negatives"))
    covered = members.where("scope = 'group'").groupBy("group_key").agg(F.count_distinct(key).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    status = F.when(F.col("negatives") < c.negatives, "too_few").when(n > 0, "ok").otherwise("none")
    return groups.join(covered, "group_key", "left").select("group_key", "feedbacks", "negatives", status.alias("status"), (F.col("negatives") - n).alias("uncovered"))
