"""Mixing sources to target token counts by entropy balancing (operator 7).

Every token of the pool starts with its document's prior rate q (1 unless
given).  Among all document rates, those that stay closest to the prior in
relative entropy over tokens, take each source's target of tokens and do not
exceed ``cap`` are ``min(cap, q * exp(lambda_source))``.  The multipliers
minimise a convex dual that separates by source; a safeguarded Newton step for
all sources at once is one aggregation over the sums of documents that share
source and prior (taken once, combined map-side, so a source with a third of all
rows is no hot group), and the number of sources is not bounded.  A source of one
prior starts at its solution; a step confirms it as it does any other.  Rates are rounded to whole copies, floor or ceiling: a
document is rounded up if its hash falls below a threshold per source, found
with exact sums over 256-way refined histograms.  The walk ends at the first
document that does not fit; it is set aside, and single documents (the largest
that still fit) and further walks over those that fit follow until no open
document fits into what its source lacks.  The singles of a source are one
fold over its sizes that fit, falling, with ``FIXES`` documents a size at most
(so a row of the fold grows at most as the root of the corpus).  If one more brings a source closer it is
taken, and documents rounded up before are turned down while one fits into the
excess.  No randomness: reruns agree.

Defined results: a null text has size 0; documents of size 0 and sources of
size 0 are never taken; null sources form one source, ordered last; rows that
repeat both id and text share their decision; an empty table gives an empty
result; other columns of the input are ignored by ``mixed`` and kept by
``apply_mix`` and ``repeated``.  ``counted`` gives every row of a plan an equal
part of what the rows with its source, id and text hold in the mixed documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelling.operators.numbering import sequential_index

from .store import stash
from .tokens import n_words

BINS = 256       # histogram cells per refinement of a threshold
REFINE = 3       # refinements: thresholds are exact to 256**-3 of the hash range
FIXES = 6        # single documents taken per source before the rest is walked again
MAX_NEWTON = 60


def source_key(source: Column) -> Column:
    """A non-null text key of a source: null and every string stay apart."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))




def weight_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Add ``target`` to one row per source (``src``, ``source``, ``source_size``).

    Sources in code-point order, null last, weigh ``weights`` repeating and
    share ``share`` of all tokens; a target stops at ``cap`` times its
    source's size and the excess is reshared by weight until none is above.
    """
    ranked = sequential_index(sources.withColumn("isnull", F.col("source").isNull()),
                              ["isnull", "source"], out="rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    table = stash(ranked.select("src", "source_size", w.alias("w"),
                                (F.col("source_size") * float(cap)).alias("most")), "weights")
    # nothing is below level 0, so all sources are open at first
    r = table.agg(F.sum("source_size").alias("total"), F.sum(F.when(F.col("most") >= 0, F.col("w"))).alias("open")).first()
    goal = float(r["total"] or 0) * share
    level, above = goal / r["open"] if r["open"] else 0.0, 0
    while True:
        r = table.agg(F.sum(F.when(F.col("most") < level * F.col("w"), F.col("most"))).alias("held"),
                      F.sum(F.when(F.col("most") >= level * F.col("w"), F.col("w"))).alias("open"),
                      F.count_if(F.col("most") < level * F.col("w")).alias("n")).first()
        if r["n"] == above or not r["open"]:
            break
        above = r["n"]
        level = (goal - (r["held"] or 0.0)) / r["open"]
    return table.select("src", "source_size",
                        F.least("most", F.lit(level) * F.col("w")).alias("target"))


def _rates(units: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """``src, target, source_size, lam``: the dual multipliers by Newton's method."""
    # documents of one source and prior share their rate: every step reads their sums
    units = stash(units.groupBy("src", "q").agg(F.sum("w").alias("w")), "strata")
    mass = units.groupBy("src").agg(F.sum(F.col("w") * F.col("q")).alias("mass"))
    free = (F.col("target") > 0) & (F.col("target") < F.lit(cap) * F.col("source_size") * (1 - 1e-12))
    lam = stash(targets.join(mass, "src").select(
        "src", "target", "source_size",
        F.when(F.col("target") <= 0, F.lit(-math.inf)).when(~free, F.lit(math.inf))
        .otherwise(F.log(F.col("target") / F.col("mass"))).alias("lam"),
        F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"),
        (~free).alias("done")), "dual")  # a target of nothing or of the cap is a bound, not a root
    for _ in range(MAX_NEWTON):
        if not lam.where(~F.col("done")).limit(1).count():
            break
        rate = F.col("q") * F.exp("lam")
        open_ = (F.abs("lam") < math.inf)
        sums = (units.join(lam.where(open_), "src").groupBy("src")
                .agg(F.sum(F.col("w") * F.least(rate, F.lit(cap))).alias("took"),
                     F.sum(F.when(rate < cap, F.col("w") * rate).otherwise(0.0)).alias("slope")))
        gap = F.col("took") - F.col("target")
        lo = F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(gap >= 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        new = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        done = F.coalesce(F.abs(gap) <= 1e-9 * F.col("target"), F.lit(True))
        lam = stash(lam.join(sums, "src", "left").select(
            "src", "target", "source_size",
            F.when(done, F.col("lam")).otherwise(new).alias("lam"),
            lo.alias("lo"), hi.alias("hi"), done.alias("done")), "dual")
    return lam.select("src", "target", "source_size", "lam")


def _thresholds(units: DataFrame, lam: DataFrame) -> DataFrame:
    """Add ``theta`` per source: units with z < theta are rounded up."""
    need = units.groupBy("src").agg(F.sum(F.col("w") * F.col("base")).alias("sure"))
    state = lam.join(need, "src").select(
        "src", "target", "source_size", "lam", (F.col("target") - F.col("sure")).alias("rest"),
        F.lit(0.0).alias("lo"), F.lit(1.0).alias("width"))
    open_units = units.where(F.col("z").isNotNull())
    for _ in range(REFINE):
        state = stash(state, "threshold")
        cell = F.floor((F.col("z") - F.col("lo")) / F.col("width") * BINS)
        hist = (open_units.join(state.select("src", "lo", "width"), "src")
                .where((F.col("z") >= F.col("lo")) & (F.col("z") < F.col("lo") + F.col("width")))
                .groupBy("src", F.least(cell, F.lit(BINS - 1)).alias("cell")).agg(F.sum("w").alias("mass")))
        by_cell = hist.groupBy("src").agg(  # at most BINS entries a source
            F.array_sort(F.collect_list(F.struct("cell", "mass"))).alias("cells"))
        # walk the cells while the whole cell still fits into the rest
        walk = F.aggregate(
            "cells", F.struct(F.col("rest").alias("rest"), F.lit(None).cast("long").alias("at")),
            lambda a, c: F.when(a["at"].isNotNull(), a)
            .when(c["mass"] <= a["rest"], F.struct((a["rest"] - c["mass"]).alias("rest"), a["at"].alias("at")))
            .otherwise(F.struct(a["rest"].alias("rest"), c["cell"].cast("long").alias("at"))))
        state = (state.join(by_cell, "src", "left")
                 .withColumn("walk", F.when(F.col("cells").isNotNull(), walk))
                 .select("src", "target", "source_size", "lam",
                         F.coalesce("walk.rest", "rest").alias("rest"),
                         # all cells fit: the threshold is the end of the interval
                         F.when(F.col("walk.at").isNull(), F.col("lo") + F.col("width"))
                         .otherwise(F.col("lo") + F.col("walk.at") * F.col("width") / BINS).alias("lo"),
                         F.when(F.col("walk.at").isNull(), F.lit(0.0))
                         .otherwise(F.col("width") / BINS).alias("width")))
        state = state.withColumn("width", F.greatest("width", F.lit(1e-300)))
    return state.select("src", "target", "source_size", "lam", F.col("lo").alias("theta"))


def mixed(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, cap: int = 3,
          id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          size: Column | None = None, prior: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, mark, uid, size, source_size, target, rate, copies, taken``.

    ``mark`` is the hash of the text, ``uid`` that of source, id and text.  ``size`` defaults to the number of
    words, ``prior`` (a positive rate) to 1.
    """
    cap = float(cap)
    size_is_of_text = size is None
    size = n_words(F.col(text_col)) if size is None else size
    src = source_key(F.col(source_col))
    rows = stash(docs.select(
        F.col(id_col).alias("doc_id"), src.alias("src"), F.col(source_col).alias("source"),
        size.cast("long").alias("size"), F.xxhash64(text_col).alias("mark"),
        (F.lit(1.0) if prior is None else prior.cast("double")).alias("q"))
        .withColumn("uid", F.xxhash64("src", "doc_id", "mark")), "sizes")
    sources = rows.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    targets = weight_targets(sources, weights, share, cap)
    units = stash(rows.where("size > 0").groupBy("src", "uid", "size", "q")
                  .agg(F.count(F.lit(1)).alias("m"))
                  .select("src", "uid", "q", (F.col("size") * F.col("m")).alias("w")), "units")
    lam = _rates(units, targets, cap)

    def rounded(df: DataFrame) -> DataFrame:
        """Add rate, base (whole copies) and z (place in the rounding order; null if the rate is whole)."""
        rate = (F.when(F.col("lam") == math.inf, F.lit(cap)).when(F.col("lam") == -math.inf, F.lit(0.0))
                .otherwise(F.least(F.lit(cap), F.col("q") * F.exp("lam"))))
        df = df.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9))
        part = F.col("rate") - F.col("base")
        u = F.shiftrightunsigned("uid", 11) / F.lit(float(1 << 53))
        # order by hash / fraction, squeezed into [0, 1)
        return df.withColumn("z", F.when(part > 1e-9, u / (u + part)))

    def copies(df: DataFrame) -> DataFrame:
        up = F.coalesce(F.col("z") < F.col("theta"), F.lit(False)).cast("int")
        return df.withColumn("up", up).withColumn(
            "copies", F.coalesce(F.col("base") + F.col("up") + F.coalesce("turn", F.lit(0)), F.lit(0)))

    marked = stash(rounded(units.join(lam, "src")).select("src", "uid", "w", "base", "z"), "marked")
    theta = stash(_thresholds(marked, lam), "theta")
    # every document's copies before any turn; only those with a place in the rounding order can be turned
    now = marked.join(theta.select("src", "theta"), "src").withColumn(
        "up", F.coalesce(F.col("z") < F.col("theta"), F.lit(False)).cast("int"))
    alone = size_is_of_text and prior is None  # else rows of one text may differ in size or prior and are turned together
    whole = F.col("w") if alone else F.sum("w").over(Window.partitionBy("src", "uid"))
    now = stash(now.select("src", "uid", "w", whole.alias("whole"), "up", (F.col("base") + F.col("up")).alias("copies"),
                           F.col("z").isNotNull().alias("free")), "rounded")
    level = stash(theta.select("src", "target").join(
        now.groupBy("src").agg(F.sum(F.col("w") * F.col("copies")).alias("took")), "src"), "level")
    moved = None

    def turn(turned: DataFrame) -> None:
        """Documents of a table of turns are turned; the words of their sources follow."""
        nonlocal moved, level
        moved = turned if moved is None else moved.unionByName(turned)
        more = turned.groupBy("src").agg(F.sum(F.col("whole") * F.col("turn")).alias("more"))
        level = stash(level.join(more, "src", "left").select(
            "src", "target", (F.col("took") + F.coalesce("more", F.lit(0))).alias("took")), "level")

    def gap(sign: int, gone: Column | None = None) -> Column:
        """What a source lacks (has too much) after ``gone`` more words."""
        took = F.col("took") if gone is None else F.col("took") + F.lit(sign) * gone
        return F.lit(sign) * (F.col("target") - took)

    def movable(sign: int, reach: float) -> DataFrame:
        """Documents whose turn up (or down) moves their source by at most ``reach`` times what it lacks (has too much)."""
        free = now.where("free")
        if moved is None:
            free = free.where(F.col("up") == (0 if sign > 0 else 1))
        else:
            turns = moved.groupBy("src", "uid").agg(F.sum("turn").alias("turn"), F.max("fixed").alias("fixed"))
            is_up = F.col("up") + F.coalesce("turn", F.lit(0))
            free = free.join(turns, ["src", "uid"], "left").where(
                ~F.coalesce("fixed", F.lit(False)) & (is_up == (0 if sign > 0 else 1)))
        return (free.select("src", "uid", "w", "whole").join(level, "src").where(F.col("w") <= reach * gap(sign)))

    def singles(fits: DataFrame, sign: int, most: int) -> DataFrame:
        """Of each source the largest document that fits, again and again, ``most`` at most; ``take`` marks them.

        Gaps only shrink, so this is one fold over the sizes, falling; of one
        size only the first ``most`` documents matter, and as many as fit.
        """
        rank = F.dense_rank().over(Window.partitionBy("src", "w").orderBy("uid"))
        few = fits.withColumn("rank", rank).where(F.col("rank") <= most).where(F.col("rank") * F.col("w") <= gap(sign))
        picks = few.groupBy("src", "target", "took").agg(F.array_sort(F.collect_list(
            F.struct((-F.col("w")).alias("order"), "uid", "w", "whole"))).alias("falling"))
        picks = picks.select("src", F.aggregate(
            "falling", F.struct(F.lit(0).cast("long").alias("gone"), F.array().cast("array<long>").alias("uids")),
            lambda a, c: F.when(
                (F.size(a["uids"]) < most) & ~F.array_contains(a["uids"], c["uid"]) & (c["w"] <= gap(sign, a["gone"])),
                F.struct((a["gone"] + c["whole"]).alias("gone"), F.array_append(a["uids"], c["uid"]).alias("uids")))
            .otherwise(a)).alias("pick")).select("src", "pick.gone", "pick.uids")
        return fits.join(picks, "src").withColumn("take", F.array_contains("uids", F.col("uid")))

    def walk(fits: DataFrame, sign: int, step: int) -> DataFrame:
        """Many small documents: those below a threshold in an order of the step's own; ``take`` marks them."""
        place = F.shiftrightunsigned(F.xxhash64("uid", F.lit(step)), 11) / F.lit(float(1 << 53))
        again = fits.select("src", "uid", "w", F.lit(0).alias("base"), place.alias("z"))
        aim = fits.groupBy("src").agg(F.max(gap(sign)).alias("target")).select(
            "src", "target", F.lit(0).alias("source_size"), F.lit(0.0).alias("lam"))
        marks = fits.join(stash(_thresholds(again, aim).select("src", "theta"), "theta"), "src").withColumn(
            "take", place < F.col("theta"))
        gone = marks.where("take").groupBy("src").agg(F.sum("whole").alias("gone"))
        return marks.join(gone, "src", "left")

    def fill(sign: int) -> None:
        """Turn documents until none fits into its source's gap; one that does not fit is set aside.

        Gaps only shrink here, so those that fit are among those that fitted before.
        """
        fits, step, turned = movable(sign, 1.0), 0, []
        while True:
            single = step < FIXES or step % 2
            marks = singles(fits, sign, 1 if step else FIXES) if single else walk(fits, sign, step)
            marks = stash(marks.select(
                "src", "uid", "w", "whole", "target", "take",
                (F.col("took") + F.lit(sign) * F.coalesce("gone", F.lit(0))).alias("took"))
                .where(F.col("take") | (F.col("w") <= gap(sign))), "fitting")
            taken = marks.where("take").select("src", "uid", "whole", F.lit(sign).alias("turn"), F.lit(False).alias("fixed"))
            turned.append(taken.distinct() if single and not alone else taken)
            fits = marks.where(~F.col("take"))
            if not fits.limit(1).count():
                break
            step = max(step + 1, FIXES)
        turn(reduce(DataFrame.unionByName, turned))

    fill(1)
    over = movable(1, 2.0).groupBy("src").agg(
        F.min(F.struct(F.abs(F.col("w") - gap(1)).alias("left"), "uid", "whole")).alias("b"))
    over = stash(over.select("src", "b.uid", "b.whole", F.lit(1).alias("turn"), F.lit(True).alias("fixed")), "turned")
    if over.limit(1).count():  # one more than fits, if that is closer; what is too much then goes
        turn(over)
        fill(-1)
    moved = moved.groupBy("src", "uid").agg(F.sum("turn").alias("turn"))
    params = targets.join(theta.select("src", "lam", "theta"), "src", "left")
    out = copies(rounded(rows.join(params, "src")).join(moved, ["src", "uid"], "left"))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)))
    return out.select("doc_id", "mark", "uid", "size", "source_size", "target", "rate", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def _uid(text: str, key: str, source: str) -> Column:
    """The hash of source, id and text that ``mixed`` gives a document."""
    return F.xxhash64(source_key(F.col(source)), F.col(key), F.xxhash64(text))


def repeated(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """The documents themselves, every one repeated as often as ``plan`` (a result of ``mixed``) takes it."""
    take = plan.where("copies > 0").groupBy("uid").agg(
        F.max("copies").alias("copies"))  # rows repeating id, text and source share their copies
    took = docs.join(take.select(F.col("uid").alias("__uid"), F.col("copies").alias("__copies")),
                     _uid(text_col, id_col, source_col) == F.col("__uid"))
    return took.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))) \
        .select(*docs.columns)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, every one repeated as often as the mix takes it."""
    return repeated(docs, mixed(docs, **options), **{k: v for k, v in options.items() if k.endswith("_col")})


def counted(plan: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source") -> DataFrame:
    """``plan`` with the ``copies`` and ``taken`` words found in ``taken``, the documents that were mixed by it."""
    held = (taken.select(_uid(text_col, id_col, source_col).alias("uid"), n_words(F.col(text_col)).alias("words"))
            .groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")))
    each = plan.groupBy("uid").agg(F.count(F.lit(1)).alias("m")).join(held, "uid").select(
        "uid", F.floor(F.col("n") / F.col("m")).alias("n"), F.floor(F.col("words") / F.col("m")).alias("words"))
    return plan.join(each, "uid", "left").withColumns({
        "copies": F.coalesce("n", F.lit(0).cast("long")), "taken": F.coalesce("words", F.lit(0).cast("long"))}).select(*plan.columns)
