"""One-to-one matching of predicted to true events and spells, greedy in time order.

What an event may take depends on what earlier events took, but only through a small state.
For entries it is which predictions of the last days are taken, a few bits; for spells it is
one bit, as at most one predicted spell reaches over two true ones. So matching is a scan: the
calendar is cut, each part maps the state it gets to the state it leaves, the parts are
composed, and each is then replayed from its state.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions import rolling as R
from tidegauge.operators.axis import Axis
from tidegauge.operators.chunks import by_chunk, fill_forward, lay_out
from tidegauge.operators.evaluate import PRED, RUNS, TRUE, entries, spells

EARLY, LATE = 5, 10
PART = 32                        # days of the calendar whose entries make one part


def _both(df, make, ax):
    a = make(df, TRUE).withColumn("is_true", F.lit(True))
    return a.unionByName(make(df, PRED).withColumn("is_true", F.lit(False)))


def entry_candidates(df: DataFrame, ax: Axis = RUNS, early=EARLY, late=LATE):
    """(true, predicted) entry pairs with the prediction in [true - early, true + late].

    Days are cut into buckets as wide as the window, so each true entry looks into at
    most two buckets through an equi-join, whatever the length of the run.
    """
    width = early + late + 1
    date = ax.order[0]

    def bucket(d):
        return F.floor(F.unix_date(d) / width)
    t = entries(df, TRUE, ax).withColumnRenamed(date, "true_date")
    t = t.withColumn("_b", F.explode(F.array_distinct(F.array(
        bucket(F.date_sub("true_date", early)), bucket(F.date_add("true_date", late))))))
    p = entries(df, PRED, ax).withColumnRenamed(date, "pred_date").withColumn("_b", bucket(F.col("pred_date")))
    pairs = t.join(p, [*ax.by, "label", "_b"]).drop("_b")
    lag = F.datediff("pred_date", "true_date")
    return pairs.withColumn("lag_days", lag).where(lag.between(-early, late))


def _parts(df, ax, early, late):
    """Entries of each key and part of the calendar, as two sets of bits.

    Bit i of ``trues`` is day i of the part, bit j of ``preds`` day j - early: a part sees
    the predictions its true entries may take, so one prediction is in two parts at most.
    """
    both = _both(df, lambda d, c: entries(d, c, ax), ax)
    day = F.unix_date(ax.order[0])
    first, last = (F.floor((day + shift) / PART) for shift in (-late, early))
    seen = F.when(F.col("is_true"), F.array(F.floor(day / PART))).otherwise(F.sequence(first, last))
    rows = both.select(*ax.by, "label", "is_true", day.alias("_day"), F.explode(seen).alias("part"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_day") - PART * F.col("part") + F.when(F.col("is_true"), 0).otherwise(early)).cast("int"))
    return rows.groupBy(*ax.by, "label", "part").agg(
        F.bit_or(F.when(F.col("is_true"), bit)).alias("trues"), F.bit_or(F.when(~F.col("is_true"), bit)).alias("preds")) \
        .where("trues is not null and preds is not null")


def _bits(mask, n):
    """Numbers of the set bits among the first ``n``, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _bit(mask, i))


def _bit(mask, i):
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1


def _choice(preds, taken, day, early, late):
    """The free prediction nearest to a true entry as a bit, the earlier of two; 0 without one."""
    window = F.call_function("shiftright", preds.bitwiseAND(F.bitwise_not(taken)), day)
    lags = sorted(range(-early, late + 1), key=lambda lag: (abs(lag), lag))
    near = F.coalesce(*[F.when(window.bitwiseAND(F.lit(1 << (early + lag)).cast("long")) != 0, F.lit(1 << (early + lag)).cast("long")) for lag in lags], F.lit(0).cast("long"))
    return F.call_function("shiftleft", near, day)


def match_entries(df: DataFrame, ax: Axis = RUNS, early=EARLY, late=LATE):
    """Each true entry takes the nearest free prediction in its window, in time order.

    ``early + late`` may be 31 days at most. The state between parts is the set of the
    predictions around the border that are taken: their subsets are tabulated, a few as an
    entry has no other the day after. Stretches of adjacent parts are composed by looking
    tables up, one entry per part, of which a year has twelve.
    """
    if early + late >= PART:
        raise ValueError(f"a window of {early + late + 1} days is too wide, {PART} is the most")
    keys = [*ax.by, "label"]
    order = Axis(tuple(keys), ("part",))
    parts = _parts(df, ax, early, late)
    parts = parts.withColumn("_new", F.when(F.lag("part").over(order.base()) == F.col("part") - 1, 0).otherwise(1))
    parts = parts.withColumn("stretch", F.sum("_new").over(order.past()))

    def replay(start):
        return F.aggregate(_bits(F.col("trues"), PART), start, lambda taken, day: taken.bitwiseOR(_choice(F.col("preds"), taken, day, early, late)))
    none = F.lit(0).cast("long")
    around = F.when(F.col("_new") == 1, none).otherwise(F.col("preds").bitwiseAND(F.lit((1 << (early + late)) - 1).cast("long")))
    subsets = F.aggregate(_bits(around, early + late), F.array(none), lambda sets, i: F.concat(sets, F.transform(
        sets, lambda x: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
    parts = parts.withColumn("_sets", subsets)
    parts = parts.withColumn("_next", F.transform("_sets", lambda x: F.shiftright(replay(x), PART)))

    inside = F.array_sort(F.collect_list(F.struct("part", "trues", "preds", "_sets", "_next")))
    rows = parts.groupBy(*keys, "stretch").agg(inside.alias("_parts"))
    start = F.struct(none.alias("state"), F.array().cast("array<bigint>").alias("states"))

    def step(acc, p):
        place = F.array_position(p["_sets"], acc["state"].bitwiseAND(p["preds"])).cast("int")
        return F.struct(F.get(p["_next"], place - 1).alias("state"), F.concat(acc["states"], F.array(acc["state"])).alias("states"))
    states = F.aggregate("_parts", start, step, lambda acc: acc["states"])
    rows = rows.select(*keys, F.explode(F.arrays_zip(F.col("_parts").alias("p"), states.alias("state"))).alias("_r"))
    rows = rows.select(*keys, "_r.state", "_r.p.part", "_r.p.trues", "_r.p.preds")

    def take(acc, day):
        bit = _choice(F.col("preds"), acc["taken"], day, early, late)
        pair = F.struct(day.cast("int").alias("t"), bit.alias("p"))
        return F.struct(acc["taken"].bitwiseOR(bit).alias("taken"), F.when(bit == 0, acc["m"]).otherwise(F.concat(acc["m"], F.array(pair))).alias("m"))
    start = F.struct(F.col("state").alias("taken"), F.array().cast("array<struct<t:int,p:bigint>>").alias("m"))
    found = F.aggregate(_bits(F.col("trues"), PART), start, take, lambda acc: acc["m"])
    rows = rows.select(*keys, "part", F.explode(found).alias("_m"))
    day = (PART * F.col("part")).cast("int")
    true, pred = day + F.col("_m.t"), day - early + F.round(F.log2(F.col("_m.p")))
    return rows.select(*keys, F.date_from_unix_date(true).alias("true_date"), F.date_from_unix_date(pred.cast("int")).alias("pred_date")) \
               .withColumn("lag_days", F.datediff("pred_date", "true_date"))


def entry_scores(df: DataFrame, classes, ax: Axis = RUNS, early=EARLY, late=LATE):
    """Hits, precision, recall, f1 and mean lead/lag of entries per run and class."""
    by = [*ax.by, "label"]
    counts = _both(df, lambda d, c: entries(d, c, ax), ax).groupBy(*by).agg(
        F.count_if("is_true").alias("n_true"), F.count_if(~F.col("is_true")).alias("n_pred"))
    hits = match_entries(df, ax, early, late).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_hit"), F.avg("lag_days").alias("mean_lag_days"))
    return _scored(_every_class(counts, df, classes, ax).join(hits, by, "left"), {"mean_lag_days": 0.0})


def _every_class(counts, df, classes, ax):
    by = [*ax.by, "label"]
    runs = df.select(*ax.by).distinct().select(*ax.by, F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    return runs.join(counts, by, "left").na.fill(0, subset=["n_true", "n_pred"])


def _scored(df, defaults):
    df = df.na.fill({"n_hit": 0, **defaults})
    precision, recall = (F.coalesce(F.try_divide("n_hit", n), F.lit(0.0)) for n in ("n_pred", "n_true"))
    df = df.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return df.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


# -- spells ------------------------------------------------------------------

def overlapping_spells(df: DataFrame, ax: Axis = RUNS, min_days=5, target_rows=None):
    """(true, predicted) spells of one class that share days, with the days shared."""
    return _overlaps(df, ax, min_days, target_rows).drop("_left", "_right")


def _overlaps(df, ax, min_days, target_rows):
    """Overlapping spells, and whether the predicted one reaches the true one before and after.

    Spells of one side do not overlap. So a pair is a true spell with the last predicted one
    that began no later, or a predicted spell with the last true one that began before it,
    and there are fewer pairs than spells. The open spells are carried forward.
    """
    keys = [*ax.by, "label"]
    starts = Axis(tuple(keys), ("start",))

    def neighbours(d, a):
        return d.withColumns({"prev_end": F.lag("end").over(a.base()), "next_start": F.lead("start").over(a.base())})
    trues = by_chunk(spells(df, TRUE, ax, min_days), starts, neighbours, before=1, after=1, target_rows=target_rows)
    trues = trues.withColumn("is_true", F.lit(True))
    preds = spells(df, PRED, ax, min_days).withColumn("is_true", F.lit(False))
    rows = trues.unionByName(preds, allowMissingColumns=True)
    this = F.struct("start", "end", "days", "prev_end", "next_start")
    open_ = {"_t": F.when(F.col("is_true"), this), "_p": F.when(~F.col("is_true"), this)}
    rows = fill_forward(lay_out(rows, Axis(tuple(keys), ("start", "is_true")), target_rows), open_)
    fields = [*[F.col(f"_{s[0]}.{c}").alias(f"{s}_{c}") for s in ("true", "pred") for c in ("start", "end", "days")]]
    pairs = rows.where(F.col("_t.end") >= F.col("_p.start")).where(F.col("_p.end") >= F.col("_t.start"))
    days = F.datediff(F.least("true_end", "pred_end"), F.greatest("true_start", "pred_start")) + 1
    return pairs.select(*keys, *fields, F.coalesce(F.col("_p.start") <= F.col("_t.prev_end"), F.lit(False)).alias("_left"),
                        F.coalesce(F.col("_p.end") >= F.col("_t.next_start"), F.lit(False)).alias("_right")).withColumn("overlap_days", days)


def match_spells(df: DataFrame, ax: Axis = RUNS, min_days=5, target_rows=None):
    """Each true spell takes the free predicted spell it overlaps longest, in time order.

    One predicted spell at most reaches from a true spell to the next, so whether that one is
    taken is all that is handed on. A true spell settles it or leaves it as it was; what was
    settled last is carried forward.
    """
    keys = [*ax.by, "label"]
    true = [f"true_{c}" for c in ("start", "end", "days")]
    choice = F.struct((-F.col("overlap_days")).alias("less"), F.col("pred_start").alias("start"), F.col("pred_end").alias("end"), F.col("pred_days").alias("days"))
    rows = _overlaps(df, ax, min_days, target_rows).groupBy(*keys, *true).agg(
        F.min(choice).alias("_any"), F.min(F.when(~F.col("_left"), choice)).alias("_own"),
        F.max(F.when(F.col("_left"), F.col("pred_start"))).alias("_from"), F.max(F.when(F.col("_right"), F.col("pred_start"))).alias("_to"))
    first, onward = F.col("_any.start"), F.col("_to")
    kept = F.coalesce(onward == F.col("_from"), F.lit(False)) | (F.coalesce(first == F.col("_from"), F.lit(False)) & F.coalesce(F.col("_own.start") == onward, F.lit(False)))
    rows = rows.withColumn("settled", F.when(onward.isNull(), False).when(first == onward, True).when(kept, F.lit(None).cast("boolean")).otherwise(False))
    order = Axis(tuple(keys), ("true_start",))

    def before(d, a):
        if "_f_settled" not in d.columns:
            d = d.withColumn("_f_settled", R.ffill(a, "settled"))
        return d.withColumn("_taken", F.coalesce(F.lag("_f_settled").over(a.base()), F.lit(False)))
    rows = by_chunk(rows, order, before, before=1, fill=["settled"], target_rows=target_rows)
    rows = rows.withColumn("_m", F.when(F.col("_taken"), F.col("_own")).otherwise(F.col("_any"))).where("_m is not null")
    return rows.select(*keys, *true, *[F.col(f"_m.{c}").alias(f"pred_{c}") for c in ("start", "end", "days")])


def spell_scores(df: DataFrame, classes, ax: Axis = RUNS, min_days=5, start_early=10, end_late=10):
    """Detection, offsets, duration ratio and shares within tolerance per run and class."""
    by = [*ax.by, "label"]
    counts = _both(df, lambda d, c: spells(d, c, ax, min_days), ax).groupBy(*by).agg(
        F.count_if("is_true").alias("n_true"), F.count_if(~F.col("is_true")).alias("n_pred"))
    first, last = F.datediff("pred_start", "true_start"), F.datediff("pred_end", "true_end")
    hits = match_spells(df, ax, min_days).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_hit"), F.avg(first).alias("avg_start_diff"), F.avg(last).alias("avg_end_diff"),
        F.avg(F.col("pred_days") / F.col("true_days")).alias("avg_duration_ratio"),
        F.avg(first.between(-start_early, 0).cast("double")).alias("starts_within_tolerance"),
        F.avg(last.between(0, end_late).cast("double")).alias("ends_within_tolerance"))
    means = {c: 0.0 for c in ("avg_start_diff", "avg_end_diff", "avg_duration_ratio", "starts_within_tolerance", "ends_within_tolerance")}
    return _scored(_every_class(counts, df, classes, ax).join(hits, by, "left"), means)
