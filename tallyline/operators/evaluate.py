"""Evaluation: error rates, confusion, thresholds, sweeps, latencies."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyline.functions import text as X
from tallyline.operators import registry as R
from tallyline.operators.curate import hash_order, round_robin, running
from tallyline.operators.tables import written
from tallyline.params import BANDS, DEFAULTS, Params


def rate(hit: Column) -> Column:
    """Share of rows; null without any."""
    return F.count_if(hit) / F.nullif(F.count("*"), F.lit(0))


def legitimate(df: DataFrame) -> DataFrame:
    """(n, correct, false_alarms, unexpected, false_alarm_rate) of trials that should pass."""
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.col("action") == "ALLOW").alias("correct"), F.count_if(F.col("action") == "ALLOW_WARN").alias("false_alarms"),
        F.count_if(F.col("status") != "AUTHORIZED").alias("unexpected"), rate(F.col("action") == "ALLOW_WARN").alias("false_alarm_rate"),
    )


def swaps(df: DataFrame) -> DataFrame:
    """(registered, true, n, missed, miss_rate) of trials with another's plate; most missed first."""
    missed = F.col("action") != "ALLOW_WARN"
    return df.groupBy("registered", "true").agg(F.count("*").alias("n"), F.count_if(missed).alias("missed"), rate(missed).alias("miss_rate")).orderBy(F.desc("missed"), F.desc("miss_rate"), "registered", "true")


def swap_totals(df: DataFrame, neutral: tuple[str, ...] = DEFAULTS.neutral) -> DataFrame:
    """(n, caught, missed, detection_rate, miss_rate, neutral_n, neutral_missed, neutral_miss_rate) of all trials of `swaps`.

    neutral_...: of trials with both colours neutral; the rate is null without any, those of all trials 0.
    """
    caught = F.coalesce(F.col("action") == "ALLOW_WARN", F.lit(False))
    both = F.upper("registered").isin(*neutral) & F.upper("true").isin(*neutral)
    share = lambda hit: F.coalesce(rate(hit), F.lit(0.0))
    return df.agg(
        F.count("*").alias("n"), F.count_if(caught).alias("caught"), F.count_if(~caught).alias("missed"), share(caught).alias("detection_rate"), share(~caught).alias("miss_rate"),
        F.count_if(both).alias("neutral_n"), F.count_if(both & ~caught).alias("neutral_missed"), (F.count_if(both & ~caught) / F.nullif(F.count_if(both), F.lit(0))).alias("neutral_miss_rate"),
    )


def unregistered(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "UNREGISTERED").alias("correct"), rate(F.col("status") == "UNREGISTERED").alias("rate"))


def gate_sweep(df: DataFrame, gates: list[float], neutral: tuple[str, ...] = DEFAULTS.neutral) -> DataFrame:
    """(gate, false_alarm_rate, detection_rate): each trial against each of the few gates, as an array of its own row."""
    same = (F.col("predicted") == F.col("registered")) | (F.col("predicted").isin(*neutral) & F.col("registered").isin(*neutral))
    spread = df.withColumn("gate", F.explode(F.array(*[F.lit(float(g)) for g in gates])))
    warn = ~same & ~(F.col("conf").isNotNull() & (F.col("conf") < F.col("gate")))
    honest = F.col("scenario") == "legitimate"
    return spread.groupBy("gate").agg(
        (F.count_if(honest & warn) / F.nullif(F.count_if(honest), F.lit(0))).alias("false_alarm_rate"),
        (F.count_if((F.col("scenario") == "swap") & warn) / F.nullif(F.count_if(F.col("scenario") == "swap"), F.lit(0))).alias("detection_rate"),
    )


def latency_metrics(df: DataFrame, latency: str, status: str) -> DataFrame:
    """(total, avg, by status): counts of the statuses that results can have; zeros without rows."""
    names = ("AUTHORIZED", "UNREGISTERED", "MISMATCH", "NO_PLATE", "ERROR")
    return df.agg(F.count("*").alias("total"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_ms"), *[F.count_if(F.col(status) == s).alias(f"{s.lower()}_count") for s in names])


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, n, low, high, and a column for each (name: share) of `at`) by group: exact, between neighbours in proportion.

    Values are counted first and ranked by running counts over range parts, so that no task holds the values of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    ranked = running(counts, [*[F.col(k) for k in keys], F.col("__v")], {"__end": "__c"})
    named = [f"__g{i}" for i in range(len(keys))]
    size = ranked.groupBy(*[F.col(k).alias(g) for k, g in zip(keys, named)]).agg(F.sum("__c").alias("n"), F.min(F.col("__end") - F.col("__c")).alias("__base"))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, named)], F.lit(True))
    placed = ranked.join(size, on).select(*keys, "n", "__v", (F.col("__end") - F.col("__base")).alias("__end"))
    place = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in at.items()}
    pick = lambda rank: F.min(F.when(F.col("__end") > rank, F.col("__v")))
    found = [x for name, h in place.items() for x in (pick(F.floor(h)).alias(f"__a_{name}"), pick(F.ceil(h)).alias(f"__b_{name}"))]
    got = placed.groupBy(*keys, "n").agg(F.min("__v").alias("low"), F.max("__v").alias("high"), *found)
    mixed = [F.when(F.floor(h) == F.ceil(h), F.col(f"__a_{name}")).otherwise((F.ceil(h) - h) * F.col(f"__a_{name}") + (h - F.floor(h)) * F.col(f"__b_{name}")).alias(name) for name, h in place.items()]
    return got.select(*keys, "n", "low", "high", *mixed)


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(n, p50, p95) by group; a group without values has none of them and n = 0."""
    named = [f"__k{i}" for i in range(len(keys))]
    got = quantiles(df, keys, value, {"p50": 0.5, "p95": 0.95}).select(*[F.col(k).alias(g) for k, g in zip(keys, named)], "n", "p50", "p95")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, named)], F.lit(True))
    return df.select(*keys).distinct().join(got, on, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "p50", "p95")


def stage_latency(df: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, median, low, high) of one column a stage, and of their sum."""
    wide = df.withColumn("total", sum((F.col(s) for s in stages[1:]), F.col(stages[0])))
    cols = ", ".join(f"'{s}', cast(`{s}` as double)" for s in [*stages, "total"])
    return quantiles(wide.selectExpr(f"stack({len(stages) + 1}, {cols}) as (stage, ms)"), ["stage"], "ms", {"median": 0.5}).select("stage", "median", "low", "high")


def ocr_report(df: DataFrame, subsets: tuple[str, ...] = ("frozen", "expanded"), truth: str = "truth", prediction: str = "prediction", latency: str = "latency_ms", order: str = "seq") -> DataFrame:
    """(engine, subset, n, exact_match, cer, invalid_format_rate, cold_ms, p50, p95) of each engine over all samples (subset `all`) and each subset.

    df: engine, subset, kind (`cold` for first calls, of which the first by `order` counts, `sample`, or others that count nowhere). A row goes to two
    groups, as grouping sets would have it, and everything but the quantiles is one aggregation. A subset without samples has zeros, and null latencies.
    """
    sample = F.col("kind") == "sample"
    both = df.withColumn("subset", F.explode(F.array(F.lit("all"), F.col("subset"))))
    edits, size = F.levenshtein(F.coalesce(prediction, F.lit("")), F.coalesce(truth, F.lit(""))), F.length(F.coalesce(truth, F.lit("")))
    of = lambda hit: F.coalesce(F.count_if(sample & hit) / F.nullif(F.count_if(sample), F.lit(0)), F.lit(0.0))
    got = both.groupBy("engine", "subset").agg(
        F.count_if(sample).alias("n"), of(F.coalesce(F.col(prediction) == F.col(truth), F.lit(False))).alias("exact_match"),
        F.coalesce(F.sum(F.when(sample, edits)) / F.nullif(F.sum(F.when(sample, size)), F.lit(0)), F.lit(0.0)).alias("cer"), of(~X.is_plate(F.col(prediction))).alias("invalid_format_rate"),
        F.min_by(latency, F.when(F.col("kind") == "cold", F.col(order))).alias("cold_ms"),
    )
    cold = got.filter("subset = 'all'").select("engine", F.col("cold_ms").alias("__cold"))
    ranks = quantiles(both.filter(sample), ["engine", "subset"], latency, {"p50": 0.5, "p95": 0.95}).select("engine", "subset", "p50", "p95")
    grid = df.select("engine").distinct().withColumn("subset", F.explode(F.array(*[F.lit(s) for s in ("all", *subsets)])))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    whole = grid.join(got.drop("cold_ms"), ["engine", "subset"], "left").join(cold, "engine", "left").join(ranks, ["engine", "subset"], "left")
    return whole.select("engine", "subset", zero("n", 0), zero("exact_match", 0.0), zero("cer", 0.0), zero("invalid_format_rate", 0.0), F.col("__cold").alias("cold_ms"), "p50", "p95")


def ocr_deployment(report: DataFrame, candidate: str, other: str, p: Params = DEFAULTS) -> DataFrame:
    """The gate on an ocr_report: one row, with the reasons against the candidate engine."""
    one = lambda engine, subset, c: F.max(F.when((F.col("engine") == engine) & (F.col("subset") == subset), F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    row = report.agg(
        zero(one(candidate, "frozen", "exact_match")).alias("frozen_exact"), zero(one(candidate, "expanded", "exact_match")).alias("expanded_exact"),
        zero(one(candidate, "all", "cer")).alias("cer"), one(candidate, "all", "p95").alias("candidate_p95"), one(other, "all", "p95").alias("other_p95"),
    )
    return deployment_gate(row, p)


def color_report(rows: DataFrame, classes: list[str], truth: str = "true") -> DataFrame:
    """(metric, value) of a classifier on the test split of rows (split, true, plain, tta): accuracy and macro F1 of both predictions, and each class's
    precision and recall of `tta`; a class that is nowhere counts with zeros."""
    held = written(rows.select("split", truth, "plain", "tta"), "predictions")
    test = held.filter("split = 'test'")
    share = lambda c: F.coalesce(rate(F.col(c) == F.col(truth)), F.lit(0.0))
    whole = held.agg(F.count("*").cast("double").alias("n_total"), F.count_if(F.col("split") == "test").cast("double").alias("n_test"))
    exact = test.agg(share("plain").alias("accuracy.plain"), share("tta").alias("accuracy.tta"))
    named = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in df.columns])).alias("m")).select("m.*")
    out = named(whole).union(named(exact))
    grid = held.sparkSession.createDataFrame([(c,) for c in classes], ["class"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for guess in ("plain", "tta"):
        each = grid.join(class_metrics(test, truth, guess), "class", "left")
        out = out.union(each.agg(F.avg(zero("f1")).alias("value")).select(F.lit(f"macro_f1.{guess}").alias("metric"), "value"))
        if guess == "tta":
            for m in ("precision", "recall"):
                out = out.union(each.select(F.concat(F.lit(f"{m}."), "class").alias("metric"), zero(m).alias("value")))
    return out


def security_trials(images: DataFrame, label: str, key: str, classes: tuple[str, ...], n: int, seed: int = 42) -> DataFrame:
    """n trials of each scenario: (scenario, turn, plate, true, registered, and the image's columns), classes in turn.

    legitimate: registered under its own colour; plate_swap: under another, drawn by a hash of seed and turn; unregistered: under none. Plates differ.
    """
    colours = F.array(*[F.lit(c) for c in classes])
    parts = []
    for k, scenario in enumerate(("legitimate", "plate_swap", "unregistered")):
        rows = round_robin(images, label, key, n, seed + k).withColumn("scenario", F.lit(scenario)).withColumn("true", F.col(label))
        others = F.array_except(colours, F.array("true"))
        draw = F.conv(F.substr(hash_order(F.concat(F.lit("other:"), F.col("turn").cast("string")), seed + k), F.lit(1), F.lit(8)), 16, 10).cast("long")
        registered = {"legitimate": F.col("true"), "plate_swap": F.get(others, F.pmod(draw, F.size(others)).cast("int")), "unregistered": F.lit(None).cast("string")}[scenario]
        parts.append(rows.withColumn("registered", registered).withColumn("plate", F.format_string(f"{30 + k}A%05d", "turn")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("round")


def security_report(trials: DataFrame, predicted: str, conf: str, gates: list[float], p: Params = DEFAULTS) -> DataFrame:
    """(metric, value): trials are registered, verified with the predicted colour, scored by scenario, and swept over the gates."""
    held = written(trials, "trials")
    registry = held.filter("registered is not null").select(F.col("plate").alias("license_plate"), F.col("registered").alias("car_color"), F.col("turn").alias("row_ord"))
    seen = written(R.verify(held.withColumn("plate_text", F.col("plate")).withColumn("color", F.col(predicted)).withColumn("color_conf", F.col(conf)), registry, p), "verified")
    of = lambda s: seen.filter(F.col("scenario") == s)
    parts = [(legitimate(of("legitimate")), "legitimate"), (swap_totals(of("plate_swap"), p.neutral), "plate_swap"), (unregistered(of("unregistered")), "unregistered")]
    named = lambda df, s: df.select(F.explode(F.array(*[F.struct(F.lit(f"{s}.{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*")
    out = named(*parts[0]).union(named(*parts[1])).union(named(*parts[2]))
    swept = seen.filter("registered is not null").select(F.when(F.col("scenario") == "plate_swap", "swap").otherwise("legitimate").alias("scenario"), F.upper("color").alias("predicted"), F.upper("registered").alias("registered"), F.col("color_conf").alias("conf"))
    for g in ("false_alarm_rate", "detection_rate"):
        out = out.union(gate_sweep(swept, gates, p.neutral).select(F.format_string(f"gate.%.2f.{g}", "gate").alias("metric"), F.col(g).alias("value")))
    return out


def deployment_gate(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """df (frozen_exact, expanded_exact, cer, candidate_p95, other_p95) with reasons against, and passed."""
    low = lambda c, bar, text: F.when(F.col(c) < bar, F.format_string(f"{text} %.4f is below {bar:.2f}", F.col(c)))
    slow = F.when(F.col("candidate_p95") >= F.col("other_p95"), F.format_string("candidate warm p95 latency %.2f ms is not lower than Paddle p95 %.2f ms", "candidate_p95", "other_p95"))
    reasons = F.array_compact(F.array(low("frozen_exact", p.frozen_exact, "frozen exact match"), low("expanded_exact", p.expanded_exact, "expanded exact match"), F.when(F.col("cer") > p.max_cer, F.format_string(f"combined CER %.4f exceeds {p.max_cer:.3f}", F.col("cer"))), slow))
    return df.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def calibrate(df: DataFrame, conf: str, correct: str, precision: float = 0.99) -> DataFrame:
    """(threshold, precision, coverage, support, total, available): the least observed confidence from which on the precision holds.

    Rows are first counted by confidence; sums run over the distinct values from the top, in range parts.
    """
    counts = df.filter(F.col(conf).between(0, 1)).groupBy(F.col(conf).alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("k"))
    run = running(counts, [-F.col("c")], {"support": "n", "hits": "k"})
    ok = run.filter(F.col("hits") / F.col("support") >= precision)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    best = ok.agg(F.min_by(F.struct("c", "support", "hits"), "c").alias("b"))
    return total.join(best, F.lit(True)).select(
        F.col("b.c").alias("threshold"), (F.col("b.hits") / F.col("b.support")).alias("precision"), F.coalesce(F.col("b.support") / F.col("total"), F.lit(0.0)).alias("coverage"),
        F.coalesce("b.support", F.lit(0)).alias("support"), "total", F.col("b").isNotNull().alias("available"),
    )


def best_checkpoint(df: DataFrame, keys: list[str]) -> DataFrame:
    """The checkpoint of most exact matches, then least CER, then the earliest."""
    return df.groupBy(*keys).agg(F.max_by("epoch", F.struct("exact", (-F.col("cer")).alias("c"), (-F.col("epoch")).alias("e"))).alias("epoch"))


def confusion(df: DataFrame, truth: str, guess: str, classes: list) -> DataFrame:
    """One row a true class, a column p_<class> for each guess, zeros filled in."""
    wide = df.groupBy(F.col(truth).alias("truth")).pivot(guess, classes).count()
    return wide.select("truth", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"p_{c}") for c in classes])


def class_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(class, support, precision, recall, f1); 0 where there's nothing to divide by. Pairs are counted once."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    each = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("g"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("k")), F.struct(F.col("g").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("k")))).alias("x")).select("x.*")
    s = each.groupBy("class").agg(F.sum("t").alias("support"), F.sum("g").alias("g"), F.sum("k").alias("k"))
    p, r = F.coalesce(F.col("k") / F.nullif(F.col("g"), F.lit(0)), F.lit(0.0)), F.coalesce(F.col("k") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    return s.select("class", "support", p.alias("precision"), r.alias("recall"), F.coalesce(2 * F.col("k") / F.nullif(F.col("g") + F.col("support"), F.lit(0)), F.lit(0.0)).alias("f1"))


def class_weights(df: DataFrame, label: str, classes: list) -> DataFrame:
    """(class, n, weight): inverse counts (of at least one) over their mean, for all classes."""
    spark = df.sparkSession
    all_classes = spark.createDataFrame([(c,) for c in classes], ["class"])
    counted = all_classes.join(df.groupBy(F.col(label).alias("class")).count(), "class", "left").select("class", F.coalesce("count", F.lit(0)).alias("n"))
    inverse = F.lit(1.0) / F.greatest(F.lit(1), F.col("n"))
    return counted.select("class", "n", (inverse / F.avg(inverse).over(W.partitionBy())).alias("weight"))


def band_counts(df: DataFrame, band: str, label: str | None = None) -> DataFrame:
    """(band, n, share) of all bands, zeros filled in, and distinct labels if asked for."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(b,) for b in BANDS], ["band"])
    extra = [F.count_distinct(label).alias("labels")] if label else []
    got = df.groupBy(F.col(band).alias("band")).agg(F.count("*").alias("n"), *extra)
    total = F.nullif(F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy()), F.lit(0))
    return bands.join(got, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.coalesce("n", F.lit(0)) / total, F.lit(0.0)).alias("share"), *([F.coalesce("labels", F.lit(0)).alias("labels")] if label else []))


def benchmark(df: DataFrame) -> DataFrame:
    """(candidate, n, accuracy, ms_per_row, per_second) of predictions with truth and guess and a latency in ms."""
    return df.groupBy("candidate").agg(F.count("*").alias("n"), rate(F.col("truth") == F.col("guess")).alias("accuracy"), F.avg("ms").alias("ms_per_row"), (F.lit(1000.0) / F.nullif(F.avg("ms"), F.lit(0.0))).alias("per_second"))


def near_certain(df: DataFrame, conf: str, least: float = 0.999) -> DataFrame:
    """Rows whose confidence leaves next to no doubt; sort them by it, greatest first, and by path."""
    return df.filter(F.col(conf) >= least)


def suspects(df: DataFrame, least: float = 0.80) -> DataFrame:
    """Confident predictions against the label, surest first."""
    return df.filter((F.col("pred_label") != F.col("true_label")) & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), "sample_id")
