"""Thresholds, ranking quality, calibration and lead time of scored windows.

Input rows: (keys..., host, window_id, window_start, y, score). Everything that
needs an order first collapses rows to one row per distinct score, so the ordered
part is small and runs over quantile chunks (see ``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ECE_BINS, FPR_BUDGETS, MIN_EPISODES_FOR_BAND, SEED, Grid
from ..functions.columns import floor_div, ratio
from ..functions.crypto import portable_hash
from .labels import closed_windows
from .ordered import ROWS_PER_CHUNK, by_shuffle, cumulative, exact_percentiles, per_key, row_numbers

MODEL_SPLIT = ["model", "split"]
HASH_BITS = 52


def score_histogram(scores: DataFrame, keys: list[str], column: str = "score") -> DataFrame:
    """Attack and benign row counts per distinct score."""
    return scores.groupBy(*keys, column).agg(
        F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))


def threshold_at_fpr(scores: DataFrame, keys: list[str], budgets=FPR_BUDGETS) -> DataFrame:
    """Lowest score whose benign share at or above it is within the budget, per key.

    Candidates are all distinct scores. If none fits, the threshold lies just above
    the highest score, so nothing alerts. A key without benign rows fails.
    """
    hist = cumulative(score_histogram(scores, keys), keys, "score", ["neg"], descending=True)
    n = F.sum(1 - F.col("y")).cast("long")
    checked = F.when(n > 0, n).otherwise(
        F.raise_error(F.lit("no benign rows: cannot set a threshold")).cast("long"))
    totals = scores.groupBy(*keys).agg(checked.alias("n_benign"))
    hist = hist.join(per_key(totals), keys) if keys else hist.withColumn("n_benign", totals.select("n_benign").scalar())
    fits = lambda b: F.col("cum_neg") / F.col("n_benign") <= F.lit(float(b))
    per = hist.groupBy(*keys).agg(
        F.max("n_benign").alias("n_benign"), F.max("score").alias("_max"),
        *[F.min(F.when(fits(b), F.struct("score", "cum_neg"))).alias(f"_t{i}") for i, b in enumerate(budgets)])
    above = F.col("_max") + F.greatest(F.abs("_max") * F.lit(2.3e-16), F.lit(5e-324))
    options = F.array(*[F.struct(
        F.lit(float(b)).alias("budget"), F.coalesce(F.col(f"_t{i}.score"), above).alias("threshold"),
        F.coalesce(F.col(f"_t{i}.cum_neg"), F.lit(0)).alias("n_false")) for i, b in enumerate(budgets)])
    return per.select(*keys, "n_benign", F.inline(options))


def operating_points(scores: DataFrame, keys: list[str], budgets=FPR_BUDGETS) -> DataFrame:
    """Per budget: threshold, the FPR it achieves, the finest FPR the rows can express."""
    t = threshold_at_fpr(scores, keys, budgets)
    finest = 1.0 / F.col("n_benign")
    return t.select(*keys, "budget", "threshold", "n_benign",
                    (F.col("n_false") / F.col("n_benign")).alias("achieved_fpr"),
                    finest.alias("finest_expressible_fpr"),
                    (F.col("budget") >= finest).cast("int").alias("budget_expressible"))


def with_rates(df: DataFrame) -> DataFrame:
    """precision, recall, f1, fpr and alert count from tp/fp/fn/tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                     ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"),
                     (tp + fp).alias("n_alerts"))


def classification(scores: DataFrame, thresholds: DataFrame, fit_keys: list[str],
                   by: list[str], tags: list[str]) -> DataFrame:
    """Confusion counts and rates per (by, tags) at given thresholds.

    ``thresholds`` holds one row per (fit_keys, tags), models times budgets whatever the
    scores table holds; it is broadcast.
    """
    t = thresholds.select(*fit_keys, *tags, "threshold")
    hist = score_histogram(scores, by)
    hit = F.col("score") >= F.col("threshold")
    part = hist.join(per_key(t), fit_keys)
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("long")
    out = part.groupBy(*by, *tags).agg(
        F.max("threshold").alias("threshold"), total("pos", hit).alias("tp"), total("neg", hit).alias("fp"),
        total("pos", ~hit).alias("fn"), total("neg", ~hit).alias("tn"))
    return with_rates(out)


def average_ranks(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Add the 1-based rank of each row's value, averaged over ties."""
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulative(counts, keys, column, ["_n"], prefix="_cum")
    rank = F.col("_cum_n") - F.col("_n") + (F.col("_n") + 1) / 2
    return df.join(cum.select(*keys, column, rank.alias(name)), [*keys, column])


def auroc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mann-Whitney AUROC with averaged ties; 0.5 when only one class is present."""
    hist = score_histogram(scores, keys).withColumn("n", F.col("pos") + F.col("neg"))
    cum = cumulative(hist, keys, "score", ["n"])
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    sums = cum.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"),
                                  F.sum(F.col("pos") * rank).alias("rank_sum"))
    p, q = F.col("p"), F.col("q")
    value = ratio(F.col("rank_sum") - p * (p + 1) / 2, p * q, 0.5)
    return sums.select(*keys, value.alias("auroc"), p.alias("n_attack"), (p + q).alias("n_rows"))


def score_bin(n_bins: int = ECE_BINS, column: str = "score") -> Column:
    """Equal-width bin by comparing with each inner edge (left-closed)."""
    step = 1.0 / n_bins
    return sum(((F.col(column) >= F.lit(i * step)).cast("int") for i in range(2, n_bins)),
               (F.col(column) >= F.lit(step)).cast("int"))


def reliability(scores: DataFrame, keys: list[str], n_bins: int = ECE_BINS) -> DataFrame:
    return scores.groupBy(*keys, score_bin(n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg("y").alias("accuracy"))


def calibration_error(scores: DataFrame, keys: list[str], n_bins: int = ECE_BINS) -> DataFrame:
    """Expected calibration error per key."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return reliability(scores, keys, n_bins).groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def first_alerts(alerts: DataFrame, episodes: DataFrame, grid: Grid, tags: list[str],
                 grace_seconds: int = 0) -> DataFrame:
    """Per (tags, episode) the first alert on its host within [start - grace, end].

    ``alerts`` must carry ``split`` and (host, window_id); repeats collapse first.
    """
    fired = alerts.select(*tags, "split", "host", "window_id").distinct()
    span = closed_windows(episodes, grid, grace_seconds=grace_seconds).select(
        "split", "host", "episode_no", "window_id")
    return (fired.join(by_shuffle(span), ["split", "host", "window_id"])
            .groupBy(*tags, "split", "host", "episode_no")
            .agg((F.min("window_id") * grid.stride_seconds).alias("first_alert")))


def lead_times(alerts: DataFrame, episodes: DataFrame, runs: DataFrame, grid: Grid, tags: list[str],
               grace_seconds: int = 0, undetected_seconds: float = 0.0) -> DataFrame:
    """Lead seconds of every episode for every run; undetected episodes stay, with 0.

    ``runs`` lists the (tags, split) combinations to report, also those without alerts.
    """
    first = first_alerts(alerts, episodes, grid, tags, grace_seconds)
    every = episodes.join(runs.select(*tags, "split").distinct(), "split")
    out = every.join(first, [*tags, "split", "host", "episode_no"], "left")
    lead = F.greatest(F.col("end_s") - F.col("first_alert"), F.lit(0)).cast("double")
    return out.select(*tags, "split", "host", "episode_no", "name", "start_s", "end_s", "first_alert",
                      F.coalesce(lead, F.lit(float(undetected_seconds))).alias("lead_seconds"),
                      F.col("first_alert").isNotNull().cast("int").alias("detected"))


def lead_summary(leads: DataFrame, tags: list[str]) -> DataFrame:
    """Median and quartiles over episodes (a timeline-sized table), detected / total."""
    return leads.groupBy(*tags, "split").agg(
        F.percentile("lead_seconds", F.lit(0.5)).alias("lead_median"),
        F.percentile("lead_seconds", F.lit(0.25)).alias("lead_q25"),
        F.percentile("lead_seconds", F.lit(0.75)).alias("lead_q75"),
        F.sum("detected").alias("episodes_detected"), F.count(F.lit(1)).alias("episodes_total"))


def alerts_per_host_day(n_alerts: Column, n_windows: Column, grid: Grid) -> Column:
    """Alerts per observed host-day: each host-window advances one stride."""
    days = n_windows * F.lit(grid.stride_seconds) / F.lit(86400.0)
    return ratio(n_alerts, days)


def alerts_at(scores: DataFrame, thresholds: DataFrame, fit_keys: list[str], tags: list[str]) -> DataFrame:
    """Rows that fire at each tag's threshold (threshold table as above)."""
    t = thresholds.select(*fit_keys, *tags, "threshold")
    return scores.join(per_key(t), fit_keys).filter(F.col("score") >= F.col("threshold"))


def evaluate(scores: DataFrame, episodes: DataFrame, grid: Grid, budgets=FPR_BUDGETS,
             fit_split: str = "val", eval_splits=("val", "test"), n_bins: int = ECE_BINS) -> DataFrame:
    """One row per (model, split, budget): the threshold fitted on val applied everywhere."""
    fitted = threshold_at_fpr(scores.filter(F.col("split") == fit_split), ["model"], budgets)
    rows = scores.filter(F.col("split").isin(list(eval_splits)))
    points = classification(rows, fitted, ["model"], MODEL_SPLIT, ["budget"])
    tags = ["model", "budget"]
    alerts = alerts_at(rows, fitted, ["model"], ["budget"])
    runs = points.select("model", "budget", "split")
    leads = lead_summary(lead_times(alerts, episodes, runs, grid, tags), tags)
    per_split = auroc(rows, MODEL_SPLIT).join(calibration_error(rows, MODEL_SPLIT, n_bins), MODEL_SPLIT)
    out = points.join(leads, ["model", "budget", "split"], "left").join(per_split, MODEL_SPLIT)
    return out.withColumn("alerts_per_host_day", alerts_per_host_day(F.col("n_alerts"), F.col("n_rows"), grid))


def dedup_host_windows(scores: DataFrame, keys: list[str], how: str = "max") -> DataFrame:
    """One row per (host, window) with its multiplicity."""
    if how not in ("max", "mean"):
        raise ValueError("how must be 'max' or 'mean'")
    pick = F.max("score") if how == "max" else F.avg("score")
    return scores.groupBy(*keys, "host", "window_id").agg(
        pick.alias("score"), F.max("y").alias("y"), F.count(F.lit(1)).alias("multiplicity"))


def multiplicity_report(scores: DataFrame, keys: list[str]) -> DataFrame:
    return dedup_host_windows(scores, keys).groupBy(*keys, "y").agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("multiplicity").alias("mean_rows"),
        F.max("multiplicity").alias("max_rows"))


def hash_order(df: DataFrame, keys: list[str], seed, id_cols: list[str], name: str = "row_no",
               rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Number the rows of each key in a seeded pseudo-random order, over uniform hash chunks whose number grows with the rows."""
    size = df.select(F.greatest(F.lit(128), F.ceil(F.count(F.lit(1)) / F.lit(rows_per_chunk)))).scalar()
    df = df.withColumn("_h", portable_hash(seed, *id_cols))
    chunk = F.floor(F.col("_h") / (F.lit(float(1 << HASH_BITS)) / size)).cast("long")
    return row_numbers(df, keys, chunk, [F.col("_h"), *[F.col(c) for c in id_cols]], name).drop("_h")


def random_baseline(scores: DataFrame, budget_per_key: DataFrame, keys: list[str], seed=SEED) -> DataFrame:
    """Fire the same number of alerts at random rows (``n_alerts`` per key)."""
    numbered = hash_order(scores, keys, seed, ["host", "window_id"])
    return numbered.join(per_key(budget_per_key.select(*keys, "n_alerts")), keys).filter(
        F.col("row_no") <= F.col("n_alerts")).drop("n_alerts", "row_no")


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation of two score columns per key."""
    ranked = average_ranks(average_ranks(rows, keys, a, "_ra"), keys, b, "_rb")
    return ranked.groupBy(*keys).agg(F.corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def per_episode_report(scores: DataFrame, episodes: DataFrame, threshold: DataFrame, grid: Grid) -> DataFrame:
    """Windows in each episode, how many fired, when first, lead, highest score."""
    span = closed_windows(episodes, grid).select("split", "host", "episode_no", "start_s", "end_s", "window_id")
    key = ["model", "split", "host", "episode_no", "start_s", "end_s"]
    inside = scores.join(by_shuffle(span), ["split", "host", "window_id"]).join(
        per_key(threshold.select("model", "threshold")), "model")
    fired = F.col("score") >= F.col("threshold")
    per = inside.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(fired).alias("n_fired"),
        F.min(F.when(fired, F.col("window_start"))).alias("_first"), F.max("score").alias("max_score"))
    return per.select(*key, "n_windows", "n_fired", (F.col("_first") - F.col("start_s")).alias("first_offset"),
                      (F.col("end_s") - F.col("_first")).alias("lead_seconds"), "max_score")


def threshold_transfer(scores: DataFrame, episodes: DataFrame, grid: Grid, budgets=FPR_BUDGETS,
                       fit_split: str = "val", test_split: str = "test") -> DataFrame:
    """What the val threshold gives on test against a threshold fitted on test itself."""
    policies = [("shipped", fit_split), ("oracle", test_split)]
    fitted = None
    for policy, split in policies:
        t = threshold_at_fpr(scores.filter(F.col("split") == split), ["model"], budgets).withColumn(
            "policy", F.lit(policy))
        fitted = t if fitted is None else fitted.unionByName(t)
    rows, tags = scores.filter(F.col("split") == test_split), ["policy", "budget"]
    points = classification(rows, fitted, ["model"], MODEL_SPLIT, tags)
    mtags = ["model", *tags]
    leads = lead_summary(lead_times(alerts_at(rows, fitted, ["model"], tags), episodes,
                                    points.select(*mtags, "split"), grid, mtags), mtags)
    both = points.join(leads, [*mtags, "split"], "left")
    pick = lambda c, p: F.max(F.when(F.col("policy") == p, F.col(c)))
    cols = ["threshold", "recall", "fpr", "episodes_detected", "lead_median"]
    wide = both.groupBy("model", "budget").agg(*[
        pick(c, p).alias(f"{c}_{p}") for p, _ in policies for c in cols])
    gap = ((F.col("episodes_detected_oracle") > F.col("episodes_detected_shipped"))
           | (F.col("recall_oracle") > F.col("recall_shipped") + 0.05))
    return wide.select("*", (F.col("threshold_shipped") / F.greatest("threshold_oracle", F.lit(1e-12))).alias("ratio"),
                       F.when(gap, "TRANSFER GAP").otherwise("transfers OK").alias("verdict"))


def score_distribution(scores: DataFrame, keys: list[str]) -> DataFrame:
    """min / max / mean / median / p99 of the score per key, exact at any size."""
    basic = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("min"),
                                      F.max("score").alias("max"), F.avg("score").alias("mean"))
    return basic.join(exact_percentiles(scores, keys, "score", {"median": 0.5, "p99": 0.99}), keys)


def confusion_from_rates(results: DataFrame) -> DataFrame:
    """Rebuild tp/fp/fn/tn from recall, alert count and row counts; add accuracy."""
    pos, n = F.col("n_attack"), F.col("n_rows")
    tp = F.rint(F.col("recall") * pos).cast("long")
    keep = [c for c in results.columns if c in ("model", "split", "budget")]
    base = results.select(*keep, tp.alias("tp"), (F.col("n_alerts") - tp).alias("fp"), (pos - tp).alias("fn"),
                          (n - pos - (F.col("n_alerts") - tp)).alias("tn"))
    out = with_rates(base)
    return out.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"),
                                            F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def comparison_table(results: DataFrame, budget: float, split: str,
                     min_episodes: int = MIN_EPISODES_FOR_BAND) -> DataFrame:
    """One row per model at one budget; a quantile band only with enough episodes."""
    if split not in ("val", "test"):
        raise ValueError("split must be 'val' or 'test'")
    rows = results.filter((F.col("budget") == budget) & (F.col("split") == split))
    band = F.col("episodes_total") >= min_episodes
    return rows.select(
        "model", "split", "f1", "precision", "recall", F.col("fpr").alias("fpr_achieved"), "auroc", "ece",
        "lead_median", F.when(band, F.col("lead_q25")).alias("lead_q25"),
        F.when(band, F.col("lead_q75")).alias("lead_q75"), "episodes_detected", "episodes_total",
        "alerts_per_host_day").orderBy(F.col("lead_median").desc_nulls_last(), "model")


def split_gap_table(results: DataFrame, budget: float) -> DataFrame:
    """val, test and their gap per model; a gap needs both sides."""
    cols = ["f1", "recall", "auroc", "lead_median"]
    rows = results.filter((F.col("budget") == budget) & F.col("split").isin("val", "test"))
    side = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c)))
    wide = rows.groupBy("model").agg(
        F.count_distinct("split").alias("_sides"),
        *[side(c, s).alias(f"{s}_{c}") for c in cols for s in ("val", "test")]).filter("_sides = 2")
    return wide.select("model", *[f"{s}_{c}" for c in cols for s in ("val", "test")],
                       *[(F.col(f"test_{c}") - F.col(f"val_{c}")).alias(f"gap_{c}") for c in cols]
                       ).orderBy(F.col("test_lead_median").desc_nulls_last(), "model")


def select_by_validation(results: DataFrame, shipped: str, budget: float) -> DataFrame:
    """Candidates against the shipped model: promoted only if val AUROC is higher."""
    wide = (results.filter(F.col("budget") == budget).groupBy("model").agg(
        F.max(F.when(F.col("split") == "val", F.col("auroc"))).alias("val_auroc"),
        F.max(F.when(F.col("split") == "test", F.col("auroc"))).alias("test_auroc")))
    bar = wide.filter(F.col("model") == shipped).agg(F.max("val_auroc")).scalar()
    return wide.filter(F.col("model") != shipped).withColumn("bar", bar).withColumn(
        "promote", F.coalesce((F.col("val_auroc") > F.col("bar")).cast("int"), F.lit(0)))
