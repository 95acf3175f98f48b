"""Why customers come back: population, sampling, clustering and label evaluation."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions import timefns as T
from ..functions import variants as V
from ..session import written
from .scale import own_exchange
from .weekly import by_definition


SEGMENTS = ("initial_user_text", "initial_ai_text", "followup_user_text")


def trace_texts(raw: DataFrame) -> DataFrame:
    """Free texts and known identifying values of each trace."""
    values = [V.filled_string_at(F.col("input"), V.path_of("other_info", "meta", k)) for k in K.KNOWN_META_KEYS]
    filled = lambda c: X.let(c, lambda t: F.when(t.rlike(r"(?U)\S"), t))
    return raw.select(
        F.col("id").alias("trace_id"), F.col("sessionId").alias("session_id"),
        filled(V.string_at(F.col("input"), "$.user_input")).alias("user_text"), filled(V.string_at(F.col("output"), "$.response")).alias("ai_text"),
        F.array_compact(F.array(*values)).alias("known_values"))


def reopen_keys(sessions: DataFrame, traces: DataFrame) -> DataFrame:
    """Eligible tickets with their first trace and first later trace within 168 hours."""
    eligible = sessions.where("ai_first and reopen_within_7d = 1 and outcome in ('ai_end_to_end', 'ai_then_cs') and data_quality = 'valid'")
    marks = eligible.select(own_exchange("session_id").alias("__key"), F.col("turn0_trace_id").alias("anchor_trace_id"), "turn0_ts")
    rows = traces.select(own_exchange("session_id").alias("__key"), "session_id", "turn", "ts", "trace_id")
    hits = rows.join(marks, "__key").where((F.col("trace_id") != F.col("anchor_trace_id")) & T.within_reopen_window(F.col("ts"), F.col("turn0_ts")))
    first = hits.groupBy("session_id").agg(F.min(F.struct("turn", "ts", "trace_id")).alias("f"))
    keep = eligible.select("session_id", F.col("turn0_trace_id").alias("anchor_trace_id"), F.col("cohort_week").alias("week"),
                           F.col("issue_category").alias("domain"), "outcome")
    return keep.join(first.select("session_id", F.col("f.trace_id").alias("followup_trace_id")), "session_id", "left")


def occurring_values(values: DataFrame, triples: DataFrame) -> DataFrame:
    """(session_id, value): the known values that occur in one of their ticket's texts u0, a0, u1.

    Values are rows, never an array of a ticket: each is met with its ticket's one row of texts and kept
    if it is found there. A ticket with very many traces has very many values on one side of the join
    and one row on the other, so AQE may split it over tasks.
    """
    distinct = values.where("value <> ''").groupBy("session_id", "value").agg(F.lit(1).alias("__one")).drop("__one")
    texts = triples.select(own_exchange("session_id").alias("__key"), "u0", "a0", "u1")
    met = distinct.withColumn("__key", own_exchange("session_id")).join(texts, "__key")
    return met.where(F.contains("u0", "value") | F.contains("a0", "value") | F.contains("u1", "value")).select("session_id", "value")


def reopen_population(sessions: DataFrame, traces: DataFrame, texts: DataFrame) -> DataFrame:
    """Masked text triples per eligible ticket; tickets without one of the texts have complete = false.

    Two traces a ticket are picked first, and only their texts are joined. The known values of all its
    traces are masked together, longest first; those that occur in none of the texts are gone before
    anything is collected, so what is collected is bounded by the texts.
    """
    keys = reopen_keys(sessions, traces)
    wanted = keys.select("session_id", F.explode(F.array(
        F.struct(F.lit(0).alias("role"), F.col("anchor_trace_id").alias("trace_id")), F.struct(F.lit(1).alias("role"), F.col("followup_trace_id").alias("trace_id")))).alias("w"))
    wanted = wanted.select("session_id", "w.role", "w.trace_id").where("trace_id is not null")
    rows = texts.select("session_id", "trace_id", "user_text", "ai_text").join(wanted, ["session_id", "trace_id"])
    text_of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    triples = rows.groupBy("session_id").agg(text_of(0, "user_text").alias("u0"), text_of(0, "ai_text").alias("a0"), text_of(1, "user_text").alias("u1"))
    complete = triples.where("u0 is not null and a0 is not null and u1 is not null")

    marks = complete.select(own_exchange("session_id").alias("__key"))
    values = texts.select("session_id", own_exchange("session_id").alias("__key"), F.explode("known_values").alias("value")).join(marks, "__key", "left_semi")
    known = occurring_values(values, complete).groupBy("session_id").agg(F.collect_list("value").alias("known"))
    found = complete.join(known, "session_id", "left")
    values_of = F.coalesce("known", F.array().cast("array<string>"))
    masked = found.select("session_id", F.lit(True).alias("complete"), *[X.mask_text(F.col(c), values_of).alias(n) for n, c in zip(SEGMENTS, ("u0", "a0", "u1"))])
    return keys.join(masked, "session_id", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def control_rate(sessions: DataFrame) -> DataFrame:
    value = F.col("control_reopen_within_7d")
    return sessions.where("outcome = 'direct_cs'").agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("numerator"), F.count(value).alias("denominator")).withColumn(
        "rate", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator")))


# ---- clustering ---------------------------------------------------------------------------


def normalize_vectors(vectors: DataFrame) -> DataFrame:
    """Unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    staged = vectors.withColumn("__n", norm)
    unit = F.when(F.col("__n") > 0, F.transform("vector", lambda x: x / F.col("__n"))).otherwise(F.transform("vector", lambda x: F.lit(0.0)))
    return staged.withColumn("vector", unit).drop("__n")


def _assigner(centroids: list[list[float]]):
    """Arrow function: index of the closest centroid, the lower index on ties."""
    points = np.asarray(centroids, dtype=float)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="int32")
        return pd.Series((1.0 - np.stack(vectors.to_numpy()) @ points.T).argmin(axis=1).astype("int32"))

    return nearest(F.col("vector"))


def _round(rows: DataFrame, fits: dict[int, tuple[list, list | None]]) -> dict[int, tuple[dict, dict, int]]:
    """One pass for all unfinished fits (k: centroids, centroids before): vector sum and size per
    cluster, and how many rows changed their cluster.

    Every batch is reduced to at most k sums per fit inside the task, Spark adds those up, and k
    vectors per fit reach the driver.
    """
    points = {k: (np.asarray(now, dtype=float), None if old is None else np.asarray(old, dtype=float)) for k, (now, old) in fits.items()}

    def reduce_batches(batches):
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["vector"].to_numpy())
            for k, (now, old) in points.items():
                c = (1.0 - x @ now.T).argmin(axis=1)
                moved = np.ones(len(c), bool) if old is None else (1.0 - x @ old.T).argmin(axis=1) != c
                found = np.unique(c)
                yield pd.DataFrame({"k": k, "c": found, "n": [int((c == i).sum()) for i in found], "moved": [int(moved[c == i].sum()) for i in found], "s": [x[c == i].sum(axis=0) for i in found]})

    parts = rows.select("vector").mapInPandas(reduce_batches, "k int, c int, n long, moved long, s array<double>")
    spread = parts.select("k", "c", "n", "moved", F.posexplode("s").alias("i", "x"))
    added = spread.groupBy("k", "c", "i").agg(F.sum("x").alias("s"), F.sum("n").alias("n"), F.sum("moved").alias("moved"))
    packed = added.groupBy("k", "c").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"), F.max("n").alias("n"), F.max("moved").alias("moved")).collect()
    out = {k: ({}, {}, 0) for k in fits}
    for r in packed:
        totals, sizes, moved = out[r["k"]]
        totals[r["c"]], sizes[r["c"]] = [x["s"] for x in r["s"]], r["n"]
        out[r["k"]] = (totals, sizes, moved + r["moved"])
    return out


def _unit(total: list[float], n: int) -> list[float]:
    mean = [x / n for x in total]
    length = sum(x * x for x in mean) ** 0.5
    return [x / length for x in mean] if length else [0.0] * len(mean)


def fit_all(unit_vectors: DataFrame, counts: list[int], rounds: int = 50) -> dict[int, list[list[float]]]:
    """Cosine k-means for several cluster counts in shared passes, from the first k vectors by id.

    A fit stops when no row changes its cluster; an empty cluster keeps its centroid. Only centroids
    live on the driver.
    """
    first = [list(r["vector"]) for r in unit_vectors.orderBy("id").limit(max(counts)).collect()]
    open_fits: dict[int, tuple[list, list | None]] = {k: (first[:k], None) for k in counts}
    used: dict[int, list[list[float]]] = {}
    for _ in range(rounds):
        if not open_fits:
            break
        for k, (totals, sizes, moved) in _round(unit_vectors, open_fits).items():
            now, before = open_fits[k]
            used[k] = now
            if before is not None and moved == 0:
                del open_fits[k]
            else:
                open_fits[k] = ([_unit(totals[c], sizes[c]) if c in totals else now[c] for c in range(len(now))], now)
    return used


def fit_centroids(unit_vectors: DataFrame, k: int, rounds: int = 50) -> list[list[float]]:
    return fit_all(unit_vectors, [k], rounds)[k]


def kmeans_cosine(unit_vectors: DataFrame, k: int) -> DataFrame:
    unit_vectors = written(unit_vectors, "unit-vectors")  # every round reads them again
    centroids = fit_centroids(unit_vectors, k)
    return unit_vectors.select("id", _assigner(centroids).alias("cluster_id"), "vector")


def silhouette_rows(assigned: DataFrame) -> DataFrame:
    """Exact cosine silhouette per row from cluster sums: linear in rows, no pairs.

    With S the sum of a cluster's n vectors, the mean distance of x to another cluster is
    1 - x.S/n, and to its own cluster (n - x.S - (1 - x.x)) / (n - 1).
    """
    parts = assigned.select("cluster_id", F.posexplode("vector").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    packed = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("s"), F.max("n").alias("n")).orderBy("cluster_id").collect()
    if len(packed) < 2:
        return assigned.select("id", "cluster_id", F.lit(None).cast("double").alias("silhouette"))
    ids = np.array([r["cluster_id"] for r in packed])
    sums, sizes = np.array([[x["s"] for x in r["s"]] for r in packed]), np.array([r["n"] for r in packed], dtype=float)

    @F.pandas_udf("double")
    def score(vectors: pd.Series, clusters: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="float64")
        x = np.stack(vectors.to_numpy())
        own = np.searchsorted(ids, clusters.to_numpy())
        dots, rows = x @ sums.T, np.arange(len(x))
        n = sizes[own]
        a = (n - dots[rows, own] - (1.0 - (x * x).sum(axis=1))) / np.where(n > 1, n - 1, 1)
        others = 1.0 - dots / sizes
        others[rows, own] = np.inf
        b = others.min(axis=1)
        top = np.maximum(a, b)
        return pd.Series(np.where((n == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top)))

    return assigned.select("id", "cluster_id", score("vector", "cluster_id").alias("silhouette"))


def silhouette_cosine(assigned: DataFrame) -> DataFrame:
    return silhouette_rows(assigned).agg(F.avg("silhouette").alias("silhouette"), F.count_distinct("cluster_id").alias("clusters"))


def select_k(vectors: DataFrame, low: int = 5, high: int = 15) -> DataFrame:
    """Clusters with the best silhouette over the candidate counts, the smaller count on ties.
    Counts that end with fewer real clusters are skipped; tiny inputs are one cluster."""
    unit = written(normalize_vectors(vectors), "unit-vectors")
    n = unit.count()
    best: tuple[float, int, list[list[float]]] | None = None
    if n >= low + 1:
        for k, centroids in sorted(fit_all(unit, list(range(low, min(high, n - 1) + 1))).items()):
            row = silhouette_cosine(unit.select("id", _assigner(centroids).alias("cluster_id"), "vector")).first()
            if row["clusters"] == k and row["silhouette"] is not None and (best is None or row["silhouette"] > best[0]):
                best = (row["silhouette"], k, centroids)
    if best is None:
        return unit.select("id", F.lit(0).alias("cluster_id"), F.lit(1).alias("k"), F.lit(None).cast("double").alias("score"))
    return unit.select("id", _assigner(best[2]).alias("cluster_id"), F.lit(best[1]).alias("k"), F.lit(best[0]).alias("score"))


# ---- sampling -----------------------------------------------------------------------------


def round_robin_sample(rows: DataFrame, strata: list[str], key: str, cap: int = K.SAMPLE_CAP) -> DataFrame:
    """One row per stratum and round, up to the cap. Fails when the strata alone exceed it.

    Only the first `cap` rows of a stratum can be chosen, so Spark drops the others before the
    shuffle (limit per group), whatever the stratum's size.
    """
    groups = rows.select(*strata).distinct().agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*strata).orderBy(key)
    ranked = rows.withColumn("round", F.row_number().over(order)).where(F.col("round") <= cap)
    fits = F.when(groups.scalar() > cap, F.raise_error(F.lit("more strata than the sample may hold")).cast("boolean")).otherwise(True)
    return ranked.where(fits).orderBy("round", *strata).limit(cap)


def saturation_stop(reasons: DataFrame, position: str, batch: int = K.REASON_BATCH, minimum_rows: int = 0) -> DataFrame:
    """Rows kept before two batches in a row add no new normalised reason.

    First occurrences are a minimum per reason and new batches a distinct set; a stop needs two
    neighbouring batches outside that set, found by joins on the batch number.
    """
    number = F.floor(F.col(position) / batch)
    rows = reasons.withColumn("batch", number)
    normal = X.casefold(X.collapse_spaces(F.col("reason")))
    first = rows.withColumn("__r", normal).groupBy("__r").agg(F.min("batch").alias("batch"))
    fresh = first.select("batch").distinct()
    stale = rows.groupBy("batch").agg(F.max(F.col(position)).alias("last")).join(fresh, "batch", "left_anti")
    previous = stale.select((F.col("batch") + 1).alias("batch"))
    stop = stale.join(previous, "batch").where(F.col("last") + 1 >= minimum_rows).agg(F.min("batch").alias("stop"))
    return rows.where(F.col("batch") <= F.coalesce(stop.scalar(), F.col("batch")))


def pii_review_sample(population: DataFrame, limit: int = K.REVIEW_LIMIT) -> DataFrame:
    """Three masked segments per ticket in stable order, up to the review limit."""
    items = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(s).alias("segment"),
                               F.col("followup_trace_id" if s == "followup_user_text" else "anchor_trace_id").alias("trace_id"), F.col(s).alias("masked_text"))
                      for i, s in enumerate(SEGMENTS)])
    rows = population.where("complete").select("session_id", F.explode(items).alias("s")).select("session_id", "s.*")
    return rows.orderBy("session_id", "part").limit(min(limit, K.REVIEW_LIMIT)).drop("part")


def unmasked_review_rows(rows: DataFrame) -> DataFrame:
    """Rows that masking would still change: must be empty before a review table is written."""
    return rows.where(X.mask_text(F.col("masked_text")) != F.col("masked_text"))


def disjoint_sample_pool(population: DataFrame, discovery: DataFrame) -> DataFrame:
    order = ["session_id", *[c for c in ("week", "domain", "outcome", "anchor_trace_id", "followup_trace_id") if c in population.columns]]
    pool = population.join(discovery.select("session_id").distinct(), "session_id", "left_anti")
    best = pool.groupBy("session_id").agg(F.min(F.struct(*order)).alias("b"))
    return best.select("b.*")


def golden_sample(pool: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n rows, about fifteen percent of them hidden duplicates, with opaque ids, in shuffled order."""
    duplicates = min(n // 2, int(n * 0.15 + 0.5))
    rank = lambda tag: F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), "session_id"), 256)
    primary = pool.orderBy(rank("pick"), "session_id").limit(n - duplicates)
    marked = primary.orderBy(rank("again"), "session_id").limit(duplicates).select("session_id", F.lit(True).alias("__again"))
    rows = primary.join(marked, "session_id", "left")
    group = F.when(F.col("__again"), F.substring(rank("group"), 1, 24))
    row_id = F.substring(rank("row"), 1, 24)
    first = rows.select("*", row_id.alias("row_id"), group.alias("duplicate_group_id"), F.lit(None).cast("string").alias("duplicate_source_row_id"))
    second = rows.where("__again").select("*", F.substring(rank("copy"), 1, 24).alias("row_id"), group.alias("duplicate_group_id"), row_id.alias("duplicate_source_row_id"))
    return first.unionByName(second).drop("__again").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffle"), "row_id"), 256))


# ---- labels -------------------------------------------------------------------------------


def label_todo(sessions: DataFrame, labels: DataFrame, labels_version: str, prompt_version: str) -> DataFrame:
    done = labels.where((F.col("labels_version") == labels_version) & (F.col("prompt_version") == prompt_version)).select("session_id").distinct()
    return sessions.select("session_id").join(done, "session_id", "left_anti")


def label_status(rows: DataFrame, allowed: tuple[str, ...] = K.REOPEN_LABELS) -> DataFrame:
    """labeled / abstained / invalid / failed from a model answer (label, quote, error)."""
    label, quote = F.col("label"), F.col("quote")
    is_abstain = label == K.ABSTAIN_LABEL
    quoted = F.coalesce(~X.is_blank(quote), F.lit(False))
    status = (
        F.when(F.coalesce(F.col("error"), F.lit(False)), "failed").when(label.isNull(), "invalid")
        .when(is_abstain & quoted, "abstained").when(is_abstain, "invalid").when(label.isin(*allowed), "labeled").otherwise("invalid")
    )
    return rows.withColumn("status", status)


def label_batch_stats(rows: DataFrame, cached: Column) -> DataFrame:
    return label_status(rows).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("labeled", "abstained", "invalid", "failed")], F.count_if(cached).alias("cached"))


def reopen_reason_rollup(labels: DataFrame, sessions: DataFrame) -> DataFrame:
    """Label x outcome x business counts of labelled reopen tickets per definition and week."""
    keep = sessions.select("session_id", "cohort_week", "is_weekend_start", "outcome", X.safe_dimension(F.col("issue_category")).alias("business"))
    rows = labels.where("label is not null").select("session_id", "label").join(keep, "session_id")
    fine = rows.groupBy("cohort_week", "is_weekend_start", "label", "outcome", "business").agg(F.count(F.lit(1)).alias("count"))
    return by_definition(fine).groupBy("week_definition", "cohort_week", "label", "outcome", "business").agg(F.sum("count").alias("count"))


def reopen_reason_coverage(labels: DataFrame, sessions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Population, label states and the direct-CS control rate, which is null for immature weeks."""
    status = labels.select("session_id", "status")
    eligible = F.expr("ai_first and reopen_within_7d = 1 and outcome in ('ai_end_to_end', 'ai_then_cs') and data_quality = 'valid'")
    rows = sessions.join(status, "session_id", "left")
    fine = rows.groupBy("cohort_week", "is_weekend_start").agg(
        F.count_if(F.coalesce(eligible, F.lit(False))).alias("population"),
        F.count_if(F.col("status").isin("labeled", "abstained")).alias("labeled"), F.count_if(F.col("status") == "abstained").alias("abstained"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "invalid").alias("invalid"),
        F.coalesce(F.sum("control_reopen_within_7d"), F.lit(0)).alias("__num"), F.count("control_reopen_within_7d").alias("__den"))
    names = ["population", "labeled", "abstained", "failed", "invalid", "__num", "__den"]
    weekly = by_definition(fine).groupBy("week_definition", "cohort_week").agg(*[F.sum(n).alias(n) for n in names])
    joined = calendar.select("week_definition", "cohort_week", "mature").join(weekly, ["week_definition", "cohort_week"], "left")
    joined = joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    return joined.select(
        "week_definition", "cohort_week", *names[:5],
        F.when(F.col("mature") & (F.col("__den") > 0), F.col("__num") / F.col("__den")).alias("direct_cs_reopen_7d_rate"),
        F.when(F.col("mature"), F.col("__den")).otherwise(0).alias("direct_cs_denominator"))


def human_consistency(rows: DataFrame) -> DataFrame:
    """Share of duplicate pairs that people labelled the same way."""
    pairs = rows.where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(
        (F.min("human_label") == F.max("human_label")).alias("same"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("same").cast("double")).alias("human_consistency"))


def _evaluated(rows: DataFrame) -> DataFrame:
    return rows.where("duplicate_source_row_id is null")


def confusion_matrix(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Every label against every label, zeros included."""
    counts = _evaluated(rows).groupBy("human_label", "prediction").agg(F.count(F.lit(1)).alias("count"))
    pairs = [(a, b) for a in labels for b in labels]
    grid = rows.sparkSession.createDataFrame(pairs, "human_label string, prediction string")
    return grid.join(counts, ["human_label", "prediction"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def label_metrics(matrix: DataFrame) -> DataFrame:
    spread = matrix.select(F.explode(F.array(
        F.struct(F.col("human_label").alias("label"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("count").alias("predicted"),
                 F.when(F.col("human_label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hit")))).alias("m"))
    sums = spread.groupBy("m.label").agg(F.sum("m.support").alias("support"), F.sum("m.hit").alias("true_positive"), F.sum("m.predicted").alias("predicted"))
    recall = F.when(F.col("support") > 0, F.col("true_positive") / F.col("support"))
    verified = F.col("support") >= 10
    return sums.select(
        "*", recall.alias("recall"), F.when(F.col("predicted") > 0, F.col("true_positive") / F.col("predicted")).alias("precision"),
        verified.alias("verified"), F.when(verified, recall >= 0.60).alias("passes_gate"))


def eval_labels(rows: DataFrame, labels: list[str], abstain: str) -> DataFrame:
    """One row: consistency first, then accuracy, recall and abstention gates."""
    matrix = confusion_matrix(rows, labels)
    metrics = label_metrics(matrix)
    total = F.sum("count")
    overall = matrix.agg(
        total.alias("model_denominator"), (F.sum(F.when(F.col("human_label") == F.col("prediction"), F.col("count")).otherwise(0)) / total).alias("accuracy"),
        (F.sum(F.when(F.col("prediction") == abstain, F.col("count")).otherwise(0)) / total).alias("abstention"))
    failed = metrics.agg(F.count_if(~F.col("passes_gate")).alias("failed"))
    human = human_consistency(rows).select("human_consistency")
    staged = overall.select("*", human.scalar().alias("human_consistency"), failed.scalar().alias("failed_recalls"))
    good = F.col("human_consistency") >= 0.85
    gate = good & (F.col("accuracy") >= 0.80) & (F.col("failed_recalls") == 0) & (F.col("abstention") <= 0.15)
    return staged.select(
        F.when(good, "evaluated").otherwise("human_consistency_failed").alias("status"), "human_consistency", "model_denominator",
        F.when(good, F.col("accuracy")).alias("overall_accuracy"), F.when(good, F.col("abstention")).alias("abstention_rate"),
        F.coalesce(gate, F.lit(False)).alias("gate_passed"))
