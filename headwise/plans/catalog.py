"""Registered queries: every operator over the whole test tables.

Each takes (spark, folder) and returns a DataFrame with zone-less timestamps.
Doubles that depend on summation order or on library math are rounded.
"""
from datetime import datetime, timezone

from pyspark.sql import functions as F

from headwise.functions import clock, geo, hashing, scoring
from headwise.operators import aggregates, drift, filters, joins, online, ranking, shadow, windows
from headwise.plans import serve
from headwise.plans.cycles import score_cycle
from headwise.session import prepare, work_path, write_and_read
from headwise.sources import feeds, model_state, scores as scores_io, star_tables, static_files, telemetry
from headwise.streaming import headways, ingest, runs, scoring as stream_scoring, summaries

QUERIES = {}

WEEK = "168h"
DAY = "24h"


def query(name):
    def register(function):
        def run(spark, folder):
            return clock.naive(function(prepare(spark), folder))
        QUERIES[name] = run
        return run
    return register


def rounded(df, digits=6, columns=None):
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def _raw(spark, folder):
    return star_tables.raw_scores(spark, folder)


def _served(spark, folder):
    return star_tables.served_scores(spark, folder)


def _arrivals(spark, folder):
    return feeds.feed_flatten(star_tables.snapshots(spark, folder))


def _earliest(spark, folder):
    return aggregates.earliest_arrival(filters.arrival_horizon_filter(_arrivals(spark, folder)))


def _landed(spark, folder):
    """Snapshots as JSON lines on disk, with truncated extra lines among them."""
    lines = feeds.snapshot_lines(star_tables.snapshots(spark, folder))
    cut = lines.where(F.pmod(F.xxhash64("value"), F.lit(97)) == 0)
    landing = work_path(spark, "landing")
    feeds.land_snapshots(lines.unionByName(cut.withColumn("value", F.substring("value", 1, 60))), landing)
    return landing


def _newest(scores, later="0"):
    return scores.agg(F.max("observed_ts")).scalar() + F.expr(f"INTERVAL '{later}' SECOND")


# Sources and sinks

@query("feed_flatten")
def _(spark, folder):
    return _arrivals(spark, folder)


@query("feed_union")
def _(spark, folder):
    return feeds.feed_flatten(feeds.feed_union(spark, _landed(spark, folder)))


@query("feed_stream_source")
def _(spark, folder):
    return runs.drain(feeds.feed_flatten(feeds.feed_stream(spark, _landed(spark, folder))), "feed-stream")


@query("scores_append")
def _(spark, folder):
    rows = ingest.headways_from_snapshots(star_tables.snapshots(spark, folder))
    path = work_path(spark, "scores")
    scores_io.append_scores(scores_io.as_scores(rows), path, clustered=True)
    return scores_io.read_scores(spark, path).select(
        "id", "observed_ts", "event_ts", "route_id", "stop_id", "headway_sec",
        "predicted_headway_sec", "anomaly_score", "residual", "window_sec",
        F.col("observed_date").cast("string").alias("observed_date"),
    )


@query("scores_update")
def _(spark, folder):
    base = _raw(spark, folder).withColumn("window_sec", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 200))
    fresh = _served(spark, folder).where("predicted_headway_sec is not null")
    vanished = fresh.withColumn("id", -F.col("id") - 1)
    return scores_io.scores_update(base, fresh.unionByName(vanished)).select(
        "id", "predicted_headway_sec", "residual", "anomaly_score", "window_sec"
    )


@query("stops_load")
def _(spark, folder):
    path = work_path(spark, "stops")
    star_tables.stops_csv_rows(spark, folder).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(path)
    return static_files.stops_load(spark, path).select(
        "stop_id", "stop_name", "lat", "lon", F.size("routes").alias("n_routes")
    )


@query("routes_static_load")
def _(spark, folder):
    path = work_path(spark, "routes")
    star_tables.routes_csv_rows(spark, folder).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return static_files.routes_static_load(spark, path)


def _online_telemetry(spark, folder):
    raw = _raw(spark, folder)
    # Written: the backlog and the telemetry both read what one run scored.
    scored = write_and_read(online.score_online(raw), "scored")
    left = aggregates.unscored_backlog(scores_io.scores_update(raw, scored))
    return online.telemetry_online(scored, left, serve.run_stamp(_newest(raw)))


@query("telemetry_write")
def _(spark, folder):
    path = work_path(spark, "telemetry")
    telemetry.telemetry_write(_online_telemetry(spark, folder), path)
    return rounded(telemetry.telemetry_read(spark, path), 4)


@query("telemetry_read")
def _(spark, folder):
    raw = _raw(spark, folder)
    base = work_path(spark, "telemetry-cases")
    good = raw.agg(
        F.count(F.lit(1)).alias("rows_seen"), F.max("id").alias("rows_updated"),
        F.max("headway_sec").alias("mae_ema"), F.lit("ignored").alias("unknown_key"),
    )
    telemetry.telemetry_write(good, f"{base}/good")
    text = good.select(F.to_json(F.struct("*")).alias("value"))
    text.select(F.substring("value", 1, 12).alias("value")).write.text(f"{base}/broken")
    text.select(F.to_json(F.array("value")).alias("value")).write.text(f"{base}/list")
    cases = [
        telemetry.telemetry_read(spark, f"{base}/{name}").select(
            F.lit(name).alias("document"), "status", "rows_seen", "rows_updated", "mae_ema", "last_run_utc"
        )
        for name in ("good", "broken", "list", "missing")
    ]
    return cases[0].unionByName(cases[1]).unionByName(cases[2]).unionByName(cases[3])


@query("model_state_io")
def _(spark, folder):
    path = work_path(spark, "model-state")
    raw = _raw(spark, folder)
    model_state.save_state(*online.learner_states(filters.recent_window_filter(raw, WEEK)), path, "20240101000000")
    model_state.save_state(*online.learner_states(raw), path, "20240201000000")
    states = model_state.load_state(spark, path)
    return rounded(states.select("route_id", "rows_seen", "mae_ema", "drift_events", "version"), 4)


# Filters

@query("arrival_horizon_filter")
def _(spark, folder):
    return filters.arrival_horizon_filter(_arrivals(spark, folder))


@query("recent_window_filter")
def _(spark, folder):
    return filters.recent_window_filter(_raw(spark, folder), WEEK).select("id", "observed_ts", "route_id")


@query("route_filter")
def _(spark, folder):
    return filters.route_filter(_raw(spark, folder), "purchase").select("id", "route_id", "stop_id")


@query("min_score_filter")
def _(spark, folder):
    return filters.min_score_filter(_served(spark, folder), 0.6).select("id", "anomaly_score")


@query("scored_unscored_split")
def _(spark, folder):
    label = F.when(filters.is_scored(), "scored").when(filters.is_unscored(), "unscored")
    return _served(spark, folder).select("id", label.alias("part"))


@query("positive_headway")
def _(spark, folder):
    as_text = F.when(F.col("id") % 9 == 0, "n/a").otherwise(F.col("headway_sec").cast("string"))
    return filters.positive_headway(_raw(spark, folder).withColumn("headway_sec", as_text)).select("id", "headway_sec")


@query("severity_flags")
def _(spark, folder):
    return _served(spark, folder).select("id", *scoring.severity_flags(F.col("anomaly_score")))


@query("severity_band")
def _(spark, folder):
    return aggregates.band_counts(_served(spark, folder))


# Joins

@query("features_join_stats")
def _(spark, folder):
    raw = _raw(spark, folder)
    rows = raw.withColumn("hour", clock.hour_utc(F.col("observed_ts")))
    joined = joins.features_join_stats(rows, aggregates.headway_median_mad(raw))
    return rounded(joined.select("id", "hour", "headway_sec", "median", "mad"))


@query("stop_name_left_join")
def _(spark, folder):
    named = joins.stop_name_left_join(_raw(spark, folder), star_tables.stops(spark, folder))
    return named.select("id", "stop_id", "stop_name")


@query("stop_geo_inner_join")
def _(spark, folder):
    located = joins.stop_geo_inner_join(_raw(spark, folder), star_tables.stops(spark, folder))
    return located.select("id", "stop_id", "stop_name", "lat", "lon")


@query("last_seen_lookup")
def _(spark, folder):
    earliest = windows.headway_lag(_earliest(spark, folder))
    middle = earliest.agg(F.timestamp_seconds(F.floor((F.unix_seconds(F.min("poll_ts")) + F.unix_seconds(F.max("poll_ts"))) / 2)))
    cut = middle.scalar()
    state = earliest.where(F.col("poll_ts") < cut).groupBy("route_id", "stop_id").agg(
        F.max_by("arrival", F.struct("poll_ts", "feed_ord")).alias("arrival")
    )
    fresh = earliest.where(F.col("poll_ts") >= cut).drop("prev_arrival", "headway_sec")
    return joins.last_seen_lookup(fresh, state).select(
        "poll_ts", "feed", "route_id", "stop_id", "arrival", "prev_arrival"
    )


# Aggregates

@query("earliest_arrival")
def _(spark, folder):
    return _earliest(spark, folder)


@query("headway_median_mad")
def _(spark, folder):
    return rounded(aggregates.headway_median_mad(_raw(spark, folder)))


@query("count_scored")
def _(spark, folder):
    return aggregates.count_scored(filters.recent_window_filter(_served(spark, folder), WEEK))


@query("count_distinct_stops")
def _(spark, folder):
    return aggregates.count_distinct_stops(filters.recent_window_filter(_served(spark, folder), WEEK))


@query("count_distinct_route_stop")
def _(spark, folder):
    return aggregates.count_distinct_route_stop(filters.recent_window_filter(_served(spark, folder), WEEK))


@query("conditional_counts")
def _(spark, folder):
    return aggregates.conditional_counts(filters.recent_window_filter(_served(spark, folder), WEEK))


@query("max_observed")
def _(spark, folder):
    return aggregates.max_observed(_raw(spark, folder))


@query("unscored_backlog")
def _(spark, folder):
    return aggregates.unscored_backlog(_served(spark, folder))


@query("readiness_counts")
def _(spark, folder):
    return aggregates.readiness_counts(_served(spark, folder))


@query("error_quantiles")
def _(spark, folder):
    return rounded(aggregates.error_quantiles(star_tables.errors(spark, folder)))


@query("score_correlation")
def _(spark, folder):
    return rounded(aggregates.score_correlation(star_tables.errors(spark, folder)))


@query("distinct_routes")
def _(spark, folder):
    return aggregates.distinct_routes(_raw(spark, folder), star_tables.static_routes(spark, folder))


# Windows

@query("headway_lag")
def _(spark, folder):
    return windows.headway_lag(_earliest(spark, folder)).select(
        "poll_ts", "feed", "route_id", "stop_id", "arrival", "prev_arrival", "headway_sec"
    )


@query("top1_per_stop")
def _(spark, folder):
    return windows.top1_per_stop(filters.scored(_served(spark, folder))).select(
        "stop_id", "id", "route_id", "observed_ts", "anomaly_score"
    )


def _numbered_residuals(spark, folder):
    scored = filters.scored(_served(spark, folder)).withColumn("abs_residual", F.abs("residual"))
    return online.number_by_route(scored, "abs_residual")


@query("residual_quantiles")
def _(spark, folder):
    found = windows.residual_quantiles(_numbered_residuals(spark, folder), "abs_residual")
    return rounded(found.select("route_id", "id", "seq", "history_n", "q50", "q90", "q99"), 4)


@query("ema_scale")
def _(spark, folder):
    scaled = windows.ema_scale(_numbered_residuals(spark, folder), "abs_residual")
    return rounded(scaled.select("route_id", "id", "seq", "ema"), 3)


# Ranking

@query("top_anomalies")
def _(spark, folder):
    ranked = ranking.top_anomalies(filters.scored(_served(spark, folder)), 1000)
    return ranked.select("id", "route_id", "stop_id", "observed_ts", "anomaly_score")


@query("fifo_unscored_batch")
def _(spark, folder):
    return ranking.fifo_unscored_batch(_served(spark, folder), 1024).select(
        "id", "route_id", "stop_id", clock.hour_utc(F.col("observed_ts")).alias("hour"), "headway_sec"
    )


@query("recent_scored_sample")
def _(spark, folder):
    return ranking.recent_scored_sample(_served(spark, folder), 18_000, 7 * 1440).select(
        "id", "observed_ts", "headway_sec", "predicted_headway_sec"
    )


@query("top_error_events")
def _(spark, folder):
    return ranking.top_error_events(star_tables.errors(spark, folder))


@query("anomaly_page")
def _(spark, folder):
    ranked = ranking.top_anomalies(filters.scored(_served(spark, folder)), 400)
    return ranking.anomaly_page(ranked, page=3).select("id", "stop_id", "anomaly_score")


# Scalar functions

@query("ts_pack")
def _(spark, folder):
    return _raw(spark, folder).select(
        "id", *clock.ts_pack(F.col("observed_ts"), "observed"), *clock.ts_pack(F.col("event_ts"), "event")
    )


@query("hour_utc")
def _(spark, folder):
    ts = F.col("observed_ts")
    return _raw(spark, folder).select("id", clock.hour_utc(ts).alias("hour"), clock.minute_utc(ts).alias("minute"))


@query("cyclic_time")
def _(spark, folder):
    return rounded(_raw(spark, folder).select("id", *clock.cyclic_time(F.col("observed_ts"))))


@query("stable_hash_unit")
def _(spark, folder):
    return _raw(spark, folder).select(
        "id",
        hashing.stable_hash_unit(F.col("route_id"), 997).alias("route_hash"),
        hashing.stable_hash_unit(F.when(F.col("id") % 10 == 0, F.lit("")).otherwise(F.col("stop_id")), 4093).alias("stop_hash"),
    )


@query("clip01")
def _(spark, folder):
    return _served(spark, folder).select("id", scoring.clip01(F.col("residual") / 100).alias("clipped"))


@query("relative_error")
def _(spark, folder):
    error = scoring.relative_error(F.col("residual"), F.col("predicted_headway_sec"))
    return filters.scored(_served(spark, folder)).select("id", error.alias("relative_error"))


@query("ssl_residual_score")
def _(spark, folder):
    numbered = _numbered_residuals(spark, folder)
    scale = windows.ema_scale(numbered, "abs_residual").select("id", "abs_residual", "ema")
    found = windows.residual_quantiles(numbered, "abs_residual").join(scale, "id")
    score = scoring.ssl_residual_score(*[F.col(c) for c in ("abs_residual", "history_n", "q50", "q99", "ema")])
    return rounded(found.select("id", "seq", score.alias("ssl_score")))


@query("composite_score")
def _(spark, folder):
    score = scoring.composite_score(
        F.col("anomaly_score"), F.col("headway_sec") / 2000,
        scoring.relative_error(F.col("residual"), F.col("predicted_headway_sec")),
    )
    return filters.scored(_served(spark, folder)).select("id", score.alias("composite"))


@query("geojson_features")
def _(spark, folder):
    """Features are decoded again so that values, not number formats, are compared."""
    rows = windows.top1_per_stop(filters.scored(_served(spark, folder)))
    located = joins.stop_geo_inner_join(rows, star_tables.stops(spark, folder)).select(
        "*", *clock.ts_pack(F.col("observed_ts"), "observed"), *clock.ts_pack(F.col("event_ts"), "event")
    )
    text = geo.event_feature(located).select("feature")
    get = lambda path: F.get_json_object("feature", path)
    return text.select(
        get("$.properties.stop_id").alias("stop_id"), get("$.geometry.type").alias("geometry"),
        get("$.geometry.coordinates[0]").cast("double").alias("lon"),
        get("$.geometry.coordinates[1]").cast("double").alias("lat"),
        get("$.properties.anomaly_score").cast("double").alias("anomaly_score"),
        get("$.properties.headway_sec").cast("double").alias("headway_sec"),
        get("$.properties.observed_ts_epoch_ms").cast("long").alias("observed_ts_epoch_ms"),
        F.contains("feature", F.lit('"event_ts_utc"')).alias("has_event"),
    )


@query("set_fingerprint")
def _(spark, folder):
    return hashing.set_fingerprint(star_tables.stops(spark, folder), "stop_id")


# Streaming

@query("stream_headway")
def _(spark, folder):
    stream = star_tables.snapshots(spark, folder, star_tables.events_stream(spark, folder))
    return runs.drain(headways.stream_headway(feeds.feed_flatten(stream)), "stream-headway").drop("feed_ord")


@query("stream_score")
def _(spark, folder):
    # Six micro-batches in time order, each of the files of one slice.
    landing, files = star_tables.land_in_slices(_raw(spark, folder), work_path(spark, "score-landing"), 6)
    stream = spark.readStream.schema(_raw(spark, folder).schema).option("maxFilesPerTrigger", files).parquet(landing)
    out = work_path(spark, "stream-score")
    sink = stream_scoring.stream_score(work_path(spark, "stream-state"), stream_scoring.to_folder(out))
    runs.drain_batches(stream, sink, "stream-score")
    scored = spark.read.parquet(out)
    return rounded(scored.select("id", "route_id", "seq", "predicted_headway_sec", "residual", "anomaly_score"), 4)


@query("stream_enrich")
def _(spark, folder):
    stream = star_tables.raw_scores(spark, folder, star_tables.events_stream(spark, folder))
    rows = stream.select("id", "route_id", "stop_id", "headway_sec")
    return runs.drain(summaries.stream_enrich(rows, star_tables.stops(spark, folder)), "stream-enrich")


@query("stream_window_summary")
def _(spark, folder):
    stream = star_tables.served_scores(spark, folder, star_tables.events_stream(spark, folder))
    return summaries.drain_window_summary(stream, slide="5 minutes", buckets=8)


# Learners

@query("online_features")
def _(spark, folder):
    return online.online_features(_raw(spark, folder)).select("id", *online.FEATURES)


@query("online_headway_regression")
def _(spark, folder):
    learned = online.online_headway_regression(_raw(spark, folder))
    return rounded(learned.select("id", "route_id", "seq", "predicted_headway_sec", "residual"), 4)


@query("half_space_trees")
def _(spark, folder):
    return rounded(online.half_space_trees(_served(spark, folder)).select("id", "route_id", "seq", "tree_score"))


@query("drift_adwin")
def _(spark, folder):
    return online.drift_adwin(_served(spark, folder)).select("id", "route_id", "seq", "drifted", "epoch")


@query("drift_cut_scan")
def _(spark, folder):
    return rounded(drift.drift_cut_scan(filters.scored(_served(spark, folder))))


@query("score_online")
def _(spark, folder):
    scored = online.score_online(_raw(spark, folder)).select(
        "id", "route_id", "seq", "predicted_headway_sec", "residual", "ema", "ssl_score", "tree_score",
        "relative_error", "anomaly_score", "drifted",
    )
    return rounded(scored, 4)


@query("telemetry_online")
def _(spark, folder):
    return rounded(_online_telemetry(spark, folder), 4)


@query("standardise_matrix")
def _(spark, folder):
    matrix = shadow.standardise_matrix(shadow.shadow_features(filters.scored(_served(spark, folder))))
    return rounded(matrix.select("id", *shadow.FEATURES), 5)


@query("shadow_autoencoder")
def _(spark, folder):
    features, _ = shadow.training_table(filters.scored(_served(spark, folder)))
    errors, _, _ = shadow.shadow_autoencoder(shadow.standardise_matrix(features))
    return errors.select("id", "route_id", "stop_id", "online_score", "err")


@query("telemetry_shadow")
def _(spark, folder):
    served = _served(spark, folder)
    row = shadow.telemetry_shadow(filters.scored(served), serve.run_stamp(_newest(served)))
    return row.withColumn("top_shadow_events", F.to_json("top_shadow_events"))


# Served queries

@query("q_summary")
def _(spark, folder):
    return serve.summary(_served(spark, folder), WEEK)


@query("q_anomalies")
def _(spark, folder):
    return serve.anomalies(_served(spark, folder), star_tables.stops(spark, folder), WEEK, min_score=0.2, limit=400)


@query("q_heatmap")
def _(spark, folder):
    served = _served(spark, folder)
    return serve.heatmap(served, star_tables.stops(spark, folder), WEEK).drop("feature")


@query("q_routes")
def _(spark, folder):
    return serve.routes(_raw(spark, folder), star_tables.static_routes(spark, folder))


@query("q_stops")
def _(spark, folder):
    return star_tables.stops(spark, folder).select("stop_id", "stop_name", "lat", "lon", F.size("routes").alias("n_routes"))


def _documents(spark, folder):
    """Telemetry of a model that ran, and of a shadow detector that has not."""
    path = work_path(spark, "health")
    good = _raw(spark, folder).agg(F.count(F.lit(1)).alias("rows_seen"), F.max("id").alias("rows_updated"))
    telemetry.telemetry_write(good, f"{path}/model")
    return f"{path}/model", f"{path}/shadow"


@query("q_freshness")
def _(spark, folder):
    served = _served(spark, folder)
    model, shadow_path = _documents(spark, folder)
    return serve.freshness(
        served, star_tables.stops(spark, folder), _newest(served, "600"), telemetry.telemetry_read(spark, model),
        telemetry.shadow_health_read(spark, shadow_path))


@query("telemetry_read_all")
def _(spark, folder):
    model, shadow_path = _documents(spark, folder)
    cases = [telemetry.telemetry_read_all(spark, p).select(F.lit(n).alias("document_name"), "status", "document")
             for n, p in (("model", model), ("shadow", shadow_path))]
    return cases[0].unionByName(cases[1])


@query("routes_fingerprint")
def _(spark, folder):
    return serve.routes_fingerprint(_raw(spark, folder), star_tables.static_routes(spark, folder))


@query("station_layer")
def _(spark, folder):
    get = lambda path: F.get_json_object("feature", path)
    return geo.station_feature(star_tables.stops(spark, folder)).select(
        get("$.properties.stop_id").alias("stop_id"), get("$.properties.stop_name").alias("stop_name"),
        get("$.geometry.coordinates[0]").cast("double").alias("lon"),
        get("$.geometry.coordinates[1]").cast("double").alias("lat"))


@query("heatmap_collection")
def _(spark, folder):
    """The tiles' documents are decoded again, so that every property is compared."""
    served = _served(spark, folder)
    rows = serve.heatmap(served, star_tables.stops(spark, folder), WEEK)
    tiles = geo.feature_collections(rows.select("lon", "lat", "feature"), serve.run_stamp(_newest(served)))
    event = ", ".join(f"{name}: {kind}" for name, kind in (
        ("stop_id", "string"), ("stop_name", "string"), ("route_id", "string"), ("anomaly_score", "double"), ("residual", "double"),
        ("headway_sec", "double"), ("predicted_headway_sec", "double"), ("observed_ts_utc", "string"), ("event_ts_utc", "string")))
    kind = f"type string, timestamp string, features array<struct<geometry: struct<coordinates: array<double>>, properties: struct<{event}>>>"
    document = tiles.select(F.from_json("collection", kind).alias("d"))
    each = document.select("d.type", "d.timestamp", F.explode("d.features").alias("f"))
    return each.select("type", "timestamp", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


@query("rewrite_scores")
def _(spark, folder):
    path = work_path(spark, "stored")
    scores_io.append_scores(_raw(spark, folder), path)
    fresh = filters.recent_window_filter(_served(spark, folder), DAY).where("predicted_headway_sec is not null")
    scores_io.rewrite_scores(spark, path, fresh)
    return scores_io.read_scores(spark, path).select("id", "predicted_headway_sec", "residual", "anomaly_score")


@query("score_cycle")
def _(spark, folder):
    """One cycle over a stored table: the oldest 4096 usable rows get their scores."""
    path = work_path(spark, "cycle")
    scores_io.append_scores(_raw(spark, folder), f"{path}/scores")
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    score_cycle(spark, f"{path}/scores", f"{path}/state", f"{path}/telemetry", now)
    stored = scores_io.read_scores(spark, f"{path}/scores").where("predicted_headway_sec is not null")
    return rounded(stored.select("id", "predicted_headway_sec", "residual", "anomaly_score"), 4)


@query("q_features_batch")
def _(spark, folder):
    return rounded(serve.features_batch(_raw(spark, folder), WEEK))


@query("q_shadow_features")
def _(spark, folder):
    sample = serve.shadow_sample(_served(spark, folder), 18_000, 7 * 1440)
    return rounded(sample.drop("observed_ts"))
