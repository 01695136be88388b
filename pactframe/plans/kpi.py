"""KPI and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kpi
from ..operators import spans as span_ops
from ..operators import timeline as tl
from . import oracle as o
from .registry import plan

ROUNDED_STATES = "array_join(transform(map_keys(states), k -> concat(k, '=', CAST(states[k] AS STRING))), ';')"


def _results(src):
    """Per-criterion rows with the time of their run."""
    runs = src.view("runs").select(F.col("analysis_id").alias("run_id"), "created_at")
    return src.view("criterion_results").join(runs, "run_id")


@plan("k1_windows", sql=f"""
WITH n AS (SELECT max(ts) AS now FROM v_spans),
spec AS (SELECT * FROM (VALUES ('30m', 1800), ('1h', 3600), ('24h', 86400), ('7d', 604800), ('30d', 2592000)) t(spec, secs))
SELECT spec, secs, (SELECT count(*) FROM v_spans, n WHERE ts >= date_trunc('second', now - secs * INTERVAL 1 SECOND)) AS n FROM spec""")
def k1(src):
    spans = src.view("spans")
    now = src.latest(spans, "ts")
    specs = list(tl.BUCKETS)
    counts = spans.agg(*[kpi.count_if(F.col("ts") >= F.lit(tl.since(s, now))).alias(s) for s in specs])
    rows = F.inline(F.array(*[
        F.struct(F.lit(s).alias("spec"), F.lit(tl.seconds(s)).alias("secs"), F.col(f"`{s}`").alias("n"))
        for s in specs]))
    return counts.select(rows)


@plan("k2_buckets", sql=f"SELECT {o.bucket('ts', '6h')} AS bucket, count(*) AS n FROM v_spans GROUP BY 1")
def k2(src):
    return src.view("spans").groupBy(tl.bucket_start(F.col("ts"), "6h").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


@plan("k3_axis", sql=f"""
WITH {o.now('v_spans', 'ts')}, {o.axis('30d', '1h')},
c AS (SELECT {o.bucket('ts', '1h')} AS bucket, count(*) AS n, count(*) FILTER (status = 'error') AS errors
        FROM v_spans, clock WHERE ts >= {o.since('30d')} GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n, round(errors / n, 4) AS error_rate FROM axis LEFT JOIN c USING (bucket)""")
def k3(src):
    spans = src.view("spans")
    now = src.latest(spans, "ts")
    counts = tl.in_window(spans, "ts", "30d", now).groupBy(
        tl.bucket_start(F.col("ts"), "1h").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), kpi.count_if(F.col("status") == "error").alias("errors"))
    return tl.axis(src.spark, "30d", "1h", now).join(F.broadcast(counts), "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), kpi.rate(F.col("errors"), F.col("n")).alias("error_rate"))


SUMMARY_SQL = f"""
WITH {o.now('v_runs', 'created_at')},
s AS (SELECT v_runs.* FROM v_runs, clock WHERE created_at >= {o.since('365d')}),
{o.percentiles('d', 's', 'job_duration_s')}, {o.percentiles('c', 's', 'cost_usd')},
h AS (SELECT count(*) AS runs, count(*) FILTER (status = 'done') AS done,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'interrupted') AS interrupted,
  count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status IN ('queued', 'running')) AS live,
  sum(coalesce(criteria_completed, 0)) AS criteria, sum(coalesce(cost_usd, 0)) AS cost_total, avg(cost_usd) AS cost_mean,
  avg(job_duration_s) AS duration_mean, sum(coalesce(input_tokens, 0)) AS input_tokens,
  sum(coalesce(output_tokens, 0)) AS output_tokens, sum(coalesce(tool_calls, 0)) AS tool_calls,
  sum(coalesce(quotes_total, 0)) AS quotes_total, sum(coalesce(quotes_verified, 0)) AS quotes_verified,
  sum(coalesce(needs_review, 0)) AS needs_review, sum(coalesce(capped, 0)) AS capped,
  count(*) FILTER (needs_review > 0) AS runs_needing_review, count(*) FILTER (capped > 0) AS runs_capped,
  avg(mean_confidence) AS mean_confidence FROM s)
SELECT runs, done, failed, interrupted, cancelled, live, criteria, input_tokens, output_tokens, tool_calls,
  quotes_total, quotes_verified, needs_review, capped, runs_needing_review, runs_capped,
  done + failed + interrupted + cancelled AS settled,
  round((failed + interrupted) / (done + failed + interrupted + cancelled), 4) AS failure_rate,
  round(quotes_verified / quotes_total, 4) AS quote_verification_rate,
  round(needs_review / criteria, 4) AS needs_review_rate, round(capped / criteria, 4) AS cap_rate,
  round(cost_total, 3) AS cost_total, round(cost_mean, 6) AS cost_mean, round(duration_mean, 3) AS duration_mean,
  round(mean_confidence, 4) AS mean_confidence, d.p50 AS duration_p50, d.p95 AS duration_p95, c.p50 AS cost_p50, c.p95 AS cost_p95
  FROM h, d, c"""


@plan("k4_summary", sql=SUMMARY_SQL)
def k4(src):
    runs = src.view("runs")
    out = kpi.summary(runs, "365d", src.latest(runs, "created_at"))
    places = {"cost_total": 3, "cost_mean": 6, "duration_mean": 3, "mean_confidence": 4}
    return out.withColumns({c: F.round(c, n) for c, n in places.items()})


@plan("k5_percentiles", sql=f"""
WITH s AS (SELECT * FROM v_runs), {o.percentiles('d', 's', 'job_duration_s', 'surface')}, {o.percentiles('c', 's', 'cost_usd', 'surface')}
SELECT surface, d.p50 AS duration_p50, d.p95 AS duration_p95, c.p50 AS cost_p50, c.p95 AS cost_p95 FROM d JOIN c USING (surface)""")
def k5(src):
    return kpi.run_percentiles(src.view("runs"), "surface")


@plan("k6_rates", sql="""
SELECT surface, count(*) AS runs, sum(quotes_total) AS quotes_total,
  round(sum(quotes_verified) / sum(quotes_total), 4) AS quote_verification_rate,
  round(sum(coalesce(needs_review, 0)) / nullif(sum(criteria_completed), 0), 4) AS needs_review_rate,
  round(count(*) FILTER (status IN ('failed', 'interrupted')) /
        nullif(count(*) FILTER (status IN ('done', 'failed', 'interrupted', 'cancelled')), 0), 4) AS failure_rate
  FROM v_runs GROUP BY surface""")
def k6(src):
    out = kpi.add_rates(kpi.run_counts(src.view("runs"), "surface"))
    return out.select("surface", "runs", "quotes_total", "quote_verification_rate", "needs_review_rate", "failure_rate")


@plan("k7_by_surface", sql="SELECT surface, count(*) AS runs, round(sum(coalesce(cost_usd, 0)), 3) AS cost_usd FROM v_runs GROUP BY surface")
def k7(src):
    return kpi.by_surface(src.view("runs")).withColumn("cost_usd", F.round("cost_usd", 3))


PER_BUCKET_SQL = """SELECT {b} AS bucket, count(*) AS runs, count(*) FILTER (status = 'done') AS done,
  count(*) FILTER (status IN ('failed', 'interrupted')) AS failed, round(sum(coalesce(cost_usd, 0)), 6) AS cost_usd,
  sum(coalesce(criteria_completed, 0)) AS criteria, sum(coalesce(quotes_total, 0)) AS quotes_total,
  sum(coalesce(quotes_verified, 0)) AS quotes_verified, sum(coalesce(needs_review, 0)) AS needs_review,
  round(avg(mean_confidence), 4) AS mean_confidence FROM {src} GROUP BY 1"""


@plan("k8_per_bucket", sql=PER_BUCKET_SQL.format(b=o.bucket("created_at", "1d"), src="v_runs"))
def k8(src):
    return kpi.per_bucket(src.view("runs"), "1d")


@plan("k9_state_mix", sql=f"""
SELECT {o.bucket('created_at', '1d')} AS bucket, state, count(*) AS n
  FROM v_criterion_results JOIN v_runs ON analysis_id = run_id GROUP BY 1, 2""")
def k9(src):
    from ..operators import assess

    reports = assess.pack_reports(src.view("criterion_results")).select("run_id", "report_json")
    runs = src.view("runs").select(F.col("analysis_id").alias("run_id"), "created_at")
    results = assess.unpack_reports(reports).select("run_id", "state").join(runs, "run_id")
    return kpi.states_per_bucket(results, "1d")


@plan("k10_timeseries", sql=f"""
WITH {o.now('v_runs', 'created_at')}, {o.axis('30d', '1d')},
s AS (SELECT v_runs.*, {o.bucket('created_at', '1d')} AS bucket FROM v_runs, clock WHERE created_at >= {o.since('30d')}),
b AS ({PER_BUCKET_SQL.format(b='bucket', src='s')}),
{o.percentiles('d', 's', 'job_duration_s', 'bucket')}, {o.percentiles('c', 's', 'cost_usd', 'bucket')},
m AS (SELECT bucket, string_agg(concat(state, '=', n), ';' ORDER BY state) AS states FROM (
  SELECT {o.bucket('created_at', '1d')} AS bucket, state, count(*) AS n FROM v_criterion_results JOIN v_runs ON analysis_id = run_id, clock
   WHERE created_at >= {o.since('30d')} GROUP BY 1, 2) GROUP BY bucket),
t AS (SELECT {o.bucket('ts', '1d')} AS bucket, count(*) AS turns, round(sum(coalesce(cost_usd, 0)), 6) AS chat_cost_usd
   FROM v_spans, clock WHERE name = 'chat' AND ts >= {o.since('30d')} GROUP BY 1)
SELECT bucket, coalesce(runs, 0) AS runs, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed,
  coalesce(cost_usd, 0) AS cost_usd, coalesce(turns, 0) AS turns, coalesce(chat_cost_usd, 0) AS chat_cost_usd, mean_confidence,
  round(quotes_verified / quotes_total, 4) AS quote_verification_rate, round(needs_review / nullif(criteria, 0), 4) AS needs_review_rate,
  round(d.p50, 3) AS duration_p50, round(d.p95, 3) AS duration_p95, round(c.p50, 6) AS cost_p50, round(c.p95, 6) AS cost_p95,
  coalesce(states, '') AS states
  FROM axis LEFT JOIN b USING (bucket) LEFT JOIN d USING (bucket) LEFT JOIN c USING (bucket) LEFT JOIN m USING (bucket) LEFT JOIN t USING (bucket)""")
def k10(src):
    runs = src.view("runs")
    now = src.latest(runs, "created_at")
    out = kpi.timeseries(runs, _results(src), src.view("spans"), "30d", now)
    return out.withColumn("states", F.expr(ROUNDED_STATES))


@plan("k11_chat", sql="""
WITH c AS (SELECT * FROM v_spans WHERE name = 'chat'),
o AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) AS rn, count(*) OVER () AS n FROM c WHERE latency_ms IS NOT NULL)
SELECT (SELECT count(*) FROM c) AS turns, (SELECT round(sum(cost_usd), 4) FROM c) AS cost_usd,
  (SELECT round(sum(cost_usd) / count(*), 6) FROM c) AS cost_per_turn, (SELECT count(*) FILTER (status = 'error') FROM c) AS errors,
  round(max(CASE WHEN rn = (n * 50 + 99) // 100 THEN v END), 1) AS latency_p50,
  round(max(CASE WHEN rn = (n * 95 + 99) // 100 THEN v END), 1) AS latency_p95 FROM o""")
def k11(src):
    return kpi.chat(src.view("spans")).withColumn("cost_usd", F.round("cost_usd", 4))


@plan("k12_chat_per_bucket", sql=f"""
SELECT {o.bucket('ts', '6h')} AS bucket, count(*) AS turns, round(sum(cost_usd), 6) AS chat_cost_usd
  FROM v_spans WHERE name = 'chat' GROUP BY 1""")
def k12(src):
    return kpi.chat_per_bucket(src.view("spans"), "6h")


MODEL_SQL = """SELECT model, count(*) AS calls, round(sum(coalesce(cost_usd, 0)), 4) AS cost_usd,
  sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens
  FROM v_spans WHERE name = 'agent.call' AND model IS NOT NULL GROUP BY model"""


@plan("k13_by_model", sql=MODEL_SQL)
def k13(src):
    return kpi.cost_by_model(src.view("spans")).withColumn("cost_usd", F.round("cost_usd", 4))


@plan("k14_runs", sql="""
SELECT analysis_id, document_id, surface, status, created_at, cost_usd, criteria_completed FROM v_runs
 ORDER BY created_at DESC, seq DESC LIMIT 50""")
def k14(src):
    return kpi.recent_runs(src.view("runs"), 50).select(
        "analysis_id", "document_id", "surface", "status", "created_at", "cost_usd", "criteria_completed")


@plan("k15_backfill", sql="""
SELECT run_id, criterion_id, state, raw_confidence, needs_review, ended_by, cost_usd, claimed AS quotes_total,
  least(verified, claimed) AS quotes_verified FROM v_criterion_results WHERE run_id % 3 <> 0
UNION ALL
SELECT run_id, criterion_id, 'kept', raw_confidence, needs_review, ended_by, cost_usd, claimed, least(verified, claimed)
  FROM v_criterion_results WHERE run_id % 3 = 0""")
def k15(src):
    from ..operators import assess

    results = src.view("criterion_results")
    reports = assess.pack_reports(results).select("run_id", "report_json")
    mined = assess.record_criteria(assess.unpack_reports(reports))
    present = mined.where(F.col("run_id") % 3 == 0).withColumn("state", F.lit("kept"))
    return assess.backfill(present, mined).select(
        "run_id", "criterion_id", "state", "raw_confidence", "needs_review", "ended_by", "cost_usd",
        "quotes_total", "quotes_verified")


@plan("k16_criterion_mix", sql=f"""
WITH {o.now('v_runs', 'created_at')}
SELECT criterion_id, state, count(*) AS runs, round(avg(raw_confidence), 4) AS confidence, round(avg(raw_confidence), 4) AS raw_confidence,
  sum(r.needs_review) AS needs_review, count(*) FILTER (ended_by = 'cap') AS capped
  FROM v_criterion_results r JOIN v_runs ON analysis_id = run_id, clock
 WHERE created_at >= {o.since('365d')} GROUP BY 1, 2""")
def k16(src):
    runs = src.view("runs")
    results = src.view("criterion_results").withColumn("confidence", F.col("raw_confidence"))
    return kpi.criterion_mix(results, runs, "365d", src.latest(runs, "created_at"))


@plan("k17_waterfall", sql="""
WITH RECURSIVE e AS (
  SELECT c.run_id, c.span_id, p.span_id AS parent FROM v_spans c
    LEFT JOIN v_spans p ON p.run_id = c.run_id AND p.span_id = c.parent_span_id AND p.span_id <> c.span_id),
t AS (SELECT run_id, span_id, span_id AS root_span_id, 0 AS depth, CAST(span_id AS STRING) AS path FROM e WHERE parent IS NULL
  UNION ALL
  SELECT e.run_id, e.span_id, t.root_span_id, t.depth + 1, concat(t.path, '/', e.span_id) FROM e JOIN t ON e.run_id = t.run_id AND e.parent = t.span_id)
SELECT run_id, span_id, root_span_id, depth, path, name, latency_ms FROM t JOIN (SELECT span_id, name, latency_ms FROM v_spans) USING (span_id)""")
def k17(src):
    out = span_ops.waterfall(src.view("spans"))
    return out.select("run_id", "span_id", "root_span_id", "depth",
                      F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "name", "latency_ms")


@plan("k17_preorder", sql="""
WITH RECURSIVE e AS (
  SELECT c.run_id, c.span_id, p.span_id AS parent FROM v_spans c
    LEFT JOIN v_spans p ON p.run_id = c.run_id AND p.span_id = c.parent_span_id AND p.span_id <> c.span_id),
t AS (SELECT run_id, span_id, span_id AS root_span_id, 0 AS depth, [span_id] AS path FROM e WHERE parent IS NULL
  UNION ALL
  SELECT e.run_id, e.span_id, t.root_span_id, t.depth + 1, list_append(t.path, e.span_id) FROM e JOIN t ON e.run_id = t.run_id AND e.parent = t.span_id)
SELECT run_id, span_id, root_span_id, depth, row_number() OVER (PARTITION BY run_id ORDER BY path) - 1 AS position FROM t""")
def k17_preorder(src):
    return span_ops.preorder(src.view("spans"))


@plan("k18_attributes", sql="""
SELECT span_id, CASE WHEN attrs IS NULL OR span_id % 31 = 0 OR span_id % 37 = 0 THEN 0 ELSE 1 END AS n_attrs,
  CASE WHEN attrs IS NULL OR span_id % 31 = 0 OR span_id % 37 = 0 THEN NULL ELSE json_extract_string(attrs, '$.k') END AS k
  FROM v_spans""")
def k18(src):
    bag = src.view("spans").select("span_id", kpi.attributes(F.col("attrs")).alias("bag"))
    return bag.select("span_id", F.size("bag").alias("n_attrs"), F.try_element_at("bag", F.lit("k")).alias("k"))


@plan("k19_evaluator_slot", sql="""
SELECT surface, 'cap_rate' AS showing, CAST(NULL AS DOUBLE) AS accept_rate,
  round(sum(capped) / nullif(sum(criteria_completed), 0), 4) AS value FROM v_runs GROUP BY surface""")
def k19(src):
    rates = kpi.add_rates(kpi.run_counts(src.view("runs"), "surface"))
    slot = rates.select("surface", kpi.evaluator_slot(F.col("cap_rate")).alias("s"))
    return slot.select("surface", "s.showing", "s.accept_rate", "s.value")


STAGE_LIST = "('ingest.parse', 'ingest.embed', 'retrieve', 'agent.tool', 'agent.call', 'chat')"
STAGE_SQL = f"SELECT name, count(*) AS n, count(*) FILTER (status = 'error') AS errors FROM v_spans WHERE name IN {STAGE_LIST} GROUP BY name"


@plan("k20_stage_counts", sql=STAGE_SQL)
def k20(src):
    return kpi.stage_counts(src.view("spans"))


@plan("k21_worst_stage", sql=f"""
SELECT name, n, errors FROM ({STAGE_SQL}) ORDER BY (n >= 10) DESC, round(errors / n, 4) DESC, n DESC, name DESC LIMIT 1""")
def k21(src):
    return kpi.worst_stage(kpi.stage_counts(src.view("spans")))


def _stage_parts(window: str) -> str:
    def counts(spec):
        return f"SELECT name, count(*) AS n, count(*) FILTER (status = 'error') AS errors FROM v_spans, clock WHERE name IN {STAGE_LIST} AND ts >= {o.since(spec)} GROUP BY name"
    return f"""{o.now('v_spans', 'ts')}, live AS ({counts('5m')}), chart AS ({counts(window)}),
pool AS (SELECT 'live' AS scope, * FROM live UNION ALL SELECT 'chart', * FROM chart WHERE NOT EXISTS (SELECT 1 FROM live)),
pick AS (SELECT scope, name, n, errors, (SELECT sum(errors) FROM pool) AS errors_total FROM pool
  ORDER BY (n >= 10) DESC, round(errors / n, 4) DESC, n DESC, name DESC LIMIT 1)"""


@plan("k22_stage_tile", sql=f"WITH {_stage_parts('7d')} SELECT *, round(errors / n, 4) AS error_rate FROM pick")
def k22(src):
    spans = src.view("spans")
    return kpi.stage_tile(spans, "7d", src.latest(spans, "ts"))


@plan("k22_stage_map", sql=f"""
WITH {_stage_parts('7d')}, {o.axis('7d', '6h')},
c AS (SELECT {o.bucket('ts', '6h')} AS bucket, count(*) FILTER (v_spans.name = pick.name) AS n,
   count(*) FILTER (v_spans.name = pick.name AND status = 'error') AS errors, count(*) FILTER (status = 'error') AS errors_total
   FROM v_spans, clock, pick WHERE v_spans.name IN {STAGE_LIST} AND ts >= {o.since('7d')} GROUP BY 1)
SELECT bucket, coalesce(n, 0) AS n, round(errors / nullif(n, 0), 4) AS error_rate, errors_total FROM axis LEFT JOIN c USING (bucket)""")
def k22_series(src):
    spans = src.view("spans")
    return kpi.stage_series(spans, "7d", src.latest(spans, "ts"))


@plan("k23_host_latest", sql="SELECT ts, rss_mb, rss_pct, disk_used_pct FROM v_samples ORDER BY ts DESC, seq DESC LIMIT 1")
def k23(src):
    return kpi.latest_sample(src.view("samples"))


@plan("k24_host_series", sql=f"""
WITH {o.now('v_samples', 'ts')}, {o.axis('24h', '1h')},
r AS (SELECT {o.bucket('ts', '1h')} AS bucket, rss_pct, disk_used_pct,
   row_number() OVER (PARTITION BY {o.bucket('ts', '1h')} ORDER BY ts DESC, seq DESC) AS rn FROM v_samples, clock WHERE ts >= {o.since('24h')})
SELECT bucket, rss_pct, disk_used_pct FROM axis LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (bucket)""")
def k24(src):
    samples = src.view("samples")
    return kpi.sample_series(samples, "24h", 30.0, src.latest(samples, "ts"))


UP = "count(*) FILTER (name = 'upstream.call') AS calls, count(*) FILTER (name = 'upstream.retry') AS retries, count(*) FILTER (name = 'upstream.failed') AS failed"
UPR = "round(100 * retries / nullif(calls, 0), 1) AS retries_per_100, round(failed / nullif(calls, 0), 4) AS exhausted_rate"


@plan("k25_upstream", sql=f"""
WITH {o.now('v_upstream', 'ts')},
a AS (SELECT 'live' AS scope, {UP} FROM v_upstream, clock WHERE ts >= {o.since('5m')}),
b AS (SELECT 'chart' AS scope, {UP} FROM v_upstream, clock WHERE ts >= {o.since('24h')}),
p AS (SELECT * FROM a WHERE calls > 0 UNION ALL SELECT * FROM b WHERE (SELECT calls FROM a) = 0)
SELECT *, {UPR} FROM p""")
def k25(src):
    up = src.view("upstream")
    return kpi.upstream_tile(up, "24h", src.latest(up, "ts"))


@plan("k26_top_reason", sql="""
WITH e AS (SELECT json_extract_string(attrs, '$.reason') AS reason FROM v_upstream WHERE name IN ('upstream.retry', 'upstream.failed'))
SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 4) AS share FROM e WHERE reason IS NOT NULL
 GROUP BY reason ORDER BY n DESC, reason LIMIT 1""")
def k26(src):
    return kpi.top_reason(src.view("upstream"))


@plan("k27_upstream_series", sql=f"""
WITH {o.now('v_upstream', 'ts')}, {o.axis('7d', '6h')},
c AS (SELECT {o.bucket('ts', '6h')} AS bucket, {UP} FROM v_upstream, clock WHERE ts >= {o.since('7d')} GROUP BY 1),
f AS (SELECT bucket, coalesce(calls, 0) AS calls, coalesce(retries, 0) AS retries, coalesce(failed, 0) AS failed FROM axis LEFT JOIN c USING (bucket))
SELECT *, {UPR} FROM f""")
def k27(src):
    up = src.view("upstream")
    return kpi.upstream_series(up, "7d", src.latest(up, "ts"))


RATES = {"m0": (5.0, 25.0), "m1": (2.0, 10.0), "m2": (3.0, 15.0)}


@plan("k28_call_cost", sql="""
WITH p AS (SELECT * FROM (VALUES ('m0', 5.0::DOUBLE, 25.0::DOUBLE), ('m1', 2.0, 10.0), ('m2', 3.0, 15.0)) t(model, i, o))
SELECT span_id, i IS NOT NULL AS is_priced, coalesce(round((input_tokens * i + cache_read_tokens * i * 0.1::DOUBLE
  + cache_write_tokens * i * 1.25::DOUBLE + output_tokens * o) / 1000000, 9), 0) AS call_cost_usd
  FROM v_spans LEFT JOIN p USING (model)""")
def k28(src):
    priced = kpi.price_calls(src.view("spans"), kpi.price_table(src.spark, RATES), places=9)
    return priced.select("span_id", "is_priced", "call_cost_usd")


@plan("k29_usage", sql="""
SELECT run_id, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cache_read_tokens) AS cache_read_tokens,
  sum(cache_write_tokens) AS cache_write_tokens, count(*) AS calls FROM v_spans GROUP BY run_id""")
def k29(src):
    return kpi.usage_by_run(src.view("spans"))


LAST_SQL = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, seq DESC) AS rn FROM v_runs) WHERE rn = 1),
a AS (SELECT l.document_id, l.analysis_id, l.status, l.created_at, coalesce(l.needs_review, 0) AS needs_review,
  count(*) FILTER (state = 'Fully Compliant') AS fully, count(*) FILTER (state = 'Partially Compliant') AS partially,
  count(*) FILTER (state = 'Non-Compliant') AS non
  FROM l LEFT JOIN v_criterion_results r ON r.run_id = l.analysis_id GROUP BY ALL)"""


@plan("k30_last_analysis", sql=f"WITH {LAST_SQL} SELECT * FROM a")
def k30(src):
    return kpi.last_analysis(src.view("runs"), src.view("criterion_results"))


@plan("k31_analyses_of_document", sql="""
SELECT document_id, analysis_id, status, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, seq DESC) AS rn
  FROM v_runs) WHERE rn <= 5""")
def k31(src):
    return kpi.analyses_of(src.view("runs"), 5).select("document_id", "analysis_id", "status", "rank")


@plan("k32_merge_live", sql="""
SELECT analysis_id, document_id, CASE WHEN status IN ('queued', 'running') THEN concat('live ', status) ELSE status END AS status FROM v_runs""")
def k32(src):
    runs = src.view("runs").select("analysis_id", "document_id", "status")
    live = runs.where(F.col("status").isin(*kpi.LIVE_STATUSES)).withColumn("status", F.concat(F.lit("live "), "status"))
    return kpi.merge_live(live, runs)


@plan("k33_find_live", sql="""
WITH j AS (SELECT *, concat('c', CAST(analysis_id % 3 AS STRING)) AS criteria FROM v_runs)
SELECT r.analysis_id AS request_id, (SELECT min(seq) FROM j WHERE j.document_id = r.document_id AND j.criteria = r.criteria
  AND j.status IN ('queued', 'running')) AS live_id FROM j r""")
def k33(src):
    jobs = src.view("runs").withColumn(
        "criteria", F.array(F.concat(F.lit("c"), (F.col("analysis_id") % 3).cast("string"))))
    requests = jobs.select(F.col("analysis_id").alias("request_id"), "document_id", "criteria")
    return kpi.find_live(requests, jobs).select("request_id", "live_id")


@plan("k34_outcomes", sql="""
SELECT analysis_id, CASE WHEN status IN ('failed', 'interrupted', 'cancelled', 'queued') THEN status
  WHEN status = 'running' THEN concat(criteria_completed, ' of ', criteria_requested, ' running')
  WHEN coalesce(needs_review, 0) = 1 THEN '1 needs review'
  WHEN coalesce(needs_review, 0) > 1 THEN concat(needs_review, ' need review')
  ELSE concat(criteria_completed, ' of ', criteria_requested, ' complete') END AS outcome FROM v_runs""")
def k34(src):
    return src.view("runs").select("analysis_id", kpi.outcome_words().alias("outcome"))


@plan("k35_thresholds", sql=f"""
WITH s AS (SELECT * FROM v_runs), {o.percentiles('d', 's', 'job_duration_s', 'surface')},
r AS (SELECT surface, sum(quotes_verified) / sum(quotes_total) AS qv, sum(coalesce(needs_review, 0)) / sum(criteria_completed) AS nr,
  count(*) FILTER (status IN ('failed', 'interrupted')) / count(*) FILTER (status IN ('done', 'failed', 'interrupted', 'cancelled')) AS fr
  FROM s GROUP BY surface)
SELECT surface, CASE WHEN round(qv, 4) >= 0.99 THEN 'healthy' ELSE 'below target' END AS quote_verification,
  CASE WHEN round(nr, 4) <= 0.1 THEN 'healthy' ELSE 'over target' END AS needs_review,
  CASE WHEN round(fr, 4) <= 0.02 THEN 'healthy' ELSE 'over target' END AS failure_rate,
  CASE WHEN p95 IS NULL THEN 'not measured' WHEN p95 <= 120 THEN 'healthy' ELSE 'over target' END AS job_duration_p95
  FROM r LEFT JOIN d USING (surface)""")
def k35(src):
    runs = src.view("runs")
    rates = kpi.add_rates(kpi.run_counts(runs, "surface"))
    p = kpi.run_percentiles(runs, "surface")
    figures = {"quote_verification": "quote_verification_rate", "needs_review": "needs_review_rate",
               "failure_rate": "failure_rate", "job_duration_p95": "duration_p95"}
    return rates.join(p, "surface", "left").select(
        "surface", *[kpi.threshold_status(F.col(c), *kpi.THRESHOLDS[t]).alias(t) for t, c in figures.items()])


@plan("k36_cost_tail", sql=f"""
WITH s AS (SELECT *, {o.bucket('created_at', '30d')} AS bucket FROM v_runs), {o.percentiles('c', 's', 'cost_usd', 'bucket')}
SELECT bucket, round(CASE WHEN p50 > 0 THEN p95 / p50 END, 6) AS tail,
  CASE WHEN p95 / p50 <= 2 THEN 'healthy' ELSE 'over target' END AS status FROM c""")
def k36(src):
    runs = src.view("runs").withColumn("bucket", tl.bucket_start(F.col("created_at"), "30d"))
    tail = kpi.cost_tail(F.col("cost_p50"), F.col("cost_p95"))
    return kpi.run_percentiles(runs, "bucket").select(
        "bucket", F.round(tail, 6).alias("tail"),
        kpi.threshold_status(tail, *kpi.THRESHOLDS["cost_tail"]).alias("status"))


@plan("k37_segments", sql=f"""
WITH {o.now('v_upstream', 'ts')}, {o.axis('30d', '1h')},
c AS (SELECT {o.bucket('ts', '1h')} AS bucket, {UP} FROM v_upstream, clock WHERE ts >= {o.since('30d')} GROUP BY 1),
f AS (SELECT bucket, CASE WHEN failed % 4 <> 0 THEN round(failed / nullif(calls, 0), 4) END AS v FROM axis LEFT JOIN c USING (bucket)),
g AS (SELECT *, count(*) FILTER (v IS NULL) OVER (ORDER BY bucket) AS seg FROM f)
SELECT min(bucket) AS first, max(bucket) AS last, count(*) AS points FROM g WHERE v IS NOT NULL GROUP BY seg HAVING count(*) > 1""")
def k37(src):
    up = src.view("upstream")
    now = src.latest(up, "ts")
    found = kpi.upstream_counts(tl.in_window(up, "ts", "30d", now), tl.bucket_start(F.col("ts"), "1h").alias("bucket"))
    rated = kpi.upstream_rates(found)
    series = tl.axis(src.spark, "30d", "1h", now).join(F.broadcast(rated), "bucket", "left").select(
        "bucket", F.when(F.col("failed") % 4 != 0, F.col("exhausted_rate")).alias("v"))
    return kpi.segments(series, "v")


@plan("k38_last_words", sql=f"""
WITH {LAST_SQL}, d AS (SELECT c_custkey AS document_id FROM @customer),
j AS (SELECT d.document_id, status, fully, partially, non, fully + partially + non AS n, partially + non AS gaps FROM d LEFT JOIN a USING (document_id))
SELECT document_id, CASE WHEN status IS NULL THEN 'Not analysed' WHEN status = 'queued' THEN 'Queued' WHEN status = 'running' THEN 'Analysing'
  WHEN status = 'failed' THEN 'Analysis failed' WHEN status = 'interrupted' THEN 'Interrupted' WHEN n = 0 THEN 'No verdicts'
  WHEN gaps = 0 THEN concat(fully, ' of ', n, ' compliant') WHEN gaps = 1 THEN '1 gap found' ELSE concat(gaps, ' gaps found') END AS label,
  CASE WHEN status IS NULL OR status IN ('queued', 'running', 'failed', 'interrupted') OR n = 0 THEN 'neutral'
  WHEN gaps = 0 THEN 'Fully Compliant' WHEN non > 0 THEN 'Non-Compliant' ELSE 'Partially Compliant' END AS state FROM j""")
def k38(src):
    last = kpi.last_analysis(src.view("runs"), src.view("criterion_results"))
    documents = src.table("customer").select(F.col("c_custkey").alias("document_id"))
    return documents.join(last, "document_id", "left").select(
        "document_id", *[c.alias(n) for n, c in kpi.last_analysis_words().items()])


@plan("k39_spans_survive", sql="""
SELECT (SELECT count(*) FROM v_documents WHERE document_id % 7 <> 0) AS documents, (SELECT count(*) FROM v_spans) AS spans,
  (SELECT count(*) FROM v_runs) AS analyses""")
def k39(src):
    from ..operators import corpus

    docs = src.view("documents")
    gone = docs.where(F.col("document_id") % 7 == 0).select("document_id")
    left = corpus.delete_documents({"documents": docs, "spans": src.view("spans"), "analyses": src.view("runs")}, gone)
    counts = [t.agg(F.count(F.lit(1)).alias(n)).withColumn("_k", F.lit(1)) for n, t in left.items()]
    return counts[0].join(counts[1], "_k").join(counts[2], "_k").select("documents", "spans", "analyses")


@plan("k40_report_states", sql="""
SELECT run_id, count(*) FILTER (state = 'Fully Compliant') AS fully, count(*) FILTER (state = 'Partially Compliant') AS partially,
  count(*) FILTER (state = 'Non-Compliant') AS non, 0 AS quotes_in_summary, sum(claimed) AS quotes_in_full FROM v_criterion_results GROUP BY run_id""")
def k40(src):
    from ..operators import assess

    reports = assess.pack_reports(src.view("criterion_results"))
    brief = assess.trim_verdicts(reports, "summary")
    return brief.select(
        "run_id",
        *[F.coalesce(F.try_element_at("states", F.lit(s)), F.lit(0)).alias(n) for n, s in
          (("fully", "Fully Compliant"), ("partially", "Partially Compliant"), ("non", "Non-Compliant"))],
        F.expr("aggregate(verdicts, 0, (a, v) -> a + size(v.quotes))").alias("quotes_in_summary"),
        F.expr("aggregate(results, 0, (a, v) -> a + size(v.relevant_quotes))").alias("quotes_in_full"))


@plan("k41_run_summaries", sql="""
SELECT analysis_id, document_id, status, status AS stage, criteria_completed + criteria_skipped AS progress_done, criteria_requested AS progress_total,
  CASE WHEN r THEN coalesce(job_duration_s, 0) END AS job_duration_s, CASE WHEN r THEN cost_usd END AS cost_usd,
  CASE WHEN r THEN input_tokens END AS input_tokens, CASE WHEN r THEN output_tokens END AS output_tokens,
  CASE WHEN r THEN tool_calls END AS tool_calls, CASE WHEN r THEN coalesce(needs_review, 0) END AS needs_review,
  CASE WHEN r THEN capped END AS capped, CASE WHEN r THEN coalesce(mean_confidence, 0) END AS mean_confidence
  FROM (SELECT *, status IN ('done', 'cancelled') AS r FROM v_runs)""")
def k41(src):
    return kpi.run_summaries(src.view("runs"), F.col("status").isin("done", "cancelled"))


@plan("k42_unpriced", sql="""
SELECT count(*) AS models, coalesce(sum(calls), 0) AS calls FROM (SELECT model, count(*) AS calls FROM v_spans
 WHERE name = 'agent.call' AND model IS NOT NULL AND model = 'm3' GROUP BY model)""")
def k42(src):
    priced = kpi.price_calls(src.view("spans"), kpi.price_table(src.spark, RATES))
    return kpi.unpriced(kpi.cost_by_model(priced.withColumn("cost_usd", F.col("call_cost_usd"))))


@plan("k43_surfaces", sql="""
WITH d AS (SELECT analysis_id, CASE WHEN analysis_id % 5 = 0 THEN NULL WHEN analysis_id % 7 = 0 THEN 'fax' WHEN analysis_id % 2 = 0 THEN 'ui' ELSE 'mcp' END AS declared FROM v_runs)
SELECT coalesce(declared, 'api') AS surface, count(*) AS n, count(*) FILTER (declared = 'fax') AS refused FROM d GROUP BY 1""")
def k43(src):
    key = F.col("analysis_id")
    declared = F.when(key % 5 == 0, None).when(key % 7 == 0, "fax").when(key % 2 == 0, "ui").otherwise("mcp")
    requests = src.view("runs").select("analysis_id", declared.alias("declared"))
    bad = kpi.refused_surfaces(requests).groupBy(F.col("declared").alias("surface")).agg(F.count(F.lit(1)).alias("refused"))
    counts = requests.groupBy(kpi.declared_surface(F.col("declared")).alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(bad, "surface", "left").na.fill(0, ["refused"])
