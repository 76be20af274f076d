"""DuckDB SQL equal to each registered query (the correctness oracle).

The SQL reads the driver's views (orders, lineitem, customer) and rebuilds the
same video / channel tables from first principles; it shares no code and no
constants with the Spark operators (edges, labels and thresholds are written out
here again). Floating outputs are rounded to 6 digits on both sides.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2001-12-31 00:00:00'"
DAY_MICROS = "CAST(86400000000 AS DOUBLE)"


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def _z(a: str, b: str) -> str:
    return f"COALESCE({_div(a, b)}, 0)"


def _labels(name: str, order: str, labels: list[str]) -> str:
    vals = ", ".join(f"('{lab}', {i})" for i, lab in enumerate(labels))
    return f"(SELECT * FROM (VALUES {vals}) AS t({name}, {order}))"


def _cut(x: str, edges: list, labels: list[str]) -> str:
    arms = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                    for lo, hi, lab in zip(edges, edges[1:], labels))
    return f"CASE {arms} END"


def _cut_order(x: str, edges: list) -> str:
    arms = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN {i}"
                    for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"CASE {arms} END"


def _age(ts: str, absolute: bool) -> str:
    days = f"FLOOR(date_diff('microsecond', {ts}, {AS_OF_SQL}) / {DAY_MICROS})"
    return f"CAST(ABS({days}) AS BIGINT)" if absolute else f"CAST({days} AS BIGINT)"


def _period(mode: str) -> str:
    if mode == "daypart":
        h = "hour(publish_date)"
        return (f"CASE WHEN {h} >= 6 AND {h} < 12 THEN 'Morning' WHEN {h} >= 12 AND {h} < 18 THEN 'Afternoon' "
                f"WHEN {h} >= 18 AND {h} < 22 THEN 'Evening' ELSE 'Night' END")
    d = "day(publish_date)"
    return f"CASE WHEN {d} <= 10 THEN 'First' WHEN {d} <= 20 THEN 'Middle' ELSE 'Last' END"


def base_ctes(period_mode: str = "daypart", absolute_age: bool = True, low_inclusive: bool = True,
              typed_join: str = "LEFT JOIN", dirty: bool = False) -> str:
    """CTEs li, ch, typed, rates, qs, videos, agg, channels. ``dirty``: the view with
    unmatched and missing channels, missing dates, missing and repeated ids, and
    categories that are no label."""
    age = _age("publish_date", absolute_age)
    if low_inclusive:
        cat = "CASE WHEN views >= q75 THEN 'High' WHEN views <= q25 THEN 'Low' ELSE 'Medium' END"
    else:
        cat = "CASE WHEN views >= q75 THEN 'High' WHEN views >= q25 THEN 'Medium' ELSE 'Low' END"
    raw = "raw AS (SELECT * FROM raw0)"
    if dirty:
        cat = f"CASE WHEN views % 37 = 0 THEN 'viral: yes' ELSE {cat} END"
        raw = """
raw1 AS (SELECT * FROM raw0 UNION ALL SELECT * FROM raw0 WHERE video_id % 31 = 0),
raw AS (
  SELECT * REPLACE (
    CASE WHEN video_id % 29 <> 0 THEN video_id END AS video_id,
    CASE WHEN video_id % 10 = 5 THEN channel_id + 10000000 WHEN video_id % 10 <> 3 THEN channel_id END AS channel_id,
    CASE WHEN video_id % 23 <> 0 THEN publish_date END AS publish_date)
  FROM raw1)"""
    return f"""
li AS (
  SELECT l_orderkey,
    CAST(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(SUM(CAST(ROUND(l_extendedprice*l_discount) AS BIGINT)) AS BIGINT) AS likes,
    CAST(SUM(CAST(ROUND(l_extendedprice*l_tax/10) AS BIGINT)) AS BIGINT) AS comments,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
  FROM lineitem GROUP BY l_orderkey),
ch AS (
  SELECT c_custkey AS channel_id, c_name AS channel_name,
    CAST(CASE WHEN c_acctbal > 0 THEN FLOOR(c_acctbal) ELSE 0 END AS BIGINT) AS ch_subscribers,
    {AS_OF_SQL} - to_days(CAST(c_custkey % 600 + 1 AS INTEGER)) AS channel_created
  FROM customer),
raw0 AS (
  SELECT o_orderkey AS video_id,
    CONCAT(o_orderpriority, REPEAT('x', CAST(o_orderkey % 97 AS INTEGER))) AS title,
    o_custkey AS channel_id,
    o_orderdate + to_minutes(CAST(o_orderkey*37 % 1440 AS INTEGER)) AS publish_date,
    COALESCE(qty, 0) / CAST(6 AS DOUBLE) AS duration_minutes,
    CAST(FLOOR(COALESCE(cents, 0) / CAST(100 AS DOUBLE)) AS BIGINT) AS views,
    CAST(COALESCE(li.likes, 0) AS BIGINT) AS likes,
    CAST(COALESCE(li.comments, 0) AS BIGINT) AS comments
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey),
{raw},
typed AS (
  SELECT raw.*, ch.channel_name, ch.ch_subscribers, ch.channel_created
  FROM raw {typed_join} ch ON raw.channel_id = ch.channel_id),
rates AS (
  SELECT typed.*,
    CAST(hour(publish_date) AS INTEGER) AS publish_hour,
    dayname(publish_date) AS publish_day,
    strftime(publish_date, '%Y-%m') AS publish_month,
    CAST(month(publish_date) AS INTEGER) AS publish_month_num,
    CAST(year(publish_date) AS INTEGER) AS publish_year,
    {_period(period_mode)} AS posting_period,
    {age} AS video_age_days,
    {_z('likes + comments', 'views')} * 100 AS engagement_rate,
    {_z('likes', 'views')} * 100 AS like_rate,
    {_z('comments', 'views')} * 100 AS comment_rate,
    {_z('likes', 'comments')} AS likes_per_comment,
    {_z('views', f'{age} + 1')} AS views_per_day,
    CAST(length(title) AS INTEGER) AS title_length
  FROM typed),
qs AS (SELECT quantile_cont(views, 0.25) AS q25, quantile_cont(views, 0.75) AS q75 FROM rates),
videos AS (
  SELECT rates.*, {cat} AS performance_category FROM rates, qs),
agg AS (
  SELECT channel_id, channel_name, COUNT(video_id) AS videos,
    CAST(SUM(views) AS BIGINT) AS total_views, CAST(SUM(likes) AS BIGINT) AS total_likes,
    CAST(SUM(comments) AS BIGINT) AS total_comments,
    CAST(SUM(likes) AS DOUBLE) / COUNT(likes) AS avg_likes,
    CAST(SUM(views) AS DOUBLE) / COUNT(views) AS avg_views,
    AVG(duration_minutes) AS avg_duration, AVG(engagement_rate) AS avg_engagement_rate
  FROM videos WHERE channel_id IS NOT NULL AND channel_name IS NOT NULL
  GROUP BY channel_id, channel_name),
chm AS (
  SELECT agg.*, ch.ch_subscribers AS subscribers, ch.channel_created,
    {_age('ch.channel_created', False)} AS channel_age_days
  FROM agg LEFT JOIN ch ON agg.channel_id = ch.channel_id),
channels AS (
  SELECT channel_id, channel_name, videos, total_views, total_likes, total_comments, avg_likes,
    avg_views, avg_duration, avg_engagement_rate, subscribers, channel_created,
    {_z('total_views', 'videos')} AS avg_views_per_video,
    COALESCE({_div('total_likes', 'total_views')} * 1000, 0) AS likes_per_1000_views,
    {_z('total_views', 'subscribers')} AS views_per_subscriber,
    COALESCE({_div('total_likes', 'total_views')} + {_z('total_views', 'subscribers')}, 0) AS engagement_score,
    channel_age_days,
    COALESCE({_div('videos', 'channel_age_days')} * 30, 0) AS videos_per_month
  FROM chm)"""


# fixed values: the filtered-report spec (mirrors catalog.REPORT_SPEC)
REPORT_FILTER = ("publish_date >= TIMESTAMP '1997-01-01 00:00:00' AND publish_date < TIMESTAMP '2000-01-01 00:00:00' "
                 "AND performance_category IN ('High', 'Medium')")

# the by-channel queries
CHANNEL_NAMES = "('Customer#000000001', 'Customer#000000002', 'Customer#000000004', 'Customer#000000007', " \
    "'Customer#000000011', 'Customer#000000050', 'Customer#000000100', 'Customer#000000149')"
CHANNEL_FILTER = ("publish_date >= TIMESTAMP '1996-03-01 00:00:00' AND publish_date < TIMESTAMP '2000-07-01 00:00:00' "
                  f"AND performance_category IN ('High', 'Medium', 'Low') AND channel_name IN {CHANNEL_NAMES}")
ALL_FILTER = ("publish_date IS NOT NULL AND channel_name IS NOT NULL "
              "AND performance_category IN ('High', 'Medium', 'Low')")

# buckets, labels and thresholds as the reports state them
DURATION_EDGES = [0, 5, 10, 15, 20, 100]
DURATION_LABELS = ["0-5min", "5-10min", "10-15min", "15-20min", "20+min"]
DURATION_LABELS_SHORT = ["0-5", "5-10", "10-15", "15-20", "20+"]
TITLE_EDGES = [0, 40, 60, 80, 200]
TITLE_LABELS = ["Short (<40)", "Medium (40-60)", "Long (60-80)", "Very Long (80+)"]
FREQUENCY_EDGES = [0, 4, 8, 12, 20, 100]
KPI_THRESHOLDS = {"video_efficiency": 100.0, "interaction_score": 50.0, "consistency": 80.0,
                  "virality_index": 200.0, "quality_score": 60.0}
QUANTILE_COLUMNS = ["views", "engagement_rate", "like_rate", "views_per_day", "duration_minutes"]
DEEP_COLUMNS = ["publish_hour", "title_length", "views", "engagement_rate", "duration_minutes"]
QUANTILE_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]

VIDEO_FLOATS = ["duration_minutes", "engagement_rate", "like_rate", "comment_rate", "likes_per_comment",
                "views_per_day"]
CHANNEL_FLOATS = ["avg_likes", "avg_views", "avg_duration", "avg_engagement_rate", "avg_views_per_video",
                  "likes_per_1000_views", "views_per_subscriber", "engagement_score", "videos_per_month"]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CATS = ["High", "Medium", "Low"]


def _q(body: str, floats: list[str], ctes: str | None = None, extra: str = "") -> str:
    ctes = base_ctes() if ctes is None else ctes
    sql = f"WITH {ctes}{(',' + extra) if extra else ''}\n{body}"
    if not floats:
        return sql
    rep = ", ".join(f"round({c} * CAST(1000000 AS DOUBLE)) / CAST(1000000 AS DOUBLE) AS {c}" for c in floats)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


FEATURES = f"""
mv AS (SELECT AVG(views) AS _mean_views FROM videos),
feat AS (
  SELECT v.video_id, v.channel_id, v.views, v.likes, v.comments, v.ch_subscribers, v.duration_minutes,
    v.title_length, v.publish_hour, v.publish_day, v.performance_category,
    CAST(v.likes + v.comments AS DOUBLE) / CAST(v.views + 1 AS DOUBLE) AS early_engagement_rate,
    CAST(v.likes AS DOUBLE) / CAST(v.views + 1 AS DOUBLE) AS likes_views_ratio,
    CAST(v.comments AS DOUBLE) / CAST(v.views + 1 AS DOUBLE) AS comments_views_ratio,
    CAST(CASE WHEN v.publish_day IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
    CAST(v.publish_hour AS DOUBLE) / 24 AS hour_encoded,
    COALESCE(c.avg_views_per_video, mv._mean_views) AS avg_views_per_video,
    CAST('0x' || substring(md5(CAST(v.video_id AS VARCHAR)), 1, 7) AS BIGINT) % 10 < 3 AS is_test
  FROM videos v LEFT JOIN channels c ON v.channel_id = c.channel_id, mv),
lab AS (
  SELECT feat.*, {_div('views', 'ch_subscribers')} AS views_per_subscriber FROM feat),
vt AS (SELECT quantile_cont(views_per_subscriber, 0.75) AS vt FROM lab),
labeled AS (
  SELECT lab.*, CAST(COALESCE(views_per_subscriber > vt, false) AS INTEGER) AS is_viral FROM lab, vt),
rule_bin AS (
  SELECT video_id, is_viral AS label, CAST(views > 2 * m AS INTEGER) AS prediction
  FROM labeled, (SELECT AVG(views) AS m FROM labeled) WHERE is_test),
rule_cat AS (
  SELECT video_id, performance_category AS label,
    CASE WHEN likes >= 12000 THEN 'High' WHEN likes < 4000 THEN 'Low' ELSE 'Medium' END AS prediction
  FROM feat WHERE is_test),
rule_views AS (
  SELECT video_id, CAST(views AS DOUBLE) AS label, avg_views_per_video AS prediction FROM feat WHERE is_test),
train AS (SELECT COUNT(*) AS training_rows FROM feat WHERE NOT is_test)"""


def _hist(source: str, col: str, bins: int = 30) -> str:
    return f"""
hv AS (SELECT CAST({col} AS DOUBLE) AS x FROM {source} WHERE {col} IS NOT NULL AND NOT isnan({col})),
hs AS (SELECT MIN(x) AS lo, COUNT(*) AS n, (MAX(x) - MIN(x)) / {bins} AS w FROM hv),
hc AS (
  SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE LEAST(FLOOR((x - lo) / w), {bins - 1}) END AS INTEGER) AS bin,
    COUNT(*) AS videos
  FROM hv, hs GROUP BY 1),
hg AS (SELECT CAST(g.bin AS INTEGER) AS bin, lo, w FROM hs, range(0, {bins}) AS g(bin) WHERE n > 0),
hist AS (
  SELECT hg.bin, lo + hg.bin * w AS bin_start, lo + (hg.bin + 1) * w AS bin_end,
    CAST(COALESCE(hc.videos, 0) AS BIGINT) AS videos
  FROM hg LEFT JOIN hc ON hg.bin = hc.bin)"""


def _kpis(source: str = "videos") -> str:
    den = "(duration_minutes * CAST(ch_subscribers AS DOUBLE))"
    return f"""
one AS (
  SELECT
    AVG(CASE WHEN {den} = 0 THEN CASE WHEN views <> 0 THEN CAST(0 AS DOUBLE) END
             ELSE CAST(views AS DOUBLE) / {den} END) AS eff_mean,
    AVG(like_rate) AS lr_mean, AVG(comment_rate) AS cr_mean,
    AVG({_div('views', 'ch_subscribers')}) AS vir_mean,
    MAX(like_rate) AS lr_max, MAX(comment_rate) AS cr_max, MAX(views_per_day) AS vpd_max,
    AVG(views_per_day) AS vpd_mean
  FROM {source}),
pc AS (
  SELECT stddev_samp(views) / NULLIF(CAST(SUM(views) AS DOUBLE) / COUNT(views), 0) AS cv
  FROM {source} WHERE channel_name IS NOT NULL GROUP BY channel_name),
kpis AS (
  SELECT COALESCE(eff_mean * 1000, 0) AS video_efficiency,
    COALESCE(lr_mean * 0.5 + cr_mean * 100 * 0.5, 0) AS interaction_score,
    COALESCE(100 - cv_mean, 0) AS consistency,
    COALESCE(vir_mean * 100, 0) AS virality_index,
    COALESCE(CASE WHEN lr_max <> 0 AND cr_max <> 0 AND vpd_max <> 0
      THEN 40 * lr_mean / lr_max + 30 * cr_mean / cr_max + 30 * vpd_mean / vpd_max ELSE 0 END, 0) AS quality_score
  FROM one, (SELECT AVG(cv) AS cv_mean FROM pc))"""


def _best(expr: str, order: str, source: str, name: str, metric: str) -> str:
    return (f"(SELECT k AS {name} FROM (SELECT {expr} AS k, {order} AS o, AVG({metric}) AS m FROM {source} "
            f"GROUP BY 1, 2) WHERE k IS NOT NULL AND m IS NOT NULL ORDER BY m DESC, o ASC LIMIT 1)")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["enriched_videos"] = _q("SELECT * FROM videos", VIDEO_FLOATS)
    q["enriched_videos_batch_mode"] = _q(
        "SELECT * FROM videos", VIDEO_FLOATS,
        ctes=base_ctes(period_mode="month_third", absolute_age=False, low_inclusive=False))
    q["videos_inner_channel"] = _q("SELECT * FROM typed", ["duration_minutes"],
                                   ctes=base_ctes(typed_join="JOIN"))
    q["channel_rollup"] = _q("SELECT * FROM channels", CHANNEL_FLOATS)
    q["channel_rollup_batch_mode"] = _q(f"""
SELECT channel_id, channel_name, videos, total_views, total_likes, total_comments, avg_likes, avg_views,
  avg_duration, avg_engagement_rate, subscribers, channel_created,
  {_z('total_views', 'videos')} AS avg_views_per_video,
  COALESCE({_div('total_likes', 'total_views')} * 1000, 0) AS likes_per_1000_views,
  {_z('total_views', 'subscribers')} AS views_per_subscriber,
  COALESCE({_div('total_likes', 'total_views')} + {_z('total_views', 'subscribers')}, 0) AS engagement_score,
  channel_age_days,
  COALESCE({_div('videos', 'channel_age_days')} * 30, 0) AS videos_per_month
FROM (SELECT r.*, {_age('r.channel_created', False)} AS channel_age_days
      FROM (SELECT channel_id, channel_name, COUNT(video_id) AS videos,
              CAST(SUM(views) AS BIGINT) AS total_views, CAST(SUM(likes) AS BIGINT) AS total_likes,
              CAST(SUM(comments) AS BIGINT) AS total_comments,
              CAST(SUM(likes) AS DOUBLE) / COUNT(likes) AS avg_likes,
              CAST(SUM(views) AS DOUBLE) / COUNT(views) AS avg_views,
              AVG(duration_minutes) AS avg_duration, AVG(engagement_rate) AS avg_engagement_rate,
              MAX(ch_subscribers) AS subscribers, MAX(channel_created) AS channel_created
            FROM videos WHERE channel_id IS NOT NULL AND channel_name IS NOT NULL
            GROUP BY channel_id, channel_name) r)""", CHANNEL_FLOATS,
        ctes=base_ctes(period_mode="month_third", absolute_age=False, low_inclusive=False))
    q["channel_profile"] = _q(f"""
SELECT channel_id, channel_name, videos, total_views, total_likes, total_comments, subscribers,
  channel_age_days,
  {_z('total_views', 'videos')} AS avg_views,
  {_z('total_likes', 'videos')} AS avg_likes,
  {_z('total_likes + total_comments', 'total_views')} * 100 AS avg_engagement_rate,
  {_z('total_views', 'videos')} AS avg_views_per_video,
  {_z('total_likes', 'total_views')} * 1000 AS likes_per_1000_views,
  {_z('total_views', 'subscribers')} AS views_per_subscriber,
  {_z('total_likes + total_comments', 'total_views')} * 100 * ln(1 + CAST(subscribers AS DOUBLE)) AS engagement_score,
  {_z('videos', 'CAST(channel_age_days AS DOUBLE) / 30')} AS videos_per_month
FROM channels""", ["avg_views", "avg_likes", "avg_engagement_rate", "avg_views_per_video",
                   "likes_per_1000_views", "views_per_subscriber", "engagement_score", "videos_per_month"])
    q["snapshot_profile"] = _q("""
SELECT (SELECT COUNT(*) FROM channels) AS channels, COUNT(*) AS videos,
  CAST(COALESCE(SUM(views), 0) AS BIGINT) AS total_views, CAST(COALESCE(SUM(likes), 0) AS BIGINT) AS total_likes,
  CAST(MIN(publish_date) AS DATE) AS first_date, CAST(MAX(publish_date) AS DATE) AS last_date
FROM videos""", [])
    q["filtered_profile"] = _q(f"""
SELECT (SELECT COUNT(*) FROM channels) AS channels, COUNT(*) AS videos,
  CAST(COALESCE(SUM(views), 0) AS BIGINT) AS total_views, CAST(COALESCE(SUM(likes), 0) AS BIGINT) AS total_likes,
  CAST(MIN(publish_date) AS DATE) AS first_date, CAST(MAX(publish_date) AS DATE) AS last_date
FROM videos WHERE {REPORT_FILTER}""", [])
    q["filtered_strategic_kpis"] = _q("SELECT * FROM kpis", ["video_efficiency", "interaction_score", "consistency",
                                                           "virality_index", "quality_score"],
                                      extra=f"fvid AS (SELECT * FROM videos WHERE {REPORT_FILTER})," + _kpis("fvid"))
    q["filter_domain"] = _q("""
SELECT n.channel_name, r.first_date, r.last_date
FROM (SELECT DISTINCT channel_name FROM channels WHERE channel_name IS NOT NULL) n,
     (SELECT CAST(MIN(publish_date) AS DATE) AS first_date, CAST(MAX(publish_date) AS DATE) AS last_date
      FROM videos) r""", [])
    q["filtered_videos"] = _q(f"SELECT * FROM videos WHERE {REPORT_FILTER}", VIDEO_FLOATS)
    q["filtered_channels"] = _q(f"SELECT * FROM channels WHERE channel_name IN {CHANNEL_NAMES}", CHANNEL_FLOATS)
    q["filtered_by_channel"] = _q(f"SELECT * FROM videos WHERE {CHANNEL_FILTER}", VIDEO_FLOATS)
    summary_floats = ["avg_views_per_video", "avg_engagement", "avg_subscribers", "views_per_day", "baseline_engagement",
                      "baseline_views_per_day", "delta_engagement", "delta_views_per_day_pct"]
    summary = f"""
SELECT total_views, total_videos,
  {_z('total_views', 'total_videos')} AS avg_views_per_video, avg_engagement, channels, total_subscribers,
  {_z('total_subscribers', 'channels')} AS avg_subscribers,
  views_per_day, baseline_engagement, baseline_views_per_day,
  avg_engagement - baseline_engagement AS delta_engagement,
  CASE WHEN baseline_views_per_day <> 0 THEN (views_per_day / baseline_views_per_day - 1) * 100
       ELSE CAST(0 AS DOUBLE) END AS delta_views_per_day_pct
FROM (SELECT CAST(COALESCE(SUM(views), 0) AS BIGINT) AS total_views, COUNT(*) AS total_videos,
        AVG(engagement_rate) AS avg_engagement, AVG(views_per_day) AS views_per_day
      FROM videos WHERE {REPORT_FILTER} AND channel_name IS NOT NULL) f,
     (SELECT COUNT(*) AS channels, CAST(COALESCE(SUM(subscribers), 0) AS BIGINT) AS total_subscribers FROM channels) c,
     (SELECT AVG(engagement_rate) AS baseline_engagement, AVG(views_per_day) AS baseline_views_per_day
      FROM videos) b"""
    q["executive_summary"] = _q(summary, summary_floats)

    def short(x: str) -> str:
        return (f"CASE WHEN coalesce({x}, 0) = 0 THEN '0' WHEN abs({x}) >= 1e9 THEN printf('%.1fB', {x} / 1e9) "
                f"WHEN abs({x}) >= 1e6 THEN printf('%.1fM', {x} / 1e6) "
                f"WHEN abs({x}) >= 1e3 THEN printf('%.1fK', {x} / 1e3) ELSE printf('%.0f', {x} / 1e0) END")

    shown = [("Total Views", short("total_views"), short("avg_views_per_video") + " || ' avg/video'"),
             ("Total Videos", "printf('%,d', total_videos)", "channels || ' channels'"),
             ("Avg Engagement", "printf('%.2f%%', avg_engagement)", "printf('%+.2f%%', delta_engagement)"),
             ("Total Subscribers", short("total_subscribers"), short("avg_subscribers") + " || ' avg'"),
             ("Views / Day", short("views_per_day"), "printf('%+.1f%%', delta_views_per_day_pct)")]
    q["executive_summary_text"] = _q(" UNION ALL ".join(
        f"SELECT '{name}' AS metric, {value} AS value, {note} AS note FROM summary" for name, value, note in shown),
        [], extra=f"summary AS ({summary})")
    dirty = base_ctes(dirty=True)
    fv = (f"fv AS (SELECT * REPLACE (COALESCE(video_id, 0) AS video_id) FROM videos WHERE {ALL_FILTER})")
    q["dirty_videos"] = _q("SELECT * FROM videos", VIDEO_FLOATS, ctes=dirty)
    q["dirty_inner"] = _q("SELECT * FROM typed", ["duration_minutes"], ctes=base_ctes(dirty=True, typed_join="JOIN"))
    q["dirty_filtered"] = _q("SELECT * FROM fv", VIDEO_FLOATS, ctes=dirty, extra=fv)
    q["dirty_executive_summary"] = _q(summary, summary_floats, ctes=dirty)
    q["dirty_channel_rollup"] = _q("SELECT * FROM channels", CHANNEL_FLOATS, ctes=dirty)
    kcols = ["video_efficiency", "interaction_score", "consistency", "virality_index", "quality_score"]
    q["strategic_kpis"] = _q("SELECT * FROM kpis", kcols, extra=_kpis())
    q["dirty_strategic_kpis"] = _q("SELECT * FROM kpis", kcols, ctes=dirty, extra=f"{fv},{_kpis('fv')}")
    q["kpi_ratings"] = _q(" UNION ALL ".join(
        f"SELECT '{k}' AS kpi, CAST({k} AS DOUBLE) AS value, CAST({t} AS DOUBLE) AS threshold, "
        f"CAST({k} AS DOUBLE) >= CAST({t} AS DOUBLE) AS meets_threshold FROM kpis"
        for k, t in KPI_THRESHOLDS.items()), ["value", "threshold"], extra=_kpis())
    q["engagement_trend"] = _q("""
SELECT CAST(publish_date AS DATE) AS publish_date, AVG(engagement_rate) AS engagement_rate
FROM videos WHERE publish_date IS NOT NULL GROUP BY 1""", ["engagement_rate"])
    q["views_by_category"] = _q(f"""
SELECT performance_category, CAST(SUM(views) AS BIGINT) AS views,
  COALESCE({_div('SUM(views)', 'SUM(SUM(views)) OVER ()')} * 100, 0) AS share_pct
FROM videos WHERE performance_category IS NOT NULL GROUP BY 1""", ["share_pct"])
    q["monthly_growth"] = _q("""
SELECT CAST(date_trunc('month', publish_date) AS DATE) AS month, CAST(SUM(views) AS BIGINT) AS views,
  COUNT(video_id) AS videos
FROM videos WHERE publish_date IS NOT NULL GROUP BY 1""", [])
    q["engagement_histogram"] = _q("SELECT * FROM hist", ["bin_start", "bin_end"],
                                   extra=_hist("videos", "engagement_rate"))
    q["engagement_by_weekday"] = _q(f"""
SELECT d.publish_day, CAST(d.day_order AS INTEGER) AS day_order, a.engagement_rate
FROM {_labels('publish_day', 'day_order', WEEKDAYS)} d
LEFT JOIN (SELECT publish_day, AVG(engagement_rate) AS engagement_rate FROM videos
           WHERE publish_day IS NOT NULL GROUP BY 1) a ON d.publish_day = a.publish_day""", ["engagement_rate"])
    q["driver_points"] = _q("""
SELECT video_id, title, channel_name, v.performance_category, views, likes, engagement_rate, duration_minutes,
  SQRT(CAST(views AS DOUBLE) / CAST(CASE WHEN vmax = 0 THEN 1 ELSE vmax END AS DOUBLE)) * 20 + 4 AS marker_size
FROM videos v JOIN (SELECT performance_category, MAX(views) AS vmax FROM videos
                    WHERE performance_category IS NOT NULL GROUP BY 1) m
  ON v.performance_category = m.performance_category""",
        ["engagement_rate", "duration_minutes", "marker_size"])
    def sample(videos: str) -> str:
        return f"""
SELECT video_id, title, channel_name, v.performance_category, views, likes, engagement_rate, duration_minutes,
  SQRT(CAST(views AS DOUBLE) / CAST(CASE WHEN vmax = 0 THEN 1 ELSE vmax END AS DOUBLE)) * 20 + 4 AS marker_size
FROM {videos} v JOIN (SELECT performance_category, MAX(views) AS vmax FROM {videos} GROUP BY 1) m
  ON v.performance_category = m.performance_category
QUALIFY row_number() OVER (PARTITION BY v.performance_category ORDER BY md5(CAST(video_id AS VARCHAR)), title, views) <= 150"""

    points = ["engagement_rate", "duration_minutes", "marker_size"]
    q["driver_points_sample"] = _q(sample("videos"), points)
    q["dirty_driver_points_sample"] = _q(sample("fv"), points, ctes=base_ctes(dirty=True), extra="""
fv AS (
  SELECT * FROM videos WHERE publish_date IS NOT NULL AND channel_name IS NOT NULL AND video_id IS NOT NULL
    AND performance_category IN ('High', 'Medium', 'Low'))""")
    q["duration_trend"] = _q("""
SELECT point, duration_minutes, slope * duration_minutes + intercept AS engagement_rate, slope, intercept
FROM (SELECT CAST(p.point AS INTEGER) AS point, slope, intercept,
        CASE WHEN p.point = 99 THEN hi ELSE p.point * ((hi - lo) / 99) + lo END AS duration_minutes
      FROM (SELECT COUNT(*) AS n, regr_slope(engagement_rate, duration_minutes) AS slope,
              regr_intercept(engagement_rate, duration_minutes) AS intercept,
              MIN(duration_minutes) AS lo, MAX(duration_minutes) AS hi
            FROM videos WHERE duration_minutes IS NOT NULL AND NOT isnan(duration_minutes)
              AND engagement_rate IS NOT NULL AND NOT isnan(engagement_rate)) s,
           range(0, 100) AS p(point)
      WHERE n > 1)""", ["duration_minutes", "engagement_rate", "slope", "intercept"])
    category_mix = f"""
SELECT d.performance_category, CAST(d.category_order AS INTEGER) AS category_order,
  CAST(COALESCE(c.videos, 0) AS BIGINT) AS videos,
  COALESCE({_div('COALESCE(c.videos, 0)', 't.total')} * 100, 0) AS pct
FROM {_labels('performance_category', 'category_order', CATS)} d
LEFT JOIN (SELECT performance_category, COUNT(*) AS videos FROM videos
           WHERE performance_category IS NOT NULL GROUP BY 1) c ON d.performance_category = c.performance_category,
  (SELECT COUNT(*) AS total FROM videos) t"""
    q["category_mix"] = _q(category_mix, ["pct"])
    q["dirty_category_mix"] = _q(category_mix, ["pct"], ctes=base_ctes(dirty=True))

    def bucket_q(col, edges, labels, bname):
        return _q(f"""
SELECT d.{bname}, CAST(d.bucket_order AS INTEGER) AS bucket_order, a.views
FROM {_labels(bname, 'bucket_order', labels)} d
LEFT JOIN (SELECT {bname}, CAST(SUM(views) AS DOUBLE) / COUNT(views) AS views
           FROM (SELECT {_cut(col, edges, labels)} AS {bname}, views FROM videos)
           WHERE {bname} IS NOT NULL GROUP BY 1) a ON d.{bname} = a.{bname}""", ["views"])

    q["views_by_duration"] = bucket_q("duration_minutes", DURATION_EDGES, DURATION_LABELS, "duration_bucket")
    q["views_by_title_length"] = bucket_q("title_length", TITLE_EDGES, TITLE_LABELS, "title_bucket")
    q["views_distribution"] = _q(f"""
SELECT d.performance_category, CAST(d.category_order AS INTEGER) AS category_order,
  CAST(COALESCE(s.videos, 0) AS BIGINT) AS videos, CAST(s.mn AS DOUBLE) AS min,
  CAST(s.q1 AS DOUBLE) AS q1, CAST(s.median AS DOUBLE) AS median, CAST(s.q3 AS DOUBLE) AS q3,
  CAST(s.mx AS DOUBLE) AS max, s.mean, s.std
FROM {_labels('performance_category', 'category_order', CATS)} d
LEFT JOIN (SELECT performance_category, COUNT(views) AS videos, MIN(views) AS mn, MAX(views) AS mx,
             CAST(SUM(views) AS DOUBLE) / COUNT(views) AS mean, stddev_samp(views) AS std,
             quantile_cont(views, 0.25) AS q1, quantile_cont(views, 0.5) AS median,
             quantile_cont(views, 0.75) AS q3
           FROM videos WHERE performance_category IS NOT NULL GROUP BY 1) s
  ON d.performance_category = s.performance_category""",
        ["min", "q1", "median", "q3", "max", "mean", "std"])
    radar_cols = ["views", "likes", "comments", "engagement_rate", "views_per_day"]
    scaled = ", ".join(
        f"CASE WHEN MAX({m}) OVER () - MIN({m}) OVER () <> 0 THEN ({m} - MIN({m}) OVER ()) / "
        f"(MAX({m}) OVER () - MIN({m}) OVER ()) * 100 ELSE CAST(0 AS DOUBLE) END AS {m}" for m in radar_cols)
    q["radar"] = _q(f"""
SELECT performance_category, {scaled}
FROM (SELECT performance_category, CAST(SUM(views) AS DOUBLE) / COUNT(views) AS views,
        CAST(SUM(likes) AS DOUBLE) / COUNT(likes) AS likes, CAST(SUM(comments) AS DOUBLE) / COUNT(comments) AS comments,
        AVG(engagement_rate) AS engagement_rate, AVG(views_per_day) AS views_per_day
      FROM videos WHERE performance_category IS NOT NULL GROUP BY 1)""", radar_cols)
    days = ", ".join(f'AVG(views) FILTER (WHERE publish_day = \'{d}\') AS "{d}"' for d in WEEKDAYS)
    q["publish_heatmap"] = _q(f"SELECT publish_hour, {days} FROM videos WHERE publish_hour IS NOT NULL GROUP BY 1",
                              WEEKDAYS)
    q["period_performance"] = _q("""
SELECT posting_period, CAST(SUM(views) AS DOUBLE) / COUNT(views) AS views, AVG(engagement_rate) AS engagement_rate
FROM videos WHERE posting_period IS NOT NULL GROUP BY 1""", ["views", "engagement_rate"])
    q["publishing_calendar"] = _q("""
SELECT CAST(publish_date AS DATE) AS publish_date, COUNT(video_id) AS videos
FROM videos WHERE publish_date IS NOT NULL GROUP BY 1""", [])
    def long(report: str, key: str, measures: dict[str, str], source: str) -> str:
        """Rows (report, item, measure, value) of a report."""
        return " UNION ALL ".join(f"SELECT '{report}' AS report, CAST({key} AS VARCHAR) AS item, '{m}' AS measure, "
                                  f"CAST({x} AS DOUBLE) AS value FROM {source}" for m, x in measures.items())

    def grouped(report: str, key: str, name: str, measures: dict[str, str]) -> str:
        inner = ", ".join(f"{x} AS {m}" for m, x in measures.items())
        return long(report, name, {m: m for m in measures},
                    f"(SELECT {key} AS {name}, {inner} FROM fv WHERE {key} IS NOT NULL GROUP BY 1)")

    def of_labels(report: str, key: str, name: str, labels: list[str], measure: str, x: str) -> str:
        return long(report, f"d.{name}", {measure: "a.m"}, f"""{_labels(name, 'o', labels)} d
LEFT JOIN (SELECT {key} AS {name}, {x} AS m FROM fv GROUP BY 1) a ON d.{name} = a.{name}""")

    views_mean, rate_mean = "CAST(SUM(views) AS DOUBLE) / COUNT(views)", "AVG(engagement_rate)"
    date, cat = "CAST(publish_date AS DATE)", "performance_category"
    radar_means = {c: f"AVG({c})" for c in radar_cols}
    scaled_means = {c: f"CASE WHEN hi_{c} <> lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) * 100 ELSE 0 END" for c in radar_cols}
    dashboard = " UNION ALL ".join([
        grouped("engagement_trend", date, "day", {"engagement_rate": rate_mean}),
        grouped("publishing_calendar", date, "day", {"videos": "COUNT(video_id)"}),
        grouped("monthly_growth", "CAST(date_trunc('month', publish_date) AS DATE)", "month",
                {"views": "SUM(views)", "videos": "COUNT(video_id)"}),
        of_labels("engagement_by_weekday", "publish_day", "publish_day", WEEKDAYS, "engagement_rate", rate_mean),
        grouped("period_performance", "posting_period", "period", {"views": views_mean, "engagement_rate": rate_mean}),
        grouped("views_by_category", cat, "cat", {"views": "SUM(views)",
                                                  "share_pct": f"COALESCE({_div('SUM(views)', 'SUM(SUM(views)) OVER ()')} * 100, 0)"}),
        of_labels("category_mix", cat, "cat", CATS, "videos", "COUNT(*)").replace("CAST(a.m", "CAST(COALESCE(a.m, 0)"),
        of_labels("category_mix", cat, "cat", CATS, "pct", "COUNT(*) * 100.0 / (SELECT COUNT(*) FROM fv)")
        .replace("CAST(a.m", "CAST(COALESCE(a.m, 0)"),
        long("radar", cat, scaled_means, f"(SELECT *, {', '.join(f'MIN({c}) OVER () AS lo_{c}, MAX({c}) OVER () AS hi_{c}' for c in radar_cols)} "
             f"FROM (SELECT {cat}, {', '.join(f'{x} AS {c}' for c, x in radar_means.items())} FROM fv GROUP BY 1) g) r"),
        of_labels("views_by_duration", _cut("duration_minutes", DURATION_EDGES, DURATION_LABELS), "bucket", DURATION_LABELS,
                  "views", views_mean),
        of_labels("views_by_title_length", _cut("title_length", TITLE_EDGES, TITLE_LABELS), "bucket", TITLE_LABELS,
                  "views", views_mean),
        *[grouped("publish_heatmap", "publish_hour", "hour", {d: f"AVG(views) FILTER (WHERE publish_day = '{d}')"})
          for d in WEEKDAYS],
    ])
    q["dashboard_reports"] = _q(dashboard, ["value"], extra=f"fv AS (SELECT * FROM videos WHERE {REPORT_FILTER})")
    q["dirty_dashboard_reports"] = _q(dashboard, ["value"], ctes=dirty, extra=fv)
    q["top_channels"] = _q("""
SELECT channel_id, channel_name, total_views FROM channels
ORDER BY total_views DESC, channel_id ASC LIMIT 10""", [])
    q["top_videos"] = _q("""
SELECT video_id, title, channel_name, views, likes, comments, engagement_rate, performance_category
FROM videos ORDER BY views DESC, video_id ASC LIMIT 20""", ["engagement_rate"])
    q["frequency_vs_performance"] = _q("""
SELECT channel_id, channel_name, videos_per_month, avg_views FROM channels
ORDER BY avg_views DESC, channel_id ASC LIMIT 10""", ["videos_per_month", "avg_views"])
    for name, columns in (("quantile_table", QUANTILE_COLUMNS), ("quantile_table_deep", DEEP_COLUMNS)):
        q[name] = _q(" UNION ALL ".join(
            f"SELECT '{c}' AS metric, CAST({p} AS DOUBLE) AS p, CAST(quantile_cont({c}, {p}) AS DOUBLE) AS value "
            f"FROM videos WHERE {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))"
            for c in columns for p in QUANTILE_PROBS), ["p", "value"])
    feat_cols = ["video_id", "channel_id", "views", "likes", "comments", "ch_subscribers", "duration_minutes",
                 "title_length", "publish_hour", "publish_day", "performance_category", "early_engagement_rate",
                 "likes_views_ratio", "comments_views_ratio", "is_weekend", "hour_encoded", "avg_views_per_video"]
    q["ml_features"] = _q(f"SELECT {', '.join(feat_cols)} FROM feat",
                          ["duration_minutes", "early_engagement_rate", "likes_views_ratio", "comments_views_ratio",
                           "hour_encoded", "avg_views_per_video"], extra=FEATURES)
    q["ml_split"] = _q("SELECT video_id, is_test FROM feat", [], extra=FEATURES)
    q["viral_label"] = _q("SELECT video_id, views_per_subscriber, is_viral FROM labeled",
                          ["views_per_subscriber"], extra=FEATURES)
    q["binary_metrics"] = _q("""
SELECT COUNT(*) AS test_rows,
  COALESCE(CAST(COUNT(*) FILTER (WHERE label = prediction) AS DOUBLE) / NULLIF(COUNT(*), 0), 0) AS accuracy,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0) AS precision,
  COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS recall,
  COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fp + fn, 0), 0) AS f1
FROM (SELECT *, COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) OVER () AS tp,
        COUNT(*) FILTER (WHERE label <> 1 AND prediction = 1) OVER () AS fp,
        COUNT(*) FILTER (WHERE label = 1 AND prediction <> 1) OVER () AS fn FROM rule_bin)
GROUP BY tp, fp, fn""", ["accuracy", "precision", "recall", "f1"], extra=FEATURES)
    grid = f"""(SELECT a.actual, a.actual_order, p.predicted, p.predicted_order
  FROM {_labels('actual', 'actual_order', CATS)} a, {_labels('predicted', 'predicted_order', CATS)} p)"""
    cm = f"""
cm AS (
  SELECT g.actual, CAST(g.actual_order AS INTEGER) AS actual_order, g.predicted,
    CAST(g.predicted_order AS INTEGER) AS predicted_order, CAST(COALESCE(c.videos, 0) AS BIGINT) AS videos
  FROM {grid} g LEFT JOIN (SELECT label AS actual, prediction AS predicted, COUNT(*) AS videos
                           FROM rule_cat GROUP BY 1, 2) c
    ON g.actual = c.actual AND g.predicted = c.predicted)"""
    q["confusion_matrix"] = _q("SELECT * FROM cm", [], extra=FEATURES + "," + cm)
    q["multiclass_metrics"] = _q("""
SELECT COALESCE(CAST(COUNT(*) FILTER (WHERE label = prediction) AS DOUBLE) / NULLIF(COUNT(*), 0), 0) AS accuracy,
  CAST(3 AS INTEGER) AS classes, MIN(training_rows) AS training_rows
FROM rule_cat, train""", ["accuracy"], extra=FEATURES)
    q["regression_metrics"] = _q("""
SELECT 1 - CAST(ss_res AS DOUBLE) / NULLIF(ss_tot, 0) AS r2, mae, training_rows
FROM (SELECT SUM((label - prediction) * (label - prediction)) AS ss_res,
        SUM((label - ybar) * (label - ybar)) AS ss_tot, AVG(ABS(label - prediction)) AS mae
      FROM rule_views, (SELECT AVG(label) AS ybar FROM rule_views)), train""", ["r2", "mae"], extra=FEATURES)
    q["rmse_residuals"] = _q("""
SELECT hist.*, r.rmse
FROM hist, (SELECT SQRT(AVG((label - prediction) * (label - prediction))) AS rmse FROM rule_views) r""",
        ["bin_start", "bin_end", "rmse"],
        extra=(FEATURES + ",\nres AS (SELECT label - prediction AS residual FROM rule_views),"
               + _hist("res", "residual")))
    q["per_class_metrics"] = _q("""
SELECT a.actual AS class, a.actual_order AS class_order,
  COALESCE(CAST(a.tp AS DOUBLE) / NULLIF(CAST(p.n_predicted AS DOUBLE), 0), 0) AS precision,
  COALESCE(CAST(a.tp AS DOUBLE) / NULLIF(CAST(a.support AS DOUBLE), 0), 0) AS recall,
  COALESCE(CAST(2 * a.tp AS DOUBLE) / NULLIF(CAST(a.support + p.n_predicted AS DOUBLE), 0), 0) AS f1,
  CAST(a.support AS BIGINT) AS support
FROM (SELECT actual, actual_order, SUM(CASE WHEN actual = predicted THEN videos ELSE 0 END) AS tp,
        SUM(videos) AS support FROM cm GROUP BY 1, 2) a
JOIN (SELECT predicted, SUM(videos) AS n_predicted FROM cm GROUP BY 1) p ON a.actual = p.predicted""",
        ["precision", "recall", "f1"], extra=FEATURES + "," + cm)
    dur = _best(_cut("duration_minutes", DURATION_EDGES, DURATION_LABELS_SHORT),
                _cut_order("duration_minutes", DURATION_EDGES), "videos", "best_duration", "CAST(views AS DOUBLE)")
    hour = _best("publish_hour", "publish_hour", "videos", "best_hour", "CAST(views AS DOUBLE)")
    day = _best("publish_day", "publish_day", "videos", "best_day", "CAST(views AS DOUBLE)")
    freq_labels = [f"({lo}, {hi}]" for lo, hi in zip(FREQUENCY_EDGES, FREQUENCY_EDGES[1:])]
    freq = _best(_cut("videos_per_month", FREQUENCY_EDGES, freq_labels),
                 _cut_order("videos_per_month", FREQUENCY_EDGES), "channels", "best_frequency", "avg_views")
    q["recommendations"] = _q(f"""
SELECT bd.best_duration, CAST(bh.best_hour AS INTEGER) AS best_hour, bday.best_day, bf.best_frequency,
  m.target_engagement, m.avg_title_length, qv.engagement_q75, qv.like_rate_q75, qc.engagement_score_q75,
  t.top_views_per_subscriber, t.top_videos_per_month
FROM (SELECT AVG(engagement_rate) AS target_engagement,
        CAST(SUM(title_length) AS DOUBLE) / COUNT(title_length) AS avg_title_length FROM videos) m
CROSS JOIN (SELECT quantile_cont(engagement_rate, 0.75) AS engagement_q75,
              quantile_cont(like_rate, 0.75) AS like_rate_q75 FROM videos) qv
CROSS JOIN (SELECT quantile_cont(engagement_score, 0.75) AS engagement_score_q75 FROM channels) qc
CROSS JOIN (SELECT AVG(views_per_subscriber) AS top_views_per_subscriber,
              AVG(videos_per_month) AS top_videos_per_month
            FROM channels WHERE engagement_score > (SELECT quantile_cont(engagement_score, 0.75) FROM channels)) t
LEFT JOIN {dur} bd ON TRUE
LEFT JOIN {hour} bh ON TRUE
LEFT JOIN {day} bday ON TRUE
LEFT JOIN {freq} bf ON TRUE""", ["target_engagement", "avg_title_length", "engagement_q75", "like_rate_q75",
                               "engagement_score_q75", "top_views_per_subscriber", "top_videos_per_month"])
    vir = _div("views", "ch_subscribers")
    names = ["Avg Views", "Engagement", "Like Rate", "Videos/Month", "Virality Index"]
    long = " UNION ALL ".join(
        f"SELECT '{n}' AS metric, {i} AS metric_order, CAST(m{i} AS DOUBLE) AS your_value, "
        f"CAST(b{i} AS DOUBLE) AS benchmark_value FROM y, yc, b, bc" for i, n in enumerate(names))
    q["benchmark_index"] = _q(f"""
SELECT metric, CAST(metric_order AS INTEGER) AS metric_order, your_value, benchmark_value,
  CASE WHEN benchmark_value IS NOT NULL AND benchmark_value <> 0 THEN your_value / benchmark_value * 100
       ELSE CAST(0 AS DOUBLE) END AS performance,
  CAST(100 AS DOUBLE) AS benchmark
FROM ({long})""", ["your_value", "benchmark_value", "performance", "benchmark"], extra=f"""
y AS (SELECT CAST(SUM(views) AS DOUBLE) / COUNT(views) AS m0, AVG(engagement_rate) AS m1, AVG(like_rate) AS m2,
        AVG({vir}) * 100 AS m4 FROM videos WHERE {REPORT_FILTER}),
yc AS (SELECT AVG(videos_per_month) AS m3 FROM channels),
b AS (SELECT quantile_cont(views, 0.75) AS b0, quantile_cont(engagement_rate, 0.75) AS b1,
        quantile_cont(like_rate, 0.75) AS b2, quantile_cont({vir}, 0.75) * 100 AS b4 FROM videos),
bc AS (SELECT quantile_cont(videos_per_month, 0.75) AS b3 FROM channels)""")
    data_check = """
SELECT COUNT(*) AS videos,
  COUNT(*) FILTER (WHERE publish_date IS NULL) AS null_publish_dates,
  COUNT(*) FILTER (WHERE views < 0) AS negative_views,
  COUNT(*) FILTER (WHERE likes < 0) AS negative_likes,
  COUNT(*) FILTER (WHERE comments < 0) AS negative_comments,
  COUNT(*) FILTER (WHERE COALESCE(ch_subscribers, 0) <= 0) AS subscribers_not_positive,
  COUNT(*) FILTER (WHERE COALESCE(duration_minutes, 0) <= 0) AS duration_not_positive,
  COUNT(*) FILTER (WHERE NOT COALESCE(performance_category IN ('High', 'Medium', 'Low'), false)) AS bad_category,
  COUNT(*) FILTER (WHERE title <> trim(title)) AS untrimmed_titles,
  COUNT(*) FILTER (WHERE channel_name <> trim(channel_name)) AS untrimmed_channel_names,
  COUNT(*) FILTER (WHERE video_id IS NULL) AS null_ids,
  COUNT(video_id) - COUNT(DISTINCT video_id) AS duplicate_ids
FROM videos"""
    q["data_check"] = _q(data_check, [])
    q["dirty_data_check"] = _q(data_check, [], ctes=dirty)
    q["views_engagement_corr"] = _q("""
SELECT COUNT(*) AS videos, corr(CAST(views AS DOUBLE), engagement_rate) AS corr_views_engagement FROM videos""",
        ["corr_views_engagement"])
    # after two fetches the tables equal the test views
    for name in ("channel_rollup", "channel_profile", "engagement_trend", "monthly_growth", "engagement_by_weekday",
                 "publishing_calendar", "publish_heatmap"):
        q[f"refreshed_{name}"] = q[name]
    q["refreshed_videos"] = q["bucketed_videos"] = q["enriched_videos"]
    q["bucketed_channel_rollup"] = q["channel_rollup"]
    q["refreshed_thresholds"] = _q("SELECT q25, q75 FROM qs", ["q25", "q75"])
    eight = ", ".join(f"'Customer#{k:09d}'" for k in (1, 2, 4, 7, 11, 50, 100, 149))
    q["refreshed_channel_trend"] = _q(f"""
SELECT CAST(publish_date AS DATE) AS publish_date, AVG(engagement_rate) AS engagement_rate FROM videos
WHERE CAST(publish_date AS DATE) BETWEEN DATE '1996-03-01' AND DATE '2000-06-30' AND channel_name IN ({eight})
GROUP BY 1""", ["engagement_rate"])
    q["csv_videos"] = _q("""
SELECT * REPLACE (title || CASE WHEN video_id % 13 = 0 THEN chr(10) || '"second", line' || chr(10) || chr(10) || 'end'
                           WHEN video_id % 7 = 0 THEN ' "q", x' ELSE '' END AS title,
                  CAST(video_id AS VARCHAR) AS video_id, CAST(channel_id AS VARCHAR) AS channel_id)
FROM videos""", VIDEO_FLOATS)
    def weeks(condition: str) -> str:
        return f"""
SELECT w.week, COALESCE(w.views, 0) AS views, COALESCE(w.videos, 0) AS videos, w.engagement_rate,
  {_div('COALESCE(w.views, 0)', 'p.views')} * 100 - 100 AS views_change_pct,
  {_div('COALESCE(w.videos, 0)', 'p.videos')} * 100 - 100 AS videos_change_pct
FROM (SELECT s.week, a.views, a.videos, a.engagement_rate
      FROM (SELECT CAST(unnest(generate_series(MIN(week), MAX(week), INTERVAL 7 DAY)) AS DATE) AS week FROM weekly) s
      LEFT JOIN weekly a ON a.week = s.week) w
LEFT JOIN weekly p ON p.week = w.week - 7""", f"""
weekly AS (
  SELECT CAST(date_trunc('week', publish_date) AS DATE) AS week, CAST(SUM(views) AS BIGINT) AS views,
    COUNT(video_id) AS videos, AVG(engagement_rate) AS engagement_rate
  FROM videos WHERE publish_date IS NOT NULL AND {condition} GROUP BY 1)"""

    changes = ["engagement_rate", "views_change_pct", "videos_change_pct"]
    gaps = "weekofyear(publish_date) % 5 <> 0"
    body, extra = weeks("TRUE")
    q["week_over_week"] = _q(body, changes, extra=extra)
    body, extra = weeks(gaps)
    q["dirty_week_over_week"] = _q(body, changes, ctes=base_ctes(dirty=True), extra=extra)
    q["dirty_daily_trend"] = _q("""
SELECT s.publish_date, a.engagement_rate
FROM (SELECT CAST(unnest(generate_series(MIN(publish_date), MAX(publish_date), INTERVAL 1 DAY)) AS DATE) AS publish_date FROM daily) s
LEFT JOIN daily a ON a.publish_date = s.publish_date""", ["engagement_rate"], ctes=base_ctes(dirty=True), extra=f"""
daily AS (
  SELECT CAST(publish_date AS DATE) AS publish_date, AVG(engagement_rate) AS engagement_rate
  FROM videos WHERE publish_date IS NOT NULL AND {gaps} GROUP BY 1)""")
    q["dirty_monthly_growth"] = _q("""
SELECT s.month, COALESCE(a.views, 0) AS views, COALESCE(a.videos, 0) AS videos
FROM (SELECT CAST(unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM monthly) s
LEFT JOIN monthly a ON a.month = s.month""", [], ctes=base_ctes(dirty=True), extra=f"""
monthly AS (
  SELECT CAST(date_trunc('month', publish_date) AS DATE) AS month, CAST(SUM(views) AS BIGINT) AS views, COUNT(video_id) AS videos
  FROM videos WHERE publish_date IS NOT NULL AND {gaps} AND publish_month_num <= 3 GROUP BY 1)""")
    q["last_90_days"] = _q("""
SELECT videos.* FROM videos, (SELECT CAST(MAX(publish_date) AS DATE) AS e FROM videos) a
WHERE CAST(publish_date AS DATE) >= a.e - 90 AND CAST(publish_date AS DATE) <= a.e""", VIDEO_FLOATS)
    q["axis_limit"] = _q("SELECT GREATEST(MAX(label), MAX(prediction)) AS axis_limit FROM rule_views", ["axis_limit"],
                         extra=FEATURES)
    q["virality_labels"] = _q("SELECT video_id, is_viral AS label FROM labeled WHERE is_test", [], extra=FEATURES)
    q["category_labels"] = _q("SELECT video_id, label FROM rule_cat", [], extra=FEATURES)
    q["views_labels"] = _q("SELECT video_id, label FROM rule_views", [], extra=FEATURES)
    virality = ["early_engagement_rate", "likes_views_ratio", "comments_views_ratio", "hour_encoded", "ch_subscribers",
                "duration_minutes"]
    content = ["duration_minutes", "title_length", "hour_encoded", "ch_subscribers", "is_weekend", "avg_views_per_video"]
    zero, mean = "COALESCE({c}, 0)", "COALESCE({c}, (SELECT AVG({c}) FROM feat))"
    q["scaler_stats"] = _q(" UNION ALL ".join(
        f"SELECT '{model}' AS model, '{c}' AS feature, AVG({fill.format(c=c)}) AS mean, stddev_samp({fill.format(c=c)}) AS std "
        "FROM feat WHERE NOT is_test"
        for model, cols, fill in (("virality", virality, zero), ("content", content, mean)) for c in cols),
        ["mean", "std"], extra=FEATURES)
    q["importance_totals"] = " UNION ALL ".join(
        f"SELECT '{m}' AS model, CAST(6 AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total"
        for m in ("virality", "category", "views"))

    def counter(n: str, key: str) -> str:
        return f"CAST(CASE WHEN ({key}) % 5 = 0 OR ({key}) % 17 = 0 THEN 0 ELSE {n} END AS BIGINT)"

    sec = "CAST(round(duration_minutes * 60) AS BIGINT)"
    q["pages_videos"] = _q(f"""
SELECT 'v' || video_id AS video_id, title || CASE WHEN video_id % 7 = 0 THEN ' "q", x' ELSE '' END AS title,
  'c' || channel_id AS channel_id, CASE WHEN video_id % 41 <> 0 THEN publish_date END AS publish_date,
  CASE WHEN video_id % 11 = 0 THEN 'P1DT2H' WHEN video_id % 13 = 0 THEN 'PT' ELSE
    'PT' || CASE WHEN {sec} >= 3600 THEN ({sec} // 3600) || 'H' ELSE '' END || ({sec} % 3600 // 60) || 'M' || ({sec} % 60)
    || 'S' END AS duration,
  CASE WHEN video_id % 11 = 0 THEN NULL WHEN video_id % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE {sec} / CAST(60 AS DOUBLE) END
    AS duration_minutes,
  {counter('views', 'video_id')} AS views, {counter('likes', 'video_id + 1')} AS likes,
  {counter('comments', 'video_id + 2')} AS comments
FROM raw0""", ["duration_minutes"])
    subscribers = "CASE WHEN channel_id % 5 <> 0 AND channel_id % 17 <> 0 THEN ch_subscribers END"
    q["pages_channels"] = _q(f"""
SELECT 'c' || channel_id AS channel_id, channel_name, {subscribers} AS ch_subscribers,
  {counter('channel_id * 1000', 'channel_id + 1')} AS total_views, {counter('channel_id % 100', 'channel_id + 2')} AS total_videos,
  'p' || channel_id AS playlist_id, CASE WHEN channel_id % 41 <> 0 THEN channel_created END AS channel_created
FROM ch""", [])
    q["pages_playlist"] = _q(f"""
SELECT 'v' || video_id AS video_id, {counter('views', 'video_id')} AS views FROM raw0 WHERE video_id % 5 <> 4""", [])
    return q
