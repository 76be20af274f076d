"""Fixed values that results depend on. Stated once, in natural order."""

# --- fixed values: labels and edges used by the reports -----------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
WEEKEND = ["Saturday", "Sunday"]
CATEGORIES = ["High", "Medium", "Low"]

# Right-closed buckets (lo, hi]; values at or below the first edge or above the
# last edge fall outside every bucket.
DURATION_EDGES = [0, 5, 10, 15, 20, 100]
DURATION_LABELS = ["0-5min", "5-10min", "10-15min", "15-20min", "20+min"]
DURATION_LABELS_SHORT = ["0-5", "5-10", "10-15", "15-20", "20+"]
TITLE_EDGES = [0, 40, 60, 80, 200]
TITLE_LABELS = ["Short (<40)", "Medium (40-60)", "Long (60-80)", "Very Long (80+)"]
FREQUENCY_EDGES = [0, 4, 8, 12, 20, 100]

# Day parts by publish hour: [6,12) Morning, [12,18) Afternoon, [18,22) Evening,
# everything else Night. Thirds of the month by day: <=10 First, <=20 Middle.
DAYPARTS = ["Morning", "Afternoon", "Evening", "Night"]
MONTH_THIRDS = ["First", "Middle", "Last"]

# KPI rating thresholds: efficiency, interaction, consistency (%), virality, quality.
KPI_THRESHOLDS = {
    "video_efficiency": 100.0,
    "interaction_score": 50.0,
    "consistency": 80.0,
    "virality_index": 200.0,
    "quality_score": 60.0,
}

# Metrics of the benchmark index, in the order they are shown.
BENCHMARK_METRICS = ["Avg Views", "Engagement", "Like Rate", "Videos/Month", "Virality Index"]

# Random forest settings of the three models.
FOREST_TREES = 100
FOREST_DEPTH = 10
SEED = 42
TEST_FRACTION_TENTHS = 3  # 30% test rows

VIRALITY_FEATURES = ["early_engagement_rate", "likes_views_ratio", "comments_views_ratio",
                     "hour_encoded", "ch_subscribers", "duration_minutes"]
CONTENT_FEATURES = ["duration_minutes", "title_length", "hour_encoded", "ch_subscribers",
                    "is_weekend", "avg_views_per_video"]
