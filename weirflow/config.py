"""Thresholds and fixed values, all of which a caller may replace."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    velocity_high: float = 50.0
    velocity_low: float = 5.0
    sentiment: float = 0.3
    comments: int = 10
    cutoff: float = 0.3
    divergence: float = 0.3
    ttl_seconds: int = 25 * 3600
    window_rows: int = 500
    least_samples: int = 10
    #: Baselines of platforms with too few samples.
    fallback: dict = field(default_factory=lambda: {"reddit": 150.0, "hackernews": 50.0, "bluesky": 10.0, "youtube": 20.0})
    other_fallback: float = 100.0


DEFAULTS = Thresholds()

#: Poll intervals in seconds by priority; inactive posts are never polled.
POLL_SECONDS = {"aggressive": 300, "normal": 1800, "slow": 7200}

#: Seed terms of topics, in natural order; the phrase of two words goes before its first word.
SEED_TERMS = (
    "pyspark", "dbt", "airflow", "kafka", "timescaledb", "duckdb", "databricks", "snowflake", "flink", "trino", "superset", "dagster", "prefect",
    "pytorch", "tensorflow", "huggingface", "langchain", "llamaindex", "ollama", "mistral", "llama",
    "anthropic", "claude", "chatgpt", "openai", "gemini", "mistral ai", "cohere", "perplexity",
    "kubernetes", "k8s", "terraform", "pulumi", "grafana", "prometheus", "vercel", "supabase", "neon",
    "rust", "golang", "zig", "elixir", "neovim", "cursor", "warp",
)

#: Entities that are no topics.
NOISE_TOPICS = (
    "new", "the", "one", "first", "last", "year", "day", "week", "today", "yesterday",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "use", "way", "time", "good", "best", "help", "work", "make", "take", "give", "come", "know", "think",
    "us", "uk", "eu", "usa", "world", "internet",
)

#: Words that are no keywords.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "that", "this", "these", "those", "it", "its", "i",
    "you", "he", "she", "we", "they", "what", "which", "who", "how", "when", "where", "why", "not", "no", "so", "if", "says", "said", "also", "after",
    "before", "along", "about", "just", "more",
)

#: What a Bluesky post must contain.
BLUESKY_TERMS = ("wall street", "stock markets")
