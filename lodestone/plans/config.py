"""Configurations with their presets and rules. All are plain values, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..errors import InvalidConfiguration, ProjectionError
from ..functions.vectors import Metric


def need(ok: bool, what: str, error: type = InvalidConfiguration) -> None:
    if not ok:
        raise error(what)


@dataclass(frozen=True)
class EmbeddingConfig:
    max_tokens: int = 512
    truncation: str = "end"
    padding: str = "none"
    special_tokens: bool = True
    pooling: str = "mean"
    normalize: bool = True

    def __post_init__(self) -> None:
        need(self.max_tokens > 0, "max_tokens must be positive")
        need(self.truncation in ("none", "end", "start", "middle"), f"truncation {self.truncation}")
        need(self.padding in ("none", "max", "batch"), f"padding {self.padding}")
        need(self.pooling in ("mean", "max", "cls", "attention"), f"pooling {self.pooling}")


#: Embedding presets by use.
EMBEDDING = {
    "default": EmbeddingConfig(),
    "semantic_search": EmbeddingConfig(512),
    "rag": EmbeddingConfig(256),
    "similarity": EmbeddingConfig(256),
    "documents": EmbeddingConfig(2048, padding="none"),
    "short_text": EmbeddingConfig(64, padding="max"),
    "visualization": EmbeddingConfig(128),
}


@dataclass(frozen=True)
class BatchConfig:
    """timeout: seconds that a batch may take, of which it waits a tenth, half a second at most, for more rows. dynamic: whether it waits at all."""

    max_batch: int = 32
    min_batch: int = 1
    bucket: int = 16
    max_tokens: int | None = None
    padding_ratio: float | None = None
    sort_by_length: bool = True
    dynamic: bool = True
    timeout: float | None = None

    def __post_init__(self) -> None:
        need(self.max_batch > 0 and self.bucket > 0, "batch and bucket sizes must be positive")
        need(0 < self.min_batch <= self.max_batch, "the least batch must be between 1 and the largest")
        need(self.max_tokens is None or self.max_tokens > 0, "max_tokens must be positive")
        need(self.padding_ratio is None or 0 <= self.padding_ratio <= 1, "padding_ratio must be between 0 and 1")

    def wait(self, default: float = 0.1) -> float:
        """Seconds that a row waits for others at most."""
        return default if self.timeout is None else min(self.timeout / 10, 0.5)


#: Batch presets.
BATCH = {"default": BatchConfig(), "high_throughput": BatchConfig(64, bucket=32), "low_latency": BatchConfig(8, sort_by_length=False, dynamic=False)}


@dataclass(frozen=True)
class CacheConfig:
    """dedup: the similarity from which texts share an entry, None for equal texts alone; ttl: seconds, 0 for ever."""

    max_entries: int = 100_000
    max_bytes: int = 500 << 20
    dedup: float | None = None
    auto_evict: bool = True
    ttl: float = 0.0
    log: bool = True

    def __post_init__(self) -> None:
        need(self.max_entries > 0 and self.max_bytes > 0 and self.ttl >= 0, "cache limits must be positive")
        need(self.dedup is None or 0 <= self.dedup <= 1, "dedup must be between 0 and 1")


@dataclass(frozen=True)
class PipelineConfig:
    embedding: EmbeddingConfig = EmbeddingConfig()
    batch: BatchConfig = BatchConfig()
    cache: CacheConfig | None = None
    memory_budget: int | None = None

    def with_cache(self, cache: CacheConfig = CacheConfig()) -> PipelineConfig:
        return replace(self, cache=cache)

    def with_memory_budget(self, megabytes: int) -> PipelineConfig:
        need(megabytes > 0, "the budget must be positive")
        return replace(self, memory_budget=megabytes << 20)

    def batch_by_pressure(self) -> tuple[tuple[float, int], ...]:
        """The batch size up to each memory pressure: halved from range to range, and never over the budget's megabytes divided by 4, 8, 16 and 32."""
        from ..operators.batching import BY_PRESSURE

        if self.memory_budget is None:
            return tuple((top, min(size, self.batch.max_batch)) for top, size in BY_PRESSURE)
        budget, most = self.memory_budget >> 20, self.batch.max_batch
        sizes = (min(most, budget // 4), min(most // 2, budget // 8), min(most // 4, budget // 16), min(16, budget // 32))
        return tuple((top, max(1, size)) for (top, _), size in zip(BY_PRESSURE, sizes, strict=True))


def large_model(dimension: int = 1024, max_tokens: int = 512) -> PipelineConfig:
    """Fewer rows a batch for longer vectors, eight at least."""
    most = max(8, 32 - dimension // 128)
    return PipelineConfig(EmbeddingConfig(max_tokens, padding="batch"), BatchConfig(most, max_tokens=max_tokens * most, timeout=120.0))


#: Pipeline presets, by resource, task and model.
PIPELINE = {
    "default": PipelineConfig(),
    "high_throughput": PipelineConfig(EmbeddingConfig(512, padding="batch"), BatchConfig(128, 8, 32, 16_384, 0.5, timeout=60.0)),
    "low_latency": PipelineConfig(EmbeddingConfig(256), BatchConfig(8, bucket=8, sort_by_length=False, dynamic=False, timeout=5.0)),
    "large_batches": PipelineConfig(EmbeddingConfig(512, padding="batch"), BatchConfig(64, bucket=32, max_tokens=32_768, timeout=30.0)),
    "memory_efficient": PipelineConfig(EmbeddingConfig(256), BatchConfig(8, bucket=8, max_tokens=1024), memory_budget=128 << 20),
    "battery_efficient": PipelineConfig(EmbeddingConfig(256, padding="batch"), BatchConfig(16)),
    "semantic_search": PipelineConfig(EmbeddingConfig(512), BatchConfig(timeout=10.0)),
    "rag": PipelineConfig(EmbeddingConfig(256), BatchConfig(64, bucket=32, max_tokens=256 * 64, timeout=30.0), CacheConfig(50_000, 250 << 20)),
    "real_time": PipelineConfig(EmbeddingConfig(128), BatchConfig(4, sort_by_length=False, dynamic=False, timeout=2.0), CacheConfig(10_000, 50 << 20, 0.95, ttl=3600.0, log=False)),
    "batch_indexing": PipelineConfig(EmbeddingConfig(512, padding="batch"), BatchConfig(128, 32, 64, 65_536, 0.4, timeout=120.0), CacheConfig(1_000_000, 2 << 30)),
    "mini": PipelineConfig(EmbeddingConfig(512), BatchConfig(64, timeout=30.0)),
    "bert": PipelineConfig(EmbeddingConfig(512), BatchConfig(bucket=32, max_tokens=8192, timeout=60.0)),
    "large": large_model(),
}


@dataclass(frozen=True)
class IndexConfig:
    dimension: int
    kind: str = "flat"
    metric: Metric = Metric.EUCLIDEAN
    store_text: bool = True
    lists: int = 100
    probes: int = 10
    capacity: int = 10_000

    def __post_init__(self) -> None:
        need(self.dimension > 0, "dimension must be positive")
        need(self.capacity > 0, "capacity must be positive")
        need(self.kind in ("flat", "ivf"), f"index kind {self.kind}")
        need(self.kind == "flat" or 0 < self.probes <= self.lists, "probes must be between 1 and the number of lists")

    @staticmethod
    def scalable(dimension: int, expected: int) -> IndexConfig:
        from ..operators.search import scalable_lists

        lists, probes = scalable_lists(expected)
        return IndexConfig(dimension, "ivf", lists=lists, probes=probes, capacity=max(1, expected))

    def to_dict(self) -> dict:
        return {"dimension": self.dimension, "kind": self.kind, "metric": self.metric.value, "store_text": self.store_text, "lists": self.lists, "probes": self.probes, "capacity": self.capacity}

    @staticmethod
    def from_dict(d: dict) -> IndexConfig:
        """Unknown kinds are read as flat, unknown metrics as cosine."""
        kind = d.get("kind") if d.get("kind") in ("flat", "ivf") else "flat"
        metric = Metric(d["metric"]) if d.get("metric") in {m.value for m in Metric} else Metric.COSINE
        return IndexConfig(d["dimension"], kind, metric, d.get("store_text", True), d.get("lists", 100), d.get("probes", 10), d.get("capacity", 10_000))


@dataclass(frozen=True)
class ProjectionConfig:
    dimensions: int = 2
    neighbours: int = 15
    min_distance: float = 0.1
    spread: float = 1.0
    iterations: int = 200
    learning_rate: float = 1.0
    negatives: int = 5
    seed: int = 0

    def __post_init__(self) -> None:
        need(self.dimensions > 0 and self.neighbours > 1 and self.iterations > 0, "dimensions, neighbours and iterations must be positive", ProjectionError)
        need(0 <= self.min_distance <= self.spread and self.learning_rate > 0, "min_distance must lie between 0 and spread", ProjectionError)


#: Projection presets.
PROJECTION = {"2d": ProjectionConfig(), "3d": ProjectionConfig(3), "quick": ProjectionConfig(neighbours=10, iterations=100), "high": ProjectionConfig(neighbours=30, iterations=500), "cluster": ProjectionConfig(neighbours=30, min_distance=0.0), "global": ProjectionConfig(neighbours=50, min_distance=0.5)}


@dataclass(frozen=True)
class FlowConfig:
    concurrency: int = 4
    depth: int = 100
    policy: str = "suspend"
    batch: int = 32
    timeout: float | None = None
    capacity: float | None = None
    refill: float | None = None

    def __post_init__(self) -> None:
        need(self.policy in ("suspend", "drop_oldest", "drop_newest", "error"), f"policy {self.policy}")

    @staticmethod
    def rate_limited(per_second: float) -> FlowConfig:
        return replace(FlowConfig(), capacity=2 * per_second, refill=per_second)


#: Flow presets.
FLOW = {"default": FlowConfig(), "high_throughput": FlowConfig(8, 500, "drop_oldest", 64), "low_latency": FlowConfig(2, 20, "error", 8, timeout=1.0)}
