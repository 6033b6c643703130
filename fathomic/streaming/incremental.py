"""Streams: incremental fits per micro-batch and watermarked window statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def partial_fit_stream(stream: DataFrame, estimator, cols: Sequence[str], checkpoint: str, on_model: Callable | None = None, **trigger) -> tuple[StreamingQuery, dict]:
    """Run ``estimator.partial_fit`` on every micro-batch; ``state["model"]`` is the latest model.

    A batch number that comes again after a restart is skipped if the state has seen it."""
    state: dict = {"model": estimator, "batch": -1}

    def step(batch: DataFrame, number: int) -> None:
        if number <= state["batch"]:
            return
        held = batch.persist()
        try:
            if held.head(1):
                state["model"] = state["model"].partial_fit(held, cols)
                if on_model is not None:
                    on_model(state["model"], number)
        finally:
            held.unpersist()
        state["batch"] = number

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(), state


def windowed_moments(stream: DataFrame, ts: str, keys: Sequence[str], value: str, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, population variance, min and max per key and event-time window; rows later than
    the watermark are dropped."""
    held = stream.withWatermark(ts, late).groupBy(F.window(ts, window, slide) if slide else F.window(ts, window), *keys)
    v = F.col(value).cast("double")
    out = held.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "var", "min", "max")


def score_stream(stream: DataFrame, model, **options) -> DataFrame:
    """A fitted model's expressions applied to a stream (they are stateless projections)."""
    return model.transform(stream, **options) if hasattr(model, "transform") and not hasattr(model, "predict") else model.predict(stream, **options)
