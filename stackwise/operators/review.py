"""Review of frames: sorting with missing values, selection by rules, and decisions that can be undone."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stackwise.schema import require

SORT_FIELDS = ("frame_id", "background", "noise", "snr", "detected_stars", "usable_stars", "fwhm", "eccentricity", "decision")


def sort_order(field_: str, descending: bool = False, missing_first: bool = False) -> list[Column]:
    """Where missing values go does not depend on the direction; ties go by frame id."""
    require(field_ in SORT_FIELDS, f"unknown sort field {field_}")
    c = F.col(field_)
    order = {(False, False): c.asc_nulls_last, (False, True): c.asc_nulls_first, (True, False): c.desc_nulls_last, (True, True): c.desc_nulls_first}
    return [order[descending, missing_first](), F.col("frame_id").asc()]


def sorted_frames(frames: DataFrame, field_: str, descending: bool = False, missing_first: bool = False) -> DataFrame:
    """The frames with their ``position``; frames are one row per file."""
    return frames.withColumn("position", (F.row_number().over(W.orderBy(*sort_order(field_, descending, missing_first))) - 1).cast("long"))


#: Metrics that count; all others are scalars.
COUNTS = ("detected_stars", "usable_stars")


def comparison_passes(metric: str, comparator: str, threshold: float | int) -> Column:
    """Whether the metric is strictly ``less`` or ``greater`` than the threshold.

    A count only compares with a whole threshold that is not negative, a scalar only with a finite one; a pair of
    different kinds, and a missing metric, never pass.
    """
    require(comparator in ("less", "greater"), "comparator must be less or greater")
    whole = isinstance(threshold, int) and not isinstance(threshold, bool) and threshold >= 0
    if whole != (metric in COUNTS) or not abs(threshold) < float("inf"):
        return F.lit(False)
    bound = F.lit(threshold).cast("long") if whole else F.lit(float(threshold))
    c = F.col(metric)
    return F.coalesce(c < bound if comparator == "less" else c > bound, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Reject a frame whose ``metric`` is below or above ``threshold``; ``missing`` says what a missing one means."""

    metric: str
    comparator: str
    threshold: float
    missing: str = "retain"

    def __post_init__(self) -> None:
        require(self.comparator in ("minimum", "maximum"), "comparator must be minimum or maximum")
        require(self.missing in ("retain", "reject"), "missing must be retain or reject")

    def outcome(self) -> Column:
        c = F.col(self.metric)
        failed = c < self.threshold if self.comparator == "minimum" else c > self.threshold
        return F.when(c.isNull(), f"missing_{self.missing}").when(failed, "failed").otherwise("passed")


def evaluate_rules(frames: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every rule's outcome for every frame; a frame is rejected if any rule failed or rejects a missing value."""
    outcomes = F.array(*[r.outcome() for r in rules]) if rules else F.array().cast("array<string>")
    return frames.withColumn("outcomes", outcomes).withColumn("rejected", F.exists("outcomes", lambda o: o.isin("failed", "missing_reject")))


def selection_digest(evaluated: DataFrame) -> DataFrame:
    """One row: counts and a digest of all outcomes.

    Each frame has its own SHA-256; their sum modulo 2^128 does not depend on order and merges on any partitioning.
    """
    line = F.concat_ws("|", F.col("frame_id").cast("string"), F.concat_ws(",", "outcomes"), F.col("rejected").cast("string"))
    part = lambda k: F.sum(F.conv(F.substring(F.sha2(line, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    return evaluated.agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("rejected").cast("long")).alias("rejected"), F.sha2(F.concat_ws("|", *[part(k).cast("string") for k in range(4)]), 256).alias("digest"))


@dataclass
class ReviewBook:
    """Decisions on the driver, one small entry per frame that was decided: preview, apply, undo, seal.

    The last ``undo_limit`` changes can be undone; older ones are final, as the parameter says.
    """

    decisions: dict[int, str] = field(default_factory=dict)
    history: list[dict[int, str | None]] = field(default_factory=list)
    generation: int = 0
    sealed: bool = False
    undo_limit: int = 100

    def preview(self, changes: dict[int, str]) -> tuple[int, dict[int, tuple[str | None, str]]]:
        """The generation and the changes that would have an effect."""
        require(all(v in ("accepted", "rejected", "undecided") for v in changes.values()), "unknown decision")
        return self.generation, {k: (self.decisions.get(k), v) for k, v in changes.items() if self.decisions.get(k) != v}

    def apply(self, preview: tuple[int, dict[int, tuple[str | None, str]]]) -> None:
        generation, changes = preview
        require(not self.sealed, "a sealed review cannot change")
        require(generation == self.generation, "the preview is stale")
        self.history = [*self.history, {k: old for k, (old, _) in changes.items()}][-self.undo_limit :]
        self.decisions.update({k: new for k, (_, new) in changes.items()})
        self.generation += 1

    def undo(self) -> dict[int, str | None]:
        require(not self.sealed, "a sealed review cannot change")
        require(bool(self.history), "there is nothing to undo")
        back = self.history.pop()
        for k, old in back.items():
            if old is None:
                self.decisions.pop(k, None)
            else:
                self.decisions[k] = old
        self.generation += 1
        return back

    def seal(self) -> None:
        self.sealed = True

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.decisions.items()), "frame_id long, decision string")


@dataclass
class FrameStepper:
    """Steps through the frames of a comparison; a step is requested, and visible once its frame was committed."""

    frames: tuple[int, ...]
    mode: str = "loop_forward"
    current: int = 0
    pending: int | None = None
    playing: bool = False
    direction: int = 1

    def __post_init__(self) -> None:
        require(len(self.frames) > 0 and len(set(self.frames)) == len(self.frames), "frames must be there and distinct")
        require(self.mode in ("loop_forward", "loop_backward", "bounce"), "unknown mode")

    def _free(self) -> None:
        require(self.pending is None, "a step is pending")
        require(len(self.frames) > 1, "one frame alone has no steps")

    def request_step(self, direction: int) -> int:
        """The frame one step ahead (1) or back (-1), around the ends."""
        require(direction in (1, -1), "direction must be 1 or -1")
        self._free()
        self.pending = (self.current + direction) % len(self.frames)
        return self.frames[self.pending]

    def request_playback_step(self) -> int:
        """The next frame of the mode; ``bounce`` turns at the ends."""
        require(self.playing, "playback is paused")
        if self.mode != "bounce":
            return self.request_step(1 if self.mode == "loop_forward" else -1)
        self._free()
        if not 0 <= self.current + self.direction < len(self.frames):
            self.direction = -self.direction
        return self.request_step(self.direction)

    def commit(self, frame: int) -> None:
        require(self.pending is not None, "no step is pending")
        require(self.frames[self.pending] == frame, "another frame is pending")
        self.current, self.pending = self.pending, None
