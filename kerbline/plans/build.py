"""The offline job: crash tables to ranked segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.models.boost import out_of_fold
from kerbline.operators.crashes import join_crash
from kerbline.operators.filters import numbered_roads
from kerbline.operators.ranks import ranked, tier_cutoffs, with_tiers
from kerbline.operators.segments import assign_segments, extend_places, place_positions, segment_table
from kerbline.operators.spanning import with_road
from kerbline.schemas import FEATURE_NAMES
from kerbline.scratch import Scratch


@dataclass(frozen=True)
class Windows:
    """Feature and target years, both inclusive."""

    features: tuple[int, int] = (2019, 2021)
    target: tuple[int, int] = (2022, 2023)

    def __post_init__(self) -> None:
        if self.features[1] - self.features[0] != 2:
            raise ValueError("the feature window has three years, one for each f_year input")
        if self.target[0] <= self.features[1]:
            raise ValueError("the target window begins after the feature window")


@dataclass
class Placed:
    """Tables that every later step starts from, each written once."""

    positions: DataFrame
    edges: DataFrame
    crashes: DataFrame
    segments: DataFrame


def place_crashes(
    collision: DataFrame, vehicle: DataFrame, casualty: DataFrame, windows: Windows, gap_m: float = 5000.0, block_m: int = 500,
    earlier: Placed | None = None, added: DataFrame | None = None,
) -> Placed:
    """Assign crashes to segments and aggregate features and target.

    With ``earlier``, the result for all collisions but the ``added`` ones, its places and forest are extended by those.
    """
    s = Scratch(collision.sparkSession, "placed")
    numbered = numbered_roads(collision)
    if earlier is None:
        positions, edges = place_positions(numbered, gap_m, block_m)
    else:
        kept = with_road(earlier.edges, earlier.positions)
        positions, edges = extend_places(earlier.positions, kept, numbered_roads(added), gap_m, block_m)
        edges = edges.select("a", "b", "w")
    positions = s.table(positions, "positions")
    crashes = s.table(assign_segments(join_crash(numbered, vehicle, casualty), positions), "crashes")
    segments = s.table(segment_table(crashes, windows.features, windows.target, block_m), "segments")
    return Placed(positions, edges, crashes, segments)


def score_segments(segments: DataFrame, k: int = 5, **fit) -> DataFrame:
    """Out-of-fold scores for all segments.

    Only segments known in the feature window are fitted on: one that exists only because of later crashes
    would leak the target into the fit. It is scored like the rest, from imputed inputs.
    """
    rows = segments.select("segment_id", "ksi_target", *FEATURE_NAMES)
    scored, _ = out_of_fold(rows, "segment_id", k, inputs=FEATURE_NAMES, known=F.col("f_crashes") > 0, **fit)
    return attach_scores(segments, scored.select("segment_id", "score"))


def attach_scores(segments: DataFrame, scores: DataFrame) -> DataFrame:
    return segments.join(scores, "segment_id", "left")


def rank_segments(scored: DataFrame, min_crashes: int = 6) -> DataFrame:
    """Tier, display score and rank of a scored segment table."""
    cutoffs = tier_cutoffs(scored.where(F.col("score").isNotNull()), min_crashes)
    return ranked(with_tiers(scored, cutoffs))


def build_segments(collision: DataFrame, vehicle: DataFrame, casualty: DataFrame, windows: Windows | None = None, k: int = 5, **fit) -> DataFrame:
    """Everything from crash tables to the ranked table."""
    placed = place_crashes(collision, vehicle, casualty, windows or Windows())
    scored = Scratch(collision.sparkSession, "scored").table(score_segments(placed.segments, k, **fit))
    return rank_segments(scored)
