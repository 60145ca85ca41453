"""Questions people ask of the ranked table: lists, one segment, route risk and the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.scale import Cutoffs
from kerbline.operators import filters, ranks, routes as r
from kerbline.scratch import Scratch


def list_segments(segments: DataFrame, bbox: str | tuple | None = None, min_score: float = 0.0, min_crashes: int = 6, limit: int = 500) -> DataFrame:
    """Scored segments, highest first; arguments are checked before any job."""
    filters.validate(min_crashes=min_crashes, limit=limit, bbox=bbox, min_score=min_score)
    df = filters.in_bbox(segments, bbox) if bbox is not None else segments
    return ranks.top_segments(filters.evidenced(filters.min_score(df, min_score), min_crashes), limit)


def segment_detail(segments: DataFrame, segment_id: str, cutoffs: Cutoffs | None) -> DataFrame:
    return ranks.with_tiers(filters.segment_rows(segments, segment_id), cutoffs)


def route_risk(routes: DataFrame, segments: DataFrame, min_crashes: int = 6, corridor_m: float = 50.0) -> DataFrame:
    """Risk of every candidate route of every request.

    Requests without a drivable route stay in the result with their status and no label.
    """
    filters.validate(min_crashes=min_crashes, corridor_m=corridor_m)
    s = Scratch(routes.sparkSession, "routes")
    chosen = s.table(r.limit_candidates(r.route_status(routes)), "chosen")
    ok, keyed = chosen.where(F.col("status") == "ok"), ["request_id", "candidate"]
    # both the corridor and the coverage start from the pieces
    pieces = s.table(r.route_pieces(ok), "pieces")
    totals = r.route_totals(chosen.drop("path"), r.match_routes(ok, segments, min_crashes, corridor_m, pieces))
    cover = r.coverage(ok, segments, pieces=pieces).select(*keyed, "coverage_warning")
    out = r.label_routes(totals).join(cover, keyed, "left")
    return out.select(
        *keyed, "status", "label", "distance_m", "duration_s", "expected_ksi", "blackspot_count",
        "worst_segment_id", "blackspots", "coverage_warning",
    )


def stats_summary(segments: DataFrame, capture_row: DataFrame, factors: DataFrame, severity: DataFrame, min_crashes: int = 6) -> DataFrame:
    """One nested row: headline, validation, tiers, speed limits and factors.

    ``segments`` carries tier and score; the other tables hold one row per model or feature.
    """

    def listed(df: DataFrame, name: str, order: str) -> DataFrame:
        rows = F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("_r"))
        return df.agg(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["_r"]).alias(name))

    parts = [
        ranks.headline(segments, min_crashes).select(F.struct("*").alias("headline")),
        capture_row.select(F.struct("*").alias("validation")),
        listed(ranks.tier_distribution(filters.evidenced(segments, min_crashes)), "tiers", "tier"),
        listed(ranks.speed_breakdown(filters.evidenced(segments, min_crashes)), "speed_limits", "speed_limit"),
        listed(factors, "factors", "rank"),
        listed(severity, "severity", "model"),
    ]
    # each part is one row; a constant key lines them up
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")
