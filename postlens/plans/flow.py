"""End-to-end flow result (J6): analysis, matches, gaps and market lists as parquet sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators import match as M
from postlens.operators import reports as R


def flow_sections(postings: DataFrame, profiles: DataFrame, min_score: float = 40.0, top_matches: int = 10
                  ) -> dict[str, DataFrame]:
    analysis = R.full_analysis(postings)
    market = M.market_skill_demand(postings)
    return {
        "summary": analysis.where(F.col("section").isin("metadata", "unique")),
        "top_matches": M.match_report(M.find_matches(postings, profiles, min_score, top_matches)),
        "skill_gaps": M.skill_gaps(profiles, market),
        "top_skills": analysis.where((F.col("section") == "skills") & (F.col("rank") <= 10)),
        "top_companies": analysis.where((F.col("section") == "top_companies") & (F.col("rank") <= 10)),
        "top_locations": analysis.where((F.col("section") == "top_locations") & (F.col("rank") <= 10)),
    }


def run_flow(postings: DataFrame, profiles: DataFrame, out_path: str, **kw) -> dict[str, DataFrame]:
    frames = flow_sections(postings, profiles, **kw)
    R.write_sections(frames, out_path)
    return frames
