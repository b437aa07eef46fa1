"""Statistical analysis and data preparation on Spark DataFrames."""

from tabulon.errors import AnalysisError
from tabulon.plans.analyses import AnalysisResult, run_analysis
from tabulon.plans.dataset import Dataset
from tabulon.plans.report import run_report

__all__ = ["AnalysisError", "AnalysisResult", "Dataset", "run_analysis", "run_report"]
