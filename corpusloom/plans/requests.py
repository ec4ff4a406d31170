"""Checks and defaults of requests, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.constants import FORMATS, MODES
from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.schemas import REQUEST

FIELDS = [x.split()[0] for x in REQUEST.split(", ")]
MALFORMED = "Request body is not a JSON object of a request"
MISSING, BAD_URL, BAD_SEED = "seedUrl is required", "Invalid URL format. Must be http:// or https://", "Invalid seedUrl format"
BAD_MODE = f"Invalid operationMode. Must be one of: {', '.join(MODES)}"
BAD_FORMAT = f"Invalid outputFormat. Must be one of: {', '.join(FORMATS)}"
BAD_DEPTH = "depth must be between 0 and 10"


def error_v1() -> Column:
    """The first error of a synchronous request, or null. The mode is required, the format has a default."""
    seed, mode, kind = F.col("seedUrl"), F.col("operationMode"), F.coalesce("outputFormat", F.lit("JSON"))
    return F.when(tx.or_default(seed, "") == "", MISSING).when(~urls.is_http(seed), BAD_URL).when(~F.coalesce(mode, F.lit("")).isin(*MODES), BAD_MODE).when(~kind.isin(*FORMATS), BAD_FORMAT)


def error_v2() -> Column:
    """The first error of a job request, or null. A seed of any scheme is taken, though only http and https lead anywhere."""
    seed = F.col("seedUrl")
    wrong = lambda c, known: (tx.or_default(F.col(c), "") != "") & ~F.col(c).isin(*known)
    return F.when(tx.or_default(seed, "") == "", MISSING).when(~urls.parses(seed), BAD_SEED).when(wrong("operationMode", MODES), BAD_MODE).when(wrong("outputFormat", FORMATS), BAD_FORMAT).when((F.col("depth") < 0) | (F.col("depth") > 10), BAD_DEPTH)


def error_single_pass() -> Column:
    seed = F.col("seedUrl")
    return F.when(tx.or_default(seed, "") == "", MISSING).when(~urls.is_http(seed), BAD_URL)


def clamped_depth(default: int = 1, most: int = 5) -> Column:
    return F.least(F.greatest(F.coalesce("depth", F.lit(default)), F.lit(0)), F.lit(most))


def checked(requests: DataFrame) -> DataFrame:
    return requests.withColumns({"error_v1": error_v1(), "error_v2": error_v2(), "error_single_pass": error_single_pass(), "depth_v1": clamped_depth(), "depth_v2": F.coalesce("depth", F.lit(2)), "mode_v2": tx.or_default(F.col("operationMode"), "CRAWL_AND_SCRAPE"), "format_v1": F.coalesce("outputFormat", F.lit("JSON"))})
