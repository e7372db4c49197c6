"""Parameters of the jobs, with their default values."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodestar.functions.stopwords import ENGLISH

# Limits and weights that decide which rows a result holds.
TOP_DATASETS = 5
TOP_PUBLICATIONS = 8
SCORE_THRESHOLD = 0.02
SIMILARITY_WEIGHT = 0.7
OVERLAP_WEIGHT = 0.3
NUMBER_BOOST = 0.5
MAX_FEATURES = 10000
FILES_PER_DATASET = 4
PREVIEW_ROWS = 5
SAMPLE_COLUMNS = 20
HEAD_CHARS = 2000
TOP_VALUES = 6
RENDERED_NUMBERS = 4
SUMMARY_LINES = 8
SUMMARY_LINES_WITHOUT_KEYWORD = 6
SUMMARY_PUBLICATIONS = 5
SUMMARY_URLS = 6
CANDIDATE_PUBLICATIONS = 3
CANDIDATE_TITLE_CHARS = 80

# Rows a side of a join may have, by count, to be sent to every executor.
BROADCAST_ROWS = 2_000_000

# Scores are compared at this many decimals, so that entries with equal texts tie
# although their sums were added up in another order.
SCORE_DIGITS = 9


@dataclass(frozen=True)
class IndexSettings:
    """How texts become terms. ``max_features=0`` gives an index without a vocabulary, ``None`` one without a cap."""

    stop_words: tuple[str, ...] = field(default=ENGLISH)
    max_features: int | None = MAX_FEATURES


@dataclass(frozen=True)
class RankSettings:
    """How entries are scored and how many are kept per question and entry type."""

    top_datasets: int = TOP_DATASETS
    top_publications: int = TOP_PUBLICATIONS
    threshold: float = SCORE_THRESHOLD
    similarity_weight: float = SIMILARITY_WEIGHT
    overlap_weight: float = OVERLAP_WEIGHT
    number_boost: float = NUMBER_BOOST
    broadcast_rows: int = BROADCAST_ROWS
