"""Row types shared by the operators, and the run settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _B, _D, _L = T.StringType(), T.BooleanType(), T.DoubleType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: A fetched feed document before parsing.
FEED_DOCUMENT = _struct(feed_url=_S, fetched_at=T.TimestampType(), body=_S)

#: One configured feed; ``feed_url`` is the key because names repeat.
FEED = _struct(feed_ord=T.IntegerType(), feed_url=_S, feed_name=_S)

#: What a scorer answers for one article.
ANALYSIS = _struct(
    isDouble=_B,
    similarArticle=_S,
    similarityReason=_S,
    isCommercial=_B,
    significanceScore=_D,
    summary=_S,
    tags=T.ArrayType(_S),
)

#: One processed article.
LEDGER = _struct(
    url=_S,
    title=_S,
    content=_S,
    analysis=ANALYSIS,
    published_date=T.TimestampNTZType(),
    image_url=_S,
    source=_S,
    processed_at=T.TimestampNTZType(),
    page_id=_S,
    ingest_ord=_L,
)

#: The parts of a remote page listing the purge needs.
REMOTE_PAGE = _struct(
    id=_S,
    properties=_struct(
        URL=_struct(url=_S),
        Title=_struct(title=T.ArrayType(_struct(text=_struct(content=_S)))),
    ),
)

#: One response of the paged listing.
PAGE_BATCH = _struct(
    results=T.ArrayType(REMOTE_PAGE), has_more=_B, next_cursor=_S
)


@dataclass(frozen=True)
class Settings:
    """Run parameters; the defaults are the fixed values of the original job.

    An article repeats an earlier one when its title or its text is that similar; ``min_content_jaccard`` None
    leaves texts out. The weights say how much either similarity counts (``operators.contents.combined_matches``).
    """

    max_articles_per_feed: int = 3
    auto_clean_threshold: int = 400
    clean_remove_count: int = 100
    log_interactions: bool = False
    prompt_content_chars: int = 1500
    prompt_history: int = 400
    chunk_size: int = 1800
    chunk_cap: int = 10
    min_title_jaccard: float = 0.7
    min_content_jaccard: float | None = 0.7
    title_weight: float = 1.0
    content_weight: float = 1.0

    def __post_init__(self) -> None:
        if self.max_articles_per_feed < 0:
            raise ValueError("max_articles_per_feed must not be negative")
        if self.clean_remove_count < 0:
            raise ValueError("clean_remove_count must not be negative")

    @staticmethod
    def parse_count(raw: str | None, default: int) -> int:
        """Integer setting with an optional ``# comment``; the default when unreadable."""
        try:
            return int((raw or "").split("#")[0].strip())
        except ValueError:
            return default

    @classmethod
    def from_mapping(cls, values: dict[str, str]) -> "Settings":
        """Settings from an environment-like mapping."""
        return cls(
            max_articles_per_feed=cls.parse_count(values.get("MAX_ARTICLES_PER_FEED"), 3),
            auto_clean_threshold=cls.parse_count(values.get("AUTO_CLEAN_THRESHOLD"), 400),
            clean_remove_count=cls.parse_count(values.get("CLEAN_REMOVE_COUNT"), 100),
            log_interactions=values.get("ENABLE_CHATGPT_LOGS", "false").lower() == "true",
        )
