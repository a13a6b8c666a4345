"""Settings. The defaults are part of what the operators mean; nothing is read from the environment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Extract:
    min_paragraph_chars: int = 70
    min_article_words: int = 100
    snippet_chars: int = 220


@dataclass(frozen=True)
class Embed:
    batch_rows: int = 4096
    encode_rows: int = 256


@dataclass(frozen=True)
class Index:
    flat_ceiling_bytes: int = 4 << 30
    nprobe: int = 10
    parts: int = 16
    bits: int = 8
    least_lists: int = 100
    most_lists: int = 65_536


@dataclass(frozen=True)
class Rerank:
    enabled: bool = False
    title_weight: float = 0.5
    backlink_weight: float = 0.3
    max_backlinks: int = 540  # 0: the 99th percentile of the counts at hand


@dataclass(frozen=True)
class Mining:
    triplets_per_article: int = 10
    rank_min: int = 1000
    rank_max: int = 2000
    pool: int = 10
    nprobe: int = 32
    min_text_chars: int = 100
    min_paragraph_chars: int = 30
    min_paragraphs: int = 2
    min_positive_words: int = 15
    sentence_anchor_probability: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class Export:
    rows_per_file: int = 1_000_000
    min_chars: int = 0


@dataclass(frozen=True)
class Settings:
    extract: Extract = field(default_factory=Extract)
    embed: Embed = field(default_factory=Embed)
    index: Index = field(default_factory=Index)
    rerank: Rerank = field(default_factory=Rerank)
    mining: Mining = field(default_factory=Mining)
    export: Export = field(default_factory=Export)


DEFAULT = Settings()
