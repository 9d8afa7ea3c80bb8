"""Settings of the operators, with their default values."""

from __future__ import annotations

from dataclasses import dataclass

#: Bytes that a unit stands for when sizes are converted.
UNIT_BYTES = {"characters": 1, "tokens": 4, "words": 6, "sentences": 80, "paragraphs": 400}


@dataclass(frozen=True)
class Limit:
    value: int
    unit: str = "characters"
    soft: bool = True

    @property
    def in_bytes(self) -> int:
        return self.value * UNIT_BYTES[self.unit]


@dataclass(frozen=True)
class SizeConfig:
    """Target, least and greatest size of chunks."""

    target: Limit = Limit(1000)
    least: Limit = Limit(100)
    most: Limit = Limit(2000, soft=False)
    tokens_per_byte: float = 0.25
    merge_small: bool = True

    @classmethod
    def by_tokens(cls, target: int, most: int) -> SizeConfig:
        return cls(Limit(target, "tokens"), Limit(target // 10, "tokens"), Limit(most, "tokens", soft=False))

    @classmethod
    def by_paragraphs(cls, target: int, most: int) -> SizeConfig:
        return cls(Limit(target, "paragraphs"), Limit(1, "paragraphs"), Limit(most, "paragraphs", soft=False), merge_small=False)


#: Named sizes: small and large chunks, and the token limits of three families of embedding models.
PRESETS = {
    "small": SizeConfig(Limit(500), Limit(100), Limit(800, soft=False)),
    "medium": SizeConfig(),
    "large": SizeConfig(Limit(2000), Limit(500), Limit(4000, soft=False)),
    "tokens_512_8000": SizeConfig.by_tokens(512, 8000),
    "tokens_256_512": SizeConfig.by_tokens(256, 512),
    "tokens_2000_8000": SizeConfig.by_tokens(2000, 8000),
}


@dataclass(frozen=True)
class OverlapConfig:
    strategy: str = "sentence"
    size: int = 2
    least: int = 20
    most: int = 500
    keep_words: bool = True
    section_context: bool = False


@dataclass(frozen=True)
class MetadataConfig:
    format: str = "bracket"
    title: bool = False
    pages: bool = False
    path: bool = False
    words_per_minute: int = 200


@dataclass(frozen=True)
class LayoutConfig:
    """Tolerances of layout detection, in points or as ratios."""

    line_height_tolerance: float = 0.5
    least_line_width: float = 5.0
    align_tolerance: float = 10.0
    justified_ratio: float = 0.9
    block_gap: float = 1.5
    column_gap: float = 20.0
    column_width: float = 50.0
    column_bucket: float = 5.0
    most_columns: int = 6
    paragraph_spacing: float = 1.5
    indent: float = 15.0
    heading_ratio: float = 1.2
    quote_indent: float = 30.0
    level_ratios: tuple[float, ...] = (1.8, 1.5, 1.3, 1.15, 1.1, 1.05)
    band: float = 72.0
    repeat_ratio: float = 0.5
    repeat_pages: int = 2
    repeat_x: float = 10.0
    repeat_y: float = 5.0
    table_tolerance: float = 2.0
    table_gap: float = 50.0
    table_confidence: float = 0.5
