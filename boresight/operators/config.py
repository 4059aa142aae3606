"""Settings of the parser, and how they change a parsed description's confidence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import compliance, parse

#: Settings that are shares.
SHARES = ("min_confidence", "fuzzy_threshold", "exact_match_boost", "fuzzy_match_penalty")


@dataclass(frozen=True)
class ParserConfig:
    """terms: further words (lower case) -> class, or -> (class, the word that it stands for). strict: a description that does not comply with the
    standard is invalid."""

    min_confidence: float = 0.5
    fuzzy: bool = True
    fuzzy_threshold: float = 0.8
    strict: bool = False
    terms: dict[str, str | tuple[str, str]] = field(default_factory=dict)
    warnings: bool = True
    max_warnings: int = 10
    exact_match_boost: float = 0.1
    fuzzy_match_penalty: float = 0.1

    def __post_init__(self) -> None:
        for name in SHARES:
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} is {getattr(self, name)}; it must lie between 0 and 1")

    def adjusted(self, confidence: Column, exact: Column, warned: Column) -> Column:
        """A confidence raised for exact matches, lowered for guessed ones, and scaled by 0.95 where there are warnings."""
        guessed = F.greatest(F.lit(0.0), confidence - self.fuzzy_match_penalty) if self.fuzzy else confidence
        out = F.when(exact, F.least(F.lit(1.0), confidence + self.exact_match_boost)).otherwise(guessed)
        return F.when(warned, out * 0.95).otherwise(out) if self.warnings else out

    def accepted(self, confidence: Column) -> Column:
        return confidence >= self.min_confidence


def parsed(df: DataFrame, config: ParserConfig, text: str = "description", out: str = "d") -> DataFrame:
    """df with a struct column out of parse.FIELDS under config, and adjusted and accepted (in place of any so called)."""
    df = parse.parse(df.drop("adjusted", "accepted"), text, out, config.terms, config.fuzzy_threshold if config.fuzzy else None)
    d = F.col(out)
    if config.strict:
        df = df.withColumn(out, d.withField("is_valid", d["is_valid"] & compliance.check(d)["is_compliant"]))
    shown = F.slice(d["warnings"], 1, config.max_warnings) if config.warnings else F.slice(d["warnings"], 1, 0)
    adjusted = config.adjusted(d["confidence"].cast("double"), F.size(d["spelling_corrections"]) == 0, F.size(d["warnings"]) > 0)
    df = df.withColumn("adjusted", adjusted).withColumn("accepted", config.accepted(F.col("adjusted")))
    return df.withColumn(out, d.withField("warnings", shown))
