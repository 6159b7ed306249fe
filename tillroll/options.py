"""Settings that change results, as one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Names and defaults a caller may rely on.
ENGINES = ("rule_based", "ai", "ai_vision")
OWN_ENGINES: list[str] = []  # names that callers have registered
OUTPUT_FORMATS = ("csv", "parquet")
CURRENCY_SYMBOLS = ("$", "£", "€", "₱", "¥")
AMOUNT_GRAMMARS = ("whole", "split")


@dataclass(frozen=True)
class Options:
    """`amount_grammar` says how a long number without thousands commas is read:
    "whole" reads $1234.56 as one amount; "split" reads digits in groups of at most three,
    so that the same text gives 123 and 4.56."""

    engine: str = "rule_based"
    currency_symbols: tuple[str, ...] = CURRENCY_SYMBOLS
    date_dayfirst: bool = False
    deduplicate: bool = True
    output_format: str = "csv"
    amount_grammar: str = "whole"

    def __post_init__(self) -> None:
        object.__setattr__(self, "currency_symbols", tuple(self.currency_symbols))
        _one_of("engine", self.engine, (*ENGINES, *OWN_ENGINES))
        _one_of("output_format", self.output_format, OUTPUT_FORMATS)
        _one_of("amount_grammar", self.amount_grammar, AMOUNT_GRAMMARS)
        if not self.currency_symbols or not all(self.currency_symbols):
            raise ValueError("currency_symbols must name at least one symbol, none empty")

    def with_overrides(self, **changes) -> "Options":
        return replace(self, **changes)


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got {value!r}")
