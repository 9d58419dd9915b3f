"""Options of a comparison, with the defaults that the results are defined by."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    modified_threshold: float = 0.50
    move_threshold: float = 0.90
    fast_threshold: float = 0.30
    max_lines: int = 50_000
    max_pairs: int = 100_000
    fast_mode: bool = True
    detect_moves: bool = True
    two_pass_threshold: int = 100
    max_block: int = 100
    max_blocks: int = 100
    token_weight: float = 0.7
    use_tokens: bool = False
    ast_weight: float = 0.6
    max_lines_for_ast: int = 1000
    normalize_delimiters: bool = False
    late_moves: bool = False
    language: str | None = None


DEFAULT = Options()
