"""Study constants. One frozen object is passed around; nothing reads them from elsewhere."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Results are only comparable when these agree.
    corpus_docs: int = 160
    chunk_max_chars: int = 1400
    chunk_overlap_chars: int = 200
    chunk_min_chars: int = 120
    candidate_k: int = 30
    eval_k: int = 10
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    weight_head: float = 1.0
    weight_body: float = 0.4
    neighbours: int = 10
    temperature: float = 0.02
    batch_size: int = 15
    cascade_keep: int = 10
    line_window: int = 80
    seed: int = 20260920
    usd_per_million_input: float = 0.042
    # Limits of the single-copy paths. Beyond each one another exact path takes over.
    broadcast_values: int = 4_000_000
    single_window_rows: int = 2_000_000

    @property
    def fetch_depth(self) -> int:
        return 2 * self.candidate_k


DEFAULTS = Config()
