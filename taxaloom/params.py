"""Parameters of the annotation operators, with the defaults that the queries use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    k: int = 12
    prot_k: int = 4
    frag_len: int = 200
    hit_threshold: int = 5
    ctg_len_min: int = 500
    read_len: int = 100
    align_threshold: int | None = None  # default: 95 % of read_len
    qmer: int = 4
    restarts: int = 10
    max_species: int = 600
    min_species: int = 100
    merge_threshold: float = 0.97
    cluster_bases: int = 300_000
    eukaryota: int = 2759
    component_length: int = 10_000
    cluster_targets: int = 10_000

    @property
    def align_min(self) -> int:
        return int(0.95 * self.read_len) if self.align_threshold is None else self.align_threshold
