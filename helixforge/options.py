"""Options of the engine.  Only those that change results, or what is written, are here; how work is spread over machines is
Spark's configuration."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Options:
    # inputs and outputs
    input_files: tuple[str, ...] = ()
    output_dir: str = ""
    output_files: tuple[str, ...] = ()
    paired: bool = False
    gz_output: bool = False
    first_reads: int = 0  #: only read ids below it; 0: all
    exclude_ambiguous: bool = False
    save_reads_to: str = ""
    load_reads_from: str = ""
    save_tables_to: str = ""
    load_tables_from: str = ""
    # sketches
    kmer_length: int = 20
    hash_functions: int = 48
    autodetect_kmer_length: bool = False
    use_all_hash_functions: bool = False  #: always true here: no memory limit drops a table
    # alignment
    min_overlap: int = 30
    min_overlap_ratio: float = 0.30
    max_error_rate: float = 0.2
    bin_by_rate: bool = False  #: of an anchor's candidates, keep those in the lowest bin of error rates that has enough
    # data set
    estimated_coverage: float = 1.0
    estimated_error_rate: float = 0.06  #: not the error rate of the data
    m_coverage: float = 0.6
    # qualities
    use_quality: bool = False
    quality_bits: int = 8
    # correction
    correct_candidates: bool = False
    new_columns_to_correct: int = 15
    neighbor_region: int = 5
    min_column_coverage: int = 3  #: rows of a column that may change a letter of an anchor of lower quality
    max_edits: int = 16
    refine_passes: int = 5
    paired_filter_threshold: float = 0.06
    label_quality: bool = False
    label_prefix: str = "correction"
    # classifiers
    correction_type: str = "classic"  #: classic, forest or print
    correction_type_candidates: str = "classic"
    forest_file: str = ""
    forest_file_candidates: str = ""
    threshold_anchor: float = 0.5
    threshold_candidates: float = 0.5
    sample_rate_anchor: float = 1.0
    sample_rate_candidates: float = 0.01
    max_trees: int = 2**32 - 1
    max_trees_candidates: int = 2**32 - 1
    features_file: str = "anchorfeatures.txt"  #: in output_dir, what print mode writes
    features_file_candidates: str = "candidatefeatures.txt"

    def __post_init__(self) -> None:
        if not 1 <= self.kmer_length <= 32:
            raise ValueError("kmer_length: 1 to 32")
        if self.hash_functions < 1:
            raise ValueError("hash_functions: at least 1")
        if self.quality_bits not in (1, 2, 8):
            raise ValueError("quality_bits: 1, 2 or 8")
        for name in ("correction_type", "correction_type_candidates"):
            if getattr(self, name) not in ("classic", "forest", "print"):
                raise ValueError(f"{name}: classic, forest or print")
        for name in ("sample_rate_anchor", "sample_rate_candidates"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name}: 0 to 1")
        if self.output_files and len(self.output_files) not in (1, len(self.input_files)):
            raise ValueError("output_files: none, one for all reads, or one for each input file")

    @property
    def bucket_limit(self) -> int:
        """Most reads of one bucket, from the coverage."""
        return int(min(65535, max(10, int(np.float32(self.estimated_coverage) * np.float32(2.5)))))

    @property
    def kmer_mask(self) -> int:
        """The low 2k bits, as a signed long."""
        return -1 if self.kmer_length == 32 else (1 << 2 * self.kmer_length) - 1

    def minimum_overlap(self, anchor_length: int) -> int:
        return max(int(np.float32(anchor_length) * np.float32(self.min_overlap_ratio)), self.min_overlap)

    @property
    def high_quality(self) -> dict[str, float]:
        """Thresholds of the simple consensus, and those of a high-quality one.  The percentages are taken in single
        precision: 0.07 is seven percent there, and eight in double precision."""
        e = self.estimated_error_rate
        percent = math.ceil(np.float32(e) * np.float32(100.0))
        half = percent // 2
        return {
            "avg": 1 - e,
            "min": 1 - 3 * e,
            "coverage": self.m_coverage * self.estimated_coverage,
            "hq_avg": max(1 - e, 1 - half / 100),
            "hq_min": max(1 - 3 * e, 1 - 3 * half / 100),
        }
