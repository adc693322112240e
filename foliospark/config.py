"""Every threshold of the library in one frozen value, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Tuning:
    # lines read from a source
    min_line_width: float = 0.004
    min_line_height: float = 0.0008
    # skew and bands
    bands: int = 3
    band_min_lines: int = 4
    max_skew_degrees: float = 10.0
    orientation_min_lines: int = 3
    orientation_quarter: float = 0.78
    orientation_half: float = 2.35
    # columns
    gutter_max_width: float = 0.80
    gutter_min_lines: int = 6
    gutter_bins: int = 200
    gutter_low: int = 60
    gutter_high: int = 140
    gutter_share: float = 0.15
    gutter_min_run: int = 4
    # roles
    margin_y: float = 0.05
    footnote_y: float = 0.22
    footnote_height: float = 0.82
    role_min_lines: int = 5
    # paragraphs
    paragraph_gap: float = 0.40
    side_by_side: float = 0.5
    row_overlap: float = 0.3
    # second OCR pass
    second_pass_confidence: float = 0.35
    second_pass_iou: float = 0.10
    # correction
    context_words: int = 2
    grapheme_limit: int = 20
    substitution_limit: int = 25
    candidate_limit: int = 30
    split_min_length: int = 6
    split_max_length: int = 24
    split_max_segment: int = 12
    split_min_mean: float = 2.5
    lexicon_min_count: int = 5
    lexicon_at_hand: int = 300_000
    lexicon_in_pages: int = 4_000_000
    # crops and images
    crop_brightness: float = 0.85
    crop_padding: float = 0.01
    crop_min_reduction: float = 0.02
    crop_max_width_cut: float = 0.50
    crop_max_height_cut: float = 0.45
    crop_max_aspect_change: float = 0.40
    landscape: float = 1.05
    weak_scan: float = -0.2
    weak_scan_upscale: float = 1.4


TUNING = Tuning()
