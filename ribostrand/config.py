"""Typed run options, and the rules by which options imply each other."""

from __future__ import annotations

import ast
import configparser
import json
from dataclasses import asdict, dataclass, field, fields, replace

# The default sequencing adapters, handles and the alignment scores.
ADAPTER_T = "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT"
ADAPTER_B = "AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC"
MASKS = ("RRRY", "YYYR")
EDGE_POLICIES = (None, "stop_only", "stop_and_mut")


@dataclass(frozen=True)
class RunConfig:
    """All options of a run; ``resolve()`` checks them and applies what they imply."""

    masks: tuple[str, ...] = MASKS
    adapter_t: str = ADAPTER_T
    adapter_b: str = ADAPTER_B
    quiet: bool = False
    debug: bool = False
    log: str | None = None
    minimum_target_match_length: int = 10
    count_mutations: bool = False
    mutations_require_quality_score: int | None = None
    count_edge_mutations: str | None = None
    ignore_stops_with_mismatched_overlap: bool = True
    minimum_adapter_len: int = 0
    allow_indeterminate: bool = False
    allowed_adapter_errors: int = 0
    allowed_target_errors: int = 0
    writeback_results: bool = False
    result_set_name: str | None = None
    resume_processing: bool = False
    skip_database: bool = True
    pair_length: int | None = None
    allow_multiple_rt_starts: bool = False
    rt_primers: tuple[str, ...] = ()
    single_target_linker: str | None = None
    cotrans: bool = False
    cotrans_linker: str = "CTGACTCGGGCACCAAGGAC"
    cotrans_minimum_length: int = 20
    minimum_tag_match_length: int = 8
    regions_of_interest: tuple[tuple[int, int], ...] = ()
    algorithm: str = "find_partial"
    allow_negative_values: bool = False
    compute_z_reactivity: bool = False
    count_left_prefixes: bool = False
    collapse_left_prefixes: bool = False
    collapse_only_prefixes: tuple[str, ...] = ()
    generate_sam: str | None = None
    generate_channel_reads: bool = False
    dumbbell: str | None = None
    allowed_dumbbell_errors: int = 0
    count_only_full_reads: bool = False
    handle_indels: bool = False
    indel_match_value: float = 3
    indel_mismatch_cost: float = 2
    indel_gap_open_cost: float = 5
    indel_gap_extend_cost: float = 1
    run_limit: int = 0
    process_all_pairs: bool = False
    redo_tag: str | None = None
    force_mask: str | None = None
    unsafe_errors: bool = False
    extra_tags: tuple[tuple[str, str], ...] = field(default_factory=tuple)

    def resolve(self) -> RunConfig:
        """Checked, with the options that others force."""
        c, change = self, {}
        if c.count_mutations:
            change["allowed_target_errors"] = max(1, c.allowed_target_errors)
        if c.handle_indels and not c.count_mutations:
            raise ValueError("handle_indels needs count_mutations")
        if c.collapse_left_prefixes or c.collapse_only_prefixes:
            change |= {"collapse_left_prefixes": True, "count_left_prefixes": True}
        primers = (c.single_target_linker,) if c.single_target_linker else c.rt_primers
        if primers:
            change |= {"rt_primers": primers, "allow_multiple_rt_starts": True}
        after = replace(c, **change)
        only_search = (
            c.handle_indels or (c.dumbbell and c.cotrans) or c.allowed_dumbbell_errors or after.count_left_prefixes or after.allow_multiple_rt_starts
            or after.allowed_target_errors > 1 or not c.ignore_stops_with_mismatched_overlap or c.regions_of_interest or c.generate_sam or c.generate_channel_reads
            or c.force_mask or any(len(m) != 4 for m in c.masks)
        )
        if only_search:
            change["algorithm"] = "find_partial"
        if c.regions_of_interest:
            change["regions_of_interest"] = tuple((min(r), max(r)) for r in c.regions_of_interest)
        if c.generate_sam or c.generate_channel_reads or (c.count_mutations and c.mutations_require_quality_score is not None):
            change["skip_database"] = True
        quality = c.mutations_require_quality_score
        if quality is not None and not 0 <= quality <= 42:
            raise ValueError("mutations_require_quality_score must be from 0 to 42")
        if c.count_edge_mutations not in EDGE_POLICIES:
            raise ValueError(f"count_edge_mutations must be one of {EDGE_POLICIES}")
        if not c.unsafe_errors and not 0 <= c.allowed_target_errors <= (2 if c.handle_indels else 4):
            raise ValueError("allowed_target_errors must be at most 4, or 2 with handle_indels")
        if c.algorithm not in ("find_partial", "lookup"):
            raise ValueError(f"unknown algorithm {c.algorithm}")
        if c.cotrans and not c.cotrans_linker:
            raise ValueError("cotrans needs a linker")
        if not 8 <= c.minimum_target_match_length <= 35:
            raise ValueError("minimum_target_match_length must be from 8 to 35")
        return replace(c, **change)

    def to_map(self) -> dict[str, str]:
        return {k: json.dumps(v) for k, v in asdict(self).items()}

    @classmethod
    def from_map(cls, values: dict[str, str]) -> RunConfig:
        def listed(v):
            return tuple(listed(x) for x in v) if isinstance(v, list) else v

        return cls(**{f.name: listed(json.loads(values[f.name])) for f in fields(cls) if f.name in values})


def typed(name: str, text: str):
    """An option's value from the text of a configuration file."""
    kinds = {f.name: f for f in fields(RunConfig)}
    if name not in kinds:
        raise KeyError(f"unknown option {name}")
    default = getattr(RunConfig(), name)
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError):
        value = text.strip()
    if name == "regions_of_interest" and isinstance(value, str):
        return tuple(tuple(int(x) for x in part.split("-")) for part in value.split(","))
    if isinstance(default, tuple):
        parts = value.split(",") if isinstance(value, str) else value
        return tuple(x.strip() if isinstance(x, str) else tuple(x) for x in parts)
    return bool(value) if isinstance(default, bool) else value


def read_config(path: str) -> tuple[RunConfig, dict[str, str], dict[str, str]]:
    """(options, inputs, metadata) of an INI file: the first section, whatever its name, and [metadata]."""
    ini = configparser.ConfigParser(interpolation=None)
    with open(path, encoding="utf-8") as f:
        ini.read_file(f)
    main = next(s for s in ini.sections() if s != "metadata")
    known = {f.name for f in fields(RunConfig)}
    options = {k: typed(k, v) for k, v in ini[main].items() if k in known}
    inputs = {k: v for k, v in ini[main].items() if k not in known}
    return RunConfig(**options), inputs, dict(ini["metadata"]) if ini.has_section("metadata") else {}
