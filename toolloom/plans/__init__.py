"""Registered queries of the engine: each module has ``QUERIES`` and ``ORACLES``."""

from toolloom.plans import assembly, datasets, end_to_end, evaluation, generation, groups, validation

MODULES = [evaluation.plans, end_to_end.plans, validation.plans, groups.plans, datasets.plans, generation.plans, assembly.plans]
