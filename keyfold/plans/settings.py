"""The six tuning keywords. They are checked and kept, and never change a result: sizing belongs to the session."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from keyfold.plans.specs import Call

_NUMBERS = ("max_table_size", "num_hash_buckets", "spill_chunk_size", "merge_chunk_size", "output_chunk_size")
_SPELLINGS = {"spill_chuck_size": "spill_chunk_size"}
_DEFAULT_CHUNK = 100_000


@dataclass(frozen=True)
class Settings:
    """``max_table_size`` (MB) and ``num_hash_buckets`` are None when Spark is left to choose."""

    input_sorted: bool
    max_table_size: int | None = None
    num_hash_buckets: int | None = None
    spill_chunk_size: int = _DEFAULT_CHUNK
    merge_chunk_size: int = _DEFAULT_CHUNK
    output_chunk_size: int = _DEFAULT_CHUNK


def sorted_by_default(call: Call, dims: Sequence[str]) -> bool:
    """True if every key is a dimension other than the last one."""
    return all(k.is_dimension and k.name != dims[-1] for k in call.keys)


def settings(call: Call, dims: Sequence[str], keywords: dict[str, Any]) -> Settings:
    given: dict[str, Any] = {}
    for name, value in keywords.items():
        name = _SPELLINGS.get(name, name)
        if name in given:
            raise ValueError(f"keyword {name!r} is given twice")
        if name == "input_sorted":
            if not isinstance(value, bool):
                raise ValueError(f"input_sorted must be a bool, not {value!r}")
        elif name not in _NUMBERS:
            raise ValueError(f"unknown keyword {name!r}; known: input_sorted, {', '.join(_NUMBERS)}")
        elif isinstance(value, bool) or not isinstance(value, int) or not 0 < value < 2**63:
            raise ValueError(f"{name} must be a whole number above 0, not {value!r}")
        given[name] = value
    return Settings(**({"input_sorted": sorted_by_default(call, dims)} | given))
