"""The record, its namespaces and the configuration."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import types as T

#: ``seq`` is the total order of operations; it decides between versions with the same ``ts``.
RECORD = T.StructType(
    [
        T.StructField("seq", T.LongType(), False), T.StructField("ts", T.LongType(), False), T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType(), False), T.StructField("tombstone", T.BooleanType(), False), T.StructField("crc", T.LongType(), False),
        T.StructField("key_size", T.LongType(), False), T.StructField("value_size", T.LongType(), False),
    ]
)

#: Bytes of a record besides key and value: crc 4, timestamp 8, tombstone 1, two sizes 8 each.
HEADER_BYTES = 29
#: Bytes at the head of a log segment that tell how much of it ends the last record of the one before.
SEGMENT_HEADER = 8


def _limit(default, low=None, high=None, choices=None):
    return field(default=default, metadata={"low": low, "high": high, "choices": choices})


@dataclass(frozen=True)
class Config:
    """Settings with their defaults and accepted ranges; a value out of range is replaced by its default."""

    wal_size: int = _limit(1_048_576, 750)
    memtable_size: int = _limit(1000, 5)
    memtable_count: int = _limit(3, 2, 10)
    memtable_structure: str = _limit("btree", choices=("btree", "skiplist", "hashmap"))
    btree_degree: int = _limit(4, 4)
    skip_list_max_height: int = _limit(20, 16, 32)
    cache_size: int = _limit(5, 5)
    separate_sst_files: bool = _limit(True)
    summary_index_density: int = _limit(5, 2)
    do_compression: bool = _limit(False)
    compression_type: str = _limit("size-tiered", choices=("size-tiered", "leveled"))
    max_lsm_levels: int = _limit(4, 2, 50)
    tables_to_compress: int = _limit(8, 2, 15)
    token_capacity: int = _limit(10, 2, 100)
    refill_cooldown: int = _limit(60, 1, 600)
    filter_precision: float = _limit(0.1, 0.01, 0.5)
    first_leveled_size: int = _limit(10_000, 3000, 1_000_000)
    leveled_inc: int = _limit(10, 1, 20)

    def validated(self) -> Config:
        fixed = {}
        for f in fields(self):
            value, m = getattr(self, f.name), f.metadata
            wanted = (int, float) if isinstance(f.default, float) else type(f.default)
            ok = isinstance(value, wanted) and (isinstance(value, bool) == isinstance(f.default, bool))
            ok = ok and (m["low"] is None or value >= m["low"]) and (m["high"] is None or value <= m["high"]) and (m["choices"] is None or value in m["choices"])
            if not ok:
                fixed[f.name] = f.default
        return replace(self, **fixed)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a JSON file: unknown settings are ignored; a file that does not exist gives the defaults. Two settings also go by older spellings."""
        try:
            with open(path) as file:
                raw = json.load(file)
        except FileNotFoundError:
            return cls()
        raw = {{"cahce_size": "cache_size", "filter_precsion": "filter_precision"}.get(k, k): v for k, v in raw.items()}
        return cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw}).validated()

    def save(self, path: str) -> None:
        with open(path, "w") as file:
            json.dump(asdict(self), file, indent=2)
