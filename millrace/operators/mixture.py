"""Mixtures of sources: validation, reweighting, ablations, hashes and sampling."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sources in their order, with different tokens (none if licences decide) and the range of epochs.
CATALOGUE = [
    ("web", 20_000_000_000_000, 2, 3),
    ("code", 4_000_000_000_000, 4, 4),
    ("math_science_arxiv", 1_500_000_000_000, 4, 4),
    ("books_papers", None, 2, 4),
    ("synthetic_rewrites", 40_000_000_000_000, 1, 1),
    ("synthetic_reasoning", 10_000_000_000_000, 1, 1),
    ("procedural_arc", 2_000_000_000_000, 1, 1),
    ("agentic_trajectories", 1_000_000_000_000, 1, 1),
]
SOURCES = [row[0] for row in CATALOGUE]
# Sources that the decay phase favours.
DECAYED = ("code", "math_science_arxiv", "synthetic_reasoning")


@dataclass(frozen=True)
class Mix:
    mix_id: str
    mix_bucket: str
    phase: str
    weights: dict[str, float]

    def ordered(self) -> list[tuple[str, float]]:
        return [(s, self.weights[s]) for s in SOURCES if s in self.weights]

    def validate(self) -> Mix:
        """Known sources, positive weights, a sum of 1 within 1e-9."""
        if not self.weights or set(self.weights) - set(SOURCES):
            raise ValueError(f"sources {sorted(set(self.weights) - set(SOURCES))} are unknown or there are none")
        if any(not w > 0 for w in self.weights.values()):
            raise ValueError("every weight must be positive")
        if abs(sum(w for _, w in self.ordered()) - 1) > 1e-9:
            raise ValueError("the weights don't add up to 1")
        return self

    def _scaled(self, weights: dict[str, float], **changes) -> Mix:
        total = sum(weights[s] for s in SOURCES if s in weights)
        return replace(self, weights={s: w / total for s, w in weights.items()}, **changes).validate()

    def decayed(self, factor: float) -> Mix:
        """Favoured sources times a factor over 1, then scaled to 1."""
        if not factor > 1:
            raise ValueError("the factor must be over 1")
        self.validate()
        return self._scaled({s: w * (factor if s in DECAYED else 1) for s, w in self.weights.items()}, phase="decay")

    def without(self, source: str) -> Mix:
        if source not in self.weights or len(self.weights) < 2:
            raise ValueError(f"{source} can't be dropped")
        return self._scaled({s: w for s, w in self.weights.items() if s != source}, mix_id=f"{self.mix_id}-no-{source}")

    def ablations(self) -> list[Mix]:
        return [self.without(s) for s, _ in self.ordered()]

    def canonical_json(self) -> str:
        """Compact JSON with the fields in the order of the record and the sources in theirs."""
        fields = {"mix_id": self.mix_id, "mix_bucket": self.mix_bucket, "phase": self.phase, "weights": dict(self.ordered())}
        return json.dumps(fields, separators=(",", ":"), ensure_ascii=False)

    def hash(self) -> str:
        return hashlib.sha256(self.canonical_json().encode()).hexdigest()

    def sample(self, u: Column) -> Column:
        """The first source whose running sum of weights is over ``u``; the last one if none is."""
        out, total = None, 0.0
        for source, weight in self.ordered():
            total += weight
            out = F.when(u < total, source) if out is None else out.when(u < total, source)
        return out.otherwise(self.ordered()[-1][0])


def weights_table(spark: SparkSession, *mixes: Mix) -> DataFrame:
    """``(mix_id, position, source, weight)``."""
    rows = [(m.mix_id, k, s, w) for m in mixes for k, (s, w) in enumerate(m.ordered())]
    return spark.createDataFrame(rows, "mix_id string, position int, source string, weight double")


def unit_hash(key: Column) -> Column:
    """A number from 0 to below 1 that depends on the key alone: 52 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tokens_seen(unique_tokens: Column, epochs: Column) -> Column:
    """Null where the number of different tokens is."""
    return unique_tokens * epochs
