"""Selection rules: their fields and defaults, named sets, and when two of them share their clusters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Rule:
    far_quantile: float = 0.99
    cfar_half: int = 0
    cfar_k: float = 0.0
    leak_ref: str = "weakest_on"
    leak_frac: float = 0.3
    exclude_mhz: tuple[tuple[float, float], ...] = ()
    single_off_frac: float | None = None
    veto_min_targets: int = 0
    off_ceiling_probe: int = 300
    min_off_pool: int = 30

    @classmethod
    def from_json(cls, text: str) -> Rule:
        """Missing fields take their defaults; an unknown one is an error."""
        got = json.loads(text)
        if unknown := set(got) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown rule fields: {', '.join(sorted(unknown))}")
        if "exclude_mhz" in got:
            got["exclude_mhz"] = tuple(tuple(map(float, band)) for band in got["exclude_mhz"])
        return cls(**got)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def shares_clusters(self, other: Rule) -> bool:
        """Whether the two differ in verdict fields alone, so that verdicts can be decided again from saved maps."""
        same = {f: getattr(self, f) for f in VERDICT_FIELDS}
        return self == replace(other, **same)


#: Fields that change verdicts but not clusters.
VERDICT_FIELDS = ("leak_ref", "leak_frac", "single_off_frac", "veto_min_targets")
# Bands left out by the later rules, and the named rules.
_BANDS = ((1200.0, 1341.2), (2300.0, 2360.0))
_V1 = Rule(far_quantile=0.995, cfar_half=256, cfar_k=6.7926, leak_ref="weakest_hit_on")
RULES = {
    "production": Rule(),
    "hybrid_v1": _V1,
    "hybrid_v2": replace(_V1, exclude_mhz=_BANDS),
    "hybrid_v3": replace(_V1, exclude_mhz=_BANDS, leak_frac=0.5),
    "hybrid_v4": replace(_V1, exclude_mhz=_BANDS, leak_frac=0.5, single_off_frac=1.0, veto_min_targets=2),
}
