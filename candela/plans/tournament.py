"""Rounds of a search, when it stops, and the freeze of its finalists. Small documents, kept by the driver."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from ..sources.bars import canonical_json, write_document

# fixed values: rounds, the improvement that counts, and what a strong survivor is
ROUNDS, IMPROVEMENT, STRONG_LIFT, STRONG_COUNT, HOLDOUT_LIFT = 4, 0.01, 0.08, 3, 0.07


def lower_bound(row: dict) -> float:
    return row["lift_low"]


@dataclass
class Tournament:
    """Quality is the best lower lift bound so far."""

    round: int = 0
    quality: float = 0.0
    stale: int = 0
    stop_reason: str | None = None
    survivors: dict = field(default_factory=dict)
    history: list = field(default_factory=list)

    def complete(self, number: int, survivors: list[dict], evaluable: bool = True) -> str | None:
        """Take a round's survivors; the reason to stop, if any. Rounds follow each other; from the second on
        two that can be evaluated without improving end the search, as do enough strong survivors."""
        if self.stop_reason is not None or number != self.round + 1 or number > ROUNDS:
            raise ValueError("rounds follow each other, and none follows the last")
        for row in survivors:
            held = self.survivors.get(row["signature_id"])
            if held is None or lower_bound(row) > lower_bound(held):
                self.survivors[row["signature_id"]] = row
        best = max([self.quality, *map(lower_bound, survivors)])
        gain, self.quality, self.round = best - self.quality, best, number
        if evaluable and number > 1:
            self.stale = 0 if gain >= IMPROVEMENT else self.stale + 1
        strong = sum(r["conservative_lift"] >= STRONG_LIFT for r in self.survivors.values())
        tests = {"fixed_round_limit": number == ROUNDS, "diminishing_returns": self.stale >= 2, "early_quality_attempt": number > 1 and strong >= STRONG_COUNT}
        conditions = [name for name, met in tests.items() if met]
        self.stop_reason = next(iter(conditions), None)
        self.history.append({"round": number, "quality": best, "improvement": gain, "evaluable": evaluable, "conditions": conditions, "diminishing_count": self.stale})
        return self.stop_reason


def digest(document: dict) -> str:
    return hashlib.sha256(canonical_json(document).encode()).hexdigest()


def freeze(finalists: list[dict], path: str | Path, provenance: dict) -> dict:
    """Write the finalists once; the content hash shows any later change."""
    if Path(path).exists():
        raise FileExistsError("a freeze can't be replaced")
    body = {"schema_version": 1, "finalists": finalists, "provenance": provenance}
    body["content_sha256"] = digest(body)
    write_document(path, body)
    return body


def verified(path: str | Path) -> dict:
    document = json.loads(Path(path).read_text())
    body = {k: v for k, v in document.items() if k != "content_sha256"}
    if digest(body) != document.get("content_sha256"):
        raise ValueError("the freeze was changed")
    return document


def holdout_verdict(stop_reason: str | None, rows: list[dict]) -> str | None:
    """What a library's stop reason becomes once the holdout is spent."""
    if stop_reason != "early_quality_attempt":
        return stop_reason
    strong = sum(r["verdict"] == "confirmed" and r["conservative_lift"] >= HOLDOUT_LIFT for r in rows)
    return "quality_gate_reached" if strong >= STRONG_COUNT else "holdout_spent_quality_gate_not_reached"
