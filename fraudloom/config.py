"""Settings of the surveillance operators, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class ScoringConfig:
    """Weights of the composite score and the threshold that raises an alert."""

    w_rule: Decimal = Decimal("0.5")
    w_ml: Decimal = Decimal("0.3")
    w_profile: Decimal = Decimal("0.2")
    alert_threshold: Decimal = Decimal("0.60")


@dataclass(frozen=True)
class LifecycleConfig:
    """Escalation delays in minutes; `batch_size` limits a tier of one tick where it is set."""

    email_minutes: int = 5
    slack_minutes: int = 10
    batch_size: int | None = None


@dataclass(frozen=True)
class DetectionConfig:
    """Everything `detect` needs besides its tables."""

    scoring: ScoringConfig = field(default_factory=ScoringConfig)
    velocity_minutes: int = 10
    demo_mode: bool = False


# Relay and consumer limits (fixed values).
MAX_PUBLISH_RETRIES = 8
MAX_CONSUMER_DELIVERIES = 5
RELAY_BATCH_SIZE = 50
CONSUMER_BATCH_SIZE = 10
MIN_IDLE_SECONDS = 30
