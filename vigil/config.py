"""Rule settings, and the YAML files they can come from."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

RULES_VERSION = "1.1.0"


class ConfigError(ValueError):
    """A threshold that is no positive integer."""


@dataclass(frozen=True)
class RuleConfig:
    """Counts and windows (minutes) of the three rules."""

    brute_force_count: int = 5
    brute_force_window: int = 10
    port_scan_count: int = 20
    port_scan_window: int = 5
    flood_404_count: int = 30
    flood_404_window: int = 5

    @staticmethod
    def uniform(count: int, window: int) -> RuleConfig:
        return RuleConfig(*[count, window] * 3)

    def override(self, **values: int | None) -> RuleConfig:
        """Explicit settings win over those of a file; None leaves a setting as it is."""
        known = {f.name for f in fields(self)}
        if unknown := set(values) - known:
            raise ConfigError(f"no such setting: {', '.join(sorted(unknown))}")
        return replace(self, **{k: v for k, v in values.items() if v is not None})


def _positive(name: str, value: object) -> int:
    try:
        number = int(value)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        raise ConfigError(f"thresholds.{name} must be a positive integer, not {value!r}") from None
    if number < 1:
        raise ConfigError(f"thresholds.{name} must be at least 1, not {number}")
    return number


def rules_from(config: dict | None, base: RuleConfig = RuleConfig()) -> RuleConfig:
    """Settings from `thresholds: {rule: {count, window_seconds}}`; seconds become whole minutes, one at least. All else in the
    file is ignored, missing parts keep the base."""
    thresholds = (config or {}).get("thresholds") or {}
    found: dict[str, int] = {}
    for rule in ("brute_force", "port_scan", "flood_404"):
        own = thresholds.get(rule) or {}
        if "count" in own:
            found[f"{rule}_count"] = _positive(f"{rule}.count", own["count"])
        if "window_seconds" in own:
            found[f"{rule}_window"] = max(1, _positive(f"{rule}.window_seconds", own["window_seconds"]) // 60)
    return base.override(**found)


@dataclass(frozen=True)
class Allowlist:
    """Networks (IPs or CIDR ranges), user names and host names whose events are left out."""

    networks: tuple[str, ...] = ()
    usernames: tuple[str, ...] = ()
    hostnames: tuple[str, ...] = ()

    @staticmethod
    def of(config: dict | None) -> Allowlist:
        """From `{ips, usernames, hostnames}`; missing keys are empty."""
        get = lambda key: tuple(str(x).strip() for x in (config or {}).get(key) or () if str(x).strip())
        return Allowlist(get("ips"), get("usernames"), get("hostnames"))

    @staticmethod
    def of_csv(text: str | None) -> Allowlist:
        return Allowlist(tuple(x.strip() for x in (text or "").split(",") if x.strip()))


def load_yaml(path: str) -> dict:
    """A small driver-side settings file. Needs PyYAML where it is called."""
    import yaml

    with open(path) as lines:
        return yaml.safe_load(lines) or {}
