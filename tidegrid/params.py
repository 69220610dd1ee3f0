"""Settings of the feature and backtest rules, in one place."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from datetime import datetime
from pathlib import Path


@dataclass(frozen=True)
class Variant:
    """Which columns a model sees, from when it may learn, and whose tuned parameters it uses (its own if none is named)."""

    name: str
    prefixes: tuple[str, ...]
    train_start: datetime
    leaky: bool = False
    quantiles: bool = False
    params_from: str = ""

    @property
    def source(self) -> str:
        return self.params_from or self.name


#: The models that are compared: without weather, with forecasts, without weather on the same short history, and with observed
#: weather (an upper bound that knows the future).
VARIANTS = (
    Variant("no_weather", ("f_",), datetime(2019, 1, 1)),
    Variant("weather_forecast", ("f_", "wxf_"), datetime(2024, 3, 9), quantiles=True),
    Variant("no_weather_short", ("f_",), datetime(2024, 3, 9), params_from="no_weather"),
    Variant("oracle_weather", ("f_", "oracle_"), datetime(2019, 1, 1), leaky=True, params_from="no_weather"),
)
#: Sites of weather (fixed values): id, name, role, latitude, longitude.
SITES = (
    ("hornsea", "Hornsea offshore wind zone", "wind", 53.885, 1.791),
    ("moray_firth", "Moray Firth offshore wind (Beatrice / Moray East)", "wind", 58.25, -2.87),
    ("whitelee", "Whitelee onshore wind farm", "wind", 55.68, -4.25),
    ("somerset", "Somerset / Wiltshire solar cluster", "solar", 51.2, -2.6),
    ("east_anglia", "Suffolk / Norfolk solar cluster", "solar", 52.3, 0.9),
    ("london", "London demand centre", "demand", 51.507, -0.128),
)


@dataclass(frozen=True)
class Settings:
    start: datetime = datetime(2019, 1, 1)
    time_zone: str = "Europe/London"
    step_minutes: int = 30
    origin_hours: tuple[int, ...] = (0, 6, 12, 18)
    horizon_min_h: float = 24.0
    horizon_max_h: float = 48.0
    availability_lag_minutes: int = 60
    weather_availability_hours: int = 8
    suspect_max: float = 1000.0
    lead_days: tuple[int, ...] = (1, 2, 3)
    cut_in: float = 3.0
    rated: float = 12.0
    cut_out: float = 25.0
    interval_alpha: float = 0.2
    calibration_months: int = 1
    seed: int = 42
    n_search: int = 12
    max_rounds: int = 3000
    early_stopping: int = 100
    test_start: datetime = datetime(2025, 10, 1)
    validation_months: int = 6
    variants: tuple[Variant, ...] = VARIANTS
    sites: tuple[tuple, ...] = SITES

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """From a YAML file; unknown names are an error, missing ones keep their defaults."""
        import yaml

        got = yaml.safe_load(Path(path).read_text()) or {}
        unknown = set(got) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        plain = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in got.items()}
        if "variants" in plain:
            plain["variants"] = tuple(Variant(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}) for x in plain["variants"])
        return cls(**plain)

    def dump(self, path: str | Path) -> None:
        import yaml

        plain = lambda v: [plain(x) for x in v] if isinstance(v, tuple | list) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
        Path(path).write_text(yaml.safe_dump(plain(asdict(self)), sort_keys=False))

    @property
    def tuned(self) -> list[Variant]:
        """Variants with parameters of their own."""
        return [v for v in self.variants if not v.params_from]


def dump_tuned(best: dict[str, dict], path: str | Path, note: str = "") -> None:
    """Writes each tuned variant's parameters, rounds and validation error, with a note on how they came about."""
    import yaml

    head = "# Written by the tune command.\n" + "".join(f"# {line}\n" for line in note.splitlines())
    Path(path).write_text(head + yaml.safe_dump(best, sort_keys=False))


def load_tuned(path: str | Path) -> dict[str, dict]:
    """What dump_tuned() wrote; FileNotFoundError says what to run."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(f"{path} is missing: run the tune command")
    return yaml.safe_load(Path(path).read_text())


#: Column prefixes of a training set: what they mean and whether a model may see them.
FEATURE, FORECAST, LEAKY = "f_", "wxf_", "oracle_"
FORBIDDEN = ("y_", "ref_", "asof_")


def feature_columns(columns: list[str], prefixes: list[str], allow_leaky: bool = False) -> list[str]:
    """The columns with the given prefixes; ValueError for targets, references, provenance, leaks and prefixes without columns."""
    for p in prefixes:
        if p.startswith(FORBIDDEN):
            raise ValueError(f"{p} columns are never features")
        if p.startswith(LEAKY) and not allow_leaky:
            raise ValueError(f"{p} columns know the future; pass allow_leaky=True")
        if not any(c.startswith(p) for c in columns):
            raise ValueError(f"no column starts with {p}")
    return [c for c in columns if c.startswith(tuple(prefixes))]
