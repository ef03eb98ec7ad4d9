"""Parameters from TOML, as dataclasses; unknown keys are ignored, missing ones are named."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Observable:
    name: str
    file: str
    forward_name: str = ""
    event_statics_id: int = 0
    station_statics_id: int = 0
    noise_guess: float = 1.0
    demean: bool = False


@dataclass(frozen=True)
class Parameter:
    name: str
    prior: str
    vlims: tuple[float, ...]
    theta_lims: tuple[float, float] = (-90.0, 90.0)
    phi_lims: tuple[float, float] = (-180.0, 180.0)
    r_lims: tuple[float, float] = (0.0, 0.0)
    extrapolation: float = 0.0


@dataclass(frozen=True)
class Config:
    out_directory: str
    run_id: str
    observables: tuple[Observable, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    sections: dict = field(default_factory=dict)


def record(cls, values: dict):
    names = {f.name: f for f in fields(cls)}
    missing = [n for n, f in names.items() if n not in values and f.default is f.default_factory]
    if missing:
        raise ValueError(f"{cls.__name__} lacks {missing}")
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names})


#: Fixed names: keys of parameter files, and the fields they fill.
OBSERVABLE_KEYS = {"type": "name", "forward_function": "forward_name", "data_uncertainty": "noise_guess", "tf_event_demean": "demean", "tf_event_statics": "event_statics_id", "tf_station_statics": "station_statics_id"}
PARAMETER_KEYS = {"field": "name", "pdf_parameters": "vlims", "lat_lims": "theta_lims", "lon_lims": "phi_lims", "elv_lims": "r_lims", "extrap_value": "extrapolation"}


def renamed(values: dict, keys: dict[str, str]) -> dict:
    return {keys.get(k, k): v for k, v in values.items()}


def parse(text: str) -> Config:
    """A parameter file: two top-level names, [[DataFields]], [[ParameterFields]] and further sections as they are."""
    raw = tomllib.loads(text)
    lists = ("DataFields", "ParameterFields")
    missing = [k for k in ("out_directory", "run_id") if k not in raw]
    if missing:
        raise ValueError(f"the parameters lack {missing}")
    observables = tuple(record(Observable, renamed(x, OBSERVABLE_KEYS)) for x in raw.get("DataFields", []))
    parameters = tuple(record(Parameter, renamed(x, PARAMETER_KEYS)) for x in raw.get("ParameterFields", []))
    return Config(raw["out_directory"], raw["run_id"], observables, parameters, {k: v for k, v in raw.items() if isinstance(v, dict) and k not in lists})


def required_fields(forward_name: str) -> list[str]:
    """Fields that a forward function's name asks for: observable_phase_field1_field2..., a last method name aside."""
    parts = forward_name.split("_")[2:]
    return [p for p in parts if p != "Thomsen" and p != "thomsen"]


def check(config: Config, known: set[str]) -> None:
    """Every forward function exists and every field it names is a parameter."""
    names = {p.name for p in config.parameters}
    for o in config.observables:
        if o.forward_name and o.forward_name not in known:
            raise ValueError(f"{o.name}: no forward function {o.forward_name!r}")
        lacking = [f for f in required_fields(o.forward_name) if f not in names]
        if lacking:
            raise ValueError(f"{o.name}: no fields {lacking}")


def to_json(config: Config) -> str:
    return json.dumps(asdict(config), indent=1)
