"""Settings from a TOML file: known keys only, ``${NAME}`` taken from the environment."""

from __future__ import annotations

import os
import string
import tomllib
from dataclasses import dataclass, field, fields


class _Braced(string.Template):
    """Text in which only ``${NAME}`` with an ASCII name stands for something; any other dollar sign is itself."""

    pattern = r"(?a:\$(?:\{(?P<braced>[A-Za-z_]\w*)\}|(?P<escaped>(?!))|(?P<named>(?!))|(?P<invalid>(?!))))"


@dataclass
class Settings:
    store: str = ""
    minimum_age_days: int = 0
    sources: list[str] = field(default_factory=list)
    codec: str = "zstd"
    shuffle_partitions: int = 0


def load(path: str) -> Settings:
    """The settings of a file; an unknown key, or a value of another type than the default's, is refused."""
    with open(path, "rb") as f:
        given = tomllib.load(f)
    known = {f.name: f for f in fields(Settings)}
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    plain = Settings()
    for name, value in given.items():
        wanted = type(getattr(plain, name))
        if type(value) is not wanted:
            raise ValueError(f"{name} must be a {wanted.__name__}")
        texts = [value] if wanted is str else value if wanted is list else []
        if not all(isinstance(t, str) for t in texts):
            raise ValueError(f"{name} must hold texts only")
        try:
            filled = [_Braced(t).substitute(os.environ) for t in texts]
        except KeyError as absent:
            raise ValueError(f"{name}: the environment has no {absent.args[0]}") from None
        setattr(plain, name, filled[0] if wanted is str else filled if wanted is list else value)
    return plain


def first_not_given(public: list[str], given: list[str]) -> list[str]:
    """The public sources that are not among the given ones, in order."""
    return [s for s in public if s not in set(given)]
