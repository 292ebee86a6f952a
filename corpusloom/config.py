"""Run configuration: layered files, dataclasses that are checked when they are made, and dotted overrides."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class MixtureConfig:
    weights: dict[str, int | None] = field(default_factory=dict)
    seed: int = 0
    exclude: list[str] = field(default_factory=list)


@dataclass
class TokenizeConfig:
    tokenizer: str | None = None  # a tokenizers JSON file; None: the native expression
    eos: str | None = None  # None: the definition's end token, "<eos>" for the native expression
    test_size: float = 0.1
    seed: int = 0

    def __post_init__(self) -> None:
        if not 0 < self.test_size < 1:
            raise ValueError("test_size must be between 0 and 1")


@dataclass
class PackConfig:
    max_seq_length: int = 2048
    eos_token_id: int = 0

    def __post_init__(self) -> None:
        if self.max_seq_length < 1:
            raise ValueError("max_seq_length must be at least 1")


@dataclass
class AdapterConfig:
    rank: int = 16


@dataclass
class RunConfig:
    """Absent or null adapter means none; an empty section means the defaults. An unknown key raises TypeError."""

    mixture: MixtureConfig = field(default_factory=MixtureConfig)
    tokenize: TokenizeConfig = field(default_factory=TokenizeConfig)
    pack: PackConfig = field(default_factory=PackConfig)
    adapter: AdapterConfig | None = None

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> RunConfig:
        kinds = {"mixture": MixtureConfig, "tokenize": TokenizeConfig, "pack": PackConfig}
        d = dict(d)
        got = {k: kind(**(d.pop(k, None) or {})) for k, kind in kinds.items()}
        adapter = d.pop("adapter", None)
        if d:
            raise TypeError(f"unknown sections {sorted(d)}")
        return cls(**got, adapter=None if adapter is None else AdapterConfig(**adapter))

    def get_dict(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if v is not None}

    def override(self, *settings: str) -> RunConfig:
        """A copy with a.b=value applied; values are read as JSON, else as strings."""
        d = self.get_dict()
        for s in settings:
            path, _, raw = s.partition("=")
            *parents, last = path.split(".")
            at = d
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = _value(raw)
        return type(self).from_dict(d)


class ConfigError(ValueError):
    """A configuration names something that is not there."""


def _merge(under: dict, over: dict) -> dict:
    """over on top of under: mappings merge, everything else replaces."""
    out = dict(under)
    for k, v in over.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parsed(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return json.loads(text) if text.strip() else {}
    return yaml.safe_load(text) or {}


def _value(raw: str) -> Any:
    try:
        return json.loads(raw)
    except ValueError:
        return raw


def _at(tree: dict, path: str, make: bool) -> tuple[dict, str]:
    """The mapping that holds path's last key."""
    *parents, last = path.split(".")
    for p in parents:
        if not isinstance(tree.get(p), dict):
            if not make and p not in tree:
                raise ConfigError(f"no key {path}")
            tree[p] = {}
        tree = tree[p]
    if not make and last not in tree:
        raise ConfigError(f"no key {path}")
    return tree, last


def compose(read: Callable[[str], str | None], name: str, overrides: Sequence[str] = ()) -> dict[str, Any]:
    """The tree that a configuration and its defaults list make, layer on layer.

    read returns a file's text by its path without ending, or None where there is none. defaults lists, in order,
    "group: option" (the file group/option, under the key group), plain names (files, at the top) and "_self_" (the
    configuration itself; at the end if it isn't listed). Later layers win; mappings merge. Files of the list may have lists
    of their own.

    overrides: group=option takes another option of a listed group; a.b=value replaces a key that is there; +a.b=value
    adds one; ~a.b removes one. Values are read as JSON, else as strings. What isn't there raises ConfigError.
    """
    chosen = dict(o.split("=", 1) for o in overrides if "=" in o and o[0] not in "+~" and "." not in o.split("=", 1)[0])
    used: set[str] = set()

    def layer(path: str, groups: bool) -> dict:
        text = read(path)
        if text is None:
            raise ConfigError(f"no configuration {path}")
        own = _parsed(text)
        listed = list(own.pop("defaults", []))
        folder = path.rpartition("/")[0]
        tree: dict[str, Any] = {}
        for item in [*listed, *([] if "_self_" in listed else ["_self_"])]:
            if item == "_self_":
                tree = _merge(tree, own)
            elif isinstance(item, dict):
                for group, option in item.items():
                    if groups and group in chosen:
                        used.add(group)
                        option = chosen[group]
                    if option is not None:
                        tree = _merge(tree, {group: layer("/".join(x for x in (folder, group, str(option)) if x), False)})
            else:
                tree = _merge(tree, layer("/".join(x for x in (folder, item) if x), False))
        return tree

    tree = layer(name, True)
    for o in overrides:
        key, eq, raw = o.lstrip("+~").partition("=")
        if o.startswith("~"):
            holder, last = _at(tree, key, False)
            del holder[last]
        elif not eq:
            raise ConfigError(f"an override is key=value: {o}")
        elif key not in used:
            holder, last = _at(tree, key, o.startswith("+"))
            holder[last] = _value(raw)
    return tree


def compose_files(spark: SparkSession, folder: str, name: str, overrides: Sequence[str] = ()) -> dict[str, Any]:
    """compose() of the files folder/<path>.yaml or .json, read through Hadoop's file system."""

    def read(path: str) -> str | None:
        for ending in ("yaml", "json"):
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}.{ending}")
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                return spark.read.text(p.toString(), wholetext=True).head()[0]
        return None

    return compose(read, name, overrides)


SECTIONS = tuple(f.name for f in fields(RunConfig))
