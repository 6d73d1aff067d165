"""Jobs by name: a module's functions called with settings and arguments, from Python or the command line."""

from __future__ import annotations

import argparse
import importlib
import inspect
from collections.abc import Callable, Sequence
from pathlib import Path

from trackengine.config import SessionConfig


def call(f: Callable, config: SessionConfig, args: Sequence[str]) -> object:
    """Call f with (config, *args), (config, args), (config), (*args), (args) or (), as its parameters say."""
    params = [p for p in inspect.signature(f).parameters.values()]
    lead = [config] if params and params[0].name == "config" else []
    rest = params[len(lead) :]
    if not rest:
        return f(*lead)
    one = len(rest) == 1 and rest[0].kind is not inspect.Parameter.VAR_POSITIONAL and rest[0].name == "args"
    return f(*lead, list(args)) if one else f(*lead, *args)


def session_config(module: object, config: SessionConfig) -> SessionConfig:
    """The module's own settings go last: a file over the current ones, then a whole configuration in their place."""
    name = getattr(module, "CONFIG_FILENAME", None)
    if name:
        config = config.merged(Path(name).read_text())
    return getattr(module, "CONFIG", None) or config


def main(argv: Sequence[str] | None = None) -> object:
    p = argparse.ArgumentParser(prog="trackengine", description="Run a function of a plugin module.")
    p.add_argument("-c", "--config")
    p.add_argument("--bin-size", type=int)
    p.add_argument("--bin-summary", choices=["mean", "max", "min", "discrete mean"])
    p.add_argument("--bin-overlap", type=int)
    p.add_argument("--initial-value", type=float)
    p.add_argument("--threads", type=int)
    p.add_argument("-v", "--verbose", action="count", default=None)
    p.add_argument("module")
    p.add_argument("function")
    p.add_argument("args", nargs=argparse.REMAINDER)
    o = p.parse_args(argv)
    config = SessionConfig()
    if o.config:
        config = config.merged(Path(o.config).read_text())
    flags = {"bin_size": o.bin_size, "bin_summary": o.bin_summary, "bin_overlap": o.bin_overlap, "track_init": o.initial_value, "threads": o.threads, "verbose": o.verbose}
    config = SessionConfig(**{**config.__dict__, **{k: v for k, v in flags.items() if v is not None}})
    if config.bin_size < 0 or config.threads < 1:
        p.error("bin size must not be negative, and threads at least 1")
    module = importlib.import_module(o.module)
    return call(getattr(module, o.function), session_config(module, config), o.args)


if __name__ == "__main__":
    main()
