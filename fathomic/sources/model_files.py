"""Model files: one folder per model, ``meta.json`` plus ``arrays.npz``.

Only plain values and numeric arrays are stored and the class is looked up in a
table of the library's own classes, so reading a file runs nothing.
"""

from __future__ import annotations

import dataclasses
import importlib
import io
import json

import numpy as np
import pyarrow.fs as pafs

FORMAT, VERSION = "fathomic-model", 1
MODULES = ("preprocessing", "decomposition", "linear", "naive_bayes", "cluster", "mixture", "trees", "feature_selection", "density", "timeseries")


def _pack(value, arrays: dict[str, np.ndarray]):
    if isinstance(value, np.ndarray) and value.dtype != object:
        arrays[key := f"a{len(arrays)}"] = value
        return {"__array": key}
    if isinstance(value, np.generic):
        return value.item()
    if dataclasses.is_dataclass(value):
        return {"__class": [type(value).__module__.rpartition(".")[2], type(value).__name__], "fields": {k: _pack(v, arrays) for k, v in vars(value).items()}}
    if isinstance(value, dict):
        return {"__items": [[_pack(k, arrays), _pack(v, arrays)] for k, v in value.items()]}
    if isinstance(value, tuple):
        return {"__tuple": [_pack(v, arrays) for v in value]}
    if isinstance(value, (list, np.ndarray)):
        return [_pack(v, arrays) for v in value]
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise TypeError(f"cannot store {type(value).__name__}")


def _unpack(value, arrays):
    if isinstance(value, list):
        return [_unpack(v, arrays) for v in value]
    if not isinstance(value, dict):
        return value
    if "__array" in value:
        return arrays[value["__array"]]
    if "__tuple" in value:
        return tuple(_unpack(v, arrays) for v in value["__tuple"])
    if "__items" in value:
        return {_unpack(k, arrays): _unpack(v, arrays) for k, v in value["__items"]}
    module, name = value["__class"]
    if module not in MODULES:
        raise ValueError(f"unknown model module {module!r}")
    kind = getattr(importlib.import_module(f"..operators.{module}", __package__), name)
    made = kind.__new__(kind)
    for k, v in value["fields"].items():
        setattr(made, k, _unpack(v, arrays))
    return made


def _place(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def save(model, path: str) -> None:
    arrays: dict[str, np.ndarray] = {}
    meta = {"format": FORMAT, "version": VERSION, "model": _pack(model, arrays)}
    fs, base = _place(path)
    fs.create_dir(base, recursive=True)
    held = io.BytesIO()
    np.savez(held, **arrays)
    with fs.open_output_stream(f"{base}/arrays.npz") as file:
        file.write(held.getvalue())
    with fs.open_output_stream(f"{base}/meta.json") as file:
        file.write(json.dumps(meta).encode())


def load(path: str):
    fs, base = _place(path)
    with fs.open_input_file(f"{base}/meta.json") as file:
        meta = json.loads(file.read())
    if meta.get("format") != FORMAT or meta.get("version") != VERSION:
        raise ValueError("not a model file of this version")
    with fs.open_input_file(f"{base}/arrays.npz") as file:
        arrays = np.load(io.BytesIO(file.read()), allow_pickle=False)
    return _unpack(meta["model"], arrays)
