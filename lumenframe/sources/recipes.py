"""Recipes: nested dictionaries with parents, overrides, stages, validation and digests."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable, Iterable


def merged(base: dict, over: dict) -> dict:
    """Deep merge: maps are merged, everything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(name: str, read: Callable[[str], dict], overrides: Iterable[str] = (), _seen: tuple[str, ...] = ()) -> dict:
    """A recipe with its parents merged left to right beneath it, then ``a.b=value`` overrides (values in JSON, else text)."""
    if name in _seen:
        raise ValueError(f"recipe {name} is its own parent")
    own, out = dict(read(name)), {}
    parents = own.pop("parents", [])
    for p in [parents] if isinstance(parents, str) else parents:
        out = merged(out, load(p, read, (), (*_seen, name)))
    out = merged(out, own)
    for o in overrides:
        path, _, value = o.partition("=")
        try:
            value = json.loads(value)
        except ValueError:
            pass
        at = out
        *most, last = path.split(".")
        for k in most:
            at = at.setdefault(k, {})
        at[last] = value
    return out


def for_stage(config: dict, stage: str, key: str = "dataset") -> dict:
    """The dataset section with the stage's overrides; an empty map there clears the section's map instead of merging."""
    out = copy.deepcopy(config.get(key, {}))
    for k, v in config.get("stages", {}).get(stage, {}).get(key, {}).items():
        if v == {}:
            out[k] = {}
        else:
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _whole(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


#: What a value can be asked to be: name -> (test with an argument, what is said of one that fails).
TESTS: dict[str, tuple[Callable[[object, object], bool], str]] = {
    "flag": (lambda v, _: isinstance(v, bool), "is not a flag"),
    "count": (lambda v, least: _whole(v) and v >= least, "is not a whole number of at least {}"),
    "positive": (lambda v, _: _number(v) and v > 0, "is not positive"),
    "share": (lambda v, _: _number(v) and 0 <= v <= 1, "is not a probability"),
    "decay": (lambda v, _: _number(v) and 0 <= v < 1, "is not a decay below one"),
    "number": (lambda v, _: _number(v), "is not a number"),
    "choice": (lambda v, names: any(v == n and type(v) is type(n) for n in names), "is none of {}"),
    "range": (lambda v, least: isinstance(v, (list, tuple)) and len(v) == 2 and all(map(_whole, v)) and least <= v[0] <= v[1], "is not an ordered pair"),
    "sizes": (lambda v, unit: isinstance(v, (list, tuple)) and len(v) == 2 and all(_whole(x) and x > 0 and x % unit == 0 for x in v), "is not a pair of multiples of {}"),
    "equals": (lambda v, want: v == want and type(v) is type(want), "is not {}"),
    "map of counts": (lambda v, names: isinstance(v, dict) and not set(v) - set(names) and all(_whole(x) and x > 0 for x in v.values()), "is not a map of whole numbers above 0, by the names {}"),
    "unset": (lambda v, _: not v, "is no longer supported"),
}

# Names that recipes of this kind use, and what they may be. A path that begins with ``*`` is looked for in
# every map at the top, as the section of the model has a name of its own in each recipe; an absent path is sound.
RULES: list[tuple[str, str, object]] = [
    ("cpu_update_threads", "count", 1),
    ("gradient_accumulation_steps", "equals", 1),
    ("ema_weight", "decay", None),
    ("inference_weights", "choice", ("auto", "raw", "ema")),
    ("validation_weights", "choice", ("auto", "raw", "ema")),
    ("timestep_shift", "positive", None),
    ("model.timestep_shift", "positive", None),
    ("model.vae_stride", "equals", [4, 8, 8]),
    ("model.prope_mode", "choice", ("matrix", "decomposed")),
    ("model.mv_prope_mode", "choice", ("matrix", "decomposed")),
    ("dataset.batch_size", "equals", 1),
    ("*.checkpoint_outside_compile", "flag", None),
    ("*.single_sequence", "flag", None),
    ("*.grouped_attention_backward", "flag", None),
    ("*.caption_mode", "unset", None),
    ("*.clean_prefix_probability", "share", None),
    ("*.caption_overlap_threshold", "share", None),
    ("*.condition_noise", "share", None),
    ("*.chunk_group_range", "range", 1),
    ("*.chunk_size_range", "range", 1),
    ("*.training_attention_block_size", "sizes", 128),
    ("*.stage", "choice", (1, 2)),
    ("*.short_frames", "count", 1),
    ("*.stage1_steps", "count", 1),
    ("*.training_shape_buckets", "map of counts", ("tokens", "timesteps", "cameras", "chunks")),
]

#: Rules between values: (what must hold of a lookup of paths, what is said otherwise).
TOGETHER: list[tuple[Callable[[Callable[[str], object]], bool], str]] = [
    (lambda at: at("*.chunk_size_range") is None or at("*.single_sequence") is True, "chunk_size_range needs single_sequence"),
    (lambda at: at("*.chunk_size_range") is None or at("*.chunk_group_range") is None, "chunk_size_range and chunk_group_range exclude each other"),
    (lambda at: "ema" not in (at("inference_weights"), at("validation_weights")) or bool(at("ema_weight")), "averaged weights need an ema_weight"),
]


def value_at(config: object, path: str) -> object:
    """The value at a dotted path; ``*`` stands for the first top map that has the rest of it. None where there is none."""
    head, _, rest = path.partition(".")
    if head == "*":
        sections = [v for v in config.values() if isinstance(v, dict)] if isinstance(config, dict) else []
        return next((x for v in sections if (x := value_at(v, rest)) is not None), None)
    value = config.get(head) if isinstance(config, dict) else None
    return value_at(value, rest) if rest else value


def faults(config: object, rules: list[tuple[str, str, object]] = RULES, together: list[tuple[Callable, str]] = TOGETHER) -> list[str]:
    """What is wrong with a recipe, of whatever shape: an empty list for a sound one.

    Callers bring rules of their own for their own keys.
    """
    if not isinstance(config, dict):
        return ["the recipe is not a map"]
    out = []
    for path, name, want in rules:
        value, (test, said) = value_at(config, path), TESTS[name]
        if value is not None and not test(value, want):
            out.append(f"{path} {said.format(want)}")
    out += [said for holds, said in together if not holds(lambda path: value_at(config, path))]
    dataset = config.get("dataset", {})
    if not isinstance(dataset, dict):
        return [*out, "dataset is not a map"]
    sources = dataset.get("sources", [])
    if not isinstance(sources, (list, tuple)):
        return [*out, "dataset.sources is not a list"]
    for i, s in enumerate(sources):
        if not isinstance(s, dict):
            out.append(f"dataset.sources[{i}] is not a map")
            continue
        if "type" not in s:
            out.append(f"dataset.sources[{i}] has no type")
        if not _number(s.get("sampling_weight_power", 0.8)):
            out.append(f"dataset.sources[{i}].sampling_weight_power is not a number")
    return out


def digest(config: dict, ignored: Iterable[str] = ()) -> str:
    """SHA-256 of a recipe without the ignored dotted keys, independent of key order."""
    c = copy.deepcopy(config)
    for path in ignored:
        at = c
        *most, last = path.split(".")
        for k in most:
            at = at.get(k, {}) if isinstance(at, dict) else {}
        if isinstance(at, dict):
            at.pop(last, None)
    return hashlib.sha256(json.dumps(c, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
