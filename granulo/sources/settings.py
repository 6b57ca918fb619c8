"""Settings of a batch: YAML in, validated, with defaults and automatic values resolved. Driver-side only."""

from __future__ import annotations

import copy
from collections.abc import Mapping
from pathlib import Path

import yaml

from granulo.errors import SettingsError
from granulo.functions.values import is_default, is_default_or_none

FILE_NAME = "settings.yml"
SUFFIXES = (".yml", ".yaml")

#: Settings of a new file.
IMAGE_DEFAULTS = {
    "img_file": "auto", "HCT_file": "auto", "magnification": "auto", "pixel_size": "auto", "crop_ratio": 0.0, "median_blur": 3,
    "d_min": [3, 50], "d_max": [50, 140], "dist2R": 0.5, "param1": 200, "param2": 15, "additional_info": None,
}
#: What an image without an entry has instead: no particle file, so it is searched for circles.
NO_ENTRY = {"img_file": "", "HCT_file": ""}
DEFAULTS = {
    "general": {"working_dir": "."},
    "metadata": {"conditions": {}},
    "data": {"default": IMAGE_DEFAULTS, "images": {}, "exclude_images": []},
    "analysis": {"PSD_space": None, "collector_threshold": 0.5},
    "export": {"draw_particles": {"labels": True, "alpha": 0.2}},
}
DETECTION = ("d_min", "d_max", "dist2R", "param1", "param2")

_NONE = type(None)
#: What may stand at each key; a mapping asks for exactly its keys.
IMAGE_SCHEMA = {
    "img_file": (str, _NONE), "HCT_file": (str, _NONE), "magnification": (int, float, str), "pixel_size": (int, float, str), "crop_ratio": (float,), "median_blur": (int, _NONE),
    "d_min": (list, int), "d_max": (list, int), "dist2R": (list, float, int), "param1": (list, float, int), "param2": (list, float, int), "additional_info": (str, _NONE),
}
SCHEMA = {
    "general": {"working_dir": (str,)},
    "metadata": {"conditions": (dict,)},
    "data": {"default": IMAGE_SCHEMA, "images": (dict,), "exclude_images": (list,)},
    "analysis": {"PSD_space": (_NONE, dict), "collector_threshold": (int, float)},
    "export": {"draw_particles": {"labels": (bool,), "alpha": (int, float)}},
}


def _check(value, schema, route: str) -> None:
    if isinstance(schema, Mapping):
        if not isinstance(value, Mapping):
            raise SettingsError(f"{route or 'settings'}: not a mapping")
        for what, keys in (("missing", schema.keys() - value.keys()), ("unknown", value.keys() - schema.keys())):
            if keys:
                raise SettingsError(f"{what} key {'.'.join(x for x in (route, sorted(map(str, keys))[0]) if x)}")
        for k, s in schema.items():
            _check(value[k], s, f"{route}.{k}" if route else k)
    elif not isinstance(value, schema) or (isinstance(value, bool) and bool not in schema):
        raise SettingsError(f"{route}: {value!r} is of a wrong type")


def check_conditions(conditions: Mapping) -> None:
    """Each condition is a number and a unit."""
    for k, v in conditions.items():
        if not (isinstance(v, (list, tuple)) and len(v) == 2 and isinstance(v[0], (int, float)) and isinstance(v[1], str)):
            raise SettingsError(f"metadata.conditions.{k}: {v!r} is not [number, unit]")


def validate(settings) -> dict:
    """A copy of settings in which images without entries have the library's defaults and NO_ENTRY; errors name the key's route."""
    if not isinstance(settings, Mapping):
        raise SettingsError("settings: not a mapping")
    s = copy.deepcopy(dict(settings))
    _check(s, SCHEMA, "")
    check_conditions(s["metadata"]["conditions"])
    for name, image in s["data"]["images"].items():
        if image is None:
            s["data"]["images"][name] = copy.deepcopy(IMAGE_DEFAULTS) | NO_ENTRY
        else:
            _check(image, IMAGE_SCHEMA, f"data.images.{name}")
    return s


def is_valid(settings) -> bool:
    try:
        validate(settings)
    except SettingsError:
        return False
    return True


def resolve(value, keep: tuple[str, ...] = ("default",)):
    """Automatic and empty texts become None, at any depth but below the keys to keep."""
    if isinstance(value, Mapping):
        return {k: v if k in keep else resolve(v, keep) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, keep) for v in value]
    return None if isinstance(value, str) and is_default_or_none(value) else value


def name_files(settings: dict) -> dict:
    """File names of images: an automatic or empty image file is `<name>.tif`; an automatic particle file is
    `<name>_HCT.csv`, an empty one none."""
    s = copy.deepcopy(settings)
    for name, image in s["data"]["images"].items():
        if image["img_file"] is None or is_default_or_none(image["img_file"]):
            image["img_file"] = f"{name}.tif"
        h = image["HCT_file"]
        image["HCT_file"] = f"{name}_HCT.csv" if h is not None and is_default(h) else None if h is None or is_default_or_none(h) else h
    return s


def read(path: str | Path) -> dict:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def is_valid_file(path: str | Path) -> bool:
    try:
        return is_valid(read(path))
    except (OSError, yaml.YAMLError, UnicodeDecodeError):
        return False


def load(path: str | Path, resolved: bool = True) -> dict:
    s = validate(read(path))
    return resolve(name_files(s)) if resolved else s


def find(folder: str | Path) -> list[Path]:
    """The valid settings files of a folder."""
    return [p for p in sorted(Path(folder).iterdir()) if p.suffix in SUFFIXES and is_valid_file(p)]


def new(images: list[str | Path]) -> dict:
    """Settings for image files, as written by dump()."""
    s = copy.deepcopy(DEFAULTS)
    s["data"]["images"] = {Path(i).stem: {"img_file": Path(i).name} for i in images}
    return s


ANCHOR = "default_img"


class _Merge(str):
    """The key by which a mapping takes over another."""


class _Dumper(yaml.SafeDumper):
    """Names the one mapping that others refer to by ANCHOR, and never refers to anything else."""

    def generate_anchor(self, node):
        return ANCHOR

    def ignore_aliases(self, data):
        return not (isinstance(data, dict) and data is self.shared)

    shared: dict | None = None


_Dumper.add_representer(_Merge, lambda d, k: d.represent_scalar("tag:yaml.org,2002:merge", str(k)))


def dump(settings: dict) -> str:
    """YAML in which each image takes the default branch by an anchor and states only what differs."""
    s = copy.deepcopy(settings)
    default = s["data"]["default"]
    s["data"]["images"] = {k: {_Merge("<<"): default, **v} for k, v in s["data"]["images"].items()}
    named = type("Named", (_Dumper,), {"shared": default})
    return yaml.dump(s, Dumper=named, default_flow_style=False, sort_keys=False, allow_unicode=True)


def create(folder: str | Path, output: str | Path = FILE_NAME, images: list | None = None, overwrite: bool = False) -> Path:
    """Writes a settings file for the images of a folder; an existing one stays unless told otherwise."""
    images = images if images is not None else sorted(Path(folder).glob("*.tif"))
    path = Path(output) if Path(output).is_absolute() else Path(folder) / output
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.write_text(dump(new(images)), encoding="utf-8")
    return path
