"""Working directories: settings beside images/<name>/<image file>. Driver-side only."""

from __future__ import annotations

import shutil
from pathlib import Path

from granulo.errors import LayoutError, SeveralFilesError

from . import settings as S

IMAGES = "images"
FORMATS = (".tif",)


def find_images(folder: str | Path) -> list[Path]:
    """Image files of a folder, not of those below."""
    return sorted(p for p in Path(folder).iterdir() if p.suffix in FORMATS)


def _image_path(folder: Path, file: str) -> Path:
    p = folder / file
    if p.suffix:
        if not p.is_file():
            raise LayoutError(f"no image {p}")
        return p
    fits = [p.with_suffix(x) for x in FORMATS if p.with_suffix(x).is_file()]
    if len(fits) != 1:
        raise LayoutError(f"{len(fits)} images fit {p}")
    return fits[0]


def datasets(path: str | Path, settings: dict, ignore: bool = True) -> dict[str, Path]:
    """Image paths by data set; excluded ones are left out with ignore. Every other must be there."""
    out = set(settings["data"]["exclude_images"] or []) if ignore else set()
    images = settings["data"]["images"]
    return {k: _image_path(Path(path) / IMAGES / k, v["img_file"] or f"{k}.tif") for k, v in images.items() if k not in out}


def settings_file(path: str | Path) -> Path:
    found = S.find(path)
    if len(found) > 1:
        raise SeveralFilesError(f"{len(found)} settings files in {path}")
    if not found:
        raise LayoutError(f"no settings file in {path}")
    return found[0]


def validate(path: str | Path) -> dict[str, Path]:
    """Data sets of a directory that has exactly one valid settings file and all images it names."""
    return datasets(path, S.load(settings_file(path)))


def is_valid(path: str | Path) -> bool:
    try:
        validate(path)
    except (LayoutError, OSError):
        return False
    return True


def initialise(path: str | Path, move: bool = False) -> list[Path]:
    """Puts each image of a settings file into images/<name>/; copies unless told to move."""
    path, out = Path(path), []
    s = S.load(settings_file(path))
    for name, image in s["data"]["images"].items():
        source = _image_path(path, image["img_file"] or f"{name}.tif")
        to = path / IMAGES / name
        to.mkdir(parents=True, exist_ok=True)
        (shutil.move if move else shutil.copy2)(str(source), str(to / source.name))
        out.append(to / source.name)
    return out


def particle_files(path: str | Path, settings: dict) -> dict[str, str]:
    """Particle files by data set, for those that name one that is there."""
    out = {}
    for name, image_path in datasets(path, settings).items():
        f = settings["data"]["images"][name]["HCT_file"]
        if f and (image_path.parent / f).is_file():
            out[name] = str(image_path.parent / f)
    return out
