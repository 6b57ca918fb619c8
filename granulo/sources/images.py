"""Grey images and their tags from TIFF files, decoded by numpy where Spark reads them."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulo.functions import units

#: Numbers and sizes of the format's field types, and of its fields that are used here.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_NAMES = {256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "Photometric", 273: "StripOffsets", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 34118: "CZ_SEM"}


def fields(data: bytes) -> dict[int, tuple]:
    """Values of the first directory by field number."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    out = {}
    for k in range(n):
        e = at + 2 + 12 * k
        tag, kind, count = struct.unpack(order + "HHI", data[e : e + 8])
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        start = e + 8 if size * count <= 4 else struct.unpack(order + "I", data[e + 8 : e + 12])[0]
        raw = data[start : start + size * count]
        out[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(order + code * count, raw)
    return out


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def pixels(data: bytes) -> np.ndarray:
    """The first page as 8-bit grey; colours by their usual weights."""
    f, order = fields(data), "<" if data[:2] == b"II" else ">"
    w, h, bits, samples = f[256][0], f[257][0], f.get(258, (8,))[0], f.get(277, (1,))[0]
    unpack = {1: bytes, 32773: _packbits}.get(f.get(259, (1,))[0])
    if unpack is None or bits not in (8, 16):
        raise ValueError("only uncompressed and PackBits images of 8 or 16 bits are read")
    raw = b"".join(unpack(data[o : o + n]) for o, n in zip(f[273], f[279], strict=True))
    a = np.frombuffer(raw, f"{order}u{bits // 8}", w * h * samples).reshape(h, w, samples)
    a = (a >> 8).astype(np.uint8) if bits == 16 else a
    grey = a[:, :, 0] if samples < 3 else np.round(a[:, :, :3] @ [0.299, 0.587, 0.114]).astype(np.uint8)
    return 255 - grey if f.get(262, (1,))[0] == 0 else grey


def tags(data: bytes) -> dict[str, str]:
    """Texts by name: the format's own fields; of the microscope's block each entry as `label|value|unit`, and its leading
    plain numbers, joined, under the empty name."""
    f = fields(data)
    out = {_NAMES.get(k, str(k)): " ".join(map(str, v)) for k, v in f.items() if k != 34118}
    if 34118 in f:
        lines = [x.strip() for x in str(f[34118][0]).splitlines()]
        numbers = []
        for x in lines:
            if not re.fullmatch(r"[-+0-9.eE]+", x):
                break
            numbers.append(x)
        out[""] = "|".join(numbers)
        for name, entry in zip(lines, lines[1:], strict=False):
            if re.fullmatch(r"[A-Z]{2}_[A-Z0-9_]+", name) and "=" in entry:
                label, _, value = entry.partition("=")
                number, _, unit = value.strip().partition(" ")
                out[name.lower()] = "|".join([label.strip(), value.strip()] if name == "AP_MAG" else [label.strip(), number, unit.strip()])
    return out


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ds_id, path, content) of .tif files; ds_id is the full name of the folder."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path)
    return df.select(F.element_at(F.split("path", "/"), -2).alias("ds_id"), "path", "content")


def info(images: DataFrame) -> DataFrame:
    """(ds_id, img_name, tags, magnification, px_size, old_format): old_format warns of a pixel size whose unit no tag tells."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(tags(x).items()) for x in b.column(2).to_pylist()], pa.map_(pa.string(), pa.string()))], ["ds_id", "path", "tags"])

    t = images.select("ds_id", "path", "content").mapInArrow(run, "ds_id string, path string, tags map<string,string>")
    mag = units.magnification(F.get(F.split(F.col("tags")["ap_mag"], r"\|"), F.lit(1)))
    return t.select("ds_id", F.element_at(F.split("path", "/"), -1).alias("img_name"), "tags", mag.alias("magnification"), units.pixel_size(F.col("tags")).alias("px_size"), units.old_format(F.col("tags")).alias("old_format"))
