"""Saving, loading and exporting. A saved object is a folder: Parquet parts and a one-row table of metadata, both under Spark's commit protocol."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import dtypes as D
from tessera.functions.frames import parts
from tessera.operators import causal
from tessera.operators.array import Array, Matrix, Vector, session

from .constructors import from_numpy

_LIMIT: dict[str, int | None] = {"export": 1 << 31}
_STORE: dict[str, str] = {}


def set_export_max_bytes(limit: int | None) -> None:
    """Most bytes that to_numpy brings to the driver; None for no limit."""
    if limit is not None and limit < 0:
        raise ValueError("a limit is a number of bytes, or None")
    _LIMIT["export"] = limit


def to_numpy(x, *, allow_huge: bool = False, dtype=None, copy: bool = True) -> np.ndarray:
    """The array on the driver; refused above the export limit unless ``allow_huge``."""
    if isinstance(x, np.ndarray):
        return x.astype(dtype) if dtype is not None else x.copy() if copy else x
    r, c = x.shape
    kind = D.numpy_type(x.dtype)
    if not allow_huge and _LIMIT["export"] is not None and r * c * kind.itemsize > _LIMIT["export"]:
        raise MemoryError(f"{r}x{c} of {x.dtype} is above the export limit; pass allow_huge=True")
    table = x.df.toArrow()
    v = table["v"].combine_chunks()
    if x.is_complex:
        values = v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False)
    elif x.dtype == "uint64":
        values = np.array([int(y) for y in v.to_pylist()], dtype=np.uint64)
    else:
        values = v.to_numpy(zero_copy_only=False)
    if isinstance(x, Vector):
        out = np.zeros(len(x), dtype=kind)
        out[table["i"].to_numpy()] = values
    else:
        out = np.zeros((r, c), dtype=kind)
        out[table["i"].to_numpy(), table["j"].to_numpy()] = values
    return out if dtype is None else out.astype(dtype)


def _plain(value):
    if isinstance(value, complex):
        return {"complex": [value.real, value.imag]}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def _restored(value):
    if isinstance(value, dict) and set(value) == {"complex"}:
        return complex(*value["complex"])
    return [_restored(v) for v in value] if isinstance(value, list) else value


def _describe(x) -> dict:
    if isinstance(x, causal.CausalSet):
        st = x.spacetime
        args = {"MinkowskiDiamond": lambda: [st.dimension()], "MinkowskiCylinder": lambda: [2, st.height, st.circumference], "MinkowskiBox": lambda: [st.dimension(), st.time_extent, st.space_extent]}
        if type(st).__name__ not in args:
            raise TypeError("only causal sets of this package's regions can be saved")
        return {"kind": "causal_set", "n": len(x), "seed": x.seed, "order": x.order, "given": x._given, "spacetime": [type(st).__name__, *args[type(st).__name__]()], "matrix": _describe(x.C)}
    out = {"kind": "vector" if isinstance(x, Vector) else "matrix", "shape": list(x.shape), "dtype": x.dtype, "structure": x.structure, "properties": {k: _plain(v) for k, v in x.properties.items() if k != "eigenvectors"}}
    return {**out, "is_row": x.is_row} if isinstance(x, Vector) else {**out, "row_partitions": x.row_partitions, "col_partitions": x.col_partitions}


def save(x, path, *, overwrite: bool = True) -> None:
    """Write an array or causal set to the folder ``path``.

    A block matrix is partitioned by block, others are clustered by row, so a
    later slice reads the row groups it needs.
    """
    path, payload = str(path).rstrip("/"), x.C if isinstance(x, causal.CausalSet) else x
    part = f"payload-{uuid.uuid4().hex}"
    if isinstance(payload, Matrix) and payload.row_partitions:
        from tessera.operators.blocks import with_blocks

        rows, n = with_blocks(payload), parts(payload.df)
        if n > payload.spark.sparkContext.defaultParallelism:  # a block is cut by rows, in more pieces than tasks so that they are even
            rows = rows.repartition(n, "bi", "bj", F.floor(F.col("i") / max(1, payload.shape[0] // (16 * n))))
        else:
            rows = rows.repartition("bi", "bj")
        rows.sortWithinPartitions("bi", "bj", "i", "j").write.partitionBy("bi", "bj").parquet(f"{path}/{part}")
    else:
        payload.df.repartitionByRange("i").sortWithinPartitions(*payload.axes).write.parquet(f"{path}/{part}")
    meta = json.dumps({"version": 1, "payload": part, **_describe(x)})
    payload.spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite" if overwrite else "error").parquet(f"{path}/meta")


def inspect(path, spark: SparkSession | None = None) -> dict:
    """The metadata of a saved object and the files of its payload."""
    path, spark = str(path).rstrip("/"), spark or session()
    meta = json.loads(spark.read.schema("meta string").parquet(f"{path}/meta").first()["meta"])
    return {**meta, "files": spark.read.parquet(f"{path}/{meta['payload']}").inputFiles()}


def load(path, spark: SparkSession | None = None):
    """A saved array or causal set, with its properties and values that were kept."""
    path, spark = str(path).rstrip("/"), spark or session()
    meta = json.loads(spark.read.schema("meta string").parquet(f"{path}/meta").first()["meta"])
    own = meta["matrix"] if meta["kind"] == "causal_set" else meta
    kind = D.KINDS[own["dtype"]].sql
    axes = "i bigint" if own["kind"] == "vector" else "i bigint, j bigint"
    df = spark.read.schema(f"{axes}, v {kind}").parquet(f"{path}/{meta['payload']}")
    props = {k: _restored(v) for k, v in own["properties"].items()}
    if own["kind"] == "vector":
        return Vector(df, max(own["shape"]) if 0 not in own["shape"] else 0, own["dtype"], own["is_row"], props)
    m = Matrix(df, *own["shape"], own["dtype"], own["structure"], props, own["row_partitions"], own["col_partitions"])
    if meta["kind"] != "causal_set":
        return m
    name, *args = meta["spacetime"]
    out = causal.CausalSet(meta["n"], spacetime=getattr(causal, name)(*args), seed=meta["seed"], matrix=m, order=meta["order"], spark=spark)
    out._given = meta["given"]
    return out


# NumPy files, which are read and written by the driver


def load_npy(path, spark: SparkSession | None = None) -> Array:
    return from_numpy(np.load(path), spark=spark)


def save_npy(x, path, *, allow_huge: bool = False, dtype=None) -> Path:
    with open(path, "wb") as f:
        np.save(f, to_numpy(x, allow_huge=allow_huge, dtype=dtype))
    return Path(path)


def load_npz(path, *, key: str | None = None, spark: SparkSession | None = None) -> Array:
    """The array of a key, or of the first key in order."""
    with np.load(path) as found:
        names = sorted(found.files)
        if not names or key is not None and key not in names:
            raise KeyError(key)
        return from_numpy(found[key or names[0]], spark=spark)


def save_npz(x, path, *, key: str = "array", allow_huge: bool = False, dtype=None) -> Path:
    with open(path, "wb") as f:
        np.savez(f, **{key: to_numpy(x, allow_huge=allow_huge, dtype=dtype)})
    return Path(path)


def convert_file(src, dst, *, dst_format: str | None = None, allow_huge: bool = False, dtype=None, npz_key: str | None = None, spark: SparkSession | None = None) -> Path:
    """Between .npy, .npz and this package's folders, by suffix."""

    def kind(p, explicit=None):
        return (explicit or Path(p).suffix.lstrip(".") or "folder").lower()

    readers = {"npy": lambda: load_npy(src, spark), "npz": lambda: load_npz(src, key=npz_key, spark=spark)}
    x = readers.get(kind(src), lambda: load(src, spark))()
    if dtype is not None:
        x = x.as_type(dtype)
    target = kind(dst, dst_format)
    if target == "npy":
        save_npy(x, dst, allow_huge=allow_huge)
    elif target == "npz":
        save_npz(x, dst, key=npz_key or "array", allow_huge=allow_huge)
    else:
        save(x, dst)
    return Path(dst)


def set_backing_dir(path) -> Path:
    """The folder for inverses that are kept."""
    _STORE["dir"] = str(path)
    return Path(path)


def kept_inverse(m: Matrix, name: str) -> Matrix:
    """The inverse of ``m``, saved in the backing folder under ``name`` and a digest of the cells when first asked for; a folder that went missing raises."""
    from tessera.operators.linalg import invert

    if "dir" not in _STORE:
        raise ValueError("set_backing_dir first")
    row = m.df.agg(F.count("*"), F.sum(F.xxhash64(*m.axes, "v").cast("decimal(38,0)"))).first()
    path = f"{_STORE['dir'].rstrip('/')}/{name}-{m.shape[0]}-{m.dtype}-{row[0]}-{row[1]}.inverse"
    if path not in _KEPT:
        save(invert(m), path)
        _KEPT.add(path)
    return load(path, m.spark)


_KEPT: set[str] = set()


def clean(x: Array) -> Array:
    """``x`` without cells that hold an explicit zero."""
    return x._new(x.df.filter(D.nonzero(F.col("v"), x.dtype)), props=dict(x.properties))
