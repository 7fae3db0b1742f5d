"""Element types, their promotion, and how Spark columns hold them.

Spark has no unsigned, half or complex numbers. Unsigned ones are held in the
next wider signed type with a range check, 64-bit ones as decimals, halves as
floats that are rounded to a half, complex ones as a struct of re and im.
"""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    family: str  # bit, int, uint, float or complex
    bits: int
    sql: str


_ALL = (
    Kind("bit", "bit", 1, "boolean"),
    Kind("int8", "int", 8, "tinyint"),
    Kind("int16", "int", 16, "smallint"),
    Kind("int32", "int", 32, "int"),
    Kind("int64", "int", 64, "bigint"),
    Kind("uint8", "uint", 8, "smallint"),
    Kind("uint16", "uint", 16, "int"),
    Kind("uint32", "uint", 32, "bigint"),
    Kind("uint64", "uint", 64, "decimal(20,0)"),
    Kind("float16", "float", 16, "float"),
    Kind("float32", "float", 32, "float"),
    Kind("float64", "float", 64, "double"),
    Kind("complex_float16", "complex", 16, "struct<re:float,im:float>"),
    Kind("complex_float32", "complex", 32, "struct<re:float,im:float>"),
    Kind("complex_float64", "complex", 64, "struct<re:double,im:double>"),
)
KINDS = {k.name: k for k in _ALL}
DTYPES = tuple(KINDS)
_ALIASES = {
    "bool": "bit", "bool_": "bit", "boolean": "bit", "int": "int32", "integer": "int32", "half": "float16", "single": "float32", "double": "float64", "float": "float64",
    "complex": "complex_float64", "complex64": "complex_float32", "complex128": "complex_float64", "complex32": "complex_float16",
    **{f"{p}{b}": f"{w}{b}" for p, w, widths in (("i", "int", (8, 16, 32, 64)), ("u", "uint", (8, 16, 32, 64)), ("f", "float", (16, 32, 64)), ("cf", "complex_float", (16, 32, 64))) for b in widths},
}
_NUMPY = {"bit": np.bool_, "complex_float16": np.complex64, "complex_float32": np.complex64, "complex_float64": np.complex128}


def normalize(dtype) -> str:
    """The name of an element type given by name, Python type or NumPy type."""
    if isinstance(dtype, str):
        name = dtype.lower()
    elif isinstance(dtype, type) and dtype in (bool, int, float, complex):
        name = dtype.__name__
    else:
        try:
            name = np.dtype(dtype).name
        except TypeError:
            raise TypeError(f"not an element type: {dtype!r}") from None
    name = _ALIASES.get(name, name)
    if name not in KINDS:
        raise TypeError(f"not an element type: {dtype!r}")
    return name


def numpy_type(dtype: str):
    return np.dtype(_NUMPY.get(dtype, dtype))


def itemsize(dtype: str) -> float:
    k = KINDS[dtype]
    return k.bits / 8 * (2 if k.family == "complex" else 1)


_MODE: ContextVar[str] = ContextVar("precision", default="lowest")


@contextmanager
def precision_mode(mode: str):
    """Within it, mixed floats become the smallest ("lowest", the default) or the largest ("highest") of them."""
    if mode not in ("lowest", "highest"):
        raise ValueError("mode is 'lowest' or 'highest'")
    token = _MODE.set(mode)
    try:
        yield
    finally:
        _MODE.reset(token)


def current_mode() -> str:
    return _MODE.get()


def resolve(op: str, a: str, b: str) -> str:
    """Element type of ``op`` on ``a`` and ``b``."""
    x, y = KINDS[a], KINDS[b]
    both = (x, y)
    pick = min if _MODE.get() == "lowest" else max
    floating = [k.bits for k in both if k.family in ("float", "complex")]
    if any(k.family == "complex" for k in both):
        return f"complex_float{pick(floating)}"
    if floating:
        return f"float{pick(floating)}"
    if op == "divide":
        return "float32" if _MODE.get() == "lowest" else "float64"
    if x.family == y.family == "bit":
        return "bit" if op in ("hadamard", "mul", "outer") else "int32"
    if "bit" in (x.family, y.family):
        return b if x.family == "bit" else a
    if x.family == y.family:
        return f"{x.family}{max(x.bits, y.bits)}"
    signed, unsigned = both if x.family == "int" else (y, x)
    for width in (8, 16, 32, 64):
        if width >= signed.bits and width > unsigned.bits:
            return f"int{width}"
    raise TypeError(f"no signed type holds both {a} and {b}")


# Columns of values


def family(dtype: str) -> str:
    return KINDS[dtype].family


def is_complex(dtype: str) -> bool:
    return family(dtype) == "complex"


def _half(x: Column) -> Column:
    """``x`` rounded to the nearest half-precision number, ties to even."""
    d = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(d))), F.lit(-14)) - 10)
    near = F.rint(d / step) * step
    out = F.when((d == 0) | F.isnan(d) | (F.abs(d) == float("inf")), d).when(F.abs(near) > 65504, F.signum(d) * float("inf")).otherwise(near)
    return out.cast("float")


def _real(x: Column, source: str, target: str) -> Column:
    k, f = KINDS[target], KINDS[source].family
    if f == "bit":
        x = x.cast("int")
    if k.family == "bit":
        return x != 0
    if k.family == "float":
        return _half(x) if k.bits == 16 and source != "float16" else x.cast(k.sql)
    if k.family == "uint":
        wide = x.cast("decimal(38,0)") if f != "float" else F.when(F.isnan(x.cast("double")), F.raise_error(F.lit("not a number"))).otherwise(F.floor(x.cast("double")).cast("decimal(38,0)"))
        top = (1 << k.bits) - 1
        return F.when((wide >= 0) & (wide <= F.lit(str(top)).cast("decimal(38,0)")), wide.cast(k.sql)).otherwise(F.raise_error(F.concat(F.lit(f"out of range for {target}: "), wide.cast("string"))).cast(k.sql))
    return x.cast(k.sql)


def cast(x: Column, source: str, target: str) -> Column:
    """A value column as another element type; a value that does not fit raises."""
    if source == target:
        return x
    if is_complex(target):
        part = f"float{KINDS[target].bits}"
        re, im = (x["re"], x["im"]) if is_complex(source) else (x, F.lit(0.0))
        of = f"float{KINDS[source].bits}" if is_complex(source) else source
        return F.struct(_real(re, of, part).alias("re"), _real(im, of if is_complex(source) else "float64", part).alias("im"))
    return _real(x["re"], f"float{KINDS[source].bits}", target) if is_complex(source) else _real(x, source, target)


def wide_type(dtype: str) -> str:
    """The type in which sums of this one are taken."""
    return {"bit": "int64", "int": "int64", "uint": "uint64" if KINDS[dtype].bits == 64 else "int64", "float": "float64", "complex": "complex_float64"}[family(dtype)]


def widen(x: Column, dtype: str) -> Column:
    return cast(x, dtype, wide_type(dtype))


def narrow(x: Column, wide_of: str, target: str) -> Column:
    """A sum, in the wide type of ``wide_of``, as ``target``."""
    return cast(x, wide_type(wide_of), target)


def zero(dtype: str) -> Column:
    return F.expr(f"named_struct('re', cast(0 as {'double' if KINDS[dtype].bits == 64 else 'float'}), 'im', cast(0 as {'double' if KINDS[dtype].bits == 64 else 'float'}))") if is_complex(dtype) else F.lit(False) if dtype == "bit" else F.lit(0).cast(KINDS[dtype].sql)


def literal(value, dtype: str) -> Column:
    if is_complex(dtype):
        part = "double" if KINDS[dtype].bits == 64 else "float"
        v = complex(value)
        return F.struct(F.lit(v.real).cast(part).alias("re"), F.lit(v.imag).cast(part).alias("im"))
    if isinstance(value, complex):
        raise TypeError(f"a complex number does not fit {dtype}")
    return F.lit(bool(value)) if dtype == "bit" else cast(F.lit(value), "float64" if isinstance(value, float) else "int64", dtype)


def pair(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def plus(x: Column, y: Column, cplx: bool) -> Column:
    return pair(x["re"] + y["re"], x["im"] + y["im"]) if cplx else x + y


def minus(x: Column, cplx: bool) -> Column:
    return pair(-x["re"], -x["im"]) if cplx else -x


def times(x: Column, y: Column, cplx: bool) -> Column:
    return pair(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"]) if cplx else x * y


def ieee_divide(x: Column, y: Column) -> Column:
    """Division that gives inf and nan where the session would raise."""
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).otherwise(F.signum(x) * float("inf"))
    return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))


def over(x: Column, y: Column, cplx: bool) -> Column:
    if not cplx:
        return ieee_divide(x, y)
    size = y["re"] * y["re"] + y["im"] * y["im"]
    return pair(ieee_divide(x["re"] * y["re"] + x["im"] * y["im"], size), ieee_divide(x["im"] * y["re"] - x["re"] * y["im"], size))


def conjugate(x: Column, dtype: str) -> Column:
    return pair(x["re"], -x["im"]) if is_complex(dtype) else x


def total(x: Column, cplx: bool) -> Column:
    return pair(F.sum(x["re"]), F.sum(x["im"])) if cplx else F.sum(x)


def nonzero(x: Column, dtype: str) -> Column:
    return (x["re"] != 0) | (x["im"] != 0) if is_complex(dtype) else x if dtype == "bit" else x != 0


def python_value(v, dtype: str):
    if v is None:
        return 0j if is_complex(dtype) else False if dtype == "bit" else 0 if family(dtype) in ("int", "uint") else 0.0
    if is_complex(dtype):
        return complex(v["re"], v["im"])
    return int(v) if family(dtype) in ("int", "uint") else v
